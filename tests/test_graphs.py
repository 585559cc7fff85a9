"""Forests, paths and trees against plain Python on random graphs."""

import heapq
import itertools
import math
import random

import pytest
from pyspark.sql import functions as F

from netloom.operators import base, graph, paths, planning, trees

EDGES, WEIGHTED = "plan int, a long, b long", "plan int, a long, b long, w double"


def at(spark, *nodes):
    return spark.createDataFrame([(0, n) for n in nodes], "plan int, node long")


def priced(spark, sources):
    return spark.createDataFrame([(0, n, float(c)) for n, c in sources.items()], "plan int, node long, cost double")


def random_graph(rng, n, share, most=50):
    return [(a, b, float(rng.randint(1, most))) for a, b in itertools.combinations(range(n), 2) if rng.random() < share]


def near(pairs):
    out = {}
    for a, b, w in pairs:
        out.setdefault(a, []).append((b, w))
        out.setdefault(b, []).append((a, w))
    return out


def kruskal(pairs):
    top = {}

    def of(x):
        while top.get(x, x) != x:
            x = top[x]
        return x

    out = []
    for w, a, b in sorted((w, min(a, b), max(a, b)) for a, b, w in pairs):
        if of(a) != of(b):
            top[of(a)] = of(b)
            out.append((a, b, w))
    return sorted(out)


@pytest.mark.parametrize("levels", [1, 3, 16])
def test_orientation_at_any_depth(spark, monkeypatch, levels):
    monkeypatch.setattr(graph, "RING", 40)  # rings in several parts
    rng = random.Random(levels)
    up = {i: max(0, i - rng.randint(1, 3)) if i % 7 else 0 for i in range(1, 60)} | {101: 100, 102: 101}
    pairs = [(0, *rng.sample(p, 2)) for p in up.items()] + [(0, 200, 201)]  # one part has no root
    oriented = graph.orient(spark.createDataFrame(pairs, EDGES), at(spark, 0, 100), levels)
    depth = {0: 0, 100: 0}
    for n, p in up.items():
        depth[n] = depth[p] + 1
    assert {r.node: (r.parent, r.depth) for r in oriented.collect()} == {n: (up.get(n), d) for n, d in depth.items()}
    sums = dict.fromkeys(depth, 0.0)
    for n in depth:
        m = n
        while m is not None:
            sums[m] += n
            m = up.get(m)
    demand = spark.createDataFrame([(0, n, float(n)) for n in depth], "plan int, node long, flow double")
    assert {r.node: r.flow for r in graph.subtree_flow(oriented, demand).collect()} == sums


def test_a_long_chain_takes_few_rounds(spark, monkeypatch):
    n, rounds = 20_000, []
    real = graph.cut
    monkeypatch.setattr(graph, "cut", lambda df, *old: rounds.append(1) or real(df, *old))
    df = spark.range(1, n).select(F.lit(0).alias("plan"), (F.col("id") - 1).alias("node"), F.col("id").alias("next"))
    far = graph.ends(df)
    assert far.agg(F.max("hops"), F.min("last"), F.count("last")).first() == (n - 1, n - 1, n - 1)
    assert len(rounds) <= math.ceil(math.log2(n)) + 2


def test_links_in_a_ring_are_an_error(spark):
    with pytest.raises(ValueError, match="ring"):
        graph.ends(spark.createDataFrame([(0, 1, 2), (0, 2, 3), (0, 3, 1)], "plan int, node long, next long"))


def test_shortest_paths(spark):
    rng = random.Random(3)
    pairs = random_graph(rng, 40, 0.1, most=5)  # many ties
    sources = {0: 0.0, 7: 3.0}
    best, queue, links = {}, [(c, 0, s, -1, s) for s, c in sources.items()], near(pairs)
    heapq.heapify(queue)
    while queue:
        c, h, s, p, n = heapq.heappop(queue)
        if n not in best:
            best[n] = (c, h, s, None if p < 0 else p)
            for m, w in links.get(n, ()):
                heapq.heappush(queue, (c + w, h + 1, s, n, m))
    edges = spark.createDataFrame([(0, *p) for p in pairs], WEIGHTED)
    found = paths.shortest(edges, priced(spark, sources))
    assert {r.node: (r.cost, r.hops, r.source, r.prev) for r in found.collect()} == best
    way = {}
    for r in paths.routes(found, at(spark, *range(45))).orderBy("pos").collect():
        way.setdefault(r.target, []).append(r.node)
    for n in best:
        want = [n]
        while best[want[-1]][3] is not None:
            want.append(best[want[-1]][3])
        assert way[n] == want[::-1]
    assert set(way) == set(best)


def test_blocks_of_nodes_settle_in_few_rounds(spark, monkeypatch):
    rng = random.Random(5)
    pairs = [(i, i + 1, float(rng.randint(1, 3))) for i in range(300)] + [(i, i + rng.randint(2, 9), 4.0) for i in range(290)] + [(150, i, 500.0) for i in range(0, 300, 7) if i != 150]
    best, queue, links = {}, [(0.0, 0, -1, 0)], near(pairs)
    while queue:
        c, h, p, n = heapq.heappop(queue)
        if n not in best:
            best[n] = (c, h, None if p < 0 else p)
            for m, w in links.get(n, ()):
                heapq.heappush(queue, (c + w, h + 1, n, m))
    written = []
    monkeypatch.setattr(paths, "cut", lambda df, *old: written.append(1) or base.cut(df, *old))
    monkeypatch.setattr(paths, "BLOCK", 160)  # about eight blocks; node 150 has so many edges that joins take them
    found = paths.shortest(spark.createDataFrame([(0, *p) for p in pairs], WEIGHTED), priced(spark, {0: 0}))
    assert {r.node: (r.cost, r.hops, r.prev) for r in found.collect()} == best
    assert len(written) < 60  # one a round, and more at the start, before blocks
    assert max(h for _, h, _ in best.values()) >= 60


def test_blocked_nodes_and_bad_weights(spark):
    edges = spark.createDataFrame([(0, 1, 2, 1.0), (0, 2, 3, 1.0), (0, 1, 3, 9.0)], WEIGHTED)
    got = paths.shortest(edges, priced(spark, {1: 0}), at(spark, 2))
    assert {r.node: r.cost for r in got.collect()} == {1: 0.0, 3: 9.0}
    one_way = paths.shortest(edges, priced(spark, {3: 0}), directed=True)
    assert [r.node for r in one_way.collect()] == [3]
    with pytest.raises(ValueError, match="negative"):
        paths.shortest(spark.createDataFrame([(0, 1, 2, -1.0)], WEIGHTED), priced(spark, {1: 0}))


def test_alternatives_go_round_one_edge(spark):
    pairs = [(0, 1, 1.0), (1, 2, 1.0), (0, 3, 2.0), (3, 2, 2.0), (2, 4, 1.0)]
    got = {}
    for r in paths.alternatives(spark.createDataFrame([(0, *p) for p in pairs], WEIGHTED), priced(spark, {0: 0}), at(spark, 4)).orderBy("pos").collect():
        got.setdefault(r.ban, []).append(r.node)
    assert got == {None: [0, 1, 2, 4], 0: [0, 3, 2, 4], 1: [0, 3, 2, 4]}  # nothing goes round the last edge


def test_alternatives_ask_only_what_lies_below_an_edge(spark, monkeypatch):
    rng = random.Random(12)
    pairs = random_graph(rng, 60, 0.05, most=3) + [(i, i + 1, 2.0) for i in range(59)]
    edges, begin, targets = spark.createDataFrame([(0, *p) for p in pairs], WEIGHTED), priced(spark, {0: 0.0}), at(spark, *range(0, 60, 7))
    asked, relaxed = [], paths._relaxed
    monkeypatch.setattr(paths, "_relaxed", lambda moves, *more: asked.append(moves.count()) or relaxed(moves, *more))
    ways = {}
    for r in paths.alternatives(edges, begin, targets).orderBy("pos").collect():
        ways.setdefault((r.target, r.ban), []).append((r.node, r.cost))

    def least(without, target):
        best, queue, links = {}, [(0.0, 0, -1, 0)], near([p for p in pairs if {p[0], p[1]} != without])
        while queue:
            c, h, p, n = heapq.heappop(queue)
            if n not in best:
                best[n] = (c, h, p)
                for m, w in links.get(n, ()):
                    heapq.heappush(queue, (c + w, h + 1, n, m))
        way, n = [], target
        while n in best:
            way.append((n, best[n][0]))
            n = best[n][2]
        return way[::-1]

    want = {}
    for t in range(0, 60, 7):
        want[t, None] = way = least(set(), t)
        for ban in {round(i * (len(way) - 2) / 3) for i in range(4)} if len(way) > 1 else ():
            if other := least({way[ban][0], way[ban + 1][0]}, t):
                want[t, ban] = other
    assert ways == want
    assert asked[1] < 4 * asked[0]  # with a graph for each ban there were about thirty times as many


def turning_costs(points, pairs, sources, rate, bend, priors=None, final=()):
    """Dijkstra over (node, previous node)."""
    links = near(pairs)

    def turn(p, n, m):
        u, v = [points[n][k] - p[k] for k in (0, 1)], [points[m][k] - points[n][k] for k in (0, 1)]
        dot = u[0] * v[0] + u[1] * v[1]
        size = math.hypot(*u) * math.hypot(*v)
        return dot, math.degrees(math.acos(max(-1.0, min(1.0, dot / size)))) if size > 1e-12 else 0.0

    best, queue = {}, [(c, s, None) for s, c in sources.items()]
    while queue:
        c, n, p = heapq.heappop(queue) if all(x[2] is not None for x in queue) else queue.pop(0)
        if (n, p) in best or (p is not None and n in final):
            best.setdefault((n, p), c)
            continue
        best[n, p] = c
        for m, extra in links.get(n, ()):
            before = points[p] if p is not None else (priors or {}).get(n)
            if m == p:
                continue
            dot, angle = turn(before, n, m) if before else (0.0, 0.0)
            if dot >= -1e-7:
                heapq.heappush(queue, (c + rate * math.dist(points[n], points[m]) + extra + bend * (angle >= 5), m, n))
    out = {}
    for (n, p), c in best.items():
        if p is not None:
            out[n] = min(out.get(n, math.inf), c)
    return out


def test_turning_paths(spark):
    rng = random.Random(8)
    points = {i: (float(rng.randint(0, 9)), float(rng.randint(0, 9))) for i in range(25)}
    pairs = [(a, b, float(rng.choice([0, 0, 3]))) for a, b in itertools.combinations(points, 2) if 0 < math.dist(points[a], points[b]) < 4.5]
    edges = spark.createDataFrame([(0, *p) for p in pairs], "plan int, a long, b long, extra double")
    nodes = spark.createDataFrame([(0, n, *p) for n, p in points.items()], "plan int, node long, x double, y double")
    priors = {0: (points[0][0] - 1, points[0][1])}
    for kind in ({}, {"priors": priors}, {"final": (3, 5)}):
        more = {}
        if "priors" in kind:
            more["priors"] = spark.createDataFrame([(0, n, *p) for n, p in priors.items()], "plan int, node long, x double, y double")
        if "final" in kind:
            more["final"] = at(spark, *kind["final"])
        found = paths.turning(edges, nodes, priced(spark, {0: 0}), 2.0, 1.5, **more)
        got = {r.node: r.cost for r in paths.arrivals(found).collect()}
        want = turning_costs(points, pairs, {0: 0.0}, 2.0, 1.5, **kind)
        assert got == pytest.approx(want)
    way = {}
    for r in paths.turning_routes(found, at(spark, 7, 11)).orderBy("pos").collect():
        way.setdefault(r.target, []).append(r.node)
    links = {(a, b) for a, b, _ in pairs} | {(b, a) for a, b, _ in pairs}
    for n, w in way.items():
        assert (w[0], w[-1]) == (0, n)
        assert all(x in links for x in itertools.pairwise(w))
        assert all((points[b][0] - points[a][0]) * (points[c][0] - points[b][0]) + (points[b][1] - points[a][1]) * (points[c][1] - points[b][1]) >= -1e-7 for a, b, c in zip(w, w[1:], w[2:], strict=False))


def test_minimum_forest(spark):
    rng = random.Random(9)
    for pairs in (random_graph(rng, 60, 0.06, most=4), [(5, 5, 1.0), (1, 2, 1.0), (2, 1, 3.0)]):
        got = trees.minimum_forest(spark.createDataFrame([(0, *p) for p in pairs], WEIGHTED))
        assert sorted((r.a, r.b, r.w) for r in got.collect()) == kruskal([p for p in pairs if p[0] != p[1]])
    assert trees.minimum_forest(spark.createDataFrame([], WEIGHTED)).count() == 0


def test_parts(spark):
    got = trees.parts(spark.createDataFrame([(0, i, i + 1) for i in range(30) if i % 10 != 4], EDGES)).collect()
    assert {r.node: r.part for r in got} == {i: 0 if i < 5 else 5 if i < 15 else 15 if i < 25 else 25 for i in range(31)}


def cheapest_tree(pairs, ends):
    """Least weight of a tree that holds the ends, over all sets of further nodes."""
    nodes = {n for a, b, _ in pairs for n in (a, b)}
    best = math.inf
    for k in range(len(nodes - ends) + 1):
        for more in itertools.combinations(sorted(nodes - ends), k):
            inside = ends | set(more)
            tree = kruskal([p for p in pairs if p[0] in inside and p[1] in inside])
            if len(tree) == len(inside) - 1:
                best = min(best, sum(w for *_, w in tree))
    return best


def test_steiner_trees(spark):
    rng = random.Random(4)
    rows, cases = [], {}
    for case in range(6):
        pairs = random_graph(rng, 9, 0.45, most=20)
        cases[case] = pairs
        rows += [(case, *p) for p in pairs]
    ends = spark.createDataFrame([(c, n) for c in cases for n in (1, 4, 6)], "plan int, node long")
    roots = spark.createDataFrame([(c, n, p) for c in cases for n, p in ((0, 4.0), (8, 9.0))], "plan int, node long, price double")
    got = trees.steiner(spark.createDataFrame(rows, WEIGHTED), ends, roots, F.lit(-1).cast("long")).collect()
    exact = 0
    for case, pairs in cases.items():
        tree = [(r.a, r.b, r.w) for r in got if r.plan == case]
        assert kruskal(tree) == sorted(tree)  # no rings
        least = cheapest_tree([*pairs, (-1, 0, 4.0), (-1, 8, 9.0)], {-1, 1, 4, 6})
        weight = sum(w for *_, w in tree)
        assert least - 1e-9 <= weight <= 2 * least + 1e-9
        exact += weight == least
        leaves = [n for n in {n for a, b, _ in tree for n in (a, b)} if sum(n in e[:2] for e in tree) == 1]
        assert set(leaves) <= {-1, 1, 4, 6}
        assert all(r.hung == (r.a == -1) for r in got if r.plan == case)
    assert exact >= 3


def test_designs_of_a_small_territory(spark):
    nodes = [(1, 0.0, 0.0, None, True), (2, 100.0, 0.0, None, False), (3, 100.0, 50.0, 2.0, False), (4, 150.0, 0.0, 1.0, False), (5, 900.0, 900.0, 1.0, False)]
    nodes = spark.createDataFrame([("t", *n, False, 200, 2) for n in nodes], "territory string, id long, x double, y double, flow double, is_tie boolean, is_chamber boolean, existing_dn int, existing_degree int")
    edges = spark.createDataFrame([("t", 1, 2, 100.0), ("t", 2, 3, 50.0), ("t", 2, 4, 50.0)], "territory string, a long, b long, w double")
    pipes, plans = planning.designs(edges, nodes, (1.0,))
    assert sorted((r.top, r.bottom, r.flow, r.length, r.dn, r.nodes) for r in pipes.collect()) == [(1, 2, 3.0, 100.0, 50, [1, 2]), (2, 3, 2.0, 50.0, 50, [2, 3]), (2, 4, 1.0, 50.0, 50, [2, 4])]
    (p,) = plans.collect()
    assert (p.missing, p.broken, p.rank, p.chambers) == (1, [], 1, 2)
    cost = 200 * 74023 + 2 * 3_000_000 + 100_000_000 + 500_000
    assert p.score == pytest.approx(0.7 * cost / 25e6 + 0.3 * 200 / 100)
    got = {r.id: (r.reachable, r.length, r.dn) for r in planning.reachability(edges, nodes).collect()}
    assert got == {3: (True, 150.0, 50), 4: (True, 150.0, 50), 5: (False, None, None)}


def test_simplified_lines(spark):
    from netloom.operators import simplify

    rng = random.Random(6)
    lines = {i: [(float(k), rng.choice([0.0, 0.5, 2.0, rng.random() * 4])) for k in range(rng.choice([1, 2, 3, 40]))] for i in range(12)}

    def kept(p, i, j):
        if j - i < 2:
            return []
        ux, uy = p[j][0] - p[i][0], p[j][1] - p[i][1]
        off = []
        for k in range(i + 1, j):
            t = max(0.0, min(1.0, ((p[k][0] - p[i][0]) * ux + (p[k][1] - p[i][1]) * uy) / (ux * ux + uy * uy)))
            off.append((math.dist(p[k], (p[i][0] + t * ux, p[i][1] + t * uy)), k))
        d, k = max(off)
        return [*kept(p, i, k), k, *kept(p, k, j)] if d > 0.8 else []

    df = spark.createDataFrame([(i, k, x, y) for i, p in lines.items() for k, (x, y) in enumerate(p)], "line int, pos int, x double, y double")
    got = {}
    for r in simplify.simplified(df, 0.8).collect():
        got.setdefault(r.line, []).append(r.n)
    assert {i: sorted(v) for i, v in got.items()} == {i: sorted({0, len(p) - 1, *kept(p, 0, len(p) - 1)}) for i, p in lines.items()}


def test_smoothed_lines(spark):
    from netloom.operators import simplify

    df = spark.createDataFrame([(i, k, 5.0 * k, 5.0 * (k % 2) + 100 * i) for i in range(2) for k in range(5)], "line int, pos int, x double, y double")
    wall = spark.createDataFrame([(10.0, 99.0, 10.0, 99.5)], "cx double, cy double, dx double, dy double")
    got = {}
    for r in simplify.smoothed(df, wall, 2.0, F.lit(1.0)).collect():
        got.setdefault(r.line, []).append(r.n)
    assert {i: sorted(v) for i, v in got.items()} == {0: [0, 4], 1: [0, 1, 4]}  # of two ways of one length that by the lesser vertex


def test_ancestors_join_a_row_a_chain(spark, monkeypatch):
    n = 300
    tree = spark.createDataFrame([(0, i, i - 1 if i else None, i, i * 0.5) for i in range(n)] + [(1, 7, None, 0, 2.0)], "plan int, node long, parent long, depth int, cost double")
    sizes, real = [], graph.cut
    monkeypatch.setattr(graph, "cut", lambda df, *old: sizes.append(df.count()) or real(df, *old))
    starts = tree.select("plan", "node", F.col("node").alias("id")).unionByName(spark.createDataFrame([(2, 9, 1)], "plan int, node long, id long"))
    got = sorted(tuple(r) for r in graph.ancestors(tree, starts, "id", values=("cost",)).select("plan", "start", "id", "node", "hops", "cost").collect() if r.plan != 2)
    assert got == sorted([(0, i, i, j, i - j, j * 0.5) for i in range(n) for j in range(i + 1)] + [(1, 7, 7, 7, 0, 2.0)])
    assert max(sizes) < 3_000 < len(got) / 10  # what is written and joined again
