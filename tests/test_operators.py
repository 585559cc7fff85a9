"""Known answers of the join, interval, graph, depth and search operators."""

import itertools
import math
import random

import pytest
from pyspark.sql import functions as F

from netloom.operators import depth, graph, linear, paths, planning, rank, spatial, trees


def rows(df, *order):
    return [tuple(r) for r in df.orderBy(*order).collect()]


def test_bucket_join_gives_each_pair_once(spark):
    import random

    rng = random.Random(1)
    left = [(i, rng.uniform(0, 100), rng.uniform(0, 100)) for i in range(80)]
    right = [(i, rng.uniform(0, 100), rng.uniform(0, 100)) for i in range(80)]
    a, b = spark.createDataFrame(left, "i int, x double, y double"), spark.createDataFrame(right, "j int, u double, v double")
    got = sorted((r.i, r.j) for r in spatial.within(a, b, 13.0, ("x", "y"), ("u", "v")).collect())
    assert got == sorted((i, j) for i, x, y in left for j, u, v in right if math.hypot(x - u, y - v) <= 13.0)


def test_nearest_widens_its_radius(spark):
    a = spark.createDataFrame([(1, 0.0, 0.0), (2, 500.0, 0.0)], "i int, x double, y double")
    b = spark.createDataFrame([(7, 3.0, 0.0), (6, 0.0, 3.0)], "j int, u double, v double")
    assert rows(spatial.nearest(a, b, "i", ("x", "y"), ("u", "v"), 5.0, "j").select("i", "j"), "i") == [(1, 6), (2, 7)]


def test_pipe_contacts(spark):
    def conflict(first, second):
        data = [(0, k, *map(float, (*p, *p))) for k, p in enumerate((first, second))]
        legs = spark.createDataFrame(data, "plan int, line int, ax double, ay double, bx double, by double, first_x double, first_y double, last_x double, last_y double")
        return spatial.conflicts(legs).count() == 1

    assert conflict((0, 0, 10, 0), (5, -5, 5, 5))
    assert conflict((0, 0, 10, 0), (5, 0, 15, 0))
    assert not conflict((0, 0, 10, 0), (10, 0, 10, 10))


def test_overlap_sweep(spark):
    line = spark.createDataFrame([(1, 50.0)], "seg int, length double")
    windows = spark.createDataFrame([(1, 12.0, 28.0, 1.6, "road"), (1, 18.0, 22.0, 1.25, "gas")], "seg int, lo double, hi double, factor double, id string")
    got = rows(linear.pieces(line, windows, "seg").select("lo", "hi", "factor", F.size("ids")), "lo")
    assert got == [(0, 12, 1.0, 0), (12, 18, 1.6, 1), (18, 22, 1.6, 2), (22, 28, 1.6, 1), (28, 50, 1.0, 0)]


def _exchanges(df):
    return df._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning")


def test_pieces_take_one_shuffle_and_equal_a_naive_version(spark):
    rng = random.Random(3)
    lines = [(k, rng.choice([0.0, 7.0, 30.0, 55.5])) for k in range(60)]
    windows = [(rng.randrange(65), float(lo), lo + rng.choice([-1.0, 0.0, 1.0, 9.0, 40.0]), rng.choice([1.25, 1.6, 2.0]), rng.choice("abcé")) for lo in (rng.randint(-10, 60) for _ in range(300))]
    windows += [(1, float(i), i + 1.5, 1.1, f"w{i}") for i in range(25_000)]  # a line of several batches
    lines[1] = (1, 20_000.0)
    df = linear.pieces(spark.createDataFrame(lines, "seg int, length double"), spark.createDataFrame(windows, "seg int, lo double, hi double, factor double, id string"), "seg")
    assert _exchanges(df) == 1
    got = rows(df, "seg", "lo")
    want = []
    for k, length in lines:
        mine = [(max(0.0, lo), min(length, hi), f, i) for s, lo, hi, f, i in windows if s == k]
        mine = [w for w in mine if w[0] < w[1]]
        cuts = sorted({0.0, length, *(w[0] for w in mine), *(w[1] for w in mine)})
        for a, b in itertools.pairwise(cuts):
            on = [w for w in (mine if k != 1 else mine[max(0, int(a) - 3) : int(a) + 3] + [w for w in mine if not w[3].startswith("w")]) if w[0] <= a and b <= w[1]]
            want.append((k, a, b, max((w[2] for w in on), default=1.0), sorted({w[3] for w in on})))
    mine = {g[:3]: g for g in got}
    assert len(got) == len(mine) == len(want)
    assert [w for w in want if w[0] != 1 and mine[w[:3]] != w] == []
    late = [w for w in want if w[0] == 1 and w[1] > 200]  # far from the other windows
    assert len(late) > 19_000
    assert [w for w in late if set(mine[w[:3]][4]) != {f"w{i}" for i in range(int(w[1]) - 2, int(w[1]) + 1) if i <= w[1] and w[2] <= i + 1.5}] == []
    keyed = linear.pieces(spark.createDataFrame([((1, 2.0), 5.0), ((1, 3.0), 5.0)], "leg struct<a:int,b:double>, length double"), spark.createDataFrame([((1, 3.0), 1.0, 2.0, 1.5, "x")], "leg struct<a:int,b:double>, lo double, hi double, factor double, id string"), "leg")
    assert [(tuple(r[0]), *r[1:]) for r in keyed.orderBy("leg", "lo").collect()] == [((1, 2.0), 0.0, 5.0, 1.0, []), ((1, 3.0), 0.0, 1.0, 1.0, []), ((1, 3.0), 1.0, 2.0, 1.5, ["x"]), ((1, 3.0), 2.0, 5.0, 1.0, [])]


def test_merged_intervals_are_not_held_in_a_hash_table(spark):
    rng = random.Random(4)
    data = [(rng.randrange(9), lo, lo + rng.randint(0, 6)) for lo in (rng.randint(0, 60) for _ in range(200))]
    df = linear.merged(spark.createDataFrame(data, "k int, lo int, hi int"), ["k"])
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "Aggregate" not in plan
    assert plan.count("Sort [") == 1
    want = []
    for k in range(9):
        for _, lo, hi in sorted(r for r in data if r[0] == k):
            if want and want[-1][0] == k and lo <= want[-1][2]:
                want[-1] = (k, want[-1][1], max(hi, want[-1][2]))
            else:
                want.append((k, lo, hi))
    assert rows(df, "k", "lo") == want
    odd = spark.createDataFrame([(1, None, 3), (1, 2, 4), (1, 9, None), (2, None, None)], "k int, lo int, hi int")
    assert rows(linear.merged(odd, ["k"]), "k", "lo") == [(1, 2, 4), (1, 9, None), (2, None, None)]


def test_linear_road_window(spark):
    legs = spark.createDataFrame([(1, 0.0, 0.0, 20.0, 0.0, 0.0, 20.0)], "seg int, ax double, ay double, bx double, by double, station double, len double")
    road = spark.createDataFrame([("r", "road", 1.6, 10.0, -5.0, 10.0, 5.0)], "id string, kind string, factor double, cx double, cy double, dx double, dy double")
    windows, bad = linear.crossing_windows(linear.line_hits(legs, road, "seg"), spark.createDataFrame([(1, 20.0)], "seg int, length double"), "seg")
    assert rows(windows.select("lo", "hi"), "lo") == [(7, 13)]
    assert bad.count() == 0


def edges(spark, pairs):
    return spark.createDataFrame([(0, a, b) for a, b in pairs], "plan int, a long, b long")


def test_flow_and_cycle(spark):
    e = edges(spark, [(0, 1), (1, 2), (1, 3)])
    roots = spark.createDataFrame([(0, 0)], "plan int, node long")
    consumers = spark.createDataFrame([(0, 2, 1.0), (0, 3, 1.0)], "plan int, node long, flow double")
    tree = graph.orient(e, roots)
    assert rows(graph.subtree_flow(tree, consumers).select("node", "flow"), "node") == [(0, 2.0), (1, 2.0), (2, 1.0), (3, 1.0)]
    assert graph.forest_violations(e, roots, tree, consumers.select("plan", "node")).count() == 0
    ring = edges(spark, [(0, 1), (1, 2), (2, 0)])
    found = {r.rule for r in graph.forest_violations(ring, roots, graph.orient(ring, roots), consumers.select("plan", "node").limit(0)).collect()}
    assert found == {"not an acyclic forest with one tie-in each"}


def test_chains_and_sizes(spark):
    e = edges(spark, [(0, 1), (1, 2), (2, 3), (2, 4)])
    roots = spark.createDataFrame([(0, 0)], "plan int, node long")
    got = rows(graph.chains(graph.orient(e, roots), roots).select("top", "bottom", "hops", "nodes"), "bottom")
    assert got == [(0, 2, 2, [0, 1, 2]), (2, 3, 1, [2, 3]), (2, 4, 1, [2, 4])]


@pytest.mark.parametrize(("segments", "sizes"), [
    ([("t", "j", 0, 2.0, 100.0), ("j", "a", 1, 1.0, 150.0), ("j", "b", 1, 1.0, 100.0)], {"j": 65, "a": 50, "b": 50}),  # a run goes on through a chamber
    ([("t", "a", 0, 1.0, 150.0), ("t", "b", 0, 1.0, 150.0)], {"a": 50, "b": 50}),  # parallel branches aren't summed
    ([("t", "a", 0, 1.0, 300.0)], {"a": 80}),  # length forces the size
])
def test_continuous_runs(spark, segments, sizes):
    s = spark.createDataFrame([(0, *x) for x in segments], "plan int, top string, bottom string, depth int, flow double, length double")
    assert {r.bottom: r.dn for r in graph.size_chains(s).collect()} == sizes


def test_prune(spark):
    e = edges(spark, [(0, 1), (1, 2), (1, 3), (3, 4)])
    keep = spark.createDataFrame([(0, 0), (0, 2)], "plan int, node long")
    assert rows(graph.prune_leaves(e, keep).select("a", "b"), "a") == [(0, 1), (1, 2)]


GAS = depth.passing_depths("gas_pipeline", 2.8, 0.4, 0.2, 0.125)


def pipe(length, at):
    return depth.Pipe("r", "t", length, 50, [depth.Crossing(at - 2, at + 2, 1.25, GAS[0], GAS[1], "g")])


def test_depth_above():
    p = depth.profile([pipe(40.0, 20.0)], {"r", "t"})
    level = next(x for x in p if x.ids)
    assert (level.hi - level.lo, level.factor) == (4, 1.25)
    assert level.start_depth == pytest.approx(2.475)
    assert sum((x.hi - x.lo) * x.factor for x in p) == pytest.approx(41)


def test_depth_below_and_infeasible():
    p = depth.profile([pipe(13.0, 6.5)], {"r", "t"})
    assert next(x for x in p if x.ids).start_depth == pytest.approx(3.4)
    with pytest.raises(ValueError, match="No feasible"):
        depth.profile([pipe(10.0, 5.0)], {"r", "t"})


def cheapest_on_a_grid(length, windows, rate, step=0.5, unit=0.05):
    """Least price of a pipe between fixed ends, by a table of stations and depths, all combinations of passages."""
    n, depths = round(length / step), [round(0.7 + unit * i, 2) for i in range(80)]
    factor = [max([f for lo, hi, f, *_ in windows if lo <= (i + 0.5) * step <= hi], default=1.0) for i in range(n)]
    level = [any(lo <= (i + 0.5) * step <= hi for lo, hi, *_ in windows) for i in range(n)]
    best = math.inf
    for above in itertools.product((True, False), repeat=len(windows)):
        if any(up and w[3] is None for up, w in zip(above, windows)):
            continue
        fits = lambda i, d, above=above: all((d <= w[3] + 1e-9 if up else d >= w[4] - 1e-9) for up, w in zip(above, windows) if w[0] - 1e-9 <= i * step <= w[1] + 1e-9)
        cost = {d: 0.0 if abs(d - 3) < 1e-9 and fits(0, d) else math.inf for d in depths}
        for i in range(n):
            after = dict.fromkeys(depths, math.inf)
            for k, d in enumerate(depths):
                if not fits(i + 1, d):
                    continue
                for j in (k,) if level[i] else (k - 1, k, k + 1):
                    if 0 <= j < len(depths):
                        mean = (max(0, d - 3) + max(0, depths[j] - 3)) / 2
                        after[d] = min(after[d], cost[depths[j]] + step * rate * (1 + 0.1 * mean) * factor[i])
            cost = after
        best = min(best, cost[3.0])
    return best


def test_depth_against_a_grid():
    rng = random.Random(8)
    rate, solved = 74023.0, 0
    for _ in range(25):
        length = rng.randint(20, 60)
        windows = []
        for k in range(rng.randint(1, 3)):
            at = rng.randint(2, length - 2)
            windows.append((at - 2.0, at + 2.0, rng.choice([1.05, 1.15, 1.25]), rng.choice([None, 2.0, 2.4, 2.75]), rng.choice([3.2, 3.4, 4.0, 1.0])))
        pipes = [depth.Pipe("r", "t", float(length), 50, [depth.Crossing(*w, id=str(k)) for k, w in enumerate(windows)])]
        want = cheapest_on_a_grid(length, windows, rate)
        if want == math.inf:
            with pytest.raises(ValueError, match="No feasible"):
                depth.profile(pipes, {"r", "t"})
            continue
        pieces = depth.profile(pipes, {"r", "t"})
        solved += 1
        got = sum((p.hi - p.lo) * rate * p.factor * (1 + 0.1 * (max(0, p.start_depth - 3) + max(0, p.end_depth - 3)) / 2) for p in pieces)
        assert got == pytest.approx(want)
        assert (pieces[0].lo, pieces[-1].hi) == (0.0, length)
        for p, q in itertools.pairwise(pieces):
            assert (p.hi, p.end_depth) == (pytest.approx(q.lo), pytest.approx(q.start_depth))
        assert all(abs(p.end_depth - p.start_depth) <= 0.1 * (p.hi - p.lo) + 1e-9 for p in pieces)
    assert solved > 8


def test_depth_is_shared_at_junctions():
    a, b, c = depth.Pipe("r", "j", 30.0, 50, [depth.Crossing(26.0, 30.0, 1.6, None, 4.0, "road")]), depth.Pipe("j", "t", 20.0, 50), depth.Pipe("j", "u", 20.0, 50)
    pieces = depth.profile([a, b, c], {"r", "t", "u"})
    assert [p.start_depth for p in pieces if p.pipe in (1, 2) and p.lo == 0] == [pytest.approx(4.0)] * 2
    assert depth.profile([depth.Pipe("r", "t", 30.0, 50), depth.Pipe("t", "u", 10.0, 50)], {"r"})[1].end_depth == 3.0
    many = [depth.Crossing(10.0 * k + 3, 10.0 * k + 7, 1.15, 2.9, 3.1, str(k)) for k in range(10)]
    assert max(p.end_depth for p in depth.profile([depth.Pipe("r", "t", 100.0, 50, many)], {"r", "t"})) == 3.0


def test_ranking(spark):
    plans = spark.createDataFrame([(1, "a", 0, 2.0, 1, 5.0), (2, "a", 0, 1.0, 1, 5.0), (3, "b", 0, 3.0, 1, 5.0), (4, "b", 1, 0.5, 1, 5.0)], "plan int, family string, missing int, score double, bends int, cost double")
    p = plans.withColumn("g", F.lit(0))
    assert rows(rank.diverse_top(p, ["g"], "family", rank.search_key(), 3).select("pick", "plan"), "pick") == [(1, 2), (2, 3), (3, 1)]
    assert rows(rank.best_of(p, ["family"], rank.search_key()).select("family", "plan"), "family") == [("a", 2), ("b", 3)]


def test_warm_edges(spark):
    pts = lambda *xy: [(float(x), float(y)) for x, y in xy]
    export = spark.createDataFrame([("v", "p1", "heat_network", pts((0, 0), (5, 0.5), (10, 0)))], "plan string, id_key string, object_type string, points array<struct<x:double,y:double>>")
    nodes = spark.createDataFrame([(1, 0.0, 0.0), (2, 10.01, 0.0), (3, 50.0, 0.0)], "id int, x double, y double")
    assert [(r.plan, r.a, r.b) for r in planning.warm_edges(export, nodes).collect()] == [("v", 1, 2)]
