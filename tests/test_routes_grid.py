"""Known answers of route rules and grids."""

import math
import random

import pytest
from pyspark.sql import functions as F

from netloom.functions.constants import CROSSINGS
from netloom.operators import crossings, grid, routes, stretches


XY = "array<struct<x:double,y:double>>"


def box(x0, y0, x1, y1):
    return [[[(float(x), float(y)) for x, y in ((x0, y0), (x1, y0), (x1, y1), (x0, y1))]]]


def broken(spark, cases, obstacles, entry=True):
    """Rules that routes (points, dn, homes) break, by their number."""
    xy = lambda ps: [(float(x), float(y)) for x, y in ps]
    r = spark.createDataFrame([(i, dn, xy(ps), xy(homes)) for i, (ps, dn, homes) in enumerate(cases)], f"route int, dn int, points {XY}, homes {XY}")
    o = spark.createDataFrame(obstacles, f"obstacle string, kind string, area array<array<{XY}>>")
    out = [set() for _ in cases]
    for v in routes.violations(r, o, entry).collect():
        out[v.route].add(v.rule)
    return out


HOUSE = [("h", "oks", box(-10, -10, 10, 10))]


def test_clearance_depends_on_size(spark):
    line = [(-30, 16), (30, 16)]
    through, within = [(-30, 0), (30, 0)], [(-2, 0), (2, 0)]
    assert broken(spark, [(line, 125, []), (line, 500, []), (through, 125, []), (within, 50, [])], HOUSE) == [set(), *[{"forbidden envelope"}] * 3]
    court = [("h", "oks", [[*box(-100, -100, 100, 100)[0], *box(-50, -50, 50, 50)[0]]])]
    assert broken(spark, [(within, 50, []), ([(0, 0), (48, 0)], 50, [])], court) == [set(), {"forbidden envelope"}]


def test_entry_by_the_nearest_facade(spark):
    home = [(1, 0)]
    cases = [([(1, 0), (20, 0)], 50, home), ([(1, 0), (-20, 0)], 50, home), ([(20, 0), (1, 0)], 50, home)]
    assert broken(spark, cases, HOUSE) == [set(), {"entry must use the nearest facade"}, set()]
    assert broken(spark, cases[:1], HOUSE, entry=False) == [{"forbidden envelope"}]
    centre = [(0, 0)]
    cases = [
        ([(40, 20), (25, 0), (0, 0)], 125, centre),
        ([(30, 20), (0, 5), (0, 0)], 125, centre),
        ([(30, 20), (0, 14), (0, 0)], 125, centre),
        ([(30, 20), (3, 14), (0, 14), (0, 0)], 125, centre),
        ([(-30, 0), (30, 0)], 125, []),
        ([(40, 0), (0, 0)], 125, [(40, 0)]),
    ]
    assert broken(spark, cases, HOUSE) == [set(), {"entry must use the nearest facade"}, set(), {"invalid departure"}, {"forbidden envelope"}, {"forbidden envelope"}]


def test_route_shape(spark):
    cases = [([(0, 0), (10, 0), (1, 1)], 50, []), ([(0, 0), (math.nan, 0)], 50, []), ([(0, 0)], 50, []), ([(0, 0), (10, 0), (10, 10), (5, 10), (5, -5)], 50, []), ([(0, 0), (10, 0), (10, 10)], 50, [])]
    real = "empty or non-finite route"
    assert broken(spark, cases, HOUSE[:0] + [("far", "water", box(900, 900, 901, 901))]) == [{"turn exceeds 90 degrees"}, {real}, {real}, {"route meets itself"}, set()]


def test_stretches_near_a_side(spark):
    rng = random.Random(1)
    rows = [tuple(rng.uniform(-20, 20) for _ in range(8)) + (rng.uniform(0.5, 12),) for _ in range(120)]
    rows += [(0.0, 5.0, 40.0, 5.0, 10.0, 0.0, 30.0, 0.0, 6.0), (0.0, 5.0, 40.0, 5.0, 10.0, 0.0, 30.0, 0.0, 5.0), (0.0, 7.0, 40.0, 7.0, 10.0, 0.0, 30.0, 0.0, 6.0), (10.0, -9.0, 10.0, 9.0, 10.0, 0.0, 30.0, 0.0, 2.0), (0.0, 0.0, 0.0, 0.0, 0.0, 0.0, 1.0, 0.0, 2.0)]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "n int, ax double, ay double, bx double, by double, cx double, cy double, dx double, dy double, r double")
    got = {x.n: (x.lo, x.hi) for x in stretches.near_parts(df, F.col("r")).collect()}

    def apart(x, y, cx, cy, dx, dy):
        t = max(0.0, min(1.0, ((x - cx) * (dx - cx) + (y - cy) * (dy - cy)) / ((dx - cx) ** 2 + (dy - cy) ** 2)))
        return math.dist((x, y), (cx + t * (dx - cx), cy + t * (dy - cy)))

    for i, (ax, ay, bx, by, *side, r) in enumerate(rows):
        size = math.dist((ax, ay), (bx, by))
        on = [k * size / 4000 for k in range(4001) if size and apart(ax + (bx - ax) * k / 4000, ay + (by - ay) * k / 4000, *side) <= r]
        if len(on) > 1:
            assert got[i] == pytest.approx((on[0], on[-1]), abs=0.03)
        else:
            assert i not in got or got[i][1] - got[i][0] < 0.03


def test_sweeps(spark):
    frame = lambda rows: spark.createDataFrame([(1, float(a), float(b)) for a, b in rows], "k int, lo double, hi double")
    held = lambda df: sorted((r.lo, r.hi) for r in df.collect())
    a, b = frame([(0, 10), (5, 20), (30, 30)]), frame([(2, 4), (3, 6), (18, 40)])
    assert held(stretches.sweep(a, b, ["k"])) == [(0, 2), (6, 18)]
    assert held(stretches.sweep(a, b, ["k"], both=True)) == [(2, 6), (18, 20)]
    got = stretches.differing(frame([(0, 10), (20, 30)]), frame([(0.001, 10), (20, 27), (50, 51)]), ["k"], 0.002).collect()
    assert sorted((r.missing, round(r.lo, 3), round(r.hi, 3)) for r in got) == [(False, 50, 51), (True, 27.002, 30)]


def test_stretches_inside_areas(spark):
    court = [[*box(0, 0, 30, 30)[0], *box(10, 10, 20, 20)[0]], *box(40, 0, 50, 30)]
    areas = spark.createDataFrame([("c", 2.0, court)], f"obstacle string, factor double, area array<array<{XY}>>")
    legs = spark.createDataFrame([(1, -10.0, 15.0, 60.0, 15.0), (2, 12.0, 15.0, 18.0, 15.0), (3, 1.0, 5.0, 9.0, 5.0)], "leg int, ax double, ay double, bx double, by double")
    got = sorted((r.leg, r.lo, r.hi, r.factor) for r in routes.area_runs(legs, areas, "factor").collect())
    assert got == [(1, 10.0, 20.0, 2.0), (1, 30.0, 40.0, 2.0), (1, 50.0, 60.0, 2.0), (3, 0.0, 8.0, 2.0)]


def test_rays_and_their_ports(spark):
    points = spark.createDataFrame([(1, 0.0, 0.0), (2, 500.0, 0.0)], "point int, x double, y double")
    walls = spark.createDataFrame([("w", "water", box(10, -5, 20, 5)), ("c", "water", box(-3, 24, 3, 27))], f"obstacle string, kind string, area array<array<{XY}>>")
    free = {}
    for r in grid.free_rays(points, walls, F.lit(2.0), rays=4).collect():
        free.setdefault((r.point, r.ray), []).append((round(r.lo, 6), round(r.hi, 6)))
    assert {k: sorted(v) for k, v in free.items()} == {(1, 0): [(0, 8), (22, 30)], (1, 1): [(0, 22), (29, 30)], (1, 2): [(0, 30)], (1, 3): [(0, 30)], **{(2, k): [(0, 30)] for k in range(4)}}
    at = sorted((round(r.x, 6), round(r.y, 6)) for r in grid.ray_ports(points.filter("point = 1"), walls, F.lit(2.0), rays=4).collect() if r.ray == 0)
    assert at == [(0.03, 0), (5, 0), (22.03, 0), (27, 0)]


def test_ports_along_crossings(spark):
    line = spark.createDataFrame([("g", 0.4, 2.0, 0.0, 0.0, 120.0, 0.0)], "id string, width double, gap double, cx double, cy double, dx double, dy double")
    got = sorted((r.side, round(r.x, 6), round(r.y, 6)) for r in grid.crossing_ports(line, F.lit(50)).collect())
    assert got == [(s, x, s * 3.4) for s in (-1, 1) for x in (0, 40, 80, 120)]


def test_dead_ends(spark):
    wall = [("h", "oks", [*box(-10, -10, 10, 10)]), ("u", "oks", [[[(0.0, 0.0), (20.0, 0.0), (20.0, 10.0), (10.02, 10.0), (10.02, 2.0), (10.0, 2.0), (10.0, 10.0), (0.0, 10.0)]]])]
    o = spark.createDataFrame(wall, f"obstacle string, kind string, area array<array<{XY}>>")
    homes = spark.createDataFrame([(1, -2.0, -3.0), (2, 9.0, 6.0), (3, 50.0, 50.0)], "home int, x double, y double")
    assert [(r.home, r.obstacle, r.feet) for r in routes.dead_ends(homes, o).collect()] == [(2, "u", 1)]


def test_ports_may_begin_within_their_building(spark):
    o = spark.createDataFrame(HOUSE, f"obstacle string, kind string, area array<array<{XY}>>")
    e = spark.createDataFrame([(1, "p", "q", 0.0, 12.0, 0.0, 40.0), (2, "p", "r", 0.0, 12.0, 30.0, 12.0), (3, "s", "t", 0.0, 12.0, 0.0, 40.0), (4, "s", "t", 0.0, 40.0, 30.0, 40.0), (5, "p", "u", 0.0, 12.0, 0.0, -40.0)], "edge int, a string, b string, ax double, ay double, bx double, by double")
    owners = spark.createDataFrame([("p", "h")], "node string, obstacle string")
    assert sorted(r.edge for r in routes.clear_pairs(e, o, owners, F.lit(125)).collect()) == [1, 2, 4]


def test_crossing_weights_sweep_overlaps(spark):
    legs = spark.createDataFrame([(1, 1.0, 0.0, 0.0, 50.0, 0.0), (2, 2.0, 0.0, 50.0, 50.0, 50.0), (3, 1.0, 19.0, 0.0, 50.0, 0.0)], "leg int, price double, ax double, ay double, bx double, by double")
    gas = spark.createDataFrame([("g", "gas_pipeline", 1.25, 20.0, -5.0, 20.0, 60.0)], "id string, kind string, factor double, cx double, cy double, dx double, dy double")
    road = spark.createDataFrame([("r", "road", 1.6, box(18, -5, 22, 5))], f"obstacle string, kind string, factor double, area array<array<{XY}>>")
    got = {r.leg: (r.extra, r.fits) for r in routes.crossing_weights(legs, gas, road).collect()}
    assert got[1] == (pytest.approx(10 * 0.6), True)
    assert got[2] == (pytest.approx(2 * 4 * 0.25), True)
    assert got[3][1] is False


def test_crossing_weights_meet_once_at_a_place(spark, monkeypatch):
    legs = spark.createDataFrame([(i, float(i), 0.0, 0.0, 50.0, 0.0) for i in range(20)], "leg int, price double, ax double, ay double, bx double, by double")
    gas = spark.createDataFrame([(f"g{i}", "gas_pipeline", 1.25, 20.0, -5.0, 20.0, 60.0 + i % 2) for i in range(30)], "id string, kind string, factor double, cx double, cy double, dx double, dy double")
    none = spark.createDataFrame([], f"obstacle string, kind string, factor double, area array<array<{XY}>>")
    met, hits = [], routes.linear.line_hits
    monkeypatch.setattr(routes.linear, "line_hits", lambda *a: met.append(hits(*a)) or met[-1])
    got = {r.leg: (r.extra, r.fits) for r in routes.crossing_weights(legs, gas, none).collect()}
    assert got == {i: (pytest.approx(4 * 0.25 * i), True) for i in range(20)}
    assert met[0].count() == 1  # there were 600


def test_grid(spark):
    ext = grid.extent(spark.createDataFrame([("t", 0.0, 0.0), ("t", 20.0, 20.0)], "territory string, x double, y double"), 5.0, 0.0)
    every = grid.cells(ext, 5.0)
    assert every.count() == 25
    ring = F.array(*(F.struct(F.lit(float(x)).alias("x"), F.lit(float(y)).alias("y")) for x, y in ((8, 8), (12, 8), (12, 12), (8, 12))))
    shells = spark.range(1).select(F.lit("t").alias("territory"), F.lit("o").alias("obstacle"), F.lit(8.0).alias("x0"), F.lit(8.0).alias("y0"), F.lit(12.0).alias("x1"), F.lit(12.0).alias("y1"), ring.alias("ring"))
    sides = spark.createDataFrame([("t", "o", 1.0, 8.0, 8.0, 12.0, 8.0)], "territory string, obstacle string, gap double, cx double, cy double, dx double, dy double")
    free = grid.free_cells(every, grid.blocked(sides, shells, 5.0))
    assert free.count() == 24
    assert grid.edges(free, 5.0).count() == 40 - 4
    assert grid.edges(free, 5.0, cardinal=False).filter("w > 6").count() == 32 - 4 - 4  # at the cell, and past its corners
    p = spark.createDataFrame([("t", 1, 10.4, 10.0)], "territory string, point int, px double, py double")
    (n,) = grid.nearest_free(p, free, 5.0).collect()
    assert (n.i, n.j) == (3, 2)


def courtyard_grid(spark):
    o = spark.createDataFrame([("h", "oks", box(-10, -10, 10, 10)), ("w", "water", box(24, -40, 26, 40))], f"obstacle string, kind string, area array<array<{XY}>>")
    free = spark.createDataFrame([(i, j, i * 5.0, j * 5.0) for i in range(-8, 9) for j in range(-8, 9) if max(abs(i), abs(j)) * 5 > 15.2 and not 22 < i * 5 < 28], "i int, j int, x double, y double")
    return o, free


def test_access_through_the_nearest_facade(spark):
    o, free = courtyard_grid(spark)
    points = spark.createDataFrame([(1, 3.0, 0.0), (2, -30.0, 2.0), (3, 25.0, 0.0)], "point int, x double, y double")
    rows = grid.access(points, free, o, 5.0, 50).collect()
    by = {p: [r for r in rows if r.point == p] for p in (1, 2, 3)}
    assert by[1]
    assert {(r.path[1].x, r.path[1].y) for r in by[1]} == {(15.25, 0.0)}  # 5 m, half of 0.4 m and 5 cm
    assert all(q.x < 24 - 1.2 for r in by[1] for q in r.path)
    assert min(r.length for r in by[2]) == 2.0
    assert not by[3]


def test_moved_consumers(spark):
    o, free = courtyard_grid(spark)
    points = spark.createDataFrame([(1, 3.0, 0.0), (2, -30.0, 2.0)], "point int, x double, y double")
    (r,) = grid.moved(points, free, o, 5.0, 50).collect()
    assert (r.point, r.x, r.y, r.obstacle) == (1, pytest.approx(15.25), 0.0, "h")
    (r,) = grid.moved(points, free.filter("i < 0"), o, 5.0, 50).collect()  # nothing is reachable on the right
    assert (r.point, r.displacement) == (1, pytest.approx(math.hypot(0, 15.25)))


def test_leads_end_at_the_first_corridor(spark):
    leads = spark.createDataFrame([("l", 0, 0.0, 0.0, 0.0, 7.0, 0.0), ("l", 1, 0.0, 7.0, 20.0, 7.0, 7.0)], "lead string, leg int, ax double, ay double, bx double, by double, station double")
    corridors = spark.createDataFrame([(1, 5.0, 0.0, 5.0, 10.0), (2, 10.0, 0.0, 10.0, 10.0), (3, -5.0, 20.0, 5.0, 20.0)], "edge int, cx double, cy double, dx double, dy double")
    (r,) = grid.first_contacts(leads, corridors).collect()
    assert (r.edge, r.station, r.at, r.x, r.y) == (1, 12.0, 7.0, 5.0, 7.0)


def found_passages(spark, cases):
    """(windows, rules) of each case (points, objects, dn, ties), in one call: cases lie a kilometre apart."""
    rows, things = [], []
    for i, (points, objects, dn, ties) in enumerate(cases):
        at = lambda ps: [(float(x) + 1000 * i, float(y)) for x, y in ps]  # noqa: B023, E731
        rows.append((i, dn, at(points), at(ties)))
        for name, kind, lines, area in objects:
            width = 0.4 if kind == "heat_network" else CROSSINGS[kind][1]
            things.append((f"{i}:{name}", kind, CROSSINGS[kind][0], width, CROSSINGS[kind][5], [at(x) for x in lines], [[at(ring) for ring in polygon] for polygon in area]))
    r = spark.createDataFrame(rows, f"route int, dn int, points {XY}, ties {XY}")
    o = spark.createDataFrame(things, f"object string, kind string, factor double, width double, gap double, lines array<{XY}>, area array<array<{XY}>>")
    out = crossings.passages(r, o).collect()
    assert all(x.object.startswith(f"{x.route}:") for x in out)
    return [(sorted((x.lo, x.hi) for x in out if x.route == i and x.rule is None), {x.rule for x in out if x.route == i and x.rule}) for i in range(len(cases))]


GAS = ("g", "gas_pipeline", [[(20, -30), (20, 30)]], [])
ROAD = ("r", "road", [[(20, -30), (20, 30)]], [])
STRIP = ("a", "tram_tracks", [], box(15, -30, 25, 30))
OLD = ("p", "heat_network", [[(0, -30), (0, 30)]], [])
ROOM, ALONG, CLEAR, ANGLE, BENT = "no room for the window before the route's end", "runs alongside within the clearance", "clearance outside the passage", "crossing angle under 45 degrees", "passage isn't straight"


PASSAGES = [
    ([(0, 0), (40, 0)], [GAS], [(18, 22)], set()),
    ([(0, 0), (40, 0)], [ROAD], [(17, 23)], set()),
    ([(0, 0), (40, 0)], [STRIP], [(12, 28)], set()),
    ([(0, 0), (40, 0)], [GAS, STRIP], [(12, 28), (18, 22)], set()),
    ([(0, 100), (40, 100)], [GAS, ROAD, STRIP], [], set()),
    ([(19, 0), (40, 0)], [GAS], [(-1, 3)], {ROOM}),
    ([(13, 0), (40, 0)], [STRIP], [(-1, 15)], {"no 3 m outside the area on each side"}),
    ([(10, -20), (30, 20)], [ROAD], [(math.hypot(10, 20) - 3, math.hypot(10, 20) + 3)], {ANGLE}),
    ([(10, -20), (30, 20)], [GAS], [(math.hypot(10, 20) - 2, math.hypot(10, 20) + 2)], set()),
    ([(10, -20), (30, 20)], [STRIP], [(math.hypot(5, 10) - 3, math.hypot(15, 30) + 3)], {ANGLE}),
    ([(21, -20), (21, 20)], [GAS], [], {ALONG, CLEAR}),
    ([(26, -20), (26, 20)], [STRIP], [], {CLEAR}),
    ([(0, 0), (20, 0), (40, 10)], [GAS], [(18, 22)], {BENT}),
    ([(0, 0), (30, 0), (30, 5), (21.5, 5)], [GAS], [(18, 22)], {CLEAR}),
]


def test_passages(spark):
    got = found_passages(spark, [(points, objects, 50, ()) for points, objects, _, _ in PASSAGES])
    for (windows, rules), (*_, want, broken_rules) in zip(got, PASSAGES, strict=True):
        assert windows == [(pytest.approx(a), pytest.approx(b)) for a, b in want]
        assert rules == broken_rules


def test_ties_are_no_crossings(spark):
    tie = [(0, 0)]
    got = found_passages(spark, [([(0, 0), (40, 0)], [OLD], 50, tie), ([(0.0005, 0), (40, 0)], [OLD], 50, tie), ([(0, 0), (40, 0)], [OLD], 50, ()), ([(0, 0), (1, 0), (1, 20)], [OLD], 50, tie), ([(40, 0), (0, 0)], [OLD], 50, tie)])
    assert got[0] == got[1] == got[4] == ([], set())
    assert got[2][1] == {ROOM}
    assert "tie approach bends within the pipe's envelope" in got[3][1]


def test_split_edges(spark):
    e = spark.createDataFrame([(1, "a", "b", 10.0)], "edge int, a string, b string, w double")
    c = spark.createDataFrame([(1, "m", 4.0)], "edge int, node string, at double")
    assert sorted((x.a, x.b, x.w) for x in grid.split_edges(e, c).collect()) == [("a", "m", 4.0), ("m", "b", 6.0)]


def test_rays_of_one_place_are_asked_once(spark, monkeypatch):
    asked = []
    join = grid.bucket_join

    def counted(left, right, radius, *more, **how):
        asked.append((left.count(), radius))
        return join(left, right, radius, *more, **how)

    monkeypatch.setattr(grid, "bucket_join", counted)
    points = spark.createDataFrame([(i, 0.0, float(i // 50)) for i in range(100)], "point int, x double, y double")
    ring = [(10.0, -5.0), (20.0, -5.0), (20.0, 5.0), (10.0, 5.0)]
    obstacles = spark.createDataFrame([(7, "oks", [[ring]])], "obstacle int, kind string, area array<array<array<struct<x:double,y:double>>>>")
    got = grid.free_rays(points, obstacles, F.lit(0.0), rays=4, widest=0.0).filter("ray = 0").select("point", "lo", "hi").collect()
    assert sorted(tuple(r) for r in got) == sorted((i, *part) for i in range(100) for part in ((0.0, 10.0), (20.0, 30.0)))
    assert {n for n, _ in asked} == {8} and max(r for _, r in asked) <= 1e-6
