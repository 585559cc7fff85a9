"""Registered queries against their SQL on small tables made for what the test tables don't hold."""

import random

import duckdb
from pyspark.sql import functions as F

from netloom.functions import geometry
from netloom.operators import crossings, routes, spatial
from netloom.plans import catalog
from test_queries import cells


def against_sql(spark, folder, name, **tables):
    """The query's rows, which are those of its SQL, over tables given as SQL."""
    con = duckdb.connect()
    for t, sql in tables.items():
        con.execute(f"COPY ({sql}) TO '{folder}/{t}.parquet'")
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    got = catalog.QUERIES[name](spark, str(folder)).toPandas()
    want = con.execute(catalog.ORACLE_SQL[name]).df()
    order = sorted(want.columns)
    assert sorted(got.columns) == order
    rows = sorted(map(cells, got[order].itertuples(index=False)))
    assert rows == sorted(map(cells, want[order].itertuples(index=False)))
    return rows


#: Parts whose gas lines the leads of customers 13800, 337, 10973 and 10021 miss by a rounded digit.
PARTS = ((10275, 42), (9006, 34), (18615, 9), (2808, 22))


def values(names, *rows):
    return f"SELECT * FROM (VALUES {', '.join(map(str, rows))}) AS v({names})"


def forest(lines):
    """A region, two nations, four customers with an order each, and lines (order, quantity)."""
    return {
        "nation": values("n_nationkey, n_regionkey", (0, 0), (1, 0)),
        "customer": f"SELECT c_custkey::BIGINT AS c_custkey, n AS c_nationkey FROM ({values('c_custkey, n', (0, 0), (1, 0), (2, 1), (3, 1))})",
        "orders": "SELECT k AS o_orderkey, k AS o_custkey FROM range(4) AS r(k)",
        "lineitem": f"SELECT k::BIGINT AS l_orderkey, q::DOUBLE AS l_quantity FROM ({values('k, q', *lines)})",
    }


def test_a_point_on_a_building_s_boundary_lies_in_it(spark):
    """To the tolerance of the even-odd test, 1e-7."""
    home = spark.createDataFrame([(1, 10 + 5e-8, 5.0), (2, 10 + 2e-7, 5.0)], "home int, x double, y double")
    house = spark.createDataFrame([(7, "oks_existing", [[[(0.0, 0.0), (10.0, 0.0), (10.0, 10.0), (0.0, 10.0)]]])], "obstacle int, kind string, area array<array<array<struct<x:double,y:double>>>>")
    assert [r.home for r in routes.owned(home, house).collect()] == [1]


def test_consumers_on_a_boundary_lie_in_the_area_that_is_read_again(spark, tmp_path):
    """Be the boundary written with the digits of a double, since twelve move it by more than the test's tolerance."""
    found = against_sql(spark, tmp_path, "geojson_areas", customer="SELECT unnest([2067, 12074])::BIGINT AS c_custkey", supplier="SELECT 1::BIGINT AS s_suppkey", part="SELECT 76850::BIGINT AS p_partkey, 42 AS p_size")
    assert len(found) == 1


def test_leads_that_end_beside_a_line_don_t_cross_it(spark, tmp_path):
    """By one binary digit."""
    found = against_sql(spark, tmp_path, "passage_windows", customer="SELECT unnest([13800, 337, 10973, 10021, 944])::BIGINT AS c_custkey", supplier="SELECT 1::BIGINT AS s_suppkey", part=f"SELECT p_partkey::BIGINT AS p_partkey, p_size FROM ({values('p_partkey, p_size', *PARTS)})")
    assert len(found) == 1


def test_members_are_customers_with_orders_be_these_without_lines(spark, tmp_path):
    tables = forest([(0, 5.0), (2, 5.0)])
    for name in ("subtree_members", "family_structure"):
        against_sql(spark, tmp_path, name, **tables)


def test_trunks_that_no_size_fits_have_no_row(spark, tmp_path):
    tables = forest([(0, 2e7), (1, 2e7), (2, 1e3), (3, 1e3)])
    assert len(against_sql(spark, tmp_path, "sized_forest", **tables)) == 5
    against_sql(spark, tmp_path, "forest_plan", **tables)


def test_rows_at_one_place_are_joined_once(spark, monkeypatch):
    """And a join by cells broadcasts no side, whose size nobody knows before the cells are opened."""
    joined, join = [], spatial.bucket_join

    def counted(left, *others, **more):
        joined.append(left.count())
        out = join(left, *others, **more)
        assert "BroadcastHashJoin" not in out._jdf.queryExecution().executedPlan().toString()
        return out

    monkeypatch.setattr(spatial, "bucket_join", counted)
    ids = spark.range(40)
    points = ids.select("id", F.lit(5.0).alias("x"), F.lit(5.0).alias("y"), F.lit(5.0).alias("px"), F.lit(5.0).alias("py"))
    legs = ids.select("id", F.lit(0.0).alias("ax"), F.lit(0.0).alias("ay"), F.lit(9.0).alias("bx"), F.lit(0.0).alias("by"))
    line = spark.createDataFrame([(1, 50, "water", 5.0, 1.0, 5.0, 9.0)], "line int, dn int, kind string, cx double, cy double, dx double, dy double")
    assert spatial.blocked(legs, line, 2.0, F.lit(2.0), ("id",)).count() == 40
    assert {r.max_dn for r in spatial.edge_max_dn(legs, line, ("id",)).collect()} == {0}
    ends = line.withColumns({"first_x": F.col("cx"), "first_y": F.col("cy"), "last_x": F.col("dx"), "last_y": F.col("dy")})
    assert {tuple(r)[1:] for r in spatial.incidence(points, ends, "id", "line").collect()} == {(2, 50)}
    near = spatial.nearest(points.select("id", "x", "y"), spark.createDataFrame([(4, 5.0, 6.0), (3, 5.0, 6.0)], "tie int, u double, v double"), "id", ("x", "y"), ("u", "v"), 2.0, "tie")
    assert [r.tie for r in near.collect()] == [3] * 40
    found = spatial.sector_neighbours(points.select("id", "x", "y"), 3.0, 2)
    assert sorted((r.id, r.other) for r in found.collect()) == sorted((i, [j for j in range(3) if j != i][k]) for i in range(40) for k in range(2))
    assert joined == [1] * 5


def test_the_distance_in_steps_is_that_in_one(spark):
    rng = random.Random(4)
    point = lambda: (float(rng.randint(0, 6)), float(rng.randint(0, 6)))
    names = ("ax", "ay", "bx", "by", "cx", "cy", "dx", "dy")
    pairs = spark.createDataFrame([sum((point() for _ in range(4)), ()) for _ in range(400)], ", ".join(f"{n} double" for n in names))
    out = spatial.with_gap(pairs).withColumn("whole", geometry.segment_segment(*map(F.col, names))).collect()
    assert len(out) == 400 and all(r.d == r.whole for r in out)


def test_routes_of_the_same_points_are_measured_once(spark, monkeypatch):
    joined, join = [], routes.bucket_join
    monkeypatch.setattr(routes, "bucket_join", lambda left, *others, **more: joined.append(left.count()) or join(left, *others, **more))
    line = "array<struct<x:double,y:double>>"
    ways = spark.createDataFrame([(k, 50, [(0.0, 0.0), (9.0, 0.0)]) for k in range(20)], f"route int, dn int, points {line}")
    wall = spark.createDataFrame([(k, "oks", [[[(4.0, 1.0), (5.0, 1.0), (5.0, 2.0)]]]) for k in (7, 8)], f"obstacle int, kind string, area array<array<{line}>>")
    found = routes.too_close(ways, wall).collect()
    assert sorted((r.route, r.obstacle, r.d) for r in found) == [(k, o, 1.0) for k in range(20) for o in (7, 8)]
    assert joined == [1, 1]


def test_rules_of_routes_broadcast_neither_routes_nor_obstacles(spark, monkeypatch):
    """Whose sizes nobody knows before points and areas are built; pairs of routes that serve nobody aren't kept."""
    kept, cut = [], routes.cut
    monkeypatch.setattr(routes, "cut", lambda df: kept.append(df) or cut(df))
    line = "array<struct<x:double,y:double>>"
    ways = spark.createDataFrame([(k, 50, [(0.0, 0.0), (9.0, 0.0)], []) for k in range(20)], f"route int, dn int, points {line}, homes {line}")
    wall = spark.createDataFrame([(k, "oks", [[[(4.0, 1.0), (5.0, 1.0), (5.0, 2.0)]]]) for k in (7, 8)], f"obstacle int, kind string, area array<array<{line}>>")
    out = routes.violations(ways, wall)
    assert sorted(map(tuple, out.collect())) == sorted((k, "forbidden envelope", o) for k in range(20) for o in "78")
    assert all("BroadcastExchange" not in df._jdf.queryExecution().executedPlan().toString() for df in (kept[0], routes.too_close(ways, wall)))
    assert all(df.count() < 40 for df in kept)


def test_routes_of_the_same_points_meet_objects_of_the_same_shape_once(spark, monkeypatch):
    joined, join = [], crossings.bucket_join
    monkeypatch.setattr(crossings, "bucket_join", lambda left, right, *others, **more: joined.append((left.count(), right.count())) or join(left, right, *others, **more))
    line = "array<struct<x:double,y:double>>"
    ways = spark.createDataFrame([(k, 50, [(0.0, 0.0), (30.0, 0.0)], []) for k in range(6)], f"route int, dn int, points {line}, ties {line}")
    gas = spark.createDataFrame([(k, "gas_pipeline", 1.25, 0.4, 2.0, [[(9.0, -40.0), (9.0, 40.0)]], []) for k in (7, 8)], f"object int, kind string, factor double, width double, gap double, lines array<{line}>, area array<array<{line}>>")
    found = crossings.passages(ways, gas).filter("rule is null").collect()
    assert sorted((r.route, r.object, r.lo, r.hi) for r in found) == [(k, o, 7.0, 11.0) for k in range(6) for o in (7, 8)]
    assert joined == [(1, 1), (1, 0)]


def test_consumers_and_areas_at_one_place_meet_once(spark, tmp_path, monkeypatch):
    joined, join = [], routes.bucket_join
    monkeypatch.setattr(routes, "bucket_join", lambda left, right, *others, **more: joined.append((left.count(), right.count())) or join(left, right, *others, **more))
    found = against_sql(spark, tmp_path, "geojson_areas", customer="SELECT unnest([2067, 12074, 22081])::BIGINT AS c_custkey", supplier="SELECT 1::BIGINT AS s_suppkey", part="SELECT unnest([76850, 96864])::BIGINT AS p_partkey, 42 AS p_size")
    assert len(found) == 1 and joined == [(1, 1)]
