"""Known answers of the scalar, geometry and line functions."""

import math

import pytest
from pyspark.sql import functions as F

from netloom.functions import crs, geometry, polyline, pricing


def value(spark, column):
    return spark.range(1).select(column.alias("v")).collect()[0].v


def points(*xy):
    return F.array(*(geometry.point(F.lit(float(x)), F.lit(float(y))) for x, y in xy))


@pytest.mark.parametrize(("flow", "length", "dn"), [(1, 10, 50), (1, 300, 80), (3.5, 0, 50), (3.6, 0, 65), (22501.9, 0, 1400), (22502.9, 0, None), (-1, 0, None), (math.nan, 0, None), (math.inf, 0, None)])
def test_size(spark, flow, length, dn):
    assert value(spark, pricing.select_dn(F.lit(float(flow)), F.lit(float(length)))) == dn


def test_strict_size_raises(spark):
    with pytest.raises(Exception, match="no supported size"):
        value(spark, pricing.select_dn(F.lit(1e6), strict=True))


def test_prices(spark):
    assert [value(spark, pricing.chamber_price(F.lit(d))) for d in (200, 500, 1000, 1200)] == [3_000_000, 5_000_000, 8_000_000, 12_000_000]
    assert value(spark, pricing.opening_price(F.lit(False), F.lit(50), F.lit(900))) == 8_000_000
    assert value(spark, pricing.opening_price(F.lit(True), F.lit(50), F.lit(900))) == 5_000_000
    assert value(spark, pricing.clearance(F.lit("oks"), F.lit(500))) == pytest.approx(7 + 1.67 / 2)
    assert value(spark, pricing.depth_factor(F.lit(3.4))) == pytest.approx(1.04)
    assert value(spark, pricing.piece_depth_factor(F.lit(None).cast("double"), F.lit(3.0))) == 1.0


def test_identifiers_keep_their_type(spark):
    keys = [value(spark, pricing.variant_id_key(F.parse_json(F.lit(j)))) for j in ("1", '"1"', "1.0", "1.5")]
    assert keys == ["n:1", "s:1", "n:1", "n:1.5"]
    with pytest.raises(Exception, match="Identifiers must be"):
        value(spark, pricing.variant_id_key(F.parse_json(F.lit("true"))))


def test_projection_round_trip(spark):
    x, y = crs.to_utm(F.lit(37.6), F.lit(55.7))
    lon, lat = crs.from_utm(x, y)
    assert abs(value(spark, lon) - 37.6) < 1e-9
    assert abs(value(spark, lat) - 55.7) < 1e-8


def test_rotation_of_nothing_moves_nothing(spark):
    u, v = crs.rotate(F.lit(3.0), F.lit(4.0), (1.0, 1.0), 0.0)
    assert (value(spark, u), value(spark, v)) == (3.0, 4.0)


def test_ring_with_hole(spark):
    shell = F.array(points((0, 0), (40, 0), (40, 40), (0, 40)))
    hole = F.array(points((10, 10), (30, 10), (30, 30), (10, 30)))
    assert not value(spark, geometry.in_area(F.lit(20.0), F.lit(20.0), shell, hole))
    assert value(spark, geometry.in_area(F.lit(5.0), F.lit(5.0), shell, hole))
    assert value(spark, geometry.in_ring(F.lit(0.0), F.lit(20.0), points((0, 0), (40, 0), (40, 40), (0, 40))))
    assert not value(spark, geometry.in_ring(F.lit(0.0), F.lit(0.0), points((0, 0), (1, 1))))


def test_segments(spark):
    lit = [F.lit(float(v)) for v in (0, 0, 10, 0, 5, -1, 5, 1)]
    assert value(spark, geometry.segment_segment(*lit)) == 0.0
    assert value(spark, geometry.intersection_at(*lit)) == 0.5
    apart = [F.lit(float(v)) for v in (0, 0, 10, 0, 0, 3, 10, 3)]
    assert value(spark, geometry.segment_segment(*apart)) == 3.0
    assert value(spark, geometry.intersection_at(*apart)) is None


def test_lines(spark):
    line = points((0, 0), (10, 0), (10, 3), (20, 3))
    assert value(spark, polyline.length(line)) == 23
    assert value(spark, polyline.bends(line)) == 2
    assert value(spark, polyline.micro_bends(line, 5.0)) == 2
    assert value(spark, polyline.stations(line)) == [0, 10, 13, 23]
    p = value(spark, polyline.point_at(line, F.lit(11.5)))
    assert (p.x, p.y) == (10, 1.5)
    back = value(spark, polyline.quality(points((0, 0), (10, 0), (1, 1))))
    assert back.backtracks == 1
    assert value(spark, polyline.quality(points((0, 0), (10, 0)))).bends == 0


def test_straightened_keeps_turns_back(spark):
    kept = value(spark, polyline.straightened(points((0, 0), (5, 0), (5, 0), (10, 0), (4, 0), (4, 5))))
    assert [(p.x, p.y) for p in kept] == [(0, 0), (10, 0), (4, 0), (4, 5)]


def test_points_of_long_lines_are_read_once(spark):
    """Legs and corners zip a derived array; lambdas that look it up by number compute it anew for every vertex."""
    line = spark.range(20_000).groupBy(F.lit(1).alias("line")).agg(F.array_sort(F.collect_list("id")).alias("v"))
    line = line.select("line", F.transform("v", lambda i: geometry.point(i, F.when(i % 20 == 7, 1).otherwise(0))).alias("points"))
    assert line.filter(F.exists(polyline.corners(F.col("points")), lambda c: c.turn > 44)).count() == 1
    out = line.select(polyline.length(F.col("points")).alias("n"), F.size(polyline.straightened(F.col("points"))).alias("left")).first()
    assert out.n == pytest.approx(17_999 + 2_000 * math.sqrt(2))
    assert out.left == 2 + 3 * 1000


def test_straightened_takes_odd_coordinates(spark):
    lines = [None, [], [(0.0, 0.0)], [(0.0, 0.0), (None, 1.0), (2.0, 0.0), (3.0, 0.0), (4.0, 0.0)], [(0.0, 0.0), (1.0, 0.0), (2.0, 0.0)]]
    df = spark.createDataFrame(list(enumerate(lines)), "i int, points array<struct<x:double,y:double>>").coalesce(1)
    got = [r.s and [tuple(p) for p in r.s] for r in df.select("i", polyline.straightened(F.col("points")).alias("s")).orderBy("i").collect()]
    assert got == [None, [], [(0.0, 0.0)], [(0.0, 0.0), (None, 1.0), (2.0, 0.0), (4.0, 0.0)], [(0.0, 0.0), (2.0, 0.0)]]


def test_points_project_like_columns(spark):
    df = spark.range(200).select((37 + F.col("id") * 0.01).alias("lon"), (55 + F.col("id") % 7 * 0.1).alias("lat"))
    x, y = crs.to_utm(F.col("lon"), F.col("lat"))
    lon, lat = crs.from_utm(F.col("x"), F.col("y"))
    df = df.withColumns({"x": x, "y": y}).withColumns({"lon2": lon, "lat2": lat})
    there, back = (F.get(f(F.array(geometry.point(F.col(a), F.col(b)))), F.lit(0)) for f, a, b in ((crs.points_to_utm, "lon", "lat"), (crs.points_from_utm, "x", "y")))
    assert df.withColumns({"p": there, "q": back}).filter("p.x != x or p.y != y or q.x != lon2 or q.y != lat2").isEmpty()
