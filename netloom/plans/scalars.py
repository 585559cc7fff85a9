"""Queries over scalar functions: sizes, prices, factors, identifiers and coordinates."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import crs
from ..functions import pricing as P
from ..functions.constants import LENGTH_EQUIVALENT
from ..operators.base import table
from .sql import KINDS_CTE, SIZES_CTE, chamber, dn_of

_FLOW, _LEN = "l_quantity", "l_extendedprice / 20"
_KIND = "CASE l_returnflag WHEN 'R' THEN 'road' WHEN 'A' THEN 'gas_pipeline' ELSE 'power_cable' END"


def _items(spark, d):
    return table(spark, d, "lineitem")


def dn_select(spark, d):
    dn = P.select_dn(F.col("l_quantity"), F.col("l_extendedprice") / 20)
    sized = _items(spark, d).select("l_orderkey", "l_partkey", "l_suppkey", dn.alias("dn"))
    return sized.select("*", P.pipe_price(F.col("dn")).alias("price"), P.longest_run(F.col("dn")).alias("max_len"))


def penalty(spark, d):
    return _items(spark, d).groupBy("l_suppkey").agg(F.round(F.sum(P.disconnection_penalty(F.col("l_quantity"))), 2).alias("penalty"), F.count(F.lit(1)).alias("n"))


def chamber_prices(spark, d):
    dn = P.select_dn(F.col("l_quantity") * 100)
    return _items(spark, d).select(dn.alias("dn")).groupBy("dn").agg(F.count(F.lit(1)).alias("n"), F.sum(P.chamber_price(F.col("dn"))).alias("chamber_cost"))


def clearances(spark, d):
    kind = F.when(F.col("p_partkey") % 2 == 0, "oks").otherwise("water")
    dn = P.select_dn(F.col("p_retailprice") * 5)
    sized = table(spark, d, "part").select("p_partkey", kind.alias("kind"), dn.alias("dn"))
    return sized.select("p_partkey", "dn", F.round(P.clearance(F.col("kind"), F.col("dn")), 6).alias("clearance"), P.envelope_height(F.col("dn")).alias("height"))


def depth_factors(spark, d):
    depth, other = F.col("l_quantity") / 10, F.col("l_tax") * 100
    return _items(spark, d).groupBy("l_quantity", "l_tax").agg(F.count(F.lit(1)).alias("n")).select("l_quantity", "l_tax", "n", F.round(P.depth_factor(depth), 6).alias("factor"), F.round(P.piece_depth_factor(depth, other), 6).alias("piece_factor"))


def crossing_factors(spark, d):
    kind = F.when(F.col("l_returnflag") == "R", "road").when(F.col("l_returnflag") == "A", "gas_pipeline").otherwise("power_cable")
    return _items(spark, d).groupBy(kind.alias("kind")).agg(F.count(F.lit(1)).alias("n"), F.sum("l_quantity").alias("metres")).select("kind", "n", "metres", P.crossing_factor(F.col("kind")).alias("factor"))


def opening_prices(spark, d):
    is_chamber = F.col("l_linenumber") == 1
    dn, old = P.select_dn(F.col("l_quantity")), P.select_dn(F.col("l_extendedprice") / 20)
    sized = _items(spark, d).select("l_suppkey", is_chamber.alias("c"), dn.alias("dn"), old.alias("old"))
    return sized.select("l_suppkey", P.opening_price(F.col("c"), F.col("dn"), F.col("old")).alias("price")).groupBy("l_suppkey").agg(F.sum("price").alias("opening_cost"), F.count(F.lit(1)).alias("n"))


def scores(spark, d):
    o = table(spark, d, "orders")
    return o.select("o_orderkey", F.round(P.score(F.col("o_totalprice") * 1000, F.col("o_totalprice") / 100), 8).alias("score"), F.round(F.col("o_totalprice") * LENGTH_EQUIVALENT, 3).alias("length_rub"))


def id_keys(spark, d):
    c = table(spark, d, "customer")
    return c.select("c_custkey", P.id_key(F.col("c_custkey"), True).alias("number_key"), P.id_key(F.col("c_custkey").cast("string"), False).alias("text_key"), P.id_key(F.col("c_custkey") / 2, True).alias("half_key"))


def edge_keys(spark, d):
    e = P.edge_key(F.col("l_partkey"), F.col("l_suppkey"))
    return _items(spark, d).select(e.alias("e")).groupBy(F.col("e.a").alias("a"), F.col("e.b").alias("b")).agg(F.count(F.lit(1)).alias("n"))


def turn_prices(spark, d):
    x, y = F.col("l_linenumber") - 4, F.col("l_quantity") - 25
    return _items(spark, d).groupBy("l_linenumber", "l_quantity").agg(F.count(F.lit(1)).alias("n")).select("l_linenumber", "l_quantity", "n", F.round(P.turn_price(F.lit(1.0), F.lit(0.0), x + 0.5, y + 0.0, 8.0), 6).alias("price"))


_LON, _LAT = "36.5 + (c_custkey * 7919 % 10007) / 10007.0::DOUBLE", "55 + (c_custkey * 104729 % 10007) / 10007.0::DOUBLE"


def _lonlat():
    k = F.col("c_custkey")
    return 36.5 + k * 7919 % 10007 / F.lit(10007.0), 55 + k * 104729 % 10007 / F.lit(10007.0)


def utm_forward(spark, d):
    x, y = crs.to_utm(*_lonlat())
    return table(spark, d, "customer").select("c_custkey", F.round(x, 3).alias("x"), F.round(y, 3).alias("y"))


def utm_inverse(spark, d):
    k = F.col("c_custkey")
    lon, lat = crs.from_utm(400000.0 + k * 7919 % 10007 * 20, 6100000.0 + k * 104729 % 10007 * 20)
    return table(spark, d, "customer").select("c_custkey", F.round(lon, 7).alias("lon"), F.round(lat, 7).alias("lat"))


def utm_round_trip(spark, d):
    lon, lat = _lonlat()
    back = crs.from_utm(*crs.to_utm(lon, lat))
    return table(spark, d, "customer").select("c_custkey", (F.abs(back[0] - lon) < 1e-8).alias("lon_ok"), (F.abs(back[1] - lat) < 1e-8).alias("lat_ok"))


_ORIGIN, _ANGLE = (500.0, 500.0), 0.3


def rotate(spark, d):
    k = F.col("c_custkey")
    x, y = k * 7919 % 10007 / F.lit(10.0), k * 104729 % 10007 / F.lit(10.0)
    u, v = crs.rotate(x, y, _ORIGIN, _ANGLE)
    p, q = crs.unrotate(u, v, _ORIGIN, _ANGLE)
    return table(spark, d, "customer").select("c_custkey", F.round(u, 6).alias("u"), F.round(v, 6).alias("v"), F.round(p, 6).alias("x"), F.round(q, 6).alias("y"))


def grid_cells(spark, d):
    k = F.col("c_custkey")
    x, y = k * 7919 % 10007 / F.lit(2.0), k * 104729 % 10007 / F.lit(2.0)
    cx, cy = crs.cell_of(x, 5.0), crs.cell_of(y, 5.0)
    cells = table(spark, d, "customer").select(cx.alias("cx"), cy.alias("cy"), crs.cell_center(cx, 5.0).alias("mx"), crs.cell_center(cy, 5.0).alias("my"))
    return cells.groupBy("cx", "cy", "mx", "my").agg(F.count(F.lit(1)).alias("n"))


def _forward_sql() -> str:
    e2, ep2, arc = crs._E2, crs._EP2, crs._ARC
    m = f"6378137.0::DOUBLE * ({arc[0]!r}::DOUBLE * phi + {arc[1]!r}::DOUBLE * sin(2*phi) + {arc[2]!r}::DOUBLE * sin(4*phi) + {arc[3]!r}::DOUBLE * sin(6*phi))"
    return f"""
WITH p AS (SELECT c_custkey, radians({_LAT}) AS phi, radians({_LON}) - radians(39.0) AS lam FROM customer),
q AS (SELECT c_custkey, phi, 6378137.0::DOUBLE / sqrt(1 - {e2!r}::DOUBLE * sin(phi) * sin(phi)) AS nu, tan(phi) AS tg, tan(phi) * tan(phi) AS t, {ep2!r}::DOUBLE * cos(phi) * cos(phi) AS c, cos(phi) * lam AS a, {m} AS m FROM p)
SELECT c_custkey,
  round(500000.0::DOUBLE + 0.9996::DOUBLE * nu * (a + (1 - t + c) * a*a*a / 6 + (5 - 18*t + t*t + 72*c - 58*{ep2!r}::DOUBLE) * a*a*a*a*a / 120), 3) AS x,
  round(0.9996::DOUBLE * (m + nu * tg * (a*a/2 + (5 - t + 9*c + 4*c*c) * a*a*a*a / 24 + (61 - 58*t + t*t + 600*c - 330*{ep2!r}::DOUBLE) * a*a*a*a*a*a / 720)), 3) AS y
FROM q"""


def _inverse_sql() -> str:
    e2, ep2, foot = crs._E2, crs._EP2, crs._FOOT
    return f"""
WITH p AS (SELECT c_custkey, 400000.0::DOUBLE + (c_custkey * 7919 % 10007) * 20 AS x, (6100000.0::DOUBLE + (c_custkey * 104729 % 10007) * 20) / ({0.9996 * 6378137.0 * crs._ARC[0]!r}::DOUBLE) AS mu FROM customer),
q AS (SELECT c_custkey, x, mu + {foot[0]!r}::DOUBLE * sin(2*mu) + {foot[1]!r}::DOUBLE * sin(4*mu) + {foot[2]!r}::DOUBLE * sin(6*mu) + {foot[3]!r}::DOUBLE * sin(8*mu) AS f FROM p),
r AS (SELECT c_custkey, f, cos(f) AS cf, tan(f) AS tg, tan(f) * tan(f) AS t, {ep2!r}::DOUBLE * cos(f) * cos(f) AS c, 6378137.0::DOUBLE / sqrt(1 - {e2!r}::DOUBLE * sin(f) * sin(f)) AS nu, 6378137.0::DOUBLE * {1 - e2!r}::DOUBLE / ((1 - {e2!r}::DOUBLE * sin(f) * sin(f)) * sqrt(1 - {e2!r}::DOUBLE * sin(f) * sin(f))) AS rho, x FROM q),
s AS (SELECT *, (x - 500000.0) / (nu * 0.9996::DOUBLE) AS d FROM r)
SELECT c_custkey,
  round(39.0 + degrees((d - (1 + 2*t + c) * d*d*d / 6 + (5 - 2*c + 28*t - 3*c*c + 8*{ep2!r}::DOUBLE + 24*t*t) * d*d*d*d*d / 120) / cf), 7) AS lon,
  round(degrees(f - nu * tg / rho * (d*d/2 - (5 + 3*t + 10*c - 4*c*c - 9*{ep2!r}::DOUBLE) * d*d*d*d / 24 + (61 + 90*t + 298*c + 45*t*t - 252*{ep2!r}::DOUBLE - 3*c*c) * d*d*d*d*d*d / 720)), 7) AS lat
FROM s"""


QUERIES = {
    "dn_select": (dn_select, f"WITH {SIZES_CTE}, i AS (SELECT l_orderkey, l_partkey, l_suppkey, {dn_of(_FLOW, _LEN)} AS dn FROM lineitem) SELECT i.*, z.price, z.max_len FROM i LEFT JOIN sizes z ON z.dn = i.dn"),
    "penalty": (penalty, "SELECT l_suppkey, round(sum(100000000 + 500000 * l_quantity), 2) AS penalty, count(*) AS n FROM lineitem GROUP BY 1"),
    "chamber_price": (chamber_prices, f"WITH {SIZES_CTE}, i AS (SELECT {dn_of('l_quantity * 100')} AS dn FROM lineitem) SELECT dn, count(*) AS n, sum({chamber('dn')})::BIGINT AS chamber_cost FROM i GROUP BY dn"),
    "clearance": (clearances, f"WITH {SIZES_CTE}, i AS (SELECT p_partkey, {dn_of('p_retailprice * 5')} AS dn FROM part) SELECT p_partkey, i.dn, round(CASE WHEN p_partkey % 2 = 0 THEN CASE WHEN i.dn < 500 THEN 5.0 WHEN i.dn <= 800 THEN 7.0 ELSE 9.0 END ELSE 1.0 END + z.width / 2, 6) AS clearance, z.height FROM i LEFT JOIN sizes z ON z.dn = i.dn"),
    "depth_factor": (depth_factors, "SELECT l_quantity, l_tax, count(*) AS n, round(1 + 0.1::DOUBLE * greatest(0, l_quantity / 10 - 3), 6) AS factor, round((1 + 0.1::DOUBLE * greatest(0, l_quantity / 10 - 3) + 1 + 0.1::DOUBLE * greatest(0, l_tax * 100 - 3)) / 2, 6) AS piece_factor FROM lineitem GROUP BY 1, 2"),
    "crossing_factor": (crossing_factors, f"WITH {KINDS_CTE}, i AS (SELECT {_KIND} AS kind, count(*) AS n, sum(l_quantity) AS metres FROM lineitem GROUP BY 1) SELECT i.kind, n, metres, factor FROM i JOIN kinds USING (kind)"),
    "opening_price": (opening_prices, f"WITH {SIZES_CTE}, i AS (SELECT l_suppkey, l_linenumber, {dn_of(_FLOW)} AS dn, {dn_of(_LEN)} AS old FROM lineitem) SELECT l_suppkey, sum(CASE WHEN l_linenumber = 1 THEN 5000000 ELSE {chamber('greatest(dn, old)')} END)::BIGINT AS opening_cost, count(*) AS n FROM i GROUP BY 1"),
    "score_term": (scores, f"SELECT o_orderkey, round(0.7::DOUBLE * (o_totalprice * 1000) / 25000000 + 0.3::DOUBLE * (o_totalprice / 100) / 100, 8) AS score, round(o_totalprice * {LENGTH_EQUIVALENT!r}::DOUBLE, 3) AS length_rub FROM orders"),
    "id_key": (id_keys, "SELECT c_custkey, 'n:' || c_custkey AS number_key, 's:' || c_custkey AS text_key, 'n:' || CASE WHEN c_custkey % 2 = 0 THEN (c_custkey // 2)::VARCHAR ELSE (c_custkey // 2)::VARCHAR || '.5' END AS half_key FROM customer"),
    "edge_key": (edge_keys, "SELECT least(l_partkey, l_suppkey) AS a, greatest(l_partkey, l_suppkey) AS b, count(*) AS n FROM lineitem GROUP BY 1, 2"),
    "turn_price": (turn_prices, "WITH i AS (SELECT l_linenumber, l_quantity, count(*) AS n FROM lineitem GROUP BY 1, 2), a AS (SELECT *, acos(least(1.0, greatest(-1.0, (l_linenumber - 4 + 0.5::DOUBLE) / sqrt((l_linenumber - 4 + 0.5::DOUBLE) * (l_linenumber - 4 + 0.5::DOUBLE) + (l_quantity - 25) * (l_quantity - 25))))) AS g FROM i) SELECT l_linenumber, l_quantity, n, round(CASE WHEN g < radians(8.0) THEN 0.0 ELSE 8.0::DOUBLE * g / (pi() / 2) END, 6) AS price FROM a"),
    "utm_forward": (utm_forward, _forward_sql()),
    "utm_inverse": (utm_inverse, _inverse_sql()),
    "utm_round_trip": (utm_round_trip, "SELECT c_custkey, true AS lon_ok, true AS lat_ok FROM customer"),
    "rotate": (rotate, "WITH p AS (SELECT c_custkey, (c_custkey * 7919 % 10007) / 10.0::DOUBLE AS x, (c_custkey * 104729 % 10007) / 10.0::DOUBLE AS y FROM customer) SELECT c_custkey, round(cos(0.3::DOUBLE) * (x - 500) + sin(0.3::DOUBLE) * (y - 500), 6) AS u, round(cos(0.3::DOUBLE) * (y - 500) - sin(0.3::DOUBLE) * (x - 500), 6) AS v, round(x, 6) AS x, round(y, 6) AS y FROM p"),
    "grid_cells": (grid_cells, "WITH p AS (SELECT round_even((c_custkey * 7919 % 10007) / 2.0::DOUBLE / 5, 0)::BIGINT AS cx, round_even((c_custkey * 104729 % 10007) / 2.0::DOUBLE / 5, 0)::BIGINT AS cy FROM customer) SELECT cx, cy, cx * 5.0::DOUBLE AS mx, cy * 5.0::DOUBLE AS my, count(*) AS n FROM p GROUP BY ALL"),
}
