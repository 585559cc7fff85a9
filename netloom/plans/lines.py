"""Queries over lines: lengths, stations, bends, quality, intervals and crossings."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import geometry as G
from ..functions import polyline as L
from ..functions.constants import CROSSINGS
from ..operators import linear, simplify
from ..operators.base import table
from . import bindings as B
from .sql import dist, point_segment, segment_segment, turn

_V = B.VERTICES_SQL


def path_length(spark, d):
    return linear.lengths(B.vertices(spark, d), "line", "pos").select("line", F.round("length", 4).alias("length"))


def stations(spark, d):
    return linear.stations(B.vertices(spark, d), "line", "pos").select("line", "pos", F.round("station", 4).alias("station"))


def bends(spark, d):
    return linear.bend_counts(B.vertices(spark, d), "line", "pos", 75.0)


def quality(spark, d):
    q = B.lines(spark, d).select("line", L.quality(F.col("points"), 75.0).alias("q"))
    return q.select("line", F.round("q.length", 4).alias("length"), F.round("q.direct", 4).alias("direct"), F.round("q.detour", 4).alias("detour"), "q.bends", "q.right_angles", "q.micro_bends", "q.backtracks")


def quality_totals(spark, d):
    q = B.lines(spark, d).select(L.quality(F.col("points"), 75.0).alias("q"))
    return q.agg(F.count(F.lit(1)).alias("lines"), F.round(F.sum("q.length"), 2).alias("length"), F.sum("q.bends").alias("bends"), F.sum("q.backtracks").alias("backtracks"), F.round(F.max("q.detour"), 4).alias("max_detour"))


def point_at_half(spark, d):
    p = B.lines(spark, d).filter(F.size("points") > 1).select("line", L.point_at(F.col("points"), L.length(F.col("points")) / 2).alias("p"))
    return p.select("line", F.round("p.x", 3).alias("x"), F.round("p.y", 3).alias("y"))


def straightened(spark, d):
    v = table(spark, d, "events").groupBy(F.col("user_id").alias("line")).agg(F.array_sort(F.collect_list(F.struct("event_id", F.floor(F.col("value") / 100).alias("y")))).alias("v"))
    p = v.select("line", F.transform("v", lambda e, i: F.struct(i.cast("double").alias("x"), e.y.cast("double").alias("y"))).alias("points"))
    return p.select("line", F.size("points").alias("before"), F.size(L.straightened(F.col("points"))).alias("after"))


def bounds(spark, d):
    b = B.lines(spark, d).select("line", G.grown(G.bounds(F.col("points")), 1.0).alias("b"))
    return b.select("line", "b.x0", "b.y0", "b.x1", "b.y1")


def sharp_turns(spark, d):
    return linear.sharp_turns(B.vertices(spark, d), "line", "pos").groupBy("line").agg(F.count(F.lit(1)).alias("n"))


def _leg_pairs(spark, d):
    a = linear.legs(B.vertices(spark, d), "line", "pos")
    b = a.select("line", (F.col("leg") - 2).alias("leg"), F.col("ax").alias("cx"), F.col("ay").alias("cy"), F.col("bx").alias("dx"), F.col("by").alias("dy"))
    return a.join(b, ["line", "leg"])


def segment_distance(spark, d):
    c = {k: F.col(k) for k in ("ax", "ay", "bx", "by", "cx", "cy", "dx", "dy")}
    p = _leg_pairs(spark, d)
    return p.select("line", "leg", F.round(G.segment_segment(*c.values()), 4).alias("d"), F.round(G.point_segment(c["cx"], c["cy"], c["ax"], c["ay"], c["bx"], c["by"]), 4).alias("pd"), F.round(G.intersection_at(c["ax"], c["ay"], c["bx"] + 400.0, c["dy"], c["cx"], c["cy"], c["bx"], c["by"]), 5).alias("t"))


def in_ring(spark, d):
    r = table(spark, d, "part").select("p_partkey", F.array(*(G.point(F.lit(x) * F.col("p_size"), F.lit(y) * F.col("p_size")) for x, y in ((0, 0), (2, 0), (2, 2), (1, 1), (0, 2)))).alias("ring"))
    k = F.col("p_partkey")
    px, py = k * 7919 % 101 + 0.25, k * 104729 % 101 + 0.5
    return r.select("p_partkey", G.in_ring(px, py, F.col("ring")).alias("inside"), F.round(G.ring_distance(px, py, F.col("ring")), 4).alias("d"))


def interval_merge(spark, d):
    i = table(spark, d, "lineitem").select("l_orderkey", F.floor(F.col("l_extendedprice") / 10).cast("long").alias("lo"), (F.floor(F.col("l_extendedprice") / 10) + F.col("l_quantity") * 20).cast("long").alias("hi"))
    return linear.merged(i, ["l_orderkey"])


def _routes(spark, d):
    return table(spark, d, "orders").select(F.col("o_orderkey").alias("seg"), (F.floor(F.col("o_totalprice") / 100) + 1).cast("double").alias("length"))


_FLAG = {"R": ("road", CROSSINGS["road"][0]), "A": ("gas_pipeline", CROSSINGS["gas_pipeline"][0]), "N": ("power_cable", CROSSINGS["power_cable"][0])}


def special_pieces(spark, d):
    flag = F.col("l_returnflag")
    factor = F.when(flag == "R", _FLAG["R"][1]).when(flag == "A", _FLAG["A"][1]).otherwise(_FLAG["N"][1])
    start = F.floor(F.col("l_extendedprice") / 100).cast("double")
    w = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("seg"), start.alias("lo"), (start + F.col("l_quantity")).alias("hi"), factor.alias("factor"), F.concat(flag, F.col("l_suppkey").cast("string")).alias("id"))
    p = linear.pieces(_routes(spark, d), w, "seg")
    return p.select("seg", "lo", "hi", "factor", F.size("ids").cast("long").alias("n_ids"), F.array_join("ids", ",").alias("ids"))


def city_axis(spark, d):
    """Dominant direction modulo a right angle, weighted by length: the best of 180 half-degree bins, then a circular mean."""
    legs = linear.legs(B.vertices(spark, d), "line", "pos").filter("len >= 8")
    quarter = F.pi() / 2
    angle = F.pmod(F.atan2(F.col("by") - F.col("ay"), F.col("bx") - F.col("ax")) + quarter / 2, quarter) - quarter / 2
    seen = legs.select(F.degrees(angle).alias("deg"), "len")
    # a leg votes for the bins within 2 degrees: at most 9 of the 180, found by arithmetic, so legs don't meet all bins
    bin_of = F.explode(F.sequence(F.ceil((F.col("deg") - 2) * 2).cast("int"), F.floor((F.col("deg") + 2) * 2).cast("int")))
    votes = seen.select(bin_of.alias("i"), "len").select((F.pmod(F.col("i") + 90, F.lit(180)) - 90).alias("bin"), "len").groupBy("bin").agg(F.sum("len").alias("w"))
    center = votes.agg(F.max_by("bin", F.struct(F.round("w", 3), -F.col("bin"))).alias("bin"))
    near = seen.crossJoin(F.broadcast(center)).filter(F.abs(F.pmod(F.col("deg") - F.col("bin") / 2 + 45, F.lit(90.0)) - 45) <= 3)  # one row
    mean = F.degrees(F.atan2(F.sum(F.col("len") * F.sin(F.radians(F.col("deg") * 4))), F.sum(F.col("len") * F.cos(F.radians(F.col("deg") * 4))))) / 4
    return near.groupBy("bin").agg(F.round(mean, 4).alias("axis"), F.count(F.lit(1)).alias("legs"))


def _q(sql: str) -> str:
    """Quote the column ``by``, which SQL reserves."""
    import re

    return re.sub(r'(?<![A-Za-z_"])by(?![A-Za-z_"])(?! (?:line|pos|l_|seg|1|x|bin|cut|lo|user))', '"by"', sql)


_L = f"legs AS (SELECT line, pos, row_number() OVER w AS leg, x AS ax, y AS ay, lead(x) OVER w AS bx, lead(y) OVER w AS by, lead(x, 2) OVER w AS cx, lead(y, 2) OVER w AS cy, lead(x, 3) OVER w AS dx, lead(y, 3) OVER w AS dy FROM vertices WINDOW w AS (PARTITION BY line ORDER BY pos))"
_C = f"corners AS (SELECT line, {turn('a', 'b', 'c')} AS turn, {dist('ax', 'ay', 'bx', 'by')} AS lb, {dist('bx', 'by', 'cx', 'cy')} AS la FROM legs WHERE cx IS NOT NULL)"
_LEN = f"lens AS (SELECT line, sum({dist('ax', 'ay', 'bx', 'by')}) AS length FROM legs WHERE bx IS NOT NULL GROUP BY line)"
_ENDS = f"ends AS (SELECT line, {dist('arg_min(x, pos)', 'arg_min(y, pos)', 'arg_max(x, pos)', 'arg_max(y, pos)')} AS direct FROM vertices GROUP BY line)"
_QUAL = f"qual AS (SELECT e.line, coalesce(length, 0.0) AS length, direct, CASE WHEN direct > 1e-9 THEN length / direct END AS detour, count_if(turn >= 8)::BIGINT AS bends, count_if(abs(turn - 90) <= 2)::BIGINT AS right_angles, count_if(turn >= 8 AND (lb <= 75 OR la <= 75))::BIGINT AS micro_bends, count_if(turn > 90)::BIGINT AS backtracks FROM ends e LEFT JOIN lens l ON e.line = l.line LEFT JOIN corners c ON e.line = c.line GROUP BY ALL)"
_RING = " UNION ALL ".join(f"SELECT p_partkey, {i} AS i, {a[0]}.0 * p_size AS ax, {a[1]}.0 * p_size AS ay, {b[0]}.0 * p_size AS bx, {b[1]}.0 * p_size AS by FROM part" for i, (a, b) in enumerate(zip(((0, 0), (2, 0), (2, 2), (1, 1), (0, 2)), ((2, 0), (2, 2), (1, 1), (0, 2), (0, 0)), strict=True)))

def simplified_lines(spark, d):
    """Vertices of users' lines that are off by more than 20 from what the others show."""
    return simplify.simplified(B.vertices(spark, d), 20.0).select("line", F.col("n").cast("long").alias("n"), "x", "y")


_SPLIT = f"""v AS (SELECT line, row_number() OVER (PARTITION BY line ORDER BY pos) - 1 AS n, count(*) OVER (PARTITION BY line) - 1 AS z, x, y FROM vertices),
s(line, i, j) AS (SELECT line, 0::BIGINT, z FROM v WHERE n = 0 AND z > 0 UNION ALL (
  SELECT line, unnest([i, m.n]), unnest([m.n, j]) FROM (SELECT s.line, i, j, max({{'d': {point_segment('v.x', 'v.y', 'a.x', 'a.y', 'b.x', 'b.y')}, 'n': v.n}}) AS m FROM s JOIN v ON v.line = s.line AND v.n > i AND v.n < j JOIN v a ON a.line = s.line AND a.n = i JOIN v b ON b.line = s.line AND b.n = j GROUP BY ALL) WHERE m.d > 20))"""

QUERIES = {
    "path_length": (path_length, _q(f"WITH {_V}, {_L}, {_LEN} SELECT line, round(length, 4) AS length FROM lens")),
    "stations": (stations, "WITH " + _V + f", s AS (SELECT line, pos, coalesce({dist('x', 'y', 'lag(x) OVER w', 'lag(y) OVER w')}, 0.0) AS step FROM vertices WINDOW w AS (PARTITION BY line ORDER BY pos)) SELECT line, pos, round(sum(step) OVER (PARTITION BY line ORDER BY pos ROWS UNBOUNDED PRECEDING), 4) AS station FROM s"),
    "bends": (bends, _q(f"WITH {_V}, {_L}, {_C} SELECT line, count_if(turn >= 15)::BIGINT AS bends, count_if(turn >= 15 AND (lb <= 75 OR la <= 75))::BIGINT AS micro_bends FROM corners GROUP BY line")),
    "line_quality": (quality, _q(f"WITH {_V}, {_L}, {_C}, {_LEN}, {_ENDS}, {_QUAL} SELECT line, round(length, 4) AS length, round(direct, 4) AS direct, round(detour, 4) AS detour, bends, right_angles, micro_bends, backtracks FROM qual")),
    "quality_totals": (quality_totals, _q(f"WITH {_V}, {_L}, {_C}, {_LEN}, {_ENDS}, {_QUAL} SELECT count(*) AS lines, round(sum(length), 2) AS length, sum(bends)::BIGINT AS bends, sum(backtracks)::BIGINT AS backtracks, round(max(detour), 4) AS max_detour FROM qual")),
    "point_at_half": (point_at_half, _q(f"WITH {_V}, {_L}, s AS (SELECT line, ax, ay, bx, by, {dist('ax', 'ay', 'bx', 'by')} AS len, sum({dist('ax', 'ay', 'bx', 'by')}) OVER (PARTITION BY line ORDER BY pos) AS hi, sum({dist('ax', 'ay', 'bx', 'by')}) OVER (PARTITION BY line) / 2 AS half FROM legs WHERE bx IS NOT NULL) SELECT line, round(ax + (half - (hi - len)) / len * (bx - ax), 3) AS x, round(ay + (half - (hi - len)) / len * (by - ay), 3) AS y FROM s WHERE hi > half AND hi - len <= half")),
    "straightened": (straightened, "WITH e AS (SELECT user_id AS line, floor(value / 100) AS y, lag(floor(value / 100)) OVER w AS p, lead(floor(value / 100)) OVER w AS q FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id)) SELECT line, count(*)::INTEGER AS before, count_if(p IS NULL OR q IS NULL OR y - p <> q - y)::INTEGER AS after FROM e GROUP BY line"),
    "line_bounds": (bounds, f"WITH {_V} SELECT line, min(x) - 1 AS x0, min(y) - 1 AS y0, max(x) + 1 AS x1, max(y) + 1 AS y1 FROM vertices GROUP BY line"),
    "sharp_turns": (sharp_turns, _q(f"WITH {_V}, {_L} SELECT line, count(*) AS n FROM legs WHERE cx IS NOT NULL AND sqrt((bx-ax)*(bx-ax)+(by-ay)*(by-ay)) * sqrt((cx-bx)*(cx-bx)+(cy-by)*(cy-by)) > 1e-12 AND ((bx-ax)*(cx-bx)+(by-ay)*(cy-by)) / (sqrt((bx-ax)*(bx-ax)+(by-ay)*(by-ay)) * sqrt((cx-bx)*(cx-bx)+(cy-by)*(cy-by))) < -1e-7 GROUP BY line")),
    "segment_distance": (segment_distance, _q(f"WITH {_V}, {_L}, g AS (SELECT * FROM legs WHERE dx IS NOT NULL), t AS (SELECT line, leg, bx + 400 - ax AS rx, dy - ay AS ry, bx - cx AS sx, by - cy AS sy, cx - ax AS ox, cy - ay AS oy FROM g), u AS (SELECT line, leg, (ox*sy - oy*sx) / nullif(rx*sy - ry*sx, 0) AS t, (ox*ry - oy*rx) / nullif(rx*sy - ry*sx, 0) AS u FROM t) SELECT g.line, g.leg, round({segment_segment('a', 'b', 'c', 'd')}, 4) AS d, round({point_segment('cx', 'cy', 'ax', 'ay', 'bx', 'by')}, 4) AS pd, round(CASE WHEN u.t BETWEEN -1e-8 AND 1 + 1e-8 AND u.u BETWEEN -1e-8 AND 1 + 1e-8 THEN least(1.0, greatest(0.0, u.t)) END, 5) AS t FROM g JOIN u ON g.line = u.line AND g.leg = u.leg")),
    "point_in_ring": (in_ring, _q(f"WITH r AS ({_RING}), p AS (SELECT r.*, p_partkey * 7919 % 101 + 0.25::DOUBLE AS px, p_partkey * 104729 % 101 + 0.5::DOUBLE AS py FROM r), g AS (SELECT p_partkey, min({point_segment('px', 'py', 'ax', 'ay', 'bx', 'by')}) AS d, sum(CASE WHEN (ay > py) <> (by > py) AND px < (bx - ax) * (py - ay) / CASE WHEN by = ay THEN 1e-30 ELSE by - ay END + ax THEN 1 ELSE 0 END) AS n FROM p GROUP BY 1) SELECT p_partkey, d < 1e-7 OR n % 2 = 1 AS inside, round(d, 4) AS d FROM g")),
    "interval_merge": (interval_merge, "WITH i AS (SELECT l_orderkey, floor(l_extendedprice / 10)::BIGINT AS lo, (floor(l_extendedprice / 10) + l_quantity * 20)::BIGINT AS hi FROM lineitem), f AS (SELECT *, CASE WHEN lo <= max(hi) OVER (PARTITION BY l_orderkey ORDER BY lo, hi ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 0 ELSE 1 END AS n FROM i), g AS (SELECT *, sum(n) OVER (PARTITION BY l_orderkey ORDER BY lo, hi ROWS UNBOUNDED PRECEDING) AS island FROM f) SELECT l_orderkey, min(lo) AS lo, max(hi) AS hi FROM g GROUP BY l_orderkey, island"),
    "special_pieces": (special_pieces, f"WITH r AS (SELECT o_orderkey AS seg, (floor(o_totalprice / 100) + 1)::DOUBLE AS length FROM orders), w AS (SELECT l_orderkey AS seg, greatest(floor(l_extendedprice / 100), 0.0) AS lo, least(floor(l_extendedprice / 100) + l_quantity, r.length) AS hi, CASE l_returnflag WHEN 'R' THEN {_FLAG['R'][1]}::DOUBLE WHEN 'A' THEN {_FLAG['A'][1]}::DOUBLE ELSE {_FLAG['N'][1]}::DOUBLE END AS factor, l_returnflag || l_suppkey AS id FROM lineitem JOIN r ON r.seg = l_orderkey), v AS (SELECT * FROM w WHERE lo < hi), c AS (SELECT seg, 0.0::DOUBLE AS cut FROM r UNION SELECT seg, length FROM r UNION SELECT seg, lo FROM v UNION SELECT seg, hi FROM v), s AS (SELECT seg, cut AS lo, lead(cut) OVER (PARTITION BY seg ORDER BY cut) AS hi FROM c), m AS (SELECT s.seg, s.lo, s.hi, v.factor, v.id FROM s LEFT JOIN v ON v.seg = s.seg AND v.lo <= (s.lo + s.hi) / 2 AND (s.lo + s.hi) / 2 <= v.hi WHERE s.hi - s.lo >= 1e-7) SELECT seg, lo, hi, coalesce(max(factor), 1.0::DOUBLE) AS factor, count(DISTINCT id) AS n_ids, coalesce(string_agg(DISTINCT id, ',' ORDER BY id), '') AS ids FROM m GROUP BY seg, lo, hi"),
    "city_axis": (city_axis, _q(f"WITH {_V}, {_L}, o AS (SELECT degrees((((atan2(by - ay, bx - ax) + pi() / 4) % (pi() / 2)) + pi() / 2) % (pi() / 2) - pi() / 4) AS deg, {dist('ax', 'ay', 'bx', 'by')} AS len FROM legs WHERE bx IS NOT NULL), s AS (SELECT * FROM o WHERE len >= 8), bins AS (SELECT range::INTEGER AS bin FROM range(-90, 90)), v AS (SELECT bin, round(sum(len), 3) AS w FROM bins, s WHERE abs(((bin / 2.0::DOUBLE - deg + 45) % 90 + 90) % 90 - 45) <= 2 GROUP BY bin), c AS (SELECT arg_max(bin, (w, -bin)) AS bin FROM v) SELECT bin, round(degrees(atan2(sum(len * sin(radians(deg * 4))), sum(len * cos(radians(deg * 4))))) / 4, 4) AS axis, count(*) AS legs FROM s, c WHERE abs(((deg - bin / 2.0::DOUBLE + 45) % 90 + 90) % 90 - 45) <= 3 GROUP BY bin")),
    "simplified_lines": (simplified_lines, f"WITH RECURSIVE {B.VERTICES_SQL}, {_SPLIT} SELECT line, n, x, y FROM v WHERE n = 0 OR (line, n) IN (SELECT line, j FROM s)"),
}
