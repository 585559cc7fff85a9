"""Measures and edits of lines held as arrays of points (struct x, y)."""

from __future__ import annotations

import math

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .constants import BEND_PRICED, BEND_REPORTED
from .geometry import distance, legs


def leg_lengths(points: Column) -> Column:
    return F.transform(legs(points), lambda s: distance(s.a.x, s.a.y, s.b.x, s.b.y))


def total(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda acc, v: acc + v)


def length(points: Column) -> Column:
    return total(leg_lengths(points))


def stations(points: Column) -> Column:
    """Distance along the line of each vertex, 0 first."""
    return F.aggregate(leg_lengths(points), F.array(F.lit(0.0)), lambda acc, v: F.concat(acc, F.array(F.element_at(acc, -1) + v)))


def point_at(points: Column, at: Column) -> Column:
    """Point at a distance along the line; beyond the ends, the end."""
    s = stations(points)
    n = F.size(points)
    i = F.least(n - 2, F.greatest(F.lit(0), F.size(F.filter(s, lambda v: v <= at)) - 1))
    a, b, lo, hi = F.get(points, i), F.get(points, i + 1), F.get(s, i), F.get(s, i + 1)
    t = F.when(hi > lo, F.least(F.lit(1.0), F.greatest(F.lit(0.0), (at - lo) / (hi - lo)))).otherwise(0.0)
    return F.struct((a.x + t * (b.x - a.x)).alias("x"), (a.y + t * (b.y - a.y)).alias("y"))


def turn(ax, ay, bx, by, cx, cy) -> Column:
    """Change of heading at b in degrees; null where a leg has no length."""
    ux, uy, vx, vy = bx - ax, by - ay, cx - bx, cy - by
    lu, lv = F.sqrt(ux * ux + uy * uy), F.sqrt(vx * vx + vy * vy)
    cosine = (ux * vx + uy * vy) / F.when((lu > 1e-9) & (lv > 1e-9), lu * lv)
    return F.degrees(F.acos(F.least(F.lit(1.0), F.greatest(F.lit(-1.0), cosine))))


def corners(points: Column) -> Column:
    """(turn in degrees, leg before, leg after) at each inner vertex with two real legs."""
    n = F.size(points)

    def at(k):
        a, b, c = k.leg.a, k.leg.b, k.c
        return F.struct(turn(a.x, a.y, b.x, b.y, c.x, c.y).alias("turn"), distance(a.x, a.y, b.x, b.y).alias("before"), distance(b.x, b.y, c.x, c.y).alias("after"))

    inner = F.greatest(n - 2, F.lit(0))
    three = F.zip_with(F.slice(legs(points), 1, inner), F.slice(points, 3, inner), lambda leg, c: F.struct(leg.alias("leg"), c.alias("c")))
    return F.filter(F.transform(F.when(n > 2, three).otherwise(F.slice(three, 1, 0)), at), lambda c: c.turn.isNotNull())


def bends(points: Column, least: float = BEND_PRICED) -> Column:
    return F.size(F.filter(corners(points), lambda c: c.turn >= least)).cast("long")


def micro_bends(points: Column, longest_leg: float, least: float = BEND_PRICED) -> Column:
    return F.size(F.filter(corners(points), lambda c: (c.turn >= least) & ((c.before <= longest_leg) | (c.after <= longest_leg)))).cast("long")


def right_angles(points: Column) -> Column:
    return F.size(F.filter(corners(points), lambda c: (c.turn >= 80) & (c.turn < 100))).cast("long")


def quality(points: Column, micro_leg: float = 5.0) -> Column:
    """length, direct, detour, bends, right_angles, micro_bends, backtracks of a line, by the report's thresholds."""
    c, whole = corners(points), length(points)
    a, b = F.get(points, F.lit(0)), F.element_at(points, -1)
    direct = distance(a.x, a.y, b.x, b.y)
    count = lambda test: F.size(F.filter(c, test)).cast("long")
    return F.struct(
        whole.alias("length"),
        direct.alias("direct"),
        F.when(direct > 1e-9, whole / direct).alias("detour"),
        count(lambda k: k.turn >= BEND_REPORTED).alias("bends"),
        count(lambda k: F.abs(k.turn - 90) <= 2).alias("right_angles"),
        count(lambda k: (k.turn >= BEND_REPORTED) & ((k.before <= micro_leg) | (k.after <= micro_leg))).alias("micro_bends"),
        count(lambda k: k.turn > 90).alias("backtracks"),
    )


_SLIM = T.ArrayType(T.StructType([T.StructField("x", T.DoubleType()), T.StructField("y", T.DoubleType())]))


def _ahead(ax, ay, bx, by, px, py) -> bool:
    """Whether b lies on the way from a straight ahead to p; compared as Spark does, which takes NaN as the largest number."""
    cross = (bx - ax) * (py - by) - (by - ay) * (px - bx)
    dot = (bx - ax) * (px - bx) + (by - ay) * (py - by)
    far = math.sqrt((ax - px) * (ax - px) + (ay - py) * (ay - py))
    return (far != far or abs(cross) <= 1e-6 * max(1.0, far)) and not dot < 0


def _kept(xs: list, ys: list, begin: int, end: int, kept: list[int]) -> None:
    """Append the numbers of the vertices that stay of begin to end."""
    first = len(kept)
    for p in range(begin, end):
        px, py = xs[p], ys[p]
        try:
            if len(kept) > first:
                dx, dy = xs[kept[-1]] - px, ys[kept[-1]] - py
                if math.sqrt(dx * dx + dy * dy) < 1e-8:
                    continue
            # a vertex that was kept bends from the one before it, so after one pop the next is looked at once more and stays
            for _ in range(2):
                if len(kept) - first < 2 or not _ahead(xs[kept[-2]], ys[kept[-2]], xs[kept[-1]], ys[kept[-1]], px, py):
                    break
                kept.pop()
        except TypeError:  # a null coordinate is like no other
            pass
        kept.append(p)


def _straightened(lines: pa.Array) -> pa.Array:
    xs, ys = (c.to_pylist() for c in lines.values.flatten())
    at, kept, offsets = lines.offsets.to_pylist(), [], [0]
    for k, valid in enumerate(lines.is_valid().to_pylist()):
        if valid:
            _kept(xs, ys, at[k], at[k + 1], kept)
        offsets.append(len(kept))
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), lines.values.take(pa.array(kept, pa.int64())), mask=lines.is_null() if lines.null_count else None)


def straightened(points: Column) -> Column:
    """Without repeated vertices and vertices on the way straight ahead; a turn back stays. One pass with a stack, over Arrow batches
    of lines: a stack that a lambda builds is copied for each vertex."""
    return F.arrow_udf(_straightened, _SLIM)(points.cast(_SLIM))


def headings_apart(a: Column, b: Column) -> Column:
    """Distance of two directions modulo a right angle, in radians."""
    quarter = math.pi / 2
    return F.abs(F.pmod(a - b + quarter / 2, F.lit(quarter)) - quarter / 2)
