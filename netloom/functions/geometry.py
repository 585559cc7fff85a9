"""Planar geometry as column expressions. A point is a struct (x, y), a ring or line an array of points.

Scalar forms on plain x and y columns serve joins on exploded segments; array forms serve whole geometries in one row.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .constants import CONFLICT


def point(x: Column, y: Column) -> Column:
    return F.struct(x.cast("double").alias("x"), y.cast("double").alias("y"))


def distance(ax: Column, ay: Column, bx: Column, by: Column) -> Column:
    return F.sqrt((ax - bx) * (ax - bx) + (ay - by) * (ay - by))


def point_segment(px: Column, py: Column, ax: Column, ay: Column, bx: Column, by: Column) -> Column:
    """Distance to the nearest point of a segment; one of no length counts as its first point."""
    vx, vy = bx - ax, by - ay
    square = vx * vx + vy * vy
    t = F.least(F.lit(1.0), F.greatest(F.lit(0.0), ((px - ax) * vx + (py - ay) * vy) / F.when(square > 1e-12, square)))
    t = F.coalesce(t, F.lit(0.0))
    return distance(px, py, ax + t * vx, ay + t * vy)


def projection(px: Column, py: Column, ax: Column, ay: Column, bx: Column, by: Column) -> Column:
    """Position of the nearest point along the segment, 0 to 1."""
    vx, vy = bx - ax, by - ay
    square = vx * vx + vy * vy
    return F.when(square > 1e-12, F.least(F.lit(1.0), F.greatest(F.lit(0.0), ((px - ax) * vx + (py - ay) * vy) / square))).otherwise(0.0)


def orientation(px: Column, py: Column, qx: Column, qy: Column, rx: Column, ry: Column) -> Column:
    return (qx - px) * (ry - py) - (qy - py) * (rx - px)


def segments_meet(ax, ay, bx, by, cx, cy, dx, dy) -> Column:
    boxes = (F.greatest(ax, bx) >= F.least(cx, dx)) & (F.greatest(cx, dx) >= F.least(ax, bx)) & (F.greatest(ay, by) >= F.least(cy, dy)) & (F.greatest(cy, dy) >= F.least(ay, by))
    return boxes & (orientation(ax, ay, bx, by, cx, cy) * orientation(ax, ay, bx, by, dx, dy) <= 0) & (orientation(cx, cy, dx, dy, ax, ay) * orientation(cx, cy, dx, dy, bx, by) <= 0)


def segment_segment(ax, ay, bx, by, cx, cy, dx, dy) -> Column:
    """Distance of two segments; 0 where they meet."""
    apart = F.least(point_segment(ax, ay, cx, cy, dx, dy), point_segment(bx, by, cx, cy, dx, dy), point_segment(cx, cy, ax, ay, bx, by), point_segment(dx, dy, ax, ay, bx, by))
    return F.when(segments_meet(ax, ay, bx, by, cx, cy, dx, dy), 0.0).otherwise(apart)


def intersection_at(ax, ay, bx, by, cx, cy, dx, dy, tolerance: float = 1e-8) -> Column:
    """Position along ab at which cd crosses it; null if they are parallel or don't meet. What ends beside the other by no more than
    the tolerance (a share of its length) meets it; with the tolerance 0 they must meet by their coordinates, however positions round."""
    rx, ry, sx, sy = bx - ax, by - ay, dx - cx, dy - cy
    det = rx * sy - ry * sx
    safe = F.when(F.abs(det) > 1e-12, det)
    t = ((cx - ax) * sy - (cy - ay) * sx) / safe
    u = ((cx - ax) * ry - (cy - ay) * rx) / safe
    met = t.between(-tolerance, 1 + tolerance) & u.between(-tolerance, 1 + tolerance) if tolerance else t.isNotNull() & segments_meet(ax, ay, bx, by, cx, cy, dx, dy)
    return F.when(met, F.least(F.lit(1.0), F.greatest(F.lit(0.0), t)))


# ---------------------------------------------------------------- arrays of points


def legs(points: Column, closed: bool = False) -> Column:
    """Consecutive pairs (a, b) of a line, or of a ring with its closing leg. Two parts of the array are zipped: a lambda that looked
    points up by number would compute a derived array anew for each."""
    n = F.size(points)
    rest = F.greatest(n - 1, F.lit(0))
    here, then = (points, F.concat(F.slice(points, 2, rest), F.slice(points, 1, 1))) if closed else (F.slice(points, 1, rest), F.slice(points, 2, rest))
    return F.when(n > (0 if closed else 1), F.zip_with(here, then, lambda a, b: F.struct(a.alias("a"), b.alias("b")))).otherwise(F.array().cast("array<struct<a:struct<x:double,y:double>,b:struct<x:double,y:double>>>"))


def ring_distance(px: Column, py: Column, ring: Column) -> Column:
    """Distance to a ring's boundary; infinite with fewer than two points."""
    return F.coalesce(F.array_min(F.transform(F.when(F.size(ring) >= 2, legs(ring, closed=True)), lambda s: point_segment(px, py, s.a.x, s.a.y, s.b.x, s.b.y))), F.lit(float("inf")))


def in_ring(px: Column, py: Column, ring: Column) -> Column:
    """Even-odd test; the boundary (to 1e-7) counts as inside. Fewer than three points enclose nothing."""
    sides = legs(ring, closed=True)
    crosses = lambda s: ((s.a.y > py) != (s.b.y > py)) & (px < (s.b.x - s.a.x) * (py - s.a.y) / F.when(s.b.y == s.a.y, 1e-30).otherwise(s.b.y - s.a.y) + s.a.x)
    odd = F.size(F.filter(sides, crosses)) % 2 == 1
    return (F.size(ring) >= 3) & (odd | (ring_distance(px, py, ring) < CONFLICT))


def in_area(px: Column, py: Column, shells: Column, holes: Column) -> Column:
    return F.exists(shells, lambda r: in_ring(px, py, r)) & ~F.exists(holes, lambda r: in_ring(px, py, r) & (ring_distance(px, py, r) >= CONFLICT))


def bounds(points: Column) -> Column:
    x, y = F.transform(points, lambda p: p.x), F.transform(points, lambda p: p.y)
    return F.struct(F.array_min(x).alias("x0"), F.array_min(y).alias("y0"), F.array_max(x).alias("x1"), F.array_max(y).alias("y1"))


def grown(box: Column, by: Column | float) -> Column:
    return F.struct((box.x0 - by).alias("x0"), (box.y0 - by).alias("y0"), (box.x1 + by).alias("x1"), (box.y1 + by).alias("y1"))


def in_bounds(px: Column, py: Column, box: Column) -> Column:
    return px.between(box.x0, box.x1) & py.between(box.y0, box.y1)


def bounds_near(a: Column, b: Column, margin: Column | float) -> Column:
    return (a.x0 <= b.x1 + margin) & (b.x0 <= a.x1 + margin) & (a.y0 <= b.y1 + margin) & (b.y0 <= a.y1 + margin)
