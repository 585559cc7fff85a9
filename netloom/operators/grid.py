"""A regular grid over a territory as tables: cells, cells that obstacles block, and edges between free cells."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import geometry, polyline, pricing
from ..functions.geometry import distance, intersection_at, point_segment
from . import routes, stretches
from .base import cut
from .spatial import boxed, bucket_join, clear, within

STRAIGHT = ((1, 0), (0, 1))
DIAGONAL = ((1, 1), (1, -1))


def extent(points: DataFrame, step: float, margin: float = 120.0) -> DataFrame:
    """(territory, i0, j0, i1, j1): the cells that hold a territory's points (territory, x, y) and a margin."""
    lo = lambda c: F.floor((F.min(c) - margin) / step).cast("long")
    hi = lambda c: F.ceil((F.max(c) + margin) / step).cast("long")
    return points.groupBy("territory").agg(lo("x").alias("i0"), lo("y").alias("j0"), hi("x").alias("i1"), hi("y").alias("j1"))


def cells(extents: DataFrame, step: float) -> DataFrame:
    """(territory, i, j, x, y): rows of cells are made in parallel."""
    rows = extents.select("territory", "i0", "i1", F.explode(F.sequence("j0", "j1")).alias("j"))
    return rows.select("territory", F.explode(F.sequence("i0", "i1")).alias("i"), "j").withColumns({"x": F.col("i") * step, "y": F.col("j") * step})


def blocked(sides: DataFrame, shells: DataFrame, step: float) -> DataFrame:
    """(territory, i, j): cells inside an obstacle or within its clearance.

    ``sides`` (territory, obstacle, gap, cx, cy, dx, dy) gives cells near a side, by the side's own box; ``shells`` (territory,
    obstacle, x0, y0, x1, y1, ring) gives cells inside, by the box's cells and the even-odd test.
    """
    from ..functions.geometry import in_ring

    span = lambda lo, hi: F.explode(F.sequence(F.ceil(lo / step).cast("long"), F.floor(hi / step).cast("long")))
    ok = lambda lo, hi: F.ceil(lo / step) <= F.floor(hi / step)
    x0, x1, y0, y1 = F.least("cx", "dx") - F.col("gap"), F.greatest("cx", "dx") + F.col("gap"), F.least("cy", "dy") - F.col("gap"), F.greatest("cy", "dy") + F.col("gap")
    near = sides.filter(ok(x0, x1) & ok(y0, y1)).withColumn("i", span(x0, x1)).withColumn("j", span(y0, y1))
    near = near.filter(point_segment(F.col("i") * step, F.col("j") * step, F.col("cx"), F.col("cy"), F.col("dx"), F.col("dy")) < F.col("gap"))
    c = {k: F.col(k) for k in ("x0", "y0", "x1", "y1")}
    within = shells.filter(ok(c["x0"], c["x1"]) & ok(c["y0"], c["y1"])).withColumn("i", span(c["x0"], c["x1"])).withColumn("j", span(c["y0"], c["y1"]))
    within = within.filter(in_ring(F.col("i") * step, F.col("j") * step, F.col("ring")))
    return near.select("territory", "i", "j").unionByName(within.select("territory", "i", "j")).distinct()


def free_cells(every: DataFrame, taken: DataFrame) -> DataFrame:
    return every.join(taken, ["territory", "i", "j"], "left_anti")


def edges(free: DataFrame, step: float, cardinal: bool = True, sides: DataFrame | None = None, gap: float = 0.0) -> DataFrame:
    """(territory, i, j, k, l, w): neighbouring free cells. A diagonal needs both cells at its corners, and no edge may come
    nearer to a side than ``gap``."""
    out = None
    for di, dj in STRAIGHT if cardinal else STRAIGHT + DIAGONAL:
        other = free.select("territory", (F.col("i") - di).alias("i"), (F.col("j") - dj).alias("j"), F.col("i").alias("k"), F.col("j").alias("l"))
        met = free.select("territory", "i", "j").join(other, ["territory", "i", "j"]).withColumn("w", F.lit(step * math.hypot(di, dj)))
        if di and dj:
            for ci, cj in ((di, 0), (0, dj)):
                met = met.join(free.select("territory", (F.col("i") - ci).alias("i"), (F.col("j") - cj).alias("j")), ["territory", "i", "j"], "left_semi")
        out = met if out is None else out.unionByName(met)
    if sides is None:
        return out
    lines = out.withColumns({"ax": F.col("i") * step, "ay": F.col("j") * step, "bx": F.col("k") * step, "by": F.col("l") * step})
    return clear(lines, sides, gap, F.lit(gap), ("territory", "i", "j", "k", "l")).select(*out.columns)


def nearest_free(points: DataFrame, free: DataFrame, step: float, most: float = 80.0) -> DataFrame:
    """(point, i, j, d): of the first square ring of cells around a point's cell that has free ones, the nearest."""
    r = math.ceil(most / step)
    at = points.withColumns({"ci": F.bround(F.col("px") / step).cast("long"), "cj": F.bround(F.col("py") / step).cast("long")})
    # both sides are dealt to blocks as wide as the search, so a point meets the cells of at most nine blocks
    block = lambda c: F.floor(F.col(c) / (r + 1))
    around = at.withColumn("bi", F.explode(F.array(*(block("ci") + k for k in (-1, 0, 1))))).withColumn("bj", F.explode(F.array(*(block("cj") + k for k in (-1, 0, 1)))))
    met = around.join(free.withColumns({"bi": block("i"), "bj": block("j")}), ["territory", "bi", "bj"])
    ring = F.greatest(F.abs(F.col("i") - F.col("ci")), F.abs(F.col("j") - F.col("cj")))
    d = distance(F.col("px"), F.col("py"), F.col("i") * step, F.col("j") * step)
    return met.filter(ring <= r).groupBy("point").agg(F.min(F.struct(ring.alias("ring"), d.alias("d"), "i", "j")).alias("m")).select("point", "m.i", "m.j", "m.d")


def split_edges(edge_rows: DataFrame, contacts: DataFrame) -> DataFrame:
    """Edges (edge, a, b, w) cut at contacts (edge, node, at): each contact becomes a node, and an edge a row of edges."""
    from pyspark.sql import Window

    e = edge_rows.select("edge", F.col("a").alias("node"), F.lit(0.0).alias("at")).unionByName(edge_rows.select("edge", F.col("b").alias("node"), F.col("w").alias("at"))).unionByName(contacts.select("edge", "node", "at"))
    w = Window.partitionBy("edge").orderBy("at", "node")
    out = e.withColumns({"b": F.lead("node").over(w), "_to": F.lead("at").over(w)}).filter("b is not null")
    return out.select("edge", F.col("node").alias("a"), "b", (F.col("_to") - F.col("at")).alias("w")).filter("w > 0")


def first_contacts(leads: DataFrame, corridors: DataFrame) -> DataFrame:
    """(lead, edge, station, at, x, y): where each lead first meets a corridor, and at what length of the corridor's edge.

    ``leads`` (lead, leg, ax, ay, bx, by, station of a); ``corridors`` (edge, cx, cy, dx, dy). A lead's own start doesn't count.
    """
    t = intersection_at(*(F.col(c) for c in ("ax", "ay", "bx", "by", "cx", "cy", "dx", "dy")))
    met = bucket_join(boxed(leads, "a", "b", "_s"), boxed(corridors, "c", "d", "_t"), 1e-6, ("_s0", "_s1", "_s2", "_s3"), ("_t0", "_t1", "_t2", "_t3"), t.isNotNull(), cell=20.0)
    met = met.withColumn("_f", t).withColumns({"x": F.col("ax") + F.col("_f") * (F.col("bx") - F.col("ax")), "y": F.col("ay") + F.col("_f") * (F.col("by") - F.col("ay"))})
    met = met.withColumns({"station": F.col("station") + F.col("_f") * distance(F.col("ax"), F.col("ay"), F.col("bx"), F.col("by")), "at": distance(F.col("x"), F.col("y"), F.col("cx"), F.col("cy"))}).filter("station > 1e-6")
    return met.groupBy("lead").agg(F.min(F.struct(F.round("station", 9).alias("station"), F.col("edge"), "at", "x", "y")).alias("m")).select("lead", "m.edge", "m.station", "m.at", "m.x", "m.y")


def _housed(points: DataFrame, obstacles: DataFrame, dn: int) -> DataFrame:
    """(point, obstacle, x, y, need): points inside buildings, with the clearance of these."""
    return routes.owned(points.select("point", "x", "y"), obstacles.withColumn("need", pricing.clearance(F.col("kind"), F.lit(dn))), "need").select("point", "obstacle", "x", "y", "need")


def ports(points: DataFrame, obstacles: DataFrame, dn: int, beyond: float = 0.05) -> DataFrame:
    """(point, obstacle, x, y, d): for points (point, x, y) inside buildings, the places just outside the envelope behind each
    of the closest outer facades, where a lead straight through the facade ends."""
    key = ["point", "obstacle"]
    held = cut(_housed(points, obstacles, dn))
    feet = routes.nearest_feet(held.select(*key, "x", "y"), obstacles, *key).filter("d > 1e-8").join(held, key)
    way = (F.col("need") + beyond) / F.col("d")
    out = feet.select(*key, "d", "need", (F.col("fx") + (F.col("fx") - F.col("x")) * way).alias("x"), (F.col("fy") + (F.col("fy") - F.col("y")) * way).alias("y"))
    return out.select(*key, "x", "y", (F.col("d") + F.col("need") + beyond).alias("d"))


def access(points: DataFrame, free: DataFrame, obstacles: DataFrame, step: float, dn: int) -> DataFrame:
    """(point, i, j, length, path): leads from points (point, x, y) to free cells (i, j, x, y), along the axes with one corner.

    A point in a building leaves it through a port first; no later leg may touch that building, and no leg comes within the
    envelope of another obstacle. Cells within 12.5 m or 2.5 steps of the point or its port count; of a cell's leads the shortest
    stays. Points that are blocked, or have no such cell, have no row.
    """
    out = ports(points, obstacles, dn).withColumnsRenamed({"x": "qx", "y": "qy"})
    start = points.join(out, "point", "left").select("point", "x", "y", "obstacle", F.coalesce("qx", "x").alias("qx"), F.coalesce("qy", "y").alias("qy"))
    start = start.withColumn("start", F.monotonically_increasing_id())
    cell = free.select("i", "j", F.col("x").alias("ex"), F.col("y").alias("ey"))
    near = within(cut(start), cell, max(12.5, 2.5 * step), ("qx", "qy"), ("ex", "ey"))
    p = lambda x, y: F.struct(F.col(x).alias("x"), F.col(y).alias("y"))
    ways = F.array(*(F.array(p("x", "y"), p("qx", "qy"), c, p("ex", "ey")) for c in (p("qx", "ey"), p("ex", "qy"))))
    leads = near.select("point", "obstacle", "i", "j", F.explode(ways).alias("w"))
    leads = leads.withColumn("path", F.filter("w", lambda v, k: (k == 0) | (v != F.get("w", k - 1)))).withColumn("lead", F.xxhash64("point", "i", "j", "path")).drop("w")
    leads = cut(leads.dropDuplicates(["lead"]))
    legs = leads.select("lead", F.col("obstacle").alias("own"), F.posexplode(geometry.legs(F.col("path"))).alias("leg", "s"))
    legs = legs.select("lead", "own", "leg", F.col("s.a.x").alias("ax"), F.col("s.a.y").alias("ay"), F.col("s.b.x").alias("bx"), F.col("s.b.y").alias("by"))
    gap = geometry.segment_segment(*(F.col(c) for c in ("ax", "ay", "bx", "by", "cx", "cy", "dx", "dy")))
    met = bucket_join(boxed(legs, "a", "b", "_s"), boxed(routes.obstacle_sides(obstacles, "kind"), "c", "d", "_t"), routes.WIDEST, ("_s0", "_s1", "_s2", "_s3"), ("_t0", "_t1", "_t2", "_t3"), cell=50.0).withColumn("d", gap)
    own = F.coalesce(F.col("own") == F.col("obstacle"), F.lit(False))
    shut = met.filter(F.when(own, (F.col("leg") > 0) & (F.col("d") <= 0)).otherwise(F.col("d") < pricing.clearance(F.col("kind"), F.lit(dn)))).select("lead").distinct()
    good = leads.join(shut, "lead", "left_anti").withColumn("length", polyline.length(F.col("path")))
    return good.groupBy("point", "i", "j").agg(F.min(F.struct("length", "path")).alias("m")).select("point", "i", "j", "m.length", "m.path")


def moved(points: DataFrame, reachable: DataFrame, obstacles: DataFrame, step: float, dn: int, beyond: float = 0.05) -> DataFrame:
    """(point, x, y, obstacle, displacement): where consumers inside buildings would stand outside: of all places just beyond the
    envelope behind or before a facade, the nearest that leads to a reachable cell (i, j, x, y). The audit of exports
    doesn't know of such moves; they are proposals for the input."""

    sides = routes.obstacle_sides(obstacles)
    held = cut(_housed(points, obstacles, dn).withColumnRenamed("point", "of"))
    met = held.join(sides, "obstacle").filter("cx != dx or cy != dy")
    t = geometry.projection(*(F.col(c) for c in ("x", "y", "cx", "cy", "dx", "dy")))
    ux, uy = F.col("dx") - F.col("cx"), F.col("dy") - F.col("cy")
    met = met.withColumns({"fx": F.col("cx") + t * ux, "fy": F.col("cy") + t * uy, "k": F.explode(F.array(F.lit(1.0), F.lit(-1.0)))})
    off = (F.col("need") + beyond) * F.col("k") / F.hypot(ux, uy)
    places = cut(met.select("of", "obstacle", "need", F.col("x").alias("px"), F.col("y").alias("py"), (F.col("fx") - off * uy).alias("x"), (F.col("fy") + off * ux).alias("y")).distinct())
    # outside of the building and of its envelope
    near = places.join(sides, "obstacle").groupBy("of", "obstacle", "x", "y").agg(F.min(point_segment(*(F.col(c) for c in ("x", "y", "cx", "cy", "dx", "dy")))).alias("d"))
    out = places.join(near, ["of", "obstacle", "x", "y"]).filter("d >= need").join(obstacles.select("obstacle", "area"), "obstacle").filter(~stretches.in_polygons(F.col("x"), F.col("y"), F.col("area")))
    options = out.select("of", "obstacle", "x", "y", distance(F.col("x"), F.col("y"), F.col("px"), F.col("py")).alias("displacement")).withColumn("point", F.xxhash64("of", "x", "y"))
    options = cut(options)
    leads = access(options.select("point", "x", "y"), reachable, obstacles, step, dn).select("point").distinct()
    best = options.join(leads, "point", "left_semi").groupBy("of").agg(F.min(F.struct("displacement", "x", "y", "obstacle")).alias("m"))
    return best.select(F.col("of").alias("point"), "m.x", "m.y", "m.obstacle", "m.displacement")


# ---------------------------------------------------------------- nodes on rays and along crossings

RAYS, RAY_REACH, RAY_OFFSETS, PORT_STEP, PORT_MORE = 24, 30.0, (0.03, 5.0, 20.0), 50.0, 1.0


def free_rays(points: DataFrame, obstacles: DataFrame, gap: Column, rays: int = RAYS, reach: float = RAY_REACH, widest: float = routes.WIDEST) -> DataFrame:
    """(point, ray, ux, uy, lo, hi): free stretches of rays of ``reach`` metres from points (point, x, y) in ``rays`` directions, the
    first to the east: neither in obstacles (obstacle, kind, area) nor nearer to them than ``gap``, which is at most ``widest``. Points
    at one place are asked once."""
    copies = points.select("point", F.struct("x", "y").alias("_at"))
    points = cut(copies.groupBy("_at").agg(F.min("point").alias("point")).select("point", "_at", "_at.x", "_at.y"))
    ray = points.select("point", F.col("x").alias("ax"), F.col("y").alias("ay"), F.explode(F.sequence(F.lit(0), F.lit(rays - 1))).alias("ray"))
    angle = F.col("ray") * (2 * math.pi / rays)
    ray = ray.withColumns({"ux": F.round(F.cos(angle), 15), "uy": F.round(F.sin(angle), 15)})
    ray = ray.withColumns({"bx": F.col("ax") + F.col("ux") * reach, "by": F.col("ay") + F.col("uy") * reach, "len": F.lit(float(reach))})
    ray = cut(ray)
    box = ("_s0", "_s1", "_s2", "_s3"), ("_t0", "_t1", "_t2", "_t3")
    near = bucket_join(boxed(ray, "a", "b", "_s"), boxed(routes.obstacle_sides(obstacles, "kind"), "c", "d", "_t"), max(widest, 1e-6), *box, cell=50.0)
    near = cut(near.select("point", "ray", "obstacle", "kind", *(f"{p}{c}" for p in "abcd" for c in "xy"), "len"))
    t = geometry.intersection_at(*(F.col(f"{p}{c}") for p in "abcd" for c in "xy"))
    hits = near.select("point", "ray", "obstacle", (t * F.col("len")).alias("at")).filter("at is not null")
    bounds = geometry.bounds(F.flatten(F.flatten("area")))
    shapes = obstacles.select("obstacle", bounds.alias("_b")).select("obstacle", *(F.col(f"_b.{c}").alias(n) for c, n in zip(("x0", "y0", "x1", "y1"), box[1], strict=True)))
    pairs = bucket_join(boxed(ray, "a", "b", "_s"), shapes, 1e-6, *box, cell=50.0).select("point", "ray", "obstacle", "ax", "ay", "bx", "by", "len")
    inner = stretches.inside(pairs, hits, obstacles, "point", "ray")
    taken = stretches.near_parts(near, gap).select("point", "ray", "lo", "hi").unionByName(inner.select("point", "ray", "lo", "hi"))
    free = stretches.sweep(ray.select("point", "ray", F.lit(0.0).alias("lo"), F.col("len").alias("hi")), taken, ["point", "ray"])
    free = free.join(ray.select("point", "ray", "ux", "uy"), ["point", "ray"]).join(points.select("point", "_at"), "point").drop("point")
    return copies.join(free, "_at").select("point", "ray", "ux", "uy", "lo", "hi")


def ray_ports(points: DataFrame, obstacles: DataFrame, gap: Column, offsets: tuple[float, ...] = RAY_OFFSETS, **how) -> DataFrame:
    """(point, ray, x, y): places on each free stretch of a point's rays, ``offsets`` metres behind its beginning."""
    free = free_rays(points, obstacles, gap, **how).join(points.select("point", F.col("x").alias("px"), F.col("y").alias("py")), "point")
    at = free.withColumn("at", F.explode(F.array(*map(F.lit, offsets)))).withColumn("at", F.col("lo") + F.col("at")).filter("at <= hi")
    return at.select("point", "ray", (F.col("px") + F.col("ux") * F.col("at")).alias("x"), (F.col("py") + F.col("uy") * F.col("at")).alias("y"))


def crossing_ports(lines: DataFrame, dn: Column, step: float = PORT_STEP, more: float = PORT_MORE) -> DataFrame:
    """(id, side, x, y): places on both sides of lines that may be crossed (id, width, gap, cx, cy, dx, dy), at both ends of each leg
    and at most ``step`` metres apart: beyond the gap and half the widths by ``more`` metres."""
    legs = lines.withColumn("_len", geometry.distance(*(F.col(c) for c in ("cx", "cy", "dx", "dy")))).filter("_len > 1e-9")
    parts = F.greatest(F.lit(1), F.ceil(F.col("_len") / step)).cast("int")
    each = legs.withColumn("_t", F.explode(F.transform(F.sequence(F.lit(0), parts), lambda k: k / parts))).withColumn("side", F.explode(F.array(F.lit(-1), F.lit(1))))
    off = (F.col("gap") + (pricing.envelope_width(dn) + F.coalesce("width", F.lit(0.0))) / 2 + more) * F.col("side") / F.col("_len")
    vx, vy = F.col("dx") - F.col("cx"), F.col("dy") - F.col("cy")
    return each.select("id", "side", (F.col("cx") + F.col("_t") * vx - off * vy).alias("x"), (F.col("cy") + F.col("_t") * vy + off * vx).alias("y")).distinct()
