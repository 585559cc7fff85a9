"""Stretches of lines in and near shapes, as rows of intervals (lo, hi) along the lines, and sets of intervals compared by sweeps.

What of a straight leg lies within r of a side is one interval, since the distance to a segment is convex along the leg; its ends
come from two circles and a strip in closed form (``near_parts``). What lies in an area is found between crossings with its sides,
by the middle of each piece (``inside``).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import geometry as G
from . import linear

#: Directions whose sine is less are parallel.
LEVEL = 1e-15


def near_parts(pairs: DataFrame, r: Column) -> DataFrame:
    """``pairs`` of legs ab and sides cd (ax, ay, …, dx, dy) with the stations (lo, hi) of the leg within ``r`` of the side; pairs
    without any, and legs of no length, are left out."""
    c = {k: F.col(k) for k in ("ax", "ay", "bx", "by", "cx", "cy", "dx", "dy", "_r", "_size", "_side", "_ux", "_uy", "_vx", "_vy", "_s", "_ds", "_q", "_dq", "_tc", "_hc", "_td", "_hd", "_a0", "_a1", "_b0", "_b1", "_lo", "_hi")}
    names = pairs.columns
    out = pairs.withColumns({"_r": r, "_size": G.distance(c["ax"], c["ay"], c["bx"], c["by"]), "_side": G.distance(c["cx"], c["cy"], c["dx"], c["dy"])}).filter("_size > 0 and _side > 0")
    size, side = F.when(c["_size"] > 0, c["_size"]), F.when(c["_side"] > 0, c["_side"])
    out = out.withColumns({"_ux": (c["bx"] - c["ax"]) / size, "_uy": (c["by"] - c["ay"]) / size, "_vx": (c["dx"] - c["cx"]) / side, "_vy": (c["dy"] - c["cy"]) / side})
    # along and across the side, at the leg's start and for each metre of it; and the two circles around the side's ends
    out = out.withColumns({"_s": (c["ax"] - c["cx"]) * c["_vx"] + (c["ay"] - c["cy"]) * c["_vy"], "_ds": c["_ux"] * c["_vx"] + c["_uy"] * c["_vy"], "_q": (c["ax"] - c["cx"]) * c["_vy"] - (c["ay"] - c["cy"]) * c["_vx"], "_dq": c["_ux"] * c["_vy"] - c["_uy"] * c["_vx"]})
    for end in "cd":
        px, py = c[f"{end}x"] - c["ax"], c[f"{end}y"] - c["ay"]
        off = px * c["_uy"] - py * c["_ux"]
        out = out.withColumns({f"_t{end}": px * c["_ux"] + py * c["_uy"], f"_h{end}": F.when(F.abs(off) <= c["_r"], F.sqrt(F.greatest(F.lit(0.0), c["_r"] * c["_r"] - off * off)))})

    def between(value: str, rate: str, low: Column, high: Column) -> tuple[Column, Column]:
        """Where low <= value + t * rate <= high; null where it never is."""
        slant, level = F.abs(rate) > LEVEL, F.col(value).between(low, high)
        safe = F.when(slant, F.col(rate))
        p, q = (low - F.col(value)) / safe, (high - F.col(value)) / safe
        return F.when(slant, F.least(p, q)).when(level, -float("inf")), F.when(slant, F.greatest(p, q)).when(level, float("inf"))

    a, b = between("_s", "_ds", F.lit(0.0), c["_side"]), between("_q", "_dq", -c["_r"], c["_r"])
    out = out.withColumns({"_a0": a[0], "_a1": a[1], "_b0": b[0], "_b1": b[1]})
    met = c["_a0"].isNotNull() & c["_b0"].isNotNull() & (F.greatest("_a0", "_b0") <= F.least("_a1", "_b1"))
    out = out.withColumns({"_lo": F.when(met, F.greatest("_a0", "_b0")), "_hi": F.when(met, F.least("_a1", "_b1"))})
    out = out.withColumns({"lo": F.greatest(F.lit(0.0), F.least(c["_lo"], c["_tc"] - c["_hc"], c["_td"] - c["_hd"])), "hi": F.least(c["_size"], F.greatest(c["_hi"], c["_tc"] + c["_hc"], c["_td"] + c["_hd"]))})
    # a filter of these columns would be pushed below them and repeat all of the above; one of a generator's output stays
    found = F.when(F.coalesce("_lo", "_hc", "_hd").isNotNull() & (F.col("lo") <= F.col("hi")), F.struct("lo", "hi"))
    return out.select(*names, F.explode_outer(F.array(found)).alias("_p")).filter("_p is not null").select(*names, "_p.lo", "_p.hi")


def inside(pairs: DataFrame, hits: DataFrame, areas: DataFrame, *keys: str) -> DataFrame:
    """(keys, obstacle, lo, hi): stations of the legs' parts in areas, neighbouring ones as one.

    ``pairs`` (keys, obstacle, ax, ay, bx, by, len) are the legs and areas whose boxes meet, ``hits`` (keys, obstacle, at) the
    stations where they cross sides; ``areas`` has (obstacle, area), arrays of polygons of rings.
    """
    names = [*keys, "obstacle"]
    cuts = pairs.select(*names, F.explode(F.array(F.lit(0.0), F.col("len"))).alias("at")).unionByName(hits.select(*names, "at")).distinct()
    w = Window.partitionBy(*names).orderBy("at")
    spans = cuts.select(*names, F.col("at").alias("lo"), F.lead("at").over(w).alias("hi")).filter("hi > lo").join(pairs, names).join(areas.select("obstacle", "area"), "obstacle")
    t = (F.col("lo") + F.col("hi")) / 2 / F.col("len")
    x, y = F.col("ax") + t * (F.col("bx") - F.col("ax")), F.col("ay") + t * (F.col("by") - F.col("ay"))
    # lambdas would compute the middle anew for each of their mentions; a generator's output is computed once
    spans = spans.select(*names, "lo", "hi", "area", F.explode_outer(F.array(F.struct(x.alias("x"), y.alias("y")))).alias("_m"))
    return linear.merged(spans.filter(in_polygons(F.col("_m.x"), F.col("_m.y"), F.col("area"))).select(*names, "lo", "hi"), names)


def in_polygons(x: Column, y: Column, area: Column) -> Column:
    return F.exists(area, lambda rings: G.in_area(x, y, F.slice(rings, 1, 1), F.slice(rings, 2, F.size(rings))))


def sweep(left: DataFrame, right: DataFrame, keys: list[str], both: bool = False) -> DataFrame:
    """(keys, lo, hi): what intervals (keys, lo, hi) of ``left`` hold and ``right``'s don't, or with ``both`` what both hold. One pass
    over the ends of a key's intervals, however they overlap."""

    def ends(df: DataFrame, own: int) -> DataFrame:
        end = lambda c, n: F.struct(F.col(c).cast("double").alias("at"), F.lit(n * own).alias("l"), F.lit(n * (1 - own)).alias("r"))
        return df.filter("lo < hi").select(*keys, F.explode(F.array(end("lo", 1), end("hi", -1))).alias("e")).select(*keys, "e.*")

    marks = ends(left, 1).unionByName(ends(right, 0)).groupBy(*keys, "at").agg(F.sum("l").alias("l"), F.sum("r").alias("r"))
    w = Window.partitionBy(*keys).orderBy("at")
    so_far = marks.select(*keys, F.col("at").alias("lo"), F.lead("at").over(w).alias("hi"), F.sum("l").over(w).alias("l"), F.sum("r").over(w).alias("r"))
    held = so_far.filter((F.col("l") > 0) & ((F.col("r") > 0) if both else (F.col("r") == 0)) & F.col("hi").isNotNull())
    return linear.merged(held.select(*keys, "lo", "hi"), keys)


def differing(expected: DataFrame, actual: DataFrame, keys: list[str], tolerance: float) -> DataFrame:
    """(keys, lo, hi, missing): stretches longer than twice the tolerance that only one of two sets of intervals holds. Ends that are
    apart by no more than the tolerance don't differ."""
    wide = lambda df: df.withColumns({"lo": F.col("lo") - tolerance, "hi": F.col("hi") + tolerance})
    gone, new = sweep(expected, wide(actual), keys), sweep(actual, wide(expected), keys)
    return gone.withColumn("missing", F.lit(True)).unionByName(new.withColumn("missing", F.lit(False))).filter(F.col("hi") - F.col("lo") > 2 * tolerance)
