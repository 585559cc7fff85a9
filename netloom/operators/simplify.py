"""Fewer vertices for many lines at once.

``simplified`` is Douglas and Peucker's method as rounds over stretches: every vertex that isn't decided knows the ends of its
stretch; each round the farthest one of every stretch stays and splits it, or all of the stretch go. ``smoothed`` takes the
shortest way over chords that are clear, so a line never gets longer and keeps its ends.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.geometry import distance, point_segment
from . import paths, spatial
from .base import cut


def _numbered(vertices: DataFrame, line: str, order: str) -> DataFrame:
    w = Window.partitionBy(line).orderBy(order)
    every = Window.partitionBy(line)
    return vertices.select(F.col(line).alias("line"), (F.row_number().over(w) - 1).alias("n"), (F.count(F.lit(1)).over(every) - 1).cast("int").alias("last"), F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y"))


def simplified(vertices: DataFrame, tolerance: float, line: str = "line", order: str = "pos") -> DataFrame:
    """(line, n, x, y): the vertices that stay of lines (line, order, x, y), with their numbers, from 0, in the whole line.

    Ends stay; of a stretch the farthest vertex, of equal ones the last, if it is off by more than ``tolerance``. Lines of fewer
    than three vertices stay as they are.
    """
    every = cut(_numbered(vertices, line, order))
    end = lambda c, n: every.filter(F.col("n") == n).select("line", F.col("n").alias(c), F.col("x").alias(f"{c}x"), F.col("y").alias(f"{c}y"))
    kept = [every.filter("n = 0 or n = last").select("line", "n", "x", "y")]
    inner = every.filter("n > 0 and n < last").select("line", "n", "x", "y")
    now = cut(inner.join(end("i", F.lit(0)), "line").join(end("j", F.col("last")), "line"))
    while not now.isEmpty():
        off = point_segment(*(F.col(c) for c in ("x", "y", "ix", "iy", "jx", "jy")))
        far = now.groupBy("line", "i", "j").agg(F.max(F.struct(off.alias("d"), "n", "x", "y")).alias("m")).filter(F.col("m.d") > tolerance)
        far = cut(far.select("line", "i", "j", F.col("m.n").alias("k"), F.col("m.x").alias("kx"), F.col("m.y").alias("ky")))
        kept.append(far.select("line", F.col("k").alias("n"), F.col("kx").alias("x"), F.col("ky").alias("y")))
        before = F.col("n") < F.col("k")
        side = lambda c, k, old: F.when(k, F.col(c)).otherwise(F.col(old)).alias(old)
        now = cut(now.join(far, ["line", "i", "j"]).filter("n != k").select("line", "n", "x", "y", *(side(f"k{c}", ~before, f"i{c}") for c in ("", "x", "y")), *(side(f"k{c}", before, f"j{c}") for c in ("", "x", "y"))), now)
    out = kept[0]
    for k in kept[1:]:
        out = out.unionByName(k)
    return out


def smoothed(vertices: DataFrame, sides: DataFrame, reach: float, gap: Column, ahead: int = 32, line: str = "line", order: str = "pos") -> DataFrame:
    """(line, n, x, y): the vertices of each line that the shortest way over its legs and clear chords keeps.

    A chord joins vertices of one line that are up to ``ahead`` apart; it is clear if it is no nearer to a side (cx, cy, dx, dy, …)
    than ``gap``, which is at most ``reach``. Legs of the line itself stay allowed, clear or not.
    """
    every = cut(_numbered(vertices, line, order))
    to = every.select("line", F.col("n").alias("m"), F.col("x").alias("bx"), F.col("y").alias("by"))
    legs = every.select("line", F.col("n"), F.col("x").alias("ax"), F.col("y").alias("ay"), F.explode(F.sequence(F.lit(1), F.lit(ahead))).alias("k")).withColumn("m", F.col("n") + F.col("k")).join(to, ["line", "m"])
    legs = cut(legs.withColumn("w", distance(*(F.col(c) for c in ("ax", "ay", "bx", "by")))))
    chords = spatial.clear(legs.filter("k > 1"), sides, reach, gap, ("line", "n", "m"))
    ways = legs.filter("k = 1").select("line", "n", "m", "w").unionByName(chords.select("line", "n", "m", "w"))
    ends = every.filter("n = 0")
    found = paths.shortest(ways.select(F.col("line").alias("plan"), F.col("n").cast("long").alias("a"), F.col("m").cast("long").alias("b"), "w"), ends.select(F.col("line").alias("plan"), F.lit(0).cast("long").alias("node"), F.lit(0.0).alias("cost")), directed=True)
    way = paths.routes(found, ends.select(F.col("line").alias("plan"), F.col("last").cast("long").alias("node")))
    return way.select(F.col("plan").alias("line"), F.col("node").cast("int").alias("n")).join(every.select("line", "n", "x", "y"), ["line", "n"])
