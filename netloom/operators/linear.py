"""Lines as rows of vertices, and intervals along lines."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.constants import BEND_PRICED
from ..functions.geometry import distance, intersection_at
from ..functions.polyline import turn


def legs(vertices: DataFrame, line: str, order: str, x: str = "x", y: str = "y") -> DataFrame:
    """(line, leg, ax, ay, bx, by, len): consecutive vertices of each line; one shuffle by line."""
    w = Window.partitionBy(line).orderBy(order)
    out = vertices.select(line, F.row_number().over(w).alias("leg"), F.col(x).alias("ax"), F.col(y).alias("ay"), F.lead(x).over(w).alias("bx"), F.lead(y).over(w).alias("by"))
    out = out.filter("bx is not null")
    return out.withColumn("len", distance(F.col("ax"), F.col("ay"), F.col("bx"), F.col("by")))


def lengths(vertices: DataFrame, line: str, order: str) -> DataFrame:
    return legs(vertices, line, order).groupBy(line).agg(F.sum("len").alias("length"))


def stations(vertices: DataFrame, line: str, order: str) -> DataFrame:
    """Every vertex with its distance along the line."""
    w = Window.partitionBy(line).orderBy(order)
    step = F.coalesce(distance(F.col("x"), F.col("y"), F.lag("x").over(w), F.lag("y").over(w)), F.lit(0.0))
    return vertices.withColumn("_step", step).withColumn("station", F.sum("_step").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("_step")


def corners(vertices: DataFrame, line: str, order: str) -> DataFrame:
    """Every inner vertex with its turn in degrees and the legs on both sides."""
    w = Window.partitionBy(line).orderBy(order)
    n = {f"{c}{k}": f(c).over(w) for c in ("x", "y") for k, f in (("p", F.lag), ("n", F.lead))}
    out = vertices.withColumns(n).filter("xp is not null and xn is not null")
    c = {k: F.col(k) for k in ("x", "y", *n)}
    return out.withColumns({"turn": turn(c["xp"], c["yp"], c["x"], c["y"], c["xn"], c["yn"]), "before": distance(c["xp"], c["yp"], c["x"], c["y"]), "after": distance(c["x"], c["y"], c["xn"], c["yn"])}).drop(*n)


def bend_counts(vertices: DataFrame, line: str, order: str, micro_leg: float, least: float = BEND_PRICED) -> DataFrame:
    bend = F.col("turn") >= least
    short = (F.col("before") <= micro_leg) | (F.col("after") <= micro_leg)
    return corners(vertices, line, order).groupBy(line).agg(F.count_if(bend).alias("bends"), F.count_if(bend & short).alias("micro_bends"))


def sharp_turns(vertices: DataFrame, line: str, order: str, tolerance: float = 1e-7) -> DataFrame:
    """Vertices where a line turns by more than a right angle."""
    w = Window.partitionBy(line).orderBy(order)
    ux, uy, vx, vy = (F.col("x") - F.lag("x").over(w), F.col("y") - F.lag("y").over(w), F.lead("x").over(w) - F.col("x"), F.lead("y").over(w) - F.col("y"))
    out = vertices.withColumns({"_u": ux, "_v": uy, "_p": vx, "_q": vy})
    norm = F.sqrt(F.expr("_u*_u+_v*_v")) * F.sqrt(F.expr("_p*_p+_q*_q"))
    return out.filter((norm > 1e-12) & (F.expr("_u*_p+_v*_q") / F.when(norm > 1e-12, norm) < -tolerance)).drop("_u", "_v", "_p", "_q")


def merged(intervals: DataFrame, keys: list[str], lo: str = "lo", hi: str = "hi", tolerance: float = 0.0) -> DataFrame:
    """Unions of overlapping intervals of each key (gaps and islands).

    One sort, and no table of islands in memory, which are nearly as many as the intervals: the greatest end of an island is that
    of the greatest (island, end) so far, and the row before the next island's first has it.
    """
    w = Window.partitionBy(*keys).orderBy(lo, hi)
    so_far = w.rowsBetween(Window.unboundedPreceding, 0)
    before = F.max(hi).over(w.rowsBetween(Window.unboundedPreceding, -1))
    new = F.when(before.isNull() | (F.col(lo) > before + tolerance), 1).otherwise(0)
    out = intervals.select(*keys, lo, hi).withColumn("_new", new).withColumn("_island", F.sum("_new").over(so_far))
    least = F.min(F.when(F.col(lo).isNotNull(), F.struct((-F.col("_island")).alias("i"), F.col(lo).alias("v")))).over(so_far)
    most = F.max(F.struct(F.col("_island").alias("i"), F.col(hi).alias("v"))).over(so_far)
    out = out.withColumns({"_least": least, "_most": most, "_then": F.lead("_new").over(w)})
    return out.filter("_then is null or _then = 1").select(*keys, F.col("_least.v").alias(lo), F.col("_most.v").alias(hi))


def pieces(lines: DataFrame, windows: DataFrame, key: str, length: str = "length", shortest: float = 1e-7) -> DataFrame:
    """(key, lo, hi, factor, ids): lines cut at each window's ends; the factor is the largest of the active windows.

    ``windows`` has (key, lo, hi, factor, id); parts outside the line are cut off. Lines and windows are dealt and sorted by the key in one
    shuffle. The cuts of the lines of a batch are numbered at once, and a window opens into the pieces between the numbers of its ends.
    So there are as many rows as pieces and active windows together, never all pairs of a line, and a task holds a batch and one line.
    """
    kind, id_kind = windows.schema[key].dataType, windows.schema["id"].dataType
    none = lambda *names: [F.lit(None).cast(id_kind if c == "id" else "double").alias(c) for c in names]
    # a line is a window of its own, without an id
    own = lines.select(F.col(key).cast(kind).alias("key"), F.lit(True).alias("line"), F.lit(0.0).alias("lo"), F.col(length).cast("double").alias("hi"), *none("factor", "id"))
    given = windows.filter(F.col(key).isNotNull()).select(F.col(key).alias("key"), F.lit(False).alias("line"), *(F.col(c).cast("double").alias(c) for c in ("lo", "hi", "factor")), "id")
    rows = own.unionByName(given).repartition("key").sortWithinPartitions("key")
    return rows.mapInArrow(_cut_up(shortest), f"key {kind.simpleString()}, lo double, hi double, factor double, ids array<{id_kind.simpleString()}>").withColumnRenamed("key", key)


def _cut_up(shortest: float):
    """A function that cuts batches of rows (key, line, lo, hi, factor, id), sorted by key, into pieces."""

    def numbers(keys: pa.Array) -> np.ndarray:
        """Numbers of the keys, as they follow one another."""
        keys = keys.combine_chunks() if isinstance(keys, pa.ChunkedArray) else keys
        if pa.types.is_struct(keys.type):
            changes = [np.diff(numbers(f), prepend=0) != 0 for f in keys.flatten()]
            return np.cumsum(np.logical_or.reduce(changes))
        return keys.dictionary_encode(null_encoding="encode").indices.to_numpy(zero_copy_only=False)

    def cut_up(t: pa.Table) -> pa.RecordBatch:
        g, line = numbers(t.column("key")), t.column("line").to_numpy()
        lo, hi, factor = (pa.compute.fill_null(t.column(c), np.nan).to_numpy() for c in ("lo", "hi", "factor"))
        n = int(g[-1]) + 1
        at, length, known, most = np.full(n, -1), np.full(n, np.nan), np.zeros(n, bool), np.full(n, np.nan)
        at[g[line]], length[g[line]], known[g[line]] = np.flatnonzero(line), hi[line], True
        np.fmax.at(most, g, hi)
        end = np.where(np.isnan(length), most, length)[g]
        lo, hi = np.where(line, np.minimum(0.0, end), np.fmax(lo, 0.0)) + 0.0, np.where(line, np.maximum(0.0, end), np.fmin(hi, length[g])) + 0.0
        held = np.flatnonzero((lo < hi) & known[g])
        g, lo, hi, factor = g[held], lo[held], hi[held], factor[held]
        of, cut = np.concatenate([g, g]), np.concatenate([lo, hi])
        order = np.lexsort((cut, of))
        new = np.ones(len(order), bool)
        new[1:] = (np.diff(of[order]) != 0) | (np.diff(cut[order]) != 0)
        number = np.empty(len(order), np.int64)
        number[order] = np.cumsum(new) - 1
        of, cut = of[order][new], cut[order][new]
        first, size = number[: len(g)], number[len(g) :] - number[: len(g)]
        row = np.repeat(np.arange(len(g)), size)
        piece = np.arange(len(row)) - np.repeat(np.cumsum(size) - size, size) + first[row]
        top = np.full(len(cut), -np.inf)
        priced = ~np.isnan(factor[row])
        np.maximum.at(top, piece[priced], factor[row][priced])
        ids = t.column("id").combine_chunks().take(pa.array(held)).dictionary_encode()
        code = pa.compute.fill_null(ids.indices, -1).to_numpy(zero_copy_only=False)
        in_order = pa.compute.array_sort_indices(ids.dictionary)
        rank = np.empty(len(in_order) + 1, np.int64)
        rank[-1], rank[in_order.to_numpy()] = -1, np.arange(len(in_order))
        code = rank[code][row]
        many = max(1, len(in_order))
        met = np.unique(piece[code >= 0] * many + code[code >= 0])
        kept = np.flatnonzero((of[1:] == of[:-1]) & (np.diff(cut) >= shortest))
        stays = np.zeros(len(cut), bool)
        stays[kept] = True
        met = met[stays[met // many]]
        offsets = np.concatenate([[0], np.cumsum(np.bincount(met // many, minlength=len(cut))[kept])])
        lists = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), ids.dictionary.take(in_order.take(pa.array(met % many))))
        keys = t.column("key").combine_chunks().take(pa.array(at[of[kept]]))
        return pa.RecordBatch.from_arrays([keys, pa.array(cut[kept]), pa.array(cut[kept + 1]), pa.array(np.where(np.isinf(top[kept]), 1.0, top[kept])), lists], names=["key", "lo", "hi", "factor", "ids"])

    def run(batches):
        rest: list[pa.RecordBatch] = []  # rows of the keys that may go on in the next batch
        for batch in batches:
            if not batch.num_rows:
                continue
            g = numbers(batch.column("key"))
            begin = int(np.searchsorted(g, g[-1]))  # where the last key begins
            same = rest and rest[-1].column("key")[-1:].equals(batch.column("key")[-1:])
            if begin or not same:
                if begin:
                    rest.append(batch.slice(0, begin))
                if rest:
                    yield cut_up(pa.Table.from_batches(rest))
                rest = []
            rest.append(batch.slice(begin))
        if rest:
            yield cut_up(pa.Table.from_batches(rest))

    return run


def line_hits(legs_with_station: DataFrame, objects: DataFrame, key: str) -> DataFrame:
    """(key, id, kind, factor, at): stations where legs (…, station of a, len) cross object legs (id, kind, factor, cx, cy, dx, dy)."""
    from .spatial import boxed, bucket_join

    t = intersection_at(*(F.col(c) for c in ("ax", "ay", "bx", "by", "cx", "cy", "dx", "dy")))
    met = bucket_join(boxed(legs_with_station, "a", "b", "_s"), boxed(objects, "c", "d", "_t"), 0.0, ("_s0", "_s1", "_s2", "_s3"), ("_t0", "_t1", "_t2", "_t3"), t.isNotNull(), cell=20.0)
    return met.select(key, "id", "kind", "factor", F.round(F.col("station") + t * F.col("len"), 7).alias("at")).distinct()


def crossing_windows(hits: DataFrame, lines: DataFrame, key: str, length: str = "length") -> tuple[DataFrame, DataFrame]:
    """Windows of hits, 3 m each side for roads and tram tracks, 2 m else; and violations: windows that don't fit the line."""
    margin = F.when(F.col("kind").isin("road", "tram_tracks"), 3.0).otherwise(2.0)
    out = hits.join(lines.select(key, length), key).withColumns({"lo": F.col("at") - margin, "hi": F.col("at") + margin})
    fits = (F.col("lo") >= -1e-6) & (F.col("hi") <= F.col(length) + 1e-6)
    return out.filter(fits).select(key, "lo", "hi", "factor", "id", "kind"), out.filter(~fits).select(key, "id", F.lit("crossing plateau cannot fit before a route endpoint").alias("rule"))
