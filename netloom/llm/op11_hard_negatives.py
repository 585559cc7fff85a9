"""Hard-negative mining over k-means inverted lists.

A vector's components become whole numbers (floor of ``scale`` times the component), scores are whole inner products. Rows lie
in the list of their nearest centroid; lists keep the radius, the largest distance of a row from the centroid. By
Cauchy-Schwarz an anchor's score with any row of a list is within |anchor| * radius of its score with the centroid.

An anchor visits lists by falling upper bound, in waves of growing width. Lists whose bounds lie outside what is asked (the
window of scores, for negatives) are skipped, and when the bound falls strictly below the anchor's k-th score so far, it stops;
a list at the k-th score may hold a tie of a lesser key and is visited. So the result is exact, whatever the centroids are.
First the best rows of the anchor's own label are its positives; each positive's score then sets a window for its negatives.

Lists are cut into packed pieces of about ``PIECE_ROWS`` rows, anchors of one list into blocks of about ``BLOCK_ROWS``; a unit
of work is a block and a piece, one product of matrices, so a list with a third of all rows is many units. The centroids are
learned from about ``SAMPLE_ROWS`` rows by a hash of the key; they are at most ``MOST_LISTS``, so that bounds are of fixed size.
Every row is in a list.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import batches_of, columns, dropped, staged

SCALE, POSITIVES, NEGATIVES, LOW, HIGH = 256, 5, 10, 30, 90
SAMPLE_ROWS, MOST_LISTS, LIST_ROWS, PIECE_ROWS, BLOCK_ROWS, ROUNDS = 20_000, 1024, 1024, 1024, 256, 8
#: Lists that an anchor visits in the first waves, at most; then all that are left.
WAVES = (2, 16)
#: Rows of packed matrices are up to some hundred KB: small row groups and Arrow batches keep few of them in memory.
ROW_GROUP, BATCH_ROWS = 8 << 20, 8
#: Scores lie within 2**53, so that products of doubles are exact; this is below all.
NONE = -(1 << 60)


def whole(vectors: DataFrame, key: str, vector: str, label: str, scale: int = SCALE) -> DataFrame:
    """(key, label, q) of rows that take part: whole keys and labels, q the whole components.

    Rows with a null key, label or vector, a null or non-finite component, or whole components whose squares add up to more
    than 2**53 (their scores can't be told in doubles) take no part. Of rows with one key the least (label, q) does. Vectors
    of several lengths are compared as if zeros followed the shorter ones.
    """
    q = F.transform("v", lambda x: F.floor(x.cast("double") * scale))
    rows = columns(vectors, key, vector, label).toDF("key", "v", "label").filter("key is not null and v is not null and label is not null")
    rows = rows.filter(F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) <= 2.0**27 / scale)))
    rows = rows.select(F.col("key").cast("long").alias("key"), F.col("label").cast("long").alias("label"), F.transform(q, lambda x: x.cast("int")).alias("q"))
    rows = rows.filter(F.aggregate("q", F.lit(0.0), lambda s, x: s + x.cast("double") * x) <= 2.0**53)
    return rows.groupBy("key").agg(F.min(F.struct("label", "q")).alias("r")).select("key", "r.label", "r.q")


def centroids(rows: DataFrame, n: int, sample_rows: int = SAMPLE_ROWS, list_rows: int = LIST_ROWS, most_lists: int = MOST_LISTS, rounds: int = ROUNDS) -> np.ndarray:
    """k-means of a sample of about ``sample_rows`` rows."""
    share = min(1.0, sample_rows / max(1, n))
    sample = rows.filter(F.pmod(F.xxhash64(F.lit("sample"), "key"), F.lit(1_000_000)) < share * 1_000_000).select(F.xxhash64("key").alias("h"), "key", "q").collect()
    if not sample:
        return np.zeros((1, 1))
    sample = [r.q for r in sorted(sample, key=lambda r: (r.h, r.key))]
    x = np.zeros((len(sample), max(1, *map(len, sample), 1)))
    for i, q in enumerate(sample):
        x[i, : len(q)] = q
    k = max(1, min(most_lists, -(-n // list_rows), len(x)))
    c = x[np.arange(k) * len(x) // k]
    for _ in range(rounds):
        own = ((c * c).sum(1) - 2 * x @ c.T).argmin(1)
        size = np.bincount(own, minlength=k)
        new = np.zeros_like(c)
        np.add.at(new, own, x)
        c = np.where(size[:, None] > 0, new / np.maximum(size, 1)[:, None], c)
    return c


def _fit(x: np.ndarray, width: int) -> np.ndarray:
    """Columns cut to, or filled with zeros up to, the width."""
    return x[:, :width] if x.shape[1] >= width else np.pad(x, ((0, 0), (0, width - x.shape[1])))


def lists(rows: DataFrame, c: np.ndarray) -> DataFrame:
    """(key, label, q, list, d): each row's nearest centroid and its distance from it."""
    sent = rows.sparkSession.sparkContext.broadcast(c)

    def run(batches):
        c = sent.value
        for batch in batches:
            column = batch.column("q")
            sizes = np.asarray(pa.compute.list_value_length(column), dtype=np.int64)
            width = max(1, int(sizes.max(initial=0)))
            x = np.zeros((len(sizes), width))
            x[np.arange(width) < sizes[:, None]] = np.asarray(column.flatten())
            cw = _fit(c, width)
            own = ((c * c).sum(1) - 2 * x @ cw.T).argmin(1)
            over = (c * c).sum(1) - (cw * cw).sum(1)  # of centroids' components that the row lacks
            d = np.sqrt(((x - cw[own]) ** 2).sum(1) + np.maximum(0, over[own]))
            yield pa.RecordBatch.from_arrays([batch.column("key"), batch.column("label"), column, pa.array(own.astype(np.int32)), pa.array(d)], names=["key", "label", "q", "list", "d"])

    return rows.mapInArrow(run, "key long, label long, q array<int>, list int, d double")


def _packed(rows: DataFrame, per: int) -> DataFrame:
    """(list, piece, keys, labels, width, q) with arrays as bytes, keys rising: the rows of each list in pieces of about ``per``."""
    sizes = rows.groupBy("list").agg(F.ceil(F.count(F.lit(1)) / per).cast("long").alias("pieces"))  # a row a list
    dealt = rows.join(F.broadcast(sizes), "list").withColumn("piece", F.pmod(F.xxhash64(F.lit("piece"), "key"), F.col("pieces")).cast("int"))

    def pack(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("key")
        width = max(1, int(pdf.q.map(len).max()))
        q = np.zeros((len(pdf), width), np.int32)
        for i, x in enumerate(pdf.q):
            q[i, : len(x)] = x
        return pd.DataFrame({"list": [pdf.list.iloc[0]], "piece": [pdf.piece.iloc[0]], "keys": [pdf.key.to_numpy(np.int64).tobytes()], "labels": [pdf.label.to_numpy(np.int64).tobytes()], "width": [width], "q": [q.tobytes()]})

    return dealt.select("list", "piece", "key", "label", "q").groupBy("list", "piece").applyInPandas(pack, "list int, piece int, keys binary, labels binary, width int, q binary")


def _matrix(r: dict, q: str = "q", width: str = "width") -> np.ndarray:
    return np.frombuffer(r[q], np.int32).reshape(-1, r[width]).astype(np.float64)


def _asked(r: dict, windows: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """A block's keys, and of each anchor and window the least and the largest score asked for, and the k-th so far."""
    keys = np.frombuffer(r["keys"], np.int64)
    low, high = (np.frombuffer(r[n], np.int64).reshape(-1, windows) for n in ("low", "high"))
    kth = np.full(low.shape, NONE)
    for x in r["kth"] or ():
        kth[np.searchsorted(keys, x["anchor"]), x["w"]] = x["score"]
    return keys, low, high, kth


def _search(blocks: DataFrame, pieces: DataFrame, c: np.ndarray, radius: np.ndarray, counts: DataFrame, windows: int, k: int, same: bool) -> DataFrame:
    """(block, anchor, w, rank, key, score): the ``k`` best rows of each anchor's window, of its own label (``same``) or of others."""
    spark = blocks.sparkSession
    sent = spark.sparkContext.broadcast((c, radius))

    def choosing(width: int | None):
        def run(batches):
            c, radius = sent.value
            for batch in batches:
                out = []
                for r in batch.to_pylist():
                    _, low, high, kth = _asked(r, windows)
                    a = _matrix(r)
                    wide = max(a.shape[1], c.shape[1])
                    at = _fit(a, wide) @ _fit(c, wide).T
                    slack = np.sqrt((a * a).sum(1))[:, None] * radius
                    err = 1e-6 + 1e-9 * (np.abs(at) + slack)
                    seen = np.zeros(len(c), bool) if r["seen"] is None else np.frombuffer(r["seen"], np.uint8).astype(bool)
                    want = np.zeros(len(c), bool)
                    for w in range(windows):
                        top = at + slack + err
                        ok = (top >= np.maximum(low, kth)[:, w, None]) & (at - slack - err <= high[:, w, None]) & (low <= high)[:, w, None] & ~seen
                        if width is None or width >= len(c):
                            want |= ok.any(0)
                        else:
                            order = np.where(ok, top, -np.inf)
                            cutoff = np.partition(order, len(c) - width, axis=1)[:, len(c) - width]
                            want |= (ok & (order >= cutoff[:, None])).any(0)
                    out.append({"block": r["block"], "lists": np.flatnonzero(want).astype(np.int32), "seen": (seen | want).astype(np.uint8).tobytes()})
                yield pa.RecordBatch.from_pylist(out, schema=pa.schema([("block", pa.int64()), ("lists", pa.list_(pa.int32())), ("seen", pa.binary())]))

        return run

    def scan(batches):
        for batch in batches:
            out = [(np.zeros(0, np.int64),) * 5]
            for r in batch.to_pylist():
                anchors, low, high, kth = _asked(r, windows)
                own = np.frombuffer(r["labels"], np.int64)
                keys, labels = (np.frombuffer(r[n], np.int64) for n in ("p_keys", "p_labels"))
                a, b = _matrix(r), _matrix(r, "p_q", "p_width")
                wide = min(a.shape[1], b.shape[1])
                s = (a[:, :wide] @ b[:, :wide].T).astype(np.int64)
                fits = (own[:, None] == labels) & (anchors[:, None] != keys) if same else own[:, None] != labels
                for w in range(windows):
                    ok = fits & (s >= np.maximum(low, kth)[:, w, None]) & (s <= high[:, w, None])
                    if not ok.any():
                        continue
                    t = np.where(ok, s, NONE)
                    if t.shape[1] > k:
                        ok &= t >= np.partition(t, t.shape[1] - k, axis=1)[:, t.shape[1] - k, None]
                    i, j = np.nonzero(ok)
                    order = np.lexsort((keys[j], -s[i, j], i))
                    i, j = i[order], j[order]
                    best = np.arange(len(i)) - np.searchsorted(i, i) < k
                    i, j = i[best], j[best]
                    out.append((np.full(len(i), r["block"]), anchors[i], np.full(len(i), w), keys[j], s[i, j]))
            block, anchor, w, key, score = (np.concatenate(x) for x in zip(*out, strict=True))
            yield pa.RecordBatch.from_arrays([pa.array(block), pa.array(anchor), pa.array(w.astype(np.int32)), pa.array(key), pa.array(score)], names=["block", "anchor", "w", "key", "score"])

    chosen, tops = None, None
    best = Window.partitionBy("block", "anchor", "w").orderBy(F.desc("score"), "key")
    of_piece = pieces.select("list", "piece", F.col("keys").alias("p_keys"), F.col("labels").alias("p_labels"), F.col("width").alias("p_width"), F.col("q").alias("p_q"))
    for width in (*WAVES, None):
        if tops is None:
            live = blocks.withColumn("kth", F.lit(None).cast("array<struct<anchor:bigint,w:int,score:bigint>>")).withColumn("seen", F.lit(None).cast("binary"))
        else:
            kth = tops.filter(F.col("rank") == k).groupBy("block").agg(F.collect_list(F.struct("anchor", "w", "score")).alias("kth"))  # a struct an anchor of the block and window
            live = blocks.join(kth, "block", "left").join(chosen.select("block", "seen"), "block", "left")
        with batches_of(spark, BATCH_ROWS):
            before, chosen = chosen, staged(live.select("block", "keys", "width", "q", "low", "high", "kth", "seen").mapInArrow(choosing(width), "block long, lists array<int>, seen binary"), "negatives-chosen")
            units = chosen.select("block", F.explode("lists").alias("list")).join(F.broadcast(counts), "list").select("block", "list", F.explode(F.sequence(F.lit(0), F.col("pieces") - 1)).alias("piece"))
            units = units.join(live.drop("seen"), "block").join(of_piece, ["list", "piece"])
            found = units.drop("list", "piece").mapInArrow(scan, "block long, anchor long, w int, key long, score long")
            old, found = tops, found if tops is None else found.unionByName(tops.drop("rank"))
            tops = staged(found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k), "negatives-tops")
        for done in (before, old):
            if done is not None:
                dropped(spark, done)
    dropped(spark, chosen)
    return tops


def mine(vectors: DataFrame, is_anchor: Column, key: str = "vec_id", vector: str = "embedding", label: str = "label", positives: int = POSITIVES, negatives: int = NEGATIVES, low: int = LOW, high: int = HIGH, scale: int = SCALE) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score): for each anchor (``is_anchor``, a condition
    on the key column) and each of its first ``positives`` other rows of its label, the first ``negatives`` rows of other labels
    whose scores lie within ``low`` to ``high`` hundredths of the positive's. Higher scores first, ties by the smaller key.

    Which rows take part is told by ``whole``. Anchors without positives or without rows in a window have no rows there.
    """
    spark = vectors.sparkSession
    rows = staged(whole(vectors, key, vector, label, scale), "negatives-rows")
    n = rows.count()
    c = centroids(rows, n)
    dealt = staged(lists(rows, c), "negatives-lists")
    far = {r.list: r.d for r in dealt.groupBy("list").agg(F.max("d").alias("d")).collect()}  # a row a list
    radius = np.array([far.get(i, 0.0) for i in range(len(c))])
    packed = staged(_packed(dealt, PIECE_ROWS), "negatives-pieces", **{"parquet.block.size": ROW_GROUP})
    counts = packed.groupBy("list").agg((F.max("piece") + 1).alias("pieces"))
    asking = dealt.withColumnRenamed("key", key).filter(is_anchor).withColumnRenamed(key, "key")
    block = F.xxhash64("list", "piece").alias("block")
    blocks = staged(_packed(asking, BLOCK_ROWS).select(block, "keys", "labels", "width", "q"), "negatives-anchors", **{"parquet.block.size": ROW_GROUP})

    def windowed(schema: str, windows: int, of):
        """Blocks with the least and largest score that each anchor asks for in each window."""

        def run(batches):
            for batch in batches:
                bounds = [of(r) for r in batch.to_pylist()]
                kept = batch.select(["block", "keys", "labels", "width", "q"])
                yield pa.RecordBatch.from_arrays([*kept.columns, *(pa.array([b[i].astype(np.int64).tobytes() for b in bounds], pa.binary()) for i in (0, 1))], names=[*kept.schema.names, "low", "high"])

        return run

    def all_scores(r):
        size = len(r["keys"]) // 8
        return np.full(size, NONE + 1), np.full(size, -NONE)

    def by_positive(r):
        keys = np.frombuffer(r["keys"], np.int64)
        lo, hi = np.ones((len(keys), positives), np.int64), np.zeros((len(keys), positives), np.int64)
        for x in r["found"] or ():
            i = np.searchsorted(keys, x["anchor"])
            lo[i, x["rank"] - 1], hi[i, x["rank"] - 1] = -(-low * x["score"] // 100), high * x["score"] // 100
        return lo, hi

    ddl = "block long, keys binary, labels binary, width int, q binary, low binary, high binary"
    with batches_of(spark, BATCH_ROWS):
        first = staged(blocks.mapInArrow(windowed(ddl, 1, all_scores), ddl), "negatives-asked", **{"parquet.block.size": ROW_GROUP})
    near = _search(first, packed, c, radius, counts, 1, positives, True)
    found = near.groupBy("block").agg(F.collect_list(F.struct("anchor", "rank", "score")).alias("found"))  # at most ``positives`` an anchor
    with batches_of(spark, BATCH_ROWS):
        second = staged(blocks.join(found, "block", "left").mapInArrow(windowed(ddl, positives, by_positive), ddl), "negatives-asked", **{"parquet.block.size": ROW_GROUP})
    away = _search(second, packed, c, radius, counts, positives, negatives, False)
    out = away.join(near.select("block", "anchor", (F.col("rank") - 1).alias("w"), F.col("key").alias("positive_id"), F.col("score").alias("positive_score")), ["block", "anchor", "w"])
    for done in (rows, dealt, packed, blocks, first, second):
        dropped(spark, done)
    return out.select(F.col("anchor").alias("anchor_id"), "positive_id", "rank", F.col("key").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    label = F.when(F.pmod("vec_id", F.lit(7)) == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return mine(rows.withColumn("label", label), F.pmod("vec_id", F.lit(100)) == 0)


SQL = """
WITH rows AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS q FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
pairs AS (SELECT a.vec_id AS anchor_id, b.vec_id AS vec_id, a.label = b.label AS same, list_inner_product(a.q, b.q)::BIGINT AS score FROM rows a JOIN rows b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id),
positives AS (SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM pairs WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5),
ranked AS (SELECT anchor_id, positive_id, row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, vec_id)::INT AS rank, vec_id AS negative_id, positive_score, score AS negative_score
  FROM positives JOIN pairs USING (anchor_id) WHERE NOT same AND 30 * positive_score <= 100 * score AND 100 * score <= 90 * positive_score)
SELECT * FROM ranked WHERE rank <= 10"""
