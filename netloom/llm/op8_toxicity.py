"""Toxicity by a linear classifier over character n-grams scaled by naive Bayes log-count ratios.

A text is the set of its hashed n-grams. With p and q the smoothed numbers of toxic and other sampled texts that hold an
n-gram, its value is r = ln((p / |toxic|) / (q / |other|)); a logistic regression over these values gives the score.

Learned from a bounded sample of labelled rows: ``per_class`` rows of each class by a hash of the key, whole texts, weighted
back to the labels' own shares; then the rarer class is lifted by the ``lift``-th power of the shares' ratio. Counting runs
on the executors. The driver gets the ``features`` n-grams whose numbers differ most from chance (the z score of the toxic texts
that hold them; ratios under ``least_ratio`` tell nothing) and the sampled texts as lists of these: at most 2 * per_class *
features numbers of four bytes, 240 MB. Number of n-grams, their choice, lift and l2 were set on folds of the learned rows only.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import char_grams, columns, fold, letter_codes, mixed, modest_batches, over_text, slices

PER_CLASS = 3000
SIZES = (3, 4, 5, 6)
LOG2_BUCKETS = 21
FEATURES = 10_000
#: Power of the classes' ratio by which the rarer one is lifted, and the weight of the squared coefficients.
LIFT, L2 = 0.5, 1e-4


@dataclass
class Model:
    weights: np.ndarray  # of each hash bucket, 0 for most
    bias: float


def _buckets(texts: list[str]):
    """(owner, bucket) of all n-grams, with repetitions, size by size."""
    codes, owner = letter_codes(texts)
    for _, h, ok in char_grams(codes, SIZES):
        yield owner[: len(ok)][ok], (mixed(h[ok]) >> np.uint64(64 - LOG2_BUCKETS)).astype(np.int64)


def _distinct(texts: list[str], table: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (owner, bucket) pairs; with a table, only of buckets that it marks."""
    keys = []
    for own, b in _buckets(texts):
        if table is not None:
            keep = table[b] != 0
            own, b = own[keep], b[keep]
        keys.append(own.astype(np.int64) << LOG2_BUCKETS | b)
    keys = np.unique(np.concatenate(keys)) if keys else np.zeros(0, np.int64)
    return keys >> LOG2_BUCKETS, keys & ((1 << LOG2_BUCKETS) - 1)


def train(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "toxic", per_class: int = PER_CLASS, features: int = FEATURES, min_df: int = 3, least_ratio: float = 0.7, lift: float = LIFT) -> Model:
    """Learn from rows of ``docs`` with a label 0 or 1 (a key with both counts as 1). With fewer than two classes there is
    nothing to tell apart: every text then gets the share of toxic labels (0.0 without labels)."""
    spark = docs.sparkSession
    named = columns(labels, key, label).toDF("key", "y").filter("key is not null and y in (0, 1)").groupBy("key").agg(F.max("y").cast("int").alias("y"))
    sizes = {r.y: r["count"] for r in named.groupBy("y").count().collect()}
    if len(sizes) < 2:
        p = float(sizes.get(1, 0) > 0)
        return Model(np.zeros(1 << LOG2_BUCKETS, np.float32), 20.0 * (2 * p - 1))
    kept = F.create_map(*(F.lit(x) for y, n in sizes.items() for x in (y, per_class / n)))[F.col("y")]
    sample = named.filter(F.pmod(F.xxhash64(F.lit("sample"), "key"), F.lit(1_000_000)) < kept * 1_000_000)
    rows = columns(docs, key, text).toDF("key", "text").join(F.broadcast(sample), "key").select("text", "y")  # bounded: about 2 * per_class rows

    def count(batches):
        size = 1 << LOG2_BUCKETS
        seen = {1: np.zeros(size, np.int32), 0: np.zeros(size, np.int32)}  # over all of the task's texts
        for batch in batches:
            for piece, texts in slices(batch, "text"):
                own, b = _distinct(texts)
                y = np.asarray(piece.column("y"))[own]
                for k, table in seen.items():
                    np.add.at(table, b[y == k], 1)
        at = np.flatnonzero(seen[1] + seen[0])
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int64)), pa.array(seen[1][at].astype(np.int64)), pa.array(seen[0][at].astype(np.int64))], names=["b", "pos", "neg"])

    modest_batches(spark)
    df = rows.mapInArrow(count, "b long, pos long, neg long").groupBy("b").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))
    n = {y: min(per_class, m) for y, m in sizes.items()}
    r = F.log(((F.col("pos") + 0.5) / (n[1] + 1)) / ((F.col("neg") + 0.5) / (n[0] + 1)))
    telling = (F.col("pos") + F.col("neg") >= min_df) & (F.abs(r) >= least_ratio)
    share = (F.col("pos") + F.col("neg")) / (n[1] + n[0])
    z = (F.col("pos") - share * n[1]) / F.sqrt(share * F.greatest(1 - share, F.lit(1e-9)) * (n[1] * n[0] / (n[1] + n[0])))
    best = df.filter(telling).select("b", r.alias("r"), F.abs(z).alias("worth")).orderBy(F.desc("worth"), "b").limit(features).toPandas()
    ratio = np.zeros(1 << LOG2_BUCKETS, np.float32)
    ratio[best.b.to_numpy(np.int64)] = best.r.to_numpy(np.float32)
    sent = spark.sparkContext.broadcast(ratio)

    def listed(_, piece, texts):
        own, b = _distinct(texts, sent.value)
        ends = np.cumsum(np.bincount(own, minlength=len(texts)))
        return {"y": piece.column("y"), "b": pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]).astype(np.int32)), pa.array(b.astype(np.int32)))}

    # in a fixed order, so that the result doesn't depend on how tasks dealt the rows
    found = over_text(rows, "text", listed, "y int, b array<int>").orderBy("y", F.size("b"), F.xxhash64("b")).toArrow()
    sent.destroy()
    y, lists = found.column("y").to_numpy(), found.column("b").combine_chunks()
    if len(set(y.tolist())) < 2:
        return Model(np.zeros(1 << LOG2_BUCKETS, np.float32), 20.0 * (2 * float(sizes[1] >= sizes[0]) - 1))
    if isinstance(lists, pa.ChunkedArray):
        lists = pa.concat_arrays(lists.chunks)
    ends = np.diff(lists.offsets.to_numpy())
    weight = np.where(y == 1, sizes[1] / max(1, (y == 1).sum()), sizes[0] / max(1, (y == 0).sum()))
    weight *= np.where((y == 1) == (sizes[1] < sizes[0]), (max(sizes.values()) / min(sizes.values())) ** lift, 1.0)
    return Model(*_fitted(np.repeat(np.arange(len(y), dtype=np.int32), ends), lists.flatten().to_numpy(), y.astype(np.float32), ratio, weight / weight.sum()))


def _fitted(row: np.ndarray, bucket: np.ndarray, y: np.ndarray, ratio: np.ndarray, weight: np.ndarray, l2: float = L2, rounds: int = 300, rate: float = 0.05) -> tuple[np.ndarray, float]:
    """Logistic regression over binary features, given as (row, bucket) pairs, times their ratios: full gradients, Adam steps."""
    used, col = np.unique(bucket, return_inverse=True)
    col, val = col.astype(np.int32), ratio[bucket]
    w, bias, m, v = np.zeros(len(used), np.float32), 0.0, np.zeros(len(used) + 1), np.zeros(len(used) + 1)
    for t in range(1, rounds + 1):
        z = np.bincount(row, weights=val * w[col], minlength=len(y)) + bias
        e = (1 / (1 + np.exp(-np.clip(z, -40, 40))) - y) * weight
        g = np.append(np.bincount(col, weights=val * e.astype(np.float32)[row], minlength=len(used)) + l2 * w, e.sum())
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        step = rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-9)
        w, bias = w - step[:-1].astype(np.float32), bias - step[-1]
    out = np.zeros(len(ratio), np.float32)
    out[used] = w * ratio[used]
    return out, float(bias)


def predict(docs: DataFrame, model: Model, key: str = "doc_id", text: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """(key, kept columns, score 0 to 1) of every row, whole texts; null and empty texts get the score of no n-gram."""
    sent = docs.sparkSession.sparkContext.broadcast(model)
    names = [key, *(k for k in keep if k != key)]
    rows = columns(docs, *names, *([] if text in names else [text]))
    fields = [rows.schema[k] for k in names]

    def kernel(_, piece, texts):
        m = sent.value
        own, b = _distinct(texts, m.weights)
        z = np.bincount(own, weights=m.weights[b], minlength=len(texts)) + m.bias
        return {**{k: piece.column(k) for k in names}, "score": 1 / (1 + np.exp(-np.clip(z, -40, 40)))}

    return over_text(rows, text, kernel, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in fields) + ", score double")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    model = train(docs, labels.filter(fold(F.col("doc_id")) != 0))
    return predict(docs, model).select("doc_id", (fold(F.col("doc_id")) == 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
