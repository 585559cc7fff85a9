"""Language identification by bit-sliced Bloom filters of character n-grams.

One filter serves all languages: a position of its table holds a mask with a bit for each language (in slices of 32
languages), so the AND of the masks at an n-gram's positions gives every language that contains the n-gram at once. For a
text, the set bits are counted by language over all its n-grams, each count is corrected for the share of n-grams that the
filter lets through falsely, and the largest corrected count decides.

Learned: from a bounded sample of rows with a language, ``per_lang`` texts of each by a hash of the key, whole texts. An
n-gram belongs to a language if at least ``min_df`` sampled texts hold it, at a rate of ``share`` or more of the rate in
the language where it is most frequent. The filter's size is fixed, at any number of rows.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import char_grams, columns, fold, letter_codes, mixed, modest_batches, over_text, slices

#: Sampled texts of a language, about.
PER_LANG = 1200
SIZES = (3, 4, 5)
#: log2 of the positions, and positions of an n-gram.
LOG2_SLOTS, HASHES = 21, 3
#: N-grams that a task holds before it hands on their counts.
HELD_GRAMS = 4_000_000


@dataclass
class Model:
    langs: list[str]
    tables: list[np.ndarray]  # a mask of 32 languages for each position
    false: np.ndarray  # rate of n-grams let through falsely, by language
    common: int  # the most frequent language

    def kernel(self, piece, texts: list[str]):
        codes, owner = letter_codes(texts)
        n, k = len(texts), len(self.langs)
        hits, total = np.zeros((k, n)), np.zeros(n)
        for _, h, ok in char_grams(codes, SIZES):
            h, own = mixed(h[ok]), owner[: len(ok)][ok]
            total += np.bincount(own, minlength=n)
            for s, table in enumerate(self.tables):
                mask = table[_slot(h, 0)]
                for j in range(1, HASHES):
                    mask &= table[_slot(h, j)]
                for b in range(min(32, k - 32 * s)):
                    hits[32 * s + b] += np.bincount(own[(mask >> np.uint32(b)) & np.uint32(1) == 1], minlength=n)
        true = np.maximum(0, hits - self.false[:, None] * total) / (1 - self.false[:, None]) if k else np.zeros((0, n))
        lettered = np.fromiter((any(map(str.isalpha, t)) for t in texts), bool, n)
        whole = true.sum(0)
        best = np.where(whole > 0, true.argmax(0), self.common) if k else np.zeros(n, int)
        score = np.where(lettered & (whole > 0), true.max(0, initial=0) / np.maximum(whole, 1e-9), 0.0)
        return pa.array([self.langs[b] if x and k else "und" for b, x in zip(best, lettered, strict=True)], pa.string()), score


def _slot(h: np.ndarray, j: int) -> np.ndarray:
    return ((h >> np.uint64(LOG2_SLOTS * j)) & np.uint64((1 << LOG2_SLOTS) - 1)).astype(np.int64)


def train(docs: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang", per_lang: int = PER_LANG, min_df: int = 3, share: float = 0.1) -> Model:
    """Learn from rows with a language and a text; others are passed over. Without any, every text is ``und``."""
    rows = columns(docs, key, text, lang).toDF("key", "text", "lang").filter("lang is not null")
    sizes = {r.lang: r["count"] for r in rows.groupBy("lang").count().collect()}
    langs = sorted(sizes)
    if not langs:
        return Model([], [], np.zeros(0), 0)
    number = F.create_map(*(F.lit(x) for i, lg in enumerate(langs) for x in (lg, i)))[F.col("lang")]
    kept = F.create_map(*(F.lit(x) for lg in langs for x in (lg, per_lang / sizes[lg])))[F.col("lang")]
    sample = rows.filter(F.pmod(F.xxhash64(F.lit("sample"), "key"), F.lit(1_000_000)) < kept * 1_000_000).select("text", number.cast("int").alias("lang"))

    def grams(batches):
        held: list[list[np.ndarray]] = [[] for _ in langs]  # by language, of each text its distinct n-grams
        size = 0

        def counted():
            rows = [(i, *np.unique(np.concatenate(h), return_counts=True)) for i, h in enumerate(held) if h]
            for i, h, df in rows:
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(h), i, np.int32)), pa.array(h.view(np.int64)), pa.array(df.astype(np.int64))], names=["lang", "gram", "df"])

        for batch in batches:
            for piece, texts in slices(batch, "text"):
                codes, owner = letter_codes(texts)
                lang_of = np.asarray(piece.column("lang"))
                for _, h, ok in char_grams(codes, SIZES):
                    h, own = mixed(h[ok]), owner[: len(ok)][ok]
                    first = np.unique(h ^ mixed(own.astype(np.uint64) + np.uint64(1)), return_index=True)[1]  # of a text's equal n-grams one
                    h, lang = h[first], lang_of[own[first]]
                    for i in np.unique(lang):
                        held[i].append(h[lang == i])
                    size += len(h)
                if size > HELD_GRAMS:
                    yield from counted()
                    held, size = [[] for _ in langs], 0
        yield from counted()

    modest_batches(docs.sparkSession)
    counts = sample.mapInArrow(grams, "lang int, gram long, df long").groupBy("gram", "lang").agg(F.sum("df").alias("df")).filter(F.col("df") >= min_df)
    used = F.array(*(F.lit(float(min(per_lang, sizes[lg]))) for lg in langs))
    rate = F.col("df") / F.get(used, F.col("lang"))
    by_gram = counts.groupBy("gram").agg(F.collect_list(F.struct("lang", rate.alias("rate"))).alias("in"), F.max(rate).alias("top"))  # at most a row a language
    of = by_gram.select("gram", F.explode(F.filter("in", lambda x: x.rate >= F.col("top") * share)).alias("x")).select("gram", "x.lang")
    found = of.groupBy("gram", F.floor(F.col("lang") / 32).cast("int").alias("slice")).agg(F.expr("bit_or(shiftleft(1L, lang % 32))").alias("mask")).toPandas()  # bounded by the sample
    tables = [np.zeros(1 << LOG2_SLOTS, np.uint32) for _ in range(-(-len(langs) // 32))]
    for s, part in found.groupby("slice"):
        h, mask = part.gram.to_numpy(np.int64).view(np.uint64), part["mask"].to_numpy(np.int64).astype(np.uint32)
        for j in range(HASHES):
            np.bitwise_or.at(tables[s], _slot(h, j), mask)
    filled = np.array([np.mean((tables[i // 32] >> np.uint32(i % 32)) & np.uint32(1)) for i in range(len(langs))])
    return Model(langs, tables, np.minimum(filled**HASHES, 0.99), max(range(len(langs)), key=lambda i: sizes[langs[i]]))


def predict(docs: DataFrame, model: Model, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, lang_pred, score) of every row. ``und``, score 0: the text is null, empty or has no letter. A text with
    letters but without a known n-gram gets the most frequent language, score 0. Repeated rows are scored each."""
    spark = docs.sparkSession
    sent = spark.sparkContext.broadcast(model)  # a fixed size: 4 bytes a position
    rows = columns(docs, key, text).toDF("key", "text")

    def kernel(_, piece, texts):
        lang, score = sent.value.kernel(piece, texts)
        return {"key": piece.column("key"), "lang_pred": lang, "score": score}

    kind = docs.schema[key].dataType.simpleString()
    return over_text(rows, "text", kernel, f"key {kind}, lang_pred string, score double").withColumnRenamed("key", key)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = train(docs.filter(fold(F.col("doc_id")) != 0))
    return predict(docs, model).select("doc_id", (fold(F.col("doc_id")) == 0).alias("held_out"), "lang_pred", "score")
