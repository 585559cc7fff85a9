"""Document fingerprints by consistent weighted sampling.

A text is a bag of lower-case words; a word's weight is (1 + ln count) * its length, so that rare, long words tell more than
frequent, short ones. For each of ``SAMPLES`` samples every word draws r and c from Gamma(2, 1) and beta from U(0, 1) by
hashes of the word; with t = floor(ln(weight) / r + beta) the word with the least ln c - r (t - beta) - r is the sample,
together with t. Two texts have equal samples with a probability equal to the generalised Jaccard similarity of
their weights. A fingerprint is the samples' 16-bit hashes in hexadecimal.

For the edited texts each document meets the next in descending order of key. Rows are dealt by ranges of the key and
sorted within a task; the first row of the next range comes along as a ghost, so no order is made in one task.
"""

from __future__ import annotations

import hashlib
import re
from decimal import Decimal

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType

from .common import columns, mixed, modest_batches, ordered_parts, over_text, schema_of

SAMPLES = 64
SLICE = 150_000
KNOWN_WORDS = 120_000
_word = re.compile(r"\w+")


class Words(dict):
    """Word -> hash whose low byte is the word's length, 255 at most."""

    def __missing__(self, w: str) -> int:
        if len(self) >= KNOWN_WORDS:
            self.clear()
        v = self[w] = xxhash.xxh3_64_intdigest(w.encode("utf-8", "surrogatepass")) & ~0xFF | min(255, len(w))
        return v


def _uniforms(h: np.ndarray, seeds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    x = mixed(h[:, None] ^ seeds)
    scale = np.float32(2.0**-32)
    return ((x >> np.uint64(32)).astype(np.float32) + np.float32(0.5)) * scale, ((x & np.uint64(0xFFFFFFFF)).astype(np.float32) + np.float32(0.5)) * scale


def fingerprints(texts: list[str], known: Words | None = None, samples: int = SAMPLES) -> np.ndarray:
    """A row of ``samples`` 16-bit codes for each text: 0 throughout for an empty text, never 0 otherwise. A text without
    words is one term."""
    known = Words() if known is None else known
    out = np.zeros((len(texts), samples), dtype=np.uint16)
    terms, counts, owner = [], [], []
    for i, t in enumerate(texts):
        words = _word.findall(t.lower()) or ([f"\0{t}"] if t else [])
        if words:
            h, n = np.unique(np.fromiter(map(known.__getitem__, words), np.uint64, len(words)), return_counts=True)
            terms.append(h)
            counts.append(n)
            owner.append(i)
    if not terms:
        return out
    rng = np.random.default_rng(3)
    seeds = rng.integers(0, 1 << 64, (3, samples), dtype=np.uint64)
    vocabulary, at = np.unique(np.concatenate(terms), return_inverse=True)
    u1, u2 = _uniforms(vocabulary, seeds[0])
    r = -np.log(u1) - np.log(u2)
    u3, u4 = _uniforms(vocabulary, seeds[1])
    c = np.log(-np.log(u3) - np.log(u4)) - r
    beta, _ = _uniforms(vocabulary, seeds[2])
    weight = np.log((1 + np.log(np.concatenate(counts))) * np.maximum(1, (vocabulary & np.uint64(0xFF)).astype(np.float64)[at])).astype(np.float32)
    start, every = 0, np.arange(samples)
    for i, h in zip(owner, terms, strict=True):
        v = at[start : start + len(h)]
        rv, bv = r[v], beta[v]
        t = np.floor(weight[start : start + len(h), None] / rv + bv)
        low = (c[v] - rv * (t - bv)).argmin(0)
        code = mixed(h[low] + t[low, every].astype(np.int64).view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(48)
        out[i] = np.maximum(code, np.uint64(1))
        start += len(h)
    return out


def text_of(code: np.ndarray) -> str:
    return code.astype(">u2").tobytes().hex()


def likeness(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Share of equal samples, row by row."""
    return (a == b).mean(1)


def fingerprint(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, fingerprint) of every row; equal texts have equal ones, null counts as empty."""
    kind = docs.schema[key].dataType.simpleString()
    return over_text(columns(docs, key, text).toDF("key", "text"), "text", lambda known, piece, texts: {"key": piece.column("key"), "fingerprint": [text_of(x) for x in fingerprints(texts, known)]}, f"key {kind}, fingerprint string", make=Words, limit=SLICE).withColumnRenamed("key", key)


def edited(text: str, following: str) -> str:
    """The last half of the code points replaced by as many of the following text, or all of it."""
    k = len(text) // 2
    return text[: len(text) - k] + following[:k]


def against_next(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next) of every row.

    The next document is the one of the next smaller key, for the smallest the one of the largest; null keys come last;
    rows with one key follow by a hash of their texts. Null texts count as empty. A lone row is its own next. Keys are whole numbers of
    at most 64 bits; others are a TypeError.
    """
    modest_batches(docs.sparkSession)
    if not isinstance(docs.schema[key].dataType, IntegralType):
        raise TypeError(f"{key} must be a whole number, not {docs.schema[key].dataType.simpleString()}")
    kind = docs.schema[key].dataType.simpleString()
    # key and hash as one number, so that rows of one key, and those without, are spread too; ~k falls as k rises, for the least k as well
    rows = columns(docs, key, text).toDF("key", "text").withColumn("tie", F.xxhash64("text"))
    place = F.coalesce(F.bitwise_not(F.col("key").cast("long")).cast("decimal(20,0)"), F.lit(Decimal(1 << 63)).cast("decimal(20,0)")).cast("decimal(38,0)")
    order = place * F.lit(1 << 61).cast("decimal(19,0)") + (F.shiftright("tie", 3) + (1 << 60)).cast("decimal(19,0)")
    rows = rows.select("key", "text", order.cast("decimal(38,0)").alias("order"), "tie")
    dealt = ordered_parts(rows, "order", ghosts_after=True, circular=True).sortWithinPartitions("part", "ghost", "order", "tie").select("key", "text", "part", "ghost")
    schema = f"key {kind}, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    arrow = schema_of(schema)

    def table(keys, texts, following, known):
        n = len(texts)
        changed = [edited(a, b) for a, b in zip(texts, [*texts[1:], following], strict=True)]
        codes = fingerprints([*texts, following, *changed], known)
        own, nxt, new = codes[:n], codes[1 : n + 1], codes[n + 1 :]
        cols = [pa.array(keys), [len(t) for t in texts], [hashlib.sha256(t.encode("utf-8", "surrogatepass")).hexdigest() for t in changed], [text_of(x) for x in own], [text_of(x) for x in new], likeness(own, new), likeness(own, nxt)]
        return pa.RecordBatch.from_arrays([pa.array(c, type=f.type) if not isinstance(c, pa.Array) else c.cast(f.type) for c, f in zip(cols, arrow, strict=True)], schema=arrow)

    def run(batches):
        known, keys, texts, size, at, closed = Words(), [], [], 0, None, False
        for batch in batches:
            for i in range(0, batch.num_rows, 64):
                part = batch.slice(i, 64)
                for k, t, p, g in zip(*(part.column(c).to_pylist() for c in ("key", "text", "part", "ghost")), strict=True):
                    t = t or ""
                    if p != at:
                        at, closed = p, False
                    if g:
                        if not closed and keys:
                            yield table(keys, texts, t, known)
                            keys, texts, size = [], [], 0
                        closed = True
                        continue
                    if size >= SLICE:
                        yield table(keys, texts, t, known)
                        keys, texts, size = [], [], 0
                    keys.append(k)
                    texts.append(t)
                    size += len(t)

    return dealt.mapInArrow(run, schema).withColumnRenamed("key", key)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return against_next(spark.read.parquet(f"{sf_dir}/documents.parquet"))
