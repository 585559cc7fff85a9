"""Ranked lexical search over a two-level quantised index.

The index holds, for blocks of documents, the postings of the terms that the queries ask for. Its first level has a byte for
each posting: the impact s = (10^9 tf) div (1000 tf + 8 m), below 10^6, divided by ``UNIT`` and rounded upwards. Its second
level has the exact tf and the documents' lengths. A query reads the first level alone, where sums of weight * byte bound
every document's score from above, and bytes less one from below; the k-th largest lower bound of all documents is the query's
threshold. Then every document whose upper bound reaches the threshold is rescored in whole numbers from the second level. A
document of the true top k has at least k-th score, so its upper bound reaches the threshold: nothing is lost.

Documents never shuffle: blocks are made, bounded and rescored where they lie; what moves are k bounds a query and task, and
the candidates. The queries are taken in batches of about ``BATCH_BYTES`` of text, so that the terms that each task is sent are
bounded whatever the number of queries.
"""

from __future__ import annotations

import math
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from .common import batches_of, columns, dropped, modest_batches, slices, staged

K, UNIT = 10, 3922  # 255 * 3922 > 10**6 > 254 * 3922
#: A block ends at so many documents or postings; a batch of queries at about so many bytes of text.
BLOCK_DOCS, BLOCK_POSTINGS, BATCH_BYTES = 1024, 200_000, 1_000_000
#: Rows of the index are up to some MB: small row groups and Arrow batches keep few of them in memory.
ROW_GROUP, BATCH_ROWS = 8 << 20, 4

#: ASCII letters in lower case, digits and all bytes of other characters stay; other ASCII becomes a space.
_BYTES = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256))


def terms(text: str | bytes) -> list[bytes]:
    """Terms of a text as UTF-8, in order, with repeats."""
    return (text.encode("utf-8", "surrogatepass") if isinstance(text, str) else text).translate(_BYTES).split()


@dataclass
class Queries:
    """A batch of queries: their ids, and (query, term) pairs without repeats."""

    ids: pa.Array
    query: np.ndarray
    term: np.ndarray
    vocabulary: dict[bytes, int]


def _queries(rows: list, kind: pa.DataType) -> Queries:
    vocabulary: dict[bytes, int] = {}
    pairs = [(i, vocabulary.setdefault(t, len(vocabulary))) for i, r in enumerate(rows) for t in dict.fromkeys(w for text in r.texts for w in terms(text))]
    return Queries(pa.array([r.item for r in rows], type=kind), np.array([p[0] for p in pairs], np.int64), np.array([p[1] for p in pairs], np.int64), vocabulary)


def index(docs: DataFrame, vocabulary: dict[bytes, int], key: str, text: str) -> tuple[DataFrame, int, int, np.ndarray]:
    """The staged index of these terms over ``docs(key, text)``, with N (documents with a term), L (terms of all) and each
    term's number of documents. Documents without any of these terms count in N and L alone."""
    spark = docs.sparkSession
    sent = spark.sparkContext.broadcast(vocabulary)
    kind = docs.schema[key].dataType
    schema = f"full long, words long, docs array<{kind.simpleString()}>, n array<long>, terms array<int>, df array<int>, local array<short>, tf array<int>"
    arrow = pa.schema([("full", pa.int64()), ("words", pa.int64()), ("docs", pa.list_(to_arrow_type(kind))), ("n", pa.list_(pa.int64())), ("terms", pa.list_(pa.int32())), ("df", pa.list_(pa.int32())), ("local", pa.list_(pa.int16())), ("tf", pa.list_(pa.int32()))])

    def run(batches):
        known = sent.value
        full, words, ids, ns, post = 0, 0, [], [], []

        def block():
            t, local, tf = (np.array(x, np.int64) for x in (zip(*post, strict=True) if post else ([], [], [])))
            order = np.argsort(t, kind="stable")
            used, df = np.unique(t, return_counts=True)
            return pa.RecordBatch.from_pylist([{"full": full, "words": words, "docs": ids, "n": ns, "terms": used, "df": df, "local": local[order], "tf": tf[order]}], schema=arrow)

        for batch in batches:
            for piece, texts in slices(batch, "text"):
                for name, x in zip(piece.column("key").to_pylist(), texts, strict=True):
                    found = terms(x)
                    if not found:
                        continue
                    full, words = full + 1, words + len(found)
                    hits = [(known[w], c) for w, c in Counter(found).items() if w in known]
                    if hits:
                        post.extend((t, len(ids), c) for t, c in hits)
                        ids.append(name)
                        ns.append(len(found))
                    if len(ids) >= BLOCK_DOCS or len(post) >= BLOCK_POSTINGS:
                        yield block()
                        full, words, ids, ns, post = 0, 0, [], [], []
        if full:
            yield block()

    modest_batches(spark)
    counted = staged(docs.select(F.col(key).alias("key"), F.col(text).alias("text")).mapInArrow(run, schema), "lexical-counts", **{"parquet.block.size": ROW_GROUP})
    total = counted.agg(F.sum("full").alias("n"), F.sum("words").alias("l")).first()
    n_docs, n_words = total.n or 0, total.l or 0
    df = np.zeros(len(vocabulary), np.int64)
    for r in counted.select(F.explode(F.arrays_zip("terms", "df")).alias("t")).groupBy("t.terms").agg(F.sum("t.df").alias("df")).collect():  # a row a term
        df[r.terms] = r.df

    def quantised(batches):
        for batch in batches:
            bytes_ = [(-(-_impact(np.asarray(b["tf"], np.int64), _length(np.asarray(b["n"], np.int64), n_docs, n_words)[np.asarray(b["local"], np.int64)]) // UNIT)).astype(np.uint8).tobytes() for b in batch.to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(bytes_, pa.binary())], names=[*batch.schema.names, "impact"])

    with batches_of(spark, BATCH_ROWS):
        rows = counted.filter("size(docs) > 0").select("docs", "n", "terms", "df", "local", "tf")
        out = staged(rows.mapInArrow(quantised, schema.partition("words long, ")[2] + ", impact binary"), "lexical-index", **{"parquet.block.size": ROW_GROUP})
    dropped(spark, counted)
    return out, n_docs, n_words, df


def _length(n: np.ndarray, n_docs: int, n_words: int) -> np.ndarray:
    return 10 + 90 * n * n_docs // max(1, n_words)


def _impact(tf: np.ndarray, m: np.ndarray) -> np.ndarray:
    return 1_000_000_000 * tf // (1000 * tf + 8 * m)


def _postings(batch: pa.RecordBatch, row: int, q: Queries, w: np.ndarray):
    """For one block: (query, local document, weight, posting) of every posting that a query asks for, and the number of
    documents."""
    of = np.asarray(batch.column("terms")[row].values)
    ends = np.cumsum(np.asarray(batch.column("df")[row].values, dtype=np.int64))
    starts = np.concatenate([[0], ends[:-1]])
    at = np.searchsorted(of, q.term)
    there = (at < len(of)) & (of[np.minimum(at, len(of) - 1)] == q.term) & (w[q.term] > 0)
    at, query, weight = at[there], q.query[there], w[q.term[there]]
    count = ends[at] - starts[at]
    total = np.cumsum(count)
    post = np.arange(total[-1] if len(total) else 0) + np.repeat(starts[at] - (total - count), count)
    local = np.asarray(batch.column("local")[row].values, dtype=np.int64)
    return np.repeat(query, count), local[post], np.repeat(weight, count), post, int(local.max()) + 1


def _batch(docs: DataFrame, q: Queries, key: str, text: str, item: str, k: int) -> DataFrame:
    """(item, doc, score) candidates of one batch of queries; the k best of each query are among them."""
    spark = docs.sparkSession
    kind, item_kind = docs.schema[key].dataType, q.ids.type
    table, n_docs, n_words, df = index(docs, q.vocabulary, key, text)
    w = np.array([math.floor(1000 * math.log((2 * n_docs + 2) / (2 * d + 1))) if d else 0 for d in df.tolist()], np.int64)
    sent = spark.sparkContext.broadcast((q, w))
    queries = len(q.ids)

    def bounds(batches):
        q, w = sent.value
        best = np.zeros((queries, k), np.int64)
        for batch in batches:
            for row in range(batch.num_rows):
                query, local, weight, post, size = _postings(batch, row, q, w)
                byte = np.frombuffer(batch.column("impact")[row].as_py(), np.uint8).astype(np.int64)[post]
                low = np.bincount(query * size + local, weights=weight * ((byte - 1) * UNIT + 1), minlength=queries * size).astype(np.int64).reshape(queries, size)
                both = np.concatenate([best, low], axis=1)
                best = np.sort(np.partition(both, both.shape[1] - k, axis=1)[:, -k:], axis=1)
        at = np.nonzero(best)
        yield pa.RecordBatch.from_arrays([pa.array(at[0].astype(np.int32)), pa.array(best[at])], names=["q", "low"])

    with batches_of(spark, BATCH_ROWS):
        lows = staged(table.select("terms", "df", "local", "impact").mapInArrow(bounds, "q int, low long"), "lexical-bounds")
    kth = lows.withColumn("rn", F.row_number().over(Window.partitionBy("q").orderBy(F.desc("low")))).filter(F.col("rn") == k)
    least = np.zeros(queries, np.int64)
    for r in kth.select("q", "low").collect():  # a row a query of the batch
        least[r.q] = r.low
    known = spark.sparkContext.broadcast(least)

    def rescored(batches):
        q, w = sent.value
        for batch in batches:
            for row in range(batch.num_rows):
                query, local, weight, post, size = _postings(batch, row, q, w)
                byte = np.frombuffer(batch.column("impact")[row].as_py(), np.uint8).astype(np.int64)[post]
                cell = query * size + local
                high = np.bincount(cell, weights=weight * byte, minlength=queries * size).astype(np.int64) * UNIT
                reach = (high > 0) & (high >= np.repeat(known.value, size))
                keep = reach[cell]
                cell, local, weight, post = cell[keep], local[keep], weight[keep], post[keep]
                m = _length(np.asarray(batch.column("n")[row].values, dtype=np.int64), n_docs, n_words)[local]
                exact = np.zeros(queries * size, np.int64)
                np.add.at(exact, cell, weight * _impact(np.asarray(batch.column("tf")[row].values, dtype=np.int64)[post], m))
                at = np.flatnonzero(reach)
                ids = batch.column("docs")[row].values
                order = np.empty(len(ids), np.int64)
                order[np.asarray(pc.array_sort_indices(ids))] = np.arange(len(ids))
                at = at[np.lexsort((order[at % size], -exact[at], at // size))]
                first = np.searchsorted(at // size, at // size)
                at = at[np.arange(len(at)) - first < k]
                yield pa.RecordBatch.from_arrays([q.ids.take(pa.array(at // size)), ids.take(pa.array(at % size)), pa.array(exact[at])], names=["item", "doc", "score"])

    with batches_of(spark, BATCH_ROWS):
        out = staged(table.mapInArrow(rescored, f"item {item}, doc {kind.simpleString()}, score long"), "lexical-candidates")
    for done in (table, lows):
        dropped(spark, done)
    return out


def search(docs: DataFrame, items: DataFrame, key: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text", k: int = K, batch_bytes: int = BATCH_BYTES) -> DataFrame:
    """(item, rank, key, score): each item's ``k`` highest-scoring documents, equal scores by ascending key, null keys last.

    Null and empty texts have no terms: such documents don't count, such items have no rows. Rows with one item id are one
    query of the terms of all their texts (also the null id). Repeated documents count and rank each.
    """
    spark = docs.sparkSession
    docs = columns(docs, key, *([text] if text != key else []))
    asked = columns(items, item, item_text).toDF("item", "text").filter("text is not null")
    size = asked.agg(F.sum(F.octet_length("text")).alias("b")).first().b or 0
    batches = max(1, -(-size // batch_bytes))
    kind = asked.schema["item"].dataType
    grouped = staged(asked.groupBy("item").agg(F.sort_array(F.collect_set("text")).alias("texts")).withColumn("batch", F.pmod(F.xxhash64("item"), F.lit(batches)).cast("int")), "lexical-queries")
    found = None
    for b in range(batches):
        q = _queries(grouped.filter(F.col("batch") == b).orderBy("item").collect(), to_arrow_type(kind))  # about batch_bytes
        if len(q.term):
            part = _batch(docs, q, key, text, kind.simpleString(), k)
            found = part if found is None else found.unionByName(part)
    if found is None:
        found = spark.createDataFrame([], f"item {kind.simpleString()}, doc {docs.schema[key].dataType.simpleString()}, score long")
    order = Window.partitionBy("item").orderBy(F.desc("score"), F.col("doc").asc_nulls_last())
    ranked = found.filter("score > 0").withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    return ranked.select(F.col("item").alias(item), "rank", F.col("doc").alias(key), "score")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


SQL = r"""
WITH words AS (SELECT doc_id, translate(unnest(regexp_extract_all(text, '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS term FROM documents),
tfs AS (SELECT doc_id, term, count(*) AS tf FROM words GROUP BY ALL),
sizes AS (SELECT doc_id, sum(tf)::BIGINT AS n FROM tfs GROUP BY doc_id),
whole AS (SELECT count(*) AS n_docs, sum(n)::BIGINT AS n_words FROM sizes),
dfs AS (SELECT term, count(*) AS df FROM tfs GROUP BY term),
asked AS (SELECT DISTINCT item_id, translate(unnest(regexp_extract_all(text, '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS term FROM benchmark),
weights AS (SELECT item_id, term, floor(1000 * ln((2 * n_docs + 2) / (2 * df + 1)::DOUBLE))::BIGINT AS w FROM asked JOIN dfs USING (term), whole),
scores AS (SELECT item_id, doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 8 * (10 + (90 * n * n_docs) // n_words))))::BIGINT AS score
  FROM weights JOIN tfs USING (term) JOIN sizes USING (doc_id), whole GROUP BY ALL),
ranked AS (SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INT AS rank, doc_id, score FROM scores WHERE score > 0)
SELECT * FROM ranked WHERE rank <= 10"""
