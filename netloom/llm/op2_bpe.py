"""Byte-level BPE encoding and decoding by a global distinct-word shuffle.

1. Texts are split into pre-tokens. Each task takes its texts in blocks, gives each distinct word of a block a number and
   writes a text as the numbers of its words in order of position. A word thus leaves a block once however often the
   block holds it: the explosion into (word, position) rows is aggregated before the shuffle.
2. (block, word) rows, in bundles by a hash of the word, are dealt by that hash. The task that owns a hash bucket encodes
   each distinct word of it once, for all blocks of the corpus.
3. The words' ids are joined back to their blocks, and each text is reassembled by position. Blocks lie in a table that is
   bucketed by block, so only the ids move.
4. Decoding joins ids to the token-byte table (fixed size: one row a token of the vocabulary) and joins the bytes.

Block tables are staged in the shared folder, so a lost executor costs a reread of its blocks. No task holds more than a
block (about ``block_bytes`` of text, or one longer text) or the distinct words of one bucket.
"""

from __future__ import annotations

import base64
import uuid
from collections import defaultdict
from itertools import count

import numpy as np
import pyarrow as pa
import regex
import xxhash
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import columns, dropped, modest_batches, schema_of, shared_dir, slices, staged, trimmed

#: Text in a block, in characters, and words in a row of word numbers.
BLOCK_CHARS, CHUNK_WORDS = 10_000_000, 200_000
#: Hash buckets of words: one for so many bytes of input, within these bounds. A task has one bucket's words in memory at once, and
#: of these no more than so many: beyond, it forgets them, and a word that comes again is encoded again.
BUCKET_BYTES, LEAST_BUCKETS, MOST_BUCKETS, KNOWN_WORDS = 64 << 20, 256, 8192, 1_000_000

_BLOCKS = "block long, kind int, bucket int, keys array<string>, lens array<int>, n int, numbers binary, payload binary"
_CODED = "block long, n int, numbers binary, payload binary"


def read_ranks(path: str) -> dict[bytes, int]:
    """The rank file as a dictionary. The driver reads it; tasks get it with their code (about 1 MB for 50,000 tokens)."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


def _pack(x: np.ndarray) -> bytes:
    """Numbers as compressed planes of their bytes: small numbers leave the upper planes empty."""
    return zstandard.ZstdCompressor(level=3).compress(np.ascontiguousarray(x, dtype=np.uint32).view(np.uint8).reshape(-1, 4).T.tobytes())


def _unpack(b: bytes) -> np.ndarray:
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(b), dtype=np.uint8).reshape(4, -1)
    return np.ascontiguousarray(planes.T).view(np.uint32).reshape(-1)


def _pack_words(words: list[bytes]) -> bytes:
    return zstandard.ZstdCompressor(level=3).compress(np.array([len(w) for w in words], dtype=np.uint32).tobytes() + b"".join(words))


def _unpack_words(b: bytes, n: int) -> list[bytes]:
    raw = zstandard.ZstdDecompressor().decompress(b)
    at, out = 4 * n, []
    for size in np.frombuffer(raw[: 4 * n], dtype=np.uint32).tolist():
        out.append(raw[at : at + size])
        at += size
    return out


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)


def _blocks(pattern: str, buckets: int, block_chars: int):
    """Task of step 1. Rows of kind 1: texts as word numbers. Kind 0: a bundle of distinct words with their numbers, which
    count words as the block meets them, so frequent words have small ones."""
    schema = schema_of(_BLOCKS)

    def run(batches):
        from pyspark import TaskContext

        split, blocks = regex.compile(pattern), count(TaskContext.get().partitionId() << 32)
        block, numbers, size = next(blocks), defaultdict(count().__next__), 0
        keys, streams, words = [], [], 0

        def texts_row():
            return _batch([(block, 1, None, keys, [len(s) for s in streams], None, None, _pack(np.concatenate(streams)))], schema)

        def word_rows():
            names = [w.encode("utf-8", "surrogatepass") for w in numbers]
            homes = np.fromiter((xxhash.xxh3_64_intdigest(w) % buckets for w in names), np.int64, len(names))
            order = np.argsort(homes, kind="stable")
            starts = np.searchsorted(homes[order], np.arange(buckets + 1))
            bundles = [(b, order[starts[b] : starts[b + 1]]) for b in range(buckets) if starts[b] < starts[b + 1]]
            return _batch([(block, 0, b, None, None, len(at), _pack(np.diff(at, prepend=0)), _pack_words([names[i] for i in at])) for b, at in bundles], schema)

        for batch in batches:
            for piece, texts in slices(batch, "text"):
                for key, text in zip(piece.column("row_key").to_pylist(), texts, strict=True):
                    found = split.findall(text)
                    keys.append(key)
                    streams.append(np.fromiter(map(numbers.__getitem__, found), np.uint32, len(found)))
                    words += len(found)
                    size += len(text)
                    if words >= CHUNK_WORDS or size >= block_chars:
                        yield texts_row()
                        keys, streams, words = [], [], 0
                    if size >= block_chars:
                        if numbers:
                            yield word_rows()
                        block, numbers, size = next(blocks), defaultdict(count().__next__), 0
        if keys:
            yield texts_row()
        if numbers:
            yield word_rows()
        numbers.clear()
        trimmed()

    return run


def _encoder(ranks: dict[bytes, int], pattern: str):
    """Task of step 2: rows arrive bucket by bucket; a bucket's words are encoded once each."""
    schema = schema_of(_CODED)

    def run(batches):
        import tiktoken

        enc = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        at, known = None, {}
        for batch in batches:
            out = []
            for block, bucket, n, numbers, payload in zip(*(batch.column(c).to_pylist() for c in ("block", "bucket", "n", "numbers", "payload")), strict=True):
                if bucket != at:
                    at, known = bucket, {}
                ids = []
                for w in _unpack_words(payload, n):
                    x = known.get(w)
                    if x is None:
                        if len(known) >= KNOWN_WORDS:
                            known = {}
                        x = known[w] = tuple(enc.encode_ordinary(w.decode("utf-8", "surrogatepass")))
                    ids.append(x)
                lens = np.fromiter(map(len, ids), np.uint32, n)
                out.append((block, n, numbers, _pack(np.concatenate([lens, np.fromiter((t for x in ids for t in x), np.uint32, int(lens.sum()))]))))
            if out:
                yield _batch(out, schema)

    return run


def _assemble(schema: pa.Schema):
    """Step 3 for one block: its texts, in chunks, and its words' ids; a text's ids in order of position."""

    def table(parts):
        numbers = np.concatenate([np.zeros(0, np.int64), *(np.cumsum(_unpack(b).astype(np.int64)) for _, b, _ in parts)])
        coded = [(n, _unpack(p)) for n, _, p in parts]
        lens = np.concatenate([np.zeros(0, np.int64), *(x[:n].astype(np.int64) for n, x in coded)])
        ids = np.concatenate([np.zeros(0, np.int32), *(x[n:].astype(np.int32) for n, x in coded)])
        start, size = np.zeros(len(numbers), np.int64), np.zeros(len(numbers), np.int64)
        start[numbers], size[numbers] = np.cumsum(lens) - lens, lens
        return start, size, ids

    def run(texts: pa.Table, words: pa.Table) -> pa.Table:
        start, size, ids = table(list(zip(*(words.column(c).to_pylist() for c in ("n", "numbers", "payload")), strict=True)))
        out = []
        for keys, lens, payload in zip(*(texts.column(c).to_pylist() for c in ("keys", "lens", "payload")), strict=True):
            s = _unpack(payload)
            each = size[s]
            ends = np.cumsum(each)
            where = np.repeat(start[s] - (ends - each), each) + np.arange(ends[-1] if len(ends) else 0)
            offsets = np.concatenate([[0], ends])[np.concatenate([[0], np.cumsum(lens)]).astype(np.int64)]
            values = pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(ids[where]))
            out.append(pa.RecordBatch.from_arrays([pa.array(keys, pa.string()), values.cast(schema.field("ids").type)], schema=schema))
        del start, size, ids
        trimmed()
        return pa.Table.from_batches(out, schema=schema)

    return run


def _bucketed(df: DataFrame) -> tuple[DataFrame, str]:
    """Stage the blocks in the shared folder as a table bucketed by block: a task writes the blocks that it made, nothing is
    shuffled, and texts later meet their words' ids without a shuffle of the texts. Returns the table and its name."""
    spark = df.sparkSession
    name = f"bpe_blocks_{uuid.uuid4().hex}"
    df.write.bucketBy(max(8, int(spark.conf.get("spark.sql.shuffle.partitions"))), "block").option("path", f"{shared_dir(spark)}/{name}").saveAsTable(name)
    return spark.table(name), name


def _size(df: DataFrame) -> int:
    """Bytes of a table as Spark's statistics have them, without reading it."""
    return int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())


def encode(docs: DataFrame, ranks: dict[bytes, int], pattern: str, key: str = "doc_id", text: str = "text", buckets: int | None = None, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """(key, ids array<int>) for every row of ``docs``.

    A null or empty text has no ids. Repeated keys and rows stay as many rows as they were; a null key stays null. Other
    columns of ``docs`` are ignored, whatever their names. An empty table gives an empty table.
    """
    return _encoded(docs, ranks, pattern, key, text, buckets, block_chars)[0]


def _encoded(docs: DataFrame, ranks: dict[bytes, int], pattern: str, key: str = "doc_id", text: str = "text", buckets: int | None = None, block_chars: int = BLOCK_CHARS) -> tuple[DataFrame, str]:
    """The ids, and the name of the table of blocks that they are made from."""
    modest_batches(docs.sparkSession)
    buckets = buckets or min(MOST_BUCKETS, max(LEAST_BUCKETS, -(-_size(columns(docs, text)) // BUCKET_BYTES)))
    kind = docs.schema[key].dataType.simpleString()
    rows = columns(docs, key, text).toDF("row_key", "text").withColumn("row_key", F.col("row_key").cast("string"))
    table, name = _bucketed(rows.mapInArrow(_blocks(pattern, buckets, block_chars), _BLOCKS))
    words = table.filter("kind = 0").select("block", "bucket", "n", "numbers", "payload")
    coded = words.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(_encoder(ranks, pattern), _CODED)
    texts = table.filter("kind = 1").select("block", "keys", "lens", "payload")
    ids = texts.groupBy("block").cogroup(coded.groupBy("block")).applyInArrow(_assemble(schema_of("row_key string, ids array<int>")), "row_key string, ids array<int>")
    return ids.select(F.col("row_key").cast(kind).alias(key), "ids"), name


def decode(ids: DataFrame, ranks: dict[bytes, int], column: str = "ids", name: str = "decoded") -> DataFrame:
    """``ids`` with a column of bytes for its arrays of ids. A null array gives empty bytes; an id that the table lacks is an
    error. The token-byte table is one array (fixed size, a row a token) that every task looks ids up in, as hexadecimal text,
    since Spark joins arrays of text only: no Python runs, so a task that also encodes needs no second worker."""
    table = ["!"] * (max(ranks.values(), default=-1) + 1)
    for b, i in ranks.items():
        table[i] = b.hex()
    known = F.split(F.lit(",".join(table)), ",")  # folded to a literal
    joined = F.array_join(F.transform(F.col(column), lambda i: F.get(known, i)), "", "!")  # what isn't a token spoils the text
    decoded = F.coalesce(F.unhex(joined), F.raise_error(F.lit("an id without a token")).cast("binary"))
    return ids.withColumn(name, F.when(F.col(column).isNull(), F.lit(b"")).otherwise(decoded))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return digests(spark.read.parquet(f"{sf_dir}/documents.parquet"), read_ranks(public_tokenizers.path("byte_bpe_multi_50k.tiktoken")), public_tokenizers.PATTERN)


def digests(docs: DataFrame, ranks: dict[bytes, int], pattern: str, with_ids: bool = False) -> DataFrame:
    """Encode, decode, and hash both: doc_id, n_tokens, ids_sha256, decoded_sha256 (and the ids themselves)."""
    spark = docs.sparkSession
    ids, name = _encoded(docs, ranks, pattern)
    ids = decode(ids, ranks)
    text = F.array_join(F.transform("ids", lambda x: x.cast("string")), ",")
    out = ids.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(text.cast("binary"), 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"), "ids")
    out = staged(out if with_ids else out.drop("ids"), "bpe-digests")
    blocks = spark.table(name)
    spark.sql(f"DROP TABLE {name}")  # leaves the files of an external table
    dropped(spark, blocks)
    return out
