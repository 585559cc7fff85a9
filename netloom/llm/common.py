"""Helpers shared by the corpus operators.

Everything here is safe on a cluster: intermediate tables go to the folder named by ``spark.checkpoint.dir``, which the
executors share, and nothing reads or writes a machine's own disk.
"""

from __future__ import annotations

import contextlib
import ctypes
import tempfile
import unicodedata
import uuid
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DataType

#: Characters of text that a Python worker handles at once; bounds its memory and keeps arrays in the CPU's caches.
SLICE_CHARS = 400_000


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share. Where the setting is absent (tests, one machine), one is made and set."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        path = "file://" + tempfile.mkdtemp(prefix="netloom-")
        spark.conf.set("spark.checkpoint.dir", path)
    return path


def staged(df: DataFrame, name: str, **options) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back: cuts lineage, survives lost executors."""
    path = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.options(**options).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def dropped(spark: SparkSession, df: DataFrame) -> None:
    """Delete the files of a staged table that nothing reads any more."""
    jvm = spark._jvm
    for f in df.inputFiles()[:1]:
        path = jvm.org.apache.hadoop.fs.Path(f).getParent()
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def modest_batches(spark: SparkSession, rows: int = 100) -> None:
    """Arrow batches of at most ``rows`` rows from now on: whole texts in batches of Spark's 10,000 rows would take hundreds of
    MB in the executor and once more in its Python worker."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(name)) <= rows:
        spark.conf.set(name, str(rows))


@contextlib.contextmanager
def batches_of(spark: SparkSession, rows: int):
    """Arrow batches of ``rows`` rows for what runs within: narrow rows are slow in small batches."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, str(rows))
    try:
        yield
    finally:
        spark.conf.set(name, before)


def trimmed() -> None:
    """Give freed memory back to the system: Spark keeps Python workers for the next tasks, and their peaks would add up."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # other C libraries lack it
        ctypes.CDLL("libc.so.6").malloc_trim(0)


def columns(df: DataFrame, *names: str) -> DataFrame:
    """Just these columns, whatever others the table has. A missing one is an error at once, not late in a job."""
    return df.select(*(F.col(f"`{n}`") for n in names))


def fold(key: Column) -> Column:
    """crc32 of the key as text, modulo 5; a null key counts as the empty text, so its remainder is 0."""
    return F.crc32(F.coalesce(key.cast("string"), F.lit("")).cast("binary")) % 5


def slices(batch: pa.RecordBatch, text: str, limit: int = SLICE_CHARS):
    """Pieces of the batch with about ``limit`` bytes of text each, and their texts as Python strings (null: empty)."""
    column = batch.column(text)
    sizes = np.asarray(pa.compute.fill_null(pa.compute.binary_length(column), 0), dtype=np.int64)
    at, start, ends = 0, 0, np.cumsum(sizes)
    while start < len(sizes):
        stop = max(start + 1, int(np.searchsorted(ends, at + limit, side="right")))
        yield batch.slice(start, stop - start), [x or "" for x in column.slice(start, stop - start).to_pylist()]
        start, at = stop, int(ends[stop - 1])


def over_text(df: DataFrame, text: str, kernel, schema: str, make=None, limit: int = SLICE_CHARS) -> DataFrame:
    """Run ``kernel(state, batch, texts) -> RecordBatch or dict of columns`` over slices of the table.

    ``make()`` builds the state once a task (a tokenizer, a table of weights). Rows keep their order; texts are whole.
    """
    arrow = schema_of(schema)
    modest_batches(df.sparkSession)

    def run(batches):
        state = make() if make else None
        for batch in batches:
            for piece, texts in slices(batch, text, limit):
                out = kernel(state, piece, texts)
                if out is not None:
                    yield pa.RecordBatch.from_arrays([x if isinstance(x, pa.Array) else pa.array(x, type=f.type) for x, f in zip((out[f.name] for f in arrow), arrow, strict=True)], schema=arrow)
        state = None
        trimmed()

    return df.mapInArrow(run, schema)


def schema_of(ddl: str) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    return to_arrow_schema(_parse_datatype_string(ddl))


# ---------------------------------------------------------------- characters


@lru_cache(1)
def letter_table() -> np.ndarray:
    """For each code point: itself if it is a letter, a combining mark or the separator 0, else a space."""
    n = 0x110000
    table = np.full(n, 32, dtype=np.uint32)
    keep = [c for c in range(n) if unicodedata.category(chr(c))[0] in "LM"]
    table[keep] = keep
    table[0] = 0
    return table


def letter_codes(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Lower-case letters of all texts, other characters as single spaces, each text within spaces, 0 between texts.

    Returns the codes (uint64) and for each code the number of its text.
    """
    clean = [t.replace("\0", " ") if "\0" in t else t for t in texts]
    joined = "".join(f"\0 {t} " for t in clean).lower().encode("utf-32-le", "surrogatepass")
    codes = letter_table()[np.frombuffer(joined, dtype=np.uint32)]
    keep = np.ones(len(codes), dtype=bool)
    keep[1:] = (codes[1:] != 32) | (codes[:-1] != 32)
    codes = codes[keep]
    return codes.astype(np.uint64), (np.cumsum(codes == 0) - 1).astype(np.int32)


MIX = np.uint64(0x9E3779B97F4A7C15)
MIX2 = np.uint64(0xC2B2AE3D27D4EB4F)


def mixed(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (xor, shift, multiply), vectorised."""
    x = x ^ (x >> np.uint64(32))
    x = x * MIX2
    x ^= x >> np.uint64(29)
    x = x * MIX
    x ^= x >> np.uint64(32)
    return x


def char_grams(codes: np.ndarray, sizes: tuple[int, ...]):
    """For each size: hashes of the n-grams that begin at each code, and which of them lie within one text."""
    ok, h = codes != 0, codes * MIX
    for n in range(2, max(sizes) + 1):
        if len(codes) < n:
            return
        ok = ok[:-1] & (codes[n - 1 :] != 0)
        h = (h[:-1] ^ (h[:-1] >> np.uint64(31))) * MIX2 + codes[n - 1 :] * MIX
        if n in sizes:
            yield n, h, ok


# ---------------------------------------------------------------- order without one task


def ordered_parts(df: DataFrame, key: str, rows_per_part: int = 1000, most_parts: int = 8192, ghosts_before: bool = False, ghosts_after: bool = False, circular: bool = False) -> DataFrame:
    """Deal rows to tasks by ranges of ``key`` (ascending), each task sorted, with its neighbours' edge rows as ghosts.

    Adds ``part`` (int) and ``ghost`` (boolean). ``ghosts_before`` gives each part the last row of the part before it,
    ``ghosts_after`` the first row of the part after; ``circular`` also gives the last part the first part's first row.
    The bounds come from a hash sample of the keys (about 64 keys a part); what goes through the driver is a key a part.
    ``key`` must not be null and should be unique: rows with one key stay in one part.
    """
    keys = df.select(F.col(key).alias("k"))
    kind = df.schema[key].dataType
    n = keys.count()
    parts = min(most_parts, max(2, -(-n // rows_per_part))) if n else 1
    share = max(1, n // (64 * parts))
    sample = sorted(r.k for r in keys.filter(F.pmod(F.xxhash64("k"), F.lit(share)) == 0).collect()) if parts > 1 else []
    bounds = sorted({sample[i * len(sample) // parts] for i in range(1, parts)}) if sample else []
    if bounds:
        tree = F.array(*(F.lit(b).cast(kind) for b in bounds))
        part = F.aggregate(F.sequence(F.lit(1), F.lit(len(bounds).bit_length())), F.struct(F.lit(0).alias("lo"), F.lit(len(bounds)).alias("hi")), lambda s, _: F.when(s.lo >= s.hi, s).otherwise(F.when(F.get(tree, _mid(s)) <= F.col(key), F.struct((_mid(s) + 1).cast("int").alias("lo"), s.hi.alias("hi"))).otherwise(F.struct(s.lo.alias("lo"), _mid(s).alias("hi")))), lambda s: s.lo)
    else:
        part = F.lit(0)
    df = df.withColumn("part", part.cast("int"))
    edges = sorted((r.part, r.lo, r.hi) for r in df.groupBy("part").agg(F.min(key).alias("lo"), F.max(key).alias("hi")).collect())
    also = F.array().cast("array<int>")
    ring = edges[1:] + (edges[:1] if circular else [])
    if ghosts_after and edges:
        for chunk in _chunks([(nxt[1], at[0]) for at, nxt in zip(edges, ring, strict=False)]):
            also = F.when(F.col(key).isin([k for k, _ in chunk]), F.array_union(also, _looked_up(key, kind, chunk))).otherwise(also)
    if ghosts_before and edges:
        for chunk in _chunks([(at[2], nxt[0]) for at, nxt in zip(edges, ring, strict=False)]):
            also = F.when(F.col(key).isin([k for k, _ in chunk]), F.array_union(also, _looked_up(key, kind, chunk))).otherwise(also)
    target = F.concat(F.array(F.struct(F.col("part").alias("part"), F.lit(False).alias("ghost"))), F.transform(also, lambda p: F.struct(p.alias("part"), F.lit(True).alias("ghost"))))
    out = df.withColumn("_to", F.explode(target)).drop("part").select("*", "_to.part", "_to.ghost").drop("_to")
    return out.repartition(max(1, len(bounds) + 1), "part")


def _mid(s: Column) -> Column:
    return F.floor((s.lo + s.hi) / 2).cast("int")


def _chunks(pairs: list, size: int = 4096):
    for i in range(0, len(pairs), size):
        yield pairs[i : i + size]


def _looked_up(key: str, kind: DataType, pairs: list) -> Column:
    """The parts for a key that is known to be among the pairs."""
    wanted: dict = {}
    for k, p in pairs:
        wanted.setdefault(k, []).append(p)
    return F.coalesce(F.map_from_entries(F.array(*(F.struct(F.lit(k).cast(kind).alias("k"), F.array(*map(F.lit, ps)).alias("p")) for k, ps in wanted.items())))[F.col(key)], F.array().cast("array<int>"))


# ---------------------------------------------------------------- components


#: Rows of a node's links that one task may join, at least, and hubs that are broadcast, at most (about 48 bytes each).
HUB_ROWS, MOST_HUBS = 64, 100_000


def components(edges: DataFrame, name: str = "components") -> DataFrame:
    """Connected components of ``edges(a, b)``: rows (node, root), root the least node, by repeated star contraction.

    Each round links every node to the least node that it sees (large star, then small star) and is checkpointed; it stops
    when no link changes. Rows are links of nodes, spread by node. The links of a hub, a node with more than ``HUB_ROWS`` and
    more than 1 / ``MOST_HUBS`` of all links, stay where they are: as the links add up to all, the hubs are few, and a
    broadcast tells every task their least nodes.
    """

    def with_least(links: DataFrame, n: int) -> DataFrame:
        """The links (v, u) with m, the least of v and all that it is linked with."""
        least = links.groupBy("v").agg(F.min("u").alias("m"), F.count(F.lit(1)).alias("n")).select("v", F.least("v", "m").alias("m"), (F.col("n") > max(HUB_ROWS, n // MOST_HUBS)).alias("hub"))
        hubs = F.broadcast(least.filter("hub").select("v", F.col("m").alias("of_hub")))
        marked = links.join(hubs, "v", "left")
        return marked.filter("of_hub is not null").select("v", "u", F.col("of_hub").alias("m")).unionByName(marked.filter("of_hub is null").select("v", "u").join(least.filter("not hub").select("v", "m"), "v"))

    now = staged(edges.select(F.greatest("a", "b").alias("v"), F.least("a", "b").alias("u")).filter("v > u").distinct(), name)
    n = now.count()
    while True:
        both = now.unionByName(now.select(F.col("u").alias("v"), F.col("v").alias("u")))
        large = with_least(both, 2 * n).filter("u > v").select(F.col("u").alias("v"), F.col("m").alias("u")).filter("v > u").distinct()
        large = staged(large, name)
        small = with_least(large, large.count()).select(F.col("u").alias("v"), F.col("m").alias("u")).unionByName(large.groupBy("v").agg(F.min("u").alias("u")))
        after = staged(small.filter("v > u").distinct(), name)
        m = after.count()
        same = m == n and after.join(now, ["v", "u"], "left_anti").isEmpty()
        for done in (large, now):
            dropped(now.sparkSession, done)
        now, n = after, m
        if same:
            return now.select(F.col("v").alias("node"), F.col("u").alias("root"))


# ---------------------------------------------------------------- bounded filters of keys

BLOOM_LOG2 = 25


def bit_filter(keys: DataFrame, column: str, log2_bits: int = BLOOM_LOG2) -> np.ndarray:
    """Bits of a Bloom filter over a column of 64-bit hashes, two bits a key, built on the executors as bitmaps.

    What reaches the driver has a fixed size, 2**log2_bits / 8 bytes (4 MB), at any number of keys. A full filter only lets
    more rows through to the exact join that must follow.
    """
    m = 1 << log2_bits
    at = F.explode(F.array(F.pmod(column, F.lit(m)) + 1, F.pmod(F.shiftright(column, 29), F.lit(m)) + 1)).alias("p")
    out = np.zeros(m // 8, dtype=np.uint8)
    for r in keys.select(at).groupBy(F.expr("bitmap_bucket_number(p)").alias("b")).agg(F.expr("bitmap_construct_agg(bitmap_bit_position(p))").alias("bits")).collect():
        out[(r.b - 1) * 4096 : r.b * 4096] = np.frombuffer(r.bits, dtype=np.uint8)[: len(out) - (r.b - 1) * 4096]
    return out


def in_filter(bits: np.ndarray, v: np.ndarray) -> np.ndarray:
    """Which of the hashes the filter, of 2**n bits, may hold. The second bit is asked where the first one is set."""
    last = len(bits) * 8 - 1
    p = v & last
    hit = (bits[p >> 3] >> (p & 7).astype(np.uint8)) & 1 == 1
    at = np.flatnonzero(hit)
    p = (v[at] >> 29) & last
    hit[at] = (bits[p >> 3] >> (p & 7).astype(np.uint8)) & 1 == 1
    return hit


def row_key(key: str, text: str) -> Column:
    """A hash that equal rows share: of the key and the text."""
    return F.xxhash64(F.col(f"`{key}`"), F.col(f"`{text}`"))


def filtered(docs: DataFrame, key: str, text: str, acts: DataFrame) -> DataFrame:
    """``docs`` after the decisions ``acts(row_key, stays)``: 0 drops the rows of that key, 1 keeps one of them; rows that
    no decision names stay. Only rows that a filter of fixed size lets through meet the exact join, so the texts of the
    others aren't shuffled."""
    names = docs.columns
    mark = next(f"_row{i}" for i in range(len(names) + 1) if f"_row{i}" not in names)
    sent = docs.sparkSession.sparkContext.broadcast(bit_filter(acts, "row_key"))

    def kernel(_, piece, texts):
        return {**{c: piece.column(c) for c in [*names, mark]}, mark + "m": pa.array(in_filter(sent.value, np.asarray(piece.column(mark))))}

    rows = docs.withColumn(mark, row_key(key, text))
    flagged = over_text(rows, text, kernel, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema) + f", {mark}m boolean")
    sure = flagged.filter(f"not {mark}m").select(*names)
    maybe = flagged.filter(f"{mark}m").join(acts.select(F.col("row_key").alias(mark), F.col("stays").alias(mark + "s")), mark, "left")
    clear = maybe.filter(f"{mark}s is null").select(*names)
    kept = maybe.filter(f"{mark}s = 1").dropDuplicates([mark]).select(*names)
    return sure.unionByName(clear).unionByName(kept)
