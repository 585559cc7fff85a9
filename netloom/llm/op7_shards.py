"""Sharding by proportional stratified interleaving.

Rows of each source are put in a seeded random order and ranked; rank and a half over the source's rows is a row's
fractional rank. All rows sorted by fractional rank are cut into shards of equal numbers of rows, so each shard holds every
source in the corpus's mixture. The law is ``rows``: shards' counts are at most one apart.

Neither a source nor the whole is ranked in one task: hashes, then fractional ranks, are cut into ranges, whose counts give
each range the rank of its first row; rows are numbered within their range only. So a source with a third of the rows is
spread over all ranges.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import columns, staged

SHARDS, SEED = 8, 7


def _range_bits(rows: int) -> int:
    """log2 of the ranges: about 100,000 rows each, between 2**8 and 2**16 ranges."""
    return min(16, max(8, (rows // 100_000).bit_length()))


def assign(docs: DataFrame, key: str = "doc_id", text: str = "text", stratum: str = "source", shards: int = SHARDS, seed: int = SEED) -> DataFrame:
    """(key, size, text_crc32, law, shard, slot, grown_shard) of every row.

    Null strata are a stratum of their own; a null text has size 1 and the checksum of the empty text. Repeated rows get
    slots of their own, which of them gets which is the same to a reader. Fewer rows than shards leave shards empty.
    """
    rows = columns(docs, key, text, stratum).toDF("key", "text", "stratum")
    crc = F.crc32(F.coalesce("text", F.lit("")).cast("binary"))
    rows = rows.select("key", F.concat(F.when(F.col("stratum").isNull(), "n").otherwise("s"), F.coalesce(F.col("stratum").cast("string"), F.lit(""))).alias("stratum"), (F.coalesce(F.octet_length("text"), F.lit(0)) + 1).cast("long").alias("size"), crc.alias("text_crc32"))
    rows = staged(rows.withColumn("h", F.xxhash64(F.lit(seed), "key", "text_crc32")), "shard-rows")
    total = rows.count()
    bits = _range_bits(total)
    rows = rows.withColumn("range", F.shiftright("h", 64 - bits))
    counts = rows.groupBy("stratum", "range").agg(F.count(F.lit(1)).alias("n"))
    of = Window.partitionBy("stratum")
    starts = counts.select("stratum", "range", (F.sum("n").over(of.orderBy("range")) - F.col("n")).alias("start"), F.sum("n").over(of).alias("of"))
    inner = Window.partitionBy("stratum", "range").orderBy("h", "key", "text_crc32", "size")
    ranked = rows.join(starts, ["stratum", "range"]).select("key", "stratum", "size", "text_crc32", ((F.col("start") + F.row_number().over(inner) - 0.5) / F.col("of")).alias("f"))
    ranked = staged(ranked.withColumn("range", F.floor(F.col("f") * (1 << bits))), "shard-ranks")
    counts = ranked.groupBy("range").agg(F.count(F.lit(1)).alias("n"))
    starts = counts.select("range", (F.sum("n").over(Window.orderBy("range")) - F.col("n")).alias("start"))  # a row a range
    inner = Window.partitionBy("range").orderBy("f", F.xxhash64("stratum"), "stratum", "key", "text_crc32")
    placed = ranked.join(starts, "range").withColumn("place", F.col("start") + F.row_number().over(inner) - 1)
    shard = F.floor(F.col("place") * shards / F.lit(max(1, total)).cast("decimal(20,0)")).cast("int")
    placed = placed.withColumn("shard", shard)
    first = F.expr(f"(shard * {total}L + {shards - 1}) div {shards}")
    return placed.select(F.col("key").alias(key), "size", "text_crc32", F.lit("rows").alias("law"), "shard", (F.col("place") - first).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return assign(spark.read.parquet(f"{sf_dir}/documents.parquet"))
