"""Geometry derived from the star-schema tables' keys by integer arithmetic, the same in Spark and in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.base import table

#: A square of about a kilometre; coordinates have one decimal.
TERMINALS_SQL = "terminals AS (SELECT c_custkey AS id, (c_custkey * 7919 % 10007) / 10.0::DOUBLE AS px, (c_custkey * 104729 % 10007) / 10.0::DOUBLE AS py FROM customer)"
TIES_SQL = "ties AS (SELECT s_suppkey AS tie, (s_suppkey * 7907 % 10007) / 10.0::DOUBLE AS qx, (s_suppkey * 15485863 % 10007) / 10.0::DOUBLE AS qy FROM supplier)"
#: Rectangles of 0.4 to 20 m; a part's kind follows its key.
BLOCKS_SQL = "blocks AS (SELECT p_partkey AS block, (p_partkey * 7901 % 10007) / 10.0::DOUBLE AS x0, (p_partkey * 86028121 % 10007) / 10.0::DOUBLE AS y0, (p_partkey * 7901 % 10007) / 10.0::DOUBLE + p_size * 0.4::DOUBLE AS x1, (p_partkey * 86028121 % 10007) / 10.0::DOUBLE + p_size * 0.2::DOUBLE AS y1, CASE WHEN p_partkey % 2 = 0 THEN 'oks' ELSE 'water' END AS kind FROM part)"
SIDES_SQL = "sides AS (SELECT block, kind, 1 AS side, x0 AS cx, y0 AS cy, x1 AS dx, y0 AS dy FROM blocks UNION ALL SELECT block, kind, 2, x1, y0, x1, y1 FROM blocks UNION ALL SELECT block, kind, 3, x1, y1, x0, y1 FROM blocks UNION ALL SELECT block, kind, 4, x0, y1, x0, y0 FROM blocks)"
#: Service leads: from each terminal 30 m in one of four directions.
LEADS_SQL = "leads AS (SELECT id, px AS ax, py AS ay, px + CASE id % 4 WHEN 0 THEN 30.0 WHEN 1 THEN -30.0 ELSE 0.0 END AS bx, py + CASE id % 4 WHEN 2 THEN 30.0 WHEN 3 THEN -30.0 ELSE 0.0 END AS \"by\" FROM terminals)"
#: A user's events in order are the vertices of a line.
VERTICES_SQL = "vertices AS (SELECT user_id AS line, event_id AS pos, event_id::DOUBLE AS x, value AS y FROM events)"


def terminals(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("c_custkey")
    return table(spark, d, "customer").select(k.alias("id"), (k * 7919 % 10007 / F.lit(10.0)).alias("px"), (k * 104729 % 10007 / F.lit(10.0)).alias("py"))


def ties(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("s_suppkey")
    return table(spark, d, "supplier").select(k.alias("tie"), (k * 7907 % 10007 / F.lit(10.0)).alias("qx"), (k * 15485863 % 10007 / F.lit(10.0)).alias("qy"))


def blocks(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("p_partkey")
    x, y = k * 7901 % 10007 / F.lit(10.0), k * 86028121 % 10007 / F.lit(10.0)
    return table(spark, d, "part").select(k.alias("block"), x.alias("x0"), y.alias("y0"), (x + F.col("p_size") * 0.4).alias("x1"), (y + F.col("p_size") * 0.2).alias("y1"), F.when(k % 2 == 0, "oks").otherwise("water").alias("kind"))


def sides(blocks: DataFrame) -> DataFrame:
    c = {k: F.col(k) for k in ("x0", "y0", "x1", "y1")}
    leg = lambda i, a, b: F.struct(F.lit(i).alias("side"), c[a[0]].alias("cx"), c[a[1]].alias("cy"), c[b[0]].alias("dx"), c[b[1]].alias("dy"))
    four = F.array(leg(1, ("x0", "y0"), ("x1", "y0")), leg(2, ("x1", "y0"), ("x1", "y1")), leg(3, ("x1", "y1"), ("x0", "y1")), leg(4, ("x0", "y1"), ("x0", "y0")))
    return blocks.select("block", "kind", F.explode(four).alias("s")).select("block", "kind", "s.*")


def leads(terminals: DataFrame) -> DataFrame:
    m = F.col("id") % 4
    return terminals.select("id", F.col("px").alias("ax"), F.col("py").alias("ay"), (F.col("px") + F.when(m == 0, 30.0).when(m == 1, -30.0).otherwise(0.0)).alias("bx"), (F.col("py") + F.when(m == 2, 30.0).when(m == 3, -30.0).otherwise(0.0)).alias("by"))


def vertices(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").select(F.col("user_id").alias("line"), F.col("event_id").alias("pos"), F.col("event_id").cast("double").alias("x"), F.col("value").alias("y"))


def lines(spark: SparkSession, d: str) -> DataFrame:
    """One row a user: its vertices as an array of points."""
    v = vertices(spark, d).groupBy("line").agg(F.array_sort(F.collect_list(F.struct("pos", "x", "y"))).alias("v"))
    return v.select("line", F.transform("v", lambda p: F.struct(p.x.alias("x"), p.y.alias("y"))).alias("points"))
