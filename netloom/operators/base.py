"""Checkpoints and small helpers of the operators."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: that of ``spark.checkpoint.dir``. Where the setting is absent (tests, one
    machine) one is made."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        path = "file://" + tempfile.mkdtemp(prefix="netloom-")
        spark.conf.set("spark.checkpoint.dir", path)
    return path


def cut(df: DataFrame, *old: DataFrame) -> DataFrame:
    """Cut the lineage of an iterative plan: write it to the folder that all executors share and read it again. Unlike the
    session's checkpoints such a table brings no constraints along, which double each round where a table is joined with itself,
    and its true size lets small sides be broadcast. The files of ``old``, tables of earlier calls that nothing else reads any
    more, are deleted afterwards."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/cut-{uuid.uuid4().hex}"
    df.write.parquet(path)
    for o in old:
        dropped(o)
    out = spark.read.schema(df.schema).parquet(path)
    out.folder = path
    return out


def dropped(df: DataFrame) -> None:
    """Delete the files of a table that ``cut`` has written."""
    spark = df.sparkSession
    folder = spark._jvm.org.apache.hadoop.fs.Path(df.folder)
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
