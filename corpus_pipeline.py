"""The corpus pipeline: documents pass its stages in order, each written as Parquet and read again by the next."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from netloom.llm import op2_bpe, op5_jaccard_join, op6_decontaminate, op8_toxicity, op9_secrets
from netloom.llm.common import columns, fold, staged

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier scores under 0.5. It learns from labels of the documents that it is given."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    model = op8_toxicity.train(docs, labels.filter(fold(F.col("doc_id")) != 0))
    return op8_toxicity.predict(docs, model, keep=COLUMNS).filter("score < 0.5").select(*COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group that links of similarity 0.8 or more over five-word shingles join: the least doc_id."""
    return op5_jaccard_join.deduplicated(columns(docs, *COLUMNS))


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a benchmark item, be its numbers, names and units changed or not."""
    return op6_decontaminate.cleaned(columns(docs, *COLUMNS), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, their secrets replaced by a mark; n_chars follows the text."""
    out = op9_secrets.redacted(columns(docs, *COLUMNS), op9_secrets.train(docs))
    return out.withColumn("n_chars", F.when(F.col("text").isNull(), F.col("n_chars")).otherwise(F.length("text").cast(docs.schema["n_chars"].dataType)))


def bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document, with digests of the ids and of the decoded bytes."""
    ranks = op2_bpe.read_ranks(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))
    return op2_bpe.digests(docs, ranks, public_tokenizers.PATTERN, with_ids=True)


STAGES = [("toxicity", toxicity), ("n-gram Jaccard join", near_duplicates), ("benchmark decontamination", decontamination), ("secret scans", secrets), ("byte-level BPE", bpe)]

#: SQL can express neither the classifier nor the tokenizer; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = staged(stage(spark, docs, sf_dir), "stage-" + name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
