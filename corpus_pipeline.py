"""A corpus pipeline of five stages over ``documents``: quality, exact copies, near copies, benchmark passages, packing.

Each stage takes all that the one before kept, with the columns of ``documents``; the last returns the packed pieces. An
empty table passes through all stages; rows with null texts are scored as empty texts and, if they stay, count as copies of
the empty text. Of rows that repeat identifier and text one stays; equal texts keep their largest identifier, near copies
their smallest. Very long texts are judged whole and packed in pieces. Other columns than those of COLUMNS don't enter.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tickspark.llm import decontaminate, exact_dedup, ngram_join, packing, quality
from tickspark.llm.spill import stored

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects what the classifier, fitted on the labelled part of ``docs``, scores below its threshold."""
    docs = docs.select(*COLUMNS)
    return quality.keep_good(docs, quality.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


def exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps of equal texts the row with the largest identifier."""
    return exact_dedup.exact_dedup(docs, smallest=False)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps of each group of near copies the document with the smallest identifier."""
    return ngram_join.near_dedup(docs)


def benchmark_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects contaminated documents."""
    return decontaminate.decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs what is left into sequences."""
    return packing.pack(docs)


STAGES = [
    ("quality", good_quality),
    ("exact_dedup", exact_copies),
    ("near_dedup", near_copies),
    ("decontaminate", benchmark_passages),
    ("packing", packed),
]

#: SQL can't express the fitted classifier nor best-fit packing.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; what a stage keeps is written as Parquet to spark.checkpoint.dir before the next one reads it."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
