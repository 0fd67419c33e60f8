"""Where the corpus operators cut lineage: reliable checkpoints in the folder the cluster names."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def folder(spark: SparkSession) -> str:
    """Where checkpoints go: spark.checkpoint.dir. Where that is unset a folder is made in local mode, as in tests; a cluster must
    name one that its machines share."""
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        named = spark.conf.get("spark.checkpoint.dir", None)
        if named is None and not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        context.setCheckpointDir(named or tempfile.mkdtemp(prefix="checkpoints"))
    return context.getCheckpointDir()


def cut(df: DataFrame, parts: int | None = None) -> DataFrame:
    """``df`` written to that folder and read back. Spark removes what is no longer referred to if the session sets
    spark.cleaner.referenceTracking.cleanCheckpoints.

    parts: at most so many partitions, for tables that are small beside what they come from; each costs files in every
    shuffle that follows. Callers take it from the size of the input.
    """
    folder(df.sparkSession)
    return (df.coalesce(parts) if parts else df).checkpoint()


def stored(df: DataFrame) -> DataFrame:
    """``df`` as Parquet in that folder, in a place of its own, and reread."""
    path = f"{folder(df.sparkSession)}/stored-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)
