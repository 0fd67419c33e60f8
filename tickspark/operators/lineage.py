"""Where iterative operators cut lineage: reliable checkpoints in the folder the cluster names."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame


def settled(df: DataFrame) -> DataFrame:
    """``df`` written to spark.checkpoint.dir and read back, so that later rounds survive a lost executor without running the
    earlier ones again. In local mode, as in tests, a folder is made if none is named."""
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        named = df.sparkSession.conf.get("spark.checkpoint.dir", None)
        if named is None and not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        context.setCheckpointDir(named or tempfile.mkdtemp(prefix="checkpoints"))
    return df.checkpoint()
