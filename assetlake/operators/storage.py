"""Tables written on the way, in the folder that driver and executors share."""

from __future__ import annotations

from pyspark.sql import DataFrame


def written(df: DataFrame) -> DataFrame:
    """df written to the folder in spark.checkpoint.dir and read again: its lineage ends, and lost executors
    cost nothing. Only a session on a single machine may go without the setting."""
    context = df.sparkSession.sparkContext
    if not context._jsc.sc().getCheckpointDir().isDefined():
        folder = context.getConf().get("spark.checkpoint.dir")
        if not folder and not (context.master == "local" or context.master.startswith("local[")):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        context.setCheckpointDir(folder or "file:///tmp/assetlake-checkpoint")
    return df.checkpoint()
