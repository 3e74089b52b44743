"""Cutting lineage in iterative plans."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame


def cut(df: DataFrame) -> DataFrame:
    """df, checkpointed in the folder that spark.checkpoint.dir names; where that is unset, in one of our own if the session is local, else an error."""
    context = df.sparkSession.sparkContext
    if not context.getCheckpointDir():
        found = df.sparkSession.conf.get("spark.checkpoint.dir", None)
        if not found and not context.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        context.setCheckpointDir(found or f"/tmp/checkpoints/{uuid.uuid4().hex}")
    return df.checkpoint()
