"""Cutting lineage in the folder that all executors share."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame


def materialise(df: DataFrame) -> DataFrame:
    """``df``, written once to the session's checkpoint folder.

    The folder is the one that ``spark.checkpoint.dir`` names; only a local
    session without one gets a temporary folder.
    """
    session, context = df.sparkSession, df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        named = session.conf.get("spark.checkpoint.dir", "")
        if not named and not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        context.setCheckpointDir(named or tempfile.mkdtemp(prefix="checkpoint-"))
    return df.checkpoint(eager=True)
