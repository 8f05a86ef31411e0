"""Durable stages: tables that cut the lineage in storage that all executors share."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame


def settle(df: DataFrame) -> DataFrame:
    """The rows, computed once: a checkpoint in the folder that ``spark.checkpoint.dir`` names.

    Only a local master (tests) may do without that setting; it gets a
    temporary folder of its own.
    """
    spark = df.sparkSession
    context = spark.sparkContext
    if context._jsc.sc().getCheckpointDir().isEmpty():
        shared = spark.conf.get("spark.checkpoint.dir", None)
        if not shared and not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        context.setCheckpointDir(shared or tempfile.mkdtemp(prefix="claimlens-"))
    return df.checkpoint()
