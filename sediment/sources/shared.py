"""Lineage cut through the folder that driver and executors share."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame


def cut(df: DataFrame) -> DataFrame:
    """`df` written to the session's checkpoint folder and read again. Local mode (tests) makes a folder where none is named;
    a cluster must name one."""
    spark = df.sparkSession
    context = spark.sparkContext
    if context._jsc.sc().getCheckpointDir().isEmpty():
        given = spark.conf.get("spark.checkpoint.dir", None)
        if not given:
            if not context.master.startswith("local") or context.master.startswith("local-cluster"):
                raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
            given = "file://" + tempfile.mkdtemp(prefix="spark-sediment-")
        context.setCheckpointDir(given)
    return df.checkpoint()
