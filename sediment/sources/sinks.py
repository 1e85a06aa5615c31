"""Sinks: tables of nodes and sessions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def write_nodes(nodes: DataFrame, folder: str, format: str = "parquet") -> None:
    """Nodes by file group: explicit ones apart, others by layer."""
    group = F.when(F.col("source") == "explicit", "explicit").otherwise(F.col("layer"))
    nodes.withColumn("node_file", group).write.mode("overwrite").partitionBy("node_file").format(format).save(folder)


def write_json_table(df: DataFrame, folder: str, overwrite: bool = True) -> None:
    """A JSON Lines table; without `overwrite` an existing one is an error."""
    df.write.mode("overwrite" if overwrite else "errorifexists").json(folder)


def daily_summaries(df: DataFrame, day: str, *counts: str) -> DataFrame:
    """Rows per day and the given columns."""
    return df.groupBy(day, *counts).agg(F.count(F.lit(1)).alias("n_rows"))
