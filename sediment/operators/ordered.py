"""Ordered sessions of any length: running values and sliding windows over blocks of a session.

A session is cut into blocks of `size` positions. What a block hands on (sums, last rows) is worked out per block with partial
sums, carried over the few blocks of a session, and given to each block; windows then run within blocks. No task holds more of
a session than a block, however long the session is.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SIZE = 4096


def _blocks(rows: DataFrame, order: str, size: int) -> DataFrame:
    return rows.withColumn("_block", F.floor(F.col(order) / size).cast("long"))


def running(rows: DataFrame, key: str, order: str, sums: dict[str, Column], lasts: dict[str, Column] = {}, size: int = SIZE) -> DataFrame:  # noqa: B006  not changed
    """`rows` with running sums up to and with each row, and the greatest value of each of `lasts` before it (null ones don't
    count; a struct that begins with the position gives the last). Positions of a session are distinct."""
    cut = _blocks(rows, order, size).withColumns({f"_s_{k}": c for k, c in sums.items()} | {f"_l_{k}": c for k, c in lasts.items()})
    of_block = cut.groupBy(key, "_block").agg(*(F.sum(f"_s_{k}").alias(f"_p_{k}") for k in sums), *(F.max(f"_l_{k}").alias(f"_q_{k}") for k in lasts))
    before = Window.partitionBy(key).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    carried = of_block.select(key, "_block", *(F.coalesce(F.sum(f"_p_{k}").over(before), F.lit(0)).alias(f"_p_{k}") for k in sums), *(F.max(f"_q_{k}").over(before).alias(f"_q_{k}") for k in lasts))
    so_far = Window.partitionBy(key, "_block").orderBy(order)
    joined = cut.join(carried, [key, "_block"])
    out = joined.withColumns(
        {k: F.col(f"_p_{k}") + F.sum(f"_s_{k}").over(so_far.rowsBetween(Window.unboundedPreceding, 0)) for k in sums}
        | {k: F.coalesce(F.max(f"_l_{k}").over(so_far.rowsBetween(Window.unboundedPreceding, -1)), F.col(f"_q_{k}")) for k in lasts}
    )
    return out.select(*rows.columns, *sums, *lasts)


def sliding(rows: DataFrame, key: str, order: str, value: Column, width: int, name: str, size: int = SIZE) -> DataFrame:
    """`rows` with an array of `value` (a struct that begins with the position) of each row and its width - 1 predecessors.

    Blocks overlap: each gets the last rows before it. A block that is there has a row at least, so those lie in the width - 1
    blocks before."""
    cut = _blocks(rows, order, size).withColumn("_v", value)
    last = cut.groupBy(key, "_block").agg(F.slice(F.sort_array(F.collect_list("_v"), asc=False), 1, width - 1).alias("_last"))
    near = Window.partitionBy(key).orderBy("_block").rowsBetween(1 - width, -1)
    given = last.withColumn("_near", F.slice(F.sort_array(F.flatten(F.collect_list("_last").over(near)), asc=False), 1, width - 1))
    extra = given.withColumn("_v", F.explode("_near")).select(key, "_block", "_v", F.lit(True).alias("_extra"))
    both = cut.withColumn("_extra", F.lit(False)).unionByName(extra, allowMissingColumns=True)
    here = Window.partitionBy(key, "_block").orderBy(F.col("_v")).rowsBetween(1 - width, 0)
    return both.withColumn(name, F.collect_list("_v").over(here)).filter(~F.col("_extra")).select(*rows.columns, name)
