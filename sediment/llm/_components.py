"""Connected components of a table of links, by least neighbours and pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import Scratch, written


def components(links: DataFrame, a: str, b: str) -> DataFrame:
    """node, label: the smallest node that each linked node reaches. Nodes without links are absent.

    A round gives each node the least label among its neighbours and then that label's own label. Minima are summed up
    before the shuffle and joins are of a kind that Spark splits where a key is hot, so a hub is no bottleneck; each
    round is written, which cuts the lineage.
    """
    with Scratch(links.sparkSession) as scratch:
        one = links.select(F.col(a).alias("node"), F.col(b).alias("other"))
        both = written(one.unionByName(one.select(F.col("other").alias("node"), F.col("node").alias("other"))).distinct(), "links")
        labels = written(both.groupBy("node").agg(F.least(F.col("node"), F.min("other")).alias("label")), "labels")
        while True:
            near = both.join(labels.select(F.col("node").alias("other"), F.col("label").alias("its")), "other").groupBy("node").agg(F.min("its").alias("its"))
            least = labels.join(near, "node").select("node", F.col("label").alias("before"), F.least("label", "its").alias("least"))
            jump = labels.select(F.col("node").alias("least"), F.col("label").alias("further"))
            after = written(least.join(jump, "least").select("node", "before", F.least("least", "further").alias("label")), "labels")
            labels = after.select("node", "label")
            if after.filter("label <> before").isEmpty():
                scratch.keep(after)
                return labels
