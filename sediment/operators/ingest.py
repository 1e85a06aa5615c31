"""Incremental ingestion: high-water marks, freshness, retry ledger, latest rows, session roll-ups."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def high_water(archived: DataFrame) -> DataFrame:
    """partition, high_water, n_records of the archived records (partition, path, updated_at, sha256)."""
    return archived.groupBy("partition").agg(F.max("updated_at").alias("high_water"), F.count(F.lit(1)).alias("n_records"))


def select_fresh(records: DataFrame, archived: DataFrame, ledger: DataFrame) -> DataFrame:
    """Records to ingest, by partition: newer than the high-water mark, changed, or pending in the ledger.

    A record older than the mark is skipped unless its path is archived under another hash; one at the mark is skipped if
    its hash is known. Pending paths (ledger: partition, path) always pass, and so does all of a partition never archived.
    """
    known = archived.groupBy("partition", "path").agg(F.collect_set("sha256").alias("_own"))
    hashes = archived.select("partition", F.col("sha256"), F.lit(True).alias("_seen")).distinct()
    out = (
        records.join(high_water(archived).select("partition", "high_water"), "partition", "left")
        .join(known, ["partition", "path"], "left")
        .join(hashes, ["partition", "sha256"], "left")
        .join(ledger.select("partition", "path", F.lit(True).alias("_pending")).distinct(), ["partition", "path"], "left")
    )
    changed = F.col("_own").isNotNull() & ~F.array_contains("_own", F.col("sha256"))
    old = (F.col("updated_at") < F.col("high_water")) & ~F.coalesce(changed, F.lit(False))
    again = (F.col("updated_at") == F.col("high_water")) & F.col("_seen").isNotNull()
    skipped = F.col("_pending").isNull() & (old | again)
    return out.filter(~F.coalesce(skipped, F.lit(False))).select(*records.columns)


def updated_ledger(ledger: DataFrame, add: DataFrame, remove: DataFrame) -> DataFrame:
    """The retry ledger with paths added and, after that, others removed."""
    keys = ["partition", "path"]
    return ledger.select(*keys).unionByName(add.select(*keys)).distinct().join(remove.select(*keys).distinct(), keys, "left_anti")


def latest_rows(df: DataFrame, keys: list[str], *order: str) -> DataFrame:
    """The last row of each key by `order`, as a partial aggregate: a hot key doesn't gather."""
    rest = [c for c in df.columns if c not in keys]
    best = F.max(F.struct(*order, *(c for c in rest if c not in order))).alias("_row")
    return df.groupBy(*keys).agg(best).select(*keys, *(F.col(f"_row.{c}").alias(c) for c in rest))


def replace_sources(sessions: DataFrame, incoming: DataFrame, keys: list[str]) -> DataFrame:
    """Sessions without those of the incoming sources, and the incoming ones: a merge by source."""
    return sessions.join(incoming.select(*keys).distinct(), keys, "left_anti").unionByName(incoming, allowMissingColumns=True)


def event_anchors(events: DataFrame, *key: str, text: str = "text") -> DataFrame:
    """Adds event_sha256 and source_anchor_id (16 hex digits of key and hash) to events."""
    hashed = events.withColumn("event_sha256", F.sha2(F.coalesce(F.col(text), F.lit("")), 256))
    return hashed.withColumn("source_anchor_id", F.substring(F.sha2(F.concat_ws("\n", *(F.col(k).cast("string") for k in key), "event_sha256"), 256), 1, 16))


def session_rollup(events: DataFrame) -> DataFrame:
    """One row per session of events (session, ordinal, kind, text): counts, intent, final state, last five user texts."""
    user, helper = F.col("kind") == "user", F.col("kind") == "assistant"
    last = Window.partitionBy("session", "kind").orderBy(F.desc("ordinal"))
    recent = events.filter(user).withColumn("_place", F.row_number().over(last)).filter("_place <= 5").groupBy("session").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ordinal", "text"))), lambda x: x["text"]), "\n").alias("recent_user"))
    sums = events.groupBy("session").agg(
        F.count(F.lit(1)).alias("n_events"),
        F.count_if(user).alias("n_user"),
        F.min_by("text", F.when(user, F.col("ordinal"))).alias("user_intent"),
        F.max_by("text", F.when(helper, F.col("ordinal"))).alias("final_state"),
    )
    return sums.join(recent, "session", "left")
