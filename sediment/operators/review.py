"""The review queue: candidates with fingerprints, decisions held against them, compression of pairs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import filters
from . import consolidate

#: Relations that go to review, and the reason they are queued under.
REASONS = {"contradiction": "conflicting", "contradiction_review": "conflicting", "scope_review": "scope_change", "overlap_review": "low_confidence"}


def review_candidates(relations: DataFrame) -> DataFrame:
    """candidate_id, current_id, old_id, reason, fingerprint of related pairs; a partial supersession needs no review."""
    reason = F.create_map(*[F.lit(x) for pair in REASONS.items() for x in pair])[F.col("relation")]
    pair = F.concat_ws("|", F.col("current_id").cast("string"), F.col("old_id").cast("string"))
    queued = relations.withColumn("reason", reason).filter(F.col("reason").isNotNull())
    return queued.select(F.sha2(pair, 256).alias("candidate_id"), "current_id", "old_id", "reason", F.sha2(F.concat_ws("|", pair, "relation"), 256).alias("fingerprint"))


def decision_status(decisions: DataFrame, candidates: DataFrame) -> DataFrame:
    """decision_id and status of decisions (decision_id, candidate_id, fingerprint, action).

    conflicting: other decisions of the candidate say otherwise; duplicate: an earlier one says the same; unknown: no such
    candidate; stale: it has changed since; unsafe: no known action; else applied (approve) or ignored (ignore).
    """
    said = decisions.groupBy("candidate_id").agg(F.count_distinct("action").alias("_actions"), F.min("decision_id").alias("_first"))
    now = candidates.select("candidate_id", F.col("fingerprint").alias("_now"))
    status = (
        F.when(F.col("_actions") > 1, "conflicting")
        .when(F.col("decision_id") != F.col("_first"), "duplicate")
        .when(F.col("_now").isNull(), "unknown")
        .when(~F.col("fingerprint").eqNullSafe(F.col("_now")), "stale")
        .when(F.col("action") == "approve", "applied")
        .when(F.col("action") == "ignore", "ignored")
        .otherwise("unsafe")
    )
    return decisions.join(said, "candidate_id").join(now, "candidate_id", "left").select("decision_id", status.alias("status"))


def pending(candidates: DataFrame, statuses: DataFrame, decisions: DataFrame) -> DataFrame:
    """Candidates that no applied or ignored decision has settled."""
    settled = decisions.join(statuses.filter(F.col("status").isin("applied", "ignored")), "decision_id", "left_semi").select("candidate_id")
    return candidates.join(settled, "candidate_id", "left_anti")


def compressed_pairs(candidates: DataFrame) -> DataFrame:
    """One row per current fact and reason: the least older fact, and how many there are."""
    return candidates.groupBy("current_id", "reason").agg(F.min("old_id").alias("representative_id"), F.count(F.lit(1)).alias("n_older"))


def settled_nodes(nodes: DataFrame, removed: DataFrame, fields: list[str]) -> DataFrame:
    """Nodes without references to removed ids; one explode and one anti-join for all fields."""
    gone = removed.select(F.col("id").alias("ref")).distinct()
    refs = None
    for f in fields:
        one = nodes.select("id", F.lit(f).alias("field"), F.posexplode(f).alias("at", "ref"))
        refs = one if refs is None else refs.unionByName(one)
    lists = refs.join(gone, "ref", "left_anti").groupBy("id", "field").agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "ref"))), lambda x: x["ref"]).alias("refs"))
    wide = lists.groupBy("id").pivot("field", fields).agg(F.first("refs"))
    kept = nodes.join(removed.select("id").distinct(), "id", "left_anti").drop(*fields).join(wide, "id", "left")
    return kept.withColumns({f: F.coalesce(F.col(f), F.array().cast("array<string>")) for f in fields})


def induction_pairs(candidates: DataFrame) -> DataFrame:
    """current_class, old_class, relation, reason, n_current, n_older: classes of candidates (at, text, project) that must be
    reviewed together, as some member of the first is later than one of the second.

    `at` is a string that orders candidates, each its own (time, path and id, say). Members of a class have one consolidation
    key, and relations hold between classes, so pairs of members aren't written out; no pair is lost. Classes meet by their
    rarest tokens.
    """
    facts = candidates.select(F.col("at").alias("id"), "text")
    classes = consolidate.fact_classes(facts)
    sizes = classes.groupBy("class_id").agg(F.count(F.lit(1)).alias("n"))
    of = classes.select(F.col("id").alias("at"), F.col("class_id"))
    pairs = consolidate.related_pairs(facts)
    reason = F.create_map(*[F.lit(x) for pair in REASONS.items() for x in pair])[F.col("relation")]
    named = pairs.join(of.select(F.col("at").alias("current_id"), F.col("class_id").alias("current_class")), "current_id").join(of.select(F.col("at").alias("old_id"), F.col("class_id").alias("old_class")), "old_id")
    queued = named.withColumn("reason", reason).filter("reason is not null")
    counted = queued.join(sizes.select(F.col("class_id").alias("current_class"), F.col("n").alias("n_current")), "current_class").join(sizes.select(F.col("class_id").alias("old_class"), F.col("n").alias("n_older")), "old_class")
    return counted.select("current_class", "old_class", "relation", "reason", "n_current", "n_older")


def withheld_candidates(candidates: DataFrame, pairs: DataFrame) -> DataFrame:
    """at, status of the candidates that review holds back: direct (its own text asks for review), related (its class is in a
    pair), or released (related, but the class is backed by two projects or more)."""
    classes = consolidate.fact_classes(candidates.select(F.col("at").alias("id"), "text")).select(F.col("id").alias("at"), "class_id")
    known = candidates.select("at", F.nullif("project", F.lit("")).alias("project"), filters.reviewable(F.col("text")).alias("direct")).join(classes, "at", "left")
    touched = pairs.select(F.col("current_class").alias("class_id")).unionByName(pairs.select(F.col("old_class").alias("class_id"))).distinct().withColumn("touched", F.lit(True))
    backed = known.filter("class_id is not null").groupBy("class_id").agg(F.count_distinct("project").alias("projects"))
    status = F.when(F.col("direct"), "direct").when(F.col("touched") & (F.col("projects") >= 2), "released").when(F.col("touched"), "related")
    return known.join(touched, "class_id", "left").join(backed, "class_id", "left").select("at", status.alias("status")).filter("status is not null")
