"""Evidence of a session's summary: a few lines by priority, distinct, the last place kept for the final state."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import titles

#: Kinds of lines by priority. Pinned lines come first; users' plain lines only where nothing else is found.
KINDS = ["pinned", "natural", "decision", "literal", "fact", "problem", "unresolved", "user"]
#: Lines of evidence, and how many of the last natural facts count.
MOST, NATURAL = 6, 5
BUCKETS = 64


def _first(rows: DataFrame, keys: list[str], order: F.Column, most: int) -> DataFrame:
    """The first rows of each key by an order, `most` of them: first in buckets, then among the buckets' first."""
    bucket = F.pmod(F.xxhash64("position"), F.lit(BUCKETS))
    near = rows.withColumn("_bucket", bucket).withColumn("_place", F.row_number().over(Window.partitionBy(*keys, "_bucket").orderBy(order))).filter(F.col("_place") <= most)
    place = F.row_number().over(Window.partitionBy(*keys).orderBy(order))
    return near.withColumn("_place", place).filter(F.col("_place") <= most).drop("_bucket", "_place")


def summary_evidence(lines: DataFrame, finals: DataFrame) -> DataFrame:
    """session, evidence: at most MOST texts of each session of `lines` (session, position, kind, text) and `finals` (session,
    text).

    The last pinned lines come first, as often as they are there; then, each text once, the last natural facts, and decisions,
    literals, facts, problems and open tasks by position; only if all that is empty, users' lines. A place is left for the
    final state unless it is there already. Lines are brought into their durable form, and those without one don't count, but
    the last pinned and natural ones are chosen before. Positions of a session and kind are distinct.

    Of each kind only the first MOST distinct lines can matter: they are kept in buckets and then per session, so a long
    session is never gathered.
    """
    ends = finals.select("session", titles.durable_text(F.col("text")).alias("final"))
    known = lines.select("session", "position", "kind", "text")
    late = known.filter(F.col("kind").isin("pinned", "natural"))
    last = _first(late, ["session", "kind"], F.desc("position"), MOST)
    ranked = last.withColumn("_back", F.row_number().over(Window.partitionBy("session", "kind").orderBy(F.desc("position")))).join(ends, "session", "left")
    room = F.when(F.coalesce("final", F.lit("")) != "", MOST - 1).otherwise(MOST)
    chosen = ranked.filter(F.col("_back") <= F.when(F.col("kind") == "natural", F.lit(NATURAL)).otherwise(room)).select("session", "position", "kind", titles.durable_text(F.col("text")).alias("durable"))
    others = known.filter(~F.col("kind").isin("pinned", "natural")).select("session", "position", "kind", titles.durable_text(F.col("text")).alias("durable")).filter("durable <> ''")
    early = _first(others.groupBy("session", "kind", "durable").agg(F.min("position").alias("position")), ["session", "kind"], F.asc("position"), MOST)
    every = chosen.filter("durable <> ''").unionByName(early.select("session", "position", "kind", "durable"))
    rank = F.array_position(F.array(*map(F.lit, KINDS)), F.col("kind"))
    gathered = every.groupBy("session").agg(F.array_sort(F.collect_list(F.struct(rank.alias("rank"), "position", "durable"))).alias("found"))  # under 50 lines
    of = lambda some: F.transform(F.filter("found", some), lambda x: x["durable"])
    none = F.array().cast("array<string>")
    both = gathered.join(ends, "session", "full").select("session", F.coalesce("final", F.lit("")).alias("final"), F.coalesce(of(lambda x: x["rank"] == 1), none).alias("pinned"), F.coalesce(of(lambda x: (x["rank"] > 1) & (x["rank"] < len(KINDS))), none).alias("rest"), F.coalesce(of(lambda x: x["rank"] == len(KINDS)), none).alias("user"))
    new = (F.col("final") != "") & ~F.array_contains("pinned", F.col("final"))
    limit = MOST - new.cast("int")
    filled = F.concat("pinned", F.slice(F.array_except("rest", "pinned"), F.lit(1), F.greatest(limit - F.size("pinned"), F.lit(0))))
    told = both.withColumn("limit", limit).withColumn("filled", filled).withColumn("filled", F.when(F.size("filled") == 0, F.slice(F.array_distinct("user"), F.lit(1), F.col("limit"))).otherwise(F.col("filled")))
    ended = F.when((F.col("final") != "") & ~F.array_contains("filled", F.col("final")), F.array_append("filled", F.col("final"))).otherwise(F.col("filled"))
    return told.select("session", F.slice(ended, 1, MOST).alias("evidence"))
