"""Where facts come from: the first event that says a fact, how it is known, and references down to a source's line."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import forms, titles
from ..functions import text as T
from ..functions.goals import source_key

#: How a fact is known, by priority: what users correct and say, literals kept for search, what is told as reusable, the rest.
LABELS = ["natural_user_correction", "natural_user", "retrieval_literal", "explicit_reusable_fact", "natural_assistant"]


def event_keys(events: DataFrame) -> DataFrame:
    """session, position, rank, key: every form in which events (session, position, role, text) say something.

    Rank 1 are a user's text, what of it may last and what it states as the user's wish; rank 2 are anyone's text and what of it
    may last. Forms are compact, lower-case and without `reusable fact:`; empty ones don't count.
    """
    formed = events.select("session", "position", "role", source_key(F.col("text")).alias("own"), titles.durable_user_text(F.col("text")).alias("of_user"), forms.natural_memory(F.col("text")).alias("natural"), titles.durable_text(F.col("text")).alias("durable"))
    said = F.array(*(F.struct(F.lit(rank).alias("rank"), c.alias("key")) for rank, c in ((2, F.col("own")), (2, source_key(F.col("durable"))))))
    by_user = F.array(*(F.struct(F.lit(1).alias("rank"), c.alias("key")) for c in (F.col("own"), source_key(F.col("of_user")), source_key(F.col("natural")))))
    return formed.select("session", "position", F.inline(F.when(F.col("role") == "user", F.concat(by_user, said)).otherwise(said))).filter("key <> ''").distinct()


def source_events(facts: DataFrame, events: DataFrame) -> DataFrame:
    """`facts` (session, text) with the position of the event that says each first: users' events go before others', then
    order counts. Null where no event says it.

    The first event of each session and key is a minimum with partial sums, so a session of any length and a saying of any
    frequency are summed up before they meet a fact.
    """
    first = event_keys(events).groupBy("session", "key").agg(F.min(F.struct("rank", "position")).alias("first"))
    asked = facts.withColumn("key", source_key(F.col("text")))
    return asked.join(first, ["session", "key"], "left").select(*facts.columns, F.col("first.position").alias("source_position"))


def labelled_facts(facts: DataFrame, events: DataFrame, known: dict[str, DataFrame]) -> DataFrame:
    """`facts` (session, text) with a label of LABELS, the first that fits; facts without words are left out.

    `known` has facts (session, text) of the first three labels, each optional. A fact is reusable if a sentence of an event
    that isn't a user's says `reusable fact:` of it.
    """
    key = lambda c: T.text_key(F.col(c))
    told = events.filter("role <> 'user'").select("session", F.explode(forms.sentences(F.col("text"))).alias("part"))
    reusable = told.filter(F.lower("part").startswith("reusable fact")).select("session", titles._fact(F.col("part")).alias("text"), F.col("part").alias("part")).filter("text <> part")
    ranked = None
    for label, rows in {**known, LABELS[3]: reusable.select("session", "text")}.items():
        one = rows.select("session", key("text").alias("key"), F.lit(LABELS.index(label)).alias("rank"))
        ranked = one if ranked is None else ranked.unionByName(one)
    best = ranked.filter("key <> ''").groupBy("session", "key").agg(F.min("rank").alias("rank"))
    asked = facts.withColumn("key", key("text")).filter("key <> ''")
    name = F.element_at(T.words(LABELS), F.coalesce("rank", F.lit(len(LABELS) - 1)) + 1)
    return asked.join(best, ["session", "key"], "left").select(*facts.columns, name.alias("source"))


# References.

#: What a reference must not hold: control characters, an absolute or climbing path.
_UNSAFE_PATH = r"[\x00-\x1f\x7f]|^/|^~|^[A-Za-z]:|(?:^|/)\.\.?(?:/|$)|\\|//|/$"
_ANCHOR = r"^[0-9a-f]{16}$"


def anchor_id(record_sha256: Column, line: Column, ordinal: Column, event_sha256: Column) -> Column:
    """The anchor of an event: a hash over its record, line, place in the line and text."""
    return F.left(F.sha2(F.concat_ws("\n", record_sha256, line.cast("string"), ordinal.cast("string"), event_sha256), 256), F.lit(16))


def line_index(records: DataFrame) -> DataFrame:
    """path, record_sha256, line, ordinal, event_sha256, text of the events of records (path, lines: array of arrays of texts)."""
    lines = records.select("path", "record_sha256", F.posexplode("lines").alias("line0", "events"))
    each = lines.select("path", "record_sha256", (F.col("line0") + 1).cast("long").alias("line"), F.posexplode("events").alias("ordinal0", "text"))
    return each.select("path", "record_sha256", "line", (F.col("ordinal0") + 1).cast("long").alias("ordinal"), F.sha2(F.coalesce("text", F.lit("")), 256).alias("event_sha256"), "text")


def resolved_references(refs: DataFrame, anchors: DataFrame, index: DataFrame, authorized: bool = True) -> DataFrame:
    """`refs` (ref_id, raw_ref) with status, reason and preview, by following each down to its line.

    raw_ref is `path#anchor`; anchors are (path, anchor, record_sha256, line, ordinal, event_sha256) as they were written; index is
    what the records hold now (line_index). In this order: blocked for an unsafe path or a sensitive anchor; unavailable if
    the record, the anchor or its line is missing, or the anchor is of an old form; blocked if the anchor's fields don't give
    its id, the record has changed, or the event at that line has; else available, with a short redacted preview if
    authorized. Joins go by path and anchor, and by path, line and place; a reference is never looked up by scanning a record.
    """
    at = forms.source_ref(F.col("raw_ref"))
    parsed = refs.withColumn("_at", at).select(*refs.columns, F.coalesce("_at.path", F.lit("")).alias("_path"), F.coalesce("_at.anchor", F.lit("")).alias("_anchor"))
    written = anchors.select(F.col("path").alias("_path"), F.col("anchor").alias("_anchor"), *(F.col(c).alias(f"_was_{c}") for c in ("record_sha256", "line", "ordinal", "event_sha256")))
    there = index.groupBy(F.col("path").alias("_path")).agg(F.first("record_sha256").alias("_now_record"))
    now = index.select(F.col("path").alias("_path"), F.col("line").alias("_was_line"), F.col("ordinal").alias("_was_ordinal"), F.col("event_sha256").alias("_now_event"), F.col("text").alias("_text"))
    joined = parsed.join(there, "_path", "left").join(written, ["_path", "_anchor"], "left").join(now, ["_path", "_was_line", "_was_ordinal"], "left")
    unsafe = (F.col("_path") == "") | F.col("_path").rlike(_UNSAFE_PATH) | F.col("_anchor").rlike(r"[\x00-\x1f\x7f]") | F.col("_anchor").rlike(T.UNSAFE_DISPLAY)
    checks = [
        (unsafe, "blocked", "unsafe_source_ref"),
        (F.col("_now_record").isNull(), "unavailable", "source_ref_not_in_archive"),
        (~F.col("_anchor").rlike(_ANCHOR), "unavailable", "legacy_source_anchor_unavailable"),
        (F.col("_was_record_sha256").isNull(), "unavailable", "source_anchor_unavailable"),
        (anchor_id(F.col("_was_record_sha256"), F.col("_was_line"), F.col("_was_ordinal"), F.col("_was_event_sha256")) != F.col("_anchor"), "blocked", "source_anchor_mismatch"),
        (F.col("_was_record_sha256") != F.col("_now_record"), "blocked", "source_hash_mismatch"),
        (F.col("_now_event").isNull(), "unavailable", "source_anchor_missing"),
        (F.col("_was_event_sha256") != F.col("_now_event"), "blocked", "source_event_mismatch"),
    ]
    status, reason = F.lit("available"), F.lit("source_line_verified")
    for found, s, r in reversed(checks):
        status, reason = F.when(found, s).otherwise(status), F.when(found, r).otherwise(reason)
    told = joined.withColumn("status", status).withColumn("reason", reason)
    preview = F.when(F.col("status") == "available", T.preview(F.col("_text"))) if authorized else F.lit(None).cast("string")
    return told.select(*refs.columns, "status", "reason", preview.alias("preview"))
