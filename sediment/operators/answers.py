"""Answers drawn from memory texts: the span behind a prefix, or abstention."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T

# What is said where memory doesn't answer, what an answer stands behind, and what ends it.
ABSTENTION = "There is not enough information in memory to answer."
PREFIX = r"(?i)\bReference answer:\s*"
BOUNDARY = r"(?i)\s+\b(?:Expected memory|Query|Reference evidence|Synthetic answer target):"


def trimmed_answer(answer: Column, query: Column) -> Column:
    """An answer up to the next section, and up to where it echoes the query (not if it begins with it)."""
    asked = T.compact_whitespace(F.coalesce(query, F.lit("")))

    def ended(x: Column) -> Column:
        at = F.instr(F.lower(x), F.lower(asked))
        return F.btrim(F.when((asked != "") & (at > 1), F.left(x, at - 1)).otherwise(x), F.lit(" ."))

    cut = T.let(answer, lambda x: T.let(F.regexp_instr(x, F.lit(BOUNDARY)), lambda at: F.when(at > 0, F.left(x, at - 1)).otherwise(x)))
    return T.let(cut, ended)


def extracted_answer(text: Column, query: Column) -> Column:
    """What a memory text answers: the span behind the prefix, trimmed; the whole text without one; ABSTENTION for nothing, null
    and what must not be shown."""

    def drawn(flat: Column) -> Column:
        at = F.regexp_instr(flat, F.lit(PREFIX))
        behind = F.substring(flat, at + F.length(F.regexp_extract(flat, PREFIX, 0)), F.length(flat))
        return F.when(at > 0, trimmed_answer(behind, query)).otherwise(flat)

    flat = T.compact_whitespace(F.coalesce(text, F.lit("")))
    return T.let(T.compact_whitespace(T.let(flat, drawn)), lambda x: F.when((x == "") | x.rlike(T.UNSAFE_DISPLAY), F.lit(ABSTENTION)).otherwise(x))


def answer_records(cases: DataFrame, hits: DataFrame) -> DataFrame:
    """case_id, memory_id, answer, verdict of each case (case_id, query, expected; null: abstain) from its best hit.

    hits (case_id, memory_id, score, text, supported) count where they are supported; the best has the greatest score, then the
    smallest id. verdict is right or wrong for an answer, by the expected text as it stands in it or normalised; abstained where
    abstention was due, missed where it wasn't. The best hit of a case is a maximum with partial sums.
    """
    best = hits.filter("supported").groupBy("case_id").agg(F.min(F.struct((-F.col("score")).alias("rank"), "memory_id", "text")).alias("best"))
    found = cases.join(best, "case_id", "left").withColumn("answer", F.when(F.col("best").isNotNull(), extracted_answer(F.col("best.text"), F.col("query"))).otherwise(ABSTENTION))
    silent, due = F.col("answer") == ABSTENTION, F.col("expected").isNull()
    holds = F.contains("answer", F.col("expected")) | ((T.normalized_answer(F.col("expected")) != "") & F.contains(T.normalized_answer(F.col("answer")), T.normalized_answer(F.col("expected"))))
    verdict = F.when(silent & due, "abstained").when(silent, "missed").when(due, "wrong").when(holds, "right").otherwise("wrong")
    return found.select("case_id", F.col("best.memory_id").alias("memory_id"), "answer", verdict.alias("verdict"))
