"""Integrity audits: each returns findings, never changes data."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as T


def secret_lines(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, line_number (from 1), category of lines in which a preview would hide something."""
    lines = docs.filter(T.may_hide(F.lower(text))).select(key, F.posexplode(F.split(F.col(text), "\r?\n")).alias("at", "line")).filter(T.may_hide(F.lower("line")))
    found = F.filter(F.array(*(F.when(F.col("line").rlike(p), F.lit(c)) for c, p in T.PREVIEW_REDACTIONS.items())), lambda c: c.isNotNull())
    return lines.select(key, (F.col("at") + 1).alias("line_number"), F.explode(found).alias("category"))


def broken_references(checks: list[tuple[str, DataFrame, str, DataFrame, str]]) -> DataFrame:
    """name, n_rows, n_broken for each (name, child, column, parent, key): rows that refer to nothing. Nulls refer to nothing."""
    out = None
    for name, child, column, parent, key in checks:
        keys = parent.select(F.col(key).alias("_key"), F.lit(True).alias("_there")).distinct()
        one = child.groupBy(F.col(column).alias("_key")).agg(F.count(F.lit(1)).alias("_rows")).join(keys, "_key", "left")
        one = one.agg(F.coalesce(F.sum("_rows"), F.lit(0)).alias("n_rows"), F.coalesce(F.sum(F.when(F.col("_there").isNull(), F.col("_rows"))), F.lit(0)).alias("n_broken")).select(F.lit(name).alias("name"), "n_rows", "n_broken")
        out = one if out is None else out.unionByName(one)
    return out


def duplicate_keys(df: DataFrame, key: str) -> DataFrame:
    return df.groupBy(key).agg(F.count(F.lit(1)).alias("n_rows")).filter("n_rows > 1")


def contract_violations(nodes: DataFrame) -> DataFrame:
    """id, violation of nodes: missing fields, unknown values, lifecycles that can't be."""
    from .consolidate import lifecycle_valid

    rules = {
        "missing_text": F.coalesce(F.trim("text"), F.lit("")) == "",
        "unknown_layer": ~F.coalesce(F.col("layer").isin("global", "domain", "project"), F.lit(False)),
        "unknown_source": ~F.coalesce(F.col("source").isin("automatic", "explicit"), F.lit(False)),
        "unknown_confidence": ~F.coalesce(F.col("confidence").isin("high", "medium", "low"), F.lit(False)),
        "no_support": F.coalesce(F.col("support_count"), F.lit(0)) < 1,
        "lifecycle": ~lifecycle_valid("audit"),
        "superseded_and_deprecated": (F.size("superseded_by") > 0) & (F.size("deprecated_by") > 0),
        "supersedes_and_deprecates": (F.size("supersedes") > 0) & (F.size("deprecates") > 0),
        "self_link": F.array_contains("supersedes", F.col("id")),
    }
    found = F.filter(F.array(*(F.when(r, F.lit(n)) for n, r in rules.items())), lambda x: x.isNotNull())
    return nodes.select("id", F.explode(found).alias("violation"))


def parity(left: DataFrame, right: DataFrame) -> DataFrame:
    """side, n_rows: rows, with repetitions, that only one of two tables of equal columns has."""
    only = lambda a, b, side: a.exceptAll(b.select(*a.columns)).agg(F.count(F.lit(1)).alias("n_rows")).select(F.lit(side).alias("side"), "n_rows")
    return only(left, right, "left").unionByName(only(right, left, "right"))
