"""JSON as text and as values: string leaves redacted in place, and all members of a document walked, whatever its depth."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import text as T

#: Stand for an escaped backslash and an escaped quote; JSON holds neither as it stands.
_BACKSLASH, _QUOTE = "\x01", "\x02"
#: Levels of a document that one plan unrolls.
LEVELS = 16


def parts(text: Column) -> Column:
    """A document cut at its quotes: even places are what stands between strings, odd ones are strings, escapes in them."""
    return F.split(F.replace(F.replace(text, F.lit("\\\\"), F.lit(_BACKSLASH)), F.lit('\\"'), F.lit(_QUOTE)), '"')


def _given(piece: Column) -> Column:
    return F.replace(F.replace(piece, F.lit(_QUOTE), F.lit('\\"')), F.lit(_BACKSLASH), F.lit("\\\\"))


def _ascii(text: Column) -> Column:
    """Characters beyond ASCII as \\u escapes, in surrogate pairs where they need it."""
    one = lambda c: F.when(c.rlike(r"[^\x00-\x7F]"), F.regexp_replace(F.lower(F.hex(F.encode(c, "UTF-16BE"))), "(.{4})", r"\\u$1")).otherwise(c)
    return F.when(text.rlike(r"[^\x00-\x7F]"), F.array_join(F.transform(F.split(text, ""), one), "")).otherwise(text)


def _leaf(piece: Column) -> Column:
    """Struct of a string's redacted spelling and counts; a string that holds nothing to hide keeps its spelling."""
    raw = _given(piece)
    value = F.get(F.from_json(F.concat(F.lit('["'), raw, F.lit('"]')), "array<string>"), F.lit(0))
    redacted = T.redact(value)
    spelt = F.to_json(F.array(redacted["text"]))
    changed = redacted["text"] != value
    hidden = T.may_hold_secret(raw) | F.contains(raw, F.lit("\\u")) | F.contains(raw, F.lit("\\/"))
    named = F.struct(F.when(changed, F.substring(spelt, F.lit(3), F.length(spelt) - 4)).otherwise(raw).alias("text"), *(redacted[c].alias(c) for c in T.REDACTIONS))
    return F.when(hidden, named).otherwise(F.struct(raw.alias("text"), *(F.lit(0).cast("long").alias(c) for c in T.REDACTIONS)))


def _total(pieces: str, category: str) -> Column:
    return F.aggregate(pieces, F.lit(0).cast("long"), lambda n, x: n + x[category])


def with_redacted_json(rows: DataFrame, column: str, name: str = "redacted") -> DataFrame:
    """`rows` with a struct of the document without secrets (text) and counts by category.

    Only string values are redacted; keys, numbers, literals and nesting stay, white space between them goes, and the result is
    ASCII. Null for null and for what is no JSON (members of one name twice in an object included). One pass over the text:
    depth and length don't matter.
    """
    cut = rows.withColumn("_parts", F.when(F.try_parse_json(F.col(column)).isNotNull(), parts(F.col(column))))
    paired = cut.withColumn("_pairs", F.arrays_zip(F.col("_parts").alias("piece"), F.concat(F.slice("_parts", 2, F.greatest(F.size("_parts") - 1, F.lit(0))), F.array(F.lit(""))).alias("after")))
    plain = lambda t: F.struct(t.alias("text"), *(F.lit(0).cast("long").alias(c) for c in T.REDACTIONS))

    def done(x: Column, i: Column) -> Column:
        return F.when(i % 2 == 0, plain(F.regexp_replace(x["piece"], r"\s+", ""))).when(x["after"].rlike(r"^\s*:"), plain(_given(x["piece"]))).otherwise(_leaf(x["piece"]))

    redacted = paired.withColumn("_done", F.transform("_pairs", done))
    joined = redacted.withColumn("_joined", F.array_join(F.transform("_done", lambda x: x["text"]), '"'))
    counts = [_total("_done", c).alias(c) for c in T.REDACTIONS]
    return joined.select(*rows.columns, F.when(F.col("_done").isNotNull(), F.struct(_ascii(F.col("_joined")).alias("text"), *counts)).alias(name))


def depth(text: Column) -> Column:
    """How deep a document nests; 0 for a scalar."""
    between = F.array_join(F.transform(F.filter(F.transform(parts(text), lambda x, i: F.struct(x.alias("x"), i.alias("i"))), lambda p: p["i"] % 2 == 0), lambda p: p["x"]), "")
    marks = F.split(F.regexp_replace(between, r"[^\[\]{}]", ""), "")
    start = F.struct(F.lit(0).alias("now"), F.lit(0).alias("most"))

    def step(at: Column, c: Column) -> Column:
        now = at["now"] + F.when(c.isin("[", "{"), 1).when(c.isin("]", "}"), -1).otherwise(0)
        return F.struct(now.alias("now"), F.greatest(at["most"], now).alias("most"))

    return F.aggregate(marks, start, step)["most"]


def walked(rows: DataFrame, key: str, column: str) -> DataFrame:
    """key, name, kind, value (a variant) of all members of all objects in JSON documents, at any depth; elements of arrays are
    gone through, but are no members. Null and malformed documents have none.

    The documents' greatest depth, one number, says how many levels are unrolled: each opens the containers that the one before
    has found. Beyond LEVELS the rows are checkpointed.
    """
    deepest = rows.agg(F.max(depth(F.col(column)))).collect()[0][0] or 0
    kept = "struct<name:string,value:variant,open:boolean>"
    now = rows.select(key, F.lit(None).cast("string").alias("name"), F.try_parse_json(F.col(column)).alias("value"), F.lit(True).alias("open")).filter("value is not null")
    for level in range(deepest):
        shape = F.schema_of_variant("value")
        members = F.expr("transform(map_entries(try_cast(value AS MAP<STRING, VARIANT>)), e -> struct(e.key AS name, e.value AS value, true AS open))")
        elements = F.expr("transform(try_cast(value AS ARRAY<VARIANT>), v -> struct(CAST(NULL AS STRING) AS name, v AS value, true AS open))")
        inner = F.when(F.col("open") & shape.startswith("OBJECT"), members).when(F.col("open") & shape.startswith("ARRAY"), elements)
        own = F.array(F.struct("name", "value", F.lit(False).alias("open")))
        now = now.select(key, F.inline(F.concat(own, F.coalesce(inner, F.array().cast(f"array<{kept}>")))))
        if level % LEVELS == LEVELS - 1:
            now = now.checkpoint()
    shape = F.schema_of_variant("value")
    kind = F.when(shape.startswith("OBJECT"), "object").when(shape.startswith("ARRAY"), "array").when(shape == "STRING", "string").when(shape == "BOOLEAN", "boolean").when(shape == "VOID", "null").otherwise("number")
    return now.filter("name is not null").select(key, "name", kind.alias("kind"), "value")
