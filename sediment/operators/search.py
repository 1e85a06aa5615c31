"""Lexical recall: explainable scores, gates, rank priors and prunes."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType

from ..functions import filters as P
from ..functions import text as T


def _importance(token: str) -> int:
    if not token.isascii():
        return 5
    if any(c in "_.-" for c in token) or any(c.isdigit() for c in token) and len(token) >= 6:
        return 4
    return 3 if len(token) >= 10 else 2 if len(token) >= 7 else 1


def is_important(token: str) -> bool:
    return _importance(token) >= 2 or token in T.LIFECYCLE_WORDS or any(c.isdigit() for c in token) and len(token) >= 3


def occurrences(lowered: Column, token: str) -> Column:
    """Substring counts for compound tokens and other scripts, whole words for the rest; `lowered` is lower-case text."""
    if not token.isascii() or any(c in "_.-" for c in token):
        return ((F.length(lowered) - F.length(F.replace(lowered, F.lit(token), F.lit("")))) / len(token)).cast("int")
    return F.regexp_count(lowered, F.lit(rf"(?<![A-Za-z0-9_]){token}(?![A-Za-z0-9_])"))


def score_text(df: DataFrame, query: list[str], text: str = "text", weight: int = 1) -> DataFrame:
    """Adds score, matched (tokens in query order) and kept (the coverage gate) for a query's tokens."""
    lowered = F.lower(F.coalesce(F.col(text), F.lit("")))
    hits = F.array(*(F.struct(F.lit(t).alias("token"), F.lit(_importance(t)).alias("importance"), occurrences(lowered, t).alias("times")) for t in query))
    out = df.withColumn("_hits", F.filter(hits, lambda h: h["times"] > 0))
    score = F.aggregate("_hits", F.lit(0), lambda s, h: s + F.least(h["times"], F.lit(5)) * weight * h["importance"])
    out = out.withColumn("score", score).withColumn("matched", F.transform("_hits", lambda h: h["token"])).drop("_hits")
    return out.withColumn("kept", keeps_match(query, F.col("matched")))


def keeps_match(query: list[str], matched: Column, context: list[str] | None = None) -> Column:
    """A match must hold a specific token if the query has any, and then an important one (or any that isn't generic).

    Tokens of the context's terms count nothing; a query of such tokens only keeps every match.
    """
    content = content_tokens(query, context)
    if not content and context:
        return F.lit(True)
    meaningful = [t for t in content if t not in T.GENERIC_WORDS]
    specific = [t for t in meaningful if _importance(t) >= 4]
    needed = [t for t in content if is_important(t)] or meaningful
    if not meaningful or not needed:
        return F.lit(False)
    any_of = lambda some: F.arrays_overlap(matched, T.words(some))
    return any_of(specific) & any_of(needed) if specific else any_of(needed)


def context_terms(project_path: str) -> list[str]:
    """A project's path and its last part, lower-case."""
    low = project_path.lower()
    return list(dict.fromkeys(x for x in (low, low.rstrip("/").rsplit("/", 1)[-1]) if x))


def content_tokens(query: list[str], context: list[str] | None) -> list[str]:
    known = {t for term in context or [] for t in re.findall(r"[\w.-]+", term)}
    return [t for t in query if t not in known]


def phrases(query: list[str]) -> list[str]:
    """Runs of four, three and two tokens of a query, the longer first, that hold an important token."""
    runs = [query[i : i + n] for n in (4, 3, 2) for i in range(len(query) - n + 1)]
    telling = [r for r in runs if any(_importance(t) >= 2 or any(c.isdigit() for c in t) and len(t) >= 3 for t in r)]
    return list(dict.fromkeys(" ".join(r) for r in telling))


#: Fields of a record and their weights, in the order in which phrases are looked for, and those that carry a match by themselves.
FIELD_WEIGHTS = {"text": 15, "decision": 14, "decisions": 14, "task": 12, "summary": 12, "reusable_facts": 12, "unresolved_tasks": 10, "rationale": 8, "user_intent": 7, "topic": 6, "scope": 6, "title": 5, "layer": 4, "project": 3, "repository": 3, "tags": 2, "memory_id": 1, "files_touched": 2, "source_agent": 1, "summary_path": 1, "evidence_path": 1, "date": 1}
TELLING_FIELDS = {"decision", "decisions", "task", "summary", "text", "rationale", "topic", "reusable_facts", "unresolved_tasks", "user_intent"}
CONTEXT_FIELDS = ("project_path", "cwd", "repository", "project")
_SIGNAL_FIELDS = ("title", "summary", "user_intent", "decision", "task")
#: Phrases that count, and what a project's context adds.
MOST_PHRASES, CONTEXT_BONUS = 3, 1200


def field_texts(df: DataFrame, name: str) -> Column:
    """The texts of a field (a string or a list of them) that aren't blank; none if the table hasn't got it."""
    if name not in df.columns:
        return F.array().cast("array<string>")
    c = F.col(name)
    listed = F.transform(c, lambda x: F.trim(x.cast("string"))) if isinstance(df.schema[name].dataType, ArrayType) else F.array(c.cast("string"))
    return F.coalesce(F.filter(listed, lambda x: F.trim(F.coalesce(x, F.lit(""))) != ""), F.array().cast("array<string>"))


def generic_title(text: Column) -> Column:
    low = F.trim(F.lower(text))
    return (low == "") | low.rlike(r"\brollout-\d{4}-\d{2}-\d{2}t") | (low.rlike(r"\.(?:jsonl|json|log|txt|md)\b") & low.contains(":"))


def in_context(df: DataFrame, terms: list[str]) -> Column:
    """Whether a record's project, in whatever form it is given, is that of the terms."""
    last = lambda c: F.regexp_extract(F.rtrim(c, F.lit("/")), "[^/]*$", 0)
    plain = lambda c: F.regexp_replace(c, "[^a-z0-9]+", "")

    def same(value: Column) -> Column:
        out, own = F.lit(False), last(value)
        for term in terms:
            name = term.rstrip("/").rsplit("/", 1)[-1]
            key = re.sub("[^a-z0-9]+", "", name)
            out = out | (value == term) | value.endswith(f"/{name}") | F.lit(term).endswith(F.concat(F.lit("/"), own)) | ((own != "") & (own == name))
            if len(key) >= 4:
                out = out | (plain(own) == key)
            if name:
                out = out | value.rlike(rf"(^|[/\s:_-]){re.escape(name)}($|[/\s:_-])")
        return out

    values = F.flatten(F.array(*(F.transform(field_texts(df, f), F.lower) for f in CONTEXT_FIELDS if f in df.columns)))
    return F.exists(values, same) if terms and any(f in df.columns for f in CONTEXT_FIELDS) else F.lit(False)


def score_records(df: DataFrame, query: list[str], context: list[str] | None = None) -> DataFrame:
    """Adds score, matched, telling and strict to records of any of FIELD_WEIGHTS' columns, for a query's distinct tokens.

    Each text of a field scores by its tokens and the field's weight; up to three phrases add to that, in the fields' order.
    Coverage of the query raises the sum, missing specific or important tokens divide it, and so do matches in no telling field.
    A telling match in the project's context gains a bonus. Talk of search results, and matches that the gate drops, score 0.
    telling: a telling field matched; strict: all of the query's required important (or specific) tokens are there. Null and blank fields match nothing.
    """
    content = content_tokens(query, context)
    # a title that names a source counts little: it is a field of its own
    fields = [(f"{n}:{kind}", n, w if kind == "" else 1) for n, w in FIELD_WEIGHTS.items() if n in df.columns for kind in (("", "generic") if n == "title" else ("",))]

    def texts(name: str, kind: str) -> Column:
        own = field_texts(df, name)
        return own if name != "title" else F.filter(own, generic_title if kind == "generic" else lambda x: ~generic_title(x))

    def hits(text: Column) -> Column:
        low = F.lower(text)
        seen = F.array(*(F.struct(F.lit(t).alias("token"), F.lit(_importance(t)).alias("importance"), occurrences(low, t).alias("times")) for t in query))
        said = F.array(*(F.when(F.contains(low, F.lit(p)), F.lit(sum(map(_importance, p.split())) * 18)) for p in phrases(query))) if phrases(query) else F.array().cast("array<int>")
        return F.struct(F.filter(seen, lambda h: h["times"] > 0).alias("hits"), F.filter(said, lambda x: x.isNotNull()).alias("said"))

    total = lambda a: F.aggregate(a, F.lit(0).cast("long"), lambda s, x: s + x)
    out = df.withColumn("_f", F.struct(*(F.transform(texts(n, label.split(":")[1]), hits).alias(label) for label, n, _ in fields)))
    tokens_of = lambda label: F.array_distinct(F.flatten(F.transform(F.col("_f")[label], lambda x: F.transform(x["hits"], lambda h: h["token"]))))

    def points(label: str, w: int) -> Column:
        return total(F.flatten(F.transform(F.col("_f")[label], lambda x: F.transform(x["hits"], lambda h: (F.least(h["times"], F.lit(5)) * h["importance"] * w).cast("long")))))

    def said(label: str, w: int) -> Column:
        with_hits = F.filter(F.col("_f")[label], lambda x: F.size(x["hits"]) > 0)
        return F.flatten(F.transform(with_hits, lambda x: F.transform(x["said"], lambda p: (p * max(1, w // 4)).cast("long"))))

    base, spoken = sum((points(label, w) for label, _, w in fields), F.lit(0).cast("long")), [said(label, w) for label, _, w in fields]
    telling = [label for label, n, _ in fields if n in TELLING_FIELDS]
    no_tokens = F.array().cast("array<string>")
    out = out.withColumns(
        {
            "_base": base + total(F.slice(F.flatten(F.array(*spoken)), 1, MOST_PHRASES)),
            "matched": F.array_distinct(F.flatten(F.array(*(tokens_of(label) for label, _, _ in fields)))),
            "_telling": F.array_distinct(F.flatten(F.array(no_tokens, *(tokens_of(label) for label in telling)))),
            "_places": sum((F.size(tokens_of(label)) for label in telling), F.lit(0)),
        }
    )
    matched = F.col("matched")
    held = lambda some: F.array_intersect(matched, T.words(some)) if some else no_tokens
    worth = lambda a: F.aggregate(a, F.lit(0).cast("long"), lambda s, t: s + T.token_importance(t))
    less = lambda x, by: F.greatest(F.lit(1), F.floor(x / by))
    now = F.col("_base") + worth(matched) * 6 + F.when(F.size(matched) == len(query), 20).otherwise(0) + F.when(F.col("_places") >= 2, 20 + F.col("_places") * 3).otherwise(0)
    out = out.withColumn("_now", now)
    if specific := [t for t in content if _importance(t) >= 4]:
        n, gained = F.size(held(specific)), F.col("_now") + worth(held(specific)) * 25
        out = out.withColumn("_now", F.when(n == 0, less(F.col("_now"), 8)).when(n < len(specific), less(gained, 2 + len(specific) - n)).otherwise(gained))
    if important := [t for t in content if is_important(t)]:
        n, required = F.size(held(important)), max(1, (len(important) + 1) // 2)
        out = out.withColumn("_now", F.when(n >= required, F.col("_now") + worth(held(important)) * 12 + n * 8).otherwise(less(F.col("_now"), 2 + (required - n) * 2)))
    alone = F.size("_telling") == 0
    broad = alone & (F.size(F.array_except(matched, T.words(T.GENERIC_WORDS))) == 0) & F.lit(any(t not in T.GENERIC_WORDS for t in query))
    quartered = F.when(alone, less(F.col("_now"), 4)).otherwise(F.col("_now"))
    out = out.withColumn("_now", F.when(broad, less(quartered, 4)).otherwise(quartered))
    bonus = F.when((F.size("_telling") > 0) & in_context(df, context or []), CONTEXT_BONUS).otherwise(0)
    signal = [field_texts(df, f) for f in _SIGNAL_FIELDS if f in df.columns]
    talk = P.search_talk(T.compact_whitespace(F.array_join(F.flatten(F.array(*signal)), " "))) if signal else F.lit(False)
    score = F.when((F.size(matched) == 0) | talk | ~keeps_match(query, matched, context), 0).otherwise(F.col("_now") + bonus)
    strict = strict_tokens(query)
    full = F.size(held(strict)) == len(strict) if strict else F.lit(False)
    # a generator of one row: filters on the score are not pushed down into its parts, where they would be worked out again and again
    found = F.struct(score.cast("long").alias("score"), matched.alias("matched"), full.alias("strict"), (F.size("_telling") > 0).alias("telling"))
    return out.select(*df.columns, F.inline(F.array(found)))


def strict_tokens(query: list[str]) -> list[str]:
    """The important tokens that aren't generic, if there are three or more; else the specific ones, if two or more."""
    meaningful = [t for t in query if t not in T.GENERIC_WORDS]
    important, specific = [t for t in meaningful if is_important(t)], [t for t in meaningful if _importance(t) >= 4]
    return important if len(important) >= 3 else specific if len(specific) >= 2 else []


def repeats_query(df: DataFrame, query: list[str]) -> Column:
    """Whether a record says a query's tokens three times and more: two of them, or one of a query of one or two."""
    some = [t for t in query if t not in T.GENERIC_WORDS] or query
    low = F.lower(T.compact_whitespace(F.array_join(F.flatten(F.array(*(field_texts(df, f) for f in (*_SIGNAL_FIELDS, "text") if f in df.columns))), " ")))
    times = sum((F.when(occurrences(low, t) >= 3, 1).otherwise(0) for t in some), F.lit(0))
    return times >= (1 if len(some) <= 2 else 2)


def required_tokens(query: list[str]) -> list[str]:
    """What a hit must hold to support a query: one to five meaningful tokens, else the important or the specific ones."""
    meaningful = [t for t in query if t not in T.GENERIC_WORDS]
    important = [t for t in meaningful if is_important(t)]
    specific = [t for t in meaningful if _importance(t) >= 4]
    if 1 <= len(meaningful) <= 5:
        return meaningful
    return important if len(important) >= 2 else specific if len(specific) >= 2 else []


def query_support(query: list[str], matched: Column) -> Column:
    """complete, partial or none: how many of a query's required tokens a hit holds; none if nothing is required."""
    required = required_tokens(query)
    if not required:
        return F.lit("none")
    held = F.size(F.array_intersect(matched, T.words(required)))
    return F.when(held == len(required), "complete").when(held > 0, "partial").otherwise("none")


def answerability(hits: DataFrame, inactive_matches: int = 0) -> DataFrame:
    """verdict and n_supported of hits (support): supported, or why not."""
    counts = hits.agg(F.count_if(F.col("support") == "complete").alias("n_supported"), F.count(F.lit(1)).alias("_hits"))
    verdict = F.when(F.col("n_supported") > 0, "supported").when(F.lit(inactive_matches) > 0, "no_active_current_support").when(F.col("_hits") > 0, "related_context_without_active_memory_support").otherwise("no_recall_hits")
    return counts.select(verdict.alias("verdict"), "n_supported")


def top_hits(scored: DataFrame, limit: int, *tie: str) -> DataFrame:
    """The best kept rows, ties by `tie` descending (a bounded heap in each task, then one of `limit` rows per task)."""
    return scored.filter("kept and score > 0").orderBy(F.desc("score"), *(F.desc(t) for t in tie)).limit(limit)


def rank_priors(source: Column, confidence: Column, layer: Column, support: Column, preferred: str = "", process: Column | None = None, repeated: Column | None = None) -> Column:
    """What a node's origin, confidence, layer and support add to its score; automatic ones of little support lose if they
    narrate a process or repeat the query's words."""
    prior = F.when(source == "explicit", 350).otherwise(0)
    prior += F.when(confidence == "high", 110).when(confidence == "medium", 40).when(confidence == "low", -100).otherwise(0)
    prior += F.when((source == "automatic") & (support == 0), -40).otherwise(0)
    prior += F.when(layer == "global", 120).when(layer == "domain", 80).when(layer == "project", 40).otherwise(0)
    if process is not None and repeated is not None:
        prior += F.when((source == "automatic") & process & ((support <= 1) | repeated), -900).otherwise(0)
        prior += F.when((source == "automatic") & (support <= 1) & confidence.isin("", "low", "medium") & repeated, -350).otherwise(0)
    if preferred in ("global", "domain", "project"):
        prior += F.when(layer == preferred, 240).when(layer.isin("global", "domain", "project"), -900).otherwise(0)
    return prior


def prune_topics(hits: DataFrame, *query: str) -> DataFrame:
    """The best hit of each (layer, scope, topic) within a query; hits that lack one of them all stay."""
    keyed = (F.col("layer") != "") & (F.col("scope") != "") & (F.col("topic") != "")
    place = F.row_number().over(Window.partitionBy(*query, "layer", "scope", "topic").orderBy(F.desc("score"), F.desc("id")))
    return hits.withColumn("_place", place).filter(~F.coalesce(keyed, F.lit(False)) | (F.col("_place") == 1)).drop("_place")


def prune_low_scores(hits: DataFrame, query: str) -> DataFrame:
    """Hits of at least 99 % of the query's best score, rounded down; the best are summed up before the join."""
    best = hits.groupBy(query).agg(F.floor(F.max("score").cast("double") * F.lit(0.99)).alias("_floor"))
    return hits.join(best, query).filter(F.col("score") >= F.col("_floor")).drop("_floor")


def prune_layers(hits: DataFrame, preferred: str, query: str) -> DataFrame:
    """If any hit of a query is of the preferred layer, only those."""
    found = hits.filter(F.col("layer") == preferred).select(query, F.lit(True).alias("_found")).distinct()
    return hits.join(found, query, "left").filter(F.col("_found").isNull() | (F.col("layer") == preferred)).drop("_found")


def prune_tails(hits: DataFrame, query: str) -> DataFrame:
    """Against each query's first hit: other topics of its layer go, and, if that hit is of a memory, so do weak hits of its
    topic in another scope. A hit is weak if it is an automatic memory of medium confidence, one support and without all of the
    query's required tokens (strict)."""
    first = hits.groupBy(query).agg(F.max(F.struct("score", "id", "kind", "layer", "scope", "topic")).alias("_first"))
    full = lambda x: (x("layer") != "") & (x("scope") != "") & (x("topic") != "")
    a = lambda c: F.col(f"_first.{c}")
    same_layer, same_topic = F.col("layer") == a("layer"), F.col("topic") == a("topic")
    frail = (F.col("kind") == "memory") & (F.col("source") == "automatic") & (F.col("confidence") == "medium") & (F.col("support_count") == 1) & ~F.col("strict")
    weak = (a("kind") == "memory") & F.coalesce(frail, F.lit(False)) & same_layer & same_topic & (F.col("scope") != a("scope"))
    stays = (F.col("id") == a("id")) | ~full(a) | ~full(F.col) | (~weak & (~same_layer | same_topic))
    return hits.join(first, query).filter(stays).drop("_first")


#: What a hit's kind adds to its score.
MEMORY_BONUS, INDEX_BONUS = 30, 10


def memory_hits(nodes: DataFrame, gone: DataFrame, query: list[str], context: list[str] | None = None, preferred: str = "") -> DataFrame:
    """query_id (1), id, kind, layer, scope, topic, score, matched, strict and what else the prunes need, of active nodes.

    `gone` are the ids of inactive nodes. Nodes that match in no telling field go; a node's score is that of its record and its
    rank priors, 1 at least. Then only hits of the preferred layer stay (if there are any), the best of a topic and scope, those
    close to the best, and no weak tails.
    """
    active = nodes.join(gone, "id", "left_anti")
    scored = score_records(active, query, context).filter("score > 0 and telling")
    flat = T.compact_whitespace(F.coalesce(F.col("text"), F.lit("")))
    prior = rank_priors(F.col("source"), F.col("confidence"), F.col("layer"), F.col("support_count"), preferred, P.process_memory(flat), repeats_query(scored, query))
    hits = scored.withColumn("score", F.greatest(F.lit(1), F.col("score") + prior) + MEMORY_BONUS).withColumn("kind", F.lit("memory")).withColumn("query_id", F.lit(1))
    if preferred in ("global", "domain", "project"):
        hits = prune_layers(hits, preferred, "query_id")
    return prune_tails(prune_low_scores(prune_topics(hits, "query_id"), "query_id"), "query_id")


def inactive_matches(nodes: DataFrame, gone: DataFrame, query: list[str], context: list[str] | None = None) -> DataFrame:
    """n_matches: how many inactive nodes the query would have found."""
    return score_records(nodes.join(gone, "id", "left_semi"), query, context).agg(F.count_if(F.col("score") > 0).alias("n_matches"))


def context_package(hits: DataFrame, query: list[str], limit: int) -> DataFrame:
    """rank, id, kind, score, status, reason of the first `limit` hits of a package: memories before others, by score.

    Hits have drill_paths. A hit supports the query if it is a memory with a way down to its evidence and holds all that the
    query requires.
    """
    top = hits.orderBy(F.desc(F.col("kind") == "memory"), F.desc("score"), F.desc("id")).limit(limit)
    rank = F.row_number().over(Window.orderBy(F.desc(F.col("kind") == "memory"), F.desc("score"), F.desc("id")))  # over `limit` rows
    support = query_support(query, F.col("matched"))
    memory, backed = F.col("kind") == "memory", F.size("drill_paths") > 0
    reason = (
        F.when(~memory, "not_active_memory_node")
        .when(~backed, "missing_support_drilldown")
        .when(support != "complete", "insufficient_query_support")
        .otherwise("active_current_memory_with_drilldown_and_query_support")
    )
    status = F.when(memory & backed & (support == "complete"), "supported").otherwise("unsupported")
    return top.select(rank.alias("rank"), "id", "kind", "score", status.alias("status"), reason.alias("reason"))


def merged_hits(hits: DataFrame) -> DataFrame:
    """One row per (query_id, path): the best score plus a small bonus for what corroborates it, and its kinds."""
    bonus = F.when(F.col("low"), 0).when(~F.col("fielded"), F.least(F.lit(5), F.greatest(F.lit(1), F.expr("score div 50")))).otherwise(F.least(F.lit(12), F.greatest(F.lit(1), F.expr("score div 25"))))
    place = F.row_number().over(Window.partitionBy("query_id", "path").orderBy(F.desc("score"), "kind"))
    rated = hits.withColumn("_bonus", bonus).withColumn("_place", place)
    kinds = F.array_sort(F.collect_set("kind"))
    return rated.groupBy("query_id", "path").agg((F.max("score") + F.sum(F.when(F.col("_place") > 1, F.col("_bonus")).otherwise(0))).alias("score"), F.when(F.size(kinds) > 1, "mixed").otherwise(kinds[0]).alias("kind"))


#: Pairs of a document and an item that one task ranks, about (rank_passages).
PAIRS = 500_000


def rank_passages(queries: DataFrame, docs: DataFrame, limit: int) -> DataFrame:
    """item_id, doc_id, score, place: documents by the weighted tokens that they share with each item.

    Tokens that no item asks for go first. A document's tokens are counted and scored in one task, for about PAIRS pairs of a document
    and an item, so that a task's tables don't grow with the documents; it keeps its best `limit` of an item only.
    """
    asked = queries.select("item_id", F.explode(T.query_tokens(F.col("text"))).alias("token"))
    parts = max(docs.sparkSession.sparkContext.defaultParallelism, -(-docs.count() * queries.count() // PAIRS))
    every = docs.select("doc_id", "text").repartition(parts, "doc_id").select("doc_id", F.explode(F.regexp_extract_all(F.lower("text"), F.lit(T.TOKEN), 0)).alias("token"))
    counted = every.join(asked.select("token").distinct(), "token", "left_semi").groupBy("doc_id", "token").agg(F.count(F.lit(1)).alias("times"))
    weight = F.least("times", F.lit(5)) * T.token_importance(F.col("token"))
    scored = counted.join(asked, "token").groupBy("item_id", "doc_id").agg(F.sum(weight).alias("score"))
    place = F.row_number().over(Window.partitionBy("item_id").orderBy(F.desc("score"), F.desc("doc_id")))
    return scored.withColumn("place", place).filter(F.col("place") <= limit)
