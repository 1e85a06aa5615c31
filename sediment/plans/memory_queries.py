"""Queries of what may become memory and how records are scored, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import filters as P
from ..functions import forms
from ..functions import text as T
from ..operators import consolidate, search
from . import fixtures as X
from .queries import _VALID, SPECIFIC_QUERY, _compact, _importance, _list, _query, _table, _tokens

#: Texts that every predicate tells apart: at least one that it accepts, and near ones that it doesn't.
TEXTS = [
    "<environment_context> x", "# AGENTS.md instructions for this", "Approval policy is currently never", "see /Users/me/notes.txt", "my request for Codex: do it", "I am checking the logs now", "we checked; then I'll report back", "先检查 日志", "现在按 计划 进行", "unit tests passed and archive audit too",
    "Understood, I will keep it", "好的，谢谢", "maybe later", "we could try it", "for this local run only", "the gate should pass", "user must confirm", "sandbox needs an approval first", "approval of the codex plan", "run status is unknown", "scheduled automation is running", "raw_refs: a", "records/a.jsonl#L1 is cited",
    "Agents should be helpful and clear.", "Agents should cite the archive of Monday", "archived source record for abc-1.", "`MY_SECRET_NAME`", "Source: https://example.org/x", "cookie, github_token", "refusal", "redacted bread", "**bold starts", "a **b** c", "notes of the repository at", "**Findings**", "verified:",
    "dry run found 3 records", "committed and pushed", "alpha entry is usable for now", "the top hit has a good rank", "remember Authorization: x", "a github token here", "do not remember this: x", "Please never remember that", "不要记住这个：x", "我偏好简短的回答", "以后我希望每次都用中文", "以后每次回答", "请写代码时必须默认不要省略", "这次我偏好长的", "我偏好吗？",
    "my_api_key_name", "session id list", "api of key", "a provisional fact", "task 12 status update", "should rank in the title", "should rank well", "plain text of no note", "the cookie jar", "", "  \n ", None,
]


def _m(c: str, pattern: str) -> str:
    return f"regexp_matches({c}, '" + pattern.replace("'", "''") + "')"


def _contains(c: str, literals: list[str]) -> str:
    return "(" + " OR ".join(f"contains({c}, '" + x.replace("'", "''") + "')" for x in literals) + ")"


def _starts(c: str, literals: list[str]) -> str:
    return "(" + " OR ".join(f"starts_with({c}, '" + x.replace("'", "''") + "')" for x in literals) + ")"


def flags_sql(rows: str) -> str:
    """The predicates over a relation (origin, id, text)."""
    labels = list(T.REDACTIONS)
    rule = f"({_m('rule', P.NORMATIVE)} AND len(rw) BETWEEN 1 AND 8 AND len(list_filter(rw, lambda x: NOT list_contains({_list(P.GENERIC_RULE_WORDS)}, x))) = 0)"
    fleeting = "(f <> '' AND (" + " OR ".join(_m("f", p) for p in (P.CHINESE_ACKNOWLEDGEMENT, P.ACKNOWLEDGEMENT, P.HYPOTHETICAL, P.TEMPORARY, P.TEST_STATUS, P.QUOTED_PROMPT, P.PERMISSION_CHATTER, P.DAILY_STATUS, P.DAILY_CONTRACT)) + f" OR {rule}))"
    redaction = f"(f <> '' AND (bare IN ('refusal', 'stayed clean', 'clean') OR (list_has_any(parts, {_list(labels)}) AND len(list_filter(parts, lambda x: NOT list_contains({_list(labels + P.REDACTION_WORDS)}, x))) = 0)))"
    incomplete = f"(f <> '' AND ((length(f) - length(replace(f, '**', ''))) % 4 = 2 OR (length(trim(f, ' -')) <= 160 AND {_m(chr(116) + 'rim(f, ' + chr(39) + ' -' + chr(39) + ')', P.INCOMPLETE)})))"
    low_signal = f"(f = '' OR {_m('f', P.PLACEHOLDER)} OR {_m('const', P.CONSTANT_NAME)} OR {_m('f', P.CITATION)} OR {redaction} OR {incomplete} OR {_m('f', P.EVALUATION)} OR {_m('f', P.HEADING)} OR {fleeting} OR {_m('f', P.RUN_STATUS)})"
    c = {k: _m("t", p) for k, p in P.CHINESE.items()}
    norms = "len(regexp_extract_all(t, '" + P.CHINESE["norm"] + "'))"
    barred = f"({_m('t', P.NEGATED)} OR {c['temporary']} OR {c['live']} OR {c['open']} OR {c['quoted']} OR {_m('t', P.CHINESE_ACKNOWLEDGEMENT)})"
    lasting = f"({c['text']} AND NOT {barred} AND ({c['direct']} OR ({c['future']} AND {c['own']} AND ({c['cue']} OR ({norms} >= 1 AND {c['recurring']}))) OR ({c['recurring']} AND (({c['own']} AND {norms} >= 1) OR ({c['to_agent']} AND {norms} >= 3)))))"
    flags = {
        "noisy": f"coalesce({_contains('lower(text)', P.NOISE)}, true)",
        "process_update": f"({_starts('low', P.PROCESS_STARTS)} OR " + " OR ".join(_m("low", p) for p in P.PROCESS) + ")",
        "sensitive_explicit": _contains("low", P.SENSITIVE + [x for k in labels for x in (k, k.replace("_", " "))]),
        "negated_directive": _m("t", P.NEGATED),
        "chinese_preference": lasting,
        "sensitive_identifier": f"(list_has_any(idw, {_list(P.SENSITIVE_WORDS)}) OR list_has_any(list_transform(range(1, len(idw)), lambda i: idw[i] || ' ' || idw[i + 1]), {_list(P.SENSITIVE_PAIRS)}))",
        "reviewable": _m("t", P.REVIEWABLE),
        "injected": f"({_starts('lower(f)', P.INJECTED_STARTS)} OR {_contains('lower(f)', P.INJECTED)})",
        "raw_prompt": f"({_contains('lower(f)', P.RAW_PROMPT)} OR {_m('f', P.LOCAL_PATH)})",
        "permission_chatter": _m("f", P.PERMISSION_CHATTER),
        "generic_rule": rule,
        "fleeting": fleeting,
        "redaction_labels_only": redaction,
        "incomplete": incomplete,
        "low_signal": low_signal,
        "process_memory": _m("lower(f)", P.PROCESS_MEMORY),
        "search_talk": f"({_m('lower(f)', P.SEARCH_TALK)} OR ({_m('lower(f)', P.SEARCH_CLAIM)} AND {_m('lower(f)', P.SEARCH_SUBJECT)}))",
    }
    return f"""WITH base AS (SELECT origin, id, text, coalesce(text, '') AS t, lower(coalesce(text, '')) AS low, {_compact("coalesce(text, '')")} AS f FROM {rows}),
more AS (SELECT *, trim(lower(f), ' .!?;:') AS rule, regexp_extract_all(trim(lower(f), ' .!?;:'), '[a-z][a-z-]+') AS rw, trim(f, '` .:;') AS const, trim(regexp_replace(lower(f), '[*`]', '', 'g'), ' .:;') AS bare,
list_filter(list_transform(string_split_regex(trim(regexp_replace(lower(f), '[*`]', '', 'g'), ' .:;'), '[,/\\s]+'), lambda x: trim(x, ' .:;()[]{{}}-')), lambda x: x <> '') AS parts, string_split_regex(replace(low, '_', ' '), '[^a-z0-9]+') AS idw FROM base)
SELECT origin, id, {', '.join(f'CAST({v} AS INTEGER) AS {k}' for k, v in flags.items())} FROM more"""


_SAMPLES = list(enumerate(TEXTS))


@_query(flags_sql(f"(SELECT 'conversation' AS origin, conv_id * 1000 + turn AS id, text FROM conversations UNION ALL SELECT 'sample', id, text FROM {X.values_sql(_SAMPLES, ['id', 'text'])})"))
def memory_text_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every turn and the sample texts under all predicates of what may become memory."""
    turns = _table(spark, sf_dir, "conversations").select(F.lit("conversation").alias("origin"), (F.col("conv_id") * 1000 + F.col("turn")).alias("id"), "text")
    samples = spark.createDataFrame(_SAMPLES, "id long, text string").select(F.lit("sample").alias("origin"), "id", "text")
    rows = turns.unionByName(samples).withColumn("flat", T.compact_whitespace(F.col("text")))
    return P.with_text_flags(rows, "text", "flat").select("origin", "id", *(F.col(k).cast("int").alias(k) for k in ("noisy", *P.OF_TEXT, *P.OF_FLAT)))


# Whole records.

#: A query of plain and specific tokens that stand near one another in some turns, and the project that it is asked in.
RECORD_QUERY, PROJECT = [*SPECIFIC_QUERY, "été", "workflow"], "/work/notes/p3"
_RECORDS = """(SELECT conv_id, turn, text, coalesce(text, '') AS summary, CASE WHEN turn % 9 = 0 THEN 'log.txt: les' WHEN turn % 7 = 0 THEN 'top hit in les' ELSE role END AS title, 'p' || (conv_id % 5) AS project, [role, 'les turn-' || turn] AS tags FROM conversations)"""


def _records(spark: SparkSession, sf_dir: str) -> DataFrame:
    title = F.when(F.col("turn") % 9 == 0, "log.txt: les").when(F.col("turn") % 7 == 0, "top hit in les").otherwise(F.col("role"))
    turns = _table(spark, sf_dir, "conversations")
    return turns.select("conv_id", "turn", "text", F.coalesce("text", F.lit("")).alias("summary"), title.alias("title"), F.concat(F.lit("p"), (F.col("conv_id") % 5).cast("string")).alias("project"), F.array("role", F.concat(F.lit("les turn-"), F.col("turn").cast("string"))).alias("tags"))


def scored_sql(relation: str, query: list[str], project: str, texts: dict[str, tuple[int, str]], telling: tuple[str, ...], prefix: str = "") -> str:
    """CTEs that end in {prefix}z: the relation's columns with score, m (matched), tm (matched in telling fields) and strict, of
    the rows that a query finds. The relation has project and talk."""
    context = search.context_terms(project)
    content = search.content_tokens(query, context)

    def times(f: str, t: str) -> str:
        if t.isascii() and t.isalnum():
            return f"len(list_filter(string_split_regex(coalesce({f}_l, ''), '[^a-z0-9_]+'), lambda x: x = '{t}'))"
        return f"((length(coalesce({f}_l, '')) - length(replace(coalesce({f}_l, ''), '{t}', ''))) // {len(t)})"

    n = {(f, i): f"{f}_{i}" for f in texts for i in range(len(query))}
    counts = ", ".join(f"{times(f, t)} AS {n[f, i]}" for f in texts for i, t in enumerate(query))
    base = " + ".join(f"least({n[f, i]}, 5) * {w * search._importance(t)}" for f, (w, _) in texts.items() for i, t in enumerate(query))
    said = ", ".join(f"CASE WHEN ({' OR '.join(f'{n[f, i]} > 0' for i in range(len(query)))}) AND contains({f}_l, '{p}') THEN {sum(map(search._importance, p.split())) * 18 * max(1, w // 4)} END" for f, (w, _) in texts.items() for p in search.phrases(query))
    found = lambda fs: "list_filter([" + ", ".join(f"CASE WHEN {' OR '.join(f'{n[f, i]} > 0' for f in fs)} THEN '{t}' END" for i, t in enumerate(query)) + "], lambda x: x IS NOT NULL)"
    places = " + ".join(f"CAST({n[f, i]} > 0 AS INTEGER)" for f in telling for i in range(len(query)))
    worth = lambda c: f"coalesce(list_sum(list_transform({c}, lambda x: {_importance('x')})), 0)"
    specific = [t for t in content if search._importance(t) >= 4]
    important = [t for t in content if search.is_important(t)]
    required = max(1, (len(important) + 1) // 2)
    meaningful = [t for t in content if t not in T.GENERIC_WORDS]
    held = lambda some: f"list_intersect(m, {_list(some)})"
    strict = search.strict_tokens(query)
    p = prefix
    return f"""{p}l AS (SELECT *, {', '.join(f'lower({c}) AS {f}_l' for f, (_, c) in texts.items())} FROM {relation}),
{p}c AS (SELECT *, {counts} FROM {p}l),
{p}a AS (SELECT *, {base} + coalesce(list_sum((list_filter([{said}], lambda x: x IS NOT NULL))[1:3]), 0) AS base, {found(texts)} AS m, {found(telling)} AS tm, {places} AS places FROM {p}c),
{p}b AS (SELECT *, base + {worth('m')} * 6 + CASE WHEN len(m) = {len(query)} THEN 20 ELSE 0 END + CASE WHEN places >= 2 THEN 20 + places * 3 ELSE 0 END AS s1, len({held(specific)}) AS ns, len({held(important)}) AS ni FROM {p}a),
{p}d AS (SELECT *, CASE WHEN ns = 0 THEN greatest(1, s1 // 8) WHEN ns < {len(specific)} THEN greatest(1, (s1 + {worth(held(specific))} * 25) // (2 + {len(specific)} - ns)) ELSE s1 + {worth(held(specific))} * 25 END AS s2 FROM {p}b),
{p}e AS (SELECT *, CASE WHEN ni >= {required} THEN s2 + {worth(held(important))} * 12 + ni * 8 ELSE greatest(1, s2 // (2 + ({required} - ni) * 2)) END AS s3 FROM {p}d),
{p}f AS (SELECT *, CASE WHEN len(tm) = 0 THEN greatest(1, s3 // 4) ELSE s3 END AS s4 FROM {p}e),
{p}z AS (SELECT *, CAST(CASE WHEN len(tm) = 0 AND len(list_filter(m, lambda x: NOT list_contains({_list(T.GENERIC_WORDS)}, x))) = 0 THEN greatest(1, s4 // 4) ELSE s4 END + CASE WHEN len(tm) > 0 AND project = '{context[-1]}' THEN {search.CONTEXT_BONUS} ELSE 0 END AS BIGINT) AS score,
{f'len({held(strict)}) = {len(strict)}' if strict else 'false'} AS strict FROM {p}f
WHERE len(m) > 0 AND NOT talk AND list_has_any(m, {_list([t for t in meaningful if search._importance(t) >= 4])}) AND list_has_any(m, {_list(important)}))"""


_RECORD_TEXTS = {"text": (15, "text"), "summary": (12, "summary"), "title": (5, "CASE WHEN NOT gt THEN title END"), "named": (1, "CASE WHEN gt THEN title END"), "project": (3, "project"), "tag1": (2, "tags[1]"), "tag2": (2, "tags[2]")}
_SIGNAL = f"lower({_compact("title || ' ' || summary")})"
_TALK = f"regexp_matches({_SIGNAL}, '{P.SEARCH_TALK}') OR (regexp_matches({_SIGNAL}, '{P.SEARCH_CLAIM}') AND regexp_matches({_SIGNAL}, '{P.SEARCH_SUBJECT}'))"
_RECORD_CTES = f"r AS (SELECT *, regexp_matches(lower(title), '\\.(?:jsonl|json|log|txt|md)\\b') AND contains(title, ':') AS gt, {_TALK} AS talk FROM {_RECORDS}),\n" + scored_sql("r", RECORD_QUERY, PROJECT, _RECORD_TEXTS, ("text", "summary"), "r_")


@_query(f"WITH {_RECORD_CTES} SELECT conv_id, turn, score, array_to_string(list_sort(m), ' ') AS matched, strict FROM r_z")
def record_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every turn that a query finds, as a record of weighted fields in the context of a project."""
    got = search.score_records(_records(spark, sf_dir), RECORD_QUERY, search.context_terms(PROJECT)).filter("score > 0")
    return got.select("conv_id", "turn", "score", F.array_join(F.array_sort("matched"), " ").alias("matched"), "strict")


# Recall over memory nodes made of all turns.

_ID = "'m' || conv_id || '-' || ({})"
_TURN_NODES = f"""(SELECT {_ID.format('turn')} AS id, {_ID.format('turn')} AS memory_id, text, ['project', 'domain', 'global'][1 + conv_id % 3] AS layer, 's' || (conv_id % 4) AS scope, 't' || (turn % 3) AS topic,
CASE WHEN turn % 4 = 0 THEN 'explicit' ELSE 'automatic' END AS source, ['high', 'medium', 'low', ''][1 + (conv_id + turn) % 4] AS confidence, turn % 3 AS support_count, 'p' || (conv_id % 5) AS project,
'2025-01-01T00:00:00Z' AS first_seen, CASE WHEN conv_id % 13 = 0 AND turn % 5 = 1 THEN '2024-01-01T00:00:00Z' ELSE '2025-06-01T00:00:00Z' END AS last_seen,
CASE WHEN turn % 6 = 5 THEN [{_ID.format('turn - 1')}, 'missing'] ELSE [] END AS supersedes, CASE WHEN turn % 6 = 4 AND conv_id % 2 = 0 THEN [{_ID.format('turn + 1')}] ELSE [] END AS superseded_by,
CASE WHEN turn % 7 = 6 THEN [{_ID.format('turn - 2')}] ELSE [] END AS contradicts, CAST([] AS VARCHAR[]) AS contradicted_by, CASE WHEN turn = 7 THEN [{_ID.format('1')}] ELSE [] END AS deprecates, CAST([] AS VARCHAR[]) AS deprecated_by,
CASE WHEN turn > 0 THEN [{_ID.format('turn - 1')}] ELSE [] END AS derived_from, CASE WHEN turn % 2 = 0 THEN ['sessions/' || conv_id] ELSE [] END AS drill_paths, false AS talk FROM conversations)"""


def _turn_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    conv, turn = F.col("conv_id"), F.col("turn")
    node = lambda t: F.concat(F.lit("m"), conv.cast("string"), F.lit("-"), t.cast("string"))
    pick = lambda values, k: F.element_at(T.words(values), (k + 1).cast("int"))
    links = lambda when, *some: F.when(when, F.array(*some)).otherwise(F.array().cast("array<string>"))
    never = F.array().cast("array<string>")
    tag = lambda c, k: F.concat(F.lit(c), k.cast("string"))
    return _table(spark, sf_dir, "conversations").select(
        node(turn).alias("id"), node(turn).alias("memory_id"), "text", pick(["project", "domain", "global"], conv % 3).alias("layer"), tag("s", conv % 4).alias("scope"), tag("t", turn % 3).alias("topic"),
        F.when(turn % 4 == 0, "explicit").otherwise("automatic").alias("source"), pick(["high", "medium", "low", ""], (conv + turn) % 4).alias("confidence"), (turn % 3).alias("support_count"), tag("p", conv % 5).alias("project"),
        F.lit("2025-01-01T00:00:00Z").alias("first_seen"), F.when((conv % 13 == 0) & (turn % 5 == 1), "2024-01-01T00:00:00Z").otherwise("2025-06-01T00:00:00Z").alias("last_seen"),
        links(turn % 6 == 5, node(turn - 1), F.lit("missing")).alias("supersedes"), links((turn % 6 == 4) & (conv % 2 == 0), node(turn + 1)).alias("superseded_by"),
        links(turn % 7 == 6, node(turn - 2)).alias("contradicts"), never.alias("contradicted_by"), links(turn == 7, node(F.lit(1))).alias("deprecates"), never.alias("deprecated_by"),
        links(turn > 0, node(turn - 1)).alias("derived_from"), links(turn % 2 == 0, tag("sessions/", conv)).alias("drill_paths"),
    )


_NODE_TEXTS = {"text": (15, "text"), "topic": (6, "topic"), "scope": (6, "scope"), "layer": (4, "layer"), "project": (3, "project"), "mid": (1, "memory_id")}
_GONE = f"nodes AS (FROM {_TURN_NODES}), gone AS (SELECT id FROM nodes WHERE NOT {_VALID} UNION SELECT id FROM nodes WHERE len(deprecates) > 0" + "".join(f" UNION SELECT dst FROM (SELECT id, unnest({f}) AS dst FROM nodes WHERE {_VALID}) WHERE id <> dst AND dst IN (SELECT id FROM nodes)" for f in consolidate.LINKS) + ")"
_REPEATED = " + ".join((f"CAST(len(list_filter(string_split_regex(text_l, '[^a-z0-9_]+'), lambda x: x = '{t}')) >= 3 AS INTEGER)" if t.isascii() else f"CAST((length(text_l) - length(replace(text_l, '{t}', ''))) // {len(t)} >= 3 AS INTEGER)") for t in RECORD_QUERY if t not in T.GENERIC_WORDS)
_MEMORY_HITS = f"""{_GONE}, act AS (FROM nodes WHERE id NOT IN (SELECT id FROM gone)), {scored_sql('act', RECORD_QUERY, PROJECT, _NODE_TEXTS, ('text', 'topic'), 'n_')},
adj AS (SELECT *, coalesce({_m("lower(" + _compact("coalesce(text, '')") + ")", P.PROCESS_MEMORY)}, false) AS process, {_REPEATED} >= 2 AS repeated FROM n_z WHERE len(tm) > 0),
pri AS (SELECT * REPLACE (greatest(1, score + CASE WHEN source = 'explicit' THEN 350 ELSE 0 END + CASE confidence WHEN 'high' THEN 110 WHEN 'medium' THEN 40 WHEN 'low' THEN -100 ELSE 0 END
 + CASE WHEN source = 'automatic' AND support_count = 0 THEN -40 ELSE 0 END + CASE layer WHEN 'global' THEN 120 WHEN 'domain' THEN 80 WHEN 'project' THEN 40 ELSE 0 END
 + CASE WHEN source = 'automatic' AND process AND (support_count <= 1 OR repeated) THEN -900 ELSE 0 END
 + CASE WHEN source = 'automatic' AND support_count <= 1 AND confidence IN ('', 'low', 'medium') AND repeated THEN -350 ELSE 0 END) + {search.MEMORY_BONUS} AS score) FROM adj),
top AS (FROM pri QUALIFY row_number() OVER (PARTITION BY layer, scope, topic ORDER BY score DESC, id DESC) = 1),
near AS (FROM top QUALIFY score >= floor(CAST(max(score) OVER () AS DOUBLE) * CAST(0.99 AS DOUBLE))),
anchor AS (SELECT id AS aid, layer AS al, scope AS asc_, topic AS at_ FROM near ORDER BY score DESC, id DESC LIMIT 1),
hits AS (SELECT near.* FROM near, anchor WHERE id = aid OR (NOT (source = 'automatic' AND confidence = 'medium' AND support_count = 1 AND NOT strict AND layer = al AND topic = at_ AND scope <> asc_) AND (layer <> al OR topic = at_)))"""


def _hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes = _turn_nodes(spark, sf_dir)
    return search.memory_hits(nodes, consolidate.inactive_ids(nodes), RECORD_QUERY, search.context_terms(PROJECT))


@_query(f"WITH {_MEMORY_HITS} SELECT id, score, array_to_string(list_sort(m), ' ') AS matched, strict FROM hits")
def memory_recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a query recalls of active memory nodes, ranked by priors and pruned."""
    return _hits(spark, sf_dir).select("id", "score", F.array_join(F.array_sort("matched"), " ").alias("matched"), "strict")


@_query(f"WITH {_GONE}, off AS (FROM nodes WHERE id IN (SELECT id FROM gone)), {scored_sql('off', RECORD_QUERY, PROJECT, _NODE_TEXTS, ('text', 'topic'), 'o_')} SELECT count(*) AS n_matches FROM o_z WHERE score > 0")
def inactive_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many inactive nodes the query would have found."""
    nodes = _turn_nodes(spark, sf_dir)
    return search.inactive_matches(nodes, consolidate.inactive_ids(nodes), RECORD_QUERY, search.context_terms(PROJECT))


_NEED = search.required_tokens(RECORD_QUERY)


@_query(f"""WITH {_MEMORY_HITS}, {_RECORD_CTES},
every AS (SELECT id, 'memory' AS kind, score, m, len(drill_paths) > 0 AS backed FROM hits UNION ALL SELECT 'r' || conv_id || '-' || turn, 'index', score + {search.INDEX_BONUS}, m, false FROM r_z)
SELECT row_number() OVER (ORDER BY kind = 'memory' DESC, score DESC, id DESC) AS rank, id, kind, score, CASE WHEN kind = 'memory' AND backed AND full_ THEN 'supported' ELSE 'unsupported' END AS status,
CASE WHEN kind <> 'memory' THEN 'not_active_memory_node' WHEN NOT backed THEN 'missing_support_drilldown' WHEN NOT full_ THEN 'insufficient_query_support' ELSE 'active_current_memory_with_drilldown_and_query_support' END AS reason
FROM (SELECT *, {f"len(list_intersect(m, {_list(_NEED)})) = {len(_NEED)}" if _NEED else "false"} AS full_ FROM every) QUALIFY rank <= 12""")
def context_package(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first twelve hits of a package, memories before index records, each with whether it supports the query."""
    memories = _hits(spark, sf_dir).select("id", "kind", "score", "matched", "drill_paths")
    records = search.score_records(_records(spark, sf_dir), RECORD_QUERY, search.context_terms(PROJECT)).filter("score > 0")
    others = records.select(F.concat(F.lit("r"), F.col("conv_id").cast("string"), F.lit("-"), F.col("turn").cast("string")).alias("id"), F.lit("index").alias("kind"), (F.col("score") + search.INDEX_BONUS).alias("score"), "matched", F.array().cast("array<string>").alias("drill_paths"))
    return search.context_package(memories.unionByName(others), RECORD_QUERY, 12)


# Lifecycle links.

_FACTS = [(1, "Updated fact: the old plan => the new plan"), (2, "Deleted fact: the lost plan"), (3, "the new plan"), (4, "The  old plan -"), (5, "the lost plan"), (6, "Deleted fact: the lost plan"), (7, None)]


@_query(f"""WITH nodes AS (FROM {_TURN_NODES}), e AS ({' UNION ALL '.join(f"SELECT DISTINCT '{f}' AS f, src, dst FROM (SELECT id AS src, unnest({f}) AS dst FROM nodes) WHERE src <> dst AND dst IN (SELECT id FROM nodes)" for f in consolidate.LINKS)}),
b AS (SELECT dst AS id, max(src) FILTER (f = 'supersedes') AS s, list_sort(list(src) FILTER (f = 'contradicts')) AS c, max(src) FILTER (f = 'deprecates') AS d FROM e GROUP BY 1),
g AS (SELECT src AS id, list_distinct(list(dst)) AS froms FROM e GROUP BY 1)
SELECT n.id, CASE WHEN b.id IS NOT NULL THEN 'low' ELSE confidence END AS confidence, CASE WHEN s IS NOT NULL THEN s ELSE array_to_string(superseded_by, ',') END AS superseded_by, coalesce(array_to_string(c, ','), '') AS contradicted_by, coalesce(d, '') AS deprecated_by,
array_to_string(list_sort(list_distinct(list_concat(derived_from, coalesce(froms, [])))), ',') AS derived_from FROM nodes n LEFT JOIN b ON n.id = b.id LEFT JOIN g ON n.id = g.id""")
def linked_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nodes of all turns with their links written back."""
    got = consolidate.apply_links(_turn_nodes(spark, sf_dir))
    joined = lambda c: F.array_join(F.array_sort(c), ",").alias(c)
    return got.select("id", "confidence", joined("superseded_by"), joined("contradicted_by"), joined("deprecated_by"), joined("derived_from"))


@_query(f"""WITH f AS (SELECT id, text FROM {X.values_sql(_FACTS, ['id', 'text'])} UNION ALL SELECT 1000 + doc_id, text FROM documents),
k AS (SELECT id, lower(trim({_compact('text')}, ' -')) AS key FROM f),
t AS (SELECT DISTINCT a, b FROM (VALUES ('the new plan', 'the old plan'), ('deleted fact: the lost plan', 'the lost plan')) v(a, b))
SELECT DISTINCT x.id AS current, y.id AS old FROM k x JOIN t ON x.key = t.a JOIN k y ON y.key = t.b WHERE x.id <> y.id""")
def text_supersessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Facts that replace others by their texts, among the beginnings of all documents."""
    facts = spark.createDataFrame(_FACTS, "id long, text string")
    docs = _table(spark, sf_dir, "documents").select((F.col("doc_id") + 1000).alias("id"), "text")
    targets = facts.select(T.refresh_targets(F.col("text")).alias("r")).select("r.text", "r.target")
    return consolidate.text_links(facts.unionByName(docs), targets)


@_query(f"""WITH nodes AS (FROM {_TURN_NODES}), l AS ({' UNION ALL '.join(f"SELECT '{f}' AS f, id AS src, unnest({f}) AS dst, 1 AS way FROM nodes UNION ALL SELECT '{f}', unnest({b}), id, 2 FROM nodes" for f, b in consolidate.LINKS.items())}),
p AS (SELECT f, src, dst, bit_or(way) AS ways, count(*) AS n FROM l GROUP BY ALL)
SELECT {', '.join(f"CAST(coalesce(sum(n) FILTER (f = '{f}'), 0) AS BIGINT) AS n_{f}" for f in consolidate.LINKS)}, coalesce(sum(CASE WHEN ways = 3 THEN n ELSE 0 END) / sum(n), 1.0) AS reciprocity,
CAST(coalesce(sum(n) FILTER (dst NOT IN (SELECT id FROM nodes) OR src NOT IN (SELECT id FROM nodes)), 0) AS BIGINT) AS n_broken, (SELECT count(*) FROM nodes) AS n_nodes, (SELECT avg(CASE WHEN len(derived_from) > 0 THEN 1.0 ELSE 0.0 END) FROM nodes) AS derived_share, (SELECT avg(CASE WHEN len(drill_paths) > 0 THEN 1.0 ELSE 0.0 END) FROM nodes) AS evidence_share FROM p""")
def link_integrity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How whole the links and sources of the nodes of all turns are."""
    return consolidate.link_integrity(_turn_nodes(spark, sf_dir))


# Texts brought into form.

FORM_TEXTS = [
    "$skill [a](b) do it", "<oai-mem-citation>x\ny</oai-mem-citation> kept <rollout_ids>z", "line\nMEMORY.md:1|note=[x]\nmore", "please remember: the port is 8080, then run it", "Remember that A uses B", "do not remember this: x", "记住：端口是八千。现在开始", "I prefer short answers", "i want it done", "my preference is that x",
    "records/a.md#L1#x", "plain/path", "a **b " + "word " * 60, "First one. Second one! third " + "tail " * 60, "- bullet one. Next.\n* two？三", "my preference and the roadmap", "logs/2026-05-14T12-30-05Z_x.jsonl", "logs/2026-05-14/x.md", "One\n\n  ", "", None,
]
_FORMS = list(enumerate(FORM_TEXTS))


def _gone(c: str, patterns: tuple[str, ...]) -> str:
    for p in patterns:
        c = f"regexp_replace({c}, '{p}', '', 'g')"
    return c


def _bounded(c: str) -> str:
    head = f"rtrim(left({c}, 237))"
    return f"(CASE WHEN length(regexp_extract({head}, '^(.*[{forms.SENTENCE_END}])', 1)) > 120 THEN regexp_extract({head}, '^(.*[{forms.SENTENCE_END}])', 1) WHEN length(regexp_extract({head}, '^(.*) ', 1)) >= 120 THEN rtrim(regexp_extract({head}, '^(.*) ', 1)) ELSE {head} END || '...')"


_ASKED = "coalesce(" + ", ".join(f"nullif(regexp_extract(text, '{p}', 1), '')" for p in forms.EXPLICIT) + ")"


@_query(f"""WITH b AS (SELECT 'sample' AS origin, id, text FROM {X.values_sql(_FORMS, ['id', 'text'])} UNION ALL SELECT 'document', doc_id, text FROM documents),
f AS (SELECT *, {_compact('text')} AS flat FROM b)
SELECT origin, id, sha256(trim(regexp_replace(flat, '{forms.SKILL_PREFIX}', ''))) AS without_skill, sha256(trim({_gone('text', forms.CITATIONS)}, ' ' || chr(9) || chr(10) || chr(13) || chr(12) || chr(11))) AS without_citations,
CASE WHEN length(flat) <= 240 THEN flat WHEN (length({_bounded('flat')}) - length(replace({_bounded('flat')}, '**', ''))) % 4 = 2 THEN {_bounded("replace(flat, '**', '')")} ELSE {_bounded('flat')} END AS daily,
sha256(lower(left(trim(text), 1)) || substr(trim(text), 2)) AS lower_first,
CASE WHEN NOT {_m('text', P.NEGATED)} THEN nullif(trim({_compact(f"regexp_replace({_ASKED}, '{forms.TASK_TAIL}', '')")}, ' -'), '') END AS explicit_memory,
coalesce({', '.join(f"CASE WHEN regexp_extract(text, '{p}', 1) <> '' THEN '{h}' || regexp_extract(text, '{p}', 1) END" for p, h in forms.NATURAL.items())}) AS natural_memory,
sha256(trim(CASE WHEN contains(text, '#') THEN left(text, instr(text, '#') - 1) ELSE text END)) AS ref_path, sha256(CASE WHEN contains(text, '#') THEN trim(substr(text, instr(text, '#') + 1)) ELSE '' END) AS ref_anchor,
len(list_filter(list_distinct({_tokens('text')}), lambda x: NOT list_contains({_list(T.QUERY_STOP_WORDS + T.GENERIC_WORDS)}, x))) > 5 OR {' + '.join(f"CAST(coalesce({_m('text', p)}, false) AS INTEGER)" for p in forms.FACETS)} >= 2 AS ask_in_parts
FROM f""")
def text_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sample texts and all documents in every form."""
    samples = spark.createDataFrame(_FORMS, "id long, text string").select(F.lit("sample").alias("origin"), "id", "text")
    rows = samples.unionByName(_table(spark, sf_dir, "documents").select(F.lit("document").alias("origin"), F.col("doc_id").alias("id"), "text"))
    t, ref = F.col("text"), forms.source_ref(F.col("text"))
    return rows.select("origin", "id", F.sha2(forms.without_skill(t), 256).alias("without_skill"), F.sha2(forms.without_citations(t), 256).alias("without_citations"), forms.clip_daily(t).alias("daily"), F.sha2(forms.lower_first(t), 256).alias("lower_first"), forms.explicit_memory(t).alias("explicit_memory"), forms.natural_memory(t).alias("natural_memory"), F.sha2(F.when(t.isNotNull(), ref["path"]), 256).alias("ref_path"), F.sha2(ref["anchor"], 256).alias("ref_anchor"), forms.ask_in_parts(t).alias("ask_in_parts"))


_PATHS = [(1, "logs/2026-05-14T12-30-05Z_x.jsonl"), (2, "logs/2026-05-14/x.md"), (3, "a/2025_01_01.txt"), (4, "x/2024-02-30/y"), (5, "2024-01-02T03:04:05/2026-01-01"), (6, ""), (7, None)]
_FULL = f"regexp_extract(path, '{forms.FILE_TIME}', 0)"


@_query(f"""WITH b AS (SELECT id, path FROM {X.values_sql(_PATHS, ['id', 'path'])} UNION ALL SELECT 100 + event_id, 'logs/' || strftime(CAST(ts AS TIMESTAMP), '%Y-%m-%dT%H-%M-%S') || 'Z.jsonl' FROM events),
t AS (SELECT *, coalesce(CASE WHEN {_FULL} <> '' THEN try_cast(regexp_extract(path, '{forms.FILE_TIME}', 1) || ' ' || regexp_extract(path, '{forms.FILE_TIME}', 2) || ':' || regexp_extract(path, '{forms.FILE_TIME}', 3) || ':' || regexp_extract(path, '{forms.FILE_TIME}', 4) AS TIMESTAMP) END,
CASE WHEN regexp_extract(path, '\\d{{4}}-\\d{{2}}-\\d{{2}}', 0) <> '' THEN try_cast(regexp_extract(path, '\\d{{4}}-\\d{{2}}-\\d{{2}}', 0) AS TIMESTAMP) END) AS tm FROM b)
SELECT id, 'sessions/' || strftime(tm, '%Y/%m/%d') || '/' || strftime(tm, '%Y-%m-%dT%H%M%SZ') || '_x_' || left(sha256(path), 10) AS folder FROM t""")
def record_folders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where records go by the time in their paths: sample paths, and one of each event."""
    name = F.concat(F.lit("logs/"), F.date_format(F.col("ts").cast("timestamp"), "yyyy-MM-dd'T'HH-mm-ss"), F.lit("Z.jsonl"))
    rows = spark.createDataFrame(_PATHS, "id long, path string").unionByName(_table(spark, sf_dir, "events").select((F.col("event_id") + 100).alias("id"), name.alias("path")))
    return rows.select("id", forms.record_folder(forms.time_of_path(F.col("path")), F.lit("x"), F.sha2("path", 256)).alias("folder"))
