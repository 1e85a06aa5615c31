"""The engine's queries over the input tables, and the same in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import audit, consolidate, evaluate, ingest, review, search
from ..sources.sinks import daily_summaries
from . import fixtures as X

QUERIES: dict = {}
SQL: dict[str, str] = {}


def _query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return add


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# Parts of SQL for DuckDB.


def _list(values: list[str]) -> str:
    return "[" + ", ".join(f"'{v}'" for v in values) + "]"


def _tokens(c: str) -> str:
    return f"list_transform(regexp_extract_all(coalesce({c}, ''), '[\\p{{L}}\\p{{N}}_.-]+'), lambda x: lower(x))"


def _importance(t: str) -> str:
    return f"CASE WHEN regexp_matches({t}, '[^\\x00-\\x7F]') THEN 5 WHEN regexp_matches({t}, '[_.-]') THEN 4 WHEN regexp_matches({t}, '[0-9]') AND length({t}) >= 6 THEN 4 WHEN length({t}) >= 10 THEN 3 WHEN length({t}) >= 7 THEN 2 ELSE 1 END"


def _words(c: str) -> str:
    return f"regexp_extract_all(lower(coalesce({c}, '')), '[a-z0-9]+')"


def _canonical(w: str) -> str:
    return "CASE " + " ".join(f"WHEN list_contains({_list(v.split())}, {w}) THEN '{k}'" for k, v in T.SYNONYMS.items()) + f" ELSE {w} END"


def _semantic(c: str) -> str:
    kept = f"list_filter(list_transform({_words(c)}, lambda x: {_canonical('x')}), lambda x: NOT list_contains({_list(T.NEGATIVE_CUES + T.SEMANTIC_STOP_WORDS)}, x))"
    single = f"list_transform({kept}, lambda x: CASE WHEN x LIKE '%ies' AND length(x) > 4 THEN left(x, length(x) - 3) || 'y' WHEN x LIKE '%s' AND length(x) > 4 THEN left(x, length(x) - 1) ELSE x END)"
    return f"list_sort(list_distinct(list_filter({single}, lambda x: length(x) >= 3)))"


def _polarity(c: str) -> str:
    return f"CASE WHEN list_has_any({_words(c)}, {_list(T.NEGATIVE_CUES)}) THEN -1 WHEN list_has_any(list_transform({_words(c)}, lambda x: {_canonical('x')}), {_list(T.POSITIVE_CUES)}) THEN 1 ELSE 0 END"


_WHITE = "[ \\t\\n\\x0B\\f\\r]+"


def _compact(c: str) -> str:
    return f"trim(regexp_replace({c}, '{_WHITE}', ' ', 'g'))"


def _normal(c: str) -> str:
    return f"trim({_compact(c)}, ' -')"


def _clip(c: str, limit: int) -> str:
    return f"CASE WHEN length({_compact(c)}) <= {limit} THEN {_compact(c)} ELSE rtrim(left({_compact(c)}, {limit - 3})) || '...' END"


def _answer(c: str) -> str:
    return f"trim(regexp_replace(lower(coalesce({c}, '')), '[^\\p{{L}}\\p{{N}}_]+', ' ', 'g'))"


# Recall.


#: A query's tokens: plain words only, and with a word of another script, which a hit must then hold.
PLAIN_QUERY, SPECIFIC_QUERY = ["nicht", "und", "die", "der", "que"], ["que", "aié", "une", "les"]


def recall_sql(query: list[str], limit: int) -> str:
    plain = lambda t: t.isascii() and t.isalnum()
    times = [f"len(list_filter(w, lambda x: x = '{t}'))" if plain(t) else f"((length(low) - length(replace(low, '{t}', ''))) // {len(t)})" for t in query]
    score = " + ".join(f"least({n}, 5) * {search._importance(t)}" for n, t in zip(times, query, strict=True))
    matched = ", ".join(f"CASE WHEN {n} > 0 THEN '{t}' END" for n, t in zip(times, query, strict=True))
    meaningful = [t for t in query if t not in T.GENERIC_WORDS]
    needed = [t for t in query if search.is_important(t)] or meaningful
    specific = [t for t in meaningful if search._importance(t) >= 4]
    return f"""
WITH c AS (SELECT conv_id, turn, lower(coalesce(text, '')) AS low, string_split_regex(low, '[^a-z0-9_]+') AS w FROM conversations),
s AS (SELECT conv_id, turn, CAST({score} AS BIGINT) AS score, list_filter([{matched}], lambda x: x IS NOT NULL) AS m FROM c)
SELECT conv_id, turn, score, array_to_string(m, ' ') AS matched FROM s
WHERE score > 0 AND list_has_any(m, {_list(needed)}) {f"AND list_has_any(m, {_list(specific)})" if specific else ""}
ORDER BY score DESC, conv_id DESC, turn DESC LIMIT {limit}"""


def _recall(spark: SparkSession, sf_dir: str, query: list[str]) -> DataFrame:
    found = search.top_hits(search.score_text(_table(spark, sf_dir, "conversations").select("conv_id", "turn", "text"), query), 8, "conv_id", "turn")
    return found.select("conv_id", "turn", F.col("score").cast("long").alias("score"), F.array_join("matched", " ").alias("matched"))


@_query(recall_sql(PLAIN_QUERY, 8))
def recall_topk_conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The eight turns that score best for a query of plain words."""
    return _recall(spark, sf_dir, PLAIN_QUERY)


@_query(recall_sql(SPECIFIC_QUERY, 8))
def recall_specific_conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same for a query with a specific word, which gates the hits."""
    return _recall(spark, sf_dir, SPECIFIC_QUERY)


_RANKED = f"""
q AS (SELECT item_id, unnest(list_distinct({_tokens('text')})) AS token FROM benchmark),
a AS (SELECT * FROM q WHERE NOT list_contains({_list(T.QUERY_STOP_WORDS)}, token)),
d AS (SELECT doc_id, token, count(*) AS times FROM (SELECT doc_id, unnest({_tokens('text')}) AS token FROM documents) GROUP BY ALL),
s AS (SELECT item_id, doc_id, sum(least(times, 5) * ({_importance('d.token')})) AS score FROM d JOIN a USING (token) GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id DESC) AS place FROM s QUALIFY place <= 10)"""


@_query(f"WITH {_RANKED} SELECT item_id, doc_id, CAST(score AS BIGINT) AS score, place FROM r")
def passage_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For every benchmark item the ten documents that score best for its tokens."""
    got = search.rank_passages(_table(spark, sf_dir, "benchmark"), _table(spark, sf_dir, "documents"), 10)
    return got.select("item_id", "doc_id", F.col("score").cast("long").alias("score"), "place")


def _relevant(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    items, docs = _table(spark, sf_dir, "benchmark"), _table(spark, sf_dir, "documents")
    ranked = search.rank_passages(items, docs, 10)
    texts = ranked.join(items.select("item_id", F.col("text").alias("passage")), "item_id").join(docs.select("doc_id", "text"), "doc_id")
    told = texts.select(F.col("item_id").alias("case_id"), "place", F.coalesce(F.contains("text", "passage"), F.lit(False)).alias("relevant"))
    return told, items.select(F.col("item_id").alias("case_id"))


_METRICS = f"""{_RANKED},
f AS (SELECT r.item_id, min(place) AS rank FROM r JOIN benchmark b USING (item_id) JOIN documents d USING (doc_id) WHERE contains(d.text, b.text) GROUP BY 1),
m AS (SELECT count(*) AS n_cases, avg(CASE WHEN rank <= 5 THEN 1.0 ELSE 0.0 END) AS recall_at_5, avg(coalesce(1.0 / rank, 0.0)) AS mrr,
  avg(CASE WHEN rank <= 5 THEN 1.0 / log2(rank + 1.0) ELSE 0.0 END) AS ndcg_at_5 FROM (SELECT DISTINCT item_id FROM benchmark) LEFT JOIN f USING (item_id))"""


@_query(f"WITH {_METRICS} SELECT n_cases, round(recall_at_5, 9) AS recall_at_5, round(mrr, 9) AS mrr, round(ndcg_at_5, 9) AS ndcg_at_5 FROM m")
def rank_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Recall at 5, reciprocal rank and nDCG of that ranking; a document is relevant that holds the passage verbatim."""
    got = evaluate.rank_metrics(*_relevant(spark, sf_dir))
    return got.select("n_cases", *(F.round(c, 9).alias(c) for c in ("recall_at_5", "mrr", "ndcg_at_5")))


@_query(f"""WITH {_METRICS}, v AS (UNPIVOT (SELECT recall_at_5, mrr, ndcg_at_5 FROM m) ON recall_at_5, mrr, ndcg_at_5 INTO NAME metric VALUE value),
t AS (SELECT metric, kind, arg_max(bound, ordinal) AS bound FROM {X.values_sql(X.THRESHOLDS, ["metric", "kind", "bound", "ordinal"])} GROUP BY ALL)
SELECT t.metric, kind, CAST(bound AS DOUBLE) AS bound, round(v.value, 9) AS value FROM t LEFT JOIN v USING (metric)
WHERE value IS NULL OR CASE WHEN kind = 'floor' THEN value < bound ELSE value > bound END""")
def threshold_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Metrics of the ranking that miss their thresholds."""
    got = evaluate.rank_metrics(*_relevant(spark, sf_dir))
    long = got.select(F.expr("stack(3, 'recall_at_5', recall_at_5, 'mrr', mrr, 'ndcg_at_5', ndcg_at_5) AS (metric, value)"))
    bounds = spark.createDataFrame(X.THRESHOLDS, "metric string, kind string, bound double, ordinal int")
    return evaluate.threshold_failures(long, bounds).withColumn("value", F.round("value", 9))


# Text.


@_query(f"""WITH t AS (SELECT lang, doc_id, unnest(list_distinct({_tokens('text')})) AS token FROM documents)
SELECT lang, {_importance('token')} AS importance, count(*) AS n_tokens, count(DISTINCT doc_id) AS n_docs FROM t GROUP BY ALL""")
def token_importance_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct tokens of documents by language and importance."""
    each = _table(spark, sf_dir, "documents").select("lang", "doc_id", F.explode(T.tokens(F.col("text"))).alias("token"))
    return each.groupBy("lang", T.token_importance(F.col("token")).alias("importance")).agg(F.count(F.lit(1)).alias("n_tokens"), F.count_distinct("doc_id").alias("n_docs"))


@_query(f"""SELECT doc_id, {_clip('text', 120)} AS title,
CASE WHEN slug <> '' THEN slug ELSE 'item' END AS slug, CASE WHEN regexp_matches(text, '{T.UNSAFE_DISPLAY}') THEN '[unsafe-field]' ELSE {_clip('text', 60)} END AS display
FROM (SELECT doc_id, text, trim(left(trim(regexp_replace(lower(text), '[^a-z0-9]+', '-', 'g'), '-'), 80), '-') AS slug FROM documents)""")
def document_titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Titles, slugs and safe display texts."""
    return _table(spark, sf_dir, "documents").select("doc_id", T.clip(F.col("text"), 120).alias("title"), T.slugify(F.col("text")).alias("slug"), T.safe_display(F.col("text"), 60).alias("display"))


def _redact_sql() -> str:
    now, counts, steps = "coalesce(text, '')", [], []
    for k, (name, pattern) in enumerate(T.REDACTIONS.items()):
        counts.append(f"len(regexp_extract_all(t{k}, '{pattern}')) AS {name}")
        steps.append(f"{now} AS t{k}")
        now = f"regexp_replace(t{k}, '{pattern}', '\\1[REDACTED_{name.upper()}]', 'g')"
    return f"SELECT id, sha256(t_end) AS redacted_sha256, {', '.join(counts)} FROM (SELECT id, {', '.join(steps)}, {now} AS t_end FROM (SELECT doc_id AS id, text FROM documents UNION ALL SELECT -id, text FROM {X.values_sql(X.SECRETS, ['id', 'text'])}))"


@_query(_redact_sql())
def redact_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents and the made-up secrets redacted, with counts by category."""
    rows = _table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text").unionByName(spark.createDataFrame(X.SECRETS, "id long, text string").withColumn("id", -F.col("id")))
    return rows.select("id", T.redact(F.col("text")).alias("r")).select("id", F.sha2("r.text", 256).alias("redacted_sha256"), *(f"r.{c}" for c in T.REDACTIONS))


def _preview_sql() -> str:
    now = "coalesce(text, '')"
    for name, pattern in T.PREVIEW_REDACTIONS.items():
        now = f"regexp_replace({now}, '{pattern}', '[REDACTED_{name}]', 'g')"
    return f"SELECT doc_id, {_clip('p', T.PREVIEW_LENGTH)} AS preview FROM (SELECT doc_id, regexp_replace({now}, '[\\x00-\\x1F\\x7F]+', ' ', 'g') AS p FROM documents)"


@_query(_preview_sql())
def redacted_previews(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A redacted preview of every document."""
    return _table(spark, sf_dir, "documents").select("doc_id", T.preview(F.col("text")).alias("preview"))


@_query("WITH l AS (SELECT doc_id, generate_subscripts(s, 1) AS line_number, unnest(s) AS line FROM (SELECT doc_id, string_split_regex(coalesce(text, ''), '\\r?\\n') AS s FROM documents)) " + " UNION ALL ".join(f"SELECT doc_id, line_number, '{c}' AS category FROM l WHERE regexp_matches(line, '{p}')" for c, p in T.PREVIEW_REDACTIONS.items()))
def secret_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of documents with something that a preview would hide."""
    return audit.secret_lines(_table(spark, sf_dir, "documents"))


@_query(f"""SELECT id, CASE WHEN fresh THEN new WHEN gone <> '' THEN 'Deleted fact: ' || gone WHEN worn <> '' THEN 'Deprecated fact: ' || worn ELSE text END AS text,
CASE WHEN fresh THEN old WHEN gone <> '' THEN gone WHEN worn <> '' THEN worn END AS target
FROM (SELECT *, coalesce(old <> '' AND new <> '' AND lower(old) <> lower(new), false) AS fresh FROM (SELECT id, text,
{_normal(f"regexp_extract(text, '{T.REFRESH}', 1)")} AS old, {_normal(f"regexp_extract(text, '{T.REFRESH}', 2)")} AS new,
{_normal(f"regexp_extract(text, '{T.DELETION}', 1)")} AS gone, {_normal(f"regexp_extract(text, '{T.DEPRECATION}', 1)")} AS worn FROM (FROM {X.values_sql(X.FACTS, ['id', 'text'])} UNION ALL SELECT 1000 + conv_id * 1000 + turn, CASE turn % 4 WHEN 0 THEN 'Updated fact: ' || f || ' => ' || role || ' said so' WHEN 1 THEN 'Deleted fact: ' || f WHEN 2 THEN 'deprecating fact: ' || f ELSE f END FROM (SELECT conv_id, turn, role, {_compact('text')} AS f FROM conversations))))""")
def refresh_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Facts that replace, delete or deprecate others, and what they aim at: all turns, told as such facts, and made-up ones."""
    turns = _table(spark, sf_dir, "conversations").withColumn("f", T.compact_whitespace(F.col("text")))
    said = F.when(F.col("turn") % 4 == 0, F.concat(F.lit("Updated fact: "), "f", F.lit(" => "), "role", F.lit(" said so"))).when(F.col("turn") % 4 == 1, F.concat(F.lit("Deleted fact: "), "f")).when(F.col("turn") % 4 == 2, F.concat(F.lit("deprecating fact: "), "f")).otherwise(F.col("f"))
    facts = spark.createDataFrame(X.FACTS, "id long, text string").unionByName(turns.select((1000 + F.col("conv_id") * 1000 + F.col("turn")).alias("id"), said.alias("text")))
    return facts.select("id", T.refresh_targets(F.col("text")).alias("r")).select("id", "r.text", "r.target")


@_query(f"""WITH p AS (SELECT a.conv_id, a.turn, coalesce(b.text, '') AS answer, coalesce(a.text, '') AS reference FROM conversations a JOIN conversations b ON a.conv_id = b.conv_id AND b.turn = a.turn + 1)
SELECT conv_id, turn, CASE WHEN reference <> '' AND contains(answer, reference) THEN 'exact' WHEN r <> '' AND contains(n, r) THEN 'normalized' ELSE 'other' END AS verdict
FROM (SELECT *, {_answer('answer')} AS n, {_answer('reference')} AS r FROM p)""")
def answer_containment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether a turn's text occurs in the next turn's, as it stands or normalised."""
    c = _table(spark, sf_dir, "conversations")
    pairs = c.select("conv_id", "turn", F.coalesce("text", F.lit("")).alias("reference")).join(c.select("conv_id", (F.col("turn") - 1).alias("turn"), F.coalesce("text", F.lit("")).alias("answer")), ["conv_id", "turn"])
    verdict = evaluate.answer_verdict(F.col("answer"), F.col("reference"), F.lit(0.0))
    return pairs.select("conv_id", "turn", F.when(verdict == "miss", "other").otherwise(verdict).alias("verdict"))


@_query(f"""WITH a AS (SELECT id, list_filter(string_split({_answer('answer')}, ' '), lambda x: x <> '') AS w, list_filter(string_split({_answer('reference')}, ' '), lambda x: x <> '') AS r FROM (FROM {X.values_sql(X.ANSWERS, ['id', 'answer', 'reference'])} UNION ALL SELECT 1000 + a.p_partkey, a.p_name || ' ' || a.p_type, b.p_name FROM part a JOIN part b ON b.p_partkey = a.p_partkey + 1)),
p AS (SELECT id, r, least(len(w), len(r)) AS n, list_slice(w, i, i + least(len(w), len(r)) - 1) AS piece FROM (SELECT *, unnest(range(1, greatest(len(w) - least(len(w), len(r)) + 1, 1) + 1)) AS i FROM a)),
f AS (SELECT id, CASE WHEN n < 1 THEN 0.0 ELSE 2.0 * list_sum(list_transform(list_distinct(r), lambda t: least(len(list_filter(piece, lambda x: x = t)), len(list_filter(r, lambda x: x = t))))) / (len(piece) + len(r)) END AS f1 FROM p)
SELECT id, round(max(CAST(f1 AS DOUBLE)), 9) AS f1, max(f1) >= 0.8 AS passed FROM f GROUP BY id""")
def answer_token_f1(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token F1 of answers against their references: of each part against the next one's name, and made-up ones."""
    parts = _table(spark, sf_dir, "part")
    answers = parts.select("p_partkey", F.concat_ws(" ", "p_name", "p_type").alias("answer")).join(parts.select((F.col("p_partkey") - 1).alias("p_partkey"), F.col("p_name").alias("reference")), "p_partkey")
    rows = spark.createDataFrame(X.ANSWERS, "id long, answer string, reference string").unionByName(answers.select((1000 + F.col("p_partkey")).alias("id"), "answer", "reference"))
    f1 = evaluate.token_f1(F.col("answer"), F.col("reference"))
    return rows.select("id", F.round(f1, 9).alias("f1"), (f1 >= 0.8).alias("passed"))


# Ingestion.


@_query("SELECT conv_id, turn, sha256(coalesce(text, '')) AS event_sha256, left(sha256(conv_id::VARCHAR || chr(10) || turn::VARCHAR || chr(10) || sha256(coalesce(text, ''))), 16) AS source_anchor_id FROM conversations")
def event_anchors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hashes and anchors of all turns."""
    return ingest.event_anchors(_table(spark, sf_dir, "conversations"), "conv_id", "turn").select("conv_id", "turn", "event_sha256", "source_anchor_id")


@_query("SELECT sha256(coalesce(text, '')) AS sha256, count(*) AS n_copies, min(doc_id) AS first_id, count(DISTINCT source) AS n_sources FROM documents GROUP BY 1 HAVING count(*) > 1")
def exact_duplicate_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts that several documents hold."""
    docs = _table(spark, sf_dir, "documents").withColumn("sha256", F.sha2(F.coalesce("text", F.lit("")), 256))
    return docs.groupBy("sha256").agg(F.count(F.lit(1)).alias("n_copies"), F.min("doc_id").alias("first_id"), F.count_distinct("source").alias("n_sources")).filter("n_copies > 1")


def _records(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _table(spark, sf_dir, "events")
    return e.select(F.col("user_id").cast("string").alias("partition"), F.col("event_id").cast("string").alias("path"), F.col("ts").alias("updated_at"), F.sha2("props", 256).alias("sha256"), "event_type")


_RECORDS = "e AS (SELECT CAST(user_id AS VARCHAR) AS part, CAST(event_id AS VARCHAR) AS path, ts, sha256(props) AS h, event_type FROM events)"


@_query(f'WITH {_RECORDS} SELECT part AS "partition", max(ts) AS high_water, count(*) AS n_records FROM e GROUP BY 1')
def high_water_marks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The newest record of each user's stream."""
    return ingest.high_water(_records(spark, sf_dir))


@_query(f"""WITH {_RECORDS}, a AS (SELECT * FROM e WHERE ts < TIMESTAMP '2024-01-20' AND event_type <> 'error'),
hw AS (SELECT part, max(ts) AS hw FROM a GROUP BY 1), own AS (SELECT part, path, list(h) AS hs FROM a GROUP BY 1, 2), seen AS (SELECT DISTINCT part, h FROM a),
l AS (SELECT DISTINCT part, path FROM e WHERE event_type = 'error' AND ts < TIMESTAMP '2024-01-03')
SELECT e.part AS "partition", e.path, e.ts AS updated_at, e.h AS sha256 FROM e LEFT JOIN hw USING (part) LEFT JOIN own ON own.part = e.part AND own.path = e.path
LEFT JOIN seen ON seen.part = e.part AND seen.h = e.h LEFT JOIN l ON l.part = e.part AND l.path = e.path
WHERE NOT coalesce(l.path IS NULL AND ((e.ts < hw AND NOT coalesce(NOT list_contains(hs, e.h), false)) OR (e.ts = hw AND seen.h IS NOT NULL)), false)""")
def incremental_selection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events to ingest, where those before a cutoff are archived but for errors, and early errors are pending."""
    every = _records(spark, sf_dir)
    before = every.filter((F.col("updated_at") < F.lit("2024-01-20").cast("timestamp")) & (F.col("event_type") != "error"))
    ledger = every.filter((F.col("event_type") == "error") & (F.col("updated_at") < F.lit("2024-01-03").cast("timestamp")))
    return ingest.select_fresh(every.drop("event_type"), before, ledger)


@_query("SELECT o_custkey, o_orderdate, o_orderkey, o_totalprice FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) = 1")
def latest_order_per_customer(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The latest row of each key."""
    orders = _table(spark, sf_dir, "orders").select("o_custkey", "o_orderdate", "o_orderkey", "o_totalprice")
    return ingest.latest_rows(orders, ["o_custkey"], "o_orderdate", "o_orderkey")


@_query("""WITH r AS (SELECT conv_id AS session, string_agg(text, chr(10) ORDER BY turn) AS recent_user FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS k FROM conversations WHERE role = 'user' QUALIFY k <= 5) GROUP BY 1)
SELECT conv_id AS session, count(*) AS n_events, count(*) FILTER (role = 'user') AS n_user, arg_min(text, turn) FILTER (role = 'user') AS user_intent, arg_max(text, turn) FILTER (role = 'assistant') AS final_state, any_value(r.recent_user) AS recent_user
FROM conversations LEFT JOIN r ON r.session = conv_id GROUP BY conv_id""")
def session_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every conversation rolled up."""
    c = _table(spark, sf_dir, "conversations")
    return ingest.session_rollup(c.select(F.col("conv_id").alias("session"), F.col("turn").alias("ordinal"), F.col("role").alias("kind"), "text"))


@_query("SELECT CAST(ts AS DATE) AS day, event_type, count(*) AS n_rows FROM events GROUP BY ALL")
def daily_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events by day and type."""
    return daily_summaries(_table(spark, sf_dir, "events").withColumn("day", F.to_date("ts")), "day", "event_type")


@_query("SELECT event_type, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, count(*) AS n_events, round(sum(value), 4) AS total FROM events GROUP BY ALL")
def metric_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Values at a JSON path, by event type."""
    return _table(spark, sf_dir, "events").groupBy("event_type", F.get_json_object("props", "$.k").cast("long").alias("k")).agg(F.count(F.lit(1)).alias("n_events"), F.round(F.sum("value"), 4).alias("total"))


# Consolidation.

_FACTS = f"""k AS (SELECT doc_id AS id, source AS project, coalesce(text, '') AS text, {_semantic('text')} AS toks FROM documents),
g AS (SELECT *, CASE WHEN len(toks) < 4 THEN 'literal:' || lower({_normal('text')}) ELSE 'semantic:' || CAST({_polarity('text')} AS VARCHAR) || ':' || array_to_string(toks, ' ') END AS node_key FROM k),
n AS (SELECT node_key, arg_min(text, id) AS text, arg_min(project, id) AS project, count(*) AS support_count, count(DISTINCT project) AS project_count, min(id) AS first_id, max(id) AS last_id FROM g GROUP BY 1)"""
_LAYER = f"CASE WHEN regexp_matches(lower(text), '{'|'.join(T.GLOBAL_HINTS)}') THEN 'global' WHEN project_count >= 2 THEN 'domain' ELSE 'project' END"
_TOPIC = "CASE " + " ".join(f"WHEN regexp_matches(lower(text), '{'|'.join(h.split())}') THEN '{k}'" for k, h in T.TOPICS.items()) + " ELSE 'general' END"


@_query(f"""WITH {_FACTS} SELECT sha256(node_key) AS node_sha256, support_count, project_count, first_id, last_id, {_LAYER} AS layer, {_TOPIC} AS topic,
CASE {_LAYER} WHEN 'global' THEN 'global' WHEN 'domain' THEN 'domain:' || {_TOPIC} ELSE 'project:' || coalesce(project, '') END AS scope,
CASE WHEN support_count >= 2 OR {_LAYER} = 'global' THEN 'high' ELSE 'medium' END AS confidence FROM n""")
def consolidated_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents as facts, consolidated to nodes."""
    facts = _table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.coalesce("text", F.lit("")).alias("text"), F.col("source").alias("project"))
    return consolidate.consolidate(facts).select("node_sha256", "support_count", "project_count", "first_id", "last_id", "layer", "topic", "scope", "confidence")


@_query(f"SELECT lang, {_polarity('text')} AS polarity, count(*) AS n_docs FROM documents GROUP BY ALL")
def polarity_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents by language and polarity."""
    return _table(spark, sf_dir, "documents").groupBy("lang", T.semantic_polarity(F.col("text")).alias("polarity")).agg(F.count(F.lit(1)).alias("n_docs"))


def _pairs_sql(source: str) -> str:
    return f"""WITH t AS (SELECT id, {_semantic('text')} AS toks, {_polarity('text')} AS pol FROM {source} WHERE text IS NOT NULL),
c AS (SELECT toks, pol, min(id) AS first_id, max(id) AS last_id FROM t WHERE len(toks) >= 4 GROUP BY ALL),
p AS (SELECT a.last_id AS current_id, b.first_id AS old_id, a.toks AS x, b.toks AS y, len(list_intersect(a.toks, b.toks)) AS both_n, a.pol <> 0 AND b.pol <> 0 AND a.pol <> b.pol AS opposed FROM c a JOIN c b ON b.first_id < a.last_id AND list_has_any(a.toks, b.toks)),
r AS (SELECT *, both_n / CAST(len(x) + len(y) - both_n AS DOUBLE) AS ratio, both_n = len(x) AND len(x) < len(y) AS narrower FROM p WHERE both_n >= 4)
SELECT current_id, old_id, relation FROM (SELECT current_id, old_id, CASE WHEN opposed AND ratio >= 0.6 THEN 'contradiction' WHEN opposed AND ratio >= 0.45 THEN 'contradiction_review'
WHEN narrower AND list_has_all({_list(consolidate.DETAIL_WORDS)}, list_filter(y, lambda w: NOT list_contains(x, w))) THEN 'partial_supersession' WHEN narrower THEN 'scope_review' WHEN ratio >= 0.45 THEN 'overlap_review' ELSE '' END AS relation FROM r) WHERE relation <> ''"""


_FACT_PAIRS = f"(FROM {X.values_sql(X.PAIRS, ['id', 'text'])} UNION ALL SELECT 1000 + p_partkey, CASE p_partkey % 3 WHEN 0 THEN 'never keep ' WHEN 1 THEN 'always include ' ELSE '' END || p_name FROM part)"


def _fact_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The made-up facts, which have a pair of each kind, and all parts' names, told for, against or neither."""
    told = F.concat(F.when(F.col("p_partkey") % 3 == 0, "never keep ").when(F.col("p_partkey") % 3 == 1, "always include ").otherwise(""), "p_name")
    parts = _table(spark, sf_dir, "part").select((1000 + F.col("p_partkey")).alias("id"), told.alias("text"))
    return consolidate.related_pairs(spark.createDataFrame(X.PAIRS, "id long, text string").unionByName(parts))


@_query(_pairs_sql(_FACT_PAIRS))
def related_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Relations of made-up facts, one for each kind, and of the parts' names."""
    return _fact_pairs(spark, sf_dir)


_PARTS_SQL = _pairs_sql("(SELECT p_partkey AS id, p_name || ' ' || p_brand || ' ' || p_type || ' size ' || p_size AS text FROM part)")


@_query(_PARTS_SQL)
def related_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Relations of all parts, described as facts."""
    told = F.concat_ws(" ", "p_name", "p_brand", "p_type", F.lit("size"), F.col("p_size").cast("string"))
    return consolidate.related_pairs(_table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), told.alias("text")))


@_query(f"""WITH t AS (SELECT id, {_semantic('text')} AS toks, {_polarity('text')} AS pol FROM (SELECT p_partkey AS id, p_name || ' ' || p_brand || ' ' || p_type AS text FROM part UNION ALL SELECT -doc_id - 1, text FROM documents) WHERE text IS NOT NULL)
SELECT id, min(id) OVER (PARTITION BY toks, pol) AS class_id, count(*) OVER (PARTITION BY toks, pol) AS n_facts FROM t WHERE len(toks) >= 4""")
def fact_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The class of every part, described as a fact, and of every document."""
    told = F.concat_ws(" ", "p_name", "p_brand", "p_type")
    parts = _table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), told.alias("text"))
    return consolidate.fact_classes(parts.unionByName(_table(spark, sf_dir, "documents").select((-F.col("doc_id") - 1).alias("id"), "text")))


_CANDIDATES = f"""r AS ({_pairs_sql(_FACT_PAIRS)}), c AS (SELECT *, CAST(current_id AS VARCHAR) || '|' || CAST(old_id AS VARCHAR) AS pair, CASE relation {" ".join(f"WHEN '{k}' THEN '{v}'" for k, v in review.REASONS.items())} END AS reason FROM r WHERE relation <> 'partial_supersession'),
q AS (SELECT sha256(pair) AS candidate_id, current_id, old_id, reason, sha256(pair || '|' || relation) AS fingerprint FROM c)"""


def _candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return review.review_candidates(_fact_pairs(spark, sf_dir))


@_query(f"WITH {_CANDIDATES} SELECT * FROM q")
def review_queue(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The facts' pairs to review."""
    return _candidates(spark, sf_dir)


@_query(f"""WITH {_CANDIDATES}, d AS (SELECT decision_id, sha256(pair) AS candidate_id, sha256(pair || '|' || relation) AS fingerprint, action FROM {X.values_sql(X.DECISIONS, ["decision_id", "pair", "relation", "action"])}
UNION ALL SELECT 1000000000 + (current_id * 1000000 + old_id) * 10 + again, candidate_id, CASE WHEN old_id % 3 = 0 THEN 'outdated' ELSE fingerprint END, CASE (current_id + again * (old_id % 2)) % 4 WHEN 0 THEN 'merge' WHEN 1 THEN 'ignore' ELSE 'approve' END FROM q, (VALUES (0), (1)) v(again) WHERE current_id > 1000 AND (again = 0 OR current_id % 5 = 0)),
s AS (SELECT candidate_id, count(DISTINCT action) AS actions, min(decision_id) AS first FROM d GROUP BY 1)
SELECT decision_id, CASE WHEN actions > 1 THEN 'conflicting' WHEN decision_id <> first THEN 'duplicate' WHEN q.fingerprint IS NULL THEN 'unknown' WHEN d.fingerprint <> q.fingerprint THEN 'stale' WHEN action = 'approve' THEN 'applied' WHEN action = 'ignore' THEN 'ignored' ELSE 'unsafe' END AS status
FROM d JOIN s USING (candidate_id) LEFT JOIN q ON q.candidate_id = d.candidate_id""")
def decision_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Decisions held against that queue: made-up ones, and one or two for each pair of parts."""
    queue = _candidates(spark, sf_dir)
    parts = queue.filter("current_id > 1000").withColumn("again", F.explode(F.when(F.col("current_id") % 5 == 0, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))))
    turn = (F.col("current_id") + F.col("again") * (F.col("old_id") % 2)) % 4
    ruled = parts.select((1000000000 + (F.col("current_id") * 1000000 + F.col("old_id")) * 10 + F.col("again")).alias("decision_id"), "candidate_id", F.when(F.col("old_id") % 3 == 0, "outdated").otherwise(F.col("fingerprint")).alias("fingerprint"), F.when(turn == 0, "merge").when(turn == 1, "ignore").otherwise("approve").alias("action"))
    told = spark.createDataFrame(X.DECISIONS, "decision_id long, pair string, relation string, action string")
    made = told.select("decision_id", F.sha2("pair", 256).alias("candidate_id"), F.sha2(F.concat_ws("|", "pair", "relation"), 256).alias("fingerprint"), "action")
    return review.decision_status(made.unionByName(ruled), queue)


@_query(f"WITH r AS ({_PARTS_SQL}), c AS (SELECT *, CASE relation {' '.join(f"WHEN '{k}' THEN '{v}'" for k, v in review.REASONS.items())} END AS reason FROM r) SELECT current_id, reason, min(old_id) AS representative_id, count(*) AS n_older FROM c WHERE reason IS NOT NULL GROUP BY ALL")
def compressed_review(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of parts to review, compressed by the newer one and the reason."""
    return review.compressed_pairs(review.review_candidates(related_parts(spark, sf_dir)))


_NODES = f"nodes AS (SELECT * FROM {X.nodes_sql()})"
_TIME = lambda c: f"TRY_CAST({c} AS TIMESTAMPTZ)"
_ORDERED = f"coalesce({_TIME('first_seen')} <= {_TIME('last_seen')}, false)"
_VALID = f"({_ORDERED} OR (first_seen = '' AND last_seen = ''))"
_INACTIVE = f"{_NODES}, gone AS (SELECT id FROM nodes WHERE NOT {_VALID} UNION SELECT id FROM nodes WHERE len(deprecates) > 0" + "".join(f" UNION SELECT dst FROM (SELECT id, unnest({f}) AS dst FROM nodes WHERE {_VALID}) WHERE id <> dst AND dst IN (SELECT id FROM nodes)" for f in consolidate.LINKS) + ")"


@_query(f"WITH {_INACTIVE} SELECT id, NOT id IN (SELECT id FROM gone) AS active FROM nodes")
def active_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which of the nodes of all turns and the made-up ones are active."""
    nodes = X.nodes(spark, sf_dir)
    gone = consolidate.inactive_ids(nodes).withColumn("gone", F.lit(True))
    return nodes.join(gone, "id", "left").select("id", F.col("gone").isNull().alias("active"))


@_query(f"WITH {_NODES}, " + ", ".join(f"f_{a} AS (SELECT DISTINCT id AS src, unnest({a}) AS dst FROM nodes), f_{b} AS (SELECT DISTINCT unnest({b}) AS src, id AS dst FROM nodes)" for a, b in consolidate.LINKS.items()) + " " + " UNION ALL ".join(f"SELECT '{a}' AS relation, * FROM (FROM f_{a} EXCEPT FROM f_{b}) UNION ALL SELECT '{b}', * FROM (FROM f_{b} EXCEPT FROM f_{a})" for a, b in consolidate.LINKS.items()))
def one_sided_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links without their counterpart."""
    return consolidate.one_sided_links(X.nodes(spark, sf_dir))


@_query(f"""WITH RECURSIVE {_NODES}, l AS (SELECT DISTINCT id AS src, unnest(derived_from) AS dst FROM nodes),
w AS (SELECT src, dst, 1 AS steps FROM l UNION ALL SELECT w.src, l.dst, steps + 1 FROM w JOIN l ON w.dst = l.src WHERE steps < 4)
SELECT src, dst, min(steps) AS steps FROM w GROUP BY ALL""")
def support_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each node derives from, four steps deep."""
    return consolidate.reached(X.nodes(spark, sf_dir).select(F.col("id").alias("src"), F.explode("derived_from").alias("dst")), 4)


@_query(f"WITH {_INACTIVE}, k AS (SELECT nodes.*, gl FROM nodes, (SELECT list(id) AS gl FROM gone) WHERE NOT list_contains(gl, id)) SELECT id, {', '.join(f"array_to_string(list_filter({f}, lambda x: NOT list_contains(gl, x)), ',') AS {f}" for f in X.LINKS)} FROM k")
def reconciled_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Active nodes, of all turns and made up, without references to inactive ones."""
    nodes = X.nodes(spark, sf_dir)
    return review.settled_nodes(nodes, consolidate.inactive_ids(nodes), X.LINKS).select("id", *(F.array_join(f, ",").alias(f) for f in X.LINKS))


@_query(f"WITH {_NODES}, m AS (SELECT max({_TIME('last_seen')}) AS newest FROM nodes) SELECT id, date_diff('day', {_TIME('last_seen')}, newest) AS age_days FROM nodes, m WHERE support_count = 1 AND source = 'automatic' AND newest - {_TIME('last_seen')} >= INTERVAL 180 DAY AND len(superseded_by) = 0")
def stale_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Automatic nodes of one support, unseen for 180 days before the newest."""
    seen = X.nodes(spark, sf_dir).withColumn("seen", T.parse_timestamp(F.col("last_seen")))
    newest = seen.agg(F.max("seen").alias("newest"))
    old = seen.crossJoin(F.broadcast(newest)).filter((F.col("support_count") == 1) & (F.col("source") == "automatic") & (F.size("superseded_by") == 0) & (F.col("newest") >= F.col("seen") + F.expr("INTERVAL 180 DAYS")))
    return old.select("id", F.date_diff("newest", "seen").cast("long").alias("age_days"))


_RULES = {
    "missing_text": "trim(text) = ''",
    "unknown_layer": "layer NOT IN ('global', 'domain', 'project')",
    "unknown_source": "source NOT IN ('automatic', 'explicit')",
    "unknown_confidence": "confidence NOT IN ('high', 'medium', 'low')",
    "no_support": "support_count < 1",
    "lifecycle": f"NOT {_ORDERED}",
    "superseded_and_deprecated": "len(superseded_by) > 0 AND len(deprecated_by) > 0",
    "supersedes_and_deprecates": "len(supersedes) > 0 AND len(deprecates) > 0",
    "self_link": "list_contains(supersedes, id)",
}


@_query(f"WITH {_NODES} " + " UNION ALL ".join(f"SELECT id, '{k}' AS violation FROM nodes WHERE {r}" for k, r in _RULES.items()))
def contract_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is wrong with the nodes of all turns and the made-up ones."""
    return audit.contract_violations(X.nodes(spark, sf_dir))


@_query(f"WITH {_NODES} SELECT id, CAST(CASE WHEN source = 'explicit' THEN 350 ELSE 0 END + CASE confidence WHEN 'high' THEN 110 WHEN 'medium' THEN 40 WHEN 'low' THEN -100 ELSE 0 END + CASE WHEN source = 'automatic' AND support_count = 0 THEN -40 ELSE 0 END + CASE layer WHEN 'global' THEN 120 WHEN 'domain' THEN 80 WHEN 'project' THEN 40 ELSE 0 END + CASE WHEN layer = 'project' THEN 240 WHEN layer IN ('global', 'domain') THEN -900 ELSE 0 END AS BIGINT) AS prior FROM nodes")
def rank_priors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Priors of the nodes of all turns and the made-up ones, the project layer preferred."""
    prior = search.rank_priors(F.col("source"), F.col("confidence"), F.col("layer"), F.col("support_count"), "project")
    return X.nodes(spark, sf_dir).select("id", prior.cast("long").alias("prior"))


# Prunes.

_KEYED = "(layer <> '' AND scope <> '' AND topic <> '')"


@_query(f"SELECT query_id, id, score FROM {X.hits_sql()} h QUALIFY NOT {_KEYED} OR row_number() OVER (PARTITION BY query_id, layer, scope, topic ORDER BY score DESC, id DESC) = 1")
def best_per_topic(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.prune_topics(X.hits(spark, sf_dir), "query_id").select("query_id", "id", "score")


@_query(f"SELECT query_id, id, score FROM {X.hits_sql()} h QUALIFY score >= floor(max(score) OVER (PARTITION BY query_id) * CAST(0.99 AS DOUBLE))")
def score_floor(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.prune_low_scores(X.hits(spark, sf_dir), "query_id").select("query_id", "id", "score")


@_query(f"SELECT query_id, id, score FROM {X.hits_sql()} h QUALIFY NOT bool_or(layer = 'global') OVER (PARTITION BY query_id) OR layer = 'global'")
def preferred_layer(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.prune_layers(X.hits(spark, sf_dir), "global", "query_id").select("query_id", "id", "score")


@_query(f"""WITH h AS (SELECT *, {_KEYED} AS keyed FROM {X.hits_sql()}), a AS (SELECT query_id, id AS aid, layer AS al, scope AS asc_, topic AS at_, kind AS akind, keyed AS ak FROM h QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id DESC) = 1)
SELECT query_id, id, score FROM h JOIN a USING (query_id) WHERE id = aid OR NOT ak OR NOT keyed OR (NOT (akind = 'memory' AND kind = 'memory' AND source = 'automatic' AND confidence = 'medium' AND support_count = 1 AND NOT strict AND layer = al AND topic = at_ AND scope <> asc_) AND (layer <> al OR topic = at_))""")
def tail_prune(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.prune_tails(X.hits(spark, sf_dir), "query_id").select("query_id", "id", "score")


@_query(f"""WITH h AS (SELECT *, CASE WHEN low THEN 0 WHEN NOT fielded THEN least(5, greatest(1, score // 50)) ELSE least(12, greatest(1, score // 25)) END AS bonus, row_number() OVER (PARTITION BY query_id, path ORDER BY score DESC, kind) AS k FROM {X.hits_sql()})
SELECT query_id, path, CAST(max(score) + sum(CASE WHEN k > 1 THEN bonus ELSE 0 END) AS BIGINT) AS score, CASE WHEN count(DISTINCT kind) > 1 THEN 'mixed' ELSE min(kind) END AS kind FROM h GROUP BY ALL""")
def merged_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.merged_hits(X.hits(spark, sf_dir)).select("query_id", "path", F.col("score").cast("long").alias("score"), "kind")


# Evaluation and audits.


@_query("SELECT lang, doc_id, place FROM (SELECT lang, doc_id, row_number() OVER (PARTITION BY lang ORDER BY sha256('228|' || CAST(doc_id AS VARCHAR)), doc_id) AS place FROM documents) WHERE place <= 25")
def stratified_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """25 documents of each language by hash: the sampling operator."""
    return evaluate.stratified_sample(_table(spark, sf_dir, "documents").select("lang", "doc_id"), "lang", "doc_id", 25, "228")


@_query("SELECT d.lang, count(*) AS n_labels, round(avg(l.quality), 9) AS quality_rate, round(avg(l.toxic), 9) AS toxic_rate, CAST(median(d.n_chars) AS DOUBLE) AS median_chars FROM labels l JOIN documents d USING (doc_id) GROUP BY ROLLUP (d.lang)")
def category_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rates by language and over all."""
    joined = _table(spark, sf_dir, "labels").join(_table(spark, sf_dir, "documents").select("doc_id", "lang", "n_chars"), "doc_id")
    return joined.rollup("lang").agg(F.count(F.lit(1)).alias("n_labels"), F.round(F.avg("quality"), 9).alias("quality_rate"), F.round(F.avg("toxic"), 9).alias("toxic_rate"), F.median("n_chars").alias("median_chars"))


@_query(" UNION ALL ".join(f"SELECT '{n}' AS name, count(*) AS n_rows, count(*) FILTER ({c} IS NULL OR {c} NOT IN (SELECT {k} FROM {p})) AS n_broken FROM {t}" for n, t, c, p, k in (("orders_customer", "orders", "o_custkey", "customer", "c_custkey"), ("lineitem_orders", "lineitem", "l_orderkey", "orders", "o_orderkey"), ("lineitem_part", "lineitem", "l_partkey", "part", "p_partkey"), ("lineitem_supplier", "lineitem", "l_suppkey", "supplier", "s_suppkey"), ("labels_documents", "labels", "doc_id", "documents", "doc_id"))))
def broken_references(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows that refer to nothing, by foreign key."""
    t = lambda n: _table(spark, sf_dir, n)
    return audit.broken_references([("orders_customer", t("orders"), "o_custkey", t("customer"), "c_custkey"), ("lineitem_orders", t("lineitem"), "l_orderkey", t("orders"), "o_orderkey"), ("lineitem_part", t("lineitem"), "l_partkey", t("part"), "p_partkey"), ("lineitem_supplier", t("lineitem"), "l_suppkey", t("supplier"), "s_suppkey"), ("labels_documents", t("labels"), "doc_id", t("documents"), "doc_id")])


@_query("""WITH v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
c AS (SELECT q.vec_id AS query_id, v.vec_id, list_dot_product(q.e, v.e) / (sqrt(list_dot_product(q.e, q.e)) * sqrt(list_dot_product(v.e, v.e))) AS cosine FROM v q JOIN v ON q.vec_id <> v.vec_id WHERE q.vec_id % 50 = 0)
SELECT query_id, vec_id, round(cosine, 6) AS cosine, row_number() OVER (PARTITION BY query_id ORDER BY cosine DESC, vec_id) AS place FROM c WHERE cosine >= 0.2 QUALIFY place <= 5""")
def embedding_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five nearest vectors of every vector whose id is divisible by 50, against all."""
    v = _table(spark, sf_dir, "embeddings")
    return evaluate.cosine_neighbours(v.filter("vec_id % 50 = 0"), v, 0.2, 5).withColumn("cosine", F.round("cosine", 6))


_SLUG = "CASE WHEN trim(regexp_replace(lower(coalesce(source, '')), '[^a-z0-9]+', '-', 'g'), '-') <> '' THEN trim(regexp_replace(lower(coalesce(source, '')), '[^a-z0-9]+', '-', 'g'), '-') ELSE 'archive' END"


@_query(f"""WITH t AS (SELECT doc_id, list_transform(list_prepend({_SLUG}, list_filter(list_transform({_tokens('text')}, lambda x: trim(x, '._-')),
lambda x: x <> '' AND NOT regexp_full_match(x, '[0-9]+|[0-9a-f]*[0-9][0-9a-f]*|.*\\.py|.{{1,2}}') AND NOT list_contains({_list(T.QUERY_STOP_WORDS + T.GENERIC_WORDS)}, x))), lambda x: left(x, 48)) AS l FROM documents),
e AS (SELECT doc_id, unnest(list_filter(l, lambda x, i: list_position(l, x) = i)[1:16]) AS tag FROM t)
SELECT tag, count(*) AS n_docs, min(doc_id) AS first_doc FROM e GROUP BY 1""")
def tag_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents by tag."""
    each = _table(spark, sf_dir, "documents").select("doc_id", F.explode(T.tags(F.col("text"), F.col("source"))).alias("tag"))
    return each.groupBy("tag").agg(F.count(F.lit(1)).alias("n_docs"), F.min("doc_id").alias("first_doc"))


@_query(f"SELECT CASE WHEN share >= 0.99 THEN '99+' WHEN share >= 0.95 THEN '95-99' WHEN share >= 0.85 THEN '85-95' WHEN share >= 0.5 THEN '50-85' ELSE '<50' END AS bucket, count(*) AS n_hits FROM (SELECT score / CAST(max(score) OVER (PARTITION BY query_id) AS DOUBLE) AS share FROM {X.hits_sql()} h) GROUP BY 1")
def score_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.score_buckets(X.hits(spark, sf_dir))


@_query(f"""WITH h AS (SELECT * FROM {X.hits_sql()}), g AS (SELECT query_id, id AS gid, layer AS gl, scope AS gs, topic AS gt FROM h WHERE (query_id = 1 AND id = 'a') OR (query_id = 2 AND id = 'g') OR (query_id >= 100 AND id = (SELECT min(id) FROM h o WHERE o.query_id = h.query_id)))
SELECT query_id, id, CASE WHEN layer = '' OR scope = '' OR topic = '' THEN 'incomplete' WHEN layer = gl AND scope = gs AND topic = gt THEN 'same_topic_and_scope' WHEN layer = gl AND topic = gt THEN 'same_topic_other_scope' WHEN layer = gl AND scope = gs THEN 'same_scope_other_topic' WHEN layer = gl THEN 'same_layer' WHEN topic = gt THEN 'same_topic_other_layer' ELSE 'unrelated' END AS relation
FROM h JOIN g USING (query_id) WHERE id <> gid""")
def noise_relations(spark: SparkSession, sf_dir: str) -> DataFrame:
    hits = X.hits(spark, sf_dir)
    gold = spark.createDataFrame([(1, "a"), (2, "g")], "query_id long, gold_id string").unionByName(hits.filter("query_id >= 100").groupBy("query_id").agg(F.min("id").alias("gold_id")))
    return evaluate.noise_relations(hits, gold)


@_query("SELECT 'left' AS side, count(*) AS n_rows FROM (SELECT doc_id FROM documents EXCEPT ALL SELECT doc_id FROM labels) UNION ALL SELECT 'right', count(*) FROM (SELECT doc_id FROM labels EXCEPT ALL SELECT doc_id FROM documents)")
def label_parity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents without a label, and labels without a document."""
    return audit.parity(_table(spark, sf_dir, "documents").select("doc_id"), _table(spark, sf_dir, "labels").select("doc_id"))


def _support_sql(query: list[str]) -> str:
    required = _list(search.required_tokens(query))
    m = f"list_filter({_list(query)}, lambda t: list_contains(w, t))"
    return f"""SELECT conv_id, turn, CASE WHEN list_has_all({m}, {required}) THEN 'complete' WHEN list_has_any({m}, {required}) THEN 'partial' ELSE 'none' END AS support
FROM (SELECT conv_id, turn, string_split_regex(lower(coalesce(text, '')), '[^a-z0-9_]+') AS w FROM conversations)"""


def _supported(spark: SparkSession, sf_dir: str, query: list[str]) -> DataFrame:
    scored = search.score_text(_table(spark, sf_dir, "conversations").select("conv_id", "turn", "text"), query)
    return scored.select("conv_id", "turn", search.query_support(query, F.col("matched")).alias("support"))


@_query(_support_sql(PLAIN_QUERY))
def query_support(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How far every turn supports the plain query."""
    return _supported(spark, sf_dir, PLAIN_QUERY)


@_query(f"SELECT CASE WHEN n_supported > 0 THEN 'supported' WHEN n > 0 THEN 'related_context_without_active_memory_support' ELSE 'no_recall_hits' END AS verdict, n_supported FROM (SELECT count(*) FILTER (support = 'complete') AS n_supported, count(*) AS n FROM ({_support_sql(PLAIN_QUERY)}) WHERE support <> 'none')")
def answerability(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The verdict over these turns."""
    return search.answerability(_supported(spark, sf_dir, PLAIN_QUERY).filter("support <> 'none'"))
