"""Queries of inventories, origins of records and answers, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import filters as P
from ..functions import text as T
from ..operators import answers, evaluate, projects, review
from ..sources import inventories
from . import fixtures as X
from .queries import _answer, _compact, _pairs_sql, _polarity, _query, _semantic, _table, _tokens

_DOCS_SQL = """d AS (SELECT doc_id, 'r/' || coalesce(source, 'none') || '/' || doc_id || '.txt' AS path, sha256(coalesce(text, '')) AS sha256, CAST(octet_length(encode(coalesce(text, ''))) AS BIGINT) AS size, '2024-01-0' || (1 + doc_id % 9) || 'T00:00:00Z' AS updated_at FROM documents)"""


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as files of their sources' folders."""
    c = _table(spark, sf_dir, "documents").withColumn("text", F.coalesce("text", F.lit("")))
    path = F.concat(F.lit("r/"), F.coalesce("source", F.lit("none")), F.lit("/"), F.col("doc_id").cast("string"), F.lit(".txt"))
    return c.select("doc_id", path.alias("path"), F.sha2("text", 256).alias("sha256"), F.octet_length("text").cast("long").alias("size"), F.concat(F.lit("2024-01-0"), (1 + F.col("doc_id") % 9).cast("string"), F.lit("T00:00:00Z")).alias("updated_at"))


@_query(f"""WITH {_DOCS_SQL}, m AS (SELECT CASE doc_id % 12 WHEN 1 THEN '../' || path WHEN 6 THEN path || '.gone' ELSE path END AS path, CASE doc_id % 12 WHEN 2 THEN 'X' WHEN 7 THEN sha256(path) ELSE sha256 END AS sha256, CASE doc_id % 12 WHEN 3 THEN -1 WHEN 8 THEN size + 1 ELSE size END AS size, CASE doc_id % 12 WHEN 4 THEN 'soon' ELSE updated_at END AS updated_at
FROM d, (VALUES (0), (1)) v(again) WHERE again = 0 OR doc_id % 12 = 5),
n AS (SELECT path, count(*) AS n FROM m GROUP BY 1)
SELECT * FROM (SELECT m.path, CASE WHEN starts_with(m.path, '..') THEN 'invalid_path' WHEN NOT regexp_full_match(m.sha256, '[0-9a-f]{{64}}') THEN 'invalid_hash' WHEN m.size < 0 THEN 'invalid_size' WHEN TRY_CAST(m.updated_at AS TIMESTAMPTZ) IS NULL THEN 'invalid_time' WHEN n > 1 THEN 'duplicate_path' WHEN d.path IS NULL THEN 'missing_record' WHEN d.size <> m.size OR d.sha256 <> m.sha256 THEN 'changed_record' END AS defect
FROM m JOIN n USING (path) LEFT JOIN d ON d.path = m.path) WHERE defect IS NOT NULL""")
def manifest_defects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is wrong with a manifest of all documents in which each kind of fault is planted by rule."""
    d = _documents(spark, sf_dir)
    k = F.col("doc_id") % 12
    rows = d.withColumn("again", F.explode(F.when(k == 5, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))))
    m = rows.select(
        F.when(k == 1, F.concat(F.lit("../"), "path")).when(k == 6, F.concat("path", F.lit(".gone"))).otherwise(F.col("path")).alias("path"),
        F.when(k == 2, "X").when(k == 7, F.sha2("path", 256)).otherwise(F.col("sha256")).alias("sha256"),
        F.when(k == 3, -1).when(k == 8, F.col("size") + 1).otherwise(F.col("size")).alias("size"),
        F.when(k == 4, "soon").otherwise(F.col("updated_at")).alias("updated_at"),
    )
    return inventories.manifest_defects(m, d)


@_query(f"""WITH {_DOCS_SQL}, g AS (SELECT 'all' AS target, '' AS folder UNION ALL SELECT DISTINCT coalesce(source, 'none'), 'r/' || coalesce(source, 'none') || '/' FROM documents),
m AS (SELECT target, path, doc_id, sha256, CAST(updated_at AS TIMESTAMPTZ) AS updated_at FROM d JOIN g ON starts_with(path, folder)),
a AS (SELECT target, path, CASE WHEN doc_id % 8 = 0 THEN sha256(path) ELSE sha256 END AS sha256, updated_at FROM m WHERE doc_id % 4 = 0 AND doc_id % 9 < 7), h AS (SELECT target, max(updated_at) AS top FROM a GROUP BY 1)
SELECT target, path, sha256 FROM m LEFT JOIN h USING (target) WHERE doc_id % 100 = 1 OR top IS NULL OR NOT ((updated_at < top AND NOT (EXISTS (FROM a WHERE a.target = m.target AND a.path = m.path) AND NOT EXISTS (FROM a WHERE a.target = m.target AND a.path = m.path AND a.sha256 = m.sha256))) OR (updated_at = top AND EXISTS (FROM a WHERE a.target = m.target AND a.sha256 = m.sha256)))""")
def inventory_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each source's folder, and the whole, is to ingest from one manifest of all documents."""
    d = _documents(spark, sf_dir)
    folders = _table(spark, sf_dir, "documents").select(F.coalesce("source", F.lit("none")).alias("target")).distinct().select("target", F.concat(F.lit("r/"), "target", F.lit("/")).alias("folder"))
    targets = spark.createDataFrame([("all", "")], "target string, folder string").unionByName(folders)
    each = d.join(targets, F.expr("folder = '' OR folder = concat(substring_index(path, '/', 2), '/')"))
    k = F.col("doc_id")
    archived = each.filter((k % 4 == 0) & (k % 9 < 7)).select(F.col("target").alias("partition"), "path", F.when(k % 8 == 0, F.sha2("path", 256)).otherwise(F.col("sha256")).alias("sha256"), T.parse_timestamp(F.col("updated_at")).alias("updated_at"))
    ledger = each.filter(k % 100 == 1).select(F.col("target").alias("partition"), "path")
    return inventories.discovered(d, targets, archived, ledger).select("target", "path", "sha256")


_LINES_SQL = """l AS (SELECT conv_id AS record, CASE turn % 4 WHEN 0 THEN '{"type": "' || CASE WHEN conv_id % 2 = 0 THEN 'session_meta' ELSE 'other' END || '", "payload": {"thread_source": "' || CASE WHEN conv_id % 3 = 0 THEN ' Automation' ELSE role END || '", "cwd": "/w/p' || conv_id % 7 || '/"}}'
WHEN 1 THEN '{"deep": [{"workspace": "/w/q' || turn || '"}, {"repo_path": "relative/' || role || '"}, {"cwd": ' || turn || '}]}' WHEN 2 THEN 'no json ' || role ELSE '[{"name": "/w/x", "items": [[{"project_path": "/w/p' || conv_id % 5 || '"}]]}]' END AS line FROM conversations)"""


@_query(f"""WITH {_LINES_SQL}, j AS (SELECT record, line FROM l WHERE json_valid(line)),
p AS (SELECT record, array_to_string(list_sort(list(DISTINCT regexp_replace(trim(json_extract_string(c.atom, '$')), '(.)/+$', '\\1'))), ',') AS paths FROM j, json_tree(j.line) c WHERE c.key IN ({', '.join(f"'{k}'" for k in projects.PATH_KEYS)}) AND c.type = 'VARCHAR' AND starts_with(trim(json_extract_string(c.atom, '$')), '/') GROUP BY 1),
a AS (SELECT record, bool_or(json_extract_string(line, '$.type') = 'session_meta' AND lower(trim(json_extract_string(line, '$.payload.thread_source'))) = 'automation') AS automation FROM j GROUP BY 1)
SELECT record, coalesce(paths, '') AS paths, coalesce(automation, false) AS automation, coalesce(list_contains(string_split(paths, ','), '/w/p3'), true) AS in_project FROM (SELECT DISTINCT record FROM l) LEFT JOIN a USING (record) LEFT JOIN p USING (record)""")
def record_origins(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The folders that each conversation's record names, whether an automation wrote it, and whether it is of one project."""
    c = _table(spark, sf_dir, "conversations")
    k, s = F.col("turn") % 4, lambda x: x.cast("string")
    conv = F.col("conv_id")
    meta = F.concat(F.lit('{"type": "'), F.when(conv % 2 == 0, "session_meta").otherwise("other"), F.lit('", "payload": {"thread_source": "'), F.when(conv % 3 == 0, " Automation").otherwise(F.col("role")), F.lit('", "cwd": "/w/p'), s(conv % 7), F.lit('/"}}'))
    deep = F.concat(F.lit('{"deep": [{"workspace": "/w/q'), s(F.col("turn")), F.lit('"}, {"repo_path": "relative/'), "role", F.lit('"}, {"cwd": '), s(F.col("turn")), F.lit("}]}"))
    inner = F.concat(F.lit('[{"name": "/w/x", "items": [[{"project_path": "/w/p'), s(conv % 5), F.lit('"}]]}]'))
    lines = c.select(conv.alias("record"), F.when(k == 0, meta).when(k == 1, deep).when(k == 2, F.concat(F.lit("no json "), "role")).otherwise(inner).alias("line"))
    origins = projects.record_origins(lines)
    ours = projects.of_project(origins, "/w/p3").select("record", F.lit(True).alias("ours"))
    return origins.join(ours, "record", "left").select("record", F.array_join("paths", ",").alias("paths"), "automation", F.coalesce("ours", F.lit(False)).alias("in_project"))


_UNSAFE_SQL = T.UNSAFE_DISPLAY.replace("'", "''")


def _answers_sql() -> str:
    asked = "'question ' || item_id"
    drawn = f"""CASE WHEN regexp_matches(flat, '{answers.PREFIX}') THEN regexp_replace(regexp_extract(flat, '{answers.PREFIX}(.*)$', 1), '{answers.BOUNDARY}.*$', '') END"""
    return f"""WITH c AS (SELECT item_id, {asked} AS query, CASE WHEN item_id % 5 = 0 THEN NULL ELSE coalesce(text, '') END AS expected, coalesce(text, '') AS said FROM benchmark),
h AS (SELECT item_id, doc_id, doc_id % 4 AS score, 'Note. Reference answer: ' || CASE WHEN doc_id % 3 = 0 THEN said ELSE coalesce(d.text, '') END || CASE WHEN doc_id % 2 = 0 THEN ' Query: ' ELSE ' ' END || query AS t FROM c JOIN documents d ON d.doc_id % (SELECT count(*) FROM benchmark) = c.item_id WHERE d.doc_id % 7 <> 0),
b AS (SELECT c.item_id, query, expected, doc_id, {_compact('t')} AS flat FROM c LEFT JOIN (SELECT * FROM h QUALIFY row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) = 1) USING (item_id)),
e AS (SELECT *, {drawn} AS x FROM b), f AS (SELECT *, {_compact("trim(CASE WHEN instr(lower(x), lower(query)) > 1 THEN left(x, instr(lower(x), lower(query)) - 1) ELSE x END, ' .')")} AS y FROM e),
g AS (SELECT *, CASE WHEN coalesce(y, '') = '' OR regexp_matches(y, '{_UNSAFE_SQL}') THEN '{answers.ABSTENTION}' ELSE y END AS answer FROM f)
SELECT item_id AS case_id, doc_id AS memory_id, sha256(answer) AS answer_sha256, CASE WHEN answer = '{answers.ABSTENTION}' THEN CASE WHEN expected IS NULL THEN 'abstained' ELSE 'missed' END WHEN expected IS NULL THEN 'wrong' WHEN contains(answer, expected) OR ({_answer('expected')} <> '' AND contains({_answer('answer')}, {_answer('expected')})) THEN 'right' ELSE 'wrong' END AS verdict FROM g"""


@_query(_answers_sql())
def answer_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An answer to every benchmark item from the best of the documents dealt to it, judged against the item."""
    b = _table(spark, sf_dir, "benchmark").withColumn("said", F.coalesce("text", F.lit("")))
    cases = b.select(F.col("item_id").alias("case_id"), F.concat(F.lit("question "), F.col("item_id").cast("string")).alias("query"), F.when(F.col("item_id") % 5 != 0, F.col("said")).alias("expected"), "said")
    docs = _table(spark, sf_dir, "documents").filter("doc_id % 7 <> 0").withColumn("case_id", F.col("doc_id") % b.count())
    text = F.concat(F.lit("Note. Reference answer: "), F.when(F.col("doc_id") % 3 == 0, F.col("said")).otherwise(F.coalesce("text", F.lit(""))), F.when(F.col("doc_id") % 2 == 0, " Query: ").otherwise(" "), "query")
    hits = docs.join(cases, "case_id").select("case_id", F.col("doc_id").alias("memory_id"), (F.col("doc_id") % 4).alias("score"), text.alias("text"), F.lit(True).alias("supported"))
    return answers.answer_records(cases, hits).select("case_id", "memory_id", F.sha2("answer", 256).alias("answer_sha256"), "verdict")


# Review of induced facts, and what is lost on the way to cases.

_INDUCED_SQL = """(SELECT lpad(p_partkey::VARCHAR, 9, '0') || again AS id, CASE p_partkey % 3 WHEN 0 THEN 'never keep ' WHEN 1 THEN 'always include ' ELSE '' END || p_name || CASE WHEN p_partkey % 11 = 0 THEN ' provisional' ELSE '' END AS text, CASE WHEN p_partkey % 4 = 0 AND again = 'b' THEN 'x' ELSE 'p' || p_size % 3 END AS project
FROM part, (VALUES ('a'), ('b')) v(again) WHERE again = 'a' OR p_partkey % 2 = 0)"""


def _induced(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts' names as induced facts; every second is there twice, some of them of another project."""
    k = F.col("p_partkey")
    p = _table(spark, sf_dir, "part").withColumn("again", F.explode(F.when(k % 2 == 0, F.array(F.lit("a"), F.lit("b"))).otherwise(F.array(F.lit("a")))))
    text = F.concat(F.when(k % 3 == 0, "never keep ").when(k % 3 == 1, "always include ").otherwise(""), "p_name", F.when(k % 11 == 0, " provisional").otherwise(""))
    return p.select(F.concat(F.lpad(k.cast("string"), 9, "0"), "again").alias("at"), text.alias("text"), F.when((k % 4 == 0) & (F.col("again") == "b"), "x").otherwise(F.concat(F.lit("p"), (F.col("p_size") % 3).cast("string"))).alias("project"))


_CLASSES_SQL = f"""s AS (SELECT *, {_semantic('text')} AS toks, {_polarity('text')} AS pol FROM {_INDUCED_SQL}), c AS (SELECT toks, pol, min(id) AS class_id, count(*) AS n, count(DISTINCT project) AS projects FROM s WHERE len(toks) >= 4 GROUP BY ALL),
m AS (SELECT s.id, s.text, class_id, n, projects FROM s LEFT JOIN c ON c.toks = s.toks AND c.pol = s.pol), r AS ({_pairs_sql(_INDUCED_SQL)}),
q AS (SELECT a.class_id AS current_class, b.class_id AS old_class, relation, CASE relation {' '.join(f"WHEN '{k}' THEN '{v}'" for k, v in review.REASONS.items())} END AS reason, a.n AS n_current, b.n AS n_older FROM r JOIN m a ON a.id = r.current_id JOIN m b ON b.id = r.old_id)"""


@_query(f"WITH {_CLASSES_SQL} SELECT * FROM q WHERE reason IS NOT NULL")
def induction_review(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Classes of induced facts that must be reviewed together."""
    return review.induction_pairs(_induced(spark, sf_dir))


@_query(f"""WITH {_CLASSES_SQL}, w AS (SELECT id AS "at", CASE WHEN regexp_matches(text, '{P.REVIEWABLE}') THEN 'direct' WHEN touched AND projects >= 2 THEN 'released' WHEN touched THEN 'related' END AS status FROM (SELECT *, class_id IN (SELECT current_class FROM q WHERE reason IS NOT NULL UNION SELECT old_class FROM q WHERE reason IS NOT NULL) AS touched FROM m)) FROM w WHERE status IS NOT NULL""")
def withheld_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which induced facts review holds back or releases."""
    facts = _induced(spark, sf_dir)
    return review.withheld_candidates(facts, review.induction_pairs(facts))


_STAGES_SQL = {"inactive": "len(superseded_by) > 0", "missing_field": "trim(text) = '' OR confidence = 'sure'", "no_support": "support_count < 1", "too_long": "length(text) > 500", "sensitive": f"regexp_matches(text, '{T.UNSAFE_DISPLAY}')", "too_few_terms": f"len(list_distinct({_tokens('text')})) < 3"}
_LIMIT = 40


@_query(f"""WITH n AS (SELECT id, lower({_compact('text')}) AS key, CASE {' '.join(f"WHEN {c} THEN '{k}'" for k, c in _STAGES_SQL.items())} END AS loss FROM {X.nodes_sql()}),
d AS (SELECT id, CASE WHEN loss IS NULL AND id > min(id) FILTER (loss IS NULL) OVER (PARTITION BY key) THEN 'duplicate' ELSE loss END AS loss FROM n), k AS (SELECT id FROM d WHERE loss IS NULL ORDER BY id LIMIT {_LIMIT})
SELECT coalesce(loss, 'kept') AS stage, count(*) AS n_rows FROM d WHERE (SELECT count(*) FROM k) < {_LIMIT} OR id <= (SELECT max(id) FROM k) GROUP BY 1""")
def case_losses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Why nodes, taken by id until 40 are kept, don't become cases."""
    nodes = X.nodes(spark, sf_dir).withColumn("key", F.lower(T.compact_whitespace(F.col("text"))))
    stages = {"inactive": F.size("superseded_by") > 0, "missing_field": (F.trim("text") == "") | (F.col("confidence") == "sure"), "no_support": F.col("support_count") < 1, "too_long": F.length("text") > 500, "sensitive": F.col("text").rlike(T.UNSAFE_DISPLAY), "too_few_terms": F.size(T.tokens(F.col("text"))) < 3}
    return evaluate.loss_counts(evaluate.first_losses(nodes.select("id", "key", "text", "superseded_by", "confidence", "support_count"), stages, "id", "key", _LIMIT))
