"""Small tables shared by queries and their SQL: rows that no input table has. Secrets are made up and put together from parts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

_LONG = "Ab3" * 8
SECRETS = [
    (1, "plain text with nothing to hide"),
    (2, "Authorization: " + "Bearer " + _LONG + " then more"),
    (3, "Cook" + "ie: id=1; theme=dark\nnext line"),
    (4, "use gh" + "p_" + _LONG + " here and s" + "k-" + _LONG),
    (5, "AK" + "IA" + "ABCDEFGHIJKLMNOP in a row AK" + "IA" + "0123456789ABCDEF"),
    (6, "-----BEGIN RSA PRIV" + "ATE KEY-----\nabc\ndef\n-----END RSA PRIV" + "ATE KEY----- end"),
    (7, "pass" + "word = hunter2hunter2 and to" + "ken: abc"),
    (8, ""),
    (9, None),
]
FACTS = [
    (1, "Updated fact: use pip for installs => use uv for installs"),
    (2, "Deleted fact: the old port is 8080"),
    (3, "remove fact:   spaced   out  fact - "),
    (4, "Deprecating fact: weekly sync notes"),
    (5, "The archive keeps evidence for each memory"),
    (6, "replacement fact: same -> Same"),
    (7, None),
]
PAIRS = [
    (1, "always include source citation evidence in every memory summary report"),
    (2, "never include source citation evidence in every memory summary report"),
    (3, "always include citation evidence in every memory summary report"),
    (4, "skip evidence summary report tables charts graphs figures"),
    (5, "evidence summary report tables"),
    (6, "render charts graphs figures legends nightly builds"),
    (7, "render charts graphs figures legends captions weekly"),
    (8, "short one"),
    (9, None),
    (10, "render charts graphs figures legends captions weekly"),
]
#: id, text, layer, source, confidence, support_count, scope, topic, first_seen, last_seen, and links (by comma): supersedes,
#: superseded_by, contradicts, contradicted_by, deprecates, deprecated_by, derived_from.
NODES = [
    ("a", "fact a", "project", "automatic", "high", 2, "project:x", "t1", "2025-01-01T00:00:00Z", "2026-01-01T00:00:00Z", "b", "", "", "", "", "", "c"),
    ("b", "fact b", "project", "automatic", "low", 1, "project:x", "t1", "2025-01-01T00:00:00Z", "2025-02-01T00:00:00Z", "c", "a", "", "", "", "", ""),
    ("c", "fact c", "domain", "automatic", "medium", 1, "domain:t1", "t1", "2025-01-01T00:00:00Z", "2025-01-05T00:00:00Z", "", "b", "", "", "", "", "d"),
    ("d", "fact d", "global", "explicit", "high", 1, "global", "t2", "", "", "", "", "e", "", "", "", "e"),
    ("e", "fact e", "global", "explicit", "high", 3, "global", "t2", "2025-03-01T00:00:00Z", "2025-01-01T00:00:00Z", "", "", "", "d", "", "", "f"),
    ("f", "Deprecated fact: g", "project", "automatic", "medium", 1, "project:y", "t3", "2025-01-01T00:00:00Z", "2025-09-01T00:00:00Z", "", "", "", "", "g", "", "a"),
    ("g", "fact g", "project", "automatic", "medium", 1, "project:y", "t3", "2025-01-01T00:00:00Z", "2025-06-01T00:00:00Z", "", "", "", "", "", "f", ""),
    ("h", "fact h", "galaxy", "automatic", "sure", 0, "project:y", "t3", "2025-01-01T00:00:00Z", "2026-06-01T00:00:00Z", "h", "z", "", "", "", "a", ""),
    ("i", "", "project", "automatic", "medium", 1, "project:y", "t4", "", "2025-01-01T00:00:00Z", "", "h", "", "", "", "", "zz"),
]
LINKS = ["supersedes", "superseded_by", "contradicts", "contradicted_by", "deprecates", "deprecated_by", "derived_from"]
_NODE_FIELDS = ["id", "text", "layer", "source", "confidence", "support_count", "scope", "topic", "first_seen", "last_seen", *LINKS]
#: query_id, id, path, kind, layer, scope, topic, score, source, confidence, support_count, strict, low, fielded
HITS = [
    (1, "a", "p/a", "memory", "project", "s1", "t1", 1000, "automatic", "high", 3, True, False, True),
    (1, "b", "p/b", "memory", "project", "s1", "t1", 995, "automatic", "high", 1, False, False, True),
    (1, "c", "p/c", "memory", "project", "s2", "t1", 992, "automatic", "medium", 1, False, False, True),
    (1, "d", "p/d", "memory", "global", "g", "t2", 990, "explicit", "high", 1, True, False, False),
    (1, "e", "p/a", "index", "", "", "", 989, "", "", 0, False, False, False),
    (1, "f", "p/f", "markdown", "", "", "", 500, "", "", 0, False, True, False),
    (2, "g", "p/g", "memory", "global", "g", "t2", 70, "explicit", "high", 1, True, False, True),
    (2, "h", "p/g", "index", "project", "s1", "t3", 70, "automatic", "medium", 1, False, True, False),
    (2, "i", "p/g", "markdown", "project", "s1", "t3", 69, "automatic", "medium", 1, False, False, False),
    (2, "j", "p/j", "memory", "global", "g", "t4", 70, "automatic", "low", 1, False, False, True),
    (3, "k", "p/k", "index", "project", "s1", "t5", 90, "", "", 0, True, False, True),
    (3, "l", "p/l", "memory", "project", "s2", "t5", 80, "automatic", "medium", 1, False, False, True),
    (3, "m", "p/m", "memory", "project", "s2", "t6", 70, "automatic", "medium", 1, False, False, True),
]
_HIT_FIELDS = ["query_id", "id", "path", "kind", "layer", "scope", "topic", "score", "source", "confidence", "support_count", "strict", "low", "fielded"]
ANSWERS = [
    (1, "The port is 8080.", "8080"),
    (2, "it uses   UV, for installs", "uses uv for installs"),
    (3, "we chose the blue plan on monday for launch", "chose a blue plan on monday"),
    (4, "no idea", "the archive keeps evidence"),
    (5, "", "anything"),
    (6, None, None),
]
#: decision_id, pair, relation, action
DECISIONS = [(1, "2|1", "contradiction", "approve"), (2, "2|1", "contradiction", "approve"), (3, "5|4", "overlap_review", "approve"), (4, "99|1", "overlap_review", "ignore"), (5, "10|6", "overlap_review", "ignore"), (6, "3|2", "contradiction", "approve"), (7, "3|2", "contradiction", "ignore"), (8, "10|7", "overlap_review", "merge")]
THRESHOLDS = [("recall_at_5", "floor", 0.99, 1), ("recall_at_5", "floor", 0.01, 2), ("mrr", "floor", 1.5, 1), ("ndcg_at_5", "ceiling", 2.0, 1), ("absent", "floor", 0.5, 1)]


def _value(v: object) -> str:
    if v is None:
        return "NULL"
    if isinstance(v, str):
        return "'" + v.replace("'", "''") + "'"
    return str(v).lower() if isinstance(v, bool) else str(v)


def values_sql(rows: list[tuple], fields: list[str]) -> str:
    """The rows as a DuckDB relation."""
    return f"(SELECT * FROM (VALUES {', '.join('(' + ', '.join(map(_value, r)) + ')' for r in rows)}) v({', '.join(fields)}))"


#: Rows made by rule from all turns, so that queries over nodes and hits grow with the tables.
_ID = "'c' || conv_id || '-' || {}"
_TURN_NODES = f"""(SELECT {_ID.format('turn')} AS id, coalesce(text, '') AS text, CASE conv_id % 4 WHEN 0 THEN 'domain' WHEN 1 THEN 'global' WHEN 2 THEN 'project' ELSE 'galaxy' END AS layer, CASE WHEN role = 'user' THEN 'explicit' ELSE 'automatic' END AS source,
CASE turn % 4 WHEN 0 THEN 'high' WHEN 1 THEN 'medium' WHEN 2 THEN 'low' ELSE 'sure' END AS confidence, turn % 3 AS support_count, 'project:' || conv_id % 9 AS scope, 't' || turn % 5 AS topic,
CASE WHEN conv_id % 11 = 3 THEN '' ELSE '2025-0' || (1 + conv_id % 6) || '-0' || (1 + turn % 9) || 'T00:00:00Z' END AS first_seen, CASE WHEN conv_id % 11 = 3 THEN '' ELSE '2025-0' || (1 + (conv_id + turn) % 9) || '-1' || (turn % 9) || 'T00:00:00Z' END AS last_seen,
CASE WHEN turn % 3 = 2 THEN [{_ID.format('(turn - 2)')}] WHEN conv_id % 17 = 5 THEN ['gone'] ELSE [] END AS supersedes, CASE WHEN turn % 3 = 0 AND conv_id % 2 = 0 THEN [{_ID.format('(turn + 2)')}] ELSE [] END AS superseded_by,
CASE WHEN turn % 4 = 3 THEN [{_ID.format('(turn - 1)')}] ELSE [] END AS contradicts, CASE WHEN turn % 4 = 2 AND conv_id % 3 = 0 THEN [{_ID.format('(turn + 1)')}] ELSE [] END AS contradicted_by,
CASE WHEN turn = 5 AND conv_id % 7 = 1 THEN [{_ID.format('1')}] ELSE [] END AS deprecates, CASE WHEN turn = 1 AND conv_id % 7 = 1 THEN [{_ID.format('5')}] ELSE [] END AS deprecated_by,
CASE WHEN turn > 0 THEN [{_ID.format('(turn - 1)')}] WHEN conv_id % 5 = 0 THEN [{_ID.format('3')}] ELSE [] END AS derived_from FROM conversations)"""
_TURN_HITS = f"""(SELECT 100 + conv_id % 40 AS query_id, {_ID.format('turn')} AS id, 'p/' || conv_id || '/' || turn % 2 AS path, CASE turn % 3 WHEN 0 THEN 'memory' WHEN 1 THEN 'index' ELSE 'markdown' END AS kind, CASE WHEN turn % 3 = 1 THEN '' WHEN conv_id % 6 = 0 THEN 'global' ELSE 'project' END AS layer,
CASE WHEN turn % 3 = 1 THEN '' ELSE 's' || conv_id % 3 END AS scope, CASE WHEN turn % 3 = 1 THEN '' ELSE 't' || turn % 4 END AS topic, 10 * length(coalesce(text, '')) + turn + 1 AS score, CASE WHEN role = 'user' THEN 'explicit' ELSE 'automatic' END AS source,
CASE turn % 3 WHEN 0 THEN 'high' WHEN 1 THEN '' ELSE 'medium' END AS confidence, turn % 4 AS support_count, conv_id % 3 = 0 AS strict, turn % 5 = 4 AS low, turn % 2 = 0 AS fielded FROM conversations)"""


def _by_rule(spark: SparkSession, sf_dir: str, sql: str) -> DataFrame:
    """A relation of SQL over the turns; Spark reads the lists of DuckDB as array()."""
    turns = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    for old, new in (("[]", "CAST(array() AS ARRAY<STRING>)"), ("['", "array('"), ("']", "')"), ("]", ")")):
        sql = sql.replace(old, new)
    return spark.sql(f"SELECT * FROM {sql.replace('FROM conversations', 'FROM {turns}')}", turns=turns)


def nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nodes of all turns, and those by hand."""
    from pyspark.sql import functions as F

    df = spark.createDataFrame(NODES, "id string, text string, layer string, source string, confidence string, support_count long, scope string, topic string, first_seen string, last_seen string, " + ", ".join(f"{c} string" for c in LINKS))
    return df.withColumns({c: F.filter(F.split(c, ","), lambda x: x != "") for c in LINKS}).unionByName(_by_rule(spark, sf_dir, _TURN_NODES))


def nodes_sql() -> str:
    lists = ", ".join(f"list_filter(string_split({c}, ','), lambda x: x <> '') AS {c}" for c in LINKS)
    return f"(SELECT {', '.join(_NODE_FIELDS[:10])}, {lists} FROM {values_sql(NODES, _NODE_FIELDS)} UNION ALL BY NAME FROM {_TURN_NODES})"


def hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hits of all turns, and those by hand."""
    df = spark.createDataFrame(HITS, "query_id long, id string, path string, kind string, layer string, scope string, topic string, score long, source string, confidence string, support_count long, strict boolean, low boolean, fielded boolean")
    return df.unionByName(_by_rule(spark, sf_dir, _TURN_HITS))


def hits_sql() -> str:
    return f"(FROM {values_sql(HITS, _HIT_FIELDS)} UNION ALL BY NAME FROM {_TURN_HITS})"
