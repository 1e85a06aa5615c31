"""Queries over sessions, JSON documents and graphs of links, with their SQL where it can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import goals as G
from ..functions import json_text as J
from ..functions import text as T
from ..operators import goals, graphs
from . import fixtures as X
from .queries import _query, _table

#: What user turns of some sessions say instead of their text, by rule, so that corrections occur.
SAYINGS = ["请帮我写这个 goal 的内容", "goal 必须用 markdown 格式", "不对，无法复制", "应该放进代码块，方便复制", "排版又乱了", "谢谢", "把 goal 直接给我，别解释", "接下来写个 python 脚本", "不要放代码块", "以后 goal 默认放在单独的 text 代码块，方便复制"]


def goal_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All turns; user turns of every third conversation say one of SAYINGS, the rest their text."""
    c = _table(spark, sf_dir, "conversations")
    saying = F.element_at(F.array(*map(F.lit, SAYINGS)), (F.pmod(F.xxhash64("conv_id", "turn"), F.lit(len(SAYINGS))) + 1).cast("int"))
    return c.select(F.col("conv_id").alias("session"), F.col("turn").alias("position"), "role", F.when(F.col("conv_id") % 3 == 0, saying).otherwise(F.col("text")).alias("text"))


@_query()
def goal_preferences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sessions that induce the preference of how goals are handed over, with the turns that support it."""
    found = goals.induced_goal_preferences(goal_sessions(spark, sf_dir))
    return found.select("session", "kind", F.array_join(F.transform("supports", lambda x: x.cast("string")), ",").alias("supports"), F.lit(G.PREFERENCE).alias("fact"))


# JSON.


def _escaped_sql(c: str) -> str:
    out = f"replace(replace(coalesce({c}, ''), '\\', '\\\\'), '\"', '\\\"')"
    return f"regexp_replace(replace(replace({out}, chr(10), '\\n'), chr(9), '\\t'), '[\\x00-\\x1f]', ' ', 'g')"


def _escaped(c: str) -> F.Column:
    out = F.replace(F.replace(F.coalesce(F.col(c), F.lit("")), F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"'))
    return F.regexp_replace(F.replace(F.replace(out, F.lit("\n"), F.lit("\\n")), F.lit("\t"), F.lit("\\t")), r"[\x00-\x1f]", " ")


_TEXTS_SQL = f"(SELECT doc_id AS id, text, source FROM documents UNION ALL SELECT -id, text, 'made up' FROM {X.values_sql(X.SECRETS, ['id', 'text'])})"
_JSON_SQL = f"""(SELECT id, '{{"id": ' || id || ', "body": {{"text" : "' || {_escaped_sql('text')} || '", "tags": ["' || {_escaped_sql('source')} || '", {{"again": ["' || {_escaped_sql('text')} || '"]}}, []]}}, "numbers": [1.50, 1e3, null, true], "{{key": {{}} }}' AS doc FROM {_TEXTS_SQL}
UNION ALL SELECT 1000000000 + event_id, props FROM events)"""


def json_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents as nested JSON, the made-up secrets, and the events' properties."""
    texts = _table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text", "source")
    texts = texts.unionByName(spark.createDataFrame(X.SECRETS, "id long, text string").select((-F.col("id")).alias("id"), "text", F.lit("made up").alias("source")))
    nested = F.concat(F.lit('{"id": '), F.col("id").cast("string"), F.lit(', "body": {"text" : "'), _escaped("text"), F.lit('", "tags": ["'), _escaped("source"), F.lit('", {"again": ["'), _escaped("text"), F.lit('"]}, []]}, "numbers": [1.50, 1e3, null, true], "{key": {} }'))
    return texts.select("id", nested.alias("doc")).unionByName(_table(spark, sf_dir, "events").select((F.col("event_id") + 1000000000).alias("id"), F.col("props").alias("doc")))


def _json_sql() -> str:
    value = "json_extract_string('[\"' || x || '\"]', '$[0]')"
    redacted = value
    for name, pattern in T.REDACTIONS.items():
        redacted = f"regexp_replace({redacted}, '{pattern}', '\\1[REDACTED_{name.upper()}]', 'g')"
    given = lambda c: f"replace(replace({c}, chr(2), '\\\"'), chr(1), '\\\\')"
    leaf = f"list_transform([{given('p')}], lambda x: CASE WHEN {redacted} = {value} THEN x ELSE (to_json({redacted})::VARCHAR)[2:-2] END)[1]"
    piece = f"CASE WHEN i % 2 = 1 THEN regexp_replace(p, '\\s+', '', 'g') WHEN regexp_matches(coalesce(parts[i + 1], ''), '^\\s*:') THEN {given('p')} ELSE {leaf} END"
    one = "CASE WHEN unicode(c) < 128 THEN c WHEN unicode(c) < 65536 THEN '\\u' || lpad(lower(to_hex(unicode(c))), 4, '0') ELSE '\\u' || lower(to_hex(55296 + (unicode(c) - 65536) // 1024)) || '\\u' || lower(to_hex(56320 + (unicode(c) - 65536) % 1024)) END"
    return f"""WITH d AS (SELECT id, string_split(replace(replace(doc, '\\\\', chr(1)), '\\"', chr(2)), '"') AS parts FROM {_JSON_SQL}),
j AS (SELECT id, array_to_string(list_transform(parts, lambda p, i: {piece}), '"') AS t FROM d),
o AS (SELECT id, array_to_string(list_transform(regexp_extract_all(t, '(?s).'), lambda c: {one}), '') AS t FROM j)
SELECT id, sha256(t) AS json_sha256, len(regexp_extract_all(t, '\\[REDACTED_')) AS n_redacted FROM o"""


@_query(_json_sql())
def json_redacted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JSON of all documents, made-up secrets and events with its strings redacted in place."""
    got = J.with_redacted_json(json_documents(spark, sf_dir), "doc", "r")
    return got.select("id", F.sha2("r.text", 256).alias("json_sha256"), F.regexp_count("r.text", F.lit(r"\[REDACTED_")).cast("long").alias("n_redacted"))


@_query(f"""WITH d AS (SELECT r.id AS doc, c.id AS node, c.parent, c.key, c.type, c.atom FROM {_JSON_SQL} r, json_tree(r.doc) c)
SELECT m.doc AS id, m.key AS name, CASE m.type WHEN 'OBJECT' THEN 'object' WHEN 'ARRAY' THEN 'array' WHEN 'VARCHAR' THEN 'string' WHEN 'BOOLEAN' THEN 'boolean' WHEN 'NULL' THEN 'null' ELSE 'number' END AS kind,
CASE WHEN m.type = 'VARCHAR' THEN sha256(json_extract_string(m.atom, '$')) END AS string_sha256 FROM d m JOIN d p ON p.doc = m.doc AND p.node = m.parent WHERE p.type = 'OBJECT'""")
def json_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All members of all objects in that JSON, at any depth."""
    got = J.walked(json_documents(spark, sf_dir), "id", "doc")
    return got.select("id", "name", "kind", F.when(F.col("kind") == "string", F.sha2(F.expr("variant_get(value, '$', 'string')"), 256)).alias("string_sha256"))


# Graphs.


@_query(f"""WITH RECURSIVE nodes AS (SELECT * FROM {X.nodes_sql()}), l AS (SELECT DISTINCT src, dst FROM (SELECT id AS src, unnest(derived_from) AS dst FROM nodes) WHERE dst IN (SELECT id FROM nodes)),
e AS (SELECT * FROM l WHERE src NOT IN (SELECT src FROM l WHERE src = dst) AND dst NOT IN (SELECT src FROM l WHERE src = dst)),
w AS (SELECT src, dst, 1 AS steps FROM e UNION SELECT w.src, e.dst, steps + 1 FROM w JOIN e ON w.dst = e.src WHERE steps < 4),
m AS (SELECT src, dst, min(steps) AS steps FROM w WHERE src <> dst GROUP BY ALL)
SELECT id, coalesce((SELECT string_agg(dst, ',' ORDER BY steps, dst) FROM m WHERE src = id), '') AS supports, CASE WHEN id IN (SELECT src FROM l WHERE src = dst) THEN '' ELSE id || coalesce((SELECT string_agg(',' || dst, '' ORDER BY steps, dst) FROM m WHERE src = id), '') END AS evidence FROM nodes""")
def support_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What every node rests on within four steps, and the evidence gathered there."""
    nodes = X.nodes(spark, sf_dir).select("id", "derived_from", F.array("id").alias("held"))
    got = graphs.supported_evidence(nodes, "held")
    return got.select("id", F.array_join("supports", ",").alias("supports"), F.array_join("evidence", ",").alias("evidence"))


_LINKS_SQL = f"(SELECT id AS src, unnest(list_concat(supersedes, derived_from)) AS dst FROM {X.nodes_sql()} UNION ALL SELECT 'hub', id FROM {X.nodes_sql()} WHERE confidence = 'low' UNION ALL SELECT id, 'hub' FROM {X.nodes_sql()} WHERE layer = 'global' AND confidence = 'high')"


@_query(f"""WITH RECURSIVE e AS (SELECT DISTINCT src, dst FROM {_LINKS_SQL} WHERE src <> dst), w AS (SELECT src, dst FROM e UNION SELECT w.src, e.dst FROM w JOIN e ON w.dst = e.src)
SELECT a.src AS node, min(a.dst) AS cycle FROM w a JOIN w b ON b.src = a.dst AND b.dst = a.src WHERE a.src IN (SELECT src FROM w WHERE src = dst) GROUP BY 1""")
def link_cycles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nodes on cycles of supersession and derivation, two hubs' links among them."""
    nodes = X.nodes(spark, sf_dir)
    links = nodes.select(F.col("id").alias("src"), F.explode(F.concat("supersedes", "derived_from")).alias("dst"))
    hub = nodes.filter("confidence = 'low'").select(F.lit("hub").alias("src"), F.col("id").alias("dst")).unionByName(nodes.filter("layer = 'global' AND confidence = 'high'").select(F.col("id").alias("src"), F.lit("hub").alias("dst")))
    return graphs.cyclic_nodes(links.unionByName(hub))


# Where facts come from.

#: What turns of some sessions say, by rule, around their text.
_FORMS = ["I prefer {}", "{}", "Reusable fact: {}", "{}", "my preference is that {}", "{}"]


def _said_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All turns as events; each says its text in one of _FORMS, and every fifth repeats the turn before."""
    c = _table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("session"), F.col("turn").alias("position"), "role", F.coalesce("text", F.lit("")).alias("text"))
    before = c.select("session", (F.col("position") + 1).alias("position"), F.col("text").alias("before"))
    text = F.when(F.pmod(F.col("session") + F.col("position"), F.lit(5)) == 0, F.coalesce("before", "text")).otherwise(F.col("text"))
    said = F.lit("")
    for k, form in enumerate(_FORMS):
        said = F.when(F.pmod(F.col("session") + 2 * F.col("position"), F.lit(len(_FORMS))) == k, F.concat(F.lit(form[: form.index("{")]), text)).otherwise(said)
    return c.join(before, ["session", "position"], "left").select("session", "position", "role", said.alias("text"))


@_query()
def fact_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The facts of all sessions (turns, and wishes as the user's facts) with their label and the turn that says them first."""
    from ..functions import forms
    from ..operators import provenance

    events = _said_turns(spark, sf_dir)
    wishes = events.filter("role = 'user'").select("session", forms.natural_memory(F.col("text")).alias("text")).filter("text is not null")
    facts = events.select("session", "text").unionByName(wishes).distinct()
    labelled = provenance.labelled_facts(facts, events, {"natural_user": wishes})
    return provenance.source_events(labelled, events).select("session", F.sha2("text", 256).alias("fact_sha256"), "source", "source_position")


_RECORDS_SQL = """t AS (SELECT conv_id, turn, 's/' || conv_id || '.jsonl' AS path, sha256(coalesce(text, '')) AS ev, turn + 1 AS line FROM conversations), r AS (SELECT path, sha256(string_agg(ev, ',' ORDER BY turn)) AS rec FROM t GROUP BY 1),
w AS (SELECT conv_id, turn, path, CASE WHEN turn % 7 = 1 THEN sha256('old') ELSE rec END AS was_rec, CASE WHEN turn % 7 = 3 THEN line + 1000 ELSE line END AS was_line, CASE WHEN turn % 7 = 2 THEN sha256(ev) ELSE ev END AS was_ev FROM t JOIN r USING (path) WHERE turn % 7 < 5),
a AS (SELECT *, CASE WHEN turn % 7 = 4 THEN left(sha256('forged' || conv_id || turn), 16) ELSE left(sha256(was_rec || chr(10) || was_line || chr(10) || '1' || chr(10) || was_ev), 16) END AS anchor FROM w)"""


@_query(f"""WITH {_RECORDS_SQL}, q AS (SELECT t.conv_id * 1000 + t.turn AS ref_id, CASE WHEN t.turn % 7 = 6 THEN '../' || t.path ELSE 's/' || (t.conv_id + CASE WHEN t.conv_id % 31 = 7 THEN 1000000000 ELSE 0 END) || '.jsonl' END AS path, CASE WHEN t.turn % 7 >= 5 THEN 'L' || t.turn ELSE a.anchor END AS anchor FROM t LEFT JOIN a USING (conv_id, turn)),
j AS (SELECT q.*, r.rec, a.was_rec, a.was_line, a.was_ev, n.ev AS now_ev FROM q LEFT JOIN r USING (path) LEFT JOIN a ON a.path = q.path AND a.anchor = q.anchor LEFT JOIN t n ON n.path = q.path AND n.line = a.was_line)
SELECT ref_id, status[1] AS status, status[2] AS reason, status[1] = 'available' AS previewed FROM (SELECT ref_id, CASE WHEN starts_with(path, '..') THEN ['blocked', 'unsafe_source_ref'] WHEN rec IS NULL THEN ['unavailable', 'source_ref_not_in_archive'] WHEN NOT regexp_full_match(anchor, '[0-9a-f]{{16}}') THEN ['unavailable', 'legacy_source_anchor_unavailable']
WHEN was_rec IS NULL THEN ['unavailable', 'source_anchor_unavailable'] WHEN left(sha256(was_rec || chr(10) || was_line || chr(10) || '1' || chr(10) || was_ev), 16) <> anchor THEN ['blocked', 'source_anchor_mismatch'] WHEN was_rec <> rec THEN ['blocked', 'source_hash_mismatch'] WHEN now_ev IS NULL THEN ['unavailable', 'source_anchor_missing'] WHEN now_ev <> was_ev THEN ['blocked', 'source_event_mismatch'] ELSE ['available', 'source_line_verified'] END AS status FROM j)""")
def reference_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A reference to every turn, good, tampered with or leading nowhere by rule, followed down to its line."""
    from ..operators import provenance

    turns = _table(spark, sf_dir, "conversations").select("conv_id", "turn", F.concat(F.lit("s/"), F.col("conv_id").cast("string"), F.lit(".jsonl")).alias("path"), "text", F.sha2(F.coalesce("text", F.lit("")), 256).alias("event_sha256"), (F.col("turn") + 1).alias("line"))
    records = turns.groupBy("path").agg(F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", "event_sha256"))), lambda x: x["event_sha256"]), ","), 256).alias("record_sha256"))
    index = turns.join(records, "path").withColumn("ordinal", F.lit(1).cast("long"))
    k = F.col("turn") % 7
    was = index.filter(k < 5).select("conv_id", "turn", "path", F.when(k == 1, F.sha2(F.lit("old"), 256)).otherwise(F.col("record_sha256")).alias("record_sha256"), F.when(k == 3, F.col("line") + 1000).otherwise(F.col("line")).alias("line"), "ordinal", F.when(k == 2, F.sha2("event_sha256", 256)).otherwise(F.col("event_sha256")).alias("event_sha256"))
    forged = F.left(F.sha2(F.concat(F.lit("forged"), F.col("conv_id").cast("string"), F.col("turn").cast("string")), 256), F.lit(16))
    anchors = was.withColumn("anchor", F.when(k == 4, forged).otherwise(provenance.anchor_id(F.col("record_sha256"), F.col("line"), F.col("ordinal"), F.col("event_sha256"))))
    asked = turns.join(anchors.select("conv_id", "turn", "anchor"), ["conv_id", "turn"], "left")
    path = F.when(k == 6, F.concat(F.lit("../"), "path")).when(F.col("conv_id") % 31 == 7, F.concat(F.lit("s/"), (F.col("conv_id") + 1000000000).cast("string"), F.lit(".jsonl"))).otherwise(F.col("path"))
    refs = asked.select((F.col("conv_id") * 1000 + F.col("turn")).alias("ref_id"), F.concat(path, F.lit("#"), F.when(k >= 5, F.concat(F.lit("L"), F.col("turn").cast("string"))).otherwise(F.col("anchor"))).alias("raw_ref"))
    return provenance.resolved_references(refs, anchors, index).select("ref_id", "status", "reason", F.col("preview").isNotNull().alias("previewed"))


@_query()
def session_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The evidence of every session's summary: its turns as facts and decisions by rule, its last turn as the final state."""
    from ..operators import summaries

    turns = _said_turns(spark, sf_dir)
    kind = F.when(F.col("role") == "user", F.when(F.col("text").startswith("I prefer"), "natural").otherwise("user")).when(F.col("text").startswith("Reusable fact"), "fact").otherwise(F.element_at(F.array(*map(F.lit, summaries.KINDS[2:7])), (F.pmod(F.col("position"), F.lit(5)) + 1).cast("int")))
    last = turns.groupBy("session").agg(F.max_by("text", "position").alias("text"))
    got = summaries.summary_evidence(turns.select("session", "position", kind.alias("kind"), "text"), last)
    return got.select("session", F.size("evidence").cast("long").alias("n_evidence"), F.sha2(F.array_join("evidence", "\n"), 256).alias("evidence_sha256"))


@_query()
def title_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document as a title, its score, and what of it may last without narration."""
    from ..functions import titles

    docs = _table(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    cleaned = docs.select("doc_id", titles.clean_title(F.col("text")).alias("title"), F.sha2(titles.durable_text(F.col("text")), 256).alias("durable_sha256"), F.sha2(titles.without_narration(F.col("text")), 256).alias("told_sha256"))
    return cleaned.select("doc_id", "title", titles.score_of_title(F.col("title")).alias("score"), "durable_sha256", "told_sha256")
