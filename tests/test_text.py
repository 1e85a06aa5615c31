"""Predicates and forms of texts against hand-made expectations, apart from their SQL."""

from pyspark.sql import functions as F

from sediment.functions import filters, forms
from sediment.functions import text as T
from sediment.operators import audit, search
from sediment.plans.memory_queries import TEXTS
from sediment.plans.queries import QUERIES

#: A text that a predicate accepts, and a near one that it doesn't.
LABELLED = {
    "noisy": ("Wall time: 3 s", "a wall of time"),
    "process_update": ("I will check the port next", "the port will be checked"),
    "sensitive_explicit": ("the private key is here", "the private office is here"),
    "negated_directive": ("Don't remember this: x", "I don't remember this"),
    "chinese_preference": ("以后我希望每次都用中文", "以后每次回答"),
    "sensitive_identifier": ("my_api_key", "key of the api"),
    "reviewable": ("a provisional fact", "a provision of facts"),
    "injected": ("x </instructions>", "the instructions"),
    "raw_prompt": ("in /home/me/x", "at home"),
    "permission_chatter": ("codex wants your approval", "codex wants tea"),
    "generic_rule": ("The tools should be safe.", "The tools should be blue."),
    "fleeting": ("maybe tomorrow", "every morning"),
    "redaction_labels_only": ("cookie, redacted", "cookie, baked"),
    "incomplete": ("**open", "**shut**"),
    "low_signal": ("memory archive updated", "memory kept"),
    "process_memory": ("task 7", "tasks"),
    "search_talk": ("a good hit", "a good fit"),
}


def test_each_predicate_tells_near_texts_apart(spark):
    rows = [(k, i, t) for k, pair in LABELLED.items() for i, t in enumerate(pair)]
    df = spark.createDataFrame(rows, "name string, i int, text string").withColumn("flat", T.compact_whitespace(F.col("text")))
    for r in filters.with_text_flags(df, "text", "flat").collect():
        assert r[r["name"]] == (r["i"] == 0), (r["name"], r["i"])
    flags = list(LABELLED)
    seen = QUERIES["memory_text_flags"](spark, "/root/testdata/sf0.001").filter("origin = 'sample'").agg(*(F.sum(k).alias(k) for k in flags)).first()
    assert all(0 < seen[k] < len(TEXTS) for k in flags)


def test_sentences(spark):
    rows = [(1, "- First one. Next one!\n<cwd> noise\n* third？fourth"), (2, "  "), (3, None), (4, "<cwd> only"), (5, "e.g. this stays. v1.2 too")]
    got = {r[0]: r[1] for r in spark.createDataFrame(rows, "id int, text string").select("id", forms.sentences(F.col("text"))).collect()}
    assert got[1] == ["First one.", "Next one!", "third？", "fourth"]
    assert got[2] == got[3] == [] and got[4] == ["<cwd> only"]
    assert got[5] == ["e.g. this stays. v1.2 too"]


def test_duplicate_keys_and_isoformat(spark):
    df = spark.createDataFrame([(1,), (1,), (2,), (None,)], "k int")
    assert [tuple(r) for r in audit.duplicate_keys(df, "k").collect()] == [(1, 2)]
    at = spark.range(1).select(T.isoformat(T.parse_timestamp(F.lit("20260514T120000"))).alias("x")).first()["x"]
    assert at == "2026-05-14T12:00:00Z"


def test_gates_of_redaction_let_nothing_through(spark):
    from sediment.plans.fixtures import SECRETS

    df = spark.createDataFrame(SECRETS, "id long, text string")
    for r in df.select("text", T.may_hold_secret(F.col("text")).alias("gate"), T._redacted(F.col("text")).alias("all"), T.redact(F.col("text")).alias("r")).collect():
        assert r["all"] == r["r"]


def test_record_scores_by_hand(spark):
    rows = [(1, "alpha-beta gamma", ["gamma"], "p"), (2, None, ["alpha-beta"], "q"), (3, "nothing", [], None)]
    df = spark.createDataFrame(rows, "id int, text string, tags array<string>, project string")
    got = {r["id"]: r["score"] for r in search.score_records(df, ["alpha-beta", "gamma"], ["/x/p", "p"]).collect()}
    # tokens 4 and 1, 15 and 2 times; phrase (4 + 1) * 18 * 3; (4 + 1) * 6; both: 20; two telling places: 26; specific 4 * 25; important 4 * 12 + 8
    assert got[1] == 15 * 5 + 2 + 270 + 30 + 20 + 26 + 100 + 56 + 1200
    # 2 * 4; 4 * 6; 4 * 25; 4 * 12 + 8; no telling field: a quarter
    assert got[2] == (8 + 24 + 100 + 56) // 4 and got[3] == 0
