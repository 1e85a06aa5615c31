import hashlib

import pytest
from pyspark.sql import functions as F

from sediment.operators import answers, projects
from sediment.sources import inventories


def sha(x):
    return hashlib.sha256(x.encode()).hexdigest()


def test_manifest_defects_and_targets(spark):
    record = {"a/b/1.jsonl": "one", "a/2.jsonl": "two", "c/3.jsonl": "three"}
    records = spark.createDataFrame([(p, sha(x), len(x)) for p, x in record.items()], "path string, sha256 string, size long")
    shape = "path string, sha256 string, size long, updated_at string"
    good = [(p, sha(x), len(x), f"2026-01-0{k + 1}T00:00:00Z") for k, (p, x) in enumerate(record.items())]
    manifest = spark.createDataFrame(good, shape)
    assert inventories.manifest_defects(manifest, records).collect() == []
    assert inventories.checked_manifest(manifest, records).count() == 3
    bad = {
        ("/a", sha("x"), 1, "2026-01-01T00:00:00Z"): "invalid_path",
        ("a/../b", sha("x"), 1, "2026-01-01T00:00:00Z"): "invalid_path",
        ("a//b", sha("x"), 1, "2026-01-01T00:00:00Z"): "invalid_path",
        (None, sha("x"), 1, "2026-01-01T00:00:00Z"): "invalid_path",
        ("x", "ABC", 1, "2026-01-01T00:00:00Z"): "invalid_hash",
        ("x1", sha("x"), -1, "2026-01-01T00:00:00Z"): "invalid_size",
        ("x2", sha("x"), 1, "soon"): "invalid_time",
        ("gone", sha("x"), 1, "2026-01-01T00:00:00Z"): "missing_record",
        ("a/2.jsonl", sha("other"), 3, "2026-01-01T00:00:00Z"): "changed_record",
        ("c/3.jsonl", sha("three"), 6, "2026-01-01T00:00:00Z"): "changed_record",
    }
    for row, want in bad.items():
        got = inventories.manifest_defects(spark.createDataFrame([row], shape), records).collect()
        assert [r["defect"] for r in got] == [want], row
    twice = spark.createDataFrame([*good, good[0]], shape)
    assert {(r["path"], r["defect"]) for r in inventories.manifest_defects(twice, records).collect()} == {("a/b/1.jsonl", "duplicate_path")}
    with pytest.raises(Exception, match="duplicate_path at a/b/1.jsonl"):
        inventories.checked_manifest(twice, records).collect()
    targets = spark.createDataFrame([("all", ""), ("a", "a/"), ("ab", "a/b/"), ("none", "z/")], "target string, folder string")
    archived = spark.createDataFrame([("all", "a/2.jsonl", sha("two"), "2026-01-02T00:00:00Z")], "partition string, path string, sha256 string, t string").withColumn("updated_at", F.try_to_timestamp("t")).drop("t")
    ledger = spark.createDataFrame([("all", "a/b/1.jsonl")], "partition string, path string")
    got = {(r["target"], r["path"]) for r in inventories.discovered(manifest, targets, archived, ledger).collect()}
    assert got == {("all", "a/b/1.jsonl"), ("all", "c/3.jsonl"), ("a", "a/b/1.jsonl"), ("a", "a/2.jsonl"), ("ab", "a/b/1.jsonl")}


def test_answers_are_drawn_and_judged(spark):
    rows = {
        ("Memory. Reference answer:  the port is 8080. Query: which port", "which port"): "the port is 8080",
        ("reference ANSWER: use uv Which tool do we use?", "which tool do we use?"): "use uv",
        ("Reference answer: Which tool? uv", "which tool?"): "Which tool? uv",
        ("no prefix  here.", "x"): "no prefix here.",
        ("Reference answer:  . Expected memory: y", "x"): answers.ABSTENTION,
        ("Reference answer: pass" + "word: abc", "x"): answers.ABSTENTION,
        (None, "x"): answers.ABSTENTION,
    }
    got = {(r["text"], r["query"]): r["a"] for r in spark.createDataFrame(list(rows), "text string, query string").withColumn("a", answers.extracted_answer(F.col("text"), F.col("query"))).collect()}
    assert got == rows
    cases = spark.createDataFrame([(1, "port", "8080"), (2, "tool", "pip"), (3, "none", None), (4, "none", "x"), (5, "y", None)], "case_id long, query string, expected string")
    hits = spark.createDataFrame([(1, "b", 5, "Reference answer: it is 8080", True), (1, "a", 9, "no", False), (2, "c", 7, "Reference answer: uv", True), (2, "d", 7, "pip", True), (5, "e", 1, "something", True)], "case_id long, memory_id string, score long, text string, supported boolean")
    told = {r["case_id"]: (r["memory_id"], r["verdict"]) for r in answers.answer_records(cases, hits).collect()}
    assert told == {1: ("b", "right"), 2: ("c", "wrong"), 3: (None, "abstained"), 4: (None, "missed"), 5: ("e", "wrong")}


def test_origins_of_records(spark):
    lines = [
        (1, '{"type": "session_meta", "payload": {"thread_source": " Automation ", "cwd": "/w/p/"}}'),
        (1, '{"deep": [{"workspace": "/w/q"}, {"workspace": "relative"}]}'),
        (2, '{"type": "other", "payload": {"thread_source": "automation"}}'),
        (2, "no json"),
        (3, '{"repo_path": "/", "cwd": 5, "name": "/w/p"}'),
        (3, None),
    ]
    got = projects.record_origins(spark.createDataFrame(lines, "record long, line string"))
    assert {r["record"]: (r["paths"], r["automation"]) for r in got.collect()} == {1: (["/w/p", "/w/q"], True), 2: ([], False), 3: (["/"], False)}
    assert sorted(r["record"] for r in projects.of_project(got, "/w/p/").collect()) == [1, 2]
    assert sorted(r["record"] for r in projects.of_project(got, "/w/p", needs_path=True).collect()) == [1]
