import hashlib
import random

from pyspark.sql import functions as F

from sediment.functions import titles
from sediment.operators import provenance as V

SAMPLES = {
    "Fix the bug in the current worktree `/Users/me/w/x` for the parser": "Fix the bug in the parser",
    "1. Read `/home/me/a/b.py` and **report** it": "Read b.py and report it",
    "see [the page](https://e.org/x) now": "see the page now",
    "Task: load /opt/lib/libx265.215.dylib please": "load libx265.215.dylib please",
    "open /tmp/x/y for me": "open for me",
    "APPROVED. Findings: 1. High: the parser drops tokens: src/a.py line 3": "APPROVED: the parser drops tokens",
    "  $skill-name   plain   words  ": "plain words",
    "the " * 40 + "end! local routing fails here. Other": "local routing fails here. Other",
}


def test_titles(spark):
    rows = list(SAMPLES.items())
    got = [r["t"] for r in spark.createDataFrame(rows, "text string, want string").select(titles.clean_title(F.col("text")).alias("t")).collect()]
    assert got == [w for _, w in rows]
    scored = spark.createDataFrame([("",), ("verified: the root cause is the local proxy",), ("tiny",), ("<environment_context>",), ("127.0.0.1:80",)], "text string").select(titles.title_score(F.col("text"), 5).alias("s")).collect()
    assert [r["s"] for r in scored] == [titles.UNFIT, 5 + 28 + 24, 5 - 45, titles.UNFIT, 5 + 8 + 55 - 80 + 10]


def test_narration_goes(spark):
    rows = {"The cache is stale. I'll check it now": "The cache is stale.", "现在先看日志": "", "端口配置是八零八零端口。我会继续检查": "端口配置是八零八零端口", "A decision was made so I'll also use it": "A decision was made", "- ...": "", "验证结果：接口返回正常的数据": "接口返回正常的数据", "plain text": "plain text"}
    got = {r["text"]: r["t"] for r in spark.createDataFrame([(k,) for k in rows], "text string").select("text", titles.without_narration(F.col("text")).alias("t")).collect()}
    assert got == rows


def test_first_event_and_label_equal_a_search(spark):
    rng = random.Random(3)
    texts = ["The port is 8080", "I prefer short answers", "Reusable fact: the port is 8080", "the  PORT is 8080 - ", "maybe later", "The user prefers short answers", "Open /home/me/notes.md now", "committed and pushed", "We keep logs for a week", "reusable fact: we keep logs for a week", "", None]
    events = [(s, p, rng.choice(["user", "assistant"]), rng.choice(texts)) for s in range(25) for p in range(rng.randrange(14))]
    facts = [(s, t) for s in range(25) for t in [x for x in texts if x] + ["Open notes.md now", "never said"]]
    e = spark.createDataFrame(events, "session long, position long, role string, text string")
    f = spark.createDataFrame(facts, "session long, text string")
    keys = {(r["session"], r["position"]): set() for r in V.event_keys(e).collect()}
    for r in V.event_keys(e).collect():
        keys[r["session"], r["position"]].add((r["rank"], r["key"]))
    key = {r["text"]: r["k"] for r in f.select("text", V.source_key(F.col("text")).alias("k")).distinct().collect()}
    got = {(r["session"], r["text"]): r["source_position"] for r in V.source_events(f, e).collect()}
    for s, t in facts:
        order = sorted(events)
        first = next((p for rank in (1, 2) for x, p, role, _ in order if x == s and (rank == 2 or role == "user") and (rank, key[t]) in keys.get((s, p), ())), None)
        assert got[s, t] == first
    assert len({v for v in got.values()}) > 5
    known = {"natural_user": spark.createDataFrame([(s, "The user prefers short answers") for s in range(0, 25, 2)], "session long, text string"), "natural_user_correction": spark.createDataFrame([(3, "never SAID")], "session long, text string")}
    label = {(r["session"], r["text"]): r["source"] for r in V.labelled_facts(f, e, known).collect()}
    said = {(s, t.split(":")[1].strip().lower()) for s, _, role, t in events if role == "assistant" and t and t.lower().startswith("reusable fact")}
    for s, t in facts:
        k = " ".join(t.lower().split()).strip(" -")
        want = "natural_user_correction" if (s, k) == (3, "never said") else "natural_user" if s % 2 == 0 and k == "the user prefers short answers" else "explicit_reusable_fact" if (s, k) in said else "natural_assistant"
        assert label[s, t] == want, (s, t)


def sha(x):
    return hashlib.sha256(x.encode()).hexdigest()


def test_references_follow_down_to_the_line(spark):
    lines = {"a/s.jsonl": [["one", "two"], [], ["pass" + "word: hunter2 three"]], "b/t.jsonl": [["four"]]}
    record = {p: sha(repr(x)) for p, x in lines.items()}

    def anchor(p, line, k, text, rec=None):
        rec = rec or record[p]
        return (p, sha(f"{rec}\n{line}\n{k}\n{sha(text)}")[:16], rec, line, k, sha(text))

    good = [anchor("a/s.jsonl", 1, 2, "two"), anchor("a/s.jsonl", 3, 1, "pass" + "word: hunter2 three")]
    old = anchor("b/t.jsonl", 1, 1, "four", sha("older"))
    moved, edited = anchor("a/s.jsonl", 9, 1, "nine"), anchor("a/s.jsonl", 1, 1, "ONE")
    forged = ("a/s.jsonl", "0" * 16, record["a/s.jsonl"], 1, 1, sha("one"))
    refs = {
        **{i: (f"{a[0]}#{a[1]}", "available", "source_line_verified") for i, a in enumerate(good)},
        10: (f"{old[0]}#{old[1]}", "blocked", "source_hash_mismatch"),
        11: (f"{moved[0]}#{moved[1]}", "unavailable", "source_anchor_missing"),
        12: (f"{edited[0]}#{edited[1]}", "blocked", "source_event_mismatch"),
        13: (f"{forged[0]}#{forged[1]}", "blocked", "source_anchor_mismatch"),
        14: ("a/s.jsonl#L3", "unavailable", "legacy_source_anchor_unavailable"),
        15: ("a/s.jsonl#" + "1" * 16, "unavailable", "source_anchor_unavailable"),
        16: ("c/none.jsonl#" + "1" * 16, "unavailable", "source_ref_not_in_archive"),
        17: ("../a/s.jsonl#x", "blocked", "unsafe_source_ref"),
        18: ("/etc/passwd", "blocked", "unsafe_source_ref"),
        19: ("a/s.jsonl#to" + "ken: abc", "blocked", "unsafe_source_ref"),
        20: (None, "blocked", "unsafe_source_ref"),
    }
    index = V.line_index(spark.createDataFrame([(p, record[p], x) for p, x in lines.items()], "path string, record_sha256 string, lines array<array<string>>"))
    anchors = spark.createDataFrame([*good, old, moved, edited, forged], "path string, anchor string, record_sha256 string, line long, ordinal long, event_sha256 string")
    given = spark.createDataFrame([(i, r[0]) for i, r in refs.items()], "ref_id long, raw_ref string")
    got = {r["ref_id"]: r for r in V.resolved_references(given, anchors, index).collect()}
    assert {i: (r["status"], r["reason"]) for i, r in got.items()} == {i: r[1:] for i, r in refs.items()}
    assert got[0]["preview"] == "two" and "hunter2" not in got[1]["preview"] and "REDACTED" in got[1]["preview"] and got[10]["preview"] is None
    assert {r["preview"] for r in V.resolved_references(given, anchors, index, authorized=False).collect()} == {None}
