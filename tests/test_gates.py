"""Patterns behind literals find what the whole patterns find, and a lower-case text is made once."""

from pyspark.sql import functions as F

from sediment.functions import filters as P
from sediment.functions import titles
from sediment.plans.memory_queries import TEXTS

SAID = [
    *TEXTS, "I'm checking it", "i’ll run it", "then I will", "using `using-x as requested", "现在我检查", "我正在等待", "流程 validator", "tests pass and py_compile", "py_compile is green", "查询 top hit", "`a` 第一 命中是 b", "search result did match",
    "if it becomes so", "This might do", "for this dry-run", "temporary choice", "scratch  workspace", "current\ttest", "gate should pass", "test status", "after rerun", "Raw prompt", "prompt echo", "user must", "approve the sandbox", "live-run", "scheduled automation push", "raw_refs = 1", "sessions/a#b",
    "dry run found", "Live Update", "secret gate refused", "默认 secret gate", "产生新写入", "命中 `cookie", "cookie =", "stopped before running", "git status --short clean", "memory archive pushed", "repo is clean", "actual run processed 1 record", "Agents should be helpful and clear.", "a must " * 60, "should " + "x " * 300,
    "[a](b) 1. the current worktree `/tmp/x` for y, in worktree /home/u/z.py for , **wor**ktree task: `q`", "Task: see /Users/a/lib/x.so, 2) for  .", "DONE Findings: 1. High: broken: a/b.py x", "x 127.0.0.1 " + "long " * 40, "kept. I'm reading on\nso I'll also use it", "留下。下一块会 处理", "a\n\n b\tc  d **Commands** x", "Command Status: y", None,
]


def test_gated_patterns_equal_whole_ones(spark):
    df = spark.createDataFrame([(t,) for t in SAID], "text string").unionByName(spark.createDataFrame([(t.upper(),) for t in SAID if t], "text string"))
    text, low = F.col("text"), F.lower("text")
    whole = {
        "process_update": P._starts(low, P.PROCESS_STARTS) | low.rlike("|".join(f"(?:{p})" for p in P.PROCESS)),
        "fleeting": (text != "") & (text.rlike("|".join(f"(?:{p})" for p in (P.CHINESE_ACKNOWLEDGEMENT, P.ACKNOWLEDGEMENT, P.HYPOTHETICAL, P.TEMPORARY, P.TEST_STATUS, P.QUOTED_PROMPT, P.PERMISSION_CHATTER, P.DAILY_STATUS, P.DAILY_CONTRACT))) | P.generic_rule(text)),
        "run_status": text.rlike(P.RUN_STATUS),
    }
    gated = {"process_update": P.process_update(text), "fleeting": P.fleeting(text), "run_status": P._gated(text, low, P.RUN_STATUS_PARTS)}
    for r in df.select("text", *(c.alias(f"whole_{k}") for k, c in whole.items()), *(c.alias(f"gated_{k}") for k, c in gated.items())).collect():
        for k in whole:
            assert r[f"whole_{k}"] == r[f"gated_{k}"], (k, r["text"])


def test_gated_replacements_equal_plain_ones(spark):
    df = spark.createDataFrame([(t,) for t in SAID], "text string").withColumn("text", titles.forms.without_skill(F.col("text")))
    plain = F.col("text")
    for _, pattern, by in titles._STRIPPED:
        plain = F.regexp_replace(plain, pattern, by)
    ended = F.col("text")
    for _, pattern, by in titles._ENDINGS:
        ended = F.regexp_replace(ended, pattern, by)
    for r in df.select("text", plain.alias("a"), titles._replaced(F.col("text"), titles._STRIPPED).alias("b"), ended.alias("c"), titles._replaced(F.col("text"), titles._ENDINGS).alias("d")).collect():
        assert r["a"] == r["b"] and r["c"] == r["d"], r["text"]


def test_a_text_is_lowered_once(spark):
    for f in (P.noisy, P.raw_prompt, P.process_update, P.generic_rule):
        assert str(f(F.col("text"))).count("lower(") == 1, f
