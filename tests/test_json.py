import json
import random
import re

from pyspark.sql import functions as F

from sediment.functions import json_text as J
from sediment.functions import text as T

SECRET = "AK" + "IA" + "ABCDEFGHIJKLMNOP"
PIECES = ["plain", "tab\there", "line\nbreak", 'quote " in', "back\\slash", "slash/", "é€😀", "\\u0041", "ends\\", "", ":", "{", "]", "x: Bear" + "er abc", "Author" + "ization: Bear" + "er abc.def-ghi rest", "Cook" + "ie: a=b\nnext", "use " + SECRET + " and " + SECRET, "s" + "k-" + "a1B2" * 6, "é " + SECRET]


def document(rng, depth):
    k = rng.random()
    if depth and k < 0.35:
        return {f"{rng.choice(PIECES[:13])}{i}": document(rng, depth - 1) for i in range(rng.randrange(4))}
    if depth and k < 0.6:
        return [document(rng, depth - 1) for _ in range(rng.randrange(4))]
    return rng.choice([*PIECES, *PIECES, 1, -2.5, 12345678901234567890, True, None, 1e300])


def redacted(value, counts):
    if isinstance(value, str):
        for name, p in T.REDACTIONS.items():
            value, n = re.subn(p, lambda m, name=name: m[1] + f"[REDACTED_{name.upper()}]", value)
            counts[name] += n
        return value
    if isinstance(value, list):
        return [redacted(x, counts) for x in value]
    return {k: redacted(x, counts) for k, x in value.items()} if isinstance(value, dict) else value


def members(value):
    if isinstance(value, dict):
        for k, x in value.items():
            yield k, x
            yield from members(x)
    elif isinstance(value, list):
        for x in value:
            yield from members(x)


def kind(x):
    return "null" if x is None else "boolean" if isinstance(x, bool) else "number" if isinstance(x, int | float) else {str: "string", list: "array", dict: "object"}[type(x)]


def test_redaction_keeps_keys_numbers_and_nesting(spark):
    rng = random.Random(8)
    documents = [document(rng, rng.randrange(7)) for _ in range(400)]
    rows = [(i, json.dumps(d, ensure_ascii=rng.random() < 0.5, indent=rng.choice([None, 2]))) for i, d in enumerate(documents)]
    rows += [(-1, None), (-2, "{no json"), (-3, ""), (-4, '{"a": 1, "a": 2}'), (-5, '{"n": 1.50, "e": 1E5, "s": "\\/ \\u0041"}')]
    got = {r["id"]: r["r"] for r in J.with_redacted_json(spark.createDataFrame(rows, "id long, text string"), "text", "r").collect()}
    for i, d in enumerate(documents):
        counts = dict.fromkeys(T.REDACTIONS, 0)
        want = redacted(d, counts)
        assert json.loads(got[i]["text"]) == want and got[i]["text"].isascii()
        assert {c: got[i][c] for c in counts} == counts
        assert SECRET not in got[i]["text"]
        assert re.sub(r'"(?:[^"\\]|\\.)*"', '""', got[i]["text"]) == re.sub(r'"(?:[^"\\]|\\.)*"', '""', json.dumps(want, separators=(",", ":")))
    assert got[-1] is got[-2] is got[-3] is got[-4] is None
    assert got[-5]["text"] == '{"n":1.50,"e":1E5,"s":"\\/ \\u0041"}'


def test_walk_finds_all_members_at_any_depth(spark):
    rng = random.Random(9)
    documents = [document(rng, rng.randrange(7)) for _ in range(200)]
    deep = "x"
    for k in range(40):
        deep = {f"k{k}": deep} if k % 3 else [deep]
    documents.append(deep)
    rows = [(i, json.dumps(d)) for i, d in enumerate(documents)] + [(-1, None), (-2, "[1")]
    spark.sparkContext.setCheckpointDir(spark.conf.get("spark.checkpoint.dir"))
    got = J.walked(spark.createDataFrame(rows, "id long, text string"), "id", "text")
    found = sorted((r["id"], r["name"], r["kind"]) for r in got.drop("value").collect())
    assert found == sorted((i, k, kind(x)) for i, d in enumerate(documents) for k, x in members(d))
    strings = got.filter("kind = 'string'").select("id", F.expr("variant_get(value, '$', 'string')").alias("s")).collect()
    assert sorted((r["id"], r["s"]) for r in strings) == sorted((i, x) for i, d in enumerate(documents) for _, x in members(d) if isinstance(x, str))
