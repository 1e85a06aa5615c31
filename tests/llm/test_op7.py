import math
import zlib
from collections import Counter

from pyspark.sql import functions as F

from sediment.llm.op7_sharding import DIMS, _measured, _placed, _points, kd_tree, shard_documents

from .corpus import SCHEMA, documents


def test_slots_sizes_and_groups(spark):
    rows = documents()
    got = shard_documents(spark.createDataFrame(rows, SCHEMA), n_shards=4).collect()
    assert len(got) == len(rows)
    by_text: dict[str, set[int]] = {}
    for r in got:
        raw = (r["text"] or "").encode()
        assert r["size"] == len(raw) + 1 and r["text_crc32"] == zlib.crc32(raw)
        by_text.setdefault(r["text"] or "", set()).add(r["shard"])
    assert all(len(s) == 1 for s in by_text.values())
    for shard, n in Counter(r["shard"] for r in got).items():
        assert 0 <= shard < 4 and sorted(r["slot"] for r in got if r["shard"] == shard) == list(range(n))


def test_nearly_equal_bytes(spark):
    docs = spark.range(4000).selectExpr("id AS doc_id", "repeat(concat('x', id), cast(1 + id % 97 AS int)) AS text")
    sizes = Counter()
    for r in shard_documents(docs, n_shards=16).collect():
        sizes[r["shard"]] += r["size"]
    assert len(sizes) == 16 and max(sizes.values()) < 1.1 * min(sizes.values())
    target = shard_documents(docs, target_bytes=100_000).groupBy("shard").sum("size").collect()
    assert max(r[1] for r in target) < 120_000


def test_empty_table(spark):
    assert shard_documents(spark.createDataFrame([], SCHEMA), n_shards=16).collect() == []
    assert shard_documents(spark.createDataFrame([], SCHEMA), target_bytes=10).collect() == []


def brute_force_tree(points: list[dict], leaves: int) -> list[list[dict]]:
    """Leaves of a k-d tree with exact weighted medians of the dimension of the greatest deviation."""

    def deviation(own: list[dict], d: str) -> float:
        w = sum(p["w"] for p in own)
        mean = sum(p["w"] * p[d] for p in own) / w
        return (sum(p["w"] * (p[d] - mean) ** 2 for p in own) / w) ** 0.5

    scale = {d: deviation(points, d) for d in DIMS}

    def parted(own: list[dict], n: int) -> list[list[dict]]:
        if n == 1 or not own:
            return [own] + [[]] * (n - 1)
        dim = max(DIMS, key=lambda d: round(deviation(own, d) / scale[d], 6))
        own = sorted(own, key=lambda p: p[dim])
        left, goal = math.ceil(n / 2), sum(p["w"] for p in own) * math.ceil(n / 2) / n
        total, cuts = 0.0, [(goal, 0)]
        for i, p in enumerate(own):
            total += p["w"]
            cuts.append((abs(total - goal), i + 1))
        at = min(cuts)[1]
        return parted(own[:at], left) + parted(own[at:], n - left)

    return parted(points, leaves)


def test_tree_equals_brute_force(spark):
    docs = spark.range(600).selectExpr("id AS doc_id", "repeat(concat('x', id % 400), cast(1 + pow(id % 31, 2) AS int)) AS text", "element_at(array('en', 'de', 'fr'), cast(1 + id % 3 AS int)) AS lang", "concat('s', id % 7) AS source")
    groups = _placed(_points(_measured(docs, "text", "lang", "source")))
    points = [r.asDict() for r in groups.collect()]
    by_key = {(p["key"], p["crc"]): k for k, leaf in enumerate(brute_force_tree(points, 8)) for p in leaf}
    got = shard_documents(docs, n_shards=8).select("shard", "size", F.xxhash64("text").alias("key"), F.crc32("text").alias("crc")).collect()
    assert len(got) == 600 and {(r["key"], r["crc"]): r["shard"] for r in got} == by_key
    dims = {r["dim"] for level in kd_tree(groups, 8)[0] for r in level.collect()}
    assert dims == set(DIMS)  # every dimension is split somewhere


def test_clashing_columns_repeated_rows_and_long_texts(spark):
    rows = [(1, "a", "x", 1, 2.0, 9), (1, "a", "x", 1, 2.0, 9), (None, None, "y", 2, 3.0, 9), (3, "long " * 200_000, "z", 3, 4.0, 9)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, kd_node string, node int, w double, shard int")
    got = shard_documents(docs, n_shards=2)
    assert set(docs.columns) <= set(got.columns) and got.columns.count("shard") == 1
    kept = sorted((r["doc_id"] or 0, r["kd_node"], r["node"], r["w"]) for r in got.collect())
    assert kept == sorted((r[0] or 0, r[2], r[3], r[4]) for r in rows)
    assert sorted((r["shard"], r["slot"]) for r in got.filter("doc_id <> 3 or doc_id is null").collect())[-1][1] <= 2
