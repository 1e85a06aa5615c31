import hashlib
import math
from collections import Counter

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from sediment import llm
from sediment.llm.op2_mixing import mix_sources, source_rates

from sediment.llm.op8_toxicity import fit, score_documents

from ..oracle import duck, rows_of, rows_of_sql
from .corpus import SCHEMA, documents
from .test_op3 import brute_force as jaccard_by_hand
from .test_op10 import brute_force as hits_by_hand

SF = "/root/testdata/sf0.01"


@pytest.mark.parametrize("name", sorted(llm.oracle_sql()))
def test_query_equals_its_sql(spark, name):
    got, names = rows_of(llm.queries()[name](spark, SF))
    want, columns = rows_of_sql(duck(SF), llm.oracle_sql()[name])
    assert names == columns and got == want and got


def test_stages_follow_one_another(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    sizes = [docs.count()]
    for _, stage in corpus_pipeline.STAGES[:3]:
        after = stage(spark, docs, SF)
        assert after.columns == docs.columns
        docs = after.persist()
        sizes.append(docs.count())
        assert docs.select("doc_id").distinct().count() == sizes[-1]
    assert sizes == sorted(sizes, reverse=True) and sizes[-1] > 0.5 * sizes[0]
    out = corpus_pipeline.run(spark, SF)
    assert {"shard", "slot"} <= set(out.columns)
    kept = {r[0] for r in docs.select("doc_id").collect()}
    assert {r[0] for r in out.select("doc_id").collect()} <= kept


def plain_pipeline(docs, items, sources_of, keep_toxic):
    """The stages before sharding in plain Python: doc_id -> times, for documents that the classifier leaves."""
    rows = [(r["doc_id"], r["text"]) for r in docs if keep_toxic[r["doc_id"]]]
    least = {i: c for i, _, c in jaccard_by_hand([(i, t) for i, t in rows])}
    rows = [(i, t) for i, t in rows if least[i] == i]
    dirty = {i for i, _, n, _ in hits_by_hand([(i, t, None) for i, t in rows], items) if n}
    rows = [(i, t) for i, t in rows if i not in dirty]
    size = Counter()
    for i, t in rows:
        size[sources_of[i] or ""] += len((t or "").encode())
    roots = sum(math.sqrt(b) for b in size.values())
    out = {}
    for i, _ in rows:
        b = size[sources_of[i] or ""]
        rate = math.sqrt(b) / roots * sum(size.values()) / b
        u = int(hashlib.md5(f"mix-1|{i}".encode()).hexdigest()[:13], 16) / 2.0**52
        k, upto = 0, math.exp(-rate)
        while upto <= u:
            k += 1
            upto += math.exp(k * math.log(rate) - rate - math.lgamma(k + 1))
        if k:
            out[i] = k
    return out


def test_whole_pipeline_equals_plain_python(spark, tmp_path):
    """run() over a small table, beside all pairs, all windows and counts drawn one by one; only the scores are the operator's."""
    small = "/root/testdata/sf0.001"
    for name in ("documents", "labels", "benchmark"):
        spark.read.parquet(f"{small}/{name}.parquet").write.parquet(f"{tmp_path}/{name}.parquet")
    docs, labels = spark.read.parquet(f"{tmp_path}/documents.parquet"), spark.read.parquet(f"{tmp_path}/labels.parquet")
    civil = {r["doc_id"]: r["score"] < 0.5 for r in score_documents(docs, fit(docs, labels)).collect()}
    rows = docs.collect()
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{tmp_path}/benchmark.parquet").collect()]
    want = plain_pipeline(rows, items, {r["doc_id"]: r["source"] for r in rows}, civil)
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert Counter(r["doc_id"] for r in got) == want and 0 < len(want) < len(rows)
    by_text, by_shard = {}, {}
    for r in got:
        assert r["size"] == len((r["text"] or "").encode()) + 1
        by_text.setdefault(r["text"], set()).add(r["shard"])
        by_shard.setdefault(r["shard"], []).append(r["slot"])
    assert all(len(s) == 1 for s in by_text.values()) and all(sorted(s) == list(range(len(s))) for s in by_shard.values())


def test_stages_with_odd_rows(spark, tmp_path):
    """Nulls, repeated rows, clashing columns and empty tables go through every stage."""
    text = " ".join(f"w{k}" for k in range(30))
    rows = [(1, text, "s", 5, "a"), (1, text, "s", 5, "a"), (2, text + " more", "s", 6, "b"), (3, None, None, 7, "c"), (None, "a text of its own here", "t", 8, "d"), (4, "", "t", 9, "e"), (5, "the item in question is this one", "t", 1, "f")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, node int, score string")
    spark.createDataFrame([], "doc_id long, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, "item in question")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs.limit(0), str(tmp_path)).count() == 0
        after = stage(spark, docs, str(tmp_path))
        assert set(docs.columns) <= set(after.columns)
        got = sorted(str(r["doc_id"]) for r in after.collect())
        want = {"toxicity": "1 1 2 3 4 5 None", "near_copies": "1 1 3 4 5 None", "decontamination": "1 1 2 3 4 None", "sharding": "1 1 2 3 4 5 None"}.get(name)
        assert want is None or got == want.split()


def test_mixing_edge_cases(spark):
    docs = spark.createDataFrame(documents(), SCHEMA)
    mixed = mix_sources(docs, weights={"s0": 3.0, "s1": 1.0}, epochs=4.0)
    assert mixed.filter("source = 's2' or source is null").count() == 0
    got = {r["source"]: r["b"] for r in mixed.groupBy("source").agg(F.sum(F.octet_length("text")).alias("b")).collect()}
    assert set(got) == {"s0", "s1"} and got["s0"] > got["s1"]
    assert mix_sources(docs.limit(0)).count() == 0
    rates = {r["mix_source"]: r["mix_rate"] for r in source_rates(docs, epochs=2.0).collect()}
    assert set(rates) == {"", "s0", "s1", "s2"} and all(r > 0 for r in rates.values())
    assert sorted(map(str, mix_sources(docs).collect())) == sorted(map(str, mix_sources(docs.repartition(7)).collect()))
