"""A ranking's tasks stay small however many documents there are, and their number changes nothing."""

import re

import pytest

from sediment import catalog
from sediment.operators import search

SF = "/root/testdata/sf0.001"
ITEMS = [(1, "alpha-beta gamma gamma the"), (2, "delta épsilon"), (3, None), (4, "the of")]
DOCS = [(k % 37, ["gamma " * (k % 9), "alpha-beta delta " * (k % 4), "Épsilon gamma", None, "nothing"][k % 5]) for k in range(60)]


def parts(df):
    return {int(n) for n in re.findall(r"hashpartitioning\(doc_id#\d+L?, (\d+)\), REPARTITION_BY_NUM", df._jdf.queryExecution().executedPlan().toString())}


def brute_force(limit):
    told = {1: {"alpha-beta": 4, "gamma": 1}, 2: {"delta": 1, "épsilon": 5}}
    out = []
    for item, worth in told.items():
        scores = {}
        for doc in {d for d, _ in DOCS}:
            words = " ".join(t for d, t in DOCS if d == doc and t).lower().split()
            if score := sum(min(words.count(w), 5) * n for w, n in worth.items()):
                scores[doc] = score
        best = sorted(scores, key=lambda d: (-scores[d], -d))[:limit]
        out += [(item, d, scores[d], k + 1) for k, d in enumerate(best)]
    return sorted(out)


def test_passage_rank_deals_documents(spark, monkeypatch):
    monkeypatch.setattr(search, "PAIRS", 10)
    items, docs = spark.createDataFrame(ITEMS, "item_id long, text string"), spark.createDataFrame(DOCS, "doc_id long, text string")
    got = search.rank_passages(items, docs, 4)
    assert parts(got) == {len(ITEMS) * len(DOCS) // 10}
    assert sorted((r["item_id"], r["doc_id"], r["score"], r["place"]) for r in got.collect()) == brute_force(4)


@pytest.mark.parametrize("name", ["rank_metrics", "threshold_gate"])
def test_metrics_deal_documents(spark, monkeypatch, name):
    plain = sorted(catalog.queries()[name](spark, SF).collect())
    monkeypatch.setattr(search, "PAIRS", 1000)
    got = catalog.queries()[name](spark, SF)
    pairs = spark.read.parquet(f"{SF}/documents.parquet").count() * spark.read.parquet(f"{SF}/benchmark.parquet").count()
    assert parts(got) == {-(-pairs // 1000)} and sorted(got.collect()) == plain
