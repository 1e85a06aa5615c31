import random
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from sediment.llm import queries
from sediment.llm.op8_toxicity import BEGINNINGS, LOOK_ALIKE, _whole, fit, fit_linear, grouped, keep_civil, label_model, read_texts, score_documents

from .corpus import words

SF = "/root/testdata/sf0.1"


def test_held_out_accuracy(spark):
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    got = queries()["op8_toxicity"](spark, SF).join(labels, "doc_id").filter("held_out").groupBy("toxic", "predicted").count().collect()
    n = {(r["toxic"], r["predicted"]): r["count"] for r in got}
    hit, missed, wrong = n[1, 1], n.get((1, 0), 0), n.get((0, 1), 0)
    assert hit / (hit + missed) > 0.8 and hit / (hit + wrong) > 0.9


def test_learned_words_nulls_and_clashing_columns(spark):
    rng = random.Random(1)
    rows = [(i, " ".join(words(rng, 30) + (["vilebad"] if i % 4 == 0 else [])), "x") for i in range(400)] + [(400, None, "y"), (401, "", "z"), (None, "vilebad", "n")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, score string")
    labels = spark.createDataFrame([(i, int(i % 4 == 0)) for i in range(0, 400)] + [(None, 1), (3, None)], "doc_id long, toxic int")
    model = fit(docs, labels)
    scores = {r["doc_id"]: r["score"] for r in score_documents(docs, model).collect()}
    assert scores[0] > 0.5 > scores[1] and scores[400] == scores[401] < 0.5 and scores[None] > 0.5
    kept = keep_civil(docs, labels)
    assert kept.columns == docs.columns and {r["doc_id"] for r in kept.collect()} == {i for i in range(402) if i % 4 or i == 400}


def test_without_labels_all_stay(spark):
    docs = spark.createDataFrame([(1, "a"), (2, None)], "doc_id long, text string")
    none = spark.createDataFrame([], "doc_id long, toxic int")
    assert keep_civil(docs, none).count() == 2
    assert keep_civil(docs.filter(F.lit(False)), none).count() == 0


def plain_words(text: str) -> list[bytes]:
    """Words as read_texts means them, character by character."""
    raw = text.encode()
    letter = [chr(c).isalpha() if c < 128 else True for c in raw]
    for i in range(len(raw) - 2, -1, -1):
        letter[i] = letter[i] or (chr(raw[i]) in LOOK_ALIKE and (chr(raw[i + 1]).isalpha() if raw[i + 1] < 128 else True))
    lowered = re.sub("[\u00c0-\u00d6\u00d8-\u00de]", lambda m: m[0].lower(), text).encode()
    lowered = bytes(ord(LOOK_ALIKE[chr(c)]) if chr(c) in LOOK_ALIKE else c for c in re.sub(rb"[A-Z]", lambda m: m[0].lower(), lowered))
    out, now = [], []
    for c, keep in [*zip(lowered, letter, strict=True), (0, False)]:
        if keep:
            now.append(c)
        elif now:
            out.append(bytes(now))
            now = []
    return out


def test_features_equal_brute_force():
    texts = ["You tr@sh, IDI0T! 4 you", "", "été ÉTÉ straße 123 a1b", "$$$ pay$$$ $ale", "x" * 3000 + " yy", "né"]
    got: dict[int, set[int]] = {}
    for r in read_texts(pa.array(texts)):
        for k, f in zip(r.row.tolist(), r.feature.tolist(), strict=True):
            assert f not in got.setdefault(r.first + k, set())
            got[r.first + k].add(f)
    for i, t in enumerate(texts):
        words = set(plain_words(t))
        assert len(got.get(i, ())) == len(words) + len({(k, w[:k]) for w in words for k in BEGINNINGS if len(w) > k})
        assert all(_whole(w.decode()) in got[i] for w in words if w.isascii())
    assert got[0] & {_whole("trash")} and got[0] & {_whole("idiot")}


def test_label_model_finds_accuracies_without_trusting_labels():
    rng = np.random.default_rng(5)
    truth = rng.random(6000) < 0.2
    accuracy = np.array([0.95, 0.9, 0.85, 0.8, 0.9, 0.5])
    says = np.array([1, 1, 1, 1, -1, 1])
    votes = np.zeros((6000, 6), np.int8)
    for k, (a, s) in enumerate(zip(accuracy, says, strict=True)):
        right = truth if s > 0 else ~truth
        votes[:, k] = np.where(rng.random(6000) < np.where(right, a * 0.6, (1 - a) * 0.6), s, 0)
    given = np.where(rng.random(6000) < 0.1, ~truth, truth)  # a tenth of the labels is wrong
    post, model = label_model(votes, given.astype(float), np.ones(6000))
    assert ((post >= 0.5) != truth).mean() < ((votes[:, 0] == 1) != truth).mean()
    strength = np.abs(np.log(model.rates[0, 0] / model.rates[1, 0]))
    assert strength[0] > strength[3] > strength[5]


def test_linear_model_and_voters():
    rng = np.random.default_rng(3)
    x = rng.random((500, 6)) < 0.3
    target = 1 / (1 + np.exp(-(x @ np.array([3.0, -2, 0, 1, 0, 0]) - 1)))
    row, at = np.nonzero(x)
    w, base = fit_linear(at, row, target, 6, ridge=1e-6, steps=50)
    assert np.allclose(w, [3, -2, 0, 1, 0, 0], atol=0.05) and abs(base + 1) < 0.05
    bits = np.array([[1, 1, 1], [1, 1, 1], [1, 1, 0], [0, 0, 1], [0, 0, 1], [0, 0, 1]], np.uint8)
    of = grouped(bits, np.array([1.0, 1, 1, 0, 0, 0]), np.ones(6), np.array([1, 1, 1]))
    assert of.tolist() == [0, 0, -1]  # the second is the first again; the third is wrong where they don't fire


def test_repeated_rows_ties_and_long_texts(spark):
    long = "calm words " * 60_000
    docs = spark.createDataFrame([(1, long + "vilebad", "a"), (1, long + "vilebad", "a"), (2, long, "a"), (2, long, "b")], "doc_id long, text string, toxic string")
    learn = spark.createDataFrame([(10 + i, "some calm words " + ("vilebad" if i % 3 == 0 else "kind")) for i in range(300)], "doc_id long, text string")
    model = fit(learn, spark.createDataFrame([(10 + i, int(i % 3 == 0)) for i in range(300)], "doc_id long, toxic int"))
    got = sorted((r["doc_id"], r["score"]) for r in score_documents(docs, model).collect())
    assert got[0] == got[1] and got[2] == got[3] and got[0][1] > 0.5 > got[2][1]


def test_a_carried_score_gives_way(spark):
    from sediment.llm.op8_toxicity import score_documents

    docs = spark.createDataFrame([(1, "a b", 9.0, "x")], "doc_id long, text string, Score double, odds string")
    got = score_documents(docs, (np.zeros(0, np.int32), np.zeros(0, np.float32), -4.0), carry=["doc_id", "Score", "odds"])
    assert got.columns == ["doc_id", "odds", "score"] and got.first()["score"] < 0.1
