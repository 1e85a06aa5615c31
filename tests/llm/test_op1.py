import hashlib
import random

import numpy as np
import pyarrow as pa

from sediment.llm.op1_fingerprints import band_keys, compare_with_edits, likeness, near_duplicates, signatures

from .corpus import SCHEMA, documents, words
from .test_op3 import brute_force, shingles


def test_edited_texts_and_equal_fingerprints(spark):
    rows = sorted({(r[0], r[1] or "") for r in documents() if r[0] is not None})
    got = sorted(compare_with_edits(spark.createDataFrame(rows, "doc_id long, text string")).collect(), key=lambda r: r["doc_id"])
    assert [r["doc_id"] for r in got] == [r[0] for r in rows]
    prints: dict[str, str] = {}
    for k, r in enumerate(got):
        text, after = rows[k][1], rows[(k + 1) % len(rows)][1]
        cut = len(text) // 4
        edited = text[: len(text) - cut] + after[:cut]
        assert r["n_chars"] == len(text)
        assert r["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
        assert prints.setdefault(text, r["fingerprint"]) == r["fingerprint"]
        assert 0 <= r["near_edited"] <= 1 and 0 <= r["near_next"] <= 1


def test_likeness_estimates_jaccard():
    rng = random.Random(5)
    for share in (0.0, 0.1, 0.3, 0.6):
        a = words(rng, 600)
        b = [f"x{rng.random()}" if k < share * 600 else w for k, w in enumerate(a)]
        s, t = shingles(" ".join(a)), shingles(" ".join(b))
        sig = signatures(pa.array([" ".join(a), " ".join(b)]))
        assert abs(float(likeness(sig[0], sig[1])) - len(s & t) / len(s | t)) < 0.15
    assert np.array_equal(*signatures(pa.array(["a b c d e f", "A  b c\td e F"])))


def test_classes_hold_true_links_and_nearly_all_of_them(spark):
    """Against all pairs, on large clusters of near copies: links that all members share, chains, and template variants."""
    rng = random.Random(8)
    texts = []
    for _ in range(6):
        base = words(rng, 150)
        for _ in range(60):  # each differs from the base, and more from its siblings
            w = list(base)
            for _ in range(rng.randrange(6)):
                w[rng.randrange(len(w))] = f"e{rng.randrange(10**9)}"
            texts.append(" ".join(w))
    chain = words(rng, 200)
    for k in range(40):  # each differs from the last only
        chain[k * 4] = f"c{rng.randrange(10**9)}"
        texts.append(" ".join(chain))
    rows = list(enumerate([*texts, texts[0], "", None, "one two"]))
    sets = [shingles(t) for _, t in rows]
    got = {r["doc_id"]: r["near_class"] for r in near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    truth = {r[0]: r[2] for r in brute_force(rows)}
    links = [(i, j) for i in range(len(rows)) for j in range(i) if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j])]
    assert sum(got[i] == got[j] for i, j in links) >= 0.9 * len(links) and len(links) > 2000
    assert all(truth[i] == truth[got[i]] for i in got)  # no class reaches beyond a true component
    assert got[len(texts)] == got[0] and all(got[i] == i for i in range(len(texts) + 1, len(rows)))


def test_bands_meet_as_planned():
    rng = np.random.default_rng(1)
    sigs = rng.integers(0, 1 << 16, (200, 128), dtype=np.uint16)
    near = sigs.copy()
    near[rng.random(near.shape) < 0.1] ^= 1
    same = (band_keys(sigs) == band_keys(near)).sum(axis=1)
    want = [(sigs[k].reshape(16, 8) == near[k].reshape(16, 8)).all(axis=1).sum() for k in range(200)]
    assert same.tolist() == want and (same > 0).mean() > 0.99


def test_clashing_columns_repeated_rows_and_long_texts(spark):
    long = " ".join(f"w{k}" for k in range(100_000))
    rows = [(None, "a b c d e f", "x", 1, 2), (1, long, "y", 1, 2), (2, long + " z", "z", 1, 2), (2, long + " z", "z", 1, 2), (3, None, "n", 1, 2)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, fingerprint string, run int, near_class int")
    got = sorted(((r["doc_id"] or 0, r["n_chars"], r["near_class"]) for r in compare_with_edits(docs).collect()), key=str)
    assert got == sorted([(0, 11, None), (1, len(long), 1), (2, len(long) + 2, 1), (2, len(long) + 2, 1), (3, 0, 3)], key=str)


def test_empty_table(spark):
    assert compare_with_edits(spark.createDataFrame([], SCHEMA)).collect() == []
