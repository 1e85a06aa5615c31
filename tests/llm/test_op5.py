import hashlib
import random
import re
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from sediment.llm import op5_substrings
from sediment.llm._fm_index import FMIndex, matching_statistics, repeated_windows
from sediment.llm.op5_substrings import remove_repeats

from .corpus import SCHEMA, documents


def brute_force(rows, width):
    split = [[w for w in re.split(r"[\x20\x09-\x0D]+", r[1] or "") if w] for r in rows]
    times = Counter(tuple(w[i : i + width]) for w in split for i in range(len(w) - width + 1))
    out = []
    for r, w in zip(rows, split, strict=True):
        gone = set()
        for i in range(len(w) - width + 1):
            if times[tuple(w[i : i + width])] > 1:
                gone.update(range(i, i + width))
        kept = [x for k, x in enumerate(w) if k not in gone]
        out.append((r[0], len(w), len(gone), hashlib.sha256(" ".join(kept).encode()).hexdigest()))
    return sorted(out, key=str)


def test_removed_words_equal_brute_force(spark):
    rows = documents()
    got = remove_repeats(spark.createDataFrame(rows, SCHEMA)).drop("kept_text").collect()
    want = brute_force(rows, 35)
    assert sorted(map(tuple, got), key=str) == want
    assert sum(x[2] for x in want) > 0


def test_repeats_within_one_text_and_overlaps(spark):
    line = " ".join(f"a{k}" for k in range(35))
    rows = [(1, f"{line} {line} tail", "en", "s", 0), (2, f"x {line}", "en", "s", 0), (3, " ".join(["same"] * 90), "en", "s", 0), (4, " ".join(f"b{k}" for k in range(35)), "en", "s", 0)]
    got = {r["doc_id"]: r["n_removed"] for r in remove_repeats(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got == {1: 70, 2: 35, 3: 90, 4: 0}


def test_matching_statistics_equal_brute_force():
    rng = np.random.default_rng(6)
    for width in (3, 5):
        for _ in range(30):
            docs = [rng.integers(1, 4, rng.integers(width, 14)) for _ in range(rng.integers(1, 6))]
            times = rng.integers(1, 3, len(docs))
            lengths = np.array([len(d) for d in docs])
            starts = np.concatenate(([0], np.cumsum(lengths + 1)[:-1]))
            text, copies = np.zeros(int((lengths + 1).sum()), np.int64), np.zeros(int((lengths + 1).sum()), np.int64)
            for d, s, t in zip(docs, starts, times, strict=True):
                text[s : s + len(d)], copies[s : s + len(d)] = d, t
            index = FMIndex(text, int(lengths.max()), copies)

            def occurs(run):
                return sum(int(t) for d, t in zip(docs, times, strict=True) for i in range(len(d) - len(run) + 1) if (d[i : i + len(run)] == run).all())

            ends = np.concatenate([s + np.arange(n) for s, n in zip(starts, lengths, strict=True)])
            most = np.concatenate([np.arange(n) + 1 for n in lengths])
            got = matching_statistics(index, text, ends, most)
            want = [max((m for m in range(1, top + 1) if occurs(text[e - m + 1 : e + 1]) > 1), default=0) for e, top in zip(ends.tolist(), most.tolist(), strict=True)]
            assert got.tolist() == want
            doc, first, last = repeated_windows(index, text, starts, lengths, width)
            hits = {(k, i) for k, a, z in zip(doc.tolist(), first.tolist(), last.tolist(), strict=True) for i in range(a, z + 1)}
            assert hits == {(k, i) for k, d in enumerate(docs) for i in range(len(d) - width + 1) if occurs(d[i : i + width]) > 1}


def test_empty_table(spark):
    assert remove_repeats(spark.createDataFrame([], SCHEMA)).collect() == []


def test_short_passage_in_many_contexts_is_spread(spark, monkeypatch):
    """A phrase of 20 words in ever different contexts: no shard holds its anchor, and the removed words stay exact."""
    rng = random.Random(11)
    phrase = [f"p{k}" for k in range(20)]
    other = lambda n: [f"c{rng.randrange(10**9)}" for _ in range(n)]
    texts = [" ".join([*other(40), *phrase, *other(40)]) for _ in range(300)]
    for _ in range(30):  # windows that reach over the phrase's edge twice or thrice, and whole copies
        left, right = other(9), other(12)
        texts += [" ".join([*other(30), *left, *phrase, *right, *other(30)]) for _ in range(rng.choice((2, 3)))]
    texts += texts[:5]
    rows = [(i, t, "en", "s", 0) for i, t in enumerate(texts)]
    monkeypatch.setattr(op5_substrings, "ANCHOR_BYTES", 8192, raising=False)
    searched, most = op5_substrings._searched, []

    def seen(segments, shards, width):
        held = segments.filter("not often") if "often" in segments.columns else segments
        most.append(held.groupBy("anchor").agg(F.sum(F.octet_length("text")).alias("n")).agg(F.max("n")).first()[0] or 0)
        return searched(segments, shards, width)

    monkeypatch.setattr(op5_substrings, "_searched", seen)
    got = remove_repeats(spark.createDataFrame(rows, SCHEMA)).drop("kept_text").collect()
    want = brute_force(rows, 35)
    assert sorted(map(tuple, got), key=str) == want
    assert sum(x[2] > 0 for x in want) > 60
    assert most and max(most) <= 8192
