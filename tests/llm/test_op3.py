import random
import re

from sediment.llm.op3_jaccard import jaccard_components, keep_one_each, shown_blocks, sketch

from .corpus import SCHEMA, documents


def shingles(text):
    w = [x for x in re.split(r"[\x20\x09-\x0D]+", (text or "").translate({c: c + 32 for c in range(65, 91)})) if x]
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()


def brute_force(rows):
    sets = [shingles(r[1]) for r in rows]
    up = list(range(len(rows)))

    def top(i):
        while up[i] != i:
            i = up[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= 80 * len(sets[i] | sets[j]):
                up[top(i)] = top(j)
    out = []
    for i, r in enumerate(rows):
        ids = [x[0] for k, x in enumerate(rows) if top(k) == top(i) and x[0] is not None]
        out.append((r[0], len(sets[i]), min(ids, default=None)))
    return sorted(out, key=str)


def test_components_equal_brute_force(spark):
    rows = documents()
    got = jaccard_components(spark.createDataFrame(rows, SCHEMA)).drop("row_key").collect()
    assert sorted(map(tuple, got), key=str) == brute_force(rows)


def test_empty_table_and_clashing_columns(spark):
    assert jaccard_components(spark.createDataFrame([], SCHEMA)).collect() == []
    rows = [(1, "a b c d e f", 9, "x"), (2, "a b c d e f", 8, None), (3, None, 7, "y")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, node long, component_id string")
    assert sorted(map(tuple, keep_one_each(docs).collect())) == [(1, "a b c d e f", 9, "x"), (3, None, 7, "y")]


def test_families_just_below_the_threshold_and_null_bridges(spark):
    """Two families of similarity 0.79 or so across, and a row without an id that links two that have one."""
    rng = random.Random(4)
    base = [f"w{k}" for k in range(120)]

    def changed(w, places):
        w = list(w)
        for p in places:
            w[p] = f"x{rng.randrange(10**9)}"
        return w

    other = changed(base, (20, 50))  # ten shingles of 116 differ: with each member's own five, some pairs reach 0.8 and some don't
    rows = [(i, " ".join(changed(base, [rng.choice((70, 90, 110))]))) for i in range(30)]
    rows += [(100 + i, " ".join(changed(other, [rng.choice((72, 92, 112))]))) for i in range(30)]
    a = [f"b{k}" for k in range(60)]
    rows += [(500, " ".join(changed(a, (2, 3)))), (None, " ".join(a)), (501, " ".join(changed(a, (56, 57))))]
    rows += [(600, "same id on one text of many words here"), (600, "and on another text of many words there")]
    got = jaccard_components(spark.createDataFrame(rows, "doc_id long, text string")).drop("row_key").collect()
    assert sorted(map(tuple, got), key=str) == brute_force(rows)
    kept = keep_one_each(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(r["doc_id"] for r in kept if r["doc_id"] >= 500) == [500, 600, 600] and None not in {r["doc_id"] for r in kept}


def test_links_share_a_block_and_sketches_bound_differences():
    import numpy as np

    rng = np.random.default_rng(3)
    for n in (1, 2, 5, 7, 20, 63, 64, 100, 129, 500):
        for _ in range(20):
            a = np.unique(rng.integers(0, 1 << 63, n).astype(np.uint64))
            common = a[rng.permutation(len(a))[: max(1, int(np.ceil(0.89 * len(a))))]]
            b = np.unique(np.concatenate([common, rng.integers(0, 1 << 63, n // 9).astype(np.uint64)]))
            both = len(np.intersect1d(a, b))
            if 100 * both >= 80 * (len(a) + len(b) - both):
                assert set(shown_blocks(a).tolist()) & set(shown_blocks(b).tolist())
                x, y = (np.frombuffer(sketch(s), np.uint64) for s in (a, b))
                if len(x) == len(y):
                    assert np.bitwise_count(x ^ y).sum() <= len(a) + len(b) - 2 * both


def test_a_failed_closest_pair_hides_no_other_pair(spark):
    """The closest pair of two components (by sketch) has been tested in another bucket and is no link; another pair is one."""
    w = "w202968415388 w78565662211 w663705369129 w9670513493 w57819048933 w429466709257 w198904794790 w730870644034 w305719891961 w265888931156 w606383104154 w576951854798".split()
    two = [*w, "w929909773700", "w902372292745"]
    three = ["w932379846368", *two[1:]]
    texts = [["w187416768243", *w, "w286890062103"], two, three, [*three[:-1], "w480246107707"]]
    rows = [(k + 1, " ".join(t)) for k, t in enumerate(texts)]
    got = jaccard_components(spark.createDataFrame(rows, "doc_id long, text string")).drop("row_key").collect()
    assert sorted(map(tuple, got), key=str) == brute_force(rows)
    assert {r["doc_id"]: r["component_id"] for r in got}[4] == 2


def test_many_small_sets_in_overlapping_buckets(spark):
    """Short texts changed at either end, again and again: similarities lie around the threshold, buckets overlap."""
    for seed in (1, 2):
        rng = random.Random(seed)
        rows = []
        for _ in range(12):
            family = [[f"w{rng.randrange(10**9)}" for _ in range(rng.randrange(12, 24))]]
            for _ in range(24):
                t = list(rng.choice(family))
                for _ in range(rng.choice((1, 1, 2))):
                    at = rng.choice((0, -1, rng.randrange(len(t))))
                    t[at] = f"w{rng.randrange(10**9)}"
                if rng.random() < 0.3:
                    t.append(f"w{rng.randrange(10**9)}")
                family.append(t)
            rows += [" ".join(t) for t in family]
        rng.shuffle(rows)
        rows = list(enumerate(rows))
        got = jaccard_components(spark.createDataFrame(rows, "doc_id long, text string")).drop("row_key").collect()
        assert sorted(map(tuple, got), key=str) == brute_force(rows)
