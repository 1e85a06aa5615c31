import hashlib
import random
import re
import time
import zlib

import pytest

from sediment.llm.op12_runs import find_runs, lyndon_edges, op12_runs, repeated_words, runs_of, text_runs

from .corpus import SCHEMA, documents


def brute_force(s, shortest=6, times=4):
    """All maximal stretches of a period, their smallest periods alone."""
    out, n = [], len(s)
    for q in range(1, n // times + 1):
        i = 0
        while i + q < n:
            a = i
            while i + q < n and s[i] == s[i + q]:
                i += 1
            size = i + q - a
            if size >= max(shortest, times * q) and not any(all(s[k] == s[k + d] for k in range(a, a + size - d)) for d in range(1, q)):
                out.append((a, size, q))
            i += 1
    return sorted(out, key=lambda x: (x[0], x[2]))


def sequences(rng, many):
    for _ in range(many):
        letters, n, s = rng.choice((1, 2, 2, 3, 5)), rng.randrange(45), []
        if rng.random() < 0.5:
            s = [rng.randrange(letters) for _ in range(n)]
        while len(s) < n:
            s += [rng.randrange(letters) for _ in range(rng.randrange(1, 6))] * rng.randrange(1, 7)
        yield s


def test_lyndon_edges_equal_sorted_suffixes():
    for s in sequences(random.Random(1), 3000):
        n, (nss, shared) = len(s), lyndon_edges(s)
        for i in range(n):
            j = next((j for j in range(i + 1, n) if s[j:] < s[i:]), n)
            k = 0
            while j + k < n and s[i + k] == s[j + k]:
                k += 1
            assert (nss[i], shared[i]) == (j, k)


def test_runs_equal_brute_force():
    for s in sequences(random.Random(2), 3000):
        want = brute_force(s)
        assert runs_of(s) == want
        assert text_runs([str(x).encode() for x in s]) == want
        assert runs_of(s, 2, 3) == brute_force(s, 2, 3)


def test_time_is_linear():
    def took(n):
        a, b = [0], [0, 1]
        while len(b) < n:
            a, b = b, b + a
        began = time.process_time()
        for s in (b[:n], [0] * n, [0, 1] * (n // 2), [0, 0, 1] * (n // 3)):
            runs_of(s)
        return time.process_time() - began

    took(2_000)
    assert took(80_000) < 3 * took(40_000)


def planted(i, text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    h = zlib.crc32(str(i).encode())
    if i is not None and h % 10 == 0 and words:
        g, n = h // 10, len(words)
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [words[a + (k - a) % p] if k >= a else words[k] for k in range(n)]
    return words


def test_query_equals_brute_force(spark, tmp_path):
    rng = random.Random(3)
    rows = [r for r in documents() if len(r[1] or "") < 5_000]
    phrases = ["ha", "one two", "ein\tzwei\ndrei", "x y z\x0b", "é Ü ﬁ w v"]
    rows += [(1000 + k, " ".join([rng.choice(phrases)] * rng.randrange(1, 30)) + rng.choice(["", " tail", " ha ha", "\n"]), "en", "s", 0) for k in range(80)]
    rows += [(2000, "la " * 5000 + "x " + "la lu " * 3000, "en", "s", 0), rows[-1]]
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    got = sorted(map(tuple, op12_runs(spark, str(tmp_path)).collect()), key=str)
    want = []
    for i, t, *_ in rows:
        words = planted(i, t)
        runs = brute_force(words) if i != 2000 else text_runs([w.encode() for w in words])
        best = min(runs, key=lambda x: (-x[1], x[0], x[2]), default=None)
        gone = {k for a, n, p in runs for k in range(a + p, a + n)}
        lines = "".join(f"{a},{n},{p}\n" for a, n, p in runs)
        kept = " ".join(w for k, w in enumerate(words) if k not in gone)
        head = (*best, 1000 * best[1] // best[2]) if best else (None,) * 4
        want.append((i, len(runs), *head, hashlib.sha256(lines.encode()).hexdigest(), hashlib.sha256(kept.encode()).hexdigest()))
    assert got == sorted(want, key=str)
    assert sum(r[1] > 0 for r in want) > 40


def test_odd_rows_and_clashing_columns(spark):
    rows = [(1, None, 7, "a"), (1, None, 7, "a"), (None, "", 8, None), (3, " \t ", 9, "b"), (4, "ha " * 7, 10, "c")]
    got = find_runs(spark.createDataFrame(rows, "doc_id long, text string, n_runs int, other string"))
    assert got.columns == ["doc_id", "text", "other", "n_runs", "start", "length", "period", "exponent_milli", "runs", "collapsed"]
    found = {(r["doc_id"], r["other"]): (r["n_runs"], r["length"], r["collapsed"]) for r in got.collect()}
    assert found == {(1, "a"): (0, None, ""), (None, None): (0, None, ""), (3, "b"): (0, None, ""), (4, "c"): (1, 7, "ha")}
    assert got.count() == 5
    assert find_runs(spark.createDataFrame([], SCHEMA)).collect() == []
    with pytest.raises(ValueError):
        find_runs(got, min_exponent=2)
    assert repeated_words(4, [(0, 4, 1)]).tolist() == [False, True, True, True]
