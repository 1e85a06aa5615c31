"""Periodic runs of words, after Ellert and Fischer: runs over an ordered alphabet in linear time.

A text is a sequence over the alphabet of its distinct words, ordered by first appearance. One pass from left to right
gives the Lyndon array: at each place the longest Lyndon word, found by comparing suffixes along a chain of previous
smaller ones. How far two suffixes match is never found twice: inside the furthest match seen so far a comparison is the
shifted copy of an earlier one, and at its right end two known matches give the third, so each word is matched anew at most
once. No suffix array, tree or hash of words is built. Every run has a Lyndon root for the order or its reverse, so two
passes find all runs.

A run of exponent four or more holds each of its words four times at least. Texts are therefore first cut at words that a
stretch holds fewer than four times, a few times over; only stretches that remain are searched.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from ._common import small_batches, table, text_column

#: A run's least length in words and in periods.
MIN_LENGTH, MIN_EXPONENT = 6, 4
#: Times a text is cut at rare words before its stretches are searched; what is left over is searched all the same.
CUTS = 6
COLUMNS = "n_runs long, start long, length long, period long, exponent_milli long, runs array<struct<start:long,length:long,period:long>>, collapsed string"


def lyndon_edges(s: list[int]) -> tuple[list[int], list[int]]:
    """For each place i of s: the place j of the next smaller suffix (len(s) if none; the empty suffix is the smallest), and
    how many words the suffixes at i and j share. s[i:j] is the longest Lyndon word that begins at i.

    A comparison (l, r) is kept as nss[l] == r or pss[r] == l with its match. `left`, `right` and `end` are the comparison
    whose match ends furthest right.
    """
    n = len(s)
    nss, shared = [n] * n, [0] * n  # next smaller suffix and the match with it
    pss, before = [-1] * n, [0] * n  # previous smaller suffix and the match with it
    left = right = end = 0
    for r in range(1, n):
        at, match = r - 1, -1  # match: of the suffix popped last with that at r
        while at >= 0:
            copied = right < r < end  # then all of the chain down to r's previous smaller suffix lies in the match, too
            if not copied and match >= 0 and before[last] != match:
                known = min(before[last], match)  # two of three matches differ: the third is the smaller of them
            else:
                if copied:  # an earlier comparison, up to the end of the furthest match
                    a, b = at - right + left, r - right + left
                    known = min(shared[a] if nss[a] == b else before[b], end - r)
                else:
                    known = max(match, 0)
                if r + known >= end:
                    while r + known < n and s[at + known] == s[r + known]:
                        known += 1
                    if r + known >= end:
                        left, right, end = at, r, r + known
            if r + known < n and s[at + known] < s[r + known]:
                pss[r], before[r] = at, known
                break
            nss[at], shared[at] = r, known
            match, last, at = known, at, pss[at]
    return nss, shared


def runs_of(s: list[int], min_length: int = MIN_LENGTH, min_exponent: int = MIN_EXPONENT) -> list[tuple[int, int, int]]:
    """(start, length, period) of all runs of s, by start and period. Exponents of three and more can be asked for.

    A run's Lyndon root begins within its first period, so what lies left of the first root is shorter than one period and
    is matched word by word.
    """
    n, found = len(s), set()
    for order in (s, [-x for x in s]):
        nss, shared = lyndon_edges(order)
        for i in range(n):
            p = nss[i] - i
            stop = nss[i] + shared[i]
            if stop - i < (min_exponent - 1) * p or (i >= p and nss[i - p] == i and shared[i - p] >= stop - i):
                continue  # too short, or not the first root of its run
            a = i
            while a and s[a - 1] == s[a - 1 + p]:
                a -= 1
            if stop - a >= max(min_length, min_exponent * p):
                found.add((a, stop - a, p))
    return sorted(found, key=lambda x: (x[0], x[2]))


def stretches(s: np.ndarray, times: int = MIN_EXPONENT, shortest: int = MIN_LENGTH) -> list[tuple[int, int]]:
    """Bounds of the parts of s that can hold runs: no run of that exponent contains a word that occurs less often in it."""
    bounds = np.array([0, len(s)])
    inside = np.ones(len(s), bool)
    for _ in range(CUTS):
        place = np.flatnonzero(inside)
        if not len(place):
            return []
        part = np.searchsorted(bounds[::2], place, "right")
        _, back, count = np.unique(part * (np.int64(s.max()) + 1) + s[place], return_inverse=True, return_counts=True)
        rare = count[back] < times
        inside[place[rare]] = False
        step = np.diff(np.concatenate(([0], inside.view(np.int8), [0])))
        a, b = np.flatnonzero(step == 1), np.flatnonzero(step == -1)
        long = b - a >= shortest
        inside[np.flatnonzero(inside)] = np.repeat(long, b - a)
        bounds = np.column_stack((a[long], b[long])).ravel()
        if not rare.any():
            break
    return list(zip(bounds[::2].tolist(), bounds[1::2].tolist(), strict=True))


def text_runs(words: list[bytes], min_length: int = MIN_LENGTH, min_exponent: int = MIN_EXPONENT) -> list[tuple[int, int, int]]:
    """The runs of a list of words."""
    if len(words) < min_length:
        return []
    number: dict[bytes, int] = {}
    s = np.array([number.setdefault(w, len(number)) for w in words], np.int64)
    out = []
    for a, b in stretches(s, min_exponent, min_length):
        out += [(a + x, n, p) for x, n, p in runs_of(s[a:b].tolist(), min_length, min_exponent)]
    return out


def repeated_words(n: int, runs: list[tuple[int, int, int]]) -> np.ndarray:
    """Marks of the words that a run contains after its first period."""
    step = np.zeros(n + 1, np.int64)
    for start, length, period in runs:
        step[start + period] += 1
        step[start + length] -= 1
    return np.cumsum(step[:n]) > 0


def find_runs(docs: DataFrame, text: str = "text", min_length: int = MIN_LENGTH, min_exponent: int = MIN_EXPONENT) -> DataFrame:
    """The rows of `docs` with their runs of words and the text without repeats; other columns are kept.

    Words are runs of characters other than space and 0x09-0x0D, case regarded. A run is a stretch of words with a smallest
    period, of at least max(min_length, min_exponent * period) words, that neither neighbour extends. Columns: n_runs; start,
    length, period and exponent_milli of the longest (ties: smallest start, then period; null without a run); runs, by start,
    then period; collapsed, the words that no run contains after its first period, joined by one space.
    Null, empty and blank texts have no runs and collapse to ''. Each row stands alone: repeated rows give equal rows. Texts
    of any length are read whole, in time linear in their words but for sorting; a text is held by one task. Columns of `docs`
    with the names of the new ones are replaced; an empty table gives no rows.
    """
    if min_exponent < 3:
        raise ValueError("exponents below three need both ends of each root matched")
    small_batches(docs.sparkSession)
    new = [c.split(" ")[0] for c in COLUMNS.split(", ")]
    kept = [c for c in docs.columns if c.lower() not in new]
    given = docs.select(*[f"`{c}`" for c in kept], docs[text].alias("text of runs"))
    kind = given.select(*[f"`{c}`" for c in kept]).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for a in range(0, b.num_rows, 64):
                part = b.slice(a, 64)
                best, every, left = [], [], []
                for t in text_column(part, "text of runs").to_pylist():
                    words = t.encode().split()  # bytes split at the same six characters
                    runs = text_runs(words, min_length, min_exponent)
                    if runs:
                        gone = repeated_words(len(words), runs)
                        words = [words[k] for k in np.flatnonzero(~gone).tolist()]
                        x = min(runs, key=lambda x: (-x[1], x[0], x[2]))
                        best.append((*x, 1000 * x[1] // x[2]))
                    else:
                        best.append((None,) * 4)
                    every.append([{"start": x[0], "length": x[1], "period": x[2]} for x in runs])
                    left.append(b" ".join(words).decode())
                of_run = pa.list_(pa.struct([(k, pa.int64()) for k in ("start", "length", "period")]))
                made = [pa.array([len(x) for x in every], pa.int64()), *(pa.array([x[k] for x in best], pa.int64()) for k in range(4)), pa.array(every, of_run), pa.array(left, pa.string())]
                yield pa.RecordBatch.from_arrays([*(part.column(k) for k in range(len(kept))), *made], names=[*(f"c{k}" for k in range(len(kept))), *new])

    schema = ", ".join([*(f"c{k} {f.dataType.simpleString()}" for k, f in enumerate(kind)), COLUMNS])
    got = given.mapInArrow(run, schema)
    return got.toDF(*kept, *new)


def with_planted_runs(docs: DataFrame) -> DataFrame:
    """doc_id, text: documents whose id's crc32 ends in 0 repeat their own words from some place on.

    Let h = crc32(decimal doc_id), g = floor(h / 10), n the number of words. Where h % 10 = 0 and n > 0, each word i >= a
    becomes word a + (i - a) % p, with a = g % n and p = 1 + floor((n - a) / (3 + g % 8)); words are then joined by one space.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, texts = b.column("doc_id"), text_column(b, "text").to_pylist()
            for k, i in enumerate(ids.to_pylist()):
                h = zlib.crc32(str(i).encode())
                if i is not None and h % 10 == 0 and (words := texts[k].encode().split()):
                    g, n = h // 10, len(words)
                    a = g % n
                    p = 1 + (n - a) // (3 + g % 8)
                    texts[k] = b" ".join(words[:a] + [words[a + (i - a) % p] for i in range(a, n)]).decode()
            yield pa.RecordBatch.from_arrays([ids, pa.array(texts, pa.string())], names=["doc_id", "text"])

    small_batches(docs.sparkSession)
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, text string")


def op12_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of the runs and of the collapsed texts of all documents, some of which repeat themselves by a rule."""
    from pyspark.sql import functions as F

    got = find_runs(with_planted_runs(table(spark, sf_dir, "documents")))
    line = F.transform("runs", lambda x: F.concat(x["start"], F.lit(","), x["length"], F.lit(","), x["period"], F.lit("\n")))
    return got.select("doc_id", "n_runs", "start", "length", "period", "exponent_milli", F.sha2(F.array_join(line, ""), 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"))
