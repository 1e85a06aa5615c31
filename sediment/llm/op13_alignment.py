"""Alignment of two tokenizers by byte-owner arrays.

The tokens of both are laid over the same bytes: np.repeat gives each byte the number of its A token and of its B token.
Where a pair of owners follows another, tokens overlap anew; where both owners change at once, both tokenizers cut, and a
group ends. This is done for distinct stretches of text (both tokenizers cut where a stretch begins) and gathered per
document.

How many documents hold a pair of ids linked is counted over the whole corpus. Texts are read in blocks; a block counts its
own pairs, Spark sums the counts up and sends each block those of its pairs back, so that no table of all pairs is broadcast
and a pair that all documents hold is one row a block.
"""

from __future__ import annotations

import hashlib
import os
from collections.abc import Iterator
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import Scratch, chunks, held_by_worker, small_batches, table, text_column, written
from ._tokens import gather_index, stretches, tokenizer_file

#: Files of the tokenizers A (byte-level BPE) and B (BPE with byte fallback, which adds a space in front).
FIRST, SECOND = "byte_bpe_50k.json", "piece_bpe_32k.model"
#: Bytes of text whose pairs are counted together, and words encoded in one line.
BLOCK_BYTES, WORDS = 32 << 20, 200
#: Bytes of text aligned at a time (a longer text stands alone), and stretches that a worker keeps between batches.
CUT_BYTES, HELD = 1 << 20, 150_000
_LOW = (1 << 32) - 1


def _byte_level() -> dict[str, int]:
    """The byte that each character of a byte-level vocabulary stands for: printable ones for themselves, others from U+0100 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(0x100 + k): b for k, b in enumerate(others)}


class _Side:
    """A tokenizer as id arrays: the bytes of each id, and which ids begin with a space."""

    def __init__(self, raw: list[bytes]) -> None:
        self.sizes = np.array(list(map(len, raw)), np.int64)
        self.flat = np.frombuffer(b"".join(raw), np.uint8)
        self.first = np.concatenate(([0], np.cumsum(self.sizes)))[:-1]
        self.spaced = np.array([x[:1] == b" " for x in raw])

    def bytes_of(self, ids: np.ndarray) -> np.ndarray:
        sizes = self.sizes[ids]
        ends = np.cumsum(sizes)
        return self.flat[np.repeat(self.first[ids] - ends + sizes, sizes) + np.arange(ends[-1] if len(ends) else 0)]

    def ids(self, words: list[str], rest: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of stretches, one after another, and how many each has. Words of letters behind one space go in lines of many:
        each begins with a token that begins with a space."""
        flat, sizes = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for a in range(0, len(words), WORDS):
            here = words[a : a + WORDS]
            got = np.array(self.line("".join(here)), np.int64)
            at = np.flatnonzero(self.spaced[got])
            if len(at) == len(here) and at[0] == 0:
                flat.append(got)
                sizes.append(np.diff(np.append(at, len(got))))
            else:
                self._each(here, flat, sizes)
        self._each(rest, flat, sizes)
        return np.concatenate(flat), np.concatenate(sizes)

    def _each(self, texts: list[str], flat: list[np.ndarray], sizes: list[np.ndarray]) -> None:
        got = self.each(texts)
        sizes.append(np.array(list(map(len, got)), np.int64))
        flat.append(np.array(list(chain.from_iterable(got)), np.int64))


class _First(_Side):
    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        byte, raw = _byte_level(), [b""] * self.tokenizer.get_vocab_size()
        for t, i in self.tokenizer.get_vocab().items():
            raw[i] = bytes(byte[c] for c in t) if all(c in byte for c in t) else t.encode()
        super().__init__(raw)

    def line(self, text: str) -> list[int]:
        return self.tokenizer.encode(text, add_special_tokens=False).ids

    def each(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]


class _Second(_Side):
    def __init__(self, path: str) -> None:
        import sentencepiece

        self.model = m = sentencepiece.SentencePieceProcessor(model_file=path)
        n = m.get_piece_size()
        super().__init__([bytes([int(m.id_to_piece(i)[3:5], 16)]) if m.is_byte(i) else m.id_to_piece(i).replace("▁", " ").encode() for i in range(n)])
        self.lead = m.encode("\n")  # what a line end in front becomes: pieces never join with it

    def line(self, text: str) -> list[int]:
        return self.model.encode(text[1:])

    def each(self, texts: list[str]) -> list[list[int]]:
        """A space in front is added by the tokenizer, but not to nothing; stretches without one are encoded behind a line end,
        whose ids go."""
        added = [t[:1] == " " and len(t) > 1 for t in texts]
        got = self.model.encode([t[1:] if x else "\n" + t for t, x in zip(texts, added, strict=True)], num_threads=1)
        return [ids if x else ids[len(self.lead) :] for ids, x in zip(got, added, strict=True)]


def owners(sizes_a: np.ndarray, sizes_b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """For tokens of A and B over the same bytes: the overlaps as pairs of token numbers, and each token's group.

    Each byte has two owners. Consecutive distinct pairs of owners are the overlaps; a group ends where both change.
    """
    a, b = np.repeat(np.arange(len(sizes_a)), sizes_a), np.repeat(np.arange(len(sizes_b)), sizes_b)
    of_a, of_b = a[1:] != a[:-1], b[1:] != b[:-1]
    at = np.concatenate(([0], np.flatnonzero(of_a | of_b) + 1))[: len(a)]
    group = np.concatenate(([0], np.cumsum((of_a & of_b)[at[1:] - 1])))[: len(a)]
    over_a, over_b = a[at], b[at]
    group_a, group_b = np.zeros(len(sizes_a), np.int64), np.zeros(len(sizes_b), np.int64)
    group_a[over_a], group_b[over_b] = group, group
    return over_a, over_b, group_a, group_b


def _unique_sum(keys: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys in order and the sums of their values."""
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    first = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1]))) if len(keys) else np.zeros(0, np.int64)
    return keys[first], np.add.reduceat(values[order], first) if len(first) else values[:0]


def _ends(sizes: np.ndarray) -> np.ndarray:
    return np.concatenate(([0], np.cumsum(sizes)))


class Aligner:
    """Both tokenizers, and what is known of stretches, by number: n_a, n_b, n_groups and n_links, the groups' text as
    `a1,a2|b1;` for each, and the pairs (A id << 32 | B id) with the times that each is linked. A stretch that either
    tokenizer changes is not `right`."""

    def __init__(self, first: str, second: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark's tasks are the parallelism
        self.a, self.b = _First(first), _Second(second)
        n, m = len(self.a.sizes), len(self.b.sizes)
        self.said = [b"%d%s" % (i, end) for size, last in ((n, b"|"), (m, b";")) for end in (b",", last) for i in range(size)]
        self.said_size = np.array(list(map(len, self.said)), np.int64)
        self.base = np.array([0, n, 2 * n, 2 * n + m])
        self.forget()

    def forget(self) -> None:
        self.number: dict[str, int] = {}
        self.numbers, self.right, self.text = np.zeros((0, 4), np.int64), np.zeros(0, bool), []
        self.pair_ends, self.pairs, self.times = np.zeros(1, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)

    def known(self, distinct: pa.Array) -> np.ndarray:
        """The numbers of stretches; new ones are aligned."""
        if len(self.number) > HELD:
            self.forget()
        texts = distinct.to_pylist()
        got = np.fromiter(map(self.number.get, texts, repeat(-1)), np.int64, len(texts))
        missing = np.flatnonzero(got < 0).tolist()
        if missing:
            plain = [k for k in missing if texts[k][:1] == " " and texts[k][1:].isalpha()]
            is_plain = set(plain)
            order = [*plain, *(k for k in missing if k not in is_plain)]
            got[order] = len(self.number) + np.arange(len(order))
            self.number.update(zip(map(texts.__getitem__, order), range(len(self.number), len(self.number) + len(order)), strict=True))
            self._learn([texts[k] for k in plain], [texts[k] for k in order[len(plain) :]])
        return got

    def _learn(self, words: list[str], rest: list[str]) -> None:
        raw = [t.encode() for t in chain(words, rest)]
        sizes = np.array(list(map(len, raw)), np.int64)
        (a, of_a), (b, of_b) = self.a.ids(words, rest), self.b.ids(words, rest)
        there = [np.diff(_ends(side.sizes[x])[_ends(of)]) for side, x, of in ((self.a, a, of_a), (self.b, b, of_b))]
        right = (there[0] == sizes) & (there[1] == sizes)
        flat = np.frombuffer(b"".join(raw), np.uint8)[np.repeat(right, sizes)]
        wrong = (self.a.bytes_of(a[np.repeat(right, of_a)]) != flat) | (self.b.bytes_of(b[np.repeat(right, of_b)]) != flat)
        right[right] = np.diff(_ends(wrong)[_ends(sizes[right])]) == 0
        a, b = a[np.repeat(right, of_a)], b[np.repeat(right, of_b)]
        numbers, n = np.zeros((len(sizes), 4), np.int64), int(right.sum())
        numbers[right, 0], numbers[right, 1] = of_a[right], of_b[right]
        text, pairs_of = [b""] * len(sizes), np.zeros(len(sizes), np.int64)
        if n:
            groups, links, spelt, ends, pair, times, size = self._groups(a, b, numbers[right, 0], numbers[right, 1])
            numbers[right, 2], numbers[right, 3], pairs_of[right] = groups, links, size
            ends = ends.tolist()
            for k, x, y in zip(np.flatnonzero(right).tolist(), ends, ends[1:], strict=False):
                text[k] = spelt[x:y]
            self.pairs, self.times = np.concatenate((self.pairs, pair)), np.concatenate((self.times, times))
        self.numbers, self.right = np.concatenate((self.numbers, numbers)), np.concatenate((self.right, right))
        self.pair_ends = np.concatenate((self.pair_ends, self.pair_ends[-1] + np.cumsum(pairs_of)))
        self.text += text

    def _groups(self, a: np.ndarray, b: np.ndarray, of_a: np.ndarray, of_b: np.ndarray) -> tuple:
        """Of stretches with tokens a and b: numbers of groups and links, all groups' text and its ends, all pairs, their times
        and how many each stretch has."""
        n = len(of_a)
        _, _, group_a, group_b = owners(self.a.sizes[a], self.b.sizes[b])
        n_groups = int(group_a[-1]) + 1
        in_a, in_b = np.bincount(group_a, minlength=n_groups), np.bincount(group_b, minlength=n_groups)
        stretch = np.repeat(np.arange(n), of_a)[np.cumsum(in_a) - in_a]  # a group lies in one stretch
        links = np.diff(_ends(in_a * in_b)[np.searchsorted(stretch, np.arange(n + 1))])
        base = np.cumsum(in_a + in_b) - in_a - in_b
        at_a = base[group_a] + np.arange(len(a)) - (np.cumsum(in_a) - in_a)[group_a]
        at_b = (base + in_a)[group_b] + np.arange(len(b)) - (np.cumsum(in_b) - in_b)[group_b]
        last_a = np.concatenate((group_a[1:] != group_a[:-1], [True]))
        last_b = np.concatenate((group_b[1:] != group_b[:-1], [True]))
        word = np.empty(len(a) + len(b), np.int64)
        word[at_a], word[at_b] = a + self.base[last_a.astype(int)], b + self.base[2 + last_b.astype(int)]
        spelt = b"".join(map(self.said.__getitem__, word.tolist()))
        ends = _ends(self.said_size[word])[_ends(of_a + of_b)]
        # pairs: distinct ids of A and of B in a group, times how often each is there
        (key_a, times_a), (key_b, times_b) = (_unique_sum(g << 32 | x, np.ones(len(x), np.int64)) for g, x in ((group_a, a), (group_b, b)))
        each = np.diff(np.searchsorted(key_b >> 32, np.arange(n_groups + 1)))
        index, _ = gather_index(each, key_a >> 32)
        left = np.repeat(np.arange(len(key_a)), each[key_a >> 32])
        pair = (key_a[left] & _LOW) << 32 | (key_b[index] & _LOW)
        times, row = times_a[left] * times_b[index], stretch[key_a[left] >> 32]
        order = np.lexsort((pair, row))
        pair, times, row = pair[order], times[order], row[order]
        new = np.flatnonzero(np.concatenate(([True], (pair[1:] != pair[:-1]) | (row[1:] != row[:-1]))))
        return np.bincount(stretch, minlength=n), links, spelt, ends, pair[new], np.add.reduceat(times, new), np.bincount(row[new], minlength=n)


def _sums(x: np.ndarray) -> np.ndarray:
    return np.concatenate((np.zeros((1, x.shape[1]), np.int64), np.cumsum(x, axis=0)))


class _Block:
    """The pairs of a block in the order in which they came, and how many documents of it hold each."""

    def __init__(self, number: int) -> None:
        self.number, self.size = number, 0
        self.keys, self.place = np.zeros(0, np.int64), np.zeros(0, np.int64)  # sorted
        self.order: list[np.ndarray] = []
        self.docs = np.zeros(0, np.int64)

    def places(self, keys: np.ndarray) -> np.ndarray:
        """The places of sorted, distinct keys; new ones get the next places."""
        at = np.minimum(np.searchsorted(self.keys, keys), max(0, len(self.keys) - 1))
        new = self.keys[at] != keys if len(self.keys) else np.ones(len(keys), bool)
        fresh = keys[new]
        out = np.empty(len(keys), np.int64)
        out[~new] = self.place[at[~new]] if len(self.keys) else 0
        out[new] = len(self.keys) + np.arange(len(fresh))
        if len(fresh):
            self.order.append(fresh)
            every, place = np.concatenate((self.keys, fresh)), np.concatenate((self.place, out[new]))
            order = np.argsort(every, kind="stable")
            self.keys, self.place = every[order], place[order]
            self.docs = np.concatenate((self.docs, np.zeros(len(fresh), np.int64)))
        return out


_ROW = "block long, n_a long, n_b long, n_groups long, n_links long, groups string, n_pairs int, places binary, times binary, pairs array<long>, docs array<long>"


def aligned_rows(docs: DataFrame, first: str, second: str, spell: bool) -> DataFrame:
    """A row per document (with the places of its pairs in its block and how often each is linked) and one per block, of no
    document, with pairs and docs. `groups` is the spelt-out text if asked for, else its SHA-256."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: Aligner = held_by_worker(("align", first, second), lambda: Aligner(first, second))
        number = TaskContext.get().partitionId() << 24
        block = _Block(number)
        names = ["doc_id", *(c.strip().split(" ")[0] for c in _ROW.split(","))]
        for b in batches:
            col = text_column(b, "text")
            for x, z in chunks(col, CUT_BYTES):
                distinct, codes, bounds = stretches(col[x:z])
                got = known.known(distinct)
                n = z - x
                ends = _sums(known.numbers[got][codes])
                empty = np.diff(np.frombuffer(col.buffers()[1], np.int32)[col.offset + x : col.offset + z + 1]) == 0
                good = (np.diff(_ends(~known.right[got][codes])[bounds]) == 0) & ~empty
                sums = np.diff(ends[bounds], axis=0) * good[:, None]
                said = list(map([known.text[k] for k in got.tolist()].__getitem__, codes.tolist()))
                groups = [b"".join(said[p:q])[:-1] if ok else b"" for p, q, ok in zip(bounds.tolist(), bounds[1:].tolist(), good.tolist(), strict=False)]
                shown = [g.decode() if spell or not g else hashlib.sha256(g).hexdigest() for g in groups]
                # pairs of each document
                index, _ = gather_index(np.diff(known.pair_ends), got)
                sizes, times = np.diff(known.pair_ends)[got], known.times[index]
                keys, back = np.unique(known.pairs[index], return_inverse=True)
                stretch = np.repeat(np.arange(n), np.diff(bounds))
                held = np.flatnonzero(good[stretch])
                index, ends_pairs = gather_index(sizes, codes[held])
                row = np.repeat(stretch[held], np.diff(ends_pairs))
                found, linked = _unique_sum(row * max(1, len(keys)) + back[index], times[index])
                row, local = np.divmod(found, max(1, len(keys)))
                used = np.flatnonzero(np.bincount(local, minlength=len(keys)))
                place = np.zeros(len(keys), np.int64)
                place[used] = block.places(keys[used])
                block.docs += np.bincount(place[local], minlength=len(block.docs))
                cut = np.searchsorted(row, np.arange(n + 1))
                raw_place, raw_times = place[local].astype(np.int32), linked.astype(np.int32) if not len(linked) or linked.max() < 1 << 31 else None
                if raw_times is None:
                    raise ValueError("a document links one pair of ids two billion times")

                def binary(values: np.ndarray, cut: np.ndarray = cut) -> pa.Array:
                    return pa.BinaryArray.from_buffers(pa.binary(), len(cut) - 1, [None, pa.py_buffer((4 * cut).astype(np.int32)), pa.py_buffer(values)])

                none = pa.nulls(n, pa.list_(pa.int64()))
                yield pa.RecordBatch.from_arrays([b.column("doc_id")[x:z], pa.array(np.full(n, block.number)), *(pa.array(sums[:, k]) for k in range(4)), pa.array(shown, pa.string()), pa.array(np.diff(cut).astype(np.int32)), binary(raw_place), binary(raw_times), none, none], names=names)
                block.size += len(col[x:z]) and int(pa.compute.sum(pa.compute.binary_length(col[x:z])).as_py())
                if block.size >= BLOCK_BYTES:
                    yield _closed(block, b, names)
                    number += 1
                    block = _Block(number)
        if block.size or len(block.docs):
            yield _closed(block, b, names)

    import pyarrow.compute  # noqa: F401

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, {_ROW}")


def _closed(block: _Block, b: pa.RecordBatch, names: list[str]) -> pa.RecordBatch:
    """The block's own row."""
    every = np.concatenate(block.order) if block.order else np.zeros(0, np.int64)
    whole = lambda x: pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), pa.array(x))
    of_doc = [pa.nulls(1, t) for t in (*[pa.int64()] * 4, pa.string(), pa.int32(), pa.binary(), pa.binary())]
    return pa.RecordBatch.from_arrays([pa.nulls(1, b.column("doc_id").type), pa.array([block.number]), *of_doc, whole(every), whole(block.docs)], names=names)


def pair_counts(rows: DataFrame) -> DataFrame:
    """block, place, docs, best: of each pair of each block, how many documents of the corpus hold it linked, and whether no pair
    of its A id is held by more."""
    pairs = rows.filter("pairs is not null").select("block", F.posexplode(F.arrays_zip("pairs", "docs"))).select("block", F.col("pos").alias("place"), F.col("col.pairs").alias("pair"), F.col("col.docs").alias("docs"))
    counts = written(pairs.groupBy("pair").agg(F.sum("docs").alias("docs")), "align-counts")
    best = counts.groupBy(F.shiftright("pair", 32).alias("a")).agg(F.max("docs").alias("most"))
    ranked = counts.withColumn("a", F.shiftright("pair", 32)).join(best, "a").select("pair", "docs", (F.col("docs") == F.col("most")).alias("best"))
    return pairs.drop("docs").join(ranked, "pair").select("block", "place", "docs", "best")


def align_tokens(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", first: str | None = None, second: str | None = None, spell: bool = True) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, groups, n_best, count_sum of each row.

    `first` is the path of a byte-level BPE of the tokenizers library, `second` that of a sentencepiece model that adds a space
    in front and knows all bytes, on every executor; special strings in texts are ordinary text. Both read space+text. groups
    spells out the ids of each group, as a1,a2|b1;a3|b2,b3, or (without `spell`) its SHA-256. A link is a pair of an A and a B
    token in one group. A pair of ids counts the rows that hold it linked; n_best is the links whose pair has the highest count
    of its A id, ties included, and count_sum the sum of counts over links.
    Null and empty texts, and texts that either tokenizer changes, have no tokens: zeros and ''. Repeated rows count each.
    Texts of any length are read whole; stretches without a space or a change between letters, digits and signs are encoded
    whole. Other columns don't matter, whatever their names; an empty table gives no rows.
    """
    spark = docs.sparkSession
    small_batches(spark)
    lean = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    with Scratch(spark) as scratch:
        rows = scratch.keep(written(aligned_rows(lean, first or tokenizer_file(FIRST), second or tokenizer_file(SECOND), spell), "align-rows"))
        counts = scratch.keep(written(pair_counts(rows), "align-ranked"))
    blocks = rows.filter("pairs is null").drop("pairs", "docs").withColumn("docs", F.lit(None).cast("long")).withColumn("best", F.lit(None).cast("boolean")).withColumn("place", F.lit(-1))
    sent = counts.select(*[(F.col(c) if c in counts.columns else F.lit(None).cast(blocks.schema[c].dataType)).alias(c) for c in blocks.columns if c != "is_doc"])
    both = blocks.withColumn("is_doc", F.lit(True)).unionByName(sent.withColumn("is_doc", F.lit(False)))
    n = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    kind = docs.schema[doc_id].dataType.simpleString()
    return both.repartition(n, "block").sortWithinPartitions("block", "is_doc", "place").mapInArrow(_summed, f"doc_id {kind}, n_a long, n_b long, n_groups long, n_links long, groups string, n_best long, count_sum long")


def _summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Documents behind the counts of their block's pairs, which come first and in order."""
    import pyarrow.compute as pc

    held: list[tuple[np.ndarray, np.ndarray]] = []
    docs, best, of = np.zeros(0, np.int64), np.zeros(0, np.int64), None
    for b in batches:
        is_doc, block = b.column("is_doc").to_numpy(zero_copy_only=False), b.column("block").to_numpy()
        step = np.flatnonzero(np.concatenate(([True], (block[1:] != block[:-1]) | (is_doc[1:] != is_doc[:-1]), [True])))
        for x, y in zip(step[:-1].tolist(), step[1:].tolist(), strict=True):
            part = b.slice(x, y - x)
            if block[x] != of:
                of, held, docs = block[x], [], np.zeros(0, np.int64)
            if not is_doc[x]:
                held.append((part.column("docs").to_numpy(), pc.cast(part.column("best"), pa.int64()).to_numpy()))
                continue
            if held:
                docs, best = np.concatenate([h[0] for h in held]), np.concatenate([h[1] for h in held])
                held = []
            sizes = part.column("n_pairs").to_numpy()
            ends = np.concatenate(([0], np.cumsum(sizes, dtype=np.int64)))
            place, times = (np.frombuffer(b"".join(part.column(c).to_pylist()), np.int32) for c in ("places", "times"))
            total = np.concatenate(([0], np.cumsum(times * docs[place]))) if len(place) else np.zeros(1, np.int64)
            first = np.concatenate(([0], np.cumsum(times * best[place]))) if len(place) else np.zeros(1, np.int64)
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), *(part.column(c) for c in ("n_a", "n_b", "n_groups", "n_links", "groups")), pa.array(np.diff(first[ends])), pa.array(np.diff(total[ends]))], names=["doc_id", "n_a", "n_b", "n_groups", "n_links", "groups", "n_best", "count_sum"])


def op13_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How the tokens of two tokenizers lie over all documents, with digests of the groups."""
    return align_tokens(table(spark, sf_dir, "documents"), spell=False).withColumnRenamed("groups", "groups_sha256")
