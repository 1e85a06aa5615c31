"""Packing documents into sequences: shortest pack first over the histogram of lengths.

A document's tokens are cut into whole sequences and a rest. The rests' lengths are counted, and the counts alone are packed,
longest first: documents of a length go on top of the shortest packs that hold them, many at once, and open new packs while
the corpus has sequences left. Once all are open, what fits nowhere is cut to fill the shortest packs, and its remainder is
packed when its own length comes. There are just as many sequences as the tokens fill, the last tokens in sequences of
powers of two, so nothing is padded. The driver holds patterns of lengths, a table bounded by the sequence length; documents
find their places by their rank among those of their length.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ._common import Scratch, chunks, held_by_worker, small_batches, table, text_column, written
from ._tokens import CUT_BYTES, Encoder, gathered, stretches, tokenizer_file

LENGTH = 4096
#: Words that are encoded in one line.
WORDS = 200
#: The tokenizer's file and the id that ends a document.
TOKENIZER, END = "word_bpe_49k.json", 2
_PLAN = ["level", "of", "lo", "hi", "shift", "length", "pack", "offset"]


def pack_counts(counts: np.ndarray, length: int = LENGTH) -> np.ndarray:
    """Places of pieces, one row per group: level, of, lo, hi, shift, length, pack, offset.

    counts[n] is how many rests are n tokens long, for 0 < n < length. A row puts tokens shift to shift + length of the rests
    `of` tokens long with ranks lo to hi - 1 into packs pack, pack + 1, ... at `offset`. Rests that are cut have rows of levels
    0, 1, ... . All packs but the last few are full; those hold a power of two each, so every pack is filled.
    """
    total = int((counts * np.arange(len(counts))).sum())
    packs, last = divmod(total, length)
    rooms: dict[int, list[tuple[int, int, int]]] = {}
    heap: list[int] = []

    def leave(room: int, group: tuple[int, int, int]) -> None:
        """A group of packs: the first, how many, and where their room begins."""
        if room:
            if not rooms.setdefault(room, []):
                heapq.heappush(heap, -room)
            rooms[room].append(group)

    for k in range(length.bit_length() - 1, -1, -1):
        if last >> k & 1:
            leave(1 << k, (packs + (last >> (k + 1)).bit_count(), 1, 0))
    opened, rows = 0, []
    cut: dict[int, list[tuple[int, int, int, int, int]]] = {}
    for size in range(length - 1, 0, -1):
        blocks = cut.pop(size, [])
        if size < len(counts) and counts[size]:
            blocks.insert(0, (0, size, 0, int(counts[size]), 0))
        for level, of, lo, hi, shift in blocks:
            while lo < hi:
                room = -heap[0] if heap else 0
                if room < size and opened < packs:  # as if one by one: a new pack is filled before the next is opened
                    each, n = length // size, min((hi - lo) // (length // size), packs - opened)
                    each, n = (each, n) if n else (hi - lo, 1)
                    rows += [(level, of, lo + k * n, lo + k * n + n, shift, size, opened, k * size) for k in range(each)]
                    leave(length - each * size, (opened, n, each * size))
                    opened, lo = opened + n, lo + each * n
                    continue
                group = rooms[room].pop()
                if not rooms[room]:
                    heapq.heappop(heap)
                pack, n, offset = group
                take = min(n, hi - lo)
                if take < n:
                    leave(room, (pack + take, n - take, offset))
                used = min(size, room)
                rows.append((level, of, lo, lo + take, shift, used, pack, offset))
                leave(room - used, (pack, take, offset + used))
                if used < size:
                    cut.setdefault(size - used, []).append((level + 1, of, lo, lo + take, shift + used))
                lo += take
    return np.array(sorted(rows), np.int64).reshape(-1, len(_PLAN))


def _encoder(path: str, end: int) -> tuple[Encoder, np.dtype, bool]:
    """An encoder of stretches to ids of 2 or 4 bytes, their type, and whether the tokenizer folds case."""
    from tokenizers import Tokenizer

    got = Tokenizer.from_file(path)
    kind = np.dtype("<u2" if max(got.get_vocab_size(), end + 1) <= 1 << 16 else "<u4")
    suffix = got.model.end_of_word_suffix
    ending = np.zeros(got.get_vocab_size(), bool)
    if suffix:
        ending[[i for t, i in got.get_vocab().items() if t.endswith(suffix)]] = True

    def each(texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, kind).tobytes() for e in got.encode_batch_fast(texts, add_special_tokens=False)]

    def encode(texts: list[str]) -> list[bytes]:
        """Words of letters go in lines of many: each ends with a token that ends a word."""
        out: list = [None] * len(texts)
        words = [k for k, t in enumerate(texts) if suffix and t.strip(" ").isalpha()]
        for a in range(0, len(words), WORDS):
            here = words[a : a + WORDS]
            ids = np.array(got.encode(" ".join([texts[k] for k in here]), add_special_tokens=False).ids, kind)
            ends = np.flatnonzero(ending[ids]) + 1
            if len(ends) == len(here) and ends[-1] == len(ids):
                raw, at = ids.tobytes(), [0, *(ends * kind.itemsize).tolist()]
                for k, x, y in zip(here, at, at[1:], strict=False):
                    out[k] = raw[x:y]
        rest = [k for k, x in enumerate(out) if x is None]
        for k, x in zip(rest, each([texts[k] for k in rest]), strict=True):
            out[k] = x
        return out

    return Encoder(encode), kind, each(["Az"]) == each(["aZ"]) == each(["az"])


def token_rows(docs: DataFrame, path: str, end: int = END, length: int = LENGTH) -> DataFrame:
    """doc_id, part, of, rank, whole, ids: each document's token ids (2 or 4 bytes each), the length of its rest, the rest's
    rank among those of its length in this task, and the rank of its first whole sequence among the task's."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, kind, fold = held_by_worker(("tokens", path, end), lambda: _encoder(path, end))
        part = TaskContext.get().partitionId()
        seen, whole = np.zeros(length, np.int64), 0
        for b in batches:
            col = text_column(b, "text")
            for a, z in chunks(col, CUT_BYTES):
                distinct, codes, bounds = stretches(col[a:z], fold)
                ids, ends = gathered(encoder.of(distinct.to_pylist()), kind, codes, bounds)
                ids = np.insert(ids, ends[1:], np.array(end, kind))
                ends = ends + np.arange(len(ends))
                size = np.diff(ends)
                of = size % length
                order = np.argsort(of, kind="stable")
                first = np.searchsorted(of[order], of[order])
                rank = np.empty(len(of), np.int64)
                rank[order] = seen[of[order]] + np.arange(len(of)) - first
                seen += np.bincount(of, minlength=length)
                fulls = size // length
                at = whole + np.cumsum(fulls) - fulls
                whole += int(fulls.sum())
                held = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(size), [None, pa.py_buffer(ends * kind.itemsize), pa.py_buffer(ids)])
                cols = [b.column("doc_id")[a:z], pa.array(np.full(len(size), part, np.int64)), pa.array(of), pa.array(rank), pa.array(at), pa.array(size), pa.array(np.full(len(size), kind.itemsize, np.int32)), held.cast(pa.binary())]
                yield pa.RecordBatch.from_arrays(cols, names=["doc_id", "part", "of", "rank", "whole", "tokens", "width", "ids"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, part long, of long, rank long, whole long, tokens long, width int, ids binary")


def pack_documents(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", tokenizer: str | None = None, end: int = END, length: int = LENGTH) -> DataFrame:
    """Pieces of all documents in sequences: doc_id, start, length, ids (little-endian unsigned 32-bit), doc_tokens, sequence_id, offset.

    `tokenizer` is the path of a tokenizers file on every executor; its special strings in texts are special ids. Each document
    ends with `end`, also null and empty ones, so every row gives a piece. A piece is tokens start to start + length of its
    document and lies at `offset` of its sequence. Sequences are numbered without gaps and hold `length` tokens (a power of
    two), but for at most log2(length) last ones, of smaller powers of two: there is no padding. A document is cut into whole
    sequences and a rest; rests are cut further only when no sequence is left to be opened. Which of the documents of one
    length comes first depends on how Spark has split the input. Repeated rows and null ids are documents of their own; other
    columns don't matter; an empty table gives no rows. A document's tokens are held by one task, however long it is; stretches
    without a space are encoded whole.
    """
    if length & (length - 1):
        raise ValueError("length must be a power of two")
    spark = docs.sparkSession
    small_batches(spark)
    lean = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    with Scratch(spark) as scratch:
        rows = scratch.keep(written(token_rows(lean, tokenizer or tokenizer_file(TOKENIZER), end, length), "packing-tokens"))
        counts = rows.groupBy("part", "of").agg(F.count(F.lit(1)).alias("n"))
        counts = counts.unionByName(rows.groupBy("part").agg(F.lit(length).cast("long").alias("of"), F.sum(F.floor(F.col("tokens") / length)).alias("n")))
        counts = scratch.keep(written(counts, "packing-counts"))
        histogram = np.zeros(length + 1, np.int64)
        for of, n in counts.groupBy("of").agg(F.sum("n").alias("n")).collect():  # one row per length
            histogram[of] = n
        histogram[0] = 0
        wholes = int(histogram[length])
        plan = pack_counts(histogram[:length], length)
        before = Window.partitionBy("of").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
        bases = counts.select("part", "of", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
        firsts = bases.filter(F.col("of") == length).select("part", F.col("base").alias("whole_base"))
        places = bases.filter(F.col("of") < length).join(firsts, "part")
        placed = rows.join(places, ["part", "of"]).select("doc_id", "of", (F.col("rank") + F.col("base")).alias("rank"), (F.col("whole") + F.col("whole_base")).alias("whole"), "tokens", "width", "ids")
        kind = docs.schema[doc_id].dataType.simpleString()
        return placed.mapInArrow(_pieces(plan, wholes, length), f"doc_id {kind}, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long")


def _pieces(plan: np.ndarray, wholes: int, length: int):
    """The pieces of rows doc_id, of, rank, whole, tokens, width, ids."""
    shared = plan

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        level, of, lo, hi, shift, size, pack, offset = shared.T
        keys = np.rec.fromarrays([level, of, lo], names="level,of,lo")
        levels = int(level.max()) + 1 if len(level) else 0
        for b in batches:
            n = b.num_rows
            rest, rank, whole, tokens = (b.column(k).to_numpy() for k in ("of", "rank", "whole", "tokens"))
            row, start, long, sequence, at = [], [], [], [], []
            fulls = tokens // length
            k = np.arange(fulls.sum()) - np.repeat(np.cumsum(fulls) - fulls, fulls)
            r = np.repeat(np.arange(n), fulls)
            row, start, long, sequence, at = [r], [k * length], [np.full(len(r), length)], [whole[r] + k], [np.zeros(len(r), np.int64)]
            left = np.flatnonzero(rest > 0)
            for stage in range(levels):
                asked = np.rec.fromarrays([np.full(len(left), stage), rest[left], rank[left]], names="level,of,lo")
                p = np.searchsorted(keys, asked, "right") - 1
                fit = (p >= 0) & (level[p] == stage) & (of[p] == rest[left]) & (rank[left] < hi[p])
                left, p = left[fit], p[fit]
                if not len(left):
                    break
                row.append(left)
                start.append(fulls[left] * length + shift[p])
                long.append(size[p])
                sequence.append(wholes + pack[p] + rank[left] - lo[p])
                at.append(offset[p])
            row, start, long, sequence, at = (np.concatenate(x).astype(np.int64) for x in (row, start, long, sequence, at))
            ids, width = b.column("ids"), b.column("width").to_pylist()
            held = [np.frombuffer(ids[i].as_buffer(), f"<u{width[i]}") for i in range(n)]
            cut = [held[i][x : x + m].astype("<u4").tobytes() for i, x, m in zip(row.tolist(), start.tolist(), long.tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column("doc_id").take(pa.array(row)), pa.array(start), pa.array(long), pa.array(cut, pa.binary()), pa.array(tokens[row]), pa.array(sequence), pa.array(at)], names=["doc_id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset"])

    return run


def op11_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where each token of all documents lies, in sequences of 4096."""
    got = pack_documents(table(spark, sf_dir, "documents"))
    return got.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")
