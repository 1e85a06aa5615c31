"""Substring deduplication with FM-indexes, one per shard.

A window is WIDTH consecutive words of one document. Each window has an anchor, the run of ANCHOR words in it with the
least hash, so equal windows have equal anchors; consecutive windows of one anchor make a segment. Only anchors that occur
twice or more can belong to repeated windows (one shuffle of anchors finds them). Segments of such anchors are dealt to
shards by anchor. A shard holds its segments in a compressed FM-index (a wavelet matrix over their words, in which equal
segments are one with its number of copies) and streams each of them through backward search, which gives matching statistics:
how long a match with any other place, copies included, ends at a word. Intervals of 35 words and more are reported. All
occurrences of a window meet in one shard, so no shard is searched for another's documents.

An anchor whose segments are more than ANCHOR_BYTES together (a short passage in ever different contexts) isn't given to a
shard: its windows are dealt one by one by the hash of all their words, so equal windows still meet and no task or index
holds the anchor.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import Scratch, shuffle_partitions, small_batches, table, text_column, written
from ._fm_index import FMIndex, repeated_windows
from ._shingles import mixed, rolled, word_hashes

WIDTH, ANCHOR = 35, 12
#: Bytes of distinct segments that a shard's index holds, about.
SHARD_BYTES = 3 << 20
#: Bytes of the segments (copies included) that an anchor brings to a shard at most.
ANCHOR_BYTES = SHARD_BYTES >> 2
_PLACE = np.uint64((1 << 24) - 1)


def anchored(words: np.ndarray, width: int = WIDTH) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Segments of one document: hash of the anchor, first window, last window. Ties go to the leftmost run of words."""
    n = len(words) - width + 1
    if n <= 0:
        none = np.zeros(0, np.int64)
        return none, none, none
    grams = rolled(words, ANCHOR)
    least = (grams & ~_PLACE) | (np.arange(len(grams), dtype=np.uint64) & _PLACE)
    span, size = width - ANCHOR + 1, 1
    while 2 * size <= span:
        least = np.minimum(least[:-size], least[size:])
        size *= 2
    if size < span:
        least = np.minimum(least[: n], least[span - size : span - size + n])
    window = np.arange(n)
    at = window + (((least & _PLACE).astype(np.int64) - window) & int(_PLACE))
    first = np.flatnonzero(np.concatenate(([True], at[1:] != at[:-1])))
    return grams[at[first]].view(np.int64), first, np.append(first[1:], n) - 1


def _documents(col: pa.Array) -> Iterator[np.ndarray]:
    for _, words, bounds, _, _ in word_hashes(col, fold=False):
        for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
            yield words[a:b]


def _dealt(keys: np.ndarray, owner: np.ndarray, first: np.ndarray, weight: np.ndarray) -> pa.RecordBatch:
    """Rows of one batch for `_again`. Keys that the batch already shows twice (by weight) are settled here and dealt at
    random; only one row per key and batch is dealt by key, so a very frequent one doesn't gather in one task."""
    _, at, back = np.unique(keys, return_index=True, return_inverse=True)
    known = np.bincount(back, weight)[back] > 1
    spread = mixed(owner.view(np.uint64) + mixed(first.astype(np.uint64))).view(np.int64)
    deal = np.where(known, spread, keys)
    deal[at] = keys[at]
    return pa.RecordBatch.from_arrays([pa.array(deal), pa.array(known), pa.array(owner), pa.array(first)], names=["deal", "known", "row_key", "first"])


_DEALT = "deal long, known boolean, row_key long, first int"


def _again(rows: DataFrame) -> DataFrame:
    """row_key and first of the rows of `_dealt` whose key occurs at least twice."""

    def again(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: tuple | None = None  # the last row and whether it is kept by what came before
        for b in batches:
            if not b.num_rows:
                continue
            h, known, key, first = (b.column(c).to_numpy(zero_copy_only=False) for c in ("deal", "known", "row_key", "first"))
            seen = False
            if held is not None:
                h, known, key, first, seen = np.append(held[0], h), np.append(held[1], known), np.append(held[2], key), np.append(held[3], first), held[4]
            same = h[1:] == h[:-1]
            before = np.concatenate(([seen], same)) | known
            keep = before[:-1] | same
            held = h[-1:], known[-1:], key[-1:], first[-1:], before[-1]
            if keep.any():
                yield pa.RecordBatch.from_arrays([pa.array(key[:-1][keep]), pa.array(first[:-1][keep].astype(np.int32))], names=["row_key", "first"])
        if held is not None and held[4]:
            yield pa.RecordBatch.from_arrays([pa.array(held[2]), pa.array(held[3].astype(np.int32))], names=["row_key", "first"])

    n = shuffle_partitions(rows.sparkSession)
    return rows.repartition(n, "deal").sortWithinPartitions("deal").mapInArrow(again, "row_key long, first int")


def _repeated_anchors(docs: DataFrame, width: int) -> DataFrame:
    """row_key and first window of the segments whose anchor occurs at least twice."""

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keys = b.column("row_key").to_numpy()
            anchors, owners, firsts = [], [], []
            for key, words in zip(keys, _documents(text_column(b, "text")), strict=True):
                h, first, _ = anchored(words, width)
                if len(h):
                    anchors.append(h)
                    owners.append(np.full(len(h), key))
                    firsts.append(first.astype(np.int32))
            if anchors:
                h = np.concatenate(anchors)
                yield _dealt(h, np.concatenate(owners), np.concatenate(firsts), np.ones(len(h)))

    return _again(docs.select("row_key", "text").mapInArrow(emit, _DEALT))


def _digest(words: list[bytes]) -> str:
    return hashlib.sha256(b" ".join(words)).hexdigest()


def _parts(docs: DataFrame, flagged: DataFrame, width: int) -> DataFrame:
    """Three kinds of rows: 0, documents without flagged segments, finished; 1, the texts of others; 2, their flagged segments."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    fields = ["kind", "doc_id", "row_key", "n_words", "digest", "text", "first", "anchor"]
    firsts = flagged.groupBy("row_key").agg(F.collect_set("first").alias("firsts"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out: dict[str, list] = {f: [] for f in fields}
            col, size = text_column(b, "text"), 0

            def add(*row) -> None:
                for f, v in zip(fields, row, strict=True):
                    out[f].append(v)

            def made() -> pa.RecordBatch:
                types = dict(zip(fields, (pa.int32(), b.schema.field("doc_id").type, pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int32(), pa.int64()), strict=True))
                got = pa.RecordBatch.from_arrays([pa.array(out[f], types[f]) for f in fields], names=fields)
                for f in fields:
                    out[f] = []
                return got

            for doc, key, want, text, hashes in zip(b.column("doc_id").to_pylist(), b.column("row_key").to_pylist(), b.column("firsts").to_pylist(), col.to_pylist(), _documents(col), strict=True):
                words = text.encode("utf-8", "surrogatepass").split()  # at 0x20 and 0x09 to 0x0D
                if not want:
                    add(0, doc, key, len(words), _digest(words), None, None, None)
                    continue
                add(1, doc, key, len(words), None, text, None, None)
                wanted = set(want)
                for h, a, z in zip(*(x.tolist() for x in anchored(hashes, width)), strict=True):
                    if a in wanted:
                        piece = b" ".join(words[a : z + width]).decode("utf-8", "surrogatepass")
                        add(2, doc, key, None, None, piece, a, h)
                        size += len(piece)
                        if size > 8 << 20:
                            yield made()
                            size = 0
            yield made()

    joined = docs.join(firsts, "row_key", "left")
    return joined.mapInArrow(run, f"kind int, doc_id {kind}, row_key long, n_words long, digest string, text string, first int, anchor long")


def _searched(segments: DataFrame, shards: int, width: int) -> DataFrame:
    """segment_id and the word ranges that repeated windows cover, for distinct segments (anchor, text, times, often).

    Segments of frequent anchors (often) are dealt at random and not held: their windows go on by the hash of all their words.
    """

    def shard_ranges(ids: list[int], col: pa.Array, times: np.ndarray) -> tuple[list[int], list[list[dict]]]:
        words, lengths = [], []
        for w in _documents(col):
            words.append(w)
            lengths.append(len(w))
        lengths = np.array(lengths)
        starts = np.concatenate(([0], np.cumsum(lengths + 1)[:-1]))
        text = np.zeros(int((lengths + 1).sum()), np.int64)  # 0 ends a segment
        place = np.ones(len(text), bool)
        place[starts + lengths] = False
        text[place] = np.unique(np.concatenate(words), return_inverse=True)[1] + 1
        copies = np.zeros(len(text), np.int64)
        copies[place] = np.repeat(times, lengths)
        doc, first, last = repeated_windows(FMIndex(text, int(lengths.max()), copies), text, starts, lengths, width)
        found: dict[int, list[dict]] = {}
        for k, a, z in zip(doc.tolist(), first.tolist(), last.tolist(), strict=True):
            found.setdefault(k, []).append({"a": a, "z": z + width})
        return [ids[k] for k in found], list(found.values())

    schema = pa.schema([("segment_id", pa.int64()), ("ranges", pa.list_(pa.struct([("a", pa.int32()), ("z", pa.int32())]))), ("deal", pa.int64()), ("known", pa.bool_()), ("first", pa.int32())])

    def windows(b: pa.RecordBatch) -> pa.RecordBatch:
        hashes = [rolled(words, width) for words in _documents(text_column(b, "text"))]
        n = [len(h) for h in hashes]
        owner, times = np.repeat(b.column("segment_id").to_numpy(), n), np.repeat(b.column("times").to_numpy(), n)
        deal, known, owner, first = _dealt(np.concatenate(hashes).view(np.int64), owner, np.concatenate([np.arange(k, dtype=np.int32) for k in n]), times).columns
        return pa.RecordBatch.from_arrays([owner, pa.nulls(len(owner), schema.field("ranges").type), deal, known, first], schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import pyarrow.compute  # noqa: F401  used below, on the executors as here

        now, held = None, []

        def close() -> pa.RecordBatch:
            t = pa.Table.from_batches(held).combine_chunks()
            ids, ranges = shard_ranges(t["segment_id"].to_pylist(), t["text"].combine_chunks(), t["times"].to_numpy())
            return pa.RecordBatch.from_pydict({"segment_id": ids, "ranges": ranges, **{k: pa.nulls(len(ids), schema.field(k).type) for k in ("deal", "known", "first")}}, schema=schema)

        for b in batches:
            often = b.column("often")
            if often.true_count:
                yield windows(b.filter(often))
                b = b.filter(pa.compute.invert(often))
            shard = b.column("shard").to_numpy()
            edges = np.flatnonzero(np.concatenate(([True], shard[1:] != shard[:-1]))) if len(shard) else []
            for a, z in zip(edges, [*edges[1:], len(shard)], strict=True):
                if shard[a] != now and held:
                    yield close()
                    held = []
                now = shard[a]
                held.append(b.slice(a, z - a))
        if held:
            yield close()

    key = F.when(F.col("often"), F.xxhash64("anchor", "text")).otherwise(F.xxhash64("anchor"))
    dealt = segments.select(F.pmod(key, F.lit(shards)).cast("int").alias("shard"), F.xxhash64("anchor", "text").alias("segment_id"), "text", "times", "often")
    n = shuffle_partitions(segments.sparkSession)
    rows = dealt.repartition(n, "shard").sortWithinPartitions("shard").mapInArrow(run, "segment_id long, ranges array<struct<a:int,z:int>>, deal long, known boolean, first int")
    rows = written(rows, "repeat-found")
    hits = _again(rows.filter("deal is not null").select("deal", "known", F.col("segment_id").alias("row_key"), "first"))
    covered = F.transform("firsts", lambda k: F.struct(k.alias("a"), (k + width).alias("z")))
    spread = hits.groupBy(F.col("row_key").alias("segment_id")).agg(F.collect_set("first").alias("firsts")).select("segment_id", covered.alias("ranges"))
    return rows.filter("deal is null").select("segment_id", "ranges").unionByName(spread)


def _kept(texts: DataFrame) -> DataFrame:
    """Finish documents with ranges of words to drop (firsts and ends in step)."""
    kind = texts.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n, gone, digests, texts = [], [], [], []
            for text, ranges in zip(text_column(b, "text").to_pylist(), b.column("ranges").to_pylist(), strict=True):
                words = text.encode("utf-8", "surrogatepass").split()
                drop = np.zeros(len(words) + 1, np.int64)
                for r in ranges or ():
                    drop[r["a"]] += 1
                    drop[r["z"]] -= 1
                drop = np.cumsum(drop)[:-1] > 0
                kept = [w for w, d in zip(words, drop.tolist(), strict=True) if not d]
                n.append(len(words))
                gone.append(int(drop.sum()))
                texts.append(b" ".join(kept).decode("utf-8", "surrogatepass"))
                digests.append(_digest(kept))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(n, pa.int64()), pa.array(gone, pa.int64()), pa.array(digests, pa.string()), pa.array(texts, pa.string())], names=["doc_id", "n_words", "n_removed", "kept_sha256", "kept_text"])

    return texts.mapInArrow(run, f"doc_id {kind}, n_words long, n_removed long, kept_sha256 string, kept_text string")


def remove_repeats(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", width: int = WIDTH) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 and kept_text (null where nothing was removed) of each row.

    Words are runs of characters other than space and 0x09-0x0D. Each word in a window whose words also start anywhere else,
    same document included, is removed. Null and empty texts have no words; texts of fewer than `width` words stay whole.
    Repeated rows are repeats of one another like other copies. A window that overlaps another is judged by itself, so no ties
    arise. Texts of any length are read whole. Other columns don't matter, whatever their names; an empty table gives no rows.
    Words, anchors, segments and rows (by doc_id and text) are
    told apart by 64-bit hashes.
    """
    spark = docs.sparkSession
    small_batches(spark)
    lean = docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text")).withColumn("row_key", F.xxhash64("doc_id", "text"))
    with Scratch(spark) as scratch:
        flagged = written(_repeated_anchors(lean, width), "repeat-anchors")
        parts = written(_parts(lean, flagged, width), "repeat-parts")
        pieces = parts.filter("kind = 2")
        size = pieces.agg(F.sum(F.octet_length("text"))).first()[0] or 0
        # of the anchors above the bound there are at most size / ANCHOR_BYTES, so their hashes can be broadcast
        frequent = written(pieces.groupBy("anchor").agg(F.sum(F.octet_length("text")).alias("bytes")).filter(F.col("bytes") > ANCHOR_BYTES).select("anchor"), "repeat-frequent")
        distinct = pieces.groupBy("anchor", "text").agg(F.count(F.lit(1)).alias("times"))
        marked = distinct.join(F.broadcast(frequent.withColumn("often", F.lit(True))), "anchor", "left").withColumn("often", F.coalesce("often", F.lit(False)))
        found = _searched(marked, max(1, -(-size // SHARD_BYTES)), width)
        where = pieces.select("row_key", "first", F.xxhash64("anchor", "text").alias("segment_id")).join(found, "segment_id")
        moved = F.transform("ranges", lambda r: F.struct((r["a"] + F.col("first")).alias("a"), (r["z"] + F.col("first")).alias("z")))
        drops = written(where.select("row_key", moved.alias("ranges")).groupBy("row_key").agg(F.flatten(F.collect_set("ranges")).alias("ranges")), "repeat-drops")
        changed = parts.filter("kind = 1").select("doc_id", "row_key", "text").join(drops, "row_key", "left")
        whole = parts.filter("kind = 0").select("doc_id", "n_words", F.lit(0).cast("long").alias("n_removed"), F.col("digest").alias("kept_sha256"), F.lit(None).cast("string").alias("kept_text"))
        for df in (parts, drops):
            scratch.keep(df)
        return whole.unionByName(_kept(changed))


def op5_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document without its words that lie in windows of 35 words found elsewhere."""
    return remove_repeats(table(spark, sf_dir, "documents")).drop("kept_text")
