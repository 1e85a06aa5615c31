"""Document fingerprints: MinHash over five-word shingles, signature bands joined in Spark, verified near-duplicates.

A signature holds, for each of PERMUTATIONS universal hash permutations x -> a*x + b (mod 2**32, a odd), the lowest
value over the text's shingles; the fingerprint keeps the low 16 bits of each (b-bit MinHash) as hex. The likeness
of two fingerprints is the share of equal places, freed of the chance agreement of 16 bits.

Distinct shingle sets that share a band of the signature meet in a bucket: each member with the least one first, then all that
are still in different components, closest pairs before others. Whatever passes a screen is verified on the sets by exact
Jaccard similarity, so that classes hold true links only, and all of those whose sets met.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import Scratch, shuffle_partitions, small_batches, table, text_column, written
from ._shingles import SHINGLE, _PLACES, mixed, rolled, shingle_sets, word_hashes
from .op3_jaccard import THRESHOLD, distinct_nodes, keyed, least_of_component, met_in_blocks, set_id, settled, sketch

PERMUTATIONS = 128
#: Bands of a signature: two texts of Jaccard 0.8 share one with probability 1 - (1 - 0.8**8)**16 > 0.94,
#: of 0.9 with more than 0.9998.
BANDS = 16
_RNG = np.random.default_rng(20240601)
_A = _RNG.integers(0, 1 << 31, PERMUTATIONS, dtype=np.uint32) * np.uint32(2) + np.uint32(1)
_B = _RNG.integers(0, 1 << 32, PERMUTATIONS, dtype=np.uint32)
_TILE = 1 << 14


def signatures(col: pa.Array) -> np.ndarray:
    """A row of PERMUTATIONS 16-bit minima for each text; texts without words have 0xFFFF throughout."""
    out = np.full((len(col), PERMUTATIONS), 0xFFFF, np.uint16)
    for first, words, bounds, _, _ in word_hashes(col):
        runs = rolled(words, SHINGLE)
        whole: list[tuple[int, int, int]] = []  # row, first and end shingle
        short: list[tuple[int, np.uint64]] = []
        for k, (a, b) in enumerate(zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)):
            if b - a >= SHINGLE:
                whole.append((first + k, a, b - SHINGLE + 1))
            elif b > a:
                short.append((first + k, mixed((words[a:b] * _PLACES[: b - a]).sum(dtype=np.uint64, keepdims=True) + np.uint64(b - a))[0]))
        xs = (runs >> np.uint64(32)).astype(np.uint32)
        at = 0
        while at < len(whole):  # texts together up to a tile that stays in the cache
            to = at + 1
            while to < len(whole) and whole[to][2] - whole[at][1] <= _TILE:
                to += 1
            lo, hi = whole[at][1], whole[to - 1][2]
            edges = np.array([v for _, a, b in whole[at:to] for v in (a - lo, b - lo)][:-1])
            rows = np.array([r for r, _, _ in whole[at:to]])
            piece = xs[lo:hi]
            for p in range(PERMUTATIONS):
                out[rows, p] = np.minimum.reduceat(piece * _A[p] + _B[p], edges)[::2].astype(np.uint16)
            at = to
        for row, x in short:
            out[row] = (np.uint32(x >> np.uint64(32)) * _A + _B).astype(np.uint16)
    return out


def likeness(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Estimated Jaccard similarity (0 to 1) of signatures, row by row."""
    share = (a == b).mean(axis=-1)
    return np.clip((share - 2.0**-16) / (1 - 2.0**-16), 0.0, 1.0)


def _hex(sigs: np.ndarray) -> list[str]:
    return [row.astype(">u2").tobytes().hex() for row in sigs]


def fingerprint_documents(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id and fingerprint of each row. Null and empty texts, and texts of white space only, all have the fingerprint of no
    shingles. Equal texts, repeated rows too, have equal fingerprints; texts of any length are read whole. Other columns don't
    matter, whatever their names; an empty table gives no rows."""
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(_hex(signatures(text_column(b, "text"))), pa.string())], names=["doc_id", "fingerprint"])

    lean = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    return lean.mapInArrow(run, f"doc_id {lean.schema['doc_id'].dataType.simpleString()}, fingerprint string")


def band_keys(sigs: np.ndarray) -> np.ndarray:
    """A row for each signature, a 64-bit key for each of BANDS bands."""
    parts = np.ascontiguousarray(sigs).view(np.uint64).reshape(len(sigs), BANDS, -1)
    out = np.broadcast_to(mixed(np.arange(1, BANDS + 1, dtype=np.uint64)), (len(sigs), BANDS)).copy()
    for k in range(parts.shape[2]):
        out = mixed(out + parts[:, :, k])
    return out


def _banded(lean: DataFrame) -> DataFrame:
    """doc_id, row_key, n_shingles, node (null without words), sketch and bands of each row; a task gives the sketch and the
    bands of a set once, however many copies it holds."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for b in batches:
            col = text_column(b, "text")
            keys = band_keys(signatures(col)).view(np.int64)
            n, ids, sk, bands = [], [], [], []
            for k, s in enumerate(shingle_sets(col)):
                i = set_id(s) if len(s) else None
                new = i is not None and i not in seen
                seen.add(i)
                n.append(len(s))
                ids.append(i)
                sk.append(sketch(s) if len(s) else None)
                bands.append(keys[k] if new else None)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("row_key"), pa.array(n, pa.int64()), pa.array(ids, pa.int64()), pa.array(sk, pa.binary()), pa.array(bands, pa.list_(pa.int64()))], names=["doc_id", "row_key", "n_shingles", "node", "sketch", "bands"])

    kind = lean.schema["doc_id"].dataType.simpleString()
    return lean.mapInArrow(run, f"doc_id {kind}, row_key long, n_shingles long, node long, sketch binary, bands array<long>")


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", threshold: int = THRESHOLD) -> DataFrame:
    """doc_id, row_key and near_class of each row: the smallest doc_id of the near-duplicates that verified links (Jaccard
    similarity of five-word shingle sets, in hundredths) lead to from it, itself included.

    Links are those between sets that share a band: of all links of similarity 0.8 more than 94 in a hundred, of 0.9 nearly
    all. Texts of equal sets are one class. Texts without words are their own class; a class of rows without an id has none.
    Repeated rows are copies of one another. Texts of any length are read whole. Other columns don't matter, whatever their names;
    an empty table gives no rows.
    """
    small_batches(docs.sparkSession)
    return _classes(keyed(docs, doc_id, text), threshold)


def _classes(lean: DataFrame, threshold: int) -> DataFrame:
    with Scratch(lean.sparkSession) as scratch:
        rows = written(_banded(lean), "minhash-rows")
        nodes = written(distinct_nodes(rows), "minhash-nodes")
        met = written(met_in_blocks(rows.filter("bands is not null").select(F.explode("bands").alias("block"), "node")), "minhash-met")
        of_node = least_of_component(nodes, settled(lean, nodes, met, threshold))
        own = F.when(F.col("node").isNull() | F.col("of_node").isNull(), F.col("doc_id")).otherwise(F.col("of_node"))
        out = rows.select("doc_id", "row_key", "node").join(of_node, "node", "left").select("doc_id", "row_key", own.alias("near_class"))
        return scratch.keep(written(out, "minhash-classes"))


def _by_successor(docs: DataFrame, classes: DataFrame | None = None) -> DataFrame:
    """Rows dealt to runs of consecutive doc_id, sorted; each run ends with a copy of the next run's first row.

    Runs are bounded by real ids, found over the id column alone by a range partitioning: the driver gets one id per
    partition. Adds run, follower (true for the copy) and near_class (null). The last run is followed by the first row of all.
    `classes` (doc_id, row_key, near_class) go to the same runs, before the row of their row_key, without a text.
    """
    spark = docs.sparkSession
    n = shuffle_partitions(spark)

    def lowest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        least = None
        for b in batches:
            here = pa.compute.min(b.column(0)).as_py()
            least = here if least is None or here < least else least
        if least is not None:
            yield pa.RecordBatch.from_pydict({"doc_id": pa.array([least], pa.int64())})

    import pyarrow.compute  # noqa: F401  used above, on the executors as here

    ids = docs.select("doc_id").repartitionByRange(n, "doc_id").mapInArrow(lowest, "doc_id long")
    firsts = sorted(r[0] for r in ids.collect()) or [0]
    bounds = F.split(F.lit(",".join(map(str, firsts))), ",").cast("array<bigint>")  # folded into one constant
    at = docs.withColumn("run", F.size(F.filter(bounds, lambda first: first <= F.col("doc_id"))) - 1)
    before = F.pmod(F.col("run") - 1, F.lit(len(firsts)))
    heads = F.element_at(bounds, F.col("run") + 1) == F.col("doc_id")
    copies = F.when(heads, F.array(F.struct(F.col("run").alias("run"), F.lit(False).alias("follower")), F.struct(before.cast("int").alias("run"), F.lit(True).alias("follower"))))
    own = F.array(F.struct(F.col("run").alias("run"), F.lit(False).alias("follower")))
    dealt = at.select("doc_id", "row_key", "text", F.lit(None).cast("long").alias("near_class"), F.inline(F.coalesce(copies, own)))
    if classes is not None:
        run = F.size(F.filter(bounds, lambda first: first <= F.col("doc_id"))) - 1
        dealt = dealt.unionByName(classes.select("doc_id", "row_key", F.lit(None).cast("string").alias("text"), "near_class", run.alias("run"), F.lit(False).alias("follower")))
    return dealt.repartitionById(len(firsts), "run").sortWithinPartitions("run", "follower", "doc_id", "row_key", F.col("text").asc_nulls_first())


def compare_with_edits(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", classes: bool = True) -> DataFrame:
    """Each document's fingerprint beside those of its edited text and of the next document, and its class of near-duplicates.

    Edited: the last floor(n/4) of n code points give way to the first as many (or all) of the next document's text,
    by ascending doc_id, after the last the first; a document alone follows itself. Null texts are empty. Null ids sort first,
    as one below the smallest long; all of them follow one another, in one task. Repeated ids follow one another by a hash of
    the text, and each row gives one. near_class is that of near_duplicates (left out without `classes`). Very long texts are
    read whole. Other columns don't matter, whatever their names; an empty table gives no rows.
    """
    small_batches(docs.sparkSession)
    lean = docs.select(F.coalesce(F.col(doc_id).cast("long"), F.lit(-(1 << 63))).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text")).withColumn("row_key", F.xxhash64("doc_id", "text"))
    found = None
    if classes:
        true_ids = lean.withColumn("doc_id", F.when(F.col("doc_id") > -(1 << 63), F.col("doc_id")))
        found = _classes(true_ids, THRESHOLD).withColumn("doc_id", F.coalesce("doc_id", F.lit(-(1 << 63))))
    runs = _by_successor(lean, found)
    names = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next", "near_class"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: tuple | None = None  # the last row, until its successor is known
        key = near = None  # the last class row
        for b in batches:
            text = b.column("text").is_valid()
            of_row = []
            for is_text, k, c in zip(text.to_pylist(), b.column("row_key").to_pylist(), b.column("near_class").to_pylist(), strict=True):
                if is_text:
                    of_row.append(near if k == key else None)
                else:
                    key, near = k, c
            b = b.filter(text)
            ids, texts, follower = b.column("doc_id").to_pylist(), text_column(b, "text").to_pylist(), b.column("follower").to_pylist()
            prints = signatures(text_column(b, "text"))
            if held is not None:
                ids, texts, follower, of_row, prints = [held[0], *ids], [held[1], *texts], [held[2], *follower], [held[3], *of_row], np.concatenate([held[4][None], prints])
            if not ids:
                continue
            held = (ids[-1], texts[-1], follower[-1], of_row[-1], prints[-1])
            # several copies may follow (repeated first ids): only the first of them is a successor
            rows = [i for i in range(len(ids) - 1) if not follower[i]]
            if not rows:
                continue
            edited = []
            for i in rows:
                cut = len(texts[i]) // 4
                edited.append(texts[i][: len(texts[i]) - cut] + texts[i + 1][:cut])
            changed = signatures(pa.array(edited, pa.string()))
            own = prints[rows]
            out = [pa.array([ids[i] for i in rows], pa.int64()), pa.array([len(texts[i]) for i in rows], pa.int64()), pa.array([hashlib.sha256(t.encode()).hexdigest() for t in edited], pa.string()), pa.array(_hex(own), pa.string()), pa.array(_hex(changed), pa.string()), pa.array(likeness(own, changed), pa.float64()), pa.array(likeness(own, prints[[i + 1 for i in rows]]), pa.float64()), pa.array([of_row[i] for i in rows], pa.int64())]
            yield pa.RecordBatch.from_arrays(out, names=names)

    out = runs.mapInArrow(run, "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double, near_class long")
    return out.withColumn("doc_id", F.when(F.col("doc_id") > -(1 << 63), F.col("doc_id")))


def op1_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of all documents and of their edited texts, and their classes of near-duplicates."""
    return compare_with_edits(table(spark, sf_dir, "documents"))
