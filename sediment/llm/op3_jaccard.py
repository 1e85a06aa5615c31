"""N-gram Jaccard join by parity sketches.

A document's set of shingles falls into K blocks by hash; a block's parity sketch is the XOR of its shingles' hashes.
Sets of sizes a and b with similarity t or more differ in at most D = (1-t)/(1+t) * (a+b) shingles, each of which
changes one block, so among any D+1 non-empty blocks of one set, taken in an order that depends on the blocks' content
alone, one is unchanged and is among the first D+1 of the other set too (pigeonhole). Each set therefore shows D+1
blocks per size band; sets that show an equal block are candidates. A set with fewer than D+1 non-empty blocks also
shows those of a second hash function, and so on until one suffices: no link is lost.

Candidates meet the least set of their bucket first, are screened by whole parity sketches (whose Hamming distance is a
lower bound of the symmetric difference) and verified on the sets. Components of these links settle most buckets. In the
buckets that still hold several components all pairs across components are screened, in blocks of bounded size and without
writing pairs out. Of what passes, the closest pair of each two components is verified first, which joins nearly all that
belong together; blocks in which a pair still passes after that get the sets themselves and are verified on the spot, so that
no link is lost and no row is written for a pair that is none.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import Scratch, free_held, shuffle_partitions, small_batches, table, text_column, written
from ._components import components
from ._shingles import mixed, shingle_sets

#: Similarity in hundredths.
THRESHOLD = 80
#: Sets whose ids are broadcast when their texts are fetched (8 bytes each); beyond, Spark joins by shuffle.
BROADCAST_SETS = 400_000
#: Members compared with one leader in one task's run, and members of a bucket's block.
CHUNK, BLOCK = 64, 512


def most_differing(a: int, b: int, threshold: int = THRESHOLD) -> int:
    return (100 - threshold) * (a + b) // (100 + threshold)


def set_id(s: np.ndarray) -> int:
    """64 bits that stand for a set."""
    return int(mixed(np.array([mixed(s ^ np.uint64(0x5851F42D4C957F2D)).sum(dtype=np.uint64) + np.uint64(len(s))], np.uint64)).view(np.int64)[0])


def sketch(s: np.ndarray) -> bytes:
    """The parity of the set over 2**k bits, at least four bits per shingle (64 at least): at the threshold few of the
    differing shingles share a bit, so the screen lets little through that isn't a link."""
    bits = 1 << max(6, (4 * len(s) - 1).bit_length())
    counts = np.bincount((mixed(s) & np.uint64(bits - 1)).astype(np.int64), minlength=bits)
    return np.packbits((counts & 1).astype(np.uint8)).tobytes()


def _folded(sk: bytes, size: int) -> np.ndarray:
    """A sketch of fewer bits: a bit is the parity of those that share its place."""
    x = np.frombuffer(sk, np.uint64)
    return np.bitwise_xor.reduce(x.reshape(-1, size), axis=0)


def shown_blocks(s: np.ndarray, threshold: int = THRESHOLD) -> np.ndarray:
    """The hashes under which a set is entered in the buckets of its size band and, if it can have a larger partner there, the next."""
    n = len(s)
    band = n.bit_length() - 1
    out = []
    largest = n * 100 // threshold
    for space in (band, band + 1):
        top = (2 << space) - 1
        if space > band and largest <= (1 << space) - 1:
            break
        need = most_differing(n, min(largest, top), threshold) + 1
        blocks = (2 * top * (100 - threshold) * 9) // ((100 + threshold) * 8) + 1
        for seed in range(64):
            x = mixed(s + np.uint64((seed + 1) * 0x632BE59BD9B4E019 & (1 << 64) - 1))
            place = ((x >> np.uint64(32)) * np.uint64(blocks) >> np.uint64(32)).astype(np.int64)
            order = np.argsort(place, kind="stable")
            ranked = place[order]
            first = np.flatnonzero(np.concatenate(([True], ranked[1:] != ranked[:-1])))
            parity = np.bitwise_xor.reduceat(x[order], first)
            count = np.diff(np.append(first, n))
            at = np.argsort(-count, kind="stable")[:need]  # fuller blocks first: they tell more
            key = (np.uint64(space) << np.uint64(56)) ^ (np.uint64(seed) << np.uint64(50)) ^ ranked[first[at]].astype(np.uint64)
            out.append(mixed(parity[at] + mixed(key) + count[at].astype(np.uint64)))
            if len(first) >= need:
                break
    return np.concatenate(out)


def _sets(docs: DataFrame) -> DataFrame:
    """doc_id, row_key, n_shingles, node (null without words), sketch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        free_held()
        for b in batches:
            n, ids, sk = [], [], []
            for s in shingle_sets(text_column(b, "text")):
                n.append(len(s))
                ids.append(set_id(s) if len(s) else None)
                sk.append(sketch(s) if len(s) else None)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("row_key"), pa.array(n, pa.int64()), pa.array(ids, pa.int64()), pa.array(sk, pa.binary())], names=["doc_id", "row_key", "n_shingles", "node", "sketch"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "row_key", "text").mapInArrow(run, f"doc_id {kind}, row_key long, n_shingles long, node long, sketch binary")


def _shown(docs: DataFrame, threshold: int) -> DataFrame:
    """block, node; a task shows a set once, however many copies it holds."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for b in batches:
            shown, owner = [], []
            for s in shingle_sets(text_column(b, "text")):
                if len(s) and (i := set_id(s)) not in seen:
                    seen.add(i)
                    shown.append(shown_blocks(s, threshold))
                    owner.append(np.full(len(shown[-1]), i, np.int64))
            if shown:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(shown).view(np.int64)), pa.array(np.concatenate(owner))], names=["block", "node"])

    return docs.select("text").mapInArrow(run, "block long, node long")


def met_in_blocks(shown: DataFrame) -> DataFrame:
    """block, leader, node: members of blocks that several sets show, beside the least of them; one pass over sorted rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = leader = last = None
        for b in batches:
            if not b.num_rows:
                continue
            x, node = b.column("block").to_numpy(), b.column("node").to_numpy()
            new = np.concatenate(([block is None or x[0] != block], x[1:] != x[:-1]))
            start = np.maximum.accumulate(np.where(new, np.arange(len(x)), -1))
            lead = np.where(start >= 0, node[np.maximum(start, 0)], leader if leader is not None else 0)
            again = np.concatenate(([not new[0] and node[0] == last], (node[1:] == node[:-1]) & ~new[1:]))
            keep = (node != lead) & ~again
            block, leader, last = x[-1], lead[-1], node[-1]
            if keep.any():
                yield pa.RecordBatch.from_arrays([pa.array(x[keep]), pa.array(lead[keep]), pa.array(node[keep])], names=["block", "leader", "node"])

    n = shuffle_partitions(shown.sparkSession)
    return shown.repartition(n, "block").sortWithinPartitions("block", "node").mapInArrow(run, "block long, leader long, node long")


def _screened(pairs: DataFrame, nodes: DataFrame, threshold: int) -> DataFrame:
    """Pairs (leader, node) whose sizes and sketches allow the threshold."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            a, c = b.column("n_a").to_pylist(), b.column("n_b").to_pylist()
            keep = []
            for m, n, p, q in zip(a, c, b.column("sk_a").to_pylist(), b.column("sk_b").to_pylist(), strict=True):
                w = min(len(p), len(q)) // 8
                keep.append(100 * min(m, n) >= threshold * max(m, n) and int(np.bitwise_count(_folded(p, w) ^ _folded(q, w)).sum()) <= most_differing(m, n, threshold))
            yield pa.RecordBatch.from_arrays([b.column("leader").filter(pa.array(keep)), b.column("node").filter(pa.array(keep))], names=["leader", "node"])

    left = nodes.select(F.col("node").alias("leader"), F.col("n").alias("n_a"), F.col("sketch").alias("sk_a"))
    right = nodes.select("node", F.col("n").alias("n_b"), F.col("sketch").alias("sk_b"))
    near = F.least("n_a", "n_b") * 100 >= F.greatest("n_a", "n_b") * threshold
    return pairs.join(left, "leader").join(right, "node").filter(near).mapInArrow(run, "leader long, node long")


def _fetched(docs: DataFrame, nodes: DataFrame, wanted: DataFrame) -> DataFrame:
    """node, shingles of the wanted nodes, made again from one text of each."""
    wanted = written(wanted.join(nodes, "node").select("node", F.col("first_key").alias("row_key")), "jaccard-wanted")
    held = wanted.select("row_key").distinct()
    few = wanted.count() <= BROADCAST_SETS
    texts = docs.select("row_key", "text").join(F.broadcast(held) if few else held, "row_key", "left_semi")

    def fetch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()  # repeated rows: one of them in a task
        for b in batches:
            ids, sets = [], []
            for s in shingle_sets(text_column(b, "text")):
                if len(s) and (i := set_id(s)) not in seen:
                    seen.add(i)
                    ids.append(i)
                    sets.append(s.tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(sets, pa.binary())], names=["node", "shingles"])

    return written(texts.mapInArrow(fetch, "node long, shingles binary"), "jaccard-sets")


def _alike(a: np.ndarray, b: np.ndarray, threshold: int) -> bool:
    """Whether two sorted sets reach the threshold."""
    at = np.searchsorted(a, b)
    common = int((a[np.minimum(at, len(a) - 1)] == b).sum())
    return 100 * common >= threshold * (len(a) + len(b) - common)


def _verified(docs: DataFrame, nodes: DataFrame, pairs: DataFrame, threshold: int) -> DataFrame:
    """Those of the pairs (leader, node) whose sets reach the threshold."""
    spark = docs.sparkSession
    pairs = written(pairs, "jaccard-pairs")
    sets = _fetched(docs, nodes, pairs.select("node").unionByName(pairs.select(F.col("leader").alias("node"))).distinct())
    sizes = pairs.groupBy("leader").agg(F.count(F.lit(1)).alias("members"))
    dealt = pairs.join(sizes, "leader").withColumn("part", F.pmod(F.xxhash64("node"), F.ceil(F.col("members") / CHUNK)).cast("int"))
    members = dealt.select("leader", "part", "node").join(sets, "node").select("leader", "part", "node", "shingles", F.lit(1).alias("rank"))
    leaders = dealt.select("leader", "part").distinct().join(sets.withColumnRenamed("node", "leader"), "leader").select("leader", "part", F.col("leader").alias("node"), "shingles", F.lit(0).alias("rank"))

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.zeros(0, np.uint64)
        for b in batches:
            a, c = [], []
            for leader, node, raw, rank in zip(b.column("leader").to_pylist(), b.column("node").to_pylist(), b.column("shingles").to_pylist(), b.column("rank").to_pylist(), strict=True):
                s = np.frombuffer(raw, np.uint64)
                if rank == 0:
                    held = s
                    continue
                if _alike(held, s, threshold):
                    a.append(leader)
                    c.append(node)
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(c, pa.int64())], names=["leader", "node"])

    n = shuffle_partitions(spark)
    rows = members.unionByName(leaders).repartition(n, "leader", "part").sortWithinPartitions("leader", "part", "rank", "node")
    return rows.mapInArrow(compare, "leader long, node long")


def _open_blocks(met: DataFrame, labels: DataFrame) -> DataFrame:
    """block, i, j, own, node, label: members of buckets that still hold several components, in groups of two parts of a
    bucket, of which each pair of parts meets once; leaders have been compared with all members already."""
    held = met.select("block", "node").join(labels, "node", "left").select("block", "node", F.coalesce("label", "node").alias("label"))
    counts = held.groupBy("block").agg(F.count(F.lit(1)).alias("members"), F.min("label").alias("lo"), F.max("label").alias("hi"))
    still = counts.filter("members >= 2 and lo <> hi").select("block", F.ceil(F.col("members") / BLOCK).cast("int").alias("parts"))
    own = F.pmod(F.xxhash64("node"), F.col("parts")).cast("int")
    rows = held.join(still, "block").withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    return rows.select("block", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", "node", "label")


def _across(group: list[list], key: tuple, threshold: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """For each member of a group (own, node, label, n, sketch, …) the later ones of other components that pass the screen,
    and their sketch distances."""
    own, _, label, n = (np.array([g[k] for g in group], np.int64) for k in range(4))
    w = min(len(g[4]) for g in group) // 8
    bits = np.stack([_folded(g[4], w) for g in group])
    across = key[1] != key[2]
    for k in range(len(group) - 1):
        rest = slice(k + 1, None)
        fit = (label[rest] != label[k]) & (100 * np.minimum(n[rest], n[k]) >= threshold * np.maximum(n[rest], n[k]))
        if across:  # pairs within a part are the business of its own group
            fit &= own[rest] != own[k]
        at = np.flatnonzero(fit) + k + 1
        if not len(at):
            continue
        apart = np.bitwise_count(bits[at] ^ bits[k]).sum(axis=1, dtype=np.int64)
        near = apart <= (100 - threshold) * (n[at] + n[k]) // (100 + threshold)
        if near.any():
            yield k, at[near], apart[near]


def _groups(batches: Iterator[pa.RecordBatch], fields: list[str]) -> Iterator[tuple[tuple, list[list]]]:
    """Rows of one (block, i, j), which follow one another."""
    key, group = None, []
    for b in batches:
        for x, i, j, *row in zip(*(b.column(k).to_pylist() for k in ("block", "i", "j", *fields)), strict=True):
            if (x, i, j) != key:
                if len(group) > 1:
                    yield key, group
                key, group = (x, i, j), []
            group.append(row)
    if len(group) > 1:
        yield key, group


def _closest_pairs(blocks: DataFrame, nodes: DataFrame, threshold: int) -> DataFrame:
    """leader, node: the pairs of the least sketch distance for each two components that pass the screen."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[tuple[int, int], tuple[int, int, int]] = {}  # two labels: distance and pair

        def flush() -> pa.RecordBatch:
            rows = [(*of, *best) for of, best in found.items()]
            found.clear()
            return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], pa.int64()) for k in range(5)], names=["lo", "hi", "apart", "leader", "node"])

        for key, group in _groups(batches, ["own", "node", "label", "n", "sketch"]):
            for k, at, apart in _across(group, key, threshold):
                for m, d in zip(at.tolist(), apart.tolist(), strict=True):
                    of = (min(group[k][2], group[m][2]), max(group[k][2], group[m][2]))
                    best = (d, min(group[k][1], group[m][1]), max(group[k][1], group[m][1]))
                    if of not in found or best < found[of]:
                        found[of] = best
            if len(found) > 100_000:
                yield flush()
        yield flush()

    got = _grouped(blocks, nodes).mapInArrow(run, "lo long, hi long, apart long, leader long, node long")
    best = F.min(F.struct("apart", "leader", "node")).alias("best")
    return got.groupBy("lo", "hi").agg(best).select("best.leader", "best.node")


def _grouped(blocks: DataFrame, nodes: DataFrame) -> DataFrame:
    n = shuffle_partitions(nodes.sparkSession)
    return blocks.join(nodes.select("node", "n", "sketch"), "node").repartition(n, "block", "i", "j").sortWithinPartitions("block", "i", "j")


def _open_members(blocks: DataFrame, nodes: DataFrame, threshold: int) -> DataFrame:
    """The rows of `blocks` (with n and sketch) of members that pass the screen with one of another component."""
    fields = ["own", "node", "label", "n", "sketch"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for key, group in _groups(batches, fields):
            there: set[int] = set()
            for k, at, _ in _across(group, key, threshold):
                there.add(k)
                there.update(at.tolist())
            rows = [group[k] for k in sorted(there)]
            types = (pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary())
            heads = [pa.array([x] * len(rows), t) for x, t in zip(key, (pa.int64(), pa.int32(), pa.int32()), strict=True)]
            yield pa.RecordBatch.from_arrays([*heads, *(pa.array([r[k] for r in rows], t) for k, t in enumerate(types))], names=["block", "i", "j", *fields])

    return _grouped(blocks, nodes).mapInArrow(run, "block long, i int, j int, own int, node long, label long, n long, sketch binary")


def _verified_here(lean: DataFrame, nodes: DataFrame, members: DataFrame, threshold: int) -> DataFrame:
    """Links (leader, node) between components, at most one for each two of them and group: the groups' members come with
    their sets, and pairs are verified where they meet."""
    sets = _fetched(lean, nodes, members.select("node").distinct())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for key, group in _groups(batches, ["own", "node", "label", "n", "sketch", "shingles"]):
            raw = [np.frombuffer(g[5], np.uint64) for g in group]
            linked: set[tuple[int, int]] = set()
            out: list[tuple[int, int]] = []
            for k, at, apart in _across(group, key, threshold):
                for m in at[np.argsort(apart, kind="stable")].tolist():
                    of = (min(group[k][2], group[m][2]), max(group[k][2], group[m][2]))
                    if of not in linked and _alike(raw[k], raw[m], threshold):
                        linked.add(of)
                        out.append((group[k][1], group[m][1]))
            yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in out], pa.int64()) for k in (0, 1)], names=["leader", "node"])

    n = shuffle_partitions(lean.sparkSession)
    rows = members.join(sets, "node").repartition(n, "block", "i", "j").sortWithinPartitions("block", "i", "j")
    return rows.mapInArrow(run, "leader long, node long")


def settled(lean: DataFrame, nodes: DataFrame, met: DataFrame, threshold: int) -> DataFrame:
    """node, label (the least node of its component) of all linked nodes, from those that met in a bucket."""
    pairs = written(_screened(met.select("leader", "node").distinct(), nodes, threshold), "jaccard-screened")
    links = written(_verified(lean, nodes, pairs, threshold), "jaccard-links")
    labels = components(links, "leader", "node")
    blocks = written(_open_blocks(met, labels), "jaccard-blocks")
    closest = written(_closest_pairs(blocks, nodes, threshold), "jaccard-open")
    if closest.isEmpty():  # no pair of two components passes the screen
        return labels
    more = written(closest.join(pairs, ["leader", "node"], "left_anti"), "jaccard-open")
    if not more.isEmpty():
        links = written(links.unionByName(_verified(lean, nodes, more, threshold)), "jaccard-links")
        labels = components(links, "leader", "node")
        blocks = written(_open_blocks(met, labels), "jaccard-blocks")
    members = written(_open_members(blocks, nodes, threshold), "jaccard-open")
    if members.isEmpty():
        return labels
    rest = _verified_here(lean, nodes, members, threshold)
    return components(written(links.unionByName(rest), "jaccard-links"), "leader", "node")


def least_of_component(nodes: DataFrame, labels: DataFrame) -> DataFrame:
    """node, of_node: the smallest doc_id of each node's component (null where no row of it has an id)."""
    least = labels.join(nodes, "node").groupBy("label").agg(F.min("first_doc").alias("least"))
    return nodes.select("node", "first_doc").join(labels.join(least, "label").select("node", "least"), "node", "left").select("node", F.coalesce("least", "first_doc").alias("of_node"))


def jaccard_components(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", threshold: int = THRESHOLD) -> DataFrame:
    """doc_id, n_shingles, component_id (smallest doc_id reachable by links) and row_key of each row.

    Words are runs of characters other than space and 0x09-0x0D, A-Z lowered; a text of one to four words is one shingle.
    Null texts and texts without words have no shingles and are their own component. Equal sets link, also those of
    repeated rows. Texts of any length are read whole. Other columns don't matter, whatever their names; an empty table gives no
    rows. A null doc_id takes no part in minima; a component of such rows only has a null id. Sets are told apart
    by 64-bit hashes.
    """
    small_batches(docs.sparkSession)
    with Scratch(docs.sparkSession) as scratch:
        lean = keyed(docs, doc_id, text)
        rows = written(_sets(lean), "jaccard-rows")
        nodes = written(distinct_nodes(rows), "jaccard-nodes")
        met = written(met_in_blocks(_shown(lean, threshold)), "jaccard-met")
        of_node = least_of_component(nodes, settled(lean, nodes, met, threshold))
        own = F.when(F.col("node").isNull() | F.col("of_node").isNull(), F.col("doc_id")).otherwise(F.col("of_node"))
        out = rows.select("doc_id", "row_key", "n_shingles", "node").join(of_node, "node", "left").select("doc_id", "n_shingles", own.alias("component_id"), "row_key")
        return scratch.keep(written(out, "jaccard-components"))


def keyed(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """doc_id, text and row_key, which tells rows apart by id and text (repeated rows share it)."""
    lean = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    return lean.withColumn("row_key", F.xxhash64("doc_id", "text"))


def distinct_nodes(rows: DataFrame) -> DataFrame:
    """node, first_doc (its smallest doc_id), first_key (a row to read its text from), n, sketch."""
    return rows.filter("node is not null").groupBy("node").agg(F.min("doc_id").alias("first_doc"), F.min("row_key").alias("first_key"), F.first("n_shingles").alias("n"), F.first("sketch").alias("sketch"))


def keep_one_each(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", threshold: int = THRESHOLD) -> DataFrame:
    """The rows of `docs`, every column kept, that are the first of their component: those of its smallest doc_id.

    A row is known by its doc_id and text: where one doc_id is on several texts of one component all these stay, and so do
    repeated rows of a row that stays. Of a component in which no row has an id, all rows stay; other rows of a null id go if
    their component has an id.
    """
    got = jaccard_components(docs, doc_id, text, threshold)
    others = written(got.filter("component_id is not null and not component_id <=> doc_id").select("row_key").distinct(), "jaccard-others")
    marked = docs.withColumn("jaccard row key", F.xxhash64(F.col(doc_id), F.col(text)))
    others = others.withColumnRenamed("row_key", "jaccard row key")
    return marked.join(F.broadcast(others) if others.count() <= BROADCAST_SETS else others, "jaccard row key", "left_anti").drop("jaccard row key")


def op3_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of all documents at similarity 0.8 over five-word shingles."""
    return jaccard_components(table(spark, sf_dir, "documents")).drop("row_key")
