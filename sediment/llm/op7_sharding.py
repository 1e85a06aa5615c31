"""Sharding by a k-d tree over metadata, in DataFrame operations only.

A point is a group of equal texts; its weight is the bytes of all its rows, and its dimensions are the group's least
language and source (as places in a fixed range, so that rows of one value lie together) and the logarithm of its length.
Each dimension is measured in its own standard deviation over the corpus. A level splits each node along the dimension in
which it is widest, at the weighted median, found by histograms of a fixed number of bins: partial sums are made before the
shuffle, and the driver sees one row per node and round. A hash of the text only tells points of one value apart. Splits are
a small table that each level joins; points go on from level to level as a written narrow table.
"""

from __future__ import annotations

import json
import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ._common import shuffle_partitions, table, written

#: Bins of a histogram, and how many are made, each of the bin that holds the median: a node's values are told apart to one
#: part in BINS ** ROUNDS of its width.
BINS, ROUNDS = 256, 3
#: Places of a dimension whose values are names.
PLACES = 4096
#: Groups whose rows differ in language or source that are broadcast (about 50 bytes each); beyond, Spark joins by shuffle.
BROADCAST_GROUPS = 200_000
DIMS = ("lang", "source", "length")
_OWN = "kd tree "  # before the names of columns made here, so that no column of the caller is hidden


def _c(name: str) -> Column:
    return F.col(f"`{_OWN}{name}`")


def _measured(docs: DataFrame, text: str, lang: str, source: str) -> DataFrame:
    """The caller's columns with size, text_crc32, the text's key and jitter, and the metadata of the row itself."""
    whole = F.coalesce(F.col(text), F.lit(""))
    name = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("")) if c in docs.columns else F.lit("")
    return docs.withColumns(
        {
            f"{_OWN}size": F.octet_length(whole).cast("long") + 1,
            f"{_OWN}crc": F.crc32(whole).cast("long"),
            f"{_OWN}key": F.xxhash64(whole),
            f"{_OWN}lang": name(lang),
            f"{_OWN}source": name(source),
        }
    )


def _points(measured: DataFrame) -> DataFrame:
    """One row for each distinct text: its key (hash, CRC-32 and size), the bytes of its rows, and its metadata."""
    key = [_c(k).alias(k) for k in ("key", "crc", "size")]
    groups = measured.groupBy(*key).agg(F.sum(_c("size")).alias("w"), F.min(_c("lang")).alias("lang_name"), F.min(_c("source")).alias("source_name"), ((F.max(_c("lang")) != F.min(_c("lang"))) | (F.max(_c("source")) != F.min(_c("source")))).alias("mixed"))
    return groups


def _placed(df: DataFrame) -> DataFrame:
    """The three dimensions from key, size, lang_name and source_name.

    The hash of the text, from 0 to 1, is added below the unit of a dimension: it decides only between equal values.
    """
    jitter = F.shiftrightunsigned(F.xxhash64("key", "crc"), 11).cast("double") / F.lit(float(1 << 53))
    place = lambda c: (F.pmod(F.xxhash64(c), F.lit(PLACES)) + jitter) / PLACES
    return df.withColumn("lang", place("lang_name")).withColumn("source", place("source_name")).withColumn("length", F.log2(F.col("size") + jitter))


def _table(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    """A table with a row for each node, made by the driver as one literal: broadcast, and bounded by the number of leaves."""
    names = [x.split()[0] for x in schema.split(", ")]
    text = json.dumps([dict(zip(names, r, strict=True)) for r in rows])
    fields = ", ".join(f"{n}: {x.split()[1]}" for n, x in zip(names, schema.split(", "), strict=True))
    return F.broadcast(spark.range(0, 1, 1, 1).select(F.inline(F.from_json(F.lit(text), f"array<struct<{fields}>>"))))


def _split(df: DataFrame, splits: DataFrame) -> DataFrame:
    """One level down: node becomes the right child where the split's dimension is at the threshold or above."""
    value = F.coalesce(*(F.when(F.col("dim") == d, F.col(d)) for d in DIMS))
    went = df.join(splits.withColumnRenamed("of", "node"), "node", "left")
    return went.withColumn("node", F.when(value >= F.col("at"), F.col("right_child")).otherwise(F.col("node"))).drop("dim", "at", "right_child")


_SPLITS = "of int, dim string, at double, right_child int"


def kd_tree(points: DataFrame, leaves: int) -> tuple[list[DataFrame], dict[int, int]]:
    """The splits of each level as tables, and the first leaf of each node. Points have key, crc, w and DIMS.

    A node splits its share of leaves in two halves, and its weight in the same proportion, at the weighted median of its
    widest dimension. The driver gets a row for each node and round, so its memory is bounded by the number of leaves.
    """
    spark = points.sparkSession
    first, shares = {0: 0}, {0: leaves}  # a node: its first leaf, how many leaves are below
    levels: list[DataFrame] = []
    if leaves < 2:
        return levels, first
    w, at = F.col("w").cast("double"), written(points.select("w", *DIMS, F.lit(0).alias("node")), "kd-points")
    scale: dict[str, float] = {}
    while max(shares.values()) > 1:
        spread = [f(d).alias(f"{k}_{d}") for d in DIMS for k, f in (("lo", F.min), ("hi", F.max), ("s", lambda d: F.sum(w * F.col(d))), ("ss", lambda d: F.sum(w * F.col(d) * F.col(d))))]
        rows = {r["node"]: r for r in at.groupBy("node").agg(F.sum(w).alias("w"), *spread).collect() if shares[r["node"]] > 1}
        if not rows:
            break
        deviation = {k: {d: math.sqrt(max(0.0, r[f"ss_{d}"] / r["w"] - (r[f"s_{d}"] / r["w"]) ** 2)) for d in DIMS} for k, r in rows.items()}
        scale = scale or {d: max(deviation[0][d], 1e-9) for d in DIMS}
        widest = {k: max(DIMS, key=lambda d: round(x[d] / scale[d], 6)) for k, x in deviation.items()}  # at a tie the earlier one
        lo = {k: r[f"lo_{widest[k]}"] for k, r in rows.items()}
        width = {k: max(r[f"hi_{widest[k]}"] - lo[k], 1e-12) * (1 + 1e-9) for k, r in rows.items()}
        goal = {k: r["w"] * math.ceil(shares[k] / 2) / shares[k] for k, r in rows.items()}
        below, cut = dict.fromkeys(rows, 0.0), dict(lo)
        for _ in range(ROUNDS):
            nodes = _table(spark, [(k, widest[k], lo[k], width[k], below[k], goal[k]) for k in rows], "node int, dim string, lo double, width double, below double, goal double")
            value = F.coalesce(*(F.when(F.col("dim") == d, F.col(d)) for d in DIMS))
            binned = at.join(nodes, "node").withColumn("bin", F.floor((value - F.col("lo")) / F.col("width") * BINS).cast("int")).filter(F.col("bin").between(0, BINS - 1))
            sums = binned.groupBy("node", "bin", "below", "goal").agg(F.sum(w).alias("w"))
            running = sums.withColumn("upto", F.sum("w").over(Window.partitionBy("node").orderBy("bin")) + F.col("below"))  # BINS rows a node
            for r in running.filter(F.col("upto") >= F.col("goal")).groupBy("node").agg(F.min(F.struct("bin", "w", "upto")).alias("x")).collect():
                k, x = r["node"], r["x"]
                below[k], width[k] = x["upto"] - x["w"], width[k] / BINS
                lo[k] += x["bin"] * width[k]
                cut[k] = lo[k] if goal[k] - below[k] < x["upto"] - goal[k] else lo[k] + width[k]  # the nearer edge
        level, base = [], max(first) + 1
        for i, (k, at_value) in enumerate(sorted(cut.items())):
            left = math.ceil(shares[k] / 2)
            first[base + i], shares[base + i], shares[k] = first[k] + left, shares[k] - left, left
            level.append((k, widest[k], float(at_value), base + i))
        for k in set(shares) - set(cut) - {x[3] for x in level}:
            shares[k] = 1  # a node without rows, or a leaf
        levels.append(_table(spark, level, _SPLITS))
        if max(shares.values()) > 1:
            at = written(_split(at, levels[-1]), "kd-points")
    return levels, first


def shard_documents(docs: DataFrame, target_bytes: int | None = None, n_shards: int | None = None, doc_id: str = "doc_id", text: str = "text", lang: str = "lang", source: str = "source", carry: list[str] | None = None) -> DataFrame:
    """Shards of nearly `target_bytes` each (or exactly `n_shards` of nearly equal bytes).

    `carry` names the columns that are kept (all of them if not given); to them come size (UTF-8 bytes of the text plus 1),
    text_crc32, shard and slot (gapless from 0 in each shard, hashed buckets of doc_id in turn and by doc_id within one). A
    kept column of one of these four names is replaced; others keep their values whatever their names. Null and empty texts are
    one group of size 1; a null language or source counts as '', and so does a column that is missing. Equal texts share a
    shard: a group larger than a shard makes that shard larger and is never divided; very long texts are points like others.
    Repeated rows each take a slot of their own; a null doc_id is a value like any other. An empty table gives no rows.
    """
    spark = docs.sparkSession
    carry = [c for c in (docs.columns if carry is None else carry) if c not in ("size", "text_crc32", "shard", "slot")]
    rows = _measured(docs.select(*dict.fromkeys([*carry, doc_id, text, *(c for c in (lang, source) if c in docs.columns)])), text, lang, source)
    points = written(_points(rows), "kd-groups")
    if n_shards is None:
        n_shards = max(1, math.ceil((points.agg(F.sum("w")).first()[0] or 0) / max(1, target_bytes or 1)))
    levels, first = kd_tree(_placed(points), n_shards)
    # rows know their group's metadata by themselves, but where copies differ
    odd = points.filter("mixed").select(F.col("key").alias(f"{_OWN}key"), F.col("crc").alias(f"{_OWN}crc"), F.col("size").alias(f"{_OWN}size"), F.struct("lang_name", "source_name").alias(f"{_OWN}group"))
    odd = written(odd, "kd-odd")
    at = rows.join(F.broadcast(odd) if odd.count() <= BROADCAST_GROUPS else odd, [f"{_OWN}key", f"{_OWN}crc", f"{_OWN}size"], "left")
    own = F.coalesce(_c("group"), F.struct(_c("lang").alias("lang_name"), _c("source").alias("source_name")))
    keep = F.struct(*[F.col(f"`{c}`") for c in carry], F.col(f"`{doc_id}`").alias(f"{_OWN}id"))
    went = _placed(at.select(keep.alias("row"), _c("size").alias("size"), _c("crc").alias("crc"), _c("key").alias("key"), own["lang_name"].alias("lang_name"), own["source_name"].alias("source_name"))).select("row", "size", "crc", *DIMS, F.lit(0).alias("node"))
    for splits in levels:
        went = _split(went, splits)
    leaves = _table(spark, list(first.items()), "node int, shard int")
    return _slots(went.join(leaves, "node").select("row", "size", "crc", "shard"), carry, n_shards, shuffle_partitions(spark))


def _slots(placed: DataFrame, carry: list[str], n_shards: int, parallel: int) -> DataFrame:
    """Number the rows of each shard without bringing a shard into one task.

    A shard is cut into buckets by the hash of doc_id; rows are numbered within a bucket, and the buckets'
    counts (n_shards x buckets rows at most) give each bucket's first number.
    """
    buckets = max(1, math.ceil(4 * parallel / n_shards))
    key = F.col("row")[f"{_OWN}id"]
    cut = placed.withColumn("bucket", F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int"))
    counts = cut.groupBy("shard", "bucket").agg(F.count(F.lit(1)).alias("n"))
    offset = F.sum("n").over(Window.partitionBy("shard").orderBy("bucket")) - F.col("n")
    firsts = counts.select("shard", "bucket", offset.alias("first"))
    within = F.row_number().over(Window.partitionBy("shard", "bucket").orderBy(key, "crc", "size"))
    out = cut.withColumn("within", within).join(firsts, ["shard", "bucket"])
    return out.select(*(F.col("row")[c].alias(c) for c in carry), "size", F.col("crc").alias("text_crc32"), "shard", (F.col("first") + F.col("within") - 1).alias("slot"))


def op7_kd_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in 16 shards of nearly equal bytes."""
    out = shard_documents(table(spark, sf_dir, "documents"), n_shards=16, carry=["doc_id"])
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", F.col("slot").cast("long"), F.lit(None).cast("int").alias("grown_shard"))
