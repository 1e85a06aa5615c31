"""Retrieval and answer metrics, threshold gates, samples."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T


def rank_metrics(ranked: DataFrame, cases: DataFrame) -> DataFrame:
    """n_cases, recall_at_5, mrr, ndcg_at_5 of ranked (case_id, place, relevant) against all cases (case_id); empty: 0."""
    first = ranked.filter("relevant").groupBy("case_id").agg(F.min("place").alias("rank"))
    every = cases.select("case_id").distinct().join(first, "case_id", "left")
    top = F.col("rank") <= 5
    return every.agg(
        F.count(F.lit(1)).alias("n_cases"),
        F.coalesce(F.avg(F.when(top, 1.0).otherwise(0.0)), F.lit(0.0)).alias("recall_at_5"),
        F.coalesce(F.avg(F.coalesce(1.0 / F.col("rank"), F.lit(0.0))), F.lit(0.0)).alias("mrr"),
        F.coalesce(F.avg(F.when(top, 1.0 / F.log2(F.col("rank") + 1.0)).otherwise(0.0)), F.lit(0.0)).alias("ndcg_at_5"),
    )


def token_f1(answer: Column, reference: Column) -> Column:
    """The best F1 of a window of the answer as long as the reference, in normalised words; 0 where either is empty."""
    split = lambda c: F.filter(F.split(T.normalized_answer(c), " "), lambda w: w != "")
    a, r = split(answer), split(reference)
    width = F.least(F.size(r), F.size(a))

    def f1(i: Column) -> Column:
        piece = F.slice(a, i, width)
        common = F.aggregate(F.array_distinct(r), F.lit(0), lambda s, w: s + F.least(F.size(F.filter(piece, lambda x: x == w)), F.size(F.filter(r, lambda x: x == w))))
        return 2.0 * common / (F.size(piece) + F.size(r))

    starts = F.sequence(F.lit(1), F.greatest(F.size(a) - width + 1, F.lit(1)))
    return F.when(width < 1, F.lit(0.0)).otherwise(F.array_max(F.transform(starts, f1)))


def answer_verdict(answer: Column, reference: Column, f1: Column, passing: float = 0.8) -> Column:
    """exact, normalized (contained), partial (F1 reaches `passing`) or miss."""
    whole = T.normalized_answer(reference)
    return F.when((reference != "") & F.contains(answer, reference), "exact").when((whole != "") & F.contains(T.normalized_answer(answer), whole), "normalized").when(f1 >= passing, "partial").otherwise("miss")


def threshold_failures(metrics: DataFrame, thresholds: DataFrame) -> DataFrame:
    """Metrics (metric, value) below a floor or above a ceiling (metric, kind, bound, ordinal); the last threshold of a kind wins."""
    last = thresholds.groupBy("metric", "kind").agg(F.max_by("bound", "ordinal").alias("bound"))
    joined = last.join(metrics, "metric", "left")
    fails = F.when(F.col("kind") == "floor", F.col("value") < F.col("bound")).otherwise(F.col("value") > F.col("bound"))
    return joined.filter(F.coalesce(fails, F.lit(True))).select("metric", "kind", "bound", "value")


def stratified_sample(df: DataFrame, stratum: str, key: str, per_stratum: int, seed: str) -> DataFrame:
    """`per_stratum` rows of each stratum, by the hash of seed and key: the same rows however the table is laid out."""
    digest = F.sha2(F.concat(F.lit(seed), F.lit("|"), F.col(key).cast("string")), 256)
    place = F.row_number().over(Window.partitionBy(stratum).orderBy(digest, key))
    return df.withColumn("place", place).filter(F.col("place") <= per_stratum)


#: Vectors and queries of one block: a block of vectors meets a block of queries in one task.
VECTOR_BLOCK, QUERY_BLOCK = 1 << 16, 1 << 12


def cosine_neighbours(queries: DataFrame, vectors: DataFrame, least: float, limit: int) -> DataFrame:
    """query_id, vec_id, cosine, place: for each query its `limit` nearest other vectors of a cosine of `least` or more.

    The stated query set is held against all rows, in blocks of bounded size: each pair of a block of queries and one of
    vectors is a matrix product in one task, which gives at most `limit` rows a query. Zero, null and odd-sized vectors match
    nothing; ties go to the smaller vec_id.
    """
    blocks = lambda df, size: max(1, -(-df.count() // size))
    n_vectors, n_queries = blocks(vectors, VECTOR_BLOCK), blocks(queries, QUERY_BLOCK)
    block = lambda n: F.pmod(F.xxhash64("vec_id"), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = queries.select(block(n_queries).alias("q"), every(n_vectors).alias("v"), F.lit(0).alias("rank"), "vec_id", F.col("embedding").cast("array<double>").alias("embedding"))
    right = vectors.select(every(n_queries).alias("q"), block(n_vectors).alias("v"), F.lit(1).alias("rank"), "vec_id", F.col("embedding").cast("array<double>").alias("embedding"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, ids, rows, matrix = None, [], [], None

        def unit(found: list) -> np.ndarray:
            x = np.array(found, np.float64)
            norm = np.sqrt(np.einsum("ij,ij->i", x, x))[:, None]
            return np.divide(x, norm, out=np.zeros_like(x), where=norm > 0)

        for b in batches:
            out: list[tuple[int, int, float]] = []
            at = list(zip(b.column("q").to_pylist(), b.column("v").to_pylist(), strict=True))
            rank, vec, emb = b.column("rank").to_pylist(), b.column("vec_id").to_pylist(), b.column("embedding").to_pylist()
            k = 0
            while k < len(at):
                if at[k] != key:
                    key, ids, rows, matrix = at[k], [], [], None
                z = k
                while z < len(at) and at[z] == key and rank[z] == rank[k]:
                    z += 1
                good = [i for i in range(k, z) if emb[i] and None not in emb[i] and (not rows or len(emb[i]) == len(rows[0]))]
                if rank[k] == 0:
                    ids += [vec[i] for i in good]
                    rows += [emb[i] for i in good]
                    matrix = None
                elif good and rows:
                    matrix = unit(rows) if matrix is None else matrix
                    cosine = np.round(unit([emb[i] for i in good]) @ matrix.T, 12)
                    own = np.array([vec[i] for i in good])
                    for j, query in enumerate(ids):
                        near = np.flatnonzero((cosine[:, j] >= least) & (own != query))
                        best = near[np.lexsort((own[near], -cosine[near, j]))[:limit]]
                        out += [(query, int(own[i]), float(cosine[i, j])) for i in best]
                k = z
            yield pa.RecordBatch.from_arrays([pa.array([x[c] for x in out], t) for c, t in enumerate((pa.int64(), pa.int64(), pa.float64()))], names=["query_id", "vec_id", "cosine"])

    both = left.unionByName(right).repartition("q", "v").sortWithinPartitions("q", "v", "rank", "vec_id")
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("cosine"), "vec_id"))
    return both.mapInArrow(run, "query_id long, vec_id long, cosine double").withColumn("place", place).filter(F.col("place") <= limit)


def score_buckets(hits: DataFrame) -> DataFrame:
    """bucket and n_hits: how hits (query_id, score) lie against their query's best score."""
    share = F.col("score") / F.max("score").over(Window.partitionBy("query_id"))
    bucket = F.when(share >= 0.99, "99+").when(share >= 0.95, "95-99").when(share >= 0.85, "85-95").when(share >= 0.5, "50-85").otherwise("<50")
    return hits.select(bucket.alias("bucket")).groupBy("bucket").agg(F.count(F.lit(1)).alias("n_hits"))


def noise_relations(hits: DataFrame, gold: DataFrame) -> DataFrame:
    """query_id, id, relation of hits that aren't expected, by what they share with the expected hit (query_id, gold_id)."""
    wanted = gold.join(hits.select("query_id", F.col("id").alias("gold_id"), F.col("layer").alias("g_layer"), F.col("scope").alias("g_scope"), F.col("topic").alias("g_topic")), ["query_id", "gold_id"])
    layer, scope, topic = (F.col(c) == F.col(f"g_{c}") for c in ("layer", "scope", "topic"))
    incomplete = (F.col("layer") == "") | (F.col("scope") == "") | (F.col("topic") == "")
    relation = (
        F.when(incomplete, "incomplete")
        .when(layer & scope & topic, "same_topic_and_scope")
        .when(layer & topic, "same_topic_other_scope")
        .when(layer & scope, "same_scope_other_topic")
        .when(layer, "same_layer")
        .when(topic, "same_topic_other_layer")
        .otherwise("unrelated")
    )
    return hits.join(wanted, "query_id").filter(F.col("id") != F.col("gold_id")).select("query_id", "id", relation.alias("relation"))


def first_losses(rows: DataFrame, stages: dict[str, Column], order: str, key: str | None = None, limit: int | None = None) -> DataFrame:
    """`rows` with `loss`: the first stage (a condition of loss) that holds, null for survivors.

    With `key`, a row that passes all stages is a `duplicate` if an earlier such row (by `order`, distinct) has its key. With
    `limit`, rows behind the limit-th survivor are left out, as if rows were taken in order until there are enough: one value,
    the order of that survivor, is found by a bounded top-k and joined.
    """
    loss = F.lit(None).cast("string")
    for name, lost in reversed(stages.items()):
        loss = F.when(F.coalesce(lost, F.lit(False)), name).otherwise(loss)
    out = rows.withColumn("loss", loss)
    if key is not None:
        first = out.filter("loss is null").groupBy(F.col(key).alias("_key")).agg(F.min(order).alias("_first"))
        joined = out.join(first, F.col(key).eqNullSafe(F.col("_key")), "left")
        out = joined.withColumn("loss", F.when(F.col("loss").isNull() & (F.col(order) > F.col("_first")), "duplicate").otherwise(F.col("loss"))).drop("_key", "_first")
    if limit is None:
        return out
    last = out.filter("loss is null").select(order).orderBy(order).limit(limit).agg(F.when(F.count(F.lit(1)) == limit, F.max(order)).alias("_last"))
    return out.crossJoin(F.broadcast(last)).filter(F.col("_last").isNull() | (F.col(order) <= F.col("_last"))).drop("_last")  # one row


def loss_counts(judged: DataFrame) -> DataFrame:
    """stage, n_rows of rows with `loss`; survivors count as `kept`."""
    return judged.groupBy(F.coalesce("loss", F.lit("kept")).alias("stage")).agg(F.count(F.lit(1)).alias("n_rows"))
