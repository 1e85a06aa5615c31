"""Mixing sources to target weights by Poisson replication.

A document of a source with mean repetition rate r appears k times, where k is the inverse of the Poisson
distribution of mean r at a uniform number made from a hash of the document's id and the seed. Rates come
from the sources' total bytes and the target weights, so all rows count. The copies then go to hashed
partitions and are sorted by a hashed key: a global shuffle that needs no sampling pass.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import shuffle_partitions, table, written

SEED = "mix-1"


def _uniform(*parts: Column) -> Column:
    """A number in [0, 1) from 52 bits of the MD5 of the parts (null: empty)."""
    joined = F.concat_ws("|", *(F.coalesce(p.cast("string"), F.lit("")) for p in parts))
    return F.conv(F.substring(F.md5(joined), 1, 13), 16, 10).cast("double") / F.lit(float(1 << 52))


def _poisson_count(rate: Column, u: Column) -> Column:
    """The number of values 0, 1, 2, … at which the distribution function of Poisson(rate) is at most u: its inverse at u.

    Terms are made from logarithms, so that a large rate doesn't underflow; values far into the upper tail end the search.
    A row costs as many steps as it can have copies, and nothing but its rate is carried along.
    """
    last = F.ceil(rate + 12 * F.sqrt(rate) + 20).cast("int")
    start = F.struct(F.lit(0.0).alias("below"), F.lit(0.0).alias("factorial"), F.lit(0).alias("n"))

    def step(s: Column, k: Column) -> Column:
        factorial = s["factorial"] + F.when(k > 0, F.ln(k.cast("double"))).otherwise(0.0)
        upto = s["below"] + F.exp(k * F.ln(rate) - rate - factorial)
        return F.struct(upto.alias("below"), factorial.alias("factorial"), (s["n"] + F.when(upto <= u, 1).otherwise(0)).alias("n"))

    return F.when(rate > 0, F.aggregate(F.sequence(F.lit(0), last), start, step, lambda s: s["n"])).otherwise(0)


def source_rates(docs: DataFrame, weights: dict[str, float] | None = None, power: float = 0.5, epochs: float = 1.0, source: str = "source", text: str = "text") -> DataFrame:
    """One row per source: mix_source, mix_rate.

    Target shares are `weights` over the sources named there (others: 0), or else each source's bytes to the
    power `power`, both scaled to sum 1. rate = share x epochs x all bytes / the source's bytes. A null source is
    the source ''. A source without bytes has rate 0.
    """
    sizes = docs.groupBy(F.coalesce(F.col(source).cast("string"), F.lit("")).alias("mix_source")).agg(F.sum(F.octet_length(F.coalesce(F.col(text), F.lit(""))).cast("long")).alias("mix_bytes"))
    if weights is None:
        target = F.pow(F.col("mix_bytes").cast("double"), F.lit(power))
    else:
        target = F.coalesce(F.create_map(*[x for k, v in weights.items() for x in (F.lit(k), F.lit(float(v)))])[F.col("mix_source")], F.lit(0.0)) if weights else F.lit(0.0)
    sizes = sizes.withColumn("mix_target", target)
    sums = sizes.agg(F.sum("mix_bytes").alias("all_bytes"), F.sum("mix_target").alias("all_target"))
    rate = F.when((F.col("mix_bytes") > 0) & (F.col("all_target") > 0), F.col("mix_target") / F.col("all_target") * epochs * F.col("all_bytes") / F.col("mix_bytes")).otherwise(F.lit(0.0))
    return sizes.crossJoin(F.broadcast(sums)).select("mix_source", rate.alias("mix_rate"))  # one row of sums


def mix_sources(docs: DataFrame, weights: dict[str, float] | None = None, power: float = 0.5, epochs: float = 1.0, seed: str = SEED, doc_id: str = "doc_id", source: str = "source", text: str = "text") -> DataFrame:
    """Every column of `docs`, each row as often as drawn, with mix_copy (from 0) and mix_key, in shuffled order.

    Rows of one doc_id draw alike (repeated rows repeat together); a null doc_id or source counts as ''. Null, empty and very
    long texts are mixed like others. An empty table gives no rows. Columns of `docs` named mix_copy and mix_key are replaced;
    no other is touched, whatever its name.
    """
    spark = docs.sparkSession
    own = "mix of sources "  # before the names of columns made here, so that no column of the caller is hidden
    rates = source_rates(docs, weights, power, epochs, source, text)
    rates = written(rates.select(F.col("mix_source").alias(f"{own}source"), F.col("mix_rate").alias(f"{own}rate")), "mix-rates")  # as a file its size is known: Spark broadcasts it below its threshold, and joins by shuffle beyond
    keyed = docs.drop("mix_copy", "mix_key").withColumn(f"{own}source", F.coalesce(F.col(source).cast("string"), F.lit("")))
    drawn = keyed.join(rates, f"{own}source").withColumn(f"{own}u", _uniform(F.lit(seed), F.col(doc_id)))
    times = _poisson_count(F.col(f"`{own}rate`"), F.col(f"`{own}u`"))
    copies = drawn.withColumn(f"{own}times", times).filter(F.col(f"`{own}times`") > 0).withColumn("mix_copy", F.explode(F.sequence(F.lit(0), F.col(f"`{own}times`") - 1)))
    key = F.conv(F.substring(F.md5(F.concat_ws("|", F.lit(f"{seed}-order"), F.coalesce(F.col(doc_id).cast("string"), F.lit("")), F.col("mix_copy").cast("string"))), 1, 15), 16, 10).cast("long")
    out = copies.withColumn("mix_key", key).drop(*(f"{own}{c}" for c in ("source", "rate", "u", "times")))
    return out.repartition(shuffle_partitions(spark), "mix_key").sortWithinPartitions("mix_key")


def op2_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole corpus mixed to square-root weights of its sources' bytes."""
    out = mix_sources(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "source", "text", F.col("mix_copy").alias("copy"), F.col("mix_key").alias("shuffle_key"))


OP2_SQL = """
WITH sizes AS (
  SELECT coalesce(source, '') AS s, sum(strlen(coalesce(text, ''))) AS b FROM documents GROUP BY 1
), sums AS (SELECT sum(b) AS all_b, sum(sqrt(b)) AS all_t FROM sizes),
rates AS (SELECT s, CASE WHEN b > 0 THEN sqrt(b) / all_t * all_b / b ELSE 0.0 END AS rate FROM sizes, sums),
ks AS (SELECT s, rate, unnest(range(0, CAST(ceil(rate + 12 * sqrt(rate) + 20) AS BIGINT) + 1)) AS k FROM rates WHERE rate > 0),
steps AS (
  SELECT s, k, sum(exp(k * ln(rate) - rate - lgamma(k + 1))) OVER (PARTITION BY s ORDER BY k) AS c FROM ks
), drawn AS (
  SELECT doc_id, source, text, coalesce(source, '') AS s,
         CAST('0x' || substr(md5('mix-1|' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 13) AS BIGINT) / 4503599627370496.0 AS u
  FROM documents
), counted AS (
  SELECT s, lead(c) OVER (PARTITION BY s ORDER BY k) AS hi, c AS lo, k + 1 AS times FROM steps
), repeated AS (
  SELECT d.doc_id, d.source, d.text, c.times FROM drawn d JOIN counted c ON d.s = c.s AND c.lo <= d.u AND (c.hi > d.u OR c.hi IS NULL)
), copies AS (SELECT doc_id, source, text, unnest(range(0, times)) AS copy FROM repeated)
SELECT doc_id, source, text, CAST(copy AS INTEGER) AS copy,
       CAST('0x' || substr(md5('mix-1-order|' || coalesce(CAST(doc_id AS VARCHAR), '') || '|' || CAST(copy AS VARCHAR)), 1, 15) AS BIGINT) AS shuffle_key
FROM copies
"""
