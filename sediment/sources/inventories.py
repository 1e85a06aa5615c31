"""Scans driven by a manifest: its rows are checked, held against what is there, and answered for many targets at once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import ingest

#: What is wrong with a manifest's row by itself, by name; the first that holds counts.
_SAFE = r"^(?!/)(?!.*(?:^|/)(?:\.{0,2})(?:/|$)).+$"


def _faults() -> dict[str, Column]:
    c = F.col
    return {
        "invalid_path": c("path").isNull() | ~c("path").rlike(_SAFE),
        "invalid_hash": c("sha256").isNull() | ~c("sha256").rlike("^[0-9a-f]{64}$"),
        "invalid_size": c("size").isNull() | (c("size") < 0),
        "invalid_time": T.parse_timestamp(c("updated_at")).isNull(),
    }


def manifest_defects(manifest: DataFrame, records: DataFrame) -> DataFrame:
    """path, defect of a manifest (path, sha256, size, updated_at as text) held against records (path, sha256, size).

    One defect a row, the first of: an invalid path (null, empty, absolute or climbing), hash, size or time; a path that stands
    there more than once; a record that is missing; another size or hash than the manifest's. Records that the manifest
    doesn't name are none. Paths meet by joins and partial counts, nothing is broadcast.
    """
    faults = F.lit(None).cast("string")
    for name, found in reversed(_faults().items()):
        faults = F.when(found, name).otherwise(faults)
    twice = manifest.groupBy("path").agg(F.count(F.lit(1)).alias("_n"))
    there = records.select("path", F.col("sha256").alias("_sha256"), F.col("size").alias("_size"))
    held = manifest.withColumn("_fault", faults).join(twice, "path", "left").join(there, "path", "left")
    defect = F.coalesce("_fault", F.when(F.col("_n") > 1, "duplicate_path").when(F.col("_sha256").isNull(), "missing_record").when((F.col("_size") != F.col("size")) | (F.col("_sha256") != F.col("sha256")), "changed_record"))
    return held.select("path", defect.alias("defect")).filter("defect is not null")


def checked_manifest(manifest: DataFrame, records: DataFrame) -> DataFrame:
    """The manifest's rows; the job fails at a row with a defect, and names it."""
    bad = manifest_defects(manifest, records).groupBy(F.col("path").alias("_path")).agg(F.min("defect").alias("_defect"))
    joined = manifest.join(bad, F.col("path").eqNullSafe(F.col("_path")), "left")
    failed = F.raise_error(F.concat(F.lit("source inventory: "), F.col("_defect"), F.lit(" at "), F.coalesce("path", F.lit("a row without a path"))))
    return joined.withColumn("sha256", F.when(F.col("_defect").isNotNull(), failed.cast("string")).otherwise(F.col("sha256"))).select(*manifest.columns)


def discovered(manifest: DataFrame, targets: DataFrame, archived: DataFrame, ledger: DataFrame) -> DataFrame:
    """target, path, sha256, updated_at of the manifest's records that each target (target, folder) is to ingest.

    A record belongs to a target whose folder (with a slash at its end, '' for all) its path begins with: folders of paths
    are exploded and joined, so many targets are answered from one reading. Which records are fresh is told by high-water
    marks, hashes and the ledger, with the target as the partition.
    """
    steps = F.split("path", "/")
    folders = F.transform(F.sequence(F.lit(0), F.size(steps) - 1), lambda i: F.when(i == 0, F.lit("")).otherwise(F.concat(F.array_join(F.slice(steps, F.lit(1), i), "/"), F.lit("/"))))
    rows = manifest.select("path", "sha256", T.parse_timestamp(F.col("updated_at")).alias("updated_at"), F.explode(folders).alias("folder"))
    of_target = rows.join(targets, "folder").select(F.col("target").alias("partition"), "path", "sha256", "updated_at")
    return ingest.select_fresh(of_target, archived, ledger).select(F.col("partition").alias("target"), "path", "sha256", "updated_at")
