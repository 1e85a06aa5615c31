"""Which project a record belongs to, and whether an automation wrote it, by the members of its JSON."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import json_text as J

# Members that name a project's folder.
PATH_KEYS = ["cwd", "project_path", "working_directory", "current_working_directory", "workspace", "repo_path", "repository_path"]


def record_origins(lines: DataFrame, key: str = "record", column: str = "line") -> DataFrame:
    """key, paths and automation of records whose JSON lines are rows (key, column).

    paths are the distinct absolute folders that members of PATH_KEYS name at any depth, without a slash at the end, sorted;
    automation tells whether a session's own line has `automation` as the source of its thread. Lines that are no JSON say
    nothing; a record with nothing to tell has no paths. Members are summed up per record, with partial sums.
    """
    known = lines.select(key, column)
    folder = F.rtrim(F.expr("variant_get(value, '$', 'string')"))
    found = J.walked(known, key, column).filter(F.col("name").isin(PATH_KEYS) & (F.col("kind") == "string"))
    paths = found.select(key, F.regexp_replace(F.trim(folder), "(?<=.)/+$", "").alias("path")).filter(F.col("path").startswith("/")).groupBy(key).agg(F.array_sort(F.collect_set("path")).alias("paths"))
    meta = F.try_parse_json(F.col(column))
    source = F.lower(F.trim(F.try_variant_get(meta, "$.payload.thread_source", "string")))
    automated = known.select(key, (F.coalesce(F.try_variant_get(meta, "$.type", "string") == "session_meta", F.lit(False)) & F.coalesce(source == "automation", F.lit(False))).alias("auto")).groupBy(key).agg(F.bool_or("auto").alias("automation"))
    return automated.join(paths, key, "left").select(key, F.coalesce("paths", F.array().cast("array<string>")).alias("paths"), "automation")


def of_project(origins: DataFrame, folder: str, needs_path: bool = False) -> DataFrame:
    """Records that name a project's folder, or name none (unless `needs_path`)."""
    silent = F.lit(False) if needs_path else F.size("paths") == 0
    return origins.filter(F.array_contains("paths", folder.rstrip("/") or "/") | silent)
