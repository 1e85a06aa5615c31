"""What the operators of this subpackage share: tables, shared storage, Arrow batches."""

from __future__ import annotations

import ctypes
import sys
import tempfile
import types
import uuid
from collections.abc import Callable, Iterator
from typing import ClassVar

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

#: Rows and bytes of one Arrow batch handed to a Python worker.
BATCH_ROWS, BATCH_BYTES = 1000, 8 << 20
#: Bytes of text that numpy code works on at a time (a longer text stands alone).
CHUNK_BYTES = 1 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the input tables; Spark reads it, so any store that Spark knows will do."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def small_batches(spark: SparkSession) -> None:
    """Bound what a Python worker holds at once, long texts included."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def shuffle_partitions(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share. Where the session names none, a temporary one serves local mode (tests);
    on a cluster that is an error, since executors would write to disks of their own."""
    got = spark.conf.get("spark.checkpoint.dir", None)
    if not got:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        got = "file://" + tempfile.mkdtemp(prefix="spark-sediment-")
        spark.conf.set("spark.checkpoint.dir", got)
    return got.rstrip("/")


def new_folder(spark: SparkSession, label: str) -> str:
    return f"{shared_folder(spark)}/{label}-{uuid.uuid4().hex}"


class Scratch:
    """Owner of the tables written while it is open: all but the kept ones are deleted when it closes.

    What leaves the block must be written (and kept) itself, since it may not read the others any more.
    """

    _open: ClassVar[list[Scratch]] = []

    def __init__(self, spark: SparkSession) -> None:
        self.spark, self.folders = spark, {}

    def __enter__(self) -> Scratch:
        self._open.append(self)
        return self

    def keep(self, df: DataFrame) -> DataFrame:
        """Leave this table of `written` to the next owner outside, if any."""
        at = self.folders.pop(id(df))
        if (place := self._open.index(self)) > 0:
            self._open[place - 1].folders[id(df)] = at
        return df

    def __exit__(self, *_: object) -> None:
        self._open.remove(self)
        for at, _df in self.folders.values():
            delete_folder(self.spark, at)


def delete_folder(spark: SparkSession, at: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(at)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def written(df: DataFrame, label: str) -> DataFrame:
    """Cut the lineage: write `df` as Parquet in the shared folder and read it back. An open Scratch owns the table."""
    spark = df.sparkSession
    at = new_folder(spark, label)
    df.write.parquet(at)
    got = spark.read.schema(df.schema).parquet(at)
    if Scratch._open:
        Scratch._open[-1].folders[id(got)] = at, got
    return got


def text_column(batch: pa.RecordBatch, name: str) -> pa.Array:
    """A string column without nulls, with 32-bit offsets."""
    col = batch.column(batch.schema.get_field_index(name))
    return col.cast(pa.string()).fill_null("")


def chunks(col: pa.Array, most: int = CHUNK_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of about `most` bytes; a longer text makes a range of its own."""
    import numpy as np

    offsets = np.frombuffer(col.buffers()[1], np.int32)[col.offset : col.offset + len(col) + 1] if len(col) else [0]
    a = 0
    while a < len(col):
        b = int(np.searchsorted(offsets, int(offsets[a]) + most, "right")) - 1
        b = min(max(b, a + 1), len(col))
        yield a, b
        a = b


def held_by_worker(key: object, make: Callable[[], object]) -> object:
    """What `make` gives, kept by a Python worker from task to task until another key is asked for."""
    held = sys.modules.setdefault("sediment_worker_cache", types.ModuleType("sediment_worker_cache"))
    if getattr(held, "key", None) != key:
        held.key = held.value = None  # the old one goes before the new one is made
        held.value, held.key = make(), key
    return held.value


def free_held() -> None:
    """Drop what a Python worker keeps for another operator, and give freed memory back to the system: a worker is used again
    from stage to stage, so what one has held would stand beside what the next one needs."""
    held = sys.modules.get("sediment_worker_cache")
    if held is not None:
        held.key = held.value = None
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # no glibc
        pass
