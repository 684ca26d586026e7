"""Where intermediate tables and files go: the folder that the whole cluster shares."""

from __future__ import annotations

import ctypes
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession

from routeflow.functions.shared import folder as shared_folder
from routeflow.functions.shared import table as stored  # noqa: F401  written once and read back, so that the rows survive executors

#: Rows and bytes of an Arrow batch at most, besides its last row: whole texts are long, and the JVM and Python both hold a batch.
RECORDS, BYTES = 1000, 16 << 20
#: Functions that empty a module's memos; each module adds its own.
memos: list[Callable[[], None]] = []
_working = [""]


def fresh_path(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def open_fs(uri: str) -> tuple[fs.FileSystem, str]:
    """File system and inner path of a URI, for tasks that read or write files of their own."""
    return fs.FileSystem.from_uri(uri if "://" in uri or uri.startswith("file:") else "file://" + uri)


def _begin(module: str) -> None:
    """Workers are used again and again; the memos of another operator's tasks go."""
    if _working[0] != module:
        for forget in memos:
            forget()
        _working[0] = module


def _end() -> None:
    """What a task has freed goes back to the machine, for the executor's other processes."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def in_arrow(df: DataFrame, function: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """``df.mapInArrow`` with small batches, and with workers that keep no more memory than they use.

    Spark takes a batch's bounds from the session, so those stay set there.
    """
    conf = df.sparkSession.conf
    for name, most in (("maxRecordsPerBatch", RECORDS), ("maxBytesPerBatch", BYTES)):
        key = f"spark.sql.execution.arrow.{name}"
        if not 0 < int(conf.get(key).rstrip("b")) <= most:
            conf.set(key, most)
    module = function.__module__

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _begin(module)
        try:
            yield from function(batches)
        finally:
            _end()

    return df.mapInArrow(run, schema)


def slices(batches: Iterator[pa.RecordBatch], rows: int = RECORDS, size: int = BYTES // 4) -> Iterator[pa.RecordBatch]:
    """The same rows in smaller batches of ``size`` bytes or one row, so that few texts are Python objects at a time. What a batch
    took goes back to the machine before the next one, for the executor's other processes."""
    for batch in batches:
        share = max(1, min(rows, batch.num_rows * size // max(1, batch.nbytes)))
        for a in range(0, batch.num_rows, share):
            yield batch.slice(a, share)
            pa.default_memory_pool().release_unused()


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")
