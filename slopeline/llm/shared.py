"""Written tables and files in the folder that all executors share."""

from __future__ import annotations

import ctypes
import math
import os
import sys
import types
from collections.abc import Callable

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import scratch_path

#: Extra Arrow settings for text columns: batches by bytes, not by 10,000 rows of any length.
BATCH_BYTES = 16 << 20


def text_batches(spark: SparkSession, n_bytes: int = BATCH_BYTES) -> None:
    """Bound the Arrow batches handed to Python by bytes, as texts may be very long."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(n_bytes))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "10000")


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` written as Parquet under ``spark.checkpoint.dir`` and read again: cuts the lineage,
    survives lost executors, and gives later plans its true size."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def give_back() -> None:
    """Return a worker's freed memory to the system: workers outlive their tasks, and what the
    allocators keep would add up over the stages of a job."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def of_worker(key, make: Callable):
    """An object of the worker process, made once. Task functions come to a worker by value, so a
    module's globals begin anew with every task; this one outlives them, and its size is its maker's to bound."""
    kept = sys.modules.setdefault("_kept_by_worker", types.ModuleType("_kept_by_worker")).__dict__
    if key not in kept:
        kept[key] = make()
    return kept[key]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def total_bytes(df: DataFrame, column: str) -> int:
    """Bytes of a text column over the whole table (one scan, one number)."""
    return int(df.agg(F.sum(F.octet_length(column))).first()[0] or 0)


def parts(n_bytes: int, each: int, least: int = 1) -> int:
    return max(least, math.ceil(n_bytes / each))


def open_folder(uri: str) -> tuple[pafs.FileSystem, str]:
    """The file system and the path of a folder URI (file, hdfs, s3, gs) on any machine."""
    uri = uri if "://" in uri or uri.startswith("file:") else "file://" + uri
    if uri.startswith("file:") and not uri.startswith("file://"):
        uri = "file://" + uri[len("file:"):]
    return pafs.FileSystem.from_uri(uri)


def put_file(uri: str, name: str, content, attempt: str) -> str:
    """Write ``content`` (bytes or an iterable of bytes) as ``uri/name`` in one visible step.

    Each attempt writes a file of its own and renames it, so a task run twice (a lost executor,
    speculation) leaves one whole file. Returns the file's path within its file system."""
    fs, base = open_folder(uri)
    fs.create_dir(base, recursive=True)
    path, own = f"{base}/{name}", f"{base}/_{attempt}-{os.getpid()}-{name}"
    with fs.open_output_stream(own, compression=None) as out:
        for block in [content] if isinstance(content, (bytes, bytearray, memoryview)) else content:
            out.write(block)
    fs.move(own, path)
    return path
