"""Pieces that several text operators share: scratch tables, Arrow helpers."""

from __future__ import annotations

import atexit
import re
import shutil
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_local: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor can reach: ``spark.checkpoint.dir``.

    Only where that is unset and all tasks run in this process (tests on one
    machine) a temporary folder is made and set for the session; on a cluster
    an unset folder is an error.
    """
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        if re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master) is None:
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        where = tempfile.mkdtemp(prefix="tidewake-")
        _local.append(where)
        spark.conf.set("spark.checkpoint.dir", where)
    if not spark.sparkContext._jsc.sc().getCheckpointDir().isDefined():
        spark.sparkContext.setCheckpointDir(where)
    return where


@atexit.register
def _drop_local() -> None:
    for d in _local:
        shutil.rmtree(d, ignore_errors=True)


def scratch_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark).rstrip('/')}/tidewake/{name}-{uuid.uuid4().hex}"


#: Spark removes an execution's shuffle files when it ends, instead of some time after.
_CLEAN = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def _written(df: DataFrame, name: str, options: dict[str, str]) -> str:
    spark = df.sparkSession
    path = scratch_path(spark, name)
    writer = df.write.option("compression", "zstd")
    for k, v in options.items():
        writer = writer.option(k, v)
    before = spark.conf.get(_CLEAN, None)
    spark.conf.set(_CLEAN, "true")
    try:
        writer.parquet(path)
    finally:
        spark.conf.set(_CLEAN, before) if before is not None else spark.conf.unset(_CLEAN)
    return path


def materialise(df: DataFrame, name: str, **options: str) -> DataFrame:
    """Write to the shared folder and read back: cuts lineage, survives executor loss; the write's shuffle files go with it."""
    return df.sparkSession.read.schema(df.schema).parquet(_written(df, name, options))


class Scratch:
    """Tables that are deleted at the end of a ``with`` block, when what was made of them is written."""

    def __init__(self, spark: SparkSession) -> None:
        self.spark: SparkSession = spark
        self.paths: list[str] = []

    def __enter__(self) -> Scratch:
        return self

    def materialise(self, df: DataFrame, name: str, **options: str) -> DataFrame:
        self.paths.append(_written(df, name, options))
        return self.spark.read.schema(df.schema).parquet(self.paths[-1])

    def __exit__(self, *_: object) -> None:
        jvm = self.spark._jvm
        for p in self.paths:
            at = jvm.org.apache.hadoop.fs.Path(p)
            at.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(at, True)


def text_of(docs: DataFrame, text_col: str, alias: str = "text"):
    """The text as UTF-8 bytes; null counts as empty."""
    return F.coalesce(F.col(text_col).cast("string"), F.lit("")).cast("binary").alias(alias)


def row_key(*values: Column) -> list[Column]:
    """Two join keys of a row: its id (first value; null counts as -1) and a hash of all values."""
    return [F.coalesce(values[0].cast("long"), F.lit(-1)).alias("key_id"), F.xxhash64(*values).alias("key_hash")]


def slices(batches: Iterator[pa.RecordBatch], column: str, max_bytes: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """Cuts batches so that one holds about ``max_bytes`` of ``column`` (or a single row)."""
    for batch in batches:
        col = batch.column(batch.schema.get_field_index(column))
        sizes = np.diff(np.frombuffer(col.buffers()[1], np.int32)[col.offset : col.offset + len(col) + 1]) if len(col) else []
        start, held = 0, 0
        for i, n in enumerate(sizes):
            if held and held + n > max_bytes:
                yield batch.slice(start, i - start)
                start, held = i, 0
            held += int(n)
        if start < batch.num_rows:
            yield batch.slice(start)


def list_array(parts: list[np.ndarray], kind: pa.DataType) -> pa.Array:
    """An Arrow list column from one NumPy array a row."""
    offsets = np.zeros(len(parts) + 1, np.int32)
    np.cumsum([len(p) for p in parts], out=offsets[1:])
    flat = np.concatenate(parts) if parts else np.zeros(0)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat, kind))
