"""Helpers shared by the training-data operators: staging, reading, Arrow slices."""

from __future__ import annotations

import contextlib
import tempfile
import uuid
import weakref
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text that one NumPy pass of an operator holds; a longer document is a group of its own.
GROUP_BYTES = 1 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, from ``spark.checkpoint.dir``.

    Only where the setting is absent (tests on one machine) a temporary folder is used.
    """
    sc = spark.sparkContext
    path = sc.getConf().get("spark.checkpoint.dir")
    if path:
        return path.rstrip("/")
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="framelens-"))
    return sc.getCheckpointDir().rstrip("/")


_PATHS: weakref.WeakKeyDictionary[DataFrame, str] = weakref.WeakKeyDictionary()
_scopes: list[list[DataFrame]] = []
#: Spark's setting by which an execution removes its shuffle files when it ends.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def stage(df: DataFrame, name: str) -> DataFrame:
    """Write a table to the shared folder and read it again: cuts lineage, survives lost executors.

    The shuffle files that made the table go when it is written; the table itself goes by ``unstage``
    or with the ``staging`` scope it was made in.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    before = spark.conf.get(_CLEANUP, "false")
    spark.conf.set(_CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(_CLEANUP, before)
    out = spark.read.schema(df.schema).parquet(path)
    _PATHS[out] = path
    for scope in _scopes[-1:]:
        scope.append(out)
    return out


def unstage(*tables: DataFrame) -> None:
    """Remove staged tables that nothing will read any more."""
    for df in tables:
        if path := _PATHS.pop(df, None):
            jvm = df.sparkSession.sparkContext._jvm
            at = jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(df.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def keep(df: DataFrame) -> DataFrame:
    """A staged table that outlives the scope it was made in: it goes with the next outer one, if there is one."""
    for i, scope in enumerate(_scopes):
        if any(x is df for x in scope):
            scope[:] = [x for x in scope if x is not df]
            if i:
                _scopes[i - 1].append(df)
            break
    return df


@contextlib.contextmanager
def staging():
    """All tables staged within are removed at the end, but those kept: write an operator's result before that."""
    _scopes.append([])
    try:
        yield
    finally:
        unstage(*_scopes.pop())


def text_or_empty(name: str = "text"):
    return F.coalesce(F.col(name), F.lit(""))


def text_buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a string column and its offsets (nulls are empty)."""
    _, offsets, data = column.buffers()
    if not len(column) or offsets is None:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    at = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1]
    return (np.zeros(0, np.uint8) if data is None else np.frombuffer(data, np.uint8)), at.astype(np.int64)


def text_groups(batch: pa.RecordBatch, column: str = "text", size: int = GROUP_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of a batch with at most ``size`` bytes of text, or one row."""
    _, at = text_buffers(batch.column(batch.schema.get_field_index(column)))
    lo = 0
    while lo < batch.num_rows:
        hi = max(lo + 1, int(np.searchsorted(at, at[lo] + size, "right")) - 1)
        yield batch.slice(lo, hi - lo)
        lo = hi


def ranges(first: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The concatenation of ``arange(f, f + c)``."""
    total = int(counts.sum())
    if not total:
        return np.zeros(0, np.int64)
    ends = np.cumsum(counts)
    return np.arange(total, dtype=np.int64) - np.repeat(ends - counts - first, counts)
