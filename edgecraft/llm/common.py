"""Helpers shared by the training-data operators."""

from __future__ import annotations

import uuid
from collections.abc import Iterable, Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from edgecraft.session import checkpoint_dir

DOCUMENT_COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def checkpoint(df: DataFrame) -> DataFrame:
    """Write ``df`` once to the shared folder of ``spark.checkpoint.dir`` and
    read it from there, so that a lost executor costs a re-read and not the
    upstream work, and later jobs do not repeat it."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def table(df: DataFrame) -> DataFrame:
    """The same as a Parquet table in that folder, whose size is that of its files.
    A checkpoint keeps the size estimate of its plan, and joins multiply those: in
    a loop of joins they grow to numbers that take longer to work out than the job."""
    path = f"{checkpoint_dir(df.sparkSession).rstrip('/')}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def fold(doc_id: Column) -> Column:
    """crc32 of the id as text, modulo 5 (null ids: null)."""
    return F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(5))


def texts_of(batch: pa.RecordBatch, column: str = "text") -> list[str]:
    """The texts of a batch; null reads as empty."""
    return [t or "" for t in batch.column(batch.schema.get_field_index(column)).to_pylist()]


def sliced(batches: Iterable[pa.RecordBatch], column: str = "text",
           target: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """Cut Arrow batches into runs of rows of about ``target`` text bytes, so
    that numpy temporaries stay small however long the texts are."""
    for rb in batches:
        n = rb.num_rows
        if not n:
            continue
        size = pc.fill_null(pc.binary_length(rb.column(rb.schema.get_field_index(column))), 0)
        end = np.cumsum(size.to_numpy(zero_copy_only=False).astype(np.int64))
        i = 0
        while i < n:
            base = end[i - 1] if i else 0
            j = max(i + 1, int(np.searchsorted(end, base + target, side="right")))
            yield rb.slice(i, j - i)
            i = j


def squeeze(vec: np.ndarray) -> bytes:
    """A vector of counts, compressed (length first)."""
    raw = vec.tobytes()
    return len(raw).to_bytes(8, "little") + pa.compress(raw, codec="zstd", asbytes=True)


def expand(blob: bytes, dtype: str = "int64") -> np.ndarray:
    raw = pa.decompress(blob[8:], decompressed_size=int.from_bytes(blob[:8], "little"), codec="zstd", asbytes=True)
    return np.frombuffer(raw, dtype)


def sum_blobs(df: DataFrame, keys: list[str], dtype: str = "int64") -> DataFrame:
    """Add up equal-length numpy vectors held in the binary column ``vec``
    (:func:`squeeze`) by ``keys`` (row layout: keys, ``task`` int, ``vec``).
    Two levels, 64 tasks at a time, so that no group holds the vectors of
    every task."""
    schema = T.StructType([df.schema[k] for k in keys] + [T.StructField("task", T.IntegerType()),
                                                         T.StructField("vec", T.BinaryType())])

    def add(pdf):
        total = expand(pdf["vec"].iloc[0], dtype).copy()
        for b in pdf["vec"].iloc[1:]:
            total += expand(b, dtype)
        out = pdf.iloc[:1].copy()
        out["vec"] = [squeeze(total)]
        return out[keys + ["task", "vec"]]

    first = (df.select(*keys, F.floor(F.col("task") / 64).cast("int").alias("task"), "vec")
             .groupBy(*keys, "task").applyInPandas(add, schema))
    return first.groupBy(*keys).applyInPandas(add, schema).drop("task")


def task_id() -> int:
    from pyspark import TaskContext
    ctx = TaskContext.get()
    return ctx.partitionId() if ctx else 0


def broadcast_if_small(df: DataFrame, rows: int, row_bytes: int, limit_mb: int = 32) -> DataFrame:
    """Broadcast hint behind a size check: ``rows`` is the counted number of
    rows.  Beyond the limit the join is left to Spark (sort-merge)."""
    return F.broadcast(df) if rows * row_bytes <= limit_mb << 20 else df


@contextmanager
def sorted_joins(spark: SparkSession):
    """Inside, joins without a hint of their own are not turned into broadcasts:
    a job of many small steps would build a relation on the driver for each."""
    key = "spark.sql.autoBroadcastJoinThreshold"
    before = spark.conf.get(key)
    spark.conf.set(key, "-1")
    try:
        yield
    finally:
        spark.conf.set(key, before)
