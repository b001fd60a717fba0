"""Materialisation points.

A DataFrame read by several later branches (a global scalar applied back to
its own rows, or a cleaned table feeding many operators) is written once
with a reliable ``checkpoint()`` into the shared folder named by
``spark.checkpoint.dir``; that cuts the lineage, so a lost executor re-reads
the files instead of re-running the upstream job.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from edgecraft.session import checkpoint_dir

_MEMO: dict[tuple, DataFrame] = {}


def materialize(df: DataFrame) -> DataFrame:
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def table(df: DataFrame) -> DataFrame:
    """Like :func:`materialize`, as a Parquet table in the same folder: readers take
    only the columns they need.  For tables of narrow rows (Parquet is read in
    batches of rows, so rows of long arrays are better left to ``materialize``)."""
    path = f"{checkpoint_dir(df.sparkSession).rstrip('/')}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def file_version(spark: SparkSession, folder: str) -> tuple:
    """Sizes and times of what lies in a folder, so that changed inputs are built anew."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    fs = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return tuple(sorted((f.getPath().getName(), f.getLen(), f.getModificationTime()) for f in fs.listStatus(path)))


def memo(spark: SparkSession, key: tuple, build, folder: str | None = None) -> DataFrame:
    """One materialised table per (session, key, state of the input folder)."""
    k = (id(spark.sparkContext._jsc), spark.sparkContext.applicationId) + key \
        + (file_version(spark, folder) if folder else ())
    if k not in _MEMO:
        _MEMO[k] = table(build())
    return _MEMO[k]


def clear() -> None:
    _MEMO.clear()
