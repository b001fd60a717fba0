"""Parquet table access (A6, A7) with explicit projections so Catalyst prunes
columns at the scan."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession


def table_path(sf_dir: str, name: str) -> str:
    return os.path.join(sf_dir, f"{name}.parquet")


def read_table(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    df = spark.read.parquet(table_path(sf_dir, name))
    return df.select(*columns) if columns else df


def write_parquet(df: DataFrame, path: str, sort_within: list[str] | None = None,
                  partition_by: list[str] | None = None) -> None:
    """Overwrite ``path`` (parents are created by the writer).

    ``sort_within`` sorts inside each output partition only (no global sort),
    which keeps row-group min/max statistics tight for later pushdown.
    """
    if sort_within:
        df = df.sortWithinPartitions(*sort_within)
    w = df.write.mode("overwrite")
    if partition_by:
        w = w.partitionBy(*partition_by)
    w.parquet(path)


def known_user_ids(spark: SparkSession, interactions_path: str) -> DataFrame:
    """Only ``user_id`` is read from the interactions table."""
    return spark.read.parquet(interactions_path).select("user_id").distinct()
