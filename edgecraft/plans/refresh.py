"""A stored candidate pool that is refreshed where users have changed.

A snapshot keeps one digest of each user's history.  A refresh compares it with
the present histories, scores the users of the buckets in which anyone changed,
appeared or went, writes those buckets into a folder of their own and commits a
manifest that names the folder of every bucket.  Without changes nothing is
written.  A change of ``context`` (catalog, models, configuration: any text that
tells them apart) refreshes all buckets.
"""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from edgecraft.plans import manifest

BUCKETS = 16


def bucket_of(user_id: str = "user_id", buckets: int = BUCKETS):
    return F.pmod(F.xxhash64(user_id), F.lit(buckets)).cast("int")


def history_digests(history: DataFrame, columns: list[str], buckets: int = BUCKETS) -> DataFrame:
    """``user_id, bucket, digest``: sums over each user's rows, in any order."""
    row = F.struct(*[F.col(c) for c in columns])
    return history.groupBy("user_id").agg(
        F.sum(F.xxhash64(row).cast("decimal(38,0)")).alias("a"), F.count(F.lit(1)).alias("n")) \
        .select("user_id", bucket_of(buckets=buckets).alias("bucket"), F.concat_ws("-", "a", "n").alias("digest"))


def refresh(spark: SparkSession, history: DataFrame, score: Callable[[DataFrame], DataFrame], root: str,
            columns: list[str], context: str = "", buckets: int = BUCKETS) -> list[int]:
    """Bring the pool in ``root`` up to date; returns the buckets written.
    ``score`` gives the pool rows (with ``user_id``) of a table of users."""
    now = history_digests(history, columns, buckets)
    last = manifest.latest(spark, root)
    if last is None or last["context"] != context or last["buckets"] != buckets:
        stale, kept = list(range(buckets)), {}
    else:
        before = spark.read.parquet(f"{root}/{last['snapshot']}").select("user_id", F.col("digest").alias("was"))
        changed = now.join(before, "user_id", "full").where(~F.col("digest").eqNullSafe(F.col("was")))
        stale = sorted(r.b for r in changed.select(bucket_of(buckets=buckets).alias("b")).distinct().collect())
        kept = {b: f for b, f in last["folders"].items() if int(b) not in stale}
    if not stale:
        return []
    version = manifest.new_version()
    folder, snapshot = f"pool/{version}", f"snapshots/{version}"
    now.write.parquet(f"{root}/{snapshot}")
    users = spark.read.parquet(f"{root}/{snapshot}").where(F.col("bucket").isin(stale)).select("user_id")
    rows = score(users)
    schema = json.loads(rows.schema.json())
    rows = rows.withColumn("bucket", bucket_of(buckets=buckets))
    rows.repartition("bucket").sortWithinPartitions("bucket", "user_id").write.partitionBy("bucket").parquet(f"{root}/{folder}")
    manifest.commit(spark, root, {"context": context, "buckets": buckets, "snapshot": snapshot, "schema": schema,
                                  "folders": kept | {str(b): folder for b in stale}})
    return stale


def read_pool(spark: SparkSession, root: str) -> DataFrame:
    """The rows of the last committed refresh."""
    m = manifest.latest(spark, root)
    folders: dict[str, list[int]] = {}
    for b, folder in m["folders"].items():
        folders.setdefault(folder, []).append(int(b))
    schema, out = T.StructType.fromJson(m["schema"]), None
    stored = T.StructType([*schema.fields, T.StructField("bucket", T.IntegerType())])
    for folder, own in sorted(folders.items()):
        part = spark.read.schema(stored).parquet(f"{root}/{folder}").where(F.col("bucket").isin(own)).drop("bucket")
        out = part if out is None else out.unionByName(part)
    return out
