"""Dataset profile and score trends over raw contest records (K1-K6).

Records include page sentinels: they count as records and fall into the
"Unknown" country / region buckets, but have no user and no contest.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def dataset_profile(records: DataFrame) -> DataFrame:
    """K1: records, distinct contests and users, users seen more than once
    (count and percent), sparsity = 1 - records / (users x contests)."""
    per_user = records.where(F.col("user_slug").isNotNull()).groupBy("user_slug") \
        .agg(F.count(F.lit(1)).alias("n"))
    u = per_user.agg(F.count(F.lit(1)).alias("users"),
                     F.sum((F.col("n") > 1).cast("long")).alias("repeat_users"))
    r = records.agg(F.count(F.lit(1)).alias("records"),
                    F.count_distinct("contest_id").alias("contests"))
    j = r.crossJoin(u)
    denom = F.col("users") * F.col("contests")
    return j.select(
        "records", "contests", "users", F.coalesce("repeat_users", F.lit(0)).alias("repeat_users"),
        F.when(F.col("users") > 0, 100.0 * F.col("repeat_users") / F.col("users")).otherwise(0.0)
        .alias("repeat_pct"),
        F.when(denom > 0, 1.0 - F.col("records") / denom).otherwise(0.0).alias("sparsity"))


def participation_top(records: DataFrame, n: int = 10) -> DataFrame:
    """K2: how many users took part k times; the n most common k (a top-n
    report; ties by k ascending)."""
    per_user = records.where(F.col("user_slug").isNotNull()).groupBy("user_slug") \
        .agg(F.count(F.lit(1)).alias("times"))
    h = per_user.groupBy("times").agg(F.count(F.lit(1)).alias("n_users"))
    return h.orderBy(F.col("n_users").desc(), F.col("times")).limit(n)


def score_stats(records: DataFrame) -> DataFrame:
    """K3: mean and max of non-null contest scores."""
    return records.agg(F.avg("score").alias("avg_score"), F.max("score").alias("max_score"))


def top_values(records: DataFrame, col: str, unknown: str, n: int | None = 10) -> DataFrame:
    """K4: counts of a record attribute, null or empty -> ``unknown``; most
    common first (ties by value)."""
    v = F.coalesce(F.nullif(F.col(col), F.lit("")), F.lit(unknown))
    out = records.groupBy(v.alias("value")).agg(F.count(F.lit(1)).alias("n")) \
        .orderBy(F.col("n").desc(), F.col("value"))
    return out.limit(n) if n else out


def top_languages(records: DataFrame, n: int = 10) -> DataFrame:
    """K4: submission languages exploded from the submissions maps."""
    sub_t = records.schema["submissions"].dataType.valueType
    ex = records.select(F.explode("submissions").alias("k", "s"))
    if sub_t.typeName() == "string":
        lang = F.get_json_object("s", "$.lang")
    else:
        lang = F.col("s.lang")
    ex = ex.select(F.coalesce(lang, F.lit("Unknown")).alias("value"))
    return ex.groupBy("value").agg(F.count(F.lit(1)).alias("n")) \
        .orderBy(F.col("n").desc(), F.col("value")).limit(n)


def _scored(records: DataFrame) -> DataFrame:
    return records.where(F.col("user_slug").isNotNull() & F.col("score").isNotNull()) \
        .select("user_slug", "score", F.coalesce("finish_time", F.lit(0)).alias("ft"), "contest_id")


def score_by_participation(records: DataFrame) -> DataFrame:
    """K5: users bucketed by total records (1..19, "20+"); mean of the
    users' average scores and the user count per bucket."""
    per = _scored(records).groupBy("user_slug").agg(F.count(F.lit(1)).alias("n"),
                                                    F.avg("score").alias("avg"))
    b = F.when(F.col("n") >= 20, F.lit("20+")).otherwise(F.col("n").cast("string"))
    return per.groupBy(b.alias("bucket")).agg(F.avg("avg").alias("avg_score"),
                                              F.count(F.lit(1)).alias("n_users"))


def score_by_nth_contest(records: DataFrame, max_n: int | None = None) -> DataFrame:
    """K6: mean score on each user's n-th contest (chronological by
    finish_time, then contest id); ``max_n`` bounds the report, by default
    nothing does."""
    w = Window.partitionBy("user_slug").orderBy("ft", "contest_id", "score")
    s = _scored(records).withColumn("nth", F.row_number().over(w))
    if max_n is not None:
        s = s.where(F.col("nth") <= max_n)
    return s.groupBy("nth").agg(F.avg("score").alias("avg_score"), F.count(F.lit(1)).alias("n_users"))
