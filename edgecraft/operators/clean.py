"""Explode, derive, join and clean contest submissions.

Shuffle plan of the full chain (``clean_interactions``):
  * contest-level stats (distinct users, start time) are one partial/final
    aggregate by ``contest_id``; the result has one row per contest (a
    calendar-bounded count) and is broadcast back;
  * the duplicate-key rule counts the keys alone: the few keys that occur more
    than once are met with the joined rows, so the rows are not shuffled for it
    (``keep='first'`` carries the row through the aggregate instead);
  * the 0.9 quantile and the medians are exact ``percentile`` aggregates over
    value histograms (distinct finish minutes / penalty counts), so only
    bounded maps reach the final one-row aggregate; the histograms and the
    main output share the same upstream exchange (Spark reuses it).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from edgecraft.config import DEFAULT, Config
from edgecraft.functions.exprs import clip, hash_user_id, tags_from_string
from edgecraft.sources.jsonl import CORRUPT, SUBMISSION_SCHEMA, once

INTERACTION_COLUMNS = [
    "user_id", "contest_id", "problem_id", "solved", "finish_time_min",
    "penalty_count", "language", "user_rating", "rank_percentile",
    "difficulty_proxy", "normalized_score", "tags",
]


def _rank_as_int(rank_col, dtype) -> F.Column:
    if isinstance(dtype, T.StringType):
        return F.col(rank_col).try_cast("double").cast("int")
    return F.col(rank_col).cast("int")


def explode_records(records: DataFrame) -> DataFrame:
    """B1: one row per submissions entry.

    Records with an empty map, a missing/empty slug or a missing contest give
    nothing; a non-object submission value is skipped.  ``solved`` means zero
    failed attempts.
    """
    if CORRUPT in records.columns:
        records = records.where(F.col(CORRUPT).isNull())
    sub_type = records.schema["submissions"].dataType.valueType
    rank_type = records.schema["rank"].dataType
    base = records.where(
        F.col("user_slug").isNotNull() & (F.col("user_slug") != "")
        & F.col("contest_id").isNotNull()
        & (F.coalesce(F.size("submissions"), F.lit(0)) > 0))
    ex = base.select("user_slug", F.col("contest_id").cast("string").alias("contest_id"),
                     _rank_as_int("rank", rank_type).alias("rank"),
                     F.explode("submissions").alias("frontend_id", "sub"))
    if isinstance(sub_type, T.StringType):
        # only a missing "lang" is unknown; an explicit null stays null
        ex = ex.where(F.ltrim(F.col("sub")).startswith("{")) \
            .withColumn("_p", once(F.struct(F.from_json("sub", SUBMISSION_SCHEMA).alias("sub"),
                                            F.array_contains(F.json_object_keys("sub"), "lang").alias("_lang")))) \
            .select("user_slug", "contest_id", "rank", "frontend_id", "_p.sub", "_p._lang")
    else:
        ex = ex.withColumn("_lang", F.col("sub.lang").isNotNull())
    ex = ex.where(F.col("sub").isNotNull())
    fail = F.coalesce(F.col("sub.fail_count").cast("int"), F.lit(0))
    return ex.select(
        "user_slug", "contest_id",
        F.col("frontend_id").cast("string").alias("frontend_id"),
        fail.alias("penalty_count"),
        F.when(F.col("_lang"), F.col("sub.lang")).otherwise(F.lit("unknown")).alias("language"),
        F.col("sub.date").cast("bigint").alias("submission_date"),
        (fail == 0).alias("solved"),
        "rank",
    )


def contest_stats(rows: DataFrame) -> DataFrame:
    """Distinct users and inferred start time per contest (B2/B3 inputs)."""
    return rows.groupBy("contest_id").agg(
        F.count_distinct("user_slug").alias("n_users"),
        F.coalesce(F.min("submission_date"), F.lit(0)).alias("contest_start"))


def derive_contest_columns(rows: DataFrame) -> DataFrame:
    """B2 rank percentile, B3 finish minutes, B4 per-attempt score.

    The contest table holds one row per contest, so it is broadcast.
    """
    stats = F.broadcast(contest_stats(rows))
    j = rows.join(stats, "contest_id")
    pct = F.when(F.col("rank").isNull() | (F.col("rank") <= 0), F.lit(0.5)) \
        .otherwise(1.0 - F.col("rank").cast("double") / F.greatest(F.col("n_users"), F.lit(1)))
    finish = F.when(F.col("contest_start") > 0,
                    F.round((F.col("submission_date") - F.col("contest_start")).cast("double") / 60.0, 2))
    score = F.when(F.col("penalty_count") > 0, 1.0 / (1.0 + F.col("penalty_count").cast("double"))) \
        .otherwise(F.col("solved").cast("double"))
    return j.select(*[c for c in rows.columns], pct.alias("rank_percentile"),
                    finish.alias("finish_time_min"), score.alias("normalized_score"))


def join_catalog(rows: DataFrame, catalog: DataFrame) -> DataFrame:
    """Inner join on frontend_id (rows without a catalog entry drop)."""
    cat = catalog.select("frontend_id", "problem_id", "title", "tags")
    return rows.join(cat, "frontend_id")


def dropped_by_catalog(rows: DataFrame, catalog: DataFrame) -> DataFrame:
    """B6 drop report: rows with no catalog match."""
    return rows.join(catalog.select("frontend_id"), "frontend_id", "left_anti")


def problems_clean(catalog: DataFrame) -> DataFrame:
    """B6 second output: catalog distinct on problem_id."""
    return catalog.select("problem_id", "title", "tags").dropDuplicates(["problem_id"])


def drop_duplicate_keys(df: DataFrame, keys: list[str], keep: str = "none") -> DataFrame:
    """Drop every copy of a duplicated key (``keep='none'``), or keep the
    first by the remaining columns (``keep='first'``).

    One hash aggregate that carries the row as a struct; no window sort.
    """
    rest = [c for c in df.columns if c not in keys]
    agg = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"),
                                F.min(F.struct(*rest)).alias("_r"))
    if keep == "none":
        agg = agg.where(F.col("_n") == 1)
    return agg.select(*keys, "_r.*").select(*df.columns)


def without_repeated_keys(df: DataFrame, keys: list[str], materialize=None) -> DataFrame:
    """B7 with ``keep='none'``, for rows that can be read twice: the repeated keys
    are found by a count of the keys and anti-joined (null keys are equal)."""
    twice = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > 1) \
        .select(*[F.col(k).alias("_" + k) for k in keys])
    if materialize is not None:
        twice = materialize(twice)
    on = [F.col(k).eqNullSafe(F.col("_" + k)) for k in keys]
    return df.join(twice, on, "left_anti")


def scalar_quantiles(df: DataFrame, cfg: Config = DEFAULT) -> DataFrame:
    """One-row table: finish-time cap (0.9 quantile), median finish after the
    cap, and median penalty — exact, linear interpolation.

    Each quantile reads a histogram (value, count) that is itself a
    distributed partial/final aggregate, so the final single-task step only
    sees distinct values.
    """
    fin = df.where(F.col("finish_time_min").isNotNull()) \
        .groupBy("finish_time_min").agg(F.count(F.lit(1)).alias("n"))
    cap = fin.agg(F.percentile("finish_time_min", F.lit(cfg.finish_cap_quantile), F.col("n"))
                  .alias("finish_cap"))
    capped = fin.crossJoin(F.broadcast(cap)).select(
        F.least("finish_time_min", "finish_cap").alias("v"), "n")
    med_t = capped.agg(F.percentile("v", F.lit(0.5), F.col("n")).alias("median_time"))
    pen = df.groupBy("penalty_count").agg(F.count(F.lit(1)).alias("n")) \
        .agg(F.percentile("penalty_count", F.lit(0.5), F.col("n")).alias("median_penalty"))
    return cap.crossJoin(med_t).crossJoin(pen)


def difficulty_proxy(finish: F.Column, penalty: F.Column, med_t: F.Column, med_p: F.Column,
                     cfg: Config = DEFAULT) -> F.Column:
    """Null finish -> 2.0, else clip((t/max(medT,1) + p/max(medP,1)) / 2)."""
    raw = (finish / F.greatest(med_t, F.lit(1.0))
           + penalty.cast("double") / F.greatest(med_p, F.lit(1.0))) / 2.0
    return F.when(finish.isNull(), F.lit(cfg.missing_finish_proxy)) \
        .otherwise(clip(raw, cfg.proxy_min, cfg.proxy_max))


def clean_interactions(exploded: DataFrame, catalog: DataFrame,
                       cfg: Config = DEFAULT, keep: str = "none",
                       extra: tuple[str, ...] = (), materialize=None) -> DataFrame:
    """B2-B13 on exploded rows -> the 12-column interactions table.

    ``materialize`` (e.g. a table in the checkpoint folder) is applied to the
    exploded rows (read by the contest statistics and the main path), to the
    joined rows (read by the key count, three quantile histograms and the final
    projection) and to the repeated keys, so the source is parsed once.
    """
    keys = ["user_slug", "problem_id", "contest_id"]
    if materialize is not None:
        exploded = materialize(exploded)
    rows = join_catalog(derive_contest_columns(exploded), catalog)
    if keep == "none":
        carried = {*keys, "user_rating", *INTERACTION_COLUMNS, *extra}
        rows = rows.select(*[c for c in rows.columns if c in carried])
    else:
        rows = drop_duplicate_keys(rows, keys, keep=keep)
    rows = rows.withColumn("user_id", hash_user_id("user_slug", cfg.user_salt)) \
        .withColumn("user_rating", F.col("rank_percentile") * cfg.rating_scale)
    if materialize is not None:
        rows = materialize(rows)
    if keep == "none":
        rows = without_repeated_keys(rows, keys, materialize)
    q = F.broadcast(scalar_quantiles(rows, cfg))
    j = rows.crossJoin(q)
    finish = F.when(F.col("finish_time_min") > F.col("finish_cap"), F.col("finish_cap")) \
        .otherwise(F.col("finish_time_min"))
    med_t = F.coalesce(F.nullif(F.col("median_time"), F.lit(0.0)), F.lit(cfg.default_median_time))
    med_p = F.coalesce(F.nullif(F.col("median_penalty"), F.lit(0.0)),
                       F.lit(cfg.default_median_penalty))
    j = j.withColumn("finish_time_min", finish) \
        .withColumn("difficulty_proxy", difficulty_proxy(F.col("finish_time_min"),
                                                         F.col("penalty_count"), med_t, med_p, cfg))
    j = j.dropna(subset=["user_id", "contest_id", "problem_id", "solved"])
    return j.select(*INTERACTION_COLUMNS, *extra)


def normalise_tags(df: DataFrame, col: str = "tags") -> DataFrame:
    """Null -> [], stringified list -> parsed list, array kept."""
    dtype = df.schema[col].dataType
    if isinstance(dtype, T.StringType):
        parsed = F.coalesce(tags_from_string(F.col(col)), F.array().cast("array<string>"))
    else:
        parsed = F.coalesce(F.col(col).cast("array<string>"), F.array().cast("array<string>"))
    return df.withColumn(col, parsed)


def normalise_tag_scores(df: DataFrame, col: str = "tag_scores") -> DataFrame:
    """Stringified ``{'tag': 0.5}`` -> map<string,double>; null -> {}."""
    dtype = df.schema[col].dataType
    empty = F.create_map().cast("map<string,double>")
    if isinstance(dtype, T.StringType):
        parsed = F.from_json(F.regexp_replace(F.col(col), "'", '"'), "map<string,double>")
        return df.withColumn(col, F.coalesce(parsed, empty))
    return df.withColumn(col, F.coalesce(F.col(col), empty))
