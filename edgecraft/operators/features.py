"""User, problem and matrix features.

All aggregations are hash aggregates with map-side partial aggregation;
per-group medians / modes use frequency-map aggregates (``percentile``,
``mode``) so a hot user or problem is merged from partial maps rather than
collected as raw rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from edgecraft.config import DEFAULT, Config
from edgecraft.sources.jsonl import any_file


def user_tag_rates(interactions: DataFrame) -> DataFrame:
    """D2 (long form): per (user, tag) mean of solved."""
    ex = interactions.select("user_id", "solved", F.explode("tags").alias("tag"))
    return ex.groupBy("user_id", "tag").agg(F.avg(F.col("solved").cast("double")).alias("rate"))


def user_tag_scores(interactions: DataFrame) -> DataFrame:
    """``tag_scores`` map per user (size bounded by the tag vocabulary)."""
    return user_tag_rates(interactions).groupBy("user_id").agg(
        F.map_from_entries(F.sort_array(F.collect_list(F.struct("tag", "rate")))).alias("tag_scores"))


def user_features(interactions: DataFrame, with_tags: bool = True) -> DataFrame:
    """D1 (+D3 modal language, +D2 tag map)."""
    feats = interactions.groupBy("user_id").agg(
        F.count_distinct("contest_id").alias("total_contests"),
        F.count_distinct("problem_id").alias("total_problems"),
        F.sum(F.col("solved").cast("long")).alias("n_solved"),
        F.coalesce(F.avg("normalized_score"), F.lit(0.0)).alias("avg_score"),
        F.avg("user_rating").alias("avg_rating"),
        F.median("finish_time_min").alias("median_finish_time"),
        (F.sum("penalty_count").cast("double") / F.count(F.lit(1))).alias("penalty_rate"),
        F.coalesce(F.mode("language", True), F.lit("unknown")).alias("top_language"),
    ).withColumn("solve_rate", F.col("n_solved").cast("double")
                 / F.greatest(F.col("total_problems"), F.lit(1)))
    cols = ["user_id", "total_contests", "total_problems", "n_solved", "solve_rate", "avg_score",
            "avg_rating", "median_finish_time", "penalty_rate", "top_language"]
    feats = feats.select(*cols)
    if with_tags:
        feats = feats.join(user_tag_scores(interactions), "user_id", "left") \
            .withColumn("tag_scores", F.coalesce("tag_scores", F.create_map().cast("map<string,double>")))
    return feats


def difficulty_bucket(proxy: F.Column) -> F.Column:
    """D5."""
    return F.when(proxy < 0.8, "easy").when(proxy < 1.5, "medium").otherwise("hard")


def problem_features(interactions: DataFrame, problems: DataFrame) -> DataFrame:
    """D4 (+D5): one row per catalog problem, zero-filled when never attempted."""
    agg = interactions.groupBy("problem_id").agg(
        F.count(F.lit(1)).alias("n_attempts"),
        F.sum(F.col("solved").cast("long")).alias("n_solved"),
        F.avg("normalized_score").alias("avg_score"),
        F.stddev_samp("normalized_score").alias("score_std"),
        F.count("normalized_score").alias("_n_scores"),
        F.avg("finish_time_min").alias("avg_finish_time"),
        F.median("finish_time_min").alias("median_finish_time"),
        F.min("finish_time_min").alias("min_finish_time"),
        F.max("finish_time_min").alias("max_finish_time"),
        F.avg("penalty_count").alias("avg_penalty"),
        F.sum("penalty_count").alias("_pen"),
        F.avg("difficulty_proxy").alias("_proxy"),
    )
    p = problems.select("problem_id", *[c for c in ("tags", "difficulty_label", "acceptance_rate")
                                        if c in problems.columns])
    j = p.join(agg, "problem_id", "left")
    n = F.coalesce(F.col("n_attempts"), F.lit(0))
    proxy = F.coalesce(F.col("_proxy"), F.lit(1.0))
    label = F.col("difficulty_label") if "difficulty_label" in p.columns else F.lit(None).cast("string")
    acc = F.col("acceptance_rate") if "acceptance_rate" in p.columns else F.lit(None).cast("double")
    return j.select(
        "problem_id",
        F.coalesce(label, F.lit("unknown")).alias("difficulty_label"),
        difficulty_bucket(proxy).alias("difficulty_bucket"),
        F.coalesce(F.col("tags"), F.array().cast("array<string>")).alias("tags")
        if "tags" in p.columns else F.array().cast("array<string>").alias("tags"),
        F.coalesce(acc.cast("double"), F.lit(0.0)).alias("acceptance_rate"),
        n.alias("n_attempts"),
        F.coalesce(F.col("n_solved"), F.lit(0)).alias("n_solved"),
        (F.coalesce(F.col("n_solved"), F.lit(0)).cast("double") / F.greatest(n, F.lit(1))).alias("solve_rate"),
        F.coalesce(F.col("avg_score"), F.lit(0.0)).alias("avg_score"),
        F.when(F.col("_n_scores") > 1, F.col("score_std")).otherwise(F.lit(0.0)).alias("score_std"),
        "avg_finish_time", "median_finish_time", "min_finish_time", "max_finish_time",
        "avg_penalty",
        (F.coalesce(F.col("_pen"), F.lit(0)).cast("double") / F.greatest(n, F.lit(1))).alias("penalty_rate"),
        proxy.alias("avg_difficulty_proxy"),
    )


def tag_vocabulary(problems: DataFrame) -> DataFrame:
    """Sorted distinct tags with a dense index (one row per tag)."""
    tags = problems.select(F.explode("tags").alias("tag")).distinct()
    # the vocabulary is tiny (tens of tags); the window over it is bounded
    return tags.select("tag", (F.dense_rank().over(Window.orderBy("tag")) - 1).alias("tag_idx"))


def tag_vectors(problems: DataFrame) -> DataFrame:
    """0/1 multi-hot vector per problem in sorted-vocabulary order.

    The vocabulary is gathered into one array (bounded by the number of
    distinct tags) and broadcast as a one-row table.
    """
    vocab = problems.select(F.explode("tags").alias("tag")).agg(
        F.sort_array(F.collect_set("tag")).alias("vocab"))
    j = problems.select("problem_id", "tags").crossJoin(F.broadcast(vocab))
    return j.select("problem_id", F.transform("vocab", lambda t: F.when(
        F.array_contains(F.coalesce("tags", F.array().cast("array<string>")), t), 1.0)
        .otherwise(0.0)).alias("tag_vector"))


def tag_index_lists(problems: DataFrame) -> DataFrame:
    """D6, sparse: per problem the sorted places of its tags in the vocabulary (at
    most one a tag), with the vocabulary size; the 0/1 vector has ones there."""
    vocab = tag_vocabulary(problems)
    size = vocab.agg(F.count(F.lit(1)).alias("size"))
    at = problems.select("problem_id", F.explode(F.array_distinct("tags")).alias("tag")).join(vocab, "tag") \
        .groupBy("problem_id").agg(F.sort_array(F.collect_set("tag_idx")).alias("indices"))
    return problems.select("problem_id").join(at, "problem_id", "left").crossJoin(F.broadcast(size)) \
        .select("problem_id", "size", F.coalesce("indices", F.array().cast("array<int>")).alias("indices"))


def problem_tags(problems: DataFrame) -> DataFrame:
    """Exploded (problem_id, tag) relation, distinct — the sparse form of D6."""
    return problems.select("problem_id", F.explode(F.array_distinct("tags")).alias("tag")).distinct()


def user_tag_preferences(interactions: DataFrame) -> DataFrame:
    """D8 (sparse): per user and tag, count over solved rows / solved rows."""
    solved = interactions.where(F.col("solved"))
    n = solved.groupBy("user_id").agg(F.count(F.lit(1)).alias("n_solved_rows"))
    per = solved.select("user_id", F.explode("tags").alias("tag")).groupBy("user_id", "tag") \
        .agg(F.count(F.lit(1)).alias("cnt"))
    return per.join(n, "user_id").select(
        "user_id", "tag", (F.col("cnt").cast("double") / F.col("n_solved_rows")).alias("preference"))


def id_map(df: DataFrame, col: str, idx_col: str, key: F.Column | None = None) -> DataFrame:
    """Dense 0-based integer index per distinct value.

    Order is by ``key`` (a long expression, default a 64-bit hash of the
    value) with the value itself breaking ties, so the index is dense and
    deterministic; for hex user ids, ``hex_key`` gives alphabetical order.
    Positions come from bucket counts and prefix sums (``dense_positions``).
    """
    from edgecraft.operators.tiers import dense_positions
    k = F.xxhash64(F.col(col)) if key is None else key
    d = df.select(col).distinct().withColumn("_key", k)
    width = 1 << 44 if key is None else 1 << 36
    return dense_positions(d, "_key", idx_col, width=width, tiebreak=(col,)) \
        .select(col, F.col(idx_col).cast("int").alias(idx_col))


def hex_key(col: str, digits: int = 15) -> F.Column:
    """Leading hex digits of an id as a long (order = alphabetical order)."""
    return F.conv(F.substring(col, 1, digits), 16, 10).cast("long")


def text_key(col: str, skip: int = 0) -> F.Column:
    """The seven bytes after ``skip`` characters as a long (order = byte order);
    longer common starts are told apart by the tie-break of ``id_map``."""
    return F.conv(F.hex(F.rpad(F.substring(col, skip + 1, 7), 7, " ")), 16, 10).cast("long")


def interaction_matrix(interactions: DataFrame, users: DataFrame, items: DataFrame,
                       score_column: str = "normalized_score",
                       include_unsolved: bool = False) -> DataFrame:
    """COO entries (user_idx, problem_idx, value); duplicates are summed."""
    src = interactions if include_unsolved else interactions.where(F.col("solved"))
    j = src.select("user_id", "problem_id", F.col(score_column).cast("double").alias("v")) \
        .join(users, "user_id").join(items, "problem_id")
    return j.groupBy("user_idx", "problem_idx").agg(F.sum("v").cast("float").alias("value"))


def matrix_density(interactions: DataFrame, include_unsolved: bool = False) -> DataFrame:
    """D9 summary: nnz, shape and density in percent (one row)."""
    src = interactions if include_unsolved else interactions.where(F.col("solved"))
    nnz = src.select("user_id", "problem_id").distinct().agg(F.count(F.lit(1)).alias("nnz"))
    shape = interactions.agg(F.count_distinct("user_id").alias("n_users"),
                             F.count_distinct("problem_id").alias("n_problems"))
    return nnz.crossJoin(shape).withColumn(
        "density_pct", 100.0 * F.col("nnz") / (F.col("n_users") * F.col("n_problems")))


def bias_terms(interactions: DataFrame, score_column: str = "normalized_score"):
    """(global_mean one-row table, user_biases, item_biases)."""
    mu = interactions.agg(F.avg(score_column).alias("global_mean"))
    ub = interactions.groupBy("user_id").agg(F.avg(score_column).alias("_m")) \
        .crossJoin(F.broadcast(mu)).select("user_id", (F.col("_m") - F.col("global_mean")).alias("bias"),
                                            "global_mean")
    ib = interactions.groupBy("problem_id").agg(F.avg(score_column).alias("_m")) \
        .crossJoin(F.broadcast(mu)).select("problem_id", (F.col("_m") - F.col("global_mean")).alias("bias"))
    return mu, ub, ib


def user_problem_rollup(interactions: DataFrame) -> DataFrame:
    """Per (user, problem) attempt statistics."""
    return interactions.groupBy("user_id", "problem_id").agg(
        F.count("contest_id").alias("n_attempts"),
        F.sum(F.col("solved").cast("long")).alias("n_solved"),
        F.avg("normalized_score").alias("avg_score"),
        F.avg("finish_time_min").alias("avg_finish_time"),
        F.avg("penalty_count").alias("avg_penalty"),
        F.max("normalized_score").alias("max_score"),
    ).withColumn("solve_rate", F.col("n_solved").cast("double") / F.col("n_attempts"))


def adjacency_lists(interactions: DataFrame):
    """User -> [problems] and problem -> [users] (duplicates kept, sorted)."""
    u = interactions.groupBy("user_id").agg(F.sort_array(F.collect_list("problem_id")).alias("problems"))
    p = interactions.groupBy("problem_id").agg(F.sort_array(F.collect_list("user_id")).alias("users"))
    return u, p


def adjacency_chunks(interactions: DataFrame, width: int = 1024) -> tuple[DataFrame, DataFrame]:
    """C6 in bounded rows: (user_id, chunk, problems) and (problem_id, chunk, users).

    The neighbours of an id get dense places (bucket counts and prefix sums), and a chunk holds at most ``width`` of them, sorted; chunks
    in order are the sorted list of :func:`adjacency_lists`, duplicates kept.  No
    list or task holds all users of a hot problem."""
    def chunks(key: str, other: str, out: str) -> DataFrame:
        rank = id_map(interactions, other, "_place", text_key(other))
        rows = interactions.select(key, other).join(rank, other)
        counts = rows.groupBy(key, other, "_place").agg(F.count(F.lit(1)).alias("_n"))
        # places before a bucket of neighbours come from bucket sums, inside it from a window over the bucket
        bucketed = counts.withColumn("_b", F.floor(F.col("_place") / width))
        upto = Window.partitionBy(key).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
        before = bucketed.groupBy(key, "_b").agg(F.sum("_n").alias("_s")) \
            .select(key, "_b", F.coalesce(F.sum("_s").over(upto), F.lit(0)).alias("_before"))
        inside = Window.partitionBy(key, "_b").orderBy("_place").rowsBetween(Window.unboundedPreceding, -1)
        placed = bucketed.withColumn("_in", F.coalesce(F.sum("_n").over(inside), F.lit(0))).join(before, [key, "_b"]) \
            .select(key, other, (F.col("_before") + F.col("_in")).alias("_at"), "_n")
        each = placed.select(key, other, F.explode(F.sequence(F.col("_at"), F.col("_at") + F.col("_n") - 1)).alias("_at"))
        return each.groupBy(key, F.floor(F.col("_at") / width).cast("long").alias("chunk")) \
            .agg(F.sort_array(F.collect_list(other)).alias(out))

    return chunks("user_id", "problem_id", "problems"), chunks("problem_id", "user_id", "users")


NUMERIC = (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.FloatType, T.DoubleType,
           T.DecimalType)


def numeric_feature_matrix(df: DataFrame, id_col: str, out_col: str = "features") -> DataFrame:
    """Numeric columns only, assembled into a vector (nulls kept as NaN)."""
    from pyspark.ml.feature import VectorAssembler
    cols = [f.name for f in df.schema.fields if isinstance(f.dataType, NUMERIC)]
    if not cols:
        return df.select(id_col)
    va = VectorAssembler(inputCols=cols, outputCol=out_col, handleInvalid="keep")
    return va.transform(df.select(id_col, *[F.col(c).cast("double") for c in cols])).select(id_col, out_col)


class FeatureStore:
    """Lazy access to the stored tables; a feature table that does not
    exist gives an empty DataFrame with its key column.  Any other failure to
    read is raised."""

    KEYS = {"user_features": "user_id string", "problem_features": "problem_id string"}

    def __init__(self, spark, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self._cache: dict[str, DataFrame] = {}

    def _load(self, name: str, required: bool) -> DataFrame:
        if name not in self._cache:
            path = f"{self.root}/{name}.parquet"
            if any_file(self.spark, path):
                self._cache[name] = self.spark.read.parquet(path)
            elif required:
                raise FileNotFoundError(path)
            else:
                self._cache[name] = self.spark.createDataFrame([], self.KEYS[name])
        return self._cache[name]

    @property
    def interactions(self) -> DataFrame:
        return self._load("interactions", True)

    @property
    def user_features(self) -> DataFrame:
        return self._load("user_features", False)

    @property
    def problem_features(self) -> DataFrame:
        return self._load("problem_features", False)
