"""Model-free scoring operators.

A "batch" is the reference's per-request candidate list: here every batch is
a group of rows sharing ``batch`` columns (normally ``user_id``) with an
``order_col`` giving the list position.  Per-batch statistics are computed by
one aggregate and joined back, so every user is scored at once.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from edgecraft.config import DEFAULT, Config
from edgecraft.functions.exprs import clip
from edgecraft.operators.factor_dots import factor_dots


# ------------------------------------------------------------------ F3 ALS dot


def als_raw_scores(pairs: DataFrame, user_factors: DataFrame, item_factors: DataFrame,
                   unknown_user: float = 0.25) -> DataFrame:
    """dot(user factors, item factors); unknown user -> 0.25 for every
    item; known user with unknown item -> 0.0.

    Factor tables are (id, features array); pairs meet them in cells
    (:func:`edgecraft.operators.factor_dots.factor_dots`).
    """
    s = F.when(~F.col("_known_user"), F.lit(unknown_user)) \
        .when(~F.col("_known_item"), F.lit(0.0)).otherwise(F.col("_dot"))
    return factor_dots(pairs, user_factors, item_factors) \
        .withColumn("als_raw", s.cast("double")).drop("_dot", "_known_user", "_known_item")


# --------------------------------------------------------------- F4/F5 content


def content_profiles(interactions: DataFrame, problem_tags: DataFrame, problems: DataFrame) -> DataFrame:
    """F4 (sparse): per (user, tag), the score-weighted share of solved rows
    whose problem carries the tag.  Solved problems of the catalog
    (``problems``) without a tag count in the divisor.  Users with no solved
    row have no entries (the zero profile)."""
    solved = interactions.where(F.col("solved")).select(
        "user_id", "problem_id", F.col("normalized_score").cast("double").alias("w"))
    known = solved.join(problems.select("problem_id").distinct(), "problem_id", "left_semi")
    tot = known.groupBy("user_id").agg(F.sum("w").alias("wsum"))
    per = known.join(problem_tags, "problem_id").groupBy("user_id", "tag").agg(F.sum("w").alias("tw"))
    return per.join(tot, "user_id").where(F.col("wsum") > 0) \
        .select("user_id", "tag", (F.col("tw") / F.col("wsum")).alias("weight"))


def content_raw_scores(pairs: DataFrame, profiles: DataFrame, problem_tags: DataFrame) -> DataFrame:
    """cosine(user profile, problem multi-hot) for each (user, problem)
    pair; 0 when the profile is empty or the problem has no tags.

    One row per user holds the profile as a map (at most one entry per tag of
    the vocabulary) and its norm; one row per problem its tags.  The pairs meet
    both by key and the dot product is folded on the row, so no pair is
    exploded or aggregated back.
    """
    prof = profiles.groupBy("user_id").agg(
        F.map_from_entries(F.collect_list(F.struct("tag", "weight"))).alias("_prof"),
        F.sqrt(F.sum(F.col("weight") ** 2)).alias("_pnorm"))
    tags = problem_tags.groupBy("problem_id").agg(F.collect_set("tag").alias("_tags"))
    j = pairs.join(tags, "problem_id", "left").join(prof, "user_id", "left")
    dotp = F.aggregate("_tags", F.lit(0.0), lambda acc, t: acc + F.coalesce(F.col("_prof")[t], F.lit(0.0)))
    s = F.when(F.col("_tags").isNull() | F.coalesce(F.col("_pnorm") == 0, F.lit(True)), F.lit(0.0)) \
        .otherwise(dotp / (F.col("_pnorm") * F.sqrt(F.size("_tags").cast("double"))))
    return j.withColumn("content_raw", s).drop("_prof", "_pnorm", "_tags")


# ---------------------------------------------------------- F8 min-max calibrate


def fit_minmax(scores: DataFrame, col: str) -> DataFrame:
    """F8 fit: one-row (lo, hi) with hi = lo + 1e-6 when equal."""
    m = scores.agg(F.min(col).alias("lo"), F.max(col).alias("hi"))
    return m.select("lo", F.when(F.col("hi") > F.col("lo"), F.col("hi"))
                    .otherwise(F.col("lo") + 1e-6).alias("hi"))


def apply_minmax(scores: DataFrame, col: str, fitted: DataFrame | None, out: str) -> DataFrame:
    """F8 apply: clip((s - lo)/(hi - lo), 0, 1); unfitted -> clip(s, 0, 1)."""
    if fitted is None:
        return scores.withColumn(out, clip(F.col(col), 0.0, 1.0))
    j = scores.crossJoin(F.broadcast(fitted))
    return j.withColumn(out, clip((F.col(col) - F.col("lo")) / (F.col("hi") - F.col("lo")), 0.0, 1.0)) \
        .drop("lo", "hi")


# ------------------------------------------------- F10-F12 gate / spread / map


def variance_gate(df: DataFrame, col: str, batch: list[str], cfg: Config = DEFAULT) -> DataFrame:
    """F10 per batch: n > 1 and population std >= min_std and more than two
    distinct values after half-even rounding to 3 decimals."""
    return df.groupBy(*batch).agg(
        ((F.count(col) > 1) & (F.coalesce(F.stddev_pop(col), F.lit(0.0)) >= cfg.min_std)
         & (F.count_distinct(F.bround(col, 3)) > 2)).alias("has_var"))


def _spread_expr(col: str, low: float, high: float) -> F.Column:
    """minmax spread given per-batch columns _n, _lo, _hi, _i (0-based pos)."""
    flat = (F.col("_hi") - F.col("_lo")) < 1e-9
    lin = F.lit(low) + (F.lit(high) - F.lit(low)) * F.col("_i") / (F.col("_n") - 1)
    scaled = F.lit(low) + (F.lit(high) - F.lit(low)) * (F.col(col) - F.col("_lo")) / (F.col("_hi") - F.col("_lo"))
    return F.when(F.col("_n") == 1, F.lit((low + high) / 2.0)).when(flat, lin).otherwise(scaled)


def _with_batch_stats(df: DataFrame, col: str, batch: list[str], order_col: str, dense: bool = False) -> DataFrame:
    """Size, range and list position per batch.  ``dense``: ``order_col`` is
    already the 0-based position, so nothing is sorted.  The position comes first:
    the windows over whole batches then find their rows sorted."""
    w = Window.partitionBy(*batch)
    pos = F.col(order_col) if dense else F.row_number().over(Window.partitionBy(*batch).orderBy(order_col)) - 1
    return df.withColumn("_i", pos.cast("double")).withColumn("_n", F.count(F.lit(1)).over(w)) \
        .withColumn("_lo", F.min(col).over(w)).withColumn("_hi", F.max(col).over(w))


def minmax_spread(df: DataFrame, col: str, out: str, batch: list[str], order_col: str,
                  low: float = 0.2, high: float = 0.9) -> DataFrame:
    """map each batch to [low, high] keeping order; single item ->
    midpoint; flat batch -> evenly spaced by list position."""
    s = _with_batch_stats(df, col, batch, order_col)
    return s.withColumn(out, _spread_expr(col, low, high)).drop("_n", "_lo", "_hi", "_i")


def _with_gate(df: DataFrame, col: str, batch: list[str], out: str, cfg: Config) -> DataFrame:
    """Adds the has-variance flag of ``col`` per batch as column ``out``.

    All statistics are partition-only window aggregates: more than two distinct
    half-even 3-decimal values means that some value lies strictly between the
    smallest and the largest, so nothing is sorted or collected.
    """
    w = Window.partitionBy(*batch)
    d = df.withColumn("_r", F.bround(F.col(col), 3))
    d = d.withColumn("_r0", F.min("_r").over(w)).withColumn("_r1", F.max("_r").over(w)) \
        .withColumn("_c", F.count(F.col(col)).over(w)).withColumn("_sd", F.stddev_pop(col).over(w))
    inner = F.max(((F.col("_r") > F.col("_r0")) & (F.col("_r") < F.col("_r1"))).cast("int")).over(w)
    gate = (F.col("_c") > 1) & (F.coalesce(F.col("_sd"), F.lit(0.0)) >= cfg.min_std) \
        & (F.coalesce(inner, F.lit(0)) == 1)
    return d.withColumn(out, gate).drop("_r", "_r0", "_r1", "_c", "_sd")


def calibrate_or_spread(df: DataFrame, raw: str, out: str, batch: list[str], order_col: str,
                        calibrated: str | None = None, cfg: Config = DEFAULT, dense: bool = False) -> DataFrame:
    """use the calibrated column when it varies within the batch
    (clipped to [0,1]); otherwise map raw scores: cosine-like batches in
    [-1.1, 1.1] with a negative value -> (raw+1)/2, else spread to
    [0.25, 0.85]; if the mapped batch is still flat, spread the mapped values.
    Adds ``<out>_spread`` (True when the fallback was used)."""
    d = df
    lo, hi = cfg.fallback_low, cfg.fallback_high
    w = Window.partitionBy(*batch)
    d = _with_batch_stats(d, raw, batch, order_col, dense)
    if calibrated is not None:
        d = _with_gate(d, calibrated, batch, "_cal_ok", cfg)
    else:
        d = d.withColumn("_cal_ok", F.lit(False))
    cosine_like = (F.col("_lo") >= -1.1) & (F.col("_hi") <= 1.1) & (F.col("_lo") < 0)
    d = d.withColumn("_mapped", F.when(cosine_like, (F.col(raw) + 1.0) / 2.0)
                     .otherwise(_spread_expr(raw, lo, hi)))
    d = _with_gate(d.drop("_lo", "_hi"), "_mapped", batch, "_map_ok", cfg)
    d = d.withColumn("_lo", F.min("_mapped").over(w)).withColumn("_hi", F.max("_mapped").over(w))
    fallback = F.when(F.col("_map_ok"), clip("_mapped", 0.0, 1.0)).otherwise(_spread_expr("_mapped", lo, hi))
    res = F.when(F.col("_cal_ok"), clip(calibrated, 0.0, 1.0)) if calibrated is not None else None
    final = res.otherwise(fallback) if res is not None else fallback
    d = d.withColumn(out, final).withColumn(out + "_spread", ~F.col("_cal_ok"))
    return d.drop("_n", "_lo", "_hi", "_i", "_mapped", "_map_ok", "_cal_ok")


# ------------------------------------------------------------- F13 ensemble


def ensemble_scores(df: DataFrame, als: str, content: str, boost: str | None,
                    batch: list[str], order_col: str, cfg: Config = DEFAULT,
                    out: str = "score", dense: bool = False) -> DataFrame:
    """ALS varies -> weighted mean; else content varies -> content; else
    weighted mean; plus graph boost; clip to [0,1]; a batch with more than one
    item that is still flat is spread to [0.3, 0.8]."""
    w_a, w_c = cfg.w_als, cfg.w_content
    d = _with_gate(_with_gate(df, als, batch, "_a_ok", cfg), content, batch, "_c_ok", cfg)
    mean = (w_a * F.col(als) + w_c * F.col(content)) / (w_a + w_c)
    base = F.when(F.col("_a_ok"), mean).when(F.col("_c_ok"), F.col(content)).otherwise(mean)
    if boost is not None:
        base = base + F.coalesce(F.col(boost), F.lit(0.0))
    d = d.withColumn("_s", clip(base, 0.0, 1.0))
    d = _with_gate(d, "_s", batch, "_s_ok", cfg)
    d = _with_batch_stats(d, "_s", batch, order_col, dense)
    spread = _spread_expr("_s", cfg.ensemble_spread_low, cfg.ensemble_spread_high)
    d = d.withColumn(out, F.when((F.col("_n") > 1) & ~F.col("_s_ok"), spread).otherwise(F.col("_s")))
    return d.drop("_a_ok", "_c_ok", "_s", "_s_ok", "_n", "_lo", "_hi", "_i")


# --------------------------------------------------------------- F15 top-k


def top_k(df: DataFrame, score: str, k: int, batch: list[str] = ("user_id",),
          tie: str = "problem_id") -> DataFrame:
    """first k per batch by score desc, ties by ``tie`` asc; adds ``pos``."""
    w = Window.partitionBy(*batch).orderBy(F.col(score).desc(), F.col(tie))
    return df.withColumn("pos", F.row_number().over(w)).where(F.col("pos") <= k)


# ------------------------------------------------ F18 similar items (cosine)


def similar_items(vectors: DataFrame, id_col: str, vec_col: str, n: int = 5,
                  n_blocks: int | None = None) -> DataFrame:
    """for every vector, the n most cosine-similar other vectors.

    Exact blocked similarity: vectors are hashed into B blocks; every block
    pair (i, j) is one cogroup where numpy multiplies the two normalised
    blocks and keeps the top n per row; a final per-id top-n merges the B
    partial lists.  No pair table is materialised: each task emits at most
    n rows per vector.
    """
    import numpy as np
    import pandas as pd

    if n_blocks is None:                                 # a block is at most about 4,096 vectors
        n_blocks = max(8, -(-vectors.count() // 4096))
    v = vectors.select(F.col(id_col).cast("long").alias("id"),
                       F.col(vec_col).cast("array<double>").alias("v")) \
        .withColumn("blk", (F.abs(F.xxhash64("id")) % n_blocks).cast("int"))
    left = v.select("id", "v", F.col("blk").alias("bi"),
                    F.explode(F.sequence(F.lit(0), F.lit(n_blocks - 1))).alias("bj"))
    right = v.select("id", "v", F.col("blk").alias("bj"),
                     F.explode(F.sequence(F.lit(0), F.lit(n_blocks - 1))).alias("bi"))

    def block_topn(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        if a.empty or b.empty:
            return pd.DataFrame({"id": pd.Series([], dtype="int64"),
                                 "other": pd.Series([], dtype="int64"),
                                 "sim": pd.Series([], dtype="float64")})
        A = np.vstack(a["v"].to_numpy()).astype(np.float64)
        B = np.vstack(b["v"].to_numpy()).astype(np.float64)
        na = np.linalg.norm(A, axis=1)
        nb = np.linalg.norm(B, axis=1)
        na[na == 0] = 1.0
        nb[nb == 0] = 1.0
        S = (A / na[:, None]) @ (B / nb[:, None]).T
        ida = a["id"].to_numpy()
        idb = b["id"].to_numpy()
        S[ida[:, None] == idb[None, :]] = -np.inf
        k = min(n, S.shape[1])
        # order by similarity desc, then other id asc (stable lexsort)
        order = np.lexsort((np.broadcast_to(idb, S.shape), -S), axis=1)[:, :k]
        rows = np.repeat(ida, k)
        others = idb[order].ravel()
        sims = np.take_along_axis(S, order, axis=1).ravel()
        keep = np.isfinite(sims)
        return pd.DataFrame({"id": rows[keep], "other": others[keep], "sim": sims[keep]})

    part = left.groupBy("bi", "bj").cogroup(right.groupBy("bi", "bj")).applyInPandas(
        lambda a, b: block_topn(a, b), "id long, other long, sim double")
    w = Window.partitionBy("id").orderBy(F.col("sim").desc(), F.col("other"))
    return part.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n) \
        .select(F.col("id").alias(id_col), F.col("other").alias("similar_" + id_col),
                F.col("sim").alias("similarity"), "rank")
