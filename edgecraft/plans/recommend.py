"""Training (F17) and the tiered recommendation job (H13, I5) for a users
DataFrame of any size.

After the candidate pool is built, every step is a join or a window keyed by
``user_id``; ``slug_rel`` is the symmetric neighbour relation.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from edgecraft.config import DEFAULT, Config
from edgecraft.operators import blocks, coldstart, features, graph, isotonic, models, peers, scoring, tiers
from edgecraft.plans import store


@dataclass
class Trained:
    als: models.ALSFit | None
    als_cal: isotonic.Steps | None
    content_profiles: DataFrame | None
    content_cal: isotonic.Steps | None
    problem_tags: DataFrame | None


CHOICES = ("als", "content", "ensemble", "all")


def train(interactions: DataFrame, problems: DataFrame, cfg: Config = DEFAULT,
          n_test_contests: int = 10, calibrate: bool = True, rank: int | None = None,
          max_iter: int | None = None, choice: str = "all") -> Trained:
    """temporal split -> ALS on train -> isotonic on all test rows ->
    content profiles on train -> isotonic on all test rows.  ``choice``: "als" or
    "content" for one of them, "ensemble" or "all" for both."""
    if choice not in CHOICES:
        raise ValueError(f"choice must be one of {CHOICES}")
    train_df, test_df = tiers.temporal_split(interactions, n_test_contests)
    pairs = test_df.select("user_id", "problem_id", "contest_id", "solved")
    als = als_cal = prof = content_cal = pt = None
    if choice != "content":
        als = models.fit_als(train_df, cfg, rank=rank, max_iter=max_iter)
        if calibrate:
            als_cal = models.fit_calibrator(als.raw_scores(pairs), "als_raw", "solved")
    if choice != "als":
        pt = features.problem_tags(problems)
        prof = store.materialize(scoring.content_profiles(train_df, pt, problems))
        if calibrate:
            c = scoring.content_raw_scores(pairs, prof, pt)
            content_cal = models.fit_calibrator(c, "content_raw", "solved")
    return Trained(als, als_cal, prof, content_cal, pt)


def refit(model: Trained, interactions: DataFrame, problems: DataFrame, cfg: Config = DEFAULT,
          rank: int | None = None, max_iter: int | None = None) -> Trained:
    """The models that a training gave, fitted again on all given interactions;
    calibrators stay, since no rows are held out for them."""
    als = models.fit_als(interactions, cfg, rank=rank, max_iter=max_iter) if model.als is not None else None
    pt = prof = None
    if model.content_profiles is not None:
        pt = features.problem_tags(problems)
        prof = scoring.content_profiles(interactions, pt, problems)
    return Trained(als, model.als_cal, prof, model.content_cal, pt)


def score_pool(pool: DataFrame, model: Trained, history: DataFrame, slug_rel: DataFrame,
               cfg: Config = DEFAULT) -> DataFrame:
    """F3/F5 -> F6 -> F12 (each model) -> G2 -> F13 on the candidate pool."""
    batch, order = ["user_id"], "pool_pos"
    s = model.als.raw_scores(pool)
    s = scoring.content_raw_scores(s, model.content_profiles, model.problem_tags)
    als_cal = con_cal = None
    if model.als_cal is not None:
        s = models.apply_isotonic(model.als_cal, s, "als_raw", "als_cal")
        als_cal = "als_cal"
    if model.content_cal is not None:
        s = models.apply_isotonic(model.content_cal, s, "content_raw", "content_cal")
        con_cal = "content_cal"
    s = scoring.calibrate_or_spread(s, "als_raw", "p_als", batch, order, als_cal, cfg, dense=True)
    s = scoring.calibrate_or_spread(s, "content_raw", "p_content", batch, order, con_cal, cfg, dense=True)
    st = graph.struggle_set(history, cfg.struggle_min_penalty)
    s = graph.graph_boost(s, st, slug_rel, cfg.graph_alpha, symmetric_rel=True)
    return scoring.ensemble_scores(s, "p_als", "p_content", "boost", batch, order, cfg, dense=True)


def recommend(users: DataFrame, interactions: DataFrame, catalog: DataFrame, model: Trained,
              slug_rel: DataFrame, problem_feats: DataFrame, cfg: Config = DEFAULT,
              tier_size: int | None = None, materialize=store.materialize) -> DataFrame:
    """(user_id, tier, pos, rank, problem_id, p_solve, title, tags).

    Scores come from :mod:`edgecraft.operators.blocks`, which gives back only the
    rows that can enter a tier, so no pool is written.  Those rows and the ranked
    output are read more than once and checkpointed (``materialize``).
    """
    if model.als is None or model.content_profiles is None:
        raise ValueError("recommendations need both models (train with choice 'ensemble' or 'all')")
    mat = materialize or (lambda d: d)
    hist = interactions.join(users.select("user_id").distinct(), "user_id", "left_semi")
    # peer rates need every user's rows (peers are drawn from all users)
    blind = mat(peers.blind_spots(interactions, cfg).join(users.select("user_id").distinct(), "user_id", "left_semi"))
    umed = hist.groupBy("user_id").agg(F.median("finish_time_min").alias("median_finish_time"))
    user_factors, item_factors = model.als.factors()
    # the pool is unsolved and unique per user already (H4-H6 hold by construction)
    scored = blocks.score_pool_blocks(
        users, hist, catalog, slug_rel, user_factors, item_factors, model.content_profiles,
        als_steps=models.step_table(model.als_cal), content_steps=models.step_table(model.content_cal), blind=blind,
        user_median=umed, problem_median=problem_feats, size=tier_size, cfg=cfg, materialize=materialize)
    scored = mat(scored.join(catalog.select("problem_id", "tags"), "problem_id"))
    t = tiers.assign_tiers(scored, cfg, blind=blind, user_median=umed,
                           problem_median=problem_feats.select("problem_id", "median_finish_time"),
                           tier_size=tier_size)
    ranked = tiers.diversity_rank(t, cfg.max_per_tag)
    tags = catalog.select("problem_id", "tags")
    out = tiers.enrich(ranked, catalog).join(tags, "problem_id", "left")
    return mat(out.select("user_id", "tier", "pos", "rank", "problem_id", "p_solve", "title", "tags"))


def respond(slugs: DataFrame, interactions: DataFrame, catalog: DataFrame, model: Trained,
            slug_rel: DataFrame, problem_feats: DataFrame, roadmap: DataFrame, count: int = 10,
            cfg: Config = DEFAULT) -> DataFrame:
    """I1 + I5 (+I2 for cold users): one card list per requested slug.

    Warm users get tiered cards (tier size max(count // 3, 3)) with
    explanation signals; cold users get the first ``count`` roadmap cards.
    """
    count = coldstart.count_clamp(count)
    routed = coldstart.route_users(slugs, interactions.select("user_id"), cfg)
    warm = routed.where(F.col("warm"))
    recs = recommend(warm, interactions, catalog, model, slug_rel, problem_feats, cfg,
                     coldstart.response_tier_size(count))
    cards = coldstart.assemble_response(recs, count)
    hist = interactions.join(warm.select("user_id"), "user_id", "left_semi")
    rates = features.user_tag_rates(hist)
    peer = peers.peer_tag_scores(interactions, cfg).join(warm.select("user_id"), "user_id", "left_semi")
    solved = hist.where(F.col("solved")).select("user_id", "problem_id").distinct()
    sig = coldstart.explanation_signals(cards, rates, peer, slug_rel, solved,
                                        graph.struggle_set(hist, cfg.struggle_min_penalty), catalog, cfg)
    warm_cards = cards.join(sig.select("user_id", "tier", "pos", "signals", "signal_count"),
                            ["user_id", "tier", "pos"]) \
        .join(warm.select("user_id", "user_slug"), "user_id") \
        .join(coldstart.user_summary(hist), "user_id", "left") \
        .select("user_slug", "user_id", F.lit(True).alias("warm_start"), "contests", "attempted", "solved_count",
                F.lit(None).cast("string").alias("message"), "card",
                F.col("problem_id").alias("slug"), "title", "tags", "tier", "p_solve",
                "signals", "signal_count")
    cold = routed.where(~F.col("warm"))
    rc = coldstart.roadmap_cards(roadmap, count)
    # at most ``count`` (<= 30) cards: one array in a one-row table, broadcast
    deck = rc.agg(F.sort_array(F.collect_list(F.struct("order", "slug", "title", "tags", "tier", "p_solve",
                                                       "signals", "signal_count"))).alias("deck"))
    cold_cards = cold.crossJoin(F.broadcast(deck)).select(
        "user_slug", "user_id", F.posexplode("deck").alias("i", "c")).select(
        "user_slug", "user_id", F.lit(False).alias("warm_start"),
        *[F.lit(None).cast("long").alias(c) for c in ("contests", "attempted", "solved_count")],
        coldstart.cold_message().alias("message"), (F.col("i") + 1).alias("card"),
        "c.slug", "c.title", "c.tags", "c.tier", "c.p_solve", "c.signals", "c.signal_count")
    return warm_cards.unionByName(cold_cards)
