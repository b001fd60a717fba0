"""Split, candidates, tiers and ranking.

Every per-user rule of the reference becomes a window or aggregate keyed by
``user_id``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from edgecraft.config import DEFAULT, Config
from edgecraft.functions.exprs import contest_number, title_from_slug

# ------------------------------------------------------------ H1-H3 splits


def with_contest_number(df: DataFrame, col: str = "contest_id", out: str = "contest_num") -> DataFrame:
    """H1."""
    return df.withColumn(out, contest_number(col))


def split_point(interactions: DataFrame, n_test_contests: int = 10) -> DataFrame:
    """H2 scalar: one row ``split_at``.  The distinct contest numbers are one
    array per dataset (a calendar-bounded count)."""
    nums = with_contest_number(interactions).agg(F.sort_array(F.collect_set("contest_num")).alias("a"))
    n = F.size("a")
    at = F.when(n <= n_test_contests, F.element_at("a", (F.floor(n / 2) + 1).cast("int"))) \
        .otherwise(F.element_at("a", (n - n_test_contests + 1).cast("int")))
    return nums.select(at.alias("split_at"))


def temporal_split(interactions: DataFrame, n_test_contests: int = 10) -> tuple[DataFrame, DataFrame]:
    """H2: contests before the split point train, the rest test."""
    sp = F.broadcast(split_point(interactions, n_test_contests))
    d = with_contest_number(interactions).crossJoin(sp)
    train = d.where(F.col("contest_num") < F.col("split_at")).drop("contest_num", "split_at")
    test = d.where(F.col("contest_num") >= F.col("split_at")).drop("contest_num", "split_at")
    return train, test


def three_way_split_labels(interactions: DataFrame, n_train: int = 250, n_val: int = 30,
                           n_test: int = 61) -> DataFrame:
    """H3: (contest_id, split) by position of the contest id in value order;
    too few contests -> 70 % / 10 % / rest.  The window runs over distinct
    contests only (calendar-bounded)."""
    c = interactions.select("contest_id").distinct()
    pos = c.withColumn("i", F.row_number().over(Window.orderBy("contest_id")))
    n = F.count(F.lit(1)).over(Window.partitionBy())
    few = n < (n_train + n_val + n_test)
    ntr = F.when(few, F.greatest(F.lit(1), F.floor(n * 0.7))).otherwise(F.lit(n_train))
    nva = F.when(few, F.greatest(F.lit(1), F.floor(n * 0.1))).otherwise(F.lit(n_val))
    return pos.withColumn("ntr", ntr).withColumn("nva", nva).select(
        "contest_id",
        F.when(F.col("i") <= F.col("ntr"), "train")
        .when(F.col("i") <= F.col("ntr") + F.col("nva"), "val").otherwise("test").alias("split"))


# --------------------------------------------------------- H4-H6 filters


def filter_solved(cands: DataFrame, solved: DataFrame) -> DataFrame:
    """H4: drop candidates the user already solved."""
    return cands.join(solved.select("user_id", "problem_id"), ["user_id", "problem_id"], "left_anti")


def dedup_keep_first(cands: DataFrame, order_col: str) -> DataFrame:
    """H5: keep the first occurrence of each (user, problem) by list position."""
    w = Window.partitionBy("user_id", "problem_id").orderBy(order_col)
    return cands.withColumn("_k", F.row_number().over(w)).where(F.col("_k") == 1).drop("_k")


def apply_filters(cands: DataFrame, solved: DataFrame | None, order_col: str) -> DataFrame:
    """H6: H4 then H5."""
    if solved is not None:
        cands = filter_solved(cands, solved)
    return dedup_keep_first(cands, order_col)


# -------------------------------------------------------- H7 candidate pool


def dense_positions(df: DataFrame, key: str, out: str = "cat_pos", width: int = 4096,
                    tiebreak: tuple[str, ...] = ()) -> DataFrame:
    """Dense 0-based position of each row in (``key``, *tiebreak) order,
    ``key`` a long.

    Rows are grouped into fixed-width key buckets; a window inside each bucket
    numbers its rows.  Bucket sizes become offsets in two levels (buckets inside
    groups of 1,024, and the groups), so the last ordered pass has one row per
    1,024 buckets.  No single task orders the whole table and nothing passes
    through Python.
    """
    d = df.withColumn("_b", F.floor(F.col(key) / width).cast("long"))
    upto = lambda by, *part: Window.partitionBy(*part).orderBy(by).rowsBetween(Window.unboundedPreceding, -1)
    sizes = d.groupBy("_b").agg(F.count(F.lit(1)).alias("_n")).withColumn("_g", F.floor(F.col("_b") / 1024))
    groups = sizes.groupBy("_g").agg(F.sum("_n").alias("_gn"))
    groups = groups.select("_g", F.coalesce(F.sum("_gn").over(upto("_g")), F.lit(0)).alias("_goff"))
    offs = sizes.withColumn("_off", F.coalesce(F.sum("_n").over(upto("_b", "_g")), F.lit(0))).join(groups, "_g") \
        .select("_b", (F.col("_off") + F.col("_goff")).alias("_off"))
    local = d.withColumn("_l", F.row_number().over(
        Window.partitionBy("_b").orderBy(key, *tiebreak)) - 1)
    return local.join(offs, "_b") \
        .withColumn(out, (F.col("_off") + F.col("_l")).cast("long")).drop("_b", "_off", "_l")


def tag_keys(problems: DataFrame, min_shared_tags: int) -> DataFrame:
    """(problem_id, tag_key): one row for each combination of ``min_shared_tags``
    of a problem's distinct tags (all of them, if it has fewer).  Problems of
    one key share that many tags."""
    tags = F.sort_array(F.array_distinct(F.filter("tags", lambda t: t.isNotNull())))
    d = problems.select("problem_id", tags.alias("ts")).where(F.size("ts") > 0)
    combos = F.array(F.array().cast("array<string>"))
    d = d.withColumn("c", combos)
    for _ in range(min_shared_tags):       # extend every combination by a later tag
        longer = F.flatten(F.transform("c", lambda c: F.transform(
            F.filter("ts", lambda t: (F.size(c) == 0) | (t > F.try_element_at(c, F.lit(-1)))),
            lambda t: F.concat(c, F.array(t)))))
        d = d.withColumn("c", F.when(F.size(longer) > 0, longer).otherwise(F.col("c")))
    return d.select("problem_id", F.explode("c").alias("tag_key"))


def candidate_pool(users: DataFrame, history: DataFrame, catalog: DataFrame, slug_rel: DataFrame,
                   cfg: Config = DEFAULT, materialize=None) -> DataFrame:
    """H7: per user, every unsolved catalog problem that neighbours an attempted
    problem in the similar-problem graph or shares ``cfg.min_shared_tags`` tags
    with one (all its tags, if it has fewer), in catalog order.

    ``catalog`` has (problem_id, tags, cat_pos) with dense positions,
    ``slug_rel`` is the neighbour relation.  Attempted problems meet the
    catalog through equi-joins on graph edges and on tag combinations; there is
    no limit on rows and no product of users and catalog.  Attempted and solved
    marks travel with the rows, so one aggregate by (user, problem) removes
    repeats and solved problems together.
    Output: user_id, problem_id, tags, cat_pos, pool_pos (0-based list order).
    """
    tried = history.join(users.select("user_id").distinct(), "user_id", "left_semi") \
        .groupBy("user_id", "problem_id").agg(F.max(F.col("solved").cast("int")).alias("solved"))
    cat = catalog.select("problem_id", "tags", "cat_pos")
    keys = tag_keys(cat, cfg.min_shared_tags)
    # problem -> problems within reach, once per catalog and not per user
    reach = keys.join(keys.select(F.col("problem_id").alias("near"), "tag_key"), "tag_key") \
        .select("problem_id", "near") \
        .unionByName(slug_rel.select(F.col("src_slug").alias("problem_id"), F.col("dst_slug").alias("near"))) \
        .distinct()
    rows = tried.join(reach, "problem_id").select("user_id", F.col("near").alias("problem_id"), F.lit(0).alias("solved")) \
        .unionByName(tried.where("solved = 1").select("user_id", "problem_id", "solved"))
    pool = rows.groupBy("user_id", "problem_id").agg(F.max("solved").alias("solved")).where("solved = 0") \
        .join(cat, "problem_id")
    w = Window.partitionBy("user_id").orderBy("cat_pos")
    pool = pool.withColumn("pool_pos", F.row_number().over(w) - 1) \
        .select("user_id", "problem_id", "tags", "cat_pos", "pool_pos")
    return materialize(pool) if materialize else pool


# ------------------------------------------------------------- H8 tiers


def assign_tiers(scored: DataFrame, cfg: Config = DEFAULT, blind: DataFrame | None = None,
                 user_median: DataFrame | None = None, problem_median: DataFrame | None = None,
                 tier_size: int | None = None, disjoint: bool = False) -> DataFrame:
    """H8: (user_id, tier, pos, problem_id, score, tags) rows.

    * edge: scores in [low, high], best first; a user with none gets the
      items nearest to the band centre;
    * confidence: score >= p_min, skipping problems whose median finish time
      exceeds 1.2 x the user's median (when both are known);
    * blind: problems carrying one of the user's blind-spot tags (E5).
    Ties: score desc, then problem_id.  Tiers may overlap (``disjoint=False``).
    """
    size = tier_size or cfg.tier_size
    s = scored.select("user_id", "problem_id", "score", "tags")
    none = F.array().cast("array<string>")
    slow = F.lit(False)
    if user_median is not None and problem_median is not None:
        s = s.join(problem_median.select("problem_id", F.col("median_finish_time").alias("_pm")), "problem_id", "left") \
            .join(user_median.select("user_id", F.col("median_finish_time").alias("_um")), "user_id", "left")
        slow = F.coalesce(F.col("_pm") > F.col("_um") * cfg.confidence_speed_factor, F.lit(False))
    weak = F.lit(False)
    if blind is not None:
        s = s.join(blind.groupBy("user_id").agg(F.collect_set("tag").alias("_bt")), "user_id", "left")
        weak = F.coalesce(F.arrays_overlap(F.coalesce("tags", none), F.col("_bt")), F.lit(False))
    centre = (cfg.edge_p_low + cfg.edge_p_high) / 2.0
    s = s.select("user_id", "problem_id", "score", "tags",
                 F.col("score").between(cfg.edge_p_low, cfg.edge_p_high).alias("_e"),
                 ((F.col("score") >= cfg.confidence_p_min) & ~slow).alias("_c"), weak.alias("_b"))
    # one ordered pass per user: running counts place each row in every tier it belongs to
    w = Window.partitionBy("user_id").orderBy(F.col("score").desc(), "problem_id") \
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    any_edge = F.max("_e").over(Window.partitionBy("user_id"))
    s = s.withColumn("_any", any_edge)
    for flag in ("_e", "_c", "_b"):
        s = s.withColumn(flag + "n", F.when(F.col(flag), F.sum(F.col(flag).cast("int")).over(w)))
    place = lambda tier, n: F.when(F.col(n) <= size, F.struct(F.lit(tier).alias("tier"), F.col(n).cast("int").alias("pos")))
    placed = F.array_compact(F.array(place("edge_of_competence", "_en"), place("confidence_builders", "_cn"),
                                     place("blind_spots", "_bn")))
    out = s.where((F.col("_en") <= size) | (F.col("_cn") <= size) | (F.col("_bn") <= size)) \
        .select("user_id", "problem_id", "score", "tags", F.explode(placed).alias("p")) \
        .select("user_id", "p.tier", "p.pos", "problem_id", "score", "tags")
    # users without any score in the band: the nearest to its centre
    near = s.where(~F.col("_any")).withColumn("pos", F.row_number().over(
        Window.partitionBy("user_id").orderBy(F.abs(F.col("score") - centre), F.col("score").desc(), "problem_id"))) \
        .where(F.col("pos") <= size).withColumn("tier", F.lit("edge_of_competence"))
    out = out.unionByName(near.select("user_id", "tier", "pos", "problem_id", "score", "tags"))
    if disjoint:
        first = Window.partitionBy("user_id", "problem_id").orderBy(
            F.when(F.col("tier") == "edge_of_competence", 0).when(F.col("tier") == "blind_spots", 1)
            .otherwise(2))
        out = out.withColumn("_k", F.row_number().over(first)).where(F.col("_k") == 1).drop("_k")
    return out


# ---------------------------------------------------------- H9-H11 ranking


def diversity_rank(tiered: DataFrame, max_per_tag: int = 2,
                   group: tuple[str, ...] = ("user_id", "tier")) -> DataFrame:
    """H9: greedy by score (desc, then problem_id); skip an item when any of
    its tags already has ``max_per_tag`` picks.  ``rank`` is the position in
    score order (gaps kept), ``pos`` the dense position among kept items.

    The fold is an ``aggregate`` over the sorted (bounded) list of a group,
    evaluated JVM-side.
    """
    g = list(group)
    items = tiered.groupBy(*g).agg(F.sort_array(F.collect_list(F.struct(
        (-F.col("score")).alias("neg"), F.col("problem_id"),
        F.coalesce("tags", F.array().cast("array<string>")).alias("tags"),
        F.col("score")))).alias("items"))
    init = F.struct(F.array().cast("array<string>").alias("seen"),
                    F.array().cast("array<struct<problem_id:string,score:double,rank:int>>").alias("kept"),
                    F.lit(0).alias("i"))

    def step(acc, x):
        i = acc["i"] + 1
        full = F.exists(x["tags"], lambda t: F.size(F.filter(acc["seen"], lambda s: s == t)) >= max_per_tag)
        kept = F.when(full, acc["kept"]).otherwise(F.concat(acc["kept"], F.array(F.struct(
            x["problem_id"].alias("problem_id"), x["score"].cast("double").alias("score"),
            i.cast("int").alias("rank")))))
        seen = F.when(full, acc["seen"]).otherwise(F.concat(acc["seen"], x["tags"]))
        return F.struct(seen.alias("seen"), kept.alias("kept"), i.cast("int").alias("i"))

    folded = items.select(*g, F.aggregate("items", init, step)["kept"].alias("kept"))
    out = folded.select(*g, F.posexplode("kept").alias("p", "k"))
    return out.select(*g, F.col("k.problem_id").alias("problem_id"), F.col("k.score").alias("score"),
                      F.col("k.rank").alias("rank"), (F.col("p") + 1).alias("pos"))


def score_rank(df: DataFrame, group: tuple[str, ...] = ("user_id",)) -> DataFrame:
    """Rank by score desc (ties by problem_id)."""
    w = Window.partitionBy(*group).orderBy(F.col("score").desc(), F.col("problem_id"))
    return df.withColumn("rank", F.row_number().over(w))


def recency_rank(df: DataFrame, recency: DataFrame, group: tuple[str, ...] = ("user_id",)) -> DataFrame:
    """Score order; recency (contests since last attempt) attached, 0
    when unknown."""
    j = df.join(recency.select("problem_id", "recency"), "problem_id", "left") \
        .withColumn("recency", F.coalesce("recency", F.lit(0)))
    return score_rank(j, group)


def enrich(df: DataFrame, problems: DataFrame | None = None) -> DataFrame:
    """p_solve rounded half-even to 4 places; title from the catalog,
    else from the slug."""
    out = df.withColumn("p_solve", F.bround("score", 4))
    if problems is not None:
        out = out.join(problems.select("problem_id", F.col("title").alias("_t")), "problem_id", "left")
        return out.withColumn("title", F.coalesce("_t", title_from_slug("problem_id"))).drop("_t")
    return out.withColumn("title", title_from_slug("problem_id"))
