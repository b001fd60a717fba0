"""Scores, tiers, ranking, metrics, cold start (F*, H*, I*, J*)."""

import math

from pyspark.sql import functions as F

from edgecraft.config import Config
from edgecraft.operators import coldstart, evaluate, scoring, tiers


def _batch(spark, vals, user="u"):
    return spark.createDataFrame([(user, f"p{i}", float(v), i) for i, v in enumerate(vals)],
                                 "user_id string, problem_id string, s double, pos int")


def test_spread_flat_batch(spark):
    out = [r["x"] for r in scoring.minmax_spread(_batch(spark, [5, 5, 5]), "s", "x", ["user_id"], "pos",
                                                 0.3, 0.8).orderBy("pos").collect()]
    assert len(set(out)) == 3 and all(0.3 <= v <= 0.8 for v in out)
    one = scoring.minmax_spread(_batch(spark, [7]), "s", "x", ["user_id"], "pos", 0.2, 0.9).first()["x"]
    assert abs(one - 0.55) < 1e-12


def test_spread_preserves_order(spark):
    vals = [0.3, 0.1, 0.9, 0.5]
    out = scoring.minmax_spread(_batch(spark, vals), "s", "x", ["user_id"], "pos").orderBy("pos").collect()
    xs = [r["x"] for r in out]
    assert sorted(range(4), key=lambda i: vals[i]) == sorted(range(4), key=lambda i: xs[i])
    assert min(xs) == 0.2 and abs(max(xs) - 0.9) < 1e-12


def test_variance_gate(spark):
    flat = scoring.variance_gate(_batch(spark, [0.64, 0.64, 0.64]), "s", ["user_id"]).first()["has_var"]
    varied = scoring.variance_gate(_batch(spark, [0.3, 0.5, 0.7]), "s", ["user_id"]).first()["has_var"]
    assert flat is False and varied is True


def test_calibrate_or_spread_branches(spark):
    cos = scoring.calibrate_or_spread(_batch(spark, [-0.5, 0.0, 0.5]), "s", "p", ["user_id"], "pos")
    assert [r["p"] for r in cos.orderBy("pos").collect()] == [0.25, 0.5, 0.75]
    flat = scoring.calibrate_or_spread(_batch(spark, [0.25, 0.25, 0.25]), "s", "p", ["user_id"], "pos")
    ps = [r["p"] for r in flat.orderBy("pos").collect()]
    assert len(set(ps)) == 3 and all(r["p_spread"] for r in flat.collect())


def _scored(spark, items):
    return spark.createDataFrame([("solver", p, float(sc), tags) for p, sc, tags in items],
                                 "user_id string, problem_id string, score double, tags array<string>")


def _tier(df, tier):
    return [r["problem_id"] for r in df.where(F.col("tier") == tier).orderBy("pos").collect()]


def test_tiers_overlap_and_bounds_are_inclusive(spark):
    t = tiers.assign_tiers(_scored(spark, [("kites", .75, []), ("rivers", .65, []), ("paper", .35, []),
                                           ("ropes", .349, []), ("tiles", .48, [])]), tier_size=4)
    assert _tier(t, "edge_of_competence") == ["rivers", "tiles", "paper"]
    assert _tier(t, "confidence_builders") == ["kites"]


def test_edge_falls_back_to_the_band_centre(spark):
    t = tiers.assign_tiers(_scored(spark, [("kites", .98, []), ("rivers", .05, []), ("paper", .70, []),
                                           ("ropes", .30, []), ("tiles", .70, [])]), tier_size=3)
    assert _tier(t, "edge_of_competence") == ["paper", "tiles", "ropes"]


def test_slow_problems_build_no_confidence(spark):
    s = _scored(spark, [("kites", .9, []), ("rivers", .8, []), ("paper", .85, [])])
    um = spark.createDataFrame([("solver", 10.0)], "user_id string, median_finish_time double")
    pm = spark.createDataFrame([("kites", 12.5), ("rivers", 12.0)], "problem_id string, median_finish_time double")
    t = tiers.assign_tiers(s, user_median=um, problem_median=pm)
    assert _tier(t, "confidence_builders") == ["paper", "rivers"]


def test_blind_spot_tier(spark):
    s = _scored(spark, [("kites", .4, ["Counting"]), ("rivers", .6, ["Union"]), ("paper", .2, ["Union", "Greedy"])])
    blind = spark.createDataFrame([("solver", "Union")], "user_id string, tag string")
    assert _tier(tiers.assign_tiers(s, blind=blind), "blind_spots") == ["rivers", "paper"]


def test_profile_counts_untagged_problems(spark):
    """A solved problem without a tag stays in the divisor."""
    i = spark.createDataFrame([("u", "tagged", True, 1.0), ("u", "plain", True, 1.0), ("u", "other", True, 1.0)],
                              "user_id string, problem_id string, solved boolean, normalized_score double")
    tags = spark.createDataFrame([("tagged", "Union")], "problem_id string, tag string")
    known = spark.createDataFrame([("tagged",), ("plain",)], "problem_id string")        # "other" is not listed
    assert [tuple(r) for r in scoring.content_profiles(i, tags, known).collect()] == [("u", "Union", 0.5)]


def test_title_from_slug(spark):
    from edgecraft.functions.exprs import title_from_slug
    slugs = ["3sum-closest", "two-PATHS", "a1b2c", ""]
    df = spark.createDataFrame([(s,) for s in slugs], "s string")
    assert [r[0] for r in df.select(title_from_slug("s")).collect()] == [s.replace("-", " ").title() for s in slugs]


def test_diversity_rank_caps_tags(spark):
    rows = [("u", "t", f"p{i}", 1.0 - i / 10, ["x"] if i < 4 else ["y"]) for i in range(6)]
    df = spark.createDataFrame(rows, "user_id string, tier string, problem_id string, score double, "
                                     "tags array<string>")
    out = tiers.diversity_rank(df).orderBy("pos").collect()
    assert [r["problem_id"] for r in out] == ["p0", "p1", "p4", "p5"]
    assert [r["rank"] for r in out] == [1, 2, 5, 6]


def test_candidate_pool_matches_brute_force(spark):
    cat = {"p1": ["a", "b", "c"], "p2": ["c", "b", "a"], "p3": ["a", "b", "z"], "p4": ["q"], "p5": ["q", "a"],
           "p6": [], "p7": ["b", "c", "a", "z"]}
    edges = [("p6", "p4"), ("p4", "p6")]
    hist = [("u", "p1", False), ("u", "p3", True), ("u", "p3", False), ("v", "p4", False), ("w", "p6", True),
            ("x", "gone", True)]
    catalog = spark.createDataFrame([(p, t, i) for i, (p, t) in enumerate(cat.items())],
                                    "problem_id string, tags array<string>, cat_pos long")
    history = spark.createDataFrame(hist, "user_id string, problem_id string, solved boolean")
    rel = spark.createDataFrame(edges, "src_slug string, dst_slug string")
    for k in (1, 2, 3, 4):
        def near(a, b):
            s, t = set(cat.get(a, [])), set(cat[b])
            # a combination of k tags, or all of them for a problem with fewer, that both have as theirs
            same = len(s) >= k and len(t) >= k and len(s & t) >= k or s and s == t
            return (a, b) in edges or bool(same)
        want = set()
        for u in "uvwx":
            done = {p for x, p, ok in hist if x == u and ok}
            tried = {p for x, p, _ in hist if x == u}
            got = [p for p in cat if p not in done and any(near(q, p) for q in tried)]
            want |= {(u, p, i) for i, p in enumerate(got)}
        pool = tiers.candidate_pool(history.select("user_id"), history, catalog, rel, Config(min_shared_tags=k))
        assert {(r.user_id, r.problem_id, r.pool_pos) for r in pool.collect()} == want


def test_candidate_pool_default_reaches_beyond_equal_tag_sets(spark):
    cat = {"p1": ["a", "b", "c", "d"], "p2": ["a", "b", "y", "z"], "p3": ["a", "b", "c", "z"], "p4": ["a", "x", "y", "z"]}
    catalog = spark.createDataFrame([(p, t, i) for i, (p, t) in enumerate(cat.items())],
                                    "problem_id string, tags array<string>, cat_pos long")
    history = spark.createDataFrame([("u", "p1", True)], "user_id string, problem_id string, solved boolean")
    rel = spark.createDataFrame([], "src_slug string, dst_slug string")
    pool = tiers.candidate_pool(history.select("user_id"), history, catalog, rel)
    assert {r.problem_id for r in pool.collect()} == {"p2", "p3"}


def test_temporal_split_disjoint(spark, interactions):
    train, test = tiers.temporal_split(interactions, 10)
    a = {r[0] for r in train.select("contest_id").distinct().collect()}
    b = {r[0] for r in test.select("contest_id").distinct().collect()}
    assert a and b and not (a & b) and train.count() + test.count() == interactions.count()


def test_ranking_metrics(spark):
    recs = spark.createDataFrame([("u", p, i + 1) for i, p in enumerate(["a", "c", "b", "d"])],
                                 "user_id string, problem_id string, pos int")
    rel = spark.createDataFrame([("u", "a"), ("u", "b")], "user_id string, problem_id string")
    m = evaluate.ranking_metrics(recs, rel, 3).first()
    assert abs(m["precision_at_k"] - 2 / 3) < 1e-12 and m["recall_at_k"] == 1.0
    assert m["ndcg_at_k"] > 0.9 and m["mrr"] == 1.0
    ideal = 1 + 1 / math.log2(3)
    assert abs(m["ndcg_at_k"] - (1 + 1 / math.log2(4)) / ideal) < 1e-12


def test_roadmap_cards(spark, sf):
    from edgecraft.sources import fixtures
    road = coldstart.read_roadmap(fixtures.roadmap_json(spark, sf))
    keys = [r[0] for r in spark.read.parquet(f"{sf}/part.parquet").where("p_size = 25").orderBy("p_partkey")
            .select("p_partkey").collect()]
    assert road.count() == len(keys)
    cards = coldstart.roadmap_cards(road, 3).orderBy("order").collect()
    assert [c["slug"] for c in cards] == [f"part-{k}" for k in keys[:3]] and cards[0]["signal_count"] == 2
    assert f"problem #{keys[0] + 1} in" in cards[0]["signals"][0]
    assert coldstart.count_clamp(0) == 1 and coldstart.count_clamp(99) == 30 and coldstart.count_clamp(None) == 10


def test_similar_items_exact(spark, sf):
    from edgecraft.sources.tables import read_table
    emb = read_table(spark, sf, "embeddings", "vec_id", "embedding")
    got = scoring.similar_items(emb, "vec_id", "embedding", n=3, n_blocks=3)
    vecs = {r["vec_id"]: r["embedding"] for r in emb.collect()}
    import numpy as np
    ids = sorted(vecs)
    M = np.array([vecs[i] for i in ids], dtype=np.float64)
    M = M / np.linalg.norm(M, axis=1, keepdims=True)
    S = M @ M.T
    np.fill_diagonal(S, -np.inf)
    first = ids[0]
    want = [ids[j] for j in np.argsort(-S[0], kind="stable")[:3]]
    have = [r["similar_vec_id"] for r in got.where(F.col("vec_id") == first).orderBy("rank").collect()]
    assert have == want


def test_calibrate_or_spread_sorts_a_batch_once(spark):
    rows = [(f"u{i % 5}", f"p{i:03d}", (i * 37 % 100) / 100, (i * 13 % 90) / 100) for i in range(60)]
    df = spark.createDataFrame(rows, "user_id string, problem_id string, s double, c double")
    one = scoring.calibrate_or_spread(df, "s", "p1", ["user_id"], "problem_id")
    two = scoring.calibrate_or_spread(one.withColumn("r2", F.col("s") * 2 - 1), "r2", "p2", ["user_id"], "problem_id", "c")
    plan = two._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Window [") > 3 and plan.count("Sort [") == 1
    got = {(r.user_id, r.problem_id): r for r in two.collect()}
    for u, p, s, c in rows:
        mine = [x[2] for x in rows if x[0] == u]
        assert abs(got[u, p].p1 - (0.25 + 0.6 * (s - min(mine)) / (max(mine) - min(mine)))) < 1e-9
        assert abs(got[u, p].p2 - c) < 1e-12 and not got[u, p].p2_spread and got[u, p].p1_spread
