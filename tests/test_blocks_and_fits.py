"""Blocked pool scoring against the plain pool code; fits against brute force."""

from __future__ import annotations

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from edgecraft.config import Config
from edgecraft.operators import als_step, blocks, graph, isotonic, models, scoring, tiers
from edgecraft.plans import store


@pytest.fixture(scope="module")
def world(spark):
    rnd = random.Random(3)
    vocabulary = "abcdefgh"
    cat = [(f"p{i:02d}", rnd.sample(vocabulary, rnd.randint(0, 4)), i) for i in range(60)]
    edges = {(f"p{a:02d}", f"p{b:02d}") for a, b in (rnd.sample(range(60), 2) for _ in range(40))}
    edges |= {(b, a) for a, b in edges}
    hist = [(f"u{u}", f"p{rnd.randrange(60):02d}", rnd.random() < .5, rnd.randint(0, 2))
            for u in range(25) for _ in range(rnd.randint(1, 9))]
    hist += [("flat", "p01", False, 0), ("lost", "gone", True, 0)]
    catalog = spark.createDataFrame(cat, "problem_id string, tags array<string>, cat_pos long")
    history = spark.createDataFrame(hist, "user_id string, problem_id string, solved boolean, penalty_count int")
    rel = spark.createDataFrame(sorted(edges), "src_slug string, dst_slug string")
    vec = lambda: [rnd.uniform(-.6, .9) for _ in range(3)]
    uf = spark.createDataFrame([(f"u{u}", vec()) for u in range(22)], "id string, features array<double>")    # the others: unknown
    itf = spark.createDataFrame([(p, vec()) for p, _, i in cat if i % 9], "id string, features array<double>")
    tags = catalog.select("problem_id", F.explode("tags").alias("tag"))
    weighted = history.withColumn("normalized_score", F.lit(1.0) / (1 + F.col("penalty_count")))
    prof = scoring.content_profiles(weighted, tags, catalog)
    return history, catalog, rel, uf, itf, tags, prof


STEPS = (np.array([-.5, 0.0, .4, .9]), np.array([.1, .3, .3, .95]))


def plain(world, cfg, content, calibrated):
    history, catalog, rel, uf, itf, tags, prof = world
    users = history.select("user_id").distinct()
    s = scoring.als_raw_scores(tiers.candidate_pool(users, history, catalog, rel, cfg), uf, itf)
    cal = F.udf(lambda x: float(np.interp(math.floor(x * 1e9 + .5) / 1e9, *STEPS)), "double")
    s = s.withColumn("cal", cal("als_raw"))
    s = scoring.calibrate_or_spread(s, "als_raw", "p_als", ["user_id"], "pool_pos", "cal" if calibrated else None, cfg, dense=True)
    if not content:
        return s.withColumn("score", F.col("p_als"))
    s = scoring.content_raw_scores(s, prof, tags)
    s = scoring.calibrate_or_spread(s, "content_raw", "p_content", ["user_id"], "pool_pos", None, cfg, dense=True)
    s = graph.graph_boost(s, graph.struggle_set(history), rel, cfg.graph_alpha, symmetric_rel=True)
    return scoring.ensemble_scores(s, "p_als", "p_content", "boost", ["user_id"], "pool_pos", cfg, dense=True)


@pytest.mark.parametrize("item_block,shared,content,calibrated", [
    (1 << 15, 2, True, True), (7, 2, True, False), (7, 1, False, True), (1 << 15, 3, False, False)])
def test_blocks_give_the_scores_of_the_pool(spark, world, item_block, shared, content, calibrated):
    history, catalog, rel, uf, itf, tags, prof = world
    cfg = Config(min_shared_tags=shared)
    want = {(r.user_id, r.problem_id): (r.pool_pos, r.score) for r in plain(world, cfg, content, calibrated).collect()}
    got = blocks.score_pool_blocks(history.select("user_id"), history, catalog, rel, uf, itf, prof if content else None,
                                   als_steps=STEPS if calibrated else None, keep="all", cfg=cfg, item_block=item_block,
                                   user_block=5, materialize=store.materialize).collect()
    assert {(r.user_id, r.problem_id) for r in got} == set(want) and len(got) == len(want) > 300
    for r in got:
        pos, score = want[r.user_id, r.problem_id]
        assert r.pool_pos == pos and abs(r.score - score) < 1e-9


@pytest.mark.parametrize("item_block", [1 << 15, 11])
def test_blocks_keep_what_enters_a_tier(spark, world, item_block):
    history, catalog, rel, uf, itf, tags, prof = world
    cfg = Config(min_shared_tags=1)
    blind = spark.createDataFrame([("u1", "a"), ("u2", "c"), ("u2", "zzz")], "user_id string, tag string")
    um = history.select("user_id").distinct().withColumn("median_finish_time", F.lit(10.0))
    pm = catalog.select("problem_id", (F.col("cat_pos") % 20).cast("double").alias("median_finish_time"))
    whole = plain(world, cfg, True, True).select("user_id", "problem_id", "score", "tags")
    kept = blocks.score_pool_blocks(history.select("user_id"), history, catalog, rel, uf, itf, prof, als_steps=STEPS,
                                    blind=blind, user_median=um, problem_median=pm, size=3, cfg=cfg, item_block=item_block,
                                    user_block=4, materialize=store.materialize).join(catalog.select("problem_id", "tags"), "problem_id")
    assign = lambda s: {(r.user_id, r.tier, r.pos, r.problem_id) for r in tiers.assign_tiers(
        s, cfg, blind=blind, user_median=um, problem_median=pm, tier_size=3).collect()}
    assert assign(kept) == assign(whole) and kept.count() < whole.count()


def test_blocks_keep_the_best_and_the_wanted(spark, world):
    history, catalog, rel, uf, itf, *_ = world
    cfg = Config(min_shared_tags=1)
    wanted = spark.createDataFrame([("u3", "p05"), ("u3", "p40"), ("u4", "none")], "user_id string, problem_id string")
    whole = {}
    for r in plain(world, cfg, False, True).collect():
        whole.setdefault(r.user_id, []).append((-r.score, r.problem_id))
    got = blocks.score_pool_blocks(history.select("user_id"), history, catalog, rel, uf, itf, als_steps=STEPS, wanted=wanted,
                                   keep="best", size=4, cfg=cfg, item_block=13, user_block=6,
                                   materialize=store.materialize)
    top = scoring.top_k(got, "score", 4).collect()
    assert {(r.user_id, r.problem_id, r.pos) for r in top} == {
        (u, p, i + 1) for u, v in whole.items() for i, (_, p) in enumerate(sorted(v)[:4])}
    pool = {p for _, p in whole["u3"]}
    assert {"p05", "p40"} & pool <= {r.problem_id for r in got.where("user_id = 'u3'").collect()}


def test_blocks_of_nothing(spark, world):
    history, catalog, rel, uf, itf, *_ = world
    assert blocks.score_pool_blocks(history.select("user_id").limit(0), history, catalog, rel, uf, itf).count() == 0
    assert blocks.score_pool_blocks(history.select("user_id"), history, catalog.limit(0), rel, None, None).count() == 0


# ------------------------------------------------------------------------ fits

def min_max(x, y):
    """Isotonic fit of sorted scores by the min-max formula."""
    xs = sorted(set(x))
    n = np.array([x.count(v) for v in xs])
    s = np.array([sum(b for a, b in zip(x, y) if a == v) for v in xs])
    return xs, [max(min(s[i:j + 1].sum() / n[i:j + 1].sum() for j in range(k, len(xs))) for i in range(k + 1))
                for k in range(len(xs))]


@pytest.mark.parametrize("parts", [1, 3, 8])
def test_isotonic_by_ranges(spark, parts):
    rnd = random.Random(parts)
    x = [round(rnd.random(), 2) for _ in range(400)]
    y = [float(rnd.random() < .9 - .5 * abs(v - .7)) for v in x]
    df = spark.createDataFrame(list(zip(x, y)) + [(None, 1.0), (0.5, None)], "x double, y double")
    m = isotonic.fit(df, "x", "y", parts)
    xs, want = min_max(x, y)
    got = {r.x: r.p for r in isotonic.apply(m, df, "x", "p").collect()}
    assert got.pop(None) is None
    assert all(abs(got[a] - b) < 1e-9 for a, b in zip(xs, want))
    steps = [(r.boundary, r.prediction) for r in m.table.orderBy("boundary").collect()]
    assert all(a[0] < b[0] and a[1] <= b[1] for a, b in zip(steps, steps[1:]))
    ends = isotonic.apply(m, spark.createDataFrame([(-9.0,), (9.0,)], "x double"), "x", "p").collect()
    assert abs(ends[0].p - want[0]) < 1e-9 and abs(ends[1].p - want[-1]) < 1e-9


def test_calibrator_reads_every_row(spark):
    # one solved row among 60,000 of one score: any sample of them gives another rate
    rows = spark.range(60000).select(F.col("id").cast("string").alias("user_id"), F.lit("p").alias("problem_id"),
                                     F.lit(0.5).alias("s"), (F.col("id") == 7).alias("solved"))
    assert [r.prediction for r in models.fit_calibrator(rows, "s", "solved").table.collect()] == [1 / 60000]


def test_isotonic_falling_labels_are_one_block(spark):
    df = spark.createDataFrame([(i / 10, float(i < 5)) for i in range(10)], "x double, y double")
    m = isotonic.fit(df, "x", "y", 4)
    assert [(r.boundary, r.prediction) for r in m.table.orderBy("boundary").collect()] == [(0.0, 0.5), (0.9, 0.5)]
    assert isotonic.fit(df.limit(0), "x", "y").table.count() == 0


def test_platt_gradient_vanishes(spark):
    rnd = random.Random(1)
    rows = [(x, float(rnd.random() < 1 / (1 + math.exp(1 - 3 * x)))) for x in (rnd.uniform(-1, 2) for _ in range(500))]
    m = models.fit_platt(spark.createDataFrame(rows, "x double, y double"), "x", "y")
    err = [1 / (1 + math.exp(-(m.slope * x + m.intercept))) - y for x, y in rows]
    assert abs(sum(err)) < 1e-6 and abs(sum(e * x for e, (x, _) in zip(err, rows)) + m.slope) < 1e-6
    one = models.fit_platt(spark.createDataFrame([(0.1, 1.0), (0.3, 1.0)], "x double, y double"), "x", "y")
    assert math.isfinite(one.slope) and one.intercept > 5


def test_als_half_step_is_the_fit(spark):
    rnd = random.Random(2)
    rows = [(f"u{u}", f"p{p}", rnd.random() < .6, rnd.randint(0, 2)) for u in range(20) for p in range(15) if rnd.random() < .4]
    i = spark.createDataFrame(rows, "user_id string, problem_id string, solved boolean, penalty_count int")
    fit = models.fit_als(i, rank=8, max_iter=5)
    users, items = fit.factors()
    want = {r.id: r.features for r in users.collect()}
    got = {r.id: r.features for r in als_step.user_factors(models.implicit_weights(i), items).collect()}
    assert set(got) == set(want)
    for u, f in want.items():
        assert np.allclose(got[u], f, atol=1e-3)
    # a new user is folded in, next to one with the same history
    like = i.where("user_id = 'u3'").withColumn("user_id", F.lit("new"))
    new = als_step.user_factors(models.implicit_weights(like), items).collect()
    assert [r.id for r in new] == ["new"] and np.allclose(new[0].features, got["u3"])
    # scores of a fitted model: one for each pair, calibrated ones within [0, 1]
    pairs = spark.createDataFrame([("u3", p) for p in ("p1", "p2", "p3")], "user_id string, problem_id string")
    scores = scoring.apply_minmax(fit.raw_scores(pairs), "als_raw", None, "p").collect()
    assert len(scores) == 3 and all(0 <= r.p <= 1 for r in scores)


def test_als_parts_add_up(spark, monkeypatch):
    rows = [(u, f"p{p}", 1.0 / (1 + p % 3)) for u in ("a", "b") for p in range(30)]
    w = spark.createDataFrame(rows, "user_id string, problem_id string, weight double")
    items = spark.createDataFrame([(f"p{p}", [p / 10, 1.0 - p / 50]) for p in range(30)], "id string, features array<double>")
    whole = {r.id: r.features for r in als_step.user_factors(w, items).collect()}
    monkeypatch.setattr(als_step, "PART", 7)
    assert all(np.allclose(r.features, whole[r.id]) for r in als_step.user_factors(w, items).collect())


def test_unknown_users_and_items(spark):
    pairs = spark.createDataFrame([("u", "p"), ("u", "new"), ("new", "p")], "user_id string, problem_id string")
    uf = spark.createDataFrame([("u", [1.0, 2.0])], "id string, features array<double>")
    itf = spark.createDataFrame([("p", [0.5, 0.25])], "id string, features array<double>")
    got = {(r.user_id, r.problem_id): r.als_raw for r in scoring.als_raw_scores(pairs, uf, itf).collect()}
    assert got == {("u", "p"): 1.0, ("u", "new"): 0.0, ("new", "p"): 0.25}


def test_tag_classes_expand_to_all_pairs(spark):
    tags = {"a": "xy", "b": "xy", "c": "xyz", "d": "z", "e": "zw", "f": "xy", "g": "z"}
    pt = spark.createDataFrame([(p, t) for p, ts in tags.items() for t in ts], "problem_id string, tag string")
    member, classes = graph.tag_classes(pt)
    assert classes.count() == 4 and member.count() == 7
    for least in (1, 2):
        want = {(p, q, len(set(tags[p]) & set(tags[q]))) for p in tags for q in tags if p < q}
        want = {w for w in want if w[2] >= least}
        assert {tuple(r) for r in graph.shared_tag_graph(pt, least, block_size=2).collect()} == want
    cosine = {(r.p1, r.p2): r.similarity for r in graph.tag_cosine(pt).collect()}
    assert cosine["a", "b"] == 1.0 and abs(cosine["c", "d"] - 1 / math.sqrt(3)) < 1e-12


def test_factor_cells_are_a_left_join(spark, monkeypatch):
    """Pairs and factors with repeated and null keys, null and odd factors, in many cells."""
    from edgecraft.functions.exprs import dot
    from edgecraft.operators import extras, factor_dots
    rnd = random.Random(5)
    vec = lambda n=4: [rnd.uniform(-1, 1) for _ in range(n)]
    users = [(f"u{k}", vec()) for k in range(40)] + [("u1", vec()), ("hole", [1.0, None, 0.5, 1.0]), ("empty", None), ("short", vec(2)), (None, vec())]
    items = [(f"p{k}", vec()) for k in range(30)] + [("p2", vec()), ("p2", vec()), ("pnull", None), ("pshort", vec(2)), (None, vec())]
    names = [u for u, _ in users] + ["new"], [p for p, _ in items] + ["none"]
    rows = [(rnd.choice(names[0]), rnd.choice(names[1]), rnd.choice([None, k])) for k in range(900)] + [("short", "pshort", 1), ("u1", "p2", 2)] * 2
    pairs = spark.createDataFrame(rows, "user_id string, problem_id string, mark int")
    uf = spark.createDataFrame(users, "id string, features array<float>")
    itf = spark.createDataFrame(items, "id string, features array<double>")
    j = pairs.join(itf.select(F.col("id").alias("problem_id"), F.col("features").alias("p")), "problem_id", "left") \
        .join(uf.select(F.col("id").alias("user_id"), F.col("features").alias("u")), "user_id", "left")
    key = lambda r: str(r)
    fixed = lambda d, c: sorted(((r.user_id, r.problem_id, r.mark, None if r[c] is None else round(r[c], 9)) for r in d.collect()), key=key)
    raw = F.when(F.col("u").isNull(), 0.25).when(F.col("p").isNull(), 0.0).otherwise(dot("u", "p"))
    monkeypatch.setattr(factor_dots, "BLOCK_BYTES", 300)
    monkeypatch.setattr(factor_dots, "PAIRS", 16)
    got = scoring.als_raw_scores(pairs, uf, itf)
    assert got.columns == ["user_id", "problem_id", "mark", "als_raw"]
    assert fixed(got, "als_raw") == fixed(j.withColumn("als_raw", raw), "als_raw")
    # no pair carries a factor through a join with the items: only users are joined
    assert got._jdf.queryExecution().optimizedPlan().toString().count("Join ") == 1
    mu = spark.createDataFrame([(0.5,)], "global_mean double")
    ub, ib = (spark.createDataFrame([(k, 0.1)], f"{c} string, bias double") for k, c in (("u1", "user_id"), ("p2", "problem_id")))
    bias = F.when(F.col("user_id") == "u1", 0.1).otherwise(0.0) + F.when(F.col("problem_id") == "p2", 0.1).otherwise(0.0)
    want = j.withColumn("prediction", 0.5 + bias + F.coalesce(dot("u", "p"), F.lit(0.0)))
    assert fixed(extras.bias_prediction(pairs, mu, ub, ib, uf, itf), "prediction") == fixed(want, "prediction")
    assert scoring.als_raw_scores(pairs.limit(0), uf, itf).count() == 0
    assert scoring.als_raw_scores(pairs, uf.limit(0), itf.limit(0)).where("als_raw = 0.25").count() == len(rows)


def test_fit_cuts_its_lineage_each_iteration(spark, monkeypatch):
    import time

    from edgecraft import session
    seen, real = {}, models.ALS
    monkeypatch.setattr(models, "ALS", lambda **kw: seen.update(kw) or real(**kw))
    i = spark.createDataFrame([("a", "p", True, 0), ("b", "p", False, 1), ("a", "q", True, 1)],
                              "user_id string, problem_id string, solved boolean, penalty_count int")
    assert models.fit_als(i, rank=2, max_iter=2).factors()[0].count() == 2 and seen["checkpointInterval"] == 1
    runs = lambda: sum(b.getCollectionCount() for b in
                       spark.sparkContext._jvm.java.lang.management.ManagementFactory.getGarbageCollectorMXBeans())
    before = runs()
    with session.garbage_collected(spark, .05):
        time.sleep(1)
    assert runs() > before
