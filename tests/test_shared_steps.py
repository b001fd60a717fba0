"""Steps that many queries share: ingest, build, similar lists, peer bands."""

import datetime

from pyspark.sql import functions as F

from edgecraft.operators import clean, graph
from edgecraft.plans import build, store
from edgecraft.sources import fixtures


def plan(df) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_each_line_and_submission_is_parsed_once(spark, sf):
    text = plan(build.exploded_rows(spark, sf, "jsonl"))
    assert text.count("from_json") == 2


def test_repeated_keys_are_left_out_without_carrying_rows(spark):
    rows = spark.createDataFrame([("a", None, 1), ("a", None, 2), ("b", "x", 3), (None, "x", 4), (None, "x", 4), ("a", "x", 5)],
                                 "u string, p string, v int")
    out = clean.without_repeated_keys(rows, ["u", "p"], store.table)
    assert sorted(r.v for r in out.collect()) == [3, 5]
    same = clean.drop_duplicate_keys(rows, ["u", "p"])
    assert sorted(map(tuple, out.collect()), key=str) == sorted(map(tuple, same.collect()), key=str)


def test_tables_in_the_checkpoint_folder_are_pruned(spark):
    t = store.table(spark.range(5).selectExpr("id", "array(cast(id as string)) as tags"))
    assert "FileScan parquet" in t.select("id")._jdf.queryExecution().toString()
    assert [r.id for r in t.select("id").orderBy("id").collect()] == [0, 1, 2, 3, 4]


def _lists(spark):
    """Problems 0..39 in lists that several of them share; with an entry without a slug."""
    import json
    entries = {f"l{i}": [{"titleSlug": f"p{(i * 7 + j) % 44}", "title": f"T{(i * 7 + j) % 44}"} for j in range(5)] for i in range(6)}
    entries["l2"].append({"title": "no slug"})
    lists = spark.createDataFrame([(k, json.dumps(v)) for k, v in entries.items()], "list_id string, similarQuestions string")
    q = spark.createDataFrame([(str(i), f"T{i}", f"p{i}", None if i % 9 == 8 else f"l{i % 7}") for i in range(40)],
                              "frontendQuestionId string, title string, titleSlug string, list_id string")
    return q, lists, q.join(lists, "list_id", "left").withColumn("similarQuestions", F.coalesce("similarQuestions", F.lit("[]")))


def test_shared_lists_give_the_edges_of_listed_pairs(spark):
    q, lists, flat = _lists(spark)
    for got, want in zip(graph.similar_problem_graph(q, lists), graph.similar_problem_graph(flat)):
        assert sorted(map(tuple, got.collect()), key=str) == sorted(map(tuple, want.collect()), key=str)


def test_boost_and_penalty_without_listing_neighbours(spark):
    q, lists, flat = _lists(spark)
    cand = spark.range(400).selectExpr("concat('u', id % 10) as user_id", "concat('p', (id * 13) div 10 % 44) as problem_id").distinct()
    hard = cand.where(F.xxhash64("user_id", "problem_id") % 4 == 0)
    whole = graph.slug_edges(*graph.similar_problem_graph(flat))
    one_way = graph.similar_slug_relation(flat, symmetric_=False)
    for rel, undirected in ((whole, True), (one_way, False)):
        by_list = graph.similar_slug_lists(q, lists, undirected)
        want = graph.graph_boost(cand, hard, rel, symmetric_rel=undirected)
        got = graph.graph_boost(cand, hard, by_list, symmetric_rel=undirected)
        assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
        assert got.select("boost").distinct().count() == (2 if undirected else 3)
    sel = cand.withColumn("tier", F.lit("t")).withColumn("pos", F.xxhash64("problem_id") % 50)
    want = graph.clique_penalty(sel, whole)
    got = graph.clique_penalty(sel, graph.similar_slug_lists(q, lists, True))
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
    assert got.select("clique_penalty").distinct().count() == 2


def test_peer_rates_equal_a_band_join(spark):
    from edgecraft.operators import peers
    rows = spark.range(900).selectExpr(
        "concat('u', id % 150) as user_id", "id % 3 = 0 as solved",
        "array(concat('t', id % 7), concat('t', (id * 5) % 11), cast(null as string)) as tags",
        "cast(case when id % 150 < 140 then ((id % 150) * 37 % 100) * 30 + 0.003 * (id % 150) else null end as double) as user_rating")
    ut = peers.user_tag_counts(rows).where("tag is not null").join(peers.user_ratings(rows), "user_id").where("r is not null")
    a, b = ut.alias("a"), ut.alias("b")
    near = (F.col("a.tag") == F.col("b.tag")) & (F.abs(F.col("a.r") - F.col("b.r")) <= 100000)
    want = a.join(b, near).groupBy("a.user_id", "a.tag").agg(F.sum("b.s").alias("s"), F.sum("b.c").alias("c"))
    want = {(r.user_id, r.tag): r.s / r.c for r in want.collect()}
    out = peers.user_tag_peers(rows)
    text = out._jdf.queryExecution().optimizedPlan().toString()
    assert {(r.user_id, r.tag): r.peer_rate for r in out.collect()} == want
    assert "FlatMapGroupsInArrow" in text and "Window" not in text       # users as rows of arrays, no row for each tag


def test_contest_peer_rates_equal_a_band_join(spark):
    from edgecraft.operators import peers
    rows = spark.range(600).selectExpr(
        "concat('u', id % 60) as user_id", "concat('c', id % 4) as contest_id", "id % 3 = 0 as solved",
        "case when id % 17 = 0 then null else array(concat('t', id % 7), concat('t', (id * 5) % 11), cast(null as string)) end as tags",
        "cast(case when id % 60 < 55 then ((id * 37) % 100) / 50.0 - 0.4 else null end as double) as rank_percentile")
    r = rows.select("user_id", "contest_id", "solved", "tags", peers.to_micro(F.col("rank_percentile")).alias("r"))
    agg = r.select("contest_id", "r", "solved", F.explode("tags").alias("tag")).where("tag is not null") \
        .groupBy("contest_id", "tag", "r").agg(F.sum(F.col("solved").cast("long")).alias("S"), F.count(F.lit(1)).alias("C")).alias("a")
    users = r.groupBy("contest_id", "user_id", "r").agg(F.count(F.lit(1)).alias("n")).alias("u")
    near = (F.col("a.contest_id") == F.col("u.contest_id")) & (F.abs(F.col("a.r") - F.col("u.r")) <= 100000)
    per = users.join(agg, near).groupBy("u.contest_id", "u.user_id", "u.r", "n", "tag").agg(F.sum("S").alias("S"), F.sum("C").alias("C"))
    want = {(x.user_id, x.tag): round(x.score, 9) for x in per.groupBy("user_id", "tag").agg(
        (F.sum(F.col("n") * F.col("S") / F.col("C")) / F.sum("n")).alias("score")).collect()}
    out = peers.contest_peer_tag_performance(rows)
    assert "FlatMapGroupsInArrow" in plan(out)
    assert {(x.user_id, x.tag): round(x.score, 9) for x in out.collect()} == want


def test_ranks_and_homes_meet_orders_not_lines(spark, tmp_path):
    def put(name, rows, schema):
        spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/{name}.parquet")
    day = lambda d: datetime.datetime(1995, 2, d)
    put("orders", [(1, 7, 10.0, day(3)), (2, 7, 30.0, day(9)), (3, 8, 20.0, day(5)), (4, None, 5.0, day(5))],
        "o_orderkey long, o_custkey long, o_totalprice double, o_orderdate timestamp_ntz")
    put("lineitem", [(o, p, n, 3.0, 1.0, 0.03, "N") for o in (1, 2, 3, 4) for n, p in enumerate((5, 6, 6), 1)],
        "l_orderkey long, l_partkey long, l_linenumber int, l_quantity double, l_extendedprice double, l_discount double, l_returnflag string")
    put("customer", [(7, 1), (7, 2), (8, 9)], "c_custkey long, c_nationkey int")
    put("nation", [(1, "A", 0), (2, "B", 0)], "n_nationkey int, n_name string, n_regionkey int")
    put("region", [(0, "R")], "r_regionkey int, r_name string")
    lines = fixtures.submission_rows(spark, str(tmp_path))
    text = plan(lines)
    assert text.index("Aggregate") < text.index("Join")
    assert sorted((r.user_slug or "", r.frontend_id, r["rank"]) for r in lines.collect()) == sorted(
        [("u7", p, 1) for p in "5566"] + [("u8", p, 2) for p in "56"] + [("", p, None) for p in "56"])
    recs = fixtures.contest_records(spark, str(tmp_path))
    text = plan(recs)
    assert "o_orderkey" in text[text.index("Join"):].splitlines()[0]
    assert sorted((r["_page"], r["rank"], r.country_name, r.data_region, len(r.submissions)) for r in recs.where("_page < 3").collect()) == [
        (1, 1, "A", "R", 2), (1, 1, "B", "R", 2), (2, 1, "A", "R", 2), (2, 1, "B", "R", 2)]
    assert [(r["_page"], r["rank"], r.country_name) for r in recs.where("_page > 2").orderBy("_page").collect()] == [(3, 2, None), (4, None, None)]


def test_records_of_the_scaled_score_are_parsed_once(spark, sf):
    from edgecraft.plans import queries_misc
    assert "from_json" not in plan(queries_misc.q_contest_score_scaled(spark, sf))


def test_the_feed_of_the_ingest_is_compressed(spark, sf, tmp_path, monkeypatch):
    from edgecraft.plans import queries_misc
    monkeypatch.setattr(queries_misc, "_scratch", lambda s: str(tmp_path))
    got = queries_misc.q_incremental_ingest(spark, sf)
    want = queries_misc._records(spark, sf).where("user_slug is not null").select(*got.columns).distinct()
    assert sorted(map(tuple, got.collect()), key=str) == sorted(map(tuple, want.collect()), key=str)
    files = [f.name for f in (tmp_path / "src").glob("part-*")]
    assert files and all(f.endswith(".txt.gz") for f in files)


def test_novelty_scores_the_listed_pairs_only(spark, sf, monkeypatch):
    from edgecraft.operators import extras, features, scoring
    from edgecraft.plans import queries_misc
    whole, seen = scoring.content_raw_scores, []

    def spy(pairs, *rest):
        seen.append(pairs)
        return whole(pairs, *rest)
    monkeypatch.setattr(scoring, "content_raw_scores", spy)
    got = queries_misc.q_coverage_novelty(spark, sf).collect()
    assert seen[0].groupBy("user_id").count().agg(F.max("count")).first()[0] <= 10
    i, problems = build.interactions(spark, sf), build.problems(spark, sf)
    pt = features.problem_tags(problems)
    every = whole(i.select("user_id", "problem_id").distinct(), scoring.content_profiles(i, pt, problems), pt)
    want = extras.coverage_novelty(seen[0], problems, every).collect()
    assert [tuple(round(x, 9) for x in r) for r in got] == [tuple(round(x, 9) for x in r) for r in want]


def _rows(df):
    return sorted(map(tuple, df.collect()), key=str)


def test_adjacency_of_classes_is_that_of_pairs(spark):
    q, lists, flat = _lists(spark)
    whole = graph.slug_edges(*graph.similar_problem_graph(flat))
    by_list = graph.slug_adjacency(graph.similar_slug_lists(q, lists, undirected=True))
    want = graph.slug_adjacency(whole)
    assert _rows(by_list) == _rows(want) and want.count() > 30


def test_explanations_without_listing_neighbours(spark):
    from edgecraft.operators import coldstart
    q, lists, flat = _lists(spark)
    pairs = spark.range(300).selectExpr("concat('u', id % 10) as user_id", "concat('p', (id * 13) div 10 % 44) as problem_id").distinct()
    solved, hard, cards = (pairs.where(F.xxhash64("user_id", "problem_id") % 4 == k) for k in (0, 1, 2))
    cards = cards.select("user_id", F.lit("blind_spots").alias("tier"), F.xxhash64("problem_id").alias("pos"), "problem_id",
                         F.lit(0.5).alias("p_solve"), F.array(F.lit("t")).alias("tags"))
    rates = spark.createDataFrame([("u1", "t", 0.1)], "user_id string, tag string, rate double")
    peer = spark.createDataFrame([("u1", "t", 0.9)], "user_id string, tag string, peer_rate double")
    titles = q.select(F.col("titleSlug").alias("problem_id"), "title")
    for undirected in (True, False):
        rel = graph.slug_edges(*graph.similar_problem_graph(flat)) if undirected else graph.similar_slug_relation(flat)
        got, want = (_rows(coldstart.explanation_signals(cards, rates, peer, r, solved, hard, titles))
                     for r in (graph.similar_slug_lists(q, lists, undirected), rel))
        assert got == want and len({str(r[-2]) for r in got}) > 5


def test_pool_blocks_take_lists(spark):
    from edgecraft.config import Config
    from edgecraft.operators import blocks
    q, lists, flat = _lists(spark)
    history = spark.range(120).selectExpr("concat('u', id % 12) as user_id", "concat('p', id * 17 % 44) as problem_id",
                                          "id % 3 = 0 as solved", "cast(id % 2 as int) as penalty_count")
    catalog = spark.range(44).selectExpr("concat('p', id) as problem_id", "array(concat('t', id % 30), 'x') as tags", "id as cat_pos")
    factors = lambda d, c: d.select(F.col(c).alias("id"), F.array(F.lit(1.0)).alias("features")).distinct()
    pools = [_rows(blocks.score_pool_blocks(
        history.select("user_id"), history, catalog, rel, factors(history, "user_id"), factors(catalog, "problem_id"), keep="all",
        cfg=Config(min_shared_tags=2), item_block=b)) for b in (1 << 15, 10)
        for rel in (graph.similar_slug_lists(q, lists), graph.similar_slug_relation(flat))]
    assert pools[0] == pools[1] == pools[2] == pools[3]
    assert {r[5] for r in pools[0]} == {0.0, 0.05} and 20 < len(pools[0]) < 12 * 40


def test_boost_orders_nothing_by_list(spark):
    q, lists, _ = _lists(spark)
    cand = spark.createDataFrame([("u", "p1"), ("u", "p8"), ("v", "p1"), (None, "p1"), ("u", None)], "user_id string, problem_id string")
    hard = spark.createDataFrame([("u", "p1"), ("w", "p8"), (None, "p8")], "user_id string, problem_id string")
    out = graph.graph_boost(cand, hard, graph.similar_slug_lists(q, lists))
    assert "windowspecdefinition(user_id" not in plan(out) and out.count() == 5
    want = graph.graph_boost(cand, hard, graph.similar_slug_relation(q.join(lists, "list_id", "left").withColumn(
        "similarQuestions", F.coalesce("similarQuestions", F.lit("[]"))), symmetric_=False))
    assert _rows(out) == _rows(want)
