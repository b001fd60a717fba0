"""Registered queries: sources / sinks, cold start and explanations,
profiles, planned extras and the Spark ML jobs (A*, F16, F17, H13, I*, J6,
K*, L*)."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from edgecraft.config import DEFAULT
from edgecraft.operators import coldstart, extras, features, graph, models, peers, profile, scoring, tiers
from edgecraft.plans import backtest, build, bundle, recommend, refresh, store
from edgecraft.plans.oracle_base import with_base
from edgecraft.plans.queries_scoring import (ENSEMBLE_SQL, HB, POOL, PROFILE_SQL, SPLIT_SQL, TIER_SQL, _catalog_pos, _ensemble,
                                             _factor_tables, _history_batch, _slug_rel, _tiers, content_sql, syn, FACTORS_SQL)
from edgecraft.plans.registry import query
from edgecraft.session import checkpoint_dir
from edgecraft.sources import fixtures, jsonl
from edgecraft.sources.tables import known_user_ids, write_parquet
from edgecraft.streaming.ingest import run_ingest


def _inter(spark, sf_dir):
    return build.interactions(spark, sf_dir)


def _scratch(spark) -> str:
    """A fresh folder inside the shared checkpoint folder."""
    return f"{checkpoint_dir(spark).rstrip('/')}/edgecraft-{uuid.uuid4().hex}"


def _records(spark, sf_dir):
    return jsonl.good_records(jsonl.parse_contest_lines(fixtures.contest_jsonl(spark, sf_dir)))


RECS_SQL = """
recs AS (
  SELECT 'biweekly-contest-' || CAST(l.cn AS VARCHAR) AS contest_id,
         'u' || CAST(l.o_custkey AS VARCHAR) AS user_slug, l.o_orderkey AS page,
         n.n_name AS country_name, r.r_name AS data_region,
         CAST(sum(CASE WHEN CAST(round(l.l_discount * 100) AS INTEGER) % 3 = 0 THEN 1 ELSE 0 END) AS BIGINT) AS score,
         max(CAST(1000000000 AS BIGINT) + CAST(l.cn AS BIGINT) * 2592000 + CAST(floor(l.l_quantity) AS BIGINT) * 60
             + CAST(l.l_linenumber AS BIGINT) * 7) AS finish_time,
         any_value(rk.rnk) AS rank
  FROM li1 l LEFT JOIN customer c ON c.c_custkey = l.o_custkey
  LEFT JOIN nation n ON n.n_nationkey = c.c_nationkey LEFT JOIN region r ON r.r_regionkey = n.n_regionkey
  LEFT JOIN rk ON rk.o_custkey = l.o_custkey AND rk.cn = l.cn
  GROUP BY l.o_orderkey, l.cn, l.o_custkey, n.n_name, r.r_name
  UNION ALL SELECT NULL, NULL, 900001, NULL, NULL, NULL, NULL, NULL
  UNION ALL SELECT NULL, NULL, 900002, NULL, NULL, NULL, NULL, NULL
)
"""

# ------------------------------------------------------------------ A


@query("records_sample", with_base("""
SELECT contest_id, user_slug, CAST(rank AS VARCHAR) AS rank, score FROM recs ORDER BY page, user_slug LIMIT 100
""", RECS_SQL))
def q_records_sample(spark, sf_dir):
    """A3: the first 100 parsed records of the feed by page (a sampling operator)."""
    return jsonl.limit_records(jsonl.parse_contest_lines(fixtures.contest_jsonl(spark, sf_dir)), 100) \
        .select("contest_id", "user_slug", "rank", "score")


@query("contest_dir_scan", with_base("""
SELECT (SELECT count(*) FROM recs) AS records, CAST(2 AS BIGINT) AS bad_lines,
       (SELECT count(*) FROM recs) + 2 AS combined_lines
""", RECS_SQL))
def q_contest_dir_scan(spark, sf_dir):
    """A2 + A4 + A5: the feed as a folder of files, scanned, audited and combined."""
    root = _scratch(spark)
    fixtures.contest_jsonl(spark, sf_dir).where("value <> ''").write.text(f"{root}/src")
    jsonl.combine_files(spark, f"{root}/src", f"{root}/all", pattern="*.txt")
    recs = jsonl.read_contest_dir(spark, f"{root}/src", "*.txt")
    bad = jsonl.bad_record_audit(recs).agg(F.sum("bad_lines").alias("bad_lines"))
    return jsonl.good_records(recs).agg(F.count(F.lit(1)).alias("records")).crossJoin(bad).crossJoin(
        spark.read.text(f"{root}/all").agg(F.count(F.lit(1)).alias("combined_lines")))


@query("dataset_roundtrip", with_base("""
SELECT user_id, contest_id, problem_id, solved, CAST(penalty_count AS BIGINT) AS penalty_count,
       round(difficulty_proxy, 6) AS difficulty_proxy FROM inter
"""))
def q_dataset_roundtrip(spark, sf_dir):
    """Interactions and problems written as Parquet and read back."""
    out = _scratch(spark)
    build.write_dataset(spark, sf_dir, out, source="tables")
    return spark.read.parquet(f"{out}/interactions.parquet").select(
        "user_id", "contest_id", "problem_id", "solved", "penalty_count", "difficulty_proxy")


@query("known_users", with_base("SELECT DISTINCT user_id FROM inter"))
def q_known_users(spark, sf_dir):
    """Projected scan — only user_id is read from the stored table."""
    out = _scratch(spark)
    write_parquet(_inter(spark, sf_dir).drop("tags"), f"{out}/interactions.parquet")
    return known_user_ids(spark, f"{out}/interactions.parquet")


PAGES_SQL = """
pg AS (SELECT 'biweekly-contest-' || CAST(cn AS VARCHAR) AS contest_id, cn, unnest(range(1, 1 + greatest(1,
         CAST(ceil(n / 25.0) AS BIGINT)))) AS page
       FROM (SELECT (year(o_orderdate) - 1995) * 12 + month(o_orderdate) AS cn, count(DISTINCT o_custkey) AS n
             FROM orders GROUP BY 1))
"""


@query("page_audit", with_base("""
SELECT contest_id, count(*) AS expected_pages,
       CAST(sum(CASE WHEN (cn * 31 + page) % 10 <> 0 THEN 1 ELSE 0 END) AS BIGINT) AS present_pages,
       CAST(sum(CASE WHEN (cn * 31 + page) % 10 = 0 THEN 1 ELSE 0 END) AS BIGINT) AS missing_pages
FROM pg GROUP BY contest_id
""", PAGES_SQL))
def q_page_audit(spark, sf_dir):
    """Expected, present and missing result pages per contest."""
    return extras.page_audit(*fixtures.page_feed(spark, sf_dir))


@query("missing_pages", with_base("""
SELECT contest_id, page AS _page FROM pg WHERE (cn * 31 + page) % 10 = 0
""", PAGES_SQL))
def q_missing_pages(spark, sf_dir):
    """The pages that a resumed run still has to fetch."""
    return extras.missing_pages(*fixtures.page_feed(spark, sf_dir))


@query("incremental_ingest", with_base("""
SELECT contest_id, user_slug, page AS _page, score FROM recs WHERE user_slug IS NOT NULL
""", RECS_SQL))
def q_incremental_ingest(spark, sf_dir):
    """Half of the feed ingested by a streaming query, then a restart on the
    same checkpoint over the whole feed (the first half comes again)."""
    root = _scratch(spark)
    feed = fixtures.contest_jsonl(spark, sf_dir)
    feed.where(F.xxhash64("value") % 2 == 0).write.text(f"{root}/src", compression="gzip")
    run_ingest(spark, f"{root}/src", f"{root}/table", f"{root}/ckpt", pattern="*.txt.gz")
    feed.write.mode("append").text(f"{root}/src", compression="gzip")
    out = run_ingest(spark, f"{root}/src", f"{root}/table", f"{root}/ckpt", pattern="*.txt.gz")
    return out.where("user_slug is not null").select("contest_id", "user_slug", "_page", "score")


@query("roadmap", """
SELECT CAST(p_partkey + 1 AS BIGINT) AS "order", 'part-' || CAST(p_partkey AS VARCHAR) AS slug, p_name AS title,
       p_brand AS topic,
       CASE WHEN p_size <= 15 THEN 'Easy' WHEN p_size <= 35 THEN 'Medium' ELSE 'Hard' END AS difficulty
FROM part WHERE p_size = 25
""")
def q_roadmap(spark, sf_dir):
    """A10: roadmap JSON document -> one row per problem."""
    return coldstart.read_roadmap(fixtures.roadmap_json(spark, sf_dir))


@query("recommendations_json", with_base("""
SELECT user_id, tier, pos, problem_id AS slug, round(round_even(score, 4), 6) AS p_solve FROM tiered
""", TIER_SQL))
def q_recommendations_json(spark, sf_dir):
    """One JSON document per user with its tier lists, written to a folder,
    read back and unfolded."""
    t = tiers.enrich(_tiers(spark, sf_dir)).select("user_id", "tier", "pos", "problem_id", "p_solve")
    per = t.groupBy("user_id", "tier").agg(F.sort_array(F.collect_list(F.struct(
        "pos", F.col("problem_id").alias("slug"), "p_solve"))).alias("items"))
    doc = per.groupBy("user_id").agg(F.map_from_entries(F.collect_list(F.struct(
        "tier", F.transform("items", lambda x: x.dropFields("pos"))))).alias("tiers"))
    path = _scratch(spark)
    doc.write.json(path)
    back = spark.read.schema("user_id string, tiers map<string, array<struct<slug: string, p_solve: double>>>").json(path)
    items = back.select("user_id", F.explode("tiers").alias("tier", "items"))
    return items.select("user_id", "tier", F.posexplode("items").alias("pos", "x")).select(
        "user_id", "tier", (F.col("pos") + 1).alias("pos"), "x.slug", "x.p_solve")


@query("feature_store", with_base("""
SELECT (SELECT count(*) FROM inter) AS interactions, (SELECT count(DISTINCT user_id) FROM inter) AS users,
       CAST(0 AS BIGINT) AS problem_rows
"""))
def q_feature_store(spark, sf_dir):
    """Stored interactions and user features read through the feature
    store; the problem table was never written, so it is empty."""
    root, i = _scratch(spark), _inter(spark, sf_dir)
    write_parquet(i, f"{root}/interactions.parquet")
    write_parquet(features.user_features(i, with_tags=False), f"{root}/user_features.parquet")
    store_ = features.FeatureStore(spark, root)
    n = lambda d, c: d.agg(F.count(F.lit(1)).alias(c))
    return n(store_.interactions, "interactions").crossJoin(n(store_.user_features, "users")).crossJoin(
        n(store_.problem_features, "problem_rows"))


# ------------------------------------------------------------------ I


@query("user_routing", with_base("""
SELECT 'u' || CAST(c_custkey AS VARCHAR) AS user_slug,
       substr(sha256('lrs_v1:' || 'u' || CAST(c_custkey AS VARCHAR)), 1, 16) AS user_id,
       substr(sha256('lrs_v1:' || 'u' || CAST(c_custkey AS VARCHAR)), 1, 16) IN (SELECT user_id FROM inter) AS warm
FROM customer
"""))
def q_user_routing(spark, sf_dir):
    """Warm when the hashed slug is a known user."""
    slugs = fixtures.read_table(spark, sf_dir, "customer", "c_custkey") \
        .select(fixtures.user_slug(F.col("c_custkey")).alias("user_slug"))
    return coldstart.route_users(slugs, _inter(spark, sf_dir))


@query("roadmap_cards", """
SELECT "order", slug, title, topic AS tag_topic, difficulty AS tag_difficulty, 'neetcode150' AS tier,
       round(round_even(least(0.85, CASE difficulty WHEN 'Easy' THEN 0.72 WHEN 'Medium' THEN 0.52
                                                    WHEN 'Hard' THEN 0.38 ELSE 0.5 END
                                      + greatest(0.0, 0.08 - "order" / 150.0 * 0.08)), 4), 6) AS p_solve,
       printf('NeetCode 150 roadmap — problem #%d in the curated interview path.', "order") AS signal_1,
       printf('%s · %s: recommended starting point without contest history.', difficulty, topic) AS signal_2,
       CAST(2 AS BIGINT) AS signal_count
FROM (SELECT CAST(p_partkey + 1 AS BIGINT) AS "order", 'part-' || CAST(p_partkey AS VARCHAR) AS slug,
             p_name AS title, p_brand AS topic,
             CASE WHEN p_size <= 15 THEN 'Easy' WHEN p_size <= 35 THEN 'Medium' ELSE 'Hard' END AS difficulty
      FROM part WHERE p_size = 25)
ORDER BY "order" LIMIT 10
""")
def q_roadmap_cards(spark, sf_dir):
    """The first 10 roadmap cards for a cold-start user."""
    c = coldstart.roadmap_cards(coldstart.read_roadmap(fixtures.roadmap_json(spark, sf_dir)), 10)
    return c.select("order", "slug", "title", F.col("tags")[0].alias("tag_topic"),
                    F.col("tags")[1].alias("tag_difficulty"), "tier", "p_solve",
                    F.col("signals")[0].alias("signal_1"), F.col("signals")[1].alias("signal_2"),
                    "signal_count")


@query("user_summary", with_base("""
SELECT user_id, count(DISTINCT contest_id) AS contests, count(DISTINCT problem_id) AS attempted,
       count(DISTINCT CASE WHEN solved THEN problem_id END) AS solved_count
FROM inter GROUP BY user_id
"""))
def q_user_summary(spark, sf_dir):
    """I3."""
    return coldstart.user_summary(_inter(spark, sf_dir))


EXPL_SQL = TIER_SQL + """,
st AS (SELECT DISTINCT user_id, problem_id FROM inter WHERE penalty_count >= 1 OR NOT solved),
sv AS (SELECT DISTINCT user_id, problem_id FROM inter WHERE solved),
cards AS (SELECT t.user_id, t.tier, t.pos, t.problem_id, round_even(t.score, 4) AS p_solve, c.tags
          FROM tiered t JOIN cat c USING (problem_id)),
ctag AS (SELECT user_id, tier, pos, unnest(tags) AS tag, generate_subscripts(tags, 1) AS ti FROM cards),
psig AS (SELECT c.user_id, c.tier, c.pos,
                list(printf('Peers at your level solve %s problems more often (you: %d%% vs peers: %d%%)',
                            c.tag, CAST(round_even(u.rate * 100, 0) AS INTEGER),
                            CAST(round_even(p.peer_rate * 100, 0) AS INTEGER)) ORDER BY c.ti) AS ps
         FROM ctag c JOIN urate u USING (user_id, tag) JOIN peer p USING (user_id, tag)
         WHERE u.rate < p.peer_rate - 0.15 GROUP BY ALL),
simn AS (SELECT c.user_id, c.tier, c.pos, min(a.dst_slug) AS nb FROM cards c
         JOIN sadj a ON a.src_slug = c.problem_id JOIN sv ON sv.user_id = c.user_id AND sv.problem_id = a.dst_slug
         GROUP BY ALL),
reln AS (SELECT c.user_id, c.tier, c.pos, min(x.nb) AS nb FROM cards c
         JOIN (SELECT src_slug AS me, dst_slug AS nb FROM sadj UNION SELECT dst_slug, src_slug FROM sadj) x
           ON x.me = c.problem_id
         JOIN st ON st.user_id = c.user_id AND st.problem_id = x.nb GROUP BY ALL),
sigs AS (
  SELECT c.user_id, c.tier, c.pos,
         list_concat(coalesce(ps.ps, []),
                     CASE WHEN s.nb IS NOT NULL THEN ['Similar to ' || st1.title || ', which you solved.']
                          WHEN r.nb IS NOT NULL THEN ['Related to ' || st2.title || ', where you had penalties in contests.']
                          ELSE [] END) AS base, c.p_solve
  FROM cards c LEFT JOIN psig ps USING (user_id, tier, pos) LEFT JOIN simn s USING (user_id, tier, pos)
  LEFT JOIN reln r USING (user_id, tier, pos)
  LEFT JOIN cat st1 ON st1.problem_id = s.nb LEFT JOIN cat st2 ON st2.problem_id = r.nb
),
sigs2 AS (
  SELECT user_id, tier, pos, p_solve,
         list_concat(base, CASE
           WHEN tier = 'edge_of_competence' THEN [printf('Edge of competence: ~%d%% estimated solve likelihood (relative ranking among candidates).', CAST(round_even(p_solve * 100, 0) AS INTEGER))]
           WHEN tier = 'confidence_builders' THEN [printf('High confidence: ~%d%% predicted solve rate — good for reinforcement.', CAST(round_even(p_solve * 100, 0) AS INTEGER))]
           WHEN tier = 'blind_spots' AND len(base) = 0 THEN ['Targets a topic where you underperform vs similar-rated peers.']
           ELSE [] END) AS s2
  FROM sigs
),
final_sigs AS (
  SELECT user_id, tier, pos,
         CASE WHEN len(s2) = 0 THEN [printf('Recommended based on contest patterns (~%d%% predicted solve rate).',
                                            CAST(round_even(p_solve * 100, 0) AS INTEGER))] ELSE s2 END AS signals
  FROM sigs2
)
"""


@query("explanations", with_base("""
SELECT user_id, tier, pos, CAST(generate_subscripts(signals, 1) AS BIGINT) AS idx, unnest(signals) AS signal
FROM final_sigs
""", EXPL_SQL))
def q_explanations(spark, sf_dir):
    """I4: ordered explanation signals for every tier card."""
    i = _inter(spark, sf_dir)
    t = _tiers(spark, sf_dir).withColumn("p_solve", F.bround("score", 4))
    cat = build.problems(spark, sf_dir)
    cards = t.drop("tags").join(cat.select("problem_id", "tags"), "problem_id")
    rel = graph.similar_slug_lists(*fixtures.question_lists(spark, sf_dir), undirected=True)
    solved = i.where(F.col("solved")).select("user_id", "problem_id").distinct()
    sig = coldstart.explanation_signals(cards, features.user_tag_rates(i), peers.peer_tag_scores(i), rel,
                                        solved, graph.struggle_set(i), cat)
    return sig.select("user_id", "tier", "pos", F.posexplode("signals").alias("idx", "signal")) \
        .withColumn("idx", F.col("idx") + 1)


# ------------------------------------------------------------------ K

KREC = RECS_SQL


@query("dataset_profile", with_base("""
SELECT count(*) AS records, count(DISTINCT contest_id) AS contests,
       (SELECT count(*) FROM (SELECT DISTINCT user_slug FROM recs WHERE user_slug IS NOT NULL)) AS users,
       (SELECT count(*) FROM (SELECT user_slug FROM recs WHERE user_slug IS NOT NULL GROUP BY 1 HAVING count(*) > 1))
         AS repeat_users,
       round(100.0 * (SELECT count(*) FROM (SELECT user_slug FROM recs WHERE user_slug IS NOT NULL
                                            GROUP BY 1 HAVING count(*) > 1))
             / (SELECT count(DISTINCT user_slug) FROM recs), 6) AS repeat_pct,
       round(1.0 - count(*) / ((SELECT count(DISTINCT user_slug) FROM recs) * count(DISTINCT contest_id)), 6)
         AS sparsity
FROM recs
""", KREC))
def q_dataset_profile(spark, sf_dir):
    """K1: records, contests, users, repeat users and sparsity."""
    return profile.dataset_profile(_records(spark, sf_dir))


@query("participation_top", with_base("""
SELECT times, count(*) AS n_users FROM (SELECT user_slug, count(*) AS times FROM recs
                                       WHERE user_slug IS NOT NULL GROUP BY 1)
GROUP BY times ORDER BY n_users DESC, times LIMIT 10
""", KREC))
def q_participation_top(spark, sf_dir):
    """K2: the ten most common participation counts (a top-k report)."""
    return profile.participation_top(_records(spark, sf_dir))


@query("score_stats", with_base("SELECT round(avg(score), 6) AS avg_score, max(score) AS max_score FROM recs",
                                KREC))
def q_score_stats(spark, sf_dir):
    """K3."""
    return profile.score_stats(_records(spark, sf_dir))


@query("top_countries", with_base("""
SELECT coalesce(nullif(country_name, ''), 'Unknown/None') AS value, count(*) AS n FROM recs
GROUP BY 1 ORDER BY n DESC, value LIMIT 10
""", KREC))
def q_top_countries(spark, sf_dir):
    """K4: top 10 countries."""
    return profile.top_values(_records(spark, sf_dir), "country_name", "Unknown/None", 10)


@query("top_regions", with_base("""
SELECT coalesce(nullif(data_region, ''), 'Unknown') AS value, count(*) AS n FROM recs GROUP BY 1
""", KREC))
def q_top_regions(spark, sf_dir):
    """K4: every data region."""
    return profile.top_values(_records(spark, sf_dir), "data_region", "Unknown", None)


@query("top_languages", with_base("""
SELECT language AS value, count(*) AS n FROM ex GROUP BY 1 ORDER BY n DESC, value LIMIT 10
"""))
def q_top_languages(spark, sf_dir):
    """K4: top 10 submission languages."""
    return profile.top_languages(_records(spark, sf_dir))


@query("score_by_participation", with_base("""
SELECT CASE WHEN n >= 20 THEN '20+' ELSE CAST(n AS VARCHAR) END AS bucket, round(avg(a), 6) AS avg_score,
       count(*) AS n_users
FROM (SELECT user_slug, count(*) AS n, avg(score) AS a FROM recs
      WHERE user_slug IS NOT NULL AND score IS NOT NULL GROUP BY 1) GROUP BY 1
""", KREC))
def q_score_by_participation(spark, sf_dir):
    """K5."""
    return profile.score_by_participation(_records(spark, sf_dir))


@query("score_by_nth_contest", with_base("""
SELECT nth, round(avg(score), 6) AS avg_score, count(*) AS n_users FROM (
  SELECT score, row_number() OVER (PARTITION BY user_slug ORDER BY coalesce(finish_time, 0), contest_id, score) AS nth
  FROM recs WHERE user_slug IS NOT NULL AND score IS NOT NULL) GROUP BY nth
""", KREC))
def q_score_by_nth_contest(spark, sf_dir):
    """K6."""
    return profile.score_by_nth_contest(_records(spark, sf_dir))


# ------------------------------------------------------------------ L


@query("contest_score_scaled", with_base("""
SELECT contest_id, user_slug, page AS _page,
       round(CASE WHEN max(score) OVER (PARTITION BY contest_id) > 0
                  THEN score / max(score) OVER (PARTITION BY contest_id) ELSE 0.0 END, 6) AS scaled_score
FROM recs WHERE contest_id IS NOT NULL
""", KREC))
def q_contest_score_scaled(spark, sf_dir):
    """L1: contest score / best score of the contest."""
    records = _records(spark, sf_dir).select("contest_id", "user_slug", "_page", "score")
    return extras.contest_score_scaled(store.table(records))       # read twice, parsed once


@query("bias_prediction", with_base("""
SELECT p.user_id, p.problem_id,
       round((SELECT avg(normalized_score) FROM inter) + coalesce(ub.b, 0.0) + coalesce(ib.b, 0.0)
             + coalesce(list_dot_product(u.uf, f.itf), 0.0), 6) AS prediction
FROM pairs p
LEFT JOIN (SELECT user_id, avg(normalized_score) - (SELECT avg(normalized_score) FROM inter) AS b
           FROM inter GROUP BY 1) ub USING (user_id)
LEFT JOIN (SELECT problem_id, avg(normalized_score) - (SELECT avg(normalized_score) FROM inter) AS b
           FROM inter GROUP BY 1) ib USING (problem_id)
LEFT JOIN ufac u USING (user_id) LEFT JOIN ifac f USING (problem_id)
""", FACTORS_SQL))
def q_bias_prediction(spark, sf_dir):
    """L2: mu + b_u + b_i + q.p (factors from the embeddings table)."""
    i = _inter(spark, sf_dir)
    mu, ub, ib = features.bias_terms(i)
    uf, itf = _factor_tables(spark, sf_dir)
    return extras.bias_prediction(i.select("user_id", "problem_id").distinct(), mu, ub, ib, uf, itf)


@query("difficulty_match", with_base("""
SELECT user_id, problem_id,
       round(content_raw * CASE WHEN (CASE WHEN r < 1200 THEN 'easy' WHEN r <= 1800 THEN 'medium' ELSE 'hard' END)
                                     = (CASE WHEN coalesce(px, 1.0) < 0.8 THEN 'easy'
                                             WHEN coalesce(px, 1.0) < 1.5 THEN 'medium' ELSE 'hard' END)
                                THEN 1.1 ELSE 1.0 END, 6) AS matched_score
FROM craw JOIN (SELECT user_id, avg(user_rating) AS r FROM inter GROUP BY 1) USING (user_id)
LEFT JOIN (SELECT problem_id, avg(difficulty_proxy) AS px FROM inter GROUP BY 1) USING (problem_id)
""", PROFILE_SQL + ", pairs AS (SELECT DISTINCT user_id, problem_id FROM inter)," + content_sql("pairs")))
def q_difficulty_match(spark, sf_dir):
    """L3: content score times the rating-band / difficulty-bucket match."""
    i = _inter(spark, sf_dir)
    pt = features.problem_tags(build.problems(spark, sf_dir))
    c = scoring.content_raw_scores(i.select("user_id", "problem_id").distinct(),
                                   scoring.content_profiles(i, pt, build.problems(spark, sf_dir)), pt)
    r = i.groupBy("user_id").agg(F.avg("user_rating").alias("r"))
    px = i.groupBy("problem_id").agg(F.avg("difficulty_proxy").alias("px"))
    j = c.join(r, "user_id").join(px, "problem_id", "left")
    m = extras.difficulty_match(F.col("r"), features.difficulty_bucket(F.coalesce("px", F.lit(1.0))))
    return j.select("user_id", "problem_id", (F.col("content_raw") * m).alias("matched_score"))


@query("finish_time_by_tag", with_base("""
SELECT user_id, tag, round(avg(finish_time_min), 6) AS avg_finish_time
FROM (SELECT user_id, finish_time_min, unnest(tags) AS tag FROM inter) GROUP BY ALL
"""))
def q_finish_time_by_tag(spark, sf_dir):
    """L4: per-user average finish time by tag."""
    return extras.finish_time_by_tag(_inter(spark, sf_dir))


@query("solve_rate_by_difficulty", with_base("""
SELECT user_id, CASE WHEN difficulty_proxy < 0.8 THEN 'easy' WHEN difficulty_proxy < 1.5 THEN 'medium'
                     ELSE 'hard' END AS bucket, round(avg(CAST(solved AS DOUBLE)), 6) AS solve_rate
FROM inter GROUP BY ALL
"""))
def q_solve_rate_by_difficulty(spark, sf_dir):
    """L4: per-user solve rate by difficulty bucket."""
    return extras.solve_rate_by_difficulty(_inter(spark, sf_dir))


@query("rating_trajectory", with_base("""
SELECT user_id, count(*) AS n_contests,
       round(max_by(rating, -k) - max_by(rating, k), 6) AS rating_delta
FROM (SELECT user_id, rating, row_number() OVER (PARTITION BY user_id ORDER BY contest_num DESC) AS k
      FROM (SELECT user_id, contest_num, avg(user_rating) AS rating FROM inter GROUP BY ALL))
WHERE k <= 6 GROUP BY user_id
"""))
def q_rating_trajectory(spark, sf_dir):
    """L4: rating change over the last five contests."""
    return extras.rating_trajectory(_inter(spark, sf_dir), 5)


@query("coverage_novelty", with_base("""
SELECT round((SELECT count(DISTINCT problem_id) FROM topk) / (SELECT count(*) FROM cat), 6) AS coverage,
       round(1.0 - (SELECT avg(c.content_raw) FROM topk t JOIN craw c USING (user_id, problem_id)), 6) AS novelty
""", PROFILE_SQL + """, pairs AS (SELECT DISTINCT user_id, problem_id FROM inter),
""" + content_sql("pairs") + ", " + HB + """,
topk AS (SELECT user_id, problem_id FROM (SELECT user_id, problem_id,
           row_number() OVER (PARTITION BY user_id ORDER BY s DESC, problem_id) AS pos FROM hs) WHERE pos <= 10)
"""))
def q_coverage_novelty(spark, sf_dir):
    """Catalog coverage and novelty of top-10 lists."""
    i = _inter(spark, sf_dir)
    recs = scoring.top_k(_history_batch(spark, sf_dir), "s", 10).select("user_id", "problem_id")
    pt = features.problem_tags(build.problems(spark, sf_dir))
    # the listed pairs are attempted ones; only they are scored, as no other score is read
    c = scoring.content_raw_scores(recs, scoring.content_profiles(i, pt, build.problems(spark, sf_dir)), pt)
    return extras.coverage_novelty(recs, build.problems(spark, sf_dir), c)


@query("not_recently_attempted", with_base("""
SELECT DISTINCT user_id, problem_id FROM inter
EXCEPT
SELECT i.user_id, i.problem_id FROM inter i JOIN (
  SELECT user_id, contest_num FROM (SELECT DISTINCT user_id, contest_num FROM inter)
  QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY contest_num DESC) <= 5) l USING (user_id, contest_num)
"""))
def q_not_recently_attempted(spark, sf_dir):
    """Attempted problems minus those seen in the user's last 5 contests."""
    i = _inter(spark, sf_dir)
    return extras.not_recently_attempted(i.select("user_id", "problem_id").distinct(), i, 5)


@query("reciprocal_rank_fusion", with_base("""
SELECT user_id, problem_id, round(sum(1.0 / (60 + rank)), 6) AS rrf FROM (
  SELECT user_id, problem_id, row_number() OVER (PARTITION BY user_id ORDER BY s DESC, problem_id) AS rank FROM hs
  UNION ALL
  SELECT user_id, problem_id, row_number() OVER (PARTITION BY user_id ORDER BY floor(content_raw * 1e9 + 0.5) DESC,
                                                                            problem_id) FROM craw)
GROUP BY ALL
""", HB + ", " + PROFILE_SQL + ", pairs AS (SELECT DISTINCT user_id, problem_id FROM inter)," + content_sql("pairs")))
def q_reciprocal_rank_fusion(spark, sf_dir):
    """Reciprocal rank fusion of the synthetic and content rankings."""
    i = _inter(spark, sf_dir)
    b = _history_batch(spark, sf_dir)
    r1 = tiers.score_rank(b.withColumnRenamed("s", "score"))
    pt = features.problem_tags(build.problems(spark, sf_dir))
    c = scoring.content_raw_scores(i.select("user_id", "problem_id").distinct(),
                                   scoring.content_profiles(i, pt, build.problems(spark, sf_dir)), pt)
    # snap to 1e-9 so float noise cannot reorder mathematically equal scores
    r2 = tiers.score_rank(c.withColumn("score", F.floor(F.col("content_raw") * 1e9 + 0.5)))
    return extras.reciprocal_rank_fusion([r1, r2])


# ------------------------------------------------------------------ Spark ML jobs (rows-only)


def _trained(spark, sf_dir, calibrate=True):
    i = _inter(spark, sf_dir)
    return recommend.train(i, build.problems(spark, sf_dir), calibrate=calibrate)


@query("model_save_load", with_base("""
SELECT (SELECT count(*) FROM (SELECT DISTINCT user_id, problem_id FROM inter)) AS pairs, CAST(0 AS BIGINT) AS differing
"""))
def q_model_save_load(spark, sf_dir):
    """F16: ALS factors and id maps saved with Spark ML writers and loaded back:
    scored pairs, and how many of them score differently after loading."""
    i = _inter(spark, sf_dir)
    fit = models.fit_als(i)
    path = _scratch(spark)
    fit.save(path)
    pairs = i.select("user_id", "problem_id").distinct()
    a = fit.raw_scores(pairs)
    b = models.ALSFit.load(spark, path).raw_scores(pairs).withColumnRenamed("als_raw", "again")
    return a.join(b, ["user_id", "problem_id"]).agg(
        F.count(F.lit(1)).alias("pairs"),
        F.sum((~F.col("als_raw").eqNullSafe(F.col("again"))).cast("long")).alias("differing"))


@query("model_bundle", with_base("""
SELECT * FROM (VALUES ('als_cal', CAST(0 AS BIGINT)), ('content_cal', 0)) v(part, n_rows)
UNION ALL SELECT 'als_users', count(DISTINCT user_id) FROM tr
UNION ALL SELECT 'als_items', count(DISTINCT problem_id) FROM tr
UNION ALL SELECT 'problem_tags', count(*) FROM cat_tags
UNION ALL SELECT 'content_profiles', count(*) FROM (
  SELECT DISTINCT user_id, tag FROM sol JOIN cat_tags USING (problem_id)
  WHERE user_id IN (SELECT user_id FROM sol GROUP BY 1 HAVING sum(normalized_score) > 0))
""", SPLIT_SQL + """,
tr AS (SELECT inter.* FROM inter, sp WHERE contest_num < split_at),
sol AS (SELECT * FROM tr WHERE solved)
"""))
def q_model_bundle(spark, sf_dir):
    """F16 + F17: a trained bundle saved, committed and loaded; the rows of each
    part that are in both the trained and the loaded one (calibrators: rows of the
    step tables that differ)."""
    m = _trained(spark, sf_dir)
    root = _scratch(spark)
    bundle.save(spark, m, root)
    back = bundle.load(spark, root, DEFAULT)
    both = lambda a, b: a.intersect(b.select(*a.columns))
    out = None
    for part, a, b in (("als_users", m.als.users, back.als.users), ("als_items", m.als.items, back.als.items),
                       ("problem_tags", m.problem_tags, back.problem_tags),
                       ("content_profiles", m.content_profiles, back.content_profiles)):
        one = both(a, b).agg(F.lit(part).alias("part"), F.count(F.lit(1)).alias("n_rows"))
        out = one if out is None else out.unionByName(one)
    for part in bundle.CALIBRATORS:
        a, b = getattr(m, part).table, getattr(back, part).table
        left = a.exceptAll(b).unionByName(b.exceptAll(a)).agg(F.lit(part).alias("part"), F.count(F.lit(1)).alias("n"))
        out = out.unionByName(left.select("part", F.col("n").alias("n_rows")))
    return out


@query("train_job")
def q_train_job(spark, sf_dir):
    """split -> ALS -> isotonic -> content -> isotonic; calibrated ALS
    and content scores on the test rows."""
    i = _inter(spark, sf_dir)
    m = _trained(spark, sf_dir)
    _, test = tiers.temporal_split(i)
    s = m.als.raw_scores(test.select("user_id", "problem_id", "solved"))
    s = scoring.content_raw_scores(s, m.content_profiles, m.problem_tags)
    s = models.apply_isotonic(m.als_cal, s, "als_raw", "als_cal")
    return models.apply_isotonic(m.content_cal, s, "content_raw", "content_cal")


def _recommend_inputs(spark, sf_dir):
    i = _inter(spark, sf_dir)
    cat = _catalog_pos(spark, sf_dir)  # problem_id, title, tags, cat_pos
    rel = _slug_rel(spark, sf_dir)
    pf = features.problem_features(i, build.problems(spark, sf_dir))
    return i, cat, rel, pf


@query("tiered_recommendations")
def q_tiered_recommendations(spark, sf_dir):
    """The full job for every user — pool, ALS + content scores with
    isotonic calibration, graph boost, ensemble, filters, peer blind spots,
    tiers, diversity rank, enrichment."""
    i, cat, rel, pf = _recommend_inputs(spark, sf_dir)
    m = _trained(spark, sf_dir)
    users = i.select("user_id").distinct()
    out = recommend.recommend(users, i, cat, m, rel, pf)
    return out.select("user_id", "tier", "pos", "rank", "problem_id", "p_solve", "title")


@query("response_cards")
def q_response_cards(spark, sf_dir):
    """I5 (+I1, I2, I4): card lists for every customer slug — warm users get
    tiered cards with signals, cold users the roadmap."""
    i, cat, rel, pf = _recommend_inputs(spark, sf_dir)
    m = _trained(spark, sf_dir)
    slugs = fixtures.read_table(spark, sf_dir, "customer", "c_custkey") \
        .select(fixtures.user_slug(F.col("c_custkey")).alias("user_slug"))
    road = coldstart.read_roadmap(fixtures.roadmap_json(spark, sf_dir))
    out = recommend.respond(slugs, i, cat, m, rel, pf, road, count=10)
    return out.select("user_slug", "user_id", "warm_start", "contests", "attempted", "solved_count", "message",
                      "card", "slug", "tier", "p_solve",
                      "signal_count", F.array_join("signals", " | ").alias("signals"))


@query("backtest")
def q_backtest(spark, sf_dir):
    """Temporal backtest of calibrated ALS (mean P/R/NDCG@10, MRR, Brier)."""
    return backtest.backtest(_inter(spark, sf_dir), _catalog_pos(spark, sf_dir), _slug_rel(spark, sf_dir))


@query("pool_refresh", with_base("""
SELECT user_id, problem_id, round(score, 6) AS score FROM ens
""", ENSEMBLE_SQL))
def q_pool_refresh(spark, sf_dir):
    """The candidate pool with ensemble scores as a stored table: a first
    refresh writes all user buckets, a second one without changes none."""
    i = _inter(spark, sf_dir)
    root = _scratch(spark)
    columns = ["problem_id", "contest_id", "solved", "penalty_count", "normalized_score"]
    score = lambda users: _ensemble(spark, sf_dir, users).select("user_id", "problem_id", "score")
    refresh.refresh(spark, i, score, root, columns)
    if refresh.refresh(spark, i, score, root, columns):
        raise AssertionError("a refresh without changes has written")
    return refresh.read_pool(spark, root)
