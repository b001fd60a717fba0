"""Registered queries: ingest, clean and features (A*, B*, C6, D*)."""

from __future__ import annotations

from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from edgecraft.operators import clean, features, graph
from edgecraft.plans import build, store
from edgecraft.plans.oracle_base import with_base
from edgecraft.plans.registry import query
from edgecraft.sources import fixtures, jsonl


def _inter(spark, sf_dir):
    return build.interactions(spark, sf_dir)


def _problems(spark, sf_dir):
    return build.problems(spark, sf_dir)


# ------------------------------------------------------------------ A / B


@query("interactions_clean", with_base("""
SELECT user_id, contest_id, problem_id, solved,
       round(finish_time_min, 6) AS finish_time_min, CAST(penalty_count AS BIGINT) AS penalty_count,
       language, round(user_rating, 6) AS user_rating, round(rank_percentile, 6) AS rank_percentile,
       round(difficulty_proxy, 6) AS difficulty_proxy, round(normalized_score, 6) AS normalized_score
FROM inter
"""))
def q_interactions_clean(spark, sf_dir):
    """B14 (A6 shape): the full clean pipeline from the JSONL text feed."""
    return build.interactions(spark, sf_dir, source="jsonl", fresh=True).drop("tags")


@query("records_exploded", with_base("""
SELECT user_slug, contest_id, frontend_id, CAST(penalty_count AS BIGINT) AS penalty_count,
       language, submission_date, solved, CAST(rank AS BIGINT) AS rank
FROM ex
"""))
def q_records_exploded(spark, sf_dir):
    """A1 + B1: JSONL text -> from_json -> explode submissions."""
    return build.exploded_rows(spark, sf_dir, source="jsonl")


@query("bad_record_audit", "SELECT CAST(2 AS BIGINT) AS bad_lines")
def q_bad_record_audit(spark, sf_dir):
    """A4: unparsable lines in the feed (the feed carries two fixed bad lines)."""
    return jsonl.bad_record_audit(jsonl.parse_contest_lines(fixtures.contest_jsonl(spark, sf_dir)))


@query("rank_percentile", with_base("""
SELECT DISTINCT contest_id, user_slug, round(rank_percentile, 6) AS rank_percentile FROM drv
"""))
def q_rank_percentile(spark, sf_dir):
    """B2: 1 - rank / distinct users of the contest (before the catalog join)."""
    d = clean.derive_contest_columns(build.exploded_rows(spark, sf_dir))
    return d.select("contest_id", "user_slug", "rank_percentile").distinct()


@query("contest_start_finish", with_base("""
SELECT contest_id, n_users, cstart AS contest_start,
       (SELECT round(max(finish_time_min), 6) FROM drv d WHERE d.contest_id = cstat.contest_id)
         AS max_finish_min
FROM cstat
"""))
def q_contest_start_finish(spark, sf_dir):
    """Inferred contest start and the latest finish minute."""
    rows = build.exploded_rows(spark, sf_dir)
    st = clean.contest_stats(rows)
    mx = clean.derive_contest_columns(rows).groupBy("contest_id").agg(
        F.max("finish_time_min").alias("max_finish_min"))
    return st.join(mx, "contest_id").select("contest_id", "n_users", "contest_start", "max_finish_min")


@query("attempt_scores", with_base("""
SELECT CAST(penalty_count AS BIGINT) AS penalty_count, solved,
       round(normalized_score, 6) AS normalized_score, count(*) AS n
FROM drv GROUP BY ALL
"""))
def q_attempt_scores(spark, sf_dir):
    """Per-attempt score by penalty count."""
    d = clean.derive_contest_columns(build.exploded_rows(spark, sf_dir))
    return d.groupBy("penalty_count", "solved", "normalized_score").agg(F.count(F.lit(1)).alias("n"))


@query("catalog_drop_report", with_base("""
SELECT frontend_id, count(*) AS n_dropped FROM ex
WHERE frontend_id NOT IN (SELECT frontend_id FROM cat WHERE p_partkey % 50 <> 0) GROUP BY frontend_id
"""))
def q_catalog_drop_report(spark, sf_dir):
    """B6 report: submissions without a catalog entry."""
    d = clean.dropped_by_catalog(build.exploded_rows(spark, sf_dir), fixtures.catalog(spark, sf_dir, reduced=True))
    return d.groupBy("frontend_id").agg(F.count(F.lit(1)).alias("n_dropped"))


@query("problems_clean", with_base("""
SELECT problem_id, title, CAST(len(tags) AS BIGINT) AS n_tags FROM cat
"""))
def q_problems_clean(spark, sf_dir):
    """B6 second output: catalog distinct on problem_id."""
    return _problems(spark, sf_dir).select("problem_id", "title", F.size("tags").alias("n_tags"))


@query("duplicate_keys", with_base("""
SELECT user_slug, problem_id, contest_id, count(*) AS n FROM joined
GROUP BY ALL HAVING count(*) > 1
"""))
def q_duplicate_keys(spark, sf_dir):
    """B7 audit: keys whose every copy is dropped."""
    rows = clean.join_catalog(build.exploded_rows(spark, sf_dir), fixtures.catalog(spark, sf_dir))
    return rows.groupBy("user_slug", "problem_id", "contest_id").agg(F.count(F.lit(1)).alias("n")) \
        .where(F.col("n") > 1)


@query("duplicate_keys_kept_first", with_base("""
SELECT user_slug, problem_id, contest_id, CAST(penalty_count AS BIGINT) AS penalty_count,
       submission_date
FROM joined
QUALIFY row_number() OVER (PARTITION BY user_slug, problem_id, contest_id
                           ORDER BY frontend_id, penalty_count, language, submission_date) = 1
"""))
def q_duplicate_keys_kept_first(spark, sf_dir):
    """B7 with keep='first' (smallest remaining columns win)."""
    rows = clean.join_catalog(build.exploded_rows(spark, sf_dir), fixtures.catalog(spark, sf_dir))
    rows = rows.select("user_slug", "problem_id", "contest_id", "frontend_id", "penalty_count",
                       "language", "submission_date")
    d = clean.drop_duplicate_keys(rows, ["user_slug", "problem_id", "contest_id"], keep="first")
    return d.select("user_slug", "problem_id", "contest_id", "penalty_count", "submission_date")


@query("user_id_hash", with_base("SELECT DISTINCT user_slug, user_id FROM inter"))
def q_user_id_hash(spark, sf_dir):
    """Salted pseudonymous id of every cleaned user slug."""
    return build.interactions(spark, sf_dir, extra=("user_slug",)).select("user_slug", "user_id").distinct()


@query("finish_quantiles", with_base("""
SELECT round(q1.finish_cap, 6) AS finish_cap,
       round((SELECT median(finish_time_min) FROM capped), 6) AS median_time,
       round((SELECT median(penalty_count) FROM capped), 6) AS median_penalty
FROM q1
"""))
def q_finish_quantiles(spark, sf_dir):
    """B10 + B11 scalars: 0.9 quantile cap and the two medians."""
    keys = ["user_slug", "problem_id", "contest_id"]
    rows = clean.derive_contest_columns(store.table(build.exploded_rows(spark, sf_dir)))
    rows = clean.join_catalog(rows, fixtures.catalog(spark, sf_dir))
    rows = store.table(rows.select(*keys, "finish_time_min", "penalty_count"))
    return clean.scalar_quantiles(clean.without_repeated_keys(rows, keys, store.table))


@query("catalog_from_graph", with_base("""
SELECT DISTINCT c.frontend_id, c.problem_id, c.title, t.tag
FROM cat c JOIN cat_tags t USING (problem_id)
"""))
def q_catalog_from_graph(spark, sf_dir):
    """B5 (A12 source): catalog rebuilt from the bipartite node / edge tables."""
    nodes, edges = fixtures.tag_graph(spark, sf_dir)
    cat = graph.catalog_from_tag_graph(nodes, edges)
    return cat.select("frontend_id", "problem_id", "title", F.explode("tags").alias("tag"))


@query("tags_normalised", with_base("""
SELECT problem_id, CAST(generate_subscripts(tags, 1) AS BIGINT) AS pos, unnest(tags) AS tag FROM cat
"""))
def q_tags_normalised(spark, sf_dir):
    """Stringified tag lists parsed back to arrays."""
    cat = fixtures.catalog(spark, sf_dir)
    s = cat.select("problem_id", F.concat(F.lit("['"), F.array_join("tags", "', '"), F.lit("']"))
                   .alias("tags"))
    n = clean.normalise_tags(s)
    return n.select("problem_id", F.posexplode("tags").alias("pos", "tag")) \
        .withColumn("pos", F.col("pos") + 1)


# ------------------------------------------------------------------ D


@query("user_features", with_base("""
SELECT user_id,
       count(DISTINCT contest_id) AS total_contests,
       count(DISTINCT problem_id) AS total_problems,
       CAST(sum(CAST(solved AS INTEGER)) AS BIGINT) AS n_solved,
       round(sum(CAST(solved AS INTEGER)) / greatest(count(DISTINCT problem_id), 1), 6) AS solve_rate,
       round(avg(normalized_score), 6) AS avg_score,
       round(avg(user_rating), 6) AS avg_rating,
       round(median(finish_time_min), 6) AS median_finish_time,
       round(sum(penalty_count) / count(*), 6) AS penalty_rate,
       mode() WITHIN GROUP (ORDER BY language) AS top_language
FROM inter GROUP BY user_id
"""))
def q_user_features(spark, sf_dir):
    """D1 + D3: per-user aggregates (modal language ties by language)."""
    return features.user_features(_inter(spark, sf_dir), with_tags=False)


@query("user_tag_rates", with_base("""
SELECT user_id, tag, round(avg(CAST(solved AS DOUBLE)), 6) AS rate FROM it GROUP BY ALL
"""))
def q_user_tag_rates(spark, sf_dir):
    """The ``tag_scores`` map in long form."""
    m = features.user_features(_inter(spark, sf_dir), with_tags=True)
    return m.select("user_id", F.explode("tag_scores").alias("tag", "rate"))


PROBLEM_FEATURES_SQL = with_base("""
SELECT c.problem_id, 'unknown' AS difficulty_label,
       CASE WHEN coalesce(a.proxy, 1.0) < 0.8 THEN 'easy'
            WHEN coalesce(a.proxy, 1.0) < 1.5 THEN 'medium' ELSE 'hard' END AS difficulty_bucket,
       0.0 AS acceptance_rate,
       coalesce(a.n_attempts, 0) AS n_attempts,
       CAST(coalesce(a.n_solved, 0) AS BIGINT) AS n_solved,
       round(coalesce(a.n_solved, 0) / greatest(coalesce(a.n_attempts, 0), 1), 6) AS solve_rate,
       round(coalesce(a.avg_score, 0.0), 6) AS avg_score,
       round(CASE WHEN a.n_scores > 1 THEN a.score_std ELSE 0.0 END, 6) AS score_std,
       round(a.avg_finish, 6) AS avg_finish_time, round(a.med_finish, 6) AS median_finish_time,
       round(a.min_finish, 6) AS min_finish_time, round(a.max_finish, 6) AS max_finish_time,
       round(a.avg_penalty, 6) AS avg_penalty,
       round(coalesce(a.pen, 0) / greatest(coalesce(a.n_attempts, 0), 1), 6) AS penalty_rate,
       round(coalesce(a.proxy, 1.0), 6) AS avg_difficulty_proxy
FROM cat c LEFT JOIN (
  SELECT problem_id, count(*) AS n_attempts, sum(CAST(solved AS INTEGER)) AS n_solved,
         avg(normalized_score) AS avg_score, stddev_samp(normalized_score) AS score_std,
         count(normalized_score) AS n_scores, avg(finish_time_min) AS avg_finish,
         median(finish_time_min) AS med_finish, min(finish_time_min) AS min_finish,
         max(finish_time_min) AS max_finish, avg(penalty_count) AS avg_penalty,
         sum(penalty_count) AS pen, avg(difficulty_proxy) AS proxy
  FROM inter GROUP BY problem_id) a USING (problem_id)
""")


@query("problem_features", PROBLEM_FEATURES_SQL)
def q_problem_features(spark, sf_dir):
    """D4 + D5: per catalog problem, zero-filled."""
    return features.problem_features(_inter(spark, sf_dir), _problems(spark, sf_dir)).drop("tags")


@query("tag_vocabulary", with_base("""
SELECT tag, row_number() OVER (ORDER BY tag) - 1 AS tag_idx FROM (SELECT DISTINCT tag FROM cat_tags)
"""))
def q_tag_vocabulary(spark, sf_dir):
    """D6 vocabulary: sorted distinct tags."""
    return features.tag_vocabulary(_problems(spark, sf_dir))


@query("tag_vectors", with_base("""
SELECT t.problem_id, v.tag_idx, 1.0 AS value
FROM cat_tags t JOIN (SELECT tag, row_number() OVER (ORDER BY tag) - 1 AS tag_idx
                      FROM (SELECT DISTINCT tag FROM cat_tags)) v USING (tag)
"""))
def q_tag_vectors(spark, sf_dir):
    """D6 multi-hot vectors (non-zero entries)."""
    v = features.tag_vectors(_problems(spark, sf_dir))
    return v.select("problem_id", F.posexplode("tag_vector").alias("tag_idx", "value")) \
        .where(F.col("value") > 0)


@query("tag_index_lists", with_base("""
SELECT p.problem_id, (SELECT count(DISTINCT tag) FROM cat_tags) AS size, coalesce(t.ix, '') AS indices
FROM cat p LEFT JOIN (SELECT problem_id, string_agg(CAST(tag_idx AS VARCHAR), ',' ORDER BY tag_idx) AS ix
  FROM cat_tags JOIN (SELECT tag, row_number() OVER (ORDER BY tag) - 1 AS tag_idx
                      FROM (SELECT DISTINCT tag FROM cat_tags)) v USING (tag) GROUP BY 1) t USING (problem_id)
"""))
def q_tag_index_lists(spark, sf_dir):
    """D6, sparse: places of each problem's ones in the multi-hot vector."""
    v = features.tag_index_lists(_problems(spark, sf_dir))
    return v.select("problem_id", "size", F.array_join(F.col("indices").cast("array<string>"), ",").alias("indices"))


@query("user_tag_preferences", with_base("""
SELECT user_id, tag, round(count(*) / any_value(ns), 6) AS preference
FROM it JOIN (SELECT user_id, count(*) AS ns FROM inter WHERE solved GROUP BY user_id) s USING (user_id)
WHERE solved GROUP BY user_id, tag
"""))
def q_user_tag_preferences(spark, sf_dir):
    """Per-user tag preference over solved rows."""
    return features.user_tag_preferences(_inter(spark, sf_dir))


ID_MAPS_SQL = """
um AS (SELECT user_id, CAST(row_number() OVER (ORDER BY user_id) - 1 AS BIGINT) AS user_idx
       FROM (SELECT DISTINCT user_id FROM inter)),
pm AS (SELECT problem_id, CAST(row_number() OVER (ORDER BY problem_id) - 1 AS BIGINT) AS problem_idx
       FROM (SELECT DISTINCT problem_id FROM inter))
"""


@query("interaction_matrix", with_base("""
SELECT user_idx, problem_idx, round(CAST(CAST(sum(normalized_score) AS FLOAT) AS DOUBLE), 6) AS value
FROM inter JOIN um USING (user_id) JOIN pm USING (problem_id)
WHERE solved GROUP BY user_idx, problem_idx
""", ID_MAPS_SQL))
def q_interaction_matrix(spark, sf_dir):
    """COO entries of the solved-only user x problem matrix."""
    i = _inter(spark, sf_dir)
    return features.interaction_matrix(
        i, features.id_map(i, "user_id", "user_idx", features.hex_key("user_id")),
        features.id_map(i, "problem_id", "problem_idx", features.text_key("problem_id", len(fixtures.PROBLEM_PREFIX))))


@query("matrix_density", with_base("""
SELECT (SELECT count(*) FROM (SELECT DISTINCT user_id, problem_id FROM inter WHERE solved)) AS nnz,
       count(DISTINCT user_id) AS n_users, count(DISTINCT problem_id) AS n_problems,
       round(100.0 * (SELECT count(*) FROM (SELECT DISTINCT user_id, problem_id FROM inter WHERE solved))
             / (count(DISTINCT user_id) * count(DISTINCT problem_id)), 6) AS density_pct
FROM inter
"""))
def q_matrix_density(spark, sf_dir):
    """D9 summary: nnz, shape and density."""
    return features.matrix_density(_inter(spark, sf_dir))


@query("id_maps", with_base("SELECT user_id, user_idx FROM um", ID_MAPS_SQL))
def q_id_maps(spark, sf_dir):
    """Dense user index in id order."""
    return features.id_map(_inter(spark, sf_dir), "user_id", "user_idx", features.hex_key("user_id"))


@query("user_biases", with_base("""
SELECT user_id, round(avg(normalized_score) - (SELECT avg(normalized_score) FROM inter), 6) AS bias,
       round((SELECT avg(normalized_score) FROM inter), 6) AS global_mean
FROM inter GROUP BY user_id
"""))
def q_user_biases(spark, sf_dir):
    """User bias and global mean."""
    _, ub, _ = features.bias_terms(_inter(spark, sf_dir))
    return ub


@query("item_biases", with_base("""
SELECT problem_id, round(avg(normalized_score) - (SELECT avg(normalized_score) FROM inter), 6) AS bias
FROM inter GROUP BY problem_id
"""))
def q_item_biases(spark, sf_dir):
    """Item bias."""
    _, _, ib = features.bias_terms(_inter(spark, sf_dir))
    return ib


@query("user_problem_rollup", with_base("""
SELECT user_id, problem_id, count(contest_id) AS n_attempts,
       CAST(sum(CAST(solved AS INTEGER)) AS BIGINT) AS n_solved,
       round(avg(normalized_score), 6) AS avg_score, round(avg(finish_time_min), 6) AS avg_finish_time,
       round(avg(penalty_count), 6) AS avg_penalty, round(max(normalized_score), 6) AS max_score,
       round(sum(CAST(solved AS INTEGER)) / count(contest_id), 6) AS solve_rate
FROM inter GROUP BY user_id, problem_id
"""))
def q_user_problem_rollup(spark, sf_dir):
    """D12."""
    return features.user_problem_rollup(_inter(spark, sf_dir))


@query("numeric_feature_matrix", with_base("""
SELECT user_id, unnest(range(0, 8)) AS pos, round(unnest(v), 6) AS value FROM (
  SELECT user_id, [CAST(count(DISTINCT contest_id) AS DOUBLE), count(DISTINCT problem_id),
                   sum(CAST(solved AS INTEGER)),
                   sum(CAST(solved AS INTEGER)) / greatest(count(DISTINCT problem_id), 1), avg(normalized_score),
                   avg(user_rating), median(finish_time_min), sum(penalty_count) / count(*)] AS v
  FROM inter GROUP BY user_id)
"""))
def q_numeric_feature_matrix(spark, sf_dir):
    """Numeric user features as a vector, one row per component."""
    uf = features.user_features(_inter(spark, sf_dir), with_tags=False)
    m = features.numeric_feature_matrix(uf, "user_id")
    return m.select("user_id", F.posexplode(vector_to_array("features")).alias("pos", "value"))


@query("user_adjacency", with_base("""
SELECT user_id, count(*) AS n, string_agg(problem_id, ',' ORDER BY problem_id) AS problems
FROM inter GROUP BY user_id
"""))
def q_user_adjacency(spark, sf_dir):
    """User -> sorted problem list (duplicates kept)."""
    u, _ = features.adjacency_lists(_inter(spark, sf_dir))
    return u.select("user_id", F.size("problems").cast("long").alias("n"),
                    F.array_join("problems", ",").alias("problems"))


@query("problem_adjacency", with_base("""
SELECT problem_id, count(*) AS n, string_agg(user_id, ',' ORDER BY user_id) AS users
FROM inter GROUP BY problem_id
"""))
def q_problem_adjacency(spark, sf_dir):
    """Problem -> sorted user list (duplicates kept)."""
    _, p = features.adjacency_lists(_inter(spark, sf_dir))
    return p.select("problem_id", F.size("users").cast("long").alias("n"),
                    F.array_join("users", ",").alias("users"))


@query("problem_adjacency_chunks", with_base("""
SELECT problem_id, chunk, count(*) AS n, string_agg(user_id, ',' ORDER BY user_id) AS users
FROM (SELECT problem_id, user_id,
             (row_number() OVER (PARTITION BY problem_id ORDER BY user_id) - 1) // 64 AS chunk FROM inter)
GROUP BY ALL
"""))
def q_problem_adjacency_chunks(spark, sf_dir):
    """C6 in bounded rows: the users of a problem in sorted chunks of 64."""
    _, p = features.adjacency_chunks(_inter(spark, sf_dir), 64)
    return p.select("problem_id", "chunk", F.size("users").cast("long").alias("n"),
                    F.array_join("users", ",").alias("users"))
