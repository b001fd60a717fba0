"""Registered queries: scoring, splits, candidates, tiers, ranking and
metrics (F*, H*, J*).

Score-dependent operators run on a model-free score computed from the keys
(``fixtures.synthetic_score``) so DuckDB can reproduce every branch; the
Spark ML fits are registered without an oracle (rows-only check).
"""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from edgecraft.operators import als_step, blocks, evaluate, features, graph, models, peers, scoring, tiers
from edgecraft.plans import build, store
from edgecraft.plans.oracle_base import BASE_CTES, with_base
from edgecraft.plans.registry import query
from edgecraft.sources import fixtures
from edgecraft.sources.tables import read_table


def D(x) -> str:
    return f"CAST({x} AS DOUBLE)"


SYN = ("CASE WHEN CAST('0x' || substr({u}, 1, 6) AS BIGINT) % 10 = 0 THEN 0.5 "
       "ELSE CAST((CAST('0x' || substr({u}, 1, 6) AS BIGINT) * 31 "
       "+ CAST(substr({p}, 6) AS BIGINT) * 17) % 1000 AS DOUBLE) / 1000.0 END")


def syn(u="user_id", p="problem_id") -> str:
    return SYN.format(u=u, p=p)


def spread_sql(col, lo, hi, n, i, low, high) -> str:
    return (f"CASE WHEN {n} = 1 THEN ({D(low)} + {D(high)}) / 2.0 "
            f"WHEN {hi} - {lo} < 1e-9 THEN {D(low)} + ({D(high)} - {D(low)}) * {i} / ({n} - 1) "
            f"ELSE {D(low)} + ({D(high)} - {D(low)}) * ({col} - {lo}) / ({hi} - {lo}) END")


def _inter(spark, sf_dir):
    return build.interactions(spark, sf_dir)


def _history_batch(spark, sf_dir):
    """Each user's distinct attempted problems with the synthetic raw score."""
    i = _inter(spark, sf_dir).select("user_id", "problem_id").distinct()
    return i.withColumn("s", fixtures.synthetic_score(F.col("user_id"), F.col("problem_id")))


def _catalog_pos(spark, sf_dir):
    cat = build.problems(spark, sf_dir).withColumn("_k", F.substring("problem_id", 6, 20).cast("long"))
    return tiers.dense_positions(cat, "_k").drop("_k")


def _slug_rel(spark, sf_dir):
    return graph.similar_slug_lists(*fixtures.question_lists(spark, sf_dir))


def _synthetic_factors(spark, sf_dir):
    """The keys that ``fixtures.synthetic_score`` is made of, as factors."""
    users = _inter(spark, sf_dir).select("user_id").distinct()
    uf = users.select(F.col("user_id").alias("id"),
                      F.array(F.conv(F.substring("user_id", 1, 6), 16, 10).cast("double")).alias("features"))
    itf = build.problems(spark, sf_dir).select(F.col("problem_id").alias("id"),
                                               F.array(F.substring("problem_id", 6, 20).cast("double")).alias("features"))
    return uf, itf


def synthetic_raw(users, items):
    """``fixtures.synthetic_score`` of user rows against problem rows."""
    import numpy as np
    u, k = users.astype(np.int64), items.T.astype(np.int64)
    return np.where(u % 10 == 0, 0.5, (u * 31 + k * 17) % 1000 / 1000.0)


def _pool_blocks(spark, sf_dir, users=None, **how):
    """Scores over the pool (H7) with the synthetic raw score."""
    i = _inter(spark, sf_dir)
    uf, itf = _synthetic_factors(spark, sf_dir)
    return blocks.score_pool_blocks(i.select("user_id").distinct() if users is None else users, i, _catalog_pos(spark, sf_dir),
                                    _slug_rel(spark, sf_dir), uf, itf, raw=synthetic_raw,
                                    materialize=store.materialize, **how)


HB = f"""
hb AS (SELECT DISTINCT user_id, problem_id FROM inter),
hs AS (SELECT user_id, problem_id, {syn()} AS s FROM hb),
hw AS (SELECT *, count(*) OVER (PARTITION BY user_id) AS n, min(s) OVER (PARTITION BY user_id) AS lo,
              max(s) OVER (PARTITION BY user_id) AS hi,
              row_number() OVER (PARTITION BY user_id ORDER BY problem_id) - 1 AS i FROM hs)
"""

POOL = """
catp AS (SELECT problem_id, tags, row_number() OVER (ORDER BY p_partkey) - 1 AS cat_pos FROM cat),
sadj AS (
  SELECT DISTINCT src_slug, dst_slug FROM (
    SELECT a.problem_id AS src_slug, b.problem_id AS dst_slug FROM cat a JOIN cat b
      ON a.p_brand = b.p_brand AND a.p_type = b.p_type AND b.p_size - a.p_size BETWEEN 1 AND 5
    UNION ALL
    SELECT b.problem_id, a.problem_id FROM cat a JOIN cat b
      ON a.p_brand = b.p_brand AND a.p_type = b.p_type AND b.p_size - a.p_size BETWEEN 1 AND 5)
),
-- two shared tags (every catalog problem has at least two)
reach AS (SELECT a.problem_id, b.problem_id AS near FROM cat_tags a JOIN cat_tags b USING (tag)
          GROUP BY ALL HAVING count(*) >= 2
          UNION SELECT src_slug, dst_slug FROM sadj),
cands AS (SELECT DISTINCT i.user_id, r.near AS problem_id FROM inter i JOIN reach r ON i.problem_id = r.problem_id),
pool AS (
  SELECT u.user_id, u.problem_id, c.tags, c.cat_pos,
         row_number() OVER (PARTITION BY u.user_id ORDER BY c.cat_pos) - 1 AS pool_pos
  FROM cands u JOIN catp c USING (problem_id)
  WHERE NOT EXISTS (SELECT 1 FROM inter s WHERE s.solved AND s.user_id = u.user_id AND s.problem_id = u.problem_id)
)
"""


# ------------------------------------------------------------------ H1-H7


@query("contest_number", with_base("""
SELECT DISTINCT contest_id,
       CAST(coalesce(TRY_CAST(nullif(regexp_extract(contest_id, '([0-9]+)$', 1), '') AS INTEGER), 0) AS BIGINT)
         AS contest_num
FROM inter
"""))
def q_contest_number(spark, sf_dir):
    """H1: trailing digits of the contest id."""
    return tiers.with_contest_number(_inter(spark, sf_dir).select("contest_id").distinct())


SPLIT_SQL = """
cnum AS (SELECT DISTINCT contest_num FROM inter),
sp AS (SELECT CASE WHEN (SELECT count(*) FROM cnum) <= 10
                   THEN (SELECT contest_num FROM cnum ORDER BY contest_num
                         LIMIT 1 OFFSET (SELECT count(*) FROM cnum) // 2)
                   ELSE (SELECT contest_num FROM cnum ORDER BY contest_num DESC LIMIT 1 OFFSET 9) END AS split_at)
"""


@query("temporal_split", with_base("""
SELECT CASE WHEN contest_num < split_at THEN 'train' ELSE 'test' END AS side,
       count(*) AS n_rows, count(DISTINCT contest_id) AS n_contests
FROM inter, sp GROUP BY ALL
""", SPLIT_SQL))
def q_temporal_split(spark, sf_dir):
    """H2: last 10 contests form the test side."""
    train, test = tiers.temporal_split(_inter(spark, sf_dir), 10)
    agg = [F.count(F.lit(1)).alias("n_rows"), F.count_distinct("contest_id").alias("n_contests")]
    return train.agg(*agg).withColumn("side", F.lit("train")).unionByName(
        test.agg(*agg).withColumn("side", F.lit("test")))


@query("three_way_split", with_base("""
SELECT contest_id, CASE WHEN i <= ntr THEN 'train' WHEN i <= ntr + nva THEN 'val' ELSE 'test' END AS split
FROM (SELECT contest_id, row_number() OVER (ORDER BY contest_id) AS i, count(*) OVER () AS n
      FROM (SELECT DISTINCT contest_id FROM inter)) x,
     LATERAL (SELECT CASE WHEN n < 341 THEN greatest(1, floor(n * 0.7)) ELSE 250 END AS ntr,
                     CASE WHEN n < 341 THEN greatest(1, floor(n * 0.1)) ELSE 30 END AS nva)
"""))
def q_three_way_split(spark, sf_dir):
    """H3: train / val / test contests by contest-id order."""
    return tiers.three_way_split_labels(_inter(spark, sf_dir))


@query("unsolved_attempts", with_base("""
SELECT user_id, problem_id, contest_id FROM inter i
WHERE NOT EXISTS (SELECT 1 FROM inter s WHERE s.solved AND s.user_id = i.user_id AND s.problem_id = i.problem_id)
QUALIFY row_number() OVER (PARTITION BY user_id, problem_id ORDER BY contest_id) = 1
"""))
def q_unsolved_attempts(spark, sf_dir):
    """H4 + H5 + H6: attempts minus solved problems, first occurrence kept."""
    i = _inter(spark, sf_dir)
    cands = i.select("user_id", "problem_id", "contest_id")
    solved = i.where(F.col("solved")).select("user_id", "problem_id").distinct()
    return tiers.apply_filters(cands, solved, "contest_id")


@query("candidate_pool", with_base("SELECT user_id, problem_id, pool_pos FROM pool", POOL))
def q_candidate_pool(spark, sf_dir):
    """H7: unsolved problems near an attempted one (graph edge or shared tags)."""
    return _pool_blocks(spark, sf_dir, keep="all", rules=False).select("user_id", "problem_id", "pool_pos")


# ------------------------------------------------------------------ F10-F15


@query("variance_gate", with_base(f"""
SELECT user_id, (count(s) > 1 AND coalesce(stddev_pop(s), 0.0) >= 0.015
                 AND count(DISTINCT round_even(s, 3)) > 2) AS has_var
FROM hs GROUP BY user_id
""", HB))
def q_variance_gate(spark, sf_dir):
    """F10 over each user's attempted-problem batch."""
    return scoring.variance_gate(_history_batch(spark, sf_dir), "s", ["user_id"])


@query("minmax_spread", with_base(f"""
SELECT user_id, problem_id, round({spread_sql('s', 'lo', 'hi', 'n', 'i', 0.2, 0.9)}, 6) AS spread FROM hw
""", HB))
def q_minmax_spread(spark, sf_dir):
    """per-batch spread to [0.2, 0.9] (flat batches by list position)."""
    return scoring.minmax_spread(_history_batch(spark, sf_dir), "s", "spread", ["user_id"], "problem_id") \
        .select("user_id", "problem_id", "spread")


def _cos_sql(src: str, raw: str, out: str) -> str:
    """F12 without a calibrator, as CTEs ``{out}_m`` / ``{out}_f`` over ``src``
    (columns user_id, problem_id, i, <raw>)."""
    lo, hi = 0.25, 0.85
    return f"""
{out}_a AS (SELECT *, count(*) OVER (PARTITION BY user_id) AS n_, min({raw}) OVER (PARTITION BY user_id) AS lo_,
                 max({raw}) OVER (PARTITION BY user_id) AS hi_ FROM {src}),
{out}_m AS (SELECT *, CASE WHEN lo_ >= -1.1 AND hi_ <= 1.1 AND lo_ < 0 THEN ({raw} + 1.0) / 2.0
                      ELSE {spread_sql(raw, 'lo_', 'hi_', 'n_', 'i', lo, hi)} END AS mapped FROM {out}_a),
{out}_g AS (SELECT user_id, (count(mapped) > 1 AND coalesce(stddev_pop(mapped), 0.0) >= 0.015
                              AND count(DISTINCT round_even(mapped, 3)) > 2) AS ok,
                   min(mapped) AS mlo, max(mapped) AS mhi FROM {out}_m GROUP BY user_id),
{out}_f AS (SELECT m.user_id, m.problem_id,
                   CASE WHEN g.ok THEN least(greatest(m.mapped, 0.0), 1.0)
                        ELSE {spread_sql('m.mapped', 'g.mlo', 'g.mhi', 'm.n_', 'm.i', lo, hi)} END AS {out}
            FROM {out}_m m JOIN {out}_g g USING (user_id))
"""


@query("calibrate_or_spread", with_base("""
SELECT a.user_id, a.problem_id, round(a.p1, 6) AS p1, round(b.p2, 6) AS p2, true AS used_spread
FROM p1_f a JOIN p2_f b USING (user_id, problem_id)
""", HB + ", hr AS (SELECT user_id, problem_id, i, s AS r1, s * 2.0 - 1.0 AS r2 FROM hw),"
    + _cos_sql("hr", "r1", "p1") + "," + _cos_sql("hr", "r2", "p2")))
def q_calibrate_or_spread(spark, sf_dir):
    """F12 without a calibrator: raw in [0, 1) is spread, raw in [-1, 1) maps
    to (raw + 1) / 2; a flat result is spread again."""
    b = _history_batch(spark, sf_dir).withColumn("r2", F.col("s") * 2.0 - 1.0)
    a = scoring.calibrate_or_spread(b, "s", "p1", ["user_id"], "problem_id")
    a = scoring.calibrate_or_spread(a, "r2", "p2", ["user_id"], "problem_id")
    return a.select("user_id", "problem_id", "p1", "p2", F.col("p1_spread").alias("used_spread"))


@query("top_k", with_base("""
SELECT user_id, problem_id, pos FROM (
  SELECT user_id, problem_id, row_number() OVER (PARTITION BY user_id ORDER BY s DESC, problem_id) AS pos FROM hs)
WHERE pos <= 10
""", HB))
def q_top_k(spark, sf_dir):
    """top 10 per user by score (a top-k report)."""
    return scoring.top_k(_history_batch(spark, sf_dir), "s", 10).select("user_id", "problem_id", "pos")


@query("minmax_calibration", with_base(f"""
SELECT user_id, problem_id, contest_id,
       round(least(greatest((s - lo) / (hi - lo), 0.0), 1.0), 6) AS p
FROM (SELECT user_id, problem_id, contest_id, {syn()} AS s FROM inter) x,
     (SELECT min({syn()}) AS lo, CASE WHEN max({syn()}) > min({syn()}) THEN max({syn()})
                                      ELSE min({syn()}) + 1e-6 END AS hi FROM inter) m
"""))
def q_minmax_calibration(spark, sf_dir):
    """F8: fit min/max on all rows, then clip((s - lo) / (hi - lo))."""
    i = _inter(spark, sf_dir).select("user_id", "problem_id", "contest_id") \
        .withColumn("s", fixtures.synthetic_score(F.col("user_id"), F.col("problem_id")))
    return scoring.apply_minmax(i, "s", scoring.fit_minmax(i, "s"), "p").drop("s")


# ------------------------------------------------------------------ F1-F5, F18


@query("implicit_weights", with_base("""
SELECT user_id, problem_id,
       round(CASE WHEN max(CAST(solved AS INTEGER)) = 1 THEN 1.0 / (1.0 + sum(penalty_count)) ELSE 0.1 END, 6)
         AS weight
FROM inter GROUP BY user_id, problem_id
"""))
def q_implicit_weights(spark, sf_dir):
    """implicit feedback weight per (user, problem)."""
    return models.implicit_weights(_inter(spark, sf_dir))


FACTORS_SQL = """
pairs AS (SELECT DISTINCT user_id, problem_id FROM inter),
nvec AS (SELECT count(*) AS n FROM embeddings),
vecs AS (SELECT row_number() OVER (ORDER BY vec_id) - 1 AS i, CAST(embedding AS DOUBLE[]) AS v FROM embeddings),
ufac AS (SELECT p.user_id, e.v AS uf
         FROM (SELECT DISTINCT user_id, CAST('0x' || substr(user_id, 1, 6) AS BIGINT) AS u FROM inter) p, nvec
         JOIN vecs e ON e.i = p.u % n),
ifac AS (SELECT c.problem_id, e.v AS itf FROM cat c, nvec JOIN vecs e ON e.i = c.p_partkey % n)
"""


def _factor_tables(spark, sf_dir):
    """Factor tables over the whole of ``embeddings``: users and problems pick a
    vector by key modulo its row count."""
    emb = read_table(spark, sf_dir, "embeddings", "vec_id", "embedding")
    vecs = tiers.dense_positions(emb, "vec_id", "i").select("i", F.col("embedding").alias("features"))
    n = F.broadcast(emb.agg(F.count(F.lit(1)).alias("n")))
    users = _inter(spark, sf_dir).select("user_id").distinct() \
        .withColumn("k", F.conv(F.substring("user_id", 1, 6), 16, 10).cast("long"))
    items = fixtures.catalog(spark, sf_dir).select("problem_id", F.col("frontend_id").cast("long").alias("k"))
    pick = lambda d, key: d.crossJoin(n).withColumn("i", F.col("k") % F.col("n")).join(vecs, "i") \
        .select(F.col(key).alias("id"), "features")
    return pick(users, "user_id"), pick(items, "problem_id")


@query("als_raw_scores", with_base("""
SELECT p.user_id, p.problem_id,
       round(CASE WHEN u.uf IS NULL THEN 0.25 WHEN f.itf IS NULL THEN 0.0
                  ELSE list_dot_product(u.uf, f.itf) END, 6) AS als_raw
FROM pairs p LEFT JOIN ufac u USING (user_id) LEFT JOIN ifac f USING (problem_id)
""", FACTORS_SQL))
def q_als_raw_scores(spark, sf_dir):
    """factor dot products with the unknown-user / unknown-item rules
    (factors taken from the ``embeddings`` table)."""
    pairs = _inter(spark, sf_dir).select("user_id", "problem_id").distinct()
    uf, itf = _factor_tables(spark, sf_dir)
    return scoring.als_raw_scores(pairs, uf, itf)


PROFILE_SQL = """
csol AS (SELECT user_id, problem_id, normalized_score AS w FROM inter
         WHERE solved AND problem_id IN (SELECT problem_id FROM cat)),
ctot AS (SELECT user_id, sum(w) AS wsum FROM csol GROUP BY user_id),
cper AS (SELECT user_id, tag, sum(w) AS tw FROM csol JOIN cat_tags USING (problem_id) GROUP BY ALL),
prof AS (SELECT user_id, tag, tw / wsum AS weight FROM cper JOIN ctot USING (user_id) WHERE wsum > 0),
pnorm AS (SELECT user_id, sqrt(sum(weight * weight)) AS pn FROM prof GROUP BY user_id),
ntag AS (SELECT problem_id, count(*) AS nt FROM cat_tags GROUP BY problem_id)
"""


def content_sql(pairs: str) -> str:
    return f"""
chits AS (SELECT p.user_id, p.problem_id, sum(pr.weight) AS dotp
          FROM {pairs} p JOIN cat_tags t USING (problem_id)
          JOIN prof pr ON pr.user_id = p.user_id AND pr.tag = t.tag GROUP BY ALL),
craw AS (SELECT p.user_id, p.problem_id,
                CASE WHEN h.dotp IS NULL OR n.pn IS NULL OR n.pn = 0 OR t.nt IS NULL THEN 0.0
                     ELSE h.dotp / (n.pn * sqrt(CAST(t.nt AS DOUBLE))) END AS content_raw
         FROM {pairs} p LEFT JOIN chits h USING (user_id, problem_id) LEFT JOIN pnorm n USING (user_id)
         LEFT JOIN ntag t USING (problem_id))
"""


@query("content_profiles", with_base("SELECT user_id, tag, round(weight, 6) AS weight FROM prof",
                                     PROFILE_SQL))
def q_content_profiles(spark, sf_dir):
    """score-weighted tag profile of solved problems."""
    pt = features.problem_tags(build.problems(spark, sf_dir))
    return scoring.content_profiles(_inter(spark, sf_dir), pt, build.problems(spark, sf_dir))


@query("content_raw_scores", with_base(
    "SELECT user_id, problem_id, round(content_raw, 6) AS content_raw FROM craw",
    PROFILE_SQL + ", pairs AS (SELECT DISTINCT user_id, problem_id FROM inter)," + content_sql("pairs")))
def q_content_raw_scores(spark, sf_dir):
    """cosine of the user profile and the problem's tags."""
    i = _inter(spark, sf_dir)
    pt = features.problem_tags(build.problems(spark, sf_dir))
    return scoring.content_raw_scores(i.select("user_id", "problem_id").distinct(),
                                      scoring.content_profiles(i, pt, build.problems(spark, sf_dir)), pt)


@query("similar_items", """
WITH e AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings),
n AS (SELECT vec_id, v, sqrt(list_dot_product(v, v)) AS nv FROM e),
pr AS (SELECT a.vec_id, b.vec_id AS other, list_dot_product(a.v, b.v) / (a.nv * b.nv) AS sim
       FROM n a JOIN n b ON a.vec_id <> b.vec_id)
SELECT vec_id, other AS similar_vec_id, round(sim, 6) AS similarity, rank FROM (
  SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY sim DESC, other) AS rank FROM pr)
WHERE rank <= 5
""")
def q_similar_items(spark, sf_dir):
    """five most cosine-similar vectors per vector (exact, blocked)."""
    emb = read_table(spark, sf_dir, "embeddings", "vec_id", "embedding")
    return scoring.similar_items(emb, "vec_id", "embedding", n=5)


# ------------------------------------------------------------------ F13 / H8-H12


ENSEMBLE_SQL = POOL + "," + PROFILE_SQL + "," + content_sql("pool") + """,
st AS (SELECT DISTINCT user_id, problem_id FROM inter WHERE penalty_count >= 1 OR NOT solved),
near AS (SELECT DISTINCT st.user_id, a.dst_slug AS problem_id FROM st JOIN sadj a ON st.problem_id = a.src_slug),
back AS (SELECT DISTINCT c.user_id, c.problem_id FROM pool c JOIN sadj a ON c.problem_id = a.src_slug
         JOIN st ON st.user_id = c.user_id AND st.problem_id = a.dst_slug),
praw AS (SELECT p.user_id, p.problem_id, p.pool_pos AS i, """ + syn("p.user_id", "p.problem_id") + """ AS ar,
                c.content_raw AS cr,
                CASE WHEN n.user_id IS NOT NULL THEN 0.05 WHEN b.user_id IS NOT NULL THEN 0.025 ELSE 0.0 END AS boost
         FROM pool p JOIN craw c USING (user_id, problem_id)
         LEFT JOIN near n USING (user_id, problem_id) LEFT JOIN back b USING (user_id, problem_id)),
""" + _cos_sql("praw", "ar", "pa") + "," + _cos_sql("praw", "cr", "pc") + """,
ens0 AS (SELECT r.user_id, r.problem_id, r.i, a.pa, c.pc, r.boost FROM praw r
         JOIN pa_f a USING (user_id, problem_id) JOIN pc_f c USING (user_id, problem_id)),
ens1 AS (SELECT *,
           (count(pa) OVER w > 1 AND coalesce(stddev_pop(pa) OVER w, 0.0) >= 0.015) AS a_sd,
           (count(pc) OVER w > 1 AND coalesce(stddev_pop(pc) OVER w, 0.0) >= 0.015) AS c_sd
         FROM ens0 WINDOW w AS (PARTITION BY user_id)),
ens_nd AS (SELECT user_id, count(DISTINCT round_even(pa, 3)) AS a_nd, count(DISTINCT round_even(pc, 3)) AS c_nd
           FROM ens0 GROUP BY user_id),
ens2 AS (SELECT e.*, least(greatest(CASE WHEN a_sd AND a_nd > 2 THEN (0.7 * pa + 0.3 * pc) / 1.0
                                           WHEN c_sd AND c_nd > 2 THEN pc
                                           ELSE (0.7 * pa + 0.3 * pc) / 1.0 END + boost, 0.0), 1.0) AS s0
         FROM ens1 e JOIN ens_nd USING (user_id)),
ens3 AS (SELECT *, count(*) OVER w AS n3, min(s0) OVER w AS lo3, max(s0) OVER w AS hi3,
                coalesce(stddev_pop(s0) OVER w, 0.0) AS sd3 FROM ens2 WINDOW w AS (PARTITION BY user_id)),
ens_nd3 AS (SELECT user_id, count(DISTINCT round_even(s0, 3)) AS nd3 FROM ens2 GROUP BY user_id),
ens AS (SELECT user_id, problem_id, pa, pc, boost,
               CASE WHEN n3 > 1 AND NOT (n3 > 1 AND sd3 >= 0.015 AND nd3 > 2)
                    THEN """ + spread_sql("s0", "lo3", "hi3", "n3", "i", 0.3, 0.8) + """ ELSE s0 END AS score
        FROM ens3 JOIN ens_nd3 USING (user_id))
"""


def _ensemble(spark, sf_dir, users=None):
    cat = build.problems(spark, sf_dir)
    profiles = scoring.content_profiles(_inter(spark, sf_dir), features.problem_tags(cat), cat)
    return _pool_blocks(spark, sf_dir, users, keep="all", profiles=profiles)


@query("ensemble_scores", with_base("""
SELECT user_id, problem_id, round(pa, 6) AS p_als, round(pc, 6) AS p_content, round(boost, 6) AS boost,
       round(score, 6) AS score FROM ens
""", ENSEMBLE_SQL))
def q_ensemble_scores(spark, sf_dir):
    """F12 + G2 + F13 + F14: component and ensemble scores over the pool."""
    return _ensemble(spark, sf_dir).select("user_id", "problem_id", "p_als", "p_content", "boost", "score")


TIER_SQL = POOL + """,
sc AS (SELECT user_id, problem_id, tags, """ + syn() + """ AS score FROM pool),
eb AS (SELECT user_id, problem_id, score,
              row_number() OVER (PARTITION BY user_id ORDER BY score DESC, problem_id) AS pos
       FROM sc WHERE score >= """ + D(0.35) + " AND score <= " + D(0.65) + """),
en AS (SELECT user_id, problem_id, score,
              row_number() OVER (PARTITION BY user_id ORDER BY abs(score - (""" + D(0.35) + " + " + D(0.65) + """) / 2.0),
                                 score DESC, problem_id) AS pos
       FROM sc WHERE user_id NOT IN (SELECT user_id FROM eb)),
umed AS (SELECT user_id, median(finish_time_min) AS um FROM inter GROUP BY user_id),
pmed AS (SELECT problem_id, median(finish_time_min) AS pm FROM inter GROUP BY problem_id),
cf AS (SELECT sc.user_id, sc.problem_id, sc.score,
              row_number() OVER (PARTITION BY sc.user_id ORDER BY sc.score DESC, sc.problem_id) AS pos
       FROM sc LEFT JOIN umed USING (user_id) LEFT JOIN pmed USING (problem_id)
       WHERE sc.score >= """ + D(0.75) + """ AND NOT (um IS NOT NULL AND pm IS NOT NULL AND pm > um * 1.2)),
ur AS (SELECT user_id, CAST(round(avg(user_rating) / 3000 * 1000000) AS BIGINT) AS r FROM inter GROUP BY user_id),
ut AS (SELECT user_id, tag, sum(CAST(solved AS BIGINT)) AS s, count(*) AS c FROM it GROUP BY user_id, tag),
utr AS (SELECT ut.*, ur.r FROM ut JOIN ur USING (user_id)),
gr AS (SELECT tag, r, sum(s) AS s, sum(c) AS c FROM utr GROUP BY tag, r),
rates AS (SELECT tag, r, sum(s) OVER w / sum(c) OVER w AS peer_rate FROM gr
          WINDOW w AS (PARTITION BY tag ORDER BY r RANGE BETWEEN 100000 PRECEDING AND 100000 FOLLOWING)),
peer AS (SELECT user_id, tag, peer_rate FROM utr JOIN rates USING (tag, r)),
urate AS (SELECT user_id, tag, avg(CAST(solved AS DOUBLE)) AS rate FROM it GROUP BY user_id, tag),
blind AS (SELECT u.user_id, list(u.tag) AS bt FROM urate u LEFT JOIN peer p USING (user_id, tag)
          WHERE u.rate < coalesce(p.peer_rate, 0.5) - 0.15 GROUP BY u.user_id),
bl AS (SELECT sc.user_id, sc.problem_id, sc.score,
              row_number() OVER (PARTITION BY sc.user_id ORDER BY sc.score DESC, sc.problem_id) AS pos
       FROM sc JOIN blind b USING (user_id) WHERE list_has_any(sc.tags, b.bt)),
tiered AS (
  SELECT 'edge_of_competence' AS tier, * FROM eb WHERE pos <= 5
  UNION ALL SELECT 'edge_of_competence', * FROM en WHERE pos <= 5
  UNION ALL SELECT 'confidence_builders', * FROM cf WHERE pos <= 5
  UNION ALL SELECT 'blind_spots', * FROM bl WHERE pos <= 5
)
"""


def _tiers(spark, sf_dir):
    i = _inter(spark, sf_dir)
    blind = store.materialize(peers.blind_spots(i))
    umed = i.groupBy("user_id").agg(F.median("finish_time_min").alias("median_finish_time"))
    pmed = i.groupBy("problem_id").agg(F.median("finish_time_min").alias("median_finish_time"))
    sc = _pool_blocks(spark, sf_dir, rules=False, blind=blind, user_median=umed, problem_median=pmed) \
        .join(build.problems(spark, sf_dir).select("problem_id", "tags"), "problem_id")
    return tiers.assign_tiers(store.materialize(sc), blind=blind, user_median=umed, problem_median=pmed)


@query("tier_assignment", with_base(
    "SELECT user_id, tier, pos, problem_id, round(score, 6) AS score FROM tiered", TIER_SQL))
def q_tier_assignment(spark, sf_dir):
    """H8: edge / confidence / blind-spot tiers (E5 blind tags, speed check)."""
    return _tiers(spark, sf_dir).select("user_id", "tier", "pos", "problem_id", "score")


DIVERSITY_SQL = "WITH RECURSIVE " + BASE_CTES.strip() + "," + TIER_SQL.strip() + """,
items AS (SELECT t.user_id, t.tier, t.problem_id, t.score, c.tags,
                 row_number() OVER (PARTITION BY t.user_id, t.tier ORDER BY t.score DESC, t.problem_id) AS i
          FROM tiered t JOIN cat c USING (problem_id)),
fold AS (
  SELECT DISTINCT user_id, tier, CAST(0 AS BIGINT) AS i, CAST([] AS VARCHAR[]) AS seen,
         CAST([] AS VARCHAR[]) AS kept, CAST([] AS BIGINT[]) AS ranks FROM items
  UNION ALL
  SELECT f.user_id, f.tier, f.i + 1,
         CASE WHEN x.full THEN f.seen ELSE list_concat(f.seen, x.tags) END,
         CASE WHEN x.full THEN f.kept ELSE list_append(f.kept, x.problem_id) END,
         CASE WHEN x.full THEN f.ranks ELSE list_append(f.ranks, x.i) END
  FROM fold f JOIN LATERAL (
    SELECT it.problem_id, it.tags, it.i,
           len(list_filter(it.tags, lambda t: len(list_filter(f.seen, lambda s: s = t)) >= 2)) > 0 AS full
    FROM items it WHERE it.user_id = f.user_id AND it.tier = f.tier AND it.i = f.i + 1) x ON true
),
last AS (SELECT * FROM fold QUALIFY row_number() OVER (PARTITION BY user_id, tier ORDER BY i DESC) = 1)
SELECT l.user_id, l.tier, k.problem_id, round(it.score, 6) AS score, k.rank, k.pos
FROM last l, LATERAL (SELECT unnest(l.kept) AS problem_id, unnest(l.ranks) AS rank,
                             unnest(range(1, len(l.kept) + 1)) AS pos) k
JOIN items it ON it.user_id = l.user_id AND it.tier = l.tier AND it.problem_id = k.problem_id
"""


@query("diversity_rank", DIVERSITY_SQL)
def q_diversity_rank(spark, sf_dir):
    """H9: greedy tag-diversity rank inside each tier (sequential fold)."""
    return tiers.diversity_rank(_tiers(spark, sf_dir))


@query("enriched_tiers", with_base("""
SELECT t.user_id, t.tier, t.pos, t.problem_id, round(round_even(t.score, 4), 6) AS p_solve, c.title
FROM tiered t JOIN cat c USING (problem_id)
""", TIER_SQL))
def q_enriched_tiers(spark, sf_dir):
    """p_solve (4 decimals, half-even) and title."""
    t = _tiers(spark, sf_dir)
    return tiers.enrich(t, build.problems(spark, sf_dir)).select(
        "user_id", "tier", "pos", "problem_id", "p_solve", "title")


@query("score_rank", with_base("""
SELECT user_id, problem_id, row_number() OVER (PARTITION BY user_id ORDER BY s DESC, problem_id) AS rank FROM hs
""", HB))
def q_score_rank(spark, sf_dir):
    """H10."""
    b = _history_batch(spark, sf_dir).withColumnRenamed("s", "score")
    return tiers.score_rank(b).select("user_id", "problem_id", "rank")


@query("recency_rank", with_base("""
SELECT h.user_id, h.problem_id, coalesce(r.recency, 0) AS recency,
       row_number() OVER (PARTITION BY h.user_id ORDER BY h.s DESC, h.problem_id) AS rank
FROM hs h LEFT JOIN (SELECT problem_id, (SELECT max(contest_num) FROM inter) - max(contest_num) AS recency
                     FROM inter GROUP BY problem_id) r USING (problem_id)
""", HB))
def q_recency_rank(spark, sf_dir):
    """Score order with contests-since-last-attempt attached."""
    i = tiers.with_contest_number(_inter(spark, sf_dir))
    last = i.groupBy("problem_id").agg(F.max("contest_num").alias("last"))
    mx = i.agg(F.max("contest_num").alias("mx"))
    rec = last.crossJoin(F.broadcast(mx)).select("problem_id", (F.col("mx") - F.col("last")).alias("recency"))
    b = _history_batch(spark, sf_dir).withColumnRenamed("s", "score")
    return tiers.recency_rank(b, rec).select("user_id", "problem_id", "recency", "rank")


# ------------------------------------------------------------------ J


@query("ranking_metrics", with_base("""
SELECT n.user_id,
       round(CASE WHEN coalesce(p.n_recs, 0) > 0 THEN coalesce(p.hits_k, 0) / 10.0 ELSE 0.0 END, 6) AS precision_at_k,
       round(coalesce(p.hits_k, 0) / n.n_rel, 6) AS recall_at_k,
       round(CASE WHEN coalesce(p.n_recs, 0) > 0 AND least(n.n_rel, 10) > 0
                  THEN coalesce(p.dcg, 0.0) / list_sum(list_transform(range(1, least(n.n_rel, 10) + 1),
                                                                       lambda x: 1.0 / log2(x + 1.0)))
                  ELSE 0.0 END, 6) AS ndcg_at_k,
       round(coalesce(1.0 / p.first_hit, 0.0), 6) AS mrr
FROM nrel n LEFT JOIN per p USING (user_id)
""", HB + """,
rkd AS (SELECT user_id, problem_id, row_number() OVER (PARTITION BY user_id ORDER BY s DESC, problem_id) AS pos FROM hs),
rel AS (SELECT DISTINCT user_id, problem_id FROM inter WHERE solved),
nrel AS (SELECT user_id, count(*) AS n_rel FROM rel GROUP BY user_id),
per AS (SELECT rkd.user_id,
               sum(CASE WHEN pos <= 10 AND rel.problem_id IS NOT NULL THEN 1 ELSE 0 END) AS hits_k,
               sum(CASE WHEN pos <= 10 AND rel.problem_id IS NOT NULL THEN 1.0 / log2(pos + 1.0) ELSE 0.0 END) AS dcg,
               min(CASE WHEN rel.problem_id IS NOT NULL THEN pos END) AS first_hit, count(*) AS n_recs
        FROM rkd LEFT JOIN rel USING (user_id, problem_id) GROUP BY rkd.user_id)
"""))
def q_ranking_metrics(spark, sf_dir):
    """J1-J4 at k = 10: ranked attempted problems vs solved ones."""
    b = _history_batch(spark, sf_dir)
    recs = scoring.top_k(b, "s", 10 ** 9).select("user_id", "problem_id", "pos")
    rel = _inter(spark, sf_dir).where(F.col("solved")).select("user_id", "problem_id")
    return evaluate.ranking_metrics(recs, rel, 10)


@query("brier_score", with_base(f"""
SELECT round(avg(pow({syn()} - CAST(solved AS DOUBLE), 2)), 6) AS brier FROM inter
"""))
def q_brier_score(spark, sf_dir):
    """Mean squared error of the synthetic probability vs solved."""
    i = _inter(spark, sf_dir).withColumn("p", fixtures.synthetic_score(F.col("user_id"), F.col("problem_id")))
    return evaluate.brier(i, "p", "solved")


# ------------------------------------------------------------------ Spark ML (rows-only)


@query("als_fit_scores")
def q_als_fit_scores(spark, sf_dir):
    """F2 + F3: implicit ALS (64 factors, 15 iterations) and raw scores for
    every observed (user, problem)."""
    i = _inter(spark, sf_dir)
    fit = models.fit_als(i)
    return fit.raw_scores(i.select("user_id", "problem_id").distinct())


def isotonic_sql(rows: str) -> str:
    """F6 by the min-max formula over distinct scores: CTEs ``{rows}_f`` (score x,
    prediction p) from ``rows`` (s, y)."""
    return f"""
{rows}_h AS (SELECT floor(floor(s * 1e9 + 0.5) / 1e9 * 1e9 + 0.5) / 1e9 AS x, count(*) AS n, sum(y) AS y FROM {rows} GROUP BY 1),
{rows}_c AS (SELECT x, n, y, row_number() OVER w AS k, sum(n) OVER w AS cn, sum(y) OVER w AS cy FROM {rows}_h
             WINDOW w AS (ORDER BY x)),
{rows}_m AS (SELECT i.k AS i, j.k AS j, min((j.cy - i.cy + i.y) / (j.cn - i.cn + i.n)) OVER (PARTITION BY i.k ORDER BY j.k DESC) AS lo
             FROM {rows}_c i JOIN {rows}_c j ON j.k >= i.k),
{rows}_f AS (SELECT c.x, c.k, max(m.lo) AS p FROM {rows}_m m JOIN {rows}_c c ON c.k = m.j GROUP BY ALL)
"""


@query("als_half_step", with_base("""
SELECT user_id, round((a22 * b1 - a12 * b2) / (a11 * a22 - a12 * a12), 6) AS f1,
       round((a11 * b2 - a12 * b1) / (a11 * a22 - a12 * a12), 6) AS f2
FROM (SELECT w.user_id, g11 + sum(weight * y1 * y1) + 0.1 * count(*) AS a11, g12 + sum(weight * y1 * y2) AS a12,
             g22 + sum(weight * y2 * y2) + 0.1 * count(*) AS a22, sum((1 + weight) * y1) AS b1, sum((1 + weight) * y2) AS b2
      FROM hw_ w JOIN y USING (problem_id), gram GROUP BY w.user_id, g11, g12, g22)
""", FACTORS_SQL + """,
y AS (SELECT problem_id, itf[1] AS y1, itf[2] AS y2 FROM ifac),
gram AS (SELECT sum(y1 * y1) AS g11, sum(y1 * y2) AS g12, sum(y2 * y2) AS g22 FROM y),
hw_ AS (SELECT user_id, problem_id, CASE WHEN max(CAST(solved AS INTEGER)) = 1 THEN CAST(1.0 AS DOUBLE) / (1 + sum(penalty_count))
               ELSE CAST(0.1 AS DOUBLE) END AS weight FROM inter GROUP BY user_id, problem_id)
"""))
def q_als_half_step(spark, sf_dir):
    """user factors by one implicit ALS half-step over all interactions, from
    problem factors of rank 2 (the first components of ``embeddings``)."""
    _, items = _factor_tables(spark, sf_dir)
    out = als_step.user_factors(models.implicit_weights(_inter(spark, sf_dir)),
                                items.select("id", F.slice("features", 1, 2).alias("features")))
    return out.select(F.col("id").alias("user_id"), F.col("features")[0].alias("f1"), F.col("features")[1].alias("f2"))


@query("isotonic_calibration", with_base("""
SELECT p.user_id, p.problem_id, p.solved, round(p.content_raw, 6) AS content_raw, round(f.p, 6) AS p
FROM iso_p p JOIN iso_f f ON f.x = floor(floor(p.content_raw * 1e9 + 0.5) / 1e9 * 1e9 + 0.5) / 1e9
""", PROFILE_SQL + ", pairs AS (SELECT DISTINCT user_id, problem_id FROM inter)," + content_sql("pairs") + """,
iso_p AS (SELECT i.user_id, i.problem_id, i.solved, c.content_raw FROM inter i JOIN craw c USING (user_id, problem_id)),
iso AS (SELECT content_raw AS s, CAST(solved AS DOUBLE) AS y FROM iso_p),""" + isotonic_sql("iso")))
def q_isotonic_calibration(spark, sf_dir):
    """isotonic fit of solved on the content raw score, applied back."""
    i = _inter(spark, sf_dir)
    pt = features.problem_tags(build.problems(spark, sf_dir))
    rows = scoring.content_raw_scores(i.select("user_id", "problem_id", "solved"),
                                      scoring.content_profiles(i, pt, build.problems(spark, sf_dir)), pt)
    m = models.fit_isotonic(rows, "content_raw", "solved")
    return models.apply_isotonic(m, rows, "content_raw", "p")


@query("platt_calibration", "WITH RECURSIVE " + BASE_CTES.strip() + f""",
rows AS (SELECT user_id, problem_id, contest_id, solved, {syn()} AS s FROM inter),
h AS (SELECT s AS x, count(*) AS n, sum(CAST(solved AS DOUBLE)) AS y FROM rows GROUP BY s),
newton AS (
  SELECT 0 AS i, {D(0)} AS a, {D(0)} AS b
  UNION ALL
  SELECT t.i + 1, t.a - (g.bb * (g.ga + t.a) - g.ab * g.gb) / ((g.aa + 1) * g.bb - g.ab * g.ab),
         t.b - ((g.aa + 1) * g.gb - g.ab * (g.ga + t.a)) / ((g.aa + 1) * g.bb - g.ab * g.ab)
  FROM newton t, LATERAL (
    SELECT sum((n * p - y) * x) AS ga, sum(n * p - y) AS gb, sum(n * p * (1 - p) * x * x) AS aa,
           sum(n * p * (1 - p) * x) AS ab, sum(n * p * (1 - p)) AS bb
    FROM (SELECT x, n, y, 1 / (1 + exp(-(t.a * x + t.b))) AS p FROM h)) g
  WHERE t.i < 20)
SELECT user_id, problem_id, contest_id, solved, round(s, 6) AS s, round(1 / (1 + exp(-(a * s + b))), 6) AS p
FROM rows, (SELECT a, b FROM newton WHERE i = 20)
""")
def q_platt_calibration(spark, sf_dir):
    """logistic calibration of the synthetic raw score."""
    i = _inter(spark, sf_dir).select("user_id", "problem_id", "contest_id", "solved") \
        .withColumn("s", fixtures.synthetic_score(F.col("user_id"), F.col("problem_id")))
    m = models.fit_platt(i, "s", "solved")
    return models.apply_platt(m, i, "s", "p")


@query("fit_calibrator", with_base("""
SELECT DISTINCT round(b, 6) AS boundary, round(p, 6) AS prediction
FROM (SELECT p, min(x) AS lo, max(x) AS hi FROM cal_f GROUP BY p), LATERAL (SELECT unnest([lo, hi]) AS b)
""", SPLIT_SQL + f""",
cal AS (SELECT {syn()} AS s, CAST(solved AS DOUBLE) AS y FROM inter, sp WHERE contest_num >= split_at),""" + isotonic_sql("cal")))
def q_fit_calibrator(spark, sf_dir):
    """isotonic fit on all test rows; the fitted step table is returned."""
    i = _inter(spark, sf_dir)
    _, test = tiers.temporal_split(i)
    rows = test.withColumn("s", fixtures.synthetic_score(F.col("user_id"), F.col("problem_id")))
    return models.fit_calibrator(rows, "s", "solved").table
