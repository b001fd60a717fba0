"""DuckDB SQL for the fixture mapping and the cleaned tables.

These CTE fragments restate, in plain SQL over the driver tables, what the
Spark operators compute; each ``oracle_sql()`` entry builds on them.  Fixed
values (salt, prefixes, epoch base) equal those in ``edgecraft.config`` and
``edgecraft.sources.fixtures``.
"""

# Submissions, ranks, contest stats, catalog, cleaned interactions.
BASE_CTES = """
li1 AS (
  SELECT l.l_orderkey AS o_orderkey, o.o_custkey,
         (year(o.o_orderdate) - 1995) * 12 + month(o.o_orderdate) AS cn,
         l.l_partkey, l.l_linenumber, l.l_quantity, l.l_discount, l.l_returnflag
  FROM lineitem l JOIN orders o ON l.l_orderkey = o.o_orderkey
  QUALIFY row_number() OVER (PARTITION BY l.l_orderkey, l.l_partkey
      ORDER BY l.l_linenumber, l.l_quantity, l.l_discount, l.l_extendedprice,
               l.l_returnflag, l.l_shipdate, l.l_suppkey) = 1
),
rk AS (
  SELECT o_custkey, cn,
         row_number() OVER (PARTITION BY cn ORDER BY max(o_totalprice) DESC, o_custkey) AS rnk
  FROM (SELECT o_custkey, o_totalprice,
               (year(o_orderdate) - 1995) * 12 + month(o_orderdate) AS cn FROM orders) t
  GROUP BY o_custkey, cn
),
ex AS (
  SELECT 'u' || CAST(li1.o_custkey AS VARCHAR) AS user_slug,
         'biweekly-contest-' || CAST(li1.cn AS VARCHAR) AS contest_id,
         li1.cn AS contest_num,
         li1.o_orderkey,
         CAST(li1.l_partkey AS VARCHAR) AS frontend_id,
         CAST(round(li1.l_discount * 100) AS INTEGER) % 3 AS penalty_count,
         li1.l_returnflag AS language,
         CAST(1000000000 AS BIGINT) + CAST(li1.cn AS BIGINT) * 2592000
           + CAST(floor(li1.l_quantity) AS BIGINT) * 60 + CAST(li1.l_linenumber AS BIGINT) * 7
           AS submission_date,
         (CAST(round(li1.l_discount * 100) AS INTEGER) % 3) = 0 AS solved,
         rk.rnk AS rank
  FROM li1 LEFT JOIN rk ON li1.o_custkey = rk.o_custkey AND li1.cn = rk.cn
),
cstat AS (
  SELECT contest_id, count(DISTINCT user_slug) AS n_users,
         coalesce(min(submission_date), 0) AS cstart
  FROM ex GROUP BY contest_id
),
drv AS (
  SELECT ex.*,
    CASE WHEN rank IS NULL OR rank <= 0 THEN 0.5
         ELSE 1.0 - CAST(rank AS DOUBLE) / greatest(n_users, 1) END AS rank_percentile,
    CASE WHEN cstart > 0 THEN round(CAST(submission_date - cstart AS DOUBLE) / 60.0, 2) END
      AS finish_time_min,
    CASE WHEN penalty_count > 0 THEN 1.0 / (1.0 + penalty_count)
         ELSE CAST(solved AS DOUBLE) END AS normalized_score
  FROM ex JOIN cstat USING (contest_id)
),
cat AS (
  SELECT CAST(p_partkey AS VARCHAR) AS frontend_id,
         'part-' || CAST(p_partkey AS VARCHAR) AS problem_id,
         p_name AS title,
         [p_brand, p_type, split_part(p_name, ' ', 1), split_part(p_name, ' ', 2)] AS tags,
         p_partkey, p_brand, p_type, p_size, p_name
  FROM part
),
cat_tags AS (
  SELECT DISTINCT problem_id, unnest(tags) AS tag FROM cat
),
joined AS (
  SELECT drv.*, cat.problem_id, cat.title, cat.tags FROM drv JOIN cat USING (frontend_id)
),
dedup AS (
  SELECT * FROM joined
  QUALIFY count(*) OVER (PARTITION BY user_slug, problem_id, contest_id) = 1
),
q1 AS (SELECT quantile_cont(finish_time_min, 0.9) AS finish_cap FROM dedup),
capped AS (
  SELECT dedup.* REPLACE (CASE WHEN finish_time_min > finish_cap THEN finish_cap
                               ELSE finish_time_min END AS finish_time_min)
  FROM dedup, q1
),
q2 AS (
  SELECT coalesce(nullif(median(finish_time_min), 0), 30.0) AS med_t,
         coalesce(nullif(median(penalty_count), 0), 1.0) AS med_p
  FROM capped
),
inter AS (
  SELECT substr(sha256('lrs_v1:' || user_slug), 1, 16) AS user_id,
         user_slug, contest_id, contest_num, problem_id, solved, finish_time_min,
         penalty_count, language,
         rank_percentile * 3000 AS user_rating, rank_percentile,
         CASE WHEN finish_time_min IS NULL THEN 2.0
              ELSE least(greatest((finish_time_min / greatest(med_t, 1.0)
                                   + penalty_count / greatest(med_p, 1.0)) / 2.0, 0.1), 3.0)
         END AS difficulty_proxy,
         normalized_score, tags, title
  FROM capped, q2
),
it AS (
  SELECT user_id, problem_id, contest_id, solved, unnest(tags) AS tag FROM inter
)
"""


def with_base(body: str, extra_ctes: str = "") -> str:
    """``WITH <base>[, extra] <body>``."""
    ctes = BASE_CTES.strip()
    if extra_ctes.strip():
        ctes = ctes + ",\n" + extra_ctes.strip()
    return "WITH " + ctes + "\n" + body.strip()
