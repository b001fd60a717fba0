"""Exact top-k inner-product search as a Voronoi kNN join.

1. ``PIVOTS`` vectors of smallest id hash are the pivots (a bounded sample;
   they steer the work and never the result).  Queries are grouped by nearest
   pivot; each group is summarised by its radius (largest distance of a member
   to the pivot).
2. For a data vector x and a query q of group i, <q, x> lies within
   ``<p_i, x> +- radius_i * |x|``.  Every task keeps the k + 1 largest lower
   ends for each group (one more, as the query's own row does not count); their
   maximum over the tasks is a score that every query of the group reaches.
3. A data vector is replicated to a group only if its upper end reaches that
   score, into one of the group's data blocks; query groups are cut into
   blocks as well, so no task holds a whole hot group.
4. Each (group, query block, data block) is solved by one matrix product, and
   the partial top-k lists are merged by a window over (query).

Scores are integer inner products, exact (64-bit integers where doubles could
round).  Ties go to the smaller id.  Edge cases: vectors that are null, empty,
hold null or non-finite components, or have another length than most, take no
part, nor do null ids; of repeated ids the smallest vector counts; a query
without any other vector has no row; extra columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from edgecraft.llm import common

PIVOTS, QUERY_BLOCK, DATA_BLOCK = 64, 512, 8192


def quantised(table: DataFrame, vec: str = "embedding", scale: int = 256) -> DataFrame:
    """``vec_id``, ``v`` (array of long): floor(scale * x) of the rows that take part."""
    ok = table.select("vec_id", F.col(vec).cast("array<double>").alias("x")).where(
        F.col("vec_id").isNotNull() & F.col("x").isNotNull() & (F.size("x") > 0)
        & F.forall("x", lambda x: F.coalesce((x > float("-inf")) & (x < float("inf")), F.lit(False))))
    rows = ok.select("vec_id", F.transform("x", lambda x: F.floor(x * F.lit(scale))).alias("v"))
    return rows.groupBy("vec_id").agg(F.min("v").alias("v"))


def matrix(column) -> np.ndarray:
    """Rows of an Arrow list column of equal lengths."""
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1).astype(np.int64)


def products(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Integer inner products, by doubles where they are exact."""
    top = float(np.abs(q).max(initial=0)) * float(np.abs(x).max(initial=0)) * q.shape[1]
    if top < 2 ** 53:
        return (q.astype(float) @ x.T.astype(float)).astype(np.int64)
    return q @ x.T


def top_rows(scores: np.ndarray, ids: np.ndarray, own: np.ndarray, k: int):
    """(row, id, score) of the k best of each row, own id left out."""
    low = np.iinfo(np.int64).min + 1                 # its negative is an integer as well
    scores = np.where(ids[None, :] == own[:, None], low, scores)
    m = min(k, scores.shape[1])
    kth = -np.partition(-scores, m - 1, axis=1)[:, m - 1]
    row, col = np.nonzero((scores >= kth[:, None]) & (ids[None, :] != own[:, None]))
    s = scores[row, col]
    by = np.lexsort((ids[col], -s, row))
    row, col, s = row[by], col[by], s[by]
    nth = np.arange(len(row)) - np.searchsorted(row, row)
    keep = nth < k
    return row[keep], ids[col[keep]], s[keep]


def knn_join(queries: DataFrame, data: DataFrame, k: int, pivots: int = PIVOTS,
             query_block: int = QUERY_BLOCK, data_block: int = DATA_BLOCK) -> DataFrame:
    """``queries`` and ``data``: (``vec_id`` long, ``v`` array of long, equal
    lengths).  Returns ``query_id``, ``rank``, ``vec_id``, ``score``."""
    spark = data.sparkSession
    picked = data.orderBy(F.xxhash64("vec_id"), "vec_id").limit(pivots).collect()
    out = "query_id long, rank int, vec_id long, score long"
    if not picked:
        return spark.createDataFrame([], out)
    p = np.array([r.v for r in picked], float)
    shared = spark.sparkContext.broadcast(p)

    def group(batches):
        piv = shared.value
        for rb in batches:
            x = matrix(rb.column(1)).astype(float)
            d2 = ((x * x).sum(1)[:, None] - 2 * x @ piv.T + (piv * piv).sum(1)[None, :])
            near = d2.argmin(1)
            dist = np.sqrt(((x - piv[near]) ** 2).sum(1))
            yield pa.RecordBatch.from_arrays([rb.column(0), rb.column(1), pa.array(near.astype(np.int32)),
                                              pa.array(dist)], names=["vec_id", "v", "cell", "dist"])

    grouped = common.checkpoint(queries.select("vec_id", "v").mapInArrow(
        group, "vec_id long, v array<long>, cell int, dist double"))
    cells = {r.cell: (r.radius * (1 + 1e-9) + 1e-6, r.n) for r in
             grouped.groupBy("cell").agg(F.max("dist").alias("radius"), F.count("*").alias("n")).collect()}
    if not cells:
        return spark.createDataFrame([], out)
    live = np.array(sorted(cells))
    radius = np.array([cells[c][0] for c in live])

    def bounds(x: np.ndarray):
        mid, slack = x @ shared.value[live].T, np.sqrt((x * x).sum(1))[:, None] * radius[None, :]
        slack = slack * (1 + 1e-9) + 1e-6 + 1e-9 * np.abs(mid)          # room for rounding
        return mid - slack, mid + slack

    def lower(batches):
        best = np.full((len(live), k + 1), -np.inf)
        for rb in batches:
            low, _ = bounds(matrix(rb.column(0)).astype(float))
            both = np.concatenate([best, low.T], axis=1)
            best = -np.partition(-both, k, axis=1)[:, :k + 1] if both.shape[1] > k + 1 else both
        c, j = np.nonzero(np.isfinite(best))
        yield pa.RecordBatch.from_pydict({"cell": pa.array(live[c].astype(np.int32)), "low": best[c, j]})

    summary = data.select("v").mapInArrow(lower, "cell int, low double")
    place = F.row_number().over(Window.partitionBy("cell").orderBy(F.desc("low")))
    reach = {r.cell: r.low for r in summary.withColumn("n", place).where(F.col("n") == k + 1).collect()}
    floor = np.array([reach.get(c, -np.inf) for c in live])             # fewer vectors than k + 1: take all

    def replicate(batches):
        for rb in batches:
            x = matrix(rb.column(1))
            _, high = bounds(x.astype(float))
            row, c = np.nonzero(high >= floor[None, :])
            yield pa.RecordBatch.from_arrays(
                [pa.array(live[c].astype(np.int32)), rb.column(0).take(pa.array(row)), rb.column(1).take(pa.array(row))],
                names=["cell", "vec_id", "v"])

    def count(batches):
        n = np.zeros(len(live), np.int64)
        for rb in batches:
            _, high = bounds(matrix(rb.column(0)).astype(float))
            n += (high >= floor[None, :]).sum(0)
        yield pa.RecordBatch.from_pydict({"cell": pa.array(live.astype(np.int32)), "n": n})

    needed = {r.cell: r.n for r in data.select("v").mapInArrow(count, "cell int, n long")
              .groupBy("cell").agg(F.sum("n").alias("n")).collect()}
    q_blocks = {int(c): -(-cells[c][1] // query_block) for c in live}
    d_blocks = {int(c): max(1, -(-needed.get(c, 0) // data_block)) for c in live}
    blocks = F.broadcast(spark.createDataFrame(                         # at most `pivots` rows
        [(c, q_blocks[c], d_blocks[c]) for c in q_blocks], "cell int, qb int, db int"))
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    q = (grouped.join(blocks, "cell").withColumn("q", F.pmod(F.xxhash64("vec_id"), F.col("qb")).cast("int"))
         .select("cell", "q", every("db").alias("d"), "vec_id", "v"))
    x = (data.select("vec_id", "v").mapInArrow(replicate, "cell int, vec_id long, v array<long>").join(blocks, "cell")
         .withColumn("d", F.pmod(F.xxhash64("vec_id"), F.col("db")).cast("int"))
         .select("cell", every("qb").alias("q"), "d", "vec_id", "v"))

    def solve(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if not len(left) or not len(right):
            return pd.DataFrame({"query_id": [], "vec_id": [], "score": []}).astype("int64")
        ids, own = right["vec_id"].to_numpy(), left["vec_id"].to_numpy()
        row, who, s = top_rows(products(np.stack(left["v"]), np.stack(right["v"])), ids, own, k)
        return pd.DataFrame({"query_id": own[row], "vec_id": who, "score": s})

    keys = ["cell", "q", "d"]
    found = q.groupBy(*keys).cogroup(x.groupBy(*keys)).applyInPandas(solve, "query_id long, vec_id long, score long")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return (found.withColumn("rank", rank.cast("int")).where(F.col("rank") <= k)
            .select("query_id", "rank", "vec_id", "score"))


def op1_voronoi_knn(spark, sf_dir: str) -> DataFrame:
    rows = quantised(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
    sizes = rows.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), "d").limit(1).collect()
    data = common.checkpoint(rows.where(F.size("v") == (sizes[0].d if sizes else 0)))
    return knn_join(data.where(F.col("vec_id") % 50 == 0), data, 5)


OP1_SQL = """
WITH ok AS (
  SELECT vec_id, [CAST(floor(CAST(x AS DOUBLE) * 256) AS BIGINT) FOR x IN embedding] AS v
  FROM embeddings WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(embedding) = 64
    AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0),
e AS (SELECT vec_id, unnest(v) AS x, generate_subscripts(v, 1) AS i FROM ok),
s AS (SELECT q.vec_id AS query_id, d.vec_id, CAST(sum(q.x * d.x) AS BIGINT) AS score
      FROM e q JOIN e d ON q.i = d.i AND q.vec_id <> d.vec_id WHERE q.vec_id % 50 = 0 GROUP BY 1, 2)
SELECT query_id, CAST(row_number() OVER w AS INTEGER) AS rank, vec_id, score FROM s
WINDOW w AS (PARTITION BY query_id ORDER BY score DESC, vec_id) QUALIFY row_number() OVER w <= 5"""
