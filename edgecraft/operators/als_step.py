"""F2, one half-step of implicit ALS in the open: the factors of users from
given factors of problems.  It folds new users into a fitted model without a new
fit, and it is the equation that a fit can be checked against.

For a user with weights w (F1) the factors x solve

    (Y'Y + alpha * sum w y y' + reg * n I) x = sum (1 + alpha * w) y

over the n problems with a positive weight.  Y'Y is one aggregate over the
problems.  The sums of each user are packed upper triangles, added up in two
levels: rows of a user with many problems are salted into parts of about ``PART``
rows, then the parts of a user are added and its system solved, a block of users
at once.  Problems without factors are left out; a user with none of them left
has no row.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from edgecraft.config import DEFAULT, Config

PART = 4096


def gram(item_factors: DataFrame) -> np.ndarray:
    """Y'Y (rank x rank) from packed sums of outer products."""
    both = F.flatten(F.transform("features", lambda a: F.transform("features", lambda b: a.cast("double") * b.cast("double"))))
    rows = item_factors.select(F.posexplode(both).alias("i", "v")).groupBy("i").agg(F.sum("v").alias("v")).collect()
    rank = int(round(len(rows) ** 0.5))
    out = np.zeros(rank * rank)
    for r in rows:                                       # rank * rank numbers
        out[r.i] = r.v
    return out.reshape(rank, rank)


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)


def user_factors(weights: DataFrame, item_factors: DataFrame, cfg: Config = DEFAULT,
                 blocks: int | None = None) -> DataFrame:
    """``id`` and ``features`` of every user of ``weights`` (user_id, problem_id,
    weight > 0), given ``item_factors`` (id, features)."""
    spark = weights.sparkSession
    blocks = blocks or int(spark.conf.get("spark.sql.shuffle.partitions"))
    yty = gram(item_factors)
    rank = len(yty)
    upper = np.triu_indices(rank)
    alpha, reg = cfg.als_alpha, cfg.als_reg
    known = weights.join(item_factors.select(F.col("id").alias("problem_id"),
                                             F.col("features").cast("array<double>").alias("features")), "problem_id")
    parts = weights.groupBy("user_id").agg(F.ceil(F.count(F.lit(1)) / PART).alias("parts"))
    block = F.pmod(F.xxhash64("user_id"), F.lit(blocks)).cast("int")
    dealt = known.join(parts, "user_id").select(
        block.alias("block"), F.pmod(F.xxhash64("problem_id"), F.col("parts")).cast("int").alias("part"),
        "user_id", F.col("weight").cast("double").alias("weight"), "features")

    def add(key: tuple, rows: pa.Table) -> pa.Table:
        rows = rows.sort_by("user_id").combine_chunks()
        user = rows["user_id"].combine_chunks()
        y, c = _matrix(rows["features"].combine_chunks()), alpha * rows["weight"].to_numpy()
        first = np.flatnonzero(np.append(True, pc.not_equal(user[1:], user[:-1]).to_numpy(zero_copy_only=False)))
        a = np.add.reduceat(c[:, None] * y[:, upper[0]] * y[:, upper[1]], first)
        b = np.add.reduceat((1.0 + c)[:, None] * y, first)
        n = np.diff(np.append(first, len(y)))
        return pa.table({"block": pa.array(np.full(len(first), key[0].as_py(), np.int32)), "user_id": user.take(pa.array(first)),
                         "n": n, "a": pa.array(list(a)), "b": pa.array(list(b))})

    def solve(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by("user_id").combine_chunks()
        user = rows["user_id"].combine_chunks()
        first = np.flatnonzero(np.append(True, pc.not_equal(user[1:], user[:-1]).to_numpy(zero_copy_only=False)))
        a, b, n = (np.add.reduceat(x, first) for x in (_matrix(rows["a"].combine_chunks()), _matrix(rows["b"].combine_chunks()),
                                                       rows["n"].to_numpy()))
        full = np.zeros((len(first), rank, rank))
        full[:, upper[0], upper[1]] = a
        full[:, upper[1], upper[0]] = a
        full += yty + (reg * n)[:, None, None] * np.eye(rank)
        return pa.table({"id": user.take(pa.array(first)), "features": pa.array(list(np.linalg.solve(full, b[:, :, None])[:, :, 0]))})

    sums = dealt.groupBy("block", "part").applyInArrow(add, "block int, user_id string, n long, a array<double>, b array<double>")
    return sums.groupBy("block").applyInArrow(solve, "id string, features array<double>")
