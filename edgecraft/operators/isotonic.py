"""Isotonic calibration as a Spark job.

Scores become a histogram (score, rows, sum of labels), sorted by score ranges.
Neighbours that violate the order are pooled inside each range, range by range in
parallel; then only ranges whose ends still violate the order are joined and
pooled again, until none does.  The driver sees one border row for each range.
Pooled blocks of any grouping in score order have the same end result, so the
rounds give the fit of the whole table.

The fitted step table has one row for each end of a block; between blocks
predictions are interpolated, outside they stay at the ends.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from edgecraft.functions.exprs import stable_round
from edgecraft.plans.store import materialize

BLOCK = "part int, first double, last double, n double, s double"
#: Rows of a step table that are sent to every task when it is applied (16 bytes each).
MAX_STEPS = 1 << 20


def pool(first: np.ndarray, last: np.ndarray, n: np.ndarray, s: np.ndarray) -> list[list[float]]:
    """Blocks in score order, neighbours pooled until their means rise."""
    out: list[list[float]] = []
    for row in zip(first.tolist(), last.tolist(), n.tolist(), s.tolist()):
        cur = list(row)
        while out and out[-1][3] * cur[2] >= cur[3] * out[-1][2]:
            prev = out.pop()
            cur = [prev[0], cur[1], prev[2] + cur[2], prev[3] + cur[3]]
        out.append(cur)
    return out


def _pool_group(pdf: pd.DataFrame) -> pd.DataFrame:
    d = pdf.sort_values("first")
    rows = pool(d["first"].to_numpy(), d["last"].to_numpy(), d["n"].to_numpy(), d["s"].to_numpy())
    out = pd.DataFrame(rows, columns=["first", "last", "n", "s"])
    out.insert(0, "part", np.int32(d["part"].min()))
    return out


def histogram(df: DataFrame, score: str, label: str) -> DataFrame:
    """Rows and label sum of each score (to nine decimals, so that the order in
    which a score was summed up does not split a tie); null scores are left out."""
    rows = df.where(F.col(score).isNotNull() & F.col(label).isNotNull())
    return rows.groupBy(stable_round(score, 9).alias("x")).agg(
        F.count(F.lit(1)).cast("double").alias("n"), F.sum(F.col(label).cast("double")).alias("s"))


@dataclass
class Steps:
    """A fitted step table ``boundary, prediction``."""
    table: DataFrame

    def arrays(self) -> tuple[np.ndarray, np.ndarray]:
        rows = self.table.orderBy("boundary").limit(MAX_STEPS + 1).toPandas()
        if len(rows) > MAX_STEPS:
            raise ValueError(f"a step table of more than {MAX_STEPS} rows is not sent to tasks")
        return rows["boundary"].to_numpy(), rows["prediction"].to_numpy()


def fit(df: DataFrame, score: str, label: str, parts: int | None = None) -> Steps:
    """Isotonic fit of ``label`` on ``score`` over all rows."""
    spark = df.sparkSession
    parts = parts or int(spark.conf.get("spark.sql.shuffle.partitions"))
    hist = histogram(df, score, label).select(F.col("x").alias("first"), F.col("x").alias("last"), "n", "s")
    placed = hist.repartitionByRange(parts, "first").withColumn("part", F.spark_partition_id())
    blocks = materialize(materialize(placed).groupBy("part").applyInPandas(_pool_group, BLOCK))
    while True:
        ends = blocks.groupBy("part").agg(F.min_by(F.struct("n", "s"), "first").alias("low"),
                                          F.max_by(F.struct("n", "s"), "first").alias("high")).orderBy("part").collect()
        joined, moved = {}, False
        for i, r in enumerate(ends):
            joined[r.part] = r.part
            if i and ends[i - 1].high.s * r.low.n >= r.low.s * ends[i - 1].high.n:
                joined[r.part] = joined[ends[i - 1].part]
                moved = True
        if not moved:
            break
        to = spark.createDataFrame(list(joined.items()), "part int, to int")
        kept = blocks.join(F.broadcast(to), "part").select(F.col("to").alias("part"), "first", "last", "n", "s")
        blocks = materialize(kept.groupBy("part").applyInPandas(_pool_group, BLOCK))
    steps = blocks.select(F.explode(F.array_distinct(F.array("first", "last"))).alias("boundary"),
                          (F.col("s") / F.col("n")).alias("prediction"))
    return Steps(materialize(steps))


def predicted(x: np.ndarray, boundary: np.ndarray, prediction: np.ndarray) -> np.ndarray:
    """Interpolated predictions; scores count to nine decimals, as in the fit."""
    return np.interp(np.floor(x * 1e9 + 0.5) / 1e9, boundary, prediction)


def apply(model: Steps, df: DataFrame, score: str, out: str) -> DataFrame:
    """Predictions of a step table; null scores give null."""
    boundary, prediction = model.arrays()

    @F.pandas_udf("double")
    def predict(x: pd.Series) -> pd.Series:
        if not len(boundary):
            return pd.Series(np.nan, index=x.index)
        return pd.Series(predicted(x.to_numpy(), boundary, prediction), index=x.index)

    return df.withColumn(out, F.when(F.col(score).isNotNull(), predict(F.col(score))))
