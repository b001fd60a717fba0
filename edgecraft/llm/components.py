"""Connected components of a link table, distributed."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from edgecraft.llm import common


def components(links: DataFrame) -> DataFrame:
    """(``node``, ``label``) for every node of ``links`` (long columns ``a``,
    ``b``): label is the smallest node it reaches.

    Rounds of minimum propagation over the links followed by a pointer jump,
    until no label changes; each round is checkpointed.  Links, labels and
    hubs stay distributed: the minimum is combined before the shuffle.
    """
    both = common.checkpoint(
        links.select("a", "b").union(links.select(F.col("b"), F.col("a"))).where("a <> b").distinct())
    label = common.checkpoint(both.groupBy(F.col("a").alias("node"))
                              .agg(F.least(F.min("a"), F.min("b")).alias("label")))
    while True:
        near = (both.join(label, both["b"] == label["node"]).groupBy(F.col("a").alias("n_"))
                .agg(F.min("label").alias("near")))
        low = (label.join(near, label["node"] == near["n_"], "left")
               .select("node", F.col("label").alias("old"), F.least("label", F.coalesce("near", "label")).alias("mid")))
        up = label.select(F.col("node").alias("u_"), F.col("label").alias("up"))
        new = common.checkpoint(
            low.join(up, F.col("mid") == F.col("u_"), "left")
            .select("node", F.least("mid", F.coalesce("up", "mid")).alias("label"), "old"))
        label = new.select("node", "label")
        if new.where("label <> old").isEmpty():
            return label
