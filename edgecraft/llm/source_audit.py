"""Source divergence audit by count-cell ranking.

How far the word use of each source of a language lies from the language and
from its other sources.  Terms are stretches of letters (ASCII letters, lower
case, and all that is not ASCII); a language keeps the terms that occur in at
least ``MIN_DOCS`` of its documents.  A group (language, source), and a whole
language, gives a kept term the share
``p(count) = 1 + floor(SCALE * (count + SMOOTH) / (N + SMOOTH * V))``.

Since p hangs on the count alone, terms with equal (group count, language
count) form a cell: shares and differences are worked out once a cell, cells of
equal difference are merged, ranked by difference with a running sum of their
multiplicities, and only cells that begin within the first ``TOP`` terms are
expanded to terms, in UTF-8 order.

Differences between the sources of a language are sums over terms.  Terms are
dealt into shards and sources into blocks; a (block pair, shard) is one dense
matrix of bounded size, and terms that neither source has are added by their
number.  No row is made for a pair of sources and a term.

Counting is one hash aggregate over (language, source, term) with partial sums
before the shuffle, so a hot source costs its distinct terms.  All arithmetic is
on whole numbers (decimals where products pass 64 bits).

Edge cases: null text, lang and source are ''; texts without terms still make
their (language, source) group occur; without kept terms differences between
sources are 0 and no terms are listed; repeated rows count each; an empty table
gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from edgecraft.llm import common

MIN_DOCS, SMOOTH, SCALE, TOP = 30, 5, 1_000_000_000, 50
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
GROUP = ["lang", "source"]
#: Sources in a block, and cells of a matrix (8 bytes each).
BLOCK, CELLS = 256, 1 << 15


def read(docs: DataFrame) -> DataFrame:
    return docs.select(*(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in (*GROUP, "text")))


def term_counts(docs: DataFrame) -> DataFrame:
    """``lang, source, term, c`` (occurrences) and ``d`` (documents) from :func:`read` rows."""
    words = F.array_remove(F.split(F.translate("text", UPPER, LOWER), r"[\x00-\x40\x5B-\x60\x7B-\x7F]+"), "")
    sorted_ = docs.select(*GROUP, F.sort_array(words).alias("w"))
    # (term, 1 where it begins a stretch of equal terms)
    marked = F.zip_with("w", F.concat(F.array(F.lit("")), F.slice("w", 1, F.greatest(F.size("w") - 1, F.lit(0)))),
                        lambda w, before: F.struct(w.alias("term"), (w != before).cast("int").alias("new")))
    return sorted_.select(*GROUP, F.explode(F.when(F.size("w") > 0, marked)).alias("t")) \
        .groupBy(*GROUP, F.col("t.term").alias("term")).agg(F.count(F.lit(1)).alias("c"), F.sum("t.new").alias("d"))


def share(count: Column, total: Column, kept: Column) -> Column:
    """p of a count; products and sums as decimals, the share itself is at most SCALE + 1."""
    whole = F.lit(SCALE).cast("decimal(10,0)") * (count + SMOOTH).cast("decimal(20,0)")
    parts = total.cast("decimal(20,0)") + F.lit(SMOOTH).cast("decimal(2,0)") * kept.cast("decimal(17,0)")
    return F.call_function("div", whole, parts).cast("long") + 1


def counted(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Kept terms of each group ``lang, source, term, c, cl`` (``cl``: of the
    language), and all groups ``lang, source, n, nl, v`` (totals over kept
    terms and their number; ``n`` is the group's)."""
    all_terms = common.checkpoint(term_counts(docs))
    kept = common.checkpoint(all_terms.groupBy("lang", "term").agg(F.sum("c").alias("cl"), F.sum("d").alias("d"))
                             .where(F.col("d") >= MIN_DOCS).drop("d"))
    kept = common.broadcast_if_small(kept, kept.count(), 64)
    terms = common.checkpoint(all_terms.join(kept, ["lang", "term"]))
    occur = docs.select(*GROUP).distinct()
    sums = terms.groupBy(*GROUP).agg(F.sum("c").alias("n"))
    langs = terms.groupBy("lang").agg(F.sum("c").alias("nl"))
    size = terms.select("lang", "term").distinct().groupBy("lang").agg(F.count(F.lit(1)).alias("v"))
    groups = occur.join(sums, GROUP, "left").join(langs, "lang", "left").join(size, "lang", "left") \
        .select(*GROUP, *(F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("n", "nl", "v")))
    return terms, common.checkpoint(groups)


def leading_terms(terms: DataFrame, groups: DataFrame, top: int = TOP) -> DataFrame:
    """``lang, source, item, value, rank``: terms that a group uses more than its language."""
    cells = terms.groupBy(*GROUP, "c", "cl").agg(F.count(F.lit(1)).alias("m")).join(groups, GROUP) \
        .select(*GROUP, "c", "cl", "m", (share(F.col("c"), F.col("n"), F.col("v"))
                                         - share(F.col("cl"), F.col("nl"), F.col("v"))).alias("value")) \
        .where("value > 0")
    by_value = Window.partitionBy(*GROUP).orderBy(F.desc("value"))
    # each value has a term at least, so the first `top` values are enough; then by multiplicity
    ranked = cells.groupBy(*GROUP, "value").agg(F.sum("m").alias("m")) \
        .withColumn("k", F.row_number().over(by_value)).where(F.col("k") <= top) \
        .withColumn("before", F.sum("m").over(by_value.rowsBetween(Window.unboundedPreceding, 0)) - F.col("m")) \
        .where(F.col("before") < top).select(*GROUP, "value")
    chosen = cells.join(ranked, [*GROUP, "value"]).select(*GROUP, "c", "cl", "value")
    in_order = Window.partitionBy(*GROUP).orderBy(F.desc("value"), "term")
    return terms.join(chosen, [*GROUP, "c", "cl"]).withColumn("rank", F.row_number().over(in_order)) \
        .where(F.col("rank") <= top).select(*GROUP, F.col("term").alias("item"), "value", "rank")


def shard_sums(block: int):
    """Sums of |p - q| over the terms of a shard for the source pairs of two
    blocks.  left: roster (source number, p of a missing term); right: terms."""
    def run(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        b1, b2 = key[1].as_py(), key[2].as_py()
        number, zero = left["number"].to_numpy(), left["zero"].to_numpy()
        by = np.argsort(number)
        number, zero = number[by], zero[by]
        _, column = np.unique(right["term"].to_numpy(zero_copy_only=False).astype(object), return_inverse=True) \
            if right.num_rows else (None, np.zeros(0, np.int64))
        wide = int(column.max()) + 1 if len(column) else 0
        p = np.repeat(zero[:, None], wide, axis=1)
        p[np.searchsorted(number, right["number"].to_numpy()), column] = right["p"].to_numpy()
        first, second = np.flatnonzero(number // block == b1), np.flatnonzero(number // block == b2)
        out = [np.abs(p[second] - p[i]).sum(axis=1) for i in first]
        return pa.table({"lang": pa.array([key[0].as_py()] * (len(first) * len(second)), pa.string()),
                         "a": np.repeat(number[first], len(second)), "b": np.tile(number[second], len(first)),
                         "part": np.concatenate(out) if out else np.zeros(0, np.int64),
                         "seen": np.full(len(first) * len(second), wide, np.int64)})
    return run


def source_distances(terms: DataFrame, groups: DataFrame) -> DataFrame:
    """``lang, source, item, value, rank`` for each ordered pair of sources of a language."""
    # dense numbers in two levels: inside a bucket of sources, and buckets before it
    bucket = F.pmod(F.xxhash64("source"), F.lit(64))
    inside = groups.withColumn("u", bucket).withColumn(
        "i", F.row_number().over(Window.partitionBy("lang", "u").orderBy("source")) - 1)
    sizes = inside.groupBy("lang", "u").agg(F.count(F.lit(1)).alias("s"))
    before = sizes.select("lang", "u", (F.sum("s").over(Window.partitionBy("lang").orderBy("u")) - F.col("s")).alias("o"),
                          F.sum("s").over(Window.partitionBy("lang")).alias("sources"))
    roster = common.checkpoint(inside.join(before, ["lang", "u"]).select(
        *GROUP, "n", "v", "sources", (F.col("i") + F.col("o")).cast("long").alias("number"),
        F.when(F.col("v") > 0, share(F.lit(0), F.col("n"), F.col("v"))).otherwise(0).alias("zero")))
    blocks = F.floor((F.col("sources") - 1) / BLOCK)
    # so many shards that a matrix of two blocks stays within CELLS
    shards = F.greatest(F.lit(1), F.ceil(F.col("v") * F.least("sources", F.lit(2 * BLOCK)) / CELLS))
    own = F.floor(F.col("number") / BLOCK)

    def pairs(df):
        """Each row once for every block pair (first <= second) that its block is in."""
        other = df.withColumn("o", F.explode(F.sequence(F.lit(0), blocks)))
        return other.withColumn("b1", F.least(own, "o")).withColumn("b2", F.greatest(own, "o"))

    left = pairs(roster.select("lang", "number", "zero", "sources", "v")) \
        .withColumn("shard", F.explode(F.sequence(F.lit(0), shards - 1))) \
        .select(F.col("lang").alias("lang"), "b1", "b2", "shard", "number", "zero")
    placed = terms.join(roster, GROUP).withColumn("p", share(F.col("c"), F.col("n"), F.col("v")))
    right = pairs(placed).withColumn("shard", F.pmod(F.xxhash64("term"), shards)) \
        .select("lang", "b1", "b2", "shard", "number", "term", "p")
    keys = ["lang", "b1", "b2", "shard"]
    parts = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(
        shard_sums(BLOCK), "lang string, a long, b long, part long, seen long")
    half = parts.where("a < b").groupBy("lang", "a", "b").agg(F.sum("part").alias("part"), F.sum("seen").alias("seen"))
    both = half.select("lang", F.explode(F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b"))))
                       .alias("s"), "part", "seen").select("lang", "s.a", "s.b", "part", "seen")
    name = roster.select("lang", F.col("number").alias("a"), "source", F.col("zero").alias("za"), "v")
    item = roster.select("lang", F.col("number").alias("b"), F.col("source").alias("item"), F.col("zero").alias("zb"))
    value = F.col("part") + (F.col("v") - F.col("seen")) * F.abs(F.col("za") - F.col("zb"))
    ranked = Window.partitionBy(*GROUP).orderBy(F.desc("value"), "item")
    return both.join(name, ["lang", "a"]).join(item, ["lang", "b"]) \
        .select(*GROUP, "item", F.when(F.col("v") > 0, value).otherwise(0).alias("value")) \
        .withColumn("rank", F.row_number().over(ranked))


def audit(docs: DataFrame, top: int = TOP) -> DataFrame:
    terms, groups = counted(read(docs))
    one = source_distances(terms, groups).withColumn("part", F.lit("pair"))
    return one.unionByName(leading_terms(terms, groups, top).withColumn("part", F.lit("term"))) \
        .select(*GROUP, "part", "item", F.col("value").cast("long").alias("value"), F.col("rank").cast("int").alias("rank"))


def op12_source_audit(spark, sf_dir: str) -> DataFrame:
    return audit(common.documents(spark, sf_dir))


OP12_SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS row_id, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
      '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS w
  FROM documents),
o AS (SELECT row_id, lang, source, unnest(w) AS term FROM d),
k AS (SELECT lang, term, count(*) AS cl FROM o GROUP BY lang, term HAVING count(DISTINCT row_id) >= 30),
l AS (SELECT lang, count(*) AS v, CAST(sum(cl) AS HUGEINT) AS nl FROM k GROUP BY lang),
c AS (SELECT o.lang, o.source, o.term, count(*) AS c FROM o JOIN k USING (lang, term) GROUP BY ALL),
g AS (SELECT lang, source, coalesce(l.v, 0) AS v, coalesce(l.nl, 0) AS nl, coalesce(s.n, 0) AS n
      FROM (SELECT DISTINCT lang, source FROM d) LEFT JOIN l USING (lang)
      LEFT JOIN (SELECT lang, source, CAST(sum(c) AS HUGEINT) AS n FROM c GROUP BY ALL) s USING (lang, source)),
f AS (SELECT g.lang, g.source, k.term, coalesce(c.c, 0) AS c,
        1 + (CAST(1000000000 AS HUGEINT) * (coalesce(c.c, 0) + 5)) // (g.n + 5 * g.v) AS p,
        1 + (CAST(1000000000 AS HUGEINT) * (k.cl + 5)) // (g.nl + 5 * g.v) AS q
      FROM g JOIN k USING (lang) LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term),
pv AS (SELECT a.lang, a.source, b.source AS item, coalesce(s.value, 0) AS value
       FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source
       LEFT JOIN (SELECT x.lang, x.source, y.source AS item, sum(abs(x.p - y.p)) AS value
                  FROM f x JOIN f y ON x.lang = y.lang AND x.term = y.term AND x.source <> y.source
                  GROUP BY ALL) s ON s.lang = a.lang AND s.source = a.source AND s.item = b.source),
r AS (SELECT lang, source, 'pair' AS part, item, value,
        row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item) AS rank FROM pv
      UNION ALL
      SELECT lang, source, 'term', term, p - q,
        row_number() OVER (PARTITION BY lang, source ORDER BY p - q DESC, term) FROM f WHERE c > 0 AND p > q)
SELECT lang, source, part, item, CAST(value AS BIGINT) AS value, CAST(rank AS INTEGER) AS rank
FROM r WHERE part = 'pair' OR rank <= 50"""
