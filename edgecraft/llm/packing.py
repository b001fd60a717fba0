"""Conflict-constrained best-fit packing.

Documents become items of ``size`` tokens (those of the tokenizer of op3); texts longer than a bin are cut into
full bins and a rest, so every token is packed.  Spark deals the items by a
salted hash into shards of about ``SHARD_ITEMS`` items (their number follows
the counted rows), and each shard is packed on its own by best fit, largest
items first:

* open bins are held in residual order; the successor search starts at the
  smallest residual that takes the item and goes on to larger ones until a bin
  is compatible, which makes it the tightest compatible bin;
* each bin carries bitmaps of its duplicate clusters and, one plane for each
  repetition, of its sources: a bin takes no two pieces of one cluster and at
  most ``per_source`` of one source.  Clusters and sources are numbered within
  the shard, so the bitmaps are exact.

A cluster holds equal shingle sets (five words) and sets that share a band of
minimal hash values (``BANDS``, ``ROWS``), which finds near copies from a likeness
of 0.8 on; sizes, digests and bands come from one pass over the texts.
(:func:`near_clusters` takes the clusters from the exact join instead.)

Bins hold at most ``capacity`` tokens and are closed when full.  Only ids,
sizes and band keys are shuffled, not the texts.  Salting by content spreads a hot source
and the copies of one text over all shards.

Edge cases: null and empty texts have size 0 and go to the bin that is
tightest for them like any other item; null sources count as one source; rows
with a null id are packed too; repeated rows are items of their own, in one
cluster; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import bisect
import uuid
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from edgecraft.llm import bpe_lexicon, common, token_cache
from edgecraft.llm.components import components
from edgecraft.llm.pretokens import distinct_spans, mix
from edgecraft.llm.shingle_join import Rule, digests, near_duplicates, shingle_sets
from edgecraft.session import checkpoint_dir

SHARD_ITEMS = 2000
CAPACITY, PER_SOURCE = 2048, 4
NEAR = Rule(words=5, percent=80)
#: Minimal hash values of a shingle set: sets of likeness s share a band with
#: probability 1 - (1 - s ** ROWS) ** BANDS (0.8: 0.97, 0.9: 1.00, 0.5: 0.08).
BANDS, ROWS, TILE, STRIP = 20, 8, 1 << 11, 16
#: Slots of the table of known word sizes of a Python process (12 bytes each).
KNOWN = 1 << 20
#: Text bytes whose sizes are counted, and whose sketches are made, at once.
SLICE = 1 << 19
_ODD = (mix(np.arange(1, BANDS * ROWS + 1, dtype=np.uint64)) >> np.uint64(32)).astype(np.uint32) | np.uint32(1)


def best_fit(items: list[tuple[int, int, int]], capacity: int, per_source: int) -> list[int]:
    """Bin of each (size, cluster, source) item, given largest first; clusters
    and sources are small integers (bit numbers)."""
    residuals: list[tuple[int, int]] = []            # (residual, bin), ascending
    clusters: list[int] = []
    planes: list[list[int]] = []                     # planes[bin][j]: sources seen more than j times
    out = []
    for size, cluster, source in items:
        c_bit, s_bit = 1 << cluster, 1 << source
        at = bisect.bisect_left(residuals, (size, -1))
        while at < len(residuals):
            b = residuals[at][1]
            if not clusters[b] & c_bit and not planes[b][per_source - 1] & s_bit:
                break
            at += 1
        if at < len(residuals):
            left = residuals.pop(at)[0] - size
        else:
            b, left = len(clusters), capacity - size
            clusters.append(0)
            planes.append([0] * per_source)
        clusters[b] |= c_bit
        for j in range(per_source):
            if not planes[b][j] & s_bit:
                planes[b][j] |= s_bit
                break
        if left > 0:
            bisect.insort(residuals, (left, b))
        out.append(b)
    return out


def pack(items: DataFrame, keep: list[str], capacity: int = CAPACITY, per_source: int = PER_SOURCE,
         shard_items: int = SHARD_ITEMS) -> DataFrame:
    """``items``: ``keep``, ``size`` (long), ``cluster`` (string) and ``source``.
    Returns ``keep``, ``piece``, ``tokens``, ``bin`` ("shard-number"): one row
    for each piece."""
    shards = max(1, -(-items.count() // shard_items))
    cut = F.expr(f"transform(sequence(0, greatest(0, int(ceil(size / {capacity}D)) - 1)), "
                 f"i -> struct(i as piece, least({capacity}L, size - i * {capacity}L) as tokens))")
    pieces = (items.select(*keep, "cluster", "source", F.explode(cut).alias("p"))
              .select(*keep, "cluster", "source", "p.piece", "p.tokens"))
    full = F.col("tokens") == capacity
    shard = F.pmod(F.xxhash64(*keep, "cluster", "piece"), F.lit(shards)).cast("int")
    dealt = pieces.withColumn("shard", shard)
    # as text on the way through pandas, which has no null in its integers
    dealt = dealt.select(*(F.col(c).cast("string").alias(c) for c in keep), "cluster", "source", "piece", "tokens", "shard")
    fields = ", ".join(f"`{c}` string" for c in keep)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["tokens", "cluster", "piece", *keep], ascending=False, kind="stable", na_position="last")
        cluster, _ = pd.factorize(pdf["cluster"], use_na_sentinel=False)
        source, _ = pd.factorize(pdf["source"], use_na_sentinel=False)
        bins = best_fit(list(zip(pdf["tokens"].tolist(), cluster.tolist(), source.tolist())), capacity, per_source)
        out = pdf[[*keep, "piece", "tokens"]].copy()
        out["bin"] = [f"{s}-{b}" for s, b in zip(pdf["shard"], bins)]
        return out

    packed = dealt.where(~full).groupBy("shard").applyInPandas(run, f"{fields}, piece int, tokens long, bin string")
    # a piece as large as a bin fills one alone: nothing to search
    alone = dealt.where(full).select(
        *keep, "piece", "tokens",
        F.concat(F.lit("full-"), F.sha2(F.to_json(F.struct(*keep, "cluster", "piece")).cast("binary"), 256),
                 F.lit("-"), F.monotonically_increasing_id()).alias("bin"))
    return packed.unionByName(alone).select(*(F.col(c).cast(items.schema[c].dataType).alias(c) for c in keep),
                                            "piece", "tokens", "bin")


def document_items(docs: DataFrame, size=None) -> DataFrame:
    """Items of documents: size in words (or the given column), cluster of
    equal lower-cased word sequences."""
    text = F.coalesce("text", F.lit(""))
    flat = F.trim(F.regexp_replace(F.lower(text), r"\s+", " "))
    words = F.when(flat == "", 0).otherwise(F.size(F.split(flat, " "))).cast("long") if size is None else size
    return docs.select("doc_id", "source", words.alias("size"), F.sha2(flat.cast("binary"), 256).alias("cluster"))


def token_items(docs: DataFrame) -> DataFrame:
    """Items of documents: size in tokens of the 50k byte-level vocabulary, cluster
    as in ``document_items``.  Rows are counted by digest, so each keeps its own."""
    import public_tokenizers
    cache = f"{checkpoint_dir(docs.sparkSession).rstrip('/')}/token-cache-{uuid.uuid4().hex}"
    keyed = document_items(docs, F.col("text"))                  # the text in place of its size
    return (token_cache.count_tokens(keyed.withColumnRenamed("size", "text"),
                                     public_tokenizers.path("byte_bpe_50k.json"), cache, ["doc_id", "source", "cluster"],
                                     slice_bytes=1 << 21)
            .select("doc_id", "source", F.col("n_tokens").alias("size"), "cluster"))


def near_clusters(items: DataFrame, docs: DataFrame) -> DataFrame:
    """``items`` of ``docs`` with near copies in one cluster: components of near
    duplicates, joined where two of them hold equal texts (empty ones too).  Rows
    without an id are in the component that has their text, if any."""
    near = common.checkpoint(near_duplicates(docs, NEAR).where("doc_id is not null")
                             .groupBy("doc_id").agg(F.min("component_id").alias("component")))
    rows = items.withColumn("id_", F.col("doc_id").cast("long"))
    known = rows.where("id_ is not null")
    held = near.withColumnRenamed("doc_id", "id_")
    pairs = common.checkpoint(known.join(held, "id_").select("cluster", "component").distinct())
    first = pairs.groupBy("cluster").agg(F.min("component").alias("b"))
    label = components(pairs.join(first, "cluster").where("component <> b").select(F.col("component").alias("a"), "b"))
    label = common.broadcast_if_small(label, label.count(), 16)
    root = F.concat(F.lit("near-"), F.coalesce("label", "component").cast("string"))
    of_id = held.join(label, F.col("component") == F.col("node"), "left").select("id_", root.alias("root"))
    of_text = first.withColumnRenamed("b", "component").join(label, F.col("component") == F.col("node"), "left") \
        .select("cluster", root.alias("root"))
    columns = [c for c in items.columns if c != "cluster"]
    return known.join(of_id, "id_").select(*columns, F.col("root").alias("cluster")).unionByName(
        rows.where("id_ is null").join(of_text, "cluster", "left")
        .select(*columns, F.coalesce("root", "cluster").alias("cluster")))


class TokenSizes:
    """Token counts of texts, equal to the tokenizer's: pre-tokens are looked up by
    their hash in a table of fixed size, the others merged exactly, all at once."""

    def __init__(self, path: str):
        self.splitter, self.merges = bpe_lexicon.splitter_of(path), bpe_lexicon.merges_of(path)
        self.key = np.arange(KNOWN, dtype=np.uint64) ^ np.uint64(1)      # belongs to no slot: nothing is known yet
        self.size = np.zeros(KNOWN, np.int32)

    def count(self, texts: list[str]) -> np.ndarray:
        whole, starts, ends, hashes, owner, special = self.splitter.spans(texts)
        slot = (hashes & np.uint64(KNOWN - 1)).astype(np.int64)
        size = self.size[slot]
        new = np.flatnonzero(self.key[slot] != hashes)
        if len(new):
            code, words = distinct_spans(whole, starts[new], ends[new], hashes[new])
            size[new] = self.merges.merge([w.encode("utf-8", "surrogatepass") for w in words])[1][code]
            self.key[slot[new]], self.size[slot[new]] = hashes[new], size[new]
        return (np.bincount(owner, weights=size, minlength=len(texts)).astype(np.int64)
                + np.bincount(special[0], minlength=len(texts)))


@lru_cache(maxsize=2)
def sizes_of(path: str) -> TokenSizes:
    return TokenSizes(path)


def _row_minima(h: np.ndarray) -> np.ndarray:
    """The ``BANDS`` x ``ROWS`` minimal hash values of a shingle set."""
    low = np.full(BANDS * ROWS, 2 ** 32 - 1, np.uint32)
    x = (h >> np.uint64(32)).astype(np.uint32)
    held = np.empty((STRIP, min(len(x), TILE)), np.uint32)
    for t in range(0, len(x), TILE):
        tile = x[None, t:t + TILE]
        for i in range(0, BANDS * ROWS, STRIP):
            product = np.multiply(tile, _ODD[i:i + STRIP, None], out=held[:, :tile.shape[1]])
            np.minimum(low[i:i + STRIP], product.min(axis=1), out=low[i:i + STRIP])
    return low


def _band_keys(low: np.ndarray) -> np.ndarray:
    """Band keys of rows of minimal hash values: each band's mixed into one 64-bit key."""
    key = np.tile(np.arange(1, BANDS + 1, dtype=np.uint64), (len(low), 1))
    for column in np.moveaxis(low.reshape(-1, BANDS, ROWS), 2, 0).astype(np.uint64):
        key = mix(key * np.uint64(0x9E3779B97F4A7C15) + column)
    return key.view(np.int64)


def sketched_items(docs: DataFrame) -> DataFrame:
    """``doc_id``, ``source``, ``size`` (tokens), ``d1`` (digest of the shingle set, 0
    without words) and ``bands`` in one pass over the texts, none of which is
    shuffled."""
    import public_tokenizers
    path = public_tokenizers.path("byte_bpe_50k.json")
    src = docs.select("doc_id", "source", "text")

    def run(batches):
        sizes = sizes_of(path)
        for rb in common.sliced(batches, target=SLICE):
            texts = common.texts_of(rb)
            sets = shingle_sets(texts, NEAR.words)
            some = [h for h in sets if len(h)]
            bands = _band_keys(np.array([_row_minima(h) for h in some], np.uint32).reshape(-1, BANDS * ROWS))
            each = iter(bands)
            yield pa.RecordBatch.from_arrays(
                [rb.column(0), rb.column(1), pa.array(sizes.count(texts)),
                 pa.array([digests(h)[0] for h in sets], pa.int64()),
                 pa.array([next(each) if len(h) else None for h in sets], pa.list_(pa.int64()))],
                names=["doc_id", "source", "size", "d1", "bands"])

    kind = src.schema["doc_id"].dataType.simpleString()
    return src.mapInArrow(run, f"doc_id {kind}, source string, size long, d1 long, bands array<long>")


def banded_clusters(items: DataFrame) -> DataFrame:
    """``items`` of :func:`sketched_items` with ``cluster``: equal shingle sets, and
    sets that share a band key, directly or through others.  Of all sets of a band
    key only links to the smallest digest are made."""
    keys = items.where("bands is not null").select("d1", F.explode("bands").alias("key")).distinct()
    lead = keys.groupBy("key").agg(F.min("d1").alias("a"), F.max("d1").alias("z")).where("a <> z").select("key", "a")
    links = common.checkpoint(keys.join(lead, "key").where("a <> d1").select("a", F.col("d1").alias("b")).distinct())
    label = components(links)
    label = common.broadcast_if_small(label, label.count(), 16)
    return items.join(label, F.col("d1") == F.col("node"), "left").select(
        "doc_id", "source", "size", F.coalesce("label", "d1").cast("string").alias("cluster"))


def packed_documents(docs: DataFrame) -> DataFrame:
    """Documents packed by tokens, near copies apart."""
    with common.sorted_joins(docs.sparkSession):
        items = common.checkpoint(sketched_items(docs))
        return pack(common.checkpoint(banded_clusters(items)), ["doc_id"])


def op8_best_fit_packing(spark, sf_dir: str) -> DataFrame:
    return packed_documents(common.documents(spark, sf_dir).select("doc_id", "text", "source"))
