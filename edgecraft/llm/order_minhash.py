"""Document fingerprints by order MinHash.

Each k-mer of a text is numbered by its occurrence, so repeats stay distinct.
For each of ``SKETCHES`` hash orders the ``PICKS`` minimal (k-mer, occurrence)
pairs are kept in the order of their places in the text and hashed as a tuple.
Two texts agree in a component when they share the same minimal pairs in the
same order, so the share of equal components follows edit distance and not
only the k-mer sets.

Texts shorter than ``K`` are one k-mer; the empty text has a component value
of its own, so equal texts always have equal fingerprints.

The edited text needs the next document: ids are placed into ranges by their
quantiles, neighbours inside a range come from a window over the range, and the
last document of a range takes the first of the next range that has any, from a
table with one row per range.  Texts are shuffled once.

Edge cases: null text is empty; a single document is its own next one; repeated
ids are ordered by text; rows with a null id come last; an empty table gives no
rows; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
from pyspark.ml.feature import Bucketizer
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from edgecraft.llm import common
from edgecraft.llm.pretokens import mix, span_hashes

K, SKETCHES, PICKS = 6, 64, 2
_ODD = (mix(np.arange(1, 257, dtype=np.uint64)) >> np.uint64(32)).astype(np.uint32) | np.uint32(1)
TILE = 1 << 14


def kmer_hashes(text: str, k: int = K) -> np.ndarray:
    """64-bit hash of every k-mer, in text order."""
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    n = len(codes)
    if not n:
        return np.zeros(0, np.uint64)
    starts = np.arange(n - min(k, n) + 1)
    return span_hashes(codes, starts, starts + min(k, n))


def edited_hashes(text: str, h: np.ndarray, following: str, g: np.ndarray, k: int = K):
    """Edited text and its k-mer hashes, from the hashes of the two texts."""
    third = len(text) // 3
    a, b = len(text) - third, min(third, len(following))
    edited = text[:a] + following[:b]
    if a < k or b < k:
        return edited, kmer_hashes(edited, k)
    seam = kmer_hashes(text[a - k + 1:a] + following[:k - 1], k)
    return edited, np.concatenate([h[:a - k + 1], seam, g[:b - k + 1]])


def numbered(h: np.ndarray) -> np.ndarray:
    """Mix the occurrence number of each value into it (32 bits), in place order.

    The packed key only sorts: values come from the whole hashes, so that a k-mer
    has the same one in texts of any length."""
    n = len(h)
    bits = np.uint64(max(int(n - 1).bit_length(), 1))
    low = (np.uint64(1) << bits) - np.uint64(1)
    key = np.sort((h & ~low) | np.arange(n, dtype=np.uint64))       # by upper bits, then place
    place = (key & low).astype(np.int64)
    value = h[place]
    changed = value[1:] != value[:-1]
    if (changed & ((key[1:] ^ key[:-1]) <= low)).any():             # same upper bits, other hash
        place = np.argsort(h, kind="stable")
        value = h[place]
        changed = value[1:] != value[:-1]
    at = np.arange(n)
    first = np.append(True, changed)
    occurrence = at - np.maximum.accumulate(np.where(first, at, 0))
    out = np.empty(n, np.uint32)
    again = np.flatnonzero(occurrence)
    v = (value >> np.uint64(32)).astype(np.uint32) ^ value.astype(np.uint32)
    if len(again):
        v[again] = (mix(value[again] + occurrence[again].astype(np.uint64) * np.uint64(0xD1B54A32D192ED03))
                    >> np.uint64(32)).astype(np.uint32)
    out[place] = v
    return out


def minimal(x: np.ndarray, sketches: int, picks: int, below: int):
    """Row, place and order value of the elements under ``below`` in each order."""
    rows, places, values = [], [], []
    for t in range(0, len(x), TILE):
        order = x[None, t:t + TILE] * _ODD[:sketches, None]
        at = np.flatnonzero(order <= np.uint32(below))
        r = at // order.shape[1]
        rows.append(r)
        places.append(at - r * order.shape[1] + t)
        values.append(order.ravel()[at])
    row, place, value = np.concatenate(rows), np.concatenate(places), np.concatenate(values)
    return row, place, value


def sketch(h: np.ndarray, sketches: int = SKETCHES, picks: int = PICKS) -> np.ndarray:
    """Fingerprint (``sketches`` 32-bit values) from the k-mer hashes of a text."""
    n = len(h)
    if not n:
        return np.zeros(sketches, np.uint32)
    x, picks, top = numbered(h), min(picks, n), 2 ** 32 - 1
    # about 16 elements an order are under the first limit; all of them, if one order has too few
    for below in ((top * 8 * picks // n, top) if n > 16 * picks else (top,)):
        row, place, value = minimal(x, sketches, picks, below)
        if np.bincount(row, minlength=sketches).min() >= picks:
            break
    # places rise within a row, so a stable sort leaves ties by place
    by = np.argsort(row.astype(np.uint64) << np.uint64(32) | value, kind="stable")
    first = np.searchsorted(row[by], np.arange(sketches))
    chosen = np.sort(place[by][first[:, None] + np.arange(picks)], axis=1)      # text order
    out = np.full(sketches, picks, np.uint64)
    for j in range(picks):
        out = mix(out * np.uint64(0x9E3779B97F4A7C15) + x[chosen[:, j]].astype(np.uint64) + np.uint64(1))
    return (out >> np.uint64(32)).astype(np.uint32) | np.uint32(1)


def fingerprint(text: str) -> np.ndarray:
    return sketch(kmer_hashes(text))


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    return float((a == b).mean())


def successors(docs: DataFrame, ranges: int) -> DataFrame:
    """``doc_id``, ``text`` (never null) and ``next_text``: the text of the next
    document by descending id (null ids last, ties by text); after the last
    one the first.  Texts are shuffled once, by id range."""
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    step = [i / ranges for i in range(1, ranges)]
    cuts = sorted(set(rows.approxQuantile("doc_id", step, 0.25 / ranges))) if step else []
    placed = rows.withColumn("id_", F.col("doc_id").cast("double"))
    placed = Bucketizer(splits=[-math.inf, *cuts, math.inf], inputCol="id_", outputCol="b_", handleInvalid="keep") \
        .transform(placed) if cuts else placed.withColumn("b_", F.lit(0.0))
    # larger ids first; rows with a null id are in the range after all others
    rows = placed.select("doc_id", "text", F.when(F.col("doc_id").isNull(), len(cuts) + 1)
                         .otherwise(len(cuts) - F.col("b_")).cast("int").alias("range"))
    inside = rows.withColumn("next_in", F.lead("text").over(
        Window.partitionBy("range").orderBy(F.desc_nulls_last("doc_id"), "text")))
    # one row a range from here on: its first document, and the range that follows
    firsts = common.checkpoint(rows.groupBy("range").agg(F.max("doc_id").alias("first_id")))
    turn = Window.orderBy("range")
    follow = firsts.select(F.coalesce(F.lead("range").over(turn), F.first("range").over(turn)).alias("range"),
                           F.col("range").alias("before"))
    first = firsts.select(F.col("range").alias("range_"), "first_id")
    heads = (rows.join(F.broadcast(first), (F.col("range") == F.col("range_"))
                       & F.col("doc_id").eqNullSafe(F.col("first_id")))
             .groupBy("range").agg(F.min("text").alias("next_head")))
    nexts = heads.join(follow, "range").select(F.col("before").alias("range"), "next_head")
    return inside.join(nexts, "range").select("doc_id", "text", F.coalesce("next_in", "next_head").alias("next_text"))


def compare(pairs: DataFrame) -> DataFrame:
    """Fingerprints and likenesses of ``successors`` rows."""
    def run(batches):
        known, known_hash, known_sketch = None, None, None      # the last next text
        for rb in common.sliced(batches):
            out = {"n_chars": [], "edited": [], "fingerprint": [], "edited_fingerprint": [],
                   "near_edited": [], "near_next": []}
            for text, following in zip(rb.column(1).to_pylist(), rb.column(2).to_pylist()):
                if text == known:
                    h, own = known_hash, known_sketch
                else:
                    h = kmer_hashes(text)
                    own = sketch(h)
                known, known_hash = following, kmer_hashes(following)
                known_sketch = sketch(known_hash)
                edited, e = edited_hashes(text, h, following, known_hash)
                other = sketch(e)
                out["n_chars"].append(len(text))
                out["edited"].append(hashlib.sha256(edited.encode("utf-8", "surrogatepass")).hexdigest())
                out["fingerprint"].append(own.tobytes().hex())
                out["edited_fingerprint"].append(other.tobytes().hex())
                out["near_edited"].append(likeness(own, other))
                out["near_next"].append(likeness(own, known_sketch))
            yield pa.RecordBatch.from_pydict({"doc_id": rb.column(0), **out})

    return pairs.select("doc_id", "text", "next_text").mapInArrow(
        run, f"doc_id {pairs.schema['doc_id'].dataType.simpleString()}, n_chars long, edited string, "
             "fingerprint string, edited_fingerprint string, near_edited double, near_next double")


def op7_order_minhash(spark, sf_dir: str) -> DataFrame:
    docs = common.documents(spark, sf_dir).select("doc_id", "text")
    ranges = 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    return compare(successors(docs, ranges)).withColumnRenamed("edited", "edited_sha256")
