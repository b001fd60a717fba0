"""Toxicity: a linear classifier over binary hashed character n-grams whose
features are scaled by naive Bayes log-count ratios.

1. Class counts of every n-gram bucket over *all* labelled training texts
   (each task sums into two vectors, Spark adds them) give the log-count
   ratio ``r`` of each bucket, smoothed in proportion to the class sizes (an
   unseen bucket has ratio 0) and raised to the power ``POWER`` with its sign
   kept, so that rare chance features weigh little.
2. A logistic regression over ``r * presence``, scaled to unit length per
   text, is fitted by mini-batch gradient descent with momentum on a bounded
   sample: the
   ``FIT_ROWS`` labelled training rows of smallest id hash, up to
   ``FIT_FEATURES`` features in that order (documented bounds; everything
   else covers all rows).
3. The two bucket vectors (``2 ** bits`` each) are broadcast and every whole
   text is scored in numpy batches.

Labels reach the texts by an equi-join; the label side is broadcast only when
its counted size is small.  Rows of one id with different labels count as
toxic.  Edge cases: null and empty texts have no feature and score the
intercept; without a training row of both classes every score is the share of
toxic rows (0 without any).  Null ids are never trained on and not held out.
Extra columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from edgecraft.llm import common
from edgecraft.llm.chargrams import SLICE, gram_counts

ORDERS, BITS = (4, 5, 6), 19
FIT_ROWS, FIT_FEATURES = 8000, 24_000_000
SMOOTH, POWER = 10.0, 2.0
PIECE = 1 << 18              # features of the fit that are worked on at once


@dataclass
class ToxicityModel:
    ratio: np.ndarray         # log-count ratio of each bucket
    weight: np.ndarray        # ratio * learned weight
    bias: float
    orders: tuple[int, ...] = ORDERS
    bits: int = BITS


def class_ratio(train: DataFrame, orders=ORDERS, bits=BITS, parts: int = 64) -> tuple[np.ndarray, np.ndarray]:
    """Log-count ratios over all rows of ``train`` (``text``, ``toxic``), and
    the number of rows of class 0 and 1."""
    size = 1 << bits

    def count(batches):
        task, sums, rows = common.task_id(), np.zeros((2, size), np.int64), np.zeros(2, np.int64)
        for rb in common.sliced(batches, target=SLICE):
            y = rb.column(1).to_numpy(zero_copy_only=False).astype(np.int64)
            doc, bucket, _ = gram_counts(common.texts_of(rb), orders, bits)
            toxic = y[doc] == 1
            sums[1] += np.bincount(bucket[toxic], minlength=size)
            sums[0] += np.bincount(bucket[~toxic], minlength=size)
            rows += np.bincount(y, minlength=2)
        if rows.any():
            step = size // parts
            for p in range(parts):
                cut = sums[:, p * step:(p + 1) * step].ravel()
                yield pa.RecordBatch.from_pydict({
                    "part": pa.array([p], pa.int32()), "task": pa.array([task], pa.int32()),
                    "vec": [common.squeeze(np.append(cut, rows if p == 0 else [0, 0]).astype(np.int64))]})

    vecs = train.select("text", F.col("toxic").cast("int")).mapInArrow(count, "part int, task int, vec binary")
    counts, rows, step = np.zeros((2, size)), np.zeros(2, np.int64), size // parts
    for r in common.sum_blobs(vecs, ["part"]).collect():          # `parts` vectors of fixed length
        v = common.expand(r.vec)
        counts[:, r.part * step:(r.part + 1) * step] = v[:-2].reshape(2, step)
        rows += v[-2:]
    share = rows / max(rows.sum(), 1)
    if not rows.all():
        return np.zeros(size), rows
    add = SMOOTH * share
    r = np.log((counts[1] + add[1]) / (rows[1] + add[1])) - np.log((counts[0] + add[0]) / (rows[0] + add[0]))
    r -= np.log(add[1] / (rows[1] + add[1])) - np.log(add[0] / (rows[0] + add[0]))
    return np.sign(r) * np.abs(r) ** POWER, rows


def _runs(sizes, most: int):
    """(first, number) of runs of rows of at most ``most`` in all, or of one row."""
    first, total, i = 0, 0, -1
    for i, k in enumerate(sizes):
        if i > first and total + k > most:
            yield first, i - first
            first, total = i, 0
        total += k
    if i >= 0:
        yield first, i + 1 - first


def fit_linear(texts_labels, ratio: np.ndarray, orders=ORDERS, bits=BITS, max_features=FIT_FEATURES,
               epochs: int = 16, block: int = 512, rate: float = 2.0, decay: float = 5e-6,
               toxic_weight: float = 3.0):
    """Mini-batch logistic regression over scaled features, gradient descent
    with momentum; toxic rows weigh ``toxic_weight`` times as much.
    ``texts_labels`` yields (texts, labels); returns (weight, bias)."""
    offs, ys, used = [0], [], 0
    b = np.empty(max_features, np.int32)             # touched as far as it is filled
    for texts, labels in texts_labels:
        found = []
        for i, k in _runs(map(len, texts), SLICE):
            doc, bucket, _ = gram_counts(texts[i:i + k], orders, bits)
            found.append((np.bincount(doc, minlength=k), bucket.astype(np.int32)))
        made = sum(len(bucket) for _, bucket in found)
        if used + made > max_features:
            if used:
                break
            b = np.empty(made, np.int32)
        for count, bucket in found:
            b[used:used + len(bucket)] = bucket
            used += len(bucket)
            offs.extend((np.cumsum(count) + offs[-1]).tolist())
        ys.extend(labels)
    y = np.asarray(ys, float)
    n, size = len(y), 1 << bits
    if not n:
        return np.zeros(size), 0.0
    off = np.asarray(offs)
    share = min(max(y.mean(), 1e-3), 1 - 1e-3)
    w, step, bias, bias_step = np.zeros(size), np.zeros(size), float(np.log(share / (1 - share))), 0.0
    starts = np.arange(0, n, block)
    order = np.random.default_rng(7)

    def pieces(s, e):
        """Rows s to e, ``PIECE`` features or a row at a time."""
        for i, k in _runs(np.diff(off[s:e + 1]), PIECE):
            i += s
            yield i, i + k, b[off[i]:off[i + k]], np.repeat(np.arange(k), np.diff(off[i:i + k + 1]))

    norm = np.empty(n)
    for i, j, idx, doc in pieces(0, n):
        norm[i:j] = np.sqrt(np.bincount(doc, weights=ratio[idx] ** 2, minlength=j - i) + 1e-9)
    for _ in range(max(epochs, 640 * block // n // 8)):
        for s in order.permutation(starts):
            e = min(s + block, n)
            z = np.concatenate([np.bincount(doc, weights=ratio[idx] / norm[i:j][doc] * w[idx], minlength=j - i)
                                for i, j, idx, doc in pieces(s, e)]) + bias
            err = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y[s:e]) / ((e - s) * share)
            err *= np.where(y[s:e] == 1, toxic_weight, 1.0)
            g = np.zeros(size)
            for i, j, idx, doc in pieces(s, e):
                np.add.at(g, idx, ratio[idx] / norm[i:j][doc] * err[i - s:j - s][doc])
            g += decay * w
            step = 0.9 * step - rate * g
            w += step
            bias_step = 0.9 * bias_step - 0.1 * rate * err.sum()
            bias += bias_step
    return w, bias


def fit(train: DataFrame, orders=ORDERS, bits=BITS, fit_rows: int = FIT_ROWS) -> ToxicityModel:
    """``train``: columns ``doc_id``, ``text``, ``toxic``."""
    ratio, rows = class_ratio(train, orders, bits)
    size = 1 << bits
    if not rows.all():
        share = rows[1] / max(rows.sum(), 1)
        bias = 30.0 if share == 1 else -30.0
        return ToxicityModel(np.zeros(size), np.zeros(size), bias, orders, bits)
    shared = train.sparkSession.sparkContext.broadcast(ratio.astype(np.float32))
    # hashes below this share hold a little more than the wanted rows; the limit takes the smallest
    share = min(1.0, 1.2 * fit_rows / rows.sum())
    first = (train.select("text", F.col("toxic").cast("int").alias("toxic"),
                          F.pmod(F.xxhash64("doc_id"), F.lit(1 << 40)).alias("_h"), "doc_id")
             .where(F.col("_h") < int(share * (1 << 40)))
             .orderBy("_h", "doc_id").limit(fit_rows).coalesce(1).sortWithinPartitions("_h", "doc_id"))

    def run(batches):
        pairs = ((common.texts_of(rb), rb.column(1).to_pylist()) for rb in common.sliced(batches))
        w, bias = fit_linear(pairs, shared.value.astype(np.float64), orders, bits)
        yield pa.RecordBatch.from_pydict({"w": [w.astype(np.float32).tobytes()], "bias": [float(bias)]})

    got = first.select("text", "toxic").mapInArrow(run, "w binary, bias double").collect()
    w = np.frombuffer(got[0].w, np.float32).astype(np.float64)
    return ToxicityModel(ratio, ratio * w, got[0].bias, orders, bits)


def score_texts(model: ToxicityModel, texts: list[str]) -> np.ndarray:
    doc, bucket, _ = gram_counts(texts, model.orders, model.bits)
    n = len(texts)
    r = model.ratio[bucket]
    norm = np.sqrt(np.bincount(doc, weights=r * r, minlength=n) + 1e-9)
    z = np.bincount(doc, weights=model.weight[bucket], minlength=n) / norm + model.bias
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def score(docs: DataFrame, model: ToxicityModel, keep: list[str]) -> DataFrame:
    """Add ``score`` to the columns ``keep``."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    src = docs.select(*dict.fromkeys([*keep, "text"]))

    def run(batches):
        for rb in common.sliced(batches, target=SLICE):
            s = score_texts(shared.value, common.texts_of(rb))
            yield pa.RecordBatch.from_arrays([*rb.select(keep).columns, pa.array(s, pa.float64())],
                                             names=[*keep, "score"])

    fields = ", ".join(f"`{c}` {src.schema[c].dataType.simpleString()}" for c in keep)
    return src.mapInArrow(run, f"{fields}, score double")


def labelled(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Training rows: documents of folds 1-4 with a label."""
    marks = (labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull())
             .groupBy("doc_id").agg((F.max("toxic") > 0).cast("int").alias("toxic")))
    marks = common.broadcast_if_small(marks, labels.count(), 16)
    return (docs.select("doc_id", "text").where(common.fold(F.col("doc_id")) != 0)
            .join(marks, "doc_id").select("doc_id", "text", "toxic"))


def op2_toxicity(spark, sf_dir: str) -> DataFrame:
    docs = common.documents(spark, sf_dir).select("doc_id", "text")
    model = fit(labelled(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))
    return (score(docs, model, ["doc_id"])
            .select("doc_id", F.coalesce(common.fold(F.col("doc_id")) == 0, F.lit(False)).alias("held_out"),
                    "score", (F.col("score") >= 0.5).cast("int").alias("predicted")))
