"""Language identification: multinomial naive Bayes over hashed character
n-grams.

Counts per language cover every training document: each task sums the hashed
n-grams of its texts into one vector per language, Spark adds the vectors.
The log-probability matrix (languages x buckets, at most ``MAX_MATRIX_MB``) is
broadcast, and each task scores its texts in sparse batches: distinct
(text, bucket, count) triples against the rows of the matrix.

Edge cases: a null or empty text, or one without a letter, is ``und`` with
score 0.  Rows with null ``lang`` or null text do not train.  Without any
training row every text is ``und``.  Equal texts score equally; ties go to the
language first in order.  Extra columns are ignored; a null ``doc_id`` is kept
and counts as held out = false, not trained on.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from edgecraft.llm import common
from edgecraft.llm.chargrams import SLICE, gram_counts

MAX_MATRIX_MB = 512


@dataclass
class LanguageModel:
    langs: list[str]
    log_prob: np.ndarray      # buckets x languages
    log_prior: np.ndarray
    orders: tuple[int, ...]
    bits: int


def fit(train: DataFrame, orders: tuple[int, ...] = (1, 2, 3), bits: int = 16, alpha: float = 0.5,
        parts: int = 16) -> LanguageModel:
    """``train``: columns ``text``, ``lang`` (rows with a null in either are skipped)."""
    size = 1 << bits
    rows = train.select("text", "lang").where(F.col("text").isNotNull() & F.col("lang").isNotNull())

    def count(batches):
        task, sums = common.task_id(), {}

        def flush():
            step = size // parts
            for lang, (v, n) in sums.items():
                for p in range(parts):
                    yield pa.RecordBatch.from_pydict({
                        "lang": [lang], "part": pa.array([p], pa.int32()), "task": pa.array([task], pa.int32()),
                        "vec": [common.squeeze(np.append(v[p * step:(p + 1) * step], n if p == 0 else 0))]})
            sums.clear()

        for rb in common.sliced(batches, target=SLICE):
            texts, langs = common.texts_of(rb), rb.column(1).to_pylist()
            doc, bucket, cnt = gram_counts(texts, orders, bits)
            names, code = np.unique(np.array(langs, dtype=object), return_inverse=True)
            of = code[doc]
            for i, lang in enumerate(names):
                v, n = sums.get(lang) or (np.zeros(size, np.int64), 0)
                mine = of == i
                v += np.bincount(bucket[mine], weights=cnt[mine], minlength=size).astype(np.int64)
                sums[lang] = (v, n + int((code == i).sum()))
            if len(sums) > 64:
                yield from flush()
        yield from flush()

    vecs = rows.mapInArrow(count, "lang string, part int, task int, vec binary")
    model = common.checkpoint(common.sum_blobs(vecs, ["lang", "part"]))
    langs = [r.lang for r in model.select("lang").distinct().orderBy("lang").limit(
        (MAX_MATRIX_MB << 20) // (8 * size) + 1).collect()]
    if len(langs) * size * 8 > MAX_MATRIX_MB << 20:
        raise ValueError("too many languages for the broadcast matrix; lower bits")
    counts, n_docs = np.zeros((size, len(langs))), np.zeros(len(langs))
    at, step = {x: i for i, x in enumerate(langs)}, size // parts
    for r in model.collect():     # languages x parts vectors, bounded above
        v = common.expand(r.vec)
        counts[r.part * step:(r.part + 1) * step, at[r.lang]] = v[:-1]
        n_docs[at[r.lang]] += v[-1]
    log_prob = np.log(counts + alpha) - np.log(counts.sum(0) + alpha * size)
    return LanguageModel(langs, log_prob, np.log(n_docs / max(n_docs.sum(), 1)) if langs else n_docs, orders, bits)


def score_texts(model: LanguageModel, texts: list[str]) -> tuple[list[str], np.ndarray]:
    """Predicted language and its posterior for each text."""
    n, k = len(texts), len(model.langs)
    if not k:
        return ["und"] * n, np.zeros(n)
    doc, bucket, cnt = gram_counts(texts, model.orders, model.bits)
    logp = np.empty((n, k))
    for j in range(k):
        logp[:, j] = np.bincount(doc, weights=cnt * model.log_prob[:, j][bucket], minlength=n) + model.log_prior[j]
    best = logp.argmax(1)
    post = 1.0 / np.exp(logp - logp.max(1, keepdims=True)).sum(1)
    letters = np.array([any(map(str.isalpha, t)) for t in texts], bool)
    return ([model.langs[b] if ok else "und" for b, ok in zip(best, letters)], np.where(letters, post, 0.0))


def predict(docs: DataFrame, model: LanguageModel, keep: list[str]) -> DataFrame:
    """Add ``lang_pred`` and ``score`` to the columns ``keep`` (the text itself
    only if it is named there)."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    cols = list(dict.fromkeys([*keep, "text"]))
    src = docs.select(*cols)

    def run(batches):
        for rb in common.sliced(batches, target=SLICE):
            lang, score = score_texts(shared.value, common.texts_of(rb))
            out = rb.select(keep)
            yield pa.RecordBatch.from_arrays(
                [*out.columns, pa.array(lang, pa.string()), pa.array(score, pa.float64())],
                names=[*keep, "lang_pred", "score"])

    fields = ", ".join(f"`{c}` {src.schema[c].dataType.simpleString()}" for c in keep)
    return src.mapInArrow(run, f"{fields}, lang_pred string, score double")


def op10_language_id(spark, sf_dir: str) -> DataFrame:
    docs = common.documents(spark, sf_dir).select("doc_id", "text", "lang")
    rest = common.fold(F.col("doc_id"))
    model = fit(docs.where(rest != 0))
    return (predict(docs, model, ["doc_id"])
            .select("doc_id", F.coalesce(rest == 0, F.lit(False)).alias("held_out"), "lang_pred", "score"))
