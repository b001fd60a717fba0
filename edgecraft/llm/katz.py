"""Katz backoff language model over words, order 2, trained and evaluated on
whole corpora.

    P(w | h) = d(r) r / c(h)          r = c(h, w) > 0
             = alpha(h) P(w)          otherwise (alpha = 1 for an unseen h)
    P(w)     = d(r) r / N             r = c(w) > 0
             = the mass left          for the unknown word

``d`` are Good-Turing discounts from the counts of counts (r up to ``K``; a
small absolute discount ``DELTA`` above, so that every history leaves mass),
``alpha(h) = (1 - sum d r / c(h)) / (1 - sum P(w))`` over the words seen after
h, which makes every history sum to one over the vocabulary and the unknown
word.  Each text is its words followed by one end token; the first word's
history is the text's begin.

Everything is dealt by Spark into tables of hash buckets whose number follows
the size of the texts; numpy works inside a bucket:

1. *Word table.*  Batches of texts send their distinct words with training
   counts to the word's bucket: N, V, counts of counts, and the words that make
   up more than a ``1 / (4 buckets)`` share (at most ``4 * buckets`` of them).
2. *Bigram table.*  Batches send distinct (word, history) entries with the
   documents they occur in to the word's bucket; entries of the frequent words
   above are spread by history as well.  A bucket thus has c(w) and c(h, w)
   whole, training counts and the tokens to score side by side.  Its first
   reading gives the counts of counts, the second (same shuffle files) scores
   the tokens, sums discounted mass and P(w) by history, and passes on the
   tokens that must back off.
3. *Backoff table*, by history: alpha(h) for the tokens that back off.
4. Partial sums meet by batch.

Words are told apart by 64-bit hashes, histories within the model by 48 bits.

Edge cases: null and empty texts are one end token; rows with a null id are
scored, not trained on, not held out; repeated rows count and stay; without a
training text every score and base score is 0; an empty table gives no rows;
extra columns are ignored.
"""

from __future__ import annotations

import math
import struct
from collections import defaultdict

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from edgecraft.llm import common
from edgecraft.llm.pretokens import mix
from edgecraft.llm.shingle_join import word_hashes

K, DELTA = 5, 0.05
BATCH_BYTES = 6 << 20
BUCKET_BYTES = 10 << 20
END, BEGIN = np.uint64(0x1F83D9ABFB41BD6B), np.uint64(0x5BE0CD19137E2179)
H_MASK = np.uint64((1 << 48) - 1)


# -- packed arrays ---------------------------------------------------------------

def pack(*arrays: np.ndarray) -> bytes:
    raw = b"".join(a.tobytes() for a in arrays)
    head = struct.pack(f"<{len(arrays)}q", *(len(a) for a in arrays))
    return struct.pack("<q", len(raw)) + head + pa.compress(raw, codec="zstd", asbytes=True)


def unpack(blob: bytes, *kinds: str) -> list[np.ndarray]:
    size = struct.unpack_from("<q", blob)[0]
    lens = struct.unpack_from(f"<{len(kinds)}q", blob, 8)
    raw = pa.decompress(blob[8 + 8 * len(kinds):], decompressed_size=size, codec="zstd", asbytes=True)
    out, at = [], 0
    for n, kind in zip(lens, kinds):
        out.append(np.frombuffer(raw, kind, n, at))
        at += n * np.dtype(kind).itemsize
    return out


def cut48(h: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(h.view(np.uint8).reshape(-1, 8)[:, :6]).ravel()


def join48(b: np.ndarray) -> np.ndarray:
    out = np.zeros((len(b) // 6, 8), np.uint8)
    out[:, :6] = b.reshape(-1, 6)
    return out.view(np.uint64).ravel()


def bucket_of(x: np.ndarray, buckets: int) -> np.ndarray:
    return (mix(x ^ np.uint64(0x94D049BB133111EB)) % np.uint64(buckets)).astype(np.int64)


# -- discounts -------------------------------------------------------------------

def discounts(n: np.ndarray) -> tuple[np.ndarray, float]:
    """``n[r]`` = types seen r times (r up to K + 1).  Returns d[0..k] for
    r <= k, and the absolute discount above.  Good-Turing for the largest k up
    to K where all discounts lie in (0, 1), else 0.5 absolute."""
    for k in range(K, 0, -1):
        if (n[1:k + 2] <= 0).any():
            continue
        a = (k + 1) * n[k + 1] / n[1]
        if a >= 1:
            continue
        r = np.arange(1, k + 1)
        d = ((r + 1) * n[r + 1] / (r * n[r]) - a) / (1 - a)
        if (d > 0).all() and (d < 1).all():
            return np.append(0.0, d), DELTA
    return np.zeros(1), 0.5


class Discount:
    def __init__(self, n: np.ndarray):
        self.low, self.delta = discounts(n)

    def counts(self, r: np.ndarray) -> np.ndarray:
        """Discounted counts d(r) r (0 for r = 0)."""
        out = np.maximum(r - self.delta, 0.0)
        small = r < len(self.low)
        out[small] = (self.low * np.arange(len(self.low)))[r[small]]
        return out

    def left(self, n: np.ndarray, types: int) -> float:
        """Total count taken off ``types`` types, ``n`` as in :func:`discounts`."""
        k = len(self.low) - 1
        r = np.arange(1, k + 1)
        return float((n[r] * r * (1 - self.low[r])).sum() + self.delta * (types - n[r].sum()))


# -- batches of texts ------------------------------------------------------------

def batches_of(batches, target: int = BATCH_BYTES):
    """(batch number, ids, train flags, words, owner): texts gathered to about
    ``target`` bytes; words with one end token a text."""
    ids, train, words, sizes, held, number = [], [], [], [], 0, 0

    def out():
        w, n = np.concatenate(words), np.concatenate(sizes)
        return number, ids, np.array(train, bool), w, n

    for rb in common.sliced(batches):
        texts = common.texts_of(rb)
        w, n = word_hashes(texts)
        at = np.cumsum(n)
        words.append(np.insert(w, at, END))
        sizes.append(n + 1)
        ids += rb.column(0).to_pylist()
        train += rb.column(2).to_pylist()
        held += sum(map(len, texts))
        if held >= target:
            yield out()
            ids, train, words, sizes, held, number = [], [], [], [], 0, number + 1
    if ids:
        yield out()


def by_bucket(bucket: np.ndarray):
    """(bucket, positions) in bucket order."""
    order = np.argsort(bucket, kind="stable")
    edge = np.flatnonzero(np.append(True, np.diff(bucket[order]) != 0)) if len(order) else []
    for i, s in enumerate(edge):
        e = edge[i + 1] if i + 1 < len(edge) else len(order)
        yield int(bucket[order[s]]), order[s:e]


def word_table(src: DataFrame, buckets: int) -> DataFrame:
    """Rows (``kind``, ``x``, ``n``): tokens, types, counts of counts r, and the
    frequent words of each bucket."""
    def send(batches):
        for _, _, train, w, n in batches_of(batches):
            mine = w[np.repeat(train, n)]
            code, word = pd.factorize(mine)
            count = np.bincount(code, minlength=len(word))
            for b, at in by_bucket(bucket_of(word, buckets)):
                yield pa.RecordBatch.from_pydict({"bucket": pa.array([b], pa.int32()),
                                                  "blob": [pack(word[at], count[at].astype(np.uint32))]})

    def merge(pdf: pd.DataFrame) -> pd.DataFrame:
        parts = [unpack(b, "<u8", "<u4") for b in pdf["blob"]]
        code, word = pd.factorize(np.concatenate([p[0] for p in parts]))
        count = np.bincount(code, weights=np.concatenate([p[1] for p in parts])).astype(np.int64)
        rows = [("tokens", 0, int(count.sum())), ("types", 0, len(word))]
        rows += [("r", r, int((count == r).sum())) for r in range(1, K + 2)]
        often = np.flatnonzero(count >= count.sum() / (4 * buckets))
        rows += [("word", int(x), int(c)) for x, c in zip(word[often].astype(np.int64), count[often])]
        return pd.DataFrame(rows, columns=["kind", "x", "n"])

    return src.mapInArrow(send, "bucket int, blob binary").groupBy("bucket").applyInPandas(
        merge, "kind string, x long, n long")


def send_bigrams(buckets: int, often: np.ndarray):
    """RDD records (bucket, (batch, blob)) of a partition; ``often``: sorted
    frequent words."""
    def run(part, batches):
        for number, ids, train, w, n in batches_of(batches):
            batch = (part << 24) | number
            h = np.empty_like(w)
            h[1:] = w[:-1]
            h[np.cumsum(n) - n] = BEGIN
            h &= H_MASK
            owner = np.repeat(np.arange(len(n), dtype=np.uint32), n)
            bits = np.packbits(train)
            yield batch % buckets, ("ids", batch, pack(
                np.array([i is None for i in ids], np.uint8), np.array([i or 0 for i in ids], np.int64),
                n.astype(np.int64), train.astype(np.uint8)))
            code, pair = pd.factorize(w ^ mix(h))
            place = np.empty(len(pair), np.int64)
            place[code[::-1]] = np.arange(len(code))[::-1]
            pw, ph = w[place], h[place]
            spread = often[np.minimum(np.searchsorted(often, pw), len(often) - 1)] == pw if len(often) else \
                np.zeros(len(pw), bool)
            bucket = bucket_of(np.where(spread, pair, pw), buckets)
            events = np.argsort(code, kind="stable")              # events by entry
            many = np.bincount(code, minlength=len(pair))
            start = np.cumsum(many) - many
            for b, at in by_bucket(bucket):
                at = at[np.argsort(pw[at], kind="stable")]        # entries by word
                first = np.flatnonzero(np.append(True, np.diff(pw[at]) != 0))
                m = many[at]
                ev = np.repeat(start[at] - (np.cumsum(m) - m), m) + np.arange(m.sum())
                doc = owner[events[ev]]
                yield b, ("big", batch, pack(
                    pw[at][first], np.diff(np.append(first, len(at))).astype(np.uint32), cut48(ph[at]),
                    m.astype(np.uint32), doc.astype(np.uint16) if len(n) <= 1 << 16 else doc.astype(np.uint32),
                    bits, np.array([len(n)], np.int64)))
    return run


class Bucket:
    """The bigram table of one bucket, merged over all batches."""

    def __init__(self, blobs: list[tuple[int, bytes]], frequent: dict[int, int]):
        w, h, many, doc, train, batch = [], [], [], [], [], []
        self.batches, self.docs = [], []
        for i, (number, blob) in enumerate(blobs):
            lens = struct.unpack_from("<7q", blob, 8)
            size = struct.unpack_from("<q", blob)[0]
            wide = (size - lens[0] * 8 - lens[1] * 4 - lens[2] - lens[3] * 4 - lens[5] - 8) // max(lens[4], 1)
            pw, run, ph, m, d, bits, n = unpack(blob, "<u8", "<u4", "u1", "<u4", "<u2" if wide == 2 else "<u4", "u1", "<i8")
            w.append(np.repeat(pw, run))
            h.append(join48(ph))
            many.append(m)
            doc.append(d.astype(np.uint32))
            train.append(np.unpackbits(bits, count=int(n[0])).astype(bool)[d])
            batch.append(np.full(len(m), i, np.int32))
            self.batches.append(number)
            self.docs.append(int(n[0]))
        w, h, many = np.concatenate(w), np.concatenate(h), np.concatenate(many).astype(np.int64)
        self.doc, train, entry_batch = np.concatenate(doc), np.concatenate(train), np.concatenate(batch)
        entry, pair = pd.factorize(w ^ mix(h))
        entry = entry.astype(np.int32)
        place = np.empty(len(pair), np.int64)
        place[entry] = np.arange(len(entry))
        self.w, self.h = w[place], h[place]                       # by distinct pair
        del w, h, place
        self.pair = np.repeat(entry, many)                        # pair of each event
        self.r = np.bincount(self.pair[train], minlength=len(pair))
        self.batch = np.repeat(entry_batch, many)
        del entry, many, train, pair, entry_batch
        code, word = pd.factorize(self.w)
        count = np.bincount(code, weights=self.r, minlength=len(word)).astype(np.int64)
        if frequent:
            known = [frequent.get(x) for x in word.tolist()]
            count = np.array([c if k is None else k for c, k in zip(count.tolist(), known)], np.int64)
        self.c = count[code]                                      # c(w) of each pair

    def count_of_counts(self) -> np.ndarray:
        return np.bincount(np.minimum(self.r, K + 2), minlength=K + 3)


def gather(records, kind: str):
    """Records of one kind by bucket; the partition holds few buckets."""
    out = defaultdict(list)
    for b, (k, number, blob) in records:
        if k == kind:
            out[b].append((number, blob))
    return out


def table_counts(buckets: int, frequent: dict[int, int]):
    def run(records):
        n = np.zeros(K + 3, np.int64)
        for blobs in gather(records, "big").values():
            n += Bucket(blobs, frequent).count_of_counts()
        yield n
    return run


def score_bucket(buckets: int, frequent: dict[int, int], model: dict):
    """Records (key, (kind, batch, blob)) for the backoff table and the sums."""
    one, two, n_tokens, types, unknown = (model[k] for k in ("one", "two", "tokens", "types", "unknown"))

    def run(records):
        held = defaultdict(list)
        for b, (kind, number, blob) in records:
            if kind == "ids":
                yield b, (kind, number, blob)
            else:
                held[b].append((number, blob))
        for b in list(held):
            t = Bucket(held.pop(b), frequent)
            c = t.c.astype(float)
            p1 = np.where(t.c > 0, one.counts(t.c) / max(n_tokens, 1), unknown)
            mass = two.counts(t.r)
            with np.errstate(divide="ignore"):
                value = np.where(t.r > 0, np.log10(mass), np.log10(p1))
                value -= np.where((t.c > 0) & (t.w != END), np.log10(c), 0.0)     # the word as the next history
            base = np.log10((c + 0.5) / (n_tokens + 0.5 * (types + 1)))
            edge = np.searchsorted(t.batch, np.arange(len(t.batches) + 1))
            for i, number in enumerate(t.batches):
                s = slice(edge[i], edge[i + 1])
                d, p, n = t.doc[s], t.pair[s], t.docs[i]
                yield number % buckets, ("sum", number, pack(
                    np.bincount(d, weights=value[p], minlength=n), np.bincount(d, weights=base[p], minlength=n),
                    np.bincount(d, weights=t.c[p] > 0, minlength=n).astype(np.uint32)))
            seen = t.r > 0
            code, hist = pd.factorize(t.h[seen])
            m, q, k = (np.bincount(code, weights=x[seen], minlength=len(hist)) for x in (mass, p1, t.r))
            for g, at in by_bucket(bucket_of(hist, buckets)):
                yield g, ("mass", 0, pack(cut48(hist[at]), m[at], q[at], k[at].astype(np.uint32)))
            back = np.flatnonzero(t.r[t.pair] == 0)
            hb = t.h[t.pair[back]]
            number = np.array(t.batches, np.int64)
            for g, at in by_bucket(bucket_of(hb, buckets)):
                e = back[at]
                yield g, ("back", 0, pack(cut48(hb[at]), number[t.batch[e]], t.doc[e]))
    return run


def back_off():
    """Resolve alpha for the tokens that back off; add up the sums by batch."""
    def run(records):
        mass, back, sums, ids = [], [], {}, []
        for b, (kind, number, blob) in records:
            if kind == "mass":
                mass.append(unpack(blob, "u1", "<f8", "<f8", "<u4"))
            elif kind == "back":
                back.append(unpack(blob, "u1", "<i8", "<u4"))
            elif kind == "ids":
                ids.append((number, blob))
            else:
                got = [x.astype(np.float64) for x in unpack(blob, "<f8", "<f8", "<u4")]
                old = sums.get(number)
                sums[number] = got if old is None else [x + y for x, y in zip(old, got)]
        for number, blob in ids:
            yield number, ("ids", blob)
        for number, (a, b, c) in sums.items():
            at = np.arange(len(a), dtype=np.uint32)
            yield number, ("sum", pack(at, a, b, c))
        if back:
            bh = join48(np.concatenate([x[0] for x in back]))
            number, doc = np.concatenate([x[1] for x in back]), np.concatenate([x[2] for x in back])
            add = np.zeros(len(bh))
            if mass:
                code, hist = pd.factorize(join48(np.concatenate([x[0] for x in mass])))
                m, q, c = (np.bincount(code, weights=np.concatenate([x[j] for x in mass])) for j in (1, 2, 3))
                alpha = (1 - m / c) / (1 - q)
                where = pd.Index(hist).get_indexer(bh)
                add = np.where(where >= 0, np.log10(alpha * c)[where], 0.0)
            for i, at in by_bucket(number):
                d, pos = pd.factorize(doc[at])
                total = np.bincount(d, weights=add[at])
                zero = np.zeros(len(pos))
                yield i, ("sum", pack(pos.astype(np.uint32), total, zero, zero))
    return run


def finish(model: dict):
    def run(records):
        ids, sums = {}, defaultdict(list)
        for number, (kind, blob) in records:
            if kind == "ids":
                ids[number] = unpack(blob, "u1", "<i8", "<i8", "u1")
            else:
                sums[number].append(unpack(blob, "<u4", "<f8", "<f8", "<f8"))
        begin = math.log10(model["train_docs"]) if model["train_docs"] else 0.0
        for number, (null, doc_id, n, train) in ids.items():
            out = np.zeros((3, len(n)))
            for at, *values in sums[number]:
                for row, v in zip(out, values):
                    row[at] += v                                  # places are distinct within a record
            score = out[0] - begin if model["tokens"] else np.zeros(len(n))
            base = out[1] if model["tokens"] else np.zeros(len(n))
            for i in range(len(n)):
                yield (None if null[i] else int(doc_id[i]), bool(train[i]), int(n[i]), int(out[2][i]),
                       int(model["tokens"]), float(base[i]), float(score[i]))
    return run


def score_corpus(docs: DataFrame, train, buckets: int | None = None) -> DataFrame:
    """Train on the rows of ``docs`` (``doc_id``, ``text``) where the boolean
    column ``train`` holds, and score all rows.  Returns ``doc_id``, ``train``,
    ``n_tokens``, ``n_known``, ``train_tokens``, ``base_score``, ``score``."""
    spark = docs.sparkSession
    src = docs.select(F.col("doc_id").cast("long"), "text", F.coalesce(train, F.lit(False)).alias("train"))
    if buckets is None:
        total = src.agg(F.sum(F.octet_length("text"))).first()[0] or 0
        buckets = max(24, -(-total // BUCKET_BYTES))
    words = common.checkpoint(word_table(src, buckets))
    sums = {(r.kind, r.x): r.n for r in words.where("kind <> 'word'").groupBy("kind", "x").agg(F.sum("n").alias("n")).collect()}
    tokens, types = sums.get(("tokens", 0), 0), sums.get(("types", 0), 0)
    often = {r.x & (2 ** 64 - 1): r.n for r in words.where((F.col("kind") == "word") & (F.col("n") >= tokens / (4 * buckets)))
             .collect()}                                          # at most 4 * buckets words
    n1 = np.array([0] + [sums.get(("r", r), 0) for r in range(1, K + 2)], float)
    one = Discount(n1)
    model = {"one": one, "tokens": tokens, "types": types,
             "unknown": one.left(n1, types) / tokens if tokens else 1.0,
             "train_docs": often.get(int(END)) or 0}
    if tokens and not model["train_docs"]:
        model["train_docs"] = src.where("train").count()
    frequent = spark.sparkContext.broadcast(often)
    order = np.sort(np.array(list(often), np.uint64))
    blobs = src.mapInArrow(arrow_records(buckets, order), "bucket int, kind string, batch long, blob binary")
    deal = (blobs.rdd.map(lambda r: (r.bucket, (r.kind, r.batch, bytes(r.blob))))
            .partitionBy(buckets, lambda b: b))                   # one shuffle, read twice
    n2 = deal.mapPartitions(lambda it: table_counts(buckets, frequent.value)(it)).fold(
        np.zeros(K + 3, np.int64), lambda a, b: a + b)
    model["two"] = Discount(n2[:K + 2].astype(float))
    shared = spark.sparkContext.broadcast(model)
    second = deal.mapPartitions(lambda it: score_bucket(buckets, frequent.value, shared.value)(it)).partitionBy(
        buckets, lambda b: b)
    third = second.mapPartitions(back_off()).partitionBy(buckets, lambda b: b % buckets)
    rows = third.mapPartitions(lambda it: finish(shared.value)(it))
    return spark.createDataFrame(rows, "doc_id long, train boolean, n_tokens long, n_known long, train_tokens long, "
                                       "base_score double, score double")


def arrow_records(buckets: int, often: np.ndarray):
    def run(batches):
        for b, (kind, number, blob) in send_bigrams(buckets, often)(common.task_id(), batches):
            yield pa.RecordBatch.from_arrays(
                [pa.array([b], pa.int32()), pa.array([kind]), pa.array([number], pa.int64()), pa.array([blob], pa.binary())],
                names=["bucket", "kind", "batch", "blob"])
    return run


def op9_katz_backoff(spark, sf_dir: str) -> DataFrame:
    docs = common.documents(spark, sf_dir).select("doc_id", "text")
    out = score_corpus(docs, common.fold(F.col("doc_id")) != 1)
    held_out = F.coalesce(common.fold(F.col("doc_id")) == 1, F.lit(False))
    return out.select("doc_id", held_out.alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")
