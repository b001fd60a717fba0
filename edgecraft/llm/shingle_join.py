"""Set-similarity self-join on word shingles with token-combination prefixes.

A document's set holds its distinct shingles (64-bit hashes).  Two sets link
when ``100 * intersection >= percent * union``; the result is the components
of the links.

1. One pass hashes the sets: size, a 128-bit digest of the set, and the number
   of documents per *token class* (``2 ** CLASS_BITS`` hash classes of
   shingles, added up over all documents), and a parity bitmap of about one bit
   a shingle.  Equal sets become one class of copies.
2. The class counts, a table of fixed length, order all shingles, rare classes
   first.  Linked sets share a shingle in their prefixes of
   ``n - ceil(percent * n / 100) + 1`` shingles, and two in prefixes longer by
   one.  A shingle of a rare class is indexed alone.  Shingles of frequent
   classes are indexed as combinations of two from the extended prefix, which
   separates sets that share only some common passage.  Sets of more than
   ``COMBINE`` shingles index them alone instead, and sets that could link to
   such a set index both, so no link is lost at the border.
3. Within an index key no pairs are listed.  Every set of a key meets the
   key's leader (its smallest digest), by bitmaps, and the likeliest leader of
   each set is verified: linear in the index.  Components are formed, and only
   keys that still hold several go on.
4. Keys of one leader form a group.  Its sets are compared by bitmaps in
   blocks of bounded size, block against block, in numpy: differing bits are at
   most the size of the symmetric difference.  Pairs of one component, and pairs
   that sizes, positions in the global order or bitmaps rule out, leave no row.
   In rounds each set gives its likeliest partners only, few at first, which are
   verified exactly on the sets and merge components; a set with no more
   candidates than it gave is finished, and pairs of a finished set need no
   later round.  So rows grow with the sets, and with the pairs that the bitmaps
   allow between different components, but not with the square of a group.

Edge cases: null and empty texts, and texts without words, have no shingle and
link with nothing; a text of fewer words than a shingle is one shingle; rows
with a null id stay alone with a null component; rows of one id belong
together; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from edgecraft.llm import common
from edgecraft.llm.components import components
from edgecraft.llm.pretokens import mix, span_hashes

CLASS_BITS = 21
COMBINE = 256
FREQUENT = 4.0               # times the mean count of a class
BLOCK_SHINGLES = 1_000_000   # verified at once
GROUP_BLOCK = 2048           # sets of a group in a block
FOLDED = 128                 # bytes of a bitmap inside a group, at most
PARTNERS = (1, 8, 64, 512)   # candidates of a set in each round; after that all
_LOW = np.uint64((1 << (64 - CLASS_BITS)) - 1)
_SHIFT = np.uint64(64 - CLASS_BITS)
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 32


@dataclass(frozen=True)
class Rule:
    words: int               # words in a shingle
    percent: int             # least Jaccard similarity

    def needed(self, n):
        """Least overlap of a set of size n with a set it links to."""
        return -(-self.percent * n // 100)

    @property
    def smallest(self) -> int:
        """Sets below this size link only to equal sets."""
        return -(-self.percent // (100 - self.percent))


def word_hashes(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of all texts and the number of words of each."""
    data = [t.encode("utf-8", "surrogatepass") for t in texts]
    raw = _LOWER[np.frombuffer(b"\n".join(data) + b"\n", np.uint8)]
    off = np.zeros(len(data) + 1, np.int64)
    np.cumsum([len(d) + 1 for d in data], out=off[1:])
    gap = _SPACE[raw]
    before = np.append(True, gap[:-1])
    starts = np.flatnonzero(before & ~gap)
    ends = np.flatnonzero(gap & ~before)
    return span_hashes(raw, starts, ends), np.diff(np.searchsorted(starts, off))


def shingle_sets(texts: list[str], words: int) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each text."""
    w, n = word_hashes(texts)
    s = w.copy()
    for j in range(1, min(words, len(w))):
        s[:len(w) - j] = mix(s[:len(w) - j] * np.uint64(0x9E3779B97F4A7C15) + w[j:])
    out, end = [], np.cumsum(n).tolist()
    for e, k in zip(end, n.tolist()):
        if k >= words:
            h = np.sort(s[e - k:e - words + 1])
            out.append(h[np.append(True, h[1:] != h[:-1])] if len(h) > 1 else h)
        elif k:
            h = np.full(1, k, np.uint64)
            for x in w[e - k:e]:
                h = mix(h * np.uint64(0xA0761D6478BD642F) ^ x)
            out.append(h)
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def digests(h: np.ndarray) -> tuple[int, int]:
    """Two 64-bit digests of a set."""
    if not len(h):
        return 0, 0
    a = mix(h ^ np.uint64(0x5851F42D4C957F2D)).sum(dtype=np.uint64)
    b = mix(h ^ np.uint64(0x14057B7EF767814F)).sum(dtype=np.uint64)
    return tuple(int(x) for x in mix(np.array([a + np.uint64(len(h)), b], np.uint64)).view(np.int64))


def parity_bitmap(h: np.ndarray) -> bytes:
    """Bit i is the parity of the shingles that hash to i; the length is the
    power of two next to the set size (64 bits or more)."""
    bits = max(64, 1 << int(len(h)).bit_length())
    at = (mix(h ^ np.uint64(0xDA942042E4DD58B5)) & np.uint64(bits - 1)).astype(np.int64)
    return np.packbits((np.bincount(at, minlength=bits) & 1).astype(np.uint8), bitorder="little").tobytes()


def fold(bits: bytes, size: int) -> bytes:
    """A parity bitmap over at most ``size`` bytes (a power of two)."""
    x = np.frombuffer(bits, np.uint8)
    return np.bitwise_xor.reduce(x.reshape(-1, min(size, len(x))), axis=0).tobytes()


def least_difference(a: bytes, b: bytes) -> int:
    """Lower bound of the symmetric difference of two sets from their bitmaps;
    the longer one is folded onto the length of the shorter."""
    if len(a) < len(b):
        a, b = b, a
    x = int.from_bytes(a, "little")
    size = len(a)
    while size > len(b):
        size //= 2
        x = (x >> (8 * size)) ^ (x & ((1 << (8 * size)) - 1))
    return (x ^ int.from_bytes(b, "little")).bit_count()


def signed(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64))


def hash_sets(docs: DataFrame, rule: Rule, parts: int = 16) -> DataFrame:
    """One row a document (``part`` -1: ``doc_id``, ``n``, ``d1``, ``d2``, bitmap
    in ``vec``) and the class counts of each task (``part``, ``task``, ``vec``)."""
    schema = pa.schema([("part", pa.int32()), ("doc_id", pa.int64()), ("n", pa.int64()), ("d1", pa.int64()),
                        ("d2", pa.int64()), ("task", pa.int32()), ("vec", pa.binary())])

    def run(batches):
        task, counts = common.task_id(), np.zeros(1 << CLASS_BITS, np.int64)
        for rb in common.sliced(batches):
            sets = shingle_sets(common.texts_of(rb), rule.words)
            counts += np.bincount((np.concatenate(sets) >> _SHIFT).astype(np.int64), minlength=1 << CLASS_BITS)
            d = np.array([digests(h) for h in sets], np.int64)
            k = len(sets)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(k, -1, np.int32)), rb.column(0), pa.array([len(h) for h in sets], pa.int64()),
                 pa.array(d[:, 0]), pa.array(d[:, 1]), pa.nulls(k, pa.int32()),
                 pa.array([parity_bitmap(h) for h in sets], pa.binary())], schema=schema)
        if counts.any():
            for p, vec in enumerate(np.split(counts, parts)):
                yield pa.RecordBatch.from_pylist([{"part": p, "task": task, "vec": common.squeeze(vec)}], schema=schema)

    return docs.select("doc_id", "text").mapInArrow(
        run, "part int, doc_id long, n long, d1 long, d2 long, task int, vec binary")


def class_order(hashed: DataFrame) -> tuple[np.ndarray, int]:
    """Rank of each token class by its count, and the first frequent rank."""
    rows = common.sum_blobs(hashed.where("part >= 0").select("part", "task", "vec"), ["part"]).collect()
    counts = np.zeros(1 << CLASS_BITS, np.int64)
    for r in rows:                                   # a table of fixed length
        v = common.expand(r.vec)
        counts[r.part * len(v):(r.part + 1) * len(v)] = v
    order = np.argsort(counts, kind="stable").astype(np.uint32)
    rank = np.empty(len(counts), np.uint32)
    rank[order] = np.arange(len(counts), dtype=np.uint32)
    return rank, int(np.count_nonzero(counts <= FREQUENT * max(counts.mean(), 1.0)))


def prefix_keys(h: np.ndarray, rank: np.ndarray, frequent: int, rule: Rule) -> tuple[np.ndarray, np.ndarray]:
    """Index keys of a set, and for each the shingles that a partner whose first
    shared key it is can no longer share."""
    n = len(h)
    short = n - rule.needed(n) + 1
    g = (rank[(h >> _SHIFT).astype(np.int64)].astype(np.uint64) << _SHIFT) | (h & _LOW)      # global order, one to one
    take = min(short + 1, n)
    g = np.sort(np.partition(g, take - 1)[:take])
    rare = int(np.searchsorted(g, np.uint64(frequent) << _SHIFT)) if frequent < 1 << CLASS_BITS else take
    keys, skip = [mix(g[:min(rare, short)])], [np.arange(min(rare, short))]
    often = g[rare:]
    if len(often) and n > rule.needed(COMBINE):      # may link to a set that indexes them alone
        keys.append(mix(g[rare:short]))
        skip.append(np.arange(rare, max(rare, short)))
    if len(often) > 1 and n <= COMBINE:
        i, j = np.triu_indices(len(often), 1)
        keys.append(mix(often[i] * np.uint64(0x9E3779B97F4A7C15) + mix(often[j])))
        skip.append(rare + j - 1)
    return np.concatenate(keys), np.concatenate(skip).astype(np.int32)


def index_entries(docs: DataFrame, shared, rule: Rule) -> DataFrame:
    """(``key``, ``d1``, ``skip``): the index; copies within a task give one set of
    entries.  ``shared`` is the broadcast class order."""

    def run(batches):
        seen: set[int] = set()
        for rb in common.sliced(batches):
            keys, skips, owner = [], [], []
            for h in shingle_sets(common.texts_of(rb), rule.words):
                d = digests(h)[0]
                if len(h) < rule.smallest or d in seen:
                    continue
                if len(seen) < 1_000_000:            # copies beyond are dropped by the distinct counts
                    seen.add(d)
                key, skip = prefix_keys(h, *shared.value, rule)
                keys.append(key)
                skips.append(skip)
                owner.append(d)
            if keys:
                m = [len(k) for k in keys]
                yield pa.RecordBatch.from_arrays(
                    [signed(np.concatenate(keys)), pa.array(np.repeat(np.array(owner, np.int64), m)),
                     pa.array(np.concatenate(skips))], names=["key", "d1", "skip"])

    return docs.select("text").mapInArrow(run, "key long, d1 long, skip int")


def sets_of(docs: DataFrame, classes: DataFrame, involved: DataFrame, rule: Rule) -> DataFrame:
    """(``d1``, ``rep``, ``set``) of the involved sets, hashed again from one
    document of each class."""
    reps = common.checkpoint(classes.join(involved, "d1").select("d1", F.col("rep").alias("doc_id"), "d2"))
    small = common.broadcast_if_small(reps.select("doc_id", F.col("d1").alias("want1"), F.col("d2").alias("want2")),
                                      reps.count(), 32)

    def run(batches):
        for rb in common.sliced(batches):
            sets = shingle_sets(common.texts_of(rb, "text"), rule.words)
            want = list(zip(rb.column(2).to_pylist(), rb.column(3).to_pylist()))
            ok = [i for i, h in enumerate(sets) if digests(h) == want[i]]      # ids may repeat with other texts
            yield pa.RecordBatch.from_arrays(
                [rb.column(2).take(pa.array(ok, pa.int64())), rb.column(0).take(pa.array(ok, pa.int64())),
                 pa.array([sets[i].tobytes() for i in ok], pa.binary())], names=["d1", "rep", "set"])

    return (docs.select("doc_id", "text").join(small, "doc_id").select("doc_id", "text", "want1", "want2")
            .mapInArrow(run, "d1 long, rep long, set binary").dropDuplicates(["d1", "rep"]))


def might_link(pairs: DataFrame, classes: DataFrame, rule: Rule) -> DataFrame:
    """(``a``, ``b``, ``nb``, ``least``): distinct pairs of digests with the least
    distance their bitmaps and sizes allow.  Only bitmaps are shuffled."""
    side = lambda k: classes.select(F.col("d1").alias(k), F.col("n").alias("n" + k),
                                    F.col("bits").alias("x" + k))
    met = pairs.select("a", "b").join(side("b"), "b").join(side("a"), "a").select("a", "b", "na", "nb", "xa", "xb")

    def run(batches):
        for rb in batches:
            na, nb = (rb.column(i).to_numpy().astype(np.int64) for i in (2, 3))
            diff = np.array([least_difference(x, y) for x, y in
                             zip(rb.column(4).to_pylist(), rb.column(5).to_pylist())], np.int64)
            diff = np.maximum(diff, np.abs(na - nb))
            inter = (na + nb - diff) // 2                # at most
            least = 1 - inter / np.maximum(na + nb - inter, 1)
            yield pa.RecordBatch.from_arrays([rb.column(0), rb.column(1), rb.column(3), pa.array(least)],
                                             names=["a", "b", "nb", "least"])

    return met.mapInArrow(run, "a long, b long, nb long, least double")


def verify(pairs: DataFrame, sets: DataFrame, rule: Rule) -> DataFrame:
    """(``a``, ``b`` digests, ``ra``, ``rb`` representatives, ``inter``, ``uni``)
    for distinct pairs (``a``, ``b``, ``nb``: size of b)."""
    blocks = F.ceil(F.sum("nb") / BLOCK_SHINGLES).cast("int")
    hub = pairs.groupBy("a").agg(F.greatest(F.lit(1), blocks).alias("blocks"))
    load = (pairs.join(hub, "a").select(F.col("a").alias("hub"), F.pmod(F.xxhash64("b"), F.col("blocks")).cast("int")
                                        .alias("part"), "b")
            .join(sets.select(F.col("d1").alias("b"), F.col("rep").alias("rb"), F.col("set").alias("sb")), "b"))
    left = (hub.join(sets.select(F.col("d1").alias("a"), F.col("rep").alias("ra"), F.col("set").alias("sa")), "a")
            .select("a", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), "ra", "sa"))

    def run(one: pd.DataFrame, many: pd.DataFrame) -> pd.DataFrame:
        out = []
        for a, ra, sa in zip(one["a"], one["ra"], one["sa"]):
            x = np.frombuffer(sa, np.uint64)
            if not len(many) or not len(x):
                continue
            n = np.array([len(s) // 8 for s in many["sb"]])
            y = np.frombuffer(b"".join(many["sb"]), np.uint64)
            hit = x[np.minimum(np.searchsorted(x, y), len(x) - 1)] == y
            total = np.append(0, np.cumsum(hit))
            end = np.cumsum(n)
            inter = total[end] - total[end - n]
            out.append(pd.DataFrame({"a": a, "b": many["b"], "ra": ra, "rb": many["rb"],
                                     "inter": inter, "uni": len(x) + n - inter}))
        return pd.concat(out) if out else pd.DataFrame(
            {c: pd.Series([], dtype="int64") for c in ("a", "b", "ra", "rb", "inter", "uni")})

    return left.groupBy("a", "block").cogroup(load.groupBy("hub", "part")).applyInPandas(
        run, "a long, b long, ra long, rb long, inter long, uni long")


def near_pairs(x: dict, y: dict, rule: Rule, most: int, width: float) -> list[tuple]:
    """For each set of ``x`` its ``most`` likeliest partners in ``y`` of another
    label that sizes, positions and bitmaps allow: (``x``, ``y``, ``nb``, ``least``)."""
    out = []
    for i in sorted(x["words"]):
        for j in sorted(y["words"]):
            (at, left), (to, right), w = x["words"][i], y["words"][j], min(i, j)
            a, b = x["n"][at], y["n"][to]
            if a.max() * 100 < b.min() * rule.percent or b.max() * 100 < a.min() * rule.percent:
                continue
            left, right = (np.bitwise_xor.reduce(m.reshape(len(m), -1, w), axis=1) for m in (left, right))
            step = max(1, (1 << 21) // max(1, right.size))
            for k in range(0, len(at), step):
                rows = at[k:k + step]
                n, m = x["n"][rows][:, None], y["n"][to][None, :]
                diff = np.zeros((len(rows), len(to)), np.int64)
                for c in range(w):
                    diff += np.bitwise_count(left[k:k + step, c][:, None] ^ right[:, c][None, :])
                inter = (n + m - np.maximum(diff, np.abs(n - m))) // 2
                inter = np.minimum(inter, np.minimum(x["rest"][rows][:, None], y["rest"][to][None, :]))
                least = 1 - inter / np.maximum(n + m - inter, 1)
                ok = (least <= width) & (x["label"][rows][:, None] != y["label"][to][None, :])
                r, c = np.nonzero(ok)
                out.append((rows[r], to[c], least[r, c]))
    if not out:
        return []
    r, c, least = (np.concatenate(v) for v in zip(*out))
    order = np.lexsort((y["d1"][c], least, r))
    r, c, least = r[order], c[order], least[order]
    rank = np.arange(len(r)) - np.searchsorted(r, r)
    keep = rank < most
    return [(x["d1"][r[keep]], y["d1"][c[keep]], y["n"][c[keep]], x["label"][r[keep]], y["label"][c[keep]], least[keep])]


def candidates(left: DataFrame, rule: Rule, most: int) -> DataFrame:
    """(``x``, ``y``, ``ny``, ``lx``, ``ly``, ``least``): the ``most`` likeliest
    partners of each set, and one more where it has more, in each block of each
    group of ``left`` (``lead``, ``d1``, ``label``, ``n``, ``rest``, ``bits``)."""
    width = 1 - rule.percent / 100 + 1e-9
    size = left.groupBy("lead").agg(F.ceil(F.count(F.lit(1)) / GROUP_BLOCK).cast("int").alias("blocks"),
                                    F.min("label").alias("lo"), F.max("label").alias("hi")).where("lo <> hi")
    bins = left.count() // GROUP_BLOCK + 1
    # small groups share a bin, a large one is dealt as pairs of blocks
    dealt = (left.join(size.select("lead", "blocks"), "lead")
             .withColumn("own", F.pmod(F.xxhash64("d1"), F.col("blocks")).cast("int"))
             .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
             .select("lead", "d1", "label", "n", "rest", "bits", "own", F.least("own", "other").alias("i"),
                     F.greatest("own", "other").alias("j"),
                     F.when(F.col("blocks") > 1, F.xxhash64("lead")).otherwise(F.pmod(F.xxhash64("lead"), F.lit(bins)))
                     .alias("bin")))

    def side(d: pd.DataFrame) -> dict:
        words: dict = {}
        length = d["bits"].map(len).to_numpy()
        for size_ in np.unique(length):
            at = np.flatnonzero(length == size_)
            words[int(size_) // 8] = (at, np.frombuffer(b"".join(d["bits"].iloc[at]), np.uint64).reshape(len(at), -1))
        return {"words": words, **{c: d[c].to_numpy(np.int64) for c in ("d1", "label", "n", "rest")}}

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        found = []
        i, j = pdf["i"].iloc[0], pdf["j"].iloc[0]
        for _, d in pdf.groupby("lead", sort=False):
            if d["label"].nunique() < 2:
                continue
            if i == j:
                s = side(d)
                found += near_pairs(s, s, rule, most + 1, width)
            else:
                s, o = side(d[d["own"] == i]), side(d[d["own"] == j])
                found += near_pairs(s, o, rule, most + 1, width) + near_pairs(o, s, rule, most + 1, width)
        return pd.DataFrame({c: np.concatenate([f[k] for f in found]) if found else np.zeros(0, t)
                             for k, (c, t) in enumerate(zip(("x", "y", "ny", "lx", "ly", "least"), ["i8"] * 5 + ["f8"]))})

    return dealt.groupBy("bin", "i", "j").applyInPandas(
        run, "x long, y long, ny long, lx long, ly long, least double")


def checked(pairs: DataFrame, docs: DataFrame, classes: DataFrame, rule: Rule) -> DataFrame:
    """Exact overlaps of the pairs that the bitmaps leave: (``a``, ``b``, ``ra``,
    ``rb``, ``inter``, ``uni``)."""
    ends = pairs.select(F.col("a").alias("d1")).union(pairs.select(F.col("b").alias("d1"))).distinct()
    return verify(pairs, common.checkpoint(sets_of(docs, classes, ends, rule)), rule)


def find_links(docs: DataFrame, hashed: DataFrame, classes: DataFrame, rule: Rule) -> DataFrame:
    """Links between class representatives (``a``, ``b``) that connect every
    pair of linked sets, directly or through other links."""
    width = 1 - rule.percent / 100 + 1e-9
    link = F.col("inter") * 100 >= F.col("uni") * rule.percent
    shared = docs.sparkSession.sparkContext.broadcast(class_order(hashed))
    entries = index_entries(docs, shared, rule)
    keys = (entries.groupBy("key").agg(F.min("d1").alias("lead"), F.max("d1").alias("last"))
            .where("lead <> last").select("key", "lead"))
    held = common.checkpoint(entries.join(keys, "key").groupBy("key", "d1").agg(F.first("lead").alias("lead"),
                                                                                   F.min("skip").alias("skip")))
    shared.unpersist()                               # still there for a task that must run again
    star = held.where("lead <> d1").select(F.col("lead").alias("a"), F.col("d1").alias("b")).distinct()
    star = might_link(star, classes, rule).where(F.col("least") <= width)
    star = star.groupBy("b").agg(F.min(F.struct("least", "a", "nb")).alias("best"))      # the likeliest leader
    first = checked(common.checkpoint(star.select("best.a", "b", "best.nb")), docs, classes, rule)
    linked = common.table(first.where(link).select(F.col("ra").alias("a"), F.col("rb").alias("b")))
    label = components(linked)

    def folded(batches):
        for rb in batches:
            yield pa.RecordBatch.from_arrays(
                [rb.column(0), rb.column(1), rb.column(2),
                 pa.array([fold(x, FOLDED) for x in rb.column(3).to_pylist()], pa.binary())],
                names=["d1", "label", "n", "bits"])

    named = (classes.join(label, classes["rep"] == label["node"], "left")
             .groupBy("d1").agg(F.min(F.coalesce("label", "rep")).alias("label"), F.min("n").alias("n"),
                                F.min("bits").alias("bits")))
    marked = held.join(named.select("d1", "label", "n"), "d1")
    open_keys = (marked.groupBy("key").agg(F.min("label").alias("lo"), F.max("label").alias("hi"))
                 .where("lo <> hi").select("key"))
    # sets of the keys of one leader; a pair of a key shares at most ``rest`` shingles
    met = (marked.join(open_keys, "key").groupBy("lead", "d1").agg(F.max(F.col("n") - F.col("skip")).alias("rest")))
    bits = named.select("d1", "label", "n", "bits").mapInArrow(folded, "d1 long, label long, n long, bits binary")
    left = common.table(met.join(bits, "d1").select("lead", "d1", "label", "n", "rest", "bits"))
    found = linked
    for most in (*PARTNERS, 1 << 30):
        # of each set the likeliest partners over all its groups
        order = Window.partitionBy("x").orderBy("least", "y")
        ranked = common.table(
            candidates(left, rule, most).groupBy("x", "y").agg(F.first("ny").alias("ny"), F.first("lx").alias("lx"),
                                                                F.first("ly").alias("ly"), F.min("least").alias("least"))
            .withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= most + 1))
        pairs = (ranked.where(F.col("rank") <= most)
                 .select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct())
        maybe = common.table(might_link(pairs, classes, rule).where(F.col("least") <= width))
        if not maybe.isEmpty():
            new = common.table(checked(maybe, docs, classes, rule).where(link)
                                    .select("a", "b", F.col("ra"), F.col("rb")))
            found = found.unionByName(new.select(F.col("ra").alias("a"), F.col("rb").alias("b")))
        else:
            new = None
        more = ranked.where(F.col("rank") > most).select(F.col("x").alias("d1"))
        if more.isEmpty():
            break
        # both sets of a pair still to be compared have more candidates than they gave
        left = left.join(more, "d1")
        if new is not None:
            ends = ranked.select(F.col("x").alias("a"), F.col("y").alias("b"), F.col("lx").alias("la"), F.col("ly").alias("lb"))
            merged = components(new.join(ends.union(ends.select("b", "a", "lb", "la")).distinct(), ["a", "b"])
                                .select(F.col("la").alias("a"), F.col("lb").alias("b")))
            left = (left.join(merged, left["label"] == merged["node"], "left")
                    .select("lead", "d1", F.coalesce(merged["label"], left["label"]).alias("label"), "n", "rest", "bits"))
        left = common.table(left.select("lead", "d1", "label", "n", "rest", "bits"))
    return found


def near_duplicates(docs: DataFrame, rule: Rule) -> DataFrame:
    """``doc_id``, ``n`` (set size) and ``component_id`` of every row of ``docs``."""
    with common.sorted_joins(docs.sparkSession):
        rows, label, classes = grouped(docs, rule)
    named = (classes.select("d1", "d2", "rep").join(label, classes["rep"] == label["node"], "left")
             .select("d1", "d2", F.coalesce("label", "rep").alias("component")))
    return (rows.join(named, ["d1", "d2"], "left")
            .select("doc_id", "n", F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id"))
                    .alias("component_id")))


def grouped(docs: DataFrame, rule: Rule) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Rows with their digests, labels of linked representatives, and classes."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    hashed = common.checkpoint(hash_sets(docs, rule))
    rows = hashed.where("part = -1").select("doc_id", "n", "d1", "d2", "vec")
    known = docs.where(F.col("doc_id").isNotNull())
    classes = common.checkpoint(rows.where("n > 0 and doc_id is not null").groupBy("d1", "d2")
                                .agg(F.min("doc_id").alias("rep"), F.min("n").alias("n"), F.min("vec").alias("bits")))
    rows = rows.drop("vec")
    links = find_links(known, hashed, classes.where(F.col("n") >= rule.smallest), rule)
    # copies, and rows of one id, belong together through the class representative
    same_id = (rows.where("n > 0").join(classes.select("d1", "d2", "rep"), ["d1", "d2"])
               .where("doc_id is not null").groupBy("doc_id").agg(F.min("rep").alias("a"), F.max("rep").alias("b"))
               .where("a <> b").select("a", "b"))
    return rows, components(links.unionByName(same_id)), classes


def op5_shingle_join(spark, sf_dir: str) -> DataFrame:
    docs = common.documents(spark, sf_dir)
    return (near_duplicates(docs, Rule(3, 90))
            .select("doc_id", F.col("n").alias("n_shingles"), "component_id"))


OP5_SQL = r"""
WITH w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
         'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(ws) = 0 THEN []::VARCHAR[]
         WHEN len(ws) < 3 THEN [array_to_string(ws, ' ')]
         ELSE [ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2] FOR i IN range(1, len(ws) - 1)] END) AS sh FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS i FROM s a JOIN s b ON a.sh = b.sh AND a.doc_id < b.doc_id
      GROUP BY 1, 2),
l AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * i >= 90 * (x.n + y.n - i)),
e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r AS (WITH RECURSIVE t(id, c) AS (SELECT doc_id, doc_id FROM documents
        UNION SELECT t.id, e.b FROM t JOIN e ON t.c = e.a WHERE e.b <> t.id) SELECT id, min(c) AS c FROM t GROUP BY 1)
SELECT d.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, r.c AS component_id
FROM documents d LEFT JOIN n USING (doc_id) JOIN r ON r.id = d.doc_id"""
