"""Periodic run detection: all long repetitions of words inside each text.

A run is a stretch of words with smallest period q, at least ``max(LEAST,
3 * q)`` words long, that no neighbouring word extends.  Runs are enumerated on a
harmonic grid: a run of period p holds, for some grid place i of p, both i and
i + p, where the grid steps by ``max(2 * p, LEAST - p)``.  From the two places the
run reaches as far as they agree forwards and backwards (longest common
extension, LCE), so the grid of all periods gives every run with about
n log n questions for n words.

LCE questions go through a difference cover: of any two places, within fewer
than ``PERIOD`` steps both are sampled.  So few words are compared, and if all
agree, the answer is the smallest common prefix between the two samples in the
sorted order of the sampled suffixes, read from a sparse table.  Only sampled
suffixes are sorted: by their first ``PERIOD`` words, then by doubling along
places ``PERIOD`` apart, which are sampled too.  Most questions end within the
compared words; suffixes are sorted for the texts in which one does not.

A stretch whose smallest period is q is found again under multiples of q; of
equal stretches the smallest period stays.

Texts are worked on in slices of bounded size, a long text alone, with its grid
in blocks.  No text is shuffled.

Edge cases: null and empty texts have no runs; rows with a null id are kept (and
never rewritten by the query); repeated rows give repeated results; an empty
table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from edgecraft.llm import common

LEAST, TIMES = 24, 3
#: A difference cover modulo 13 (every difference is one of two of its members).
PERIOD, COVER = 13, (0, 1, 3, 9)
#: LCE questions worked on at once, and text bytes of a slice.
QUESTIONS, SLICE = 1 << 19, 1 << 19

_MEMBER = np.isin(np.arange(PERIOD), COVER)
#: Steps from two residues until both are in the cover.
SHIFT = np.array([[next(d for d in range(PERIOD) if _MEMBER[(a + d) % PERIOD] and _MEMBER[(b + d) % PERIOD])
                   for b in range(PERIOD)] for a in range(PERIOD)], np.int64)
_SLOT = np.cumsum(_MEMBER) - 1


class Words:
    """Texts as word numbers in one array; each text starts at a multiple of
    PERIOD and ends with a mark of its own, so that no comparison leaves it."""

    def __init__(self, texts: list[np.ndarray], words: int):
        self.n = np.array([len(t) for t in texts], np.int64)
        room = -(-(self.n + 1) // PERIOD) * PERIOD
        self.start = np.cumsum(room) - room
        marks = words + np.arange(len(texts), dtype=np.int64)
        self.at = np.full(int(room.sum()) + PERIOD, words + len(texts), np.int64)
        self.at[:-PERIOD] = np.repeat(marks, room)
        for t, s in zip(texts, self.start):
            self.at[s:s + len(t)] = t


def compared(at: np.ndarray, a: np.ndarray, b: np.ndarray, most: np.ndarray, step: int) -> np.ndarray:
    """How many words from places a and b on (in direction ``step``) agree, at
    most ``most``."""
    agree = np.zeros(len(a), np.int64)
    live = np.flatnonzero(most > 0)
    t = 0
    while len(live):
        live = live[at[a[live] + step * t] == at[b[live] + step * t]]
        t += 1
        agree[live] = t
        live = live[most[live] > t]
    return agree


class Samples:
    """Sorted sampled suffixes of :class:`Words` with a sparse table of their
    common prefixes."""

    def __init__(self, w: Words):
        at, blocks = w.at, (len(w.at) // PERIOD) - 1
        self.w, self.chain = w, blocks
        place = np.concatenate([np.arange(blocks) * PERIOD + r for r in COVER])     # a chain for each residue
        m = len(place)
        # the first PERIOD words, several to a key
        bits = max(int(at.max()).bit_length(), 1)
        per = 63 // bits
        keys = []
        for k in range(0, PERIOD, per):
            key = np.zeros(m, np.int64)
            for j in range(k, min(k + per, PERIOD)):
                key = key << bits | at[place + j]
            keys.append(key)
        order = np.lexsort(keys[::-1])
        new = np.zeros(m, np.int64)
        for key in keys:
            s = key[order]
            new[1:] |= s[1:] != s[:-1]
        rank = np.empty(m, np.int64)
        rank[order] = np.cumsum(new)
        levels, reach = [rank.astype(np.int32)], 1
        index = np.arange(m) % blocks
        while rank.max() < m - 1 and reach < blocks:
            further = np.where(index + reach < blocks, rank[np.minimum(np.arange(m) + reach, m - 1)] + 1, 0)
            key = rank * (m + 1) + further
            order = np.argsort(key, kind="stable")
            s = key[order]
            rank = np.empty(m, np.int64)
            rank[order] = np.cumsum(np.append(False, s[1:] != s[:-1]))
            reach *= 2
            levels.append(rank.astype(np.int32))
        self.rank = rank
        # common prefixes of neighbours, by descending the levels
        a, b = order[:-1], order[1:]
        ahead = np.zeros(m - 1, np.int64)
        for k in range(len(levels) - 1, -1, -1):
            x, y = a + ahead, b + ahead
            inside = (index[a] + ahead < blocks) & (index[b] + ahead < blocks)
            x, y = np.minimum(x, m - 1), np.minimum(y, m - 1)
            ahead += np.where(inside & (levels[k][x] == levels[k][y]), 1 << k, 0)
        pa_, pb = place[a] + ahead * PERIOD, place[b] + ahead * PERIOD
        end = len(at) - 1
        rest = compared(at, np.minimum(pa_, end), np.minimum(pb, end),
                        np.minimum(PERIOD, np.maximum(len(at) - np.maximum(pa_, pb), 0)), 1)
        table = [(ahead * PERIOD + rest).astype(np.int32)]
        while 1 << len(table) <= m - 1:
            h, t = 1 << (len(table) - 1), table[-1]
            table.append(np.minimum(t[:-h], t[h:]))
        self.table = table

    def common(self, text: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Common prefix of the suffixes at sampled places i and j of texts."""
        base = self.w.start[text]
        x, y = (self.rank[_SLOT[p % PERIOD] * self.chain + (base + p) // PERIOD] for p in (i, j))
        lo, hi = np.minimum(x, y), np.maximum(x, y)
        k = np.frexp((hi - lo).astype(np.float64))[1] - 1                           # floor of the logarithm
        out = np.empty(len(lo), np.int64)
        for level in np.unique(k):
            q = np.flatnonzero(k == level)
            t = self.table[level]
            out[q] = np.minimum(t[lo[q]], t[hi[q] - (1 << int(level))])
        return out


def grid(n: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Blocks of (text, period, place) for texts of n words."""
    most = np.where(n >= LEAST, n // TIMES, 0)
    total = int(most.sum())
    ends = np.cumsum(most)
    step = QUESTIONS // 4
    for low in range(0, total, step):                       # of all (text, period)
        pair = np.arange(low, min(low + step, total))
        text = np.searchsorted(ends, pair, side="right")
        period = pair - (ends[text] - most[text]) + 1
        gap = np.maximum(2 * period, LEAST - period)
        places = -(-(n[text] - period) // gap)              # i < n - period
        upto = np.cumsum(places)
        at = 0
        while at < len(pair):
            base = upto[at - 1] if at else 0
            stop = max(at + 1, int(np.searchsorted(upto, base + QUESTIONS, side="right")))
            s = slice(at, stop)
            which = np.repeat(np.arange(at, stop), places[s])
            i = (np.arange(len(which)) + base - np.repeat(upto[s] - places[s], places[s])) * gap[which]
            yield text[which], period[which], i
            at = stop


def runs_of(texts: list[np.ndarray], words: int) -> pd.DataFrame:
    """All runs ``text, start, length, period`` of texts given as word numbers
    below ``words``, by text, start and period."""
    w = Words(texts, words)
    sampled: dict[tuple, Samples] = {}

    def index(needed: np.ndarray, back: bool) -> tuple[Samples, np.ndarray]:
        key = (back, needed.tobytes())
        if key not in sampled:
            sampled[key] = Samples(Words([texts[d][::-1] if back else texts[d] for d in needed], words))
        number = np.zeros(len(texts), np.int64)
        number[needed] = np.arange(len(needed))
        return sampled[key], number

    def extend(text, i, j, back: bool, agree, most):
        """LCE of places i and j of texts whose first ``most`` words were compared."""
        far = np.flatnonzero(agree == most)
        if len(far):
            s, number = index(np.unique(text[far]), back)
            agree[far] = most[far] + s.common(number[text[far]], i[far] + most[far], j[far] + most[far])
        return agree

    found = [np.zeros((0, 4), np.int64)]
    for text, p, i in grid(w.n):
        a = w.start[text] + i
        same = w.at[a] == w.at[a + p]
        text, p, i, a = text[same], p[same], i[same], a[same]
        n = w.n[text]
        most_f = SHIFT[i % PERIOD, (i + p) % PERIOD]
        forth = compared(w.at, a, a + p, most_f, 1)
        # places before i and i + p, in the reversed text
        ri, rj = n - i, n - i - p
        most_b = SHIFT[ri % PERIOD, rj % PERIOD]
        back = compared(w.at, a - 1, a + p - 1, most_b, -1)
        need = np.maximum(LEAST, TIMES * p)
        open_ = (forth == most_f) | (back == most_b) | (forth + back + p >= need)
        text, p, i, n, ri, rj, forth, back, most_f, most_b, need = (
            x[open_] for x in (text, p, i, n, ri, rj, forth, back, most_f, most_b, need))
        forth = extend(text, i, i + p, False, forth, most_f)
        back = extend(text, ri, rj, True, back, most_b)
        long = forth + back + p >= need
        rows = np.column_stack([text, i - back, back + p + forth, p])[long]
        found.append(np.unique(rows, axis=0))
    rows = np.concatenate(found)
    # of equal stretches the smallest period
    rows = rows[np.lexsort((rows[:, 3], rows[:, 2], rows[:, 1], rows[:, 0]))]
    first = np.append(True, (rows[1:, :3] != rows[:-1, :3]).any(axis=1))[:len(rows)]
    rows = rows[first]
    rows = rows[np.lexsort((rows[:, 3], rows[:, 1], rows[:, 0]))]
    return pd.DataFrame(rows, columns=["text", "start", "length", "period"])


def kept(n: int, runs: np.ndarray) -> np.ndarray:
    """Which of n words stay when of each run (start, length, period) only the
    first period stays."""
    edge = np.zeros(n + 1, np.int64)
    np.add.at(edge, runs[:, 0] + runs[:, 2], 1)
    np.add.at(edge, runs[:, 0] + runs[:, 1], -1)
    return np.cumsum(edge[:-1]) == 0


def find_runs(docs: DataFrame, rewrite: Callable[[object, int], np.ndarray | None] | None = None) -> DataFrame:
    """``doc_id``, ``runs`` (start, length, period; by start and period) and
    ``collapsed`` (the words that stay, joined by one space) of each text.
    ``rewrite(doc_id, n)`` may give the places of the words that a text of n words
    is to be made of."""
    run = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])

    def work(batches):
        for rb in common.sliced(batches, target=SLICE):
            ids = rb.column(0)
            split = [t.encode("utf-8", "surrogatepass").split() for t in common.texts_of(rb)]
            for k, i in enumerate(ids.to_pylist() if rewrite else ()):
                places = rewrite(i, len(split[k]))
                if places is not None:
                    split[k] = [split[k][x] for x in places.tolist()]
            flat = np.empty(sum(map(len, split)), object)
            flat[:] = [x for s in split for x in s]
            codes, names = pd.factorize(flat)
            cuts = np.cumsum([len(s) for s in split])
            found = runs_of(np.split(codes.astype(np.int64), cuts[:-1]), len(names))
            offsets = np.searchsorted(found["text"].to_numpy(), np.arange(len(split) + 1)).astype(np.int32)
            rows = found[["start", "length", "period"]].to_numpy()
            collapsed = []
            for k, s in enumerate(split):
                own = rows[offsets[k]:offsets[k + 1]]
                if len(own):
                    s = [s[x] for x in np.flatnonzero(kept(len(s), own)).tolist()]
                collapsed.append(b" ".join(s))
            values = pa.StructArray.from_arrays([pa.array(rows[:, c]) for c in range(3)], fields=list(run))
            yield pa.RecordBatch.from_arrays(
                [ids, pa.ListArray.from_arrays(pa.array(offsets), values),
                 pa.array(collapsed, pa.binary()).cast(pa.string())], names=["doc_id", "runs", "collapsed"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(
        work, f"doc_id {kind}, runs array<struct<start:bigint,length:bigint,period:bigint>>, collapsed string")


def planted(doc_id, n: int) -> np.ndarray | None:
    """The query's rewriting: some texts are periodic from a place on."""
    if doc_id is None or not n:
        return None
    h = zlib.crc32(str(doc_id).encode())
    if h % 10:
        return None
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    i = np.arange(n)
    return np.where(i < a, i, a + (i - a) % p)


def op11_periodic_runs(spark, sf_dir: str) -> DataFrame:
    found = find_runs(common.documents(spark, sf_dir), planted)
    # exact: length / period of one run against another by cross products; the earlier one stays
    best = F.aggregate(F.slice("runs", 2, F.greatest(F.size("runs") - 1, F.lit(0))), F.get("runs", F.lit(0)),
                       lambda a, r: F.when(r["length"] * a["period"] > a["length"] * r["period"], r).otherwise(a))
    lines = F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n")))
    return found.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), best.alias("b"),
        F.sha2(F.array_join(lines, "").cast("binary"), 256).alias("runs_sha256"),
        F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256")).select(
        "doc_id", "n_runs", "b.start", "b.length", "b.period",
        F.expr("1000 * b.length div b.period").alias("exponent_milli"), "runs_sha256", "collapsed_sha256")


OP11_SQL = r"""
WITH t AS (
  SELECT list(list_reduce(list_concat([CAST(i AS BIGINT)], range(8)), lambda c, k:
    CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) ORDER BY i) AS crc FROM range(256) r(i)),
d AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w,
    xor(list_reduce(list_concat([4294967295], list_transform(string_split(CAST(doc_id AS VARCHAR), ''),
      lambda s: CAST(ascii(s) AS BIGINT))), lambda c, b: xor(c >> 8, crc[(xor(c, b) & 255) + 1])), 4294967295) AS h
  FROM documents, t),
g AS (SELECT doc_id, w, h, len(w) AS n, CASE WHEN len(w) > 0 THEN (h // 10) % len(w) END AS a FROM d),
p AS (SELECT *, 1 + (n - a) // (3 + (h // 10) % 8) AS p FROM g),
e AS (SELECT doc_id, n, CASE WHEN h % 10 = 0 AND n > 0
        THEN [w[CASE WHEN i < a THEN i ELSE a + (i - a) % p END + 1] FOR i IN range(n)] ELSE w END AS w FROM p),
x AS (SELECT doc_id, n, unnest(w) AS word, unnest(range(n)) AS i FROM e),
m AS (SELECT a.doc_id, b.i - a.i AS q, a.i FROM x a JOIN x b ON a.doc_id = b.doc_id AND a.word = b.word AND a.i < b.i
      WHERE 3 * (b.i - a.i) <= a.n),
s AS (SELECT doc_id, q, min(i) AS start, count(*) + q AS length
      FROM (SELECT *, i - row_number() OVER (PARTITION BY doc_id, q ORDER BY i) AS island FROM m)
      GROUP BY doc_id, q, island HAVING count(*) + q >= greatest(24, 3 * q)),
r AS (SELECT doc_id, start, length, min(q) AS period FROM s GROUP BY ALL),
f AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY length / period DESC, start, period) AS k FROM r),
o AS (SELECT doc_id, count(*) AS n_runs, string_agg(start || ',' || length || ',' || period || chr(10), ''
        ORDER BY start, period) AS lines FROM r GROUP BY 1),
c AS (SELECT doc_id, string_agg(word, ' ' ORDER BY i) AS words FROM x
      WHERE NOT EXISTS (SELECT 1 FROM r WHERE r.doc_id = x.doc_id AND x.i >= r.start + r.period
                        AND x.i < r.start + r.length) GROUP BY 1)
SELECT e.doc_id, CAST(coalesce(o.n_runs, 0) AS BIGINT) AS n_runs, CAST(f.start AS BIGINT) AS start,
  CAST(f.length AS BIGINT) AS length, CAST(f.period AS BIGINT) AS period,
  CAST(1000 * f.length // f.period AS BIGINT) AS exponent_milli,
  sha256(coalesce(o.lines, '')) AS runs_sha256, sha256(coalesce(c.words, '')) AS collapsed_sha256
FROM e LEFT JOIN o USING (doc_id) LEFT JOIN c USING (doc_id) LEFT JOIN f ON f.doc_id = e.doc_id AND f.k = 1"""
