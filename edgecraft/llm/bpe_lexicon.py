"""Byte-level BPE with a minimal acyclic transducer lexicon.

1. Spark counts the pre-tokens of all texts; the ``LEXICON_WORDS`` most
   frequent ones (a bounded table) are merged exactly and compiled into a
   minimal acyclic automaton over UTF-8 bytes that shares suffixes.  Each
   transition carries the number of lexicon words that sort before it, so the
   outputs along a path add up to the word's index, which names its ids.
2. The automaton is one flat file: it is broadcast as bytes, written to an
   unnamed temporary file in each Python worker and memory-mapped.
3. Distinct pre-tokens of a batch walk the automaton together, one byte a
   step; words outside it are merged exactly, lowest rank first, also for all
   words at once (words over ``LONG`` bytes one at a time on a heap).

Decoding concatenates the byte strings of the ids and reads them as UTF-8,
invalid parts as the replacement character.

Edge cases: null text encodes as empty (no ids, decoded empty); repeated rows
stay; null ids pass through; with no text at all the lexicon is empty and
every word takes the exact merge; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import mmap
import tempfile
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from edgecraft.llm import common
from edgecraft.llm.pretokens import Splitter

LEXICON_WORDS = 1 << 16
LONG = 256
NONE = np.iinfo(np.int32).max


def byte_alphabet() -> list[str]:
    """The printable character that stands for each byte in the files:
    printable Latin-1 bytes for themselves, the others from U+0100 on."""
    shown = [b for b in range(256) if 0x21 <= b <= 0x7E or 0xA1 <= b <= 0xAC or 0xAE <= b]
    rest = iter(range(256, 512))
    return [chr(b) if b in set(shown) else chr(next(rest)) for b in range(256)]


class Merges:
    """Vocabulary and ranked merges of a byte-level BPE file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            conf = json.load(f)
        vocab = conf["model"]["vocab"]
        letters = byte_alphabet()
        self.byte_id = np.array([vocab[c] for c in letters], np.int32)
        self.size = max([*vocab.values(), *(t["id"] for t in conf["added_tokens"])]) + 1
        byte_of = {c: b for b, c in enumerate(letters)}
        self.token_bytes: list[bytes] = [b""] * self.size
        for token, i in vocab.items():
            self.token_bytes[i] = bytes(byte_of[c] for c in token)
        for t in conf["added_tokens"]:
            self.token_bytes[t["id"]] = t["content"].encode()
        pairs = [m if isinstance(m, list) else m.split(" ") for m in conf["model"]["merges"]]
        left = np.array([vocab[a] for a, _ in pairs], np.int64)
        right = np.array([vocab[b] for _, b in pairs], np.int64)
        made = np.array([vocab[a + b] for a, b in pairs], np.int32)
        key = left * self.size + right
        order = np.argsort(key, kind="stable")
        self.key, self.rank, self.made = key[order], order.astype(np.int32), made     # made by rank
        self.by_pair = {k: r for r, k in enumerate(key.tolist())}

    def ranks(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        key = a.astype(np.int64) * self.size + b
        at = np.minimum(np.searchsorted(self.key, key), len(self.key) - 1)
        return np.where(self.key[at] == key, self.rank[at], NONE).astype(np.int32)

    def merge_long(self, word: bytes) -> list[int]:
        """One word, pairs taken from a heap by rank, then position."""
        sym = self.byte_id[np.frombuffer(word, np.uint8)].tolist()
        n = len(sym)
        nxt, prv = list(range(1, n + 1)), list(range(-1, n - 1))
        alive = [True] * n
        get, size = self.by_pair.get, self.size
        heap = [(r, i, sym[i], sym[i + 1]) for i in range(n - 1) if (r := get(sym[i] * size + sym[i + 1])) is not None]
        heapq.heapify(heap)
        while heap:
            r, i, a, b = heapq.heappop(heap)
            j = nxt[i] if alive[i] else n
            if j >= n or sym[i] != a or sym[j] != b:
                continue
            sym[i] = int(self.made[r])
            alive[j] = False
            k = nxt[i] = nxt[j]
            if k < n:
                prv[k] = i
                if (q := get(sym[i] * size + sym[k])) is not None:
                    heapq.heappush(heap, (q, i, sym[i], sym[k]))
            p = prv[i]
            if p >= 0 and (q := get(sym[p] * size + sym[i])) is not None:
                heapq.heappush(heap, (q, p, sym[p], sym[i]))
        return [s for s, ok in zip(sym, alive) if ok]

    def merge(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all words end to end, and the number of ids of each."""
        n = len(words)
        long = {i: self.merge_long(w) for i, w in enumerate(words) if len(w) > LONG}
        lens = np.array([0 if i in long else len(w) for i, w in enumerate(words)], np.int64)
        data = b"".join(w for i, w in enumerate(words) if i not in long)
        sym = self.byte_id[np.frombuffer(data, np.uint8)]
        wid = np.repeat(np.arange(n), lens)
        done_sym, done_wid = [], []
        rank = np.full(len(sym), NONE, np.int32)
        if len(sym):
            same = wid[:-1] == wid[1:]
            rank[:-1][same] = self.ranks(sym[:-1][same], sym[1:][same])
        while len(sym):
            first = np.flatnonzero(np.append(True, wid[1:] != wid[:-1]))
            size = np.diff(np.append(first, len(wid)))
            low = np.minimum.reduceat(rank, first)
            busy = low < NONE
            if not busy.all():
                keep = np.repeat(busy, size)
                done_sym.append(sym[~keep])
                done_wid.append(wid[~keep])
                sym, wid, rank = sym[keep], wid[keep], rank[keep]
                low, size = low[busy], size[busy]
                if not len(sym):
                    break
            hit = np.flatnonzero(rank == np.repeat(low, size))
            hit = hit[np.append(True, wid[hit[1:]] != wid[hit[:-1]])]       # first place in each word
            sym[hit] = self.made[rank[hit]]
            keep = np.ones(len(sym), bool)
            keep[hit + 1] = False
            at = hit - np.arange(len(hit))                                  # place after the cut
            sym, wid, rank = sym[keep], wid[keep], rank[keep]
            for left in (at, at[at > 0] - 1):
                right = left + 1
                ok = right < len(sym)
                inside = np.zeros(len(left), bool)
                inside[ok] = wid[left[ok]] == wid[right[ok]]
                r = np.full(len(left), NONE, np.int32)
                r[inside] = self.ranks(sym[left[inside]], sym[right[inside]])
                rank[left] = r
        for i, ids in long.items():
            done_sym.append(np.asarray(ids, np.int32))
            done_wid.append(np.full(len(ids), i, np.int64))
        if not done_sym:
            return np.zeros(0, np.int32), np.zeros(n, np.int64)
        sym, wid = np.concatenate(done_sym), np.concatenate(done_wid)
        order = np.argsort(wid, kind="stable")
        return sym[order], np.bincount(wid, minlength=n)


def ragged_take(flat: np.ndarray, lens: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Concatenate the given rows of a ragged table."""
    start = np.cumsum(lens) - lens
    take = lens[rows]
    out = np.repeat(start[rows] - (np.cumsum(take) - take), take) + np.arange(take.sum())
    return flat[out]


class Automaton:
    """Minimal acyclic automaton: words (bytes) to their index in sorted order."""

    ARRAYS = ("key", "target", "output", "final", "id_count", "ids")

    @classmethod
    def compile(cls, words: list[bytes], ids: np.ndarray, id_count: np.ndarray) -> bytes:
        """``words`` sorted and distinct; ``ids`` end to end in that order."""
        children: list[dict[int, int]] = [{}]
        final = [False]
        register: dict[tuple, int] = {}

        def settle(path: list[tuple[int, int]], depth: int) -> None:
            # replace states below `depth` on the last word's path by equal registered ones
            while len(path) > depth:
                parent, label = path.pop()
                state = children[parent][label]
                shape = (final[state], tuple(children[state].items()))
                known = register.setdefault(shape, state)
                if known != state:
                    children[parent][label] = known

        path: list[tuple[int, int]] = []
        last = b""
        for w in words:
            common_len = 0
            while common_len < min(len(w), len(last)) and w[common_len] == last[common_len]:
                common_len += 1
            settle(path, common_len)
            state = children[path[-1][0]][path[-1][1]] if path else 0
            for b in w[common_len:]:
                children.append({})
                final.append(False)
                children[state][b] = len(children) - 1
                path.append((state, b))
                state = len(children) - 1
            final[state] = True
            last = w
        settle(path, 0)
        number, order, stack = {0: 0}, [0], [0]
        while stack:                                   # number the states that are left
            for t in children[stack.pop()].values():
                if t not in number:
                    number[t] = len(order)
                    order.append(t)
                    stack.append(t)
        below: dict[int, int] = {}

        def words_below(s: int) -> int:
            todo = [s]
            while todo:
                x = todo[-1]
                missing = [t for t in children[x].values() if t not in below]
                if missing:
                    todo.extend(missing)
                else:
                    below[x] = final[x] + sum(below[t] for t in children[x].values())
                    todo.pop()
            return below[s]

        words_below(0)
        key, target, output = [], [], []
        for s in order:
            before = int(final[s])
            for b, t in sorted(children[s].items()):
                key.append(number[s] * 256 + b)
                target.append(number[t])
                output.append(before)
                before += below[t]
        sort = np.argsort(np.asarray(key, np.int64), kind="stable")
        arrays = {"key": np.asarray(key, np.int64)[sort], "target": np.asarray(target, np.int64)[sort],
                  "output": np.asarray(output, np.int64)[sort],
                  "final": np.asarray([final[s] for s in order], np.int64),
                  "id_count": id_count.astype(np.int64), "ids": ids.astype(np.int64)}
        head = np.array([len(arrays[a]) for a in cls.ARRAYS], np.int64)
        return head.tobytes() + b"".join(arrays[a].tobytes() for a in cls.ARRAYS)

    def __init__(self, blob: bytes):
        with tempfile.TemporaryFile() as f:            # unnamed: gone with the worker
            f.write(blob)
            f.flush()
            self._map = mmap.mmap(f.fileno(), 0, access=mmap.ACCESS_READ)
        sizes, at = np.frombuffer(self._map, np.int64, len(self.ARRAYS)), 8 * len(self.ARRAYS)
        for name, size in zip(self.ARRAYS, sizes.tolist()):
            setattr(self, name, np.frombuffer(self._map, np.int64, size, at))
            at += 8 * size

    def index(self, words: list[bytes]) -> np.ndarray:
        """Index of each word, -1 outside the lexicon."""
        n = len(words)
        lens = np.array([len(w) for w in words], np.int64)
        if not n or not len(self.key):
            return np.full(n, -1)
        data = np.frombuffer(b"".join(words), np.uint8).astype(np.int64)
        begin = np.cumsum(lens) - lens
        state, total = np.zeros(n, np.int64), np.zeros(n, np.int64)
        walk, step = np.flatnonzero(lens > 0), 0
        result = np.full(n, -1)
        while len(walk):
            k = state[walk] * 256 + data[begin[walk] + step]
            at = np.minimum(np.searchsorted(self.key, k), len(self.key) - 1)
            ok = self.key[at] == k
            walk, at = walk[ok], at[ok]
            total[walk] += self.output[at]
            state[walk] = self.target[at]
            step += 1
            end = lens[walk] == step
            stop = walk[end]
            result[stop] = np.where(self.final[state[stop]] > 0, total[stop], -1)
            walk = walk[~end]
        return result


@lru_cache(maxsize=2)
def splitter_of(path: str) -> Splitter:
    return Splitter(path)


@lru_cache(maxsize=2)
def merges_of(path: str) -> Merges:
    return Merges(path)


class Encoder:
    """Ids of texts: lexicon first, exact merges for the rest."""

    def __init__(self, path: str, automaton: bytes):
        self.splitter, self.merges, self.lexicon = splitter_of(path), merges_of(path), Automaton(automaton)

    def word_ids(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        at = self.lexicon.index(words)
        out = np.flatnonzero(at < 0)
        ids, lens = self.merges.merge([words[i] for i in out.tolist()])
        flat = np.concatenate([self.lexicon.ids, ids])
        table = np.concatenate([self.lexicon.id_count, lens])
        row = at.copy()
        row[out] = len(self.lexicon.id_count) + np.arange(len(out))
        return ragged_take(flat, table, row), table[row]

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts end to end, and the number of each."""
        distinct, code, owner, (s_owner, s_place, s_id) = self.splitter.words(texts)
        flat, lens = self.word_ids([w.encode("utf-8", "surrogatepass") for w in distinct])
        if len(s_id):                                  # added tokens are rows of their own
            code = np.insert(code, s_place, len(lens) + np.arange(len(s_id)))
            owner = np.insert(owner, s_place, s_owner)
            flat, lens = np.concatenate([flat, s_id]), np.concatenate([lens, np.ones(len(s_id), np.int64)])
        ids = ragged_take(flat, lens, code) if len(code) else np.zeros(0, np.int64)
        count = np.bincount(owner, weights=lens[code], minlength=len(texts)) if len(code) else np.zeros(len(texts))
        return ids.astype(np.int32), count.astype(np.int64)


def word_counts(docs: DataFrame, path: str, hold: int = 400_000) -> DataFrame:
    """(word, n): the pre-tokens of all texts."""
    def run(batches):
        split = splitter_of(path)
        held: dict[str, int] = {}

        def out():
            words = list(held)
            for i in range(0, len(words), 50_000):
                w = words[i:i + 50_000]
                yield pa.RecordBatch.from_arrays([pa.array(w, pa.string()), pa.array([held[x] for x in w], pa.int64())],
                                                 names=["word", "n"])
            held.clear()

        for rb in common.sliced(batches, target=1 << 20):
            distinct, code, _, _ = split.words(common.texts_of(rb))
            for w, n in zip(distinct, np.bincount(code, minlength=len(distinct)).tolist()):
                held[w] = held.get(w, 0) + n
            if len(held) > hold:
                yield from out()
        yield from out()

    return docs.select("text").mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def build_lexicon(docs: DataFrame, path: str, size: int = LEXICON_WORDS, longest: int = 64) -> bytes:
    """Automaton of the most frequent pre-tokens of at most ``longest`` bytes:
    the words from the lowest count on (in steps of a sixteenth of an octave)
    that are at most ``size`` together.  Words seen once never belong."""
    counted = common.checkpoint(word_counts(docs, path).where((F.col("n") > 1) & (F.octet_length("word") <= longest))
                                .withColumn("bin", F.floor(F.log2("n") * 16).cast("int")))
    held, least = 0, None                              # the lowest bin that keeps the table within `size`
    for r in counted.groupBy("bin").count().orderBy(F.desc("bin")).collect():     # at most 16 * 64 bins
        held += r["count"]
        if held > size:
            break
        least = r.bin
    top = counted.where(F.col("bin") >= least).select("word").collect() if least is not None else []
    words = sorted({r.word.encode("utf-8", "surrogatepass") for r in top})
    ids, lens = merges_of(path).merge(words)
    return Automaton.compile(words, ids, lens)


def encode(docs: DataFrame, path: str, automaton: bytes, keep: list[str]) -> DataFrame:
    """Add ``ids`` (array of int) to the columns ``keep``."""
    shared = docs.sparkSession.sparkContext.broadcast(automaton)
    src = docs.select(*dict.fromkeys([*keep, "text"]))

    def run(batches):
        enc = Encoder(path, shared.value)
        for rb in common.sliced(batches, target=1 << 22):
            ids, n = enc.encode(common.texts_of(rb))
            off = np.zeros(len(n) + 1, np.int32)
            np.cumsum(n, out=off[1:])
            yield pa.RecordBatch.from_arrays([*rb.select(keep).columns, pa.ListArray.from_arrays(off, pa.array(ids))],
                                             names=[*keep, "ids"])

    fields = ", ".join(f"`{c}` {src.schema[c].dataType.simpleString()}" for c in keep)
    return src.mapInArrow(run, f"{fields}, ids array<int>")


def decode_ids(merges: Merges, flat: np.ndarray, lens: np.ndarray) -> list[str]:
    data = [merges.token_bytes[i] for i in flat.tolist()]
    end = np.cumsum(lens).tolist()
    return [b"".join(data[e - n:e]).decode("utf-8", "replace") for e, n in zip(end, lens.tolist())]


def decode(coded: DataFrame, path: str, keep: list[str]) -> DataFrame:
    """Add ``decoded`` (text) to the columns ``keep`` from ``ids``."""
    src = coded.select(*dict.fromkeys([*keep, "ids"]))

    def run(batches):
        merges = merges_of(path)
        for rb in batches:
            for i in range(0, rb.num_rows, 256):
                part = rb.slice(i, 256)
                ids = part.column(part.schema.get_field_index("ids"))
                lens = np.diff(ids.offsets.to_numpy())
                text = decode_ids(merges, ids.flatten().to_numpy(), lens)
                yield pa.RecordBatch.from_arrays([*part.select(keep).columns, pa.array(text, pa.string())],
                                                 names=[*keep, "decoded"])

    fields = ", ".join(f"`{c}` {src.schema[c].dataType.simpleString()}" for c in keep)
    return src.mapInArrow(run, f"{fields}, decoded string")


def round_trip(docs: DataFrame, path: str, automaton: bytes) -> DataFrame:
    """``doc_id``, ``n_tokens`` and the digests of the ids and of the decoded text.
    Each slice is encoded and decoded in one worker, so neither ids nor texts
    leave it, and a core needs one worker with one set of tables."""
    shared = docs.sparkSession.sparkContext.broadcast(automaton)
    sha = lambda data: hashlib.sha256(data).hexdigest()

    def run(batches):
        enc = Encoder(path, shared.value)
        for rb in common.sliced(batches, target=1 << 20):
            ids, n = enc.encode(common.texts_of(rb))
            end = np.cumsum(n).tolist()
            coded = [sha(",".join(map(str, ids[e - k:e].tolist())).encode()) for e, k in zip(end, n.tolist())]
            back = [sha(t.encode("utf-8", "surrogatepass")) for t in decode_ids(enc.merges, ids, n)]
            yield pa.RecordBatch.from_arrays([rb.column(0), pa.array(n), pa.array(coded), pa.array(back)],
                                             names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(
        run, f"doc_id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string")


def op6_bpe_lexicon(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers
    path = public_tokenizers.path("byte_bpe_50k.json")
    docs = common.documents(spark, sf_dir).select("doc_id", "text")
    return round_trip(docs, path, build_lexicon(docs, path))
