"""Byte-level pre-tokens of many texts at once.

The split rule of the public byte-level BPE files is
``'s|'t|'re|'ve|'m|'ll|'d| ?\\p{L}+| ?\\p{N}+| ?[^\\s\\p{L}\\p{N}]+|\\s+(?!\\S)|\\s+``.
Its matches are runs of one character class, up to one leading blank and the
contractions, so the start of every match follows from the classes of
neighbouring characters; numpy finds them for a whole batch.  The class of a
code point is asked from the tokenizer library once per process, so that the
Unicode version is always the library's.
"""

from __future__ import annotations

import numpy as np
import pandas as pd

LETTER, NUMBER, SPACE, OTHER = 1, 2, 3, 4


class CharClasses:
    """Class of each code point as the library's pre-tokenizer sees it."""

    def __init__(self):
        from tokenizers.pre_tokenizers import ByteLevel
        self._split = ByteLevel(add_prefix_space=False, use_regex=True).pre_tokenize_str
        self.table = np.zeros(0x110000, np.uint8)
        self.table[0x20] = SPACE          # the blank also leads other classes

    def _spans(self, text: str) -> list[tuple[int, int]]:
        return [span for _, span in self._split(text)]

    def _learn(self, cp: int) -> int:
        c = chr(cp)
        spans = self._spans(f"a{c}1")
        if (0, 2) in spans:
            return LETTER
        if (1, 3) in spans:
            return NUMBER
        return OTHER if (0, 3) in self._spans(f"!{c}!") else SPACE

    def of(self, codes: np.ndarray) -> np.ndarray:
        cls = self.table[codes]
        new = codes[cls == 0]
        if len(new):
            for cp in pd.unique(new):
                self.table[cp] = self._learn(int(cp))
            cls = self.table[codes]
        return cls


def token_starts(codes: np.ndarray, off: np.ndarray, cls: np.ndarray) -> np.ndarray:
    """Positions where a pre-token starts, for texts laid end to end."""
    n = len(codes)
    if not n:
        return np.zeros(0, np.int64)
    first = np.zeros(n + 1, bool)
    first[off] = True                      # text starts (and the end)
    run = first[:n].copy()
    run[1:] |= cls[1:] != cls[:-1]
    run_end = np.append(run[1:], True)     # last position of a run
    ends_text = first[1:]                  # last position of a text
    start = run.copy()
    # a run of white space that is followed by something gives up its last character
    give = np.flatnonzero(run_end & (cls == SPACE) & ~ends_text)
    start[give] = True
    blank = give[codes[give] == 0x20]
    start[blank + 1] = False               # a blank leads the next pre-token
    # contractions: an apostrophe that starts a pre-token
    a = np.flatnonzero(run & (codes == 0x27) & ~ends_text)
    a = a[start[a]]
    if len(a):
        nxt = codes[a + 1]
        one = np.isin(nxt, [ord(x) for x in "stmd"])
        after = codes[np.minimum(a + 2, n - 1)]
        has2 = ~ends_text[a + 1]
        two = has2 & (((nxt == ord("r")) & (after == ord("e"))) | ((nxt == ord("v")) & (after == ord("e")))
                      | ((nxt == ord("l")) & (after == ord("l"))))
        for hit, size in ((one, 2), (two, 3)):
            at = a[hit]
            start[at + 1] = False
            cut = at + size
            start[cut[cut < n]] = True
    return np.flatnonzero(start)


_POWERS = [np.ones(1, np.uint64), np.ones(1, np.uint64)]
_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_POWERS[0]) <= n:
        size = max(n + 1, 1 << 20)
        for i, base in enumerate((_BASE, _INVERSE)):
            p = np.full(size, base, np.uint64)
            p[0] = 1
            _POWERS[i] = np.cumprod(p, dtype=np.uint64)
    return _POWERS[0], _POWERS[1]


def mix(x: np.ndarray) -> np.ndarray:
    """64-bit finaliser."""
    x = x ^ (x >> np.uint64(33))
    x *= np.uint64(0xFF51AFD7ED558CCD)
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def span_hashes(units: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hash of each span of ``units`` (code points or bytes), equal for
    equal content wherever it stands."""
    n = len(units)
    power, inverse = _powers(n)
    table = units.astype(np.uint64)
    table = (table + np.uint64(1)) * np.uint64(0xD6E8FEB86659FD93)
    table ^= table >> np.uint64(32)
    total = np.zeros(n + 1, np.uint64)
    np.cumsum(table * power[:n], out=total[1:])
    h = (total[ends] - total[starts]) * inverse[starts]
    return mix(h + (ends - starts).astype(np.uint64) * np.uint64(0xA0761D6478BD642F))


def distinct_spans(whole: str, starts: np.ndarray, ends: np.ndarray, hashes: np.ndarray) -> tuple[np.ndarray, list[str]]:
    """Index of each span among the distinct ones, and these."""
    code, _ = pd.factorize(hashes)
    seen = np.zeros(code.max() + 1 if len(code) else 0, np.int64)
    seen[code[::-1]] = np.arange(len(code))[::-1]             # first place of each
    return code, [whole[s:e] for s, e in zip(starts[seen].tolist(), ends[seen].tolist())]


class Splitter:
    """Pre-tokens of a batch of texts, with added tokens cut out first."""

    def __init__(self, tokenizer_json: str):
        import json
        with open(tokenizer_json, encoding="utf-8") as f:
            conf = json.load(f)
        self.added = {t["content"]: t["id"] for t in conf["added_tokens"]}
        odd = [t["content"] for t in conf["added_tokens"] if t["single_word"] or t["lstrip"] or t["rstrip"]]
        pre = conf["pre_tokenizer"]
        if odd or conf["normalizer"] or pre["type"] != "ByteLevel" or pre["add_prefix_space"] or not pre["use_regex"]:
            raise ValueError("not a plain byte-level tokenizer file")
        self.classes = CharClasses()

    def pieces(self, texts: list[str]):
        """(pieces, text index of each piece, added id after each piece or -1)"""
        pieces, owner, after = texts, None, None
        if any(a in t for a in self.added for t in texts):
            import re
            cut = re.compile("(" + "|".join(map(re.escape, sorted(self.added, key=len, reverse=True))) + ")")
            pieces, owner, after = [], [], []
            for i, t in enumerate(texts):
                part = cut.split(t)
                for j in range(0, len(part), 2):
                    pieces.append(part[j])
                    owner.append(i)
                    after.append(self.added[part[j + 1]] if j + 1 < len(part) else -1)
        n = len(pieces)
        return (pieces, np.arange(n) if owner is None else np.asarray(owner, np.int64),
                np.full(n, -1) if after is None else np.asarray(after, np.int64))

    def spans(self, texts: list[str]):
        """(all texts end to end, start and end of each pre-token, hash of each,
        text index of each, added ids by text: (text index, position among
        pre-tokens, id))"""
        pieces, owner, after = self.pieces(texts)
        whole = "".join(pieces)
        codes = np.frombuffer(whole.encode("utf-32-le", "surrogatepass"), np.uint32)
        off = np.zeros(len(pieces) + 1, np.int64)
        np.cumsum([len(p) for p in pieces], out=off[1:])
        starts = token_starts(codes, off, self.classes.of(codes))
        ends = np.append(starts[1:], len(codes)) if len(starts) else starts
        piece_of = np.searchsorted(off, starts, side="right") - 1
        special = np.flatnonzero(after >= 0)
        place = np.searchsorted(starts, off[special + 1], side="left")
        return whole, starts, ends, span_hashes(codes, starts, ends), owner[piece_of], (owner[special], place, after[special])

    def words(self, texts: list[str]):
        """(distinct pre-tokens, index of each pre-token in them, text index of
        each, added ids by text: (text index, position among pre-tokens, id))"""
        whole, starts, ends, hashes, owner, special = self.spans(texts)
        code, distinct = distinct_spans(whole, starts, ends, hashes)
        return distinct, code, owner, special
