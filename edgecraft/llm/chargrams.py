"""Hashed character n-grams of many texts at once (numpy)."""

from __future__ import annotations

import numpy as np

#: Text bytes whose n-grams are made at once: about 150 bytes of memory each.
SLICE = 1 << 18


def folded_codes(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Code points of all texts end to end (A-Z and the Latin-1 capitals in
    lower case) and the offset of each text."""
    c = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32).copy()
    upper = ((c >= 0x41) & (c <= 0x5A)) | ((c >= 0xC0) & (c <= 0xDE) & (c != 0xD7))
    c[upper] += 32
    off = np.zeros(len(texts) + 1, np.int64)
    np.cumsum([len(t) for t in texts], out=off[1:])
    return c, off


def gram_counts(texts: list[str], orders: tuple[int, ...], bits: int):
    """Distinct hashed n-grams of each text.

    Returns (document index, bucket, count) arrays in document order; a text
    shorter than an order has none of it.  Buckets are ``bits`` wide.
    """
    c, off = folded_codes(texts)
    lens = np.diff(off)
    wide = np.uint64 if len(texts) >= 1 << (32 - bits) else np.uint32
    doc = np.repeat(np.arange(len(texts), dtype=wide) << wide(bits), lens)
    left = np.repeat(off[1:], lens) - np.arange(len(c))       # characters to the end of the text
    keys, h = [], c * np.uint32(0x9E3779B1)
    for k in range(1, max(orders) + 1):
        if k > 1:
            if len(h) < 2:
                break
            h = h[:-1] * np.uint32(0x85EBCA6B) + c[k - 1:] * np.uint32(0xC2B2AE35)
            h ^= h >> np.uint32(15)
        if k in orders:
            inside = left[:len(h)] >= k
            bucket = (h * np.uint32(0x2C1B3C6D)) >> np.uint32(32 - bits)
            keys.append((doc[:len(h)] | bucket)[inside])
    key = np.sort(np.concatenate(keys)) if keys else np.zeros(0, wide)
    first = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1]))) if len(key) else np.zeros(0, np.int64)
    count = np.diff(np.append(first, len(key)))
    key = key[first]
    return (key >> wide(bits)).astype(np.int64), (key & wide((1 << bits) - 1)).astype(np.int64), count
