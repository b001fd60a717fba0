"""Token sizes of the packing, band keys, and the memory of n-gram slices."""

from __future__ import annotations

import random
import tracemalloc

import numpy as np
import pyarrow as pa
import pytest

from edgecraft.llm import chargrams, common, packing, toxicity

WORDS = "river stone cloud it's we'll 漢字 Zürich 12345 !!! naïve 🙂 x\ty under\n\n seven".split(" ")


def some_texts(n, seed=5):
    rnd = random.Random(seed)
    letters = "etaoinshrdlu"
    made = [" ".join(rnd.choice(WORDS) if rnd.random() < 0.6 else "".join(rnd.choices(letters, k=rnd.randint(1, 9)))
                     for _ in range(rnd.randint(0, 80))) for _ in range(n)]
    return made + ["", "  \t ", "a" * 3000, "x<|endoftext|>y <|endoftext|>"]


@pytest.mark.parametrize("known", [packing.KNOWN, 8])
def test_token_sizes_are_the_librarys(monkeypatch, known):
    import public_tokenizers
    from tokenizers import Tokenizer
    path = public_tokenizers.path("byte_bpe_50k.json")
    library = Tokenizer.from_file(path)
    monkeypatch.setattr(packing, "KNOWN", known)             # 8: words drive each other out of the table
    sizes = packing.TokenSizes(path)
    texts = some_texts(120)
    want = [len(library.encode(t, add_special_tokens=False).ids) for t in texts]
    for part in (texts, texts[::-1], texts):
        assert sizes.count(part).tolist() == (want if part is texts else want[::-1])
    assert sizes.count([]).tolist() == [] and len(sizes.key) == known


def test_known_words_are_not_merged_again(monkeypatch):
    import public_tokenizers
    sizes = packing.TokenSizes(public_tokenizers.path("byte_bpe_50k.json"))
    merged = []
    inner = sizes.merges.merge
    monkeypatch.setattr(sizes.merges, "merge", lambda words: merged.extend(words) or inner(words))
    first = sizes.count(["stone stone river"]).tolist()
    assert sorted(merged) == [b" river", b" stone", b"stone"]
    assert sizes.count(["stone stone river"]).tolist() == first and len(merged) == 3


def test_band_keys_are_those_of_all_hash_values_at_once():
    rnd = np.random.default_rng(3)
    sets = [rnd.integers(0, 2 ** 63, n).astype(np.uint64) for n in (1, 7, 300, 2 * packing.TILE + 5)]
    low = np.array([packing._row_minima(h) for h in sets])
    for h, got, keys in zip(sets, low, packing._band_keys(low)):
        x = (h >> np.uint64(32)).astype(np.uint32)
        want = np.array([(x * o).min() for o in packing._ODD], np.uint32)
        assert (got == want).all()
        key = np.arange(1, packing.BANDS + 1, dtype=np.uint64)
        for column in want.reshape(packing.BANDS, packing.ROWS).T.astype(np.uint64):
            key = packing.mix(key * np.uint64(0x9E3779B97F4A7C15) + column)
        assert (keys == key.view(np.int64)).all()


def test_scores_of_a_task_take_little_memory_and_do_not_depend_on_slices():
    texts = [t for t in some_texts(14000, 8) if t]
    batch = pa.RecordBatch.from_pydict({"text": texts})
    assert sum(map(len, texts)) > 8 * chargrams.SLICE
    size = 1 << toxicity.BITS
    ratio = np.random.default_rng(1).normal(size=size)
    model = toxicity.ToxicityModel(ratio, ratio * 0.1, 0.1)

    def scores(target):
        return np.concatenate([toxicity.score_texts(model, common.texts_of(rb))
                               for rb in common.sliced([batch], target=target)])

    tracemalloc.start()
    got = scores(chargrams.SLICE)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 64 << 20                                    # 1 MB of text at once took more than 120 MB
    assert (got == scores(1 << 20)).all()


def test_fit_takes_little_memory_beside_its_features():
    texts = [t for t in some_texts(6000, 9) if t]
    labels = [i % 7 == 0 for i in range(len(texts))]
    ratio = np.random.default_rng(2).normal(size=1 << toxicity.BITS)
    tracemalloc.start()
    w, bias = toxicity.fit_linear([(texts, labels)], ratio, max_features=4_000_000, epochs=1, block=4096)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert np.isfinite(w).all() and np.isfinite(bias) and w.any()
    assert peak < 80 << 20                                    # features 16 MB; 188 MB before
    assert list(toxicity._runs([3, 3, 3, 9, 0, 1], 6)) == [(0, 2), (2, 1), (3, 1), (4, 2)]
    assert list(toxicity._runs([], 6)) == []
