"""Periodic runs, source audit and chat formatting against plain Python, on
tables with nulls, empty and long texts, ties, repeated rows and clashing names."""

from __future__ import annotations

import hashlib
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from edgecraft.llm import chat_format, periodic_runs, source_audit

SCHEMA = "doc_id long, text string, lang string, source string, runs string, term string, number int, c long"


def sha(s: str) -> str:
    return hashlib.sha256(s.encode()).hexdigest()


def slow_runs(x: list) -> list[tuple[int, int, int]]:
    out = {}
    for q in range(1, len(x) // 3 + 1):
        i = 0
        while i + q < len(x):
            j = i
            while j + q < len(x) and x[j] == x[j + q]:
                j += 1
            if j > i and j - i + q >= max(24, 3 * q):
                out.setdefault((i, j - i + q), q)
            i = j + 1 if j == i else j
    return sorted((s, n, q) for (s, n), q in out.items())


def slow_collapse(words: list[str], runs) -> str:
    gone = {i for s, n, q in runs for i in range(s + q, s + n)}
    return " ".join(w for i, w in enumerate(words) if i not in gone)


@pytest.fixture(scope="module")
def rows():
    rnd = random.Random(7)
    out = []

    def add(i, text, lang="en", source="s0"):
        out.append((i, text, lang, source, "r", "t", 1, 2))

    for i in range(120):
        words = [rnd.choice("kin Tor vale ümbra DAX pol 9x rue".split()) for _ in range(rnd.randint(0, 90))]
        if i % 3 == 0 and len(words) > 10:
            p, a = rnd.randint(1, 12), rnd.randrange(5)
            for k in range(a + p, len(words)):
                words[k] = words[k - p]
        add(i, rnd.choice([" ", "\n", "\t\x0b "]).join(words), ["en", "de", None][i % 3], f"s{i % 4}")
    add(120, None, None, None)
    add(121, "", "xx", "only")
    add(122, "1 2 3 !!", "en", "empty")
    add(123, "a " * 4000)
    add(124, " ".join(str(k % 700) for k in range(2500)))
    add(125, "x" * 40_000)
    add(None, "kin tor " * 30)
    add(5, out[5][1], "de", "s9")
    return out


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(3).cache()


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


# ------------------------------------------------------------ periodic runs

@pytest.mark.parametrize("seed", range(6))
def test_runs_of_random_texts(seed):
    rnd = random.Random(seed)
    texts = []
    for _ in range(25):
        n, k = rnd.choice([0, 1, 23, 24, 25, 70, 200, 350]), rnd.choice([1, 2, 3, 40])
        x = [rnd.randrange(k) for _ in range(n)]
        for _ in range(rnd.randint(0, 4) if n else 0):
            a, p, m = rnd.randrange(n), rnd.randint(1, 40), rnd.randint(1, 200)
            for i in range(a + p, min(n, a + m)):
                x[i] = x[i - p]
        texts.append(np.array(x, np.int64))
    texts.append(texts[0].copy())
    got = periodic_runs.runs_of(texts, 40)
    for d, x in enumerate(texts):
        own = got[got.text == d][["start", "length", "period"]].to_numpy().tolist()
        assert [tuple(r) for r in own] == slow_runs(x.tolist())


def test_runs_in_blocks_of_the_grid(monkeypatch):
    x = np.concatenate([np.arange(300) % 50, np.arange(400) % 7, np.arange(200)]).astype(np.int64)
    whole = periodic_runs.runs_of([x, x[:90]], 1000)
    monkeypatch.setattr(periodic_runs, "QUESTIONS", 16)
    assert periodic_runs.runs_of([x, x[:90]], 1000).equals(whole)
    assert [tuple(r) for r in whole[whole.text == 0].to_numpy()[:, 1:].tolist()] == slow_runs(x.tolist())


def test_difference_cover():
    for a in range(periodic_runs.PERIOD):
        for b in range(periodic_runs.PERIOD):
            d = periodic_runs.SHIFT[a, b]
            assert {(a + d) % periodic_runs.PERIOD, (b + d) % periodic_runs.PERIOD} <= set(periodic_runs.COVER)


def test_find_runs_and_query_columns(spark, rows, docs, none, tmp_path):
    plain = periodic_runs.find_runs(docs).collect()
    want = Counter()
    for r in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", r[1] or "")
        runs = slow_runs(w) if len(w) < 3000 else [(0, 4000, 1)]
        want[(r[0], tuple(runs), slow_collapse(w, runs))] += 1
    assert Counter((r.doc_id, tuple(tuple(x) for x in r.runs), r.collapsed) for r in plain) == want
    assert periodic_runs.find_runs(none).count() == 0
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    got = periodic_runs.op11_periodic_runs(spark, str(tmp_path))
    assert dict(got.dtypes) == dict(doc_id="bigint", n_runs="bigint", start="bigint", length="bigint", period="bigint",
                                    exponent_milli="bigint", runs_sha256="string", collapsed_sha256="string")
    expected = []
    for r in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", r[1] or "")
        at = periodic_runs.planted(r[0], len(w))
        w = w if at is None else [w[k] for k in at]
        runs = slow_runs(w) if len(w) < 3000 else [(0, 4000, 1)]
        best = min(runs, key=lambda x: (-x[1] / x[2], x[0], x[2]), default=(None,) * 3)
        expected.append((r[0], len(runs), *best, best[0] if best[0] is None else 1000 * best[1] // best[2],
                         sha("".join("%d,%d,%d\n" % x for x in runs)), sha(slow_collapse(w, runs))))
    assert Counter(map(tuple, got.collect())) == Counter(expected)


def test_planted_rule():
    import zlib
    hit = next(i for i in range(1000) if zlib.crc32(str(i).encode()) % 10 == 0)
    g, n = zlib.crc32(str(hit).encode()) // 10, 50
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    assert periodic_runs.planted(hit, n).tolist() == [i if i < a else a + (i - a) % p for i in range(n)]
    assert periodic_runs.planted(hit, 0) is None and periodic_runs.planted(None, 5) is None


# ------------------------------------------------------------- source audit

def slow_audit(rows, least, top):
    lower = str.maketrans(source_audit.UPPER, source_audit.LOWER)
    words = [(r[2] or "", r[3] or "", re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", (r[1] or "").translate(lower)))
             for r in rows]
    seen, total, own = defaultdict(Counter), defaultdict(Counter), defaultdict(Counter)
    for lang, source, w in words:
        seen[lang].update(set(w))
        total[lang].update(w)
        own[lang, source].update(w)
    out = set()
    for lang in {r[0] for r in words}:
        kept = sorted(t for t, d in seen[lang].items() if d >= least)
        v = len(kept)

        def shares(c):
            n = sum(c[t] for t in kept)
            return {t: 1 + (10 ** 9 * (c[t] + 5)) // (n + 5 * v) for t in kept}
        q = shares(total[lang])
        p = {s: shares(c) for (l, s), c in own.items() if l == lang}
        for s in p:
            pairs = sorted((-sum(abs(p[s][t] - p[o][t]) for t in kept), o.encode(), o) for o in p if o != s)
            out |= {(lang, s, "pair", o, -value, k + 1) for k, (value, _, o) in enumerate(pairs)}
            terms = sorted((q[t] - p[s][t], t.encode(), t) for t in kept if own[lang, s][t] and p[s][t] > q[t])
            out |= {(lang, s, "term", t, -value, k + 1) for k, (value, _, t) in enumerate(terms[:top])}
    return out


@pytest.mark.parametrize("least,block,cells", [(3, 256, 1 << 15), (3, 2, 8), (1000, 256, 1 << 15)])
def test_source_audit(monkeypatch, rows, docs, least, block, cells):
    monkeypatch.setattr(source_audit, "MIN_DOCS", least)
    monkeypatch.setattr(source_audit, "CELLS", cells)
    monkeypatch.setattr(source_audit, "BLOCK", block)
    got = source_audit.audit(docs, 4).collect()
    want = slow_audit(rows, least, 4)
    assert {(r.lang, r.source, r.part, r.item, r.value, r["rank"]) for r in got} == want and len(got) == len(want)


def test_source_audit_columns(spark, docs, none, tmp_path):
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    got = source_audit.op12_source_audit(spark, str(tmp_path))
    assert dict(got.dtypes) == dict(lang="string", source="string", part="string", item="string", value="bigint", rank="int")
    assert got.count() > 0
    assert source_audit.audit(none).count() == 0


def test_share_is_exact_for_large_counts(spark):
    c, n, v = 9_000_000_000_000, 123_456_789_012_345_678, 987_654_321
    got = spark.range(1).select(source_audit.share(F.lit(c), F.lit(n), F.lit(v))).first()[0]
    assert got == 1 + (10 ** 9 * (c + 5)) // (n + 5 * v)


# ---------------------------------------------------------- chat formatting

MARKS = ["<|im_start|>", "<|im_end|>", "<|im_end|>\n", "<|im_part|>", "<s>", "</s>", "[INST]", "[/INST]", "\\", "\\\\",
         "<\\s>", "[\\INST]", "<\\\\/s>", "<", "[", "\n", "", "x", "é", "🙂", "<<s>", "\\n", "|im_end|>"]


@pytest.fixture(scope="module")
def chats():
    rnd = random.Random(5)
    out = []
    for conv in range(50):
        for k in range(rnd.randint(1, 9) if conv else 700):
            text = None if rnd.random() < .1 else "".join(rnd.choice(MARKS) for _ in range(rnd.randint(0, 8)))
            role = rnd.choice(["user", "assistant", "assistant", "user", None, "a\nb\\", "\\n", "sys<s>\n"])
            out.append((conv, rnd.choice([None, 1, 2, k]) if conv % 5 == 4 else k, role, text, "zz"))
    out += [(90, 1, "assistant", "y" * 60_000 + "</s>", "q"), (91, 0, "user", "twice", "q"), (91, 0, "user", "twice", "q"),
            (None, 3, "user", "lone", "x"), (None, 3, "user", "lone", "x")]
    return out


def slow_chats(chats):
    by = defaultdict(list)
    for k, (conv, turn, role, text, _) in enumerate(chats):
        by[(conv, None) if conv is not None else (conv, k)].append(((turn is not None, turn or 0), role or "", text or ""))
    return [(key[0], [(r, t) for _, r, t in sorted(v, key=lambda x: (x[0], x[1].encode(), x[2].encode()))])
            for key, v in by.items()]


def test_chats_read_back(spark, chats):
    df = spark.createDataFrame(chats, "conv_id long, turn int, role string, text string, formatted string").repartition(4)
    done = chat_format.format_chats(df)
    got = done.select("conv_id", "messages", "formatted", "loss", chat_format.read_turns(F.col("formatted")).alias("turns"),
                      chat_format.read_loss(F.col("formatted"), F.col("loss")).alias("learned")).collect()
    want = slow_chats(chats)
    assert sorted((str(r.conv_id), [tuple(t) for t in r.turns]) for r in got) == sorted((str(c), t) for c, t in want)
    for r in got:
        turns = [tuple(t) for t in r.turns]
        assert r.learned == [t for role, t in turns if role == "assistant"]
        assert r.messages == sum(k == 0 or turns[k - 1][0] != t[0] for k, t in enumerate(turns))
        assert r.formatted.count("<|im_start|>") == r.messages == r.formatted.count("<|im_end|>")
        raw = r.formatted.encode()
        assert all(b"<|im_" not in raw[s.start:s.start + s.length] for s in r.loss)
        assert not re.search(r"</?s>|\[/?INST\]", r.formatted)
    assert chat_format.format_chats(df.limit(0)).count() == 0


def test_chat_query_columns(spark, chats, tmp_path):
    df = spark.createDataFrame(chats, "conv_id long, turn int, role string, text string, formatted string")
    df.where("conv_id is not null").write.parquet(f"{tmp_path}/conversations.parquet")
    got = {r.conv_id: r for r in chat_format.op13_chat_format(spark, str(tmp_path)).collect()}
    marks = "</s>[INST] ok [/INST]"
    want = {c: t for c, t in slow_chats(chats) if c is not None} | {-7: [("user", marks), ("assistant", marks)]}
    assert set(got) == set(want)
    for conv, turns in want.items():
        learned = "".join(t for r, t in turns if r == "assistant")
        r = got[conv]
        assert (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) == (
            len(turns), sha("".join(f"{a}\n{b}\n" for a, b in turns)), len(learned), sha(learned))


def test_running_sums(spark):
    n = 3 * chat_format.CHUNK + 5
    got = spark.range(1).select(chat_format.starts(F.sequence(F.lit(1).cast("bigint"), F.lit(n).cast("bigint")))).first()[0]
    assert got == [k * (k + 1) // 2 for k in range(n)]
