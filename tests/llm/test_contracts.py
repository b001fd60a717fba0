"""The registered queries on a table with nulls, empty and long texts and
repeated rows: names, types and every column that plain Python can restate."""

from __future__ import annotations

import hashlib
import math
import re
import zlib
from collections import Counter

import pytest

from edgecraft.llm import queries

from test_operators import bpe, docs, none, rows  # noqa: F401  (fixtures)


def sha(s: str) -> str:
    return hashlib.sha256(s.encode()).hexdigest()


def rest(doc_id) -> int | None:
    return None if doc_id is None else zlib.crc32(str(doc_id).encode()) % 5


@pytest.fixture(scope="module")
def table(spark, rows, docs, tmp_path_factory):  # noqa: F811
    d = str(tmp_path_factory.mktemp("contract"))
    docs.write.parquet(f"{d}/documents.parquet")
    toxic = [(r[0], 1, int(any(w in (r[1] or "") for w in ("blockhead", "numskull")))) for r in rows if r[0] is not None]
    spark.createDataFrame(toxic, "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    return d


def run(spark, name, table):
    df = queries.QUERIES[name](spark, table)
    return dict(df.dtypes), df.collect()


def test_op2(spark, table, rows):  # noqa: F811
    types, got = run(spark, "op2_toxicity", table)
    assert {k: types[k] for k in ("doc_id", "held_out", "score", "predicted")} == dict(
        doc_id="bigint", held_out="boolean", score="double", predicted="int")
    assert Counter(r.doc_id for r in got) == Counter(r[0] for r in rows)
    for r in got:
        assert r.held_out == (None if r.doc_id is None else rest(r.doc_id) == 0) or r.doc_id is None
        assert 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5)


def test_op3(spark, table, rows, bpe):  # noqa: F811
    from tokenizers import Tokenizer
    lib = Tokenizer.from_file(bpe)
    lib.no_truncation()
    lib.no_padding()
    types, got = run(spark, "op3_token_counts", table)
    assert {k: types[k] for k in ("doc_id", "n_bytes", "n_tokens", "over_limit")} == dict(
        doc_id="bigint", n_bytes="bigint", n_tokens="bigint", over_limit="boolean")
    want = Counter()
    for r in rows:
        n = len(lib.encode(r[1] or "", add_special_tokens=False).ids)
        want[r[0], len((r[1] or "").encode()), n, n > 1024] += 1
    assert Counter((r.doc_id, r.n_bytes, r.n_tokens, r.over_limit) for r in got) == want


def test_op4(spark, table, rows):  # noqa: F811
    kinds = (("assign", r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""),
             ("access", r"AKIA[A-Z0-9]+"), ("hex", r"[0-9a-f]+"))
    least = {"assign": 6, "access": 20, "hex": 24}
    types, got = run(spark, "op4_secret_scan", table)
    assert types["n_assign"] == types["n_access"] == types["n_hex"] == "bigint"
    want = Counter()
    for r in rows:
        spans = []
        for order, (kind, pattern) in enumerate(kinds):
            for m in re.finditer(pattern, r[1] or ""):
                if len(m.group(1) if kind == "assign" else m.group()) >= least[kind]:
                    spans.append((m.start(), order, kind, m.end()))
        count = Counter(s[2] for s in spans)
        text = ",".join(f"{k}:{a}:{e}" for a, _, k, e in sorted(spans))
        want[r[0], count["assign"], count["access"], count["hex"], sha(text)] += 1
    assert Counter((r.doc_id, r.n_assign, r.n_access, r.n_hex, r.base_sha256) for r in got) == want
    assert all(r.n_assign + r.n_access + r.n_hex <= len([s for s in r.spans.split(",") if s]) for r in got)


def test_op6(spark, table, rows, bpe):  # noqa: F811
    from tokenizers import Tokenizer
    lib = Tokenizer.from_file(bpe)
    lib.no_truncation()
    lib.no_padding()
    types, got = run(spark, "op6_bpe_lexicon", table)
    assert types == dict(doc_id="bigint", n_tokens="bigint", ids_sha256="string", decoded_sha256="string")
    want = Counter()
    for r in rows:
        ids = lib.encode(r[1] or "", add_special_tokens=False).ids
        want[r[0], len(ids), sha(",".join(map(str, ids))), sha(lib.decode(ids, skip_special_tokens=False))] += 1
    assert Counter(map(tuple, got)) == want


def test_op7(spark, table, rows):  # noqa: F811
    _, got = run(spark, "op7_order_minhash", table)
    known = sorted(((r[0], r[1] or "") for r in rows if r[0] is not None), key=lambda x: (-x[0], x[1]))
    order = known + [(None, r[1] or "") for r in rows if r[0] is None]
    want = Counter()
    for k, (doc_id, text) in enumerate(order):
        following, third = order[(k + 1) % len(order)][1], len(text) // 3
        edited = text[:len(text) - third] + following[:min(third, len(following))]
        want[doc_id, len(text), sha(edited)] += 1
    assert Counter((r.doc_id, r.n_chars, r.edited_sha256) for r in got) == want
    assert all(0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1 for r in got)


def test_op9(spark, table, rows):  # noqa: F811
    _, got = run(spark, "op9_katz_backoff", table)
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    words = [(r[0], re.findall(r"[^\x20\x09-\x0D]+", (r[1] or "").translate(lower)) + [None]) for r in rows]
    held = {i for i, _ in words if rest(i) == 1}
    c = Counter(w for i, ws in words if i is not None and i not in held for w in ws)
    n, v = sum(c.values()), len(c)
    for r in got:
        if r.doc_id is None:
            continue
        own = [ws for i, ws in words if i == r.doc_id]
        base = {round(sum(math.log10((c[w] + .5) / (n + .5 * (v + 1))) for w in ws), 6) for ws in own}
        assert r.held_out == (r.doc_id in held) and r.train_tokens in (n, n + sum(len(ws) for i, ws in words if i is None))
        if r.train_tokens == n:
            assert round(r.base_score, 6) in base or min(abs(r.base_score - b) for b in base) < 1e-4
        assert r.n_tokens in {len(ws) for ws in own} and r.score < 0


def test_op10(spark, table, rows):  # noqa: F811
    types, got = run(spark, "op10_language_id", table)
    assert types["lang_pred"] == "string" and types["score"] == "double"
    text = {}
    for r in rows:
        text.setdefault(r[0], []).append(r[1] or "")
    learned = {r[2] for r in rows if r[2] is not None}
    for r in got:
        bare = not any(any(ch.isalpha() for ch in t) for t in text[r.doc_id])
        assert (r.lang_pred == "und") == bare and (bare or r.lang_pred in learned) and 0 <= r.score <= 1


def test_redaction_tells_missing_ids_apart(spark):
    from edgecraft.llm import secrets
    docs = spark.createDataFrame([(None, "5\x1ftoken = abcdefgh1"), (5, "token = abcdefgh1"), (5, None)], "doc_id long, text string")
    got = {(r.doc_id, r.text) for r in secrets.redact(docs, ["doc_id", "text"]).collect()}
    assert got == {(None, "5\x1f[SECRET]"), (5, "[SECRET]"), (5, None)}
