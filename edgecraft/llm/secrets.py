"""Secret scans with multipart credential linking.

1. One pass over the texts finds the parts: the three base kinds (assignment,
   access identifier, hex run), which are always reported, and weak
   candidates, which are not: mixed base64-like runs (``key``) and host names
   or URLs (``host``).
2. Each part becomes an interval (a *scope*, ``SCOPE`` code points to either
   side).  Weak candidates are interval-joined to the identifiers, secrets and
   hosts of their own document by an equi-join on (document, scope-sized
   block, neighbours included) and an overlap test.
3. A weak ``key`` is reported when an access identifier stands in its scope; a
   ``host`` when an access identifier and a secret (assignment, hex run or
   key) both do.

Only the parts are shuffled, never the texts; they are checkpointed, so the
texts are scanned once.

Edge cases: null text is empty (no spans, the digest of the empty string);
repeated rows are told apart by a row number and stay; null ids pass through;
equal starts are ordered by kind; extra columns are ignored.
"""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from edgecraft.llm import common

SCOPE = 400
KINDS = ("assign", "access", "hex", "key", "host")      # order of equal starts
BASE = KINDS[:3]
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
                    re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
HEX = re.compile(r"[0-9a-f]{24,}")
KEY = re.compile(r"[A-Za-z0-9+/]{40,}={0,2}")
HOST = re.compile(r"(?:https?|s3|ftp|postgres|mysql|mongodb|redis|amqp)://[^\s\"'<>]+|"
                  r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.(?:amazonaws|googleapis|azure|windows)\.(?:com|net)")


def find_parts(text: str) -> list[tuple[int, int, int]]:
    """(kind index, start, end) of every part, code points, end exclusive."""
    out = [(0, m.start(), m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 6]
    out += [(1, m.start(), m.end()) for m in ACCESS.finditer(text)] if "AKIA" in text else []
    out += [(2, m.start(), m.end()) for m in HEX.finditer(text)]
    out += [(3, m.start(), m.end()) for m in KEY.finditer(text)
            if re.search("[a-z]", m[0]) and re.search("[A-Z]", m[0]) and re.search("[0-9]", m[0])]
    out += [(4, m.start(), m.end()) for m in HOST.finditer(text)] if "://" in text or "." in text else []
    return out


def scan(docs: DataFrame, keep: list[str]) -> DataFrame:
    """``keep``, ``row`` (long, unique) and ``parts`` of every document;
    checkpointed."""
    src = docs.select(*dict.fromkeys([*keep, "text"])).withColumn("row", F.monotonically_increasing_id())
    kind = pa.list_(pa.struct([("kind", pa.int32()), ("start", pa.int32()), ("end", pa.int32())]))

    def run(batches):
        for rb in common.sliced(batches):
            parts = [[{"kind": k, "start": s, "end": e} for k, s, e in find_parts(t)] for t in common.texts_of(rb)]
            yield pa.RecordBatch.from_arrays(
                [*rb.select([*keep, "row"]).columns, pa.array(parts, kind)], names=[*keep, "row", "parts"])

    fields = ", ".join(f"`{c}` {src.schema[c].dataType.simpleString()}" for c in keep)
    return common.checkpoint(src.mapInArrow(
        run, f"{fields}{', ' if keep else ''}row long, parts array<struct<kind:int,start:int,end:int>>"))


def link_weak(scanned: DataFrame, scope: int = SCOPE) -> DataFrame:
    """(row, kind, start, end) of the weak candidates whose complementary
    parts co-occur in their scope."""
    weak_docs = scanned.where(F.exists("parts", lambda p: p.kind >= 3) & F.exists("parts", lambda p: p.kind == 1))
    part = weak_docs.select("row", F.explode("parts").alias("p")).select("row", "p.kind", "p.start", "p.end")
    block = lambda c: F.floor(c / F.lit(scope))
    # candidate: the blocks its scope covers; partner: the block it starts in.  A partner
    # overlaps the scope when start < end + scope and end > start - scope; long partners
    # are placed in every block they touch.
    weak = part.where(part.kind >= 3).select(
        "row", "kind", "start", "end",
        F.explode(F.sequence(block(F.col("start") - scope), block(F.col("end") + scope))).alias("block"))
    full = part.select("row", F.col("kind").alias("p_kind"), F.col("start").alias("p_start"), F.col("end").alias("p_end"),
                       F.explode(F.sequence(block(F.col("start")), block(F.col("end")))).alias("block"))
    hit = weak.join(full, ["row", "block"]).where(
        (F.col("p_start") < F.col("end") + scope) & (F.col("p_end") > F.col("start") - scope)
        & ~((F.col("kind") == F.col("p_kind")) & (F.col("start") == F.col("p_start"))))
    seen = hit.groupBy("row", "kind", "start", "end").agg(
        F.max((F.col("p_kind") == 1).cast("int")).alias("ident"),
        F.max(F.col("p_kind").isin(0, 2, 3).cast("int")).alias("secret"))
    return seen.where((F.col("ident") == 1) & ((F.col("kind") == 3) | (F.col("secret") == 1))).select(
        "row", "kind", "start", "end")


def find_secrets(docs: DataFrame, keep: list[str], scope: int = SCOPE) -> DataFrame:
    """``keep`` and ``spans``: array of (start, kind index, end), ordered, of the
    base spans and the linked weak candidates."""
    scanned = scan(docs, keep)
    span = lambda s, k, e: F.struct(s.alias("start"), k.alias("kind"), e.alias("end"))
    base = F.transform(F.filter("parts", lambda p: p.kind < 3), lambda p: span(p.start, p.kind, p.end))
    linked = (link_weak(scanned, scope).groupBy("row")
              .agg(F.collect_list(span(F.col("start"), F.col("kind"), F.col("end"))).alias("linked")))
    return (scanned.select(*keep, "row", base.alias("base")).join(linked, "row", "left")
            .select(*keep, F.array_sort(F.concat("base", F.coalesce("linked", F.expr("slice(base, 1, 0)")))).alias("spans")))


def spans_text(spans):
    names = F.array(*map(F.lit, KINDS))
    return F.concat_ws(",", F.transform(spans, lambda s: F.concat_ws(
        ":", F.element_at(names, s.kind + 1), s.start.cast("string"), s.end.cast("string"))))


def count_kind(k: int):
    return F.size(F.filter("spans", lambda s: s.kind == k)).cast("long")


def op4_secret_scan(spark, sf_dir: str) -> DataFrame:
    found = find_secrets(common.documents(spark, sf_dir).select("doc_id", "text"), ["doc_id"])
    base = F.filter("spans", lambda s: s.kind < 3)
    return found.select("doc_id", *(count_kind(k).alias(f"n_{KINDS[k]}") for k in range(3)),
                        F.sha2(spans_text(base).cast("binary"), 256).alias("base_sha256"),
                        spans_text(F.col("spans")).alias("spans"))


def redact(docs: DataFrame, columns: list[str], mark: str = "[SECRET]", scope: int = SCOPE) -> DataFrame:
    """``columns`` of the documents with every reported span replaced by
    ``mark`` (overlapping spans together); ``n_chars`` follows the new text.
    Texts without a span stay as they are.  Documents are keyed by a digest of
    id and text: equal rows have equal spans."""
    key = F.md5(F.concat_ws("\x1f", F.coalesce(F.col("doc_id").cast("string"), F.lit("-")), F.coalesce("text", F.lit("")))
                .cast("binary"))
    scanned = scan(docs.select("doc_id", "text", key.alias("key_")), ["key_"])
    linked = common.checkpoint(
        link_weak(scanned, scope).join(scanned.select("row", "key_"), "row").groupBy("key_")
        .agg(F.collect_set(F.struct("start", "end")).alias("linked_")))
    linked = common.broadcast_if_small(linked, linked.count(), 256)
    joined = (docs.select(*columns, key.alias("key_")).join(linked, "key_", "left")
              .select(*columns, F.coalesce("linked_", F.expr("array()")).alias("linked_")))

    def clean(text: str, more: list[dict]) -> str:
        spans = sorted([(s, e) for k, s, e in find_parts(text) if k < 3] + [(m["start"], m["end"]) for m in more])
        out, at = [], 0
        for s, e in spans:
            if s >= at:
                out += [text[at:s], mark]
            at = max(at, e)
        return "".join(out) + text[at:] if spans else text

    def run(batches):
        for rb in common.sliced(batches):
            old = rb.column(rb.schema.get_field_index("text")).to_pylist()
            new = [None if t is None else clean(t, m)
                   for t, m in zip(old, rb.column(rb.schema.get_field_index("linked_")).to_pylist())]
            cols = {c: rb.column(rb.schema.get_field_index(c)) for c in columns}
            cols["text"] = pa.array(new, pa.string())
            if "n_chars" in cols:
                kind = cols["n_chars"].type
                cols["n_chars"] = pa.array([n if a is b or a == b else len(b) for a, b, n in
                                            zip(old, new, cols["n_chars"].to_pylist())], kind)
            yield pa.RecordBatch.from_pydict(cols)

    fields = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in columns)
    return joined.mapInArrow(run, fields)
