"""Chat formatting with DataFrame expressions only.

The turns of a conversation are collected as structs and sorted; stretches of
one role become one message whose texts are an array; messages are written with
the markers below and joined.  A message looks like::

    <|im_start|>role
    first text<|im_part|>second text<|im_end|>

so a merged message still tells where each turn began, and :func:`read_turns`
gives back every turn.  ``loss`` lists the places of the assistant texts as
(start, length) in UTF-8 bytes, so that each is cut out without walking the
text; markers are never inside.

Control strings inside texts and roles (the markers, and the sequence and
instruction marks of other templates) get a backslash after their first
character; where backslashes stand there already, one is added, so taking one
away restores every text.  In roles a line feed and a backslash are written as
two characters.

Edge cases: null texts and roles are empty, empty texts stay turns; turns are
sorted by (turn, role, text), null turns first, so ties and repeated rows keep
one order and all their rows; a row without ``conv_id`` is a conversation of its
own; an empty table gives no rows; extra columns are ignored.  The formatted
conversation is one value, so it must fit a row (2 GB); work on it is linear in
its turns and bytes.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

OPEN, PART, CLOSE = "<|im_start|>", "<|im_part|>", "<|im_end|>\n"
#: What may not stand inside a text as it is, after ``<`` and after ``[``.
ANGLE, SQUARE = r"\|im_start\|>|\|im_part\|>|\|im_end\|>|s>|/s>", r"INST\]|/INST\]"
TRAINED = "assistant"
CHUNK = 256


def escape(text: Column) -> Column:
    return F.regexp_replace(text, rf"(<(?=\\*(?:{ANGLE}))|\[(?=\\*(?:{SQUARE})))", r"$1\\")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, rf"(<(?=\\+(?:{ANGLE}))|\[(?=\\+(?:{SQUARE})))\\", "$1")


def escape_role(role: Column) -> Column:
    return escape(F.replace(F.replace(role, F.lit("\\"), F.lit("\\\\")), F.lit("\n"), F.lit("\\n")))


def unescape_role(role: Column) -> Column:
    pieces = F.split(unescape(role), r"\\\\", -1)
    return F.array_join(F.transform(pieces, lambda p: F.replace(p, F.lit("\\n"), F.lit("\n"))), "\\")


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, also when used inside lambdas."""
    return F.element_at(F.transform(F.array(value), body), 1)


def merged(turns: Column) -> Column:
    """Messages ``(role, texts)`` from sorted turns: adjacent turns of one role
    are one message."""
    def build(t: Column) -> Column:
        first = F.filter(F.sequence(F.lit(1), F.size(t)), lambda i: (i == 1) | (
            F.get(t, i - 1)["role"] != F.get(t, i - 2)["role"]))
        return let(first, lambda s: F.transform(
            F.arrays_zip(s.alias("a"), F.concat(F.slice(s, 2, F.size(s)), F.array(F.size(t) + 1)).alias("b")),
            lambda r: F.struct(F.get(t, r["a"] - 1)["role"].alias("role"),
                               F.transform(F.slice(t, r["a"], r["b"] - r["a"]), lambda x: x["text"]).alias("texts"))))
    return let(turns, build)


def segments(messages: Column) -> Column:
    """The formatted text in pieces ``(text, loss)``."""
    def piece(text, loss=F.lit(False)):
        return F.struct(text.alias("text"), loss.alias("loss"))

    def message(m):
        def text(x, i):
            own = piece(escape(x), m["role"] == TRAINED)
            return F.when(i == 0, F.array(own)).otherwise(F.array(piece(F.lit(PART)), own))
        return F.concat(F.array(piece(F.concat(F.lit(OPEN), escape_role(m["role"]), F.lit("\n")))),
                        F.flatten(F.transform(m["texts"], text)), F.array(piece(F.lit(CLOSE))))
    return F.flatten(F.transform(messages, message))


def _sums(values: Column, base: Column) -> Column:
    """Sums of what stands before each value, from ``base`` on."""
    start = F.struct(base.alias("at"), F.array().cast("array<bigint>").alias("all"))
    return F.aggregate(values, start, lambda a, x: F.struct((a["at"] + x).alias("at"), F.concat(
        a["all"], F.array(a["at"])).alias("all")), lambda a: a["all"])


def starts(lengths: Column) -> Column:
    """Start of each piece, in two levels, since appending to an array copies it."""
    def build(n: Column) -> Column:
        chunks = F.transform(F.sequence(F.lit(0), F.floor((F.size(n) - 1) / CHUNK).cast("int")),
                             lambda c: F.slice(n, c * CHUNK + 1, CHUNK))
        return let(chunks, lambda ch: F.flatten(F.zip_with(
            ch, _sums(F.transform(ch, lambda c: F.aggregate(c, F.lit(0).cast("bigint"), lambda a, x: a + x)),
                      F.lit(0).cast("bigint")), _sums)))
    return let(lengths, build)


def loss_spans(pieces: Column) -> Column:
    def build(p: Column) -> Column:
        size = F.transform(p, lambda x: F.octet_length(x["text"]).cast("bigint"))
        placed = F.zip_with(p, starts(size), lambda x, at: F.struct(
            at.alias("start"), F.octet_length(x["text"]).cast("bigint").alias("length"), x["loss"].alias("loss")))
        return F.transform(F.filter(placed, lambda x: x["loss"]),
                           lambda x: F.struct(x["start"].alias("start"), x["length"].alias("length")))
    return let(pieces, build)


def conversations(rows: DataFrame) -> DataFrame:
    """``conv_id`` and its sorted ``turns`` from rows (conv_id, turn, role, text)."""
    turn = F.struct(F.col("turn").cast("long").alias("turn"), F.coalesce("role", F.lit("")).alias("role"),
                    F.coalesce("text", F.lit("")).alias("text"))
    known = rows.where("conv_id is not null").groupBy("conv_id").agg(F.sort_array(F.collect_list(turn)).alias("turns"))
    alone = rows.where("conv_id is null").select("conv_id", F.array(turn).alias("turns"))
    return known.unionByName(alone)


def format_chats(rows: DataFrame) -> DataFrame:
    """``conv_id``, ``messages`` (number after merging), ``formatted`` text and ``loss`` spans."""
    pieces = conversations(rows).select("conv_id", merged(F.col("turns")).alias("m")) \
        .select("conv_id", F.size("m").cast("long").alias("messages"), segments(F.col("m")).alias("p"))
    return pieces.select("conv_id", "messages", F.array_join(F.transform("p", lambda x: x["text"]), "").alias("formatted"),
                         loss_spans(F.col("p")).alias("loss"))


def read_turns(formatted: Column) -> Column:
    """Turns ``(role, text)`` read back from a formatted conversation."""
    def message(m):
        role = F.substring_index(m, "\n", 1)
        texts = F.split(F.substring(m, F.length(role) + 2, F.length(m)), PART.replace("|", r"\|"), -1)
        return let(unescape_role(F.substring(role, F.lit(len(OPEN) + 1), F.length(role))), lambda r: F.transform(
            texts, lambda x: F.struct(r.alias("role"), unescape(x).alias("text"))))

    split = F.split(formatted, CLOSE.replace("|", r"\|"), -1)
    return F.flatten(F.transform(let(split, lambda s: F.slice(s, 1, F.size(s) - 1)), message))


def read_loss(formatted: Column, loss: Column) -> Column:
    """Texts under the loss mask, as they were before escaping."""
    return let(formatted.cast("binary"), lambda b: F.transform(loss, lambda s: unescape(
        F.substring(b, (s["start"] + 1).cast("int"), s["length"].cast("int")).cast("string"))))


def digest(texts: Column) -> Column:
    return F.sha2(F.array_join(texts, "").cast("binary"), 256)


def op13_chat_format(spark, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    added = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"),
                                  F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"),
                                  F.lit("</s>[INST] ok [/INST]").alias("text"))
    done = format_chats(rows.withColumn("conv_id", F.col("conv_id").cast("long")).unionByName(added))
    back = done.select("conv_id", F.length("formatted").cast("long").alias("formatted_chars"), "messages",
                       read_turns(F.col("formatted")).alias("turns"),
                       read_loss(F.col("formatted"), F.col("loss")).alias("learned"))
    return back.select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"),
        digest(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n")))).alias("turns_sha256"),
        F.length(F.array_join("learned", "")).cast("long").alias("loss_chars"),
        digest(F.col("learned")).alias("loss_sha256"), "formatted_chars", F.col("messages").alias("n_messages"))


OP13_SQL = r"""
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]'
  UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'),
e AS (
  SELECT *, row_number() OVER w AS i,
    CASE WHEN lag(role) OVER w = role THEN 0 ELSE 1 END AS opens,
    regexp_replace(regexp_replace(text,
      '<(\\*(?:\|im_start\|>|\|im_part\|>|\|im_end\|>|s>|/s>))', '<\\\1', 'g'),
      '\[(\\*(?:INST\]|/INST\]))', '[\\\1', 'g') AS safe,
    regexp_replace(regexp_replace(replace(replace(role, '\', '\\'), chr(10), '\n'),
      '<(\\*(?:\|im_start\|>|\|im_part\|>|\|im_end\|>|s>|/s>))', '<\\\1', 'g'),
      '\[(\\*(?:INST\]|/INST\]))', '[\\\1', 'g') AS safe_role
  FROM c WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text))
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY i)) AS turns_sha256,
  CAST(coalesce(sum(CASE WHEN role = 'assistant' THEN length(text) END), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(CASE WHEN role = 'assistant' THEN text END, '' ORDER BY i), '')) AS loss_sha256,
  CAST(sum(length(safe) + CASE WHEN opens = 1 THEN length(safe_role) + 24 ELSE 11 END) AS BIGINT) AS formatted_chars,
  CAST(sum(opens) AS BIGINT) AS n_messages
FROM e GROUP BY conv_id"""
