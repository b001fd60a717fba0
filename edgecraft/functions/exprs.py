"""Column-expression helpers. All JVM-side built-ins, so they stay inside
whole-stage codegen; no Python UDF anywhere in this module."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def col_or(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def hash_user_id(slug: str | Column, salt: str) -> Column:
    """First 16 hex chars of sha256("{salt}:{slug}") (pseudonymous user id)."""
    return F.substring(F.sha2(F.concat_ws(":", F.lit(salt), col_or(slug)), 256), 1, 16)


def clip(c: str | Column, lo: float, hi: float) -> Column:
    return F.least(F.greatest(col_or(c), F.lit(lo)), F.lit(hi))


def contest_number(contest_id: str | Column) -> Column:
    """Trailing digits of a contest id as an int, else 0."""
    digits = F.regexp_extract(col_or(contest_id).cast("string"), r"([0-9]+)$", 1)
    return F.coalesce(F.nullif(digits, F.lit("")).try_cast("int"), F.lit(0))


def dot(a: str | Column, b: str | Column) -> Column:
    """Inner product of two equal-length numeric arrays (null if either is null)."""
    prod = F.zip_with(col_or(a), col_or(b), lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(prod, F.lit(0.0), lambda acc, v: acc + v)


def title_from_slug(slug: str | Column) -> Column:
    """'3sum-closest' -> '3Sum Closest' (fallback when a title is missing): the
    first letter of every run of letters is upper-cased, the rest lowered."""
    runs = F.regexp_extract_all(F.regexp_replace(col_or(slug), "-", " "), F.lit(r"(\p{L}+|[^\p{L}]+)"), 1)
    return F.array_join(F.transform(runs, lambda r: F.concat(F.upper(F.substring(r, 1, 1)), F.lower(r.substr(F.lit(2), F.length(r))))), "")


def pct(x: str | Column) -> Column:
    """int(round(x * 100)) with Python-style half-to-even rounding."""
    return F.bround(col_or(x) * 100.0, 0).cast("int")


def tags_from_string(s: str | Column) -> Column:
    """Parse a stringified Python list "['a', 'b']" into array<string>."""
    return F.from_json(F.regexp_replace(col_or(s), "'", '"'), "array<string>")


def stable_round(c: str | Column, digits: int = 6) -> Column:
    """Round in plain IEEE steps (first to 9 places, then to ``digits``) so
    every engine that multiplies, adds 0.5 and floors gets identical bits.
    The floor stays a double (x minus its fraction), so it holds at any size."""
    def floor(y: Column) -> Column:
        return y - F.pmod(y, F.lit(1.0))

    s9, sd = 10.0 ** 9, 10.0 ** digits
    return floor(floor(col_or(c).cast("double") * s9 + 0.5) / s9 * sd + 0.5) / sd


def round_doubles(df, digits: int = 6):
    """Round every double / float column and widen every integral column to
    bigint (for engine-independent comparison of query results)."""
    out = []
    for f in df.schema.fields:
        t = f.dataType.typeName()
        if t in ("double", "float"):
            out.append(stable_round(f.name, digits).alias(f.name))
        elif t in ("byte", "short", "integer"):
            out.append(F.col(f.name).cast("long").alias(f.name))
        else:
            out.append(F.col(f.name))
    return df.select(*out)
