"""Contest JSONL scans (A1-A5).

The parser takes any DataFrame with a ``value`` text column, so the same code
reads files (``spark.read.text``) and text Spark derived from tables.  The
schema is explicit; nothing is inferred.  Submission values are first read as
raw JSON text so a non-object value is skipped on its own instead of turning
the whole record into a corrupt one (the reference skips such values).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

CORRUPT = "_corrupt_record"

SUBMISSION_SCHEMA = T.StructType([
    T.StructField("fail_count", T.LongType()),
    T.StructField("lang", T.StringType()),
    T.StructField("date", T.LongType()),
])

RECORD_SCHEMA = T.StructType([
    T.StructField("contest_id", T.StringType()),
    T.StructField("user_slug", T.StringType()),
    T.StructField("rank", T.StringType()),
    T.StructField("country_name", T.StringType()),
    T.StructField("data_region", T.StringType()),
    T.StructField("score", T.LongType()),
    T.StructField("finish_time", T.LongType()),
    T.StructField("submissions", T.MapType(T.StringType(), T.StringType())),
    T.StructField("_page", T.LongType()),
    T.StructField("_empty", T.BooleanType()),
    T.StructField(CORRUPT, T.StringType()),
])


#: a text rank that is not a whole number
ODD_RANK = r'"rank"\s*:\s*"(?!\s*[+-]?\d+\s*")'


def once(expr: Column) -> Column:
    """The expression as a generator of one row: conditions on its result are not
    pushed below it, where each would work it out again."""
    return F.explode(F.array(expr))


def parse_contest_lines(text: DataFrame) -> DataFrame:
    """A1: ``value`` lines -> contest records plus ``_corrupt_record``.

    Blank lines are skipped; unparsable lines keep only ``_corrupt_record``
    (and ``file_name`` when present) so A4 can audit them.
    """
    keep = [c for c in ("file_name",) if c in text.columns]
    lines = text.where(F.length(F.trim(F.col("value"))) > 0)
    parsed = lines.select(*keep, "value", once(F.from_json(
        F.col("value"), RECORD_SCHEMA, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": CORRUPT})).alias("r")) \
        .select(*keep, "r", F.col("value").rlike(ODD_RANK).alias("_odd"))
    # a rank given as text counts only when it is a whole number; as a number it is truncated later
    r = parsed.select(*keep, "r.*", "_odd")
    return r.withColumn("rank", F.when(~F.coalesce("_odd", F.lit(False)), F.col("rank"))).drop("_odd")


def good_records(records: DataFrame) -> DataFrame:
    return records.where(F.col(CORRUPT).isNull())


def read_contest_dir(spark: SparkSession, path: str, pattern: str = "*.jsonl") -> DataFrame:
    """A2: every ``*.jsonl`` file in a folder; file name kept from metadata; a
    folder without one is an error."""
    if not any_file(spark, path, pattern):
        raise FileNotFoundError(f"no {pattern} in {path}")
    text = (spark.read.format("text").option("pathGlobFilter", pattern).load(path)
            .select("value", F.col("_metadata.file_name").alias("file_name")))
    return parse_contest_lines(text)


def any_file(spark: SparkSession, path: str, pattern: str = "") -> bool:
    """Whether a path (or a pattern in it) exists in the store that Spark reads."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path.rstrip('/')}/{pattern}" if pattern else path)
    return len(p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(p) or []) > 0


def limit_records(records: DataFrame, n: int, order: tuple[str, ...] = ("_page", "user_slug")) -> DataFrame:
    """A3: the first ``n`` parsed source records by ``order`` (bad lines do not
    count), the same ones on every run."""
    return good_records(records).orderBy(*order).limit(n)


def bad_record_audit(records: DataFrame) -> DataFrame:
    """A4: unparsable lines per file (one row when there is no file name)."""
    keys = [c for c in ("file_name",) if c in records.columns]
    bad = records.where(F.col(CORRUPT).isNotNull())
    if keys:
        return bad.groupBy(*keys).agg(F.count("*").alias("bad_lines"))
    return bad.agg(F.count("*").alias("bad_lines"))


def combine_files(spark: SparkSession, src: str, dst: str, pattern: str = "*.jsonl") -> None:
    """A5: concatenate JSONL files; the output is a folder of part files
    (no single-file funnel through one task)."""
    (spark.read.format("text").option("pathGlobFilter", pattern).load(src)
     .write.mode("overwrite").text(dst))
