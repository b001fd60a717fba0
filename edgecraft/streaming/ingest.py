"""Resumable incremental ingest (A9) with Structured Streaming.

New JSONL page files dropped into a folder are parsed (A1), de-duplicated on
(contest, page, user) by streaming state, and written to a Parquet table.  The
checkpoint remembers which files were processed and which keys were seen, so a
restart skips both; ``trigger(availableNow=True)`` processes everything present
and stops.  The key space (contest, page, user) is bounded, so the state needs
no watermark.  Each micro-batch overwrites its own ``_batch`` partition, so a
batch replayed after a failure replaces itself; the table is never read back.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from edgecraft.sources.jsonl import parse_contest_lines

KEY = ["contest_id", "_page", "user_slug"]


def _write_batch(batch: DataFrame, batch_id: int, target: str) -> None:
    batch.write.mode("overwrite").parquet(f"{target}/_batch={batch_id}")


def start_ingest(spark: SparkSession, src_dir: str, target: str, checkpoint: str,
                 max_files_per_trigger: int = 100, pattern: str = "*.jsonl"):
    """Start the stream (returns the StreamingQuery)."""
    text = (spark.readStream.format("text").option("maxFilesPerTrigger", max_files_per_trigger)
            .option("pathGlobFilter", pattern).load(src_dir))
    parsed = parse_contest_lines(text).where(F.col("_corrupt_record").isNull()) \
        .drop("_corrupt_record").dropDuplicates(KEY)
    return (parsed.writeStream.foreachBatch(lambda b, i: _write_batch(b, i, target))
            .option("checkpointLocation", checkpoint).trigger(availableNow=True).start())


def run_ingest(spark: SparkSession, src_dir: str, target: str, checkpoint: str,
               pattern: str = "*.jsonl") -> DataFrame:
    """Process every file present, wait for completion and return the table."""
    q = start_ingest(spark, src_dir, target, checkpoint, pattern=pattern)
    q.awaitTermination()
    return spark.read.option("basePath", target).parquet(f"{target}/_batch=*")
