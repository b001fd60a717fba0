"""Token counts through a digest cache.

The cache is a Parquet table (``digest``, ``version``, ``n_tokens``): SHA-256
of the normalised content, digest of the tokenizer file, count.  A run joins
the digests of its texts to the table, encodes only the distinct texts that
miss, appends their counts and joins the counts back.  Texts are reduced to
one per digest before and after the shuffle, so copies are encoded once; the
final joins carry digests only.

Misses are counted by the tokenizer library over the distinct pre-tokens of a
batch (the byte-level merges never cross a pre-token), remembered per process
up to ``MEMO`` entries.

Edge cases: null text counts as empty (0 bytes, 0 tokens); repeated rows keep
their rows; null ids pass through; a cache row written twice is read once;
extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import os
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from edgecraft.llm import common
from edgecraft.llm.pretokens import Splitter
from edgecraft.session import checkpoint_dir

MEMO = 300_000
CACHE_SCHEMA = "digest binary, version string, n_tokens long"


def tokenizer_version(path: str) -> str:
    with open(path, "rb") as f:
        return hashlib.sha256(f.read()).hexdigest()


class Counter:
    """Token counts of texts, equal to ``len(encode(text).ids)``."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer
        self.library = Tokenizer.from_file(path)
        self.splitter = Splitter(path)
        self.memo: dict[str, int] = {}

    def count(self, texts: list[str]) -> np.ndarray:
        distinct, code, owner, special = self.splitter.words(texts)
        n = list(map(self.memo.get, distinct))
        new = [w for w, k in zip(distinct, n) if k is None]
        if new:
            got = [len(e.ids) for e in self.library.encode_batch_fast(new, add_special_tokens=False)]
            if len(self.memo) + len(new) > MEMO:
                self.memo.clear()
            self.memo.update(zip(new, got))
            got = iter(got)
            n = [next(got) if k is None else k for k in n]
        per_word = np.asarray(n, np.int64)
        out = np.bincount(owner, weights=per_word[code], minlength=len(texts)) if len(code) else np.zeros(len(texts))
        return out.astype(np.int64) + np.bincount(special[0], minlength=len(texts))


_COUNTERS: dict[str, Counter] = {}


def counter(path: str) -> Counter:
    if path not in _COUNTERS:
        _COUNTERS[path] = Counter(path)
    return _COUNTERS[path]


def read_cache(spark, cache: str, version: str) -> DataFrame:
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(cache)
    fs = hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(hadoop):
        return spark.createDataFrame([], CACHE_SCHEMA).select("digest", "n_tokens")
    return (spark.read.schema(CACHE_SCHEMA).parquet(cache).where(F.col("version") == version)
            .groupBy("digest").agg(F.max("n_tokens").alias("n_tokens")))


def count_tokens(docs: DataFrame, tokenizer: str, cache: str, keep: list[str], normalize=None,
                 slice_bytes: int = 1 << 22) -> DataFrame:
    """Add ``n_bytes`` and ``n_tokens`` to the columns ``keep`` of ``docs``.

    ``normalize`` maps the text column to what the tokenizer sees (None: the
    text itself, right for a tokenizer file without a normaliser).  Texts are
    encoded ``slice_bytes`` at a time: fewer take less memory and more time.
    """
    spark = docs.sparkSession
    version = tokenizer_version(tokenizer)
    text = F.coalesce(F.col("text"), F.lit(""))
    shown = normalize(text) if normalize else text
    digest = F.unhex(F.sha2(shown.cast("binary"), 256)).alias("digest")
    keyed = docs.select(*keep, F.octet_length(text).cast("long").alias("n_bytes"), digest)
    distinct = docs.select(digest, shown.alias("text")).groupBy("digest").agg(F.first("text").alias("text"))
    misses = distinct.join(read_cache(spark, cache, version), "digest", "left_anti")

    def encode(batches):
        c = counter(tokenizer)
        for rb in common.sliced(batches, target=slice_bytes):
            n = c.count(common.texts_of(rb))
            yield pa.RecordBatch.from_arrays(
                [rb.column(0), pa.array([version] * rb.num_rows), pa.array(n)], names=["digest", "version", "n_tokens"])

    misses.mapInArrow(encode, CACHE_SCHEMA).write.mode("append").parquet(cache)
    counts = common.checkpoint(read_cache(spark, cache, version))     # a plain join below: hot digests can be split
    return keyed.join(counts, "digest").select(*keep, "n_bytes", "n_tokens")


def op3_token_counts(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers
    docs = common.documents(spark, sf_dir).select("doc_id", "text")
    cache = f"{checkpoint_dir(spark).rstrip('/')}/token-cache-{uuid.uuid4().hex}"   # empty: every digest misses
    return (count_tokens(docs, public_tokenizers.path("byte_bpe_50k.json"), cache, ["doc_id"])
            .select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > 1024).alias("over_limit")))
