"""Corpus pipeline: toxicity, language ID, near-duplicate join, secret scan and
packing over ``documents``.

Each stage takes (spark, docs, sf_dir) and works on all documents that the
stage before it kept; all but the last return the columns of ``documents``.
``run`` writes each result as Parquet to the shared folder named by
``spark.checkpoint.dir`` and reads it again for the next stage.

Null and empty texts pass the toxicity filter (nothing to score), are rejected
by language ID (``und``) and so never reach the packing; rows with a null id
are never duplicates of others; an empty table passes through every stage;
extra columns are dropped by the first stage.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from edgecraft.llm import common, langid, packing, secrets, toxicity
from edgecraft.llm.shingle_join import Rule, near_duplicates
from edgecraft.session import checkpoint_dir

COLUMNS = list(common.DOCUMENT_COLUMNS)
NEAR = Rule(words=5, percent=80)


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier scores under 0.5."""
    model = toxicity.fit(toxicity.labelled(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))
    return toxicity.score(docs.select(*COLUMNS), model, COLUMNS).where("score < 0.5").select(*COLUMNS)


def keep_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is told with a posterior of one half or more."""
    model = langid.fit(docs.where(common.fold(F.col("doc_id")) != 0))
    told = langid.predict(docs.select(*COLUMNS), model, COLUMNS)
    return told.where("lang_pred <> 'und' and score >= 0.5").select(*COLUMNS)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document (the smallest id) of each near-duplicate group."""
    found = common.checkpoint(near_duplicates(docs, NEAR))
    gone = found.where("doc_id <> component_id").select("doc_id").distinct()
    kept = docs.select(*COLUMNS).join(common.broadcast_if_small(gone, gone.count(), 16), "doc_id", "left_anti")
    if found.where("doc_id = component_id").groupBy("doc_id").count().where("count > 1").isEmpty():
        return kept.select(*COLUMNS)
    one = kept.where("doc_id is not null").dropDuplicates(["doc_id"])      # rows that share an id
    return one.unionByName(kept.where("doc_id is null")).select(*COLUMNS)


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, secrets replaced in their texts."""
    return secrets.redact(docs, COLUMNS)


def pack_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row for each packed piece: ``doc_id``, ``piece``, ``tokens``, ``bin``."""
    return packing.packed_documents(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("language_id", keep_languages),
    ("near_duplicates", drop_near_duplicates),
    ("secrets", redact_secrets),
    ("packing", pack_documents),
]

#: None: the first stages are trained classifiers (tests/llm checks the stages by brute force).
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    base = f"{checkpoint_dir(spark).rstrip('/')}/pipeline-{uuid.uuid4().hex}"
    docs = common.documents(spark, sf_dir)
    for i, (_, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{base}/{i}")
        docs = spark.read.parquet(f"{base}/{i}")
    return docs
