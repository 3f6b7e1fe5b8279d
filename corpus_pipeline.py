"""A training corpus from raw documents, stage by stage.

Every stage takes (spark, docs, sf_dir) and works on all rows that the one before has kept. All
but the last return the columns of ``docs``:

1. quality: documents that the classifier rejects go.
2. near_dedup: of each group of near copies the document with the smallest id stays. Rows
   without an id stay, and rows that repeat an id stay or go together.
3. decontaminate: documents that hold a benchmark item go.
4. secrets: secrets are masked in the text; no document goes.
5. pack: the pieces of full training sequences.

Null and empty texts are kept by all stages (they hold nothing to reject) and packed as their
end mark; empty tables pass through. Further columns of ``docs`` are carried along.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from tasteloom.llm import decontaminate as benchmark, minhash, packing, quality as weak, secrets as keys
from tasteloom.llm.common import session, table, unused, written


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    model = weak.fit(docs, table(spark, sf_dir, "labels"))
    kept = weak.scored(docs, model)
    return kept.where((F.col("quality_score") >= weak.KEEP) | (F.length(F.trim(F.coalesce("text", F.lit("")))) == 0)).select(*docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    found = minhash.near_duplicates(docs)
    name = unused(docs, "_gone")
    gone = written(found.where("not kept").select(F.col("doc_id").alias(name)).distinct(), "gone")
    return docs.join(gone, F.col("doc_id") == F.col(name), "left_anti")


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return benchmark.clean(docs, table(spark, sf_dir, "benchmark"))


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    found = keys.scan(docs)
    return found.withColumn("text", keys.redacted(found)).select(*docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs)


STAGES = [("quality", quality), ("near_dedup", near_dedup), ("decontaminate", decontaminate), ("secrets", secrets), ("pack", pack)]
#: The classifier and the tokenizer are beyond SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written and read again as the next one's input."""
    session(spark)
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), name)
    return docs
