"""The corpus pipeline: stages over ``documents``, each written as Parquet and read again.

Every stage works on all rows its predecessor kept and returns the columns of documents; the last one
returns the packed pieces.
"""
from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from flankwear.llm.common import table, tokenizer_path
from flankwear.llm.decontam import drop_contaminated
from flankwear.llm.langid import drop_unidentified
from flankwear.llm.near_dup import drop_near_duplicates
from flankwear.llm.packing import pack
from flankwear.llm.quality import drop_bad
from flankwear.session import checkpoint_dir


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the weakly supervised scorer accepts."""
    return drop_bad(docs)


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a main language; the model learns from the labelled rows that arrive."""
    return drop_unidentified(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies (five-word shingles, similarity 0.8)."""
    return drop_near_duplicates(docs, width=5, similarity=0.8)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that overlap with no benchmark item."""
    return drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The kept documents in sequences of at most 2048 tokens, one row per piece."""
    return pack(docs, tokenizer_path(), capacity=2048, end_id=0)


STAGES = [("quality_classifier", quality), ("language_id", language), ("near_dedup", near_dedup),
          ("decontamination", decontaminate), ("packing", packing)]

#: Learned models and near-duplicate components can't be written in SQL; tests use brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to ``documents`` in order; every stage's rows are written and read again."""
    base = f"{checkpoint_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(path := f"{base}/{k}-{name}")
        docs = spark.read.parquet(path)
    return docs
