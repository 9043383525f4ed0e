"""The corpus pipeline: documents through five stages, each written as Parquet and read again.

  quality_rules    rejected documents go; lines above their host's limit go
  line_dedup       lines that stand earlier in the corpus, or nearly so, go (exact repeats
                   at every length); all documents stay
  near_dedup       one document of each group stays (five-word shingles, similarity 0.8)
  decontamination  documents that hold a window of a benchmark item go
  byte_bpe         token ids of each text, decoded again as a check

All stages but the last return the columns of documents, whatever their names (n_chars follows
the text where present); the last one adds columns, and a given one with the name of an added
one gets `_given` behind it. Nulls, empty texts, repeated rows and empty tables are handled as
the operators' docstrings say; near_dedup keeps one of rows repeated with one id and text.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sievework.llm import bpe, common, decontaminate, line_dedup, near_dup, quality


def _counted(docs: DataFrame) -> DataFrame:
    if "n_chars" not in docs.columns:
        return docs
    return docs.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return _counted(quality.clean(docs))


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return _counted(line_dedup.clean(docs))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return near_dup.clean(docs)


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.clean(docs, common.table(spark, sf_dir, "benchmark"))


def byte_bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return bpe.encode(docs)


STAGES = [
    ("quality_rules", quality_rules),
    ("line_dedup", dedup_lines),
    ("near_dedup", near_dedup),
    ("decontamination", decontaminated),
    ("byte_bpe", byte_bpe),
]

#: SQL has no byte-level BPE; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents")
    scratch = common.Scratch(spark, "pipeline")
    for name, stage in STAGES:
        docs = scratch.keep(stage(spark, docs, sf_dir), name)
    return docs
