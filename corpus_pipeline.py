"""The training-data pipeline over ``documents``.

Each stage takes (spark, docs, sf_dir), works on all rows its predecessor kept and returns a
DataFrame, which is written as Parquet and read again as the next stage's ``docs``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from reqsieve.llm import decontaminate, mixing, near_dedup, quality, token_files
from reqsieve.llm.common import stored, table
from reqsieve.session import scratch_dir


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules accept."""
    return quality.good_documents(docs, table(spark, sf_dir, "labels"))


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates."""
    return near_dedup.deduplicated(docs)


def decontaminate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without benchmark contamination; the others lose their benchmark passages."""
    return decontaminate.decontaminate(docs, table(spark, sf_dir, "benchmark"), cut=True)


def mix_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the target weights of their sources ask."""
    return mixing.mix(docs)


def token_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token files of the mix, and each document's place in them as read back."""
    path = scratch_dir(spark, "token-files")
    token_files.write_token_files(docs, path)
    return token_files.read_token_files(spark, path, with_ids=False)


STAGES = [
    ("quality classifier", quality_stage),
    ("near duplicates", near_dedup_stage),
    ("benchmark decontamination", decontaminate_stage),
    ("source mixing", mix_stage),
    ("token files", token_stage),
]

# Rules, signatures and token ids are beyond SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
