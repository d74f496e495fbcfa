"""Vocabulary as one JSON object, ``{"token_to_id": {...}, "vocab_size": n}``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from reqsieve.operators.tokens import SPECIALS, specials_table

_SCHEMA = "token_to_id map<string,int>, vocab_size int"


def vocab_to_json(vocab: DataFrame, vocab_size: int) -> DataFrame:
    """One row; the vocabulary is at most vocab_size rows, so it fits one value."""
    entries = F.array_sort(F.collect_list(F.struct("id", "token")))
    pairs = F.transform(entries, lambda e: F.struct(e["token"], e["id"]))
    return vocab.agg(
        F.to_json(
            F.struct(
                F.map_from_entries(pairs).alias("token_to_id"), F.lit(vocab_size).alias("vocab_size")
            )
        ).alias("value")
    )


def vocab_from_json(texts: DataFrame, value: str = "value") -> DataFrame:
    """(token, id) of a JSON vocabulary; the special tokens always keep their own ids."""
    doc = F.from_json(value, _SCHEMA)
    listed = texts.select(F.explode(doc["token_to_id"]).alias("token", "id")).where(
        ~F.col("token").isin(*SPECIALS)
    )
    return specials_table(texts.sparkSession).select("token", "id").unionByName(listed)


def save_vocab(vocab: DataFrame, path: str, vocab_size: int) -> None:
    vocab_to_json(vocab, vocab_size).write.mode("overwrite").text(path)


def load_vocab(spark: SparkSession, path: str) -> DataFrame:
    return vocab_from_json(spark.read.option("wholetext", True).text(path))
