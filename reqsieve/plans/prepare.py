"""From logs to encoded samples in one job: parse, normalise, vocabulary, encode, write."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from reqsieve.operators import normalize, parse, tokens
from reqsieve.session import stored
from reqsieve.sources import logs, vocab_io


def request_texts(spark: SparkSession, path: str) -> DataFrame:
    """(id, text) of the requests of a log file, a folder of logs, or a structured JSONL file.

    Computed once and stored: the vocabulary and the encoding both read it.
    """
    if path.endswith((".json", ".jsonl")):
        rows = logs.read_structured_requests(spark, path)
    else:
        lines = logs.read_log_lines(spark, path)
        rows = parse.parse_log_lines(lines)
    composed = normalize.with_training_text(parse.with_text_fields(rows))
    return stored(composed.select(F.monotonically_increasing_id().alias("id"), "text"), "request-texts")


def write_samples(texts: DataFrame, vocab: DataFrame, out: str, max_length: int) -> None:
    """Encoded samples as JSON lines below ``<out>/samples``."""
    encoded = tokens.encode(texts, vocab, "id", max_length=max_length)
    encoded.select("input_ids", "attention_mask").write.mode("overwrite").json(f"{out}/samples")


def prepare_samples(
    spark: SparkSession, path: str, out: str, vocab_size: int = 10_000, max_length: int = 128
) -> DataFrame:
    """Samples of normal traffic and their vocabulary, at ``<out>/samples`` and ``<out>/vocab``.

    Returns the vocabulary.
    """
    texts = request_texts(spark, path)
    vocab = stored(tokens.build_vocab(texts, vocab_size=vocab_size), "vocabulary")
    vocab_io.save_vocab(vocab, f"{out}/vocab", vocab_size)
    write_samples(texts, vocab, out, max_length)
    return vocab


def prepare_delta(spark: SparkSession, path: str, vocab: str, out: str, max_length: int = 128) -> None:
    """Samples of new traffic, encoded with a vocabulary that is already there."""
    write_samples(request_texts(spark, path), vocab_io.load_vocab(spark, vocab), out, max_length)
