"""How unusual is a request, given normal traffic?

A request is the token sequence ``[CLS] t1 .. tn [SEP]``. The score is the mean of
-ln p over every position but the first, so an empty request still has a score.
Tokens outside the vocabulary count as ``[UNK]``.

Unigram: p(t) = (n(t) + alpha) / (N + alpha * V). Bigram: lambda * c(prev, t) / c(prev)
plus (1 - lambda) times the unigram.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from reqsieve.functions.text import let
from reqsieve.operators.tokens import (
    CLS,
    MAX_VOCAB,
    SEP,
    SPECIALS,
    UNK,
    ids_of_tokens,
    tokens_of,
    vocabulary_rows,
)
from reqsieve.session import materialize, stored

SEP_TOKEN, UNK_TOKEN, CLS_TOKEN = "[SEP]", "[UNK]", "[CLS]"

# Rows of the pair table that a task holds at once, 16 bytes each.
PAIR_BLOCK = 4_000_000
# Positions of a batch that a task looks up at once; a request is at least one row.
POSITION_BLOCK = 500_000


# --- sequences -------------------------------------------------------------------------


def effective_length(configured: int, model_max: int | None = None) -> int:
    return configured if model_max is None else min(configured, model_max)


def _sequence(text: Column, max_length: int | None) -> Column:
    """Target tokens of one request: its tokens, cut to the length, and the end mark."""
    tokens = tokens_of(text)
    if max_length is not None:
        if max_length < 2:
            raise ValueError("max_length must leave room for the two end marks")
        tokens = F.slice(tokens, 1, max_length - 2) if max_length > 2 else F.slice(tokens, 1, 0)
    return F.concat(tokens, F.array(F.lit(SEP_TOKEN)))


# --- unigram model ---------------------------------------------------------------------


def unigram_counts(
    normal: DataFrame, text: str = "text", vocab_size: int = 10000, max_length: int | None = None
) -> DataFrame:
    """(token, id, n) over normal requests: the vocabulary, [UNK] and [SEP].

    One scan and one shuffle, with partial counts before it: next to its tokens every
    request emits its length, whose sum tells how many positions the kept tokens leave
    to [UNK]. What the window sees is at most vocab_size rows.
    """
    if vocab_size > MAX_VOCAB:
        raise ValueError(f"a vocabulary has at most {MAX_VOCAB} rows")
    weighted = let(
        _sequence(F.col(text), max_length),
        lambda s: F.concat(
            F.transform(s, lambda t: F.struct(t.alias("token"), F.lit(1).alias("w"))),
            F.array(F.struct(F.lit(UNK_TOKEN).alias("token"), F.size(s).alias("w"))),
        ),
    )
    # Without any request the model still has its two marks, so that every score is defined.
    marks = normal.sparkSession.range(2).select(
        F.when(F.col("id") == 0, UNK_TOKEN).otherwise(SEP_TOKEN).alias("token"), F.lit(0).alias("w")
    )
    counts = (
        normal.select(F.inline(weighted)).unionByName(marks)
        .groupBy("token").agg(F.sum("w").cast("bigint").alias("n"))
    )
    fixed = F.col("token").isin(UNK_TOKEN, SEP_TOKEN)
    order = [F.desc(fixed), F.desc("n"), F.asc("token")]
    room = max(vocab_size, len(SPECIALS)) - len(SPECIALS)
    top = counts.orderBy(*order).limit(room + 2)
    everything = Window.partitionBy()
    rest = F.col("n") - F.sum(F.when(F.col("token") != UNK_TOKEN, F.col("n")).otherwise(0)).over(everything)
    return top.select(
        "token",
        F.when(F.col("token") == UNK_TOKEN, UNK)
        .when(F.col("token") == SEP_TOKEN, SEP)
        .otherwise(F.row_number().over(Window.orderBy(*order)) + len(SPECIALS) - 3)
        .cast("int")
        .alias("id"),
        F.when(F.col("token") == UNK_TOKEN, rest).otherwise(F.col("n")).cast("bigint").alias("n"),
    )


def unigram_model(counts: DataFrame, alpha: float = 1.0) -> DataFrame:
    """(token, id, n, log_p) from a count table of at most vocab_size rows."""
    everything = Window.partitionBy()
    mass = F.sum(F.col("n") + F.lit(float(alpha))).over(everything)
    return counts.withColumn("log_p", F.log((F.col("n") + F.lit(float(alpha))) / mass))


def fit_unigram(
    normal: DataFrame,
    text: str = "text",
    vocab_size: int = 10000,
    alpha: float = 1.0,
    max_length: int | None = None,
) -> DataFrame:
    """A fitted model, computed once: scoring reads its few rows several times."""
    return materialize(unigram_model(unigram_counts(normal, text, vocab_size, max_length), alpha))


def _unigram_losses(df: DataFrame, model: DataFrame, key: str | None, text: str, max_length) -> DataFrame:
    """(_key, loss) per position; without a key just the losses."""
    keys = [F.col(key).alias("_key")] if key else []
    unknown = model.where(F.col("token") == UNK_TOKEN).select("log_p").scalar()
    exploded = df.select(*keys, F.explode(_sequence(F.col(text), max_length)).alias("token"))
    return exploded.join(F.broadcast(model.select("token", "log_p")), "token", "left").select(
        *(["_key"] if key else []), (-F.coalesce("log_p", unknown)).alias("loss")
    )


def score_unigram(
    df: DataFrame,
    model: DataFrame,
    key: str,
    text: str = "text",
    max_length: int | None = None,
) -> DataFrame:
    """(key, anomaly_score). The tokens of a request shrink to one row before the shuffle."""
    return (
        _unigram_losses(df, model, key, text, max_length)
        .groupBy("_key")
        .agg(F.avg("loss").alias("anomaly_score"))
        .withColumnRenamed("_key", key)
    )


def held_out_loss(
    df: DataFrame, model: DataFrame, text: str = "text", max_length: int | None = None
) -> DataFrame:
    """One row: token-weighted mean loss, and the number of positions it covers."""
    return _unigram_losses(df, model, None, text, max_length).agg(
        F.avg("loss").alias("loss"), F.count(F.lit(1)).alias("positions")
    )


# --- bigram model ----------------------------------------------------------------------


@dataclass(frozen=True)
class BigramModel:
    """``unigram`` has at most vocab_size rows; ``pairs`` may have its square.

    ``pairs`` is (prev_id, id, n, share) with share = c(prev, t) / c(prev).
    """

    unigram: DataFrame
    pairs: DataFrame
    weight: float
    vocab_size: int


def _slices(batches: Iterable[pa.RecordBatch], positions: int = POSITION_BLOCK) -> Iterator[pa.RecordBatch]:
    """Batches of sequences in slices of at most ``positions`` positions or of one row: a batch is
    counted in rows, so long texts would otherwise make the arrays over its positions large."""
    for batch in batches:
        ends = np.cumsum(batch["sequence"].value_lengths().to_numpy(zero_copy_only=False))
        start = 0
        while start < batch.num_rows:
            before = ends[start - 1] if start else 0
            stop = max(start + 1, int(np.searchsorted(ends, before + positions, "right")))
            yield batch.slice(start, stop - start)
            start = stop


def _positions(batch: pa.RecordBatch, known: pa.Array, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For every position of a batch of sequences: its row, the id before it, its id."""
    sizes = batch["sequence"].value_lengths().to_numpy(zero_copy_only=False)
    here = ids_of_tokens(batch["sequence"].flatten(), known, ids)
    before = np.concatenate([[CLS], here[:-1]])
    before[(np.cumsum(sizes) - sizes)[sizes > 0]] = CLS
    return np.repeat(np.arange(len(sizes)), sizes), before, here


def pair_counts(normal: DataFrame, unigram: DataFrame, text: str = "text", max_length: int | None = None) -> DataFrame:
    """(prev_id, id, n): the pairs of neighbours, counted in the tasks before the shuffle."""
    vocab = vocabulary_rows(unigram, "token", "id")
    known, ids = vocab["token"].combine_chunks(), vocab["id"].to_numpy().astype(np.int64)
    span = int(max(ids.max(initial=SEP), SEP)) + 1

    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _slices(batches):
            _, before, here = _positions(batch, known, ids)
            pair, n = np.unique(before * span + here, return_counts=True)
            yield pa.RecordBatch.from_arrays(
                [pa.array(pair // span, pa.int32()), pa.array(pair % span, pa.int32()), pa.array(n)], names=["prev_id", "id", "n"]
            )

    sequences = normal.select(_sequence(F.col(text), max_length).alias("sequence"))
    found = sequences.mapInArrow(count, "prev_id int, id int, n bigint")
    return found.groupBy("prev_id", "id").agg(F.sum("n").alias("n"))


def fit_bigram(
    normal: DataFrame,
    text: str = "text",
    vocab_size: int = 10000,
    alpha: float = 1.0,
    weight: float = 0.7,
    max_length: int | None = None,
) -> BigramModel:
    unigram = fit_unigram(normal, text, vocab_size, alpha, max_length)
    counts = stored(pair_counts(normal, unigram, text, max_length), "pair-counts")
    # c(prev) has one row per vocabulary entry, so it is small enough to broadcast.
    starts = counts.groupBy("prev_id").agg(F.sum("n").alias("c_prev"))
    pairs = counts.join(F.broadcast(starts), "prev_id").select(
        "prev_id", "id", "n", (F.col("n") / F.col("c_prev")).alias("share")
    )
    return BigramModel(unigram, stored(pairs, "pairs"), weight, vocab_size)


def score_bigram(
    df: DataFrame,
    model: BigramModel,
    key: str,
    text: str = "text",
    max_length: int | None = None,
    pair_block: int = PAIR_BLOCK,
) -> DataFrame:
    """(key, anomaly_score) under the interpolated bigram.

    The pair table is packed into sorted arrays of at most about ``pair_block`` pairs, by the
    id before. Each block is one pass over the requests, which adds up the losses of the
    positions whose id before belongs to it, so a task holds one block however large the
    table is, and what is shuffled is one row per request and pass.
    """
    vocab = vocabulary_rows(model.unigram, "token", "id", "log_p")
    known, ids = vocab["token"].combine_chunks(), vocab["id"].to_numpy().astype(np.int64)
    span = int(max(ids.max(initial=SEP), SEP)) + 1
    alone = np.zeros(span)
    alone[ids] = np.exp(vocab["log_p"].to_numpy())
    blocks = max(1, -(-model.pairs.count() // pair_block))
    weight = model.weight
    keyed = df.select(F.col(key).alias("key"), _sequence(F.col(text), max_length).alias("sequence"))
    keyed = stored(keyed, "sequences") if blocks > 1 else keyed

    def losses(block: int) -> DataFrame:
        mine = model.pairs.where(F.col("prev_id") % blocks == block).select("prev_id", "id", "share").toArrow()
        pairs = mine["prev_id"].to_numpy().astype(np.int64) * span + mine["id"].to_numpy()
        order = np.argsort(pairs)
        # One more entry, which no pair equals, spares the lookup a bound.
        pairs = np.append(pairs[order], np.iinfo(np.int64).max)
        shares = np.append(mine["share"].to_numpy()[order], 0.0)

        def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in _slices(batches):
                row, before, here = _positions(batch, known, ids)
                own = before % blocks == block
                row, before, here = row[own], before[own], here[own]
                pair = before * span + here
                at = np.searchsorted(pairs, pair)
                share = np.where(pairs[at] == pair, shares[at], 0.0)
                loss = -np.log(weight * share + (1 - weight) * alone[here])
                n = batch.num_rows
                yield pa.RecordBatch.from_arrays(
                    [batch["key"], pa.array(np.bincount(row, loss, n), pa.float64()), pa.array(np.bincount(row, minlength=n))],
                    names=["key", "loss", "n"],
                )

        return keyed.mapInArrow(run, f"key {dict(keyed.dtypes)['key']}, loss double, n bigint")

    parts = reduce(DataFrame.unionByName, [losses(b) for b in range(blocks)])
    return parts.groupBy("key").agg((F.sum("loss") / F.sum("n")).alias("anomaly_score")).withColumnRenamed("key", key)


# --- decisions -------------------------------------------------------------------------


def is_anomaly(score: Column, threshold: float) -> Column:
    return score > F.lit(float(threshold))


def confidence(score: Column, threshold: float) -> Column:
    over = (score - F.lit(float(threshold))) / F.lit(max(float(threshold), 1e-6))
    return F.least(F.greatest(over, F.lit(0.0)), F.lit(1.0))


def with_flag(df: DataFrame, threshold: float, score: str = "anomaly_score") -> DataFrame:
    """A score equal to the threshold is not flagged."""
    return df.withColumn("is_anomaly", is_anomaly(F.col(score), threshold))


def with_confidence(df: DataFrame, threshold: float, score: str = "anomaly_score") -> DataFrame:
    return df.withColumn("confidence", confidence(F.col(score), threshold))


def with_decision(df: DataFrame, threshold: float, score: str = "anomaly_score") -> DataFrame:
    return with_confidence(with_flag(df, threshold, score), threshold, score)


def rethreshold(df: DataFrame, threshold: float) -> DataFrame:
    """New flags, confidences and threshold over stored scores, without rescoring."""
    out = with_decision(df, threshold)
    return out.withColumn("threshold", F.lit(float(threshold))) if "threshold" in df.columns else out


def score_requests(
    df: DataFrame,
    model: DataFrame | BigramModel | None,
    key: str,
    threshold: float,
    text: str = "text",
    max_length: int | None = None,
) -> DataFrame:
    """(key, anomaly_score, is_anomaly, confidence), one row per request.

    Without a model every request scores 0 and is not flagged. Regroups by ``key``, so on
    a stream it belongs inside ``foreachBatch``.
    """
    if model is None:
        return df.select(
            key,
            F.lit(0.0).alias("anomaly_score"),
            F.lit(False).alias("is_anomaly"),
            F.lit(0.0).alias("confidence"),
        )
    score = score_bigram if isinstance(model, BigramModel) else score_unigram
    return with_decision(score(df, model, key, text, max_length), threshold)


# --- splits, updates, versions ---------------------------------------------------------


def split_train_validation(
    df: DataFrame, key: str, tenths: int = 8, bucket: Column | None = None
) -> tuple[DataFrame, DataFrame]:
    """A split that depends on the key alone, so reruns and retries agree.

    ``bucket`` is a number from 0 to 9, by default a hash of the key.
    """
    if bucket is None:
        bucket = F.pmod(F.xxhash64(key), F.lit(10))
    return df.where(bucket < tenths), df.where(bucket >= tenths)


def merge_counts(
    counts: DataFrame,
    delta: DataFrame,
    text: str = "text",
    max_length: int | None = None,
) -> DataFrame:
    """Add new normal requests to a count table, keeping its vocabulary.

    Tokens it does not know count as [UNK].
    """
    ids = counts.select("token", "id")
    fresh = (
        delta.select(F.explode(_sequence(F.col(text), max_length)).alias("token"))
        .groupBy("token")
        .agg(F.count(F.lit(1)).alias("n"))
        .join(F.broadcast(ids), "token", "left")
        .select(
            F.when(F.col("id").isNull(), UNK_TOKEN).otherwise(F.col("token")).alias("token"),
            F.coalesce("id", F.lit(UNK)).alias("id"),
            "n",
        )
    )
    return (
        counts.select("token", "id", "n")
        .unionByName(fresh)
        .groupBy("token", "id")
        .agg(F.sum("n").cast("bigint").alias("n"))
    )


def newest_versions(versions: DataFrame, keep: int = 5) -> DataFrame:
    """The ``keep`` highest versions; the highest is current."""
    top = versions.orderBy(F.desc("version")).limit(keep)
    latest = F.max("version").over(Window.partitionBy())  # over ``keep`` rows
    return top.withColumn("is_current", F.col("version") == latest)


def next_version(versions: DataFrame) -> DataFrame:
    return versions.agg((F.coalesce(F.max("version"), F.lit(0)) + 1).alias("next_version"))


# --- pluggable scorer ------------------------------------------------------------------


def score_with(
    df: DataFrame,
    load_scorer: Callable[[], Callable],
    key: str,
    text: str = "text",
) -> DataFrame:
    """(key, anomaly_score) from a user's scorer.

    ``load_scorer`` runs once per task and returns a function from a pandas Series of
    texts to a sequence of scores.
    """
    key_type = dict(df.dtypes)[key]

    def run(batches: Iterator) -> Iterator:
        scorer = load_scorer()
        for pdf in batches:
            yield pdf[[key]].assign(anomaly_score=scorer(pdf[text]))

    return df.select(key, text).mapInPandas(run, f"`{key}` {key_type}, anomaly_score double")
