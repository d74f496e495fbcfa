"""Tokens, vocabulary and fixed-length encodings.

A vocabulary has at most ``MAX_VOCAB`` rows, which is checked where one is taken to the tasks.
Ids are looked up there, batch by batch, so no token is ever shuffled.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from reqsieve.functions.text import is_blank, text_or_empty

# Reserved ids.
PAD, UNK, CLS, SEP = 0, 1, 2, 3
SPECIALS = {"[PAD]": PAD, "[UNK]": UNK, "[CLS]": CLS, "[SEP]": SEP}

# Rows of a vocabulary that a task may hold.
MAX_VOCAB = 1_000_000

# The thirty split characters. Each is a token of its own; blanks do not
# split and stay inside their token.
_MARKS = r"/?=&:#.;,\[\]{}()<>\-_'\"|`~!@^*+\\"
TOKEN = rf"[{_MARKS}]|[^{_MARKS}]+"
SINGLE_MARK = rf"^[{_MARKS}]\z"

VOCAB_SCHEMA = "token string, id int, n bigint"


def tokens_of(text: Column) -> Column:
    return F.filter(
        F.regexp_extract_all(text_or_empty(text), F.lit(TOKEN), F.lit(0)), lambda t: ~is_blank(t)
    )


def with_tokens(df: DataFrame, text: str = "text", out: str = "tokens") -> DataFrame:
    return df.withColumn(out, tokens_of(F.col(text)))


def token_counts(df: DataFrame, text: str = "text") -> DataFrame:
    """(token, n) over a text table; partial counts are taken before the shuffle."""
    return (
        df.select(F.explode(tokens_of(F.col(text))).alias("token"))
        .groupBy("token")
        .agg(F.count(F.lit(1)).alias("n"))
    )


def specials_table(spark: SparkSession) -> DataFrame:
    rows = ", ".join(f"('{t}', {i}, 0L)" for t, i in SPECIALS.items())
    return spark.sql(f"SELECT * FROM VALUES {rows} AS t(token, id, n)")


def top_tokens(counts: DataFrame, vocab_size: int) -> DataFrame:
    """Most frequent tokens with their ids, special tokens left out."""
    room = max(vocab_size, len(SPECIALS)) - len(SPECIALS)
    top = (
        counts.where(~F.col("token").isin(*SPECIALS))
        .orderBy(F.desc("n"), F.asc("token"))
        .limit(room)
    )
    # At most vocab_size rows are left, so one task for the numbering is fine.
    by_rank = Window.orderBy(F.desc("n"), F.asc("token"))
    return top.select(
        "token", (F.row_number().over(by_rank) + len(SPECIALS) - 1).cast("int").alias("id"), "n"
    )


def build_vocab(df: DataFrame, text: str = "text", vocab_size: int = 10000) -> DataFrame:
    """Vocabulary of a text table: special tokens, then count descending, token ascending."""
    top = top_tokens(token_counts(df, text), vocab_size)
    return specials_table(df.sparkSession).unionByName(top)


def vocabulary_rows(vocab: DataFrame, *columns: str) -> pa.Table:
    """The columns of a vocabulary, checked to be small enough for every task."""
    rows = vocab.select(*columns).limit(MAX_VOCAB + 1).toArrow()
    if rows.num_rows > MAX_VOCAB:
        raise ValueError(f"a vocabulary has at most {MAX_VOCAB} rows")
    return rows.combine_chunks()


def ids_of_tokens(tokens: pa.Array, known: pa.Array, ids: np.ndarray) -> np.ndarray:
    """The id of each token, [UNK] for those that are not known."""
    at = pc.fill_null(pc.index_in(tokens, value_set=known), -1).to_numpy(zero_copy_only=False)
    return np.where(at < 0, UNK, ids[at]) if len(ids) else np.full(len(at), UNK)


def token_ids(df: DataFrame, vocab: DataFrame, key: str, tokens: Column) -> DataFrame:
    """(key, token_ids), unknown tokens as 1."""
    rows = vocabulary_rows(vocab, "token", "id")
    known, ids = rows["token"].combine_chunks(), rows["id"].to_numpy()

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch["tokens"]
            found = ids_of_tokens(lists.flatten(), known, ids)
            ends = np.cumsum(lists.value_lengths().to_numpy(zero_copy_only=False))
            offsets = pa.array(np.concatenate([[0], ends]), pa.int32())
            yield pa.RecordBatch.from_arrays(
                [batch["key"], pa.ListArray.from_arrays(offsets, pa.array(found, pa.int32()))], names=["key", "token_ids"]
            )

    keyed = df.select(F.col(key).alias("key"), tokens.alias("tokens"))
    return keyed.mapInArrow(run, f"key {dict(keyed.dtypes)['key']}, token_ids array<int>").withColumnRenamed("key", key)


def tokenize(df: DataFrame, vocab: DataFrame, key: str, text: str = "text") -> DataFrame:
    """(key, token_ids) of whole texts."""
    return token_ids(df, vocab, key, tokens_of(F.col(text)))


def encoded(ids: Column, max_length: int) -> Column:
    if max_length < 2:
        raise ValueError("max_length must leave room for the two end marks")
    body = F.slice(ids, 1, max_length - 2) if max_length > 2 else F.expr("cast(array() as array<int>)")
    framed = F.concat(F.array(F.lit(CLS)), body, F.array(F.lit(SEP)))
    return F.concat(framed, F.array_repeat(F.lit(PAD), F.lit(max_length) - F.size(framed)))


def attention(ids: Column, max_length: int) -> Column:
    used = F.least(F.size(ids) + 2, F.lit(max_length))
    return F.concat(
        F.array_repeat(F.lit(1), used), F.array_repeat(F.lit(0), F.lit(max_length) - used)
    )


def with_encoding(df: DataFrame, max_length: int, ids: str = "token_ids") -> DataFrame:
    """Fixed-length ``input_ids``: start mark, ids, end mark, padding."""
    return df.withColumn("input_ids", encoded(F.col(ids), max_length))


def with_attention_mask(df: DataFrame, max_length: int, ids: str = "token_ids") -> DataFrame:
    """1 for every real position of the encoding, 0 for padding."""
    return df.withColumn("attention_mask", attention(F.col(ids), max_length))


def encode(
    df: DataFrame, vocab: DataFrame, key: str, text: str = "text", max_length: int = 128
) -> DataFrame:
    """(key, input_ids, attention_mask); only tokens that fit are looked up."""
    fitting = F.slice(tokens_of(F.col(text)), 1, max(max_length - 2, 0))
    ids = token_ids(df, vocab, key, fitting)
    return with_attention_mask(with_encoding(ids, max_length), max_length).drop("token_ids")


def decode(df: DataFrame, vocab: DataFrame, key: str, ids: str = "input_ids") -> DataFrame:
    """(key, text): marks are glued on, two words get a blank between them; an id that is not
    known is an empty word."""
    rows = vocabulary_rows(vocab, "id", "token")
    known, tokens = rows["id"].combine_chunks(), rows["token"].combine_chunks()

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch["ids"]
            words = pc.fill_null(tokens.take(pc.index_in(lists.flatten(), value_set=known)), "")
            ends = np.cumsum(lists.value_lengths().to_numpy(zero_copy_only=False))
            offsets = pa.array(np.concatenate([[0], ends]), pa.int32())
            yield pa.RecordBatch.from_arrays([batch["key"], pa.ListArray.from_arrays(offsets, words)], names=["key", "words"])

    kept = F.filter(F.coalesce(F.col(ids), F.array().cast("array<int>")), lambda i: ~i.isin(PAD, CLS, SEP))
    keyed = df.select(F.col(key).alias("key"), kept.alias("ids"))
    found = keyed.mapInArrow(run, f"key {dict(keyed.dtypes)['key']}, words array<string>")
    return found.select(F.col("key").alias(key), _spaced(F.col("words")).alias("text"))


def _spaced(words: Column) -> Column:
    """Glue tokens: a blank only between two neighbours that are both no single mark."""
    tagged = F.transform(
        words, lambda w: F.struct(w.alias("w"), w.rlike(SINGLE_MARK).alias("mark"))
    )
    start = F.expr("named_struct('s', '', 'glue', true, 'begun', false)")

    def step(acc: Column, x: Column) -> Column:
        gap = F.when(acc["begun"] & ~acc["glue"] & ~x["mark"], " ").otherwise("")
        return F.struct(
            F.concat(acc["s"], gap, x["w"]).alias("s"),
            x["mark"].alias("glue"),
            F.lit(True).alias("begun"),
        )

    return F.aggregate(tagged, start, step, lambda acc: acc["s"])
