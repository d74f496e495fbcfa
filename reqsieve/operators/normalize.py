"""Canonical text of requests: masking of volatile values and composition."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reqsieve.functions.masks import canonical_escapes, mask_path, mask_values
from reqsieve.functions.text import join_pairs, last_wins, text_or_empty


def with_canonical_escapes(df: DataFrame, source: str, out: str) -> DataFrame:
    return df.withColumn(out, canonical_escapes(text_or_empty(F.col(source))))


def with_masked_path(df: DataFrame, source: str = "path", out: str = "masked_path") -> DataFrame:
    return df.withColumn(out, mask_path(F.col(source)))


def with_masked_values(df: DataFrame, source: str, out: str) -> DataFrame:
    return df.withColumn(out, mask_values(F.col(source)))


def normal_params(params: Column) -> Column:
    """Parameters sorted by lower-cased key (stable), keys lowered, values masked."""
    keyed = F.transform(
        params,
        lambda x, i: F.struct(F.lower(x["k"]).alias("k"), i.alias("at"), x["v"].alias("v")),
    )
    return last_wins(
        F.transform(
            F.array_sort(keyed),
            lambda x: F.struct(x["k"].alias("k"), mask_values(x["v"]).alias("v")),
        )
    )


def with_normal_params(
    df: DataFrame, source: str = "query_params", out: str = "normal_params"
) -> DataFrame:
    return df.withColumn(out, normal_params(F.col(source)))


def with_training_text(df: DataFrame, out: str = "text") -> DataFrame:
    """``METHOD masked-path[?k=v&...][ BODY:masked]`` from a parsed request.

    ``query_params`` is an array of (k, v); ``?`` appears only when it is not empty.
    """
    staged = df.withColumn("_params", join_pairs(normal_params(F.col("query_params"))))
    has_params = F.size("query_params") > 0
    text = F.concat(
        F.col("method"),
        F.lit(" "),
        mask_path(F.col("path")),
        F.when(has_params, F.concat(F.lit("?"), F.col("_params"))).otherwise(""),
        F.when(F.col("body") != "", F.concat(F.lit(" BODY:"), mask_values(F.col("body")))).otherwise(""),
    )
    return staged.withColumn(out, text).drop("_params")


def with_scoring_text(df: DataFrame, out: str = "text") -> DataFrame:
    """``METHOD path?k=v&...[ BODY:body]``, raw, ``?`` always, keys in code-point order."""
    text = F.concat(
        F.col("method"),
        F.lit(" "),
        F.col("path"),
        F.lit("?"),
        join_pairs(F.array_sort(F.col("query_params"))),
        F.when(F.col("body") != "", F.concat(F.lit(" BODY:"), F.col("body"))).otherwise(""),
    )
    return df.withColumn(out, text)
