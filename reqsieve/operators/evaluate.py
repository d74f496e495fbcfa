"""Evaluation against labelled data."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BENIGN, ATTACK = "benign", "attack"


def error_rates(df: DataFrame, label: str = "label") -> DataFrame:
    """One row: false positives and negatives with totals; no rate for an absent class."""
    benign, attack = F.col(label) == BENIGN, F.col(label) == ATTACK
    flagged = F.col("is_anomaly")
    return df.agg(
        F.count_if(benign).alias("benign_total"),
        F.count_if(benign & flagged).alias("false_positives"),
        F.count_if(attack).alias("attack_total"),
        F.count_if(attack & ~flagged).alias("false_negatives"),
    ).select(
        "*",
        F.try_divide("false_positives", "benign_total").alias("fpr"),
        F.try_divide("false_negatives", "attack_total").alias("fnr"),
    )


def case_results(cases: DataFrame, scored: DataFrame, key: str) -> DataFrame:
    """Expected against actual flag for every named case."""
    return cases.join(scored.select(key, "is_anomaly"), key).withColumn(
        "passed", F.col("expected") == F.col("is_anomaly")
    )


def case_totals(results: DataFrame) -> DataFrame:
    return results.agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if("passed").alias("passed"),
        F.count_if(~F.col("passed")).alias("failed"),
    )


def evaluation_set(
    routes: DataFrame,
    payloads: DataFrame,
    terms: list[str],
    iterations: int,
    payload_limit: int | None = None,
) -> DataFrame:
    """Benign routes and attack payloads, repeated.

    ``routes`` is (method, path, params MAP); a ``/search`` route gets the term of its
    iteration in ``q``. ``payloads`` is (position, payload); each goes into ``q`` of
    ``GET /search``. All are used, or the first ``payload_limit`` by position if that is given.
    """
    rounds = F.explode(F.sequence(F.lit(0), F.lit(iterations - 1))).alias("iteration")
    words = F.array(*[F.lit(t) for t in terms])
    term = F.get(words, F.pmod(F.col("iteration"), F.lit(len(terms))).cast("int"))
    benign = routes.select("*", rounds).select(
        "iteration",
        F.lit(BENIGN).alias("label"),
        "method",
        "path",
        F.when(
            F.col("path") == "/search",
            F.map_concat(
                F.map_filter("params", lambda k, v: k != "q"), F.create_map(F.lit("q"), term)
            ),
        )
        .otherwise(F.col("params"))
        .alias("params"),
    )
    if payload_limit is not None:
        payloads = payloads.orderBy("position").limit(payload_limit)
    attack = payloads.select("*", rounds).select(
        "iteration",
        F.lit(ATTACK).alias("label"),
        F.lit("GET").alias("method"),
        F.lit("/search").alias("path"),
        F.create_map(F.lit("q"), F.col("payload")).alias("params"),
    )
    return benign.unionByName(attack)
