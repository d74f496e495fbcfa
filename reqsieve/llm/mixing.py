"""Mix sources to target weights.

Tokens are summed per source, each source gets a share of the budget by its weight, and the
rate of a source is its target by its size. A document is emitted floor(rate) times, plus
once more if a hash of its id falls below the fraction of the rate.

Targets: the budget is shared by weight; a source stops at ``max_repeat`` times its size and
the excess is shared again. Since sources reach their limit in the order of limit by weight,
running sums in that order give the final shares at once.

Defined results: a null text has size 0; null is a source of its own and comes last; a source
without words has target 0 and is not taken; rows that share a doc_id share their draw; an
empty table gives no rows; ``mix`` keeps all columns, whatever their names. Sources are joined without a broadcast hint: few are broadcast by
Spark, many go through a join whose skewed partitions Spark splits.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reqsieve.llm.common import named, numbered, running_sums, stored

WEIGHTS = (3, 1, 2)
BUDGET = 1.5
MAX_REPEAT = 2
SEED = "mix"

_PARTS = r"split(coalesce(text, ''), r'[\x20\x09-\x0D]+')"
# Words of a text: the parts between white space, less the empty one at either end.
SIZE = (
    f"CAST(size({_PARTS}) - IF({_PARTS}[0] = '', 1, 0) "
    f"- IF(size({_PARTS}) > 1 AND element_at({_PARTS}, -1) = '', 1, 0) AS BIGINT)"
)


def source_targets(
    sized: DataFrame, weights: tuple = WEIGHTS, budget: float = BUDGET, max_repeat: int = MAX_REPEAT
) -> DataFrame:
    """source, source_size, target, rate from rows of (source, size)."""
    sources = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    ranked = running_sums(sources, ["source"], {"place": "1"}, "sources")
    weight = f"element_at(array({', '.join(map(str, weights))}), CAST(place % {len(weights)} AS INT) + 1)"
    capped = (
        ranked.withColumn("weight", F.expr(weight))
        .withColumn("cap", F.expr(f"source_size * {max_repeat}"))
        .withColumn("ratio", F.expr("CAST(cap AS DOUBLE) / weight"))
    )
    sums = running_sums(
        capped, ["ratio", "place"], {"caps_before": "cap", "weights_before": "weight"}, "ratios"
    )
    sums = stored(sums, "shares")
    whole = sums.agg(F.sum("source_size").alias("size"), F.sum("weight").alias("weights")).first()
    level = (F.lit((whole["size"] or 0) * budget) - F.col("caps_before")) / (
        F.lit(whole["weights"] or 0) - F.col("weights_before")
    )
    flagged = sums.withColumn("level", level).withColumn("full", F.expr("ratio <= level"))
    # The level at the first source that is not full holds for all that are not. It is the
    # greatest of theirs: each of them stands further above the level than the one before.
    share = flagged.where("NOT full").agg(F.max("level")).first()[0]
    # Rates above the limit or below zero would be an error of the shares, so they raise.
    checked = "IF(target BETWEEN 0D AND cap, {}, raise_error(concat('target out of range: ', target)))"
    return flagged.withColumn("share", F.lit(share or 0.0)).selectExpr(
        "source", "source_size", "cap",
        "CASE WHEN full THEN CAST(cap AS DOUBLE) ELSE least(CAST(cap AS DOUBLE), share * weight) END AS target",
    ).selectExpr(
        "source", "source_size", f"{checked.format('target')} AS target",
        "CASE WHEN source_size = 0 THEN 0D ELSE target / source_size END AS rate",
    )


def copies(seed: str = SEED) -> str:
    """SQL for how often a document with a ``rate`` is emitted."""
    draw = (
        f"CAST(conv(substring(md5(concat('{seed}:', coalesce(CAST(doc_id AS STRING), ''))), 1, 8), 16, 10) "
        "AS DOUBLE) / 4294967296D"
    )
    return f"CAST(floor(rate) AS BIGINT) + CASE WHEN {draw} < rate - floor(rate) THEN 1L ELSE 0L END"


def mix_plan(docs: DataFrame, seed: str = SEED, **shares) -> DataFrame:
    """doc_id, size, source, source_size, target, copies: how often each document is taken."""
    sized = stored(docs.selectExpr("doc_id", "source", f"{SIZE} AS size"), "sizes")
    targets = stored(source_targets(sized, **shares), "targets").withColumnRenamed("source", "_source")
    return sized.join(targets, F.expr("source <=> _source")).selectExpr(
        "doc_id", "size", "source", "source_size", "target", f"{copies(seed)} AS copies"
    )


def mix(docs: DataFrame, seed: str = SEED, **shares) -> DataFrame:
    """The rows of ``docs``, each as often as the mix takes it."""
    targets = source_targets(docs.selectExpr("source", f"{SIZE} AS size"), **shares)
    rates = stored(targets, "targets").select("source", "rate")
    id_at, source_at = (f"c{docs.columns.index(c)}" for c in ("doc_id", "source"))
    taken = numbered(docs).join(rates, F.expr(f"{source_at} <=> source"))
    times = re.sub(r"\bdoc_id\b", id_at, copies(seed))
    return named(taken.selectExpr("*", f"explode(array_repeat(0, CAST({times} AS INT))) AS copy"), docs)
