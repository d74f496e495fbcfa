"""Exact duplicates by a tree merge of digest runs.

Each partition of the scan is a run: one row per digest, with how many rows it stands for and
the row that would stay. In each round the runs of ``FAN_IN`` neighbours meet, every task
taking one part of the digests of one node of the tree, so a text that a third of all rows
repeat is one row per run from the first round on. The winners then go back down the same
tree: each step joins a node's rows to those of its parent, and a key occurs at most
``FAN_IN`` times there, or once per row of one partition at the leaves.

A digest is verified at every level: rows meet only if SHA-256, a second hash and the number
of bytes of the normalised text all agree.

Defined results: a null text counts as empty, and empty texts are one group; rows without
doc_id are last in a tie; of rows that agree in everything one is kept; an empty table gives
no rows; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reqsieve.llm.common import stored

FAN_IN = 16

_KEY = ["digest", "second", "n_bytes"]


def _squeezed(text: str) -> str:
    """SQL for ``text`` without space, tab, line feed, vertical tab, form feed and return."""
    for code in (32, 9, 10, 11, 12, 13):
        text = f"replace({text}, char({code}), '')"
    return text


def digest_rows(docs: DataFrame) -> DataFrame:
    """One small row per document: its run, its digest and its rank within a group."""
    return (
        docs.selectExpr("doc_id", "coalesce(text, '') AS text")
        .selectExpr(
            "doc_id", "char_length(text) AS n_chars", f"{_squeezed('text')} AS norm",
            "spark_partition_id() AS run", "monotonically_increasing_id() AS row",
        )
        .selectExpr(
            "doc_id", "run", "row", "n_chars", "unhex(sha2(norm, 256)) AS digest",
            "xxhash64(norm) AS second", "octet_length(norm) AS n_bytes",
        )
    )


def merge_runs(runs: DataFrame, n_runs: int, fan_in: int = FAN_IN) -> DataFrame:
    """The winner and size of every group, for each (run, digest) of the leaves.

    ``runs`` has run, the digest columns, ``best`` (compared as a struct) and ``copies``.
    """
    level = runs.groupBy(F.col("run").alias("node"), *_KEY).agg(
        F.min("best").alias("best"), F.sum("copies").alias("copies")
    )
    levels, nodes = [level], n_runs
    while nodes > 1:
        nodes = -(-nodes // fan_in)
        level = level.groupBy(F.expr(f"node div {fan_in}").alias("node"), *_KEY).agg(
            F.min("best").alias("best"), F.sum("copies").alias("copies")
        )
        levels.append(level)
    down = levels.pop()
    while levels:
        parent = down.withColumnRenamed("node", "up")
        down = (
            levels.pop()
            .selectExpr("node", *_KEY, f"node div {fan_in} AS up")
            .join(parent, ["up", *_KEY])
            .select("node", *_KEY, "best", "copies")
        )
    return down


def exact_duplicates(docs: DataFrame, fan_in: int = FAN_IN) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256: one row per row of ``docs``."""
    leaves = stored(digest_rows(docs), "digests")
    n_runs = (leaves.agg(F.max("run")).first()[0] or 0) + 1
    best = "struct(-n_chars AS order, doc_id IS NULL AS last, doc_id, row) AS best"
    winners = merge_runs(leaves.selectExpr("run", *_KEY, best, "1L AS copies"), n_runs, fan_in)
    return leaves.join(winners.withColumnRenamed("node", "run"), ["run", *_KEY]).selectExpr(
        "doc_id", "best.doc_id AS keep_id", "copies AS group_size", "row = best.row AS kept",
        "lower(hex(digest)) AS text_sha256",
    )
