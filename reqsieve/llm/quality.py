"""Quality classifier: a sparse ensemble of rules over text statistics.

A small forest is grown on labelled rows; every node's path from the root is a conjunctive
rule; a logistic regression with lasso penalty weighs the rules and drops most of them; what is
left is compiled into one Spark column expression. Scoring is thus a narrow projection without
Python.

The statistics of the labelled rows are a Spark job. Forest and weights are fitted on those of at
most ``MAX_TRAIN`` rows, chosen by a hash of doc_id; ten numbers each reach the driver, and the
bound also covers the broadcast that picks their texts. Fitting takes the rows in an order of
their own, so that the same rows give the same model however they are partitioned. Rows with
crc32(doc_id) mod 5 = 0 are held out and never learnt from. Only the text is an input.

Defined results: null and empty texts are scored like any other (all statistics are 0); a row
without doc_id is not held out and not learnt from; of several labels of one id the largest
counts; repeated rows get equal scores; without labels of both kinds the score is the smoothed
share of label 1 and there are no rules; an empty table gives no rows; ``good_documents`` keeps
all columns, whatever their names.
"""

from __future__ import annotations

import math
import re
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reqsieve.llm.common import named, numbered

MAX_TRAIN = 20_000
THRESHOLD = 0.3
TREES = 12
DEPTH = 3
PENALTY = 0.002
ITERATIONS = 400
# Rows and features that a tree and a node look at, thresholds tried, and rows a leaf has at least.
ROW_SHARE, FEATURE_SHARE, CUTS, LEAF = 0.7, 1 / 3, 32, 5

HELD_OUT = "coalesce(crc32(CAST(doc_id AS STRING)) % 5 = 0, false)"

# Each statistic over t (the text, not null), w (its words) and l (its lines).
STATISTICS = {
    "log_chars": "ln(1D + char_length(t))",
    "word_length": "char_length(t) / greatest(1D, size(w))",
    "letter_share": r"char_length(regexp_replace(t, r'[^\p{L}]+', '')) / greatest(1D, char_length(t))",
    "upper_share": r"char_length(regexp_replace(t, r'[^\p{Lu}]+', '')) / greatest(1D, char_length(t))",
    "digit_share": r"char_length(regexp_replace(t, r'[^0-9]+', '')) / greatest(1D, char_length(t))",
    "symbol_share": r"char_length(regexp_replace(t, r'[\p{L}\p{N}\s.,]+', '')) / greatest(1D, char_length(t))",
    "distinct_words": "size(array_distinct(w)) / greatest(1D, size(w))",
    "distinct_lines": "size(array_distinct(l)) / greatest(1D, size(l))",
    "stops": "(char_length(t) - char_length(replace(t, '.', ''))) / greatest(1D, size(w))",
}


@dataclass(frozen=True)
class RuleModel:
    """Conditions (SQL over the statistics) with their weights."""

    intercept: float
    rules: tuple[tuple[str, float], ...]

    def score(self, stats: str) -> str:
        """SQL for P(label 1), the statistics being fields of ``stats``."""
        terms = [f"IF({re.sub(r'{(\w+)}', stats + r'.\1', c)}, {w!r}D, 0D)" for c, w in self.rules]
        return f"1D / (1D + exp(-({' + '.join([f'{self.intercept!r}D', *terms])})))"


def with_statistics(docs: DataFrame, name: str = "stats", text: str = "text") -> DataFrame:
    """Add a struct of statistics. The explode of one item keeps Spark from moving later
    filters below it, where every mention of a statistic would be computed again."""
    parts = (
        "struct(coalesce({t}, '') AS t, split(coalesce({t}, ''), r'[\\x20\\x09-\\x0D]+') AS w, "
        "split(coalesce({t}, ''), '\\n') AS l)"
    ).format(t=text)
    fields = ", ".join(
        f"CAST({re.sub(r'\b([twl])\b(?=[,)])', r'p.\1', e)} AS DOUBLE) AS {k}" for k, e in STATISTICS.items()
    )
    return docs.select("*", F.expr(f"explode(transform(array({parts}), p -> struct({fields})))").alias(name))


# A rule: (statistic, whether it must be at most the threshold or above it, threshold), sorted.
Rule = tuple[tuple[int, bool, float], ...]


def _split(x: np.ndarray, y: np.ndarray, features: np.ndarray) -> tuple[int, float] | None:
    """The cut that leaves the least impurity, None where none lessens it."""
    best, found = 2 * y.mean() * (1 - y.mean()) - 1e-9, None
    for f in features.tolist():
        column = x[:, f]
        for cut in np.unique(np.quantile(column, np.linspace(0, 1, CUTS + 1)[1:-1], method="lower")).tolist():
            low = column <= cut
            n = int(low.sum())
            if LEAF <= n <= len(y) - LEAF:
                a, b = y[low].mean(), y[~low].mean()
                left = (n * 2 * a * (1 - a) + (len(y) - n) * 2 * b * (1 - b)) / len(y)
                if left < best:
                    best, found = left, (f, cut)
    return found


def _paths(x: np.ndarray, y: np.ndarray, rng: np.random.Generator, path: Rule, depth: int) -> set[Rule]:
    """The path to every node of a tree below its root."""
    n = max(1, round(x.shape[1] * FEATURE_SHARE))
    cut = _split(x, y, rng.choice(x.shape[1], n, replace=False)) if depth and len(y) >= 2 * LEAF else None
    if cut is None:
        return set()
    found = set()
    for at_most in (True, False):
        here = tuple(sorted({*path, (cut[0], at_most, cut[1])}))
        rows = (x[:, cut[0]] <= cut[1]) == at_most
        found |= {here} | _paths(x[rows], y[rows], rng, here, depth - 1)
    return found


def rules_of(x: np.ndarray, y: np.ndarray, trees: int = TREES, depth: int = DEPTH, seed: int = 7) -> list[Rule]:
    """The paths of a forest as conjunctions over the columns of ``x``."""
    rng, found = np.random.default_rng(seed), set()
    for _ in range(trees):
        rows = rng.choice(len(y), max(1, round(len(y) * ROW_SHARE)), replace=False)
        found |= _paths(x[rows], y[rows], rng, (), depth)
    return sorted(found)


def fires(rule: Rule, x: np.ndarray) -> np.ndarray:
    return np.logical_and.reduce([(x[:, f] <= cut) == at_most for f, at_most, cut in rule])


def condition(rule: Rule) -> str:
    """A rule as SQL, statistics in braces."""
    names = list(STATISTICS)
    return " AND ".join(f"{{{names[f]}}} {'<=' if at_most else '>'} {cut!r}D" for f, at_most, cut in rule)


def lasso(z: np.ndarray, y: np.ndarray, penalty: float = PENALTY, rounds: int = ITERATIONS) -> tuple[float, np.ndarray]:
    """Intercept and weights of a logistic regression with an absolute penalty on the weights,
    by accelerated proximal gradient steps."""
    z = np.column_stack([np.ones(len(y)), z])
    step = 4 * len(y) / max(np.linalg.norm(z, 2) ** 2, 1e-12)
    w = v = np.zeros(z.shape[1])
    t = 1.0
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(z @ v, -500, 500)))
        moved = v - step * (z.T @ (p - y)) / len(y)
        shrunk = np.sign(moved) * np.maximum(np.abs(moved) - step * penalty, 0)
        shrunk[0] = moved[0]
        after = (1 + math.sqrt(1 + 4 * t * t)) / 2
        v = shrunk + (t - 1) / after * (shrunk - w)
        w, t = shrunk, after
    return float(w[0]), w[1:]


def fit(docs: DataFrame, labels: DataFrame, max_train: int = MAX_TRAIN) -> RuleModel:
    known = (
        labels.selectExpr("doc_id AS id", "CAST(quality AS DOUBLE) AS label")
        .where(f"id IS NOT NULL AND label IN (0, 1) AND NOT {HELD_OUT.replace('doc_id', 'id')}")
        .groupBy("id").agg(F.max("label").alias("label"))
    )
    n = known.count()
    sample = known.where(f"pmod(xxhash64(id), 1000000) < {min(1.0, max_train / max(n, 1)) * 0.95 * 1e6 if n > max_train else 1e6}")
    texts = docs.selectExpr("doc_id AS id", "text").join(F.broadcast(sample), "id")
    rows = with_statistics(texts).select("label", "stats.*").toArrow()
    table = np.column_stack([rows[c].to_numpy() for c in rows.column_names]) if rows.num_rows else np.zeros((0, 1 + len(STATISTICS)))
    table = table[np.lexsort(table.T[::-1])]
    y, x = table[:, 0], table[:, 1:]
    if len(np.unique(y)) < 2:
        share = (y.sum() + 1) / (len(y) + 2)
        return RuleModel(math.log(share / (1 - share)), ())
    rules = rules_of(x, y)
    intercept, weights = lasso(np.column_stack([fires(r, x) for r in rules]).astype(float), y)
    return RuleModel(intercept, tuple((condition(r), float(w)) for r, w in zip(rules, weights) if w))


def score(docs: DataFrame, model: RuleModel, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out, score, predicted for every row."""
    return with_statistics(docs.select("doc_id", "text")).selectExpr(
        "doc_id", f"{HELD_OUT} AS held_out", f"{model.score('stats')} AS score"
    ).selectExpr("*", f"CAST(score >= {threshold} AS INT) AS predicted")


def good_documents(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs`` that the classifier accepts."""
    model = fit(docs.select("doc_id", "text"), labels)
    scored = with_statistics(numbered(docs), text=f"c{docs.columns.index('text')}")
    return named(scored.where(f"{model.score('stats')} >= {threshold}"), docs)
