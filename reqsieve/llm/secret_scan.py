"""Secret scan: fixed patterns, and runs that look random to two character Markov models.

One model is trained on random strings, one on ordinary identifiers: counts of character pairs
over all documents, where the strings that the fixed patterns capture are the samples labelled
random and long words without digits those labelled ordinary. A run of token characters is
added as ``markov`` if the log-likelihood ratio of its characters is at least ``MIN_RATIO`` in
all and at least ``MIN_MEAN`` per pair, and if it overlaps no span of a pattern.

A model has (characters + 1)^2 counts, which bounds what the driver holds. All of the scanning
is built-in expressions over one row's text, so nothing is shuffled but pair counts. Positions
come from the pieces between matches: split() and regexp_extract_all() find the same ones.

Defined results: a null text is empty; a text without matches has empty spans; repeated rows
are scanned each for itself; with no samples both models are uniform and nothing is added; an
empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# The patterns, quotes written as \x22 and \x27.
ASSIGN = (
    r"(?i:password|passwd|secret|token|api_?key)[\x22\x27]?\x20*[:=]\x20*[\x22\x27]?([A-Za-z0-9+/_.=-]+)"
)
ACCESS = "AKIA[A-Z0-9]{16,}"
HEX = "[0-9a-f]{24,}"

MIN_SECRET = 6
MIN_RUN = 20
MIN_RATIO = 12.0
MIN_MEAN = 0.8
# Weight, in pairs, of a character's overall frequency within each row of a model.
BACKOFF = 8.0
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"
RUN = f"[A-Za-z0-9+/_=-]{{{MIN_RUN},}}"
_SIZE = len(ALPHABET) + 1
# Entries whose sums are taken at once when positions are added up.
_STEP = 512


def _let(value: str, name: str, body: str) -> str:
    """SQL that evaluates ``value`` once and uses it as ``name`` in ``body``."""
    return f"element_at(transform(array({value}), {name} -> {body}), 1)"


def spans_of(text: str, pattern: str) -> str:
    """SQL for array<struct<start, stop, hit>>: the matches of a pattern with their places.

    Starts are running sums of the lengths of pieces and matches, taken in two levels so that a
    text with very many matches does not cost their square.
    """
    plus = "0, (a, v) -> a + v"
    steps = (
        "transform(f.hits, (h, i) -> char_length(f.parts[i]) + IF(i > 0, char_length(f.hits[i - 1]), 0))"
    )
    sums = (
        f"transform(sequence(0, (size(g.steps) - 1) div {_STEP}), "
        f"c -> aggregate(slice(g.steps, CAST(c * {_STEP} + 1 AS INT), {_STEP}), {plus}))"
    )
    bases = f"transform(k.sums, (s, i) -> aggregate(slice(k.sums, 1, i), {plus}))"
    start = f"m.bases[i div {_STEP}] + aggregate(slice(m.steps, CAST((i div {_STEP}) * {_STEP} + 1 AS INT), i % {_STEP} + 1), {plus})"
    placed = _let(
        f"struct(split({text}, r'{pattern}') AS parts, regexp_extract_all({text}, r'{pattern}', 0) AS hits)", "f",
        _let(
            f"struct(f.hits AS hits, {steps} AS steps)", "g",
            _let(
                f"struct(g.hits AS hits, g.steps AS steps, {sums} AS sums)", "k",
                _let(
                    f"struct(k.hits AS hits, k.steps AS steps, {bases} AS bases)", "m",
                    f"transform(transform(m.hits, (h, i) -> struct({start} AS start, h AS hit)), "
                    "s -> struct(s.start AS start, s.start + char_length(s.hit) AS stop, s.hit AS hit))",
                ),
            ),
        ),
    )
    return (
        f"CASE WHEN {text} RLIKE r'{pattern}' THEN {placed} "
        "ELSE CAST(array() AS array<struct<start: int, stop: int, hit: string>>) END"
    )


def pair_counts(docs: DataFrame) -> DataFrame:
    """kind, first, second, n: how often a character follows another in each kind of sample."""
    text = "text"
    random = (
        f"concat(filter(regexp_extract_all({text}, r'{ASSIGN}', 1), v -> char_length(v) >= {MIN_RUN}), "
        f"regexp_extract_all({text}, r'{ACCESS}', 0), regexp_extract_all({text}, r'{HEX}', 0))"
    )
    samples = (
        docs.selectExpr("coalesce(text, '') AS text")
        .selectExpr(
            f"IF(text RLIKE r'{ASSIGN}|{ACCESS}|{HEX}', array_distinct({random}), CAST(array() AS array<string>)) AS random",
            "split(text, r'[^A-Za-z_-]+') AS parts",
        )
        .selectExpr(
            "random", "filter(parts, p -> char_length(p) >= 12) AS plain"
        )
        .selectExpr(
            "explode(concat(transform(random, s -> struct(true AS random, s)), "
            "transform(array_except(plain, random), s -> struct(false AS random, s)))) AS sample"
        )
        .selectExpr("sample.random AS random", "split(sample.s, '') AS chars")
    )
    return (
        samples.selectExpr(
            "random", "explode(transform(sequence(1, size(chars) - 1), i -> concat(chars[i - 1], chars[i]))) AS pair"
        )
        .groupBy("random", "pair")
        .agg(F.count("*").alias("n"))
        .selectExpr("random", "substring(pair, 1, 1) AS first", "substring(pair, 2, 1) AS second", "n")
    )


def fit_ratios(docs: DataFrame) -> list[float]:
    """log P(b | a) under random strings less that under identifiers, for each pair (a, b)."""
    counts = {True: [0.0] * _SIZE**2, False: [0.0] * _SIZE**2}
    for r in pair_counts(docs).collect():
        counts[r.random][_place(r.first) * _SIZE + _place(r.second)] += r.n
    logs = {}
    for kind, flat in counts.items():
        # A character that was seldom followed by others falls back on how common those are.
        totals = [sum(flat[a * _SIZE : (a + 1) * _SIZE]) for a in range(_SIZE)]
        common = [(sum(flat[b::_SIZE]) + 0.5) / (sum(totals) + 0.5 * _SIZE) for b in range(_SIZE)]
        logs[kind] = [
            math.log((n + BACKOFF * common[i % _SIZE]) / (totals[i // _SIZE] + BACKOFF)) for i, n in enumerate(flat)
        ]
    return [a - b for a, b in zip(logs[True], logs[False])]


def _place(c: str) -> int:
    return ALPHABET.find(c) + 1


def scan(docs: DataFrame, min_ratio: float = MIN_RATIO, min_mean: float = MIN_MEAN) -> DataFrame:
    """doc_id and arrays assign, access, hex, markov of (start, stop, hit) for every row."""
    docs = docs.select("doc_id", "text")
    table = ", ".join(f"{v:.6f}D" for v in fit_ratios(docs))
    found = docs.selectExpr("doc_id", "coalesce(text, '') AS text").selectExpr(
        "doc_id", f"array({table}) AS ratios",
        f"filter({spans_of('text', ASSIGN)}, s -> char_length(regexp_extract(s.hit, r'{ASSIGN}', 1)) >= {MIN_SECRET}) AS assign",
        f"{spans_of('text', ACCESS)} AS access", f"{spans_of('text', HEX)} AS hex",
        f"{spans_of('text', RUN)} AS runs",
    )
    place = f"instr('{ALPHABET}', {{}})"
    pair = f"ratios[{place.format('c[i - 1]')} * {_SIZE} + {place.format('c[i]')}]"
    ratio = _let("split(s.hit, '')", "c", f"aggregate(transform(sequence(1, size(c) - 1), i -> {pair}), 0D, (a, v) -> a + v)")
    free = "NOT exists(concat(assign, access, hex), b -> b.start < s.stop AND s.start < b.stop)"
    likely = _let(ratio, "r", f"r >= {min_ratio} AND r >= {min_mean} * (char_length(s.hit) - 1)")
    return found.selectExpr(
        "doc_id", "assign", "access", "hex", f"filter(runs, s -> {free} AND {likely}) AS markov"
    )


def report(found: DataFrame) -> DataFrame:
    """Counts, digest of the pattern spans, and all spans as text."""
    kinds = ("assign", "access", "hex", "markov")
    tagged = [f"transform({k}, s -> struct(s.start AS start, {i} AS kind, concat('{k}:', s.start, ':', s.stop) AS span))"
              for i, k in enumerate(kinds)]
    listed = "array_join(transform(array_sort(concat({})), s -> s.span), ',')"
    return found.selectExpr(
        "doc_id", *[f"CAST(size({k}) AS BIGINT) AS n_{k}" for k in kinds[:3]],
        f"sha2({listed.format(', '.join(tagged[:3]))}, 256) AS base_sha256",
        f"{listed.format(', '.join(tagged))} AS spans",
    )
