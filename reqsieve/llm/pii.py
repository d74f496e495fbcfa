"""Personal data by weak supervision.

Candidates are the spans of the fixed patterns (email, ip, card, phone) and of looser forms of
them. Three labelers vote on each (yes, no or abstain): the strict pattern with its check, a
gazetteer (top-level domains, card issuers, country codes, reserved addresses) and the words
around. The documents are read once; what is stored is each document's candidates with a code
of votes and shape. Expectation-maximisation over the counts of vote patterns estimates how
reliable each labeler is, without labels, and the posteriors of the patterns train a logistic
classifier over votes and shape. Spans of the fixed patterns always stay; a looser candidate is
added if the classifier gives it ``MIN_SCORE`` and it overlaps none of them.

There are ``CODES`` codes per kind, whatever the input, so counts and weights are small; the
counts cover all documents.

Defined results: a null text is empty; a text without candidates has no spans; repeated rows
are scanned each for itself; with no candidates of a kind its classifier stays at its prior; an
empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reqsieve.llm.common import stored

KINDS = ("email", "ip", "card", "phone")
MIN_SCORE = 0.7
CONTEXT = 40
SLICE = 512
LABELERS = 3
SHAPES = 4
CODES = 3**LABELERS * SHAPES

# Gazetteers and cue words.
DOMAINS = frozenset(
    "com org net edu gov mil int info biz io ai dev app co us uk de fr es it nl be ch at se no fi dk pl cz "
    "pt ie ca au nz jp cn in br mx ar za ru eu example test".split()
)
ISSUERS = re.compile(r"4|5[1-5]|2[2-7]|3[47]|35|36|6011|64|65|62")
COUNTRIES = re.compile(r"1|7|2[07]|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58]|2[1-689]\d|3[578]\d|42\d|[58]\d\d|9[679]\d")
CUES = {
    "email": re.compile(r"(?i)\b(?:e-?mail|mail|contact|write|reach)\b"),
    "ip": re.compile(r"(?i)\b(?:ip|host|server|address|client|gateway)\b"),
    "card": re.compile(r"(?i)\b(?:card|visa|mastercard|amex|credit|payment)\b"),
    "phone": re.compile(r"(?i)\b(?:phone|tel|telephone|call|fax|mobile|cell)\b"),
}
OTHER = re.compile(r"(?i)\b(?:version|isbn|order|invoice|serial|sku|build|release|section|page)\b")

_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
# A digit run is entered at its start only; starting later in it could give no other match.
_IP = re.compile(r"(?<![0-9])[0-9]+(?:\.[0-9]+){3}")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
# Looser forms: none overlaps itself in more than a few characters, so each scan is linear.
_LOOSE = {
    "email": re.compile(
        r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64} ?[(\[] ?(?:at|AT) ?[)\]] ?[A-Za-z0-9-]{1,63}"
        r"(?: ?(?:\.|[(\[] ?(?:dot|DOT) ?[)\]]) ?[A-Za-z0-9-]{1,63}){1,5}"
    ),
    "ip": re.compile(r"(?<![0-9a-fA-F:])(?:[0-9a-fA-F]{1,4}:){7}[0-9a-fA-F]{1,4}(?![0-9a-fA-F:])"),
    "card": re.compile(r"(?<![0-9./])[0-9]{4}([./_])[0-9]{4}\1[0-9]{4}\1[0-9]{4}(?![0-9])|(?<![0-9])3[47][0-9]{13}(?![0-9])"),
    "phone": re.compile(r"(?<![0-9+(])(?:\([0-9]{3}\) ?|[0-9]{3}[ .-])[0-9]{3}[ .-][0-9]{4}(?![0-9])"),
}
_DIGITS = re.compile(r"[0-9]")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        n = ord(c) - 48
        total += n if i % 2 == 0 else 2 * n - 9 * (n > 4)
    return total % 10 == 0


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """Goes from one @ to the next, since a pattern would try every start of a long run."""
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        domain = _DOMAIN.match(text, at + 1) if start < at else None
        if domain:
            done = domain.end()
            yield start, done
        at = text.find("@", max(at + 1, done))


def strict_spans(text: str) -> Iterator[tuple[str, int, int, bool]]:
    """(kind, start, stop, whether its check passes): leftmost, disjoint within a kind."""
    for start, stop in _emails(text):
        yield "email", start, stop, True
    if not _DIGITS.search(text):
        return
    for m in _IP.finditer(text):
        parts = (p.lstrip("0") or "0" for p in m[0].split("."))
        yield "ip", m.start(), m.end(), all(len(p) < 4 and int(p) < 256 for p in parts)
    for m in _CARD.finditer(text):
        digits = m[0].replace(" ", "").replace("-", "")
        if len(digits) >= 13:
            yield "card", m.start(), m.end(), 16 <= len(digits) <= 19 and luhn(digits)
    for m in _PHONE.finditer(text):
        n = sum("0" <= c <= "9" for c in m[0])
        yield "phone", m.start(), m.end(), 8 <= n <= 15


def _gazetteer(kind: str, span: str) -> int:
    digits = re.sub(r"[^0-9]", "", span)
    if kind == "email":
        return 1 if re.split(r"[^A-Za-z0-9-]+", span.rstrip(")] "))[-1].lower() in DOMAINS else -1
    if kind == "card":
        return 1 if ISSUERS.match(digits) else -1
    if kind == "phone":
        return (1 if COUNTRIES.match(digits) else -1) if span.startswith("+") else (-1 if digits[0] in "01" else 0)
    head = re.split(r"[.:]", span)[0].lstrip("0")
    return -1 if head in ("", "127", "255") else 1


def _context(kind: str, before: str, after: str) -> int:
    if CUES[kind].search(before) or CUES[kind].search(after[: CONTEXT // 2]):
        return 1
    return -1 if OTHER.search(before) else 0


def code_of(kind: str, text: str, start: int, stop: int, strict: int) -> int:
    """Votes in base 3, then shape: one separator throughout, clean ends."""
    span = text[start:stop]
    before, after = text[max(0, start - CONTEXT) : start], text[stop : stop + CONTEXT]
    votes = (strict, _gazetteer(kind, span), _context(kind, before, after))
    code = 0
    for v in votes:
        code = code * 3 + v + 1
    even = len(set(re.sub(r"[A-Za-z0-9]", "", span))) <= 1
    clean = not (before[-1:].isalnum() or after[:1].isalnum())
    return code * SHAPES + 2 * even + clean


def candidates(text: str) -> list[dict]:
    """Strict spans and looser ones that overlap no passing strict span."""
    out, taken = [], []
    for kind, start, stop, ok in strict_spans(text):
        code = code_of(kind, text, start, stop, 1 if ok else -1)
        out.append({"kind": KINDS.index(kind), "start": start, "stop": stop, "code": code, "base": ok})
        if ok:
            taken.append((start, stop))
    taken.sort()
    for kind, pattern in _LOOSE.items():
        i = 0
        for m in pattern.finditer(text):
            while i < len(taken) and taken[i][1] <= m.start():
                i += 1
            if i == len(taken) or taken[i][0] >= m.end():
                out.append(
                    {"kind": KINDS.index(kind), "start": m.start(), "stop": m.end(),
                     "code": code_of(kind, text, m.start(), m.end(), 0), "base": False}
                )
    return out


# --- models over counts of codes --------------------------------------------------------


def votes_of(code: int) -> list[int]:
    code //= SHAPES
    return [code // 3**i % 3 - 1 for i in reversed(range(LABELERS))]


def posteriors(counts: np.ndarray, rounds: int = 60) -> np.ndarray:
    """P(personal data | votes) for each code by expectation-maximisation.

    A labeler has a probability of voting yes, given that it votes, on true and on false
    spans; both have a prior worth ten votes that it is right four times in five, which also
    settles which class is which.
    """
    votes = np.array([votes_of(c) for c in range(CODES)])
    right, wrong, prior = np.full(LABELERS, 0.8), np.full(LABELERS, 0.2), 0.5
    for _ in range(rounds):
        yes = np.log(prior) + np.where(votes > 0, np.log(right), np.where(votes < 0, np.log(1 - right), 0)).sum(1)
        no = np.log(1 - prior) + np.where(votes > 0, np.log(wrong), np.where(votes < 0, np.log(1 - wrong), 0)).sum(1)
        post = 1 / (1 + np.exp(np.clip(no - yes, -50, 50)))
        a, b = counts * post, counts * (1 - post)
        prior = (a.sum() + 5) / (counts.sum() + 10)
        right = ((votes > 0).T @ a + 8) / ((votes != 0).T @ a + 10)
        wrong = ((votes > 0).T @ b + 2) / ((votes != 0).T @ b + 10)
    return post


def span_scores(counts: np.ndarray, rounds: int = 30, ridge: float = 1.0) -> np.ndarray:
    """Scores of all codes by a logistic classifier trained on the posteriors."""
    target = posteriors(counts)
    rows = []
    for code in range(CODES):
        shape = code % SHAPES
        rows.append([1.0, shape // 2, shape % 2, *(f(v) for v in votes_of(code) for f in (lambda v: v > 0, lambda v: v < 0))])
    x = np.array(rows, float)
    # Large corpora must not drown the ridge: counts weigh by their share of ten thousand.
    weight = counts * min(1.0, 1e4 / max(counts.sum(), 1))
    w = np.zeros(x.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (weight * p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(w)), x.T @ (weight * (target - p)) - ridge * w)
        w += step
    return 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))


# --- the job ----------------------------------------------------------------------------

_FOUND = pa.list_(
    pa.struct([("kind", pa.int32()), ("start", pa.int32()), ("stop", pa.int32()), ("code", pa.int32()), ("base", pa.bool_())])
)


def find(docs: DataFrame) -> DataFrame:
    """doc_id and ``spans``: array of (kind, start, stop, score, base), by kind, then start."""
    key = dict(docs.dtypes)["doc_id"]

    def scan(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for lo in range(0, whole.num_rows, SLICE):
                batch = whole.slice(lo, SLICE)
                found = [candidates(t) if t else [] for t in batch["text"].to_pylist()]
                yield pa.RecordBatch.from_arrays([batch["doc_id"], pa.array(found, _FOUND)], names=["doc_id", "found"])

    shape = "array<struct<kind: int, start: int, stop: int, code: int, base: boolean>>"
    found = stored(docs.select("doc_id", "text").mapInArrow(scan, f"doc_id {key}, found {shape}"), "pii")
    counted = found.selectExpr("explode(found) AS c").groupBy("c.kind", "c.code").agg(F.count("*").alias("n")).collect()
    counts = np.zeros((len(KINDS), CODES))
    for r in counted:
        counts[r.kind, r.code] = r.n
    scores = np.concatenate([span_scores(c) for c in counts])
    table = f"array({', '.join(f'{s:.6f}D' for s in scores)})"
    names = f"array({', '.join(repr(k) for k in KINDS)})"
    score = f"{table}[c.kind * {CODES} + c.code]"
    return found.selectExpr(
        "doc_id",
        f"transform(array_sort(filter(found, c -> c.base OR {score} >= {MIN_SCORE})), c -> struct("
        f"{names}[c.kind] AS kind, c.start AS start, c.stop AS stop, {score} AS score, c.base AS base)) AS spans",
    )


def report(found: DataFrame) -> DataFrame:
    """Counts, digest of the fixed patterns' spans, and all spans as text."""
    listed = "array_join(transform({}, s -> concat(s.kind, ':', s.start, ':', s.stop)), ',')"
    return found.selectExpr(
        "doc_id",
        *[f"CAST(size(filter(spans, s -> s.base AND s.kind = '{k}')) AS BIGINT) AS n_{k}" for k in KINDS],
        f"sha2({listed.format('filter(spans, s -> s.base)')}, 256) AS base_sha256",
        f"{listed.format('spans')} AS spans",
    )
