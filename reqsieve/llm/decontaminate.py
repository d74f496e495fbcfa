"""Benchmark decontamination with a generalised suffix automaton over words.

The normalised test items are dealt into blocks of a bounded number of words. The tasks of a
Spark job build one automaton per block and write it as flat arrays; the driver only passes
them on, one block at a time. A document streams its words through an automaton and tracks the
longest suffix that some item contains. Where that reaches the window length, the last
``window`` words are a window of an item. An item shorter than the window is one window as a
whole.

Each block is one pass over the documents, which carry the spans and items found so far to the
next pass. So a task holds one block, however many items there are, and more items mean more
passes; nothing is left out. The benchmark of one block, the usual case, is one pass.

Defined results: null and empty texts have no words, no hits and are clean; items without
words never occur; items with equal ids count once, and items without id cover words but are
not listed; repeated documents are judged each for itself; an empty table of items leaves every
document clean; other columns are ignored (``decontaminate`` keeps all columns, whatever their
names). With ``cut`` a column n_chars is brought up to date.
"""

from __future__ import annotations

import hashlib
import pickle
from bisect import bisect_left
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reqsieve.llm.common import WORD_BYTES, named, numbered, running_sums, stored, words_of

WINDOW = 13
COVERAGE = 0.05
# Words of test items in one automaton (at most twice as many states).
BLOCK_WORDS = 250_000
# Rows of a batch taken into Python at once.
SLICE = 256

FINDINGS = "n_words bigint, n_hit bigint, n_items bigint, items_sha256 string, contaminated boolean"


class Automaton:
    """Generalised suffix automaton of word sequences, closed by :meth:`flat`."""

    def __init__(self, window: int):
        self.window = window
        self.vocabulary: dict[bytes, int] = {}
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        self.items: list[tuple[str | None, list[int]]] = []

    def add(self, item_id: str | None, words: list[bytes]) -> None:
        ids = [self.vocabulary.setdefault(w, len(self.vocabulary)) for w in words]
        self.items.append((item_id, ids))
        last = 0
        for w in ids:
            last = self._extend(last, w)

    def _extend(self, last: int, w: int) -> int:
        nxt, link, length = self.next, self.link, self.length
        known = nxt[last].get(w)
        if known is not None:
            return known if length[known] == length[last] + 1 else self._split(last, w, known)
        state = self._state(length[last] + 1, {}, 0)
        p = last
        while p >= 0 and w not in nxt[p]:
            nxt[p][w] = state
            p = link[p]
        if p >= 0:
            q = nxt[p][w]
            link[state] = q if length[q] == length[p] + 1 else self._split(p, w, q)
        return state

    def _state(self, length: int, edges: dict[int, int], link: int) -> int:
        self.next.append(edges)
        self.length.append(length)
        self.link.append(link)
        return len(self.link) - 1

    def _split(self, p: int, w: int, q: int) -> int:
        """Give the suffixes of ``q`` that end a path from ``p`` a state of their own."""
        copy = self._state(self.length[p] + 1, dict(self.next[q]), self.link[q])
        self.link[q] = copy
        while p >= 0 and self.next[p].get(w) == q:
            self.next[p][w] = copy
            p = self.link[p]
        return copy

    def flat(self) -> Flat:
        """The automaton as arrays, with the windows and short items that end at each state."""
        n = len(self.link)
        order = sorted(range(n), key=self.length.__getitem__)
        window_of = [-1] * n  # the state of the last `window` words
        owners: dict[int, list[int]] = {}
        short: dict[int, tuple[int, list[int]]] = {}
        for s in order[1:]:
            if self.length[s] >= self.window:
                up = self.link[s]
                window_of[s] = s if self.length[up] < self.window else window_of[up]
        for item, (item_id, ids) in enumerate(self.items):
            state = length = 0
            for w in ids:
                state, length = self.next[state][w], length + 1
                if length >= self.window:
                    own = owners.setdefault(window_of[state], [])
                    if item_id is not None and (not own or own[-1] != item):
                        own.append(item)
            if 0 < length < self.window:
                found = short.setdefault(state, (length, []))
                if item_id is not None:
                    found[1].append(item)
        # Short items end at a state or at one up its chain of links; point to the nearest.
        nearest = [0] * n
        for s in order[1:]:
            nearest[s] = s if s in short else nearest[self.link[s]]
        edges = [sorted(e.items()) for e in self.next]
        starts = np.cumsum([0, *map(len, edges)], dtype=np.int32)
        words = sorted(self.vocabulary, key=self.vocabulary.__getitem__)
        array = lambda x: np.fromiter(x, np.int32)
        return Flat(
            self.window, b" ".join(words), starts, array(w for e in edges for w, _ in e), array(t for e in edges for _, t in e),
            array(self.link), array(self.length), array(window_of), array(nearest),
            owners, short, [item_id for item_id, _ in self.items],
        )


class Flat:
    """An automaton to read: edges sorted by state and word, one array per property."""

    def __init__(self, window, words, starts, edge_words, targets, link, length, window_of, nearest, owners, short, names):
        self.parts = (window, words, starts, edge_words, targets, link, length, window_of, nearest, owners, short, names)
        self.window, self.owners, self.short, self.names = window, owners, short, names
        # Words are bytes without blanks. Memory views give plain numbers without a copy.
        self.vocabulary = {w: i for i, w in enumerate(words.split(b" "))} if words else {}
        arrays = (starts, edge_words, targets, link, length, window_of, nearest)
        self.starts, self.edge_words, self.targets, self.link, self.length, self.window_of, self.nearest = map(memoryview, arrays)

    def step(self, state: int, word: int) -> int:
        """The state behind the edge of ``word``, -1 without one."""
        end = self.starts[state + 1]
        at = bisect_left(self.edge_words, word, self.starts[state], end)
        return self.targets[at] if at < end and self.edge_words[at] == word else -1

    def hits(self, words: list[bytes]) -> tuple[list[tuple[int, int]], set[str]]:
        """Disjoint spans of hit words, in order, and the items whose windows occur."""
        spans: list[tuple[int, int]] = []
        found: set[int] = set()
        seen: set[int] = set()
        link, length, window, step = self.link, self.length, self.window, self.step
        window_of, nearest, short = self.window_of, self.nearest, self.short
        state = run = 0
        for i, w in enumerate(map(self.vocabulary.get, words)):
            if w is None:
                state = run = 0
                continue
            after = step(state, w)
            while after < 0 and state:
                state = link[state]
                run = length[state]
                after = step(state, w)
            if after < 0:
                state = run = 0
                continue
            state, run = after, run + 1
            wide = 0
            if run >= window:
                wide = window
                at = window_of[state]
                if at not in seen:
                    seen.add(at)
                    found.update(self.owners.get(at, ()))
            at = nearest[state]
            while at:
                size, items = short[at]
                if size <= run:
                    wide = max(wide, size)
                    found.update(items)
                at = nearest[link[at]]
            if wide:
                start = i + 1 - wide
                while spans and spans[-1][1] >= start:
                    start = min(start, spans.pop()[0])
                spans.append((start, i + 1))
        return spans, {self.names[item] for item in found}


def automata(items: DataFrame, window: int, block_words: int) -> DataFrame:
    """(block, automaton): one row per block of items, built where the block's items meet.

    Blocks are runs of items of about ``block_words`` words, so a group has at most that many
    words and one item more.
    """
    sized = stored(
        items.selectExpr(
            "CAST(item_id AS STRING) AS item_id", "text", "octet_length(coalesce(text, '')) + 1 AS size",
            "xxhash64(item_id, text) AS place",
        ),
        "test-items",
    )
    # Six bytes a word: blocks are cut by size, so that no text is split into words here.
    placed = running_sums(sized, ["place"], {"before": "size"}, "test-items")

    def build(group: pa.Table) -> pa.Table:
        automaton = Automaton(window)
        for item_id, text in zip(group["item_id"].to_pylist(), group["text"].to_pylist()):
            words = words_of(text)
            if words:
                automaton.add(item_id, words)
        return pa.table({"automaton": pa.array([pickle.dumps(automaton.flat().parts, 5)], pa.binary())})

    blocks = placed.selectExpr(f"CAST(before div {6 * block_words} AS INT) AS block", "item_id", "text")
    return blocks.groupBy("block").applyInArrow(build, "automaton binary")


def _merge(a: list[tuple[int, int]], b: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for lo, hi in sorted(a + b):
        if out and lo <= out[-1][1]:
            out[-1] = (out[-1][0], max(hi, out[-1][1]))
        else:
            out.append((lo, hi))
    return out


def cut_spans(text: str, spans: Iterable[tuple[int, int]]) -> str:
    """The text without the bytes from the first to the last word of each span."""
    data = text.encode("utf-8", "replace")
    plain, starts, at = data.translate(WORD_BYTES), [], 0
    for w in plain.split():
        at = plain.index(w, at)
        starts.append((at, at + len(w)))
        at += len(w)
    out, done = [], 0
    for lo, hi in spans:
        out.append(data[done : starts[lo][0]])
        done = starts[hi - 1][1]
    return b"".join([*out, data[done:]]).decode("utf-8")


_STATE = "struct<spans: array<int>, items: array<string>>"


def _judged(docs: DataFrame, items: DataFrame, window: int, coverage: float, block_words: int, cut: bool) -> DataFrame:
    """``docs``, numbered, with the findings; with ``cut`` the text has lost its hit spans."""
    sc = docs.sparkSession.sparkContext
    blocks = stored(automata(items, window, block_words), "automata").toLocalIterator()
    at, width = docs.columns.index("text"), len(docs.columns)
    schema = ", ".join(f"c{i} {t}" for i, (_, t) in enumerate(docs.dtypes))
    none = pickle.dumps(Automaton(window).flat().parts, 5)

    def passed(block: bytes, first: bool, last: bool):
        def judge(words: list[bytes], automaton: Flat, before: dict | None):
            spans, found = automaton.hits(words)
            if before and before["spans"]:
                told = iter(before["spans"])
                spans, found = _merge(spans, list(zip(told, told))), found | set(before["items"])
            return spans, found

        def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            automaton = Flat(*pickle.loads(block))
            for whole in batches:
                for lo in range(0, whole.num_rows, SLICE):
                    batch = whole.slice(lo, SLICE)
                    texts = batch.column(at).to_pylist()
                    befores = [None] * len(texts) if first else batch.column(width).to_pylist()
                    words = [words_of(t) for t in texts]
                    judged = [judge(w, automaton, x) for w, x in zip(words, befores)]
                    columns = list(batch.columns[:width])
                    names = [f"c{i}" for i in range(width)]
                    if not last:
                        state = [{"spans": [x for s in spans for x in s], "items": sorted(found)} for spans, found in judged]
                        kind = pa.struct([("spans", pa.list_(pa.int32())), ("items", pa.list_(pa.string()))])
                        yield pa.RecordBatch.from_arrays([*columns, pa.array(state, kind)], names=[*names, "state"])
                        continue
                    if cut:
                        columns[at] = pa.array([cut_spans(t, s) if s else t for t, (s, _) in zip(texts, judged)], columns[at].type)
                    n_hit = [sum(hi - lo for lo, hi in spans) for spans, _ in judged]
                    bad = [n > 0 and n + 1e-9 >= coverage * len(w) for n, w in zip(n_hit, words)]
                    digests = [hashlib.sha256(",".join(sorted(found)).encode()).hexdigest() for _, found in judged]
                    found = [
                        pa.array(list(map(len, words)), pa.int64()), pa.array(n_hit, pa.int64()),
                        pa.array([len(f) for _, f in judged], pa.int64()), pa.array(digests), pa.array(bad, pa.bool_()),
                    ]
                    yield pa.RecordBatch.from_arrays(
                        [*columns, *found], names=[*names, "n_words", "n_hit", "n_items", "items_sha256", "contaminated"]
                    )

        return run

    current, first = numbered(docs), True
    block = next(blocks, None)
    block = bytes(block.automaton) if block else none
    while block is not None:
        following = next(blocks, None)
        last = following is None
        out = f"{schema}, {FINDINGS}" if last else f"{schema}, state {_STATE}"
        # A function of this size is sent as a broadcast, which Spark drops with it.
        current = current.mapInArrow(passed(block, first, last), out)
        if not last:
            current = stored(current, "decontaminated")
        block, first = (None if last else bytes(following.automaton)), False
    return current


def contamination(
    docs: DataFrame, items: DataFrame, window: int = WINDOW, coverage: float = COVERAGE,
    block_words: int = BLOCK_WORDS,
) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated for every row."""
    found = _judged(docs.select("doc_id", "text"), items, window, coverage, block_words, False)
    return found.withColumnRenamed("c0", "doc_id").drop("c1")


def decontaminate(
    docs: DataFrame, items: DataFrame, window: int = WINDOW, coverage: float = COVERAGE,
    block_words: int = BLOCK_WORDS, cut: bool = False,
) -> DataFrame:
    """``docs`` without the contaminated documents.

    Documents below the coverage limit stay as they are; with ``cut`` they lose every span of
    hit words, which are ``window`` words or longer or whole short items.
    """
    found = _judged(docs, items, window, coverage, block_words, cut).where("NOT contaminated")
    if cut and "n_chars" in docs.columns:
        i, t = docs.columns.index("n_chars"), docs.columns.index("text")
        kind = docs.dtypes[i][1]
        found = found.withColumn(f"c{i}", F.expr(f"CASE WHEN n_hit > 0 THEN CAST(char_length(c{t}) AS {kind}) ELSE c{i} END"))
    return named(found, docs)
