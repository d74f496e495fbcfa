"""BPE encoding and decoding with reuse of content-defined chunks.

A rolling hash over ``WINDOW`` bytes cuts texts into chunks where its value, and thus the
content, says so; equal passages of different documents are cut alike. First all chunks are
counted, by marks of ``MARK_BITS`` bits: the bitmap of the marks that occur more than once has a
fixed size, which bounds its broadcast, and no repeated chunk can be missing in it. Documents
without repeated chunks are encoded where they are read. The repeated chunks of the others go
to one place each, are encoded there once, and their ids come back to the documents that
have them.

Joins are repaired. Of a chunk only the words that are whole in it count; what lies between
the whole words of one chunk and those of the next is encoded in place, together with words of
both chunks beside it. Where the ids of these words are not exactly those that the text of the
chunk gives, more words are taken in, until both sides agree. The ids that come back with
the chunk are compared with them once more; a document in which they differ is encoded whole.

Chunks without ``WORDS`` whole words are encoded in place. The marks bound memory, not results:
when most marks are taken, rare chunks travel too, and nothing else changes.

Defined results: a null text is empty, and an empty text has no ids; repeated rows are encoded
alike; rows without doc_id are kept; an empty table gives no rows; other columns are ignored.
Exact for every tokenizer of the library that splits words at white space, or whose ids at
the joins show that it does not.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reqsieve.llm.common import stored
from reqsieve.llm.encoders import encoder, id_width, tokenizer_path

WINDOW = 16
# Mean and least bytes of a chunk.
CHUNK, LEAST = 512, 64
MARK_BITS = 27
# Whole words that a reused chunk has at least, and those taken in at a join.
WORDS, BESIDE = 8, 2
# Bytes of text cut at once.
SLICE_BYTES = 1 << 21

_BASE = 0x100000001B3
_SPACE = re.compile(rb"[ \t\n\r]+")


# --- chunks -----------------------------------------------------------------------------


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[:1] = 1
    return np.cumprod(out, dtype=np.uint64)


def cuts_of(texts: list[bytes], mean: int = CHUNK, least: int = LEAST) -> list[list[int]]:
    """Where each text is cut: the hash of the bytes before decides, and no character is split."""
    raw = np.frombuffer(b"".join(texts), np.uint8)
    sizes = np.array([len(t) for t in texts], np.int64)
    ends = np.cumsum(sizes)
    if len(raw) <= WINDOW:
        return [[] for _ in texts]
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum((raw.astype(np.uint64) + np.uint64(1)) * _powers(_BASE, len(raw)))])
    # The window before position i, shifted to the same power everywhere.
    value = (sums[WINDOW:-1] - sums[: -WINDOW - 1]) * _powers(pow(_BASE, -1, 1 << 64), len(raw) - WINDOW)
    value ^= value >> np.uint64(29)
    value *= np.uint64(0xBF58476D1CE4E5B9)
    places = np.flatnonzero((value >> np.uint64(32)) % np.uint64(mean) == 0) + WINDOW
    places = places[(raw[places] & 0xC0) != 0x80]
    owner = np.searchsorted(ends, places, side="right")
    out: list[list[int]] = [[] for _ in texts]
    for text, at in zip(owner.tolist(), (places - (ends - sizes)[owner]).tolist()):
        # A window that reaches into the text before says nothing about this one.
        if at >= max(WINDOW, least) and (not out[text] or at - out[text][-1] >= least):
            out[text].append(at)
    return out


def chunks_of(texts: list[bytes]) -> Iterator[list[tuple[int, int, bytes]]]:
    """(start, end, digest) of the chunks of each text."""
    for text, cuts in zip(texts, cuts_of(texts)):
        ends = [*cuts, len(text)]
        yield [(a, b, hashlib.md5(text[a:b]).digest()) for a, b in zip([0, *ends], ends) if b > a]


def _slices(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, list[str], list[bytes]]]:
    for batch in batches:
        lo, held, texts = 0, 0, []
        for i, value in enumerate(batch["text"]):
            texts.append(value.as_py() or "")
            held += len(texts[-1])
            if held >= SLICE_BYTES or i + 1 == batch.num_rows:
                yield batch.slice(lo, len(texts)), texts, [t.encode("utf-8", "replace") for t in texts]
                lo, held, texts = i + 1, 0, []


def mark_of(digest: bytes, bits: int) -> int:
    return int.from_bytes(digest[:8], "little") >> (64 - bits)


def repeated_marks(docs: DataFrame, bits: int = MARK_BITS) -> np.ndarray:
    """Bitmap (bytes) of the marks that chunks of ``docs`` bear more than once."""

    def run(batches):
        for _, _, texts in _slices(batches):
            marks = [mark_of(d, bits) for found in chunks_of(texts) for _, _, d in found]
            mark, n = np.unique(np.array(marks, np.int64), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(mark), pa.array(n)], names=["mark", "n"])

    marks = docs.select("text").mapInArrow(run, "mark bigint, n bigint").groupBy("mark").agg(F.sum("n").alias("n"))
    parts = marks.where("n > 1").groupBy(F.expr("mark >> 15").alias("part")).agg(
        F.expr("bitmap_construct_agg(mark & 32767)").alias("bits")
    )
    found = parts.toArrow()
    out = np.zeros((max(1, (1 << bits) >> 15), 4096), np.uint8)
    for part, data in zip(found["part"].to_pylist(), found["bits"].to_pylist()):
        out[part] = np.frombuffer(data, np.uint8)
    return out.reshape(-1)


# --- joins ------------------------------------------------------------------------------


class Core:
    """The whole words of a chunk: from ``first``, the start of a word, to ``last``, behind the
    white space after a word; ``spaces`` are the ends of the white space between."""

    def __init__(self, chunk: bytes):
        self.chunk = chunk
        spaces = [m.end() for m in _SPACE.finditer(chunk)]
        if spaces and spaces[-1] == len(chunk) and not chunk[-1:].strip() and len(spaces) > 1:
            # White space at the very end may go on in the next chunk.
            spaces.pop()
        self.spaces, self.words = spaces, len(spaces) - 1

    @property
    def inner(self) -> bytes:
        return self.chunk[self.spaces[0] : self.spaces[-1]]

    def last_words(self, n: int) -> bytes:
        return self.chunk[self.spaces[-1 - n] : self.spaces[-1]]

    def first_words(self, n: int) -> bytes:
        return self.chunk[self.spaces[0] : self.spaces[n]]


def plan(text: bytes, chunks: list, is_repeated, ids_of, words: int = WORDS, beside: int = BESIDE):
    """How to put the ids of ``text`` together, or None where no chunk of it is reused.

    (reused chunks, ids between them, ids that these share with the chunk before and after).
    """
    reused = []
    for a, b, digest in chunks:
        if is_repeated(digest):
            core = Core(text[a:b])
            if core.words >= words:
                reused.append((a, b, digest, core))
    if not reused:
        return None
    # The text between: behind the whole words of one chunk, up to those of the next.
    gaps, shares, at = [], [], 0
    edges = [(a + core.spaces[0], a + core.spaces[-1]) for a, _, _, core in reused]
    for i in range(len(reused) + 1):
        start, end = at, edges[i][0] if i < len(reused) else len(text)
        left, right = (reused[i - 1][3] if i else None), (reused[i][3] if i < len(reused) else None)
        n = beside
        while True:
            before = left.last_words(n) if left else b""
            after = right.first_words(n) if right else b""
            whole = ids_of(before + text[start:end] + after)
            a, b = ids_of(before), ids_of(after)
            if whole.startswith(a) and whole.endswith(b) and len(a) + len(b) <= len(whole):
                break
            n += 1
            if 2 * n > min(c.words for c in (left, right) if c):
                return None
        gaps.append(whole)
        shares += [len(a), len(b)]
        at = edges[i][1] if i < len(reused) else at
    return reused, gaps, shares


def joined(cores: list[bytes], gaps: list[bytes], shares: list[int]) -> bytes | None:
    """The ids of a document, None where a chunk's ids differ from those beside it."""
    out = []
    for i, gap in enumerate(gaps):
        a, b = shares[2 * i], shares[2 * i + 1]
        if i and a and cores[i - 1][-a:] != gap[:a]:
            return None
        if i < len(cores) and b and cores[i][:b] != gap[len(gap) - b :]:
            return None
        out.append(gap[a : len(gap) - b])
        if i < len(cores):
            out.append(cores[i])
    return b"".join(out)


# --- the job ----------------------------------------------------------------------------

_RESULT = "n_tokens bigint, ids_sha256 string, decoded_sha256 string"


def _results(ids: list[bytes | None], tokenizer, width: str) -> list[pa.Array]:
    """n_tokens and the digests of ids and decoded texts; nulls for None."""
    arrays = [np.frombuffer(b or b"", width) for b in ids]
    texts = tokenizer.decode_batch([a.tolist() for a in arrays], skip_special_tokens=False)
    none = [b is None for b in ids]
    sha = lambda data, skip: None if skip else hashlib.sha256(data).hexdigest()
    return [
        pa.array([None if skip else len(a) for a, skip in zip(arrays, none)], pa.int64()),
        pa.array([sha(a.astype("<u4").tobytes(), skip) for a, skip in zip(arrays, none)], pa.string()),
        pa.array([sha(t.encode("utf-8", "replace"), skip) for t, skip in zip(texts, none)], pa.string()),
    ]


def _split(docs: DataFrame, path: str, width: str, marks, bits: int) -> DataFrame:
    """One row per document: its results, or what they are put together from."""
    key = dict(docs.dtypes)["doc_id"]

    def run(batches):
        kept = encoder(path, width)
        ids_of = lambda data: kept.ids(data.decode("utf-8", "replace"))
        bitmap = np.frombuffer(marks.value, np.uint8)
        is_repeated = lambda digest: (lambda m: bitmap[m >> 3] >> (m & 7) & 1)(mark_of(digest, bits))
        for batch, texts, data in _slices(batches):
            ids, reuse = [], []
            for text, raw, chunks in zip(texts, data, chunks_of(data)):
                how = plan(raw, chunks, is_repeated, ids_of)
                reuse.append(how)
                ids.append(kept.ids(text) if how is None else None)
            lists = [
                [[d for _, _, d, _ in how[0]] if how else None for how in reuse],
                [[c.chunk for _, _, _, c in how[0]] if how else None for how in reuse],
                [how[1] if how else None for how in reuse],
            ]
            shares = pa.array([how[2] if how else None for how in reuse], pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays(
                [batch["row"], batch["doc_id"], batch["body"], *_results(ids, kept.tokenizer, width),
                 *(pa.array(x, pa.list_(pa.binary())) for x in lists), shares],
                names=["row", "doc_id", "body", "n_tokens", "ids_sha256", "decoded_sha256", "digests", "chunks", "gaps", "shares"],
            )

    rows = docs.selectExpr("monotonically_increasing_id() AS row", "doc_id", "md5(coalesce(text, '')) AS body", "text")
    return rows.mapInArrow(
        run,
        f"row bigint, doc_id {key}, body string, {_RESULT}, digests array<binary>, chunks array<binary>, "
        "gaps array<binary>, shares array<int>",
    )


def _encoded_chunks(pieces: DataFrame, path: str, width: str) -> DataFrame:
    """(digest, core): every reused chunk, encoded once, without the ids of its cut words."""

    def run(batches):
        kept = encoder(path, width)
        ids_of = lambda data: kept.ids(data.decode("utf-8", "replace"))
        for batch in batches:
            out = []
            for chunk in batch["chunk"].to_pylist():
                core = Core(chunk)
                whole = ids_of(chunk)
                head, tail = ids_of(chunk[: core.spaces[0]]), ids_of(chunk[core.spaces[-1] :])
                out.append(whole[len(head) : len(whole) - len(tail)])
            yield pa.RecordBatch.from_arrays([batch["digest"], pa.array(out, pa.binary())], names=["digest", "core"])

    found = pieces.where("digests IS NOT NULL").selectExpr("inline(arrays_zip(digests, chunks)) AS (digest, chunk)")
    once = found.groupBy("digest").agg(F.first("chunk").alias("chunk"))
    return once.mapInArrow(run, "digest binary, core binary")


def _finished(pieces: DataFrame, encoded: DataFrame, path: str, width: str) -> DataFrame:
    open_ = pieces.where("digests IS NOT NULL")
    refs = open_.selectExpr("row AS owner", "posexplode(digests) AS (at, digest)").join(encoded, "digest")
    cores = refs.groupBy("owner").agg(F.expr("transform(array_sort(collect_list(struct(at, core))), x -> x.core)").alias("cores"))

    def run(batches):
        tokenizer = encoder(path, width).tokenizer
        for whole in batches:
            for lo in range(0, whole.num_rows, 256):
                batch = whole.slice(lo, 256)
                ids = [joined(*parts) for parts in zip(*(batch[c].to_pylist() for c in ("cores", "gaps", "shares")))]
                yield pa.RecordBatch.from_arrays(
                    [batch["doc_id"], batch["body"], *_results(ids, tokenizer, width)],
                    names=["doc_id", "body", "n_tokens", "ids_sha256", "decoded_sha256"],
                )

    both = open_.select("row", "doc_id", "body", "gaps", "shares").join(cores, F.expr("row = owner"))
    key = dict(pieces.dtypes)["doc_id"]
    return both.select("doc_id", "body", "gaps", "shares", "cores").mapInArrow(run, f"doc_id {key}, body string, {_RESULT}")


def _whole(docs: DataFrame, path: str, width: str) -> DataFrame:
    def run(batches):
        kept = encoder(path, width)
        for batch, texts, _ in _slices(batches):
            yield pa.RecordBatch.from_arrays(
                [batch["doc_id"], *_results([kept.ids(t) for t in texts], kept.tokenizer, width)],
                names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
            )

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {dict(docs.dtypes)['doc_id']}, {_RESULT}")


def encode_and_decode(docs: DataFrame, tokenizer: str | None = None, mark_bits: int = MARK_BITS) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of every row: the digests of its ids, as
    unsigned 32-bit little-endian integers, and of the text that they decode to, in UTF-8."""
    path = tokenizer or tokenizer_path()
    width = id_width(path)
    docs = docs.select("doc_id", "text")
    marks = docs.sparkSession.sparkContext.broadcast(repeated_marks(docs, mark_bits).tobytes())
    pieces = stored(_split(docs, path, width, marks, mark_bits), "encoded-parts")
    marks.destroy()
    encoded = stored(_encoded_chunks(pieces, path, width), "encoded-chunks")
    finished = stored(_finished(pieces, encoded, path, width), "encoded-documents")
    columns = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
    out = pieces.where("digests IS NULL").select(columns).unionByName(finished.where("n_tokens IS NOT NULL").select(columns))
    apart = finished.where("n_tokens IS NULL").groupBy("doc_id", "body").agg(F.count("*").alias("n"))
    if apart.isEmpty():
        return out
    again = docs.withColumn("body", F.expr("md5(coalesce(text, ''))")).join(
        apart.selectExpr("doc_id AS id", "body AS own"), F.expr("doc_id <=> id AND body = own")
    )
    return out.unionByName(_whole(again, path, width))
