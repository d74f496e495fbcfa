"""Token-id files: canonical length-limited Huffman codes, decoded by table in blocks.

Writing: documents are encoded where they are read, and each task counts its ids meanwhile.
The ids, not the texts, are then dealt out by range of doc_id. Package-merge turns the counts of
all ids into code lengths of at most ``MAX_BITS``; each range packs runs of whole documents into
segments. A segment is one row of a Parquet file: its range and the ids of the range before it,
its documents and their lengths, the bits, and the bit offset of every ``BLOCK``-th id. File
numbers follow the ranges, and segments within a file follow each other, so the files hold the
ids in ascending order of doc_id. The code table is stored beside them as (id, length):
canonical codes follow from the lengths.

Reading: the blocks of a segment are independent, so all of them are decoded side by side,
one id of each per step, by one lookup in a table of 2^MAX_BITS entries.

Parquet holds the segments because its commit protocol makes a lost task's file reappear
whole. A document is never split, so memory is bounded by the longest document.

Defined results: a null text is empty, and an empty text is the end id alone; documents come
in ascending doc_id, nulls first, rows that share an id in the order of the input; an empty
table gives no segments; other columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from reqsieve.llm.common import stored
from reqsieve.llm.encoders import encoder, id_width, tokenizer_path

END_ID = 1
MAX_BITS = 18
BLOCK = 256
SEGMENT_IDS = 1 << 18
# Rows of a batch tokenised at once.
SLICE = 256


# --- ids of texts -----------------------------------------------------------------------


def tokenize(docs: DataFrame, path: str | None = None, end_id: int = END_ID) -> DataFrame:
    """doc_id, row, n_tokens, ids (little-endian, end id last) of each document.

    Each task adds one row of its own, which has no ids but the different ids that it met in
    ``seen`` and how often in ``times``.
    """
    path = path or tokenizer_path()
    width = id_width(path, end_id)

    def encode(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids_of, size = encoder(path, width).ids, np.dtype(width).itemsize
        end = np.array([end_id], width).tobytes()
        total = np.zeros(0, np.int64)
        for whole in batches:
            for lo in range(0, whole.num_rows, SLICE):
                batch = whole.slice(lo, SLICE)
                ids = [ids_of(t or "") + end for t in batch["text"].to_pylist()]
                found = np.bincount(np.frombuffer(b"".join(ids), width), minlength=len(total))
                found[: len(total)] += total
                total = found
                n = len(ids)
                yield pa.RecordBatch.from_arrays(
                    [batch["doc_id"], batch["row"], pa.array([len(b) // size for b in ids], pa.int64()), pa.array(ids, pa.binary()),
                     pa.nulls(n, pa.list_(pa.int32())), pa.nulls(n, pa.list_(pa.int64()))],
                    names=["doc_id", "row", "n_tokens", "ids", "seen", "times"],
                )
        seen = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays(
            [pa.nulls(1, key), pa.nulls(1, pa.int64()), pa.nulls(1, pa.int64()), pa.nulls(1, pa.binary()),
             pa.array([seen], pa.list_(pa.int32())), pa.array([total[seen]], pa.list_(pa.int64()))],
            names=["doc_id", "row", "n_tokens", "ids", "seen", "times"],
        )

    texts = docs.selectExpr("doc_id", "text", "monotonically_increasing_id() AS row")
    key = texts.select("doc_id").limit(0).toArrow().schema.field("doc_id").type
    return texts.mapInArrow(
        encode,
        f"doc_id {dict(docs.dtypes)['doc_id']}, row bigint, n_tokens bigint, ids binary, seen array<int>, times array<bigint>",
    )


# --- codes ------------------------------------------------------------------------------


def code_lengths(counts: np.ndarray, limit: int = MAX_BITS) -> np.ndarray:
    """Lengths of an optimal prefix code of at most ``limit`` bits, by package-merge."""
    n = len(counts)
    if n > 1 << limit:
        raise ValueError(f"{n} symbols need more than {limit} bits")
    if n < 2:
        return np.ones(n, np.int64)
    order = np.argsort(counts, kind="stable")
    leaves = np.asarray(counts, np.float64)[order]
    level, is_leaf = np.empty(0), []
    for _ in range(limit):
        packages = level[: len(level) // 2 * 2].reshape(-1, 2).sum(axis=1)
        both = np.concatenate([leaves, packages])
        by_weight = np.argsort(both, kind="stable")
        level = both[by_weight]
        is_leaf.append(by_weight < n)
    lengths, take = np.zeros(n, np.int64), 2 * n - 2
    for flags in reversed(is_leaf):
        chosen = int(flags[:take].sum())
        lengths[:chosen] += 1
        take = 2 * (take - chosen)
    out = np.empty(n, np.int64)
    out[order] = lengths
    return out


class Codec:
    """Canonical code of (id, length) pairs: codes by length, then id."""

    def __init__(self, ids: np.ndarray, lengths: np.ndarray, max_bits: int = MAX_BITS):
        order = np.lexsort((ids, lengths))
        self.ids, self.lengths, self.max_bits = ids[order], lengths[order].astype(np.int64), max_bits
        spans = np.left_shift(1, max_bits - self.lengths)
        first = np.cumsum(spans) - spans
        self.codes = first >> (max_bits - self.lengths)
        # Entry: id and length of the code that begins the next max_bits bits.
        table = np.repeat(self.ids.astype(np.int64) << 5 | self.lengths, spans)
        self.table = np.concatenate([table, np.full((1 << max_bits) - len(table), 1, np.int64)])
        top = int(ids.max()) + 1 if len(ids) else 0
        self.code_of, self.length_of = np.zeros(top, np.uint64), np.zeros(top, np.int64)
        self.code_of[self.ids], self.length_of[self.ids] = self.codes, self.lengths

    def encode(self, ids: np.ndarray, block: int = BLOCK) -> tuple[bytes, np.ndarray]:
        """Bits, first bit highest, and the bit offset of every ``block``-th id."""
        sizes = self.length_of[ids]
        ends = np.cumsum(sizes)
        starts = ends - sizes
        words = np.zeros(int(ends[-1] if len(ends) else 0) // 64 + 2, np.uint64)
        at, room = starts >> 6, 64 - (starts & 63) - sizes
        code = self.code_of[ids]
        over = room < 0
        here = np.where(over, code >> np.maximum(-room, 0).astype(np.uint64), code << np.maximum(room, 0).astype(np.uint64))
        if len(ids):
            first = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]]))
            words[at[first]] = np.bitwise_or.reduceat(here, first)
            words[at[over] + 1] |= code[over] << (64 + room[over]).astype(np.uint64)
        used = (int(ends[-1]) + 7) // 8 if len(ends) else 0
        return words.astype(">u8").tobytes()[:used], starts[::block]

    def decode(self, bits: bytes, checkpoints: np.ndarray, n: int, block: int = BLOCK) -> np.ndarray:
        words = np.frombuffer(bits + b"\0" * (24 - len(bits) % 8), ">u8").astype(np.uint64)
        at, last = np.asarray(checkpoints, np.int64).copy(), len(words) - 2
        out = np.empty((min(block, n), len(at)), np.int64)
        down, one = np.uint64(64 - self.max_bits), np.uint64(1)
        for step in range(len(out)):
            word, shift = np.minimum(at >> 6, last), (at & 63).astype(np.uint64)
            window = words[word] << shift | words[word + 1] >> one >> (np.uint64(63) - shift)
            entry = self.table[window >> down]
            out[step] = entry >> 5
            at += entry & 31
        return out.T.reshape(-1)[:n]


# --- files ------------------------------------------------------------------------------

_SEGMENT = "part int, before bigint, n_tokens bigint, doc_ids array<{key}>, doc_tokens array<bigint>, checkpoints array<bigint>, bits binary"


def write_token_files(docs: DataFrame, path: str, tokenizer: str | None = None, end_id: int = END_ID) -> None:
    """Tokenise and write ``<path>/codes`` and ``<path>/segments``."""
    spark = docs.sparkSession
    tokens = stored(tokenize(docs, tokenizer, end_id), "token-ids")
    width = id_width(tokenizer or tokenizer_path(), end_id)
    # The vocabulary bounds what reaches the driver.
    counts = tokens.where("seen IS NOT NULL").selectExpr("inline(arrays_zip(seen, times))").groupBy("seen").agg(F.sum("times").alias("n"))
    rows = counts.orderBy("seen").toArrow()
    ids = rows["seen"].to_numpy()
    lengths = code_lengths(rows["n"].to_numpy())
    pairs = list(zip(ids.tolist(), lengths.tolist()))
    spark.createDataFrame(pairs, "id int, length int").coalesce(1).write.parquet(f"{path}/codes")

    def pack(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec, part = Codec(ids, lengths), TaskContext.get().partitionId()
        # ``before`` counts the ids of this range ahead of the segment that is being filled.
        pieces, doc_ids, doc_tokens, before, held = [], [], [], 0, 0

        def segment() -> pa.RecordBatch:
            bits, checkpoints = codec.encode(np.frombuffer(b"".join(pieces), width))
            return pa.RecordBatch.from_arrays(
                [
                    pa.array([part], pa.int32()), pa.array([before]), pa.array([held]),
                    pa.ListArray.from_arrays(pa.array([0, sum(map(len, doc_ids))], pa.int32()), pa.concat_arrays(doc_ids)),
                    pa.array([np.concatenate(doc_tokens)], pa.list_(pa.int64())),
                    pa.array([checkpoints], pa.list_(pa.int64())), pa.array([bits], pa.binary()),
                ],
                names=["part", "before", "n_tokens", "doc_ids", "doc_tokens", "checkpoints", "bits"],
            )

        for batch in batches:
            n, data = batch["n_tokens"].to_numpy(), batch["ids"].to_pylist()
            # A segment is the documents that begin within the same SEGMENT_IDS ids.
            number = (before + held + np.cumsum(n) - n) // SEGMENT_IDS
            cuts = [0, *(np.flatnonzero(number[1:] != number[:-1]) + 1).tolist(), len(n)]
            for lo, hi in zip(cuts, cuts[1:]):
                if held and number[lo] != before // SEGMENT_IDS:
                    yield segment()
                    before += held
                    pieces, doc_ids, doc_tokens, held = [], [], [], 0
                pieces += data[lo:hi]
                doc_ids.append(batch["doc_id"].slice(lo, hi - lo))
                doc_tokens.append(n[lo:hi])
                held += int(n[lo:hi].sum())
        if held:
            yield segment()

    dealt = (
        tokens.where("seen IS NULL").select("doc_id", "row", "n_tokens", "ids")
        .repartitionByRange("doc_id", "row").sortWithinPartitions("doc_id", "row")
    )
    segments = dealt.mapInArrow(pack, _SEGMENT.format(key=dict(docs.dtypes)["doc_id"]))
    segments.write.option("compression", "uncompressed").parquet(f"{path}/segments")


def read_token_files(spark: SparkSession, path: str, with_ids: bool = True) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 and, if wanted, ids of every document in the files."""
    codes = spark.read.parquet(f"{path}/codes").toArrow()
    code_ids, lengths = codes["id"].to_numpy(), codes["length"].to_numpy()
    segments = spark.read.parquet(f"{path}/segments")
    key = dict(segments.dtypes)["doc_ids"].removeprefix("array<").removesuffix(">")
    # One total per range: as many rows as partitions.
    totals = segments.groupBy("part").agg(F.sum("n_tokens").alias("n")).orderBy("part").toArrow()
    ends = np.cumsum(totals["n"].to_numpy())
    start_of = dict(zip(totals["part"].to_pylist(), (ends - totals["n"].to_numpy()).tolist()))

    def unpack(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = Codec(code_ids, lengths)
        for batch in batches:
            for part, before, n, docs, sizes, checkpoints, bits in zip(
                *(batch[c] for c in ("part", "before", "n_tokens", "doc_ids", "doc_tokens", "checkpoints", "bits"))
            ):
                ids = codec.decode(bits.as_py(), checkpoints.values.to_numpy(), n.as_py()).astype("<u4")
                sizes = sizes.values.to_numpy(zero_copy_only=False)
                ends = np.cumsum(sizes)
                starts = ends - sizes
                data = memoryview(ids.tobytes())
                crcs = [zlib.crc32(data[4 * a : 4 * b]) for a, b in zip(starts.tolist(), ends.tolist())]
                start = start_of[part.as_py()] + before.as_py()
                columns = [docs.values, pa.array(start + starts), pa.array(sizes), pa.array(crcs, pa.int64())]
                names = ["doc_id", "start", "n_tokens", "ids_crc32"]
                if with_ids:
                    offsets = pa.array(np.append(starts, ends[-1:]).astype(np.int32))
                    columns.append(pa.ListArray.from_arrays(offsets, pa.array(ids.astype(np.int32))))
                    names.append("ids")
                yield pa.RecordBatch.from_arrays(columns, names=names)

    schema = f"doc_id {key}, start bigint, n_tokens bigint, ids_crc32 bigint" + ", ids array<int>" * with_ids
    return segments.select("part", "before", "n_tokens", "doc_ids", "doc_tokens", "checkpoints", "bits").mapInArrow(unpack, schema)
