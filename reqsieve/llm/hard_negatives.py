"""Hard-negative mining with exact integer scores from float32 matrix products.

Components are scaled and floored to integers. A score is the inner product of two such
vectors. It is computed in a residue number system: each matrix is reduced modulo a few primes
to residues around zero, small enough that a float32 product of ``DIMS`` dimensions stays below
2^24 and is thus exact; products of more dimensions are added up modulo the prime; Chinese
remaindering puts the residues together again. The number of primes follows from the greatest
norm in the table, which bounds every score.

Anchors are a stated set of query rows. They are taken in blocks of at most about
``ANCHOR_BLOCK`` rows, and each block, which is what the tasks receive, meets all rows in two
passes: one for its positives, one for the negatives in the window below each positive. A task
keeps the first few rows per anchor (or anchor and positive) of what it has seen, so its memory
does not grow with the table, and no pair of rows is ever written. Repeated or very similar
vectors change nothing in this: rows are dealt as the input is, not by label or value.

Defined results: rows with a null id, label or vector, or with a null or non-finite component
take no part; a shorter vector counts as filled up with zeros; rows that share an id are
different rows, so a copy of an anchor can be its positive; an anchor without positives, or
without rows in a window, gives no rows; an empty table gives no rows; other columns are ignored.
Vectors so large that a score could leave 64 bits raise an error.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reqsieve.llm.common import stored

SCALE = 256
POSITIVES = 5
NEGATIVES = 5
# A negative scores between LOW and HIGH percent of its positive.
LOW, HIGH = 80, 100
ANCHOR_BLOCK = 8192
# Dimensions multiplied at once, and entries of a block of scores.
DIMS = 256
SCORES = 1 << 20
# Scores stay below this, so that percentages of them fit 64 bits.
MOST = (1 << 63) // 128


# --- residue arithmetic -----------------------------------------------------------------


def primes_for(bound: int, dims: int) -> list[int]:
    """Primes whose product exceeds 2 * bound, the largest first; the residues of ``dims``
    (at most ``DIMS``) dimensions multiply and add up to less than 2^24."""
    half = math.isqrt(((1 << 24) - 1) // max(1, min(dims, DIMS)))
    found, product, p = [], 1, min(2 * half + 1, 1021)
    while product <= 2 * bound or not found:
        if p < 3:
            raise ValueError("scores are out of range")
        if all(p % q for q in range(2, math.isqrt(p) + 1)):
            found.append(p)
            product *= p
        p -= 1
    return found


def residues(matrix: np.ndarray, primes: list[int]) -> list[np.ndarray]:
    """``matrix`` modulo each prime, as float32 between -p/2 and p/2."""
    out = []
    for p in primes:
        r = np.mod(matrix, p)
        out.append(np.where(r > p // 2, r - p, r).astype(np.float32))
    return out


def products(a: list[np.ndarray], b: list[np.ndarray], primes: list[int]) -> np.ndarray:
    """Exact a @ b.T as int64, from the residues of both; mixed-radix reconstruction."""
    total, weight = None, 1
    for x, y, p in zip(a, b, primes):
        r = np.zeros((len(x), len(y)), np.int32)
        for lo in range(0, x.shape[1], DIMS):
            r = (r + (x[:, lo : lo + DIMS] @ y[:, lo : lo + DIMS].T).astype(np.int32)) % np.int32(p)
        if total is None:
            total = r.astype(np.int64)
        else:
            # The digit that makes the number agree modulo this prime too.
            digit = ((r - total % p) * pow(weight, -1, p)) % p
            total += digit * weight
        weight *= p
    return np.where(total > weight // 2, total - weight, total)


# --- the first few of each group --------------------------------------------------------


class Best:
    """For each of ``n`` groups its first ``k`` rows by score descending, id ascending."""

    def __init__(self, n: int, k: int):
        self.k = k
        self.group = np.zeros(0, np.int64)
        self.score, self.id, self.row = (np.zeros(0, np.int64) for _ in range(3))
        # Below its floor nothing can enter a group any more.
        self.floor = np.full(n, np.iinfo(np.int64).min)

    def add(self, group: np.ndarray, score: np.ndarray, ids: np.ndarray, rows: np.ndarray) -> None:
        new = score >= self.floor[group]
        group = np.concatenate([self.group, group[new]])
        score = np.concatenate([self.score, score[new]])
        ids, rows = np.concatenate([self.id, ids[new]]), np.concatenate([self.row, rows[new]])
        order = np.lexsort((rows, ids, -score, group))
        group = group[order]
        start = np.searchsorted(group, group, side="left")
        place = np.arange(len(group)) - start
        keep = order[place < self.k]
        self.floor[group[place == self.k - 1]] = score[order[place == self.k - 1]]
        kept = place < self.k
        self.group, self.score, self.id, self.row = group[kept], score[keep], ids[keep], rows[keep]


def _label_codes(labels: np.ndarray, known: np.ndarray) -> np.ndarray:
    """Place of each label among the sorted ``known`` ones, -1 for others."""
    at = np.minimum(np.searchsorted(known, labels), len(known) - 1)
    return np.where(known[at] == labels, at, -1)


def _chunks(batches: Iterable[pa.RecordBatch], dims: int, size: int) -> Iterator[tuple]:
    """row, vec_id, label and the int64 matrix of at most ``size`` rows at once."""
    for whole in batches:
        for lo in range(0, whole.num_rows, size):
            batch = whole.slice(lo, size)
            yield (*(batch[c].to_numpy() for c in ("row", "vec_id", "label")), matrix_of(batch["vec"], dims))


def matrix_of(vectors: pa.ListArray, dims: int) -> np.ndarray:
    flat = vectors.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
    sizes = vectors.value_lengths().to_numpy(zero_copy_only=False)
    if len(sizes) and (sizes == dims).all():
        return flat.reshape(len(sizes), dims)
    out = np.zeros((len(sizes), dims), np.int64)
    row = np.repeat(np.arange(len(sizes)), sizes)
    at = np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    out[row, at] = flat
    return out


# --- passes over all rows ---------------------------------------------------------------


def _positives(rows: DataFrame, anchors, dims: int, primes: list[int], k: int) -> DataFrame:
    """(anchor, positive, id, score): places of anchors, and the rows that come first."""

    def run(batches):
        own, _, labels, matrix = anchors.value
        known = np.unique(labels)
        codes = np.searchsorted(known, labels)
        # Anchors of a label side by side: only rows of the same label are multiplied.
        of_label = [np.flatnonzero(codes == c) for c in range(len(known))]
        left = residues(matrix, primes)
        best = Best(len(own), k)
        for row, ids, label, vectors in _chunks(batches, dims, max(64, SCORES // max(1, max(map(len, of_label))))):
            code = _label_codes(label, known)
            for c in np.unique(code[code >= 0]).tolist():
                mine, theirs = of_label[c], np.flatnonzero(code == c)
                scores = products([x[mine] for x in left], residues(vectors[theirs], primes), primes)
                # Ties at the k-th score stay: the id decides. The anchor itself may be among them.
                edge = best.floor[mine]
                if len(theirs) > k + 1:
                    top = np.partition(scores, len(theirs) - k - 1, axis=1)[:, len(theirs) - k - 1]
                    edge = np.maximum(edge, top)
                a, b = np.nonzero(scores >= edge[:, None])
                other = own[mine[a]] != row[theirs[b]]
                a, b = a[other], b[other]
                best.add(mine[a], scores[a, b], ids[theirs[b]], row[theirs[b]])
        yield pa.RecordBatch.from_arrays(
            [pa.array(best.group), pa.array(best.row), pa.array(best.id), pa.array(best.score)],
            names=["anchor", "positive", "id", "score"],
        )

    found = rows.mapInArrow(run, "anchor bigint, positive bigint, id bigint, score bigint")
    place = "row_number() OVER (PARTITION BY anchor ORDER BY score DESC, id, positive)"
    return found.selectExpr("*", f"{place} AS place").where(f"place <= {k}")


def _negatives(rows: DataFrame, anchors, positives, dims: int, primes: list[int], k: int, window: tuple) -> DataFrame:
    """(pair, id, score, rank): for each (anchor, positive) the first rows of its window."""
    low, high = window

    def run(batches):
        _, _, labels, matrix = anchors.value
        anchor, score = positives.value
        used = np.unique(anchor)
        left = residues(matrix[used], primes)
        # The pairs of an anchor, side by side.
        n = np.bincount(np.searchsorted(used, anchor), minlength=len(used))
        first = np.cumsum(n) - n
        least, most = np.full(len(used), np.iinfo(np.int64).max), np.full(len(used), np.iinfo(np.int64).min)
        place = np.searchsorted(used, anchor)
        np.minimum.at(least, place, -(-low * score // 100))
        np.maximum.at(most, place, high * score // 100)
        best = Best(len(anchor), k)
        for row, ids, label, vectors in _chunks(batches, dims, max(64, SCORES // max(1, len(used)))):
            scores = products(left, residues(vectors, primes), primes)
            fits = (scores >= least[:, None]) & (scores <= most[:, None]) & (labels[used][:, None] != label[None, :])
            a, b = np.nonzero(fits)
            found = scores[a, b]
            for j in range(int(n.max(initial=0))):
                has = n[a] > j
                pair, at, s = first[a[has]] + j, b[has], found[has]
                p = score[pair]
                ok = (low * p <= 100 * s) & (100 * s <= high * p)
                best.add(pair[ok], s[ok], ids[at[ok]], row[at[ok]])
        yield pa.RecordBatch.from_arrays(
            [pa.array(best.group), pa.array(best.id), pa.array(best.score), pa.array(best.row)],
            names=["pair", "id", "score", "row"],
        )

    found = rows.mapInArrow(run, "pair bigint, id bigint, score bigint, row bigint")
    rank = "CAST(row_number() OVER (PARTITION BY pair ORDER BY score DESC, id, row) AS INT)"
    return found.selectExpr("*", f"{rank} AS rank").where(f"rank <= {k}").drop("row")


def prepared(vectors: DataFrame, scale: int, relabel: str) -> DataFrame:
    """row, vec_id, label, vec (integers), norm of the rows that take part, stored."""
    whole = vectors.selectExpr("vec_id", "label", "CAST(embedding AS array<double>) AS vec").where(
        "vec_id IS NOT NULL AND label IS NOT NULL AND vec IS NOT NULL AND NOT exists(vec, "
        "x -> x IS NULL OR isnan(x) OR abs(x) = double('Infinity'))"
    )
    scaled = whole.selectExpr(
        "monotonically_increasing_id() AS row", "CAST(vec_id AS BIGINT) AS vec_id", f"CAST({relabel} AS BIGINT) AS label",
        f"transform(vec, x -> floor({float(scale)}D * x)) AS vec",
        f"aggregate(vec, 0D, (s, x) -> s + pow(floor({float(scale)}D * x), 2)) AS norm",
    )
    return stored(scaled, "vectors")


def mine(
    vectors: DataFrame, anchors: str = "vec_id % 100 = 0", relabel: str = "label", scale: int = SCALE,
    positives: int = POSITIVES, negatives: int = NEGATIVES, window: tuple = (LOW, HIGH), anchor_block: int = ANCHOR_BLOCK,
) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    ``vectors`` has vec_id, embedding and label; ``anchors`` and ``relabel`` are SQL over vec_id
    and label. ``window`` bounds a negative's score in percent of its positive's.
    """
    spark = vectors.sparkSession
    sc = spark.sparkContext
    rows = prepared(vectors, scale, relabel)
    size = rows.agg(
        F.max("norm").alias("norm"), F.expr("max(size(vec))").alias("dims"), F.expr(f"count_if({anchors})").alias("n")
    ).first()
    dims, blocks, found = size.dims or 1, -(-size.n // anchor_block), []
    # Norms are sums of doubles; the margin covers their rounding.
    if (size.norm or 0.0) * 1.001 + 1 >= MOST:
        raise ValueError("vectors are so large that their scores leave 64 bits")
    primes = primes_for(int((size.norm or 0.0) * 1.001) + 1, dims)
    vec = rows.select("row", "vec_id", "label", "vec")
    for block in range(blocks):
        part = vec.where(anchors).where(f"pmod(xxhash64(row), {blocks}) = {block}").toArrow().combine_chunks()
        if not part.num_rows:
            continue
        own, anchor_ids, labels = (part[c].to_numpy() for c in ("row", "vec_id", "label"))
        matrix = matrix_of(part["vec"].combine_chunks(), dims)
        shared = sc.broadcast((own, anchor_ids, labels, matrix))
        # At most ``positives`` rows for each anchor of the block.
        near = _positives(vec, shared, dims, primes, positives).toArrow().sort_by([("anchor", "ascending"), ("place", "ascending")])
        anchor, positive, score = (near[c].to_numpy() for c in ("anchor", "id", "score"))
        pairs = sc.broadcast((anchor, score))
        names = spark.createDataFrame(
            pa.table({
                "pair": np.arange(len(anchor)), "anchor_id": anchor_ids[anchor], "positive_id": positive, "positive_score": score,
            })
        )
        hard = _negatives(vec, shared, pairs, dims, primes, negatives, window).join(F.broadcast(names), "pair")
        hard = hard.selectExpr("anchor_id", "positive_id", "rank", "id AS negative_id", "positive_score", "score AS negative_score")
        found.append(stored(hard, "hard-negatives"))
        shared.destroy()
        pairs.destroy()
    if not found:
        columns = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
        return spark.createDataFrame([], columns)
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    return out
