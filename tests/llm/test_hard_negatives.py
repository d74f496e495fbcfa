"""Exact scores from residues, and mined rows against brute force."""

import random

import numpy as np
import pytest

from reqsieve.llm import hard_negatives as hn

RELABEL = "CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END"
SCHEMA = "vec_id long, embedding array<float>, label int, row string, norm string, score string, `a.b` string"


@pytest.mark.parametrize("dims", [1, 3, 64, 300, 700])
@pytest.mark.parametrize("size", [1, 100, 2**20])
def test_products_are_exact(dims, size):
    rng = np.random.default_rng(dims)
    a, b = rng.integers(-size, size + 1, (7, dims)), rng.integers(-size, size + 1, (11, dims))
    a[0], b[0] = size, -size
    primes = hn.primes_for(size * size * dims, dims)
    assert len(set(primes)) == len(primes)
    got = hn.products(hn.residues(a, primes), hn.residues(b, primes), primes)
    assert (got == a @ b.T).all()


def test_largest_scores_are_exact():
    a = np.array([[2**27, -(2**27)]])
    primes = hn.primes_for(2**55, 2)
    got = hn.products(hn.residues(a, primes), hn.residues(np.vstack([a, -a]), primes), primes)
    assert got.tolist() == [[2**55, -(2**55)]]


def brute(rows, k=5):
    use = []
    for i, vec, label in rows:
        if i is None or label is None or vec is None or any(x is None or not np.isfinite(np.float32(x)) for x in vec):
            continue
        q = [int(np.floor(256 * float(np.float32(x)))) for x in vec]
        use.append((i, q, (label + 1) % 10 if i % 7 == 0 else label))
    dot = lambda x, y: sum(a * b for a, b in zip(x, y))
    out = []
    for n, (i, q, label) in enumerate(use):
        if i % 100:
            continue
        scored = sorted((-dot(q, v), j, m, other) for m, (j, v, other) in enumerate(use) if m != n)
        for s, j, _, _ in [x for x in scored if x[3] == label][:k]:
            fits = [x for x in scored if x[3] != label and 80 * -s <= 100 * -x[0] <= 100 * -s][:k]
            out += [(i, j, r + 1, x[1], -s, -x[0]) for r, x in enumerate(fits)]
    return sorted(out)


def table(spark, rows):
    return spark.createDataFrame([(*r, "x", "x", "x", "x") for r in rows], SCHEMA)


@pytest.mark.parametrize("block", [8192, 3])
def test_mined_rows_against_brute_force(spark, block):
    r = random.Random(block)
    rows = []
    for i in range(900):
        # Few different vectors: many ties and repeated rows.
        vec = [r.choice([-0.5, -0.1, 0.0, 0.3, 0.31, 1.7]) for _ in range(r.choice([4, 4, 4, 3, 0]))]
        rows.append((i % 850, vec, r.choice([0, 0, 0, 1, 2])))
    rows += [(100, [float("nan")] * 4, 1), (200, [1.0, None], 1), (300, None, 1), (400, [1.0], None), (None, [1.0], 1),
             (500, [float("inf")], 0), (0, [9.0, -9.0, 9.0, 9.0], 0), (100, [1.5] * 4, 77)]
    r.shuffle(rows)
    got = hn.mine(table(spark, rows).repartition(5), relabel=RELABEL, anchor_block=block)
    assert sorted(tuple(x) for x in got.collect()) == brute(rows)


def test_without_rows(spark):
    empty = table(spark, [])
    assert hn.mine(empty).count() == 0 and hn.mine(empty).columns[0] == "anchor_id"
    alone = table(spark, [(0, [1.0, 2.0], 1), (3, [1.0], 2)])
    assert hn.mine(alone).count() == 0
    with pytest.raises(ValueError):
        hn.mine(table(spark, [(0, [1e9] * 8, 1)]))
