"""The distributed audit against a plain sliding log."""

import random
from collections import deque

import pytest
from pyspark.sql import functions as F

from reqsieve.operators import rate_audit


def sliding_log(rows, limit, window_us):
    out, logs = {}, {}
    for client, us, i in sorted(rows):
        log = logs.setdefault(client, deque())
        while log and log[0] < us - window_us:
            log.popleft()
        out[i] = len(log) < limit
        if out[i]:
            log.append(us)
    return out


def frame(spark, rows):
    df = spark.createDataFrame(rows, "client string, us bigint, id bigint")
    return df.withColumn("ts", F.timestamp_micros("us"))


def audited(spark, rows, limit, window):
    return {r.id: r.accepted for r in rate_audit.audit(frame(spark, rows), limit, window).collect()}


def test_both_ends_of_the_window_count(spark):
    s = 1_000_000
    rows = [("a", 0, 0), ("a", 60 * s, 1), ("a", 60 * s + 1, 2), ("a", 120 * s, 3)]
    assert audited(spark, rows, 1, 60) == {0: True, 1: False, 2: True, 3: False}


def test_rejected_requests_leave_no_entry(spark):
    s = 1_000_000
    rows = [("a", i * 10 * s, i) for i in range(20)]
    got = audited(spark, rows, 2, 60)
    assert got == sliding_log(rows, 2, 60 * s)
    assert got[7] and not got[6]


@pytest.mark.parametrize("limit,window,step", [(3, 10, 1_000_000), (20, 60, 1_000_000), (1, 60, 1), (7, 20, 250_000)])
def test_random_traffic_with_a_hot_client(spark, limit, window, step):
    rng = random.Random(limit)
    span = 4000 * 1_000_000 // step
    rows = [
        ("hot" if rng.random() < 0.4 else f"c{rng.randrange(6)}", rng.randrange(span) * step, i)
        for i in range(3000)
    ]
    rows += [("burst", 5_000_000, 3000 + i) for i in range(50)]  # one tick, accepted in part
    assert audited(spark, rows, limit, window) == sliding_log(rows, limit, window * 1_000_000)


def test_requests_without_client_share_a_log(spark):
    rows = [(None, 0, 0), (None, 1, 1)]
    assert audited(spark, rows, 1, 60) == {0: True, 1: False}


def test_window_counts(spark):
    rng = random.Random(5)
    rows = [(f"c{rng.randrange(3)}", rng.randrange(600) * 1_000_000, i) for i in range(800)]
    got = {r.id: r.in_window for r in rate_audit.with_window_count(frame(spark, rows), 30).collect()}
    want = {i: sum(1 for c2, u2, _ in rows if c2 == c and u - 30_000_000 <= u2 <= u) for c, u, i in rows}
    assert got == want
