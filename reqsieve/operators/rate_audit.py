"""Per-client rate-limit audit: a sliding log of accepted requests.

A request is accepted when fewer than ``limit`` accepted requests of its client lie in
the last ``window_seconds``, both ends included. Rejected requests leave no entry.
Requests are taken in (time, id) order.

The rule is sequential, but only where a client is busy. Time is cut into cells one
window wide, and requests are counted per (client, cell):

* where a cell and the one before it hold at most ``limit`` requests together, the cell is
  calm: no window that ends in it can be full, so all of it is accepted;
* a run of busy cells is a stretch. The cell before it is calm, so the log a stretch starts
  from is known, and stretches do not depend on each other;
* only the busy stretches are walked, as counts per microsecond, over sorted partitions
  that stream through with a state of at most ``limit`` entries.

A hot client is thus spread over its cells. What stays sequential is one unbroken
overload of one client.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from reqsieve.operators.history import micros_of


def _client(name: str) -> Column:
    """Requests without a client share one log."""
    return F.coalesce(F.col(name).cast("string"), F.lit("unknown"))


def _ticks(df: DataFrame, client: str, ts: str) -> DataFrame:
    return (
        df.select(_client(client).alias("client"), micros_of(df, ts).alias("us"))
        .groupBy("client", "us")
        .agg(F.count(F.lit(1)).alias("n"))
    )


def window_counts(
    df: DataFrame,
    window_seconds: int = 60,
    client: str = "client",
    ts: str = "ts",
    bucket_seconds: int | None = None,
) -> DataFrame:
    """(client, us, n, in_window): requests in the window that ends at each tick.

    An upper bound of the accepted log: where it stays within the limit, all is accepted.

    The count is a difference of two running sums, at the tick and before its window. A
    sliding frame would add the whole window up again for every row. Running sums are per
    (client, bucket), with the ticks the bucket looks back on copied into it, so a hot
    client is many groups.
    """
    w = window_seconds * 1_000_000
    width = max((bucket_seconds or 0) * 1_000_000, 4 * w)
    ticks = _ticks(df, client, ts)
    us = F.col("us")
    home = us - F.pmod(us, F.lit(width))
    tick = lambda bucket: F.struct(
        bucket.alias("bucket"), us.alias("at"), F.lit(1).alias("kind"), F.col("n").alias("add")
    )
    probe = F.struct(
        home.alias("bucket"), (us - w).alias("at"), F.lit(0).alias("kind"), F.lit(0).cast("bigint").alias("add")
    )
    copied = F.when(us >= home + (width - w), tick(home + width))
    marks = ticks.select(
        "client", "us", "n", home.alias("home"),
        F.inline(F.array_compact(F.array(tick(home), probe, copied))),
    )
    # At the same time the probe comes first: the window includes its own start.
    so_far = Window.partitionBy("client", "bucket").orderBy("at", "kind").rowsBetween(
        Window.unboundedPreceding, 0
    )
    return (
        marks.withColumn("run", F.sum("add").over(so_far))
        .where(F.col("bucket") == F.col("home"))
        .groupBy("client", "bucket", "us")
        .agg(
            F.max("n").alias("n"),
            F.sum(F.when(F.col("kind") == 1, F.col("run")).otherwise(-F.col("run"))).alias("in_window"),
        )
        .select("client", "us", "n", "in_window")
    )


def with_window_count(
    df: DataFrame, window_seconds: int = 60, client: str = "client", ts: str = "ts"
) -> DataFrame:
    counts = window_counts(df, window_seconds, client, ts).select(
        F.col("client").alias("_c"), F.col("us").alias("_us"), "in_window"
    )
    keyed = df.withColumns({"_c": _client(client), "_us": micros_of(df, ts)})
    return keyed.join(counts, ["_c", "_us"]).drop("_c", "_us")


def _scan(limit: int, window: int):
    """Walk sorted ticks of many stretches; the state never holds over ``limit`` entries."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        current, log, used = None, deque(), 0
        for pdf in batches:
            taken = []
            rows = zip(pdf["client"], pdf["stretch"], pdf["us"], pdf["n"], pdf["warm"])
            for client, stretch, us, n, warm in rows:
                if (client, stretch) != current:
                    current, log, used = (client, stretch), deque(), 0
                while log and log[0][0] < us - window:
                    used -= log.popleft()[1]
                got = n if warm else min(n, limit - used)
                if got:
                    log.append((us, got))
                    used += got
                taken.append(got)
            out = pdf[["client", "us", "n"]].assign(taken=taken)
            yield out[~pdf["warm"].to_numpy()]

    return run


def _stretches(cells: DataFrame, limit: int, w: int) -> DataFrame:
    """(client, cell, stretch, warm) of the busy cells and the cell before each run.

    A client has one row per window of time here, whatever its number of requests.
    """
    order = Window.partitionBy("client").orderBy("cell")
    follows = F.coalesce(F.lag("cell").over(order) == F.col("cell") - w, F.lit(False))
    before = F.when(follows, F.lag("n").over(order)).otherwise(0)
    marked = cells.withColumns({"follows": follows, "busy": F.col("n") + before > limit})
    opens = F.col("busy") & ~(F.col("follows") & F.coalesce(F.lag("busy").over(order), F.lit(False)))
    marked = marked.withColumn("opens", opens)
    number = F.sum(F.col("opens").cast("int")).over(order)
    next_opens = F.coalesce(F.lead("opens").over(order) & F.lead("follows").over(order), F.lit(False))
    return (
        marked.withColumns({"number": number, "next_opens": next_opens})
        .where(F.col("busy") | F.col("next_opens"))
        .select(
            "client",
            "cell",
            (F.col("number") + F.when(F.col("busy"), 0).otherwise(1)).alias("stretch"),
            (~F.col("busy")).alias("warm"),
        )
    )


def audit(
    df: DataFrame,
    limit: int = 1000,
    window_seconds: int = 60,
    client: str = "client",
    ts: str = "ts",
    tie: str = "id",
) -> DataFrame:
    """Every input row with an exact ``accepted`` flag."""
    if limit < 1:
        raise ValueError("limit must be at least 1")
    w = window_seconds * 1_000_000
    us = micros_of(df, ts)
    cell = us - F.pmod(us, F.lit(w))  # start of the cell
    who = _client(client)
    times = df.select(who.alias("client"), us.alias("us"), cell.alias("cell"))
    cells = times.groupBy("client", "cell").agg(F.count(F.lit(1)).alias("n"))
    stretches = _stretches(cells, limit, w)

    ticks = times.groupBy("client", "cell", "us").agg(F.count(F.lit(1)).alias("n"))
    decided = (
        ticks.join(stretches, ["client", "cell"])
        .repartition("client", "stretch")
        .sortWithinPartitions("client", "stretch", "us")
        .select("client", "stretch", "us", "n", "warm")
        .mapInPandas(_scan(limit, w), "client string, us bigint, n bigint, taken bigint")
        .select(F.col("client").alias("_c"), F.col("us").alias("_us"), "taken")
    )

    keyed = df.withColumns({"_c": who, "_us": us, "_cell": cell}).join(
        stretches.where(~F.col("warm")).select(
            F.col("client").alias("_c"), F.col("cell").alias("_cell"), F.lit(True).alias("_busy")
        ),
        ["_c", "_cell"],
        "left",
    )
    calm = keyed.where(F.col("_busy").isNull()).withColumn("accepted", F.lit(True))
    # Of the requests of one tick the first ``taken`` by id are accepted.
    rank = F.row_number().over(Window.partitionBy("_c", "_us").orderBy(tie))
    busy = (
        keyed.where(F.col("_busy"))
        .join(decided, ["_c", "_us"])
        .withColumn("accepted", rank <= F.col("taken"))
        .drop("taken")
    )
    return calm.unionByName(busy).drop("_c", "_us", "_cell", "_busy")
