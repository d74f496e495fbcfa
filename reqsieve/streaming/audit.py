"""Rate-limit audit of a stream in event time.

The rule depends on the order of requests, and requests come out of order. So they are held
until the watermark, the latest time seen less the lateness, has passed them; then they are
decided in (time, id) order by the batch audit, which spreads busy clients over time cells. A
request that comes behind the watermark cannot be decided any more: it is given out with the flag
``late`` and without a decision. Every request is given out once.

State: the requests held, and the accepted ones of the last window. Both are tables in the
stream's folder, written anew by every micro-batch from those of the batch before, so a hot client
is rows in them and not one group in memory. A batch commits its number last; a batch that comes
again after a crash finds the state it began with, or its own commit, and changes nothing.

    <out>/results/batch_id=<n>/   requests given out
    <out>/held/<n>, <out>/log/<n>  state after batch n
    <out>/commits/<n + 1>.json    latest time seen

Since accepted requests of a past window, audited once more, are all accepted again, the log is
simply put before the requests that are due.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from reqsieve.operators import rate_audit
from reqsieve.operators.history import micros_of
from reqsieve.sources import commits
from reqsieve.streaming.jobs import BATCH_INTERVAL_SECONDS, for_each_batch


def _read(spark: SparkSession, path: str, schema) -> DataFrame:
    if not commits.exists(spark, path):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(path)


def _due(log: DataFrame, due: DataFrame, limit: int, window_seconds: int) -> DataFrame:
    """The requests of ``due`` with their decisions, behind the log."""
    rows = log.withColumn("given", F.lit(True)).unionByName(due.withColumn("given", F.lit(False)))
    audited = rate_audit.audit(rows, limit, window_seconds, client="client", ts="ts", tie="id")
    return audited.where("NOT given").drop("given").withColumn("late", F.lit(False))


def audit_stream(
    stream: DataFrame,
    out: str,
    checkpoint: str,
    limit: int = 1000,
    window_seconds: int = 60,
    client: str = "client",
    ts: str = "ts",
    tie: str = "id",
    lateness_seconds: int = 600,
    interval_seconds: int | None = BATCH_INTERVAL_SECONDS,
) -> StreamingQuery:
    """Run the audit over a stream; :func:`audited` reads what it has given out.

    Requests without a time count as late. All requests of one micro-batch are measured by the
    watermark of the batches before it.
    """
    out = out.rstrip("/")
    shaped = stream.select(F.col(tie).alias("id"), F.col(client).alias("client"), F.col(ts).alias("ts"))
    schema = shaped.schema

    def run(batch: DataFrame, n: int) -> None:
        spark = batch.sparkSession
        if commits.exists(spark, f"{out}/commits/{n + 1:012d}.json"):
            return
        latest = commits.read(spark, f"{out}/commits", n)["latest"] if n else None
        passed = None if latest is None else latest - lateness_seconds * 1_000_000
        batch = batch.persist()
        try:
            us = micros_of(batch)
            found = batch.agg(F.max(us).alias("latest")).first()["latest"]
            latest = max((x for x in (latest, found) if x is not None), default=None)
            late = us.isNull() if passed is None else us.isNull() | (us < passed)
            known = _read(spark, f"{out}/held/{n - 1}", schema).unionByName(batch.where(~late))
            log = _read(spark, f"{out}/log/{n - 1}", schema)
            mark = None if latest is None else latest - lateness_seconds * 1_000_000
            is_due = F.lit(False) if mark is None else micros_of(known) < mark
            decided = _due(log, known.where(is_due), limit, window_seconds)
            none = F.lit(None).cast("boolean")
            given = decided.unionByName(batch.where(late).withColumns({"accepted": none, "late": F.lit(True)}))
            given.write.mode("overwrite").parquet(f"{out}/results/batch_id={n}")
            known.where(~is_due).write.mode("overwrite").parquet(f"{out}/held/{n}")
            accepted = spark.read.schema(given.schema).parquet(f"{out}/results/batch_id={n}").where("accepted")
            kept = log.unionByName(accepted.select(*schema.names))
            if mark is not None:
                # Whatever is still to come is at the mark or later.
                kept = kept.where(micros_of(kept) >= mark - window_seconds * 1_000_000)
            kept.write.mode("overwrite").parquet(f"{out}/log/{n}")
            commits.publish(spark, f"{out}/commits", n + 1, {"latest": latest})
        finally:
            batch.unpersist()
        for old in ("held", "log"):
            commits.delete(spark, f"{out}/{old}/{n - 2}")

    return for_each_batch(shaped, run, checkpoint, interval_seconds)


def audited(spark: SparkSession, out: str, like: DataFrame) -> DataFrame:
    """(id, client, ts, accepted, late) of the requests given out so far. ``like`` has the
    columns id, client and ts of the stream."""
    schema = like.select("id", "client", "ts").withColumns(
        {"accepted": F.lit(True), "late": F.lit(False), "batch_id": F.lit(0)}
    ).schema
    return _read(spark, f"{out.rstrip('/')}/results", schema).drop("batch_id")


def held(spark: SparkSession, out: str, like: DataFrame, limit: int = 1000, window_seconds: int = 60) -> DataFrame:
    """The requests not given out yet, with the decisions they get if no more come."""
    out, schema = out.rstrip("/"), like.select("id", "client", "ts").schema
    last = commits.newest(spark, f"{out}/commits")[0] - 1
    log, due = (_read(spark, f"{out}/{name}/{last}", schema) for name in ("log", "held"))
    return _due(log, due, limit, window_seconds)
