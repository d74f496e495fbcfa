"""Detection history: records, filters, paging, statistics, replay and retention.

The store is a Parquet table with a ``ts`` column, partitioned by day in ``dt``.
"""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime, timedelta, timezone

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from reqsieve.operators.normalize import with_training_text
from reqsieve.operators.scoring import score_requests
from reqsieve.session import ensure_checkpoint_dir, stored

REQUEST_SCHEMA = (
    "method string, path string, query_params map<string,string>, "
    "headers map<string,string>, body string"
)

# Column order of a stored record.
RECORD_FIELDS = [
    "request_id",
    "ts",
    "timestamp",
    "method",
    "path",
    "anomaly_score",
    "is_anomaly",
    "model_version",
    "threshold",
    "client_ip_hash",
    "notes",
    "normalized_request",
    "created_at",
]

BATCH_NOTE = "batch_request"


# --- time ------------------------------------------------------------------------------


def epoch_micros(ts: Column, is_ntz: bool) -> Column:
    """Microseconds since 1970; wall-clock times without a zone count as UTC."""
    if is_ntz:
        ts = F.convert_timezone(F.lit("UTC"), F.current_timezone(), ts).cast("timestamp")
    return F.unix_micros(ts)


def micros_of(df: DataFrame, ts: str = "ts") -> Column:
    return epoch_micros(F.col(ts), dict(df.dtypes)[ts] == "timestamp_ntz")


def parse_time_bound(value: str | float | datetime) -> datetime:
    """ISO text (``Z`` allowed), epoch seconds or a datetime to a UTC datetime.

    Text without a zone counts as UTC. Anything else raises ``ValueError``.
    """
    if isinstance(value, datetime):
        parsed = value
    else:
        try:
            parsed = datetime.fromisoformat(str(value).replace("Z", "+00:00"))
        except ValueError:
            micros = round(float(value) * 1_000_000)
            parsed = datetime(1970, 1, 1, tzinfo=timezone.utc) + timedelta(microseconds=micros)
    return parsed.astimezone(timezone.utc) if parsed.tzinfo else parsed.replace(tzinfo=timezone.utc)


def time_text_to_epoch(text: Column) -> Column:
    """Column form of ``parse_time_bound``: epoch seconds, null where nothing parses."""
    dated = text.rlike(r"^\d{4}-\d{2}-\d{2}($|[T ]\d{2})")
    zoned = text.rlike(r"(Z|[+-]\d{2}:?\d{2})$") & text.rlike(r"[T ]\d{2}")
    iso = F.when(
        dated,
        F.when(zoned, text).otherwise(
            F.when(F.length(text) > 10, F.concat(text, F.lit("Z"))).otherwise(
                F.concat(text, F.lit("T00:00:00Z"))
            )
        ),
    )
    # 1700000000 is no date, so it falls through to the number.
    return F.coalesce(
        F.unix_micros(iso.try_cast("timestamp")) / F.lit(1_000_000.0), text.try_cast("double")
    )


def _bound(df: DataFrame, ts: str, at: datetime) -> Column:
    """A literal of the column's own type, so that the comparison reaches the scan."""
    if dict(df.dtypes)[ts] == "timestamp_ntz":
        return F.lit(at.strftime("%Y-%m-%d %H:%M:%S.%f")).cast("timestamp_ntz")
    micros = (at - datetime(1970, 1, 1, tzinfo=timezone.utc)) // timedelta(microseconds=1)
    return F.timestamp_micros(F.lit(micros))


# --- records ---------------------------------------------------------------------------


def client_hash(ip: Column, salt: str) -> Column:
    return F.sha2(F.concat(F.lit(salt), ip), 256)


def with_client_hash(
    df: DataFrame, salt: str, ip: str = "client", out: str = "client_ip_hash"
) -> DataFrame:
    return df.withColumn(out, client_hash(F.col(ip), salt))


def normalized_request(df: DataFrame) -> Column:
    """The request as one JSON text that ``replay`` can read back."""
    cols = set(df.columns)
    empty = F.expr("cast(map() as map<string,string>)")
    return F.to_json(
        F.struct(
            "method",
            "path",
            F.map_from_entries("query_params").alias("query_params"),
            (F.col("headers") if "headers" in cols else empty).alias("headers"),
            "body",
        )
    )


def build_records(
    df: DataFrame,
    model_version: int,
    threshold: float,
    salt: str,
    client: str | None = "client",
    notes: str | None = None,
) -> DataFrame:
    """Scored requests to stored records.

    Reads method, path, query_params, body, anomaly_score, is_anomaly and ``ts``; a
    ``request_id`` column is kept where there is one.
    """
    micros = micros_of(df)
    rid = F.col("request_id").cast("string") if "request_id" in df.columns else F.uuid()
    wall = F.col("ts")
    if dict(df.dtypes)["ts"] != "timestamp_ntz":
        wall = F.convert_timezone(F.current_timezone(), F.lit("UTC"), wall.cast("timestamp_ntz"))
    day_text = F.substring(wall.cast("string"), 1, 19)
    values = {
        "request_id": rid,
        "ts": F.col("ts"),
        "timestamp": micros / F.lit(1_000_000.0),
        "method": F.col("method"),
        "path": F.col("path"),
        "anomaly_score": F.col("anomaly_score"),
        "is_anomaly": F.col("is_anomaly"),
        "model_version": F.lit(model_version),
        "threshold": F.lit(float(threshold)),
        "client_ip_hash": client_hash(F.col(client), salt) if client else F.lit(None).cast("string"),
        "notes": F.lit(notes).cast("string"),
        "normalized_request": normalized_request(df),
        "created_at": day_text,
    }
    return df.select(*[values[f].alias(f) for f in RECORD_FIELDS])


# --- reading ---------------------------------------------------------------------------


def filter_history(
    df: DataFrame,
    from_time: str | float | datetime | None = None,
    to_time: str | float | datetime | None = None,
    flagged: bool | None = None,
    min_score: float | None = None,
    max_score: float | None = None,
    path_pattern: str | None = None,
    ts: str = "ts",
) -> DataFrame:
    """Any of the filters; one left out filters nothing. Bounds are inclusive and the
    pattern is a substring. Time bounds also prune the day partitions."""
    by_day = "dt" in df.columns
    if from_time is not None:
        start = parse_time_bound(from_time)
        df = df.where(F.col(ts) >= _bound(df, ts, start))
        if by_day:
            df = df.where(F.col("dt") >= F.lit(start.date()))
    if to_time is not None:
        end = parse_time_bound(to_time)
        df = df.where(F.col(ts) <= _bound(df, ts, end))
        if by_day:
            df = df.where(F.col("dt") <= F.lit(end.date()))
    if flagged is not None:
        df = df.where(F.col("is_anomaly") == flagged)
    if min_score is not None:
        df = df.where(F.col("anomaly_score") >= float(min_score))
    if max_score is not None:
        df = df.where(F.col("anomaly_score") <= float(max_score))
    if path_pattern is not None:
        df = df.where(F.col("path").contains(path_pattern))
    return df


def page(
    df: DataFrame,
    limit: int = 100,
    offset: int = 0,
    after: tuple[str | float | datetime, int] | None = None,
    ts: str = "ts",
    tie: str = "id",
) -> DataFrame:
    """Most recent first. ``after`` is the (time, id) of the last row already seen: it
    reaches deep pages with a pushed-down filter, where ``offset`` must pass all earlier
    rows. The page is found by counts per second, so no long prefix is brought to one
    place. Records without a time come last."""
    if after is not None:
        seen = _bound(df, ts, parse_time_bound(after[0]))
        df = df.where(
            (F.col(ts) < seen) | ((F.col(ts) == seen) & (F.col(tie) < F.lit(after[1])))
        )
    return _located_page(df, limit, offset, ts, tie)


def _located_page(df: DataFrame, limit: int, offset: int, ts: str, tie: str) -> DataFrame:
    """Count rows per second, per day and in total, to find the seconds the page covers;
    only their rows are ranked."""
    us = micros_of(df, ts)
    # No time sorts below all times.
    second = F.coalesce(us - F.pmod(us, F.lit(1_000_000)), F.lit(-(2**62)))
    keyed = df.withColumn("_second", second)
    day = F.col("_second") - F.pmod(F.col("_second"), F.lit(86_400_000_000))
    seconds = keyed.groupBy("_second").agg(F.count(F.lit(1)).alias("_n")).withColumn("_day", day)
    to_here = (Window.unboundedPreceding, 0)
    # One row per day in the unpartitioned window.
    days = seconds.groupBy("_day").agg(F.sum("_n").alias("_of_day"))
    by_day = Window.orderBy(F.desc("_day")).rowsBetween(*to_here)
    days = days.select("_day", (F.sum("_of_day").over(by_day) - F.col("_of_day")).alias("_newer"))
    in_day = Window.partitionBy("_day").orderBy(F.desc("_second")).rowsBetween(*to_here)
    placed = seconds.join(days, "_day").withColumn(
        "_before", F.col("_newer") + F.sum("_n").over(in_day) - F.col("_n")
    )
    covered = placed.where(
        (F.col("_before") + F.col("_n") > offset) & (F.col("_before") < offset + limit)
    ).select("_second", "_before")
    rank = F.row_number().over(Window.partitionBy("_second").orderBy(F.desc(ts), F.desc(tie)))
    place = F.col("_before") + rank
    return (
        keyed.join(covered, "_second")
        .withColumn("_place", place)
        .where((F.col("_place") > offset) & (F.col("_place") <= offset + limit))
        .orderBy("_place")
        .select(*df.columns)
    )


def lookup(df: DataFrame, request_id: str) -> DataFrame:
    return df.where(F.col("request_id") == request_id)


def lookup_all(df: DataFrame, ids: DataFrame) -> DataFrame:
    """Records of every id in a table of ids; Spark broadcasts it only where it is small."""
    return df.join(ids.select("request_id"), "request_id", "left_semi")


def history_page(
    df: DataFrame,
    limit: int = 50,
    offset: int = 0,
    high: float = 9.0,
    medium: float = 8.5,
    ts: str = "ts",
    tie: str = "id",
) -> DataFrame:
    """One page as shown: score band, rounded score, hash prefix, more-pages flag.

    The flag says whether the page is full; its window sees at most ``limit`` rows.
    """
    return shown_page(page(df, limit, offset, ts=ts, tie=tie), limit, high, medium, ts, tie)


def shown_page(
    shown: DataFrame, limit: int = 50, high: float = 9.0, medium: float = 8.5, ts: str = "ts", tie: str = "id"
) -> DataFrame:
    """The rows of a page, as shown."""
    full = F.count(F.lit(1)).over(Window.partitionBy()) == limit
    score = F.col("anomaly_score")
    return shown.select(
        tie,
        ts,
        "method",
        "path",
        F.round(score, 3).alias("score"),
        F.when(score >= high, "high").when(score >= medium, "medium").otherwise("low").alias("band"),
        F.substring("client_ip_hash", 1, 8).alias("client_prefix"),
        full.alias("has_more"),
    )


# --- aggregates ------------------------------------------------------------------------


def stats(df: DataFrame, ts: str = "ts") -> DataFrame:
    """One row over the whole history; the rate is a percentage, 0 when empty."""
    flagged = F.count_if(F.col("is_anomaly"))
    total = F.count(F.lit(1))
    return df.agg(
        total.alias("total_requests"),
        flagged.alias("total_anomalies"),
        F.coalesce(F.avg("anomaly_score"), F.lit(0.0)).alias("avg_score"),
        F.coalesce(F.try_divide(flagged * F.lit(100.0), total), F.lit(0.0)).alias("detection_rate"),
        F.min(ts).alias("first_detection"),
        F.max(ts).alias("last_detection"),
    )


def counters(df: DataFrame) -> DataFrame:
    """Running request and anomaly counters; on a stream, use complete output mode."""
    return df.groupBy().agg(
        F.count(F.lit(1)).alias("requests"), F.count_if(F.col("is_anomaly")).alias("anomalies")
    )


def windowed_counters(df: DataFrame, ts: str, width: str, lateness: str) -> DataFrame:
    """The same counters per time window; the watermark bounds the state on a stream."""
    return (
        df.withWatermark(ts, lateness)
        .groupBy(F.window(ts, width).alias("w"))
        .agg(F.count(F.lit(1)).alias("requests"), F.count_if(F.col("is_anomaly")).alias("anomalies"))
        .select(F.col("w.start").alias("window_start"), "requests", "anomalies")
    )


# --- replay ----------------------------------------------------------------------------


def unpack_requests(df: DataFrame) -> DataFrame:
    """Records to request rows, from the stored JSON; unreadable ones are dropped."""
    doc = F.from_json("normalized_request", REQUEST_SCHEMA)
    empty = F.expr("cast(map() as map<string,string>)")
    pairs = F.transform(
        F.map_entries(F.coalesce("_d.query_params", empty)),
        lambda e: F.struct(e["key"].alias("k"), e["value"].alias("v")),
    )
    return (
        df.withColumn("_d", doc)
        .where(F.col("_d.method").isNotNull() & F.col("_d.path").isNotNull())
        .select(
            "request_id",
            F.col("_d.method").alias("method"),
            F.col("_d.path").alias("path"),
            pairs.alias("query_params"),
            F.coalesce("_d.headers", empty).alias("headers"),
            F.coalesce("_d.body", F.lit("")).alias("body"),
        )
    )


def replay(
    records: DataFrame,
    model,
    model_version: int,
    threshold: float,
    now: str | float | datetime,
    salt: str = "",
    max_length: int | None = None,
    compose: Callable[[DataFrame], DataFrame] = with_training_text,
) -> DataFrame:
    """Rescore stored requests with the current model, as new records.

    The new id ends in eight hex digits taken from the old id, the version and the time,
    so a retried task writes the same id again.
    """
    # Composed once: the text is scored, the fields go into the record.
    texts = stored(compose(unpack_requests(records)), "replay-texts")
    scores = score_requests(texts, model, "request_id", threshold, max_length=max_length)
    at = parse_time_bound(now)
    again = (
        texts.drop("text")
        .join(scores, "request_id")
        .withColumn("ts", _bound(records, "ts", at))
    )
    built = build_records(again, model_version, threshold, salt, client=None)
    mark = F.substring(
        F.sha2(F.concat_ws("|", "request_id", F.lit(str(model_version)), F.lit(at.isoformat())), 256), 1, 8
    )
    return built.withColumns(
        {
            "notes": F.concat(F.lit("replay_of_"), F.col("request_id")),
            "request_id": F.concat(F.lit("replay-"), F.col("request_id"), F.lit("-"), mark),
        }
    )


def compare_replay(records: DataFrame, replayed: DataFrame) -> DataFrame:
    """Old and new score and flag per request."""
    new = replayed.select(
        F.expr("substr(notes, length('replay_of_') + 1)").alias("request_id"),
        F.col("anomaly_score").alias("new_score"),
        F.col("is_anomaly").alias("new_flag"),
    )
    old = records.select(
        "request_id",
        F.col("anomaly_score").alias("old_score"),
        F.col("is_anomaly").alias("old_flag"),
    )
    return old.join(new, "request_id")


# --- retention -------------------------------------------------------------------------


def cutoff(now: str | float | datetime, retention_days: int) -> datetime:
    return parse_time_bound(now) - timedelta(days=retention_days)


def kept_records(df: DataFrame, now, retention_days: int = 30, ts: str = "ts") -> DataFrame:
    at = cutoff(now, retention_days)
    kept = df.where(F.col(ts) >= _bound(df, ts, at))
    return kept.where(F.col("dt") >= F.lit(at.date())) if "dt" in df.columns else kept


def expired_count(df: DataFrame, now, retention_days: int = 30, ts: str = "ts") -> DataFrame:
    at = cutoff(now, retention_days)
    old = df.where(F.col(ts) < _bound(df, ts, at))
    if "dt" in df.columns:
        old = old.where(F.col("dt") <= F.lit(at.date()))
    return old.agg(F.count(F.lit(1)).alias("deleted_records"))


def retention_counts(df: DataFrame, now, retention_days: int = 30, ts: str = "ts") -> DataFrame:
    """One row: records a cleanup would delete and keep."""
    old = F.col(ts) < _bound(df, ts, cutoff(now, retention_days))
    return df.agg(F.count_if(old).alias("deleted_records"), F.count_if(~old).alias("kept_records"))


def cleanup(spark: SparkSession, table: str, now, retention_days: int = 30) -> int:
    """Delete old records from a managed table partitioned by ``dt``; returns how many.

    Whole expired days are dropped as partitions. Only the one day the cutoff falls in is
    rewritten, from a checkpoint, since a partition cannot be read while it is replaced.
    """
    at = cutoff(now, retention_days)
    day = at.date().isoformat()
    df = spark.table(table)
    deleted = expired_count(df, now, retention_days).first()["deleted_records"]
    if deleted == 0:
        return 0
    ensure_checkpoint_dir(spark)
    edge = df.where((F.col("dt") == F.lit(at.date())) & (F.col("ts") >= _bound(df, "ts", at))).drop("dt")
    edge = edge.checkpoint()
    # One row per stored day.
    days = [r[0].split("=", 1)[1] for r in spark.sql(f"SHOW PARTITIONS {table}").collect()]
    if day in days:
        if edge.isEmpty():
            spark.sql(f"ALTER TABLE {table} DROP IF EXISTS PARTITION (dt='{day}')")
        else:
            edge.createOrReplaceTempView("_kept_edge")
            cols = ", ".join(f"`{c}`" for c in edge.columns)
            spark.sql(
                f"INSERT OVERWRITE TABLE {table} PARTITION (dt='{day}') SELECT {cols} FROM _kept_edge"
            )
            spark.catalog.dropTempView("_kept_edge")
    for d in days:
        if d < day:
            spark.sql(f"ALTER TABLE {table} DROP IF EXISTS PARTITION (dt='{d}')")
    spark.catalog.refreshTable(table)
    return deleted


