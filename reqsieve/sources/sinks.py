"""Sinks for parsed rows, detections and evaluation rows."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reqsieve.operators.history import micros_of
from reqsieve.operators.parse import LOG_FIELDS
from reqsieve.sources.record_store import RecordStore, with_day

EVAL_FIELDS = ["ts", "label", "method", "path", "query", "anomaly_score", "is_anomaly"]


def write_jsonl(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """One JSON object per line; non-ASCII text is written as it is."""
    df.write.mode(mode).option("ignoreNullFields", False).json(path)


def write_log_csv(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Header and the ten fields in fixed order. Doubled quotes, empty text kept empty."""
    (
        df.select(*LOG_FIELDS)
        .write.mode(mode)
        .option("header", True)
        .option("escape", '"')
        .option("emptyValue", "")
        .csv(path)
    )


def write_parsed(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """CSV for a ``.csv`` path, JSON lines for any other."""
    csv = os.path.splitext(path)[1].lower() == ".csv"
    (write_log_csv if csv else write_jsonl)(df, path, mode)


# Fields of a logged detection, in order.
DETECTION_LOG_FIELDS = [
    "request_id", "method", "path", "query_params", "headers", "is_anomaly", "anomaly_score", "confidence", "ts",
]
DETECTION_LOG_SCHEMA = (
    "request_id string, method string, path string, query_params map<string,string>, "
    "headers map<string,string>, is_anomaly boolean, anomaly_score double, confidence double, ts string"
)


def log_records(scored: DataFrame, ts: str = "ts") -> DataFrame:
    """Scored requests, also those scored without a model, as the nine fields of the log.

    ``query_params`` are pairs; headers are empty where there are none. The time is text:
    seconds since 1970 with six digits.
    """
    empty = F.expr("cast(map() as map<string,string>)")
    seconds = (micros_of(scored, ts) / F.lit(1_000_000)).cast("decimal(20,6)").cast("string")
    values = {
        "request_id": F.col("request_id").cast("string"),
        "query_params": F.map_from_entries("query_params"),
        "headers": F.col("headers") if "headers" in scored.columns else empty,
        "ts": seconds,
    }
    return scored.select(*[values.get(f, F.col(f)).alias(f) for f in DETECTION_LOG_FIELDS])


def append_detection_log(df: DataFrame, path: str, batch: bool = False) -> None:
    """Append logged detections as JSON lines; a failed write fails the job.

    Detections of a batch call carry ``batch: true``.
    """
    out = df.withColumn("batch", F.lit(True)) if batch else df
    write_jsonl(out, path, "append")


def append_records(df: DataFrame, path: str) -> None:
    """Append to the record store at a path."""
    RecordStore(df.sparkSession, path).append(df)


def write_evaluation(df: DataFrame, path: str) -> None:
    df.select(*EVAL_FIELDS).write.mode("overwrite").option("header", True).option("escape", '"').csv(path)
