"""Scans of log, request, payload and sample files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from reqsieve.functions.text import is_blank, strip
from reqsieve.operators.parse import COMBINED, LOG_SCHEMA, json_object

# Fields that mark a JSON line as a log line.
JSON_MARKERS = ["ip", "timestamp", "request", "status"]

ENCODED_SCHEMA = "input_ids array<int>, attention_mask array<int>"
EVAL_SCHEMA = (
    "ts double, label string, method string, path string, query string, "
    "anomaly_score double, is_anomaly boolean"
)
_PLAIN = "request string, label string"
_STRUCTURED = (
    "request struct<method:string, path:string, query_params:map<string,string>, "
    "headers:map<string,string>, body:string>, label string"
)


def read_log_lines(spark: SparkSession, path: str, file_column: str | None = None) -> DataFrame:
    """Non-blank lines of a file or of every file below a folder.

    Undecodable bytes become U+FFFD, ``.gz`` is unpacked, files whose name starts with
    ``_`` or ``.`` are skipped, and so are files that vanish.
    """
    df = (
        spark.read.option("recursiveFileLookup", True)
        .option("ignoreMissingFiles", True)
        .option("lineSep", "\n")
        .text(path)
    )
    if file_column:
        df = df.select("value", F.col("_metadata.file_path").alias(file_column))
    return df.where(~is_blank(F.col("value")))


def format_hits(df: DataFrame, value: str = "value") -> DataFrame:
    """Two flags per line: counts as JSON, counts as combined."""
    line = strip(F.col(value))
    out = df.withColumn("_line", line)
    keys = [F.col("_doc")[k].isNotNull() for k in JSON_MARKERS]
    has_key = keys[0] | keys[1] | keys[2] | keys[3]
    return (
        out.withColumn("_doc", json_object(F.col("_line")))
        .withColumn("json_hit", F.coalesce(F.col("_doc").isNotNull() & has_key, F.lit(False)))
        .withColumn("combined_hit", ~F.col("json_hit") & F.col("_line").rlike(COMBINED))
        .drop("_line", "_doc")
    )


def log_format_profile(df: DataFrame, by: list[str] | None = None, value: str = "value") -> DataFrame:
    """Format per group (for example per file) over all lines: json wins ties."""
    hits = format_hits(df, value).groupBy(*(by or [])).agg(
        F.count_if("json_hit").alias("json_hits"), F.count_if("combined_hit").alias("combined_hits")
    )
    return hits.withColumn(
        "log_format", F.when(F.col("json_hits") >= F.col("combined_hits"), "json").otherwise("combined")
    )


def detect_log_format(df: DataFrame, value: str = "value") -> DataFrame:
    """One row with the format of all lines; an empty input counts as json."""
    return log_format_profile(df.where(~is_blank(F.col(value))), value=value)


def read_structured_requests(spark: SparkSession, path: str) -> DataFrame:
    """Already parsed log rows, one JSON object per line."""
    return spark.read.schema(LOG_SCHEMA).json(path)


def read_labelled_requests(spark: SparkSession, texts: str, structs: str | None = None) -> DataFrame:
    """Labelled requests of both layouts: ``request`` as text or as an object."""
    out = spark.read.schema(_PLAIN).json(texts).select(F.col("request").alias("request_text"), "label")
    if structs is None:
        return out
    r = "request."
    objects = spark.read.schema(_STRUCTURED).json(structs).select(
        *[F.col(r + c).alias(c) for c in ("method", "path", "query_params", "headers", "body")], "label"
    )
    return out.unionByName(objects, allowMissingColumns=True)


def payload_lines(lines: DataFrame, value: str = "value") -> DataFrame:
    """Payload lines: stripped, without blank and ``#`` lines."""
    return (
        lines.withColumn(value, strip(F.col(value)))
        .where((F.col(value) != "") & ~F.col(value).startswith("#"))
        .withColumnRenamed(value, "payload")
    )


def read_payloads(spark: SparkSession, path: str) -> DataFrame:
    return payload_lines(spark.read.text(path))


def read_encoded_samples(spark: SparkSession, path: str) -> DataFrame:
    """Encoded samples of one file, or of every ``.jsonl`` and ``.json`` in a folder."""
    reader = spark.read.schema(ENCODED_SCHEMA)
    if not path.endswith((".jsonl", ".json")):
        reader = reader.option("pathGlobFilter", "*.{jsonl,json}")
    return reader.json(path).where(F.col("input_ids").isNotNull())


def read_evaluation(spark: SparkSession, path: str) -> DataFrame:
    """Evaluation rows; quoted fields may hold line breaks."""
    reader = spark.read.schema(EVAL_SCHEMA).option("header", True)
    return reader.option("escape", '"').option("multiLine", True).csv(path)


def read_log_csv(spark: SparkSession, path: str) -> DataFrame:
    """Parsed rows as ``write_log_csv`` wrote them, line breaks in fields included."""
    reader = spark.read.schema(LOG_SCHEMA).option("header", True).option("escape", '"')
    reader = reader.option("nullValue", "\x00").option("multiLine", True)
    return reader.csv(path).na.fill("")
