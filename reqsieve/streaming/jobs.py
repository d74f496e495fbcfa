"""Streaming jobs: follow logs, parse, score in micro-batches, count, audit."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from reqsieve.functions.text import is_blank
from reqsieve.operators.history import build_records
from reqsieve.operators.normalize import with_training_text
from reqsieve.operators.parse import light_requests_json_or_quoted, with_line_client
from reqsieve.operators.scoring import BigramModel, score_requests
from reqsieve.sources import model_store
from reqsieve.sources.record_store import RecordStore
from reqsieve.sources.sinks import log_records, write_jsonl
from reqsieve.sources.tail import TailSource

# Fixed value: seconds between near-real-time batches.
BATCH_INTERVAL_SECONDS = 300


def spread(lines: DataFrame, key: str = "line_id") -> DataFrame:
    """The lines dealt over all cores by their id. Files are split by bytes, but parsing costs far
    more than reading, and few large files would leave most cores idle."""
    return lines.repartition(2 * lines.sparkSession.sparkContext.defaultParallelism, key)


def follow_files(spark: SparkSession, folder: str, max_files: int | None = None) -> DataFrame:
    """Lines of closed files put into a folder. ``max_files`` per batch is the throttle.

    Files are known by path: rotate finished files out of the folder, since a rename
    inside it would be read again.
    """
    reader = spark.readStream
    if max_files:
        reader = reader.option("maxFilesPerTrigger", max_files)
    return reader.text(folder).where(~is_blank(F.col("value")))


def tail_logs(
    spark: SparkSession, paths: list[str], from_end: bool = False, max_partition_bytes: int = 64 << 20,
    positions: str | None = None, fail_on_data_loss: bool = True,
) -> DataFrame:
    """Lines appended to growing files or to files of a folder, as (path, value).

    ``positions`` is a folder of the query's own, beside its checkpoint: with it, files that a
    listing misses keep their place over restarts too.
    """
    spark.dataSource.register(TailSource)
    reader = (
        spark.readStream.format("log_tail")
        .option("paths", ",".join(paths))
        .option("startingPosition", "end" if from_end else "start")
        .option("maxPartitionBytes", str(max_partition_bytes))
        .option("failOnDataLoss", str(fail_on_data_loss).lower())
    )
    return (reader.option("positions", positions) if positions else reader).load()


def _start(writer, interval_seconds: int | None) -> StreamingQuery:
    """Every ``interval_seconds``, or once over what is there now when None."""
    if interval_seconds is None:
        return writer.trigger(availableNow=True).start()
    return writer.trigger(processingTime=f"{interval_seconds} seconds").start()


def for_each_batch(
    stream: DataFrame,
    fn: Callable[[DataFrame, int], None],
    checkpoint: str,
    interval_seconds: int | None = BATCH_INTERVAL_SECONDS,
) -> StreamingQuery:
    """Hand every micro-batch to ``fn``. After a crash a batch may come again."""
    return _start(
        stream.writeStream.foreachBatch(fn).option("checkpointLocation", checkpoint), interval_seconds
    )


def write_stream(
    stream: DataFrame,
    path: str,
    checkpoint: str,
    fmt: str = "parquet",
    interval_seconds: int | None = BATCH_INTERVAL_SECONDS,
) -> StreamingQuery:
    """Append a stream to files, exactly once."""
    writer = stream.writeStream.format(fmt).option("path", path).option("checkpointLocation", checkpoint)
    return _start(writer.outputMode("append"), interval_seconds)


def detect_stream(
    lines: DataFrame,
    model: DataFrame | BigramModel | str | None,
    threshold: float,
    store: RecordStore,
    checkpoint: str,
    log: str | None = None,
    stream: str = "detect",
    salt: str = "",
    model_version: int = 1,
    max_length: int | None = None,
    interval_seconds: int | None = BATCH_INTERVAL_SECONDS,
) -> StreamingQuery:
    """Lines to detection records: light parse, score, store and log.

    ``lines`` has ``value`` and may have ``line_id``, unique within a batch, ``client``, of
    which the record keeps a salted hash, and ``ts``; without a time the current one counts.
    ``model`` may be the path of a model store: every batch is scored with its newest version.
    Each micro-batch is committed to the store under its number, so one that is repeated after
    a crash adds nothing, and replaces its own folder of the log.
    """

    def run(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        if "line_id" not in batch.columns:
            batch = batch.withColumn("line_id", F.monotonically_increasing_id())
        if "ts" not in batch.columns:
            batch = batch.withColumn("ts", F.current_timestamp())
        version = model_store.current_version(spark, model) if isinstance(model, str) else model_version
        scorer = model_store.load_model(spark, model, version) if isinstance(model, str) else model
        known = ["client"] if "client" in batch.columns else []
        columns = spread(batch.select("line_id", *known, "ts", "value"))
        if not known:
            columns = with_line_client(columns)
        parsed = with_training_text(light_requests_json_or_quoted(columns)).persist()
        # Several uses: the text for the score, the fields for record and log. The two sides of a
        # join start together and would both parse, so the rows are parsed before.
        scored = None
        try:
            parsed.count()
            scores = score_requests(parsed, scorer, "line_id", threshold, max_length=max_length)
            rid = F.concat(F.lit(f"b{batch_id}-"), F.col("line_id").cast("string"))
            scored = parsed.drop("text").join(scores, "line_id").withColumn("request_id", rid).persist()
            if log is not None:
                write_jsonl(log_records(scored), f"{log.rstrip('/')}/batch_id={batch_id}")
            store.append(build_records(scored, version or 0, threshold, salt), (stream, batch_id))
        finally:
            if scored is not None:
                scored.unpersist()
            parsed.unpersist()

    return for_each_batch(lines, run, checkpoint, interval_seconds)
