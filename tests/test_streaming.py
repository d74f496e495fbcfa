"""Streams give the batch result, and survive restarts."""

import hashlib
import os
import random

import pytest
from pyspark.sql import functions as F

from reqsieve.operators import history, normalize, parse, rate_audit, scoring
from reqsieve.plans import views
from reqsieve.sources import model_store, sinks, tail
from reqsieve.sources.record_store import RecordStore
from reqsieve.streaming import audit, jobs


def drain(stream, tmp_path, name="out"):
    out = str(tmp_path / name)
    jobs.write_stream(stream, out, str(tmp_path / f"{name}-progress"), interval_seconds=None).awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(out)


def lines(df):
    return sorted(r.value for r in df.collect())


def tailer(spark, tmp_path, folder, **options):
    """Run a tailing query to the end of what is there; every call is a restart."""

    def run():
        stream = jobs.tail_logs(spark, [str(folder)], positions=str(tmp_path / "positions"), **options)
        return lines(drain(stream.select("value"), tmp_path))

    return run


def test_tail_emits_each_line_once(spark, tmp_path):
    logs = tmp_path / "logs"
    logs.mkdir()
    a, b = logs / "a.log", logs / "b.log"
    a.write_text("a1\na2\nhalf")
    tailed = tailer(spark, tmp_path, logs, max_partition_bytes=7)
    assert tailed() == ["a1", "a2"]
    with a.open("a") as f:
        f.write(" done\n\n  \na3\n")
    b.write_text("b1\n")
    assert tailed() == ["a1", "a2", "a3", "b1", "half done"]
    # Rotation: the renamed file keeps its position, the new file of that name starts at 0.
    os.rename(a, logs / "a.log.1")
    with (logs / "a.log.1").open("a") as f:
        f.write("a4\n")
    a.write_text("new1\n")
    assert tailed() == ["a1", "a2", "a3", "a4", "b1", "half done", "new1"]
    assert tailed() == ["a1", "a2", "a3", "a4", "b1", "half done", "new1"]
    # Truncated in place and written again: what is there now is new.
    b.write_text("c\n")
    assert tailed() == ["a1", "a2", "a3", "a4", "b1", "c", "half done", "new1"]


def test_file_that_listings_miss_keeps_its_position(spark, tmp_path):
    logs = tmp_path / "logs"
    logs.mkdir()
    x = logs / "x.log"
    x.write_text("x1\nx2\n")
    (logs / "y.log").write_text("y1\n")
    tailed = tailer(spark, tmp_path, logs)
    assert tailed() == ["x1", "x2", "y1"]
    os.rename(x, tmp_path / "away.log")
    with (logs / "y.log").open("a") as f:
        f.write("y2\n")
    assert tailed() == ["x1", "x2", "y1", "y2"]
    # Restarted several times while the file is away, and lines are added there.
    assert tailed() == ["x1", "x2", "y1", "y2"]
    with (tmp_path / "away.log").open("a") as f:
        f.write("x3\n")
    os.rename(tmp_path / "away.log", x)
    assert tailed() == ["x1", "x2", "x3", "y1", "y2"]
    assert tailed() == ["x1", "x2", "x3", "y1", "y2"]


def reader_of(folder, **options):
    return tail._TailReader({"paths": str(folder), **options})


def values(reader, parts):
    return [v for p in parts for batch in reader.read(p) for v in batch.column("value").to_pylist()]


def test_missed_file_within_one_run(tmp_path):
    x = tmp_path / "x.log"
    x.write_text("x1\n")
    reader = reader_of(tmp_path)
    first = reader.latestOffset()
    assert values(reader, reader.partitions({}, first)) == ["x1"]
    os.rename(x, tmp_path / ".hidden")
    second = reader.latestOffset()
    assert values(reader, reader.partitions(first, second)) == []
    os.rename(tmp_path / ".hidden", x)
    with x.open("a") as f:
        f.write("x2\n")
    assert values(reader, reader.partitions(second, reader.latestOffset())) == ["x2"]


def test_rename_between_planning_and_reading(tmp_path):
    x = tmp_path / "x.log"
    x.write_text("old1\nold2\n")
    reader = reader_of(tmp_path, maxPartitionBytes="6")
    end = reader.latestOffset()
    parts = reader.partitions({}, end)
    os.rename(x, tmp_path / "x.log.1")
    x.write_text("new\n")
    assert values(reader, parts) == ["old1", "old2"]
    # The batch is planned again after a crash, by a reader that knows nothing, and reads the same.
    other = reader_of(tmp_path)
    assert values(other, other.partitions({}, end)) == ["old1", "old2"]
    assert values(other, other.partitions(end, other.latestOffset())) == ["new"]


def test_file_gone_between_planning_and_reading(tmp_path):
    x = tmp_path / "x.log"
    x.write_text("old\n")
    reader = reader_of(tmp_path)
    parts = reader.partitions({}, reader.latestOffset())
    os.remove(x)
    x.write_text("another file of this name\n")
    with pytest.raises(FileNotFoundError):
        values(reader, parts)
    assert values(reader_of(tmp_path, failOnDataLoss="false"), parts) == []


@pytest.mark.parametrize("known", [True, False])
def test_new_file_on_an_old_inode(tmp_path, known):
    x = tmp_path / "x.log"
    x.write_text("first file\n")
    reader = reader_of(tmp_path)
    before = reader.latestOffset()
    reader.partitions({}, before)
    # Same inode, other content, and longer: the position of the old file means nothing.
    with x.open("r+") as f:
        f.write("other file\nmore\n")
    after = (reader if known else reader_of(tmp_path)).latestOffset()
    assert list(after) == list(before)
    got = reader if known else reader_of(tmp_path)
    assert values(got, got.partitions(before, after)) == ["other file", "more"]


def test_forgotten_files_leave_the_offset(tmp_path):
    x = tmp_path / "x.log"
    x.write_text("x1\n")
    reader = reader_of(tmp_path, forgetAfterSeconds="0")
    assert len(reader.latestOffset()) == 1
    os.remove(x)
    assert reader.latestOffset() == {}


def test_tail_from_end_of_named_file(spark, tmp_path):
    log = tmp_path / "x.log"
    log.write_text("old\n")
    run = tailer(spark, tmp_path, log, from_end=True)
    assert run() == []
    with log.open("a") as f:
        f.write("new\n")
    assert run() == ["new"]


@pytest.mark.parametrize("piece", [1, 2, 5, 64])
def test_byte_ranges_cover_every_line_once(tmp_path, piece):
    path = tmp_path / "f"
    want = ["a", "bb", "é" * 4, "x" * 9, "last"]
    path.write_text("\n".join(want) + "\n", encoding="utf-8")
    reader = tail._TailReader({"paths": str(path), "maxPartitionBytes": str(piece)})
    got = []
    for part in reader.partitions({}, reader.latestOffset()):
        for batch in reader.read(part):
            got += batch.column("value").to_pylist()
    assert got == want


def test_followed_files_parse_like_batch(spark, sf_dir, tmp_path):
    static = views.log_lines(spark, sf_dir)
    static.select("value").write.text(str(tmp_path / "in"))
    stream = parse.parse_log_lines(jobs.follow_files(spark, str(tmp_path / "in"), max_files=1))
    got = drain(stream, tmp_path)
    want = parse.parse_log_lines(static).drop("line_id")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


def test_detection_stream_repeats_no_rows(spark, sf_dir, tmp_path):
    static = views.log_lines(spark, sf_dir)
    static.write.parquet(str(tmp_path / "in"))
    requests = normalize.with_training_text(parse.light_requests_json_or_quoted(static))
    model = scoring.fit_unigram(requests)
    stream = spark.readStream.schema("line_id bigint, value string").parquet(str(tmp_path / "in"))
    store, log = RecordStore(spark, str(tmp_path / "records")), str(tmp_path / "log")
    want = scoring.score_requests(requests, model, "line_id", 5.0)
    expected = {r.line_id: (round(r.anomaly_score, 9), r.is_anomaly, round(r.confidence, 9)) for r in want.collect()}
    clients = {r.line_id: r.client for r in parse.with_line_client(static).collect()}
    # The second run has lost its progress, as after a crash before the commit.
    for run in ("p1", "p2"):
        jobs.detect_stream(
            stream, model, 5.0, store, str(tmp_path / run), log=log, salt="s", interval_seconds=None
        ).awaitTermination()
        number = lambda r: int(r.request_id.split("-")[1])
        got = store.read().collect()
        logged = {number(r): r for r in spark.read.schema(sinks.DETECTION_LOG_SCHEMA).json(log).collect()}
        assert len(got) == len(expected) == len(logged)
        assert {
            number(r): (round(r.anomaly_score, 9), r.is_anomaly, round(logged[number(r)].confidence, 9)) for r in got
        } == expected
        hashes = {i: c and hashlib.sha256(("s" + c).encode()).hexdigest() for i, c in clients.items()}
        assert {number(r): r.client_ip_hash for r in got} == {i: hashes[i] for i in expected}
        assert all(r.headers == {} and float(r.ts) > 1.6e9 and r.method for r in logged.values())


def test_detection_stream_takes_the_newest_model(spark, tmp_path):
    path, folder = str(tmp_path / "models"), tmp_path / "in"
    folder.mkdir()
    rows = spark.createDataFrame([(1, "GET /a"), (2, "GET /b")], "id long, text string")
    store = RecordStore(spark, str(tmp_path / "records"))

    def run(k):
        (folder / f"{k}.txt").write_text(f'h "GET /{k} x" 200\n')
        lines = jobs.follow_files(spark, str(folder)).withColumn("ts", F.lit("2024-01-01 00:00:00").cast("timestamp"))
        jobs.detect_stream(lines, path, 1.0, store, str(tmp_path / "p"), interval_seconds=None).awaitTermination()

    run(0)  # no model yet: score 0, version 0
    model_store.save_model(scoring.fit_unigram(rows), path)
    run(1)
    model_store.retrain(spark, path, rows)
    run(2)
    got = {r.path: (r.model_version, r.anomaly_score > 0, r.ts.year) for r in store.read().collect()}
    assert got == {"/0": (0, False, 2024), "/1": (1, True, 2024), "/2": (2, True, 2024)}


def test_for_each_batch(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "f").write_text("x\ny\n")
    seen = []
    jobs.for_each_batch(
        jobs.follow_files(spark, str(tmp_path / "in")),
        lambda df, i: seen.append((i, lines(df))),
        str(tmp_path / "p"),
        interval_seconds=None,
    ).awaitTermination()
    assert seen == [(0, ["x", "y"])]


def events(spark, tmp_path, files):
    schema = "id bigint, client string, ts timestamp"
    for i, rows in enumerate(files):
        df = spark.createDataFrame([(a, c, t) for a, c, t in rows], "id bigint, client string, t bigint")
        df.select("id", "client", F.timestamp_seconds("t").alias("ts")).coalesce(1).write.mode("append").parquet(
            str(tmp_path / "events" / str(i))
        )
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "events" / "*"))


def run_audit(spark, tmp_path, files, **options):
    """Each file is a micro-batch; returns what was given out and what is still held."""
    stream = events(spark, tmp_path, files)
    out = str(tmp_path / "audit")
    options = {"limit": 2, "window_seconds": 60, **options}
    audit.audit_stream(stream, out, str(tmp_path / "p"), interval_seconds=None, **options).awaitTermination()
    held = audit.held(spark, out, stream, options["limit"], options["window_seconds"])
    return audit.audited(spark, out, stream).collect(), held.collect()


def batch_audit(spark, rows, **options):
    flat = spark.createDataFrame(rows, "id bigint, client string, t bigint").select(
        "id", "client", F.timestamp_seconds("t").alias("ts")
    )
    return {r.id: r.accepted for r in rate_audit.audit(flat, **{"limit": 2, "window_seconds": 60, **options}).collect()}


def test_audit_stream_equals_batch(spark, tmp_path):
    rows = [(i, [f"c{i % 3}", None][i % 11 == 0], 1_700_000_000 + i * 7) for i in range(240)]
    given, held = run_audit(spark, tmp_path, [rows[:80], rows[80:160], rows[160:]], lateness_seconds=100)
    assert given and held and len({r.id for r in given} | {r.id for r in held}) == len(given) + len(held) == 240
    assert not any(r.late for r in given)
    assert {r.id: r.accepted for r in [*given, *held]} == batch_audit(spark, rows)


def test_audit_stream_of_disordered_requests(spark, tmp_path):
    """Out of order by less than the lateness: the decisions of the batch audit."""
    r = random.Random(4)
    rows = [(i, r.choice(["hot", "hot", "hot", "a", None]), 1_700_000_000 + i * 3 + r.randint(0, 200)) for i in range(600)]
    files = [rows[k : k + 120] for k in range(0, 600, 120)]
    given, held = run_audit(spark, tmp_path, files, limit=5, lateness_seconds=300)
    assert {x.id: x.accepted for x in [*given, *held]} == batch_audit(spark, rows, limit=5)
    assert len(given) > 300 and not any(x.late for x in given)


def test_late_requests_come_out_once_with_a_flag(spark, tmp_path):
    first = [(i, "a", 1000 + i) for i in range(5)] + [(9, "a", 5000)]
    second = [(20, "a", 1001), (21, "b", 2), (22, "a", None), (23, "a", 4990), (24, "a", 9000)]
    given, held = run_audit(spark, tmp_path, [first, second], lateness_seconds=100)
    assert sorted(r.id for r in [*given, *held]) == [0, 1, 2, 3, 4, 9, 20, 21, 22, 23, 24]
    late = {r.id for r in given if r.late}
    assert late == {20, 21, 22} and all(r.accepted is None for r in given if r.late)
    on_time = [x for x in first + second if x[0] not in late]
    assert {r.id: r.accepted for r in [*given, *held] if not r.late} == batch_audit(spark, on_time)


def test_repeated_audit_batches_change_nothing(spark, tmp_path):
    rows = [(i, "a", 1000 + 20 * i) for i in range(40)]
    files = [rows[:20], rows[20:]]
    given, held = run_audit(spark, tmp_path, files, lateness_seconds=60)
    stream, out = events(spark, tmp_path, []), str(tmp_path / "audit")
    audit.audit_stream(stream, out, str(tmp_path / "lost"), 2, 60, lateness_seconds=60, interval_seconds=None).awaitTermination()
    again = audit.audited(spark, out, stream).collect()
    assert sorted(again) == sorted(given) and sorted(audit.held(spark, out, stream, 2, 60).collect()) == sorted(held)


def test_running_counters(spark, tmp_path):
    stream = events(spark, tmp_path, [[(1, "a", 0), (2, "a", 60)], [(3, "b", 120)]])
    flagged = stream.withColumn("is_anomaly", F.col("id") == 2)
    query = (
        history.counters(flagged).writeStream.outputMode("complete").format("memory").queryName("counters")
        .trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "p")).start()
    )
    query.awaitTermination()
    r = spark.table("counters").first()
    assert (r.requests, r.anomalies) == (3, 1)


def test_lines_of_one_file_are_parsed_by_many_tasks(spark, sf_dir, tmp_path):
    """One small file of many lines is not one task's work."""
    views.log_lines(spark, sf_dir).limit(2000).coalesce(1).write.parquet(str(tmp_path / "in"))
    tasks = []

    class Store:
        def append(self, records, batch):
            tasks.append(records.select(F.spark_partition_id()).distinct().count())
            assert records.select("request_id").distinct().count() == records.count()

    stream = spark.readStream.schema("line_id bigint, value string").parquet(str(tmp_path / "in"))
    model = scoring.fit_unigram(spark.createDataFrame([("GET /a",)], "text string"))
    jobs.detect_stream(stream, model, 5.0, Store(), str(tmp_path / "p"), interval_seconds=None).awaitTermination()
    assert tasks == [2 * spark.sparkContext.defaultParallelism]
