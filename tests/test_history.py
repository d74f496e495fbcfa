"""Records, filters, paging, replay, retention."""

from datetime import datetime, timezone

import pytest
from pyspark.sql import functions as F

from reqsieve.operators import history, scoring
from reqsieve.sources import sinks
from reqsieve.sources.record_store import RecordStore


def records(spark, n=40):
    return spark.range(n).select(
        "id",
        F.concat(F.lit("r"), F.col("id")).alias("request_id"),
        F.timestamp_seconds(F.lit(1704067200) + F.col("id") * 21600).alias("ts"),
        F.lit("GET").alias("method"),
        F.when(F.col("id") % 2 == 0, "/even").otherwise("/odd").alias("path"),
        (F.col("id") % 10).cast("double").alias("anomaly_score"),
        (F.col("id") % 10 > 5).alias("is_anomaly"),
    )


def ids(df):
    return [r.id for r in df.collect()]


def test_time_bounds():
    want = datetime(2024, 1, 1, 12, tzinfo=timezone.utc)
    for text in ("2024-01-01T12:00:00Z", "2024-01-01 12:00:00", "2024-01-01T14:00:00+02:00", "1704110400", 1704110400.0):
        assert history.parse_time_bound(text) == want
    with pytest.raises(ValueError):
        history.parse_time_bound("yesterday")


def test_time_bounds_as_column(one):
    values = ["2024-01-01T12:00:00Z", "2024-01-01 12:00:00", "2024-01-01T14:00:00+02:00", "1704110400.5", "2024-01-01", "x"]
    want = [1704110400.0, 1704110400.0, 1704110400.0, 1704110400.5, 1704067200.0, None]
    assert one(values, history.time_text_to_epoch) == want


def test_filters(spark):
    df = records(spark)
    assert len(ids(history.filter_history(df))) == 40
    got = history.filter_history(df, "2024-01-02T00:00:00Z", 1704067200 + 12 * 21600)
    assert sorted(ids(got)) == list(range(4, 13))  # both ends count
    assert set(ids(history.filter_history(df, flagged=True))) == {i for i in range(40) if i % 10 > 5}
    assert set(ids(history.filter_history(df, min_score=3, max_score=4))) == {i for i in range(40) if i % 10 in (3, 4)}
    assert set(ids(history.filter_history(df, path_pattern="dd"))) == set(range(1, 40, 2))


def test_pages_by_offset_and_by_key_agree(spark):
    df = records(spark)
    assert ids(history.page(df, 5)) == [39, 38, 37, 36, 35]
    assert ids(history.page(df, 5, 5)) == [34, 33, 32, 31, 30]
    last = df.where("id = 35").select(F.unix_timestamp("ts").alias("t")).first().t
    assert ids(history.page(df, 5, after=(last, 35))) == [34, 33, 32, 31, 30]
    assert ids(history.page(df, 5, 38)) == [1, 0]


def test_pages_equal_a_sort(spark):
    df = records(spark, 400).withColumn("ts", F.timestamp_seconds(F.lit(1704067200) + F.floor(F.col("id") / 3) * 40000))
    df = df.withColumn("ts", F.when(F.col("id") % 50 != 0, F.col("ts")))
    for limit, offset in ((5, 0), (7, 11), (50, 333), (100, 350), (10, 400), (500, 0)):
        want = ids(df.orderBy(F.desc("ts"), F.desc("id")))[offset : offset + limit]
        assert ids(history.page(df, limit, offset)) == want


@pytest.mark.parametrize("zone", ["America/New_York", "Asia/Tokyo"])
def test_days_are_utc_in_every_zone(spark, tmp_path, zone):
    start = 1704412800  # 2024-01-05T00:00:00Z
    df = records(spark, 48).withColumn("ts", F.timestamp_seconds(F.lit(start) + (F.col("id") - 24) * 3600))
    before = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", zone)
    try:
        store = RecordStore(spark, str(tmp_path / "store"))
        store.append(df)
        stored = store.read()
        assert {str(r.dt) for r in stored.select("dt").distinct().collect()} == {"2024-01-04", "2024-01-05"}
        assert history.filter_history(stored, from_time="2024-01-05T00:00:00Z").count() == 24
        assert history.kept_records(stored, "2024-01-05T00:30:00Z", 0).count() == 23
        assert history.expired_count(stored, "2024-01-05T00:30:00Z", 0).first()[0] == 25
    finally:
        spark.conf.set("spark.sql.session.timeZone", before)


def test_history_page(spark):
    df = history.with_client_hash(records(spark).withColumn("client", F.lit("1.2.3.4")), "s")
    rows = history.history_page(df, 4, high=9, medium=7).collect()
    assert [r.band for r in rows] == ["high", "medium", "medium", "low"]
    assert {r.has_more for r in rows} == {True} and {len(r.client_prefix) for r in rows} == {8}
    assert {r.has_more for r in history.history_page(df, 50).collect()} == {False}


def test_lookup(spark):
    df = records(spark)
    assert ids(history.lookup(df, "r7")) == [7]
    wanted = spark.createDataFrame([("r1",), ("r1",), ("nope",)], "request_id string")
    assert ids(history.lookup_all(df, wanted)) == [1]


def test_stats_and_counters(spark):
    r = history.stats(records(spark)).first()
    assert (r.total_requests, r.total_anomalies, r.avg_score, r.detection_rate) == (40, 16, 4.5, 40.0)
    empty = history.stats(records(spark).where("id < 0")).first()
    assert (empty.total_requests, empty.avg_score, empty.detection_rate, empty.first_detection) == (0, 0.0, 0.0, None)
    c = history.counters(records(spark)).first()
    assert (c.requests, c.anomalies) == (40, 16)


def request_rows(spark):
    return spark.createDataFrame(
        [("a", "GET", "/p", [("q", "1\"é"), ("B", "2")], "x=1"), ("b", "POST", "/p/123456", [], "")],
        "request_id string, method string, path string, query_params array<struct<k:string,v:string>>, body string",
    ).withColumns({"ts": F.timestamp_seconds(F.lit(1704067200)), "client": F.lit("1.1.1.1")})


def test_records_round_trip_and_replay(spark, tmp_path):
    rows = request_rows(spark).withColumns({"anomaly_score": F.lit(1.5), "is_anomaly": F.lit(True)})
    built = history.build_records(rows, 3, 1.0, "salt", notes=history.BATCH_NOTE)
    assert built.columns == history.RECORD_FIELDS
    sinks.append_records(built, str(tmp_path / "store"))
    stored = RecordStore(spark, str(tmp_path / "store")).read()
    r = stored.where("request_id = 'a'").first()
    assert (r.model_version, r.threshold, r.notes, r.timestamp) == (3, 1.0, "batch_request", 1704067200.0)
    assert len(r.client_ip_hash) == 64 and str(r.dt) == "2024-01-01"
    back = {x.request_id: x for x in history.unpack_requests(stored).collect()}
    assert [(p.k, p.v) for p in back["a"].query_params] == [("q", '1"é'), ("B", "2")]
    assert (back["b"].method, back["b"].path, back["b"].body) == ("POST", "/p/123456", "")

    normal = spark.createDataFrame([("GET /p?b=2&q=1",)], "text string")
    model = scoring.fit_unigram(normal)
    again = history.replay(stored, model, 4, 0.5, "2024-02-01T00:00:00Z")
    got = again.collect()
    assert again.columns == history.RECORD_FIELDS
    assert {x.notes for x in got} == {"replay_of_a", "replay_of_b"}
    for x in got:
        old = x.notes.removeprefix("replay_of_")
        assert x.request_id.startswith(f"replay-{old}-") and len(x.request_id.rsplit("-", 1)[1]) == 8
        assert x.model_version == 4 and x.client_ip_hash is None
    assert [x.request_id for x in sorted(got)] == [x.request_id for x in sorted(again.collect())]
    pairs = history.compare_replay(stored, again).collect()
    assert {p.request_id for p in pairs} == {"a", "b"} and {p.old_score for p in pairs} == {1.5}


def test_filters_prune_days_and_reach_the_scan(spark, tmp_path):
    sinks.append_records(records(spark), str(tmp_path / "s"))
    df = RecordStore(spark, str(tmp_path / "s")).read()
    out = history.filter_history(df, "2024-01-03T00:00:00Z", "2024-01-03T23:00:00Z", min_score=2)
    mode = spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted")
    plan = out._jdf.queryExecution().explainString(mode)
    assert "PartitionFilters: [isnotnull(dt" in plan and "GreaterThanOrEqual(anomaly_score,2.0)" in plan
    assert "GreaterThanOrEqual(ts" in plan
    assert sorted(ids(out)) == [8, 9]


def test_cleanup_rewrites_one_day(spark, tmp_path):
    spark.sql(f"CREATE DATABASE IF NOT EXISTS hist LOCATION '{tmp_path}/db'")
    spark.sql("USE hist")
    try:
        rows = sinks.with_day(records(spark))
        rows.write.partitionBy("dt").format("parquet").saveAsTable("detections")
        # 40 records, four a day from 1 January; the cutoff is 6 January 12:00.
        deleted = history.cleanup(spark, "hist.detections", "2024-01-16T12:00:00Z", 10)
        assert deleted == 22
        assert sorted(ids(spark.table("hist.detections"))) == list(range(22, 40))
        days = [r[0] for r in spark.sql("SHOW PARTITIONS hist.detections").collect()]
        assert min(days) == "dt=2024-01-06" and len(days) == 5
        assert history.cleanup(spark, "hist.detections", "2024-01-16T12:00:00Z", 10) == 0
        kept = history.kept_records(rows, "2024-01-16T12:00:00Z", 10)
        assert sorted(ids(kept)) == list(range(22, 40))
    finally:
        spark.sql("USE default")
        spark.sql("DROP DATABASE hist CASCADE")
