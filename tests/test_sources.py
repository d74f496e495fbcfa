"""Scans and sinks over files."""

import csv
import gzip
import json

from pyspark.sql import functions as F

from reqsieve.operators import parse
from reqsieve.sources import logs, sinks

LINE = '1.1.1.1 - - [01/Jan/2024:00:00:01 +0000] "GET /é?q=1 HTTP/1.1" 200 12 "-" "a, ""b"'.replace('""b', "'b'")


def values(df, col="value"):
    return sorted(r[col] for r in df.collect())


def test_scan_is_recursive_and_skips_blanks(spark, tmp_path):
    (tmp_path / "a" / "b").mkdir(parents=True)
    (tmp_path / "x.log").write_text("one\n\n   \n")
    (tmp_path / "a" / "y.log").write_text("two\nthree")
    (tmp_path / "a" / "b" / "z.txt").write_bytes(b"bad \xff byte\n")
    with gzip.open(tmp_path / "a" / "w.gz", "wt") as f:
        f.write("zipped\n")
    assert values(logs.read_log_lines(spark, str(tmp_path))) == ["bad � byte", "one", "three", "two", "zipped"]
    assert values(logs.read_log_lines(spark, str(tmp_path / "x.log"))) == ["one"]
    named = logs.read_log_lines(spark, str(tmp_path), file_column="file").where("value = 'two'").first()
    assert named.file.endswith("y.log")


def test_long_file_keeps_lines_whole(spark, tmp_path):
    lines = [f"{i} " + "x" * (i % 977) for i in range(6000)]
    (tmp_path / "big.log").write_text("\n".join(lines))
    assert values(logs.read_log_lines(spark, str(tmp_path))) == sorted(lines)


def formats(spark, lines):
    df = spark.createDataFrame([(x,) for x in lines], "value string")
    return logs.detect_log_format(df).first().log_format


def test_format_detection(spark):
    assert formats(spark, [LINE]) == "combined"
    assert formats(spark, ['{"ip": 1}']) == "json"
    assert formats(spark, [LINE, '{"status": null}']) == "json"  # a tie
    assert formats(spark, [LINE, '{"other": 1}', "{bad}"]) == "combined"
    assert formats(spark, ["", "nonsense"]) == "json"
    assert formats(spark, [" "] * 60 + ['{"ip": 1}'] * 10 + [LINE] * 40) == "combined"


def test_format_per_file(spark, tmp_path):
    (tmp_path / "j.log").write_text('{"ip": "a"}\n')
    (tmp_path / "c.log").write_text(LINE + "\n")
    df = logs.read_log_lines(spark, str(tmp_path), file_column="file")
    got = {r.file.rsplit("/", 1)[1]: r.log_format for r in logs.log_format_profile(df, ["file"]).collect()}
    assert got == {"j.log": "json", "c.log": "combined"}


def test_jsonl_and_csv_sinks(spark, tmp_path):
    df = parse.parse_log_lines(spark.createDataFrame([(LINE,)], "value string")).coalesce(1)
    sinks.write_parsed(df, str(tmp_path / "o.jsonl"))
    sinks.write_parsed(df, str(tmp_path / "o.csv"))
    part = next((tmp_path / "o.jsonl").glob("part-*.json")).read_text(encoding="utf-8")
    assert "é" in part and list(json.loads(part)) == parse.LOG_FIELDS
    part = next((tmp_path / "o.csv").glob("part-*.csv"))
    rows = list(csv.reader(part.open(encoding="utf-8")))
    assert rows[0] == parse.LOG_FIELDS
    assert rows[1] == ["01/Jan/2024:00:00:01 +0000", "1.1.1.1", "GET", "/é", "q=1", "a, 'b'", "200", "12", "-", ""]
    assert logs.read_structured_requests(spark, str(tmp_path / "o.jsonl")).collect() == df.collect()


def test_csv_quotes_and_line_breaks(spark, tmp_path):
    base = parse.parse_log_lines(spark.createDataFrame([(LINE,)], "value string"))
    df = base.coalesce(1).withColumn("body", F.lit('say "hi",\nbye'))
    sinks.write_log_csv(df, str(tmp_path / "q"))
    rows = list(csv.reader(next((tmp_path / "q").glob("part-*.csv")).open(encoding="utf-8", newline="")))
    assert rows[1][-1] == 'say "hi",\nbye'


def test_labelled_requests_of_both_layouts(spark, tmp_path):
    (tmp_path / "t.jsonl").write_text('{"request": "GET /a"}\n{"request": "GET /b", "label": "attack"}\n')
    obj = {"request": {"method": "GET", "path": "/c", "query_params": {"q": "1"}, "headers": {}, "body": ""}, "label": "benign"}
    (tmp_path / "o.jsonl").write_text(json.dumps(obj) + "\n")
    rows = logs.read_labelled_requests(spark, str(tmp_path / "t.jsonl"), str(tmp_path / "o.jsonl")).collect()
    assert {(r.request_text, r.label, r.path) for r in rows} == {
        ("GET /a", None, None), ("GET /b", "attack", None), (None, "benign", "/c"),
    }
    assert [r.query_params for r in rows if r.path] == [{"q": "1"}]


def test_payloads(spark, tmp_path):
    (tmp_path / "p.txt").write_text("# head\n\n  ' OR 1=1  \n#x\n<script>\n   \n")
    assert values(logs.read_payloads(spark, str(tmp_path / "p.txt")), "payload") == ["' OR 1=1", "<script>"]


def test_encoded_samples(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text('{"input_ids": [2, 3], "attention_mask": [1, 1]}\n\n')
    (tmp_path / "b.txt").write_text("not a sample\n")
    rows = logs.read_encoded_samples(spark, str(tmp_path)).collect()
    assert [(r.input_ids, r.attention_mask) for r in rows] == [([2, 3], [1, 1])]


def test_detection_log_and_evaluation_csv(spark, tmp_path):
    df = spark.createDataFrame([("r", 1.5, "é")], "request_id string, anomaly_score double, note string")
    sinks.append_detection_log(df, str(tmp_path / "d"))
    sinks.append_detection_log(df, str(tmp_path / "d"), batch=True)
    got = spark.read.schema("request_id string, batch boolean").json(str(tmp_path / "d")).collect()
    assert sorted(str(r.batch) for r in got) == ["None", "True"]
    ev = spark.createDataFrame(
        [(1.5, "attack", "GET", "/s", '{"q":"a,\\"b"}', 8.25, True)], logs.EVAL_SCHEMA
    )
    sinks.write_evaluation(ev, str(tmp_path / "e"))
    assert logs.read_evaluation(spark, str(tmp_path / "e")).collect() == ev.collect()
