"""Request-shaped views over the given tables, each over all of its rows.

``plans/sql.py`` builds the same views in SQL.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F



def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def _by(number: Column, mod: int, cases: dict[int, Column], default: Column) -> Column:
    out = F
    for k, v in cases.items():
        out = out.when(F.pmod(number, F.lit(mod)) == k, v)
    return out.otherwise(default)


def requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(request_id, method, path, query, body) from page addresses and page text.

    Every page keeps its own path and query; by page number a prefix, a suffix or more
    parameters are added so that escapes, duplicates and maskable values occur.
    """
    page, url = F.col("page_id"), F.col("url")
    rest = F.regexp_extract(url, r"^https?://[^/?#]+([^#]*)", 1)
    path = F.substring_index(rest, "?", 1)
    query = F.when(F.instr(rest, "?") > 0, F.regexp_extract(rest, r"\?(.*)$", 1)).otherwise("")
    n = page.cast("string")
    path = _by(
        page,
        7,
        {
            1: F.concat(path, F.lit("//%2e%2E/%2Fetc")),
            2: F.concat(F.lit("/10.0.7."), F.pmod(page, F.lit(300)).cast("string"), path),
            3: F.concat(F.lit("/A+b%20C"), path),
            4: F.concat(path, F.lit("/0000"), n, F.lit("/x")),
            5: F.concat(F.lit("/0123456789abcdef"), n, path),
        },
        path,
    )
    more = _by(
        page,
        8,
        {
            1: F.concat(F.lit("a=1&a="), n, F.lit("&b")),
            2: F.concat(F.lit("q=%2527+OR+"), n, F.lit("&Q=x")),
            3: F.concat(F.lit("=x&&a==b&n="), n),
            4: F.concat(F.lit("a%2520=1&a%20="), n, F.lit("&a%2520=3")),
            5: F.concat(F.lit("x=1;y=2&z=%zz%41&w=100%&B="), n),
            6: F.concat(F.lit("u=%C3%A9&at=2024-01-0"), F.pmod(page, F.lit(9)).cast("string"), F.lit("T10:00:00Z")),
            7: F.concat(F.lit("ip=192.168.1."), n, F.lit("&h=deadbeefdeadbeef"), n),
        },
        F.lit(""),
    )
    session = _by(page, 5, {1: F.concat(F.lit("user=u"), n, F.lit("&session=ab.c-"), n)}, F.lit(""))
    body = F.concat(F.coalesce("html", F.lit("")), session)
    return table(spark, sf_dir, "pages").select(
        page.alias("request_id"),
        F.when(F.pmod(page, F.lit(4)) == 3, "post").otherwise("GET").alias("method"),
        path.alias("path"),
        F.concat_ws("&", F.nullif(query, F.lit("")), F.nullif(more, F.lit(""))).alias("query"),
        body.alias("body"),
    )


def _request_line() -> Column:
    s = lambda c: c.cast("string")
    e = F.col("event_id")
    line = F.concat(
        F.lit("GET /"), F.col("event_type"), F.lit("/"), s(e), F.lit("?k="),
        s(F.pmod(e, F.lit(97))), F.lit("&u="), s(F.col("user_id")), F.lit(" HTTP/1.1"),
    )
    return _by(e, 19, {3: F.lit(""), 5: F.concat(F.lit("POST  /"), F.col("event_type"))}, line)


def request_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select(
        F.col("event_id").alias("line_id"), _request_line().alias("request")
    )


def log_lines_of(events: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """(line_id, value): combined lines, every 10th as JSON, every 17th malformed."""
    e, user = F.col("event_id"), F.col("user_id")
    s = lambda c: c.cast("string")
    when = F.concat(F.date_format("ts", "dd/MMM/yyyy:HH:mm:ss"), F.lit(" +0000"))
    ip = F.concat(F.lit("10.0."), s(F.floor(user / 256)), F.lit("."), s(F.pmod(user, F.lit(256))))
    size = s(F.floor(F.col("value") * 100))
    line = _request_line()
    combined = F.concat(
        ip,
        F.lit(" - - ["),
        when,
        F.lit('] "'),
        line,
        F.lit('" '),
        _by(e, 7, {1: F.lit("404")}, F.lit("200")),
        F.lit(" "),
        _by(e, 13, {4: F.lit("-"), 5: F.lit("1_0x")}, size),
        F.lit(' "'),
        _by(e, 3, {0: F.lit("-")}, F.lit("/home")),
        F.lit('" "agent/'),
        s(F.pmod(e, F.lit(4))),
        F.lit('"'),
        _by(e, 6, {2: F.concat(F.lit(' "sid=s'), s(e), F.lit('"'))}, F.lit("")),
        _by(e, 8, {1: F.lit("  ")}, F.lit("")),
    )
    json = F.concat(
        F.lit('{"'),
        _by(e, 20, {0: F.lit("timestamp")}, F.lit("time")),
        F.lit('": "'),
        when,
        F.lit('", "ip": '),
        _by(e, 30, {0: F.lit('""'), 10: F.lit("null")}, F.concat(F.lit('"'), ip, F.lit('"'))),
        F.lit(', "remote_addr": "172.16.0.1", "request": '),
        _by(e, 70, {0: F.lit("7"), 10: F.lit("[]"), 20: F.lit("null")}, F.concat(F.lit('"'), line, F.lit('"'))),
        F.lit(', "req": "HEAD /fallback?x=1", "status": '),
        _by(e, 50, {0: F.lit("0"), 10: F.lit('"0"'), 20: F.lit('" 2_04 "')}, F.lit("201")),
        F.lit(', "size": '),
        _by(e, 40, {0: F.lit("true"), 10: F.lit("12.5"), 20: F.lit('"12.5"')}, size),
        F.lit(', "agent": '),
        _by(e, 90, {0: F.lit("true"), 10: F.lit("false"), 20: F.lit("42"), 30: F.lit("NaN")}, F.lit('"jsonagent"')),
        F.lit(', "body": "b='),
        s(e),
        F.lit('"'),
        # A key that comes again, and a number that is none.
        _by(e, 110, {0: F.lit(', "status": 503, "load": NaN')}, F.lit("")),
        F.lit("}"),
    )
    broken = _by(
        e,
        3,
        {0: F.lit('{"ip": oops}'), 1: F.concat(ip, F.lit(" GET /nothing "), s(e))},
        F.concat(ip, F.lit(' - - ['), when, F.lit('] "'), line, F.lit('" 200 5')),
    )
    value = F.when(F.pmod(e, F.lit(17)) == 16, broken).when(F.pmod(e, F.lit(10)) == 0, json).otherwise(combined)
    return events.select(*(keep or []), e.alias("line_id"), value.alias("value"))


def log_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return log_lines_of(table(spark, sf_dir, "events"))


def bodies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, body): document text with maskable values put around it."""
    d = F.col("doc_id")
    n = d.cast("string")
    pad = F.lpad(n, 12, "0")
    body = F.concat(
        F.lit("id=3f2504e0-4f89-11d3-9a0c-"),
        pad,
        F.lit(" Token=t."),
        n,
        F.lit(" at 2023-05-0"),
        F.pmod(d, F.lit(9)).cast("string"),
        F.lit(" 12:00:00+02:00, %2Fx%2e "),
        F.col("text"),
        F.lit(" from 10.1.2."),
        F.pmod(d, F.lit(300)).cast("string"),
    )
    docs = table(spark, sf_dir, "documents")
    return docs.select(d.alias("doc_id"), body.alias("body"))


def detections(spark: SparkSession, sf_dir: str, threshold: float = 100.0) -> DataFrame:
    """Detection records from events; ``ts`` stays a wall-clock UTC time."""
    e = F.col("event_id")
    return table(spark, sf_dir, "events").select(
        e.alias("id"),
        F.concat(F.lit("r-"), e.cast("string")).alias("request_id"),
        "ts",
        F.lit("GET").alias("method"),
        F.concat(F.lit("/"), F.col("event_type")).alias("path"),
        F.col("value").alias("anomaly_score"),
        (F.col("value") > threshold).alias("is_anomaly"),
        F.lit(1).alias("model_version"),
        F.lit(float(threshold)).alias("threshold"),
        F.col("user_id").cast("string").alias("client"),
        F.lit(None).cast("string").alias("notes"),
    )


def labelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, text, label): documents that have a label, toxic ones as attacks.

    Neither side is broadcast by hand: labels grow with the documents.
    """
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    marks = table(spark, sf_dir, "labels").select("doc_id", "toxic")
    return docs.join(marks, "doc_id").select(
        F.col("doc_id").alias("id"),
        "text",
        F.when(F.col("toxic") == 1, "attack").otherwise("benign").alias("label"),
    )
