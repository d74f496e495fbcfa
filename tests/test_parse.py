"""Log lines to rows, rows to requests."""

from pyspark.sql import functions as F

from reqsieve.sources import logs
from reqsieve.operators import normalize, parse

COMBINED = '10.0.0.1 - bob [01/Jan/2024:00:00:01 +0000] "GET /a/b?x=1?y HTTP/1.1" 200 12 "-" "curl"'


def rows(df):
    return [r.asDict() for r in df.collect()]


def parse_all(spark, lines):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(lines)], "i int, value string")
    return {r["i"]: r for r in rows(parse.parse_log_lines(df))}


def test_combined_line(spark):
    got = parse_all(spark, [COMBINED])[0]
    assert got == {
        "i": 0, "timestamp": "01/Jan/2024:00:00:01 +0000", "ip": "10.0.0.1", "method": "GET", "path": "/a/b",
        "query": "x=1?y", "user_agent": "curl", "status": 200, "response_size": 12, "referer": "-", "body": "",
    }


def test_combined_variants(spark):
    got = parse_all(
        spark,
        [
            COMBINED + ' "k=v"  ',
            COMBINED.replace(" 12 ", " - "),
            COMBINED.replace('"GET /a/b?x=1?y HTTP/1.1"', '""'),
            COMBINED.replace(' "-" "curl"', ""),  # common format has no agent
            COMBINED.replace("curl", 'c\\"url'),  # escaped quotes do not match
            COMBINED.replace("curl", "cu\x1erl"),  # holds the internal mark
            "",
            COMBINED.replace("bob", 'b"ob'),
        ],
    )
    assert sorted(got) == [0, 1, 2, 5, 7]
    assert got[0]["body"] == "k=v"
    assert got[1]["response_size"] == 0
    assert (got[2]["method"], got[2]["path"]) == ("", "")
    assert got[5]["user_agent"] == "cu\x1erl" and got[5]["status"] == 200
    assert got[7]["ip"] == "10.0.0.1"


def test_json_lines(spark):
    got = parse_all(
        spark,
        [
            '{"request": "POST /p?q=1 HTTP/1.1", "status": "404", "body_bytes_sent": 9, "time": "t", "body": {"a": 1}}',
            '{"request": null, "req": "GET /r", "ip": "", "remote_addr": "1.1.1.1", "status": 0}',
            '{"other": 1}',
            '{"request": 5, "req": "GET /r", "agent": true}',
            '{"ip": oops}',
            '{"status": 200.0, "size": "1_0", "request": []}',
            '  {"request": "GET", "ip": ["x"], "user_agent": false, "agent": 0, "referer": {}}  ',
        ],
    )
    assert sorted(got) == [0, 1, 2, 3, 5, 6]
    assert (got[0]["method"], got[0]["path"], got[0]["query"]) == ("POST", "/p", "q=1")
    assert (got[0]["status"], got[0]["response_size"], got[0]["timestamp"]) == (404, 9, "t")
    assert got[0]["body"] == '{"a":1}'
    assert (got[1]["path"], got[1]["ip"], got[1]["status"]) == ("/r", "1.1.1.1", 0)
    assert all(got[2][f] in ("", 0) for f in parse.LOG_FIELDS)
    assert (got[3]["method"], got[3]["user_agent"]) == ("", "True")
    assert (got[5]["status"], got[5]["response_size"], got[5]["method"]) == (0, 10, "")
    assert (got[6]["method"], got[6]["ip"], got[6]["user_agent"], got[6]["referer"]) == ("GET", '["x"]', "", "")


def test_event_time(spark):
    df = spark.createDataFrame([("01/Jan/2024:00:00:01 +0200",), ("nonsense",)], "timestamp string")
    got = [r.event_ts for r in parse.with_event_ts(df).select(F.unix_timestamp("event_ts").alias("event_ts")).collect()]
    assert got == [1704060001, None]


def test_json_lines_as_a_lenient_reader_takes_them(spark):
    lines = [
        '{"request": "GET /old", "status": 1, "request": "GET /new?a=b", "status": 404}',
        '{"req": "GET /n", "agent": NaN, "referer": -Infinity, "size": NaN, "status": Infinity, "x": {"a": 1, "a": NaN}}',
        '{"request": "GET /x"} {"request": "GET /y"}', '{"request": "GET /x"}, "b": {}', '{"request": "GET /x"}],[{"z": 1}',
        '{"request": "GET /x",}', "{'request': 'GET /x'}", '{"status": 007}', '{"request": "GET /x"} // y}', "{}", "[{}]",
        '{"ip": null, "remote_addr": "r", "status": 12345678901234567890}',
    ]
    df = spark.createDataFrame(list(enumerate(lines)), "line_id int, value string")
    got = {r.line_id: r for r in parse.parse_json_lines(df).collect()}
    assert sorted(got) == [0, 1, 9, 11]
    assert (got[0].path, got[0].query, got[0].status) == ("/new", "a=b", 404)
    one = got[1]
    assert (one.path, one.user_agent, one.referer, one.response_size, one.status) == ("/n", "nan", "-inf", 0, 0)
    assert got[9].method == "" and got[9].status == 0
    assert (got[11].ip, got[11].status) == ("r", 0)
    assert {r.line_id for r in parse.parse_log_lines(df).collect()} == {0, 1, 9, 11}
    flavour = {r.line_id: (r.method, r.path) for r in parse.light_requests_json_or_quoted(df).collect()}
    assert flavour[0] == ("GET", "/new") and flavour[1] == ("GET", "/") and not {2, 3, 4, 5, 6, 7, 8} & set(flavour)
    hits = {r.line_id: r.json_hit for r in logs.format_hits(df).collect()}
    assert [i for i, hit in hits.items() if hit] == [0, 1, 11]


def test_client_of_a_line(spark):
    lines = ['10.0.0.1 - - [x] "GET /"', '{"ip": "", "remote_addr": "10.0.0.2"}', "{broken}", "  ", '{"ip": 7}']
    df = spark.createDataFrame(list(enumerate(lines)), "line_id int, value string")
    got = {r.line_id: r.client for r in parse.with_line_client(df).collect()}
    assert got == {0: "10.0.0.1", 1: "10.0.0.2", 2: None, 3: None, 4: "7"}


def light(spark, fn, lines):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(lines)], "i int, value string")
    return {
        r.i: (r.method, r.path, [(p.k, p.v) for p in r.query_params]) for r in fn(df).collect()
    }


def test_light_json_or_quoted(spark):
    got = light(
        spark,
        parse.light_requests_json_or_quoted,
        ['x "PUT /a?b=%41&b&c=1=2"', "no quotes", '{"request": "GET /j"}', '{"a": 1}', '{"request": null}', "{bad", '""'],
    )
    assert got == {
        0: ("PUT", "/a", [("b", ""), ("c", "1=2")]),
        1: ("GET", "/", []),
        2: ("GET", "/j", []),
        3: ("GET", "/", []),
        6: ("GET", "/", []),
    }


def test_light_quoted(spark):
    got = light(spark, parse.light_requests_quoted, ['h "GET /x?k=v" 200', 'open "GET /y', "none", '"" x'])
    assert got == {0: ("GET", "/x", [("k", "v")]), 1: ("GET", "/y", []), 3: ("GET", "/", [])}


def test_full_request(spark):
    df = spark.createDataFrame(
        [("get", "/a%20b", "id=123&token=abc", "UA", "ref", "200", "x", {"Cookie": "a=1; b ; c=x=y;a=2"}, "B=1")],
        "method string, path string, query string, user_agent string, referer string, status string, "
        "response_size string, headers map<string,string>, body string",
    )
    r = parse.parse_requests(df).first()
    assert (r.method, r.path, r.status, r.response_size) == ("GET", "/a b", 200, 0)
    assert [(p.k, p.v) for p in r.query_params] == [("id", "123"), ("token", "abc")]
    assert r.headers == {"Cookie": "a=1; b ; c=x=y;a=2", "User-Agent": "UA", "Referer": "ref"}
    assert r.cookies == {"a": "2", "c": "x=y"}


def test_header_block(spark):
    df = spark.createDataFrame([("Host: a\r\nX : 1\nnone\r\nX:2:3 Y: z",), ("",), (None,)], "raw_headers string")
    got = [r.headers for r in parse.with_header_map(df).collect()]
    assert got == [{"Host": "a", "X": "2:3", "Y": "z"}, {}, {}]


def test_compositions(spark):
    df = spark.createDataFrame(
        [("get", "/U//123", "B=1&a=10.0.0.1", "sid=x1"), ("GET", "/p", "", "")],
        "method string, path string, query string, body string",
    ).selectExpr("*", "'' user_agent", "'' referer", "0 status", "0 response_size")
    req = parse.parse_requests(df)
    assert [r.text for r in normalize.with_training_text(req).collect()] == [
        "GET /u/{USER_ID}?a={IP}&b=1 BODY:sid={SESSION}",
        "GET /p",
    ]
    assert [r.text for r in normalize.with_scoring_text(req).collect()] == [
        "GET /U//123?B=1&a=10.0.0.1 BODY:sid=x1",
        "GET /p?",
    ]


def test_parse_runs_the_regex_once(spark):
    """Later filters must not be pushed below the parse."""
    df = spark.createDataFrame([(COMBINED,)], "value string")
    plan = parse.parse_log_lines(df).where(F.col("status") == 200)._jdf.queryExecution().optimizedPlan().toString()
    below = plan[plan.index("Generate explode"):].split("\n", 1)[1]
    assert "regexp_replace" not in below
