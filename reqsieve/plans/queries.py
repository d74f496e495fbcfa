"""One query per operator over the given tables, each with its SQL twin.

Queries return scalar columns only: lists are joined to text, times written as text, and
floats rounded to six digits.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from reqsieve.functions.text import join_pairs
from reqsieve.operators import evaluate, history, normalize, parse, rate_audit, scoring, tokens
from reqsieve.plans import prepare, views
from reqsieve.plans import sql as q
from reqsieve.session import materialize, scratch_dir, stored
from reqsieve.sources import logs, model_store, sinks, vocab_io
from reqsieve.sources.record_store import RecordStore
from reqsieve.streaming import audit, jobs

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

VOCAB = 10_000
BIGRAM_VOCAB = 10_000
MAX_LENGTH = 512
THRESHOLD = 4.5
NOW = "2024-02-01T00:00:00Z"
SALT = "pepper"


def register(name: str, oracle: str | None = None) -> Callable[[Query], Query]:
    def add(fn: Query) -> Query:
        QUERIES[name] = fn
        if oracle is not None:
            ORACLES[name] = q.sql(oracle)
        return fn

    return add


# --- shared stages ---------------------------------------------------------------------


def parsed_from(raw: DataFrame) -> DataFrame:
    """Requests without headers: what their texts are made of."""
    return parse.with_text_fields(raw)


def parsed(spark: SparkSession, sf: str) -> DataFrame:
    return parsed_from(views.requests(spark, sf))


def texts_from(raw: DataFrame) -> DataFrame:
    return normalize.with_training_text(parsed_from(raw)).select("request_id", "text")


def texts(spark: SparkSession, sf: str) -> DataFrame:
    return texts_from(views.requests(spark, sf))


def texts_once(spark: SparkSession, sf: str) -> DataFrame:
    """The texts, composed once, for queries that read them more than once."""
    return stored(texts(spark, sf), "texts")


_STORES: dict[tuple[str, str], RecordStore] = {}


def detection_store(spark: SparkSession, sf: str) -> RecordStore:
    """The detections as a record store, written once per application and table folder."""
    key = (spark.sparkContext.applicationId, sf)
    if key not in _STORES:
        store = RecordStore(spark, scratch_dir(spark, "detections"), tie="id")
        store.append(views.detections(spark, sf))
        _STORES[key] = store
    return _STORES[key]


def utc_text(c: Column) -> Column:
    return ts_text(F.convert_timezone(F.current_timezone(), F.lit("UTC"), c.cast("timestamp_ntz")))


def ts_text(c: Column) -> Column:
    return F.date_format(c, "yyyy-MM-dd HH:mm:ss.SSSSSS")


def r6(c: Column | str) -> Column:
    return F.round(c, 6)


def ints(c: Column | str) -> Column:
    return F.array_join(F.col(c) if isinstance(c, str) else c, " ")


def log_files(spark: SparkSession, sf: str) -> str:
    """The log lines of the events table as text files in a fresh folder."""
    path = scratch_dir(spark, "log-lines")
    views.log_lines(spark, sf).select("value").write.text(path)
    return path


def run_now(query) -> None:
    query.awaitTermination()


q.model_views("m", "texts", ["texts"], "true", VOCAB)
q.score_views("s", "m", "texts", "request_id", ["texts"])
q.model_views("c", "texts", ["texts"], "true", VOCAB, MAX_LENGTH)
q.score_views("sc", "c", "texts", "request_id", ["texts"], max_length=MAX_LENGTH)
q.model_views("tr", "texts", ["texts"], "request_id % 10 < 8", VOCAB)
q.score_views("ho", "tr", "texts", "request_id", ["texts"], "request_id % 10 >= 8")
q.model_views("b", "texts", ["texts"], "true", BIGRAM_VOCAB)
q.model_views("ben", "labelled", ["labelled"], "label = 'benign'", VOCAB)
q.score_views("lab", "ben", "labelled", "id", ["labelled"])
q.model_views("ev", "texts", ["texts"], "request_id % 2 = 0", VOCAB)
q.score_views("old", "ev", "texts", "request_id", ["texts"])

_FLAG = f"anomaly_score > {THRESHOLD}"
_CONF = f"least(greatest((anomaly_score - {THRESHOLD}) / {THRESHOLD}, 0.0), 1.0)"
_LOG_COLS = "timestamp, ip, method, path, query, user_agent, status, response_size, referer, body"


# --- flagship --------------------------------------------------------------------------


@register(
    "top_anomalies",
    f"""
SELECT t.request_id, t.text, round(anomaly_score, 6) AS anomaly_score, {_FLAG} AS is_anomaly,
  round({_CONF}, 6) AS confidence
FROM s_scores JOIN texts t ON s_scores.request_id = t.request_id
ORDER BY round(anomaly_score, 9) DESC, t.request_id LIMIT 100""",
)
def top_anomalies(spark: SparkSession, sf: str) -> DataFrame:
    """Hundred least likely requests under a model of all requests.

    The top is taken from (id, score) rows; its hundred ids then pick the texts.
    """
    rows = texts_once(spark, sf)
    model = scoring.fit_unigram(rows, vocab_size=VOCAB)
    scores = scoring.score_requests(rows, model, "request_id", THRESHOLD)
    top = scores.orderBy(F.desc(F.round("anomaly_score", 9)), F.asc("request_id")).limit(100)
    top = materialize(top)
    return rows.join(F.broadcast(top), "request_id").select(
        "request_id", "text", r6("anomaly_score").alias("anomaly_score"), "is_anomaly",
        r6("confidence").alias("confidence"),
    )


# --- sources and sinks -----------------------------------------------------------------


@register("s1_scan_log_lines", "SELECT value FROM log_lines WHERE trim(value) <> ''")
def s1_scan_log_lines(spark, sf):
    return logs.read_log_lines(spark, log_files(spark, sf))


@register(
    "s2_log_format_profile",
    rf"""
SELECT event_type, j AS json_hits, c AS combined_hits,
  CASE WHEN j >= c THEN 'json' ELSE 'combined' END AS log_format
FROM (SELECT event_type, count(*) FILTER (is_json) AS j,
        count(*) FILTER (NOT is_json AND regexp_matches(line, '{q.COMBINED}')) AS c
      FROM (SELECT e.event_type, d.line, d.doc IS NOT NULL AND (json_exists(d.doc, '$.ip')
              OR json_exists(d.doc, '$.timestamp') OR json_exists(d.doc, '$.request')
              OR json_exists(d.doc, '$.status')) AS is_json
            FROM json_docs d JOIN events e ON d.line_id = e.event_id)
      GROUP BY event_type)""",
)
def s2_log_format_profile(spark, sf):
    events = views.table(spark, sf, "events")
    lines = views.log_lines_of(events, keep=["event_type"])
    return logs.log_format_profile(lines, by=["event_type"])


@register("s3_scan_structured", f"SELECT {_LOG_COLS} FROM log_rows")
def s3_scan_structured(spark, sf):
    path = scratch_dir(spark, "structured")
    sinks.write_jsonl(parse.parse_log_lines(views.log_lines(spark, sf)).drop("line_id"), path)
    return logs.read_structured_requests(spark, path)


@register(
    "s4_scan_labelled",
    """
SELECT label, request_text, method, path FROM (
  SELECT label, text AS request_text, NULL::VARCHAR AS method, NULL::VARCHAR AS path FROM labelled
  UNION ALL
  SELECT CASE WHEN request_id % 5 = 1 THEN 'attack' ELSE 'benign' END, NULL, method, path FROM parsed)""",
)
def s4_scan_labelled(spark, sf):
    plain, objects = scratch_dir(spark, "labelled-text"), scratch_dir(spark, "labelled-objects")
    sinks.write_jsonl(
        views.labelled(spark, sf).select(F.col("text").alias("request"), "label"), plain
    )
    rows = parsed(spark, sf).select(
        F.struct(
            "method", "path", F.map_from_entries("query_params").alias("query_params"),
            F.expr("cast(map() as map<string,string>)").alias("headers"), "body",
        ).alias("request"),
        F.when(F.col("request_id") % 5 == 1, "attack").otherwise("benign").alias("label"),
    )
    sinks.write_jsonl(rows, objects)
    return logs.read_labelled_requests(spark, plain, objects).select(
        "label", "request_text", "method", "path"
    )


@register(
    "s5_scan_payloads",
    """
SELECT trim(CASE WHEN doc_id % 3 = 0 THEN '# ' || source WHEN doc_id % 3 = 1 THEN '  ' || lang || ' ' ||
  source || ' ' ELSE '   ' END) AS payload FROM documents WHERE doc_id % 3 = 1""",
)
def s5_scan_payloads(spark, sf):
    path = scratch_dir(spark, "payloads")
    d = F.col("doc_id") % 3
    line = (
        F.when(d == 0, F.concat(F.lit("# "), "source"))
        .when(d == 1, F.concat(F.lit("  "), "lang", F.lit(" "), "source", F.lit(" ")))
        .otherwise("   ")
    )
    views.table(spark, sf, "documents").select(line.alias("value")).write.text(path)
    return logs.read_payloads(spark, path)


def _ids_sql(limit: bool = True) -> str:
    toks = f"tokens[1:{MAX_LENGTH - 2}]" if limit else "tokens"
    return f"""
(SELECT k.request_id, coalesce(list(coalesce(m.id, 1) ORDER BY k.pos), []) AS ids FROM
  (SELECT request_id, unnest({toks}) AS token, generate_subscripts({toks}, 1) AS pos FROM toks) k
  LEFT JOIN vocab m ON k.token = m.token GROUP BY k.request_id)"""


q.view("vocab", ["m_top"], """
SELECT token, id, n FROM (VALUES ('[PAD]', 0, 0), ('[UNK]', 1, 0), ('[CLS]', 2, 0), ('[SEP]', 3, 0)) t(token, id, n)
UNION ALL SELECT token, CAST(3 + row_number() OVER (ORDER BY n DESC, token) AS INTEGER), n FROM m_top""")
q.view("id_lists", ["toks", "vocab"], _ids_sql(False).strip()[1:-1])
q.view("short_ids", ["toks", "vocab"], _ids_sql(True).strip()[1:-1])
q.view("encoded", ["short_ids"], f"""
SELECT request_id, array_to_string([2] || ids || [3] || list_transform(range({MAX_LENGTH} - 2 - len(ids)), lambda x: 0), ' ') AS input_ids,
  array_to_string(list_transform(range(len(ids) + 2), lambda x: 1) || list_transform(range({MAX_LENGTH} - 2 - len(ids)), lambda x: 0), ' ') AS attention_mask
FROM short_ids""")


@register("s6_scan_encoded", "SELECT input_ids, attention_mask FROM encoded")
def s6_scan_encoded(spark, sf):
    path = scratch_dir(spark, "encoded")
    rows = texts_once(spark, sf)
    enc = tokens.encode(rows, tokens.build_vocab(rows, vocab_size=VOCAB), "request_id", max_length=MAX_LENGTH)
    enc.select("input_ids", "attention_mask").write.json(path)
    back = logs.read_encoded_samples(spark, path)
    return back.select(ints("input_ids").alias("input_ids"), ints("attention_mask").alias("attention_mask"))


@register("s7_sink_jsonl", f"SELECT {_LOG_COLS} FROM log_rows")
def s7_sink_jsonl(spark, sf):
    path = scratch_dir(spark, "rows") + ".jsonl"
    sinks.write_parsed(parse.parse_log_lines(views.log_lines(spark, sf)).drop("line_id"), path)
    return logs.read_structured_requests(spark, path)


@register("s8_sink_csv", f"SELECT {_LOG_COLS} FROM log_rows")
def s8_sink_csv(spark, sf):
    path = scratch_dir(spark, "rows") + ".csv"
    sinks.write_parsed(parse.parse_log_lines(views.log_lines(spark, sf)), path)
    return logs.read_log_csv(spark, path)


@register("s9_vocab_roundtrip", "SELECT token, id FROM vocab")
def s9_vocab_roundtrip(spark, sf):
    path = scratch_dir(spark, "vocab")
    vocab_io.save_vocab(tokens.build_vocab(texts(spark, sf), vocab_size=VOCAB), path, VOCAB)
    return vocab_io.load_vocab(spark, path)


@register(
    "s10_append_detection_log",
    f"""
SELECT CAST(p.request_id AS VARCHAR) AS request_id, method, path, {q.join_pairs('params')} AS query_params,
  CAST(0 AS INTEGER) AS n_headers, batch.b AS batch, CAST(1704067200 + p.request_id AS VARCHAR) || '.000000' AS ts,
  CASE WHEN batch.b THEN false ELSE {_FLAG} END AS is_anomaly,
  CASE WHEN batch.b THEN 0.0::DOUBLE ELSE round(anomaly_score, 6) END AS anomaly_score,
  CASE WHEN batch.b THEN 0.0::DOUBLE ELSE round({_CONF}, 6) END AS confidence
FROM parsed p JOIN s_scores s ON p.request_id = s.request_id, (VALUES (NULL::BOOLEAN), (true)) batch(b)""",
)
def s10_append_detection_log(spark, sf):
    """Requests scored one by one, and as a batch without a model."""
    path = scratch_dir(spark, "detection-log")
    rows = stored(normalize.with_training_text(parsed(spark, sf)), "request-rows")
    fields = rows.drop("text").withColumn("ts", F.timestamp_seconds(F.lit(1704067200) + F.col("request_id")))
    model = scoring.fit_unigram(rows, vocab_size=VOCAB)
    for scorer, batch in ((model, False), (None, True)):
        scores = scoring.score_requests(rows, scorer, "request_id", THRESHOLD)
        sinks.append_detection_log(sinks.log_records(fields.join(scores, "request_id")), path, batch=batch)
    back = spark.read.schema(sinks.DETECTION_LOG_SCHEMA + ", batch boolean").json(path)
    pairs = F.transform(F.map_entries("query_params"), lambda e: F.concat(e["key"], F.lit("="), e["value"]))
    return back.select(
        "request_id", "method", "path", F.array_join(pairs, "&").alias("query_params"), F.size("headers").alias("n_headers"),
        "batch", "ts", "is_anomaly", r6("anomaly_score").alias("anomaly_score"), r6("confidence").alias("confidence"),
    )


@register(
    "s11_append_records",
    """
SELECT strftime(ts, '%Y-%m-%d') AS dt, count(*) AS n, count(*) FILTER (is_anomaly) AS anomalies,
  round(sum(anomaly_score), 4) AS total FROM detections GROUP BY 1""",
)
def s11_append_records(spark, sf):
    return (
        detection_store(spark, sf).read()
        .groupBy(F.col("dt").cast("string").alias("dt"))
        .agg(
            F.count(F.lit(1)).alias("n"),
            F.count_if("is_anomaly").alias("anomalies"),
            F.round(F.sum("anomaly_score"), 4).alias("total"),
        )
    )


@register(
    "s12_evaluation_csv",
    """
SELECT CAST(id AS DOUBLE) AS ts, label, 'GET' AS method, '/search' AS path,
  '{"q":"' || CAST(id AS VARCHAR) || '"}' AS query, round(anomaly_score, 6) AS anomaly_score,
  anomaly_score > 6.0 AS is_anomaly
FROM lab_scores JOIN (SELECT id AS i, label FROM labelled) ON i = id""",
)
def s12_evaluation_csv(spark, sf):
    path = scratch_dir(spark, "evaluation")
    scored = _labelled_scores(spark, sf, 6.0)
    sinks.write_evaluation(
        scored.select(
            F.col("id").cast("double").alias("ts"), "label", F.lit("GET").alias("method"),
            F.lit("/search").alias("path"),
            F.to_json(F.struct(F.col("id").cast("string").alias("q"))).alias("query"),
            r6("anomaly_score").alias("anomaly_score"), "is_anomaly",
        ),
        path,
    )
    return logs.read_evaluation(spark, path)


@register("s13_tail_source", "SELECT value FROM log_lines WHERE trim(value) <> ''")
def s13_tail_source(spark, sf):
    out = scratch_dir(spark, "tailed")
    lines = jobs.tail_logs(spark, [log_files(spark, sf)])
    run_now(jobs.write_stream(lines.select("value"), out, out + "-progress", interval_seconds=None))
    return spark.read.schema("value string").parquet(out)


# --- parsing ---------------------------------------------------------------------------


@register("p1_json_lines", q.typed_rows("json_raw"))
def p1_json_lines(spark, sf):
    return parse.parse_json_lines(views.log_lines(spark, sf))


@register("p2_combined_lines", q.typed_rows("combined_raw"))
def p2_combined_lines(spark, sf):
    return parse.parse_combined_lines(views.log_lines(spark, sf))


@register("p3_log_lines", "SELECT * FROM log_rows")
def p3_log_lines(spark, sf):
    return parse.parse_log_lines(views.log_lines(spark, sf))


@register(
    "p4_request_line",
    f"""
SELECT e AS line_id, coalesce(w[1], '') AS method, coalesce(w[2], '') AS path, coalesce(w[3], '') AS protocol
FROM (SELECT e, {q.words('line')} AS w FROM line_parts)""",
)
def p4_request_line(spark, sf):
    lines = views.request_lines(spark, sf)
    return parse.with_request_line(lines).drop("request")


@register(
    "p5_split_query",
    """
SELECT page_id, split_part(rest, '?', 1) AS path,
  CASE WHEN contains(rest, '?') THEN substr(rest, instr(rest, '?') + 1) ELSE '' END AS query FROM requests_0""",
)
def p5_split_query(spark, sf):
    rest = F.regexp_extract("url", r"^https?://[^/?#]+([^#]*)", 1)
    pages = views.table(spark, sf, "pages").select("page_id", rest.alias("target"))
    return parse.with_split_query(pages).drop("target")


_INT_TEXT = {1: "'-'", 2: "' ' || CAST(event_id AS VARCHAR) || ' '", 3: "CAST(value AS VARCHAR)", 4: "'1_0' || CAST(event_id AS VARCHAR)", 5: "'+7'"}


@register(
    "p6_safe_int",
    f"""
SELECT event_id, CAST({q.safe_int('t')} AS BIGINT) AS number
FROM (SELECT event_id, {q.case('event_id', 6, _INT_TEXT, 'CAST(event_id AS VARCHAR)')} AS t FROM events)""",
)
def p6_safe_int(spark, sf):
    e = F.col("event_id").cast("string")
    k = F.col("event_id") % 6
    text = (
        F.when(k == 1, "-").when(k == 2, F.concat(F.lit(" "), e, F.lit(" ")))
        .when(k == 3, F.col("value").cast("string")).when(k == 4, F.concat(F.lit("1_0"), e))
        .when(k == 5, "+7").otherwise(e)
    )
    rows = views.table(spark, sf, "events").select("event_id", text.alias("t"))
    return parse.with_safe_int(rows, "t", "number").drop("t")


def _light_sql(source: str) -> str:
    target = "coalesce(w[2], '/')"
    return f"""
SELECT line_id, method, path, {q.join_pairs('lp')} AS params FROM
(SELECT line_id, method, path, {q.last_wins('e')} AS lp FROM
(SELECT line_id, coalesce(w[1], 'GET') AS method, split_part({target}, '?', 1) AS path,
  {q.pairs(f"CASE WHEN contains({target}, '?') THEN substr({target}, instr({target}, '?') + 1) ELSE '' END")} AS e
 FROM (SELECT line_id, {q.words('request')} AS w FROM ({source})) a) b) c"""


def _light(df: DataFrame) -> DataFrame:
    return df.select("line_id", "method", "path", join_pairs(F.col("query_params")).alias("params"))


@register(
    "p7_light_json_or_quoted",
    _light_sql(
        """
SELECT line_id, CASE WHEN doc IS NOT NULL THEN
    CASE WHEN json_type(doc, '$.request') IS NULL THEN 'GET /'
         WHEN json_type(doc, '$.request') = 'VARCHAR' THEN json_extract_string(doc, '$.request') END
  WHEN line LIKE '{%' THEN NULL
  WHEN regexp_matches(line, '"[^"]*"') THEN regexp_extract(line, '"([^"]*)"', 1) ELSE 'GET /' END AS request
FROM json_docs"""
    ).replace("FROM json_docs)", "FROM json_docs) WHERE request IS NOT NULL"),
)
def p7_light_json_or_quoted(spark, sf):
    return _light(parse.light_requests_json_or_quoted(views.log_lines(spark, sf)))


@register(
    "p8_light_quoted",
    _light_sql("SELECT line_id, split_part(value, '\"', 2) AS request FROM log_lines WHERE contains(value, '\"')"),
)
def p8_light_quoted(spark, sf):
    return _light(parse.light_requests_quoted(views.log_lines(spark, sf)))


@register(
    "p9_raw_pairs",
    f"""
SELECT request_id, {q.join_pairs('lp')} AS pairs FROM
(SELECT request_id, {q.last_wins('e')} AS lp FROM (SELECT request_id, {q.pairs('query')} AS e FROM requests) a) b""",
)
def p9_raw_pairs(spark, sf):
    rows = parse.with_raw_pairs(views.requests(spark, sf))
    return rows.select("request_id", join_pairs(F.col("pairs")).alias("pairs"))


@register(
    "p10_decode_url",
    f"SELECT request_id, {q.decode('path')} AS path, {q.decode('query')} AS query FROM requests",
)
def p10_decode_url(spark, sf):
    rows = views.requests(spark, sf).select("request_id", "path", "query")
    return parse.with_decoded(parse.with_decoded(rows, "path", "path"), "query", "query")


@register("p11_query_params", f"SELECT request_id, {q.join_pairs('params')} AS params FROM parsed")
def p11_query_params(spark, sf):
    rows = parse.with_query_params(views.requests(spark, sf))
    return rows.select("request_id", join_pairs(F.col("query_params")).alias("params"))


_EVENT_HEADERS = (
    "'Host: h' || CAST(user_id AS VARCHAR) || chr(13) || chr(10) || 'X-Kind : ' || event_type || chr(10) || "
    "'no colon here' || chr(10) || 'X-Kind: ' || event_type || ':' || CAST(event_id AS VARCHAR) || chr(13) || chr(10)"
)


def _event_headers() -> Column:
    s = lambda n: F.col(n).cast("string")
    return F.concat(
        F.lit("Host: h"), s("user_id"), F.lit("\r\nX-Kind : "), F.col("event_type"),
        F.lit("\nno colon here\nX-Kind: "), F.col("event_type"), F.lit(":"), s("event_id"), F.lit("\r\n"),
    )


@register(
    "p12_header_block",
    """
SELECT event_id, 'h' || CAST(user_id AS VARCHAR) AS host,
  event_type || ':' || CAST(event_id AS VARCHAR) AS kind, CAST(2 AS INTEGER) AS n FROM events""",
)
def p12_header_block(spark, sf):
    rows = views.table(spark, sf, "events").select("event_id", _event_headers().alias("raw_headers"))
    got = F.col("headers")
    return parse.with_header_map(rows).select(
        "event_id", got["Host"].alias("host"), got["X-Kind"].alias("kind"), F.size(got).alias("n")
    )


@register(
    "p13_merged_headers",
    """
SELECT event_id, CASE event_id % 4 WHEN 0 THEN event_type WHEN 1 THEN NULL
    ELSE 'ua' || CAST(user_id AS VARCHAR) END AS agent,
  CASE event_id % 4 WHEN 0 THEN NULL WHEN 1 THEN event_type END AS lower_agent,
  CASE WHEN event_id % 3 = 0 THEN NULL ELSE '/from/' || event_type END AS referer
FROM events""",
)
def p13_merged_headers(spark, sf):
    e = F.col("event_id")
    given = F.when(e % 4 == 0, F.create_map(F.lit("User-Agent"), F.col("event_type"))).when(
        e % 4 == 1, F.create_map(F.lit("user-agent"), F.col("event_type"))
    )
    rows = views.table(spark, sf, "events").select(
        "event_id", given.alias("headers"),
        F.concat(F.lit("ua"), F.col("user_id").cast("string")).alias("user_agent"),
        F.when(e % 3 == 0, "").otherwise(F.concat(F.lit("/from/"), "event_type")).alias("referer"),
    )
    h = lambda n: F.try_element_at("headers", F.lit(n))
    return parse.with_merged_headers(rows).select(
        "event_id", h("User-Agent").alias("agent"), h("user-agent").alias("lower_agent"),
        h("Referer").alias("referer"),
    )


@register(
    "p14_cookies",
    """
SELECT event_id, CASE WHEN event_id % 3 = 2 THEN NULL ELSE 'u' || CAST(user_id AS VARCHAR) END AS sid,
  CASE WHEN event_id % 3 = 2 THEN NULL ELSE event_type || '=x' END AS kind,
  CAST(CASE WHEN event_id % 3 = 2 THEN 0 ELSE 2 END AS INTEGER) AS n FROM events""",
)
def p14_cookies(spark, sf):
    e = F.col("event_id")
    jar = F.concat(
        F.lit("sid=old; flag;kind = "), F.col("event_type"), F.lit("=x ;  sid=u"), F.col("user_id").cast("string")
    )
    rows = views.table(spark, sf, "events").select(
        "event_id",
        F.when(e % 3 == 0, F.create_map(F.lit("Cookie"), jar))
        .when(e % 3 == 1, F.create_map(F.lit("Cookie"), F.lit(""), F.lit("cookie"), jar))
        .otherwise(F.create_map(F.lit("Accept"), jar)).alias("headers"),
    )
    c = lambda n: F.try_element_at("cookies", F.lit(n))
    return parse.with_cookies(rows).select(
        "event_id", c("sid").alias("sid"), c("kind").alias("kind"), F.size("cookies").alias("n")
    )


q.view("rows_once", ["log_rows"], f"SELECT *, {q.decode_pairs(q.pairs('query'))} AS e1 FROM log_rows")
q.view("rows_folded", ["rows_once"], f"SELECT *, {q.last_wins('e1')} AS e2 FROM rows_once")
q.view("rows_twice", ["rows_folded"], f"SELECT *, {q.decode_pairs('e2')} AS e3 FROM rows_folded")
q.view("rows_params", ["rows_twice"], f"SELECT *, {q.last_wins('e3')} AS ps FROM rows_twice")


@register(
    "p15_parse_requests",
    f"""
SELECT line_id, upper(method) AS method, {q.decode('path')} AS path, {q.join_pairs('ps')} AS params,
  nullif(user_agent, '') AS agent, nullif(referer, '') AS referer, body, status, response_size
FROM rows_params""",
)
def p15_parse_requests(spark, sf):
    rows = parse.parse_requests(parse.parse_log_lines(views.log_lines(spark, sf)))
    h = lambda n: F.try_element_at("headers", F.lit(n))
    return rows.select(
        "line_id", "method", "path", join_pairs(F.col("query_params")).alias("params"),
        h("User-Agent").alias("agent"), h("Referer").alias("referer"), "body", "status", "response_size",
    )


# --- normalising -----------------------------------------------------------------------


@register(
    "n1_canonical_escapes",
    f"SELECT request_id, {q.CANON.format(x='path')} AS path, {q.CANON.format(x='query')} AS query FROM requests",
)
def n1_canonical_escapes(spark, sf):
    rows = views.requests(spark, sf).select("request_id", "path", "query")
    rows = normalize.with_canonical_escapes(rows, "path", "path")
    return normalize.with_canonical_escapes(rows, "query", "query")


@register("n2_mask_path", f"SELECT request_id, {q.mask_path('path')} AS masked_path FROM parsed")
def n2_mask_path(spark, sf):
    return normalize.with_masked_path(parsed(spark, sf)).select("request_id", "masked_path")


@register("n3_normal_params", f"SELECT request_id, {q.join_pairs('np')} AS params FROM normal_params")
def n3_normal_params(spark, sf):
    rows = normalize.with_normal_params(parsed(spark, sf))
    return rows.select("request_id", join_pairs(F.col("normal_params")).alias("params"))


@register("n4_mask_values", f"SELECT doc_id, {q.mask_values('body')} AS masked FROM bodies")
def n4_mask_values(spark, sf):
    return normalize.with_masked_values(views.bodies(spark, sf), "body", "masked").drop("body")


@register("n5_training_text", "SELECT request_id, text FROM texts")
def n5_training_text(spark, sf):
    return texts(spark, sf)


@register("n6_scoring_text", "SELECT request_id, text FROM raw_texts")
def n6_scoring_text(spark, sf):
    return normalize.with_scoring_text(parsed(spark, sf)).select("request_id", "text")


# --- tokens ----------------------------------------------------------------------------


@register(
    "t1_tokenize",
    f"SELECT doc_id, array_to_string({q.tokens('body')}, '|') AS tokens FROM bodies",
)
def t1_tokenize(spark, sf):
    rows = tokens.with_tokens(views.bodies(spark, sf), "body")
    return rows.select("doc_id", F.array_join("tokens", "|").alias("tokens"))


@register("t2_vocabulary", "SELECT token, id, CAST(n AS BIGINT) AS n FROM vocab")
def t2_vocabulary(spark, sf):
    return tokens.build_vocab(texts(spark, sf), vocab_size=VOCAB)


@register("t3_token_ids", "SELECT request_id, array_to_string(ids, ' ') AS token_ids FROM id_lists")
def t3_token_ids(spark, sf):
    rows = texts_once(spark, sf)
    ids = tokens.tokenize(rows, tokens.build_vocab(rows, vocab_size=VOCAB), "request_id")
    return ids.select("request_id", ints("token_ids").alias("token_ids"))


def _encoded(spark: SparkSession, sf: str) -> DataFrame:
    rows = texts_once(spark, sf)
    vocab = tokens.build_vocab(rows, vocab_size=VOCAB)
    return tokens.encode(rows, vocab, "request_id", max_length=MAX_LENGTH)


@register("t4_encode", "SELECT request_id, input_ids FROM encoded")
def t4_encode(spark, sf):
    return _encoded(spark, sf).select("request_id", ints("input_ids").alias("input_ids"))


@register("t5_attention_mask", "SELECT request_id, attention_mask FROM encoded")
def t5_attention_mask(spark, sf):
    rows = texts(spark, sf).withColumn("token_ids", tokens.tokens_of(F.col("text")))
    # The mask depends on the number of tokens alone, so nothing is looked up or shuffled.
    return tokens.with_attention_mask(rows, MAX_LENGTH).select(
        "request_id", ints("attention_mask").alias("attention_mask")
    )


@register(
    "t6_decode",
    f"""
SELECT request_id, string_agg(CASE WHEN pos > 1 AND NOT mark AND NOT coalesce(lag_mark, true) THEN ' ' ELSE '' END || token, '' ORDER BY pos) AS text
FROM (SELECT *, lag(mark) OVER (PARTITION BY request_id ORDER BY pos) AS lag_mark FROM
  (SELECT i.request_id, i.pos, v.token, regexp_full_match(v.token, '[{q.MARKS}]') AS mark FROM
    (SELECT request_id, unnest(ids) AS id, generate_subscripts(ids, 1) AS pos FROM short_ids) i
    JOIN vocab v ON v.id = i.id) a) b GROUP BY request_id""",
)
def t6_decode(spark, sf):
    rows = texts_once(spark, sf)
    vocab = materialize(tokens.build_vocab(rows, vocab_size=VOCAB))
    return tokens.decode(tokens.encode(rows, vocab, "request_id", max_length=MAX_LENGTH), vocab, "request_id")


# --- scoring ---------------------------------------------------------------------------


@register(
    "m1_fit_unigram",
    "SELECT token, id, n, round(log_p, 6) AS log_p FROM m_model",
)
def m1_fit_unigram(spark, sf):
    model = scoring.fit_unigram(texts(spark, sf), vocab_size=VOCAB)
    return model.withColumn("log_p", r6("log_p"))


q.view("b_pos", ["texts", "b_model"], f"""
SELECT request_id, CASE WHEN pos = 1 THEN 2 ELSE coalesce(p.id, 1) END AS prev_id, coalesce(m.id, 1) AS id FROM
  (SELECT request_id, pos, s[pos] AS token, s[pos - 1] AS prev FROM
    (SELECT request_id, s, unnest(range(1, len(s) + 1)) AS pos FROM
      (SELECT request_id, list_append({q.tokens('text')}, '[SEP]') AS s FROM texts) x) y) z
  LEFT JOIN b_model m ON z.token = m.token LEFT JOIN b_model p ON z.prev = p.token""")
q.view("b_pairs", ["b_pos"], """
SELECT prev_id, id, count(*) AS n, count(*) / (sum(count(*)) OVER (PARTITION BY prev_id))::DOUBLE AS share
FROM b_pos GROUP BY prev_id, id""")


@register(
    "m1_fit_bigram",
    "SELECT prev_id, id, CAST(n AS BIGINT) AS n, round(share, 6) AS share FROM b_pairs",
)
def m1_fit_bigram(spark, sf):
    model = scoring.fit_bigram(texts_once(spark, sf), vocab_size=BIGRAM_VOCAB)
    return model.pairs.withColumn("share", r6("share"))


@register(
    "m2_score_unigram",
    "SELECT request_id, round(anomaly_score, 6) AS anomaly_score FROM s_scores",
)
def m2_score_unigram(spark, sf):
    rows = texts_once(spark, sf)
    scores = scoring.score_unigram(rows, scoring.fit_unigram(rows, vocab_size=VOCAB), "request_id")
    return scores.withColumn("anomaly_score", r6("anomaly_score"))


@register(
    "m2_score_bigram",
    """
SELECT request_id, round(avg(-ln(0.7 * coalesce(b.share, 0) + 0.3 * exp(m.log_p))), 6) AS anomaly_score
FROM b_pos p LEFT JOIN b_pairs b ON p.prev_id = b.prev_id AND p.id = b.id JOIN b_model m ON m.id = p.id
GROUP BY request_id""",
)
def m2_score_bigram(spark, sf):
    rows = texts_once(spark, sf)
    model = scoring.fit_bigram(rows, vocab_size=BIGRAM_VOCAB)
    return scoring.score_bigram(rows, model, "request_id").withColumn("anomaly_score", r6("anomaly_score"))


def _scores(spark: SparkSession, sf: str) -> DataFrame:
    rows = texts_once(spark, sf)
    return scoring.score_unigram(rows, scoring.fit_unigram(rows, vocab_size=VOCAB), "request_id")


@register("m3_flag", f"SELECT request_id, {_FLAG} AS is_anomaly FROM s_scores")
def m3_flag(spark, sf):
    return scoring.with_flag(_scores(spark, sf), THRESHOLD).select("request_id", "is_anomaly")


@register("m4_confidence", f"SELECT request_id, round({_CONF}, 6) AS confidence FROM s_scores")
def m4_confidence(spark, sf):
    rows = scoring.with_confidence(_scores(spark, sf), THRESHOLD)
    return rows.select("request_id", r6("confidence").alias("confidence"))


@register(
    "m5_no_model",
    """
SELECT request_id, CAST(0 AS DOUBLE) AS anomaly_score, false AS is_anomaly, CAST(0 AS DOUBLE) AS confidence
FROM requests""",
)
def m5_no_model(spark, sf):
    return scoring.score_requests(texts(spark, sf), None, "request_id", THRESHOLD)


@register(
    "m6_score_batch",
    f"""
SELECT request_id, round(anomaly_score, 6) AS anomaly_score, {_FLAG} AS is_anomaly,
  round({_CONF}, 6) AS confidence FROM s_scores""",
)
def m6_score_batch(spark, sf):
    rows = texts_once(spark, sf)
    model = scoring.fit_unigram(rows, vocab_size=VOCAB)
    scored = scoring.score_requests(rows, model, "request_id", THRESHOLD)
    return scored.withColumns(
        {"anomaly_score": r6("anomaly_score"), "confidence": r6("confidence")}
    )


@register(
    "m7_rethreshold",
    """
SELECT id, round(anomaly_score, 6) AS anomaly_score, anomaly_score > 250 AS is_anomaly,
  round(least(greatest((anomaly_score - 250) / 250, 0.0), 1.0), 6) AS confidence,
  250.0::DOUBLE AS threshold FROM detections""",
)
def m7_rethreshold(spark, sf):
    rows = scoring.rethreshold(views.detections(spark, sf), 250.0)
    return rows.select(
        "id", r6("anomaly_score").alias("anomaly_score"), "is_anomaly",
        r6("confidence").alias("confidence"), "threshold",
    )


@register(
    "m8_score_cut_to_length",
    "SELECT request_id, round(anomaly_score, 6) AS anomaly_score FROM sc_scores",
)
def m8_score_cut_to_length(spark, sf):
    length = scoring.effective_length(512, MAX_LENGTH)
    rows = texts_once(spark, sf)
    model = scoring.fit_unigram(rows, vocab_size=VOCAB, max_length=length)
    scores = scoring.score_unigram(rows, model, "request_id", max_length=length)
    return scores.withColumn("anomaly_score", r6("anomaly_score"))


@register(
    "m9_split",
    """
SELECT id, CASE WHEN id % 10 < 8 THEN 'train' ELSE 'validation' END AS part FROM labelled""",
)
def m9_split(spark, sf):
    rows = views.labelled(spark, sf).select("id")
    train, held = scoring.split_train_validation(rows, "id", bucket=F.pmod("id", F.lit(10)))
    return train.withColumn("part", F.lit("train")).unionByName(
        held.withColumn("part", F.lit("validation"))
    )


@register(
    "m10_held_out_loss",
    "SELECT round(avg(loss), 6) AS loss, count(*) AS positions FROM ho_losses",
)
def m10_held_out_loss(spark, sf):
    train, held = scoring.split_train_validation(
        texts_once(spark, sf), "request_id", bucket=F.pmod("request_id", F.lit(10))
    )
    model = scoring.fit_unigram(train, vocab_size=VOCAB)
    return scoring.held_out_loss(held, model).withColumn("loss", r6("loss"))


@register(
    "m11_merge_counts",
    f"""
SELECT token, id, CAST(sum(n) AS BIGINT) AS n FROM (
  SELECT token, id, n FROM tr_counts UNION ALL
  SELECT c.token, c.id, 1 FROM
    (SELECT unnest(list_append({q.tokens('text')}, '[SEP]')) AS token FROM texts WHERE request_id % 10 >= 8) d
    JOIN tr_counts k ON d.token = k.token JOIN tr_counts c ON c.token = k.token
  UNION ALL
  SELECT '[UNK]', 1, 1 FROM
    (SELECT unnest(list_append({q.tokens('text')}, '[SEP]')) AS token FROM texts WHERE request_id % 10 >= 8) d
    WHERE token NOT IN (SELECT token FROM tr_counts))
GROUP BY token, id""",
)
def m11_merge_counts(spark, sf):
    old, new = scoring.split_train_validation(
        texts_once(spark, sf), "request_id", bucket=F.pmod("request_id", F.lit(10))
    )
    counts = materialize(scoring.unigram_counts(old, vocab_size=VOCAB))
    return scoring.merge_counts(counts, new)


@register(
    "m12_versions",
    """
SELECT version, trained_on, version = (SELECT max(user_id) FROM events) AS is_current
FROM (SELECT user_id AS version, count(*) AS trained_on FROM events GROUP BY user_id)
ORDER BY version DESC LIMIT 5""",
)
def m12_versions(spark, sf):
    versions = (
        views.table(spark, sf, "events").groupBy(F.col("user_id").alias("version"))
        .agg(F.count(F.lit(1)).alias("trained_on"))
    )
    return scoring.newest_versions(versions, keep=5)


q.model_views("v1", "texts", ["texts"], "request_id % 10 < 4", VOCAB)
for _n, (_old, _slice) in enumerate([("v1", "request_id % 10 BETWEEN 4 AND 7"), ("v2", "request_id % 10 > 7")], 2):
    q.view(f"v{_n}_new", ["texts"], f"SELECT unnest(list_append({q.tokens('text')}, '[SEP]')) AS token FROM texts WHERE {_slice}")
    q.view(f"v{_n}_counts", [f"{_old}_counts", f"v{_n}_new"], f"""
SELECT token, id, CAST(sum(n) AS BIGINT) AS n FROM (
  SELECT token, id, n FROM {_old}_counts UNION ALL
  SELECT coalesce(k.token, '[UNK]'), coalesce(k.id, 1), 1 FROM v{_n}_new d LEFT JOIN {_old}_counts k ON d.token = k.token)
GROUP BY token, id""")
q.view("v3_model", ["v3_counts"], """
SELECT token, id, n, ln((n + 1.0::DOUBLE) / (sum(n) OVER () + 1.0::DOUBLE * count(*) OVER ())) AS log_p FROM v3_counts""")
q.score_views("v3s", "v3", "texts", "request_id", ["texts"])


@register(
    "m12_model_store",
    """
SELECT request_id, round(anomaly_score, 6) AS anomaly_score, 3 AS model_version, '2 3' AS kept_versions,
  (SELECT count(*) FROM texts) AS trained_on FROM v3s_scores""",
)
def m12_model_store(spark, sf):
    """Fit on a slice, retrain on two more, keep two versions, score with the newest."""
    path = scratch_dir(spark, "models")
    rows = texts_once(spark, sf)
    part = F.pmod("request_id", F.lit(10))
    first = rows.where(part < 4)
    model_store.save_model(scoring.fit_unigram(first, vocab_size=VOCAB), path, first.count())
    for delta in (rows.where(part.between(4, 7)), rows.where(part > 7)):
        model_store.retrain(spark, path, delta, keep=2)
    kept = model_store.versions(spark, path)
    numbers = F.array_join(F.array_sort(F.collect_list(F.col("version").cast("string"))), " ")
    told = kept.agg(numbers.alias("kept_versions"), F.max("version").cast("int").alias("model_version"),
                    F.max_by("trained_on", "version").alias("trained_on"))
    scores = scoring.score_unigram(rows, model_store.load_model(spark, path), "request_id")
    return scores.withColumn("anomaly_score", r6("anomaly_score")).crossJoin(F.broadcast(told))


def _load_mark_share():
    return lambda texts: texts.str.count(r"[^A-Za-z0-9]") / texts.str.len().clip(lower=1)


@register(
    "m13_custom_scorer",
    """
SELECT request_id, round(len(regexp_extract_all(text, '[^A-Za-z0-9]')) / greatest(length(text), 1)::DOUBLE, 6) AS anomaly_score
FROM texts""",
)
def m13_custom_scorer(spark, sf):
    scores = scoring.score_with(texts(spark, sf), _load_mark_share, "request_id")
    return scores.withColumn("anomaly_score", r6("anomaly_score"))


# --- history ---------------------------------------------------------------------------


def _old_records(spark: SparkSession, sf: str) -> DataFrame:
    """Records of all requests, scored by a model of the even ones."""
    rows = stored(normalize.with_training_text(parsed(spark, sf)), "request-rows")
    even = rows.where(F.col("request_id") % 2 == 0)
    model = scoring.fit_unigram(even, vocab_size=VOCAB)
    scores = scoring.score_requests(rows.select("request_id", "text"), model, "request_id", THRESHOLD)
    fields = rows.drop("text").withColumns(
        {
            "ts": F.timestamp_seconds(F.lit(1704067200) + F.col("request_id") * 60),
            "client": F.concat(F.lit("c"), F.col("request_id").cast("string")),
        }
    )
    return history.build_records(
        fields.join(scores, "request_id"), 1, THRESHOLD, SALT, notes=history.BATCH_NOTE
    )


@register(
    "d1_build_records",
    f"""
SELECT CAST(p.request_id AS VARCHAR) AS request_id, CAST(1704067200 + p.request_id * 60 AS DOUBLE) AS timestamp,
  method, path, round(anomaly_score, 6) AS anomaly_score, {_FLAG} AS is_anomaly, CAST(1 AS INTEGER) AS model_version,
  CAST({THRESHOLD} AS DOUBLE) AS threshold, sha256('{SALT}c' || CAST(p.request_id AS VARCHAR)) AS client_ip_hash,
  'batch_request' AS notes,
  strftime(make_timestamp((1704067200 + p.request_id * 60) * 1000000), '%Y-%m-%d %H:%M:%S.%f') AS ts,
  strftime(make_timestamp((1704067200 + p.request_id * 60) * 1000000), '%Y-%m-%d %H:%M:%S') AS created_at,
  '{{"method":' || CAST(to_json(method) AS VARCHAR) || ',"path":' || CAST(to_json(path) AS VARCHAR) || ',"query_params":{{'
  || coalesce(array_to_string(list_transform(params, lambda x: CAST(to_json(x.k) AS VARCHAR) || ':' || CAST(to_json(x.v) AS VARCHAR)), ','), '')
  || '}},"headers":{{}},"body":' || CAST(to_json(body) AS VARCHAR) || '}}' AS normalized_request
FROM parsed p JOIN old_scores o ON p.request_id = o.request_id""",
)
def d1_build_records(spark, sf):
    return _old_records(spark, sf).withColumns(
        {"anomaly_score": r6("anomaly_score"), "ts": utc_text(F.col("ts"))}
    )


@register(
    "d2_filter_history",
    f"""
SELECT id, {q.text_ts('ts')} AS ts, path, round(anomaly_score, 6) AS anomaly_score FROM detections
WHERE ts >= TIMESTAMP '2024-01-05 00:00:00' AND ts <= TIMESTAMP '2024-01-25 12:00:00'
  AND is_anomaly AND anomaly_score >= 120 AND anomaly_score <= 400 AND contains(path, 'i')""",
)
def d2_filter_history(spark, sf):
    rows = history.filter_history(
        detection_store(spark, sf).read(), "2024-01-05T00:00:00Z", 1706184000, True, 120, 400, "i"
    )
    return rows.select("id", ts_text(F.col("ts")).alias("ts"), "path", r6("anomaly_score").alias("anomaly_score"))


@register(
    "d3_time_bounds",
    """
SELECT event_id, CASE event_id % 5 WHEN 4 THEN NULL
  WHEN 3 THEN CAST(epoch_us(date_trunc('day', ts)) AS DOUBLE) / 1000000.0
  WHEN 2 THEN CAST(CAST(epoch_us(ts) // 1000000 AS VARCHAR) AS DOUBLE)
  ELSE CAST(epoch_us(date_trunc('second', ts)) AS DOUBLE) / 1000000.0 END AS epoch FROM events""",
)
def d3_time_bounds(spark, sf):
    k = F.col("event_id") % 5
    iso = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss")
    events = views.table(spark, sf, "events")
    text = (
        F.when(k == 0, F.concat(iso, F.lit("Z"))).when(k == 1, F.replace(iso, F.lit("T"), F.lit(" ")))
        .when(k == 2, F.floor(history.micros_of(events) / 1_000_000).cast("string"))
        .when(k == 3, F.date_format("ts", "yyyy-MM-dd")).otherwise("not a time")
    )
    return events.select("event_id", history.time_text_to_epoch(text).alias("epoch"))


@register(
    "d4_recent_page",
    f"""
SELECT id, {q.text_ts('ts')} AS ts FROM detections ORDER BY detections.ts DESC, id DESC LIMIT 100 OFFSET 50""",
)
def d4_recent_page(spark, sf):
    rows = detection_store(spark, sf).page(100, 50)
    return rows.select("id", ts_text(F.col("ts")).alias("ts"))


@register(
    "d5_lookup",
    """
SELECT id, request_id, path FROM detections
WHERE request_id IN (SELECT 'r-' || CAST(doc_id AS VARCHAR) FROM labels)""",
)
def d5_lookup(spark, sf):
    ids = views.table(spark, sf, "labels").select(
        F.concat(F.lit("r-"), F.col("doc_id").cast("string")).alias("request_id")
    )
    return history.lookup_all(views.detections(spark, sf), ids).select("id", "request_id", "path")


@register(
    "d6_replay",
    f"""
SELECT CAST(o.request_id AS VARCHAR) AS request_id, round(o.anomaly_score, 6) AS old_score,
  o.anomaly_score > {THRESHOLD} AS old_flag, round(n.anomaly_score, 6) AS new_score,
  n.anomaly_score > {THRESHOLD} AS new_flag
FROM old_scores o JOIN s_scores n ON o.request_id = n.request_id""",
)
def d6_replay(spark, sf):
    records = stored(_old_records(spark, sf), "records")
    model = scoring.fit_unigram(texts(spark, sf), vocab_size=VOCAB)
    again = history.replay(records, model, 2, THRESHOLD, NOW)
    return history.compare_replay(records, again).select(
        "request_id", r6("old_score").alias("old_score"), "old_flag", r6("new_score").alias("new_score"), "new_flag"
    )


@register(
    "d6_replay_store",
    f"""
SELECT CAST(request_id AS VARCHAR) AS request_id, round(anomaly_score, 6) AS anomaly_score,
  {_FLAG} AS is_anomaly, CAST(1 AS INTEGER) AS model_version, 'batch_request' AS notes FROM old_scores
UNION ALL
SELECT 'replay-' || CAST(request_id AS VARCHAR) || '-' || substr(sha256(CAST(request_id AS VARCHAR) || '|2|2024-02-01T00:00:00+00:00'), 1, 8),
  round(anomaly_score, 6), {_FLAG}, 2, 'replay_of_' || CAST(request_id AS VARCHAR) FROM s_scores""",
)
def d6_replay_store(spark, sf):
    """Replayed records are added to the store, once though the replay runs twice."""
    store = RecordStore(spark, scratch_dir(spark, "records"))
    store.append(_old_records(spark, sf))
    model = scoring.fit_unigram(texts(spark, sf), vocab_size=VOCAB)
    again = stored(history.replay(store.read(), model, 2, THRESHOLD, NOW), "replayed")
    for _ in range(2):
        store.merge(again)
    return store.read().select(
        "request_id", r6("anomaly_score").alias("anomaly_score"), "is_anomaly", "model_version", "notes"
    )


@register(
    "d7_stats",
    f"""
SELECT count(*) AS total_requests, count(*) FILTER (is_anomaly) AS total_anomalies,
  round(avg(anomaly_score), 6) AS avg_score,
  round(100.0 * count(*) FILTER (is_anomaly) / count(*), 6) AS detection_rate,
  {q.text_ts('min(ts)')} AS first_detection, {q.text_ts('max(ts)')} AS last_detection FROM detections""",
)
def d7_stats(spark, sf):
    return history.stats(views.detections(spark, sf)).select(
        "total_requests", "total_anomalies", r6("avg_score").alias("avg_score"),
        r6("detection_rate").alias("detection_rate"),
        ts_text(F.col("first_detection")).alias("first_detection"),
        ts_text(F.col("last_detection")).alias("last_detection"),
    )


@register(
    "d8_retention",
    """
SELECT count(*) FILTER (ts < TIMESTAMP '2024-01-18 00:00:00') AS deleted_records,
  count(*) FILTER (ts >= TIMESTAMP '2024-01-18 00:00:00') AS kept_records FROM detections""",
)
def d8_retention(spark, sf):
    return history.retention_counts(views.detections(spark, sf), NOW, 14)


@register(
    "d8_cleanup",
    f"""
SELECT id, {q.text_ts('ts')} AS ts, round(anomaly_score, 6) AS anomaly_score,
  (SELECT count(*) FROM detections WHERE ts < TIMESTAMP '2024-01-18 07:30:00') AS deleted
FROM detections WHERE ts >= TIMESTAMP '2024-01-18 07:30:00'""",
)
def d8_cleanup(spark, sf):
    """What stays of a store of its own after the records older than 14 days are removed."""
    store = RecordStore(spark, scratch_dir(spark, "detections"), tie="id")
    rows = views.detections(spark, sf)
    store.append(rows.where(F.col("id") % 2 == 0))
    store.append(rows.where(F.col("id") % 2 == 1))
    store.compact(grace_seconds=0)
    deleted = store.cleanup("2024-02-01T07:30:00Z", 14, grace_seconds=0)
    return store.read().select(
        "id", ts_text(F.col("ts")).alias("ts"), r6("anomaly_score").alias("anomaly_score"),
        F.lit(deleted).cast("bigint").alias("deleted"),
    )


@register(
    "d9_counters",
    "SELECT count(*) AS requests, count(*) FILTER (is_anomaly) AS anomalies FROM detections",
)
def d9_counters(spark, sf):
    return history.counters(views.detections(spark, sf))


# Requests of a client in order, each carrying the log of accepted times before it.
_AUDIT_SQL = """
WITH RECURSIVE numbered AS (
  SELECT event_id AS id, CAST(user_id AS VARCHAR) AS client, epoch_us(ts) AS us,
    row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM events),
walk AS (
  SELECT id, client, k, true AS accepted, [us] AS held FROM numbered WHERE k = 1
  UNION ALL
  SELECT id, client, k, len(live) < 3, CASE WHEN len(live) < 3 THEN list_append(live, us) ELSE live END
  FROM (SELECT n.id, n.client, n.k, n.us, list_filter(w.held, lambda t: t >= n.us - 86400000000) AS live
        FROM walk w JOIN numbered n ON n.client = w.client AND n.k = w.k + 1))
SELECT id, client, accepted FROM walk"""


@register("d10_rate_audit", _AUDIT_SQL)
def d10_rate_audit(spark, sf):
    rows = views.detections(spark, sf).select("id", "client", "ts")
    audited = rate_audit.audit(rows, limit=3, window_seconds=86_400)
    return audited.select("id", "client", "accepted")


@register(
    "d10_rate_bound",
    """
SELECT id, client, CAST(count(*) OVER (PARTITION BY client ORDER BY epoch_us(ts)
  RANGE BETWEEN 86400000000 PRECEDING AND CURRENT ROW) AS BIGINT) AS in_window FROM detections""",
)
def d10_rate_bound(spark, sf):
    rows = views.detections(spark, sf).select("id", "client", "ts")
    return rate_audit.with_window_count(rows, 86_400).select("id", "client", "in_window")


@register(
    "d11_client_hash",
    f"SELECT id, sha256('{SALT}' || client) AS client_ip_hash FROM detections",
)
def d11_client_hash(spark, sf):
    rows = history.with_client_hash(views.detections(spark, sf), SALT)
    return rows.select("id", "client_ip_hash")


@register(
    "d12_history_page",
    f"""
SELECT id, {q.text_ts('ts')} AS ts, method, path, round(anomaly_score, 3) AS score,
  CASE WHEN anomaly_score >= 150 THEN 'high' WHEN anomaly_score >= 50 THEN 'medium' ELSE 'low' END AS band,
  substr(sha256('{SALT}' || client), 1, 8) AS client_prefix, count(*) OVER () = 50 AS has_more
FROM (SELECT * FROM detections ORDER BY ts DESC, id DESC LIMIT 50 OFFSET 50)""",
)
def d12_history_page(spark, sf):
    rows = history.with_client_hash(detection_store(spark, sf).page(50, 50), SALT)
    shown = history.shown_page(rows, 50, high=150, medium=50)
    return shown.withColumn("ts", ts_text(F.col("ts")))


# --- evaluation ------------------------------------------------------------------------


def _labelled_scores(spark: SparkSession, sf: str, threshold: float) -> DataFrame:
    # Joined once: fitted on, scored, and read for the labels.
    rows = stored(views.labelled(spark, sf), "labelled")
    model = scoring.fit_unigram(rows.where(F.col("label") == evaluate.BENIGN), vocab_size=VOCAB)
    scored = scoring.score_requests(rows, model, "id", threshold)
    return rows.select("id", "label").join(scored, "id")


@register(
    "e1_error_rates",
    """
SELECT count(*) FILTER (label = 'benign') AS benign_total,
  count(*) FILTER (label = 'benign' AND anomaly_score > 6.0) AS false_positives,
  count(*) FILTER (label = 'attack') AS attack_total,
  count(*) FILTER (label = 'attack' AND NOT anomaly_score > 6.0) AS false_negatives,
  round(count(*) FILTER (label = 'benign' AND anomaly_score > 6.0) / nullif(count(*) FILTER (label = 'benign'), 0)::DOUBLE, 6) AS fpr,
  round(count(*) FILTER (label = 'attack' AND NOT anomaly_score > 6.0) / nullif(count(*) FILTER (label = 'attack'), 0)::DOUBLE, 6) AS fnr
FROM lab_scores JOIN (SELECT id AS i, label FROM labelled) ON i = id""",
)
def e1_error_rates(spark, sf):
    rates = evaluate.error_rates(_labelled_scores(spark, sf, 6.0))
    return rates.withColumns({"fpr": r6("fpr"), "fnr": r6("fnr")})


@register(
    "e2_case_totals",
    """
SELECT count(*) AS total, count(*) FILTER ((label = 'attack') = (anomaly_score > 6.0)) AS passed,
  count(*) FILTER ((label = 'attack') <> (anomaly_score > 6.0)) AS failed
FROM lab_scores JOIN (SELECT id AS i, label FROM labelled) ON i = id""",
)
def e2_case_totals(spark, sf):
    scored = _labelled_scores(spark, sf, 6.0)
    cases = scored.select(
        "id", F.concat(F.lit("case "), F.col("id").cast("string")).alias("name"),
        (F.col("label") == evaluate.ATTACK).alias("expected"),
    )
    return evaluate.case_totals(evaluate.case_results(cases, scored.drop("label"), "id"))


_TERMS = ["alpha", "beta", "gamma"]


@register(
    "e3_evaluation_set",
    f"""
SELECT i AS iteration, 'benign' AS label, method, path,
  CASE WHEN path = '/search' THEN ['alpha', 'beta', 'gamma'][i % 3 + 1] END AS q
FROM (SELECT CASE WHEN request_id % 4 = 1 THEN '/search' ELSE path END AS path, method FROM parsed), (SELECT unnest(range(4)) AS i)
UNION ALL
SELECT i, 'attack', 'GET', '/search', text FROM labelled, (SELECT unnest(range(4)) AS i) WHERE label = 'attack'""",
)
def e3_evaluation_set(spark, sf):
    path = F.when(F.col("request_id") % 4 == 1, "/search").otherwise(F.col("path"))
    routes = parsed(spark, sf).select(
        "method", path.alias("path"), F.expr("cast(map() as map<string,string>)").alias("params")
    )
    attacks = views.labelled(spark, sf).where(F.col("label") == evaluate.ATTACK).select(
        F.col("id").alias("position"), F.col("text").alias("payload")
    )
    rows = evaluate.evaluation_set(routes, attacks, _TERMS, iterations=4, payload_limit=None)
    return rows.select(
        F.col("iteration").cast("bigint").alias("iteration"), "label", "method", "path",
        F.try_element_at("params", F.lit("q")).alias("q"),
    )


# --- streaming -------------------------------------------------------------------------


def event_stream(spark: SparkSession, sf: str) -> DataFrame:
    schema = views.table(spark, sf, "events").schema
    return spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf)


def collected(spark: SparkSession, stream: DataFrame, purpose: str) -> DataFrame:
    """Run a stream over what is there and read its output back."""
    out = scratch_dir(spark, purpose)
    run_now(jobs.write_stream(stream, out, out + "-progress", interval_seconds=None))
    return spark.read.schema(stream.schema).parquet(out)


@register("w1_follow_files", "SELECT value FROM log_lines WHERE trim(value) <> ''")
def w1_follow_files(spark, sf):
    return collected(spark, jobs.follow_files(spark, log_files(spark, sf)), "followed")


def _rotate(spark: SparkSession, folder: str) -> None:
    """Rename every log file of a folder the way log rotation does, where files have inodes."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    at = jvm.org.apache.hadoop.fs.Path(folder)
    fs = at.getFileSystem(conf)
    for status in fs.listStatus(at) if fs.getScheme() == "file" else []:
        name = status.getPath().getName()
        if not name.startswith((".", "_")):
            fs.rename(status.getPath(), jvm.org.apache.hadoop.fs.Path(at, name + ".1"))


@register("w2_rotated_logs", "SELECT value FROM log_lines WHERE trim(value) <> ''")
def w2_rotated_logs(spark, sf):
    """Tail, rotate every file, tail again: nothing is lost and nothing comes twice."""
    folder, out = log_files(spark, sf), scratch_dir(spark, "rotated")
    for _ in range(2):
        lines = jobs.tail_logs(spark, [folder], positions=out + "-positions").select("value")
        run_now(jobs.write_stream(lines, out, out + "-progress", interval_seconds=None))
        _rotate(spark, folder)
    return spark.read.schema("value string").parquet(out)


@register("w3_parse_batches", "SELECT * FROM log_rows")
def w3_parse_batches(spark, sf):
    out = scratch_dir(spark, "parsed-batches")

    def keep(batch: DataFrame, batch_id: int) -> None:
        parse.parse_log_lines(batch).write.mode("overwrite").parquet(f"{out}/batch_id={batch_id}")

    lines = views.log_lines_of(event_stream(spark, sf))
    run_now(jobs.for_each_batch(lines, keep, out + "-progress", interval_seconds=None))
    return spark.read.parquet(out).drop("batch_id")


q.view("light_lines", ["json_docs"], """
SELECT line_id FROM json_docs WHERE CASE WHEN doc IS NOT NULL THEN json_type(doc, '$.request') IS NULL
  OR json_type(doc, '$.request') = 'VARCHAR' ELSE line NOT LIKE '{%' END""")


_LIGHT = _light_sql("""
SELECT line_id, CASE WHEN doc IS NOT NULL THEN
    CASE WHEN json_type(doc, '$.request') IS NULL THEN 'GET /'
         WHEN json_type(doc, '$.request') = 'VARCHAR' THEN json_extract_string(doc, '$.request') END
  WHEN line LIKE '{%' THEN NULL
  WHEN regexp_matches(line, '"[^"]*"') THEN regexp_extract(line, '"([^"]*)"', 1) ELSE 'GET /' END AS request
FROM json_docs""").replace("FROM json_docs)", "FROM json_docs) WHERE request IS NOT NULL")
q.view("light", ["json_docs"], _LIGHT.replace(f"{q.join_pairs('lp')} AS params", "lp"))


def _masked_sql(params: str) -> str:
    lowered = f"list_sort(list_transform({params}, lambda x, i: {{'k': lower(x.k), 'pos': i, 'v': x.v}}))"
    return f"list_transform({lowered}, lambda x: {{'k': x.k, 'v': {q.mask_values('x.v')}}})"


q.view("light_sorted", ["light"], f"SELECT *, {_masked_sql('lp')} AS sp FROM light")
q.view("light_params", ["light_sorted"], f"SELECT *, {q.last_wins('sp')} AS np FROM light_sorted")
q.view("light_texts", ["light_params"], f"""
SELECT line_id, method || ' ' || {q.mask_path('path')}
  || CASE WHEN len(lp) > 0 THEN '?' || {q.join_pairs('np')} ELSE '' END AS text FROM light_params""")
q.model_views("li", "light_texts", ["light_texts"], "true", VOCAB)
q.score_views("ls", "li", "light_texts", "line_id", ["light_texts"])
q.view("line_clients", ["stripped", "json_raw"], f"""
SELECT s.line_id, CASE WHEN line LIKE '{{%' THEN nullif(j.ip, '') ELSE {q.words('line')}[1] END AS client
FROM stripped s LEFT JOIN json_raw j ON s.line_id = j.line_id""")


@register(
    "w4_detect_stream",
    f"""
SELECT 'b0-' || CAST(l.line_id AS VARCHAR) AS request_id, method, path, round(anomaly_score, 6) AS anomaly_score,
  anomaly_score > 5.0 AS is_anomaly, round(least(greatest((anomaly_score - 5.0) / 5.0, 0.0), 1.0), 6) AS confidence,
  sha256('{SALT}' || client) AS client_ip_hash, CAST(1 AS INTEGER) AS model_version
FROM light l JOIN ls_scores s ON l.line_id = s.line_id JOIN line_clients c ON c.line_id = l.line_id""",
)
def w4_detect_stream(spark, sf):
    """Lines to records and log; the batch comes twice, as after a crash, and adds nothing."""
    out = scratch_dir(spark, "detected")
    store, models = RecordStore(spark, out + "/store"), out + "/models"
    static = parse.light_requests_json_or_quoted(jobs.spread(views.log_lines(spark, sf)))
    model_store.save_model(scoring.fit_unigram(normalize.with_training_text(static), vocab_size=VOCAB), models)
    for attempt in ("first", "second"):
        lines = views.log_lines_of(event_stream(spark, sf))
        run_now(jobs.detect_stream(
            lines, models, 5.0, store, f"{out}/progress-{attempt}", log=out + "/log", salt=SALT, interval_seconds=None
        ))
    logged = spark.read.schema(sinks.DETECTION_LOG_SCHEMA).json(out + "/log").select("request_id", "confidence")
    return store.read().join(logged, "request_id").select(
        "request_id", "method", "path", r6("anomaly_score").alias("anomaly_score"), "is_anomaly",
        r6("confidence").alias("confidence"), "client_ip_hash", "model_version",
    )


q.view("log_sorted", ["rows_params"], f"SELECT *, {_masked_sql('ps')} AS sp FROM rows_params")
q.view("log_params", ["log_sorted"], f"SELECT *, {q.last_wins('sp')} AS np FROM log_sorted")
q.view("log_texts", ["log_params"], f"""
SELECT line_id, upper(method) || ' ' || {q.mask_path(q.decode('path'))}
  || CASE WHEN len(ps) > 0 THEN '?' || {q.join_pairs('np')} ELSE '' END
  || CASE WHEN body <> '' THEN ' BODY:' || {q.mask_values('body')} ELSE '' END AS text FROM log_params""")
q.model_views("lg", "log_texts", ["log_texts"], "true", VOCAB)
q.view("log_found", ["log_texts", "lg_top"], f"""
SELECT t.line_id, list(coalesce(m.id, 1) ORDER BY t.pos) AS ids FROM
  (SELECT line_id, unnest(toks) AS token, generate_subscripts(toks, 1) AS pos FROM
    (SELECT line_id, ({q.tokens('text')})[1:62] AS toks FROM log_texts) a) t
  LEFT JOIN (SELECT token, CAST(3 + row_number() OVER (ORDER BY n DESC, token) AS INTEGER) AS id FROM lg_top) m ON t.token = m.token
GROUP BY t.line_id""")
q.view("log_ids", ["log_texts", "log_found"], """
SELECT t.line_id, coalesce(f.ids, []) AS ids FROM log_texts t LEFT JOIN log_found f ON t.line_id = f.line_id""")


@register(
    "a1_prepare_samples",
    """
SELECT part, array_to_string([2] || ids || [3] || list_transform(range(62 - len(ids)), lambda x: 0), ' ') AS input_ids,
  array_to_string(list_transform(range(len(ids) + 2), lambda x: 1) || list_transform(range(62 - len(ids)), lambda x: 0), ' ') AS attention_mask
FROM log_ids, (VALUES ('all'), ('delta')) p(part) WHERE part = 'all' OR line_id % 3 = 0""",
)
def a1_prepare_samples(spark, sf):
    """Logs to encoded samples; every third line once more, as new traffic in the same vocabulary."""
    out, new = scratch_dir(spark, "samples"), scratch_dir(spark, "new-lines")
    prepare.prepare_samples(spark, log_files(spark, sf), f"{out}/all", VOCAB, 64)
    views.log_lines(spark, sf).where("line_id % 3 = 0").select("value").write.text(new)
    prepare.prepare_delta(spark, new, f"{out}/all/vocab", f"{out}/delta", 64)
    back = [
        logs.read_encoded_samples(spark, f"{out}/{part}/samples").select(
            F.lit(part).alias("part"), ints("input_ids").alias("input_ids"), ints("attention_mask").alias("attention_mask")
        )
        for part in ("all", "delta")
    ]
    return back[0].unionByName(back[1])


@register(
    "d9_windowed_counters",
    f"""
SELECT {q.text_ts("date_trunc('hour', ts)")} AS window_start, count(*) AS requests,
  count(*) FILTER (value > 100) AS anomalies FROM events
GROUP BY 1 HAVING date_trunc('hour', min(ts)) + INTERVAL 1 HOUR
  <= (SELECT max(date_trunc('millisecond', ts)) FROM events) - INTERVAL 10 MINUTE""",
)
def d9_windowed_counters(spark, sf):
    stream = event_stream(spark, sf).select(
        F.convert_timezone(F.lit("UTC"), F.current_timezone(), "ts").cast("timestamp").alias("ts"),
        (F.col("value") > 100).alias("is_anomaly"),
    )
    counted = history.windowed_counters(stream, "ts", "1 hour", "10 minutes")
    out = collected(spark, counted, "windowed")
    local = F.convert_timezone(F.current_timezone(), F.lit("UTC"), F.col("window_start").cast("timestamp_ntz"))
    return out.withColumn("window_start", ts_text(local))


@register("w5_timed_batches", "SELECT * FROM log_rows")
def w5_timed_batches(spark, sf):
    """Batches on a timer, here of one second; stopped once all input is through."""
    out = scratch_dir(spark, "timed")
    rows = parse.parse_log_lines(views.log_lines_of(event_stream(spark, sf)))
    query = jobs.write_stream(rows, out, out + "-progress", interval_seconds=1)
    query.processAllAvailable()
    query.stop()
    return spark.read.schema(rows.schema).parquet(out)


@register("d10_rate_audit_stream", _AUDIT_SQL)
def d10_rate_audit_stream(spark, sf):
    """What the stream gave out, and what it still holds behind the watermark."""
    out = scratch_dir(spark, "audited")
    stream = event_stream(spark, sf).select(
        F.col("event_id").alias("id"), F.col("user_id").cast("string").alias("client"),
        F.convert_timezone(F.lit("UTC"), F.current_timezone(), "ts").cast("timestamp").alias("ts"),
    )
    run_now(audit.audit_stream(
        stream, out, out + "-progress", limit=3, window_seconds=86_400, lateness_seconds=3_600, interval_seconds=None
    ))
    given = audit.audited(spark, out, stream)
    held = audit.held(spark, out, stream, limit=3, window_seconds=86_400)
    return given.unionByName(held).select("id", "client", "accepted")
