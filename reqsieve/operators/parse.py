"""Log lines to typed request rows. Narrow: works on batch tables and on streams."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reqsieve.functions.text import (
    NOT_WS,
    WS,
    after_first,
    before_first,
    decode_pairs,
    decode_url,
    last_wins,
    let,
    safe_int,
    split_pairs,
    strip,
    text_or_empty,
    ws_split,
)

# Field names of the parsed row, in output order.
LOG_FIELDS = [
    "timestamp",
    "ip",
    "method",
    "path",
    "query",
    "user_agent",
    "status",
    "response_size",
    "referer",
    "body",
]

LOG_SCHEMA = (
    "timestamp string, ip string, method string, path string, query string, "
    "user_agent string, status bigint, response_size bigint, referer string, body string"
)

# JSON field aliases, first truthy one wins.
JSON_ALIASES = {
    "request": ["request", "req"],
    "timestamp": ["timestamp", "time"],
    "ip": ["ip", "remote_addr"],
    "user_agent": ["user_agent", "agent"],
    "status": ["status"],
    "response_size": ["body_bytes_sent", "size"],
    "referer": ["referer", "http_referer"],
    "body": ["request_body", "body"],
}

# Fixed value: combined log format with an optional trailing quoted body.
COMBINED = (
    rf"(?U)^({NOT_WS}+){WS}+{NOT_WS}+{WS}+{NOT_WS}+{WS}+\[([^\]]+)\]{WS}+"
    rf'"([^"]*)"{WS}+(\d{{3}}){WS}+({NOT_WS}+){WS}+"([^"]*)"{WS}+"([^"]*)"(?:{WS}+"([^"]*)")?{WS}*\z'
)

_FIELD_MARK = "\x1e"


# --- request line ----------------------------------------------------------------------


def request_line_parts(line: Column) -> Column:
    """Method, path and protocol of a request line, "" for what is missing."""
    words = ws_split(text_or_empty(line))
    part = lambda i, name: F.coalesce(F.get(words, F.lit(i)), F.lit("")).alias(name)
    return F.struct(part(0, "method"), part(1, "path"), part(2, "protocol"))


def with_request_line(df: DataFrame, line: str = "request") -> DataFrame:
    return df.withColumn("_rl", request_line_parts(F.col(line))).select("*", "_rl.*").drop("_rl")


def with_split_query(df: DataFrame, target: str = "target") -> DataFrame:
    """Path and query, split at the first question mark."""
    c = text_or_empty(F.col(target))
    return df.withColumns({"path": before_first(c, "?"), "query": after_first(c, "?")})


def with_safe_int(df: DataFrame, source: str, out: str) -> DataFrame:
    return df.withColumn(out, safe_int(text_or_empty(F.col(source))))


# --- combined lines --------------------------------------------------------------------


def _combined_groups(line: Column) -> Column:
    """The eight groups of a combined line behind a mark: nine items, or fewer when the
    line does not match.

    One regex pass writes the groups out with a mark between them and a split takes them
    apart. A line that holds the mark itself takes eight extracts instead.
    """
    marked = F.regexp_replace(
        line, COMBINED, _FIELD_MARK.join(["!"] + [f"${i}" for i in range(1, 9)])
    )
    slow = F.array(F.lit("!"), *[F.regexp_extract(line, COMBINED, i) for i in range(1, 9)])
    return F.when(F.instr(line, _FIELD_MARK) == 0, F.split(marked, _FIELD_MARK)).when(
        line.rlike(COMBINED), slow
    )


# --- JSON lines ------------------------------------------------------------------------


def _truthy(kind: Column, text: Column) -> Column:
    """Whether a JSON value counts as set: null, "", 0, false, [] and {} do not."""
    return (
        F.when(kind == "VOID", False)
        .when(kind == "STRING", text != "")
        .when(kind == "BOOLEAN", text == "true")
        .when(kind.startswith("ARRAY"), text != "[]")
        .when(kind.startswith("OBJECT"), text != "{}")
        .otherwise(text.try_cast("double") != 0)
    )


_JSON_NAMES = [n for names in JSON_ALIASES.values() for n in names]
# Strict but for NaN and infinities, which the format of the logs allows.
_JSON_OPTIONS = {"allowSingleQuotes": "false"}
_NOT_FINITE = {"NaN": "nan", "Infinity": "inf", "-Infinity": "-inf"}


def _looks_like_object(line: Column) -> Column:
    return line.startswith("{") & line.endswith("}")


def json_object(line: Column) -> Column:
    """The known fields of a JSON line as variants, null where the line is no JSON object.

    Of a repeated key the last value counts, and NaN and infinities are numbers. A field that
    is there but null is a variant null, one that is missing is null. The reader stops at the
    end of the first value, so the line is also read inside an object, with a mark behind it,
    and inside an array: only a single whole value fits both.
    """
    fields = ", ".join(f"{n}: variant" for n in _JSON_NAMES)
    inside = F.from_json(
        F.concat(F.lit('{"line":'), line, F.lit(',"mark":1}')), f"line struct<{fields}>, mark int", _JSON_OPTIONS
    )
    alone = F.size(F.from_json(F.concat(F.lit("["), line, F.lit("]")), "array<struct<mark:int>>", _JSON_OPTIONS)) == 1
    return F.when(
        _looks_like_object(line), let(inside, lambda x: F.when((x["mark"] == 1) & alone, x["line"]))
    )


def _json_texts(doc: Column) -> Column:
    """Known fields of a JSON object as a struct of texts, null for values that count as unset.

    A request that is no string and a number field that is no whole number or string
    count as set but empty. Booleans are capitalised, nested values stay JSON; a nested value
    with a repeated key of its own counts as unset.
    """
    texts_only = JSON_ALIASES["request"]
    ints_only = JSON_ALIASES["status"] + JSON_ALIASES["response_size"]

    def convert(name: str, kind: Column, text: Column) -> Column:
        out = F.when(~_truthy(kind, text), F.lit(None))
        if name in texts_only:
            out = out.when(kind != "STRING", "")
        if name in ints_only:
            out = out.when(~kind.isin("BIGINT", "STRING"), "")
        for written, shown in _NOT_FINITE.items():
            out = out.when((kind == "DOUBLE") & (text == written), shown)
        return out.when(kind == "BOOLEAN", F.initcap(text)).otherwise(text)

    def one(name: str) -> Column:
        value = doc[name]
        parts = F.struct(
            F.schema_of_variant(value).alias("kind"), F.try_variant_get(value, "$", "string").alias("text")
        )
        text = let(parts, lambda p: convert(name, p["kind"], p["text"]))
        return F.when(value.isNotNull(), text).alias(name)

    return F.when(doc.isNotNull(), F.struct(*[one(n) for n in _JSON_NAMES]))


# Positions of the fields among the groups of a combined line.
_GROUP = {
    "ip": 1,
    "timestamp": 2,
    "request": 3,
    "status": 4,
    "response_size": 5,
    "referer": 6,
    "user_agent": 7,
    "body": 8,
}


def _typed(df: DataFrame, raw: Callable[[str], Column]) -> DataFrame:
    """Raw text fields to the ten typed log fields."""
    df = df.withColumn("_words", ws_split(raw("request")))
    word = lambda i: F.coalesce(F.get(F.col("_words"), F.lit(i)), F.lit(""))
    computed = {
        "method": word(0),
        "path": before_first(word(1), "?"),
        "query": after_first(word(1), "?"),
        "status": safe_int(raw("status")),
        "response_size": safe_int(raw("response_size")),
    }
    keep = [c for c in df.columns if not c.startswith("_")]
    return df.select(*keep, *[computed.get(f, raw(f) if f in _GROUP else None).alias(f) for f in LOG_FIELDS])


def _from_json(name: str) -> Column:
    return F.coalesce(*[F.col("_json")[n] for n in JSON_ALIASES[name]], F.lit(""))


def _from_groups(name: str) -> Column:
    # A size of "-" needs no case of its own: it is no number and becomes 0.
    return F.get(F.col("_groups"), F.lit(_GROUP[name]))


def _barrier(c: Column, name: str) -> Column:
    """The column as the only row of an explode: filters on it stay above, where they
    would otherwise be pushed below the parse and run it a second time."""
    return F.explode(F.array(c)).alias(name)


def _lines(df: DataFrame, value: str) -> DataFrame:
    return df.withColumn("_line", strip(F.col(value))).drop(value)


def _json_of(line: Column) -> Column:
    return let(json_object(line), _json_texts)


def parse_json_lines(df: DataFrame, value: str = "value") -> DataFrame:
    """JSON log lines to rows; other lines are dropped. ``value`` is consumed.

    Repeated keys and NaN are read as :func:`json_object` says.
    """
    staged = _lines(df, value).select("*", _barrier(_json_of(F.col("_line")), "_json"))
    return _typed(staged.where(F.col("_json").isNotNull()), _from_json)


def parse_combined_lines(df: DataFrame, value: str = "value") -> DataFrame:
    """Combined log lines to rows; other lines are dropped. ``value`` is consumed."""
    staged = _lines(df, value).select("*", _barrier(_combined_groups(F.col("_line")), "_groups"))
    return _typed(staged.where(F.size("_groups") == 9), _from_groups)


def parse_log_lines(df: DataFrame, value: str = "value") -> DataFrame:
    """Mixed log lines to rows: JSON objects first, then combined; the rest is dropped."""
    is_json = F.col("_json").isNotNull()
    groups = F.when(~is_json, _combined_groups(F.col("_line")))
    staged = (
        _lines(df, value)
        .withColumn("_json", _json_of(F.col("_line")))
        .select("*", _barrier(groups, "_groups"))
        .where(is_json | (F.size("_groups") == 9))
    )
    return _typed(staged, lambda f: F.when(is_json, _from_json(f)).otherwise(_from_groups(f)))


def with_event_ts(df: DataFrame, timestamp: str = "timestamp") -> DataFrame:
    """Typed event time next to the unparsed one, null where it does not parse."""
    return df.withColumn(
        "event_ts", F.try_to_timestamp(F.col(timestamp), F.lit("dd/MMM/yyyy:HH:mm:ss Z"))
    )


# --- light extraction for the tailing jobs ---------------------------------------------


def _light_request(df: DataFrame, request: Column, value: str) -> DataFrame:
    keep = [c for c in df.columns if c != value and not c.startswith("_")]
    found = df.select(*keep, _barrier(request, "_request")).where(F.col("_request").isNotNull())
    found = found.withColumn("_words", ws_split(F.col("_request")))
    target = F.coalesce(F.get(F.col("_words"), F.lit(1)), F.lit("/"))
    return found.select(
        *keep,
        F.coalesce(F.get(F.col("_words"), F.lit(0)), F.lit("GET")).alias("method"),
        before_first(target, "?").alias("path"),
        last_wins(split_pairs(after_first(target, "?"))).alias("query_params"),
        F.lit("").alias("body"),
    )


def light_requests_json_or_quoted(df: DataFrame, value: str = "value") -> DataFrame:
    """Request between the first two quotes, or the ``request`` of a JSON line.

    Lines without a quoted part count as ``GET /``. Broken JSON and a JSON request that
    is not text are dropped.
    """
    line = F.col(value)
    is_json = strip(line).startswith("{")
    staged = df.withColumn("_fields", F.when(is_json, json_object(strip(line))))

    def from_field(v: Column) -> Column:
        return F.when(v.isNull(), "GET /").when(
            F.schema_of_variant(v) == "STRING", F.try_variant_get(v, "$", "string")
        )

    fields = F.col("_fields")
    request = (
        F.when(fields.isNotNull(), let(fields["request"], from_field))
        .when(is_json, F.lit(None))
        .when(line.rlike('"[^"]*"'), F.regexp_extract(line, '"([^"]*)"', 1))
        .otherwise("GET /")
    )
    return _light_request(staged, request, value)


def with_line_client(df: DataFrame, value: str = "value", out: str = "client") -> DataFrame:
    """The address a log line begins with, or ``ip`` or ``remote_addr`` of a JSON line; null without one."""
    line = strip(F.col(value))
    texts = let(json_object(line), _json_texts)
    told = let(texts, lambda t: F.coalesce(*[t[n] for n in JSON_ALIASES["ip"]]))
    first = F.nullif(F.get(ws_split(line), F.lit(0)), F.lit(""))
    return df.withColumn(out, F.when(line.startswith("{"), told).otherwise(first))


def light_requests_quoted(df: DataFrame, value: str = "value") -> DataFrame:
    """Request after the first quote; lines without a quote are dropped."""
    return _light_request(df, F.get(F.split(F.col(value), '"'), F.lit(1)), value)


def with_raw_pairs(df: DataFrame, query: str = "query", out: str = "pairs") -> DataFrame:
    """Query pairs without decoding, last value wins."""
    return df.withColumn(out, last_wins(split_pairs(F.col(query))))


# --- full request ----------------------------------------------------------------------


def with_decoded(df: DataFrame, source: str, out: str) -> DataFrame:
    return df.withColumn(out, decode_url(F.col(source)))


def query_params(query: Column) -> Column:
    """Parameters decoded twice, last value wins after each pass."""
    once = last_wins(decode_pairs(split_pairs(query)))
    return last_wins(decode_pairs(once))


def with_query_params(df: DataFrame, query: str = "query", out: str = "query_params") -> DataFrame:
    return df.withColumn(out, query_params(F.col(query)))


_LINE_BREAK = r"\r\n|[\n\x0b\f\r\x1c-\x1e\x{85}\x{2028}\x{2029}]"


def _trimmed_pairs(parts: Column, sep: str) -> Column:
    kept = F.filter(parts, lambda p: F.instr(p, sep) > 0)
    return last_wins(
        F.transform(
            kept,
            lambda p: F.struct(
                strip(before_first(p, sep)).alias("k"), strip(after_first(p, sep)).alias("v")
            ),
        )
    )


def with_header_map(df: DataFrame, raw: str = "raw_headers", out: str = "headers") -> DataFrame:
    """Raw ``Key: Value`` block to a map, last value wins."""
    lines = F.split(text_or_empty(F.col(raw)), _LINE_BREAK)
    return df.withColumn(out, F.map_from_entries(_trimmed_pairs(lines, ":")))


def merged_headers(headers: Column | None, user_agent: Column, referer: Column) -> Column:
    """Given headers, plus agent and referer when neither spelling is present."""
    empty = F.expr("cast(map() as map<string,string>)")
    base = empty if headers is None else F.coalesce(headers, empty)

    def extra(value: Column, name: str) -> Column:
        absent = ~F.map_contains_key(base, name) & ~F.map_contains_key(base, name.lower())
        return F.when((text_or_empty(value) != "") & absent, F.create_map(F.lit(name), value)).otherwise(
            empty
        )

    return F.map_concat(base, extra(user_agent, "User-Agent"), extra(referer, "Referer"))


def with_merged_headers(df: DataFrame, out: str = "headers") -> DataFrame:
    given = F.col("headers") if "headers" in df.columns else None
    return df.withColumn(out, merged_headers(given, F.col("user_agent"), F.col("referer")))


def cookies(headers: Column) -> Column:
    """Cookie header to (k, v) pairs; pairs without ``=`` are skipped, last value wins."""
    named = lambda n: F.nullif(F.try_element_at(headers, F.lit(n)), F.lit(""))
    header = F.coalesce(named("Cookie"), named("cookie"), F.lit(""))
    return _trimmed_pairs(F.split(header, rf"(?U);{WS}*"), "=")


def with_cookies(df: DataFrame, headers: str = "headers", out: str = "cookies") -> DataFrame:
    return df.withColumn(out, F.map_from_entries(cookies(F.col(headers))))


def with_text_fields(df: DataFrame) -> DataFrame:
    """The fields a request's text is made of: method, path, query_params and body."""
    return df.withColumns(
        {
            "method": F.upper(text_or_empty(F.col("method"))),
            "path": decode_url(F.col("path")),
            "query_params": query_params(F.col("query")),
            "body": text_or_empty(F.col("body")),
        }
    )


def parse_requests(df: DataFrame) -> DataFrame:
    """Parsed log rows to full requests.

    Reads method, path, query, user_agent, referer, body, status, response_size and,
    where there, a ``headers`` map. A status that is no number becomes 0.
    """
    kinds = dict(df.dtypes)

    def number(name: str) -> Column:
        if kinds[name] == "string":
            return safe_int(text_or_empty(F.col(name)))
        return F.coalesce(F.col(name).cast("bigint"), F.lit(0)).cast("bigint")

    out = with_merged_headers(with_text_fields(df)).withColumns(
        {"status": number("status"), "response_size": number("response_size")}
    )
    return with_cookies(out)
