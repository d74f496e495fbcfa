"""The same views and operators as ANSI-style SQL, for checking results with DuckDB.

Each query is a WITH list of the views it needs and one SELECT.
"""

from __future__ import annotations

import re

CANON = "replace(replace(replace(replace({x}, '%2F', '/'), '%2f', '/'), '%2E', '.'), '%2e', '.')"
IPV4 = r"\b(?:(?:25[0-5]|2[0-4]\d|[01]?\d\d?)\.){3}(?:25[0-5]|2[0-4]\d|[01]?\d\d?)\b"
UUID = r"\b[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}\b"
HEX = r"\b[0-9a-fA-F]{16,}\b"
STAMP = r"\b20\d{2}-\d{2}-\d{2}[T\s]\d{2}:\d{2}:\d{2}(?:Z|[+-]\d{2}:?\d{2})?\b"
SESSION = r"(?i)\b(session|token|auth|sid|sessionid|jwt)=([A-Za-z0-9._-]+)"
MARKS = r"""/?=&:#.;,\[\]{}()<>\-_''"|`~!@^*+\\"""
BLANK = r"[\s\x0b\x1c-\x1f\x{85}\p{Z}]*"


def sub(x: str, pattern: str, to: str) -> str:
    return f"regexp_replace({x}, '{pattern}', '{to}', 'g')"


def decode(x: str) -> str:
    return f"url_decode(replace({x}, '+', ' '))"


def pairs(q: str) -> str:
    return (
        f"list_transform(list_filter(string_split({q}, '&'), lambda p: p <> ''), lambda p: "
        "{'k': split_part(p, '=', 1), "
        "'v': CASE WHEN contains(p, '=') THEN substr(p, instr(p, '=') + 1) ELSE '' END})"
    )


def decode_pairs(e: str) -> str:
    return f"list_transform({e}, lambda x: {{'k': {decode('x.k')}, 'v': {decode('x.v')}}})"


def last_wins(e: str) -> str:
    """``e`` must be a column name."""
    keys = f"list_transform({e}, lambda y: y.k)"
    return (
        f"list_transform(list_filter({e}, lambda x, i: list_position({keys}, x.k) = i), lambda x: "
        f"{{'k': x.k, 'v': {e}[len({e}) - list_position(list_reverse({keys}), x.k) + 1].v}})"
    )


def join_pairs(e: str) -> str:
    return f"coalesce(array_to_string(list_transform({e}, lambda x: x.k || '=' || x.v), '&'), '')"


def mask_path(x: str) -> str:
    p = sub(f"lower({CANON.format(x=x)})", "/+", "/")
    seg = (
        f"array_to_string(list_transform(string_split({p}, '/'), lambda s, i: CASE WHEN i > 1 AND "
        r"regexp_full_match(s, '\d{3,}') THEN '{USER_ID}' ELSE s END), '/')"
    )
    return sub(sub(sub(seg, IPV4, "{IP}"), UUID, "{UUID}"), HEX, "{HASH}")


def mask_values(x: str) -> str:
    v = sub(sub(CANON.format(x=x), STAMP, "{TIMESTAMP}"), IPV4, "{IP}")
    v = sub(v, SESSION, r"\1={SESSION}")
    return sub(sub(v, UUID, "{UUID}"), HEX, "{HASH}")


def tokens(x: str) -> str:
    return (
        f"list_filter(regexp_extract_all({x}, '[{MARKS}]|[^{MARKS}]+'), "
        f"lambda t: NOT regexp_full_match(t, '{BLANK}'))"
    )


def safe_int(x: str) -> str:
    return (
        f"CASE WHEN regexp_full_match({x}, '\\s*[+-]?[0-9](_?[0-9])*\\s*') "
        f"THEN coalesce(TRY_CAST(regexp_replace({x}, '[^0-9+-]', '', 'g') AS BIGINT), 0) ELSE 0 END"
    )


def words(x: str) -> str:
    return f"list_filter(regexp_split_to_array({x}, '\\s+'), lambda w: w <> '')"


def text_ts(x: str) -> str:
    return f"strftime({x}, '%Y-%m-%d %H:%M:%S.%f')"


def case(col: str, mod: int, cases: dict[int, str], default: str) -> str:
    whens = " ".join(f"WHEN {k} THEN {v}" for k, v in cases.items())
    return f"CASE {col} % {mod} {whens} ELSE {default} END"


# --- views -----------------------------------------------------------------------------

VIEWS: dict[str, tuple[list[str], str]] = {}


def view(name: str, needs: list[str], body: str) -> None:
    VIEWS[name] = (needs, body)


view(
    "requests_0",
    [],
    r"""
SELECT page_id, html, CAST(page_id AS VARCHAR) AS n,
       regexp_extract(url, '^https?://[^/?#]+([^#]*)', 1) AS rest FROM pages""",
)
view(
    "requests",
    ["requests_0"],
    f"""
SELECT page_id AS request_id, CASE WHEN page_id % 4 = 3 THEN 'post' ELSE 'GET' END AS method,
  {case('page_id', 7, {
      1: "split_part(rest, '?', 1) || '//%2e%2E/%2Fetc'",
      2: "'/10.0.7.' || CAST(page_id % 300 AS VARCHAR) || split_part(rest, '?', 1)",
      3: "'/A+b%20C' || split_part(rest, '?', 1)",
      4: "split_part(rest, '?', 1) || '/0000' || n || '/x'",
      5: "'/0123456789abcdef' || n || split_part(rest, '?', 1)",
  }, "split_part(rest, '?', 1)")} AS path,
  concat_ws('&',
    nullif(CASE WHEN contains(rest, '?') THEN substr(rest, instr(rest, '?') + 1) ELSE '' END, ''),
    nullif({case('page_id', 8, {
      1: "'a=1&a=' || n || '&b'",
      2: "'q=%2527+OR+' || n || '&Q=x'",
      3: "'=x&&a==b&n=' || n",
      4: "'a%2520=1&a%20=' || n || '&a%2520=3'",
      5: "'x=1;y=2&z=%zz%41&w=100%&B=' || n",
      6: "'u=%C3%A9&at=2024-01-0' || CAST(page_id % 9 AS VARCHAR) || 'T10:00:00Z'",
      7: "'ip=192.168.1.' || n || '&h=deadbeefdeadbeef' || n",
    }, "''")}, '')) AS query,
  coalesce(html, '') || {case('page_id', 5, {1: "'user=u' || n || '&session=ab.c-' || n"}, "''")} AS body
FROM requests_0""",
)
view("decoded_once", ["requests"], f"SELECT *, {decode_pairs(pairs('query'))} AS e1 FROM requests")
view("folded_once", ["decoded_once"], f"SELECT *, {last_wins('e1')} AS e2 FROM decoded_once")
view("decoded_twice", ["folded_once"], f"SELECT *, {decode_pairs('e2')} AS e3 FROM folded_once")
view(
    "parsed",
    ["decoded_twice"],
    f"""
SELECT request_id, upper(method) AS method, {decode('path')} AS path, {last_wins('e3')} AS params, body
FROM decoded_twice""",
)
view(
    "sorted_params",
    ["parsed"],
    f"""
SELECT *, list_transform(list_sort(list_transform(params, lambda x, i:
    {{'k': lower(x.k), 'pos': i, 'v': x.v}})), lambda x: {{'k': x.k, 'v': {mask_values('x.v')}}}) AS sp
FROM parsed""",
)
view("normal_params", ["sorted_params"], f"SELECT *, {last_wins('sp')} AS np FROM sorted_params")
view(
    "texts",
    ["normal_params"],
    f"""
SELECT request_id, method || ' ' || {mask_path('path')}
  || CASE WHEN len(params) > 0 THEN '?' || {join_pairs('np')} ELSE '' END
  || CASE WHEN body <> '' THEN ' BODY:' || {mask_values('body')} ELSE '' END AS text
FROM normal_params""",
)
view(
    "raw_texts",
    ["parsed"],
    f"""
SELECT request_id, method || ' ' || path || '?' || {join_pairs('list_sort(params)')}
  || CASE WHEN body <> '' THEN ' BODY:' || body ELSE '' END AS text
FROM parsed""",
)
view("toks", ["texts"], f"SELECT request_id, {tokens('text')} AS tokens FROM texts")

_ip = "'10.0.' || CAST(user_id // 256 AS VARCHAR) || '.' || CAST(user_id % 256 AS VARCHAR)"
_size = "CAST(CAST(floor(value * 100) AS BIGINT) AS VARCHAR)"
view(
    "line_parts",
    [],
    f"""
SELECT event_id AS e, {_ip} AS ip, {_size} AS size,
  strftime(ts, '%d/%b/%Y:%H:%M:%S') || ' +0000' AS stamp,
  {case('event_id', 19, {3: "''", 5: "'POST  /' || event_type"},
        "'GET /' || event_type || '/' || CAST(event_id AS VARCHAR) || '?k=' || CAST(event_id % 97 AS VARCHAR)"
        " || '&u=' || CAST(user_id AS VARCHAR) || ' HTTP/1.1'")} AS line
FROM events""",
)
view(
    "log_lines",
    ["line_parts"],
    f"""
SELECT e AS line_id, CASE WHEN e % 17 = 16 THEN
  {case('e', 3, {0: "'{\"ip\": oops}'", 1: "ip || ' GET /nothing ' || CAST(e AS VARCHAR)"},
        "ip || ' - - [' || stamp || '] \"' || line || '\" 200 5'")}
WHEN e % 10 = 0 THEN
  '{{"' || {case('e', 20, {0: "'timestamp'"}, "'time'")} || '": "' || stamp || '", "ip": '
  || {case('e', 30, {0: "'\"\"'", 10: "'null'"}, "'\"' || ip || '\"'")}
  || ', "remote_addr": "172.16.0.1", "request": '
  || {case('e', 70, {0: "'7'", 10: "'[]'", 20: "'null'"}, "'\"' || line || '\"'")}
  || ', "req": "HEAD /fallback?x=1", "status": '
  || {case('e', 50, {0: "'0'", 10: "'\"0\"'", 20: "'\" 2_04 \"'"}, "'201'")}
  || ', "size": ' || {case('e', 40, {0: "'true'", 10: "'12.5'", 20: "'\"12.5\"'"}, "size")}
  || ', "agent": ' || {case('e', 90, {0: "'true'", 10: "'false'", 20: "'42'", 30: "'NaN'"}, "'\"jsonagent\"'")}
  || ', "body": "b=' || CAST(e AS VARCHAR) || '"' || {case('e', 110, {0: "', \"status\": 503, \"load\": NaN'"}, "''")} || '}}'
ELSE
  ip || ' - - [' || stamp || '] "' || line || '" ' || {case('e', 7, {1: "'404'"}, "'200'")} || ' '
  || {case('e', 13, {4: "'-'", 5: "'1_0x'"}, "size")} || ' "' || {case('e', 3, {0: "'-'"}, "'/home'")}
  || '" "agent/' || CAST(e % 4 AS VARCHAR) || '"'
  || {case('e', 6, {2: "' \"sid=s' || CAST(e AS VARCHAR) || '\"'"}, "''")}
  || {case('e', 8, {1: "'  '"}, "''")}
END AS value FROM line_parts""",
)

COMBINED = (
    r'^(\S+)\s+\S+\s+\S+\s+\[([^\]]+)\]\s+"([^"]*)"\s+(\d{3})\s+(\S+)\s+"([^"]*)"\s+"([^"]*)"'
    r'(?:\s+"([^"]*)")?\s*$'
)
view("stripped", ["log_lines"], "SELECT line_id, trim(value) AS line FROM log_lines")
# Lines without what strict JSON does not have: the earlier one of two equal keys, and NaN.
view(
    "json_docs",
    ["stripped"],
    r"""
SELECT line_id, line, CASE WHEN line LIKE '{%}' THEN TRY_CAST(replace(regexp_replace(line,
  '"status": [^,]+, (.*"status": 503), "load": NaN\}$', '\1}'), '"agent": NaN', '"agent": "nan"') AS JSON) END AS doc
FROM stripped""",
)


def _json_value(name: str, mode: str) -> str:
    kind, text = f"json_type(doc, '$.{name}')", f"json_extract_string(doc, '$.{name}')"
    truthy = (
        f"CASE WHEN {kind} IS NULL OR {kind} = 'NULL' THEN false WHEN {kind} = 'VARCHAR' THEN {text} <> '' "
        f"WHEN {kind} = 'BOOLEAN' THEN {text} = 'true' WHEN {kind} = 'ARRAY' THEN {text} <> '[]' "
        f"WHEN {kind} = 'OBJECT' THEN {text} <> '{{}}' ELSE TRY_CAST({text} AS DOUBLE) <> 0 END"
    )
    if mode == "request":
        out = f"CASE WHEN {kind} = 'VARCHAR' THEN {text} ELSE '' END"
    elif mode == "int":
        out = f"CASE WHEN {kind} IN ('VARCHAR', 'BIGINT', 'UBIGINT') THEN {text} ELSE '' END"
    else:
        out = f"CASE WHEN {kind} = 'BOOLEAN' THEN 'True' ELSE {text} END"
    return f"CASE WHEN {truthy} THEN {out} END"


def _first(names: list[str], mode: str = "text") -> str:
    return "coalesce(" + ", ".join(_json_value(n, mode) for n in names) + ", '')"


view(
    "json_raw",
    ["json_docs"],
    f"""
SELECT line_id, {_first(['timestamp', 'time'])} AS ts, {_first(['ip', 'remote_addr'])} AS ip,
  {_first(['request', 'req'], 'request')} AS request, {_first(['user_agent', 'agent'])} AS agent,
  {_first(['status'], 'int')} AS status, {_first(['body_bytes_sent', 'size'], 'int')} AS size,
  {_first(['referer', 'http_referer'])} AS referer, {_first(['request_body', 'body'])} AS body
FROM json_docs WHERE doc IS NOT NULL""",
)
view(
    "combined_raw",
    ["stripped"],
    f"""
SELECT line_id, g.ts, g.ip, g.request, g.agent, g.status,
  CASE WHEN g.size = '-' THEN '0' ELSE g.size END AS size, g.referer, g.body
FROM (SELECT line_id, regexp_extract(line, '{COMBINED}',
        ['ip', 'ts', 'request', 'status', 'size', 'referer', 'agent', 'body']) AS g
      FROM stripped WHERE regexp_matches(line, '{COMBINED}'))""",
)
view(
    "all_raw",
    ["json_raw", "combined_raw"],
    """
SELECT * FROM json_raw UNION ALL
SELECT * FROM combined_raw WHERE line_id NOT IN (SELECT line_id FROM json_raw)""",
)


def typed_rows(source: str) -> str:
    target = "coalesce(w[2], '')"
    return f"""
SELECT line_id, ts AS timestamp, ip, coalesce(w[1], '') AS method, split_part({target}, '?', 1) AS path,
  CASE WHEN contains({target}, '?') THEN substr({target}, instr({target}, '?') + 1) ELSE '' END AS query,
  agent AS user_agent, CAST({safe_int('status')} AS BIGINT) AS status,
  CAST({safe_int('size')} AS BIGINT) AS response_size, referer, coalesce(body, '') AS body
FROM (SELECT *, {words('request')} AS w FROM {source})"""


view("log_rows", ["all_raw"], typed_rows("all_raw"))
view(
    "bodies",
    [],
    """
SELECT doc_id, 'id=3f2504e0-4f89-11d3-9a0c-' || lpad(CAST(doc_id AS VARCHAR), 12, '0') || ' Token=t.'
  || CAST(doc_id AS VARCHAR) || ' at 2023-05-0' || CAST(doc_id % 9 AS VARCHAR)
  || ' 12:00:00+02:00, %2Fx%2e ' || text || ' from 10.1.2.' || CAST(doc_id % 300 AS VARCHAR) AS body
FROM documents""",
)
view(
    "detections",
    [],
    """
SELECT event_id AS id, 'r-' || CAST(event_id AS VARCHAR) AS request_id, ts, 'GET' AS method,
  '/' || event_type AS path, value AS anomaly_score, value > 100 AS is_anomaly, 1 AS model_version,
  100.0::DOUBLE AS threshold, CAST(user_id AS VARCHAR) AS client FROM events""",
)
view(
    "labelled",
    [],
    """
SELECT d.doc_id AS id, d.text, CASE WHEN l.toxic = 1 THEN 'attack' ELSE 'benign' END AS label
FROM documents d JOIN labels l ON d.doc_id = l.doc_id""",
)


# --- model -----------------------------------------------------------------------------


def model_views(
    prefix: str, source: str, needs: list[str], where: str, vocab_size: int, max_length: int | None = None
) -> None:
    """Views ``<prefix>_counts`` and ``<prefix>_model`` fitted on ``source(key, text)``."""
    toks = tokens("text")
    if max_length is not None:
        toks = f"({toks})[1:{max_length - 2}]"
    view(f"{prefix}_seq", needs, f"SELECT list_append({toks}, '[SEP]') AS s FROM {source} WHERE {where}")
    view(f"{prefix}_tok", [f"{prefix}_seq"], f"SELECT unnest(s) AS token FROM {prefix}_seq")
    view(
        f"{prefix}_cnt",
        [f"{prefix}_tok"],
        f"SELECT token, CAST(count(*) AS BIGINT) AS n FROM {prefix}_tok GROUP BY token",
    )
    view(
        f"{prefix}_top",
        [f"{prefix}_cnt"],
        f"""
SELECT token, n FROM {prefix}_cnt WHERE token <> '[SEP]' ORDER BY n DESC, token LIMIT {vocab_size - 4}""",
    )
    view(
        f"{prefix}_counts",
        [f"{prefix}_top", f"{prefix}_cnt"],
        f"""
SELECT token, CAST(3 + row_number() OVER (ORDER BY n DESC, token) AS INTEGER) AS id, n FROM {prefix}_top
UNION ALL SELECT token, 3, n FROM {prefix}_cnt WHERE token = '[SEP]'
UNION ALL SELECT '[UNK]', 1, CAST((SELECT sum(n) FROM {prefix}_cnt WHERE token <> '[SEP]')
                                  - (SELECT sum(n) FROM {prefix}_top) AS BIGINT)""",
    )
    view(
        f"{prefix}_model",
        [f"{prefix}_counts"],
        f"""
SELECT token, id, n, ln((n + 1.0::DOUBLE) / (sum(n) OVER () + 1.0::DOUBLE * count(*) OVER ())) AS log_p
FROM {prefix}_counts""",
    )


def score_views(
    prefix: str,
    model: str,
    source: str,
    key: str,
    needs: list[str],
    where: str = "true",
    max_length: int | None = None,
) -> None:
    """View ``<prefix>_scores(key, anomaly_score)`` and ``<prefix>_losses``."""
    toks = tokens("text")
    if max_length is not None:
        toks = f"({toks})[1:{max_length - 2}]"
    view(
        f"{prefix}_losses",
        [f"{model}_model", *needs],
        f"""
SELECT t.{key}, -coalesce(m.log_p, u.log_p) AS loss
FROM (SELECT {key}, unnest(list_append({toks}, '[SEP]')) AS token FROM {source} WHERE {where}) t
LEFT JOIN {model}_model m ON t.token = m.token
JOIN {model}_model u ON u.token = '[UNK]'""",
    )
    view(
        f"{prefix}_scores",
        [f"{prefix}_losses"],
        f"SELECT {key}, avg(loss) AS anomaly_score FROM {prefix}_losses GROUP BY {key}",
    )


def query(needs: list[str], select: str) -> str:
    """The SELECT under a WITH list of the views it needs, in dependency order."""
    order: list[str] = []

    def add(name: str) -> None:
        if name in order:
            return
        for n in VIEWS[name][0]:
            add(n)
        order.append(name)

    for n in needs:
        add(n)
    if not order:
        return select.strip()
    ctes = ",\n".join(f"{n} AS ({VIEWS[n][1].strip()})" for n in order)
    return f"WITH {ctes}\n{select.strip()}"


def sql(select: str) -> str:
    """``query`` with the views found by name in the SELECT."""
    names = [n for n in VIEWS if re.search(rf"\b{n}\b", select)]
    return query(names, select)
