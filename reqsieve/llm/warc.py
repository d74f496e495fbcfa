"""WARC archives: write captures as records, read them back, and join them into captures.

A capture is a response (or revisit) record with the records concurrent to it. A record may name
several others in ``WARC-Concurrent-To``, from either side, and a metadata record may name the
request instead; it then belongs to the request's captures. The archives written here have three
records a capture, the request and the metadata record naming the response. Records are built as text in the JVM and written by Spark's
text writer, gzip-compressed, with the empty lines that end a record as line separator; so a
lost task is simply written again. Reading goes by Content-Length, never by separators, one
record at a time.

Of pages with equal payloads of at least ``MIN_REVISIT`` bytes the one with the smallest
page_id is the response and the others are revisits that refer to it. Payloads are equal if
SHA-256 and length agree.

Defined results: a null html is an empty payload; a null url gives no target header and reads
back as null; line breaks in a url are escaped; a page without page_id is never referred to,
and is a response where no page of its payload has an id; rows that repeat both page_id and
html share one record id and come back once per row; an empty table gives no records; other
columns are ignored.
"""

from __future__ import annotations

import gzip
import hashlib
import io
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from reqsieve.llm.common import stored

MIN_REVISIT = 100
RECORDS_PER_FILE = 3000
# Pages have no time of capture; one date stands for the crawl.
CRAWL_DATE = "2024-01-01T00:00:00Z"

_EOL = r"'\r\n'"


def with_originals(pages: DataFrame, min_revisit: int = MIN_REVISIT) -> DataFrame:
    """Add digest, size and, for revisits, ``original``: the page_id of the response.

    Digests are counted per (digest, page_id) in the scan's tasks first, so a payload of many
    pages shuffles as few rows. The small table of payloads with several ids is stored and
    joined back; a frequent digest is split there by Spark's skew join.
    """
    hashed = pages.selectExpr("page_id", "url", "coalesce(html, '') AS html").selectExpr(
        "page_id", "url", "html", "sha2(html, 256) AS digest", "octet_length(html) AS size"
    )
    shared = (
        hashed.where(f"size >= {min_revisit}")
        .groupBy("digest", "size")
        .agg(F.min("page_id").alias("first_page"), F.count("*").alias("copies"))
        .where("copies > 1 AND first_page IS NOT NULL")
        .drop("copies")
    )
    return hashed.join(stored(shared, "payloads"), ["digest", "size"], "left").selectExpr(
        "page_id", "url", "html", "digest", "size",
        "CASE WHEN NOT first_page <=> page_id THEN first_page END AS original",
    )


def _record_id(kind: str, page: str) -> str:
    h = f"md5(concat('{kind}:', coalesce(CAST({page} AS STRING), ''), ':', digest))"
    cuts = ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))
    uuid = ", '-', ".join(f"substring({h}, {a}, {n})" for a, n in cuts)
    return f"concat('<urn:uuid:', {uuid}, '>')"


def _record(kind: str, headers: list[str], block: str) -> str:
    """SQL for one record without the line ends that close it."""
    fixed = [f"'WARC/1.1'", f"concat('WARC-Type: ', {kind})", f"'WARC-Date: {CRAWL_DATE}'", *headers]
    return (
        f"concat(concat_ws({_EOL}, {', '.join(fixed)}, concat('Content-Length: ', octet_length({block}))), "
        f"{_EOL}, {_EOL}, {block})"
    )


def capture_records(pages: DataFrame) -> DataFrame:
    """The records of each page as text: response or revisit, request, metadata."""
    capture = _record_id("capture", "page_id")
    parts = pages.selectExpr(
        "page_id", "html", "digest", "size", "original", f"{capture} AS id",
        f"CASE WHEN original IS NOT NULL THEN {_record_id('capture', 'original')} END AS refers",
        f"{_record_id('request', 'page_id')} AS request_id",
        f"{_record_id('metadata', 'page_id')} AS metadata_id",
        r"regexp_replace(url, r'[\x00-\x1F]', '%20') AS url",
        f"concat_ws({_EOL}, 'HTTP/1.1 200 OK', 'Content-Type: text/html; charset=utf-8', "
        rf"concat('Content-Length: ', size), '\r\n') AS http",
    )
    parts = parts.selectExpr(
        "*",
        "CASE WHEN original IS NULL THEN concat(http, html) ELSE http END AS block",
        r"concat('GET ', coalesce(nullif(regexp_extract(url, r'^[a-z]+://[^/]*(/[^#]*)', 1), ''), '/'), "
        r"' HTTP/1.1\r\nHost: ', regexp_extract(coalesce(url, ''), r'^[a-z]+://([^/?#]*)', 1), '\r\n\r\n') AS request",
        r"concat_ws('\r\n', 'payload-length: ' || size, 'page-id: ' || page_id, 'refers-to-page: ' || original, '') AS metadata",
    )
    uri = "'WARC-Target-URI: ' || url"
    digest = "'WARC-Payload-Digest: sha256:' || digest"
    http = "application/http; msgtype="
    to = "'WARC-Concurrent-To: ' || id"
    main = _record(
        "CASE WHEN original IS NULL THEN 'response' ELSE 'revisit' END",
        [
            "'WARC-Record-ID: ' || id", uri, digest, f"'Content-Type: {http}response'",
            "'WARC-Refers-To: ' || refers",
            "CASE WHEN original IS NOT NULL THEN "
            "'WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest' END",
        ],
        "block",
    )
    request = _record(
        "'request'", ["'WARC-Record-ID: ' || request_id", uri, to, f"'Content-Type: {http}request'"], "request"
    )
    metadata = _record(
        "'metadata'", ["'WARC-Record-ID: ' || metadata_id", uri, to, "'Content-Type: application/warc-fields'"], "metadata"
    )
    return parts.selectExpr(f"explode(array({main}, {request}, {metadata})) AS value")


def write_archives(pages: DataFrame, path: str, records_per_file: int = RECORDS_PER_FILE) -> None:
    records = capture_records(with_originals(pages))
    (
        records.write.option("lineSep", "\r\n\r\n").option("compression", "gzip")
        .option("maxRecordsPerFile", records_per_file).text(path)
    )


# --- reading ----------------------------------------------------------------------------

_RECORD = pa.schema(
    [
        ("file", pa.string()), ("type", pa.string()), ("id", pa.string()), ("concurrent_to", pa.list_(pa.string())),
        ("refers_to", pa.string()), ("uri", pa.string()), ("date", pa.string()), ("declared_digest", pa.string()),
        ("payload_digest", pa.string()), ("payload_bytes", pa.int64()),
        ("fields", pa.map_(pa.string(), pa.string())), ("payload", pa.binary()),
    ]
)
RECORD_TYPE = (
    "file string, type string, id string, concurrent_to array<string>, refers_to string, uri string, date string, "
    "declared_digest string, payload_digest string, payload_bytes bigint, fields map<string,string>, payload binary"
)


def _headers(stream) -> dict[str, str]:
    out = {}
    while line := stream.readline().rstrip(b"\r\n"):
        name, _, value = line.partition(b":")
        key, text = name.decode("utf-8", "replace").strip().lower(), value.decode("utf-8", "replace").strip()
        # The one header that may be repeated; ids have no blanks.
        out[key] = f"{out[key]} {text}" if key == "warc-concurrent-to" and key in out else text
    return out


def parse_archive(content: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """(headers, block) of each record of an archive, plain or gzip."""
    raw = io.BytesIO(content)
    stream = gzip.GzipFile(fileobj=raw) if content[:2] == b"\x1f\x8b" else raw
    while line := stream.readline():
        if not line.strip():
            continue
        if not line.startswith(b"WARC/"):
            raise ValueError(f"no record starts at {line[:60]!r}")
        headers = _headers(stream)
        length = int(headers["content-length"])
        block = stream.read(length)
        if len(block) != length:
            raise ValueError(f"record {headers.get('warc-record-id')} is cut short")
        yield headers, block


def record_row(headers: dict[str, str], block: bytes, keep_payload: bool) -> dict:
    """One record as a row; the digest of a response is computed from its payload."""
    kind, fields, payload = headers.get("warc-type"), {}, None
    declared = headers.get("warc-payload-digest", "").rpartition(":")[2] or None
    if kind in ("response", "revisit", "request"):
        head, _, payload = block.partition(b"\r\n\r\n")
        fields = _headers(io.BytesIO(head.partition(b"\n")[2] + b"\r\n"))
    elif kind == "metadata":
        fields = _headers(io.BytesIO(block + b"\r\n"))
    found = kind == "response"
    return {
        "type": kind, "id": headers.get("warc-record-id"), "concurrent_to": headers.get("warc-concurrent-to", "").split(),
        "refers_to": headers.get("warc-refers-to"), "uri": headers.get("warc-target-uri"),
        "date": headers.get("warc-date"), "declared_digest": declared,
        "payload_digest": hashlib.sha256(payload).hexdigest() if found else declared,
        "payload_bytes": len(payload) if found else None,
        "fields": list(fields.items()), "payload": payload if found and keep_payload else None,
    }


def read_records(spark: SparkSession, path: str, keep_payload: bool = True) -> DataFrame:
    """Every record of the archives in a folder. A file is one task's at most; its records
    are parsed one after another and leave in small batches."""
    schema = _RECORD

    def parse(batches):
        for batch in batches:
            for name, content in zip(batch["path"].to_pylist(), batch["content"]):
                rows, held = [], 0
                for headers, block in parse_archive(content.as_py()):
                    rows.append({"file": name, **record_row(headers, block, keep_payload)})
                    held += len(block)
                    if held > 8 << 20 or len(rows) >= 5000:
                        yield pa.RecordBatch.from_pylist(rows, schema=schema)
                        rows, held = [], 0
                yield pa.RecordBatch.from_pylist(rows, schema=schema)

    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path)
    return files.select("path", "content").mapInArrow(parse, RECORD_TYPE)


def _captures_of(records: DataFrame) -> DataFrame:
    """(id, capture_id) of the records that are concurrent to a response or revisit, at first
    hand or through a record that is."""
    main = records.where(_MAIN).select("id").distinct()
    named = records.selectExpr("id", "explode(concurrent_to) AS target")
    links = named.unionByName(named.selectExpr("target AS id", "id AS target")).distinct()
    first = links.join(main.selectExpr("id AS target"), "target").selectExpr("id", "target AS capture_id")
    first = first.join(main, "id", "left_anti")
    through = links.join(first.selectExpr("id AS target", "capture_id"), "target").select("id", "capture_id")
    # What has captures of its own does not take those of others.
    second = through.join(first.select("id").distinct(), "id", "left_anti").join(main, "id", "left_anti")
    return first.unionByName(second).distinct()


_MAIN = "type IN ('response', 'revisit')"


def assemble(records: DataFrame) -> DataFrame:
    """One nested row per capture: its records joined through their concurrent-to ids.

    ``requests`` and ``metadata`` hold all such records of a capture by id, since there may be
    several; ``response`` is the response or revisit, which names the capture, and null for
    records that no response goes with. ``records`` counts the responses and revisits of the id,
    more than one where the archives repeat it. An id has few records, so no group is large. The
    others than responses are small: they meet their captures in joins of ids, and payloads are
    shuffled once.
    """
    slim = stored(records.drop("payload"), "warc-records")
    others = slim.where(f"NOT coalesce({_MAIN}, false)").join(_captures_of(slim), "id", "left")
    placed = others.withColumn("capture_id", F.expr("coalesce(capture_id, array_min(concurrent_to), id)"))
    rows = (
        records.where(_MAIN).withColumn("capture_id", F.col("id"))
        .unionByName(placed.withColumn("payload", F.lit(None).cast("binary")))
    )
    response = (
        "struct(type, uri, date, refers_to, declared_digest, payload_digest, payload_bytes, "
        "fields['content-length'] AS content_length, payload)"
    )
    listed = "array_sort(collect_list(struct(id, uri, map_entries(fields) AS fields)) FILTER (WHERE type = '{}'))"
    back = "transform({}, x -> struct(x.id AS id, x.uri AS uri, map_from_entries(x.fields) AS fields))"
    grouped = rows.groupBy("capture_id").agg(
        F.expr(f"max_by({response}, file) FILTER (WHERE {_MAIN})").alias("response"),
        F.expr(listed.format("request")).alias("requests"),
        F.expr(listed.format("metadata")).alias("metadata"),
        F.expr(f"count(*) FILTER (WHERE {_MAIN})").alias("records"),
    )
    return grouped.withColumns({c: F.expr(back.format(c)) for c in ("requests", "metadata")})
