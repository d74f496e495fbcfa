"""The numbered queries over the given tables, and their SQL twins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from reqsieve.llm import (
    chunk_reuse,
    collocations,
    decontaminate,
    exact_dedup,
    hard_negatives,
    licenses,
    mixing,
    near_dedup,
    pii,
    quality,
    secret_scan,
    token_files,
    warc,
)
from reqsieve.llm.common import stored, table
from reqsieve.session import scratch_dir

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def register(fn):
    QUERIES[fn.__name__] = fn
    return fn


@register
def op2_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    plan = mixing.mix_plan(table(spark, sf_dir, "documents"))
    return plan.selectExpr("doc_id", "size", "source_size", "target", "copies * size AS taken")


ORACLES["op2_mix_sources"] = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, source,
    len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size
  FROM documents),
s AS (
  SELECT source, sum(size)::BIGINT AS source_size,
    [3, 1, 2][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1] AS weight
  FROM d GROUP BY source),
-- Share by weight, stop the sources that are above their limit, share the rest again.
g(step, level) AS (
  SELECT 0, sum(source_size)::DOUBLE * 1.5::DOUBLE / sum(weight)::DOUBLE FROM s
  UNION ALL
  SELECT step + 1,
    ((SELECT sum(source_size)::DOUBLE * 1.5::DOUBLE FROM s)
      - (SELECT coalesce(sum(2 * source_size), 0)::DOUBLE FROM s WHERE 2 * source_size <= level * weight))
    / (SELECT sum(weight)::DOUBLE FROM s WHERE 2 * source_size > level * weight)
  FROM g WHERE step < (SELECT count(*) FROM s)),
t AS (
  SELECT source, source_size,
    least((2 * source_size)::DOUBLE, (SELECT max(level) FROM g) * weight) AS target
  FROM s),
j AS (
  SELECT doc_id, size, source_size, target,
    CASE WHEN source_size = 0 THEN 0 ELSE target / source_size END AS rate,
    ('0x' || substr(md5('mix:' || coalesce(doc_id::VARCHAR, '')), 1, 8))::BIGINT / 4294967296.0::DOUBLE AS draw
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target,
  (floor(rate)::BIGINT + CASE WHEN draw < rate - floor(rate) THEN 1 ELSE 0 END) * size AS taken
FROM j"""


@register
def op7_exact_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_duplicates(table(spark, sf_dir, "documents"))


ORACLES["op7_exact_duplicates"] = r"""
WITH d AS (
  SELECT doc_id, length(coalesce(text, '')) AS n_chars,
    regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS norm
  FROM documents)
SELECT doc_id,
  first_value(doc_id) OVER best AS keep_id,
  count(*) OVER (PARTITION BY norm) AS group_size,
  row_number() OVER best = 1 AS kept,
  sha256(norm) AS text_sha256
FROM d
WINDOW best AS (PARTITION BY norm ORDER BY n_chars DESC, doc_id NULLS LAST)"""


@register
def op10_warc_captures(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_dir(spark, "warc")
    warc.write_archives(table(spark, sf_dir, "pages"), path)
    captures = stored(warc.assemble(warc.read_records(spark, path, keep_payload=False)), "captures")
    page = "CAST(get(metadata, 0).fields['page-id'] AS BIGINT)"
    # A revisit names the record it refers to; that record's capture knows its page.
    originals = captures.selectExpr("capture_id AS original", f"{page} AS refers_to")
    return (
        captures.where("response IS NOT NULL").join(originals, F.expr("response.refers_to = original"), "left")
        .selectExpr(
            f"{page} AS page_id",
            "coalesce(response.payload_bytes, CAST(response.content_length AS BIGINT)) AS payload_bytes",
            "response.payload_digest AS payload_digest",
            "response.type AS record_type",
            "refers_to",
            "explode(array_repeat(0, CAST(records AS INT))) AS nth",
        ).drop("nth")
    )


ORACLES["op10_warc_captures"] = """
WITH p AS (
  SELECT page_id, sha256(coalesce(html, '')) AS digest, strlen(coalesce(html, '')) AS size,
    min(page_id) OVER (PARTITION BY coalesce(html, '')) AS original
  FROM pages),
r AS (SELECT *, size >= 100 AND original IS NOT NULL AND original IS DISTINCT FROM page_id AS again FROM p)
SELECT page_id, size AS payload_bytes, digest AS payload_digest,
  CASE WHEN again THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN again THEN original END AS refers_to
FROM r"""


@register
def op3_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


# Words of A-Z in lower case only; lower() would change letters beyond ASCII too.
_SQL_WORDS = (
    r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), "
    r"'[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
)

ORACLES["op3_decontaminate"] = f"""
WITH i AS (SELECT item_id::VARCHAR AS item_id, {_SQL_WORDS} AS words FROM benchmark),
w AS (
  SELECT DISTINCT item_id, least(13, len(words)) AS size,
    list_aggregate(words[k : k + least(13, len(words)) - 1], 'string_agg', ' ') AS phrase
  FROM (SELECT *, unnest(generate_series(1, greatest(len(words) - 12, 1))) AS k FROM i WHERE len(words) > 0)),
d AS (SELECT doc_id, row_number() OVER () AS row, {_SQL_WORDS} AS words FROM documents),
n AS (SELECT DISTINCT size FROM w),
h AS (
  SELECT row, k, size, item_id
  FROM (
    SELECT row, size, k, list_aggregate(words[k : k + size - 1], 'string_agg', ' ') AS phrase
    FROM (SELECT row, words, size, unnest(generate_series(1, len(words) - size + 1)) AS k
          FROM d, n WHERE len(words) >= size))
  JOIN w USING (size, phrase)),
c AS (
  SELECT row, count(DISTINCT p) AS n_hit
  FROM (SELECT row, unnest(generate_series(k, k + size - 1)) AS p FROM (SELECT DISTINCT row, k, size FROM h))
  GROUP BY row),
t AS (SELECT row, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS items
      FROM (SELECT DISTINCT row, item_id FROM h) GROUP BY row)
SELECT doc_id, len(words)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit,
  coalesce(n_items, 0)::BIGINT AS n_items, sha256(coalesce(items, '')) AS items_sha256,
  coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(words) AS contaminated
FROM d LEFT JOIN c USING (row) LEFT JOIN t USING (row)"""


@register
def op1_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_dir(spark, "token-files")
    token_files.write_token_files(table(spark, sf_dir, "documents"), path)
    return token_files.read_token_files(spark, path, with_ids=False)


@register
def op4_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(table(spark, sf_dir, "documents"))


def _license_sql() -> str:
    """The same by brute force: every block against every template, no filters."""
    sets = ", ".join(
        f"({i}, '{label}', {sorted(set(text.split()))})" for i, (text, label) in enumerate(licenses.TEMPLATES)
    )
    phrases = ", ".join(f"('{text}', {len(text.split())}, '{label}')" for text, label in licenses.PHRASES)
    step = max(len(text.split()) for text, _ in licenses.TEMPLATES)
    return f"""
WITH t(template, label, tokens) AS (VALUES {sets}),
p(phrase, size, label) AS (VALUES {phrases}),
d AS (SELECT doc_id, row_number() OVER () AS row, {_SQL_WORDS} AS words FROM documents),
b AS (
  SELECT row, words[k : k + {2 * step - 1}] AS held
  FROM (SELECT row, words, unnest(generate_series(1, len(words), {step})) AS k FROM d WHERE len(words) > 0)),
m AS (
  SELECT row, label, len(list_intersect(held, tokens))::DOUBLE / len(tokens) AS share
  FROM b, t WHERE len(list_intersect(held, tokens)) >= {licenses.CONTAINMENT} * len(tokens) - 1e-9),
h AS (
  SELECT row, k - 1 AS place, label
  FROM (SELECT row, words, unnest(generate_series(1, len(words))) AS k FROM d WHERE len(words) > 0), p
  WHERE list_aggregate(words[k : k + size - 1], 'string_agg', ' ') = phrase),
x AS (SELECT row, count(*) AS n, min(place) AS lo, max(place) AS hi,
  string_agg(DISTINCT label, ',' ORDER BY label) AS base FROM h GROUP BY row),
y AS (SELECT row, max(share) AS share FROM m GROUP BY row),
z AS (SELECT row, string_agg(DISTINCT label, ',' ORDER BY label) AS labels
  FROM (SELECT row, label FROM m UNION SELECT row, label FROM h) GROUP BY row)
SELECT doc_id, len(words)::BIGINT AS n_words, coalesce(n, 0)::BIGINT AS n_base, lo::BIGINT AS first_word,
  hi::BIGINT AS last_word, coalesce(base, '') AS base_labels, coalesce(labels, '') AS labels,
  CASE WHEN n > 0 THEN 1.0::DOUBLE ELSE coalesce(share, 0.0)::DOUBLE END AS score
FROM d LEFT JOIN x USING (row) LEFT JOIN y USING (row) LEFT JOIN z USING (row)"""


ORACLES["op4_license_scan"] = _license_sql()


@register
def op9_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.report(secret_scan.scan(table(spark, sf_dir, "documents")))


@register
def op8_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.report(pii.find(table(spark, sf_dir, "documents")))


@register
def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return quality.score(docs, quality.fit(docs, table(spark, sf_dir, "labels")))


@register
def op6_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_duplicates(table(spark, sf_dir, "documents"))


@register
def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    relabel = "CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END"
    return hard_negatives.mine(table(spark, sf_dir, "embeddings"), relabel=relabel)


ORACLES["op11_hard_negatives"] = """
WITH v AS (
  SELECT row_number() OVER () AS r, vec_id,
    CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
    list_transform(embedding, lambda x: floor(256.0::DOUBLE * x::DOUBLE)) AS q
  FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT a.r AS ar, a.vec_id AS anchor_id, b.r AS br, b.vec_id AS id, a.label = b.label AS same,
    list_sum(list_transform(range(1, len(a.q) + 1), lambda i: a.q[i] * b.q[i]))::BIGINT AS score
  FROM v a, v b WHERE a.vec_id % 100 = 0),
p AS (
  SELECT ar, anchor_id, br AS pr, id AS positive_id, score AS positive_score
  FROM (SELECT *, row_number() OVER (PARTITION BY ar ORDER BY score DESC, id) AS k FROM s WHERE same AND ar <> br)
  WHERE k <= 5),
n AS (
  SELECT p.anchor_id, positive_id, positive_score, id AS negative_id, score AS negative_score,
    row_number() OVER (PARTITION BY p.ar, pr ORDER BY score DESC, id) AS rank
  FROM p JOIN s ON p.ar = s.ar AND NOT same
  WHERE 80 * positive_score <= 100 * score AND 100 * score <= 100 * positive_score)
SELECT anchor_id, positive_id, rank::INTEGER AS rank, negative_id, positive_score, negative_score
FROM n WHERE rank <= 5"""


@register
def op12_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(table(spark, sf_dir, "documents"))


# By plain n-grams of every piece, all lengths at once.
ORACLES["op12_collocations"] = r"""
WITH p AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece
  FROM documents),
w AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS words FROM p),
s AS (SELECT lang, sum(len(words))::BIGINT AS n FROM w GROUP BY lang),
g AS (
  SELECT lang, list_aggregate(words[i : i + k - 1], 'string_agg', ' ') AS phrase, k
  FROM (SELECT lang, words, k, unnest(generate_series(1, len(words) - k + 1)) AS i
        FROM w, (SELECT unnest([1, 2, 3, 4, 5]) AS k) WHERE len(words) >= k)),
f AS (SELECT lang, phrase, k, count(*)::BIGINT AS f FROM g GROUP BY lang, phrase, k HAVING count(*) >= 100),
c AS (SELECT lang, phrase, k AS size, f AS a, string_split(phrase, ' ') AS words FROM f WHERE k >= 2),
x AS (
  SELECT c.lang, c.phrase, c.size, a, j, l.f AS l, r.f AS r, n, (1000::HUGEINT * a * n) // (l.f::HUGEINT * r.f) AS score
  FROM (SELECT *, unnest(generate_series(1, size - 1)) AS j FROM c) c
  JOIN f l ON l.lang = c.lang AND l.k = j AND l.phrase = list_aggregate(words[1 : j], 'string_agg', ' ')
  JOIN f r ON r.lang = c.lang AND r.k = size - j AND r.phrase = list_aggregate(words[j + 1 : size], 'string_agg', ' ')
  JOIN s ON s.lang = c.lang),
b AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY lang, phrase ORDER BY score, j) AS best FROM x) WHERE best = 1),
d AS (
  SELECT DISTINCT s.lang, s.phrase FROM c s JOIN c t ON s.lang = t.lang AND t.size > s.size AND 100 * t.a >= 100 * s.a
    AND contains(' ' || t.phrase || ' ', ' ' || s.phrase || ' ')),
k AS (SELECT b.* FROM b LEFT JOIN d ON b.lang = d.lang AND b.phrase = d.phrase WHERE d.phrase IS NULL),
o AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, encode(phrase)) AS rank FROM k)
SELECT lang, rank, phrase, a, l, r, n, score::BIGINT AS score FROM o WHERE rank <= 2000"""


@register
def op13_chunk_reuse(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunk_reuse.encode_and_decode(table(spark, sf_dir, "documents"))
