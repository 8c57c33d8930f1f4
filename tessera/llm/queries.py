"""The queries of this subpackage: each applies one operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tessera.llm import (
    credentials,
    decontaminate,
    extract,
    fingerprint,
    mixing,
    neighbours,
    pieces,
    quality,
    ranking,
    simhash,
    urlfilter,
    vectorcodes,
    warc,
)
from tessera.session import new_folder, table


def op1_document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint.edited_fingerprints(table(spark, sf_dir, "documents"))


#: A public SentencePiece model; it is read where it is installed.
PIECES = "/opt/tokenizers/piece_bpe_32k.model"


def op2_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract.extract(table(spark, sf_dir, "pages"))


def op3_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.encode_documents(table(spark, sf_dir, "documents"), PIECES)


def op4_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return quality.judged(docs, quality.fit(docs, table(spark, sf_dir, "labels")))


def op5_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return credentials.digests(credentials.scan(table(spark, sf_dir, "documents")))


#: action, host, path
URL_RULES = (("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"), ("block", "net", "/es/"), ("block", "net", "/fr/"))


def op6_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = new_folder(spark, "warc")
    warc.write_pages(table(spark, sf_dir, "pages"), folder)
    return warc.page_rows(warc.read_archives(spark, folder))


def op7_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"), weights=(3, 1, 2), share=1.5, most=2.0)


def op8_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urlfilter.judge(table(spark, sf_dir, "pages"), urlfilter.rule_table(spark, URL_RULES))


def op9_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op10_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours.nearest(table(spark, sf_dir, "embeddings"), "vec_id % 20 = 0", k=20)


def op11_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectorcodes.compress(table(spark, sf_dir, "embeddings"), parts=16, entries=64, rounds=2)


def op12_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranking.search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), k=20)


def op13_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), n=10)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = (
        op1_document_fingerprints,
        op2_html_extraction,
        op3_sentencepiece,
        op4_quality_classifier,
        op5_secret_scans,
        op6_warc,
        op7_mix_sources,
        op8_url_filters,
        op9_simhash_near_dedup,
        op10_nearest_neighbours,
        op11_vector_codes,
        op12_ranked_search,
        op13_decontaminate,
    )
    return {f.__name__: f for f in found}


def oracle_sql() -> dict[str, str]:
    return {
        "op6_warc": OP6_SQL,
        "op7_mix_sources": OP7_SQL,
        "op8_url_filters": OP8_SQL,
        "op11_vector_codes": OP11_SQL,
        "op12_ranked_search": OP12_SQL,
        "op13_decontaminate": OP13_SQL,
    }


# base32 has no function in DuckDB: the 40 hex digits of the digest are cut into 32 groups of five bits
OP6_SQL = r"""
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS payload FROM pages),
d AS (SELECT page_id, octet_length(payload)::BIGINT AS payload_bytes, sha1(payload) AS sha FROM p),
b AS (
  SELECT *, array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
      (((('0x' || substr(sha, (i // 8 * 10 + 1)::INT, 10))::BIGINT) >> (35 - 5 * (i % 8))::INT) & 31)::INT + 1, 1)), '') AS payload_digest,
    min(page_id) OVER (PARTITION BY sha) AS first
  FROM d)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN page_id IS DISTINCT FROM first AND first IS NOT NULL THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN page_id IS DISTINCT FROM first THEN first END AS refers_to
FROM b
"""

OP7_SQL = r"""
WITH words AS (
  SELECT doc_id, source, coalesce(length(text), 0) AS chars,
         len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
         (('0x' || substr(md5('7:' || coalesce(doc_id::VARCHAR, 'null') || ':' || md5(coalesce(text, ''))), 1, 13))::BIGINT + 0.5::DOUBLE) / 4503599627370496::DOUBLE AS unit
  FROM documents),
keyed AS (
  SELECT *, -ln(unit) / (CASE WHEN size > 0 THEN 0.5::DOUBLE + 1.0::DOUBLE / (1.0::DOUBLE + abs(chars::DOUBLE / size::DOUBLE - 6.0::DOUBLE)) ELSE 0.5::DOUBLE END) AS k
  FROM words),
per AS (SELECT source, sum(size)::BIGINT AS source_size FROM keyed GROUP BY source),
ranked AS (
  SELECT *, [3.0::DOUBLE, 1.0::DOUBLE, 2.0::DOUBLE][((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::INT] AS w,
         2.0::DOUBLE * source_size AS cap, row_number() OVER (ORDER BY source NULLS LAST) AS nth
  FROM per),
filled AS (
  SELECT *, (1.5::DOUBLE * sum(source_size) OVER ()::DOUBLE
             - coalesce(sum(cap) OVER (ORDER BY cap / w, nth ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
            / sum(w) OVER (ORDER BY cap / w, nth ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
  FROM ranked),
found AS (SELECT arg_min(level, nth2) AS level FROM (SELECT level, row_number() OVER (ORDER BY cap / w, nth) AS nth2, cap / w AS full_at FROM filled) WHERE level < full_at),
targets AS (
  SELECT source, source_size, coalesce(least(cap, found.level * w), cap) AS target FROM filled, found),
plan AS (
  SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size)::BIGINT ELSE 0 END AS epochs FROM targets),
rests AS (SELECT *, floor(target - epochs * source_size + 0.5::DOUBLE)::BIGINT AS rest FROM plan),
run AS (
  SELECT d.doc_id, d.size, r.source_size, r.target, r.epochs, r.rest,
         sum(d.size) OVER (PARTITION BY d.source ORDER BY d.k, d.doc_id, d.size ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - d.size AS earlier
  FROM keyed d JOIN rests r ON d.source IS NOT DISTINCT FROM r.source)
SELECT doc_id, size, source_size, target, (epochs * size + greatest(0, least(rest - earlier, size)))::BIGINT AS taken FROM run
"""

OP8_SQL = r"""
WITH parts AS (
  SELECT page_id, row_number() OVER () AS nth,
         translate(coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)', 1), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)', 2), '') AS path
  FROM pages),
rules(action, h, p) AS (VALUES ('allow', 'com', '/'), ('block', 'example.com', '/en/'), ('allow', 'www.example.com', '/en/'), ('block', 'net', '/es/'), ('block', 'net', '/fr/')),
fits AS (
  SELECT nth, h || p AS rule, action, row_number() OVER (PARTITION BY nth ORDER BY length(h || p) DESC, length(h) DESC, action DESC) AS place
  FROM parts JOIN rules ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p))
SELECT page_id, host, path, rule, coalesce(action, 'allow') AS verdict
FROM parts LEFT JOIN (SELECT * FROM fits WHERE place = 1) USING (nth)
"""

# a round: each part's nearest entry (the index in the low six bits breaks ties), then the floored means by component
_ROUND = """,
near{i} AS MATERIALIZED (
  SELECT nth, part, min(list_sum(list_transform(range(len(x)), lambda j: (x[j + 1] - c[j + 1]) * (x[j + 1] - c[j + 1])))::BIGINT * 64 + entry) AS far
  FROM cut JOIN book{i} USING (part) GROUP BY nth, part)"""
_MOVE = """,
mean{i} AS (
  SELECT part, far % 64 AS entry, j, floor(sum(x[j])::DOUBLE / count(*))::BIGINT AS mean
  FROM near{i} JOIN cut USING (nth, part), range(1, 5) s(j) WHERE j <= len(x) GROUP BY part, far % 64, j),
book{n} AS MATERIALIZED (
  SELECT part, entry, coalesce(moved, c) AS c
  FROM book{i} LEFT JOIN (SELECT part, entry, list(mean ORDER BY j) AS moved FROM mean{i} GROUP BY part, entry) USING (part, entry))"""

OP11_SQL = (
    r"""
WITH kept AS MATERIALIZED (
  SELECT vec_id, label, row_number() OVER () AS nth, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS v
  FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
cut AS MATERIALIZED (
  SELECT nth, vec_id, part::BIGINT AS part, v[part * (len(v) // 16) + 1 : (part + 1) * (len(v) // 16)] AS x FROM kept, range(16) p(part)),
book0 AS (SELECT part, row_number() OVER (PARTITION BY part ORDER BY vec_id) - 1 AS entry, x AS c FROM cut QUALIFY entry < 64)"""
    + _ROUND.format(i=0) + _MOVE.format(i=0, n=1) + _ROUND.format(i=1) + _MOVE.format(i=1, n=2) + _ROUND.format(i=2)
    + r""",
coded AS (SELECT nth, string_agg(printf('%02x', (far % 64)::INT), '' ORDER BY part) AS code, sum(far // 64)::BIGINT AS error FROM near2 GROUP BY nth),
digest AS (SELECT sha256(string_agg(array_to_string(c, ','), ',' ORDER BY part, entry)) AS codebooks_sha256 FROM book2)
SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error, codebooks_sha256
FROM coded JOIN kept USING (nth), digest
"""
)

OP12_SQL = r"""
WITH upper AS (SELECT 'ABCDEFGHIJKLMNOPQRSTUVWXYZ' AS a, 'abcdefghijklmnopqrstuvwxyz' AS b, '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+' AS pattern),
words AS (
  SELECT nth, doc_id, unnest(w) AS term, len(w) AS n
  FROM (SELECT row_number() OVER () AS nth, doc_id, regexp_extract_all(translate(text, a, b), pattern) AS w FROM documents, upper)),
tf AS MATERIALIZED (SELECT nth, doc_id, term, n, count(*) AS tf FROM words GROUP BY ALL),
asked AS (
  SELECT item_id, term, count(*) AS times
  FROM (SELECT item_id, unnest(regexp_extract_all(translate(text, a, b), pattern)) AS term FROM benchmark, upper) GROUP BY ALL),
total AS (SELECT count(DISTINCT nth) AS docs, sum(tf)::BIGINT AS length FROM tf),
weights AS (
  SELECT term, floor(1000 * ln((2 * any_value(docs) + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE))::BIGINT AS w
  FROM tf, total WHERE term IN (SELECT term FROM asked) GROUP BY term),
scores AS (
  SELECT item_id, nth, doc_id, sum(times * w * ((1000000000 * tf) // (1000 * tf + 12 * (75 + (25 * n * docs) // length))))::BIGINT AS score
  FROM asked JOIN weights USING (term) JOIN tf USING (term), total GROUP BY item_id, nth, doc_id),
ranked AS (
  SELECT item_id, (row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id NULLS LAST))::INT AS rank, doc_id, score
  FROM scores WHERE score > 0)
SELECT * FROM ranked WHERE rank <= 20
"""

OP13_SQL = r"""
WITH upper AS (SELECT 'ABCDEFGHIJKLMNOPQRSTUVWXYZ' AS a, 'abcdefghijklmnopqrstuvwxyz' AS b, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+' AS pattern),
items AS (SELECT item_id, regexp_extract_all(translate(text, a, b), pattern) AS w FROM benchmark, upper),
grams AS MATERIALIZED (
  SELECT DISTINCT item_id, least(len(w), 10) AS k, array_to_string(w[i : i + least(len(w), 10) - 1], ' ') AS gram
  FROM (SELECT *, unnest(range(1, len(w) - least(len(w), 10) + 2)) AS i FROM items WHERE len(w) > 0)),
docs AS MATERIALIZED (SELECT row_number() OVER () AS nth, doc_id, coalesce(regexp_extract_all(translate(text, a, b), pattern), []) AS w FROM documents, upper),
places AS (
  SELECT nth, k, i, array_to_string(w[i : i + k - 1], ' ') AS gram
  FROM (SELECT nth, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM docs, (SELECT DISTINCT k FROM grams) WHERE len(w) >= k)),
met AS MATERIALIZED (SELECT nth, i, places.k, item_id FROM places JOIN grams USING (gram) WHERE places.k = grams.k),
hit AS (SELECT nth, count(DISTINCT word) AS n_hit FROM (SELECT nth, unnest(range(i, i + k)) AS word FROM (SELECT DISTINCT nth, i, k FROM met)) GROUP BY nth),
named AS (
  SELECT nth, count(*) AS n_items, string_agg(item, ',' ORDER BY item COLLATE C) AS ids
  FROM (SELECT DISTINCT nth, item_id::VARCHAR AS item FROM met WHERE item_id IS NOT NULL) GROUP BY nth)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, n_hit IS NOT NULL AS contaminated
FROM docs LEFT JOIN hit USING (nth) LEFT JOIN named USING (nth)
"""
