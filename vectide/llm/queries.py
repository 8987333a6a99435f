"""The registered queries of this subpackage, each over its whole tables, and their SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontaminate, html_text, licenses, line_dedup, near_dedup, packing, quality, token_counts, url_filter, warc
from .common import stored


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.suffix_sums(stored(token_counts.length_histogram(_table(spark, sf_dir, "documents"))))


def op2_license_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.license_report(_table(spark, sf_dir, "documents"))


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contamination_report(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op4_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.main_text(_table(spark, sf_dir, "pages"))


def op5_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = warc.archive_pages(_table(spark, sf_dir, "pages"))
    return got.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = quality.judge_quality(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"), keep=["doc_id"])
    return got.select("row.doc_id", "base.*", "kept", F.round("score", 9).alias("score"))


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = line_dedup.dedupe_lines(_table(spark, sf_dir, "documents"), keep=["doc_id"])
    return got.select("row.doc_id", "n_lines", "n_removed", "text")


def op8_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.label_near_duplicates(_table(spark, sf_dir, "documents"))


def captures_of(pages: DataFrame) -> DataFrame:
    """The pages with a fetch time spread over 2024 by page_id."""
    minutes = F.pmod(F.col("page_id") * 7919, F.lit(366 * 1440)).cast("int")
    return pages.select("page_id", "url", (F.lit("2024-01-01").cast("timestamp") + F.make_dt_interval(mins=minutes)).alias("fetched_at"))


def entries_of(pages: DataFrame) -> DataFrame:
    """A dated list of hosts, domains and addresses of the pages; a name's MD5 says on which days it is added and removed."""
    url = F.col("url")
    host = url_filter.host_of(url)
    number = lambda c: F.conv(F.substring(F.md5(c), 1, 6), 16, 10).cast("int")
    named = (
        pages.select(F.lit("host").alias("kind"), host.alias("pattern"))
        .union(pages.select(F.lit("domain"), F.regexp_extract(host, r"([^.]+\.[^.]+)$", 1)))
        .union(pages.where("page_id % 50 = 0").select(F.lit("url"), url_filter.address_of(url)))
        .where("pattern <> ''")
        .distinct()
        .withColumn("v", number(F.concat_ws(":", "kind", "pattern")))
        .where("v % 3 = 0")
    )
    turns = F.array(
        *[
            F.struct(F.date_add(F.lit("2024-01-01").cast("date"), (F.col("v") % 250 + after).cast("int")).alias("day"), F.lit(what).alias("action"))
            for after, what in ((0, "add"), (40, "remove"), (70, "add"), (110, "remove"))
        ]
    )
    kept = F.slice(turns, 1, F.when(F.col("v") % 4 == 0, 1).when(F.col("v") % 4 == 1, 2).otherwise(4))
    return named.select(F.when(F.col("v") % 5 == 0, "allow").otherwise("block").alias("list"), "kind", "pattern", F.explode(kept).alias("e")).select(
        "list", "kind", "pattern", "e.day", "e.action"
    )


def op9_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = _table(spark, sf_dir, "pages").select("page_id", "url")
    got = url_filter.evaluate_captures(captures_of(pages), entries_of(pages))
    return got.withColumn("fetched_at", F.date_format("fetched_at", "yyyy-MM-dd HH:mm:ss"))


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(_table(spark, sf_dir, "documents"))


QUERIES = {f.__name__: f for f in (
        op1_token_counts,
        op2_license_scans,
        op3_decontamination,
        op4_html_extraction,
        op5_warc,
        op6_quality_rules,
        op7_line_dedup,
        op8_near_dedup,
        op9_url_filters,
        op10_packing,
    )}

ORACLE_SQL = {
    "op5_warc": """
WITH p AS (SELECT page_id, octet_length(encode(coalesce(html, ''))) AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest FROM pages),
    o AS (SELECT payload_digest, max(page_id) AS original FROM p WHERE payload_bytes >= 1000 GROUP BY payload_digest)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN original <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
    CASE WHEN original <> page_id THEN original END AS refers_to
FROM p LEFT JOIN o USING (payload_digest)
""",
    "op9_url_filters": r"""
WITH p AS (SELECT page_id, url, rtrim(lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)', 1)), '.') AS host,
        regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^#]*)', 1) AS rest FROM pages),
    c AS (SELECT page_id, url, host, host || CASE WHEN rest = '' THEN '/' ELSE rest END AS address,
        TIMESTAMP '2024-01-01' + to_minutes(CAST(page_id * 7919 % 527040 AS INTEGER)) AS fetched_at FROM p),
    named AS (SELECT DISTINCT kind, pattern FROM (
        SELECT 'host' AS kind, host AS pattern FROM c UNION ALL SELECT 'domain', regexp_extract(host, '([^.]+\.[^.]+)$', 1) FROM c
        UNION ALL SELECT 'url', address FROM c WHERE page_id % 50 = 0) x WHERE pattern <> ''),
    v AS (SELECT kind, pattern, CAST('0x' || substr(md5(kind || ':' || pattern), 1, 6) AS INTEGER) AS v FROM named),
    e AS (SELECT CASE WHEN v % 5 = 0 THEN 'allow' ELSE 'block' END AS list, kind, lower(pattern) AS pattern, v,
        DATE '2024-01-01' + CAST(v % 250 AS INTEGER) AS d FROM v WHERE v % 3 = 0),
    span AS (SELECT list, kind, pattern, d AS since, CASE WHEN v % 4 > 0 THEN d + 40 END AS until FROM e
        UNION ALL SELECT list, kind, pattern, d + 70, d + 110 FROM e WHERE v % 4 > 1),
    k AS (SELECT page_id, url, fetched_at, 'host' AS kind, host AS pattern FROM c WHERE host <> ''
        UNION ALL SELECT page_id, url, fetched_at, 'url', lower(address) FROM c WHERE host <> ''
        UNION ALL SELECT page_id, url, fetched_at, 'domain', array_to_string(list_slice(string_split(host, '.'), i, len(string_split(host, '.'))), '.')
            FROM (SELECT *, unnest(range(1, len(string_split(host, '.')) + 1)) AS i FROM c WHERE host <> '') y),
    a AS (SELECT k.*, list, row_number() OVER (PARTITION BY page_id, url ORDER BY CASE k.kind WHEN 'url' THEN 0 WHEN 'host' THEN 1 ELSE 2 END,
            length(k.pattern) DESC, list, k.pattern) AS r, count(*) OVER (PARTITION BY page_id, url) AS n
        FROM k JOIN span USING (kind, pattern) WHERE CAST(fetched_at AS DATE) >= since AND (until IS NULL OR CAST(fetched_at AS DATE) < until))
SELECT c.page_id, c.url, strftime(c.fetched_at, '%Y-%m-%d %H:%M:%S') AS fetched_at, CAST(coalesce(n, 0) AS BIGINT) AS n_active,
    CASE WHEN n IS NULL THEN '' ELSE list || ':' || kind || ':' || pattern END AS rule, coalesce(list = 'block', false) AS blocked
FROM c LEFT JOIN (SELECT * FROM a WHERE r = 1) a ON a.page_id = c.page_id AND a.url = c.url
""",
    "op3_decontamination": r"""
WITH d AS (SELECT row_number() OVER () AS k, doc_id,
        regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
    b AS (SELECT item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
    win AS (SELECT DISTINCT item_id, least(len(w), 13) AS n, array_to_string(list_slice(w, i, i + least(len(w), 13) - 1), ' ') AS g
        FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 12, 1) + 1)) AS i FROM b WHERE len(w) > 0)),
    pos AS (SELECT k, w, unnest(range(1, len(w) + 1)) AS i FROM d),
    hit AS (SELECT pos.k, pos.i, s.n, win.item_id FROM pos, (SELECT DISTINCT n FROM win) s, win
        WHERE pos.i + s.n - 1 <= len(pos.w) AND win.n = s.n AND win.g = array_to_string(list_slice(pos.w, pos.i, pos.i + s.n - 1), ' ')),
    words AS (SELECT k, count(DISTINCT p) AS n_hit FROM (SELECT k, unnest(range(i, i + n)) AS p FROM hit) h GROUP BY k),
    items AS (SELECT k, count(*) AS n_items, string_agg(s, ',' ORDER BY s) AS ids FROM (SELECT DISTINCT k, CAST(item_id AS VARCHAR) AS s FROM hit) GROUP BY k)
SELECT doc_id, CAST(coalesce(len(w), 0) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
    sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN words USING (k) LEFT JOIN items USING (k)
""",
}
