"""The queries of this subpackage, and DuckDB SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import ann, bpe, exact_dedup, langid, packing, quality, simhash, tokens, toxicity, warc
from .common import table


def op1_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_groups(table(spark, sf_dir, "documents"))


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return str(public_tokenizers.path(name))


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    packed = packing.pack(table(spark, sf_dir, "documents"), tokenizer_path(), with_ids=False)
    return packed.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


def op3_warc_revisits(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = warc.resolve_revisits(warc.page_captures(table(spark, sf_dir, "pages")))
    lines = F.array_sort(F.transform(F.map_entries("headers"), lambda e: F.concat(e["key"], F.lit(": "), e["value"])))
    return out.withColumn("headers", F.array_join(lines, "\n")).withColumn("original_id", F.coalesce("original_id", F.lit(-1)))


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return toxicity.score_toxicity(docs, toxicity.fit_toxicity(docs, table(spark, sf_dir, "labels")))


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.simhash_components(table(spark, sf_dir, "documents"))


def op6_nearest_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.nearest(table(spark, sf_dir, "embeddings"), "vec_id % 50 = 0")


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return quality.score_quality(docs, quality.fit_quality(docs, table(spark, sf_dir, "labels")))


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return langid.identify_languages(docs, langid.fit_language_model(docs), host_col="source")


def page_languages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same on raw pages, which declare a language and have an address."""
    model = langid.fit_language_model(table(spark, sf_dir, "documents"))
    pages = langid.pages_evidence(table(spark, sf_dir, "pages"))
    return langid.identify_languages(pages, model, id_col="page_id", host_col="host", markup_col="markup")


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.token_counts(table(spark, sf_dir, "documents"), tokenizer_path())


def op10_bpe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.round_trip(table(spark, sf_dir, "documents"), tokenizer_path())


def byte_level_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same with a byte-level vocabulary, whose tokens may end inside a character: decoding goes through the byte machine."""
    return bpe.round_trip(table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.json"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_exact_dedup, op2_packing, op3_warc_revisits, op4_toxicity, op5_simhash, op6_nearest_vectors, op7_quality, op8_language_id, page_languages, op9_token_counts, op10_bpe_round_trip, byte_level_round_trip)}


def oracle_sql() -> dict[str, str]:
    return {
        "op1_exact_dedup": """
            WITH d AS (
                SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS content FROM documents
            ), g AS (
                SELECT content, max(doc_id) AS keep_id, count(*) AS group_size FROM d GROUP BY content
            )
            SELECT d.doc_id, g.keep_id, g.group_size, d.doc_id = g.keep_id AS kept, sha256(d.content) AS text_sha256
            FROM d JOIN g ON d.content = g.content
        """,
        "op3_warc_revisits": r"""
            WITH p AS (
                SELECT page_id, url, md5(coalesce(html, '')) AS tag, sha256(coalesce(html, '')) AS digest, CAST(strlen(coalesce(html, '')) AS VARCHAR) AS size FROM pages
            ), r AS (
                SELECT page_id * 2 AS record_id, 'response' AS kind, url, page_id AS captured_at, tag, size, digest FROM p
                UNION ALL
                SELECT page_id * 2 + 1, 'revisit',
                    CASE WHEN page_id % 3 = 0 THEN url || '#top' WHEN page_id % 3 = 1 AND NOT contains(url, '?') AND NOT contains(url, '#') THEN url || '?utm_source=again' ELSE url END,
                    page_id + 1099511627776, CASE WHEN page_id % 7 = 0 THEN 'gone' ELSE tag END, '0', NULL FROM p
            ), s AS (
                SELECT *, regexp_replace(regexp_replace(trim(url), '#.*$', ''), '^[A-Za-z][A-Za-z0-9+.-]*://', '') AS rest FROM r
            ), k AS (
                SELECT record_id, kind, captured_at, tag, size, digest,
                    regexp_replace(regexp_replace(regexp_replace(lower(regexp_extract(rest, '^([^/?]*)', 1)), '^.*@', ''), ':(80|443)$', ''), '^www\d*\.', '')
                    || regexp_replace(regexp_extract(rest, '^[^/?]*(/[^?]*)', 1), '/+$', '')
                    || coalesce('?' || nullif(array_to_string(list_sort(list_filter(string_split(regexp_extract(rest, '\?(.*)$', 1), '&'),
                        lambda x: x <> '' AND NOT regexp_matches(x, '^(utm_[^=]*|gclid|fbclid)(=|$)'))), '&'), ''), '') AS canonical_url
                FROM s
            ), o AS (
                SELECT n.*, f.record_id AS f_id, f.tag AS f_tag, f.size AS f_size, f.digest AS f_digest
                FROM k AS n ASOF LEFT JOIN (SELECT * FROM k WHERE kind = 'response') AS f
                ON n.canonical_url = f.canonical_url AND n.captured_at > f.captured_at
            ), j AS (
                SELECT *, CASE WHEN kind = 'response' THEN 'full' WHEN f_id IS NULL THEN 'missing' WHEN tag = f_tag THEN 'resolved' ELSE 'etag_mismatch' END AS outcome FROM o
            )
            SELECT record_id, canonical_url, kind, captured_at, outcome,
                CASE outcome WHEN 'full' THEN record_id WHEN 'resolved' THEN f_id ELSE -1 END AS original_id,
                CAST(CASE WHEN kind = 'response' OR outcome = 'resolved' THEN 200 ELSE 304 END AS INTEGER) AS status,
                CASE WHEN kind = 'response' THEN '' ELSE 'cache-control: max-age=60' || chr(10) END
                || 'content-length: ' || CASE WHEN outcome = 'resolved' THEN f_size ELSE size END || chr(10)
                || CASE WHEN kind = 'response' OR outcome = 'resolved' THEN 'content-type: text/html' || chr(10) ELSE '' END
                || 'date: ' || CAST(captured_at AS VARCHAR) || chr(10)
                || 'etag: ' || CASE WHEN kind = 'response' OR tag = 'gone' THEN '' ELSE 'W/' END || '"' || tag || '"' AS headers,
                CASE WHEN outcome = 'resolved' THEN f_digest ELSE digest END AS digest
            FROM j
        """,
    }
