"""The registered queries of this subpackage, and DuckDB SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from . import byte_bpe, embed_dedup, langid, orc_tokens, packing, quality, secret_scan, simhash, token_counts, wacz
from .common import scratch, table


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


def op2_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.languages(table(spark, sf_dir, "documents"))


def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op5_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return byte_bpe.digests(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


def op6_orc_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = scratch(spark, "op6-orc")
    orc_tokens.write_tokens(table(spark, sf_dir, "documents"), folder, public_tokenizers.path("byte_bpe_50k.json"))
    return orc_tokens.summary(spark, folder)


def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    manifest = wacz.write_archives(table(spark, sf_dir, "pages"), scratch(spark, "op7-wacz"))
    read = wacz.read_archives(manifest, payloads=False)
    return read.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.report(table(spark, sf_dir, "documents"))


def op9_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embed_dedup.near_duplicates(table(spark, sf_dir, "embeddings"), 0.9)


def op10_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.scan(table(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    import corpus_pipeline

    return {
        "pipeline": corpus_pipeline.run,
        "op1_token_counts": op1_token_counts,
        "op2_best_fit_packing": op2_best_fit_packing,
        "op3_language_id": op3_language_id,
        "op4_simhash": op4_simhash,
        "op5_byte_bpe": op5_byte_bpe,
        "op6_orc_tokens": op6_orc_tokens,
        "op7_warc": op7_warc,
        "op8_quality_rules": op8_quality_rules,
        "op9_embedding_dedup": op9_embedding_dedup,
        "op10_secret_scan": op10_secret_scan,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op7_warc": OP7_SQL,
        "op8_quality_rules": OP8_SQL,
    }


def _stop_list() -> str:
    return ", ".join(f"'{w}'" for w in quality.STOP_FORMS)


OP7_SQL = """
WITH p AS (
  SELECT page_id, coalesce(html, '') AS h, sha1(coalesce(html, '')) AS x, max(page_id) OVER (PARTITION BY coalesce(html, '')) AS leader
  FROM pages
)
SELECT page_id, CAST(strlen(h) AS BIGINT) AS payload_bytes,
       array_to_string(list_transform(range(0, 32), lambda k: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
         CAST((CAST('0x' || substr(x, CAST(k // 4 * 5 + 1 AS BIGINT), 5) AS INTEGER) // CAST(pow(32, 3 - k % 4) AS INTEGER)) % 32 + 1 AS BIGINT), 1)), '') AS payload_digest,
       CASE WHEN leader IS NOT NULL AND leader IS DISTINCT FROM page_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN leader IS NOT NULL AND leader IS DISTINCT FROM page_id THEN leader END AS refers_to
FROM p
"""

OP8_SQL = rf"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t,
         regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l
  FROM documents
), g AS (
  SELECT r, i, count(*) OVER (PARTITION BY r, a, b, c) AS n FROM (
    SELECT r, i, w[i] AS a, w[i + 1] AS b, w[i + 2] AS c FROM (SELECT r, w, unnest(range(1, len(w) - 1)) AS i FROM d)
  )
), k AS (
  SELECT r, count(DISTINCT p) AS n FROM (SELECT r, unnest([i, i + 1, i + 2]) AS p FROM g WHERE n > 1) GROUP BY r
), m AS (
  SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars,
         CAST(length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
         CAST(len(l) - len(list_distinct(l)) AS BIGINT) AS n_dup_lines,
         CAST(coalesce(k.n, 0) AS BIGINT) AS n_repeat_words, len(l) AS n_lines,
         len(list_filter(w, lambda x: x IN ({_stop_list()}))) AS n_stop_words,
         len(list_filter(w, lambda x: regexp_matches(x, '[!?*#$%&~=_^]{{2,}}$'))) AS n_marked_words
  FROM d LEFT JOIN k ON d.r = k.r
), b AS (
  SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM m
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND word_chars >= 2.0 * n_words AND word_chars <= 20.0 * n_words AND n_symbols <= 0.05 * word_chars
         AND n_marked_words <= 0.3 * n_words AND n_stop_words >= 0.06 * n_words AND n_dup_lines <= 0.5 * n_lines AS kept
FROM b
"""
