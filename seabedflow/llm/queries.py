"""The registered queries of this subpackage: each applies one operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import chat, decontaminate, exact_dedup, licenses, mixing, near_dup, packing, quality, suffix_dedup, url_filter

Query = Callable[[SparkSession, str], DataFrame]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.filter_urls(table(spark, sf_dir, "pages"))


def op2_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dup.near_duplicates(table(spark, sf_dir, "documents"))


def op3_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.format_chats(table(spark, sf_dir, "conversations"))


def op4_token_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"))


def op5_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_dedup(table(spark, sf_dir, "documents"))


def op6_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.suffix_dedup(table(spark, sf_dir, "documents"))


def op7_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan_licenses(table(spark, sf_dir, "documents"))


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.benchmark_matches(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_plan(table(spark, sf_dir, "documents")).drop("copies")


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.classify_quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def queries() -> dict[str, Query]:
    return {f.__name__: f for f in (op1_url_filter, op2_near_duplicates, op3_chat_format, op4_token_packing, op5_exact_dedup, op6_suffix_dedup, op7_license_scan, op8_decontamination, op9_mixing, op10_quality)}


EXACT_SQL = """
WITH g AS (SELECT coalesce(text, '') AS t, max(doc_id) AS keep_id, count(*) AS group_size FROM documents GROUP BY 1)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(coalesce(text, '')) AS text_sha256
FROM documents JOIN g ON coalesce(text, '') = g.t
"""

MIX_SQL = r"""
WITH d AS (
  SELECT doc_id, source, CASE WHEN text IS NULL THEN 0 ELSE len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')) END::BIGINT AS size FROM documents
), s AS (
  SELECT source, sum(size)::HUGEINT AS source_size, [5, 2, 1][((row_number() OVER (ORDER BY source IS NULL, source) - 1) % 3 + 1)::INT]::HUGEINT AS w
  FROM d GROUP BY source
), r AS (
  SELECT *, sum(2 * source_size) OVER (o ROWS UNBOUNDED PRECEDING) AS below,
    coalesce(sum(w) OVER (o ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), 0) AS above, sum(source_size) OVER () AS total
  FROM s WINDOW o AS (ORDER BY 2 * source_size / w, source IS NULL, source)
), f AS (SELECT *, (below * w + 2 * source_size * above) * 2 <= 3 * total * w AS is_full FROM r
), t AS (
  SELECT source, source_size, CASE WHEN is_full THEN (2 * source_size)::DOUBLE
    ELSE (w * (3 * total - 2 * coalesce(sum(CASE WHEN is_full THEN 2 * source_size END) OVER (), 0)))::DOUBLE
      / (2 * sum(CASE WHEN is_full THEN 0 ELSE w END) OVER ())::DOUBLE END AS target
  FROM f
), p AS (
  SELECT doc_id, size, source_size::BIGINT AS source_size, target, CASE WHEN source_size > 0 THEN target / source_size::DOUBLE ELSE 0 END AS rate,
    ('0x' || substr(md5('mix:' || coalesce(doc_id::VARCHAR, 'null')), 1, 8))::BIGINT AS u
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source
)
SELECT doc_id, size, source_size, target, (size * (floor(rate) + CASE WHEN u::DOUBLE < (rate - floor(rate)) * 4294967296.0 THEN 1 ELSE 0 END))::BIGINT AS taken
FROM p
"""


def oracle_sql() -> dict[str, str]:
    return {"op5_exact_dedup": EXACT_SQL, "op9_mixing": MIX_SQL}
