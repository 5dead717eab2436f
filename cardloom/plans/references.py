"""Queries on references to records that do not exist, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.references import MATCHES, orphan_references, orphans, references
from ..session import table


def _orphans(spark: SparkSession, d: str) -> DataFrame:
    return orphan_references(references(table(spark, d, "flash_cards"), table(spark, d, "density")), table(spark, d, "text_chunks"), table(spark, d, "change_log"))


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    """One row per orphan reference."""
    return _orphans(spark, d).select("ref_table", "row_id", "kind").distinct()


def p2_report(spark: SparkSession, d: str) -> DataFrame:
    """Orphan references per referring table, kind and month of the referring record."""
    return _orphans(spark, d).distinct().groupBy("ref_table", "kind", "month").agg(F.count("*").alias("n_orphans"))


def p2_composite(spark: SparkSession, d: str) -> DataFrame:
    """Chunks whose file and context, both of which may be null, name no upload, under each match rule."""
    refs = table(spark, d, "text_chunks").select("id", "file_id", "extra_context").distinct()
    uploads = table(spark, d, "uploads").select("file_id", "extra_context").distinct()
    parts = [orphans(refs, uploads, [("file_id", "file_id"), ("extra_context", "extra_context")], match).select(F.lit(match).alias("match"), "id") for match in MATCHES]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


_CASES = """
WITH refs AS (
  SELECT DISTINCT 'flash_cards' AS ref_table, id AS row_id, origin_id AS key, saved_at AS at_time FROM flash_cards WHERE origin_id IS NOT NULL
  UNION SELECT DISTINCT 'density', chunk_id, chunk_id, taken_at FROM density WHERE chunk_id IS NOT NULL),
saved AS (SELECT id, min(saved_at) AS saved_at FROM text_chunks WHERE id IS NOT NULL GROUP BY id),
events AS (
  SELECT seq, id, (op = 'delete' OR new_id IS NOT NULL) AS deleted FROM change_log WHERE entity = 'TextChunk' AND op IN ('delete', 'restore')
  UNION ALL SELECT seq, new_id, false FROM change_log WHERE entity = 'TextChunk' AND op = 'restore' AND new_id IS NOT NULL),
states AS (SELECT id, max_by(deleted, seq) AS deleted FROM events GROUP BY id),
cases AS (
  SELECT ref_table, row_id, CAST(date_trunc('month', at_time) AS DATE) AS month,
    CASE WHEN coalesce(st.deleted, false) THEN 'deleted' WHEN s.id IS NULL THEN 'missing' WHEN s.saved_at > at_time THEN 'late' END AS kind
  FROM refs r LEFT JOIN saved s ON s.id = r.key LEFT JOIN states st ON st.id = r.key)
"""

QUERIES = {"p2_found": p2_found, "p2_report": p2_report, "p2_composite": p2_composite}
SQL = {
    "p2_composite": """WITH r AS (SELECT DISTINCT id, file_id, extra_context FROM text_chunks)
      SELECT m AS match, id FROM r, (SELECT unnest(['simple', 'partial', 'full']) AS m) WHERE CASE
        WHEN file_id IS NULL AND extra_context IS NULL THEN false
        WHEN file_id IS NOT NULL AND extra_context IS NOT NULL THEN NOT EXISTS (SELECT 1 FROM uploads u WHERE u.file_id = r.file_id AND u.extra_context = r.extra_context)
        WHEN m = 'simple' THEN false WHEN m = 'full' THEN true
        WHEN file_id IS NOT NULL THEN NOT EXISTS (SELECT 1 FROM uploads u WHERE u.file_id = r.file_id) ELSE NOT EXISTS (SELECT 1 FROM uploads u WHERE u.extra_context = r.extra_context) END""",
    "p2_found": _CASES + "SELECT DISTINCT ref_table, row_id, kind FROM cases WHERE kind IS NOT NULL",
    "p2_report": _CASES + "SELECT ref_table, kind, month, count(*) AS n_orphans FROM (SELECT DISTINCT * FROM cases) WHERE kind IS NOT NULL GROUP BY ALL",
}
