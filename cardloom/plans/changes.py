"""Queries that change tables: delete, cascade, update, restore, retry, and the change log behind them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.references import chunk_states
from ..operators.store import delete_cards, delete_chunks, fold_log, new_ids, number_rows, restore_chunks, update_cards
from ..session import table


def _chunks(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "text_chunks").dropDuplicates(["id"])


def _cards(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "flash_cards").select("id", "question", "answer", "origin_id").distinct()


def _log(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "change_log").distinct()


def _gone(spark: SparkSession, d: str, entity: str) -> DataFrame:
    return chunk_states(_log(spark, d), entity).where("deleted").select("id")


def changelog_fold(spark: SparkSession, d: str) -> DataFrame:
    """The last change of each record."""
    return fold_log(_log(spark, d), ["entity", "id"], "seq", ["op", "new_id"])


def live_states(spark: SparkSession, d: str) -> DataFrame:
    """Whether each chunk of the log is deleted after all changes."""
    return chunk_states(_log(spark, d), "TextChunk")


def cards_deleted(spark: SparkSession, d: str) -> DataFrame:
    return delete_cards(_cards(spark, d), _gone(spark, d, "FlashCard")).select("id", "origin_id")


def cascade_delete(spark: SparkSession, d: str) -> DataFrame:
    """Chunks and cards left after the deletions of the log, cards going with their chunk."""
    chunks, cards = delete_chunks(_chunks(spark, d), _cards(spark, d), _gone(spark, d, "TextChunk"))
    return chunks.select(F.lit("TextChunk").alias("entity"), "id").unionByName(cards.select(F.lit("FlashCard").alias("entity"), "id"))


def update_merge(spark: SparkSession, d: str) -> DataFrame:
    """Cards that the log updates get a changed text; an update of a card that is not there does nothing."""
    changes = _log(spark, d).where("op = 'update' and entity = 'FlashCard'").select("id").distinct()
    delta = changes.select("id", F.concat(F.lit("changed "), F.col("id").cast("string")).alias("question"), F.lit("changed").alias("answer"))
    return update_cards(_cards(spark, d), delta)


def _highest(df: DataFrame) -> int:
    return df.agg(F.max("id")).head()[0] or 0


def restore_rekey(spark: SparkSession, d: str) -> DataFrame:
    """Deleted chunks brought back under new ids, with their cards."""
    gone, chunks, cards = _gone(spark, d, "TextChunk"), _chunks(spark, d).select("id", "file_id"), _cards(spark, d)
    lost = chunks.join(gone, "id", "left_semi")
    lost_cards = cards.join(lost.select(F.col("id").alias("origin_id")), "origin_id", "left_semi").select("id", "origin_id")
    restored, moved = restore_chunks(lost, lost_cards, _highest(chunks), _highest(cards))
    return restored.select(F.lit("TextChunk").alias("entity"), "old_id", "id", F.lit(None).cast("long").alias("origin_id")).unionByName(moved.select(F.lit("FlashCard").alias("entity"), "old_id", "id", "origin_id"))


def retry_chunks(spark: SparkSession, d: str) -> DataFrame:
    """Chunks without cards go back into the queue under new ids."""
    chunks, cards = _chunks(spark, d), _cards(spark, d)
    idle = chunks.join(cards.select(F.col("origin_id").alias("id")), "id", "left_anti").select("id", "file_id", "content")
    return new_ids(idle, "id", _highest(chunks)).select("old_id", "id", "file_id")


def insert_ids(spark: SparkSession, d: str) -> DataFrame:
    """Ids given to new chunks in the order of their arrival."""
    uploads = table(spark, d, "uploads").select("file_id", "received_at").distinct()
    return number_rows(uploads, ["received_at", "file_id"], "id")


QUERIES = {f.__name__: f for f in (changelog_fold, live_states, cards_deleted, cascade_delete, update_merge, restore_rekey, retry_chunks, insert_ids)}

_C = "(SELECT DISTINCT ON (id) * FROM text_chunks)"
_F = "(SELECT DISTINCT id, question, answer, origin_id FROM flash_cards)"
_STATES = """(SELECT id, max_by(deleted, seq) AS deleted FROM (
  SELECT seq, id, (op = 'delete' OR new_id IS NOT NULL) AS deleted FROM change_log WHERE entity = '{0}' AND op IN ('delete', 'restore')
  UNION ALL SELECT seq, new_id, false FROM change_log WHERE entity = '{0}' AND op = 'restore' AND new_id IS NOT NULL) GROUP BY id)"""
_GONE = f"(SELECT id FROM {_STATES} WHERE deleted)"
_LOST = f"lost AS (SELECT id, file_id, row_number() OVER (ORDER BY id) + (SELECT max(id) FROM text_chunks) AS new_id FROM {_C} WHERE id IN {_GONE.format('TextChunk')})"

SQL = {
    "changelog_fold": "SELECT entity, id, seq, op, new_id FROM (SELECT DISTINCT entity, id, seq, op, new_id FROM change_log) QUALIFY row_number() OVER (PARTITION BY entity, id ORDER BY seq DESC, op DESC, new_id DESC NULLS LAST) = 1",
    "live_states": f"SELECT id, deleted FROM {_STATES.format('TextChunk')}",
    "cards_deleted": f"SELECT id, origin_id FROM {_F} WHERE id NOT IN {_GONE.format('FlashCard')}",
    "cascade_delete": f"""SELECT 'TextChunk' AS entity, id FROM {_C} WHERE id NOT IN {_GONE.format('TextChunk')}
      UNION ALL SELECT 'FlashCard', id FROM {_F} WHERE origin_id IS NULL OR origin_id NOT IN {_GONE.format('TextChunk')}""",
    "update_merge": f"""SELECT f.id, CASE WHEN u.id IS NOT NULL THEN 'changed ' || f.id ELSE question END AS question, CASE WHEN u.id IS NOT NULL THEN 'changed' ELSE answer END AS answer, origin_id
      FROM {_F} f LEFT JOIN (SELECT DISTINCT id FROM change_log WHERE op = 'update' AND entity = 'FlashCard') u ON u.id = f.id""",
    "restore_rekey": f"""WITH {_LOST} SELECT 'TextChunk' AS entity, id AS old_id, new_id AS id, CAST(NULL AS BIGINT) AS origin_id FROM lost
      UNION ALL SELECT 'FlashCard', f.id, row_number() OVER (ORDER BY f.id) + (SELECT max(id) FROM flash_cards), l.new_id FROM {_F} f JOIN lost l ON l.id = f.origin_id""",
    "retry_chunks": f"""SELECT id AS old_id, row_number() OVER (ORDER BY id) + (SELECT max(id) FROM text_chunks) AS id, file_id FROM {_C}
      WHERE id NOT IN (SELECT origin_id FROM flash_cards WHERE origin_id IS NOT NULL)""",
    "insert_ids": "SELECT file_id, received_at, row_number() OVER (ORDER BY received_at, file_id) AS id FROM (SELECT DISTINCT file_id, received_at FROM uploads)",
}
