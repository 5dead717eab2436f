"""Chunks and cards as tables with a change log: delete, cascade, update, restore and retry without row-level writes.

Every operation is a function of whole tables, so any number of changes is applied in one pass. Ids are never used
again: new ones start above the largest that the tables or the log ever held.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut
from .skew import skew_left_join


def delete_cards(cards: DataFrame, ids: DataFrame) -> DataFrame:
    """Cards without those named in ``ids`` (column ``id``)."""
    return cards.join(ids.select("id").distinct(), "id", "left_anti")


def delete_chunks(chunks: DataFrame, cards: DataFrame, ids: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Chunks without those named in ``ids``, and cards without the ones made from them."""
    gone = ids.select("id").distinct()
    return chunks.join(gone, "id", "left_anti"), cards.join(gone.withColumnRenamed("id", "origin_id"), "origin_id", "left_anti").select(cards.columns)


def update_cards(cards: DataFrame, changes: DataFrame) -> DataFrame:
    """Cards with ``question`` and ``answer`` of ``changes`` (``id, question, answer``, one row per id) where there are
    any. A change of a card that is not there does nothing."""
    delta = changes.select("id", F.col("question").alias("__q"), F.col("answer").alias("__a"), F.lit(True).alias("__hit"))
    joined = cards.join(delta, "id", "left")
    return joined.withColumn("question", F.when(F.col("__hit"), F.col("__q")).otherwise(F.col("question"))).withColumn("answer", F.when(F.col("__hit"), F.col("__a")).otherwise(F.col("answer"))).select(cards.columns)


def blocks(df: DataFrame, order: list[str]) -> DataFrame:
    """``df`` in sorted blocks, with ``__block`` and ``__row`` (from 0) of each row: consecutive blocks hold consecutive
    ranges of the order.

    The blocks are the tasks of one range exchange. Where a range begins depends on a sample, so the result is written
    to the checkpoint folder before anything is derived from it: whoever counts the blocks and whoever reads them sees
    the same ones, also after an executor is lost.
    """
    placed = df.repartitionByRange(*[F.col(c) for c in order]).sortWithinPartitions(*order)
    placed = cut(placed.withColumn("__at", F.monotonically_increasing_id()))  # number of the task << 33 | row in it
    return placed.withColumn("__block", F.shiftright("__at", 33)).withColumn("__row", F.col("__at").bitwiseAND(F.lit((1 << 33) - 1))).drop("__at")


def number_rows(df: DataFrame, order: list[str], column: str, start: int = 1) -> DataFrame:
    """Adds consecutive numbers in the given order, nulls first, without bringing all rows into one task.

    A row's number is its place in its block and the rows of the blocks before, which are one count per block. Rows
    that agree in the whole order are numbered in any order. An empty input stays empty.
    """
    placed = blocks(df, order)
    counts = placed.groupBy("__block").agg(F.count("*").alias("__n"))
    before = F.coalesce(F.sum("__n").over(Window.orderBy("__block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = counts.select("__block", before.alias("__before"))  # a row per block
    return placed.join(F.broadcast(offsets), "__block").withColumn(column, (F.col("__before") + F.col("__row") + F.lit(start)).cast("long")).drop("__block", "__row", "__before")


def new_ids(df: DataFrame, id_: str, highest: int) -> DataFrame:
    """Replaces ids by new ones above ``highest`` in their order; ``old_id`` keeps the former one."""
    return number_rows(df.withColumnRenamed(id_, "old_id"), ["old_id"], id_, highest + 1)


def restore_chunks(chunks: DataFrame, cards: DataFrame, highest_chunk: int, highest_card: int) -> tuple[DataFrame, DataFrame]:
    """Deleted chunks and their cards under new ids; the cards refer to the new chunks."""
    restored = new_ids(chunks, "id", highest_chunk)
    ids = restored.select(F.col("old_id").alias("origin_id"), F.col("id").alias("__new"))
    moved = cards.join(ids, "origin_id").withColumn("origin_id", F.col("__new")).drop("__new").select(cards.columns)
    return restored, new_ids(moved, "id", highest_card)


def fold_log(log: DataFrame, key: list[str], order: str, columns: list[str]) -> DataFrame:
    """The last row of a log for each key: a partial aggregate, so a key with very many entries is no problem."""
    return log.groupBy(*key).agg(F.max(F.struct(order, *columns)).alias("__last")).select(*key, *[F.col(f"__last.{c}").alias(c) for c in [order, *columns]])


def retry_chunks(chunks: DataFrame, cards: DataFrame, ids: DataFrame, highest_chunk: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Chunks named in ``ids`` start anew: they and their cards are deleted and the chunks come back under new ids.

    Returns the chunks and the cards that stay, and the new chunks (``old_id`` is the former id), which are to be
    enqueued. An id that names no chunk does nothing.
    """
    known = chunks.join(ids.select("id").distinct(), "id", "left_semi")
    kept_chunks, kept_cards = delete_chunks(chunks, cards, known)
    return kept_chunks, kept_cards, new_ids(known, "id", highest_chunk)


def resubmitted(chunks: DataFrame, gone: DataFrame) -> DataFrame:
    """Deleted chunks as uploads to be chunked once more: ``file_id, content, extra_context`` (null for an empty one).

    ``gone`` has the deleted ids (``id``). Their former ids stay deleted.
    """
    lost = chunks.join(gone.select("id").distinct(), "id", "left_semi")
    return lost.select(F.col("id").alias("old_id"), "file_id", "content", F.nullif("extra_context", F.lit("")).alias("extra_context"))


def details(chunks: DataFrame, cards: DataFrame) -> DataFrame:
    """Every chunk with its cards, a row for each card and one with nulls for a chunk without any: ``card_id``,
    ``question``, ``answer`` beside the chunk's columns. A chunk that holds a large part of all cards stays many rows.
    """
    unique = cards.where("origin_id is not null").select(F.col("id").alias("card_id"), "question", "answer", F.col("origin_id").alias("id")).distinct()
    with_cards = skew_left_join(unique, chunks.dropDuplicates(["id"]).withColumn("__there", F.lit(True)), "id").where("__there").drop("__there")
    without = chunks.dropDuplicates(["id"]).join(unique.select("id").distinct(), "id", "left_anti")
    return with_cards.unionByName(without, allowMissingColumns=True)


def details_of(chunks: DataFrame, cards: DataFrame, chunk_id: int) -> DataFrame:
    """One chunk (null if it is not there) and its cards as an array, in the order of their ids; one row always."""
    held = cards.where(F.col("origin_id") == chunk_id).select("id", "question", "answer").distinct()
    told = held.agg(F.array_sort(F.collect_list(F.struct("id", "question", "answer"))).alias("cards"))
    found = chunks.where(F.col("id") == chunk_id).agg(F.first(F.struct(*chunks.columns)).alias("chunk"))
    return found.crossJoin(told)  # one row each
