"""Sinks: tables with their ids, CSV and JSON export, the queue's landing folder."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import csv_field
from ..operators.references import orphans
from ..operators.skew import skew_left_join
from ..operators.store import number_rows

CHUNKS = "id long, content string, start_position int, end_position int, file_id string, extra_context string"
CARDS = "id long, question string, answer string, origin_id long"
CSV_HEADER = "Question,Answer,FileId"


def create_tables(spark: SparkSession, folder: str) -> None:
    """Empty tables of chunks and cards, where there are none yet."""
    for name, schema in (("text_chunks", CHUNKS), ("flash_cards", CARDS)):
        spark.createDataFrame([], schema).write.mode("ignore").parquet(f"{folder}/{name}.parquet")


def append_rows(rows: DataFrame, target: str, order: list[str], highest: int) -> DataFrame:
    """Appends rows with new ids in the given order; the job's commit makes all of them visible or none. Returns what
    was written."""
    numbered = number_rows(rows, order, "id", highest + 1)
    numbered.write.mode("append").parquet(target)
    return numbered


def append_cards(cards: DataFrame, chunks: DataFrame, target: str, highest: int) -> DataFrame:
    """Appends cards after checking that their chunks exist."""
    lost = orphans(cards, chunks, [("origin_id", "id")]).limit(1).count()
    if lost:
        raise ValueError("a card refers to a chunk that is not there")
    return append_rows(cards, target, ["origin_id", "question", "answer"], highest)


def csv_lines(cards: DataFrame, chunks: DataFrame) -> DataFrame:
    """``id, file_id, line`` of every card that has a chunk; a chunk with a large part of all cards stays many rows."""
    files = chunks.select(F.col("id").alias("origin_id"), "file_id").dropDuplicates(["origin_id"])
    line = F.concat_ws(",", csv_field(F.col("question")), csv_field(F.col("answer")), csv_field(F.col("file_id")))
    return skew_left_join(cards.where("origin_id is not null"), files, "origin_id", "inner").select("id", "file_id", line.alias("line"))


def export_csv(cards: DataFrame, chunks: DataFrame, path: str) -> None:
    """All cards with their file as CSV lines, in the order of file and card: an unquoted header, every field quoted,
    quotes doubled, line breaks kept. Files are written in parallel in that order; each part begins with the header
    only if it is the first."""
    joined = csv_lines(cards, chunks)
    ordered = joined.select("file_id", "id", F.col("line").alias("value")).orderBy("file_id", "id")
    header = joined.sparkSession.createDataFrame([(CSV_HEADER,)], "value string")
    header.unionByName(ordered.select("value")).write.mode("overwrite").text(path)


def json_responses(parsed: DataFrame, chunks: DataFrame, keys: list[str], origin: str) -> DataFrame:
    """``keys, json``: one JSON array of cards per response, each with its chunk as ``Origin``; ids of cards are not
    assigned yet, so ``Id`` and ``OriginId`` are 0. Null fields are written. ``parsed`` has ``keys``, the chunk's id
    ``origin``, ``card_no``, ``question`` and ``answer``; a response's cards are as bounded as the response."""
    of = chunks.select(
        F.col("id").alias(origin),
        F.struct(F.col("id").alias("Id"), F.col("content").alias("Content"), F.col("start_position").alias("StartPosition"), F.col("end_position").alias("EndPosition"), F.col("file_id").alias("FileId"), F.col("extra_context").alias("ExtraContext")).alias("__origin"),
    )
    gathered = parsed.groupBy(*{**dict.fromkeys(keys), origin: None}).agg(F.array_sort(F.collect_list(F.struct("card_no", "question", "answer"))).alias("__c"))
    told = skew_left_join(gathered, of, origin)
    card = lambda c: F.struct(F.lit(0).alias("Id"), c["question"].alias("Question"), c["answer"].alias("Answer"), F.lit(0).alias("OriginId"), F.col("__origin").alias("Origin"))
    return told.select(*keys, F.to_json(F.transform("__c", card), {"ignoreNullFields": "false"}).alias("json"))


def export_json(parsed: DataFrame, chunks: DataFrame, keys: list[str], origin: str, path: str) -> None:
    """The side files: a line for each response."""
    json_responses(parsed, chunks, keys, origin).select(F.col("json").alias("value")).write.mode("overwrite").text(path)


def name_uuid(name: Column) -> Column:
    """A name for a side file in the form of a UUID, always the same for the same name."""
    return F.regexp_replace(F.md5(name.cast("binary")), "^(.{8})(.{4})(.{4})(.{4})(.{12})$", "$1-$2-$3-$4-$5")


def enqueue(requests: DataFrame, folder: str) -> None:
    """Adds requests to the landing folder that ``queue_stream`` reads."""
    requests.write.mode("append").parquet(folder)
