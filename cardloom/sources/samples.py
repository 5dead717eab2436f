"""A small built-in collection to try the engine on: two files of different kinds with contexts of their own."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

_NOTES = """Rivers carry sand. The slower the water, the finer the grains it drops.

A delta grows where a river meets still water! Each flood adds a layer.

# Terms

Silt is finer than sand. Clay is finer than silt."""
_WORDS = "\n".join("川 海 砂 泥 粘土 洪水 河口 海 層 岸".split()) + "\n\n流れ\n"


def sample_uploads(spark: SparkSession) -> DataFrame:
    """``file_id, content, extra_context, strip_html`` of both files."""
    rows = [("notes.txt", _NOTES, "Notes of a lecture on rivers", False), ("words.txt", _WORDS, "Japanese words", False)]
    return spark.createDataFrame(rows, "file_id string, content string, extra_context string, strip_html boolean")
