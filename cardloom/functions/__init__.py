"""Column functions, and their registration for SQL users."""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql.functions import udtf


class _ChunkText:
    """Rows of chunks of one text."""

    def eval(self, text: str):
        from ..operators.chunker import chunk_text

        for n, (content, start, end) in enumerate(chunk_text(text)):
            yield n, content, start, end


class _SplitLines:
    """Rows of lines of one text."""

    def eval(self, text: str):
        import re

        lines = re.split(r"\r\n|\r|\n", (text or "").removeprefix("﻿"))
        for n, line in enumerate(lines[:-1] if lines[-1] == "" else lines):
            yield n, line


class _ParseCards:
    """Rows of the cards in one response."""

    def eval(self, text: str):
        from ..operators.cards import parse_response

        for n, (question, answer) in enumerate(parse_response(text)):
            yield n, question, answer


def register(spark: SparkSession) -> None:
    """Makes ``html_to_text(text)`` and, for use with LATERAL, the table functions ``chunk_text(text)``,
    ``text_lines(text)`` and ``parse_cards(text)`` known to SQL."""
    from ..operators.html import html_to_text

    spark.udf.register("html_to_text", html_to_text)
    spark.udtf.register("chunk_text", udtf(_ChunkText, returnType="chunk_no int, content string, start_position int, end_position int"))
    spark.udtf.register("text_lines", udtf(_SplitLines, returnType="line_no int, line string"))
    spark.udtf.register("parse_cards", udtf(_ParseCards, returnType="card_no int, question string, answer string"))
