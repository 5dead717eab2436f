"""Scalar text functions with the semantics of UTF-16 strings and Unicode white space, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_SPACE = r"(?U)^\s+|\s+$"
LINE_BREAK = r"\r\n|\r|\n"


def utf16_length(text: Column) -> Column:
    """Length in UTF-16 units: a character outside the basic plane counts twice. Null stays null."""
    return F.octet_length(F.encode(text, "UTF-16BE")).cast("long") / F.lit(2)


def token_estimate(text: Column) -> Column:
    """UTF-16 units / 4, rounded down; 0 for null."""
    return F.coalesce(F.floor(utf16_length(text) / 4), F.lit(0)).cast("long")


def unicode_trim(text: Column) -> Column:
    """Trim any Unicode white space, not only blanks."""
    return F.regexp_replace(text, _SPACE, "")


def trim_start_chars(text: Column, chars: str) -> Column:
    """Remove the leading run of any of ``chars``."""
    return F.regexp_replace(text, f"^[{chars}]+", "")


def split_lines(text: Column) -> Column:
    """Lines as a line reader gives them: a break at the very end starts no further line; empty text has none."""
    lines = F.split(F.regexp_replace(text, "^﻿", ""), LINE_BREAK, -1)
    return F.when(F.element_at(lines, -1) == "", F.slice(lines, 1, F.greatest(F.size(lines) - 1, F.lit(0)))).otherwise(lines)


def split_sentences(text: Column) -> Column:
    """Trimmed, non-empty parts after ``.``, ``!`` or ``?`` and white space."""
    return F.filter(F.transform(F.split(text, r"(?<=[.!?])\s+", -1), unicode_trim), lambda s: s != "")


def last_line(text: Column) -> Column:
    """The trimmed text after the last line feed."""
    return unicode_trim(F.substring_index(text, "\n", -1))


def without_last_line(text: Column) -> Column:
    """The text before the last line feed, trimmed at its end; empty if there is none."""
    head = F.substring(text, F.lit(1), F.length(text) - F.length(F.substring_index(text, "\n", -1)))
    return F.regexp_replace(head, r"(?U)\s+$", "")


def index_of(text: Column, value: str, start: int = 0) -> Column:
    """Position of ``value`` from ``start`` on, by code units, -1 if absent; an empty value is found at ``start``."""
    if value == "":
        return F.when(F.length(text) > start, F.lit(start)).otherwise(-1)
    return F.locate(value, text, start + 1) - 1


def csv_field(text: Column) -> Column:
    """A quoted CSV field with doubled quotes; line breaks stay."""
    return F.concat(F.lit('"'), F.replace(F.coalesce(text, F.lit("")), F.lit('"'), F.lit('""')), F.lit('"'))


def html_escape(text: Column) -> Column:
    """The five characters that HTML gives a meaning, escaped."""
    for raw, escaped in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#039;")):
        text = F.replace(text, F.lit(raw), F.lit(escaped))
    return text


def safe_name(text: Column) -> Column:
    """Only letters, digits, dot, underscore and dash."""
    return F.regexp_replace(text, r"[^\p{L}\p{Nd}._-]", "")
