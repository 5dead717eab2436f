"""Sources: uploaded files, direct text, layered settings and the queue as a stream."""

from __future__ import annotations

import json
import os
import re
from collections.abc import Callable
from dataclasses import dataclass, field, fields, replace
from pathlib import Path

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.html import upload_text
from ..operators.rules import RuleSet

TEXT_TYPES, HTML_TYPES, PDF_TYPES = (".txt", ".text", ".md"), (".html", ".htm"), (".pdf",)


@dataclass(frozen=True)
class Options:
    """Settings of the engine, with the defaults of the settings that a user may leave out."""

    batch_size: int = 4
    min_batch: int = 1
    max_wait_s: int = 30
    max_tokens: int = 1024
    context_size: int | None = None
    temperature: float = 0.6
    top_k: int = 40
    top_p: float = 0.9
    min_p: float = 0.1
    banned_texts: list = field(default_factory=list)
    instruction: str = ""
    context_prefix: str = "# Context\n"
    context_suffix: str = "\n\n"
    continuous_batching: bool = False
    warehouse_dir: str = "out"
    chunk_max_tokens: int = 700
    chunk_min_tokens: int = 500
    chunk_flush_chars: int = 700

    @property
    def context(self) -> int:
        """Tokens of the whole context: as set, or room for a batch of answers."""
        return self.context_size or 160 + self.max_tokens * self.batch_size


def preset_name(name: str | None) -> str:
    """Only letters, digits, dots, dashes and underscores of a preset's name."""
    return re.sub(r"[^\w.-]", "", name or "")


def load_options(folder: str, preset: str | None = None, variable: str = "CARDLOOM_PRESET") -> Options:
    """Settings from ``settings.json``, then ``secrets.json``, then ``settings.<preset>.json`` of a folder; the later wins.
    The preset may come from an environment variable. Missing files and unknown keys are passed over."""
    options, known = Options(), {f.name for f in fields(Options)}
    preset = preset_name(preset or os.environ.get(variable))
    for name in ("settings.json", "secrets.json", f"settings.{preset}.json" if preset else ""):
        path = Path(folder) / name
        if name and path.exists():
            options = replace(options, **{k: v for k, v in json.loads(path.read_text()).items() if k in known})
    return options


def layered(*layers: Column) -> Column:
    """One map of several layers of settings; the later wins. A null layer is passed over."""
    out = F.coalesce(layers[0], F.create_map().cast("map<string,string>"))

    def over(lower: Column, upper: Column) -> Column:
        return F.map_concat(F.map_filter(lower, lambda k, _: ~F.map_contains_key(upper, k)), upper)

    for layer in layers[1:]:
        out = over(out, F.coalesce(layer, F.create_map().cast("map<string,string>")))
    return out


def banned_rules(options: Options, ends: frozenset[str] = frozenset()) -> RuleSet:
    """The bans that settings name, without end."""
    return RuleSet(ends=ends).ban_texts(options.banned_texts)


def upload_result(uploads: DataFrame, chunks: DataFrame, request: str) -> DataFrame:
    """What the sender of each request is told: ``success, files_processed, chunks_added, message``.

    ``uploads`` has ``request`` and ``content``, ``chunks`` the chunks made of them with ``request``. A request whose
    files are all empty is rejected.
    """
    files = uploads.groupBy(request).agg(F.count("*").alias("n"), F.coalesce(F.max(F.length("content")), F.lit(0)).alias("longest"))
    made = chunks.groupBy(request).agg(F.count("*").alias("made"))
    told, ok = files.join(made, request, "left"), F.col("longest") > 0
    n, added = F.when(ok, F.col("n")).otherwise(0), F.when(ok, F.coalesce("made", F.lit(0))).otherwise(0)
    said = F.concat(F.lit("Successfully uploaded "), n.cast("string"), F.lit(" file(s) and added "), added.cast("string"), F.lit(" chunks for processing."))
    return told.select(request, ok.alias("success"), n.cast("long").alias("files_processed"), added.cast("long").alias("chunks_added"), F.when(ok, said).otherwise("No files uploaded").alias("message"))


def paged_text(pages: Column, newline: str = "\n") -> Column:
    """``page_text`` as an expression over an array of pages, each an array of blocks."""
    page = lambda blocks: F.concat(F.array_join(F.transform(blocks, lambda b: F.concat(b, F.lit(newline * 2))), ""), F.lit("---" + newline))
    return F.array_join(F.transform(pages, page), "")


def read_files(spark: SparkSession, path: str, strip_html: bool = False, extra_context: str | None = None, pdf: Callable[[bytes], list[list[str]]] | None = None) -> DataFrame:
    """Files of a folder as ``file_id, content, extra_context, received_at``; empty ones are rejected.

    Text and HTML are decoded as UTF-8 (a byte order mark goes). HTML is stripped only if asked for. ``pdf`` gets a
    file's bytes and returns the text blocks of each page; without it PDF files are left out. Each file is one row, so
    files are read in parallel and nothing is shuffled.
    """
    suffix = F.lower(F.regexp_extract("path", r"(\.[^./]*)$", 1))
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).where("length > 0").withColumn("suffix", suffix)
    name = F.regexp_extract("path", r"([^/]*)$", 1)
    text = files.where(F.col("suffix").isin(*TEXT_TYPES, *HTML_TYPES))
    body = F.regexp_replace(F.decode("content", "UTF-8"), "^﻿", "")
    out = text.select(name.alias("file_id"), upload_text(body, F.lit(strip_html)).alias("content"), F.lit(extra_context).cast("string").alias("extra_context"), F.col("modificationTime").alias("received_at"))
    if pdf is None:
        return out

    def extract(batches):
        for pdf_rows in batches:
            pages = [pdf(bytes(b)) for b in pdf_rows["content"]]
            yield pd.DataFrame({"file_id": pdf_rows["file_id"], "content": [page_text(p) for p in pages], "received_at": pdf_rows["received_at"]})

    found = files.where(F.col("suffix").isin(*PDF_TYPES)).select(name.alias("file_id"), "content", F.col("modificationTime").alias("received_at"))
    made = found.mapInPandas(extract, "file_id string, content string, received_at timestamp")
    return out.unionByName(made.withColumn("extra_context", F.lit(extra_context).cast("string")).select(out.columns))


def page_text(pages: list[list[str]], newline: str = "\n") -> str:
    """Text of a paged document: its blocks, each followed by an empty line, and a rule after each page."""
    return "".join("".join(block + newline * 2 for block in blocks) + "---" + newline for blocks in pages)


def direct_text(text: Column, name: Column, at: Column) -> tuple[Column, Column]:
    """Content and file name of text that was typed in: trimmed, and named by its time if no name was given."""
    stamp = F.translate(F.date_format(at, "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'"), ":.", "--")
    given = F.nullif(F.trim(F.coalesce(name, F.lit(""))), F.lit(""))
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", ""), F.coalesce(given, F.concat(F.lit("text_input_"), stamp, F.lit(".txt")))


def queue_stream(spark: SparkSession, folder: str, schema: str, files_per_batch: int = 1) -> DataFrame:
    """The work queue as a stream over a landing folder: what is enqueued there is read once, in order of arrival,
    ``files_per_batch`` at a time (the back pressure)."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(folder)


def start_queue(stream: DataFrame, process: Callable[[DataFrame, int], None], checkpoint: str, options: Options):
    """Starts the work on a queue: with continuous batching whatever comes is taken at once, else what is there is
    worked off to the end and the query stops."""
    trigger = {"processingTime": "0 seconds"} if options.continuous_batching else {"availableNow": True}
    return stream.writeStream.option("checkpointLocation", checkpoint).trigger(**trigger).foreachBatch(process).start()
