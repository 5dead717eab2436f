"""Queries from uploads to cards: scans, chunks, prompts, parsing, details, density, export."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import html_escape, last_line, split_lines, split_sentences, token_estimate
from ..operators.cards import by_context, completion_status, generate, parse_cards, prompts
from ..operators.density import card_counts, intensity
from ..operators.store import details, details_of
from ..operators.skew import skew_left_join
from ..session import table
from ..sources import sinks

INSTRUCTION = "Write flash cards about the text."
_UTF16 = "(length({0}) + length(regexp_replace({0}, '[^\\x{{10000}}-\\x{{10FFFF}}]', '', 'g')))"


def _chunks(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "text_chunks").dropDuplicates(["id"])


def token_estimates(spark: SparkSession, d: str) -> DataFrame:
    return _chunks(spark, d).select("id", token_estimate(F.col("content")).alias("n_tokens"))


def line_scan(spark: SparkSession, d: str) -> DataFrame:
    return _chunks(spark, d).select("id", F.posexplode(split_lines(F.col("content"))).alias("line_no", "line"))


def sentence_split(spark: SparkSession, d: str) -> DataFrame:
    parts = F.posexplode(split_sentences(F.col("content"))).alias("sentence_no", "sentence")
    return _chunks(spark, d).select("id", parts)


def last_lines(spark: SparkSession, d: str) -> DataFrame:
    return _chunks(spark, d).select("id", last_line(F.col("content")).alias("last_line"))


def html_escaped(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "uploads").select("file_id", "received_at", html_escape(F.col("content")).alias("escaped")).distinct()


def prompt_assembly(spark: SparkSession, d: str) -> DataFrame:
    return prompts(_chunks(spark, d), INSTRUCTION).select("id", "prompt")


def context_order(spark: SparkSession, d: str) -> DataFrame:
    """Requests as the model gets them: per context their number, and whether each task meets every context in one run, so
    that its prefix is read once."""
    told = by_context(_chunks(spark, d)).select(F.coalesce("extra_context", F.lit("")).alias("context"), F.monotonically_increasing_id().alias("at"))
    per_task = told.groupBy("context", F.shiftright("at", 33).alias("task")).agg(F.count("*").alias("n"), (F.max("at") - F.min("at") + 1).alias("span"))
    return per_task.groupBy("context").agg(F.sum("n").alias("n_requests"), F.bool_and(F.col("n") == F.col("span")).alias("in_one_run"))


def _responses(spark: SparkSession, d: str) -> DataFrame:
    """Responses made of the cards of a chunk, up to eight consecutive ids each, as a model would have written them."""
    cards = table(spark, d, "flash_cards").where("origin_id is not null").select("id", "origin_id", "question", "answer").distinct()
    said = F.concat(F.lit("Q: "), F.coalesce("question", F.lit("")), F.lit("\nA: "), F.coalesce("answer", F.lit("")))
    told = cards.groupBy("origin_id", F.floor(F.col("id") / 8).alias("part")).agg(F.array_sort(F.collect_list(F.struct("id", said.alias("said")))).alias("c"))
    return told.select("origin_id", "part", F.concat(F.lit("<think>Q: none\nA: none</think>\n"), F.array_join(F.transform("c", lambda x: x["said"]), "\n")).alias("response"))


def qa_parse(spark: SparkSession, d: str) -> DataFrame:
    return parse_cards(_responses(spark, d), "response", ["origin_id", "part"]).drop("card_no")


def completion(spark: SparkSession, d: str) -> DataFrame:
    """What each chunk shows when it is done: every 11th fails and every 13th is cancelled here."""
    parsed = parse_cards(_responses(spark, d), "response", ["origin_id"]).groupBy(F.col("origin_id").alias("id")).agg(F.count("*").alias("n_cards"))
    done = _chunks(spark, d).select("id").join(parsed, "id", "left").fillna(0, ["n_cards"])
    return done.select("id", completion_status(F.col("n_cards"), F.when(F.col("id") % 11 == 0, "out of memory"), F.col("id") % 13 == 0).alias("status"))


def card_count(spark: SparkSession, d: str) -> DataFrame:
    return card_counts(table(spark, d, "text_chunks"), table(spark, d, "flash_cards"))


def density_chart(spark: SparkSession, d: str) -> DataFrame:
    return intensity(card_counts(table(spark, d, "text_chunks"), table(spark, d, "flash_cards")))


def density_files(spark: SparkSession, d: str) -> DataFrame:
    """Chunks of each file in the order of their start, as the chart shows them."""
    chart = density_chart(spark, d)
    starts = _chunks(spark, d).groupBy("id").agg(F.min("start_position").alias("start_position"))
    told = chart.join(starts.withColumnRenamed("id", "chunk_id"), "chunk_id")
    return told.groupBy("file_id").agg(F.count("*").alias("n_chunks"), F.sum("flash_card_count").alias("n_cards"), F.max("intensity").alias("most"), F.min("start_position").alias("first_position"))


def stale_density(spark: SparkSession, d: str) -> DataFrame:
    """Recorded counts that differ from the counted ones."""
    recorded = table(spark, d, "density").select("chunk_id", F.col("flash_card_count").alias("recorded")).distinct()
    return recorded.join(card_count(spark, d).select("chunk_id", "flash_card_count"), "chunk_id").where("recorded <> flash_card_count")


def csv_lines(spark: SparkSession, d: str) -> DataFrame:
    """Export lines of all cards with their file; the header is ``Question,Answer,FileId``."""
    return sinks.csv_lines(table(spark, d, "flash_cards").select("id", "question", "answer", "origin_id").distinct(), _chunks(spark, d))


def chunk_details(spark: SparkSession, d: str) -> DataFrame:
    return details(_chunks(spark, d), table(spark, d, "flash_cards")).select("id", "file_id", "card_id", "question", "answer")


def one_chunk(spark: SparkSession, d: str) -> DataFrame:
    told = details_of(table(spark, d, "text_chunks"), table(spark, d, "flash_cards"), 7)
    return told.select(F.col("chunk.id").alias("id"), F.size("cards").cast("long").alias("n_cards"), F.array_join(F.transform("cards", lambda c: c["id"].cast("string")), ",").alias("card_ids"))


def point_lookup(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "text_chunks").where(F.col("id") == 7).select("id", "content", "start_position", "end_position", "file_id", "extra_context").distinct()


def dig_deeper(spark: SparkSession, d: str) -> DataFrame:
    """Cards as new documents under ``<file>-deeper``."""
    cards = table(spark, d, "flash_cards").select("id", "question", "answer", "origin_id").distinct()
    chunks = _chunks(spark, d).select(F.col("id").alias("origin_id"), "file_id", "extra_context")
    note = F.lit("Go deeper.")
    context = F.when(F.coalesce("extra_context", F.lit("")) == "", note).otherwise(F.concat_ws("\n", "extra_context", note))
    return skew_left_join(cards.where("origin_id is not null"), chunks, "origin_id", "inner").select("id", F.concat_ws("\n", "question", "answer").alias("content"), F.concat("file_id", F.lit("-deeper")).alias("file_id"), context.alias("extra_context"))


QUERIES = {f.__name__: f for f in (
    token_estimates, line_scan, sentence_split, last_lines, html_escaped,
    prompt_assembly, context_order, qa_parse, completion, card_count, density_chart, density_files, stale_density, csv_lines, chunk_details, one_chunk, point_lookup, dig_deeper,
)}

_C = "(SELECT DISTINCT ON (id) * FROM text_chunks)"
_F = "(SELECT DISTINCT id, question, answer, origin_id FROM flash_cards)"
_COUNTS = f"""counts AS (SELECT c.file_id, c.id AS chunk_id, count(f.id) AS flash_card_count
  FROM (SELECT DISTINCT id, file_id FROM text_chunks) c LEFT JOIN {_F} f ON f.origin_id = c.id GROUP BY c.file_id, c.id)"""
_CHART = f"""{_COUNTS}, nz AS (SELECT list_sort(list(flash_card_count)) AS s, count(*) AS n FROM counts WHERE flash_card_count > 0),
p AS (SELECT [s[greatest(1, floor(n * (i * 0.2))::INT)] for i in [1, 2, 3, 4]] AS p FROM nz),
chart AS (SELECT file_id, chunk_id, flash_card_count, CASE WHEN flash_card_count = 0 THEN 0 WHEN flash_card_count <= p[1] THEN 1 WHEN flash_card_count <= p[2] THEN 2
  WHEN flash_card_count <= p[3] THEN 3 WHEN flash_card_count <= p[4] THEN 4 ELSE 5 END AS intensity FROM counts, p)"""
_WS = "[\\s\\x{85}\\x{A0}\\x{1680}\\x{2000}-\\x{200A}\\x{2028}\\x{2029}\\x{202F}\\x{205F}\\x{3000}\\x{0B}]"
_EDGE = f"^{_WS}+|{_WS}+$"


def _trim(x: str) -> str:
    return f"regexp_replace({x}, '{_EDGE}', '', 'g')"


_RESPONSES = f"""said AS (SELECT origin_id, id // 8 AS part, '<think>Q: none' || chr(10) || 'A: none</think>' || chr(10) || string_agg('Q: ' || coalesce(question, '') || chr(10) || 'A: ' || coalesce(answer, ''), chr(10) ORDER BY id) AS t
  FROM {_F} WHERE origin_id IS NOT NULL GROUP BY origin_id, id // 8),
body AS (SELECT origin_id, part, string_split(substr(t, instr(t, '</think>') + 8), chr(10)) AS l FROM said),
lines AS (SELECT origin_id, part, unnest(l) AS line, generate_subscripts(l, 1) AS n FROM body),
marked AS (SELECT *, sum(CASE WHEN regexp_matches(line, '^{_WS}*Q:') THEN 1 ELSE 0 END) OVER (PARTITION BY origin_id, part ORDER BY n) AS card FROM lines),
answers AS (SELECT *, min(CASE WHEN regexp_matches(line, '^{_WS}*A:') THEN n END) OVER (PARTITION BY origin_id, part, card) AS a FROM marked WHERE card > 0),
cards AS (SELECT origin_id, part, card, string_agg(CASE WHEN n < a THEN line END, chr(10) ORDER BY n) AS q, string_agg(CASE WHEN n >= a THEN line END, chr(10) ORDER BY n) AS w FROM answers WHERE a IS NOT NULL GROUP BY origin_id, part, card)"""

SQL = {
    "token_estimates": f"SELECT id, coalesce({_UTF16.format('content')} // 4, 0) AS n_tokens FROM {_C}",
    "line_scan": f"""SELECT id, (unnest(range(len(k))))::INT AS line_no, unnest(k) AS line FROM (SELECT id, CASE WHEN l[len(l)] = '' THEN l[1:len(l) - 1] ELSE l END AS k
      FROM (SELECT id, string_split_regex(content, '\\r\\n|\\r|\\n') AS l FROM {_C}))""",
    "sentence_split": f"""SELECT id, (unnest(range(len(k))))::INT AS sentence_no, unnest(k) AS sentence FROM (SELECT id, [x for x in [{_trim('y')} for y in
      string_split(regexp_replace(content, '([.!?])[ \\t\\n\\r\\f\\x{{0B}}]+', '\\1' || chr(31), 'g'), chr(31))] if x <> ''] AS k FROM {_C})""",
    "last_lines": f"SELECT id, {_trim('string_split(content, chr(10))[-1]')} AS last_line FROM {_C}",
    "html_escaped": """SELECT DISTINCT file_id, received_at, replace(replace(replace(replace(replace(content, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;'), '''', '&#039;') AS escaped FROM uploads""",
    "prompt_assembly": f"""SELECT id, '<s>[SYSTEM_PROMPT]{INSTRUCTION}[/SYSTEM_PROMPT]' || CASE WHEN coalesce(extra_context, '') <> '' THEN '[INST]# Context' || chr(10) || extra_context || chr(10) || chr(10) ELSE '[INST]' END
      || coalesce(content, '') || '[/INST]' AS prompt FROM {_C}""",
    "context_order": f"SELECT coalesce(extra_context, '') AS context, count(*) AS n_requests, true AS in_one_run FROM {_C} GROUP BY 1",
    "qa_parse": f"WITH {_RESPONSES} SELECT origin_id, part, {_trim("ltrim(q, 'Q:')")} AS question, {_trim("ltrim(w, 'A:')")} AS answer FROM cards",
    "completion": f"""WITH {_RESPONSES}, n AS (SELECT origin_id, count(*) AS k FROM cards GROUP BY 1)
      SELECT id, CASE WHEN id % 11 = 0 THEN 'Failed: out of memory' WHEN id % 13 = 0 THEN 'Cancelled' WHEN coalesce(k, 0) = 0 THEN 'Failed: No flashcards parsed from LLM response.' ELSE 'Completed: ' || k || ' cards created' END AS status FROM {_C} c LEFT JOIN n ON n.origin_id = c.id""",
    "card_count": f"WITH {_COUNTS} SELECT * FROM counts",
    "density_chart": f"WITH {_CHART} SELECT * FROM chart",
    "density_files": f"""WITH {_CHART} SELECT c.file_id, count(*) AS n_chunks, sum(flash_card_count)::BIGINT AS n_cards, max(intensity) AS most, min(s.start_position) AS first_position
      FROM chart c JOIN {_C} s ON s.id = c.chunk_id GROUP BY c.file_id""",
    "stale_density": f"WITH {_COUNTS} SELECT d.chunk_id, d.recorded, flash_card_count FROM (SELECT DISTINCT chunk_id, flash_card_count AS recorded FROM density) d JOIN counts USING (chunk_id) WHERE recorded <> flash_card_count",
    "csv_lines": f"""SELECT f.id, c.file_id, '"' || replace(coalesce(f.question, ''), '"', '""') || '","' || replace(coalesce(f.answer, ''), '"', '""') || '","' || replace(c.file_id, '"', '""') || '"' AS line
      FROM {_F} f JOIN {_C} c ON c.id = f.origin_id""",
    "chunk_details": f"SELECT c.id, c.file_id, f.id AS card_id, f.question, f.answer FROM {_C} c LEFT JOIN {_F} f ON f.origin_id = c.id",
    "one_chunk": f"SELECT (SELECT min(id) FROM text_chunks WHERE id = 7) AS id, count(*) AS n_cards, coalesce(string_agg(id::VARCHAR, ',' ORDER BY id), '') AS card_ids FROM {_F} WHERE origin_id = 7",
    "point_lookup": "SELECT DISTINCT id, content, start_position, end_position, file_id, extra_context FROM text_chunks WHERE id = 7",
    "dig_deeper": f"""SELECT f.id, concat_ws(chr(10), f.question, f.answer) AS content, c.file_id || '-deeper' AS file_id,
      CASE WHEN coalesce(c.extra_context, '') = '' THEN 'Go deeper.' ELSE c.extra_context || chr(10) || 'Go deeper.' END AS extra_context FROM {_F} f JOIN {_C} c ON c.id = f.origin_id""",
}
