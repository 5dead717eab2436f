"""Queries from uploads to chunks: HTML, chunking, results of requests, paged and direct text, settings."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import token_estimate
from ..operators.cards import generate, parse_cards
from ..operators.chunker import chunk
from ..operators.density import card_counts, intensity
from ..operators.html import upload_text
from ..operators.steps import run_steps
from ..operators.store import resubmitted
from ..session import cut, table
from ..sources.readers import direct_text, layered, paged_text, upload_result
from .changes import _GONE, _gone

_PRESETS = {"amber-8b": {"batch_size": "6", "max_tokens": "2560"}, "basalt-14b": {"min_batch": "4", "temperature": "0"}}


def _uploads(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "uploads").where(F.length("content") > 0).select("file_id", "received_at", "extra_context", "strip_html", "content")


def _texts(spark: SparkSession, d: str) -> DataFrame:
    return _uploads(spark, d).withColumn("text", upload_text(F.col("content"), F.col("strip_html")))


def html_to_text(spark: SparkSession, d: str) -> DataFrame:
    return _texts(spark, d).where("strip_html").select("file_id", "received_at", "text")


def upload_chunks(spark: SparkSession, d: str) -> DataFrame:
    return chunk(_texts(spark, d), "text", ["file_id", "received_at"])


def document_chunks(spark: SparkSession, d: str) -> DataFrame:
    return chunk(table(spark, d, "documents"), "text", ["doc_id"])


def upload_summary(spark: SparkSession, d: str) -> DataFrame:
    """Per file its uploads, the empty ones among them and its chunks."""
    made = upload_chunks(spark, d).groupBy("file_id").agg(F.count("*").alias("n_chunks"))
    received = table(spark, d, "uploads").groupBy("file_id").agg(F.count("*").alias("n_uploads"), F.count_if(F.coalesce(F.length("content"), F.lit(0)) == 0).alias("n_rejected"))
    return received.join(made, "file_id", "left").fillna(0, ["n_chunks"])


def upload_results(spark: SparkSession, d: str) -> DataFrame:
    """What the sender is told of each request; the files of one day and context are one request here."""
    request = F.concat_ws("/", F.date_format("received_at", "yyyy-MM-dd"), F.coalesce("extra_context", F.lit("")))
    uploads = table(spark, d, "uploads").withColumn("request", request)
    texts = uploads.where(F.length("content") > 0).withColumn("text", upload_text(F.col("content"), F.col("strip_html")))
    return upload_result(uploads, chunk(texts, "text", ["request", "file_id", "received_at"]), "request")


def resubmitted_chunks(spark: SparkSession, d: str) -> DataFrame:
    """Deleted chunks uploaded once more under their file's name and cut anew."""
    chunks = table(spark, d, "text_chunks").dropDuplicates(["id"])
    return chunk(resubmitted(chunks, _gone(spark, d, "TextChunk")), "content", ["old_id", "file_id", "extra_context"])


def paged_texts(spark: SparkSession, d: str) -> DataFrame:
    """The text of paged documents: paragraphs as blocks, three of them a page."""
    blocks = F.filter(F.split("text", "\n\n"), lambda b: b != "")
    pages = F.when(F.size(blocks) > 0, F.transform(F.sequence(F.lit(0), F.floor((F.size(blocks) - 1) / 3)), lambda i: F.slice(blocks, (i * 3 + 1).cast("int"), F.lit(3)))).otherwise(F.array().cast("array<array<string>>"))
    return table(spark, d, "documents").where("text is not null").select("doc_id", paged_text(pages).alias("text"))


def direct_texts(spark: SparkSession, d: str) -> DataFrame:
    """Texts typed in: named by their time where no name was given (here: where the context is empty)."""
    name = F.when(F.coalesce("extra_context", F.lit("")) != "", F.col("file_id"))
    text, given = direct_text(F.col("content"), name, F.col("received_at"))
    return table(spark, d, "uploads").select("file_id", "received_at", given.alias("name"), text.alias("text"))


def layered_settings(spark: SparkSession, d: str) -> DataFrame:
    """The settings of each preset: defaults, what the preset changes, and a limit from its longest answer."""
    base = F.create_map(*[F.lit(x) for x in ("batch_size", "12", "max_tokens", "2048", "temperature", "0.6")])
    own = F.lit(None).cast("map<string,string>")
    for name, settings in _PRESETS.items():
        own = F.when(F.col("preset") == name, F.create_map(*[F.lit(x) for pair in settings.items() for x in pair])).otherwise(own)
    longest = table(spark, d, "flash_cards").groupBy("preset").agg(F.max(token_estimate(F.col("answer"))).alias("n"))
    of = layered(base, own, F.create_map(F.lit("longest"), F.col("n").cast("string")))
    return longest.select("preset", F.array_join(F.transform(F.array_sort(F.map_entries(of)), lambda e: F.concat_ws("=", e["key"], e["value"])), ";").alias("settings"))


def stepped_responses(spark: SparkSession, d: str) -> DataFrame:
    """The step loop over all chunks with the stub model, at most 64 tokens each."""
    return run_steps(table(spark, d, "text_chunks").dropDuplicates(["id"]), "id", "content", width=12, max_tokens=64)


def density_pipeline(spark: SparkSession, d: str) -> DataFrame:
    """The flagship: uploads are chunked, answered, parsed into cards, counted and put into intensities."""
    made = cut(upload_chunks(spark, d).withColumn("id", F.xxhash64("file_id", "received_at", "chunk_no")).select("id", "file_id", "content"))
    cards = parse_cards(generate(made), "response", ["id"])
    numbered = cards.select(F.xxhash64("id", "card_no").alias("id"), F.col("id").alias("origin_id"))
    counted = cut(card_counts(made, numbered))
    return intensity(counted).groupBy("file_id", "intensity").agg(F.count("*").alias("n_chunks"), F.sum("flash_card_count").alias("n_cards"))


QUERIES = {f.__name__: f for f in (density_pipeline, html_to_text, upload_chunks, document_chunks, upload_summary, upload_results, resubmitted_chunks, paged_texts, direct_texts, layered_settings, stepped_responses)}

_WS = "[\\s\\x{85}\\x{A0}\\x{1680}\\x{2000}-\\x{200A}\\x{2028}\\x{2029}\\x{202F}\\x{205F}\\x{3000}\\x{0B}\\x{1C}-\\x{1F}]"
_NL = "chr(10)"


def _trim(x: str) -> str:
    return f"regexp_replace({x}, '^{_WS}+|{_WS}+$', '', 'g')"


def _units(x: str) -> str:
    return f"(length({x}) + length(regexp_replace({x}, '[^\\x{{10000}}-\\x{{10FFFF}}]', '', 'g')))"


def chunk_ctes(source: str) -> str:
    """CTEs of a WITH RECURSIVE: ``pieces`` (k, chunk_no, content, start_position, end_position) of ``source`` (k, text)."""
    return f"""src AS ({source}),
    rows_in AS (SELECT k, CASE WHEN l[len(l)] = '' THEN l[1:len(l) - 1] ELSE l END AS l FROM (SELECT k, string_split_regex(regexp_replace(text, '^\\x{{FEFF}}', ''), '\\r\\n|\\r|\\n') AS l FROM src WHERE text <> '')),
    buf AS (SELECT k, 0 AS i, '' AS b, CAST(NULL AS VARCHAR) AS block FROM rows_in
      UNION ALL SELECT k, i, CASE WHEN cut_at > 0 THEN substr(b, cut_at::BIGINT + 2) ELSE b END, CASE WHEN cut_at > 0 THEN substr(b, 1, cut_at::BIGINT) END FROM (
        SELECT *, CASE WHEN {_units('b')} < 700 THEN 0 WHEN two > 0 AND length(b) - two - 1 > 0 THEN length(b) - two - 1 WHEN one > 0 THEN length(b) - one ELSE 0 END AS cut_at FROM (
          SELECT k, i, b, instr(reverse(b), {_NL} || {_NL}) AS two, instr(reverse(b), {_NL}) AS one FROM (
            SELECT buf.k, buf.i + 1 AS i, buf.b || r.l[buf.i + 1] || {_NL} AS b FROM buf JOIN rows_in r ON r.k = buf.k WHERE buf.i < len(r.l))))),
    blocks AS (SELECT k, i AS bno, block FROM buf WHERE block IS NOT NULL
      UNION ALL SELECT buf.k, buf.i + 1, buf.b FROM buf JOIN rows_in r ON r.k = buf.k WHERE buf.i = len(r.l) AND buf.b <> ''),
    secs AS (SELECT k, bno, unnest(x) AS s, generate_subscripts(x, 1) AS sno FROM (SELECT k, bno, [t for t in [{_trim('y')} for y in string_split_regex(block, '\\r\\n\\r\\n|\\n\\n')] if t <> ''] AS x FROM blocks)),
    sized AS (SELECT k, bno, sno, s, {_units('s')} AS w FROM secs),
    sents AS (SELECT k, bno, sno, unnest(x) AS s, generate_subscripts(x, 1) AS n, x[len(x)] AS last FROM (SELECT k, bno, sno, [t for t in [{_trim('y')} for y in string_split(regexp_replace(s, '([.!?]){_WS}+', '\\1' || chr(1), 'g'), chr(1))] if t <> ''] AS x FROM sized WHERE w // 4 > 700)),
    widths AS (SELECT *, {_units('s')} AS w FROM sents),
    placed AS (SELECT k, bno, sno, s, w, w // 4 > 700 AS long, (sum(own) OVER o - own)::BIGINT AS before, row_number() OVER (PARTITION BY k, bno ORDER BY sno) AS j, count(*) OVER (PARTITION BY k, bno) AS last
      FROM (SELECT z.*, coalesce(v.total, z.w) AS own FROM sized z LEFT JOIN (SELECT k, bno, sno, sum(w) AS total FROM widths GROUP BY ALL) v USING (k, bno, sno)) WINDOW o AS (PARTITION BY k ORDER BY bno, sno)),
    fold AS (SELECT k, bno, 0::BIGINT AS j, '' AS cur, 0::BIGINT AS size, before AS start, CAST(NULL AS VARCHAR) AS content, 0::BIGINT AS a, 0::BIGINT AS e FROM placed WHERE j = 1
      UNION ALL SELECT p.k, p.bno, p.j, CASE WHEN over THEN '' ELSE cur END || CASE WHEN long THEN '' ELSE s END, CASE WHEN over THEN 0 ELSE size END + CASE WHEN long THEN 0 ELSE w END,
        CASE WHEN over THEN before ELSE start END, CASE WHEN over THEN cur END, start, before
      FROM (SELECT p.*, f.cur, f.size, f.start, f.size > 0 AND (f.size + p.w) // 4 > 700 AS over FROM fold f JOIN placed p ON p.k = f.k AND p.bno = f.bno AND p.j = f.j + 1) p),
    inner_fold AS (SELECT w.k, w.bno, w.sno, 0::BIGINT AS n, '' AS cur, 0::BIGINT AS size, p.before AS start, p.before AS pos, CAST(NULL AS VARCHAR) AS c1, 0::BIGINT AS a1, 0::BIGINT AS e1, CAST(NULL AS VARCHAR) AS c2, 0::BIGINT AS a2, 0::BIGINT AS e2
        FROM widths w JOIN placed p USING (k, bno, sno) WHERE w.n = 1
      UNION ALL SELECT k, bno, sno, n, CASE WHEN full_ THEN '' ELSE now END, CASE WHEN full_ THEN 0 ELSE nsize END, CASE WHEN full_ THEN pos + w ELSE nstart END, pos + w, CASE WHEN over THEN cur END, start, pos, CASE WHEN full_ THEN now END, nstart, pos + w
      FROM (SELECT *, nsize // 4 >= 500 AND s = last AS full_ FROM (
        SELECT w.k, w.bno, w.sno, w.n, w.s, w.last, w.w, f.cur, f.start, f.pos, f.size > 0 AND (f.size + w.w) // 4 > 700 AS over,
          CASE WHEN f.size > 0 AND (f.size + w.w) // 4 > 700 THEN '' ELSE f.cur END || w.s AS now, CASE WHEN f.size > 0 AND (f.size + w.w) // 4 > 700 THEN 0 ELSE f.size END + w.w AS nsize,
          CASE WHEN f.size > 0 AND (f.size + w.w) // 4 > 700 THEN f.pos ELSE f.start END AS nstart
        FROM inner_fold f JOIN widths w ON w.k = f.k AND w.bno = f.bno AND w.sno = f.sno AND w.n = f.n + 1))),
    emitted AS (
      SELECT k, bno, j, 0 AS part, 0::BIGINT AS n, content, a, e FROM fold WHERE content IS NOT NULL
      UNION ALL SELECT f.k, f.bno, f.j + 1, 0, 0, f.cur, f.start, p.before + p.w FROM fold f JOIN placed p ON p.k = f.k AND p.bno = f.bno AND p.j = f.j WHERE f.j = p.last AND f.size > 0 AND NOT p.long
      UNION ALL SELECT f.k, f.bno, f.j + 1, 0, 0, f.cur, f.start, p.before + t.total FROM fold f JOIN placed p ON p.k = f.k AND p.bno = f.bno AND p.j = f.j JOIN (SELECT k, bno, sno, sum(w)::BIGINT AS total FROM widths GROUP BY ALL) t ON t.k = p.k AND t.bno = p.bno AND t.sno = p.sno WHERE f.j = p.last AND f.size > 0 AND p.long
      UNION ALL SELECT i.k, i.bno, p.j, 1, i.n * 2, i.c1, i.a1, i.e1 FROM inner_fold i JOIN placed p USING (k, bno, sno) WHERE i.c1 IS NOT NULL
      UNION ALL SELECT i.k, i.bno, p.j, 1, i.n * 2 + 1, i.c2, i.a2, i.e2 FROM inner_fold i JOIN placed p USING (k, bno, sno) WHERE i.c2 IS NOT NULL
      UNION ALL SELECT i.k, i.bno, p.j, 1, i.n * 2 + 2, i.cur, i.start, i.pos FROM inner_fold i JOIN placed p USING (k, bno, sno) JOIN (SELECT k, bno, sno, max(n) AS top FROM widths GROUP BY ALL) m USING (k, bno, sno) WHERE i.n = m.top AND i.size > 0),
    pieces AS (SELECT k, (row_number() OVER (PARTITION BY k ORDER BY bno, j, part, n) - 1)::INT AS chunk_no, content, a::INT AS start_position, e::INT AS end_position FROM emitted)"""


def _html(x: str) -> str:
    """Text of HTML by regular expressions: comments and scripts go, tags become parts of a list, blank parts go, entities
    are decoded."""
    tag = "</?[a-zA-Z](?:=\\s*\"[^\"]*\"|=\\s*''[^'']*''|[^>=]|=)*>"
    for pattern, by in (("<!--(?:.|\\n|\\r)*?-->", "chr(1)"), ("(?i)<(?:script|style)\\b[^>]*>(?:.|\\n|\\r)*?</(?:script|style)\\s*>", "chr(1)"), (f"({tag})", "chr(1) || chr(3) || '\\1' || chr(1)")):
        x = f"regexp_replace({x}, '{pattern}', {by}, 'g')"
    x = f"array_to_string([CASE WHEN n[1] <> chr(3) THEN n WHEN regexp_matches(n, '(?i)^.<(p|br)[\\s/>]') THEN chr(13) || chr(10) ELSE '' END for n in string_split({x}, chr(1)) if {_trim('n')} <> ''], '')"
    for name, value in (("'&lt;'", "'<'"), ("'&gt;'", "'>'"), ("'&nbsp;'", "chr(160)"), ("'&ndash;'", "chr(8211)"), ("'&#8230;'", "chr(8230)"), ("'&amp;'", "'&'")):
        x = f"replace({x}, {name}, {value})"
    return x


_UP = f"up AS (SELECT row_number() OVER () AS k, file_id, received_at, extra_context, content, CASE WHEN strip_html THEN {_html('content')} ELSE content END AS text FROM uploads WHERE length(content) > 0)"
_OF_UPLOADS = f"WITH RECURSIVE {_UP}, {chunk_ctes('SELECT k, text FROM up')}"
_REQUEST = "strftime(received_at, '%Y-%m-%d') || '/' || coalesce(extra_context, '')"
_CASES = " ".join(f"WHEN preset = '{name}' THEN [{', '.join(f"'{k}={v}'" for k, v in sorted({**{'batch_size': '12', 'max_tokens': '2048', 'temperature': '0.6'}, **own}.items()))}]" for name, own in _PRESETS.items())
_DONE = f"""n AS (SELECT up.file_id, p.k, p.chunk_no, len([x for x in string_split_regex(regexp_replace(p.content, '([.!?])[ \\t\\n\\r\\f\\x{{0B}}]+', '\\1' || chr(31), 'g'), '[.!?]' || chr(31)) if trim(x, ' ') <> '']) AS sentences FROM pieces p JOIN up USING (k)),
  c AS (SELECT file_id, least(3, sentences) AS n FROM n), nz AS (SELECT list_sort(list(n)) AS s, count(*) AS m FROM c WHERE n > 0), p AS (SELECT [s[greatest(1, floor(m * (i * 0.2))::INT)] for i in [1, 2, 3, 4]] AS p FROM nz)"""

SQL = {
    "html_to_text": f"SELECT file_id, received_at, {_html('content')} AS text FROM uploads WHERE strip_html AND length(content) > 0",
    "document_chunks": f"WITH RECURSIVE {chunk_ctes('SELECT doc_id AS k, text FROM documents')} SELECT k AS doc_id, chunk_no, content, start_position, end_position FROM pieces",
    "upload_chunks": f"{_OF_UPLOADS} SELECT file_id, received_at, chunk_no, p.content, start_position, end_position FROM pieces p JOIN up USING (k)",
    "upload_summary": f"""{_OF_UPLOADS}, made AS (SELECT file_id, count(*) AS n FROM pieces JOIN up USING (k) GROUP BY 1)
      SELECT file_id, count(*) AS n_uploads, count(*) FILTER (WHERE coalesce(length(content), 0) = 0) AS n_rejected, coalesce(any_value(made.n), 0) AS n_chunks FROM uploads LEFT JOIN made USING (file_id) GROUP BY file_id""",
    "upload_results": f"""{_OF_UPLOADS}, made AS (SELECT {_REQUEST} AS request, count(*) AS n FROM pieces JOIN up USING (k) GROUP BY 1),
      r AS (SELECT {_REQUEST} AS request, count(*) AS n, max(coalesce(length(content), 0)) > 0 AS ok FROM uploads GROUP BY 1)
      SELECT request, ok AS success, CASE WHEN ok THEN r.n ELSE 0 END AS files_processed, CASE WHEN ok THEN coalesce(made.n, 0) ELSE 0 END AS chunks_added,
        CASE WHEN ok THEN 'Successfully uploaded ' || r.n || ' file(s) and added ' || coalesce(made.n, 0) || ' chunks for processing.' ELSE 'No files uploaded' END AS message FROM r LEFT JOIN made USING (request)""",
    "resubmitted_chunks": f"""WITH RECURSIVE lost AS (SELECT DISTINCT ON (id) id, file_id, extra_context, content FROM text_chunks WHERE id IN {_GONE.format('TextChunk')}), {chunk_ctes('SELECT id AS k, content AS text FROM lost')}
      SELECT l.id AS old_id, file_id, nullif(extra_context, '') AS extra_context, chunk_no, p.content, start_position, end_position FROM pieces p JOIN lost l ON l.id = p.k""",
    "paged_texts": f"""SELECT doc_id, array_to_string([array_to_string([x || {_NL} || {_NL} for x in b[i * 3 + 1:i * 3 + 3]], '') || '---' || {_NL} for i in range(0, ((len(b) + 2) // 3)::BIGINT)], '') AS text
      FROM (SELECT doc_id, [x for x in string_split(text, {_NL} || {_NL}) if x <> ''] AS b FROM documents WHERE text IS NOT NULL)""",
    "direct_texts": f"""SELECT file_id, received_at, CASE WHEN coalesce(extra_context, '') <> '' THEN file_id ELSE 'text_input_' || replace(replace(strftime(received_at, '%Y-%m-%dT%H:%M:%S.%gZ'), ':', '-'), '.', '-') || '.txt' END AS name, {_trim('content')} AS text FROM uploads""",
    "layered_settings": f"""SELECT preset, array_to_string(list_sort(list_append(CASE {_CASES} ELSE ['batch_size=12', 'max_tokens=2048', 'temperature=0.6'] END, 'longest=' || n)), ';') AS settings FROM (
      SELECT preset, max(coalesce({_units('answer')} // 4, 0)) AS n FROM flash_cards GROUP BY 1)""",
    "stepped_responses": """SELECT id, array_to_string(w[1:64], ' ') AS response, least(64, len(w))::INT AS n_tokens, CAST(NULL AS VARCHAR) AS error FROM (
      SELECT id, [x for x in string_split_regex(coalesce(content, ''), '[\\s\\x{85}\\x{A0}\\x{1680}\\x{2000}-\\x{200A}\\x{2028}\\x{2029}\\x{202F}\\x{205F}\\x{3000}\\x{0B}\\x{1C}-\\x{1F}]+') if x <> ''] AS w FROM (SELECT DISTINCT ON (id) id, content FROM text_chunks))""",
    "density_pipeline": f"""{_OF_UPLOADS}, {_DONE}
      SELECT file_id, CASE WHEN n = 0 THEN 0 WHEN n <= p[1] THEN 1 WHEN n <= p[2] THEN 2 WHEN n <= p[3] THEN 3 WHEN n <= p[4] THEN 4 ELSE 5 END AS intensity, count(*) AS n_chunks, sum(n)::BIGINT AS n_cards FROM c, p GROUP BY ALL""",
}
