"""Queries on rules for generated text, templates and work in progress."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.cards import GENERIC, TEMPLATES, conversation, live_work, template_of, wrapped
from ..operators.density import card_counts
from ..operators.queue import next_batch, room
from ..operators.references import chunk_states
from ..operators.rules import Rule, RuleSet, copied_rules, live_rules, longest_patterns, permitted, replay
from ..operators.store import number_rows, retry_chunks
from ..session import table
from ..sources.readers import Options, banned_rules
from ..sources.sinks import json_responses, name_uuid
from ..streaming.progress import status_counts, work_list
from .changes import _C, _F, _GONE, _cards, _chunks, _gone, _highest, _log

BANNED = (("the reservoir", False), (" fails and", True), ("at 4", False))
SEQUENCES, NEXT_TO = (("If", "a"), ("When", "the"), ("The",)), ("If", "a", "the", "When", "The", "glacier", "</s>")
ALLOWED = RuleSet(ends=frozenset({"</s>"})).add(*(Rule("allow", "tokens", s) for s in SEQUENCES), Rule("ban", "token", "the", 1, 3), Rule("ban", "text", "glac"))
MODELS = {"amber-8b": "Mistral-Small-3.2-24B-Instruct-2506-Q5", "flint-4b": "unsloth/Mistral-Small-3.2-24B-Instruct-2506"}


def _tokens(column: str):
    """Words with the blanks before them: together they are the text up to its last blanks."""
    return F.regexp_extract_all(column, F.lit(r"[ \t\r\n]*[^ \t\r\n]+"), F.lit(0))


def text_ban_replay(spark: SparkSession, d: str) -> DataFrame:
    """Answers put through text bans: what is left of each, and how often something was taken back."""
    rules = RuleSet().add(*(Rule("ban", "text", text, ban_last=last) for text, last in BANNED))
    told = replay(table(spark, d, "flash_cards").select("id", "answer").distinct(), "id", _tokens("answer"), rules)
    return told.select("id", "text", "n_tokens", F.size("events").alias("n_bans"), F.aggregate("events", F.lit(0), lambda a, e: a + e["rewind"]).alias("taken_back"))


def text_ban_events(spark: SparkSession, d: str) -> DataFrame:
    """Every ban met: the token banned and the part of the timeline."""
    rules = RuleSet().add(*(Rule("ban", "text", text, ban_last=last) for text, last in BANNED))
    told = replay(table(spark, d, "flash_cards").select("id", "answer").distinct(), "id", _tokens("answer"), rules)
    return told.select("id", F.inline("events"))


def allowed_next(spark: SparkSession, d: str) -> DataFrame:
    """Which of a few tokens may follow the first two words of each answer under allowed sequences, bans and a text ban."""
    words = F.slice(F.filter(F.split(F.coalesce("answer", F.lit("")), r"[ \t\r\n]+", -1), lambda w: w != ""), 1, 2)
    return permitted(table(spark, d, "flash_cards").select("id", "answer").distinct(), "id", words, list(NEXT_TO), ALLOWED, frozenset({"</s>"}))


def rules_alive(spark: SparkSession, d: str) -> DataFrame:
    """Rules after additions, clearings and resets; the change log gives the changes, a scope is an id modulo 7."""
    change = F.when(F.col("op") == "update", "add").when(F.col("op") == "delete", "clear").otherwise("reset")
    log = _log(spark, d).select("seq", F.concat(F.lit("s"), F.pmod("id", F.lit(7)).cast("string")).alias("scope"), F.col("entity").alias("kind"), change.alias("change"), F.col("id").cast("string").alias("pattern"))
    return copied_rules(live_rules(log, "scope", "seq").select("scope", "kind", "seq", "pattern"), "scope", "s1", "copy")


def rule_lengths(spark: SparkSession, d: str) -> DataFrame:
    """The longest banned text (nations) and token sequence (names of parts) of a table of rules."""
    texts = table(spark, d, "nation").select(F.col("n_name").alias("text"), F.lit(None).cast("array<string>").alias("tokens"))
    return longest_patterns(texts.unionByName(table(spark, d, "part").select(F.lit(None).cast("string").alias("text"), F.split("p_name", " ").alias("tokens"))))


def settings_bans(spark: SparkSession, d: str) -> DataFrame:
    """Texts that the settings ban, as permanent rules."""
    names = [r.r_name for r in table(spark, d, "region").select("r_name").distinct().orderBy("r_name").collect()]  # a setting
    return banned_rules(Options(banned_texts=names)).frame(spark).select("no", "mode", "text", "start", "duration", "ban_duration")


def chat_template(spark: SparkSession, d: str) -> DataFrame:
    """Each card as a conversation in its template."""
    cards = table(spark, d, "flash_cards").select("id", "question", "answer").distinct()
    turn = lambda n, role, text: F.struct(F.lit(n).alias("turn"), F.lit(role).alias("role"), F.coalesce(text, F.lit("")).alias("text"))
    turns = cards.select("id", F.inline(F.array(turn(0, "System", F.lit("Answer.")), turn(1, "user", F.col("question")), turn(2, "assistant", F.col("answer")))))
    return conversation(turns, "id", "turn", "role", "text")


def template_choice(spark: SparkSession, d: str) -> DataFrame:
    """The template of each card's model and the question in it, without what follows it."""
    names = F.coalesce(F.create_map(*[F.lit(x) for pair in MODELS.items() for x in pair])[F.col("preset")], F.col("preset"))
    cards = table(spark, d, "flash_cards").select("id", "question", "preset").distinct().withColumn("template", template_of(names))
    return cards.select("id", "preset", "template", wrapped(F.lit("user"), F.coalesce("question", F.lit("")), F.col("template"), after=False).alias("prompt"))


def _progress(spark: SparkSession, d: str) -> DataFrame:
    told = F.max(F.struct("event_id", "event_type"))["event_type"].alias("text")
    return table(spark, d, "events").groupBy(F.col("user_id").alias("id")).agg(F.count("*").alias("n_tokens"), told, F.bool_or(F.col("event_type") == "purchase").alias("completed"))


def live_status(spark: SparkSession, d: str) -> DataFrame:
    """Chunks in work with their status text; the events of a user are the tokens of the chunk with that id."""
    return live_work(_chunks(spark, d), _progress(spark, d), "id", 24_736)


def _work(spark: SparkSession, d: str) -> DataFrame:
    counted = card_counts(table(spark, d, "text_chunks"), table(spark, d, "flash_cards")).select(F.col("chunk_id").alias("id"), F.col("flash_card_count").alias("n_cards"))
    joined = _chunks(spark, d).join(counted, "id").join(_progress(spark, d).select("id", "n_tokens", "text"), "id", "left")
    status = F.when(F.col("n_cards") > 0, F.concat(F.lit("Completed: "), F.col("n_cards").cast("string"), F.lit(" cards created"))).when(F.col("n_tokens").isNotNull(), "Processing").otherwise("Queued")
    return joined.select("id", status.alias("status"), F.coalesce("text", F.lit("")).alias("response"), F.lit(0).alias("rewind_chars"), "n_cards", "n_tokens", F.col("saved_at").alias("at"))


def status_report(spark: SparkSession, d: str) -> DataFrame:
    """What a status push carries: processed, remaining, tokens and tokens per second."""
    return status_counts(_work(spark, d))


def work_items(spark: SparkSession, d: str) -> DataFrame:
    """The list of work in a status push: all that is not queued."""
    return work_list(_work(spark, d))


def live_with_cards(spark: SparkSession, d: str) -> DataFrame:
    """Chunks that are not deleted and have cards."""
    gone = chunk_states(_log(spark, d), "TextChunk").where("deleted").select(F.col("id").alias("chunk_id"))
    return card_counts(table(spark, d, "text_chunks"), table(spark, d, "flash_cards")).where("flash_card_count > 0").join(gone, "chunk_id", "left_anti")


def chart_order(spark: SparkSession, d: str) -> DataFrame:
    """Chunks in the order of the chart: file, then start."""
    return number_rows(_chunks(spark, d).select("file_id", "start_position", "id"), ["file_id", "start_position", "id"], "place")


def export_order(spark: SparkSession, d: str) -> DataFrame:
    """Cards in the order of the export: file, then card."""
    files = _chunks(spark, d).select(F.col("id").alias("origin_id"), "file_id")
    return number_rows(_cards(spark, d).join(files, "origin_id").select("file_id", "id"), ["file_id", "id"], "place")


def taken_batch(spark: SparkSession, d: str) -> DataFrame:
    """What is taken from the queue with five in work and a batch width of 12."""
    return next_batch(_chunks(spark, d).select("id", "saved_at"), ["saved_at", "id"], 12, 5).select("id")


def retried(spark: SparkSession, d: str) -> DataFrame:
    """Chunks named by updates in the log start anew: their cards go, they come back under new ids."""
    ids = _log(spark, d).where("op = 'update'").select("id").distinct()
    chunks, cards = _chunks(spark, d).select("id", "file_id", "content"), _cards(spark, d)
    kept, left, anew = retry_chunks(chunks, cards, ids, _highest(chunks))
    none = F.lit(None).cast("long")
    return (
        kept.select(F.lit("chunk").alias("entity"), "id", none.alias("old_id"))
        .unionByName(left.select(F.lit("card").alias("entity"), "id", none.alias("old_id")))
        .unionByName(anew.select(F.lit("queued").alias("entity"), "id", "old_id"))
    )


def json_cards(spark: SparkSession, d: str) -> DataFrame:
    """The side file of each chunk's cards, with the chunk inside, under a name of its own."""
    cards = _cards(spark, d).where("origin_id is not null").withColumn("part", F.floor(F.col("id") / 8))
    parsed = cards.select("origin_id", "part", F.col("id").alias("card_no"), "question", "answer")
    told = json_responses(parsed, _chunks(spark, d), ["origin_id", "part"], "origin_id")
    return told.select("origin_id", "part", name_uuid(F.concat_ws("/", "origin_id", "part")).alias("name"), "json")


QUERIES = {f.__name__: f for f in (
    text_ban_replay, text_ban_events, allowed_next, rules_alive, rule_lengths, settings_bans, chat_template, template_choice, live_status, status_report, work_items, live_with_cards, chart_order, export_order, taken_batch, retried, json_cards,
)}

_COUNTS = f"""(SELECT c.file_id, c.id AS chunk_id, count(f.id) AS flash_card_count, any_value(c.saved_at) AS saved_at FROM {_C} c LEFT JOIN {_F} f ON f.origin_id = c.id GROUP BY 1, 2)"""
_HIT = "CASE WHEN instr(substr({t}, greatest(0, length({t}) - length({k}) - {n} + 1) + 1), '{p}') > 0 THEN greatest(0, length({t}) - length({k}) - {n} + 1) + instr(substr({t}, greatest(0, length({t}) - length({k}) - {n} + 1) + 1), '{p}') - 1 ELSE -1 END"
_AT = ", ".join(_HIT.format(t="body", k="tok", n=len(p), p=p) + f" AS m{i}" for i, (p, _) in enumerate(BANNED))
_LAST = " ".join(f"WHEN m{i} >= 0 THEN {str(last).lower()}" for i, (_, last) in enumerate(BANNED))
_MET = " ".join(f"WHEN m{i} >= 0 THEN m{i}" for i in range(len(BANNED)))
_REPLAY = f"""WITH RECURSIVE t AS (SELECT id, regexp_extract_all(answer, '[ \\t\\r\\n]*[^ \\t\\r\\n]+') AS w FROM (SELECT DISTINCT id, answer FROM flash_cards)),
  r AS (SELECT id, 0::BIGINT AS i, CAST([] AS VARCHAR[]) AS kept, 0::BIGINT AS rewind, CAST(NULL AS VARCHAR) AS banned, 0::BIGINT AS ban_from FROM t
    UNION ALL SELECT id, i, kept[1:len(kept) - n], n, CASE WHEN n > 0 THEN kept[len(kept) - n + 1] END, len(kept) - n FROM (
      SELECT *, CASE WHEN met < 0 THEN 0 WHEN last THEN 1 ELSE list_min([x for x in range(1, len(kept) + 1) if length(array_to_string(kept[len(kept) - x + 1:], '')) >= length(body) - met]) END AS n FROM (
        SELECT *, CASE {_MET} ELSE -1 END AS met, CASE {_LAST} ELSE false END AS last FROM (SELECT *, {_AT} FROM (
          SELECT *, array_to_string(kept, '') AS body FROM (SELECT r.id, r.i + 1 AS i, t.w[r.i + 1] AS tok, list_append(r.kept, t.w[r.i + 1]) AS kept FROM r JOIN t ON t.id = r.id WHERE r.i < len(t.w)))))))"""
_H = f"(SELECT id, [x for x in string_split_regex(coalesce(answer, ''), '[ \\t\\r\\n]+') if x <> ''][1:2] AS h FROM (SELECT DISTINCT id, answer FROM flash_cards))"
_SEQ = ", ".join("[" + ", ".join(f"'{t}'" for t in s) + "]" for s in (*SEQUENCES, ("</s>",)))
_DB = "(SELECT seq, 's' || (id % 7) AS scope, entity AS kind, CASE op WHEN 'update' THEN 'add' WHEN 'delete' THEN 'clear' ELSE 'reset' END AS change, id::VARCHAR AS pattern FROM (SELECT DISTINCT * FROM change_log))"
_T = TEMPLATES[GENERIC]["user"][0].replace("\n", "' || chr(10) || '")
_P = "(SELECT user_id AS id, count(*) AS n_tokens, max_by(event_type, event_id) AS text, bool_or(event_type = 'purchase') AS completed FROM events GROUP BY 1)"
_W = f"""(SELECT c.chunk_id AS id, CASE WHEN flash_card_count > 0 THEN 'Completed: ' || flash_card_count || ' cards created' WHEN p.id IS NOT NULL THEN 'Processing' ELSE 'Queued' END AS status,
  coalesce(p.text, '') AS response, 0 AS rewind_chars, flash_card_count AS n_cards, p.n_tokens, saved_at FROM {_COUNTS} c LEFT JOIN {_P} p ON p.id = c.chunk_id)"""

SQL = {
    "text_ban_replay": f"""{_REPLAY} SELECT id, array_to_string(arg_max(kept, i), '') AS text, len(arg_max(kept, i))::INT AS n_tokens, count(*) FILTER (WHERE rewind > 0)::INT AS n_bans, sum(rewind)::INT AS taken_back FROM r GROUP BY id""",
    "text_ban_events": f"{_REPLAY} SELECT id, (i - 1)::INT AS idx, rewind::INT AS rewind, banned, ban_from::INT AS ban_from, 3 AS ban_for FROM r WHERE rewind > 0",
    "allowed_next": f"""SELECT id, token, CASE WHEN contains(token, 'glac') THEN false WHEN token = '</s>' THEN true
        WHEN NOT list_contains(CASE WHEN len(h) = 0 THEN [s[1] for s in [{_SEQ}]] ELSE [s[list_max([k for k in range(0, len(s) + 1) if k <= len(h) and (k = 0 or h[len(h) - k + 1:] = s[1:k])])::BIGINT + 1] for s in [{_SEQ}]
          if list_max([k for k in range(0, len(s) + 1) if k <= len(h) and (k = 0 or h[len(h) - k + 1:] = s[1:k])]) between 1 and len(s) - 1] END, token) THEN false
        ELSE NOT (token = 'the' AND len(h) >= 1 AND len(h) - 1 < 3) END AS allowed FROM {_H}, (SELECT unnest({list(NEXT_TO)}) AS token)""",
    "rules_alive": f"""WITH l AS {_DB}, a AS (SELECT scope, kind, seq, pattern FROM l WHERE change = 'add' AND NOT EXISTS (SELECT 1 FROM l x WHERE x.scope = l.scope AND x.seq > l.seq AND (x.change = 'reset' OR x.change = 'clear' AND x.kind = l.kind)))
      SELECT * FROM a UNION ALL SELECT 'copy', kind, seq, pattern FROM a WHERE scope = 's1'""",
    "rule_lengths": "SELECT (SELECT max(length(n_name)) FROM nation)::INT AS characters, (SELECT max(len(string_split(p_name, ' '))) FROM part)::INT AS tokens",
    "settings_bans": "SELECT (row_number() OVER (ORDER BY r_name) - 1)::INT AS no, 'ban' AS mode, r_name AS text, 0 AS start, -1 AS duration, 3 AS ban_duration FROM (SELECT DISTINCT r_name FROM region)",
    "chat_template": "SELECT id, '<s>[SYSTEM_PROMPT]Answer.[/SYSTEM_PROMPT][INST]' || coalesce(question, '') || '[/INST]' || coalesce(answer, '') || '</s>' AS prompt FROM (SELECT DISTINCT id, question, answer FROM flash_cards)",
    "template_choice": f"""SELECT id, preset, CASE WHEN preset IN ('amber-8b', 'flint-4b') THEN 'mistral' ELSE '{GENERIC}' END AS template, CASE WHEN preset IN ('amber-8b', 'flint-4b') THEN '[INST]' ELSE '{_T}' END || coalesce(question, '') AS prompt
      FROM (SELECT DISTINCT id, question, preset FROM flash_cards)""",
    "live_status": f"""SELECT id, CASE WHEN completed THEN 'Processing complete' ELSE 'Processing (' || n_tokens || '/' || (24736 - ((SELECT count(*) FROM events) - n_tokens)) || ' tokens)' END AS status, text AS response FROM {_P} WHERE id IN (SELECT id FROM text_chunks)""",
    "status_report": f"""SELECT count(*) FILTER (WHERE n_cards > 0) AS processed, count(*) FILTER (WHERE status = 'Queued') AS remaining, coalesce(sum(n_tokens), 0)::BIGINT AS total_tokens,
      CASE WHEN max(saved_at) > min(saved_at) AND sum(n_tokens) > 0 THEN round(sum(n_tokens) / ((epoch_us(max(saved_at)) - epoch_us(min(saved_at))) / 1e6), 6) END AS tokens_per_second FROM {_W}""",
    "work_items": f"SELECT id, status, response, rewind_chars FROM {_W} WHERE status <> 'Queued'",
    "live_with_cards": f"SELECT file_id, chunk_id, flash_card_count FROM {_COUNTS} WHERE flash_card_count > 0 AND chunk_id NOT IN {_GONE.format('TextChunk')}",
    "chart_order": f"SELECT file_id, start_position, id, row_number() OVER (ORDER BY file_id NULLS FIRST, start_position NULLS FIRST, id) AS place FROM {_C}",
    "export_order": f"SELECT file_id, f.id, row_number() OVER (ORDER BY file_id NULLS FIRST, f.id) AS place FROM {_F} f JOIN {_C} c ON c.id = f.origin_id",
    "taken_batch": f"SELECT id FROM {_C} ORDER BY saved_at NULLS FIRST, id LIMIT {room(12, 5)}",
    "retried": f"""WITH u AS (SELECT DISTINCT id FROM change_log WHERE op = 'update'), k AS (SELECT id FROM text_chunks WHERE id IN (SELECT id FROM u))
      SELECT 'chunk' AS entity, id, CAST(NULL AS BIGINT) AS old_id FROM {_C} WHERE id NOT IN (SELECT id FROM k) UNION ALL SELECT 'card', id, NULL FROM {_F} WHERE origin_id IS NULL OR origin_id NOT IN (SELECT id FROM k)
      UNION ALL SELECT 'queued', row_number() OVER (ORDER BY id) + (SELECT max(id) FROM text_chunks), id FROM {_C} WHERE id IN (SELECT id FROM k)""",
    "json_cards": f"""SELECT origin_id, part, substr(h, 1, 8) || '-' || substr(h, 9, 4) || '-' || substr(h, 13, 4) || '-' || substr(h, 17, 4) || '-' || substr(h, 21) AS name, json FROM (
      SELECT f.origin_id, f.id // 8 AS part, md5(f.origin_id || '/' || (f.id // 8)) AS h, to_json(list({{'Id': 0, 'Question': f.question, 'Answer': f.answer, 'OriginId': 0,
        'Origin': CASE WHEN c.id IS NOT NULL THEN {{'Id': c.id, 'Content': c.content, 'StartPosition': c.start_position, 'EndPosition': c.end_position, 'FileId': c.file_id, 'ExtraContext': c.extra_context}} END}} ORDER BY f.id))::VARCHAR AS json
      FROM {_F} f LEFT JOIN {_C} c ON c.id = f.origin_id WHERE f.origin_id IS NOT NULL GROUP BY 1, 2)""",
}
