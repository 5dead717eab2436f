"""Queries on the work queue, guards on generated text, sampling and progress."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import token_estimate
from ..operators.guard import active_rules, allowed_tokens, banned_spans, banned_tokens, immediate_repeats, line_repeat_stop, low_diversity_stop, progress_fold, sequence_bans, single_token_bans, tokens_of
from ..operators.queue import admit, context_groups, fifo_batches, gate
from ..operators.sampling import draw, greedy, min_p, sample, softmax, top_k, top_p, typical, until_stop
from ..session import table
from ..sources.readers import Options, banned_rules
from ..streaming.rates import burst_rates

PHRASES = ["the reservoir", "fails and", "at 4"]
SEQUENCES = [["within", "29"], ["must", "be", "reset."]]
ALLOWED_WORDS = ["The", "If", "Without", "When", " the", " a", " deep", " rule", " slow", " smooth"]
RULES = [(" the", 0, 3), ("glacier", 2, 5), ("beacon", 0, 0)]


def _requests(spark: SparkSession, d: str) -> DataFrame:
    chunks = table(spark, d, "text_chunks").dropDuplicates(["id"])
    return chunks.select("id", "file_id", "extra_context", "saved_at", token_estimate(F.col("content")).alias("n_tokens"))


def _answers(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "flash_cards").select("id", "answer").distinct()


def _logits(spark: SparkSession, d: str) -> DataFrame:
    told = table(spark, d, "embeddings").select("vec_id", F.posexplode("embedding").alias("token_id", "logit"))
    return told.withColumn("logit", F.col("logit").cast("double") * 8)


def fifo_batch(spark: SparkSession, d: str) -> DataFrame:
    return fifo_batches(_requests(spark, d), ["saved_at", "id"], 12).select("id", "queue_no", "batch_no")


def queue_depth(spark: SparkSession, d: str) -> DataFrame:
    done = table(spark, d, "flash_cards").select(F.col("origin_id").alias("id"))
    return _requests(spark, d).join(done, "id", "left_anti").agg(F.count("*").alias("n_remaining"))


def admission_prefix(spark: SparkSession, d: str) -> DataFrame:
    return admit(_requests(spark, d), "id", "file_id", ["saved_at", "id"], F.col("n_tokens") + 2048, 24_736, 12).select("id", "file_id", "cost", "fits_alone", "admitted")


def context_group(spark: SparkSession, d: str) -> DataFrame:
    return context_groups(_requests(spark, d))


def gate_release(spark: SparkSession, d: str) -> DataFrame:
    """When each event would leave the gate of 8 requests or 90 seconds."""
    return gate(table(spark, d, "events").select("event_id", "ts"), "ts", "event_id", 8, 90)


def burst_rate(spark: SparkSession, d: str) -> DataFrame:
    events = table(spark, d, "events").select("user_id", "ts", F.length("props").cast("long").alias("n_tokens"))
    return burst_rates(events, "user_id", "ts", "n_tokens", "6 hours")


def event_progress(spark: SparkSession, d: str) -> DataFrame:
    """Text folded from the events of each user and hour, every third event taking back characters."""
    events = table(spark, d, "events").select(F.concat_ws("/", "user_id", F.date_trunc("hour", "ts").cast("string")).alias("item"), "event_id", F.col("event_type").alias("token"), F.pmod("event_id", F.lit(3)).cast("int").alias("rewind"))
    return progress_fold(events, "item", "event_id", "token", "rewind")


def low_diversity(spark: SparkSession, d: str) -> DataFrame:
    """Texts whose last 20 signs, taken as tokens, come down to fewer than five different ones: documents by characters."""
    return low_diversity_stop(table(spark, d, "documents"), "doc_id", F.split(F.coalesce("text", F.lit("")), ""))


def immediate_repeat(spark: SparkSession, d: str) -> DataFrame:
    """Characters of documents that come twice in a row."""
    signs = table(spark, d, "documents").select("doc_id", F.posexplode(F.split(F.coalesce("text", F.lit("")), "")).alias("idx", "token"))
    return immediate_repeats(signs, "doc_id")


def line_repeat(spark: SparkSession, d: str) -> DataFrame:
    return line_repeat_stop(table(spark, d, "text_chunks").dropDuplicates(["id"]), "id", "content")


def banned_text_spans(spark: SparkSession, d: str) -> DataFrame:
    return banned_spans(tokens_of(_answers(spark, d), "id", "answer"), "id", PHRASES)


def single_token_ban(spark: SparkSession, d: str) -> DataFrame:
    vocabulary = tokens_of(_answers(spark, d), "id", "answer").select("token").distinct()
    rules = banned_rules(Options(banned_texts=["oar", "vx", "ith."]))
    return single_token_bans(vocabulary, [r.pattern for r in rules.of("ban", "text")])


def token_sequence_bans(spark: SparkSession, d: str) -> DataFrame:
    return sequence_bans(tokens_of(_answers(spark, d), "id", "answer"), "id", SEQUENCES)


def token_rule_bans(spark: SparkSession, d: str) -> DataFrame:
    rules = spark.createDataFrame([(t.strip(), s, n) for t, s, n in RULES], "token string, start int, duration int")
    steps = tokens_of(_answers(spark, d), "id", "answer").withColumnRenamed("idx", "step")
    return banned_tokens(steps, rules).select("id", "step", "token")


def rules_in_force(spark: SparkSession, d: str) -> DataFrame:
    """Rules active at the length of each answer in tokens: a rule a nation, from its key on, for as many steps as its region's."""
    rules = table(spark, d, "nation").select(F.col("n_name").alias("token"), F.col("n_nationkey").cast("int").alias("start"), (F.col("n_regionkey") * 5).cast("int").alias("duration"))
    steps = _answers(spark, d).select("id", F.size(F.filter(F.split(F.coalesce("answer", F.lit("")), r"[ \t\r\n]+", -1), lambda w: w != "")).alias("step"))
    return active_rules(steps.join(F.broadcast(rules)), "step").select("id", "step", "token")  # 25 rules


def allowed_text(spark: SparkSession, d: str) -> DataFrame:
    """Which words may follow the beginning of each answer if a text must be a run of the words in ALLOWED_WORDS."""
    words = F.split(F.coalesce("answer", F.lit("")), " ", -1)
    candidates = _answers(spark, d).select("id", F.array_join(F.slice(words, 1, 2), " ").alias("text"), F.concat(F.lit(" "), F.coalesce(F.get(words, F.lit(2)), F.lit(""))).alias("token"))
    return allowed_tokens(candidates, ALLOWED_WORDS).select("id", "text", "token")


def greedy_pick(spark: SparkSession, d: str) -> DataFrame:
    return greedy(_logits(spark, d), ["vec_id"])


def topk_filter(spark: SparkSession, d: str) -> DataFrame:
    return top_k(_logits(spark, d), ["vec_id"], 5).select("vec_id", "token_id", "logit")


def topp_filter(spark: SparkSession, d: str) -> DataFrame:
    return top_p(_logits(spark, d), ["vec_id"], 0.9).select("vec_id", "token_id", "logit")


def minp_filter(spark: SparkSession, d: str) -> DataFrame:
    return min_p(_logits(spark, d), ["vec_id"], 0.1).select("vec_id", "token_id", "logit")


def typical_filter(spark: SparkSession, d: str) -> DataFrame:
    return typical(_logits(spark, d), ["vec_id"], 0.5).select("vec_id", "token_id", "logit")


def stop_token(spark: SparkSession, d: str) -> DataFrame:
    """How many words of each answer come before the first of a few that stop it."""
    return until_stop(tokens_of(_answers(spark, d), "id", "answer"), "id", ["which", "while", "because"])


def greedy_sample(spark: SparkSession, d: str) -> DataFrame:
    """The whole chain at temperature 0 with every third token banned."""
    return sample(_logits(spark, d), ["vec_id"], banned=F.col("token_id") % 3 == 0, temperature=0)


def softmax_top(spark: SparkSession, d: str) -> DataFrame:
    return softmax(top_k(_logits(spark, d), ["vec_id"], 3), ["vec_id"], 0.6).select("vec_id", "token_id", F.round("p", 6).alias("p"))


def sampled_tokens(spark: SparkSession, d: str) -> DataFrame:
    return sample(_logits(spark, d), ["vec_id"], seed=7)


def drawn_tokens(spark: SparkSession, d: str) -> DataFrame:
    return draw(_logits(spark, d), ["vec_id"], seed=7)


QUERIES = {f.__name__: f for f in (
    fifo_batch, queue_depth, admission_prefix, context_group, gate_release, burst_rate, event_progress, low_diversity, immediate_repeat, line_repeat, banned_text_spans,
    single_token_ban, token_sequence_bans, token_rule_bans, rules_in_force, allowed_text, greedy_pick, topk_filter, topp_filter, minp_filter, typical_filter, stop_token, greedy_sample, softmax_top, sampled_tokens, drawn_tokens,
)}

_C = "(SELECT DISTINCT ON (id) *, coalesce((length(content) + length(regexp_replace(content, '[^\\x{10000}-\\x{10FFFF}]', '', 'g'))) // 4, 0) AS n_tokens FROM text_chunks)"
_A = "(SELECT DISTINCT id, answer FROM flash_cards)"
_WORDS = """(SELECT {0}, unnest(w) AS token, unnest(range(len(w)))::INT AS idx FROM (SELECT {0}, [x for x in string_split_regex(coalesce({1}, ''), '[ \\t\\r\\n]+') if x <> ''] AS w FROM {2}))"""
_TOKENS = _WORDS.format("id", "answer", _A)
_LOGITS = "(SELECT vec_id, unnest(range(len(embedding)))::INT AS token_id, unnest(embedding)::DOUBLE * 8 AS logit FROM embeddings)"
_P = f"(SELECT *, exp(logit - max(logit) OVER w) / sum(exp(logit - m)) OVER w AS p FROM (SELECT *, max(logit) OVER (PARTITION BY vec_id) AS m FROM {_LOGITS}) WINDOW w AS (PARTITION BY vec_id))"
_SPACED = f"(SELECT id, string_agg(token, ' ' ORDER BY idx) AS body FROM {_TOKENS} GROUP BY id)"

SQL = {
    "fifo_batch": f"SELECT id, n AS queue_no, (n - 1) // 12 AS batch_no FROM (SELECT id, row_number() OVER (ORDER BY saved_at, id) AS n FROM {_C})",
    "queue_depth": f"SELECT count(*) AS n_remaining FROM {_C} WHERE id NOT IN (SELECT origin_id FROM flash_cards WHERE origin_id IS NOT NULL)",
    "admission_prefix": f"""SELECT id, file_id, cost, cost + 1000 <= 24736 AS fits_alone, (cost + 1000 <= 24736) AND run + 1000 <= 24736 AND place <= 12 AS admitted FROM (
      SELECT *, sum(CASE WHEN cost + 1000 <= 24736 THEN cost ELSE 0 END) OVER w AS run, sum(CASE WHEN cost + 1000 <= 24736 THEN 1 ELSE 0 END) OVER w AS place
      FROM (SELECT *, n_tokens + 2048 AS cost FROM {_C}) WINDOW w AS (PARTITION BY file_id ORDER BY saved_at, id))""",
    "context_group": f"SELECT coalesce(extra_context, '') AS context, count(*) AS n_requests, sum(n_tokens)::BIGINT AS n_tokens FROM {_C} GROUP BY 1",
    # a list of arrival times; each step of the recursion finds the end of the group that begins at place i
    "gate_release": """WITH RECURSIVE l AS (SELECT list(ts ORDER BY ts, event_id) AS a FROM events),
      g AS (SELECT 0::BIGINT AS n, 1::BIGINT AS i, CASE WHEN len(a) > 0 THEN len([t for t in a[1:8] if t <= a[1] + INTERVAL 90 SECOND]) ELSE 0 END AS size FROM l
        UNION ALL SELECT n + 1, i + size, len([t for t in a[i + size:i + size + 7] if t <= a[i + size] + INTERVAL 90 SECOND]) FROM g, l WHERE i + size <= len(a)),
      e AS (SELECT event_id, ts, row_number() OVER (ORDER BY ts, event_id) AS place FROM events)
      SELECT event_id, ts, n AS group_no, CASE WHEN size = 8 THEN a[i + 7] ELSE a[i] + INTERVAL 90 SECOND END AS released_at FROM e, l, g WHERE place >= i AND place < i + size""",
    "burst_rate": """SELECT user_id, min(ts) AS started_at, max(ts) AS ended_at, sum(n)::BIGINT AS n_tokens, CASE WHEN max(ts) > min(ts) AND sum(n) > 0 THEN round(sum(n) / (epoch_us(max(ts)) - epoch_us(min(ts))) * 1e6, 6) END AS tokens_per_second
      FROM (SELECT *, sum(CASE WHEN ts < prev + INTERVAL 6 HOUR THEN 0 ELSE 1 END) OVER (PARTITION BY user_id ORDER BY ts) AS burst FROM (
        SELECT user_id, ts, length(props) AS n, lag(ts) OVER (PARTITION BY user_id ORDER BY ts) AS prev FROM events)) GROUP BY user_id, burst""",
    "event_progress": """WITH RECURSIVE e AS (SELECT user_id || '/' || date_trunc('hour', ts)::TIMESTAMP::VARCHAR AS item, event_type, (event_id % 3)::INT AS r,
        row_number() OVER (PARTITION BY user_id, date_trunc('hour', ts) ORDER BY event_id) AS n FROM events),
      f AS (SELECT item, n, event_type AS text FROM e WHERE n = 1 UNION ALL
        SELECT e.item, e.n, substr(f.text, 1, greatest(0, length(f.text) - e.r)) || e.event_type FROM f JOIN e ON e.item = f.item AND e.n = f.n + 1)
      SELECT item, arg_max(text, n) AS text FROM f GROUP BY item""",
    "low_diversity": """SELECT doc_id, min(i)::INT AS stop_idx FROM (SELECT doc_id, unnest(range(20, length(text))) AS i, text FROM documents WHERE length(text) > 20) WHERE len(list_distinct(regexp_extract_all(substr(text, i - 18, 20), '(?s).'))) < 5 GROUP BY 1""",
    "immediate_repeat": """SELECT doc_id, i::INT AS idx, substr(text, i + 1, 1) AS token, (i + 3)::INT AS banned_until FROM (SELECT doc_id, text, unnest(range(1, length(text))) AS i FROM documents) WHERE substr(text, i + 1, 1) = substr(text, i, 1)""",
    "line_repeat": """WITH l AS (SELECT id, unnest(x) AS line, unnest(range(len(x)))::INT AS n FROM (SELECT id, string_split(coalesce(content, ''), chr(10)) AS x FROM (SELECT DISTINCT ON (id) * FROM text_chunks))),
      t AS (SELECT id, trim(line) AS line, n FROM l),
      m AS (SELECT *, coalesce(sum(CASE WHEN contains(line, '</think>') THEN 1 ELSE 0 END) OVER w, 0) AS seg,
        coalesce(last_value(CASE WHEN contains(line, '</think>') THEN false WHEN contains(line, '<think>') THEN true END IGNORE NULLS) OVER w, false) AS thinking
        FROM t WINDOW w AS (PARTITION BY id ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
      c AS (SELECT *, row_number() OVER (PARTITION BY id, seg, lower(line) ORDER BY n) AS nth FROM m WHERE length(line) > 2 AND NOT starts_with(line, 'A:'))
      SELECT id, min(n) AS stop_line FROM c WHERE nth >= CASE WHEN thinking THEN 4 ELSE 2 END GROUP BY id""",
    "banned_text_spans": f"""WITH b AS {_SPACED}, t AS (SELECT id, idx, sum(length(token) + 1) OVER (PARTITION BY id ORDER BY idx) - 1 AS e, sum(length(token) + 1) OVER (PARTITION BY id ORDER BY idx) - 1 - length(token) AS s FROM {_TOKENS}),
      p AS (SELECT unnest({PHRASES}) AS phrase),
      k AS (SELECT id, phrase, unnest(parts[:-2]) AS part, unnest(range(len(parts) - 1)) AS n FROM (SELECT id, phrase, string_split(body, phrase) AS parts FROM b, p WHERE contains(body, phrase))),
      m AS (SELECT id, phrase, (sum(length(part)) OVER (PARTITION BY id, phrase ORDER BY n) + n * length(phrase))::INT AS match_start FROM k)
      SELECT m.id, phrase, match_start, min(idx) AS first_idx, max(idx) AS last_idx, count(*)::INT AS rewind FROM m JOIN t ON t.id = m.id AND t.e > match_start AND t.s < match_start + length(phrase) GROUP BY m.id, phrase, match_start""",
    "single_token_ban": f"SELECT token, phrase FROM (SELECT DISTINCT token FROM {_TOKENS}), (SELECT unnest(['oar', 'vx', 'ith.']) AS phrase) WHERE contains(token, phrase)",
    "token_sequence_bans": f"""WITH t AS (SELECT *, lag(token, 1) OVER w AS p1, lag(token, 2) OVER w AS p2 FROM {_TOKENS} WINDOW w AS (PARTITION BY id ORDER BY idx))
      SELECT id, idx, 'within 29' AS sequence, 2 AS rewind FROM t WHERE p1 = 'within' AND token = '29' UNION ALL SELECT id, idx, 'must be reset.', 3 FROM t WHERE p2 = 'must' AND p1 = 'be' AND token = 'reset.'""",
    "token_rule_bans": f"SELECT id, idx AS step, token FROM {_TOKENS} WHERE (token = 'the' AND idx < 3) OR (token = 'glacier' AND idx >= 2 AND idx - 2 < 5) OR token = 'beacon'",
    "rules_in_force": f"""SELECT id, step, n_name AS token FROM (SELECT id, len([x for x in string_split_regex(coalesce(answer, ''), '[ \\t\\r\\n]+') if x <> ''])::INT AS step FROM {_A}), nation
      WHERE step >= n_nationkey AND (n_regionkey * 5 < 1 OR step - n_nationkey < n_regionkey * 5)""",
    "allowed_text": f"""SELECT id, text, token FROM (SELECT id, array_to_string(w[1:2], ' ') AS text, ' ' || coalesce(w[3], '') AS token FROM (SELECT id, string_split(coalesce(answer, ''), ' ') AS w FROM {_A}))
      WHERE regexp_full_match(text || token, '({"|".join(ALLOWED_WORDS)})*({"|".join(sorted({w[:k] for w in ALLOWED_WORDS for k in range(len(w))}, key=len, reverse=True))})')""",
    "greedy_pick": f"SELECT vec_id, token_id, logit FROM {_LOGITS} QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY logit DESC, token_id) = 1",
    "topk_filter": f"SELECT vec_id, token_id, logit FROM {_LOGITS} QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY logit DESC, token_id) <= 5",
    "topp_filter": f"SELECT vec_id, token_id, logit FROM (SELECT *, coalesce(sum(p) OVER (PARTITION BY vec_id ORDER BY logit DESC, token_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM {_P}) WHERE before < 0.9",
    "minp_filter": f"SELECT vec_id, token_id, logit FROM (SELECT *, max(logit) OVER (PARTITION BY vec_id) AS top FROM {_LOGITS}) WHERE logit >= top + ln(0.1)",
    "typical_filter": f"""WITH s AS (SELECT *, -ln(p) AS s FROM {_P}), x AS (SELECT *, round(abs(s - sum(p * s) OVER (PARTITION BY vec_id)), 12) AS far FROM s)
      SELECT vec_id, token_id, logit FROM (SELECT *, coalesce(sum(p) OVER (PARTITION BY vec_id ORDER BY far, token_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM x) WHERE before < 0.5""",
    "stop_token": f"SELECT id, coalesce(min(idx) FILTER (WHERE token IN ('which', 'while', 'because')), count(*))::INT AS n_tokens, bool_or(token IN ('which', 'while', 'because')) AS stopped FROM {_TOKENS} GROUP BY 1",
    "greedy_sample": f"SELECT vec_id, token_id FROM {_LOGITS} WHERE token_id % 3 <> 0 QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY logit DESC, token_id) = 1",
    "softmax_top": f"""WITH k AS (SELECT vec_id, token_id, logit FROM {_LOGITS} QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY logit DESC, token_id) <= 3),
      e AS (SELECT *, exp((logit - max(logit) OVER (PARTITION BY vec_id)) / 0.6) AS w FROM k) SELECT vec_id, token_id, round(w / sum(w) OVER (PARTITION BY vec_id), 6) AS p FROM e""",
}
