"""From responses to cards: prompts, chat templates, the pluggable model and the question-answer parser."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import trim_start_chars, unicode_trim

THINK_END = "</think>"
#: Fixed values of the chat template: what stands before and after a message of each role.
TEMPLATES = {
    "mistral": {"bos": "<s>", "system": ("[SYSTEM_PROMPT]", "[/SYSTEM_PROMPT]"), "user": ("[INST]", "[/INST]"), "assistant": ("", "</s>")},
    "chatml": {"bos": "", "system": ("<|im_start|>system\n", "<|im_end|>\n"), "user": ("<|im_start|>user\n", "<|im_end|>\n<|im_start|>assistant\n"), "assistant": ("", "<|im_end|>\n")},
}
#: Which template a model gets: the first whose part its name contains, else the generic one.
TEMPLATE_OF = (("Mistral-Small-3.2-24B-Instruct-2506", "mistral"),)
GENERIC = "chatml"
CONTEXT_PREFIX, CONTEXT_SUFFIX = "# Context\n", "\n\n"


def parse_cards(responses: DataFrame, text: str, keys: list[str], strict: bool = False) -> DataFrame:
    """``keys``, ``card_no``, ``question``, ``answer`` of every card in a response.

    What stands up to the first ``</think>`` is dropped. A card begins at a line that starts with ``Q:``; its answer
    at the first line with ``A:`` before the next card. A question without answer is dropped, an empty answer is kept.
    The leading run of the letters of the marks is removed (with ``strict`` only the mark itself), then white space.
    All built-in expressions: no Python, no shuffle. Null and empty responses have no cards.
    """
    t = F.col(text)
    body = F.when(F.locate(THINK_END, t) > 0, F.expr(f"substring(`{text}`, locate('{THINK_END}', `{text}`) + {len(THINK_END)})")).otherwise(t)
    parts = F.filter(F.split(body, r"(?dmU)^(?=[^\S\n]*Q:)", -1), lambda s: s.rlike(r"(?dU)^[^\S\n]*Q:"))
    split_at = r"(?dmU)^(?=[^\S\n]*A:)"
    cards = responses.select(*keys, F.posexplode(parts).alias("__no", "__part")).withColumn("__halves", F.split("__part", split_at, 2)).where(F.size("__halves") == 2)

    def side(column: Column, mark: str) -> Column:
        cut = F.regexp_replace(column, f"(?U)^\\s*{mark}:", "") if strict else trim_start_chars(column, f"{mark}:")
        return unicode_trim(cut)

    return cards.select(*keys, F.col("__no").alias("card_no"), side(F.get("__halves", F.lit(0)), "Q").alias("question"), side(F.get("__halves", F.lit(1)), "A").alias("answer"))


def parse_response(text: str | None) -> list[tuple[str, str]]:
    """The cards of one response, as ``parse_cards`` finds them; for the table function of SQL users."""
    body = (text or "").partition(THINK_END)[2] if THINK_END in (text or "") else text or ""
    cards: list[list[list[str]]] = []
    for line in body.split("\n"):
        start = line.lstrip()
        if start.startswith("Q:"):
            cards.append([[line], []])
        elif cards and (cards[-1][1] or start.startswith("A:")):
            cards[-1][1].append(line)
        elif cards:
            cards[-1][0].append(line)
    return [("\n".join(q).lstrip("Q:").strip(), "\n".join(a).lstrip("A:").strip()) for q, a in cards if a]


def message(role: str, body: Column, before: bool = True, after: bool = True, template: str = "mistral") -> Column:
    """One message in a chat template; an unknown role is an error."""
    marks = TEMPLATES[template].get(role.lower())
    if marks is None or role.lower() == "bos":
        raise ValueError(f"unknown role {role}")
    return F.concat(*([F.lit(marks[0])] if before else []), body, *([F.lit(marks[1])] if after else []))


def prompts(chunks: DataFrame, instruction: str, template: str = "mistral", prefix: str = CONTEXT_PREFIX, suffix: str = CONTEXT_SUFFIX, compat: bool = False) -> DataFrame:
    """Adds ``prompt``: system message, the context if there is one, and the chunk as the user's message.

    Null and empty contexts are the same. With ``compat`` a prompt without context lacks the opening of the user's
    turn, as the original has it.
    """
    held = F.coalesce(F.col("extra_context"), F.lit("")) != ""
    system = F.concat(F.lit(TEMPLATES[template]["bos"]), message("system", F.lit(instruction), template=template))
    context = message("user", F.concat(F.lit(prefix), "extra_context", F.lit(suffix)), after=False, template=template)
    without = F.lit("" if compat else TEMPLATES[template]["user"][0])
    return chunks.withColumn("prompt", F.concat(system, F.when(held, context).otherwise(without), message("user", F.coalesce("content", F.lit("")), before=False, template=template)))


def template_of(model: Column, rules: tuple[tuple[str, str], ...] = TEMPLATE_OF) -> Column:
    """The template's name for a model's name; the generic one for null and unknown names."""
    chosen = F.when(F.lit(False), "")
    for part, name in rules:
        chosen = chosen.when(F.contains(model, F.lit(part)), name)
    return chosen.otherwise(GENERIC)


def wrapped(role: Column, body: Column, template: Column, before: bool = True, after: bool = True) -> Column:
    """A message in the template named by a column: what stands before it, the message, what stands after it."""
    said = F.when(F.lit(False), "")
    for name, marks in TEMPLATES.items():
        for of, (head, tail) in ((k, v) for k, v in marks.items() if k != "bos"):
            said = said.when((template == name) & (F.lower(role) == of), F.concat(F.lit(head if before else ""), body, F.lit(tail if after else "")))
    return said.otherwise(F.raise_error(F.concat(F.lit("unknown role "), F.coalesce(role, F.lit("null")))))


def conversation(turns: DataFrame, key: str, order: str, role: str, text: str, template: str = "mistral") -> DataFrame:
    """``key``, ``prompt``: all turns of a conversation in order. An unknown role raises an error when it is met."""
    marks = TEMPLATES[template]
    cases = F.when(F.lit(False), "")
    for name in ("system", "user", "assistant"):
        cases = cases.when(F.lower(role) == name, F.concat(F.lit(marks[name][0]), text, F.lit(marks[name][1])))
    cases = cases.otherwise(F.raise_error(F.concat(F.lit("unknown role "), F.coalesce(role, F.lit("null")))))
    told = turns.select(key, F.struct(F.col(order), cases.alias("said")).alias("turn"))
    parts = F.transform(F.array_sort(F.collect_list("turn")), lambda t: t["said"])
    return told.groupBy(key).agg(F.concat(F.lit(marks["bos"]), F.array_join(parts, "")).alias("prompt"))


def stub_model(content: Column) -> Column:
    """The default model, a pure function of the chunk: asks for the first word of each of its first three sentences."""
    sentences = F.slice(F.filter(F.split(content, r"[.!?]\s+", -1), lambda s: F.trim(s) != ""), 1, 3)
    card = F.transform(sentences, lambda s: F.concat(F.lit("Q: What of "), F.substring_index(F.trim(s), " ", 1), F.lit("?\nA: "), F.regexp_replace(F.trim(s), r"\s+", " ")))
    return F.array_join(card, "\n")


def generate(chunks: DataFrame, model: Callable[[Column], Column] | None = None, column: str = "content") -> DataFrame:
    """Adds ``response``. ``model`` maps a column to a column, so an Arrow UDF around any model fits. Prompts that
    share a context should reach the model together: ``by_context`` arranges that."""
    return chunks.withColumn("response", (model or stub_model)(F.col(column)))


def by_context(chunks: DataFrame, buckets: int = 32) -> DataFrame:
    """Rows with the same context next to each other. A context is spread over a few buckets, so that one which most
    rows share does not fill a single task."""
    spread = F.pmod(F.xxhash64("id"), F.lit(buckets))
    arranged = chunks.withColumn("__context", F.coalesce("extra_context", F.lit(""))).repartition("__context", spread)
    return arranged.sortWithinPartitions("__context").drop("__context")


def progress_status(n_tokens: Column, used: Column, context: int, completed: Column) -> Column:
    """What an item in work shows: its tokens and how many it may have, that is the context without what all others use."""
    room = F.lit(context) - (used - n_tokens)
    return F.when(completed, "Processing complete").otherwise(F.concat(F.lit("Processing ("), n_tokens.cast("string"), F.lit("/"), room.cast("string"), F.lit(" tokens)")))


def live_work(work: DataFrame, progress: DataFrame, key: str, context: int) -> DataFrame:
    """``key, status, response`` of the items in work that a step told of; queued ones are left out.

    ``progress`` has ``n_tokens, text, completed`` of each item after a step; all of them share one context.
    """
    used = progress.agg(F.sum("n_tokens").alias("__used"))  # one row
    told = work.select(key).join(progress, key).crossJoin(F.broadcast(used))
    return told.select(key, progress_status(F.col("n_tokens"), F.col("__used"), context, F.col("completed")).alias("status"), F.coalesce("text", F.lit("")).alias("response"))


def completion_status(n_cards: Column, error: Column, cancelled: Column) -> Column:
    """What a finished chunk shows."""
    return (
        F.when(error.isNotNull(), F.concat(F.lit("Failed: "), error))
        .when(F.coalesce(cancelled, F.lit(False)), "Cancelled")
        .when(F.coalesce(n_cards, F.lit(0)) == 0, "Failed: No flashcards parsed from LLM response.")
        .otherwise(F.concat(F.lit("Completed: "), n_cards.cast("string"), F.lit(" cards created")))
    )
