"""Broken question-answer pairs: empty, copied, cut off, refusing or answered in another language."""

from __future__ import annotations

import re
from collections import Counter

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import spread, written
from .cutoff import BLOCK, DECIDED, KINDS, ContextCounter, ValueTexts, asked, closed, cut_off, end_of, looked_up, trusted
from .language import NAMES, is_japanese, language_of

#: What stands for an answer that is not there, in lower case and without signs.
PLACEHOLDERS = frozenset("a answer antwort respuesta réponse q none null nil nan na n/a tbd tba todo empty blank undefined unknown missing placeholder no answer not available not applicable keine antwort sin respuesta sans réponse 回答 答え なし 未定".split()) | {
    "no answer", "not available", "not applicable", "keine antwort", "sin respuesta", "sans réponse", "n a", "to do", "to be determined", "to be done",
}
_LONGEST_PLACEHOLDER = max(len(p.split()) for p in PLACEHOLDERS)
_RUNS = re.compile(r"[^\W_]+")
_JAPANESE = regex.compile(r"[\p{Hiragana}\p{Katakana}\p{Han}]")
_LABEL = regex.compile(r"^\s*(?:a|answer|antwort|réponse|respuesta|q|question|答え|回答)\s*[:：]\s*", regex.I)
_QUOTED = regex.compile(r"\"[^\"]*\"|“[^”]*”|«[^»]*»|„[^“]*“|「[^」]*」|‘[^’]*’")
#: Share of the answer's words that must be tiles of the question, and how much of the question they must cover.
COPY_ANSWER, COPY_QUESTION = 0.85, 0.6
#: Share of the answer's words that must be the question's as they are, and of a word's letters for two words to be alike.
COPY_KNOWN, LIKE_WORDS = 0.6, 0.7

# Grammars of refusals. Each needs a refusing speaker (the writer, or the text as a source for a card): sentences in
# which others refuse, or that only quote a refusal, are none.
_I = r"\b(?:i|we)(?:\s*[’']m|\s+am|\s*[’']re|\s+are)?\s+(?:\w+\s+){0,2}?"
_TASK = r"(?:answer|help|assist|create|write|provide|produce|generate|make|give|discuss|respond|comply|complete|share|offer|continue|do\s+(?:that|this))"
_REFUSALS = {
    "en": regex.compile(
        rf"""{_I}(?:can\s*not|can[’']?t|could\s*n[o’']?t|won[’']?t|will\s+not|would\s+not|unable\s+to|not\s+able\s+to|not\s+(?:allowed|permitted|comfortable|willing)|have\s+to\s+(?:reject|decline|refuse)|must\s+(?:reject|decline|refuse)|decline|refuse|reject|rather\s+not|don[’']?t\s+(?:feel\s+comfortable|have\s+(?:enough|the)))
        |\bno\s+(?:flash\s*)?(?:cards?|answers?|questions?|information)\s+(?:can|could|will|may)\s+be\s+\w+
        |\b(?:passage|text|context|material|source|excerpt|content|information)\b[^.!?]*?\b(?:lacks?|does\s+not\s+(?:contain|have|provide|include)|doesn[’']?t\s+(?:contain|have|provide|include)|is\s*n[o’']?t\s+(?:educational|enough|sufficient|suitable)|is\s+not\s+(?:educational|enough|sufficient|suitable))
        |\bit\s+would\s+(?:not|n[’']?t)\s+be\s+(?:appropriate|right|suitable|possible)
        |\bas\s+an?\s+(?:ai\s+)?(?:large\s+)?(?:language\s+)?model\b
        |\b(?:beyond|outside)\s+(?:my|our)\s+\w+""",
        regex.I | regex.X,
    ),
    "de": regex.compile(
        r"\b(?:ich|wir)\s+(?:\w+\s+)?(?:kann|können|darf|dürfen|möchte|möchten|werde|werden|will|muss)\b[^.!?]*?\b(?:nicht|kein\w*|ablehnen|verweigern)|\b(?:kann|können|darf|möchte|werde)\s+(?:ich|wir)\b[^.!?]*?\b(?:nicht|kein\w*|ablehnen)|\b(?:ich|wir)\s+(?:lehne|verweigere|lehnen|verweigern)\b"
        r"|\b(?:text|abschnitt|passage|inhalt)\b[^.!?]*?\b(?:nicht\s+lehrreich|keine?\s+(?:ausreichend\w*|genügend\w*)|reicht\s+nicht|kein\s+lehrtext|ist\s+nicht\s+\w+)[^.!?]*|\bals\s+(?:ki|sprachmodell)\b|\blässt\s+sich\s+keine?\s+(?:karte|antwort|frage)",
        regex.I,
    ),
    "fr": regex.compile(
        r"\bje\s+(?:ne\s+)?(?:peux|puis|veux|dois|suis|saurais|souhaite|vais)\b[^.!?]*?\b(?:pas|refuser|décliner|désolée?|incapable)|\bje\s+(?:refuse|décline|regrette)\b|\bne\s+(?:me|nous)\s+permet\w*\s+pas|\b(?:passage|texte|extrait|contenu)\b[^.!?]*?\bn[’']est\s+pas\s+(?:éducatif|assez|suffisant|approprié)|\baucune\s+(?:carte|réponse)\s+ne\s+peut|\ben\s+tant\s+que\s+(?:modèle|ia)\b",
        regex.I,
    ),
    "es": regex.compile(
        r"\b(?:no|tampoco)\s+(?:puedo|podemos|podré|debo|quiero|voy\s+a|me\s+es\s+posible|responderé|respondo|crearé|haré)\b|\blo\s+siento\b|\b(?:me\s+niego|rechazo|declino)\b|\b(?:pasaje|texto|fragmento|contenido)\b[^.!?]*?\b(?:no\s+es\s+(?:educativo|suficiente|apropiado)|no\s+(?:contiene|tiene)\s+(?:suficiente|bastante))|\bno\s+se\s+puede\s+(?:crear|producir|dar|responder)|\bcomo\s+modelo\s+de\s+lenguaje\b",
        regex.I,
    ),
    "ja": regex.compile(r"申し訳|すみません|お答え(?:でき|し)|(?:作成|回答|提供|お手伝い|説明|対応)(?:は|が|を|も)?(?:でき|いたし|し)(?:ません|かね|ない)|答えられ(?:ません|ない)|控え(?:させて|ます)|お断り|教育的では(?:ない|ありません)|情報が(?:不足|足り)"),
}


# What the words of a text must hold for a grammar to match in it: each alternative of a grammar has words of its own that
# every match contains whole, so a text that lacks them in all alternatives is left out without a search. One tuple of
# word sets for each alternative, the rarest first: a word of every set must be there.
_NEEDED = {
    "en": (("i we",), ("card cards flashcard flashcards answer answers question questions information", "no", "be"), ("passage text context material source excerpt content information",), ("would", "it"), ("model", "as"), ("beyond outside", "my our")),
    "de": (("ich wir",), ("text abschnitt passage inhalt",), ("ki sprachmodell", "als"), ("lässt", "sich")),
    "fr": (("je",), ("me nous", "ne"), ("passage texte extrait contenu", "est"), ("aucune", "carte réponse"), ("tant", "en")),
    "es": (("puedo podemos podré debo quiero voy posible responderé respondo crearé haré", "no tampoco"), ("siento", "lo"), ("niego", "me"), ("rechazo declino",), ("pasaje texto fragmento contenido", "no"), ("puede", "no"), ("modelo", "como")),
}
_NEEDED = {k: [tuple(frozenset(w.split()) for w in sets) for sets in alternatives] for k, alternatives in _NEEDED.items()}
_RAREST = frozenset().union(*(sets[0] for alternatives in _NEEDED.values() for sets in alternatives))


def words_of(text: str | None) -> list[str]:
    """Runs of letters and digits in lower case."""
    return _RUNS.findall(text.lower()) if text else []


def may_refuse(words: set[str]) -> list[str]:
    """The languages (but Japanese) whose grammar can match in a text of these words."""
    if _RAREST.isdisjoint(words):
        return []
    return [k for k, alternatives in _NEEDED.items() if any(all(not of.isdisjoint(words) for of in sets) for sets in alternatives)]


def is_empty(answer: str | None, words: list[str] | None = None) -> bool:
    """Null, blank, or without any word but a placeholder. A label is one word, so an answer of more ``words`` than the
    longest placeholder and a label is none."""
    if answer is None:
        return True
    if words is not None and len(words) > _LONGEST_PLACEHOLDER + 1:
        return False
    words = words_of(_LABEL.sub("", answer))
    return not words or len(words) <= _LONGEST_PLACEHOLDER and " ".join(words) in PLACEHOLDERS


def common(a: Counter, b: Counter) -> int:
    """Size of the common multiset. Greedy tiling with tiles of one sign or more goes on until nothing common is left, so
    this is what it covers."""
    return sum(min(n, b[x]) for x, n in a.items() if x in b)


def tiled(a: str, b: str, least: int = 2) -> int:
    """Greedy string tiling: how many signs of ``a`` lie in tiles of ``least`` or more (longest first, none overlapping)
    that ``b`` has. Each round fills one row of match lengths after the other."""
    x, y = (np.frombuffer(t.encode("utf-32-le", "surrogatepass"), np.uint32) for t in (a, b))
    free_x, free_y, covered = np.ones(len(x), bool), np.ones(len(y), bool), 0
    while True:
        best, tiles, before = least, [], np.zeros(len(y) + 1, np.int32)
        for i in range(len(x)):
            now = np.zeros(len(y) + 1, np.int32)
            if free_x[i]:
                hit = (y == x[i]) & free_y
                now[1:][hit] = before[:-1][hit] + 1
            top = int(now.max())
            if top > best:
                best, tiles = top, []
            if top == best:
                tiles += [(i, int(j) - 1) for j in np.flatnonzero(now == best)]
            before = now
        if not tiles:
            return covered
        for i, j in tiles:
            if free_x[i - best + 1 : i + 1].all() and free_y[j - best + 1 : j + 1].all():
                free_x[i - best + 1 : i + 1] = free_y[j - best + 1 : j + 1] = False
                covered += best


def _alike(w: str, v: str) -> bool:
    """Whether most letters of two words lie in common tiles; what bounds the tiling from above is asked first."""
    need = LIKE_WORDS * max(len(w), len(v))
    return min(len(w), len(v)) >= need and common(Counter(w), Counter(v)) >= need and tiled(w, v) >= need


def is_copy(question: str | None, answer: str, a: list[str] | None = None, q: list[str] | None = None) -> bool:
    """Whether the answer says nothing but the question: its words are tiles of the question, and tell most of it.

    Words that no tile covers are compared by tiles of their letters, so a typing error in a long word does not hide a
    copy. Texts without blanks are tiled by characters. An answer may say the question any number of times: its words
    are tiled in rounds with the question's words free again in each, while the question is covered once, in the first.
    """
    if not question:
        return False
    a, q = a if a is not None else words_of(answer), q if q is not None else words_of(question)
    if is_japanese(answer):
        a, q = list("".join(a)), list("".join(q))
    known = set(q)
    told = sum(map(known.__contains__, a))  # tiles may be single words, so the rounds end with just these words covered
    if told < COPY_KNOWN * len(a) and (label := _LABEL.match(answer)):
        a = words_of(answer[label.end() :])
        told = sum(map(known.__contains__, a))
    if not a or not q or told < COPY_KNOWN * len(a):
        return False
    asked, covered = 0, common(Counter(a), Counter(q))
    if told < len(a):
        said = set(a)
        loose_q, loose_a = [w for w in q if w not in said], [w for w in a if w not in known and len(w) > 3]
        if told + len(loose_a) < COPY_ANSWER * len(a) or len(loose_q) + covered < COPY_QUESTION * len(q):
            return False
        like = {w: {v for v in set(loose_q) if _alike(w, v)} for w in set(loose_a)}
        told += sum(bool(like[w]) for w in loose_a)
        asked = sum(any(v in found for found in like.values()) for v in loose_q)
    return told >= COPY_ANSWER * len(a) and asked + covered >= COPY_QUESTION * len(q)


def is_refusal(answer: str, words: list[str] | None = None) -> bool:
    """Whether the writer declines to answer. Quoted words and sentences about others that refuse do not count."""
    if words is None or "ſ" in answer:  # the grammars take the long s for an s
        words = words_of(answer.replace("ſ", "s"))
    found = may_refuse(set(words))
    if not answer.isascii() and _JAPANESE.search(answer):
        found.append("ja")
    if not found:
        return False
    said = _QUOTED.sub(" ", answer).replace("’", "'")
    return any(_REFUSALS[k].search(said) for k in found if k != "ja" or is_japanese(answer))


def is_other_language(question: str | None, answer: str | tuple[str, float], asked_words: list[str] | None = None, lead: float = 0.75) -> bool:
    """Whether the answer (or what ``language_of`` says of it) is in another language than the question, and the question
    does not ask for one."""
    given, clear = language_of(answer) if isinstance(answer, str) else answer
    if not given or clear < lead:
        return False
    asked, sure = language_of(question or "", asked_words)
    if not asked or asked == given or sure < lead:
        return False
    question = (question or "").lower()
    return not any(name in question for name in NAMES[given])


def first_defect(question: str | None, answer: str | None, a: list[str], q: list[str]) -> str | None:
    """``empty`` or ``copy``, which come before a cut."""
    if is_empty(answer, a):
        return "empty"
    return "copy" if is_copy(question, answer, a, q) else None


def last_defect(question: str | None, answer: str, a: list[str], q: list[str], given: tuple[str, float]) -> str | None:
    """``refusal`` or ``language``, which come after it. ``given`` is what ``language_of`` says of the answer."""
    if is_refusal(answer, a):
        return "refusal"
    return "language" if is_other_language(question, given, q) else None


def defect_of(question: str | None, answer: str | None, cut: bool) -> str | None:
    """The first defect that holds: empty, copy, truncated, refusal or language."""
    a, q = words_of(answer), words_of(question)
    return first_defect(question, answer, a, q) or ("truncated" if cut else last_defect(question, answer, a, q, language_of(answer, a)))


READ = "kind int, key long, n long, yes long, over long, id long, row long, form int, language string, defect string"
_SCHEMA = pa.schema([(name, {"int": pa.int32(), "long": pa.int64(), "string": pa.string()}[kind]) for name, kind in (c.split() for c in READ.split(", "))])


def _batch(size: int, /, **columns) -> pa.RecordBatch:
    """Rows of READ; columns that are not given are null."""
    return pa.RecordBatch.from_arrays([pa.array(columns[f.name], f.type) if f.name in columns else pa.nulls(size, f.type) for f in _SCHEMA], schema=_SCHEMA)


def _read(every: bool, rows: int = 2000):
    """One pass over all cards: partial counts of contexts (rows without ``id``); the contexts that a card's answer asks
    for, with what the card is if it is not cut; and with kind -1 the cards whose defect is known already."""

    def run(batches):
        counter = ContextCounter()
        for whole in batches:
            for batch in (whole.slice(i, rows) for i in range(0, whole.num_rows, rows)):
                answered, spoken, ended = [], [], []
                decided, waiting, forms, languages = [], [], [], []
                for i, row, question, answer in zip(*(batch.column(c).to_pylist() for c in ("id", "row", "question", "answer"))):
                    a, form, body = words_of(answer), DECIDED, ""
                    given = language_of(answer, a) if answer is not None else ("", 0.0)
                    if answer is not None and (stripped := answer.rstrip()):
                        answered.append(stripped)
                        spoken.append(given[0])
                        ended.append(whole_end := closed(stripped))
                        form, body = end_of(stripped, whole_end)
                    if i is None:
                        continue
                    q = words_of(question)
                    defect = first_defect(question, answer, a, q)
                    if defect:
                        form = DECIDED
                    elif form == DECIDED and body:
                        defect = "truncated"
                    elif every:
                        defect = last_defect(question, answer, a, q, given)
                    if form != DECIDED:
                        waiting.append((i, row, defect))
                        forms.append((form, body))
                        languages.append(given[0])
                    elif defect:
                        decided.append((i, row, defect))
                if answered:
                    counter.add(ValueTexts(answered, spoken), np.array(ended))
                yield from (_batch(len(x["key"]), **x) for x in counter.blocks(BLOCK))
                at, kind, key = asked(forms, languages)
                if len(at):
                    where = pa.array(at)
                    ids, row_, defects_ = (pa.array(x, t).take(where) for x, t in zip(zip(*waiting), (pa.int64(), pa.int64(), pa.string())))
                    yield _batch(len(at), kind=kind, key=key, id=ids, row=row_, defect=defects_, form=pa.array([f for f, _ in forms], pa.int32()).take(where), language=pa.array(languages, pa.string()).take(where))
                # what asks for nothing (a mark behind no word) is whole
                asking = set(at.tolist())
                decided += [x for k, x in enumerate(waiting) if x[2] and k not in asking]
                if decided:
                    ids, row_, defects_ = zip(*decided)
                    yield _batch(len(decided), id=ids, row=row_, defect=defects_, kind=np.full(len(decided), -1))
        yield from (_batch(len(x["key"]), **x) for x in counter.blocks())

    return run


def defects(cards: DataFrame, every: bool = True) -> DataFrame:
    """``id, defect`` of every defective card, one row each; without ``every`` refusals and languages are not asked for.

    A null question has no language and no copy. Exact repeats of a card count once. Only ``id``, ``question`` and
    ``answer`` are read, in one pass of Python that both counts the contexts of the model and asks for those that
    decide. What it tells is written to the shared folder once, so the texts are not read again. An empty table gives
    no rows.
    """
    read = cards.select(F.col("id").cast("long").alias("id"), "question", "answer", F.xxhash64("question", "answer").alias("row"))
    told = written(spread(read).mapInArrow(_read(every), READ))
    known = written(trusted(told.where("id is null").select("kind", "key", "n", "yes", "over")))
    values = cards.where(F.trim("answer") != "").count()
    asks = told.where("id is not null and kind >= 0").select("id", "row", "form", "language", "defect", "kind", "key")
    met = looked_up(asks, known, values, "row")
    of = lambda column: [F.max(F.when(F.col("kind") == k, F.col(column))).alias(f"{column}{k}") for k in range(KINDS)]
    judged = met.groupBy("id", "row", "form", "language", "defect").agg(*of("first"), *of("second"))
    cut = cut_off(F.col("form"), F.col("language"), {k: F.col(f"first{k}") for k in range(KINDS)}, {k: F.col(f"second{k}") for k in range(KINDS)})
    found = judged.select("id", F.when(cut, "truncated").otherwise(F.col("defect")).alias("defect")).where("defect is not null")
    return found.unionByName(told.where("kind = -1").select("id", "defect")).distinct()


def truncated(cards: DataFrame) -> DataFrame:
    """``id`` of the cards whose answer stops before its end. All but blank answers are judged."""
    return defects(cards, every=False).where("defect = 'truncated'").select("id")


def cut_share(cards: DataFrame, by: str) -> DataFrame:
    """Per value of ``by``: answered cards, cut ones and their share. A null value is a group of its own."""
    answered: Column = F.col("answer").isNotNull() & (F.trim("answer") != "")
    every = cards.where(F.col("id").isNotNull() & answered).select("id", by).distinct()
    cut = truncated(cards).withColumn("__cut", F.lit(1))
    told = every.join(cut, "id", "left").groupBy(by).agg(F.count("*").alias("n_answers"), F.coalesce(F.sum("__cut"), F.lit(0)).alias("n_cut"))
    return told.withColumn("cut_share", F.round(F.col("n_cut") / F.col("n_answers"), 6))
