"""Markup residue in texts: which kinds a text holds, and clean text that keeps its structure.

A lexer reads a text into words and candidates of markup syntax. Each candidate has features (its form, what stands
beside it); weights learned from labelled pages say how strongly each feature speaks for words (positive) or for tags
(negative). The content of a text is its maximum-scoring contiguous run of words and tags, found by one linear scan;
where little but tags stands beyond it, it goes. With the scores turned round the same scan finds the region of each
kind of markup, and a text holds the kinds that have one.
"""

from __future__ import annotations

import html
import random
import re
from collections import Counter, defaultdict
from functools import lru_cache
from math import log

import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

KINDS = ("html", "markdown", "wiki", "latex")
#: Where a candidate can begin; a text without such a place holds no markup. The same in Java and Python.
SIGNS = r"(?m)[<\\$`*{\[]|&[a-zA-Z#]|''|!\[|(?<!\w)_|~[~\\]|^[ \t]*[#=|!>+\-~_]"

#: Names of HTML elements.
ELEMENTS = "a abbr address article aside audio b blockquote body br button canvas caption center cite code col dd del details dfn div dl dt em embed fieldset figcaption figure font footer form frame h1 h2 h3 h4 h5 h6 head header hr html i iframe img input ins kbd label legend li link main map mark meta nav noscript object ol option p param picture pre q s samp script section select small source span strike strong style sub summary sup svg table tbody td textarea tfoot th thead time title tr tt u ul var video"
_E = "(?i:" + "|".join(sorted(ELEMENTS.split(), key=len, reverse=True)) + ")"

#: The forms of candidates, tried in this order at each place. Group names are ``kind__form``.
_FORMS = [
    ("latex", "environment", r"\\(?:begin|end)\s*\{[^{}\n]*\}?"),
    ("latex", "display", r"\$\$[^$]*(?:\$\$)?|\\\[(?:[^\\]|\\(?!\]))*(?:\\\])?"),
    ("latex", "inline", r"\\\((?:[^\\\n]|\\(?!\)))*(?:\\\))?"),
    ("latex", "math", r"(?<![\w$\\])\$(?=\S)[^$\n]+?(?<=\S)\$(?![\w$])"),
    ("latex", "cut_math", r"(?<![\w$\\])\$(?=[^\s\d$])[^$\n]*[\\^_{=][^$\n]*\Z"),
    ("latex", "command", r"~?\\[a-zA-Z]+\*?(?:\s*\[[^\]\n]*\])?(?:\s*\{[^{}\n]*\}?)*"),
    ("latex", "escape", r"\\[,;:!%&#_$~{}]|\\\\(?=\s*$)"),
    ("html", "comment", r"<!--(?:(?!-->).)*(?:-->)?"),
    ("html", "script", r"(?i:<(?:script|style)\b[^>]*>(?:(?!</(?:script|style)).)*(?:</(?:script|style)\s*>?)?)"),
    ("html", "doctype", r"(?i:<!DOCTYPE)[^>\n]*>?"),
    ("html", "tag", rf"</?{_E}(?:\s+[\w:-]+(?:\s*=\s*(?:\"[^\"]*\"|'[^']*'|[^\s>\"']+))?)*\s*/?>"),
    ("html", "cut_tag", rf"</?{_E}(?:\s+[\w:-]+\s*=\s*[\"'][^<>\n]*|\s*)$|<{_E}\s+[\w:-]+\s*=\s*(?:\"[^\"<>\n]*|'[^'<>\n]*)[^<>\n]*|</{_E}\b"),
    ("html", "entity", r"&(?:[a-zA-Z][a-zA-Z0-9]{1,30}|#\d{1,7}|#[xX][0-9a-fA-F]{1,6});"),
    ("wiki", "file", r"\[\[(?:File|Image|Datei|Bild|Fichier|Archivo|Category|Kategorie|Catégorie|Categoría)\s*:[^\[\]\n]*(?:\]\])?"),
    ("wiki", "link", r"\[\[[^\[\]\n]+(?:\]\])?|\[https?://[^\s\]]+ [^\]\n]*\]"),
    ("wiki", "template", r"\{\{[^{}]*(?:\}\})?"),
    ("wiki", "table", r"(?m:^[ \t]*\{\|[^\n]*$|^[ \t]*\|\}|^[ \t]*\|-(?![-:])(?![^\n]*\|)[^\n]*$|^[ \t]*!(?!\[) [^\n]*$)"),
    ("wiki", "heading", r"(?m:^(?P<eq>={2,6})[ \t]*[^=\s][^\n]*?[ \t]*(?P=eq)[ \t]*$)"),
    ("wiki", "quotes", r"'{2,5}(?=[^'\s])[^\n]*?'{2,5}|(?<!\w)'{2,5}(?=[^'\s])"),
    ("wiki", "magic", r"~{3,5}(?!~)(?=\s|$)|__(?:TOC|NOTOC|FORCETOC|NOEDITSECTION|INDEX|NOINDEX)__|(?m:^#REDIRECT\b[^\n]*$)"),
    ("markdown", "fence", r"(?m:^[ \t]*(?:```|~~~)[\w+-]*[ \t]*$)(?:(?!\n[ \t]*(?:```|~~~)).)*(?:\n[ \t]*(?:```|~~~)[ \t]*(?=\n|$))?"),
    ("markdown", "code", r"``?[^`\n]+``?|`(?=\w)"),
    ("markdown", "image", r"!\[[^\]\n]*\](?:\([^()\n]*\)?)?"),
    ("markdown", "footnote", r"\[\^[^\]\s]+\]:?"),
    ("markdown", "link", r"(?<!\[)\[[^\[\]\n]+\]\((?!\s)[^()\n]*\)?|(?m:^\[[^\]\n]+\]:[ \t]+\S+)|\[[^\[\]\n]+\]\[[^\[\]\n]*\]"),
    ("markdown", "heading", r"(?m:^ {0,3}#{1,6}[ \t]+\S[^\n]*$)"),
    ("markdown", "setext", r"(?m:^ {0,3}(?:={2,}|-{2,})[ \t]*$)"),
    ("markdown", "table_rule", r"(?m:^[ \t]*\|?[ \t]*:?-{2,}:?[ \t]*(?:\|[ \t]*:?-{1,}:?[ \t]*)+\|?[ \t]*$)"),
    ("markdown", "rule", r"(?m:^ {0,3}(?:(?:\*[ \t]*){3,}|(?:-[ \t]*){3,}|(?:_[ \t]*){3,})$)"),
    ("markdown", "quote", r"(?m:^ {0,3}>[ \t]?(?=\S))"),
    ("markdown", "task", r"(?m:^[ \t]*[-*+][ \t]+\[[ xX]\](?=\s))"),
    ("markdown", "strong", r"\*\*(?=\S)[^\n]+?(?<=\S)\*\*|(?<![\w_])__(?=[^\s_])[^\n]+?(?<=[^\s_])__(?![\w_])|\*\*(?=\w)"),
    ("markdown", "strike", r"~~(?=\S)[^\n]+?(?<=\S)~~"),
    ("markdown", "emphasis", r"(?<![\w*\\])\*(?=[^\s*])[^*\n]+?(?<=[^\s*])\*(?![\w*])|(?<![\w_\\])_(?=[^\s_])[^_\n]+?(?<=[^\s_])_(?![\w_])"),
    ("markdown", "autolink", r"<https?://[^\s>]+>"),
]
_LEXER = regex.compile("|".join(f"(?P<{kind}__{form}>{pattern})" for kind, form, pattern in _FORMS), regex.S)
_START = re.compile(SIGNS)
_WORD = regex.compile(r"[\p{L}\p{N}]+")
_PATH = regex.compile(r"[A-Za-z]:$|[\w.$-]$")
_MONEY = regex.compile(r"^\$\d[\d.,]*\s.*\$$|^\$\d[\d.,]*\s+\w+\s+\$?$")


def features(text: str, m: regex.Match) -> tuple[str, ...]:
    """What is seen of a candidate: its form, whether it is closed, and signs that it is ordinary text after all."""
    kind, form = m.lastgroup.split("__")
    found, before = m.group(), text[max(0, m.start() - 40) : m.start()]
    seen = [f"{kind}.{form}"]
    if kind == "latex" and found.startswith("\\") and form in ("command", "escape") and _PATH.search(before) and regex.search(r"(?:^|[\s(\"'])[A-Za-z]:[\\\w.\- ]*$|(?:^|\s)\\\\[\w.-]+[\\\w.-]*$|[\w.-]\\[\w.\\-]*$", before + ""):
        seen.append("in_path")
    elif form == "command" and before.endswith("\\"):
        seen.append("in_path")
    if form in ("math",) and (_MONEY.match(found) or not regex.search(r"[\\^_={}+*/<>]|^\$\w{1,2}\$$", found)):
        seen.append("like_money")
    if kind == "markdown" and form in ("emphasis", "strong") and "_" == found[0] and regex.search(r"\w$", before):
        seen.append("in_name")
    if form == "emphasis" and not regex.search(r"\p{L}", found):
        seen.append("no_letters")
    if kind == "wiki" and form == "quotes" and not regex.search(r"[\p{L}\p{N}]", text[m.start() : m.end() + 3]):
        seen.append("no_letters")
    if form == "setext" and not regex.search(r"\p{L}[^\n|]*\n$", before):
        seen.append("no_letters")
    return tuple(seen)


#: Labelled pages: (text, its kinds of markup). They name the forms of each kind and ordinary text that looks alike.
LABELLED = [
    ("<p>One <b>two</b> three<br/>four</p>", "html"), ("x &amp; y &ndash; z &#8230;", "html"), ("<!-- draft --> text", "html"),
    ("<script>var a = 1;</script>after", "html"), ("see <a href='#x' title=\"cut", "html"), ("<pre><code>x = 1</code></pre>", "html"),
    ("&lt;b&gt;shown&lt;/b&gt;", "html"), ("H<sub>2</sub>O <EM>so</EM> <!DOCTYPE html>", "html"), ("<ul><li>a</li></ul></div", "html"),
    ("**bold** and *soft* and __strong__ and _low_", "markdown"), ("# Title\ntext\n## Next", "markdown"), ("Title\n=====\ntext", "markdown"),
    ("a `code` b\n```py\nx = 1\n```\n", "markdown"), ("[link](page.md) ![image](p.png)", "markdown"), ("text.[^1]\n[^1]: note", "markdown"),
    ("> quoted\n- [x] done\n- [ ] open", "markdown"), ("| a | b |\n|---|:-:|\n| 1 | 2 |", "markdown"), ("~~gone~~ <https://example.org>\n***\n", "markdown"),
    ("''soft'' and '''bold''' and [[page|word]] [[cut|off", "wiki"), ("== Heading ==\ntext {{cite|x}} {{cut|y", "wiki"),
    ("{| class=x\n|-\n! a !! b\n| c || d\n|}", "wiki"), ("[[File:x.svg|thumb|y]] [[Category:Z]] ~~~~\n__NOTOC__", "wiki"),
    ("\\textbf{x} and \\emph{y} of 95\\,\\% ~\\cite{z}", "latex"), ("$x_{1} = \\frac{1}{2}$ and $r^5$ and $t = 7$ and $k$", "latex"),
    ("\\begin{itemize}\n\\item a\n\\end{itemize}", "latex"), ("\\[ E = k^2 \\] with \\(k \\to 1\\) $$\\sum_{i} a_i$$", "latex"),
    ("It costs $5 to $9 here, see item #4.", ""), ("The log lies in C:\\notes\\run.txt -> copy it.", ""),
    ("C:\\alpha\\beta\\gamma and D:\\x\\y", ""), ("\\\\server\\share\\file", ""), ("Keep x < 20 and y > 2; a == b, 3 * 4 = 12 and 2 * 3 * 4.", ""),
    ("set max_flow_rate before min_a_level_b", ""), ("R&D plan, {a, b}, ~7 & two, [25] and (fig. 4)", ""), ("- a\n- b\n* c\n1. d\n2) e", ""),
    ("'one' and 'two' rule", ""), ("a -- b --- c", ""), ("5 ** 2 and 4 _ 4", ""), ("* * 12 * 13 *", ""),
]


#: How many pages the weights are learned from, the seed of their composition, and what is added to each count.
PAGES, SEED, SMOOTHING = 600, 29, 0.5
#: Words of the ordinary sentences between the labelled passages.
_ORDINARY = "the water of a valley falls while every house near it keeps its light and no road leads to an old bridge after rain so two farmers measure what is left in their fields each year".split()


def labelled_pages(n: int = PAGES, seed: int = SEED) -> list[tuple[str, list[tuple[int, int, str]]]]:
    """Pages composed of ordinary sentences and passages of LABELLED, with the labels of the passages: (text, [(start, end,
    kinds)]). The same in every run."""
    rng, pages = random.Random(seed), []
    for _ in range(n):
        parts, spans, size = [], [], 0
        for k in range(rng.randrange(2, 7)):
            if k % 2:
                text, kinds = rng.choice(LABELLED)
                spans.append((size, size + len(text), kinds))
            else:
                text = " ".join(rng.choice(_ORDINARY) for _ in range(rng.randrange(5, 25))).capitalize() + "."
            parts.append(text)
            size += len(text) + 1
        pages.append(("\n".join(parts), spans))
    return pages


@lru_cache(1)
def weights() -> dict[str, float]:
    """Log-odds of each feature for ordinary text against tags, learned from the labelled pages; ``word`` is that of a word.

    A candidate is a tag if it begins in a passage of its kind, else ordinary. It counts for its most special feature: a
    sign of ordinary text stands for the form beside it. A form that no page has counts as a tag seen once.
    """
    tag, other, words = Counter(), Counter(), Counter()
    for text, spans in labelled_pages():
        inside = 0
        for m in _LEXER.finditer(text):
            kinds = next((k for a, b, k in spans if a <= m.start() < b), "")
            is_tag = m.lastgroup.split("__")[0] in kinds.split()
            (tag if is_tag else other)[features(text, m)[-1]] += 1
            inside += is_tag and len(_WORD.findall(m.group()))
        words["tag"] += inside
        words["all"] += len(_WORD.findall(text))
    forms = {f"{kind}.{form}" for kind, form, _ in _FORMS}
    out = defaultdict(float)
    for f in {*tag, *other, *forms}:
        out[f] = log((other[f] + SMOOTHING) / (tag[f] + SMOOTHING + (f not in tag and f not in other)))
    out["word"] = log((words["all"] - words["tag"] + SMOOTHING) / (words["tag"] + SMOOTHING))
    return dict(out)


def lex(text: str) -> list[tuple[int, int, str, str, float]]:
    """Tags of a text: (start, end, kind, form, score), all with a negative score."""
    known, out, at = weights(), [], 0
    while place := _START.search(text, at):
        m = _LEXER.match(text, place.start())
        if not m:
            at = place.start() + 1
            continue
        score = known.get(features(text, m)[-1], 0.0)
        kind, form = m.lastgroup.split("__")
        if score < 0 and m.end() > m.start():
            out.append((m.start(), m.end(), kind, form, score))
            at = m.start() + max(1, _lead(form, m.group()))
        else:
            at = m.start() + 1
    return out


def _lead(form: str, found: str) -> int:
    """How much of a form to pass over: all of a closed one, but only the beginning of what is cut off or encloses
    text, so that the rest is read as well."""
    if form == "fence":
        return len(found) if regex.search(r"\n[ \t]*(?:```|~~~)[ \t]*$", found) else len(found.partition("\n")[0])
    if form == "script":
        return len(found) if "</" in found else found.find(">") + 1
    if form == "comment":
        return len(found) if found.endswith("-->") else 4
    if form == "display":
        return len(found) if len(found) > 3 and found.endswith(("$$", "\\]")) else 2
    if form == "inline":
        return len(found) if found.endswith("\\)") else 2
    if form == "template":
        return len(found) if found.endswith("}}") else 2
    if form == "heading":
        return len(found) - len(found.lstrip(" #="))
    return len(found)


def best_run(parts: list[tuple[int, int, float]]) -> tuple[int, int, float]:
    """The contiguous run of scored parts with the greatest sum, as (start, end, sum), by one linear scan; (0, 0, 0) if no
    part has a positive score."""
    best, total, begin = (0, 0, 0.0), 0.0, 0
    for i, (_, end, score) in enumerate(parts):
        if total <= 0:
            total, begin = 0.0, i
        total += score
        if total > best[2]:
            best = (parts[begin][0], end, total)
    return best


def _parts(text: str, tags: list[tuple[int, int, str, str, float]], word: float, tag) -> list[tuple[int, int, float]]:
    """Words and tags of a text in order with their scores; words within a tag belong to it."""
    parts, at = [], 0
    for found in tags:
        start, end = found[:2]
        if start < at:
            continue
        parts += [(m.start(), m.end(), word) for m in _WORD.finditer(text, at, start)]
        parts.append((start, end, tag(found)))
        at = end
    return parts + [(m.start(), m.end(), word) for m in _WORD.finditer(text, at)]


def markup_regions(text: str) -> dict[str, tuple[int, int]]:
    """Per kind of markup the region of a text that is most markup of that kind: the maximum-scoring run where its tags
    score positive, words negative and other tags nothing. Kinds without a run of positive sum are absent.

    The scores are those of ``content_region`` turned round. Tags within other tags are of the run too.
    """
    tags = lex(text)
    out = {}
    for kind in dict.fromkeys(t[2] for t in tags):
        own = [t for t in tags if t[2] == kind]
        start, end, total = best_run(_parts(text, own, -weights()["word"], lambda t: -t[4]))
        if total > 0:
            out[kind] = (start, end)
    return out


def kinds_of(text: str | None) -> list[str]:
    """The kinds of markup a text holds, complete or cut off, in the order of KINDS: those that have a region. Null and
    empty texts hold none."""
    if not text:
        return []
    found = markup_regions(text)
    return [k for k in KINDS if k in found]


def content_region(text: str, tags: list[tuple[int, int, str, str, float]]) -> tuple[int, int]:
    """The contiguous region with the greatest sum of word and tag scores; the whole text where nothing is positive.
    Scripts and comments count for each of their words."""

    def score(t: tuple[int, int, str, str, float]) -> float:
        return t[4] * (1 + len(_WORD.findall(text, t[0], t[1])) if t[3] in ("script", "comment") else 1)

    start, end, total = best_run(_parts(text, tags, weights()["word"], score))
    return (start, end) if total > 0 else (0, len(text))


def _without_tag_lines(part: str, tags: list[tuple[int, int, str, str, float]], offset: int) -> str:
    out, at = [], offset
    for line in part.splitlines(keepends=True):
        tagged = any(t[2] == "html" and t[0] < at + len(line) and t[1] > at for t in tags)
        held = regex.search(r"(?i)</?(?:pre|code|li|td|th|h[1-6])\b", line)
        if not tagged or held or len(_WORD.findall(regex.sub(r"<[^>]*>", " ", line))) > 2:
            out.append(line)
        at += len(line)
    return "".join(out)


_BLOCK = regex.compile(r"</?(?:p|div|section|article|ul|ol|table|tr|blockquote|pre|h[1-6]|dl|dd|dt|header|footer|figure)\b[^>]*>|<br\s*/?>|<hr\s*/?>", regex.I)


def clean_text(text: str | None) -> str | None:
    """The text without markup: headings as ``# ``, list items as ``- ``, tables as rows with `` | ``, code and
    formulas as they are. A text without markup stays as it is; null stays null.
    """
    if not text:
        return text
    tags = lex(text)
    if not tags:
        return text
    begin, end = content_region(text, tags)
    # beyond the content only lines that are little more than tags go; sentences stay wherever they stand
    body = _without_tag_lines(text[:begin], tags, 0) + text[begin:end] + _without_tag_lines(text[end:], tags, end)
    kept: list[str] = []

    def hold(value: str) -> str:
        kept.append(value)
        return f"\x02{len(kept) - 1}\x03"

    kinds = {t[2] for t in tags}
    if "html" in kinds:
        body = _html(body, hold)
    if "latex" in kinds:
        body = _latex(body, hold)
    if "wiki" in kinds:
        body = _wiki(body)
    if "markdown" in kinds:
        body = _markdown(body, hold)
    while "\x02" in body:
        body = regex.sub(r"\x02(\d+)\x03", lambda m: kept[int(m[1])], body)
    body = regex.sub(r"[ \t]+(?=\n|$)", "", body)
    return regex.sub(r"\n{3,}", "\n\n", body).strip("\n")


def _html(s: str, hold) -> str:
    s = regex.sub(r"(?is)<!--.*?-->|<(script|style)\b[^>]*>.*?</\1\s*>|(?:<!--|<(?:script|style)\b)[^\n]*|<!DOCTYPE[^>\n]*>?", "", s)
    s = regex.sub(r"(?is)<pre\b[^>]*>(.*?)</pre\s*>", lambda m: "\n" + hold(html.unescape(regex.sub(r"</?code\b[^>]*>", "", m[1]))) + "\n", s)
    s = regex.sub(r"(?is)<code\b[^>]*>(.*?)</code\s*>", lambda m: hold(html.unescape(m[1])), s)
    s = regex.sub(r"(?i)<h([1-6])\b[^>]*>\s*([^\n]*?)\s*(?:</h\1\s*>|(?=\n|$))", lambda m: f"\n{hold('#' * int(m[1]))} {m[2]}\n", s)
    s = regex.sub(r"(?i)<li\b[^>]*>\s*", lambda m: "\n" + hold("- "), s)
    s = regex.sub(r"(?i)</t[dh]\s*>\s*<t[dh]\b[^>]*>", lambda m: hold(" | "), s)
    s = _BLOCK.sub("\n", s)
    s = regex.sub(rf"(?i)</?{_E}\b(?:\s+[\w:-]+(?:\s*=\s*(?:\"[^\"]*\"|'[^']*'|[^\s>\"']+))?)*\s*/?>", "", s)
    s = regex.sub(rf"(?i)<{_E}\s+[\w:-]+\s*=\s*(?:\"[^\"<>\n]*|'[^'<>\n]*)[^<>\n]*|</{_E}\b$|<{_E}$", "", s)
    return html.unescape(s)


def _latex(s: str, hold) -> str:
    s = regex.sub(r"(?s)\$\$.*?\$\$|\\\[.*?\\\]|\\\((?:[^\\\n]|\\(?!\)))*(?:\\\))?|(?<![\w$\\])\$(?=\S)(?!\d[\d.,]*\s)[^$\n]+?(?<=\S)\$(?![\w$])", lambda m: hold(m[0]), s)
    s = regex.sub(r"(?s)\\begin\{(equation|align|math|displaymath|verbatim|lstlisting)\*?\}\n?(.*?)(?:\\end\{\1\*?\}|\n\n|$)", lambda m: hold(m[2].strip("\n")) + "\n", s)
    s = regex.sub(r"\\(?:(sub)*section|chapter|paragraph)\*?\{([^{}\n]*)\}?", lambda m: f"{hold('#' * (1 + len(m.captures(1))))} {m[2]}", s)
    s = regex.sub(r"(?s)\\begin\{tabular\}(?:\{[^{}]*\})?(.*?)(?:\\end\{tabular\}|\n\n|$)", lambda m: regex.sub(r"[ \t]*\\\\[ \t]*", "\n", m[1].replace("\\hline", "").replace("&", "|")), s)
    s = regex.sub(r"\\item(?:\[[^\]]*\])?[ \t]*", lambda m: hold("- "), s)
    s = regex.sub(r"~?\\(?:label|ref|cite\w*|footnote|includegraphics|usepackage|documentclass|vspace|hspace)\*?(?:\[[^\]]*\])?(?:\{[^{}\n]*\}?)?", "", s)
    s = regex.sub(r"\\(?:begin|end)\{[^{}\n]*\}?(?:\{[^{}\n]*\})?", "", s)
    for _ in range(3):
        s = regex.sub(r"(?<![\w:.])\\[a-zA-Z]+\*?\{([^{}\n]*)\}?", r"\1", s)
    s = regex.sub(r"\\([%&#_$])", r"\1", s)
    return regex.sub(r"\\[,;: ]", " ", s)


def _wiki(s: str) -> str:
    s = regex.sub(r"\{\{(?=[^{}]*[|:#])[^{}]*\}\}|\{\{[^{}\n]*[|:#][^{}\n]*", "", s)
    s = regex.sub(r"\{\{([^{}\n]*)(?:\}\})?", r"\1", s)  # a name alone may be a word of the sentence
    s = regex.sub(r"\[\[(?:Category|Kategorie|Catégorie|Categoría)\s*:[^\[\]\n]*(?:\]\])?", "", s)
    s = regex.sub(r"\[\[(?:File|Image|Datei|Bild|Fichier|Archivo)\s*:[^\[\]\n|]*((?:\|[^\[\]\n|]*)*)(?:\]\])?", lambda m: m[1].rpartition("|")[2] if "|" in m[1] else "", s)
    s = regex.sub(r"\[\[(?:[^\[\]\n|]*\|)?([^\[\]\n|]*)(?:\]\])?", r"\1", s)
    s = regex.sub(r"(?m)^(={2,6})[ \t]*(.*?)[ \t]*\1[ \t]*$", lambda m: f"{'#' * len(m[1])} {m[2]}", s)
    s = regex.sub(r"(?m)^[ \t]*(?:\{\|.*|\|\}|\|-.*)$\n?", "", s)
    s = regex.sub(r"(?m)^[ \t]*[!|](?!\[)[ \t]*(.*)$", lambda m: regex.sub(r"[ \t]*(?:!!|\|\|)[ \t]*", " | ", m[1]), s)
    return regex.sub(r"'{2,5}|~{3,5}(?=\s|$)|__(?:TOC|NOTOC|FORCETOC|NOEDITSECTION|INDEX|NOINDEX)__", "", s)


def _markdown(s: str, hold) -> str:
    s = regex.sub(r"(?ms)^[ \t]*(?:```|~~~)[\w+-]*[ \t]*\n(.*?)\n[ \t]*(?:```|~~~)[ \t]*$", lambda m: hold(m[1]), s)
    s = regex.sub(r"(?m)^[ \t]*(?:```|~~~)[\w+-]*[ \t]*$\n?", "", s)
    s = regex.sub(r"``?([^`\n]+)``?", lambda m: hold(m[1]), s)
    s = regex.sub(r"!\[([^\]\n]*)\](?:\([^()\n]*\)?)?", r"\1", s)
    s = regex.sub(r"(?<!\[)\[([^\[\]\n]+)\]\((?!\s)[^()\n]*\)?", r"\1", s)
    s = regex.sub(r"(?m)^\[\^[^\]\s]+\]:[ \t]*|\[\^[^\]\s]+\]", "", s)
    s = regex.sub(r"(?m)^([^\n|]*\w[^\n|]*)\n {0,3}(=|-)\2+[ \t]*$", lambda m: f"{'#' if m[2] == '=' else '##'} {m[1].strip()}", s)
    s = regex.sub(r"(?m)^[ \t]*\|?[ \t]*:?-{2,}:?[ \t]*(?:\|[ \t]*:?-+:?[ \t]*)+\|?[ \t]*$\n?", "", s)
    s = regex.sub(r"(?m)^[ \t]*\|[ \t]*(.*?)[ \t]*\|[ \t]*$", r"\1", s)
    s = regex.sub(r"(?m)^ {0,3}(?:(?:\*[ \t]*){3,}|(?:-[ \t]*){3,}|(?:_[ \t]*){3,})$", "", s)
    s = regex.sub(r"(?m)^ {0,3}>[ \t]?", "", s)
    s = regex.sub(r"(?m)^([ \t]*)[-*+][ \t]+\[[ xX]\]", r"\1-", s)
    s = regex.sub(r"\*\*(?=\S)([^\n]+?)(?<=\S)\*\*|(?<![\w_])__(?=[^\s_])([^\n]+?)(?<=[^\s_])__(?![\w_])|~~(?=\S)([^\n]+?)(?<=\S)~~", lambda m: m[1] or m[2] or m[3], s)
    return regex.sub(r"(?<![\w*\\])\*(?=[^\s*])([^*\n]+?)(?<=[^\s*])\*(?![\w*])|(?<![\w_\\])_(?=[^\s_])([^_\n]+?)(?<=[^\s_])_(?![\w_])", lambda m: m[1] or m[2], s)


def _chunks(chunks: DataFrame) -> DataFrame:
    return chunks.where(F.col("id").isNotNull()).select("id", "content")


def markup_kinds(chunks: DataFrame) -> DataFrame:
    """``id, markup``: one row per text and kind. Null and empty texts give none; exact repeats count once.

    Texts without any sign that markup needs never leave the JVM. Only ``id`` and ``content`` are read.
    """

    def run(batches):
        for pdf in batches:
            yield pd.DataFrame([(i, k) for i, t in zip(pdf["id"], pdf["content"]) for k in kinds_of(t)], columns=["id", "markup"])

    return _chunks(chunks).where(F.col("content").rlike(SIGNS)).mapInPandas(run, "id long, markup string").distinct()


def cleaned(chunks: DataFrame) -> DataFrame:
    """``id, content``: each text once, without its markup. Texts without markup and nulls are unchanged."""

    def run(batches):
        for pdf in batches:
            yield pdf.assign(content=[clean_text(t) for t in pdf["content"]])

    marked = F.coalesce(F.col("content").rlike(SIGNS), F.lit(False))
    texts = _chunks(chunks)
    return texts.where(marked).mapInPandas(run, "id long, content string").unionByName(texts.where(~marked)).dropDuplicates(["id"])
