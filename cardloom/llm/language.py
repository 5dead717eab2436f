"""Language of a short text by its function words and script."""

from __future__ import annotations

from collections.abc import Iterable

import regex

#: Frequent function words of each language; words that several share count for all of them.
FUNCTION_WORDS = {
    "en": "the of and to in is it its that a an for with as was on are by this from at which or be not has have when why how what does do can than then if because while after before between through during without unlike within every each most more less one no into near who their there keep",
    "de": "der die das und ist ein eine einer eines einem einen den dem des zu in im mit von für auf nicht sich auch nach bei aus wenn weil ohne bevor jede jeder jedes ihre ihr seine warum wie was welche welcher welches wird werden sind hat an keine kein etwa lang über unter zwischen durch",
    "fr": "le la les un une des de du et est que qui dans pour sur avec au aux ce cette ces son sa ses par plus ne pas se sans quand comme avant après chaque aucune aucun elle il à en y quelle quel comment pourquoi où pendant près sont ou",
    "es": "el la los las un una unos unas de del y es que en por para con no su sus se al lo como cuando sin antes después cada ninguna ningún más qué cómo cuál cuáles dónde durante cerca entre sobre desde son pero o",
}
#: Names of the languages as questions use them.
NAMES = {
    "en": ("english", "englisch", "anglais", "inglés", "inglesa", "英語"),
    "de": ("german", "deutsch", "allemand", "alemán", "alemana", "ドイツ語"),
    "fr": ("french", "französisch", "français", "francés", "francesa", "フランス語"),
    "es": ("spanish", "spanisch", "espagnol", "español", "española", "スペイン語"),
    "ja": ("japanese", "japanisch", "japonais", "japonés", "japonesa", "日本語"),
}
#: Letters and signs that point to a language.
LETTERS = {"de": "äöüÄÖÜß", "fr": "çèêàùœëîïÀÈÊÇ", "es": "ñáíóú¿¡Ñ"}
_LETTER_OF = {letter: language for language, letters in LETTERS.items() for letter in letters}
_WORD = regex.compile(r"\p{L}[\p{L}\p{M}]*")
_KANA = regex.compile(r"[\p{Hiragana}\p{Katakana}\p{Han}]")
_OF: dict[str, list[tuple[str, float]]] = {}
for _language, _words in FUNCTION_WORDS.items():
    for _word in _words.split():
        _OF[_word] = [*_OF.get(_word, []), (_language, 0.0)]
_OF = {word: [(language, 1 / len(of)) for language, _ in of] for word, of in _OF.items()}


def scores(words: Iterable[str]) -> dict[str, float]:
    """Function words found, by language; one that several languages have counts for each of them in part."""
    out: dict[str, float] = {}
    for of in filter(None, map(_OF.get, words)):
        for language, weight in of:
            out[language] = out.get(language, 0) + weight
    return out


def is_japanese(text: str) -> bool:
    """Whether ``language_of`` would say so; it counts no words."""
    return not text.isascii() and len(_KANA.findall(text)) * 3 > len(text.strip())


def language_of(text: str, words: list[str] | None = None) -> tuple[str, float]:
    """The likeliest language ("" if nothing tells) and by how many function words it leads the next one. ``words`` are
    the text's words in lower case, where they are known already."""
    if not text.isascii() and (n := len(_KANA.findall(text))) * 3 > len(text.strip()):
        return "ja", float(n)
    found = scores(_WORD.findall(text.lower()) if words is None else words)
    if not text.isascii():
        for letter in set(text):
            if of := _LETTER_OF.get(letter):
                found[of] = found.get(of, 0) + 0.5
    ranked = sorted(found.items(), key=lambda x: (-x[1], x[0]))
    if not ranked:
        return "", 0.0
    return ranked[0][0], ranked[0][1] - (ranked[1][1] if len(ranked) > 1 else 0)
