"""English terms: a stop list and Porter's suffix rules as column expressions.

A step is an ordered list of rules; the first rule whose test fits a word decides, whether or not
its pattern then changes the word. Each step is one ``transform`` over the words of a row, so a
step names its word once however many rules it has.
"""

from __future__ import annotations

from collections.abc import Iterable
from typing import NamedTuple

from pyspark.sql import Column, functions as F

from patchloom.functions.tokens import analyse

# The common English stop list of search engines, and the "s" that possessives leave behind.
STOP_WORDS = (
    "a", "an", "and", "are", "as", "at", "be", "but", "by", "for", "if", "in", "into", "is", "it", "no", "not", "of", "on", "or",
    "s", "such", "that", "the", "their", "then", "there", "these", "they", "this", "to", "was", "will", "with",
)

_CONSONANTS = "[^aeiou][^aeiouy]*"
_VOWELS = "[aeiouy][aeiou]*"
_ANY = ".*"
_SOME = f"(?:{_CONSONANTS})?{_VOWELS}{_CONSONANTS}.*"  # measure above 0
_MORE = f"(?:{_CONSONANTS})?{_VOWELS}{_CONSONANTS}{_VOWELS}{_CONSONANTS}.*"  # measure above 1
_ONE = f"(?:{_CONSONANTS})?{_VOWELS}{_CONSONANTS}(?:{_VOWELS})?"  # measure 1
_VOICED = f"(?:{_CONSONANTS})?[aeiouy].*"  # has a vowel
_SHORT = f"{_CONSONANTS}[aeiouy][^aeiouwxy]"  # consonant, vowel, consonant of measure 1


class Rule(NamedTuple):
    """A word that ``test`` finds has what ``pattern`` finds replaced by group 1 and ``ending``."""

    test: str
    pattern: str
    ending: str


def _suffix(suffix: str, stem: str, ending: str = "") -> Rule:
    return Rule(f"{suffix}$", f"^({stem}){suffix}$", ending)


def _longest_first(stem: str, endings: dict[str, str]) -> list[Rule]:
    return [_suffix(s, stem, endings[s]) for s in sorted(endings, key=lambda s: (-len(s), s))]


# Suffixes of the published algorithm, with its two later departures ("bli", "logi").
_STEP_2 = {
    "ational": "ate", "tional": "tion", "enci": "ence", "anci": "ance", "izer": "ize", "bli": "ble", "alli": "al", "entli": "ent", "eli": "e", "ousli": "ous",
    "ization": "ize", "ation": "ate", "ator": "ate", "alism": "al", "iveness": "ive", "fulness": "ful", "ousness": "ous", "aliti": "al", "iviti": "ive",
    "biliti": "ble", "logi": "log",
}
_STEP_3 = {"icate": "ic", "ative": "", "alize": "al", "iciti": "ic", "ical": "ic", "ful": "", "ness": ""}
_STEP_4 = ("al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent", "ou", "ism", "ate", "iti", "ous", "ive", "ize")

#: An initial y is a consonant and is written Y meanwhile; "+" marks words that lost -ed or -ing.
STEPS: list[list[Rule]] = [
    [Rule("^y", "^()y", "Y")],
    [_suffix("sses", _ANY, "ss"), _suffix("ies", _ANY, "i"), _suffix("ss", _ANY, "ss"), _suffix("s", _ANY)],
    [_suffix("eed", _SOME, "ee"), _suffix("ed", _VOICED, "+"), _suffix("ing", _VOICED, "+")],
    [
        *(Rule(rf"{s}\+$", r"^(.*)\+$", "e") for s in ("at", "bl", "iz")),
        Rule(rf"(?:{'|'.join(c + c for c in 'bcdfghjkmnpqrtvwx')})\+$", r"^(.*).\+$", ""),
        Rule(rf"^{_SHORT}\+$", r"^(.*)\+$", "e"),
        Rule(r"\+$", r"^(.*)\+$", ""),
    ],
    [_suffix("y", _VOICED, "i")],
    _longest_first(_SOME, _STEP_2),
    _longest_first(_SOME, _STEP_3),
    [*_longest_first(_MORE, dict.fromkeys(_STEP_4, "")), Rule("[st]ion$", f"^({_MORE})ion$", "")],
    [Rule(f"^{_MORE}e$", "^(.*)e$", ""), Rule(f"^{_SHORT}e$", "^(.*)$", ""), Rule(f"^{_ONE}e$", "^(.*)e$", "")],
    [Rule(f"^(?:{_CONSONANTS})?{_VOWELS}{_CONSONANTS}{_VOWELS}(?:{_CONSONANTS}.*)?ll$", "^(.*)l$", "")],
    [Rule("^Y", "^()Y", "y")],
]


def _applied(word: Column, rules: Iterable[Rule]) -> Column:
    out = None
    for r in rules:
        changed = F.regexp_replace(word, r.pattern, "$1" + r.ending.replace("+", r"\+"))
        out = F.when(word.rlike(r.test), changed) if out is None else out.when(word.rlike(r.test), changed)
    return out.otherwise(word)


def _gate(rules: list[Rule]) -> str:
    """One test that fits wherever a rule of the step does."""
    return "|".join(f"(?:{r.test})" for r in rules)


def _step(words: Column, rules: list[Rule]) -> Column:
    return F.transform(words, lambda w: F.when(w.rlike(_gate(rules)), _applied(w, rules)).otherwise(w))


def stems(words: Column) -> Column:
    """Stems of an array of lower-case words; words of one or two characters stay."""
    whole = words
    for rules in STEPS:
        words = _step(words, rules)
    return F.zip_with(whole, words, lambda w, s: F.when(F.length(w) > 2, s).otherwise(w))


def english(text: Column) -> Column:
    """Stems of the lower-case words that aren't stop words; null gives null."""
    return stems(F.filter(analyse(text), lambda w: ~w.isin(*STOP_WORDS)))
