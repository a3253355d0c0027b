"""Text functions as Column expressions: everything here stays inside the JVM and visible to the optimizer."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from textloom.functions import words

#: White space as Python's regular expressions see it, spelled out so that every engine agrees.
SPACE = r"[\t-\r\x{1c}-\x{20}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
NOT_SPACE = SPACE.replace("[", "[^", 1)
STEM_RX = "^(.{2,}?)(?:" + "|".join(words.STEM_SUFFIXES) + ")$"
# The patterns of sentences, paragraphs, spans, chunks and words.
SENTENCE_RX = r"[^.!?]+(?:[.!?]+|$)"
PARAGRAPH_RX = r"[^\n]+(?:\n[^\n]+)*|\n+"
SPAN_RX = r"[^.!?\n]+(?:[.!?]+|$)"
CHUNK_RX = r"[^.!?]+[.!?]+(?:\s+|$)|[^.!?]+$"
WORD_RX = r"[A-Za-z]+(?:'[A-Za-z]+)?"
ESSAY_WORD_RX = r"[A-Za-z]+(?:['’-][A-Za-z]+)*"
LATIN_RX = "[A-Za-zÁÉÍÓÚÜÑáéíóúüñ]+"


def _all(text: Column, rx: str) -> Column:
    return F.regexp_extract_all(text, F.lit(rx), F.lit(0))


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with the value computed once a row: inside higher-order functions a captured expression is computed for every element."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def strip(text: Column) -> Column:
    """Without white space at both ends (Spark's trim takes spaces only)."""
    return F.regexp_replace(text, f"^{SPACE}+|{SPACE}+$", "")


def stem(word: Column) -> Column:
    """One suffix off, the first in order that leaves two letters."""
    return F.regexp_replace(word, STEM_RX, "$1")


def search_tokens(text: Column) -> Column:
    """Terms of the search index: ASCII words in lower case without stop words and single letters, stemmed. Null gives null."""
    stop = [w for w in words.SEARCH_STOPWORDS if "'" not in w]  # words are cut at apostrophes; isin is a hash lookup
    return F.transform(F.filter(_all(F.lower(text), "[a-zA-Z]+"), lambda w: (F.length(w) > 1) & ~w.isin(stop)), stem)


def clean(text: Column) -> Column:
    """Lower case, Latin and Russian letters only, single spaces."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(text), r"[^a-zıſа-яё\s]", " "), r"\s+", " "))


def clean_tokens(text: Column) -> Column:
    return F.filter(F.split(clean(text), " "), lambda w: w != "")


def char_ngrams(text: Column, n: int = 5) -> Column:
    """All character n-grams of length 1..n of the words, each padded with an underscore at both ends."""
    padded = F.transform(clean_tokens(text), lambda w: F.concat(F.lit("_"), w, F.lit("_")))

    def of(word: Column) -> Column:
        sizes = F.sequence(F.lit(1), F.least(F.lit(n), F.length(word)))
        return F.flatten(F.transform(sizes, lambda k: F.transform(F.sequence(F.lit(1), F.length(word) - k + 1), lambda i: F.substring(word, i, k))))

    return F.flatten(F.transform(padded, of))


def char_windows(text: Column, width: int = 120, step: int = 60, least: int = 20) -> Column:
    """Overlapping windows of the clean text that have more than `least` characters without their outer spaces."""
    def cut(body: Column) -> Column:
        starts = F.when(F.length(body) > 0, F.sequence(F.lit(0), F.length(body) - 1, F.lit(step))).otherwise(F.array().cast("array<int>"))
        return F.filter(F.transform(starts, lambda i: F.trim(F.substring(body, i + 1, F.lit(width)))), lambda w: F.length(w) > least)

    return let(clean(text), cut)


def summary_terms(text: Column, language: str | Column) -> Column:
    """Terms of the summariser: Latin words of two letters or more, lower case, without the language's stop words. The language
    can be a column; other languages than the known ones have no terms."""
    if isinstance(language, str) and language not in words.SUMMARY_STOPWORDS:
        raise ValueError(f"no stop words for {language}")
    given = F.lit(language) if isinstance(language, str) else language
    found = F.filter(F.transform(_all(text, LATIN_RX), F.lower), lambda w: F.length(w) > 1)
    terms = F.lit(None).cast("array<string>")
    for name in words.SUMMARY_STOPWORDS:
        terms = F.when(given == name, F.filter(found, _outside(words.SUMMARY_STOPWORDS[name]))).otherwise(terms)
    return terms


def _outside(stop: list[str]) -> Callable[[Column], Column]:
    return lambda w: ~w.isin(stop)


def essay_words(text: Column) -> Column:
    return F.transform(_all(text, ESSAY_WORD_RX), F.lower)


def essay_paragraphs(text: Column) -> Column:
    return F.size(F.filter(F.split(text, r"\n\s*\n"), lambda p: p.rlike(NOT_SPACE)))


def essay_sentences(text: Column) -> Column:
    return F.size(F.filter(F.split(text, "[.!?]+"), lambda p: p.rlike(NOT_SPACE)))


def has_marker(text: Column, kind: str) -> Column:
    low = F.lower(text)
    out = F.lit(False)
    for phrase in words.ESSAY_MARKERS[kind]:
        out = out | F.contains(low, F.lit(phrase))
    return out


def speech_chunks(text: Column) -> Column:
    return _all(text, CHUNK_RX)


def translation_spans(text: Column) -> Column:
    """Sentences of the translator: stripped spans that hold a word; a line's unfinished rest is lost."""
    return F.transform(F.filter(_all(text, SPAN_RX), lambda s: s.rlike(WORD_RX)), strip)


def escape_html(text: Column) -> Column:
    for char, name in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;")):
        text = F.replace(text, F.lit(char), F.lit(name))
    return text


def extension(path: Column) -> Column:
    """Lower-case extension after the last dot; empty without one."""
    return F.when(F.contains(path, F.lit(".")), F.lower(F.substring_index(path, ".", -1))).otherwise("")


def allowed(path: Column, extensions: list[str]) -> Column:
    return extension(path).isin(extensions)


def title_of(path: Column) -> Column:
    """File name without its folder and its last extension."""
    name = F.substring_index(path, "/", -1)
    return F.regexp_replace(name, r"(?<=.)\.[^.]*$", "")


def title_of_text(text: Column, most: int = 80) -> Column:
    """The first characters of a text, as a title where none is given."""
    return F.left(strip(F.coalesce(text, F.lit(""))), F.lit(most))


def bounded(value: Column, infinite: float = 1e9) -> Column:
    """NaN to 0, infinities to the largest value shown."""
    return F.when(F.isnan(value), 0.0).when(value == float("inf"), infinite).when(value == float("-inf"), -infinite).otherwise(value)


def word_forms(word: Column) -> Column:
    """Dictionary forms to try for an English word, in order."""
    w = F.lower(word)

    def cut(n: int, more: str = "") -> Column:
        return F.concat(F.left(w, F.length(w) - n), F.lit(more))

    def when(suffix: str, longer: int, value: Column) -> Column:
        return F.when(w.endswith(suffix) & (F.length(w) > longer), value)

    forms = [w, when("ies", 4, cut(3, "y")), when("ing", 5, cut(3)), when("ing", 5, cut(3, "e")), when("ed", 4, cut(2)), when("ed", 4, cut(1)), when("es", 4, cut(2)), when("s", 3, cut(1))]
    return F.array_distinct(F.array_compact(F.array(*forms)))


def command(phrase: Column) -> Column:
    """A spoken phrase in the form commands are compared in."""
    return strip(F.regexp_replace(F.lower(phrase), "[.!?]+$", ""))


def meaning(tag: Column) -> Column:
    table = F.create_map(*[F.lit(x) for pair in words.TAG_MEANINGS.items() for x in pair])
    return F.coalesce(F.try_element_at(table, tag), F.lit(words.OTHER_TAG))


def result_sentence(n_words: Column, n_sentences: Column, n_paragraphs: Column, found: Column) -> Column:
    return F.format_string("%d words, %d sentences, %d paragraphs. %d of 3 structure signals found.", n_words, n_sentences, n_paragraphs, found)
