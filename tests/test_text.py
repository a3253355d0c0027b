import re

import pytest
from pyspark.sql import functions as F

from textloom.functions import text as fx


def one(spark, column, value):
    return spark.createDataFrame([(value,)], "t string").select(column(F.col("t")).alias("x")).first()[0]


def by_rules(word):
    """The stemmer as rules tried in order."""
    for suffix in ["ational", "ization", "iveness", "fulness", "ousness", "ing", "edly", "ed", "ies", "es", "s", "ly", "ness", "ion", "ment"]:
        if word.endswith(suffix) and len(word) >= len(suffix) + 2:
            return word[: -len(suffix)]
    return word


def test_stemmer(spark):
    known = {"databases": "databas", "database": "database", "queries": "quer", "query": "query", "class": "clas", "searches": "search", "ring": "ring", "happiness": "happines", "giveness": "givenes"}
    words = sorted(known) + ["organization", "relational", "ly", "ed", "es", "sses", "national", "statement", "actively", "edly", "cement"]
    got = {r[0]: r[1] for r in spark.createDataFrame([(w,) for w in words], "t string").select("t", fx.stem(F.col("t"))).collect()}
    assert {w: got[w] for w in known} == known
    assert got == {w: by_rules(w) for w in words}


@pytest.mark.parametrize("value, expected", [
    ("Don't STOP the Searching, x 12 databases!", ["don", "stop", "search", "databas"]),
    ("", []),
    ("the of and", []),
])
def test_search_tokens(spark, value, expected):
    assert one(spark, fx.search_tokens, value) == expected


def test_null_text(spark):
    assert one(spark, fx.search_tokens, None) is None
    assert one(spark, fx.clean_tokens, None) is None


def test_clean(spark):
    assert one(spark, fx.clean, "Привет,  World-2!\n ёж") == "привет world ёж"
    assert one(spark, fx.clean_tokens, " 12 ") == []


def test_ngrams_and_windows(spark):
    assert one(spark, fx.char_ngrams, "ab") == ["_", "a", "b", "_", "_a", "ab", "b_", "_ab", "ab_", "_ab_"]
    text = "abcdefghij " * 20
    body = text.strip()
    expected = [w for w in (body[i : i + 120].strip() for i in range(0, len(body), 60)) if len(w) > 20]
    assert one(spark, fx.char_windows, text) == expected
    assert one(spark, fx.char_windows, "") == []


def test_sentence_patterns(spark):
    assert one(spark, fx.speech_chunks, "A 3.5 b. c") == ["5 b. ", "c"]
    assert one(spark, fx.translation_spans, "Title line\nFirst one. Second 3.5 here\nTail no dot\n") == ["First one.", "Second 3.", "Tail no dot"]


def test_summary_terms(spark):
    assert one(spark, lambda c: fx.summary_terms(c, "es"), "The heart 2026 corazón y presión") == ["the", "heart", "corazón", "presión"]


def test_word_forms(spark):
    assert one(spark, fx.word_forms, "Studies") == ["studies", "study", "studi", "studie"]
    assert one(spark, fx.word_forms, "using") == ["using"]
    assert one(spark, fx.word_forms, "making") == ["making", "mak", "make"]


def test_strip_takes_all_white_space(spark):
    value = " \t x y  \x85\n"
    assert one(spark, fx.strip, value) == re.sub(r"^\s+|\s+$", "", value)


def test_paths(spark):
    assert one(spark, fx.extension, "/a.b/c") == "b/c"
    assert one(spark, fx.extension, "x.TXT") == "txt"
    assert one(spark, fx.title_of, "/a/b/file.v2.docx") == "file.v2"
    assert one(spark, fx.escape_html, "<a href=\"x\">'&'</a>") == "&lt;a href=&quot;x&quot;&gt;&#x27;&amp;&#x27;&lt;/a&gt;"


def test_bounded(spark):
    rows = spark.sql("select explode(array(double('nan'), double('inf'), double('-inf'), 1.5D)) as x").select(fx.bounded(F.col("x"))).collect()
    assert [r[0] for r in rows] == [0.0, 1e9, -1e9, 1.5]
