"""Column functions against restatements in plain Python."""

import re

import pytest
from pyspark.sql import functions as F

from inkwell import lexicons as L
from inkwell.functions import text as X

TEXTS = ["", "   ", None, "one two  three\nfour", "A b. C d! E? f", "No mark", "Mr. Smith went. He left", "x\u00a0y\u2003z", "Was 1907 or 1599, 2029-1600 and 2030.", "**Head**\n\nOne. Two. Three. Four.\n\nNext", " ".join(map(str, range(901))), "É. Ünder 1850é 1851"]


def column(spark, expression, values=TEXTS):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, text string").withColumn("x", expression)
    return [r.x for r in df.orderBy("i").collect()]


def py_windows(text, size=400, overlap=100):
    w = (text or "").split()
    return [" ".join(w[i : i + size]) for i in range(0, len(w), size - overlap)]


def py_sentences(text):
    if text is None:
        return []
    s = [x.strip() for x in re.sub(r"([.!?]+)\s+", "\\1\x01", text).split("\x01") if x.strip()]
    return s or [text]


def test_windows(spark):
    assert column(spark, X.windows(F.col("text"))) == [py_windows(t) for t in TEXTS]
    for n in (0, 1, 300, 301, 400, 401, 700):
        t = " ".join(["w"] * n)
        assert column(spark, X.windows(F.col("text")), [t]) == [py_windows(t)]
    with pytest.raises(ValueError):
        X.windows(F.col("text"), 10, 10)


def test_sentences_and_words(spark):
    assert column(spark, X.sentences(F.col("text"))) == [py_sentences(t) for t in TEXTS]
    assert column(spark, X.word_count(F.col("text"))) == [len((t or "").split()) for t in TEXTS]


def test_years(spark):
    expected = [[int(y) for y in re.findall(L.YEAR, t or "")] for t in TEXTS]
    assert column(spark, X.years(F.col("text"))) == expected
    assert column(spark, X.first_year(F.col("text"))) == [e[0] if e else None for e in expected]
    assert column(spark, X.decade(X.first_year(F.col("text"))), ["in 1907", "none"]) == ["1900", "unknown"]


def test_terms(spark):
    v = ["Bank's", "O'Hara", "Rothschilds", "Baring’s ", "new york"]
    assert column(spark, X.canonical(F.col("text")), v) == ["Bank", "OHara", "Rothschilds", "Baring’s", "new york"]
    assert column(spark, X.spellings(F.col("text")), ["Banks", "gas"]) == [["Banks", "banks", "bank"], ["gas", "Gas", "ga"]]
    assert column(spark, X.underscored(F.col("text")), ["new york"]) == ["new_york"]


def test_tags_truncation_paragraphs(spark):
    assert column(spark, X.strip_tags(F.col("text")), ["a<i>b</i>c", None]) == ["a b c", ""]
    assert column(spark, X.strip_tags(F.col("text"), ""), ["a<i>b</i>c"]) == ["abc"]
    assert column(spark, X.truncated(F.col("text"), 3), ["abcd", "abc"]) == ["abc\n\n[Truncated]", "abc"]
    assert column(spark, X.first_words(F.col("text"), 2), ["a b c", "a b"]) == ["a b...", "a b"]
    limited = column(spark, X.limited_paragraphs(F.col("text")), ["**Head**\n\nOne. Two. Three. Four\n\nNext", "", None])
    assert limited == ["**Head**\n\nOne. Two. Three.\n\nFour.\n\nNext.", "", None]
    assert column(spark, X.sentence_count(F.col("text")), ["One. Two! three", "x", "a. b. c."]) == [2, 1, 3]


def test_classifiers(spark):
    assert column(spark, X.first_match(F.col("text"), L.REGIONS, "none"), ["London and Paris", "Paris", "marked"]) == ["Britain", "France", "none"]
    assert column(spark, X.last_match(F.col("text"), L.PERIODS, L.UNDATED), ["1750 and 1850", "x", "1066"]) == ["19th century", "Undated", "Medieval"]
    assert column(spark, X.any_word(F.col("text"), ["trust"]), ["The Trust.", "trustee"]) == [True, False]
    assert column(spark, X.law_codes(F.col("text"), list(L.LAW_PREFIXES)), ["BA1933 BHCA1956 XBA1933 BA19333"]) == [["BA1933", "BHCA1956"]]
    assert column(spark, X.short_law_codes(F.col("text"), ["BA"]), ["BA33."]) == [["BA1833", "BA1933"]]
    assert column(spark, X.has_related_questions(F.col("text")), ["a?\nb?\nc?", "Related questions", "a?"]) == [True, True, False]
    assert column(spark, X.json_block(F.col("text"), "map<string,array<string>>"), ['```json\n{"a":["b"]}\n```', "broken"]) == [{"a": ["b"]}, None]
    assert column(spark, X.subphrases(F.col("text"), 2, 3), ["A b c"]) == [["a b", "b c", "a b c"]]
    assert column(spark, X.shingles(F.col("text"), 2), ["a b c", "a"]) == [["a b c", "a b", "b c"], ["a"]]


def test_all_subphrases(spark):
    assert column(spark, X.subphrases(F.col("text")), ["A b c d e f", "a b", None]) == [["a b c d e", "b c d e f", "a b c d e f"], [], []]
    assert column(spark, X.titled(F.col("text")), ["o'neil & mCKAY", ""]) == ["O'Neil & Mckay", ""]
