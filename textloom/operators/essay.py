"""Rule-based indicators of an essay."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from textloom.functions import words
from textloom.functions.text import essay_paragraphs, essay_sentences, essay_words, has_marker, result_sentence

# Fixed value: the notice shown with the indicators.
NOTICE = "Indicators are based on simple rules; they do not grade literary quality."
MOST_CHARS = 10_000


def acceptable(text: Column, most: int = MOST_CHARS) -> Column:
    """Texts that are analysed: not blank and not too long."""
    return text.isNotNull() & text.rlike(r"\S") & (F.length(text) <= most)


def indicators(documents: DataFrame) -> DataFrame:
    """(doc_id, word_count, sentence_count, paragraph_count, thesis, evidence, conclusion, signals, spoken) of every non-null text."""
    text = F.col("text")
    counted = documents.where("text is not null").select(
        "doc_id",
        F.size(essay_words(text)).alias("word_count"),
        essay_sentences(text).alias("sentence_count"),
        essay_paragraphs(text).alias("paragraph_count"),
        *[has_marker(text, kind).alias(kind) for kind in words.ESSAY_MARKERS],
    )
    signals = sum((F.col(kind).cast("int") for kind in words.ESSAY_MARKERS), F.lit(0))
    found = counted.withColumn("signals", signals)
    return found.withColumn("spoken", result_sentence(F.col("word_count"), F.col("sentence_count"), F.col("paragraph_count"), F.col("signals")))


def top_words(documents: DataFrame, n: int = 5) -> DataFrame:
    """(doc_id, place, word, count): the most frequent content words of more than three letters, ties by first occurrence."""
    every = documents.select("doc_id", F.posexplode(essay_words(F.col("text"))).alias("pos", "word")).where((F.length("word") > 3) & ~F.col("word").isin(words.ESSAY_STOPWORDS))
    counts = every.groupBy("doc_id", "word").agg(F.count("*").alias("count"), F.min("pos").alias("first"))
    order = W.partitionBy("doc_id").orderBy(F.desc("count"), "first")
    return counts.withColumn("place", F.row_number().over(order)).where(F.col("place") <= n).select("doc_id", "place", "word", "count")
