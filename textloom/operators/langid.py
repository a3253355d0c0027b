"""Language identification by frequent words, by short words and by character n-grams."""

from __future__ import annotations

import time

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from textloom.functions.text import clean_tokens
from textloom.session import checkpoint, small

TOP_WORDS = 250
SHORT_LETTERS, SHORT_COUNT = 5, 3
LANGUAGES = ("ru", "en")
#: Distinct words of all profiles up to which they are broadcast.
BROADCAST_WORDS = 200_000


def word_counts(training: DataFrame) -> DataFrame:
    """(lang, word, n, first) of training texts (lang, doc_id, text); `first` orders words by their first occurrence."""
    words = training.select("lang", "doc_id", F.posexplode(clean_tokens(F.col("text"))).alias("pos", "word"))
    return words.groupBy("lang", "word").agg(F.count("*").alias("n"), F.min(F.struct("doc_id", "pos")).alias("first"))


def _probabilities(kept: DataFrame) -> DataFrame:
    """Shares of the kept words' occurrences; totals are one row a language and broadcast."""
    totals = kept.groupBy("lang").agg(F.sum("n").alias("total"), F.min("n").alias("least"))
    prob = F.col("n") / F.col("total")
    return kept.join(F.broadcast(totals), "lang").select("lang", "word", "n", prob.alias("prob"), (0.1 * (F.col("least") / F.col("total"))).alias("min_prob"))


def frequent_profile(counts: DataFrame, top: int = TOP_WORDS) -> DataFrame:
    """(lang, word, n, prob, min_prob): the most frequent words, ties by first occurrence; shares of these words' occurrences.

    The rank is limited before the shuffle, so a task gets `top` words of every partition at most."""
    order = W.partitionBy("lang").orderBy(F.desc("n"), "first")
    return _probabilities(counts.withColumn("r", F.row_number().over(order)).where(F.col("r") <= top).select("lang", "word", "n"))


def short_profile(counts: DataFrame, letters: int = SHORT_LETTERS, least: int = SHORT_COUNT) -> DataFrame:
    """(lang, word, n, prob, min_prob) of the words of at most `letters` letters that occur more than `least` times; of all
    short words in a language where none does."""
    short = counts.where(F.length("word") <= letters)
    some = F.broadcast(short.groupBy("lang").agg(F.max(F.col("n") > least).alias("some")))
    return _probabilities(short.join(some, "lang").where((F.col("n") > least) | ~F.col("some")).select("lang", "word", "n"))


def log_likelihoods(documents: DataFrame, profile: DataFrame, letters: int | None = None) -> DataFrame:
    """(doc_id, lang, score): the sum of ln p over the words, unknown ones with the profile's min_prob; -inf without words.

    Words a language does not know all add the same, so they are only counted; what the known ones add beyond that is
    joined, and combined per document before the one shuffle. The profile is broadcast if its size allows that. There is one
    floor a language."""
    profile = checkpoint(profile)
    floors = profile.groupBy("lang").agg(F.log(F.max("min_prob")).alias("floor")).collect()  # one row a language
    fits = lambda w: F.length(w) <= letters if letters is not None else F.lit(True)
    sizes = documents.select("doc_id", F.size(F.filter(clean_tokens(F.col("text")), fits)).alias("n"))
    each = F.array(*[F.struct(F.lit(r["lang"]).alias("lang"), F.lit(r["floor"]).alias("floor")) for r in floors]).cast("array<struct<lang:string,floor:double>>")
    every = sizes.select("doc_id", F.greatest(F.coalesce("n", F.lit(0)), F.lit(0)).alias("n"), F.inline(each))
    low = F.coalesce(*[F.when(F.col("lang") == r["lang"], F.lit(r["floor"])) for r in floors], F.lit(0.0))
    known = profile.groupBy("word").agg(F.collect_list(F.struct("lang", (F.log("prob") - low).alias("more"))).alias("logs"))
    words = documents.select("doc_id", F.explode(clean_tokens(F.col("text"))).alias("word")).where(fits(F.col("word")))
    more = words.join(small(known, BROADCAST_WORDS), "word").select("doc_id", F.inline("logs")).groupBy("doc_id", "lang").agg(F.sum("more").alias("more"))
    score = F.when(F.col("n") > 0, F.col("n") * F.col("floor") + F.coalesce("more", F.lit(0.0))).otherwise(F.lit(float("-inf")))
    return every.join(more, ["doc_id", "lang"], "left").select("doc_id", "lang", score.alias("score"))


def predicted(scores: DataFrame, languages: tuple[str, ...] = LANGUAGES) -> DataFrame:
    """(doc_id, predicted): the language with the highest score; ties, and texts without words, go to the first declared."""
    order = F.array_position(F.array(*[F.lit(x) for x in languages]), F.col("lang"))
    best = F.max_by("lang", F.struct(F.round("score", 6), -order))
    return scores.groupBy("doc_id").agg(best.alias("predicted"))


def timed(predictions: DataFrame, method: str) -> tuple[DataFrame, DataFrame]:
    """(the predictions with `method`, written out; (method, documents, mean_ms)): the wall-clock time of the whole table by document."""
    began = time.perf_counter()
    done = checkpoint(predictions.withColumn("method", F.lit(method)))
    n = done.count()
    mean = (time.perf_counter() - began) * 1000 / n if n else None
    return done, predictions.sparkSession.createDataFrame([(method, n, mean)], "method string, documents long, mean_ms double")


def accuracy(predictions: DataFrame, truth: DataFrame) -> DataFrame:
    """(method, correct, total, accuracy) over the documents with a label; accuracy in per cent, null without any."""
    labelled = truth.where(F.coalesce("true_language", F.lit("")) != "")
    joined = predictions.join(labelled, "doc_id")
    right = F.sum((F.col("predicted") == F.col("true_language")).cast("int"))
    return joined.groupBy("method").agg(right.alias("correct"), F.count("*").alias("total")).select("method", "correct", "total", (F.col("correct") * 100.0 / F.nullif("total", F.lit(0))).alias("accuracy"))


def display_percent(scores: DataFrame) -> DataFrame:
    """Adds percent: the score between the lowest (0) and the highest (100) of the document; a range of 0 counts as 1."""
    every = W.partitionBy("doc_id")
    low, high = F.min("score").over(every), F.max("score").over(every)
    return scores.withColumn("percent", (F.col("score") - low) / F.coalesce(F.nullif(high - low, F.lit(0.0)), F.lit(1.0)) * 100)
