"""Extractive summaries and keywords."""

from __future__ import annotations

import time

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from textloom.functions.text import NOT_SPACE, PARAGRAPH_RX, SENTENCE_RX, SPACE, strip, summary_terms
from textloom.session import checkpoint

SENTENCES, KEYWORDS = 10, 12


def sentences(documents: DataFrame) -> DataFrame:
    """(doc_id, index, text, document_offset, paragraph_offset, paragraph_length) of every sentence of `text`; further columns are kept.

    Paragraphs are runs of lines that are not empty, sentences run up to their marks; numbered from 0. Pieces tile the text, so
    their places are running sums of lengths over one partitioning by document, which all that follows shares."""
    every = lambda c, rx: F.regexp_extract_all(c, F.lit(rx), F.lit(0))
    more = [c for c in documents.columns if c not in ("doc_id", "text")]
    upto = lambda *by: W.partitionBy("doc_id", *by[:-1]).orderBy(by[-1]).rowsBetween(W.unboundedPreceding, W.currentRow)
    pieces = documents.where("text is not null").select("doc_id", *more, F.posexplode(every("text", PARAGRAPH_RX)).alias("p", "par")).repartition("doc_id")
    size = F.length("par")
    paragraphs = pieces.withColumn("p0", F.sum(size).over(upto("p")) - size).where(~F.col("par").startswith("\n"))
    lead = F.length(F.regexp_extract("par", "^[.!?]+", 0))
    raw = paragraphs.select("doc_id", *more, "p", "p0", size.alias("paragraph_length"), lead.alias("lead"), F.posexplode(every("par", SENTENCE_RX)).alias("s", "raw"))
    start = F.sum(F.length("raw")).over(upto("p", "s")) - F.length("raw")
    offset = (F.col("lead") + start + F.length(F.regexp_extract("raw", f"^{SPACE}*", 0))).cast("int")
    placed = raw.withColumn("offset", offset).where(F.col("raw").rlike(NOT_SPACE))
    index = (F.row_number().over(W.partitionBy("doc_id").orderBy("p", "s")) - 1).alias("index")
    return placed.select("doc_id", *more, index, strip(F.col("raw")).alias("text"), (F.col("p0") + F.col("offset")).cast("int").alias("document_offset"), F.col("offset").alias("paragraph_offset"), "paragraph_length")


def _language(documents: DataFrame, language: str | None) -> DataFrame:
    """The documents with their language in `lang`: the one given, or their own."""
    return documents.select("doc_id", "text", F.lit(language).alias("lang") if language else F.col("lang"))


def _weighed(tf: DataFrame, documents: DataFrame) -> DataFrame:
    """Adds weight = 0.5 (1 + tf / max tf) ln(N / df) to (doc_id, lang, term, tf); the documents of each language are a corpus."""
    most = tf.withColumn("most", F.max("tf").over(W.partitionBy("doc_id")))
    df = tf.groupBy("lang", "term").agg(F.count("*").alias("df"))
    n = F.broadcast(documents.groupBy("lang").agg(F.count("*").alias("n")))  # one row a language
    weight = 0.5 * (1 + F.col("tf") / F.col("most")) * F.log(F.col("n") / F.col("df"))
    return most.join(df, ["lang", "term"]).join(n, "lang").withColumn("weight", weight)


def term_weights(documents: DataFrame, language: str | None) -> DataFrame:
    """(doc_id, term, weight) with weight = 0.5 (1 + tf / max tf) ln(N / df) over the documents of a language as the corpus."""
    docs = _language(documents, language)
    terms = docs.select("doc_id", "lang", F.explode(summary_terms(F.col("text"), F.col("lang"))).alias("term")).repartition("doc_id")
    return _weighed(terms.groupBy("doc_id", "lang", "term").agg(F.count("*").alias("tf")), docs).select("doc_id", "term", "weight")


def sentence_scores(documents: DataFrame, language: str | None = None) -> DataFrame:
    """(doc_id, index, text, score, lang): the weights of a sentence's terms, less the later it stands in document and paragraph.

    Without a language every document counts by its own column `lang`, all languages in one pass. Sentences tile the text and
    terms lie within them, so the terms of the text are those of its sentences: they are cut once."""
    docs = _language(documents, language)
    parts = sentences(docs.withColumn("n", F.greatest(F.length("text"), F.lit(1)))).withColumn("terms", summary_terms(F.col("text"), F.col("lang")))
    tf = parts.select("doc_id", "lang", "index", F.explode("terms").alias("term")).groupBy("doc_id", "lang", "term").agg(F.count("*").alias("tf"), F.collect_list("index").alias("at"))
    sums = _weighed(tf, docs).select("doc_id", F.explode("at").alias("index"), "weight").groupBy("doc_id", "index").agg(F.sum("weight").alias("s"))
    place = (1 - F.col("document_offset") / F.col("n")) * (1 - F.col("paragraph_offset") / F.greatest("paragraph_length", F.lit(1)))
    return parts.join(sums, ["doc_id", "index"], "left").select("doc_id", "index", "text", (F.coalesce("s", F.lit(0.0)) * place).alias("score"), "lang")


def select_sentences(scores: DataFrame, count: int = SENTENCES) -> DataFrame:
    """(doc_id, position, index, text, score): the best sentences in the order of the source, scores rounded to 4 places; `lang` is kept."""
    best = W.partitionBy("doc_id").orderBy(F.round("score", 9).desc(), "index")
    kept = scores.withColumn("r", F.row_number().over(best)).where(F.col("r") <= count)
    place = F.row_number().over(W.partitionBy("doc_id").orderBy("index"))
    return kept.withColumn("position", place).select("doc_id", "position", "index", "text", F.round("score", 4).alias("score"), *[c for c in ("lang",) if c in scores.columns])


def keywords(weights: DataFrame, count: int = KEYWORDS) -> DataFrame:
    """(doc_id, position, term, weight): the heaviest terms with a weight above 0."""
    order = W.partitionBy("doc_id").orderBy(F.round("weight", 9).desc(), "term")
    return weights.where("weight > 0").withColumn("position", F.row_number().over(order)).where(F.col("position") <= count).select("doc_id", "position", "term", F.round("weight", 4).alias("weight"))


def with_text(corpus: DataFrame, text: str, doc_id: int = -1) -> DataFrame:
    """The corpus and, unless one of its texts is just this one, the text under the id `doc_id`."""
    spark = corpus.sparkSession
    one = spark.createDataFrame([(doc_id, text)], "doc_id long, text string")
    return corpus.select(F.col("doc_id").cast("long"), "text").unionByName(one.join(corpus.select("text"), "text", "left_anti").select("doc_id", "text"))


def summarize(documents: DataFrame, language: str, method: str = "sentence", count: int = SENTENCES, n_keywords: int = KEYWORDS) -> tuple[DataFrame, DataFrame]:
    """(sentences, keywords) of every document by the method "sentence" or "lsa"; the number of sentences is kept within 1..20."""
    if language not in ("en", "es"):
        raise ValueError(f"no stop words for {language}")
    if method not in ("sentence", "lsa"):
        raise ValueError(f"no such method: {method}")
    scores = sentence_scores(documents, language) if method == "sentence" else lsa_scores(documents, language)
    return select_sentences(scores, max(1, min(20, count))), keywords(term_weights(documents, language), n_keywords)


def lsa_scores(documents: DataFrame, language: str | None = None, topics: int = 3) -> DataFrame:
    """(doc_id, index, text, score, lang): the cosine of each sentence with the centroid of all in the space of the first topics.

    Fewer than 3 sentences all score 1, sentences without terms 0. A document is one group: its matrix is as large as its text;
    many documents go through each Arrow batch."""
    import pyarrow as pa

    parts = sentences(_language(documents, language)).withColumn("terms", summary_terms(F.col("text"), F.col("lang")))
    whole = parts.groupBy("doc_id", "lang").agg(F.array_sort(F.collect_list(F.struct("index", "text", "terms"))).alias("s"))

    def run(batches):
        for batch in batches:
            scores = [latent_scores([x["terms"] or [] for x in s], topics).tolist() for s in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(2), pa.array(scores, pa.list_(pa.float64()))], names=["doc_id", "s", "lang", "scores"])

    made = whole.select("doc_id", "s", "lang").mapInArrow(run, f"doc_id long, s {whole.schema['s'].dataType.simpleString()}, lang string, scores array<double>")
    return made.select("doc_id", "lang", F.explode(F.arrays_zip("s", "scores")).alias("z")).select("doc_id", "z.s.index", "z.s.text", F.col("z.scores").alias("score"), "lang")


def latent_scores(sentences: list[list[str]], topics: int = 3) -> np.ndarray:
    n = len(sentences)
    if n < 3:
        return np.ones(n)
    vocabulary = {t: i for i, t in enumerate(sorted({t for s in sentences for t in s}))}
    if not vocabulary:
        return np.zeros(n)
    counts = np.zeros((n, len(vocabulary)))
    for row, sentence in enumerate(sentences):
        for term in sentence:
            counts[row, vocabulary[term]] += 1
    rows = counts * (np.log((1 + n) / (1 + (counts > 0).sum(axis=0))) + 1)
    norms = np.linalg.norm(rows, axis=1, keepdims=True)
    rows = np.divide(rows, norms, out=np.zeros_like(rows), where=norms > 0)
    k = min(topics, n - 1, len(vocabulary) - 1)
    if k < 1:
        return rows.sum(axis=1)
    u, s, _ = np.linalg.svd(rows, full_matrices=False)
    latent = u[:, :k] * s[:k]
    centre = latent.mean(axis=0)
    size = np.linalg.norm(latent, axis=1) * np.linalg.norm(centre)
    return np.divide(latent @ centre, size, out=np.zeros(n), where=size > 1e-12)


def evaluate(selected: DataFrame, reference: DataFrame, taken: int = 10, expected: int = 8) -> DataFrame:
    """(doc_id, overlap, precision, recall) of selected (doc_id, index) against reference (doc_id, index), from 1; both over fixed sizes."""
    hits = selected.select("doc_id", (F.col("index") + 1).alias("index")).join(reference, ["doc_id", "index"], "left_semi").groupBy("doc_id").agg(F.count("*").alias("overlap"))
    return reference.select("doc_id").distinct().join(hits, "doc_id", "left").fillna(0).select("doc_id", "overlap", F.bround(F.col("overlap") / taken, 2).alias("precision"), F.bround(F.col("overlap") / expected, 2).alias("recall"))


def evaluate_timed(documents: DataFrame, language: str, method: str, reference: DataFrame, repetitions: int = 3) -> DataFrame:
    """`evaluate` of a method with mean_ms: the wall-clock time of summarising the whole collection, by document and repetition."""
    times = []
    for _ in range(max(1, repetitions)):
        began = time.perf_counter()
        picked = checkpoint(summarize(documents, language, method)[0])
        times.append(time.perf_counter() - began)
    n = documents.count()
    mean = sum(times) / len(times) * 1000 / n if n else None
    return evaluate(picked, reference).withColumn("mean_ms", F.lit(mean).cast("double"))
