"""All queries of the core operators over the stored tables."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.ml import PipelineModel
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.functions import text as fx
from textloom.operators import essay, index, langid, langid_ml, metrics, records, search, summarize, translate
from textloom.plans import oracle
from textloom.session import checkpoint, scratch, table
from textloom.sources import sinks
from textloom.streaming import commands

Query = Callable[[SparkSession, str], DataFrame]

#: Queries of the search collection: (number, text, subject whose documents are relevant).
SEARCHES = [
    (1, "interest rate dividend market", "economy"),
    (2, "court evidence lawsuit appeal", "law"),
    (3, "goalkeeper match penalty record", "sport"),
    (4, "patients nurse vaccine pressure", "medicine"),
    (5, "compiler cache repository branches", "software"),
    (6, "enzyme particle beams radiation", "science"),
    (7, "fresco murals gallery brush", "art"),
    (8, "sonnet rhyme novel narrator", "literature"),
    (9, "zzqx", "nothing"),
]
PREFIXES = ["pr", "Co", "ma", "th", "zz", "x", "ar", "п"]
SNIPPET_QUERY = "interest rates markets"
DOMAIN = "computer_science"


def _docs(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents")


def _searches(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(i, q) for i, q, _ in SEARCHES], "query_id int, query string")


def _judgements(spark: SparkSession, d: str) -> DataFrame:
    subjects = spark.createDataFrame([(i, s) for i, _, s in SEARCHES], "query_id int, subject string")
    return table(spark, d, "labels").join(F.broadcast(subjects), "subject").select("query_id", "doc_id").distinct()


_indexes: dict[tuple[str, str, str], str] = {}
_models: dict[tuple[str, str, int, str], tuple[PipelineModel, list[str]]] = {}


def _index(spark: SparkSession, d: str) -> str:
    """The stored index of the documents: built once in an application, and again if their file has changed."""
    docs = _docs(spark, d)
    key = (spark.sparkContext.applicationId, d, _state(spark, f"{d}/documents.parquet"))
    if key not in _indexes:
        root = f"{scratch(spark)}/index-{len(_indexes)}"
        index.store(docs.select("doc_id", "title", "text", "doc_date"), root)
        _indexes[key] = root
    return _indexes[key]


def _state(spark: SparkSession, path: str) -> str:
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    status = folder.getFileSystem(spark._jsc.hadoopConfiguration()).getContentSummary(folder), folder.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(folder)
    return f"{status[0].getLength()} {status[1].getModificationTime()}"


def _weights(spark: SparkSession, d: str) -> DataFrame:
    return index.stored_weights(spark, _index(spark, d))


def _training(spark: SparkSession, d: str) -> DataFrame:
    return _docs(spark, d).where(F.col("lang").isin("en", "ru") & F.col("text").isNotNull()).select("lang", "doc_id", "text")


def _articles(spark: SparkSession, d: str, language: str) -> DataFrame:
    return _docs(spark, d).where((F.col("lang") == language) & F.col("content").isNotNull()).select("doc_id", F.col("content").alias("text"))


def _contents(spark: SparkSession, d: str) -> DataFrame:
    return _docs(spark, d).select("doc_id", F.col("content").alias("text"))


def _runs(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "translation_runs").dropDuplicates(["id"]).select("id", F.col("source_text").alias("text"))


def _entries(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "dictionary_entries").dropDuplicates(["id"])


def suffix_tag(word: Column) -> Column:
    """A tag from the word's ending alone, so that SQL can do the same."""
    return F.when(word.endswith("ing"), "VBG").when(word.endswith("ed"), "VBD").when(word.endswith("ly"), "RB").when(word.endswith("s"), "NNS").otherwise("NN")


def _tokens(spark: SparkSession, d: str) -> DataFrame:
    spans = _runs(spark, d).select("id", F.posexplode(fx.translation_spans(F.col("text"))).alias("i", "span"))
    found = spans.select("id", "i", F.posexplode(F.regexp_extract_all("span", F.lit(fx.WORD_RX), F.lit(0))).alias("j", "w"))
    return found.select("id", (F.col("i") * 100_000 + F.col("j")).alias("pos"), F.lower("w").alias("word")).withColumn("tag", suffix_tag(F.col("word")))


def _effective(spark: SparkSession, d: str) -> DataFrame:
    return translate.overlay(_entries(spark, d), DOMAIN)


def _tagged(spark: SparkSession, d: str) -> DataFrame:
    """The tokens of the runs with the tags of the operator's tagger."""
    return translate.tagged(checkpoint(translate.tokens(_runs(spark, d))), _effective(spark, d))


def tokens_en(spark: SparkSession, d: str) -> DataFrame:
    return index.tokens(_docs(spark, d))


def postings_tf(spark: SparkSession, d: str) -> DataFrame:
    return index.postings(_docs(spark, d))


def doc_frequency_idf(spark: SparkSession, d: str) -> DataFrame:
    docs = _docs(spark, d)
    return index.document_frequency(index.postings(docs), index.count_documents(docs)).select("term", "df", F.round("idf", 6).alias("idf"))


def tfidf_weights(spark: SparkSession, d: str) -> DataFrame:
    return index.weights(_docs(spark, d)).select("doc_id", "term", "tf", F.round("weight", 6).alias("weight"))


def _ranked(df: DataFrame) -> DataFrame:
    return df.withColumn("rank", F.round("rank", 6))


def vector_search_top50(spark: SparkSession, d: str) -> DataFrame:
    return _ranked(search.search(_docs(spark, d), _weights(spark, d), _searches(spark)))


def search_all_words(spark: SparkSession, d: str) -> DataFrame:
    return _ranked(search.search(_docs(spark, d), _weights(spark, d), _searches(spark), all_words=True))


def search_filtered(spark: SparkSession, d: str) -> DataFrame:
    return _ranked(search.search(_docs(spark, d), _weights(spark, d), _searches(spark), since="2024-01-05", until="2024-02-20"))


def top_terms_per_doc(spark: SparkSession, d: str) -> DataFrame:
    return index.top_terms(_weights(spark, d))


def suggest(spark: SparkSession, d: str) -> DataFrame:
    prefixes = spark.createDataFrame([(p,) for p in PREFIXES], "prefix string")
    return search.suggest(_weights(spark, d).select("term").distinct(), _docs(spark, d), prefixes)


def _snippet_terms() -> list[str]:
    return [re.sub(fx.STEM_RX, r"\1", w) for w in SNIPPET_QUERY.split()]


def snippet_window(spark: SparkSession, d: str) -> DataFrame:
    return search.best_windows(_docs(spark, d), _snippet_terms())


def snippets(spark: SparkSession, d: str) -> DataFrame:
    return search.snippets(_docs(spark, d), _snippet_terms())


def search_everything(spark: SparkSession, d: str) -> DataFrame:
    """All hits of every query, ranked."""
    return _ranked(search.search(_docs(spark, d), _weights(spark, d), _searches(spark), limit=None))


def _placed(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """(places of the relevant documents, numbers of hits) of the queries."""
    found = checkpoint(search.scores(_docs(spark, d), _weights(spark, d), _searches(spark)))
    return search.positions(found, _judgements(spark, d)), found.groupBy("query_id").agg(F.count("*").alias("found"))


def _metrics(spark: SparkSession, d: str) -> DataFrame:
    placed, found = _placed(spark, d)
    return metrics.rank_metrics(_searches(spark), placed, _judgements(spark, d), found=found)


def rank_metrics(spark: SparkSession, d: str) -> DataFrame:
    found = _metrics(spark, d)
    return found.select("query_id", *[F.round(c, 6).alias(c) for c in found.columns if c != "query_id"])


def pr_curve_11pt(spark: SparkSession, d: str) -> DataFrame:
    return metrics.curve(_searches(spark), _placed(spark, d)[0], _judgements(spark, d)).withColumn("precision", F.round("precision", 6))


def rank_metrics_summary(spark: SparkSession, d: str) -> DataFrame:
    return metrics.summary(_metrics(spark, d))


def pr_curve_mean(spark: SparkSession, d: str) -> DataFrame:
    return metrics.mean_curve(metrics.curve(_searches(spark), _placed(spark, d)[0], _judgements(spark, d)))


def index_after_delete(spark: SparkSession, d: str) -> DataFrame:
    docs = _docs(spark, d)
    removed = docs.where("coalesce(lang, '') = 'es'").select("doc_id")
    left, posts = index.without_documents(docs, index.postings(docs), removed)
    return index.document_frequency(posts, index.count_documents(left)).select("term", "df", F.round("idf", 6).alias("idf"))


def index_reindexed(spark: SparkSession, d: str) -> DataFrame:
    """The postings after the text of one language's documents was replaced by their content."""
    docs = _docs(spark, d).select("doc_id", "title", "text", "lang", "content")
    changed = docs.where("lang = 'es'").withColumn("text", F.col("content"))
    return index.reindexed(index.postings(docs), changed)


def freq_profile(spark: SparkSession, d: str) -> DataFrame:
    return langid.frequent_profile(langid.word_counts(_training(spark, d))).select("lang", "word", "n", F.round("prob", 9).alias("prob"), F.round("min_prob", 9).alias("min_prob"))


def short_profile(spark: SparkSession, d: str) -> DataFrame:
    return langid.short_profile(langid.word_counts(_training(spark, d))).select("lang", "word", "n", F.round("prob", 9).alias("prob"), F.round("min_prob", 9).alias("min_prob"))


def _scores(spark: SparkSession, d: str, method: str) -> DataFrame:
    counts = langid.word_counts(_training(spark, d))
    if method == "freq":
        return langid.log_likelihoods(_docs(spark, d), langid.frequent_profile(counts))
    return langid.log_likelihoods(_docs(spark, d), langid.short_profile(counts), langid.SHORT_LETTERS)


def langid_scores(spark: SparkSession, d: str) -> DataFrame:
    bounded = _scores(spark, d, "freq").withColumn("score", fx.bounded(F.col("score")))
    return langid.display_percent(bounded).select("doc_id", "lang", F.round("score", 4).alias("score"), F.round("percent", 4).alias("percent"))


def langid_freq(spark: SparkSession, d: str) -> DataFrame:
    return langid.predicted(_scores(spark, d, "freq"))


def langid_short(spark: SparkSession, d: str) -> DataFrame:
    return langid.predicted(_scores(spark, d, "short"))


def langid_summary(spark: SparkSession, d: str) -> DataFrame:
    both = langid_freq(spark, d).withColumn("method", F.lit("freq_words")).unionByName(langid_short(spark, d).withColumn("method", F.lit("short_words")))
    return langid.accuracy(both, _docs(spark, d).select("doc_id", "true_language")).withColumn("accuracy", F.round("accuracy", 6))


def langid_mlp(spark: SparkSession, d: str, texts: int = langid_ml.TEXTS) -> DataFrame:
    docs = _docs(spark, d)
    key = (spark.sparkContext.applicationId, d, texts, _state(spark, f"{d}/documents.parquet") if docs.inputFiles() else "")
    if key not in _models:  # trained once in an application, and again if the file has changed
        _models[key] = langid_ml.train(_training(spark, d).orderBy(F.xxhash64("doc_id")).limit(texts))
    return langid_ml.predict(docs, *_models[key])


def langid_mlp_accuracy(spark: SparkSession, d: str) -> DataFrame:
    """How often the perceptron agrees with the labels set by hand, over the documents labelled with one of its languages."""
    truth = _docs(spark, d).where(F.col("true_language").isin(*langid.LANGUAGES)).select("doc_id", "true_language")
    return langid.accuracy(langid_mlp(spark, d).withColumn("method", F.lit("neural")), truth)


def char_windows(spark: SparkSession, d: str) -> DataFrame:
    return _docs(spark, d).select("doc_id", F.posexplode(fx.char_windows(F.col("text"))).alias("i", "window"))


def char_ngrams(spark: SparkSession, d: str) -> DataFrame:
    grams = _docs(spark, d).select("doc_id", F.explode(fx.char_ngrams(F.col("text"))).alias("gram"))
    return grams.groupBy("doc_id", F.length("gram").alias("n")).agg(F.count("*").alias("grams"), F.countDistinct("gram").alias("different"))


def sentences_offsets(spark: SparkSession, d: str) -> DataFrame:
    return summarize.sentences(_contents(spark, d))


def _both(spark: SparkSession, d: str) -> DataFrame:
    """The articles of the two languages the summariser knows."""
    return _docs(spark, d).where(F.col("lang").isin("en", "es") & F.col("content").isNotNull()).select("doc_id", F.col("content").alias("text"), "lang")


def summary_sentence(spark: SparkSession, d: str) -> DataFrame:
    return summarize.select_sentences(summarize.sentence_scores(_both(spark, d)))


def keywords(spark: SparkSession, d: str) -> DataFrame:
    docs = _both(spark, d)
    return summarize.keywords(summarize.term_weights(docs, None)).join(docs.select("doc_id", "lang"), "doc_id")


def summary_lsa(spark: SparkSession, d: str) -> DataFrame:
    return summarize.select_sentences(summarize.lsa_scores(_both(spark, d)))


def summary_evaluation(spark: SparkSession, d: str) -> DataFrame:
    picked = summarize.select_sentences(summarize.sentence_scores(_articles(spark, d, "en"), "en"))
    reference = summarize.sentences(_articles(spark, d, "en")).where("index < 8").select("doc_id", (F.col("index") + 1).alias("index"))
    return summarize.evaluate(picked, reference)


def dictionary_overlay(spark: SparkSession, d: str) -> DataFrame:
    return translate.overlay(_entries(spark, d), DOMAIN).select("english", "pos", "german")


def lookup_words(spark: SparkSession, d: str) -> DataFrame:
    return translate.lookup(_tokens(spark, d), translate.overlay(_entries(spark, d), DOMAIN))


def frequency_dictionary(spark: SparkSession, d: str) -> DataFrame:
    return translate.frequency_dictionary(_tokens(spark, d), translate.overlay(_entries(spark, d), DOMAIN))


def unknown_words(spark: SparkSession, d: str) -> DataFrame:
    entries = _entries(spark, d)
    return translate.new_entries(_tokens(spark, d), entries, translate.overlay(entries, DOMAIN), DOMAIN)


def dictionary_seeded(spark: SparkSession, d: str) -> DataFrame:
    keyed = _entries(spark, d).groupBy("english", F.col("pos_tag").alias("pos"), "domain").agg(F.max("german").alias("german"))
    seeds = keyed.where("domain = 'general'").withColumn("domain", F.lit(DOMAIN))
    return translate.seeded(keyed, seeds)


def dictionary_page(spark: SparkSession, d: str) -> DataFrame:
    return translate.dictionary_page(_entries(spark, d), "e", page=2, size=20).select("id", "english", "pos_tag", "german", "domain")


def dictionary_inserted(spark: SparkSession, d: str) -> DataFrame:
    entries = _entries(spark, d).select("english", "pos_tag", "domain").distinct()
    new = entries.where("domain <> 'general'").select("english", "pos_tag", F.lit("general").alias("domain")).distinct()
    return records.delete(records.insert_new(entries, new, ["english", "pos_tag", "domain"])[0], entries.where("pos_tag = '*'").select("english", "pos_tag"))


def _pairs_as_text(df: DataFrame) -> DataFrame:
    """The lists of (word, tag) as word/tag, so that they can be compared."""
    text = lambda c: F.array_join(F.transform(c, lambda x: F.concat(x["word"], F.lit("/"), x["tag"])), " ").alias(c)
    return df.select("id", "translated_text", "word_count", "translated_count", text("seen"), text("unknown"))


def translate_direct(spark: SparkSession, d: str) -> DataFrame:
    return _pairs_as_text(translate.translate(_runs(spark, d), _effective(spark, d), "direct"))


def translate_transfer(spark: SparkSession, d: str) -> DataFrame:
    return _pairs_as_text(translate.translate(_runs(spark, d), _effective(spark, d), "transfer"))


def translation_report(spark: SparkSession, d: str) -> DataFrame:
    runs = table(spark, d, "translation_runs").dropDuplicates(["id"]).withColumn("method", F.lit("transfer"))
    return translate.report(runs, translate.frequency_dictionary(translate.words_seen(_tagged(spark, d)), _effective(spark, d)))


def tagged_words(spark: SparkSession, d: str) -> DataFrame:
    return _tagged(spark, d).where("word is not null").select("id", "span", "j", "gap", "word", "tag")


def tagged_frequency(spark: SparkSession, d: str) -> DataFrame:
    return translate.frequency_dictionary(translate.words_seen(_tagged(spark, d)), _effective(spark, d))


def tagged_unknown(spark: SparkSession, d: str) -> DataFrame:
    return translate.new_entries(translate.words_seen(_tagged(spark, d)), _entries(spark, d), _effective(spark, d), DOMAIN)


def phrase_hits(spark: SparkSession, d: str) -> DataFrame:
    return translate.phrases(translate.tokens(_runs(spark, d)), _effective(spark, d))


def chunk_trees(spark: SparkSession, d: str) -> DataFrame:
    return translate.chunk_trees(_tagged(spark, d))


def essay_indicators(spark: SparkSession, d: str) -> DataFrame:
    return essay.indicators(_contents(spark, d))


def essay_top_words(spark: SparkSession, d: str) -> DataFrame:
    return essay.top_words(_contents(spark, d))


def speech_chunks(spark: SparkSession, d: str) -> DataFrame:
    return _contents(spark, d).select("doc_id", F.posexplode(fx.speech_chunks(F.col("text"))).alias("i", "chunk"))


def translation_spans(spark: SparkSession, d: str) -> DataFrame:
    return _runs(spark, d).select("id", F.posexplode(fx.translation_spans(F.col("text"))).alias("i", "span"))


def _phrases(spark: SparkSession, d: str) -> DataFrame:
    said = F.create_map(*[F.lit(x) for pair in (("signup", "Dictate."), ("click", "analyze essay"), ("view", "Read results!"), ("purchase", "show plan"), ("error", "clear essay")) for x in pair])
    return table(spark, d, "events").select(F.col("user_id").alias("session"), F.col("event_id").alias("seq"), F.coalesce(F.try_element_at(said, F.col("event_type")), F.col("event_type")).alias("phrase"))


def command_log(spark: SparkSession, d: str) -> DataFrame:
    return commands.outcomes(_phrases(spark, d))


def dictated_essays(spark: SparkSession, d: str) -> DataFrame:
    return commands.essays(command_log(spark, d))


def crawl_changes(spark: SparkSession, d: str) -> DataFrame:
    docs = _docs(spark, d).where("file_path is not null")
    found = docs.select(F.col("file_path").alias("path"), F.md5(F.coalesce("text", F.lit("")).cast("binary")).alias("hash"))
    known = docs.where("file_hash is not null").select(F.col("file_path").alias("path"), F.col("file_hash").alias("hash"))
    return records.file_changes(found, known)


def crawl_tally(spark: SparkSession, d: str) -> DataFrame:
    return records.tally(crawl_changes(spark, d))


def nested_correct_update(spark: SparkSession, d: str) -> DataFrame:
    docs = _docs(spark, d)
    method = lambda c: F.struct(c.alias("predicted"), F.lit(None).cast("boolean").alias("correct"))
    stored = docs.select("doc_id", "true_language", "original_filename", "uploaded_at", F.struct(method(F.col("lang")).alias("freq_words"), method(F.lit("en")).alias("short_words"), method(F.lower("true_language")).alias("neural")).alias("methods"))
    changes = docs.where("true_language is null").select("doc_id", F.lit("en").alias("new_language"))
    return sinks.result_rows(records.with_true_language(stored, changes))


def upsert_latest(spark: SparkSession, d: str) -> DataFrame:
    return records.latest(table(spark, d, "summaries"), ["document_id", "method"], [F.col("created_at"), F.col("id")])


def summary_keywords(spark: SparkSession, d: str) -> DataFrame:
    return records.keyword_rows(upsert_latest(spark, d))


def recent_documents(spark: SparkSession, d: str) -> DataFrame:
    return records.recent(_docs(spark, d), [F.desc("uploaded_at"), F.desc("doc_id")], 10).select("doc_id", "title", "uploaded_at")


def file_facts(spark: SparkSession, d: str) -> DataFrame:
    path = F.col("file_path")
    return _docs(spark, d).where("file_path is not null").select("doc_id", fx.extension(path).alias("extension"), fx.allowed(path, ["txt", "docx", "pdf"]).alias("allowed"), fx.title_of(path).alias("title"), F.substring("text", 1, 600).alias("preview"), F.length("text").alias("length"), F.md5(F.col("text").cast("binary")).alias("md5"))


def escaped_titles(spark: SparkSession, d: str) -> DataFrame:
    return _docs(spark, d).select("doc_id", fx.escape_html(F.col("title")).alias("title"))


def queries() -> dict[str, Query]:
    made = [
        vector_search_top50, tokens_en, postings_tf, doc_frequency_idf, tfidf_weights, search_all_words, search_filtered, top_terms_per_doc, suggest,
        search_everything, index_reindexed, snippet_window, snippets, rank_metrics, pr_curve_11pt, rank_metrics_summary, pr_curve_mean, index_after_delete, freq_profile, short_profile,
        langid_scores, langid_freq, langid_short, langid_summary, langid_mlp, langid_mlp_accuracy, char_windows, char_ngrams, sentences_offsets, summary_sentence, keywords, summary_lsa,
        summary_evaluation, dictionary_overlay, lookup_words, frequency_dictionary, unknown_words, dictionary_seeded, dictionary_inserted, dictionary_page, translate_direct,
        translate_transfer, translation_report, tagged_words, tagged_frequency, tagged_unknown, phrase_hits, chunk_trees, essay_indicators, essay_top_words, speech_chunks, translation_spans, command_log, dictated_essays,
        crawl_changes, crawl_tally, nested_correct_update, upsert_latest, summary_keywords, recent_documents, file_facts, escaped_titles,
    ]
    return {f.__name__: f for f in made}


def oracle_sql() -> dict[str, str]:
    return oracle.sql(SEARCHES, PREFIXES, _snippet_terms(), DOMAIN)
