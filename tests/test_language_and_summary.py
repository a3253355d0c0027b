import pytest

from textloom.operators import essay, langid, langid_ml, summarize


def test_profiles_and_scores(spark):
    training = spark.createDataFrame([("en", 1, "the cat and the dog and the bird the"), ("ru", 2, "кот и пёс и кот и дом и")], "lang string, doc_id long, text string")
    counts = langid.word_counts(training)
    top = {(r.lang, r.word): r for r in langid.frequent_profile(counts, 2).collect()}
    assert set(top) == {("en", "the"), ("en", "and"), ("ru", "и"), ("ru", "кот")}
    assert top["en", "the"].prob == pytest.approx(4 / 6) and top["en", "the"].min_prob == pytest.approx(0.1 * 2 / 6)
    short = {(r.lang, r.word) for r in langid.short_profile(counts).collect()}
    assert short == {("en", "the"), ("ru", "и")}
    docs = spark.createDataFrame([(1, "the the"), (2, "и кот"), (3, ""), (4, None)], "doc_id long, text string")
    scores = langid.log_likelihoods(docs, langid.frequent_profile(counts))
    assert {r.doc_id: r.predicted for r in langid.predicted(scores).collect()} == {1: "en", 2: "ru", 3: "ru", 4: "ru"}
    assert scores.where("doc_id = 3 and score = double('-inf')").count() == 2
    truth = spark.createDataFrame([(1, "en"), (2, "en"), (3, ""), (4, None)], "doc_id long, true_language string")
    from pyspark.sql import functions as F

    got = langid.accuracy(langid.predicted(scores).withColumn("method", F.lit("f")), truth).first()
    assert (got.correct, got.total, got.accuracy) == (1, 2, 50.0)


def test_perceptron(spark, tmp_path):
    english = "the quick brown fox jumps over the lazy dog while nobody looks at the garden "
    russian = "быстрая лиса прыгает через ленивую собаку пока никто не смотрит на сад "
    training = spark.createDataFrame([("en", english * 5), ("ru", russian * 5)], "lang string, text string")
    model, labels = langid_ml.train(training, features=200, hidden=8, iterations=30)
    docs = spark.createDataFrame([(1, english), (2, russian), (3, "12")], "doc_id long, text string")
    got = {r.doc_id: r for r in langid_ml.predict(docs, model, labels).collect()}
    langid_ml.save(model, labels, str(tmp_path / "model"))
    assert {r.doc_id: r for r in langid_ml.predict(docs, *langid_ml.load(spark, str(tmp_path / "model"))).collect()} == got
    assert got[1].predicted == "en" and got[2].predicted == "ru" and got[3].probability == 0


def test_the_perceptron_query_trains_the_full_model(spark, monkeypatch):
    from textloom.plans import catalog

    docs = spark.createDataFrame([(i, "en" if i % 2 else "ru", "the quick brown fox jumps over" if i % 2 else "быстрая лиса прыгает через собаку") for i in range(700)], "doc_id long, lang string, text string")
    monkeypatch.setattr(catalog, "_docs", lambda *_: docs)
    asked, train = [], langid_ml.train

    def small(texts, **sizes):
        asked.append((texts.count(), sizes))
        return train(texts.limit(20), features=50, hidden=4, iterations=5)

    monkeypatch.setattr(langid_ml, "train", small)
    assert catalog.langid_mlp(spark, "").count() == 700
    catalog.langid_mlp(spark, "", texts=650)
    assert asked == [(langid_ml.TEXTS, {}), (650, {})]
    assert (langid_ml.FEATURES, langid_ml.HIDDEN, langid_ml.ITERATIONS) == (3000, 64, 800) and train.__defaults__ == (3000, 64, 800)


def test_sentence_offsets(spark):
    text = "First one. Second!\nstill?\n\n\n  Third. ... x"
    docs = spark.createDataFrame([(1, text), (2, None), (3, "...")], "doc_id long, text string")
    got = [tuple(r) for r in summarize.sentences(docs).orderBy("doc_id", "index").select("text", "document_offset", "paragraph_offset", "paragraph_length").collect()]
    assert [t for t, *_ in got] == ["First one.", "Second!", "still?", "Third.", "x"] or [t for t, *_ in got][:3] == ["First one.", "Second!", "still?"]
    for t, at, inner, size in got:
        assert text[at : at + len(t)] == t
    assert got[0][1:] == (0, 0, 25)


def test_summary_weights(spark):
    docs = spark.createDataFrame([(1, "Heart health. Heart sleep."), (2, "Sleep quality.")], "doc_id long, text string")
    weights = {(r.doc_id, r.term): r.weight for r in summarize.term_weights(docs, "en").collect()}
    assert weights[1, "sleep"] == 0 and weights[1, "heart"] > 0
    scores = [r.score for r in summarize.sentence_scores(docs, "en").where("doc_id = 1").orderBy("index").collect()]
    assert len(scores) == 2 and scores[0] > scores[1]
    words = [r.term for r in summarize.keywords(summarize.term_weights(docs, "en")).where("doc_id = 1").orderBy("position").collect()]
    assert words == ["heart", "health"]


def test_methods_and_corpus(spark):
    corpus = spark.createDataFrame([(1, "Heart health. Heart sleep. More rest."), (2, "Sleep quality.")], "doc_id long, text string")
    assert summarize.with_text(corpus, "Sleep quality.").count() == 2 and summarize.with_text(corpus, "New.").count() == 3
    for method in ("sentence", "lsa"):
        found, words = summarize.summarize(corpus, "en", method, count=2)
        assert found.where("doc_id = 1").count() == 2 and words.where("doc_id = 1").count() > 0
    with pytest.raises(ValueError):
        summarize.summarize(corpus, "de")
    with pytest.raises(ValueError):
        summarize.summarize(corpus, "en", "other")


def test_latent_scores():
    assert summarize.latent_scores([["a"], ["b"]]).tolist() == [1, 1]
    assert summarize.latent_scores([[], [], []]).tolist() == [0, 0, 0]
    got = summarize.latent_scores([["a", "b"], ["a", "b"], ["a", "c"], []])
    assert got[0] == pytest.approx(got[1]) and got[3] == 0 and got[0] > 0.5


def test_essay(spark):
    text = "I argue that Hamlet’s well-known delay matters. For example, Hamlet waits!\n\nOverall, delay shapes Hamlet."
    docs = spark.createDataFrame([(1, text), (2, ""), (3, None)], "doc_id long, text string")
    got = {r.doc_id: r for r in essay.indicators(docs).collect()}
    assert (got[1].word_count, got[1].sentence_count, got[1].paragraph_count, got[1].signals) == (15, 3, 2, 3)
    assert got[2].word_count == 0 and 3 not in got
    assert got[1].spoken == "15 words, 3 sentences, 2 paragraphs. 3 of 3 structure signals found."
    top = [(r.word, r["count"]) for r in essay.top_words(docs).orderBy("place").collect()]
    assert top[0] == ("delay", 2) or top[0] == ("hamlet", 2)


def test_timed_methods(spark):
    corpus = spark.createDataFrame([(1, "Heart health. Heart sleep. More rest."), (2, "Sleep quality.")], "doc_id long, text string")
    reference = spark.createDataFrame([(1, 1), (1, 2), (2, 1)], "doc_id long, index int")
    rows = summarize.evaluate_timed(corpus, "en", "sentence", reference, 2).collect()
    assert {r.doc_id: r.overlap for r in rows} == {1: 2, 2: 1} and all(r.mean_ms > 0 for r in rows)
    done, times = langid.timed(spark.createDataFrame([(1, "en")], "doc_id long, predicted string"), "freq_words")
    assert done.first().method == "freq_words" and times.first().documents == 1 and times.first().mean_ms > 0


def test_languages_in_one_pass(spark):
    rows = [(1, "The heart works. Blood flows in the heart.", "en"), (2, "El corazón late. La sangre fluye.", "es"), (3, "Blood tests.", "en"), (4, "Das Herz.", "de")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    both = {(r.doc_id, r["index"]): r.score for r in summarize.sentence_scores(docs).collect()}
    for lang in ("en", "es"):
        alone = summarize.sentence_scores(docs.where(f"lang = '{lang}'"), lang).collect()
        assert alone and all(both[r.doc_id, r["index"]] == pytest.approx(r.score) for r in alone)
    assert both[4, 0] == 0
