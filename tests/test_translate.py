import pytest

from textloom.operators import translate as tr

ENTRIES = [
    (1, "neural network", "*", "neuronales Netzwerk", "computer_science"),
    (2, "algorithm", "NN", "Algorithmus", "computer_science"),
    (3, "the", "DT", "der", "general"),
    (4, "because", "IN", "weil", "general"),
    (5, "process", "VB", "verarbeitet", "general"),
    (6, "data", "*", "Daten", "general"),
    (7, "simple", "JJ", "einfach", "general"),
    (8, "simple", "JJ", "", "computer_science"),
    (9, "a", "DT", "ein", "general"),
    (10, "classifier", "NN", "Klassifikator", "computer_science"),
    (11, "improve", "VB", "verbessern", "literature"),
]
SCHEMA = "id long, english string, pos_tag string, german string, domain string"


@pytest.fixture(scope="module")
def entries(spark):
    return spark.createDataFrame(ENTRIES, SCHEMA)


@pytest.fixture(scope="module")
def dictionary(entries):
    return tr.overlay(entries, "computer_science")


def run(spark, text, dictionary, method, tagger=None):
    texts = spark.createDataFrame([(1, text)], "id long, text string")
    return tr.translate(texts, dictionary, method, tagger).first()


def test_overlay(spark, entries):
    got = {(r.english, r.pos): r.german for r in tr.overlay(entries, "computer_science").collect()}
    assert got["simple", "JJ"] == "einfach" and ("improve", "VB") not in got


def test_transfer_puts_the_verb_last(spark, dictionary):
    assert run(spark, "Because the algorithm processes data.", dictionary, "transfer").translated_text == "Weil der Algorithmus Daten verarbeitet."
    assert run(spark, "The algorithm processes data because it can. If!", dictionary, "transfer").translated_text == "Der Algorithmus verarbeitet Daten weil [[it]] [[can]]. [[If]]!"


def test_direct_keeps_gaps_and_marks_unknown_words(spark, dictionary):
    got = run(spark, "A neural  network,  moonbeam data!\nLost line\n?End.", dictionary, "direct")
    assert got.translated_text == "Ein neuronales Netzwerk,  [[moonbeam]] Daten!\nLost line\n?[[End]]." and (got.word_count, got.translated_count) == (6, 4)
    assert [x.word for x in got.unknown] == ["end", "moonbeam"]
    assert [(x.word, x.tag) for x in got.seen] == [("a", "DT"), ("data", "NN"), ("end", "NN"), ("moonbeam", "NN"), ("network", "NN"), ("neural", "NN")]


def test_forms(spark, dictionary):
    assert run(spark, "Classifiers.", dictionary, "transfer").translated_text.startswith("Klassifikator")
    for text in ("", None, "12 ... \n"):
        assert run(spark, text, dictionary, "transfer") == (1, "", 0, 0, [], [])
    assert run(spark, " 12 ... \n", dictionary, "direct").translated_text == "12 ..."
    with pytest.raises(ValueError):
        run(spark, "x", dictionary, "other")


def test_phrases_from_the_left_the_longest_first(spark):
    made = [(i, e, "*", g, "general") for i, (e, g) in enumerate([("a b", "AB"), ("b c", "BC"), ("b c d", "BCD"), ("c d", "CD"), ("d e", "DE"), ("f g h i", "FGHI")])]
    dictionary = tr.overlay(spark.createDataFrame(made, SCHEMA), "general")
    texts = spark.createDataFrame([(1, "a b c d e. B c d e, d\t e! f g  h, i f g h i"), (2, "b-c a. b")], "id long, text string")
    got = sorted((r.id, r.span, r.j, r.size, r.phrase) for r in tr.phrases(tr.tokens(texts), dictionary).collect())
    assert got == [(1, 0, 0, 2, "AB"), (1, 0, 2, 2, "CD"), (1, 1, 0, 3, "BCD"), (1, 1, 4, 2, "DE"), (1, 2, 4, 4, "FGHI")]
    both = {m: {r.id: r for r in tr.translate(texts, dictionary, m).collect()} for m in ("direct", "transfer")}
    assert both["direct"][1].translated_text == "AB CD [[e]]. BCD [[e]], DE! [[f]] [[g]]  [[h]], [[i]] FGHI" and both["direct"][1].translated_count == 13
    assert both["transfer"][1].translated_text == "AB CD [[e]]. BCD [[e]] DE! [[f]] [[g]] [[h]] [[i]] FGHI".replace("[[e]]", "[[e]]")
    assert ("a", "DT") not in {tuple(x) for x in both["direct"][1].unknown} and ("a", "DT") in {tuple(x) for x in both["transfer"][1].unknown}


def test_tokens_tile_the_text(spark):
    texts = ["One two. Three\n\nlost here\nit's a'b'c!?  -- end", "...", "x", "(y) \n", "no end\n"]
    rows = tr.tokens(spark.createDataFrame(list(enumerate(texts)), "id long, text string")).collect()
    for i, text in enumerate(texts):
        mine = sorted((r for r in rows if r.id == i), key=lambda r: (r.span, r.j))
        assert "".join(r.gap + (r.word or "") for r in mine) == text
    assert [r.word for r in sorted(rows, key=lambda r: (r.id, r.span, r.j)) if r.word] == ["One", "two", "it's", "a'b", "c", "end", "x", "y", "no", "end"]


def test_tags(spark, dictionary):
    texts = spark.createDataFrame([(1, "The Algorithms quickly improves Paris. Classifiers was interesting")], "id long, text string")
    got = [(r.word, r.tag) for r in tr.tagged(tr.tokens(texts), dictionary).where("word is not null").orderBy("span", "j").collect()]
    assert got == [("The", "DT"), ("Algorithms", "NNS"), ("quickly", "RB"), ("improves", "NNS"), ("Paris", "NNP"), ("Classifiers", "NNS"), ("was", "VBD"), ("interesting", "VBG")]
    other = tr.tagged_by(tr.tokens(texts), lambda ws: [f"T{len(ws)}"] * len(ws))
    assert [r.tag for r in other.where("word is not null").orderBy("span", "j").collect()] == ["T5"] * 5 + ["T3"] * 3
    assert tr.translate(texts, dictionary, "direct", lambda ws: ["XX"] * len(ws)).first().seen[0].tag == "XX"


def test_lookup_order(spark, dictionary):
    asked = [("classifiers", "NNS"), ("processes", "VBZ"), ("data", "NN"), ("moonbeam", "NN"), ("simple", "NN"), ("processed", "VBD")]
    frame = spark.createDataFrame(asked, "word string, tag string")
    got = {(r.word, r.tag): r.german for r in tr.lookup(frame, dictionary).collect()}
    assert got == dict(zip(asked, ["Klassifikator", "verarbeitet", "Daten", "", "einfach", "verarbeitet"]))


def test_frames(spark, entries):
    texts = spark.createDataFrame([(1, "Data improves data."), (2, None), (3, "Title without end\nA simple algorithm.")], "id long, text string")
    dictionary = tr.overlay(entries, "computer_science")
    got = {r.id: r for r in tr.translate(texts, dictionary, "transfer").collect()}
    assert got[2].translated_text == "" and got[2].word_count == 0
    assert got[3].translated_text == "Ein einfach Algorithmus." and got[1].word_count == 3
    tokens = tr.words_seen(tr.tagged(tr.tokens(texts), dictionary))
    table = {r.word: r for r in tr.frequency_dictionary(tokens, dictionary).where("id = 1").collect()}
    assert table["data"].frequency == 2 and table["data"].translation == "Daten"
    added = tr.new_entries(tokens, entries, dictionary, "computer_science").collect()
    assert ("algorithm", "NN") not in {(r.english, r.pos) for r in added}


def test_report_has_the_tags_of_the_tagger(spark, entries, monkeypatch):
    from textloom.plans import catalog

    text = "The simple algorithm processes data because she can improve it quickly. We saw Paris."
    runs = spark.createDataFrame([(1, "T", "D", "2026-01-01", 13, 5, text, "x"), (2, None, None, None, 0, 0, None, None)], "id long, title string, domain string, created_at string, word_count int, translated_count int, source_text string, translated_text string")
    runs = runs.withColumn("created_at", runs.created_at.cast("timestamp"))
    monkeypatch.setattr(catalog, "table", lambda _, __, name: {"translation_runs": runs, "dictionary_entries": entries}[name])
    got = {r.id: r.report for r in catalog.translation_report(spark, "").collect()}
    lines = [x.split("\t") for x in got[1].split("Frequency dictionary:\n")[1].split("\n")]
    seen = tr.translate(runs.selectExpr("id", "source_text AS text"), tr.overlay(entries, "computer_science")).where("id = 1").first().seen
    assert sorted((x[1], x[3]) for x in lines) == [tuple(x) for x in seen]
    assert {"DT", "JJ", "VBZ", "IN", "PRP", "MD", "RB", "NNP"} <= {x[3] for x in lines}
    assert {x[1]: x[2] for x in lines}["processes"] == "verarbeitet" and got[2].endswith("Frequency dictionary:\n")


def test_edit(spark, entries):
    changes = spark.createDataFrame([(8, " leicht "), (99, "x")], "id long, german string")
    got = {r.id: r.german for r in tr.edited(entries, changes).collect()}
    assert got[8] == "leicht" and got[7] == "einfach" and 99 not in got and len(got) == len(ENTRIES)


def test_seeding(spark):
    key = "english string, pos string, domain string, german string"
    have = spark.createDataFrame([("a", "*", "general", ""), ("b", "*", "general", "alt")], key)
    seeds = spark.createDataFrame([("a", "*", "general", "neu"), ("b", "*", "general", "neu"), ("c", "*", "general", "neu")], key)
    assert {r.english: r.german for r in tr.seeded(have, seeds).collect()} == {"a": "neu", "b": "alt", "c": "neu"}


def test_trees(spark):
    tree = tr.chunk_tree(["the", "model", "uses", "data"], ["DT", "NN", "VBZ", "NNS"])
    assert tree == "(S (CLAUSE (NP the/DT model/NN) (VP uses/VBZ (NP data/NNS))))"
    node = tr.tree_nodes(tree)
    texts = spark.createDataFrame([(1, "The model uses data. Data.")], "id long, text string")
    toks = tr.tagged_by(tr.tokens(texts), lambda ws: [{"The": "DT", "model": "NN", "uses": "VBZ"}.get(w, "NNS") for w in ws])
    assert {(r.span, r.tree) for r in tr.chunk_trees(toks).collect()} == {(0, tree.replace("the", "The")), (1, "(S (NP Data/NNS))")}
    assert node["label"] == "S" and node["children"][0]["children"][0]["children"][1]["word"] == "model"
