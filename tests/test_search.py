import math

import pytest

from textloom.operators import index, metrics, search
from textloom.sources import sinks

DOCS = [
    (1, "Cats", "Cats chase mice. Mice fear cats.", "2024-01-01"),
    (2, "Dogs", "Dogs chase cats and dogs bark.", "2024-02-01"),
    (3, "Birds", None, "2024-03-01"),
    (4, None, "", "2024-04-01"),
]
SCHEMA = "doc_id long, title string, text string, doc_date string"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(DOCS, SCHEMA)


def test_weights_are_unit_vectors(spark, docs):
    rows = index.weights(docs).collect()
    by = {}
    for r in rows:
        by.setdefault(r.doc_id, []).append(r)
    for own in by.values():
        assert math.isclose(sum(r.weight**2 for r in own), 1.0, rel_tol=1e-12)
    tf = {(r.doc_id, r.term): r.tf for r in rows}
    assert tf[1, "cat"] == 3 and tf[2, "dog"] == 3 and (4, "cat") not in tf


def test_search(spark, docs):
    queries = spark.createDataFrame([(1, "cats dogs"), (2, "cats zebras"), (3, "the"), (4, "birds")], "query_id int, query string")
    weights = index.weights(docs)
    got = {(r.query_id, r.doc_id): r for r in search.search(docs, weights, queries).collect()}
    assert {k for k in got if k[0] == 1} == {(1, 1), (1, 2)}
    assert got[1, 2].rank_pos == 1 and got[1, 2].matched_terms == "cat,dog"
    assert got[4, 3].rank == pytest.approx(1.0)
    assert 0 < got[1, 1].rank < 1
    strict = search.search(docs, weights, queries, all_words=True).collect()
    assert {(r.query_id, r.doc_id) for r in strict} == {(1, 2), (4, 3)}
    dated = search.search(docs, weights, queries, since="2024-02-01", until="2024-02-28").collect()
    assert {r.doc_id for r in dated} == {2}


def test_suggest(spark, docs):
    words = index.postings(docs).select("term").distinct()
    asked = spark.createDataFrame([("ca",), ("c",), ("DO",)], "prefix string")
    got = [(r.prefix, r.place, r.suggestion) for r in search.suggest(words, docs, asked).orderBy("prefix", "place").collect()]
    assert got == [("DO", 1, "dog"), ("DO", 2, "Dogs"), ("ca", 1, "cat"), ("ca", 2, "Cats")]


def test_snippets(spark):
    text = "one two " * 40 + "<Cats> eat fish. " + "three four " * 40
    docs = spark.createDataFrame([(1, text), (2, "12 & 13"), (3, "cats"), (4, None)], "doc_id long, text string")
    got = {r[0]: r[1] for r in search.snippets(docs, ["cat", "fish"]).collect()}
    assert got[3] == "<strong>cats</strong>" and got[2] == "12 &amp; 13" and 4 not in got
    assert got[1].startswith("…") and got[1].endswith("…") and "&lt;<strong>Cats</strong>&gt; eat <strong>fish</strong>" in got[1]
    windows = {r[0]: (r[1], r[2]) for r in search.best_windows(docs, ["cat", "fish"]).collect()}
    assert windows == {1: (55, 2), 3: (0, 1)}


def test_reindex(spark, docs):
    posts = index.postings(docs)
    changed = spark.createDataFrame([(2, "Dogs", "cows", "2024-02-01")], SCHEMA)
    after = index.reindexed(posts, changed)
    assert {(r.doc_id, r.term) for r in after.collect() if r.doc_id == 2} == {(2, "dog"), (2, "cow")}
    removed = changed.select("doc_id")
    left, kept = index.without_documents(docs, posts, removed)
    assert left.count() == 3 and kept.where("doc_id = 2").count() == 0


def test_stored_index(spark, docs, tmp_path):
    root = str(tmp_path / "index")
    index.store(docs, root)
    rows = lambda df: sorted((r.doc_id, r.term, r.tf, round(r.weight, 9)) for r in df.collect())
    assert rows(index.stored_weights(spark, root)) == rows(index.weights(docs))
    asked = spark.createDataFrame([(1, "cats dogs"), (2, "zebras")], "query_id int, query string")
    stored = search.search(docs, index.stored_weights(spark, root), asked)
    assert sorted(map(tuple, stored.collect())) == sorted(map(tuple, search.search(docs, index.weights(docs), asked).collect()))
    changed = spark.createDataFrame([(2, "Dogs", "cows", "2024-02-01"), (9, "New", "zebras", "2024-05-01")], SCHEMA)
    index.update(spark, root, changed, removed=spark.createDataFrame([(3,)], "doc_id long"))
    after = docs.where("doc_id not in (2, 3)").unionByName(changed)
    assert rows(index.stored_weights(spark, root)) == rows(index.weights(after))
    assert len(sinks.versions(spark, root)) == 2 and sinks.read_version(spark, root, "documents").count() == 4
    empty = str(tmp_path / "empty")
    index.store(docs.limit(0), empty)
    assert search.search(docs, index.stored_weights(spark, empty), asked).count() == 0


def test_positions_are_those_of_the_ranking(spark, docs, monkeypatch):
    many = spark.createDataFrame([(i, f"t{i % 3}", "cats " * (i % 4) + "dogs " * (i % 7) + f"word{i % 5}", None) for i in range(60)], SCHEMA)
    asked = spark.createDataFrame([(1, "cats dogs"), (2, "word1"), (3, "zzqx")], "query_id int, query string")
    weights = index.weights(many)
    monkeypatch.setattr(search, "STEPS", 8)
    every = {(r.query_id, r.doc_id): r.rank_pos for r in search.search(many, weights, asked, limit=None).collect()}
    first = {(r.query_id, r.doc_id): r.rank_pos for r in search.search(many, weights, asked, limit=1000).collect()}
    assert every == first and len(every) > 40
    wanted = spark.createDataFrame([(q, d) for q in (1, 2, 3) for d in range(0, 60, 7)], "query_id int, doc_id long")
    got = {(r.query_id, r.doc_id): r.rank_pos for r in search.positions(search.scores(many, weights, asked), wanted).collect()}
    assert got == {k: v for k, v in every.items() if k[1] % 7 == 0}


def test_suggestions_with_signs(spark, docs):
    asked = spark.createDataFrame([("c_t",), ("%ird",)], "prefix string")
    got = [(r.prefix, r.suggestion) for r in search.suggest(index.postings(docs).select("term").distinct(), docs, asked).collect()]
    assert set(got) == {("c_t", "cat"), ("c_t", "Cats"), ("%ird", "bird"), ("%ird", "Birds")}


def test_metrics(spark):
    queries = spark.createDataFrame([(1, "a"), (2, "b"), (3, "c")], "query_id int, query string")
    results = spark.createDataFrame([(1, 1, 10), (1, 2, 11), (1, 3, 12), (2, 1, 10)], "query_id int, rank_pos int, doc_id long")
    judged = spark.createDataFrame([(1, 10), (1, 12), (1, 99), (3, 5)], "query_id int, doc_id long")
    got = {r.query_id: r for r in metrics.rank_metrics(queries, results, judged).collect()}
    assert got[1].precision == pytest.approx(2 / 3) and got[1].recall == pytest.approx(2 / 3)
    assert got[1].average_precision == pytest.approx((1 + 2 / 3) / 3) and got[1].r_precision == pytest.approx(2 / 3)
    assert got[1].p_at_5 == pytest.approx(2 / 5)
    assert got[2].precision == 0 and got[2].recall is None and got[2].f1 == 0 and got[2].average_precision is None
    assert got[3].precision is None and got[3].recall == 0 and got[3].f1 == 0 and got[3].p_at_5 == 0
    curve = {(r.query_id, r.level): r.precision for r in metrics.curve(queries, results, judged).collect()}
    assert len(curve) == 33 and curve[1, 0] == 1 and curve[1, 3] == 1 and curve[1, 6] == pytest.approx(2 / 3) and curve[1, 7] == 0
    assert all(curve[2, i] == 0 for i in range(11))
    means = {r.metric: r["mean"] for r in metrics.summary(metrics.rank_metrics(queries, results, judged)).collect()}
    assert means["precision"] == pytest.approx(0.3333) and means["recall"] == pytest.approx(0.3333)
