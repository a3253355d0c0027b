import datetime
import json
import os

from pyspark.sql import functions as F

from textloom.operators import records
from textloom.sources import readers, sinks
from textloom.streaming import commands, ingest


def test_latest_and_upsert(spark):
    rows = spark.createDataFrame([(1, "a", 1), (1, "b", 3), (1, "c", 2), (2, None, 1)], "k int, v string, t int")
    assert {(r.k, r.v) for r in records.latest(rows, ["k"], [F.col("t")]).collect()} == {(1, "b"), (2, None)}
    new = spark.createDataFrame([(2, "x", 9)], rows.schema)
    assert {(r.k, r.v) for r in records.upsert(rows, new, ["k"]).collect()} == {(1, "a"), (1, "b"), (1, "c"), (2, "x")}


def test_insert_and_delete(spark):
    rows = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string")
    after, refused = records.insert_new(rows, spark.createDataFrame([(2, "x"), (3, "c"), (3, "c")], rows.schema), ["k"])
    assert {tuple(r) for r in after.collect()} == {(1, "a"), (2, "b"), (3, "c")} and [r.k for r in refused.collect()] == [2]
    assert [r.k for r in records.delete(rows, spark.createDataFrame([(1,)], "k int")).collect()] == [2]


def test_shortened(spark):
    changes = spark.createDataFrame([(f"p{i}", "new") for i in range(5)] + [("q", "changed")], "path string, status string")
    got = {r.status: (r.shown, r.more) for r in records.shortened(changes, 3).collect()}
    assert got == {"new": (["p0", "p1", "p2"], 2), "changed": (["q"], 0)}


def test_file_changes(spark):
    files = spark.createDataFrame([("a", "1"), ("b", "2"), ("c", "3")], "path string, hash string")
    known = spark.createDataFrame([("a", "1"), ("b", "9")], "path string, hash string")
    changes = records.file_changes(files, known)
    assert {r.path: r.status for r in changes.collect()} == {"a": "unchanged", "b": "changed", "c": "new"}
    assert {r.status: r.files for r in records.tally(changes).collect()} == {"new": 1, "changed": 1, "unchanged": 1, "unsupported": 0, "error": 0}
    assert records.tally(changes.limit(0)).agg(F.sum("files")).first()[0] == 0


def test_crawl(spark, tmp_path):
    root, store = tmp_path / "files", str(tmp_path / "store")
    (root / "deep").mkdir(parents=True)
    (root / "a.txt").write_text("первый", encoding="cp1251")
    (root / "deep" / "b.TXT").write_text("second", encoding="utf-8")
    (root / "c.exe").write_bytes(b"\x00")
    first = {r.status: r.files for r in ingest.crawl_folder(spark, str(root), store).collect()}
    assert first == {"new": 2, "changed": 0, "unchanged": 0, "unsupported": 1, "error": 0}
    (root / "a.txt").write_text("иначе", encoding="utf-8")
    second = {r.status: r.files for r in ingest.crawl_folder(spark, str(root), store).collect()}
    assert second == {"new": 0, "changed": 1, "unchanged": 1, "unsupported": 1, "error": 0}
    assert {r.title: r.text for r in sinks.read_version(spark, store, "documents").collect()} == {"a": "иначе", "b": "second"}
    query = ingest.follow_folder(spark, str(root), str(tmp_path / "streamed"), str(tmp_path / "checkpoint"))
    query.awaitTermination()
    assert {r.title for r in sinks.read_version(spark, str(tmp_path / "streamed"), "documents").collect()} == {"a", "b"}


PHRASES = [(1, 1, "Help."), (1, 2, "dictate"), (1, 3, "dictate!"), (1, 4, "what now"), (1, 5, "dictate"), (1, 6, "my essay"), (1, 7, ""), (1, 8, "show plan"), (2, 1, "dictate"), (2, 2, "clear essay"), (2, 3, "clear essay")]
OUTCOMES = {(1, 1): "help", (1, 2): "dictate", (1, 3): "content", (1, 4): "no match", (1, 5): "dictate", (1, 6): "content", (1, 8): "show plan", (2, 1): "dictate", (2, 2): "content", (2, 3): "clear essay"}


def test_commands_in_batch_and_stream(spark, tmp_path):
    phrases = spark.createDataFrame(PHRASES, "session long, seq long, phrase string")
    log = commands.outcomes(phrases)
    assert {(r.session, r.seq): r.outcome for r in log.collect()} == OUTCOMES
    assert {r.session: r.essay for r in commands.essays(log).collect()} == {1: "dictate! my essay"}
    phrases.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = commands.outcome_stream(spark.readStream.schema(phrases.schema).parquet(str(tmp_path / "in")))
    query = stream.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    query.awaitTermination()
    assert {(r.session, r.seq): r.outcome for r in spark.read.parquet(str(tmp_path / "out")).collect()} == OUTCOMES


def test_readers(spark, tmp_path):
    path = tmp_path / "c.json"
    path.write_text(json.dumps({"documents": [{"title": "t", "date": "2024-01-01", "time": "10:00", "text": "x"}, {"title": "t", "date": "", "time": "", "text": "y"}], "queries": [{"query": "q", "relevant_titles": ["t", "unknown"]}]}))
    docs, queries, judged = readers.judged_collection(spark, str(path))
    assert docs.count() == 2 and queries.count() == 1 and [tuple(r) for r in judged.collect()] == [(1, 2)]
    lines = spark.createDataFrame([("a|NN|b|general",), ("broken",)], "value string")
    assert [tuple(r) for r in readers.lexicon(lines).collect()] == [("a", "NN", "b", "general")]
    asked = spark.createDataFrame([('{"text": "hi"}',), ('{"text": " "}',), ("{}",)], "value string")
    assert [(r.text, r.error) for r in readers.requests(asked).collect()] == [("hi", None), (None, "empty"), (None, "no text")]
    content = spark.createDataFrame([("a.txt", bytearray("﻿ text ".encode())), ("b.txt", bytearray(b"\xff\xfe")), ("c.pdf", bytearray(b"x"))], "path string, content binary")
    assert [(r.title, r.text) for r in readers.uploads(content, 1, 30_000).collect()] == [("a", "text")]
    assert readers.decode("ё".encode("cp1251")) == "ё"


def test_sinks(spark, tmp_path):
    rows = spark.createDataFrame([(1, "x")], "a int, b string")
    sinks.write_csv(rows, str(tmp_path / "csv"))
    parts = {(tmp_path / "csv" / p).read_text(encoding="utf-8") for p in os.listdir(tmp_path / "csv") if p.endswith(".csv")}
    assert max(parts, key=len) == "﻿a,b\n1,x\n"
    profile = spark.createDataFrame([("en", "the", 0.5, 0.01)], "lang string, word string, prob double, min_prob double")
    sinks.write_json(sinks.profile_files(profile), str(tmp_path / "profiles"))
    assert [tuple(r) for r in readers.profiles(spark, str(tmp_path / "profiles")).collect()] == [("en", "the", 0.5, 0.01)]


def test_summaries_are_replaced_with_their_keywords(spark):
    schema = "id long, document_id long, method string, keywords string, created_at timestamp"
    at = lambda d: datetime.datetime(2026, 1, d)
    stored = spark.createDataFrame([(1, 1, "lsa", '[{"term":"a","weight":1}]', at(1)), (2, 2, "lsa", '[{"term":"b","weight":1}]', at(1))], schema)
    new = spark.createDataFrame([(3, 1, "lsa", '[{"term":"c","weight":2},{"term":"d","weight":1}]', at(2)), (4, 1, "lsa", '[{"term":"e","weight":2}]', at(3))], schema)
    summaries, children = records.replaced_summaries(stored, records.keyword_rows(stored), new)
    assert {r.id for r in summaries.collect()} == {2, 4}
    assert {(r.summary_id, r.position, r.term) for r in children.collect()} == {(2, 1, "b"), (4, 1, "e")}
    assert [r.id for r in records.by_id(summaries, "id", 4).collect()] == [4]


def test_marked_exports(spark, tmp_path):
    rows = spark.createDataFrame([("a,b", None, 1), ("c", "é", 2)], "file string, true_language string, n int").coalesce(1)
    sinks.write_csv(rows, str(tmp_path / "csv"))
    part = next((tmp_path / "csv").glob("part-*")).read_bytes()
    assert part.startswith(b"\xef\xbb\xbffile,true_language,n\n")
    assert [tuple(r) for r in spark.read.csv(str(tmp_path / "csv"), header=True).collect()] == [("a,b", None, "1"), ("c", "é", "2")]
    sinks.write_reports(spark.createDataFrame([(7, "one\ntwo")], "id long, report string"), str(tmp_path / "reports"))
    assert next((tmp_path / "reports" / "id=7").glob("part-*")).read_text(encoding="utf-8-sig") == "one\ntwo\n"


def test_versions_survive_an_unfinished_write(spark, tmp_path):
    root = str(tmp_path / "store")
    for n in range(3):
        sinks.write_version({"rows": spark.range(n + 1)}, root)
    (tmp_path / "store" / "v00000004.part").mkdir()
    assert [v[-1] for v in sinks.versions(spark, root)] == ["2", "3"] and sinks.read_version(spark, root, "rows").count() == 3
    sinks.write_version({"rows": spark.range(9)}, root)
    assert sinks.read_version(spark, root, "rows").count() == 9


def test_labelled_collection_and_corpora(spark, tmp_path):
    folder = tmp_path / "texts"
    folder.mkdir()
    (folder / "a.txt").write_text("hello")
    (folder / "b.txt").write_text("привет")
    for name, body in (("map.json", '{"a.txt": "en", "gone.txt": "ru"}'), ("list.json", '[{"file": "a.txt", "language": "en"}, {"file": "gone.txt", "language": "ru"}]')):
        (tmp_path / name).write_text(body)
        found, missing = readers.labelled_collection(spark, str(tmp_path / name), str(folder))
        assert [tuple(r) for r in found.collect()] == [("a.txt", "en", "hello")] and [r.file for r in missing.collect()] == ["gone.txt"]
    corpora = readers.language_corpora(spark, {"en": str(folder / "a.txt"), "ru": str(folder / "b.txt")})
    assert sorted((r.lang, r.text) for r in corpora.collect()) == [("en", "hello"), ("ru", "привет")]
