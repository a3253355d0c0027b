"""Readers: collections, profiles, corpora, files and uploads."""

from __future__ import annotations

import io
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.functions.text import allowed, strip, title_of

EXTENSIONS = ["txt", "pdf", "docx"]
MOST_BYTES = 20 * 1024 * 1024


def judged_collection(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(documents, queries, judgements) of a JSON collection with documents (title, date, time, text) and queries (query,
    relevant_titles). Ids follow the order in the file; unknown titles are left out, of equal titles the last one counts."""
    schema = "documents array<struct<title:string,date:string,time:string,text:string>>, queries array<struct<query:string,relevant_titles:array<string>>>"
    whole = spark.read.schema(schema).json(path, multiLine=True)
    documents = whole.select(F.posexplode("documents").alias("i", "d")).select((F.col("i") + 1).cast("long").alias("doc_id"), "d.title", "d.text", F.col("d.date").alias("doc_date"), F.col("d.time").alias("doc_time"))
    asked = whole.select(F.posexplode("queries").alias("i", "q")).select((F.col("i") + 1).alias("query_id"), "q.query", "q.relevant_titles")
    by_title = documents.groupBy("title").agg(F.max("doc_id").alias("doc_id"))
    wanted = asked.select("query_id", F.explode("relevant_titles").alias("title")).join(by_title, "title").select("query_id", "doc_id").distinct()
    return documents, asked.select("query_id", "query"), wanted


def files(spark: SparkSession, root: str) -> DataFrame:
    """(path, length, modified, content) of all files below a folder; content is read only where it is used. Links to folders are
    not followed on file systems that tell them apart: their files would come from outside the folder."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root).select("path", "length", F.col("modificationTime").alias("modified"), "content")


def decode(data: bytes) -> str:
    """Text in the first of three encodings that fits; the last one always does."""
    for encoding in ("utf-8", "cp1251"):
        try:
            return data.decode(encoding)
        except UnicodeDecodeError:
            continue
    return data.decode("latin-1")


def docx_text(data: bytes) -> str:
    """The paragraphs of a DOCX file that are not blank, one a line."""
    space = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
    with zipfile.ZipFile(io.BytesIO(data)) as archive:
        root = ElementTree.fromstring(archive.read("word/document.xml"))
    lines = ("".join(t.text or "" for t in p.iter(f"{space}t")) for p in root.iter(f"{space}p"))
    return "\n".join(line for line in lines if line.strip())


def pdf_text(data: bytes) -> str:
    """The pages' text joined by line breaks; needs a PDF library and raises ValueError where there is none or no text."""
    try:
        from pypdf import PdfReader
    except ImportError as e:
        raise ValueError("no PDF library is installed") from e
    text = "\n".join(page.extract_text() or "" for page in PdfReader(io.BytesIO(data)).pages)
    if not text.strip():
        raise ValueError("the PDF has no text")
    return text


def extract(content: DataFrame, most: int = MOST_BYTES) -> DataFrame:
    """(path, hash, text, error) of files (path, length, content): one of text and error is null.

    Unsupported extensions and files above `most` bytes are errors and are not decoded."""

    def run(batches: Iterator) -> Iterator:
        import pandas as pd

        readers = {"txt": decode, "docx": docx_text, "pdf": pdf_text}
        for batch in batches:
            texts: list[str | None] = []
            errors: list[str | None] = []
            for path, data, error in zip(batch["path"], batch["content"], batch["error"]):
                text = None
                if error is None:
                    try:
                        text = readers[path.rsplit(".", 1)[-1].lower()](bytes(data))
                    except (ValueError, KeyError, zipfile.BadZipFile, ElementTree.ParseError) as e:
                        error = str(e)
                texts.append(text)
                errors.append(error)
            yield pd.DataFrame({"path": batch["path"], "hash": batch["hash"], "text": texts, "error": errors})

    error = F.when(~allowed(F.col("path"), EXTENSIONS), "unsupported").when(F.col("length") > most, "too large")
    ready = content.select("path", error.alias("error"), F.when(error.isNull(), F.md5("content")).alias("hash"), F.when(error.isNull(), F.col("content")).alias("content"))
    return ready.mapInPandas(run, "path string, hash string, text string, error string")


def uploads(content: DataFrame, least: int, most: int | None = None) -> DataFrame:
    """(path, title, text) of uploaded UTF-8 text files (path, content): a byte order mark is dropped, white space at both ends
    too, and only texts of `least` to `most` characters are taken. Bytes that are not UTF-8 are refused."""
    raw = F.decode("content", "UTF-8")
    checked = content.where(allowed(F.col("path"), ["txt"]) & F.is_valid_utf8(F.col("content").cast("string")))
    texts = checked.select("path", title_of(F.col("path")).alias("title"), strip(F.regexp_replace(raw, "^﻿", "")).alias("text"))
    size = F.length("text")
    return texts.where((size >= least) & (size <= most if most is not None else F.lit(True)))


def corpus(spark: SparkSession, manifest: str, folder: str, language: str | None = None) -> DataFrame:
    """(file, title, language, domain, text) of the files a JSON manifest names, of one language if asked."""
    listed = spark.read.schema("file string, title string, language string, domain string").json(manifest, multiLine=True)
    listed = listed.where(F.col("language") == language) if language else listed
    texts = spark.read.text(folder, wholetext=True, recursiveFileLookup=True).select(F.substring_index(F.input_file_name(), "/", -1).alias("file"), F.col("value").alias("text"))
    return texts.join(listed, "file").select("file", "title", "language", "domain", "text")


def language_corpora(spark: SparkSession, paths: dict[str, str]) -> DataFrame:
    """(lang, doc_id, text) of training corpora, whole files of one language below each path; ids follow the names."""
    each = [spark.read.text(path, wholetext=True, recursiveFileLookup=True).select(F.lit(lang).alias("lang"), F.input_file_name().alias("name"), F.col("value").alias("text")) for lang, path in sorted(paths.items())]
    whole = each[0]
    for one in each[1:]:
        whole = whole.unionByName(one)
    return whole.select("lang", F.xxhash64("name").alias("doc_id"), "text")


def labelled_collection(spark: SparkSession, manifest: str, folder: str) -> tuple[DataFrame, DataFrame]:
    """(records, missing) of a JSON manifest {file: true language} or [{file, language}]: (file, true_language, text) of the files found
    in the folder, to be classified and stored with their label, and (file) of those that are not there."""
    raw = spark.read.text(manifest, wholetext=True)
    listed = F.from_json("value", "array<struct<file:string,language:string>>")
    named = F.from_json("value", "map<string,string>")
    pairs = F.when(F.trim("value").startswith("["), listed).otherwise(F.transform(F.map_entries(named), lambda e: F.struct(e["key"].alias("file"), e["value"].alias("language"))))
    rows = raw.select(F.inline(pairs)).select("file", F.col("language").alias("true_language"))
    texts = spark.read.text(folder, wholetext=True, recursiveFileLookup=True).select(F.substring_index(F.input_file_name(), "/", -1).alias("file"), F.col("value").alias("text"))
    return rows.join(texts, "file"), rows.select("file").join(texts.select("file"), "file", "left_anti")


def profiles(spark: SparkSession, path: str) -> DataFrame:
    """(lang, word, prob, min_prob) of profile files {language, word_probs, min_prob}."""
    raw = spark.read.schema("language string, word_probs map<string,double>, min_prob double").json(path, multiLine=True)
    return raw.select(F.col("language").alias("lang"), F.explode("word_probs").alias("word", "prob"), "min_prob")


def lexicon(lines: DataFrame, column: str = "value") -> DataFrame:
    """(english, pos, german, domain) of lines english|pos|german|domain; other lines are left out."""
    parts = F.split(column, r"\|", -1)
    return lines.where(F.size(parts) == 4).select(*[F.trim(parts[i]).alias(name) for i, name in enumerate(("english", "pos", "german", "domain"))])


def requests(lines: DataFrame, most: int = 10_000, column: str = "value") -> DataFrame:
    """(text, error) of JSON requests {"text": ...}: the text if it is a string, not blank and not too long."""
    text: Column = F.get_json_object(column, "$.text")
    error = F.when(text.isNull(), "no text").when(~text.rlike(r"\S"), "empty").when(F.length(text) > most, "too long")
    return lines.select(F.when(error.isNull(), text).alias("text"), error.alias("error"))

