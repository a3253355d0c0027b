"""Incremental ingestion of a folder: files are compared with what is stored by path and digest."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from textloom.functions.text import title_of
from textloom.operators.records import file_changes, tally
from textloom.sources.readers import extract, files
from textloom.sources.sinks import read_version, versions, write_version

STORED = "path string, title string, text string, hash string, doc_date string, doc_time string"


def crawl(found: DataFrame, stored: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(documents after the crawl, (path, status, message) of every file). New files are added with the name as their
    title, changed ones get text, digest and time anew and keep their title; documents whose files are gone stay."""
    read = extract(found)
    changes = file_changes(read.where("error is null").select("path", "hash"), stored.select("path", "hash"))
    faults = read.where("error is not null").select("path", F.when(F.col("error") == "unsupported", "unsupported").otherwise("error").alias("status"), F.col("error").alias("message"))
    report = changes.select("path", "status", F.lit(None).cast("string").alias("message")).unionByName(faults)
    fresh = read.join(changes.where("status <> 'unchanged'"), "path").join(stored.select("path", F.col("title").alias("old")), "path", "left")
    now = F.current_timestamp()
    rows = fresh.select("path", F.coalesce("old", title_of(F.col("path"))).alias("title"), "text", "hash", F.date_format(now, "yyyy-MM-dd").alias("doc_date"), F.date_format(now, "HH:mm").alias("doc_time"))
    return stored.join(rows.select("path"), "path", "left_anti").unionByName(rows), report


def _stored(spark: SparkSession, store: str) -> DataFrame:
    return read_version(spark, store, "documents") if versions(spark, store) else spark.createDataFrame([], STORED)


def crawl_folder(spark: SparkSession, root: str, store: str) -> DataFrame:
    """One crawl of `root` into the store: the tally of outcomes. The documents become its next version."""
    after, report = crawl(files(spark, root), _stored(spark, store))
    counted = tally(report)
    rows = counted.collect()  # one row a status
    write_version({"documents": after}, store)
    return spark.createDataFrame(rows, counted.schema)


def follow_folder(spark: SparkSession, root: str, store: str, checkpoint: str) -> StreamingQuery:
    """A stream of new files of `root`, each micro-batch merged into the store as its next version; ends when all files now there
    are read. A batch run again after a crash finds its files unchanged and adds nothing."""
    schema = "path string, modificationTime timestamp, length long, content binary"
    found = spark.readStream.format("binaryFile").schema(schema).option("recursiveFileLookup", True).load(root)

    def merge(batch: DataFrame, _: int) -> None:
        after, _report = crawl(batch.select("path", "length", "content"), _stored(spark, store))
        write_version({"documents": after}, store)

    return found.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
