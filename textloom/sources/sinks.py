"""Writers: exports, profiles, reports, versioned stores."""

from __future__ import annotations

import json
import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# The columns of the result export.
RESULT_COLUMNS = ["file", "true_language", "freq_words_predicted", "freq_words_correct", "short_words_predicted", "short_words_correct", "neural_predicted", "neural_correct", "uploaded_at"]


def result_rows(records: DataFrame) -> DataFrame:
    """The flat result table of records with nested `methods` (freq_words, short_words, neural: predicted, correct)."""
    methods = [F.col(f"methods.{m}.{f}").alias(f"{m}_{f}") for m in ("freq_words", "short_words", "neural") for f in ("predicted", "correct")]
    return records.select(F.col("original_filename").alias("file"), F.coalesce("true_language", F.lit("")).alias("true_language"), *methods, "uploaded_at")


#: A byte order mark, for readers that take UTF-8 for another encoding without it.
MARK = "\ufeff"


def write_csv(rows: DataFrame, path: str, mark: bool = True) -> None:
    """CSV with a header in every part; with `mark` the header's first name, and so the file, begins with a byte order mark."""
    first = rows.columns[0]
    rows = rows.withColumnRenamed(first, MARK + first) if mark else rows
    rows.write.mode("overwrite").csv(path, header=True, encoding="UTF-8")


def write_reports(reports: DataFrame, path: str) -> None:
    """A report (id, report) a file folder: id=... below the path, each text with a byte order mark."""
    marked = reports.select("id", F.concat(F.lit(MARK), "report").alias("value"))
    marked.write.mode("overwrite").partitionBy("id").text(path)


def write_json(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").json(path)


def export_json(records: DataFrame, summary: DataFrame) -> DataFrame:
    """(kind, body): each record and each row of the summary as JSON, one a row, so that no row holds the collection."""
    one = records.select(F.lit("document").alias("kind"), F.to_json(F.struct(*records.columns)).alias("body"))
    return one.unionByName(summary.select(F.lit("summary").alias("kind"), F.to_json(F.struct(*summary.columns)).alias("body")))


def summary_text(sentences: DataFrame, keywords: DataFrame, most: int = 20) -> DataFrame:
    """(doc_id, text): up to `most` sentences and keywords of each document as plain text."""
    body = sentences.where(F.col("position") <= most).groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("position", "text"))).alias("s"))
    words = keywords.where(F.col("position") <= most).groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("position", "term"))).alias("k"))
    joined = body.join(words, "doc_id", "full")
    lines = F.array_join(F.transform("s", lambda x: x["text"]), "\n")
    return joined.select("doc_id", F.concat_ws("\n\n", lines, F.array_join(F.transform("k", lambda x: x["term"]), ", ")).alias("text"))


def profile_files(profile: DataFrame) -> DataFrame:
    """(language, word_probs, min_prob) of a profile (lang, word, prob, min_prob); a language's profile has a bounded number of words."""
    words = F.map_from_entries(F.collect_list(F.struct("word", "prob")))
    return profile.groupBy(F.col("lang").alias("language")).agg(words.alias("word_probs"), F.max("min_prob").alias("min_prob"))


def _folder(spark: SparkSession, root: str):
    path = spark._jvm.org.apache.hadoop.fs.Path(root)
    return path, path.getFileSystem(spark._jsc.hadoopConfiguration())


def versions(spark: SparkSession, root: str) -> list[str]:
    """Folders of the complete versions of a store, oldest first."""
    path, system = _folder(spark, root)
    if not system.exists(path):
        return []
    return sorted(f"{root}/{x.getPath().getName()}" for x in system.listStatus(path) if re.fullmatch(r"v\d{8}", x.getPath().getName()))


def write_version(tables: dict[str, DataFrame], root: str, partitions: dict[str, list[str]] | None = None) -> str:
    """Writes tables as the next version of a store and returns its folder. The folder gets its name by one rename when all
    is written, so readers see the version before or this one, and a crash loses neither; the last two are kept."""
    spark = next(iter(tables.values())).sparkSession
    have = versions(spark, root)
    folder = f"{root}/v{int(have[-1][-8:]) + 1 if have else 1:08d}"
    for name, df in tables.items():
        df.write.mode("overwrite").partitionBy(*(partitions or {}).get(name, [])).parquet(f"{folder}.part/{name}")
    _, system = _folder(spark, root)
    path = spark._jvm.org.apache.hadoop.fs.Path
    for name, df in tables.items():  # a table without rows has no files to learn its columns from
        out = system.create(path(f"{folder}.part/{name}.schema"), True)
        out.write(bytearray(df.schema.json().encode()))
        out.close()
    if not system.rename(path(f"{folder}.part"), path(folder)):
        raise OSError(f"{folder} cannot be put in place")
    for old in have[:-1]:
        system.delete(path(old), True)
    return folder


def read_version(spark: SparkSession, root: str, name: str) -> DataFrame:
    """A table of the newest complete version."""
    folder = versions(spark, root)[-1]
    _, system = _folder(spark, root)
    stream = system.open(spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/{name}.schema"))
    schema = T.StructType.fromJson(json.loads(spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")))
    stream.close()
    return spark.read.schema(schema).parquet(f"{folder}/{name}")


def replace_table(rows: DataFrame, path: str) -> None:
    """Rewrites a whole table."""
    rows.write.mode("overwrite").parquet(path)
