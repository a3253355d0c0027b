"""Changes of stored records: upserts, nested updates, deletes, change detection, paging."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def latest(rows: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The last row of every key: what an upsert of all rows in this order leaves. One pre-aggregated grouping, no window."""
    whole = F.struct(*[F.col(c) for c in rows.columns])
    return rows.groupBy(*keys).agg(F.max_by(whole, F.struct(*order)).alias("row")).select("row.*")


def upsert(stored: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """The stored rows without those whose key is in `new`, and the new rows."""
    return stored.join(new.select(*keys), keys, "left_anti").unionByName(new)


def insert_new(stored: DataFrame, new: DataFrame, keys: list[str]) -> tuple[DataFrame, DataFrame]:
    """(stored rows and the new ones whose key is free, the new rows refused). Of new rows with one key the first in order counts."""
    once = new.dropDuplicates(keys)
    refused = once.join(stored.select(*keys).distinct(), keys, "left_semi")
    return stored.unionByName(once.join(stored.select(*keys), keys, "left_anti")), refused


def delete(stored: DataFrame, keys: DataFrame) -> DataFrame:
    """The stored rows without those whose key is in `keys`."""
    return stored.join(keys, keys.columns, "left_anti")


def replaced_summaries(stored: DataFrame, children: DataFrame, new: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(summaries, keyword rows) after summaries `new` took the place of those of the same document and method. A summary's keyword
    rows go with it; those of the new ones come from their lists."""
    keys = ["document_id", "method"]
    fresh = latest(new, keys, [F.col("created_at"), F.col("id")])
    gone = stored.join(fresh.select(*keys), keys, "left_semi").select(F.col("id").alias("summary_id"))
    return upsert(stored, fresh, keys), children.join(gone.distinct(), "summary_id", "left_anti").unionByName(keyword_rows(fresh))


def by_id(rows: DataFrame, key: str, value: int) -> DataFrame:
    """The row or rows of one id; the comparison reaches the scan."""
    return rows.where(F.col(key) == F.lit(value))


def keyword_rows(summaries: DataFrame) -> DataFrame:
    """(summary_id, position, term, weight) from the JSON list `keywords`, positions from 1; null lists have no rows."""
    parsed = F.from_json("keywords", "array<struct<term:string,weight:double>>")
    return summaries.select(F.col("id").alias("summary_id"), F.posexplode(parsed).alias("p", "k")).select("summary_id", (F.col("p") + 1).alias("position"), "k.term", "k.weight")


def with_true_language(records: DataFrame, changes: DataFrame) -> DataFrame:
    """Sets `true_language` of changed records (doc_id, new_language) and, in every method of the nested `methods`, whether its prediction is right."""
    joined = records.join(changes, "doc_id", "left")
    label = F.when(F.col("new_language").isNotNull(), F.col("new_language")).otherwise(F.col("true_language"))
    out = joined.withColumn("true_language", label).drop("new_language")
    methods = F.col("methods")
    for name in records.schema["methods"].dataType.names:
        right = F.when(F.coalesce("true_language", F.lit("")) == "", F.lit(None).cast("boolean")).otherwise(methods[name]["predicted"] == F.col("true_language"))
        methods = methods.withField(name, methods[name].withField("correct", right))
    return out.withColumn("methods", methods)


def file_changes(files: DataFrame, known: DataFrame) -> DataFrame:
    """(path, status) of files (path, hash) against known (path, hash): new, changed or unchanged. Null hashes count as changed."""
    old = known.where("path is not null").groupBy("path").agg(F.max("hash").alias("old_hash"), F.lit(True).alias("seen"))
    status = F.when(F.col("seen").isNull(), "new").when(F.col("hash") == F.col("old_hash"), "unchanged").otherwise("changed")
    return files.join(old, "path", "left").select("path", status.alias("status"))


def tally(changes: DataFrame, statuses: tuple[str, ...] = ("new", "changed", "unchanged", "unsupported", "error")) -> DataFrame:
    """(status, files) for every status, those that did not occur with 0."""
    every = changes.sparkSession.createDataFrame([(s,) for s in statuses], "status string")
    return every.join(changes.groupBy("status").agg(F.count("*").alias("files")), "status", "left").fillna(0)


def recent(rows: DataFrame, order: list[Column], n: int) -> DataFrame:
    return rows.orderBy(*order).limit(n)


def page(rows: DataFrame, order: list[Column], number: int, size: int) -> DataFrame:
    """Page `number` (from 1; smaller numbers count as 1) of `size` rows."""
    return rows.orderBy(*order).offset((max(1, number) - 1) * size).limit(size)


def clamped(value: Column, low: int, high: int) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), value))


def shortened(changes: DataFrame, n: int = 20) -> DataFrame:
    """(status, shown, more): the first n paths of each status and how many more there are. A status can have any number of
    rows, so the first n are picked by rank, and only these are gathered."""
    order = W.partitionBy("status").orderBy("path")
    counts = changes.groupBy("status").agg(F.count("*").alias("n"))
    first = changes.withColumn("r", F.row_number().over(order)).where(F.col("r") <= n).groupBy("status").agg(F.array_sort(F.collect_list("path")).alias("shown"))
    return counts.join(first, "status").select("status", "shown", F.greatest(F.col("n") - n, F.lit(0)).alias("more"))
