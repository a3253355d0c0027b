"""The inverted index: postings, document frequencies, TF-IDF weights."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from textloom.functions.text import search_tokens
from textloom.session import checkpoint
from textloom.sources.sinks import read_version, write_version

#: Postings of one bucket of a stored index, about.
ROWS_PER_BUCKET = 4_000_000


def indexed_text() -> Column:
    """What is indexed of a document: its text and its title; a missing one counts as empty."""
    return F.concat_ws(" ", F.coalesce("text", F.lit("")), F.coalesce("title", F.lit("")))


def tokens(documents: DataFrame) -> DataFrame:
    """(doc_id, pos, term) of every term occurrence."""
    return documents.select("doc_id", F.posexplode(search_tokens(indexed_text())).alias("pos", "term"))


def postings(documents: DataFrame) -> DataFrame:
    """(doc_id, term, tf): one shuffle, combined on the map side."""
    return documents.select("doc_id", F.explode(search_tokens(indexed_text())).alias("term")).groupBy("doc_id", "term").agg(F.count("*").cast("int").alias("tf"))


def document_frequency(posts: DataFrame, n_documents: DataFrame) -> DataFrame:
    """(term, df, idf) with idf = ln(N / df); `n_documents` is one row (n), all documents counted."""
    # The sum of tf keeps the column alive, so that the shuffle of the postings is the same as their other readers' and is reused.
    df = posts.groupBy("term").agg(F.count("*").alias("df"), F.sum("tf").alias("tf")).where("tf > 0")
    return df.join(F.broadcast(n_documents)).select("term", "df", F.log(F.col("n") / F.col("df")).alias("idf"))


def count_documents(documents: DataFrame) -> DataFrame:
    return documents.agg(F.count("*").alias("n"))


def weights(documents: DataFrame) -> DataFrame:
    """(doc_id, term, tf, weight): tf * idf, scaled to length 1 per document; documents whose weights are all 0 keep them."""
    return weighted(postings(documents), count_documents(documents))


def weighted(posts: DataFrame, n_documents: DataFrame) -> DataFrame:
    """The weights of given postings.

    The frequencies are joined on the term (an equi-join of an aggregate, so a frequent term is one row on that side
    and adaptive execution splits the other); the squares are summed per document on the map side and the sums joined back."""
    raw = posts.join(document_frequency(posts, n_documents), "term").select("doc_id", "term", "tf", (F.col("tf") * F.col("idf")).alias("w"))
    norms = raw.groupBy("doc_id").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"))
    return raw.join(norms, "doc_id").select("doc_id", "term", "tf", F.coalesce(F.col("w") / F.nullif("norm", F.lit(0.0)), F.col("w")).alias("weight"))


def bucket_of(term: Column, buckets: Column) -> Column:
    return F.pmod(F.xxhash64(term), buckets).cast("int")


def store(documents: DataFrame, root: str) -> None:
    """Writes documents, postings and weights as one version of an index: all become visible together.

    Postings and weights are partitioned by a bucket of the term and sorted by it, so a search reads the buckets of its terms
    and, within them, the row groups that can hold them."""
    _write(root, documents, postings(documents))


def _write(root: str, documents: DataFrame, posts: DataFrame) -> None:
    posts = checkpoint(posts)
    buckets = max(8, posts.count() // ROWS_PER_BUCKET)
    split = lambda df: df.withColumn("buckets", F.lit(buckets)).withColumn("bucket", bucket_of(F.col("term"), F.lit(buckets))).repartition("bucket").sortWithinPartitions("bucket", "term")
    tables = {"documents": documents, "postings": split(posts), "weights": split(weighted(posts, count_documents(documents)))}
    write_version(tables, root, {"postings": ["bucket"], "weights": ["bucket"]})


def update(spark: SparkSession, root: str, changed: DataFrame | None = None, removed: DataFrame | None = None) -> None:
    """Adds or replaces the documents `changed` and drops those of `removed` (doc_id), with their postings, as a new version; the
    weights are computed anew, as the frequencies of all terms change."""
    documents, posts = read_version(spark, root, "documents"), read_version(spark, root, "postings").drop("bucket", "buckets")
    if removed is not None:
        documents, posts = without_documents(documents, posts, removed)
    if changed is not None:
        rows = changed.select(*documents.columns)
        documents = documents.join(rows.select("doc_id"), "doc_id", "left_anti").select(*rows.columns).unionByName(rows)
        posts = reindexed(posts, rows)
    _write(root, documents, posts)


def stored_weights(spark: SparkSession, root: str) -> DataFrame:
    """(doc_id, term, tf, weight, bucket, buckets) of the newest version."""
    return read_version(spark, root, "weights")


def top_terms(weighted: DataFrame, n: int = 15) -> DataFrame:
    """The n heaviest terms of every document, weights rounded to 4 places."""
    order = W.partitionBy("doc_id").orderBy(F.round("weight", 9).desc(), "term")
    return weighted.withColumn("rank_pos", F.row_number().over(order)).where(F.col("rank_pos") <= n).select("doc_id", "rank_pos", "term", F.round("weight", 4).alias("weight"))


def without_documents(documents: DataFrame, posts: DataFrame, removed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Deletes documents and, with them, their postings; weights are to be computed anew."""
    return documents.join(removed, "doc_id", "left_anti"), posts.join(removed, "doc_id", "left_anti")


def reindexed(posts: DataFrame, changed: DataFrame) -> DataFrame:
    """Postings after the documents `changed` were added or changed: theirs are replaced, the others kept."""
    return posts.join(changed.select("doc_id"), "doc_id", "left_anti").unionByName(postings(changed))
