"""Quality of ranked retrieval, per query and over all queries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def judged(results: DataFrame, judgements: DataFrame) -> DataFrame:
    """The relevant ones of results (query_id, rank_pos, doc_id), with hits: how many relevant ones stand up to there."""
    marks = judgements.select("query_id", "doc_id").distinct()
    order = W.partitionBy("query_id").orderBy("rank_pos").rowsBetween(W.unboundedPreceding, W.currentRow)
    return results.join(marks, ["query_id", "doc_id"]).select("query_id", "rank_pos", "doc_id").withColumn("hits", F.count("*").over(order))


def _with_counts(queries: DataFrame, judgements: DataFrame) -> DataFrame:
    relevant = judgements.select("query_id", "doc_id").distinct().groupBy("query_id").agg(F.count("*").alias("n_rel"))
    return queries.select("query_id").distinct().join(relevant, "query_id", "left").fillna(0, ["n_rel"])


def f_measure(precision: Column, recall: Column, beta: float = 1.0) -> Column:
    """0 if either is undefined or both are 0."""
    b2 = beta * beta
    return F.when(precision.isNull() | recall.isNull() | (precision + recall == 0), 0.0).otherwise((1 + b2) * precision * recall / F.nullif(b2 * precision + recall, F.lit(0.0)))


def rank_metrics(queries: DataFrame, results: DataFrame, judgements: DataFrame, at: tuple[int, ...] = (5, 10), found: DataFrame | None = None) -> DataFrame:
    """Per query: precision (null if nothing was found), recall, R-precision and average precision (null if nothing is
    relevant), F1 (0 where undefined), and precision at each n (hits in the first n, over n).

    Only relevant results are ordered; of the others their number counts. `found` (query_id, found) gives that where `results` has
    the relevant ones only."""
    counts = _with_counts(queries, judgements)
    found = results.groupBy("query_id").agg(F.count("*").alias("found")) if found is None else found
    placed = judged(results, judgements).join(counts, "query_id")
    inside = lambda most: F.sum((F.col("rank_pos") <= most).cast("int"))
    sums = placed.groupBy("query_id").agg(
        F.count("*").alias("good"),
        F.sum(F.col("hits") / F.col("rank_pos")).alias("ap"),
        inside(F.col("n_rel")).alias("in_r"),
        *[inside(F.lit(n)).alias(f"in_{n}") for n in at],
    ).join(found, "query_id", "right")
    all_of = counts.join(sums, "query_id", "left")
    precision = F.coalesce("good", F.lit(0)) / F.nullif("found", F.lit(0))
    recall = F.coalesce("good", F.lit(0)) / F.nullif("n_rel", F.lit(0))
    return all_of.select(
        "query_id",
        precision.alias("precision"),
        recall.alias("recall"),
        f_measure(precision, recall).alias("f1"),
        (F.coalesce("ap", F.lit(0.0)) / F.nullif("n_rel", F.lit(0))).alias("average_precision"),
        (F.coalesce("in_r", F.lit(0)) / F.nullif("n_rel", F.lit(0))).alias("r_precision"),
        *[(F.coalesce(f"in_{n}", F.lit(0)) / F.lit(float(n))).alias(f"p_at_{n}") for n in at],
    )


def curve(queries: DataFrame, results: DataFrame, judgements: DataFrame) -> DataFrame:
    """(query_id, level, precision): interpolated precision at the recall levels 0..10 tenths; 0 without relevant documents.
    It is highest at relevant results, so the others are not needed."""
    counts = _with_counts(queries, judgements)
    points = judged(results, judgements).join(counts, "query_id").where("n_rel > 0").select("query_id", (F.col("hits") / F.col("n_rel")).alias("r"), (F.col("hits") / F.col("rank_pos")).alias("p"))
    levels = F.array(*[F.max(F.when(F.col("r") >= i / 10.0, F.col("p"))) for i in range(11)])
    best = points.groupBy("query_id").agg(levels.alias("best"))
    return counts.join(best, "query_id", "left").select("query_id", F.explode(F.sequence(F.lit(0), F.lit(10))).alias("level"), "best").select(
        "query_id", "level", F.coalesce(F.get("best", F.col("level")), F.lit(0.0)).alias("precision")
    )


def summary(metrics: DataFrame) -> DataFrame:
    """(metric, mean) over the queries where it is defined, 0 if nowhere, rounded to 4 places."""
    names = [c for c in metrics.columns if c != "query_id"]
    means = metrics.agg(*[F.round(F.coalesce(F.avg(c), F.lit(0.0)), 4).alias(c) for c in names])
    return means.unpivot([], names, "metric", "mean")


def mean_curve(curves: DataFrame) -> DataFrame:
    """(level, precision) over all queries, those without relevant documents included."""
    return curves.groupBy("level").agg(F.round(F.avg("precision"), 4).alias("precision"))
