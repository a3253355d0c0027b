"""Ranked search, suggestions and snippets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from textloom.functions.text import escape_html, let, search_tokens, stem
from textloom.operators.index import bucket_of
from textloom.session import small

#: Rows of the query table up to which it is broadcast.
BROADCAST_ROWS = 100_000
#: Steps of equal width in which ranks are counted.
STEPS = 1 << 14
#: Digits by which ranks are compared, so that equal sums added in another order stay ties.
DIGITS = 9


def query_terms(queries: DataFrame) -> DataFrame:
    """(query_id, term, n_terms) of the distinct terms of each query; n_terms counts those outside the vocabulary too."""
    terms = queries.select("query_id", F.array_distinct(search_tokens("query")).alias("terms"))
    return terms.select("query_id", F.size("terms").alias("n_terms"), F.explode("terms").alias("term"))


def scores(documents: DataFrame, weighted: DataFrame, queries: DataFrame, all_words: bool = False, since: str = "", until: str = "") -> DataFrame:
    """(query_id, doc_id, rank, matched) of every hit, not ordered; see `search`. Weights with a bucket of the term (a stored index)
    are read in the buckets of the queries' terms only."""
    asked = query_terms(queries)
    keys = ["term"]
    if "bucket" in weighted.columns:
        asked = asked.withColumn("bucket", bucket_of(F.col("term"), F.lit(weighted.select("buckets").first()[0] if weighted.take(1) else 1)))
        keys = ["bucket", "term"]
    few = asked.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    sent = F.broadcast if few else (lambda df: df)
    asked = sent(asked)
    hits = weighted.select("doc_id", "term", "weight", *keys[:-1]).join(asked, keys)
    found = hits.groupBy("query_id", "doc_id").agg(F.sum("weight").alias("dot"), F.first("n_terms").alias("n_terms"), F.array_sort(F.collect_set("term")).alias("matched")).where("n_terms > 0")
    # Which terms of a query some document has: sets of matched terms, as many as a query has subsets. All columns are read, so both readers share one shuffle.
    sets = found.groupBy("query_id").agg(F.collect_set("matched").alias("sets"), F.max("dot").alias("d"), F.max("n_terms").alias("t")).where("d is not null and t > 0")
    vocabulary = sent(sets.select("query_id", F.size(F.array_distinct(F.flatten("sets"))).alias("known")))  # fewer rows than the queries have terms
    if all_words:
        found = found.where(F.size("matched") >= F.col("n_terms"))
    dates = documents.select("doc_id", "doc_date")
    if since:
        dates = dates.where(F.col("doc_date") >= since)
    if until:
        dates = dates.where(F.col("doc_date") <= until)
    found = found.join(dates, "doc_id", "left_semi") if since or until else found
    return found.join(vocabulary, "query_id").withColumn("rank", F.round(F.col("dot") / F.sqrt("known"), DIGITS)).where("rank > 0").select("query_id", "doc_id", "rank", "matched")


def _step(rank: Column) -> Column:
    """Steps of the rank, the best first; ranks are cosines."""
    return F.floor((1 - rank) * STEPS).cast("int")


def _before(found: DataFrame) -> DataFrame:
    """(query_id, step, before): how many hits stand in better steps; at most STEPS rows a query, counted on the map side."""
    counts = found.groupBy("query_id", _step(F.col("rank")).alias("step")).agg(F.count("*").alias("n"))
    upto = W.partitionBy("query_id").orderBy("step").rowsBetween(W.unboundedPreceding, W.currentRow)
    return counts.select("query_id", "step", (F.sum("n").over(upto) - F.col("n")).alias("before"))


def search(documents: DataFrame, weighted: DataFrame, queries: DataFrame, limit: int | None = 50, all_words: bool = False, since: str = "", until: str = "") -> DataFrame:
    """(query_id, rank_pos, doc_id, rank, matched_terms), ranked by the cosine of document and query.

    Queries are binary vectors over the vocabulary. With all_words a document must hold every distinct term of the
    query, those outside the vocabulary included, so such a query finds nothing. `since` and `until` bound the date, which is
    compared as a string; an empty bound is open. Ties go to the lower doc_id. Queries without terms find nothing.

    With a limit the rank is cut before the shuffle; without one a task ranks one step of a query's ranks, and the numbers of
    hits in better steps are added."""
    found = scores(documents, weighted, queries, all_words, since, until)
    best = [F.desc("rank"), F.col("doc_id")]
    if limit is not None:
        placed = found.withColumn("rank_pos", F.row_number().over(W.partitionBy("query_id").orderBy(*best))).where(F.col("rank_pos") <= limit)
    else:
        inside = F.row_number().over(W.partitionBy("query_id", "step").orderBy(*best))
        placed = found.withColumn("step", _step(F.col("rank"))).withColumn("i", inside).join(_before(found), ["query_id", "step"]).withColumn("rank_pos", (F.col("i") + F.col("before")).cast("int"))
    return placed.select("query_id", "rank_pos", "doc_id", "rank", F.concat_ws(",", "matched").alias("matched_terms"))


def positions(found: DataFrame, wanted: DataFrame) -> DataFrame:
    """(query_id, rank_pos, doc_id) of the wanted (query_id, doc_id) among the hits of `scores`, without ranking the others: those in
    better steps are counted by step, and only the hits of a wanted one's own step are compared with it."""
    hits = found.select("query_id", "doc_id", "rank", _step(F.col("rank")).alias("step"))
    mine = hits.join(wanted.select("query_id", "doc_id").distinct(), ["query_id", "doc_id"]).toDF("query_id", "mine", "mine_rank", "step")
    better = (F.col("rank") > F.col("mine_rank")) | ((F.col("rank") == F.col("mine_rank")) & (F.col("doc_id") < F.col("mine")))
    ahead = hits.join(mine, ["query_id", "step"]).groupBy("query_id", "step", "mine").agg(F.sum(better.cast("long")).alias("ahead"))
    return ahead.join(_before(found), ["query_id", "step"]).select("query_id", (F.col("before") + F.col("ahead") + 1).cast("int").alias("rank_pos"), F.col("mine").alias("doc_id"))


def suggest(vocabulary: DataFrame, documents: DataFrame, prefixes: DataFrame, limit: int = 8, least: int = 2) -> DataFrame:
    """(prefix, place, suggestion): terms that begin with the prefix, then titles that hold it, each in order, at most
    `limit` of each and of both together, equal ones (whatever their case) once. LIKE's signs in a prefix keep their meaning.

    Terms and prefixes are joined on the first `least` letters, titles and prefixes on that many successive letters anywhere;
    prefixes with LIKE's signs have no such key and are held against everything, if there are few enough to send around."""
    asked = prefixes.where(F.length("prefix") >= least).distinct()
    signs = F.col("prefix").rlike(r"[%_\\\\]")
    plain = asked.where(~signs).withColumn("key", F.lower(F.left("prefix", F.lit(least))))
    low = F.lower("suggestion")
    named = vocabulary.select(F.col("term").alias("suggestion")).distinct()
    titles = documents.where("title is not null").select(F.col("title").alias("suggestion")).distinct()
    keys = F.array_distinct(F.transform(F.sequence(F.lit(1), F.length("suggestion") - (least - 1)), lambda i: F.substring(low, i, F.lit(least))))
    terms = named.withColumn("key", F.left(low, F.lit(least))).join(plain, "key").where(F.startswith(low, F.lower("prefix")))
    inside = titles.where(F.length("suggestion") >= least).withColumn("key", F.explode(keys)).join(plain, "key").where(F.contains(low, F.lower("prefix")))
    pattern = small(asked.where(signs), BROADCAST_ROWS)
    terms = terms.select("prefix", "suggestion").unionByName(named.join(pattern, F.expr("suggestion ilike prefix || '%'")).select("prefix", "suggestion"))
    inside = inside.select("prefix", "suggestion").unionByName(titles.join(pattern, F.expr("suggestion ilike '%' || prefix || '%'")).select("prefix", "suggestion"))
    each = W.partitionBy("prefix", "kind").orderBy("suggestion")
    both = terms.withColumn("kind", F.lit(0)).unionByName(inside.withColumn("kind", F.lit(1)))
    few = both.withColumn("i", F.row_number().over(each)).where(F.col("i") <= limit)
    once = few.withColumn("again", F.row_number().over(W.partitionBy("prefix", F.lower("suggestion")).orderBy("kind", "i"))).where("again = 1")
    return once.withColumn("place", F.row_number().over(W.partitionBy("prefix").orderBy("kind", "i"))).where(F.col("place") <= limit).select("prefix", "place", "suggestion")


def _pieces(text: Column) -> Column:
    """A text as gap, word, gap, word, ...; words are ASCII letters, the first gap may be empty."""
    parts = F.regexp_extract_all(text, F.lit("[a-zA-Z]+|[^a-zA-Z]+"), F.lit(0))
    return F.when(text.rlike("^[a-zA-Z]"), F.concat(F.array(F.lit("")), parts)).otherwise(parts)


def _is_hit(word: Column, terms: list[str]) -> Column:
    return stem(F.lower(word)).isin(terms) if terms else F.lit(False)


def _hits(pieces: Column, terms: list[str]) -> Column:
    """Numbers of the words whose stem is a query term."""
    return F.array_compact(F.transform(pieces, lambda p, i: F.when((i % 2 == 1) & _is_hit(p, terms), F.floor(i / 2).cast("int"))))


def _densest(hits: Column, n: Column, width: int) -> Column:
    """(best_start, hits) of the first window with the most hits. Unless it is the first of all, its last word is a hit, for else
    the window before it would do as well; so only windows that end with a hit are counted, over the hits before it alone."""

    def ending(at: Column, k: Column) -> Column:
        start = F.greatest(at - (width - 1), F.lit(0))
        near = F.slice(hits, F.greatest(k - (width - 2), F.lit(1)), F.lit(width))
        return F.struct((-F.size(F.filter(near, lambda h: (h >= start) & (h < start + width)))).alias("less"), start.alias("start"))

    best = F.array_min(F.concat(F.array(F.struct(F.lit(0).alias("less"), F.lit(0).alias("start"))), F.transform(hits, ending)))
    return F.struct(best["start"].alias("best_start"), (-best["less"]).alias("hits"), n.alias("n"))


def _with_windows(documents: DataFrame, terms: list[str], width: int) -> DataFrame:
    """(doc_id, text, pieces, n, w): the pieces of each text, its number of words and its best window; one pass without a shuffle."""
    cut = documents.where("text is not null").select("doc_id", "text", _pieces(F.col("text")).alias("pieces"))
    counted = cut.withColumn("n", F.floor(F.size("pieces") / 2).cast("int"))
    return counted.withColumn("w", let(_hits(F.col("pieces"), terms), lambda h: _densest(h, F.col("n"), width)))


def best_windows(documents: DataFrame, terms: list[str], width: int = 28) -> DataFrame:
    """(doc_id, best_start, hits): the first of the windows of `width` words with the most words whose stem is a query
    term; texts with fewer words have one window."""
    return _with_windows(documents, terms, width).where("n > 0").select("doc_id", "w.best_start", "w.hits")


def snippets(documents: DataFrame, terms: list[str], width: int = 28, most: int = 320) -> DataFrame:
    """(doc_id, snippet): the best window as HTML, query words in <strong>, as many whole words as fit in `most` characters,
    with … where text is left out. Texts without words give their first characters."""
    found = _with_windows(documents, terms, width)
    first = F.col("w.best_start")
    window = F.slice("pieces", 2 * first + 2, F.lit(2 * width - 1))
    before = F.length(F.array_join(F.slice("pieces", F.lit(1), 2 * first + 1), ""))
    placed = found.select("doc_id", "text", "n", before.alias("before"), window.alias("window"))
    # A text may end in a gap; the window does not. `at` is where the piece ends, counted from the window's beginning.
    ended = placed.withColumn("window", F.when((F.size("window") % 2 == 0) & (F.size("window") > 0), F.slice("window", F.lit(1), F.size("window") - 1)).otherwise(F.col("window")))
    nothing = F.struct(F.lit(0).alias("at"), F.lit("").alias("gap"), F.lit("").alias("html"))

    def step(acc: Column, piece: Column) -> Column:
        at = acc["at"] + F.length(piece)
        safe = escape_html(piece)
        word = F.concat(acc["html"], acc["gap"], F.when(_is_hit(piece, terms), F.concat(F.lit("<strong>"), safe, F.lit("</strong>"))).otherwise(safe))
        is_word = piece.rlike("^[a-zA-Z]")
        return F.struct(at.alias("at"), F.when(is_word, "").otherwise(safe).alias("gap"), F.when(is_word & (at <= most), word).otherwise(acc["html"]).alias("html"))

    html = F.aggregate("window", nothing, step, lambda acc: acc["html"])
    end = F.col("before") + F.least(F.length(F.array_join("window", "")), F.lit(most))
    dots = lambda c: F.when(c, "…").otherwise("")
    made = F.concat(dots(F.col("before") > 0), html, dots(end < F.length("text")))
    return ended.select("doc_id", F.when(F.col("n") == 0, escape_html(F.left("text", F.lit(most)))).otherwise(made).alias("snippet"))
