"""The queries of the training-data problems, over whole tables with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from textloom.llm import encode, languages, mixing, neardup, sentences, spans, subjects, termfreq
from textloom.session import table

Query = Callable[[SparkSession, str], DataFrame]


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.pairs(table(spark, sf_dir, "documents"), size=3, threshold=0.6, min_words=20)


def p1_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.groups(table(spark, sf_dir, "documents"), size=3, threshold=0.6, min_words=20)


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentences.sentences(table(spark, sf_dir, "documents"), table(spark, sf_dir, "translation_runs"))


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return languages.languages(table(spark, sf_dir, "documents")).where("is_case").select("doc_id", "seg_no", "lang")


def p3_languages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return languages.languages(table(spark, sf_dir, "documents"), every=True)


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return termfreq.found(table(spark, sf_dir, "lemmas"), table(spark, sf_dir, "document_lemmas"))


def p4_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return termfreq.all_terms(table(spark, sf_dir, "lemmas"), table(spark, sf_dir, "document_lemmas"))


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents")
    rules = subjects.train(documents, table(spark, sf_dir, "labels"), table(spark, sf_dir, "subjects"))
    return subjects.document_subjects(documents, rules).select("doc_id", "subject")


def p5_composition(spark: SparkSession, sf_dir: str) -> DataFrame:
    return subjects.composition(p5_found(spark, sf_dir), table(spark, sf_dir, "documents"))


def p6_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode.encode(table(spark, sf_dir, "documents"))


def p7_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"), table(spark, sf_dir, "mix_targets"))


def p7_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.shares(table(spark, sf_dir, "documents"), table(spark, sf_dir, "mix_targets"))


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spans.shared_spans(table(spark, sf_dir, "documents"))


def p8_share(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spans.shared_share(table(spark, sf_dir, "documents"))


def queries() -> dict[str, Query]:
    return {
        "p1_found": p1_found,
        "p1_groups": p1_groups,
        "p2_found": p2_found,
        "p3_found": p3_found,
        "p3_languages": p3_languages,
        "p4_found": p4_found,
        "p4_terms": p4_terms,
        "p5_found": p5_found,
        "p5_composition": p5_composition,
        "p6_ids": p6_ids,
        "p7_mix": p7_mix,
        "p7_shares": p7_shares,
        "p8_found": p8_found,
        "p8_share": p8_share,
    }


_P4_TERMS = r"""
WITH terms AS (
    SELECT id, nfc_normalize(lower(regexp_replace(term, '^\s+|\s+$', '', 'g'))) AS term FROM lemmas WHERE term IS NOT NULL
), posts AS (
    SELECT DISTINCT id, document_id, lemma_id, tf FROM document_lemmas WHERE tf > 0
), counted AS (
    SELECT p.id, p.document_id, p.tf, t.term FROM posts p JOIN (SELECT DISTINCT id, term FROM terms) t ON t.id = p.lemma_id
), sums AS (
    SELECT term, CAST(sum(tf) AS BIGINT) AS occurrences, count(DISTINCT document_id) AS documents FROM counted GROUP BY term
), n AS (SELECT count(DISTINCT document_id) AS n FROM counted)
"""

#: Pairs by their common sequences of three words.
_P1_FOUND = r"""
WITH w AS (SELECT DISTINCT doc_id, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') AS w FROM documents WHERE doc_id IS NOT NULL AND text IS NOT NULL),
s AS (SELECT DISTINCT doc_id, unnest(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) AS s FROM w WHERE len(w) >= 20),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
x AS (SELECT a.doc_id AS doc_a, b.doc_id AS doc_b, count(*) AS c FROM s a JOIN s b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY ALL)
SELECT doc_a, doc_b FROM x JOIN n a ON a.doc_id = doc_a JOIN n b ON b.doc_id = doc_b WHERE c >= 0.6 * (a.n + b.n - c) - 1e-9"""
#: Every stretch of 200 characters, cut from blocks of the text, those of a second document kept and joined to runs.
_P8_FOUND = """
WITH d AS (SELECT doc_id, text, length(text) AS n FROM documents WHERE doc_id IS NOT NULL AND length(text) >= 200),
b AS (SELECT doc_id, unnest(range(0, n, 1000)) AS o, text, n FROM d),
p AS (SELECT doc_id, o, substring(text, o + 1, 1199) AS part, least(n - o, 1199) AS m FROM b),
s AS (SELECT doc_id, o + k AS pos, substring(part, k + 1, 200) AS piece FROM (SELECT *, unnest(range(0, greatest(m - 199, 0))) AS k FROM p)),
h AS (SELECT piece FROM s GROUP BY piece HAVING min(doc_id) <> max(doc_id)),
f AS (SELECT DISTINCT doc_id, pos FROM s JOIN h USING (piece)),
g AS (SELECT *, CASE WHEN pos <= lag(pos) OVER (PARTITION BY doc_id ORDER BY pos) + 200 THEN 0 ELSE 1 END AS new FROM f),
r AS (SELECT *, sum(new) OVER (PARTITION BY doc_id ORDER BY pos) AS run FROM g)
SELECT doc_id, CAST(min(pos) AS INT) AS span_start, CAST(max(pos) + 200 AS INT) AS span_end FROM r GROUP BY doc_id, run"""


def oracle_sql() -> dict[str, str]:
    return {
        "p1_found": _P1_FOUND,
        "p8_found": _P8_FOUND,
        "p4_found": _P4_TERMS + """
SELECT term, 'rare' AS mark FROM sums WHERE occurrences <= 2
UNION ALL SELECT term, 'common' FROM sums, n WHERE documents * 10 > n.n""",
        "p4_terms": _P4_TERMS + """
SELECT e.term, coalesce(occurrences, 0) AS occurrences, coalesce(documents, 0) AS documents,
    coalesce(occurrences <= 2, false) AS rare, coalesce(documents * 10 > n.n, false) AS common
FROM (SELECT DISTINCT term FROM terms) e LEFT JOIN sums ON sums.term = e.term, n""",
    }
