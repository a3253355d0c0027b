"""Problem 4: frequency of every distinct term over the whole index.

Method: recursive radix spilling. Postings meet their terms partitioned by the lemma (the shuffle is the first level); a
task writes its rows to files of Spark's scratch folder by hash bits of the term as soon as it holds `HELD_BYTES`,
splits files larger than `PART_BYTES` again by further bits, and aggregates each with DuckDB, whose own memory is bounded and spills too.

A term of one lemma is counted to the end there, whatever its documents. Lemmas whose terms differ only in writing make one
term, so their sums by document go through the same aggregation once more, partitioned by the term.

Skew: lemmas with more postings than an even share (`HOT_ROWS`, at least a `HOT_SHARE`-th of all, so at most as many
lemmas) are dealt to `SALT` parts by the document, the others are whole in their partition; what comes out are partial sums,
added up by a pre-aggregated grouping on the term. Documents are counted apart: those with positive rows, less those whose
positive rows all lack a term.

Defined cases: rows with a null or non-positive tf, or a lemma that is null or has no term, do not count; rows of
one id count once, rows with a null id each; a null document counts in the sum of tf, not in the documents. Of lemmas repeated
with one id and several terms the least term counts. An empty term (only white space) is a term like others.
"""

from __future__ import annotations

import os
import shutil
import tempfile
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textloom.llm.hashing import mix
from textloom.session import checkpoint

#: Bytes of rows a task holds before it writes them to files by hash bits, and the largest file that is aggregated at once.
HELD_BYTES, PART_BYTES = 4 << 20, 64 << 20
#: Hash bits of one level; levels beyond the last are left to DuckDB's own spilling.
BITS, LEVELS = 3, 10
#: Postings of a lemma beyond which they are dealt to `SALT` parts, or a share of all postings if that is more.
HOT_ROWS, HOT_SHARE, SALT = 500_000, 100_000, 64

#: Sums of terms of one lemma; sums by document of the others; rows without a term of each document.
_SQL = """
WITH once AS (
    SELECT DISTINCT id, term, document_id, tf, variants FROM part WHERE id IS NOT NULL AND term IS NOT NULL
    UNION ALL SELECT id, term, document_id, tf, variants FROM part WHERE id IS NULL AND term IS NOT NULL
), pairs AS (SELECT term, document_id, variants, sum(tf) AS tf FROM once GROUP BY ALL)
SELECT term, CAST(NULL AS BIGINT) AS document_id, CAST(sum(tf) AS BIGINT) AS occurrences, count(document_id) AS documents, false AS variants FROM pairs WHERE NOT variants GROUP BY term
UNION ALL SELECT term, document_id, CAST(tf AS BIGINT), 0, true FROM pairs WHERE variants
UNION ALL SELECT NULL, document_id, count(*), 0, true FROM part WHERE term IS NULL AND document_id IS NOT NULL GROUP BY document_id
"""
_OUT = pa.schema([("term", pa.string()), ("document_id", pa.int64()), ("occurrences", pa.int64()), ("documents", pa.int64()), ("variants", pa.bool_())])
_OUT_SQL = "term string, document_id long, occurrences long, documents long, variants boolean"


def normalised(terms: DataFrame) -> DataFrame:
    """(id, term) with the term lower-cased, without white space at its ends and composed (NFC); null terms are left out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [unicodedata.normalize("NFC", t.strip().lower()) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.string())], names=["id", "term"])

    return terms.where("id is not null and term is not null").select(F.col("id").cast("long"), "term").mapInArrow(run, "id long, term string")


def _scratch() -> str:
    """A folder of this task attempt in the scratch space Spark gives its executors; it holds nothing another task needs."""
    local = os.environ.get("SPARK_LOCAL_DIRS", "").split(",")[0] or tempfile.gettempdir()
    os.makedirs(local, exist_ok=True)
    return tempfile.mkdtemp(prefix="radix-", dir=local)


def _hashes(terms: pa.Array) -> np.ndarray:
    """64-bit hashes of the terms, other bits than the shuffle's."""
    from pandas.util import hash_array

    coded = terms.fill_null("").dictionary_encode()
    return mix(hash_array(coded.dictionary.to_numpy(zero_copy_only=False)))[coded.indices.to_numpy()]


class Radix:
    """Rows of one partition of one level: held in memory up to a few bytes, then in files by hash bits of the term."""

    def __init__(self, folder: str, level: int, held: int, part: int):
        self.folder, self.level, self.part, self.limit = folder, level, part, part if level else held
        self.held: list[pa.RecordBatch] = []
        self.bytes = 0
        self.files: list[pa.ipc.RecordBatchStreamWriter | None] = [None] * (1 << BITS)
        self.paths = [os.path.join(folder, f"{level}-{i}") for i in range(1 << BITS)]

    def add(self, batch: pa.RecordBatch) -> None:
        self.held.append(batch)
        self.bytes += batch.nbytes
        if self.bytes > self.limit and self.level < LEVELS:
            self._spill()

    def _spill(self) -> None:
        """Writes what is held to the files, sorted by the hash bits so that each file gets one slice."""
        rows = pa.Table.from_batches(self.held).combine_chunks()
        bits = ((_hashes(rows["term"].chunk(0)) >> np.uint64(self.level * BITS)) & np.uint64((1 << BITS) - 1)).astype(np.int64)
        order = np.argsort(bits, kind="stable")
        rows, ends = rows.take(pa.array(order)), np.cumsum(np.bincount(bits, minlength=1 << BITS))
        for i, (a, b) in enumerate(zip([0, *ends.tolist()], ends.tolist())):
            if b > a:
                if self.files[i] is None:
                    self.files[i] = pa.ipc.new_stream(self.paths[i], rows.schema, options=pa.ipc.IpcWriteOptions(compression="lz4"))
                self.files[i].write_table(rows.slice(a, b - a))
        self.held, self.bytes = [], 0

    def parts(self) -> Iterator[pa.Table]:
        if not any(self.files):
            if self.held:
                yield pa.Table.from_batches(self.held)
            return
        if self.held:
            self._spill()
        for i, file in enumerate(self.files):
            if file is None:
                continue
            file.close()
            inner = Radix(os.path.join(self.folder, str(i)), self.level + 1, self.limit, self.part)
            os.makedirs(inner.folder, exist_ok=True)
            with pa.ipc.open_stream(self.paths[i]) as stream:
                for batch in stream:
                    inner.add(batch)
            os.remove(self.paths[i])
            yield from inner.parts()


def _aggregate(rows: DataFrame, held: int, part: int) -> DataFrame:
    """Sums (term, document_id, occurrences, documents, variants) of rows (id, term, document_id, tf, variants); see `_SQL`."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import duckdb

        folder = _scratch()
        try:
            radix = Radix(folder, 0, held, part)
            for batch in batches:
                if batch.num_rows:
                    radix.add(batch)
            with duckdb.connect(config={"memory_limit": "300MB", "threads": 1, "temp_directory": os.path.join(folder, "duckdb")}) as con:
                for rows_of in radix.parts():
                    con.register("part", rows_of)
                    yield from con.sql(_SQL).to_arrow_table().cast(_OUT).to_batches(max_chunksize=50_000)
        finally:
            shutil.rmtree(folder, ignore_errors=True)

    return rows.select("id", "term", "document_id", "tf", "variants").mapInArrow(run, _OUT_SQL)


def term_counts(lemmas: DataFrame, postings: DataFrame, held: int = HELD_BYTES, part: int = PART_BYTES, hot_rows: int = HOT_ROWS) -> tuple[DataFrame, int]:
    """((term, occurrences, documents) of every term with counted rows, number of documents with counted rows)."""
    terms = normalised(lemmas).groupBy("id").agg(F.min("term").alias("term")).withColumnRenamed("id", "lemma_id")
    several = terms.groupBy("term").agg(F.min("lemma_id").alias("lo"), F.max("lemma_id").alias("hi")).where("lo <> hi").select("term", F.lit(True).alias("variants"))
    terms = terms.join(several, "term", "left").select("lemma_id", "term", F.coalesce("variants", F.lit(False)).alias("variants"))
    positive = postings.where("tf > 0 and lemma_id is not null").select(F.col("lemma_id").cast("long"), F.col("id").cast("long"), F.col("document_id").cast("long"), F.col("tf").cast("long"))

    n = positive.count()
    hot = positive.groupBy("lemma_id").agg(F.count("*").alias("n")).where(F.col("n") > max(hot_rows, n // HOT_SHARE)).select("lemma_id", F.lit(SALT).alias("parts"))
    hot = F.broadcast(checkpoint(hot))  # at most HOT_SHARE lemmas
    one = F.lit(1)
    dealt = positive.join(hot, "lemma_id", "left").withColumn("salt", F.pmod(F.xxhash64("document_id"), F.coalesce("parts", one)).cast("int")).drop("parts")
    salted = terms.join(hot, "lemma_id", "left").withColumn("salt", F.explode(F.sequence(F.lit(0), F.coalesce("parts", one) - 1))).drop("parts")
    # A left join, as rows without a term are wanted for the count of documents. The partitioning is asked for by name, so
    # that a lemma's part stays whole whatever kind of join is taken.
    met = dealt.repartition("lemma_id", "salt").join(salted, ["lemma_id", "salt"], "left").withColumn("variants", F.coalesce("variants", F.lit(True)))
    sums = checkpoint(_aggregate(met, held, part))

    again = sums.where("variants and term is not null").select(F.lit(None).cast("long").alias("id"), "term", "document_id", F.col("occurrences").alias("tf"), F.lit(False).alias("variants"))
    joined = _aggregate(again.repartition("term", F.pmod(F.xxhash64("document_id"), F.lit(SALT))), held, part)
    total = sums.where("not variants").unionByName(joined).groupBy("term").agg(F.sum("occurrences").alias("occurrences"), F.sum("documents").alias("documents"))

    without = sums.where("term is null").groupBy("document_id").agg(F.sum("occurrences").alias("bad"))
    every = positive.where("document_id is not null").groupBy("document_id").agg(F.count("*").alias("rows"))
    counted = every.join(without, "document_id", "left").where("bad is null or bad < rows")
    return checkpoint(total), counted.count()


def marked(counts: DataFrame, n_documents: int, rare_at_most: int = 2, common_share: tuple[int, int] = (1, 10)) -> DataFrame:
    """Adds rare (at most so many occurrences) and common (in more than the share, a fraction, of the documents)."""
    over, under = common_share
    return counts.withColumn("rare", F.col("occurrences") <= rare_at_most).withColumn("common", F.col("documents") * under > F.lit(n_documents * over))


def found(lemmas: DataFrame, postings: DataFrame) -> DataFrame:
    """(term, mark) of every term marked; a term of a tiny index can bear both marks."""
    marks = F.array_compact(F.array(F.when(F.col("rare"), F.lit("rare")), F.when(F.col("common"), F.lit("common"))))
    return marked(*term_counts(lemmas, postings)).select("term", F.explode(marks).alias("mark"))


def all_terms(lemmas: DataFrame, postings: DataFrame) -> DataFrame:
    """(term, occurrences, documents, rare, common) of every distinct term; terms without counted rows have 0 and no marks."""
    every = normalised(lemmas).select("term").distinct()
    counts = marked(*term_counts(lemmas, postings))
    zero = {"occurrences": 0, "documents": 0, "rare": False, "common": False}
    return every.join(counts, "term", "left").fillna(zero)
