"""Problem 1: near-duplicate records with small edits.

Method: SetSketch. Each record is the set of its word shingles; records with the same set form a class, and one
representative stands for it from then on. The registers of the representatives are cut into bands, equal bands make
candidates, the joint likelihood of the two sketches drops candidates far below the threshold, and the shingle sets
themselves decide the rest. The similarity of sets at the threshold may miss every band with the probability
`miss` (0.001) at most; more similar ones far less often.

Skew: copies collapse before any pair is made. Candidates come from an equi-join on the band, which adaptive
execution splits where a band is frequent; nothing is capped. Only ids and sketches travel there; the texts of the pairs
left over are read again, once each. Registers are fine enough (see setsketch) that unlike records hardly ever share a
band. `links` gives links between representatives and the membership of the classes; only `pairs` writes copies out as pairs.

Defined cases: records with a null id or text, or with fewer words than `min_words` or than a shingle has, belong to no pair; repeated rows
of one id count once. Words are maximal runs of letters and digits of the lower-cased text.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textloom.llm import setsketch
from textloom.llm.hashing import mix
from textloom.session import checkpoint, partitions

WORD = re.compile(r"[^\W_]+")
#: Registers of a band. Records of one language share a few per cent of their shingles; with six a band, pairs of such a
#: similarity J become candidates about 145 J**6 of the time.
ROWS = 6
MISS = 0.001
#: Registers kept for the likelihood; of the others only the bands' hashes are, KEY bytes each.
KEPT, KEY = 96, 5
#: Rows of bands in a partition of the join that finds candidates.
BAND_ROWS = 250_000
#: Standard errors by which an estimate may stay below the threshold and still be verified.
MARGIN = 4.5
_MEMO = 1_000_000
_CHUNK = 1 << 19
_words: dict[str, int] = {}
_word_hashes = np.empty(1 << 16, dtype=np.uint64)


def _hash_words(words: list[str]) -> np.ndarray:
    """64-bit hashes of words; a worker remembers those it has seen."""
    global _word_hashes
    if len(_words) > _MEMO:
        _words.clear()
    new = set(words).difference(_words)
    if new:
        if len(_words) + len(new) > len(_word_hashes):
            _word_hashes = np.resize(_word_hashes, 2 * (len(_words) + len(new)))
        for word in new:
            at = len(_words)
            _word_hashes[at] = xxhash.xxh3_64_intdigest(word.encode("utf-8", "surrogatepass"))
            _words[word] = at
    return _word_hashes[np.fromiter(map(_words.__getitem__, words), dtype=np.int64, count=len(words))]


def shingle_sets(texts: list[str | None], size: int, min_words: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(rows, starts, hashes) of bounded chunks: the distinct shingle hashes of text rows[k] are hashes[starts[k]:starts[k+1]], sorted."""
    held: list[list[str]] = []
    rows: list[int] = []
    count = 0

    def flush() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        h = _hash_words(list(chain.from_iterable(held)))
        lengths = np.array([len(w) for w in held])
        n = len(h) - size + 1
        s = np.zeros(n, dtype=np.uint64)
        for k in range(size):
            s = mix(s + h[k : k + n])
        owner = np.repeat(np.arange(len(held)), lengths)
        inside = np.flatnonzero(owner[:n] == owner[size - 1 :])
        s, owner = s[inside], owner[inside]
        order = np.lexsort((s, owner))
        s, owner = s[order], owner[order]
        new = np.ones(len(s), dtype=bool)
        new[1:] = (s[1:] != s[:-1]) | (owner[1:] != owner[:-1])
        s, owner = s[new], owner[new]
        starts = np.searchsorted(owner, np.arange(len(held) + 1))
        return np.array(rows), starts, s

    for row, text in enumerate(texts):
        words = WORD.findall(text.lower()) if text else []
        if len(words) < max(min_words, size):
            continue
        if count and count + len(words) > _CHUNK:
            yield flush()
            held, rows, count = [], [], 0
        held.append(words)
        rows.append(row)
        count += len(words)
    if rows:
        yield flush()


def sketches(documents: DataFrame, size: int, min_words: int, rows: int, bands: int) -> DataFrame:
    """(doc_id, n, s1, s2, sketch, keys): number of distinct shingles, 128-bit hash of their set, the first registers, and a hash of
    the registers of each band."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            for texts, starts, s in shingle_sets(batch.column(1).to_pylist(), size, min_words):
                heads = starts[:-1]
                registers = setsketch.sketch(s, heads, max(rows * bands, KEPT))
                keys = np.zeros((len(heads), bands), dtype=np.uint64)
                for i in range(rows):
                    keys = mix(keys * np.uint64(0x100000001B3) + registers[:, i : rows * bands : rows] + np.uint64(1))
                packed = np.ascontiguousarray(keys.view(np.uint8).reshape(len(heads), bands, 8)[:, :, :KEY])
                s1 = np.add.reduceat(mix(s ^ np.uint64(0xA5A5A5A5A5A5A5A5)), heads).view(np.int64)
                s2 = np.add.reduceat(mix(s + np.uint64(0x5851F42D4C957F2D)), heads).view(np.int64)
                binary = [pa.array([r.tobytes() for r in rows_of], pa.binary()) for rows_of in (registers[:, :KEPT], packed)]
                yield pa.RecordBatch.from_arrays([pa.array(ids[texts].astype(np.int64)), pa.array(np.diff(starts).astype(np.int32)), pa.array(s1), pa.array(s2), *binary], names=["doc_id", "n", "s1", "s2", "sketch", "keys"])

    return documents.mapInArrow(run, "doc_id long, n int, s1 long, s2 long, sketch binary, keys binary")


def _bands(reps: DataFrame, bands: int) -> DataFrame:
    """(band, rep, n): the number of each band with the hash of its registers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = np.arange(bands, dtype=np.int64) << (8 * KEY)
        for batch in batches:
            if not batch.num_rows:
                continue
            wide = np.zeros((batch.num_rows, bands, 8), dtype=np.uint8)
            wide[:, :, :KEY] = np.frombuffer(b"".join(batch.column(2).to_pylist()), dtype=np.uint8).reshape(batch.num_rows, bands, KEY)
            keys = wide.view(np.int64).reshape(batch.num_rows, bands) | number
            ids = np.repeat(batch.column(0).to_numpy(), bands)
            sizes = np.repeat(batch.column(1).to_numpy(), bands)
            yield pa.RecordBatch.from_arrays([pa.array(keys.reshape(-1)), pa.array(ids), pa.array(sizes)], names=["band", "rep", "n"])

    return reps.select("rep", "n", "keys").mapInArrow(run, "band long, rep long, n int")


def _likely(pairs: DataFrame, least: float) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            one, other = (np.frombuffer(b"".join(batch.column(c).to_pylist()), dtype=np.uint16).reshape(batch.num_rows, -1) for c in ("ka", "kb"))
            close = setsketch.jaccard(one, other, batch.column("na").to_numpy().astype(float), batch.column("nb").to_numpy().astype(float)) >= least
            keep = pa.array(np.flatnonzero(close))
            yield pa.RecordBatch.from_arrays([batch.column("a").take(keep), batch.column("b").take(keep)], names=["a", "b"])

    return pairs.select("a", "b", "na", "nb", "ka", "kb").mapInArrow(run, "a long, b long")


def _verified(pairs: DataFrame, size: int, threshold: float) -> DataFrame:
    """The pairs whose shingle sets reach the threshold, and the similarity."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b = batch.column("a").to_pylist(), batch.column("b").to_pylist()
            texts: dict[int, str] = {}
            for ids, column in ((a, "ta"), (b, "tb")):
                texts.update(zip(ids, batch.column(column).to_pylist()))
            names, sets = list(texts), {}
            for rows, starts, s in shingle_sets(list(texts.values()), size, 1):
                for k, row in enumerate(rows.tolist()):
                    sets[names[row]] = s[starts[k] : starts[k + 1]]
            out = []
            for x, y in zip(a, b):
                both = len(np.intersect1d(sets[x], sets[y], assume_unique=True))
                either = len(sets[x]) + len(sets[y]) - both
                if both >= threshold * either - 1e-9:
                    out.append((x, y, both / either))
            yield pa.RecordBatch.from_arrays([pa.array([o[k] for o in out], kind) for k, kind in enumerate((pa.int64(), pa.int64(), pa.float64()))], names=["a", "b", "similarity"])

    return pairs.select("a", "b", "ta", "tb").mapInArrow(run, "a long, b long, similarity double")


def links(documents: DataFrame, size: int = 5, threshold: float = 0.8, min_words: int = 1, rows: int = ROWS, miss: float = MISS) -> tuple[DataFrame, DataFrame]:
    """(members, links): members has (doc_id, rep) of every record with shingles, links has (a, b, similarity) with
    a < b of every two representatives that reach the threshold."""
    bands = setsketch.bands_for(threshold, rows, miss)
    docs = documents.where(F.col("doc_id").isNotNull() & F.col("text").isNotNull()).select(F.col("doc_id").cast("long"), "text")
    sets = checkpoint(sketches(docs, size, min_words, rows, bands))
    if not sets.groupBy("doc_id").count().where("count > 1").isEmpty():
        sets = checkpoint(sets.dropDuplicates(["doc_id"]))
    # Sketches stay where they are: classes are found by the hashes of the sets alone, and only the ids of copies are joined back.
    classes = sets.groupBy("s1", "s2", "n").agg(F.min("doc_id").alias("rep"))
    members = checkpoint(sets.select("doc_id", "s1", "s2", "n").join(classes, ["s1", "s2", "n"]).select("doc_id", "rep"))
    reps = sets.join(members.where("doc_id <> rep").select("doc_id"), "doc_id", "left_anti").withColumnRenamed("doc_id", "rep")
    band = _bands(reps, bands)
    left, right = band.toDF("band", "a", "na"), band.toDF("band", "b", "nb")
    near = (F.col("a") < F.col("b")) & (F.least("na", "nb") >= F.lit(threshold - 1e-9) * F.greatest("na", "nb"))
    pairs = left.join(right, "band").where(near).groupBy("a", "b").agg(F.first("na").alias("na"), F.first("nb").alias("nb"))
    keys = reps.select(F.col("rep"), F.col("sketch"))
    pairs = pairs.join(keys.toDF("a", "ka"), "a").join(keys.toDF("b", "kb"), "b")
    likely = _likely(pairs, threshold - MARGIN * (threshold * (1 - threshold) / KEPT) ** 0.5)
    with partitions(documents.sparkSession, members.count() * bands // BAND_ROWS):
        likely = checkpoint(likely)
    ids = likely.select(F.explode(F.array("a", "b")).alias("doc_id")).distinct()
    texts = checkpoint(docs.join(ids, "doc_id", "left_semi").dropDuplicates(["doc_id"]))
    found = _verified(likely.join(texts.toDF("a", "ta"), "a").join(texts.toDF("b", "tb"), "b"), size, threshold)
    return members.select("doc_id", "rep"), checkpoint(found.dropDuplicates(["a", "b"]))


def pairs(documents: DataFrame, size: int = 5, threshold: float = 0.8, min_words: int = 1) -> DataFrame:
    """(doc_a, doc_b) with doc_a < doc_b of every two records that reach the threshold, copies included."""
    members, found = links(documents, size, threshold, min_words)
    several = members.groupBy("rep").count().where("count > 1").select("rep")
    one, other = members.toDF("x", "a"), members.toDF("y", "b")
    across = found.select("a", "b").join(one, "a").join(other, "b").select(F.least("x", "y").alias("doc_a"), F.greatest("x", "y").alias("doc_b"))
    copies = members.join(several, "rep")
    within = copies.toDF("rep", "doc_a").join(copies.toDF("rep", "doc_b"), "rep").where("doc_a < doc_b").select("doc_a", "doc_b")
    return across.unionByName(within)


def components(edges: DataFrame) -> DataFrame:
    """(node, root): the least node each node of the edges (a, b) is connected with, by alternating large and small stars.

    Each round is a shuffle of the edges and ends in the shared folder; the rounds grow with the logarithm of the
    longest chain. Edges never gather in one task but as the pre-aggregated minimum of a node's neighbours."""

    def star(e: DataFrame, large: bool) -> DataFrame:
        both = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        if not large:
            both = e.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        low = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        joined = both.join(low, "a")
        if large:
            return joined.where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        return joined.select(F.col("b").alias("x"), F.col("m"), F.col("a")).select(F.explode(F.array(F.struct("x", "m"), F.struct(F.col("a").alias("x"), F.col("m")))).alias("e")).select(F.col("e.x").alias("a"), F.col("e.m").alias("b")).where("a <> b").distinct()

    edges = checkpoint(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    sums = lambda e: e.agg(F.count("*"), F.sum(F.hash("a", "b").cast("long"))).first()
    state = sums(edges)
    while state[0]:
        edges = checkpoint(star(star(edges, True), False))
        before, state = state, sums(edges)
        if before == state:
            break
    roots = edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return roots.unionByName(edges.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())


def groups(documents: DataFrame, size: int = 5, threshold: float = 0.8, min_words: int = 1) -> DataFrame:
    """(doc_id, class_id, group_id, n_links) of every record with a non-null id: the class of equal shingle sets, the group of
    classes connected by links, and the number of links of the class. A record in no class stands alone."""
    members, found = links(documents, size, threshold, min_words)
    degree = found.select(F.explode(F.array("a", "b")).alias("rep")).groupBy("rep").agg(F.count("*").alias("n_links"))
    roots = components(found).withColumnRenamed("node", "rep")
    known = members.join(degree, "rep", "left").join(roots, "rep", "left")
    ids = documents.where("doc_id is not null").select(F.col("doc_id").cast("long")).distinct()
    return ids.join(known, "doc_id", "left").select(
        "doc_id",
        F.coalesce("rep", "doc_id").alias("class_id"),
        F.coalesce("root", "rep", "doc_id").alias("group_id"),
        F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
    )
