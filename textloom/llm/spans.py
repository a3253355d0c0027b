"""Problem 8: long exact spans shared between records.

Method: compact windows. The tokens of a text are its character grams (one from each position), and the signature of a
subsequence under a hash function is the least hash of its tokens. All subsequences with the same least token form a
compact window (l, c, r): they begin at l..c and end at c..r, c being a node of the Cartesian tree over the token hashes
and l..r what hangs below it. Only nodes that hang over enough tokens for `min_chars` matter, about 2n / (tokens + 1) of a
text of n characters; they are the top of the tree, so sliding minima pick them and one pass with a stack links them.

This is done for `HASHES` hash functions. The windows of one function are intervals of beginnings that tile the text,
and the interval join of all functions' windows cuts it into segments whose signatures agree in every function. Two
texts that share a stretch of `min_chars` characters share its tokens, so their segments around it have equal
signatures throughout: nothing is missed, and each further function only takes away segments that merely look alike.

Signatures of one document only are dropped after a pre-aggregated count. For the others the characters of the segments
are compared, stretch by stretch, without forming pairs: a stretch is shared if the same stretch comes from a second
document. Hits are confirmed on the characters themselves on every path, so a hash collision can neither give nor lose a row.

A signature of more than `HOT` segments (boilerplate) is never gathered in one task: equal segments are grouped by their
characters, one of each goes on, its stretches meet in a pre-aggregated grouping on a 128-bit hash, neighbouring ones
are joined to runs, and the characters of each run are compared with those of the run it was matched with.

Defined cases: null and short texts have no rows; a stretch repeated inside one document only is not shared; rows
with a null id are left out; rows repeated with the same id count as one document. Positions are code points.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from textloom.llm.hashing import BLOCK, codes, gram_hashes, mix, sliding_min
from textloom.session import checkpoint

MIN_CHARS = 200
GRAM, HASHES = 80, 2
#: Segments of one signature that one task may hold.
HOT = 4096
_SECOND_BASE = 0xD6E8FEB86659FD93 | 1
#: Low bits of a packed token hash that hold its position in the block.
_PLACE = np.uint64((1 << 20) - 1)


def blocks(texts: list[str | None], min_chars: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Texts joined to blocks of bounded size: (code points, row, position in the text, start in the block) of the
    parts. A text longer than a block is cut so that each stretch of `min_chars` lies in exactly one part."""
    parts: list[np.ndarray] = []
    rows: list[int] = []
    at: list[int] = []
    size = 0

    def flush() -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        starts = np.cumsum([0, *map(len, parts)])
        return np.concatenate(parts), np.array(rows), np.array(at), starts

    for row, text in enumerate(texts):
        if text is None or len(text) < min_chars:
            continue
        points = codes(text)
        for begin in range(0, len(points) - min_chars + 1, BLOCK - min_chars + 1):
            part = points[begin : begin + BLOCK]
            if size and size + len(part) > BLOCK:
                yield flush()
                parts, rows, at, size = [], [], [], 0
            parts.append(part)
            rows.append(row)
            at.append(begin)
            size += len(part)
    if parts:
        yield flush()


def cartesian(nodes: np.ndarray, values: np.ndarray, first: int, last: int) -> tuple[np.ndarray, np.ndarray]:
    """(l, r) of each node (position) of the Cartesian tree over first..last: as far as no lesser value stands.

    The nodes must be the top of the tree: whatever bounds one of them is among them."""
    low, high = [first] * len(nodes), [last] * len(nodes)
    at, value = nodes.tolist(), values.tolist()
    open_: list[int] = []
    for i, v in enumerate(value):
        while open_ and value[open_[-1]] > v:
            high[open_.pop()] = at[i] - 1
        if open_:
            low[i] = at[open_[-1]] + 1
        open_.append(i)
    return np.array(low, dtype=np.int64), np.array(high, dtype=np.int64)


def compact_windows(tokens: np.ndarray, starts: np.ndarray, lengths: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(l, c, r) of the compact windows of at least `width` tokens of each part; part k has tokens[starts[k] : starts[k] + lengths[k]]."""
    packed = (tokens & ~_PLACE) | np.arange(len(tokens), dtype=np.uint64)
    least = sliding_min(packed, width)
    found: list[tuple[np.ndarray, ...]] = []
    for s, n in zip(starts.tolist(), lengths.tolist()):
        top = least[s : s + n - width + 1]
        top = top[np.flatnonzero(np.diff(top, prepend=~top[:1]))]
        nodes = (top & _PLACE).astype(np.int64)
        low, high = cartesian(nodes, top, s, s + n - 1)
        found.append((low, nodes, high))
    return tuple(np.concatenate(x) for x in zip(*found))


def segments(texts: list[str | None], min_chars: int = MIN_CHARS, gram: int = GRAM, hashes: int = HASHES) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(row, first, last, signature): the stretches of `min_chars` characters that begin at first..last have equal signatures in every function."""
    found: list[tuple[np.ndarray, ...]] = []
    width = min_chars - gram + 1
    for points, rows, at, starts in blocks(texts, min_chars):
        grams = gram_hashes(points, gram)
        lengths = np.diff(starts) - gram + 1
        edges, owners = [], []
        for k in range(hashes):
            tokens = mix(grams ^ np.uint64(k * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF)) if k else grams
            low, node, _ = compact_windows(tokens, starts[:-1], lengths, width)
            edges.append(np.maximum(low, node - width + 1))  # first beginning of a stretch whose least token is the node
            owners.append(tokens[node])
        first = np.unique(np.concatenate(edges))
        signature = np.zeros(len(first), dtype=np.uint64)
        for edge, owner in zip(edges, owners):  # the interval join: the window of each function that holds the beginning
            signature = mix(signature * np.uint64(0x100000001B3) + owner[np.searchsorted(edge, first, side="right") - 1])
        part = np.searchsorted(starts, first, side="right") - 1
        last = np.append(first[1:], 0) - 1
        ends = np.append(part[1:] != part[:-1], True)
        last[ends] = starts[part[ends] + 1] - min_chars
        shift = at[part] - starts[part]
        found.append((rows[part], first + shift, last + shift, signature.view(np.int64)))
    if not found:
        return tuple(np.empty(0, dtype=np.int64) for _ in range(4))
    return tuple(np.concatenate(x) for x in zip(*found))


def _segments(documents: DataFrame, min_chars: int, gram: int, hashes: int) -> DataFrame:
    """(doc_id, version, sig, first, last) of documents (doc_id, version, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            row, first, last, sig = segments(batch.column(2).to_pylist(), min_chars, gram, hashes)
            take = pa.array(row)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(take), batch.column(1).take(take), pa.array(sig), pa.array(first.astype(np.int32)), pa.array(last.astype(np.int32))], names=["doc_id", "version", "sig", "first", "last"])

    return documents.mapInArrow(run, "doc_id long, version long, sig long, first int, last int")


def _contexts(rows: DataFrame, min_chars: int) -> DataFrame:
    """(sig, doc_id, base, ctx, hot): the characters of the segments listed with each text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(2)
            row = np.repeat(np.arange(batch.num_rows), np.diff(lists.offsets.to_numpy()))
            if not len(row):
                continue
            part = lists.flatten()
            texts = batch.column(1).to_pylist()
            first, last = part.field("first"), part.field("last")
            ctx = [texts[r][a : b + min_chars] for r, a, b in zip(row.tolist(), first.to_pylist(), last.to_pylist())]
            yield pa.RecordBatch.from_arrays([part.field("sig"), batch.column(0).take(pa.array(row)), first, pa.array(ctx, pa.string()), part.field("hot")], names=["sig", "doc_id", "base", "ctx", "hot"])

    return rows.mapInArrow(run, "sig long, doc_id long, base int, ctx string, hot boolean")


def shared_stretches(doc: np.ndarray, base: np.ndarray, ctx: list[str], min_chars: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(doc, start, end) of the stretches of each context that also stand in a context of another document."""
    found: list[tuple[int, int, int]] = []
    sizes = np.array([len(c) for c in ctx]) - min_chars + 1
    hashes = np.empty(int(sizes.sum()), dtype=np.uint64)
    done, group, held = 0, [], 0
    for i, c in enumerate([*ctx, None]):
        if c is None or held + len(c) > BLOCK:
            points = codes("".join(group))
            low = gram_hashes(points, min_chars)
            begin = 0
            for g in group:
                n = len(g) - min_chars + 1
                hashes[done : done + n] = low[begin : begin + n]
                done, begin = done + n, begin + len(g)
            group, held = [], 0
        if c is not None:
            group.append(c)
            held += len(c)
    owner = np.repeat(np.arange(len(ctx)), sizes)
    offset = np.arange(len(owner)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    order = np.lexsort((doc[owner], hashes))
    sorted_hash, sorted_doc = hashes[order], doc[owner[order]]
    head = np.ones(len(order), dtype=bool)
    head[1:] = sorted_hash[1:] != sorted_hash[:-1]
    heads = np.flatnonzero(head)
    tails = np.append(heads[1:], len(order)) - 1
    run = np.cumsum(head) - 1
    partner = np.where(sorted_doc == sorted_doc[heads][run], order[tails][run], order[heads][run])
    differs = doc[owner[partner]] != sorted_doc
    other = np.full(len(order), -1, dtype=np.int64)
    other[order[differs]] = partner[differs]
    hit = np.flatnonzero(other >= 0)
    if not len(hit):
        return doc[:0], base[:0], base[:0]
    mate = other[hit]
    cut = np.ones(len(hit), dtype=bool)  # a run: neighbouring stretches of one context against neighbouring ones of another
    cut[1:] = (np.diff(hit) != 1) | (np.diff(mate) != 1) | (owner[hit][1:] != owner[hit][:-1]) | (owner[mate][1:] != owner[mate][:-1])
    firsts = np.flatnonzero(cut)
    lengths = np.diff(np.append(firsts, len(hit)))
    for k, n in zip(firsts.tolist(), lengths.tolist()):
        i, j, a, b = owner[hit[k]], owner[mate[k]], int(offset[hit[k]]), int(offset[mate[k]])
        if ctx[i][a : a + n - 1 + min_chars] == ctx[j][b : b + n - 1 + min_chars]:
            found.append((doc[i], base[i] + a, base[i] + a + n - 1 + min_chars))
        else:  # two different stretches of one hash: look at every other context
            for a in range(a, a + n):
                piece = ctx[i][a : a + min_chars]
                if any(piece in c for c, d in zip(ctx, doc) if d != doc[i]):
                    found.append((doc[i], base[i] + a, base[i] + a + min_chars))
    out = np.array(found, dtype=np.int64).reshape(-1, 3)
    return out[:, 0], out[:, 1], out[:, 2]


def _cold(rows: DataFrame, min_chars: int) -> DataFrame:
    """Spans of the contexts, a signature's rows standing together in one partition; a batch takes whole signatures."""

    def emit(part: pa.Table) -> pa.RecordBatch:
        doc, start, end = shared_stretches(part["doc_id"].to_numpy(), part["base"].to_numpy(), part["ctx"].to_pylist(), min_chars)
        return pa.RecordBatch.from_arrays([pa.array(doc.astype(np.int64)), pa.array(start.astype(np.int32)), pa.array(end.astype(np.int32))], names=["doc_id", "span_start", "span_end"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.Table] = []
        for batch in batches:
            here = pa.Table.from_batches([batch])
            if not here.num_rows:
                continue
            sig = here["sig"].to_numpy()
            tail = int(np.searchsorted(sig != sig[-1], False)) if sig[0] == sig[-1] else int(np.flatnonzero(sig != sig[-1])[-1]) + 1
            if held and held[0]["sig"][0].as_py() != int(sig[-1]):
                yield emit(pa.concat_tables([*held, here.slice(0, tail)]))
                held = []
            elif not held and tail:
                yield emit(here.slice(0, tail))
            held.append(here.slice(tail))
        if held:
            yield emit(pa.concat_tables(held))

    return rows.repartition("sig").sortWithinPartitions("sig").mapInArrow(run, "doc_id long, span_start int, span_end int")


def _hot(rows: DataFrame, min_chars: int, bits: int) -> DataFrame:
    """Spans of segments (doc_id, base, ctx) whose signature is frequent. `bits` of each half of the hash are looked at."""
    same = rows.groupBy("ctx").agg(F.min(F.struct("doc_id", "base")).alias("one"), F.max("doc_id").alias("hi"))
    same = checkpoint(same.select("ctx", F.col("one.doc_id").alias("rep"), F.col("one.base").alias("at"), (F.col("hi") != F.col("one.doc_id")).alias("several")))
    placed = rows.join(same, "ctx")
    whole = placed.where("several").select("doc_id", F.col("base").alias("span_start"), (F.col("base") + F.length("ctx")).alias("span_end"))
    keep = np.uint64((1 << bits) - 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for doc, base, ctx in zip(*(batch.column(i).to_pylist() for i in range(3))):
                for begin in range(0, len(ctx) - min_chars + 1, BLOCK - min_chars + 1):
                    points = codes(ctx[begin : begin + BLOCK])
                    one, two = gram_hashes(points, min_chars) & keep, gram_hashes(points, min_chars, _SECOND_BASE) & keep
                    at = np.arange(len(one), dtype=np.int32) + np.int32(base + begin)
                    yield pa.RecordBatch.from_arrays([pa.array(one.view(np.int64)), pa.array(two.view(np.int64)), pa.array(np.full(len(one), doc)), pa.array(at), pa.array(np.full(len(one), base, dtype=np.int32))], names=["h1", "h2", "rep", "start", "at"])

    stretches = same.select("rep", "at", "ctx").mapInArrow(run, "h1 long, h2 long, rep long, start int, at int")
    place = F.struct("rep", "start", "at")
    mates = stretches.groupBy("h1", "h2").agg(F.min(place).alias("lo"), F.max(place).alias("hi")).where("lo.rep <> hi.rep")
    mate = F.when(F.col("lo.rep") != F.col("rep"), F.col("lo")).otherwise(F.col("hi"))
    met = stretches.join(mates, ["h1", "h2"]).select("rep", "at", "start", mate["rep"].alias("mate"), mate["at"].alias("mate_at"), (mate["start"] - F.col("start")).alias("shift"))
    line = ["rep", "at", "mate", "mate_at", "shift"]
    number = F.row_number().over(W.partitionBy(*line).orderBy("start"))
    runs = met.withColumn("run", F.col("start") - number).groupBy(*line, "run").agg(F.min("start").alias("a"), (F.max("start") + min_chars).alias("b"))
    piece = lambda at, shift: F.substring("ctx", F.col("a") + shift - F.col(at) + 1, F.col("b") - F.col("a"))
    mine = runs.join(same.select("rep", "at", "ctx"), ["rep", "at"]).withColumn("mine", piece("at", F.lit(0))).drop("ctx")
    others = same.select(F.col("rep").alias("mate"), F.col("at").alias("mate_at"), "ctx")
    compared = checkpoint(mine.join(others, ["mate", "mate_at"]).select("rep", "at", "a", "b", (F.col("mine") == piece("mate_at", F.col("shift"))).alias("equal")))
    good = compared.where("equal").select("rep", "at", "a", "b")
    if not compared.where("not equal").isEmpty():  # two different stretches of one hash: every stretch is grouped by its characters
        each = same.select("rep", "at", "ctx", F.explode(F.sequence(F.lit(0), F.length("ctx") - min_chars)).alias("k"))
        each = each.select("rep", "at", (F.col("at") + F.col("k")).alias("a"), F.substring("ctx", F.col("k") + 1, F.lit(min_chars)).alias("piece"))
        twice = each.groupBy("piece").agg(F.min("rep").alias("lo"), F.max("rep").alias("hi")).where("lo <> hi").select("piece")
        good = each.join(twice, "piece").select("rep", "at", "a", (F.col("a") + min_chars).alias("b"))
    shift = F.col("base") - F.col("at")
    found = placed.where("not several").join(good, ["rep", "at"]).select("doc_id", (F.col("a") + shift).alias("span_start"), (F.col("b") + shift).alias("span_end"))
    return whole.unionByName(found)


def merge_spans(spans: DataFrame) -> DataFrame:
    """Overlapping and touching spans of a document joined to maximal ones."""
    order = W.partitionBy("doc_id").orderBy("span_start", "span_end")
    before = F.max("span_end").over(order.rowsBetween(W.unboundedPreceding, -1))
    return (
        spans.groupBy("doc_id", "span_start").agg(F.max("span_end").alias("span_end"))
        .withColumn("new", F.when(F.col("span_start") <= before, 0).otherwise(1))
        .withColumn("run", F.sum("new").over(order.rowsBetween(W.unboundedPreceding, 0)))
        .groupBy("doc_id", "run").agg(F.min("span_start").alias("span_start"), F.max("span_end").alias("span_end"))
        .select("doc_id", F.col("span_start").cast("int"), F.col("span_end").cast("int"))
    )


def shared_spans(documents: DataFrame, min_chars: int = MIN_CHARS, gram: int = GRAM, hot: int = HOT, hashes: int = HASHES, bits: int = 64) -> DataFrame:
    """(doc_id, span_start, span_end): the maximal runs of characters shared with another document."""
    docs = documents.where(F.col("doc_id").isNotNull() & (F.length("text") >= min_chars)).select(F.col("doc_id").cast("long"), F.xxhash64("text").alias("version"), "text")
    found = checkpoint(_segments(docs, min_chars, gram, hashes))
    shared = found.groupBy("sig").agg(F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi"), F.count("*").alias("n")).where("lo <> hi").select("sig", (F.col("n") > hot).alias("hot"))
    lists = found.join(shared, "sig").groupBy("doc_id", "version").agg(F.collect_set(F.struct("sig", "first", "last", "hot")).alias("parts"))
    contexts = checkpoint(_contexts(docs.join(lists, ["doc_id", "version"]).select("doc_id", "text", "parts"), min_chars))
    spans = _cold(contexts.where("not hot").select("sig", "doc_id", "base", "ctx"), min_chars)
    frequent = contexts.where("hot").select("doc_id", "base", "ctx")
    if not frequent.isEmpty():
        spans = spans.unionByName(_hot(frequent, min_chars, bits))
    return merge_spans(spans)


def shared_share(documents: DataFrame, **how: int) -> DataFrame:
    """(doc_id, n_chars, shared_chars, shared_share) of every document; the share of an empty or null text is 0."""
    covered = shared_spans(documents, **how).groupBy("doc_id").agg(F.sum(F.col("span_end") - F.col("span_start")).alias("c"))
    sizes = documents.where("doc_id is not null").select(F.col("doc_id").cast("long"), F.coalesce(F.length("text"), F.lit(0)).cast("long").alias("n_chars"))
    shared = F.coalesce("c", F.lit(0)).cast("long")
    return sizes.join(covered, "doc_id", "left").select("doc_id", "n_chars", shared.alias("shared_chars"), (shared / F.greatest("n_chars", F.lit(1))).alias("shared_share"))
