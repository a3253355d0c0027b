"""Problem 7: mixing sources to target weights.

Method: a multivariate-hypergeometric splitting tree. The records of a source are dealt to blocks by a hash, as many
blocks as make about 1 / `GRAIN` of an output shard each. A source is used in whole passes and one partial pass; each
pass takes the blocks in a permuted order of its own, and the last block of the partial pass is cut at a record. The
blocks so used are dealt to output shards: a node of the tree halves its shards and draws how many blocks of each source
go left from the multivariate hypergeometric distribution, which is what one random permutation of all blocks would
give. Every shard walks from the root to its leaf on an executor, the draws of a node being fixed by its place, and
gets the exact quota of each source as a stretch of that source's order. Inside a shard records stand in hashed order.

Quotas: the mix is as large as `total`, by default as all usable records together, so it grows with the collection. A
source that cannot give its share of that within `max_repeats` gives all it can, and the others keep their proportions
and fill up the rest; `shares` reports what each source fell short of. With `exact` the total is lowered until every
source with tokens reaches its share.

What reaches the driver are one row of sums a source and the place of its cut. Positions are computed, not listed:
the permutation of 2**k blocks is a chain of invertible steps on k bits.

Defined cases: records with a null id, a source that is null or not among the targets, or no tokens are not used; of
rows repeated with the same id one is used; of targets repeated for a source the largest share counts; sources with a share but without tokens give nothing, and the shares of
the others grow in proportion; empty tables give an empty mix. The same seed gives the same mix.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from textloom.llm.encode import DEFAULT_VOCABULARY, count_tokens
from textloom.session import checkpoint, small

#: Tokens of an output shard of a large mix, and the shards of a small one.
SHARD_TOKENS, MIN_SHARDS = 20_000_000, 8
#: Blocks a shard is put together from, about.
GRAIN = 64
#: Blocks whose tokens are added up in one step when the cut of a partial pass is looked for.
STRETCH = 4096
#: Rows of the table of shards' stretches up to which it is broadcast.
BROADCAST_ROWS = 200_000


@dataclass
class Source:
    """A source of the mix: its quota of tokens, whole passes, tokens of the partial pass, and the bits of its block numbers."""

    name: str
    tokens: int
    quota: int
    bits: int

    @property
    def passes(self) -> int:
        return self.quota // self.tokens

    @property
    def rest(self) -> int:
        return self.quota % self.tokens


def quotas(tokens: dict[str, int], targets: dict[str, tuple[float, int]], total: int | None = None, exact: bool = False) -> dict[str, int]:
    """Tokens each source gives: its share of the total, but at most its tokens times max_repeats; what capped sources leave
    goes to the others in proportion to their shares."""
    names = sorted(s for s, (share, most) in targets.items() if share > 0 and most > 0 and tokens.get(s, 0) > 0)
    if not names:
        return {}
    share = np.array([targets[s][0] for s in names])
    most = np.array([targets[s][1] * tokens[s] for s in names], dtype=np.float64)
    wanted = float(sum(tokens.get(s, 0) for s in targets) if total is None else total)
    if exact:
        wanted = min(wanted, float((most * share.sum() / share).min()))
    order = np.argsort(most / share, kind="stable")  # who is capped first as the level rises
    left, weight, level = wanted, share.sum(), 0.0
    for k in order:
        level = left / weight
        if most[k] / share[k] > level:
            break
        left, weight = left - most[k], weight - share[k]
        level = np.inf
    return {s: int(min(m, level * w + 1e-6)) for s, m, w in zip(names, most, share)}


def leaf(counts: np.ndarray, shards: int, shard: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """(first, end) of the shard's stretch in each source's order: one path of the splitting tree from the root to its leaf."""
    q, first = counts.astype(np.int64), np.zeros(len(counts), dtype=np.int64)
    total, lo, hi = int(q.sum()), 0, shards
    edge = lambda i: total * i // shards
    while hi - lo > 1:
        mid = (lo + hi) // 2
        rng = np.random.default_rng([seed, lo, hi])
        left = rng.multivariate_hypergeometric(q, edge(mid) - edge(lo), method="marginals")
        if shard < mid:
            q, hi = left, mid
        else:
            first, q, lo = first + left, q - left, mid
    return first, first + q


def permuted(block: Column, size: Column, key: Column) -> Column:
    """Place of a block in the order `key` stands for: a bijection of the numbers below `size`, a power of 2."""
    step = F.pow(F.lit(2.0), F.floor(F.log2(size) / 2) + 1)
    x = block.cast("long")
    for k in range(3):
        salt = F.xxhash64(key, F.lit(k))
        odd = F.pmod(F.shiftrightunsigned(salt, 20), F.lit(1 << 29)) * 2 + 1
        x = F.pmod(x * odd + F.pmod(salt, size), size)
        x = x.bitwiseXOR(F.floor(x / step))
    return x


def _records(documents: DataFrame, vocabulary: str, seed: int) -> DataFrame:
    """(doc_id, source, n_tokens, key) of the usable records, kept in the shared folder."""
    docs = documents.where("doc_id is not null and source is not null").select(F.col("doc_id").cast("long"), "source", "text")
    counted = count_tokens(docs, ["doc_id", "source"], "text", vocabulary).where("n_tokens > 0").dropDuplicates(["doc_id"])
    return checkpoint(counted.withColumn("key", F.xxhash64(F.lit(seed), "doc_id")))


def _sources(records: DataFrame, targets: DataFrame, total: int | None, shards: int | None, exact: bool) -> tuple[list[Source], int]:
    """The sources that give something, and the number of shards. One row a source of the targets comes to the driver."""
    wanted = targets.where("source is not null and target_share is not null").groupBy("source").agg(F.max("target_share").cast("double").alias("share"), F.max(F.coalesce("max_repeats", F.lit(1))).alias("most"))
    rows = wanted.join(records.groupBy("source").agg(F.sum("n_tokens").alias("tokens")), "source").collect()
    tokens = {r["source"]: r["tokens"] for r in rows}
    made = {s: q for s, q in quotas(tokens, {r["source"]: (r["share"], r["most"]) for r in rows}, total, exact).items() if q > 0}
    used = sum(made.values())
    n = shards or max(MIN_SHARDS, used // SHARD_TOKENS)
    block = max(1, used // (n * GRAIN))
    return [Source(s, tokens[s], q, max(0, tokens[s] // block).bit_length()) for s, q in sorted(made.items())], n


def _partial(records: DataFrame) -> DataFrame:
    """(source, place, take): where the partial pass of each source is cut, and the tokens taken from that block.

    Tokens are summed by block, then by stretches of places, so that no task adds up a source record by record."""
    blocks = records.where("rest > 0").groupBy("source", "rest", F.col("last_place").alias("place")).agg(F.sum("n_tokens").alias("t"))
    blocks = blocks.withColumn("stretch", F.floor(F.col("place") / STRETCH))
    upto = lambda *by: W.partitionBy(*by).rowsBetween(W.unboundedPreceding, W.currentRow)
    coarse = blocks.groupBy("source", "stretch").agg(F.sum("t").alias("s")).withColumn("before", F.sum("s").over(upto("source").orderBy("stretch")) - F.col("s"))
    fine = blocks.join(coarse, ["source", "stretch"]).withColumn("end", F.col("before") + F.sum("t").over(upto("source", "stretch").orderBy("place")))
    return fine.where((F.col("end") >= F.col("rest")) & (F.col("end") - F.col("t") < F.col("rest"))).select("source", "place", (F.col("rest") - F.col("end") + F.col("t")).alias("take"))


def _stretches(counts: DataFrame, numbers: list[int], shards: int, seed: int) -> DataFrame:
    """(number, at, shard): the shard of each place of each source's order."""
    sizes = np.array(numbers, dtype=np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for shard in batch.column(0).to_pylist():
                first, end = leaf(sizes, shards, shard, seed)
                number = np.repeat(np.arange(len(sizes), dtype=np.int32), end - first)
                at = np.concatenate([np.arange(a, b) for a, b in zip(first, end)]) if len(sizes) else np.empty(0, dtype=np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(number), pa.array(at), pa.array(np.full(len(at), shard, dtype=np.int64))], names=["number", "at", "shard"])

    return counts.mapInArrow(run, "number int, at long, shard long")


def mix(documents: DataFrame, targets: DataFrame, total: int | None = None, shards: int | None = None, seed: int = 7, vocabulary: str = DEFAULT_VOCABULARY, exact: bool = False) -> DataFrame:
    """(shard, order_key, doc_id, source, pass, n_tokens): the uses of records, one row each; a shard is read in the order of order_key."""
    spark = documents.sparkSession
    records = _records(documents, vocabulary, seed)
    sources, n = _sources(records, targets, total, shards, exact)
    plan = [(i, s.name, 1 << s.bits, s.passes, s.rest) for i, s in enumerate(sources)]
    known = small(spark.createDataFrame(plan, "number int, source string, size long, passes int, rest long"), BROADCAST_ROWS)
    order = lambda p: F.xxhash64(F.lit(seed), "source", p)
    block = F.pmod("key", "size")
    named = records.join(known, "source").withColumn("block", block).withColumn("last_place", permuted(F.col("block"), F.col("size"), order(F.col("passes"))))
    cuts = checkpoint(_partial(named))
    cut_at = {r[0]: r[1] for r in cuts.select("source", "place").collect()}  # one row a source
    counts = [(s.passes << s.bits) + cut_at.get(s.name, -1) + 1 for s in sources]
    cuts = small(cuts.select("source", F.col("place").alias("cut"), "take"), BROADCAST_ROWS)
    with_cut = named.join(cuts, "source", "left")
    whole = with_cut.select("number", "source", "doc_id", "n_tokens", "key", "size", "block", "passes", "last_place", "cut", F.explode(F.sequence(F.lit(0), "passes")).alias("pass"))
    whole = whole.where((F.col("pass") < F.col("passes")) | (F.col("last_place") < F.col("cut")))
    upto = W.partitionBy("source").orderBy("key", "doc_id").rowsBetween(W.unboundedPreceding, W.currentRow)
    last = with_cut.where(F.col("last_place") == F.col("cut")).withColumn("upto", F.sum("n_tokens").over(upto)).where(F.col("upto") - F.col("n_tokens") / 2 <= F.col("take")).withColumn("pass", F.col("passes"))
    columns = ["number", "source", "doc_id", "n_tokens", "key", "size", "block", "pass"]
    uses = whole.select(*columns).unionByName(last.select(*columns))
    uses = uses.withColumn("at", F.col("pass") * F.col("size") + permuted(F.col("block"), F.col("size"), order(F.col("pass"))))
    slots = _stretches(spark.range(0, n, 1, min(n, 200)), counts, n, seed)
    slots = F.broadcast(slots) if sum(counts) <= BROADCAST_ROWS else slots
    placed = uses.join(slots, ["number", "at"]).select("shard", F.xxhash64("key", "pass").alias("order_key"), "doc_id", "source", "pass", "n_tokens")
    return placed.repartition("shard").sortWithinPartitions("shard", "order_key")


def shares(documents: DataFrame, targets: DataFrame, **how: int) -> DataFrame:
    """(source, target_share, max_repeats, actual_share, used_tokens, uses, records, most_uses, short_tokens) of every source of the
    targets; short_tokens is what it would have to give more to have its share of the whole mix."""
    uses = mix(documents, targets, **how)
    per = uses.groupBy("source", "doc_id").agg(F.sum("n_tokens").alias("t"), F.count("*").alias("c")).groupBy("source").agg(
        F.sum("t").alias("used_tokens"), F.sum("c").alias("uses"), F.count("*").alias("records"), F.max("c").alias("most_uses")
    )
    zero = {"used_tokens": 0, "uses": 0, "records": 0, "most_uses": 0}
    joined = targets.select("source", "target_share", "max_repeats").join(per, "source", "left").fillna(zero, list(zero))
    every = W.partitionBy(F.lit(1))  # as many rows as sources
    total, whole = F.sum("used_tokens").over(every), F.sum("target_share").over(every)
    short = F.coalesce(F.col("target_share") / F.nullif(whole, F.lit(0.0)) * total - F.col("used_tokens"), F.lit(0.0))
    return joined.withColumn("actual_share", F.coalesce(F.col("used_tokens") / F.nullif(total, F.lit(0)), F.lit(0.0))).withColumn("short_tokens", F.greatest(F.round(short).cast("long"), F.lit(0).cast("long")))
