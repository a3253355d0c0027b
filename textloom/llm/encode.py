"""Problem 6: encoding a whole corpus with a public byte-level BPE vocabulary.

Method: prefix-sharing trie traversal. The pieces of a batch that are new to the worker are sorted, which lists
the leaves of their trie depth first; the state of a trie node is the last token of the encoding of its prefix.
Going from one word to the next, the states of the shared prefix stay on the stack and only new nodes are
computed, so a prefix common to many words is encoded once.

Why one token a node is enough: a sequence of tokens is the BPE encoding of its bytes exactly if every two
neighbours are, on their own, encoded as those two tokens. So the encoding of a prefix ends with the one token
that fits the last token of the prefix before it, and whole encodings are read backwards along these tokens.

Empty and null texts give an empty list. Strings that look like special tokens are ordinary text.
"""

from __future__ import annotations

import base64
import json
import os
from collections.abc import Iterator
from itertools import chain
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark import SparkFiles
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: The published split pattern of the vocabulary.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
DEFAULT_VOCABULARY = "/opt/tokenizers/byte_bpe_50k.json"
#: Pieces a worker remembers; when full it forgets them all, which changes the speed and never a result.
MEMO_PIECES = 1_000_000
#: Longer pieces are forgotten after their batch.
MEMO_PIECE_CHARS = 64
#: Pairs of tokens a worker remembers, likewise.
MEMO_PAIRS = 1_000_000


def _byte_of_char() -> dict[str, int]:
    """The vocabulary file writes bytes as printable characters: those printable in Latin-1 stand for themselves, the others follow from U+0100 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class TrieBpe:
    """A byte-level BPE encoder over sorted distinct words."""

    def __init__(self, vocabulary: str = DEFAULT_VOCABULARY):
        import regex

        if vocabulary.endswith(".json"):
            model = json.loads(Path(vocabulary).read_text(encoding="utf-8"))["model"]
            to_byte = _byte_of_char()
            raw = {piece: bytes(to_byte[c] for c in piece) for piece in model["vocab"] if all(c in to_byte for c in piece)}
            self.ids = {raw[piece]: i for piece, i in model["vocab"].items() if piece in raw}
            pairs = (m.split(" ") if isinstance(m, str) else m for m in model["merges"])
            order = [(self.ids[raw[a]], self.ids[raw[b]], self.ids[raw[a] + raw[b]]) for a, b in pairs]
        else:
            lines = Path(vocabulary).read_bytes().splitlines()
            self.ids = {base64.b64decode(a): int(b) for a, b in map(bytes.split, filter(None, lines))}
            order = self._merges_from_ranks()
        self.rank = {(a, b): r for r, (a, b, _) in enumerate(order)}
        self.made = {c: (r, a, b) for r, (a, b, c) in enumerate(order)}
        self.longest = [1] * 256  # of the tokens that end with each byte
        for token in self.ids:
            self.longest[token[-1]] = max(self.longest[token[-1]], len(token))
        self.fits_memo: dict[int, bool] = {}
        self.memo: dict[str, tuple[int, ...]] = {}
        self.long: list[str] = []
        self.split = regex.compile(PATTERN).findall

    def _merges_from_ranks(self) -> list[tuple[int, int, int]]:
        """A rank file lists tokens only; the pair that makes a token is what its bytes merge to just before it."""
        order = []
        for token, rank in sorted(self.ids.items(), key=lambda x: x[1]):
            if len(token) > 1:
                parts = [token[i : i + 1] for i in range(len(token))]
                while len(parts) > 2:
                    best = min(range(len(parts) - 1), key=lambda i: self.ids.get(parts[i] + parts[i + 1], rank))
                    parts[best : best + 2] = [parts[best] + parts[best + 1]]
                order.append((self.ids[parts[0]], self.ids[parts[1]], rank))
        return order

    def fits(self, left: int, right: int) -> bool:
        """Whether the bytes of both tokens, encoded together, give just these two tokens.

        No merge across the seam may come before the merges that built the tokens at the seam; the tokens are taken
        apart from the latest merge back, the seam pair being looked at in each state."""
        seam = left << 32 | right
        known = self.fits_memo.get(seam)
        if known is not None:
            return known
        a, b, limit, good = left, right, len(self.rank) + 1, True
        while True:
            if self.rank.get((a, b), limit) < limit:
                good = False
                break
            rank_a, rank_b = self.made.get(a, (-1,))[0], self.made.get(b, (-1,))[0]
            if rank_a < 0 and rank_b < 0:
                break
            if rank_a > rank_b:  # of equal merges the left one comes first, so the right one is undone first
                limit, a = rank_a, self.made[a][2]
            else:
                limit, b = rank_b + 1, self.made[b][1]
        if len(self.fits_memo) >= MEMO_PAIRS:
            self.fits_memo.clear()
        self.fits_memo[seam] = good
        return good

    def encode_sorted(self, words: list[bytes]) -> Iterator[tuple[int, ...]]:
        """Encodings of sorted distinct non-empty words; `last` and `start` are the trie path from the root."""
        ids, fits, longest = self.ids, self.fits, self.longest
        last: list[int] = [-1]
        start: list[int] = [0]
        before = b""
        for word in words:
            shared, most = 0, min(len(before), len(word))
            if before[:most] == word[:most]:
                shared = most
            else:
                while before[shared] == word[shared]:
                    shared += 1
            del last[shared + 1 :], start[shared + 1 :]
            for end in range(shared + 1, len(word) + 1):
                for begin in range(max(0, end - longest[word[end - 1]]), end):
                    token = ids.get(word[begin:end])
                    if token is not None and (begin == 0 or fits(last[begin], token)):
                        last.append(token)
                        start.append(begin)
                        break
                else:
                    raise ValueError("the vocabulary lacks a single byte")
            out, at = [], len(word)
            while at:
                out.append(last[at])
                at = start[at]
            before = word
            yield tuple(reversed(out))

    def learn(self, pieces: set[str]) -> None:
        if len(self.memo) + len(pieces) > MEMO_PIECES:
            self.memo.clear()
        new = sorted((p.encode("utf-8", "surrogatepass"), p) for p in pieces if p not in self.memo)
        self.long += [p for _, p in new if len(p) > MEMO_PIECE_CHARS]
        self.memo.update(zip((p for _, p in new), self.encode_sorted([b for b, _ in new])))

    def encode_batch(self, texts: list[str | None]) -> list[list[int]]:
        split = self.split
        pieces = [split(t) if t else () for t in texts]
        self.learn(set(chain.from_iterable(pieces)))
        get = self.memo.__getitem__
        out = [list(chain.from_iterable(map(get, p))) for p in pieces]
        for piece in self.long:
            self.memo.pop(piece, None)
        self.long.clear()
        return out

    def count_batch(self, texts: list[str | None]) -> np.ndarray:
        return np.fromiter(map(len, self.encode_batch(texts)), dtype=np.int64, count=len(texts))


_ENCODERS: dict[str, TrieBpe] = {}


def encoder(vocabulary: str = DEFAULT_VOCABULARY) -> TrieBpe:
    """One encoder a worker and vocabulary."""
    if vocabulary not in _ENCODERS:
        _ENCODERS[vocabulary] = TrieBpe(vocabulary)
    return _ENCODERS[vocabulary]


def _ship(spark: SparkSession, vocabulary: str) -> None:
    """Sends the vocabulary to the executors, once a context."""
    context = spark.sparkContext
    sent = getattr(context, "_textloom_vocabularies", set())
    if vocabulary not in sent:
        context.addFile(vocabulary)
        context._textloom_vocabularies = sent | {vocabulary}


def _received(vocabulary: str) -> str:
    return SparkFiles.get(os.path.basename(vocabulary))


def encode(documents: DataFrame, text: str = "text", key: str = "doc_id", vocabulary: str = DEFAULT_VOCABULARY) -> DataFrame:
    """(key, ids) of every row of `documents`, in one pass and without a shuffle.

    Null and empty texts give an empty list, repeated rows stay repeated, other columns are not read. The file of the
    vocabulary is sent to the executors."""
    _ship(documents.sparkSession, vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = encoder(_received(vocabulary))
        for batch in batches:
            lists = bpe.encode_batch(batch.column(1).to_pylist())
            sizes = np.fromiter(map(len, lists), dtype=np.int32, count=len(lists))
            flat = np.fromiter(chain.from_iterable(lists), dtype=np.int32, count=int(sizes.sum()))
            offsets = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat))], names=[key, "ids"])

    rows = documents.select(F.col(key), F.col(text))
    return rows.mapInArrow(run, T.StructType([rows.schema[key], T.StructField("ids", T.ArrayType(T.IntegerType()))]))


def count_tokens(documents: DataFrame, keep: list[str], text: str = "text", vocabulary: str = DEFAULT_VOCABULARY) -> DataFrame:
    """The columns `keep` and n_tokens (long, 0 for null and empty texts) of every row."""
    _ship(documents.sparkSession, vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = encoder(_received(vocabulary))
        for batch in batches:
            counts = pa.array(bpe.count_batch(batch.column(len(keep)).to_pylist()))
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], counts], names=[*keep, "n_tokens"])

    rows = documents.select(*keep, F.col(text).alias("__text"))
    fields = [rows.schema[c] for c in keep]
    return rows.mapInArrow(run, T.StructType([*fields, T.StructField("n_tokens", T.LongType())]))
