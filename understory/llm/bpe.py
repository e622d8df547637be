"""Byte-level BPE encoding of whole texts with a hierarchical-bitmap rank queue.

A pre-token is a linked list of byte symbols. Every rank has a bucket of list positions at which a pair of
that rank starts; a three-level bitmap tells which buckets are filled, and find-first-set picks the lowest
rank. A bucket is worked off from left to right; an entry whose pair has changed since is stale and skipped.
A merge touches two neighbours, so a pre-token of n bytes takes O(n) queue steps whatever its length.

The vocabulary file is read once on the driver and broadcast (about 50,000 entries, fixed). A null or empty
text has no ids. Strings that look like special tokens are ordinary text. Repeated rows give a row each.
"""

from __future__ import annotations

import base64
import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: How texts are cut into pre-tokens; belongs to the vocabulary.
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Pre-tokens of up to this many characters are remembered, up to this many of them per worker.
CACHED_LENGTH, CACHED_ENTRIES = 48, 400_000
#: Bits per bitmap word; three levels reach 2**18 ranks.
WORD = 6


def read_vocabulary(path: str = VOCABULARY) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


class RankQueue:
    """Buckets per rank under a hierarchical bitmap."""

    def __init__(self, ranks: int) -> None:
        if ranks > 1 << 3 * WORD:
            raise ValueError(f"at most {1 << 3 * WORD} ranks")
        self.low = [0] * ((ranks >> WORD) + 1)
        self.mid = [0] * ((ranks >> 2 * WORD) + 1)
        self.top = 0
        self.bucket: dict[int, list[int]] = {}

    def push(self, rank: int, at: int) -> None:
        if (b := self.bucket.get(rank)) is not None:
            b.append(at)
            return
        self.bucket[rank] = [at]
        i, j = rank >> WORD, rank >> 2 * WORD
        self.low[i] |= 1 << (rank & 63)
        self.mid[j] |= 1 << (i & 63)
        self.top |= 1 << j

    def pop(self) -> tuple[int, list[int]] | None:
        """The lowest rank and its positions from left to right."""
        if not self.top:
            return None
        j = (self.top & -self.top).bit_length() - 1
        m = self.mid[j]
        i = (j << WORD) + (m & -m).bit_length() - 1
        w = self.low[i]
        rank = (i << WORD) + (w & -w).bit_length() - 1
        self.low[i] = w = w & (w - 1)
        if not w:
            self.mid[j] = m = m & (m - 1)
            if not m:
                self.top &= self.top - 1
        at = self.bucket.pop(rank)
        at.sort()
        return rank, at


class Encoder:
    def __init__(self, ranks: dict[bytes, int]) -> None:
        self.ranks = ranks
        self.queue = RankQueue(max(ranks.values()) + 1)
        self.find = regex.compile(PATTERN).findall
        self.cache: dict[str, tuple[int, ...]] = {}

    def merge(self, piece: bytes) -> list[int]:
        """The ids of a pre-token."""
        n, rank_of, push = len(piece), self.ranks.get, self.queue.push
        if n == 1:
            return [self.ranks[piece]]
        end = list(range(1, n + 1))  # end of the symbol that starts at i; its successor starts there
        before = list(range(-1, n))
        pair = [-1] * n  # rank of the pair that starts at i, -1 if there is none or i is no start
        for i in range(n - 1):
            if (r := rank_of(piece[i : i + 2])) is not None:
                pair[i] = r
                push(r, i)
        while (got := self.queue.pop()) is not None:
            rank, places = got
            for i in places:
                if pair[i] != rank:
                    continue  # stale
                j = end[i]
                k = end[i] = end[j]
                pair[j] = pair[i] = -1
                if k < n:
                    before[k] = i
                    if (r := rank_of(piece[i : end[k]])) is not None:
                        pair[i] = r
                        push(r, i)
                if (h := before[i]) >= 0:
                    r = rank_of(piece[h:k])
                    if r is None:
                        pair[h] = -1
                    else:
                        pair[h] = r
                        push(r, h)
        out, i = [], 0
        while i < n:
            out.append(self.ranks[piece[i : end[i]]])
            i = end[i]
        return out

    def encode(self, text: str | None) -> list[int]:
        if not text:
            return []
        out: list[int] = []
        cache, extend = self.cache, out.extend
        for token in self.find(text):
            ids = cache.get(token)
            if ids is None:
                ids = tuple(self.merge(token.encode("utf-8")))
                if len(token) <= CACHED_LENGTH:
                    if len(cache) >= CACHED_ENTRIES:
                        cache.clear()
                    cache[token] = ids
            extend(ids)
        return out


def _encoder(vocabulary) -> Encoder:
    """One encoder per worker process, kept from task to task."""
    kept = sys.__dict__.setdefault("_understory_encoders", {})
    if vocabulary.id not in kept:
        kept[vocabulary.id] = Encoder(vocabulary.value)
    return kept[vocabulary.id]


class _Shipped:
    def __init__(self, broadcast) -> None:
        self.broadcast, self.id = broadcast, broadcast._jbroadcast.id()

    def __getstate__(self):
        return {"broadcast": self.broadcast, "id": self.id}

    @property
    def value(self):
        return self.broadcast.value


def encode_documents(documents: DataFrame, path: str = VOCABULARY) -> DataFrame:
    """(doc_id, ids) of every row."""
    shipped = _Shipped(documents.sparkSession.sparkContext.broadcast(read_vocabulary(path)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(shipped)
        for b in batches:
            ids = [encoder.encode(x.as_py()) for x in b.column(1)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(ids, pa.list_(pa.int32()))], ["doc_id", "ids"])

    return documents.select("doc_id", "text").mapInArrow(run, "doc_id long, ids array<int>")


def count_tokens(documents: DataFrame, path: str = VOCABULARY) -> DataFrame:
    """(doc_id, n_tokens) of every row, without moving the ids."""
    shipped = _Shipped(documents.sparkSession.sparkContext.broadcast(read_vocabulary(path)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(shipped)
        for b in batches:
            n = np.fromiter((len(encoder.encode(x.as_py())) for x in b.column(1)), np.int64, b.num_rows)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n)], ["doc_id", "n_tokens"])

    return documents.select("doc_id", "text").mapInArrow(run, "doc_id long, n_tokens long")


def vocabulary_path(spark) -> str:
    """The vocabulary file: the session's ``spark.understory.vocabulary``, else the usual place."""
    return spark.conf.get("spark.understory.vocabulary", VOCABULARY)


def round_trips(documents: DataFrame, path: str = VOCABULARY) -> DataFrame:
    """(doc_id, same): whether the bytes of the ids of a text are those of the text."""
    shipped = _Shipped(documents.sparkSession.sparkContext.broadcast(read_vocabulary(path)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = {i: w for w, i in shipped.value.items()}
        for b in batches:
            same = [b"".join(map(words.__getitem__, ids)) == (text or "").encode("utf-8") for ids, text in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(same, pa.bool_())], ["doc_id", "same"])

    return encode_with_text(documents, path).mapInArrow(run, "doc_id long, same boolean")


def encode_with_text(documents: DataFrame, path: str = VOCABULARY) -> DataFrame:
    """(doc_id, ids, text) of every row."""
    shipped = _Shipped(documents.sparkSession.sparkContext.broadcast(read_vocabulary(path)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(shipped)
        for b in batches:
            ids = [encoder.encode(x.as_py()) for x in b.column(1)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(ids, pa.list_(pa.int32())), b.column(1)], ["doc_id", "ids", "text"])

    return documents.select("doc_id", "text").mapInArrow(run, "doc_id long, ids array<int>, text string")
