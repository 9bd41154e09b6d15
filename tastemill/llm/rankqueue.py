"""Byte-level BPE encoding and decoding with a hierarchical-bitmap queue of merge ranks.

Every adjacent pair that some merge joins waits in the bucket of that merge's rank. A bitmap with
a summary level says which buckets hold something, so the next rank is two find-first-set steps
away. Bytes form a linked list; a merge relinks two neighbours, files the two new pairs and leaves
the old entries in their buckets, where they are skipped once reached. A bucket is worked off from
left to right, unless a merge brings up a lower rank. The cost follows the number
of merges, so a pre-token of megabytes is as cheap a byte as a word. Many pre-tokens share one
queue: lists end at each pre-token, so the lowest rank of all is the lowest of its own pre-token.
"""

from __future__ import annotations

import base64
import re
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tastemill.llm.cutting import ASCII_SPLIT, SPLIT
from tastemill.llm.shared import ready
from tastemill.llm.words import tidy

CACHE_BYTES = 24 << 20  # of pre-tokens met lately, and as many of those before
ENTRY_BYTES = 200  # of an entry besides its characters and ids
QUEUED_BYTES = 1 << 14
WORD_BITS = 256


class Merges:
    """Ranks of a vocabulary file: one line a token, base64 and rank."""

    def __init__(self, path: str):
        with open(path, "rb") as f:
            self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f) if a}
        ranks = self.ranks
        self.size = max(ranks.values(), default=0) + 1
        self.single = [ranks[bytes([b])] for b in range(256)]
        # the rank of joining two tokens is the rank of their bytes
        self.pairs = {}
        for whole, rank in ranks.items():
            for cut in range(1, len(whole)):
                left, right = ranks.get(whole[:cut]), ranks.get(whole[cut:])
                if left is not None and right is not None:
                    self.pairs[left << 32 | right] = rank
        self.first = np.array(self.single, np.int64)
        # ranks of pairs of bytes; the size stands for none
        self.byte_pairs = np.full((256, 256), self.size, np.int64)
        for whole, rank in ranks.items():
            if len(whole) == 2:
                self.byte_pairs[whole[0], whole[1]] = rank
        self.lengths = np.zeros(self.size, np.int64)
        tokens = [b""] * self.size
        for whole, rank in ranks.items():
            tokens[rank] = whole
            self.lengths[rank] = len(whole)
        self.offsets = np.concatenate(([0], np.cumsum(self.lengths)))[:-1]
        self.bytes = np.frombuffer(b"".join(tokens), np.uint8)

    def encode(self, pieces: list[bytes]) -> list[list[int]]:
        """Token ids of each pre-token, merged by rank, leftmost first."""
        data = np.frombuffer(b"".join(pieces), np.uint8)
        ends = np.cumsum([len(piece) for piece in pieces], dtype=np.int64)
        ranks = np.full(len(data), self.size, np.int64)
        ranks[:-1] = self.byte_pairs[data[:-1], data[1:]]
        ranks[ends[ends > 0] - 1] = self.size
        after, before = np.arange(1, len(data) + 1), np.arange(-1, len(data) - 1)
        after[ends[ends > 0] - 1] = -1
        before[ends[ends < len(data)]] = -1
        # the first buckets at once: positions sorted by the rank of their pair
        order = np.argsort(ranks, kind="stable")[: int((ranks < self.size).sum())]
        found, starts = np.unique(ranks[order], return_index=True)
        positions, bounds = order.tolist(), [*starts.tolist(), len(order)]
        token, after, before, waits = self.first[data].tolist(), after.tolist(), before.tolist(), ranks.tolist()
        low, top = [0] * (self.size // WORD_BITS + 1), 0
        buckets: dict[int, list[int]] = {}
        for rank, begin, end in zip(found.tolist(), bounds, bounds[1:]):
            buckets[rank] = positions[begin:end]
            low[rank >> 8] |= 1 << (rank & 255)
            top |= 1 << (rank >> 8)
        pairs = self.pairs.get
        while top:
            word = (top & -top).bit_length() - 1
            bits = low[word]
            rank = word << 8 | (bits & -bits).bit_length() - 1
            low[word] = bits = bits & (bits - 1)
            if not bits:
                top &= top - 1
            bucket, lower = buckets.pop(rank), False
            bucket.sort()
            for place, i in enumerate(bucket):
                if waits[i] != rank:
                    continue  # stale: one of the two has been merged meanwhile
                j = after[i]
                token[i], token[j], waits[j] = rank, -1, -1
                k = after[i] = after[j]
                # pairs with the new token are longer than it, so none has its rank
                if k >= 0:
                    before[k] = i
                    waits[i] = new = pairs(rank << 32 | token[k])
                    if new is not None:
                        lower = new < rank
                        if new in buckets:
                            buckets[new].append(i)
                        else:
                            buckets[new] = [i]
                            low[new >> 8] |= 1 << (new & 255)
                            top |= 1 << (new >> 8)
                else:
                    waits[i] = None
                h = before[i]
                if h >= 0:
                    waits[h] = new = pairs(token[h] << 32 | rank)
                    if new is not None:
                        lower = lower or new < rank
                        if new in buckets:
                            buckets[new].append(h)
                        else:
                            buckets[new] = [h]
                            low[new >> 8] |= 1 << (new & 255)
                            top |= 1 << (new >> 8)
                if lower and place + 1 < len(bucket):  # a lower rank comes first, the rest of this one later
                    buckets[rank] = bucket[place + 1 :]
                    low[rank >> 8] |= 1 << (rank & 255)
                    top |= 1 << (rank >> 8)
                    break
        left = np.array(token, np.int64)
        ids = left[left >= 0].tolist()
        bounds = np.concatenate(([0], np.cumsum(left >= 0)))[np.concatenate(([0], ends)).astype(np.int64)].tolist()
        return [ids[i:j] for i, j in zip(bounds, bounds[1:])]

    def decode(self, ids: np.ndarray) -> bytes:
        """The bytes that the ids stand for, one after another."""
        lengths = self.lengths[ids]
        ends = np.cumsum(lengths)
        total = int(ends[-1]) if len(ends) else 0
        return self.bytes[np.repeat(self.offsets[ids] - ends + lengths, lengths) + np.arange(total)].tobytes()


@lru_cache(maxsize=2)
def merges(path: str) -> Merges:
    return Merges(path)


class Encoder:
    """Splits texts by the pattern and encodes each distinct pre-token once while it is cached.

    The cache has two halves of bounded bytes. When the younger is full it becomes the older one,
    and what is met again moves over from there, so frequent pre-tokens stay and rare ones go.
    """

    def __init__(self, path: str, pattern: str):
        self.merges = merges(path)
        self.find = regex.compile(pattern).findall
        self.find_ascii = re.compile(ASCII_SPLIT).findall if pattern == SPLIT else self.find
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}
        self.held = 0

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        split = [(self.find_ascii if t.isascii() else self.find)(t) for t in texts]
        if self.held > CACHE_BYTES:
            self.young, self.old, self.held = {}, self.young, 0
        young, old = self.young, self.old
        missing = set().union(*split) - young.keys()
        for piece in missing & old.keys():
            self._keep(piece, old[piece])
        ranks, queue, size = self.merges.ranks, [], 0
        for piece in missing - old.keys():
            raw = piece.encode()
            rank = ranks.get(raw)
            if rank is not None:
                self._keep(piece, np.int32(rank).tobytes())
                continue
            queue.append((piece, raw))
            size += len(raw)
            if size >= QUEUED_BYTES:
                self._merge(queue)
                queue, size = [], 0
        if queue:
            self._merge(queue)
        known = young.__getitem__
        return [np.frombuffer(b"".join(map(known, pieces)), np.int32) for pieces in split]

    def _keep(self, piece: str, ids: bytes) -> None:
        self.young[piece] = ids
        self.held += ENTRY_BYTES + len(piece) + len(ids)

    def _merge(self, queue: list[tuple[str, bytes]]) -> None:
        for (piece, _), ids in zip(queue, self.merges.encode([raw for _, raw in queue]), strict=True):
            self._keep(piece, np.array(ids, np.int32).tobytes())


@lru_cache(maxsize=2)
def encoder(path: str, pattern: str) -> Encoder:
    return Encoder(path, pattern)


TEXTS_AT_ONCE = 2 << 20


def encode_and_decode(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """doc_id, ids (array of int) and decoded (binary, from the ids) of every row.

    A null text counts as empty: no ids, no bytes. Rows that repeat are encoded each; a null
    doc_id stays null; other columns are ignored. Documents never leave their partition.
    """
    ready(docs.sparkSession)

    def run(batches):
        coder = encoder(path, pattern)
        for batch in batches:
            texts, at = batch.column(1).fill_null("").to_pylist(), 0
            while at < len(texts):
                end, size = at, 0
                while end < len(texts) and (size < TEXTS_AT_ONCE or end == at):
                    size += len(texts[end])
                    end += 1
                ids = coder.encode(texts[at:end])
                bounds = np.concatenate(([0], np.cumsum([len(x) for x in ids]))).astype(np.int32)
                flat = pa.array(np.concatenate(ids) if ids else np.zeros(0, np.int32), pa.int32())
                decoded = pa.array([coder.merges.decode(x) for x in ids], pa.binary())
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, end - at), pa.ListArray.from_arrays(bounds, flat), decoded], ["doc_id", "ids", "decoded"])
                at = end

    narrow = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return narrow.mapInArrow(tidy(run), "doc_id long, ids array<int>, decoded binary")
