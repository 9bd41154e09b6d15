"""Repeated passages by difference-cover anchors.

Positions 0, 1 and 3 modulo 7 form a difference cover: whatever two places a passage has, some
shift below 7 brings both onto cover positions. Two equal runs of 13 words so share an anchor, a
window of 7 words that begins at a cover position in either. Only anchors are hashed and compared
at first. Around those that several documents share the match is extended to whole windows of 13
words, in every alignment that holds the anchor, and these are compared exactly by long hashes.
"""

from __future__ import annotations

from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from tastemill.llm.exchange import blocks, bucket_bounds, bucket_count, from_planes, open_block, planes, replies, texts_of, with_answers
from tastemill.llm.shared import Cuts, with_rows
from tastemill.llm.words import Texts, runs_inside, tidy, windows

_U = np.uint64
PERIOD, COVER = 7, (0, 1, 3)
KEY_BYTES = 6  # of an anchor's hash, besides its bucket; a false match costs a comparison only
NO_ID = np.iinfo(np.int64).max


class Block:
    """The words of a block's documents, their anchors and candidate windows."""

    def __init__(self, rows: bytes, window: int):
        self.batch = open_block(rows)
        self.part: Texts = texts_of(self.batch)
        self.window, self.anchor = window, window - PERIOD + 1
        ids = self.batch.column(0)
        self.ids = ids.fill_null(NO_ID).to_numpy().astype(np.int64)
        self.h = self.part.word_hashes()
        self.text_of = self.part.text_of_word()
        self.nth = np.arange(len(self.h)) - self.part.words[:-1][self.text_of]

    def anchors(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Distinct anchors, where each anchor stands, and which of the distinct it is."""
        a = windows(self.h, self.anchor)
        good = runs_inside(self.part.words, self.anchor, len(a)) & np.isin(self.nth[: len(a)] % PERIOD, COVER)
        at = np.flatnonzero(good)
        keys, which = np.unique(a[at], return_inverse=True)
        return keys, at, which

    def shared_inside(self, keys: np.ndarray, at: np.ndarray, which: np.ndarray) -> np.ndarray:
        """Whether several ids of this block hold the anchor."""
        ids = self.ids[self.text_of[at]]
        low, high = np.full(len(keys), NO_ID), np.full(len(keys), np.iinfo(np.int64).min)
        np.minimum.at(low, which, ids)
        np.maximum.at(high, which, ids)
        return low != high

    def candidates(self, shared: np.ndarray, at: np.ndarray, which: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Window starts around shared anchors; distinct windows as two hashes with their smallest id."""
        n = len(self.h) - self.window + 1
        hit = at[shared[which]]
        near = np.zeros(max(n, 0) + 1, np.int64)
        if n > 0 and len(hit):
            np.add.at(near, np.maximum(hit - PERIOD + 1, 0).clip(0, n), 1)
            np.add.at(near, (hit + 1).clip(0, n), -1)
        starts = np.flatnonzero((np.cumsum(near)[:-1] > 0) & runs_inside(self.part.words, self.window, max(n, 0)))
        # an anchor reaches windows of its own text only, so both stand in one
        first, second = windows(self.h, self.window), windows(self.h, self.window, 1)
        first, second = first[starts], (second[starts] >> _U(32)).astype(np.uint32)
        by = np.lexsort((second, first))
        first, second, owner = first[by], second[by], self.ids[self.text_of[starts[by]]]
        fresh = np.ones(len(by), bool)
        fresh[1:] = (first[1:] != first[:-1]) | (second[1:] != second[:-1])
        heads = np.flatnonzero(fresh)
        group = np.cumsum(fresh) - 1
        smallest = np.minimum.reduceat(owner, heads) if len(heads) else owner
        which_window = np.empty(len(by), np.int64)
        which_window[by] = group
        return starts, which_window, first[heads], second[heads], smallest


def ask_anchors(table: DataFrame, window: int, buckets: int) -> DataFrame:
    def run(batches):
        for batch in batches:
            for block, rows in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                b = Block(rows, window)
                keys, at, which = b.anchors()
                inside = b.shared_inside(keys, at, which)
                of, bounds = bucket_bounds(keys, buckets)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(of), pa.array(np.full(len(of), block)), pa.array(np.diff(bounds)),
                        pa.array([planes(keys[i:j], KEY_BYTES) for i, j in zip(bounds, bounds[1:])], pa.binary()),
                        pa.array([np.packbits(inside[i:j]).tobytes() for i, j in zip(bounds, bounds[1:])], pa.binary()),
                    ],
                    ["bucket", "block", "n", "keys", "inside"],
                )

    return table.select("block", "rows").mapInArrow(tidy(run), "bucket long, block long, n long, keys binary, inside binary")


def answer_anchors(asked: DataFrame) -> DataFrame:
    """For every block and bucket, which of its anchors several documents share."""

    def answer(key, group):
        n, raw, flags = (group.column(k).to_pylist() for k in ("n", "keys", "inside"))
        keys = np.concatenate([from_planes(r, np.uint64, KEY_BYTES) for r in raw])
        inside = np.concatenate([np.unpackbits(np.frombuffer(f, np.uint8), count=c).astype(bool) for f, c in zip(flags, n)])
        _, which, count = np.unique(keys, return_inverse=True, return_counts=True)
        shared = (count > 1) | (np.bincount(which, weights=inside) > 0)
        out, bounds = shared[which], np.cumsum([0, *n])
        return pa.table({"block": group.column("block"), "bucket": group.column("bucket"), "reply": pa.array([np.packbits(out[i:j]).tobytes() for i, j in zip(bounds, bounds[1:])], pa.binary())})

    return asked.groupBy("bucket").applyInArrow(answer, "block long, bucket long, reply binary")


def bits(column: pa.Array, row: int, keys: np.ndarray, buckets: int) -> np.ndarray:
    """Flags of a block's sorted keys from the replies of its buckets."""
    _, bounds = bucket_bounds(keys, buckets)
    got = [np.unpackbits(np.frombuffer(r, np.uint8), count=int(j - i)) for r, i, j in zip(replies(column, row), bounds[:-1], bounds[1:], strict=True)]
    return np.concatenate(got).astype(bool) if got else np.zeros(0, bool)


def ask_windows(table: DataFrame, window: int, buckets: int) -> DataFrame:
    def run(batches):
        for batch in batches:
            for row in range(batch.num_rows):
                b = Block(batch.column(1)[row].as_py(), window)
                keys, at, which = b.anchors()
                _, _, first, second, smallest = b.candidates(bits(batch.column(2), row, keys, buckets), at, which)
                of, bounds = bucket_bounds(first, buckets)
                spans = list(zip(bounds, bounds[1:]))
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(of), pa.array(np.full(len(of), batch.column(0)[row].as_py(), np.int64)), pa.array(np.diff(bounds)),
                        pa.array([first[i:j].tobytes() for i, j in spans], pa.binary()), pa.array([second[i:j].tobytes() for i, j in spans], pa.binary()),
                        pa.array([planes(smallest[i:j]) for i, j in spans], pa.binary()),
                    ],
                    ["bucket", "block", "n", "first", "second", "ids"],
                )

    return table.mapInArrow(tidy(run), "bucket long, block long, n long, first binary, second binary, ids binary")


def answer_windows(asked: DataFrame) -> DataFrame:
    """For every block and bucket, which windows start in a document with a smaller id than its own."""

    def answer(key, group):
        n = group.column("n").to_pylist()
        first = np.frombuffer(b"".join(group.column("first").to_pylist()), np.uint64)
        second = np.frombuffer(b"".join(group.column("second").to_pylist()), np.uint32)
        ids = np.concatenate([from_planes(r, np.int64) for r in group.column("ids").to_pylist()])
        by = np.lexsort((second, first))
        fresh = np.ones(len(by), bool)
        fresh[1:] = (first[by][1:] != first[by][:-1]) | (second[by][1:] != second[by][:-1])
        smallest = np.minimum.reduceat(ids[by], np.flatnonzero(fresh)) if len(by) else ids
        out = np.empty(len(by), bool)
        out[by] = smallest[np.cumsum(fresh) - 1] < ids[by]
        bounds = np.cumsum([0, *n])
        return pa.table({"block": group.column("block"), "bucket": group.column("bucket"), "reply": pa.array([np.packbits(out[i:j]).tobytes() for i, j in zip(bounds, bounds[1:])], pa.binary())})

    return asked.groupBy("bucket").applyInArrow(answer, "block long, bucket long, reply binary")


def strip_repeats(docs: DataFrame, window: int = 13, keep_layout: bool = False) -> DataFrame:
    """doc_id, n_words, n_removed, kept_text and row (all columns but the text) of every row.

    Removed is each word covered by a run of ``window`` words that also starts in a document with
    a smaller doc_id, judged on the input; kept words are joined by one space; with ``keep_layout`` a text that loses nothing stays
    as it is, null included. A null text has no
    words. A null doc_id counts as larger than all others; rows with equal ids never remove from
    each other. An empty table gives no rows.
    """
    cuts = Cuts(docs.sparkSession, "anchors")
    narrow = with_rows(docs)
    table = cuts.save("blocks", blocks(narrow))
    buckets = bucket_count(table)
    anchors = cuts.save("anchors", answer_anchors(ask_anchors(table, window, buckets)))
    found = cuts.save("windows", answer_windows(ask_windows(with_answers(table, anchors), window, buckets)))

    def run(batches):
        for batch in batches:
            for row in range(batch.num_rows):
                b = Block(batch.column(1)[row].as_py(), window)
                keys, at, which = b.anchors()
                starts, of, first, _, smallest = b.candidates(bits(batch.column(2), row, keys, buckets), at, which)
                elsewhere = bits(batch.column(3), row, first, buckets)
                gone = starts[elsewhere[of] | (smallest[of] < b.ids[b.text_of[starts]])]
                edge = np.zeros(len(b.h) + 1, np.int64)
                edge[gone] += 1
                np.add.at(edge, gone + window, -1)
                kept = np.cumsum(edge)[:-1] == 0
                words = b.part.words
                out = []
                for i, text in enumerate(b.batch.column(1).to_pylist()):
                    flags = kept[words[i] : words[i + 1]]
                    if keep_layout and flags.all():
                        out.append(text)
                    else:
                        out.append(b" ".join(compress((text or b"").split(), flags)))
                removed = np.concatenate(([0], np.cumsum(~kept)))[words]
                yield pa.RecordBatch.from_arrays(
                    [b.batch.column(0), pa.array(np.diff(words)), pa.array(np.diff(removed)), pa.array(out, pa.binary()).cast(pa.string()), b.batch.column(2)],
                    ["doc_id", "n_words", "n_removed", "kept_text", "row"],
                )

    schema = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("n_words", T.LongType()), T.StructField("n_removed", T.LongType()), T.StructField("kept_text", T.StringType()), T.StructField("row", narrow.schema["row"].dataType)])
    return with_answers(table, anchors, found).mapInArrow(tidy(run), schema)
