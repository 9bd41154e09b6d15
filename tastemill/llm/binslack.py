"""Packing token sequences with minimum bin slack.

Only documents longer than a sequence are cut; a shorter first piece takes what does not fill
whole sequences. The lengths of all pieces form a histogram of at most ``size`` entries, whatever
the corpus holds. Bin after bin, the longest piece left is fixed and a subset-sum dynamic program
over a bitset of reachable sums finds the fullest combination of the lengths left; the combination
is removed as often as the histogram holds it. Pieces then get their places by rank: their number
within their partition and length, counted while they are cut, plus the pieces of that length in
earlier partitions. Lengths are exact, so a place fixes the offset and no sequence is ever sorted.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tastemill.llm.cutting import SPLIT, TEXTS_AT_ONCE, _ids
from tastemill.llm.shared import Cuts, ready
from tastemill.llm.words import tidy

PIECE = ("doc_id", "piece", "start", "length", "ids_crc32")


def cut_long(docs: DataFrame, path: str, size: int, end_id: int, split: str | None, with_ids: bool) -> DataFrame:
    """Pieces of every document with their partition and their number among its pieces of that length."""
    fields = "doc_id long, piece int, start long, length int, ids_crc32 long, part int, nth long" + (", ids array<int>" if with_ids else "")

    def run(batches):
        from pyspark import TaskContext

        part, seen = TaskContext.get().partitionId(), np.zeros(size + 1, np.int64)
        coder = _ids(path, split)
        for batch in batches:
            owners, texts, at = batch.column(0).to_pylist(), batch.column(1).fill_null("").to_pylist(), 0
            while at < len(texts):
                end, chars = at, 0
                while end < len(texts) and (chars < TEXTS_AT_ONCE or end == at):
                    chars += len(texts[end])
                    end += 1
                rows = []
                for doc, ids in zip(owners[at:end], coder.of(texts[at:end]), strict=True):
                    ids = np.append(ids, np.uint32(end_id)).astype("<u4")
                    first = len(ids) % size or size
                    for number, stop in enumerate(range(first, len(ids) + 1, size)):
                        start = max(0, stop - size) if number else 0
                        held = ids[start:stop]
                        rows.append((doc, number, start, len(held), zlib.crc32(held.tobytes()), part, int(seen[len(held)]), held.astype(np.int32) if with_ids else None))
                        seen[len(held)] += 1
                kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.int64(), pa.list_(pa.int32())]
                names = [*PIECE, "part", "nth", *(["ids"] if with_ids else [])]
                columns = list(zip(*rows, strict=True))
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)][: len(names)], names)
                at = end

    narrow = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return narrow.mapInArrow(tidy(run), fields)


def fullest(left: np.ndarray, lengths: np.ndarray, room: int) -> dict[int, int]:
    """The combination of lengths left that fills ``room`` best, as length to count.

    Bit s of ``reach`` says that some combination adds up to s. Longer lengths come first, and of
    equal sums the one that needs fewer of the short lengths is kept, as they fill later gaps.
    """
    reach, mask, steps = 1, (1 << (room + 1)) - 1, []
    for length in lengths.tolist():
        if length > room:
            continue
        copies, many = min(int(left[length]), room // length), 1
        while copies > 0:
            taken = min(many, copies)
            after = (reach | reach << length * taken) & mask
            if after != reach:
                steps.append((reach, length, taken))
                reach = after
            copies -= taken
            many *= 2
        if reach >> room & 1:
            break
    total, chosen = reach.bit_length() - 1, {}
    for before, length, taken in reversed(steps):
        if not before >> total & 1:
            chosen[length] = chosen.get(length, 0) + taken
            total -= length * taken
    return chosen


def fill(counts: dict[int, int], size: int) -> list[tuple[dict[int, int], int]]:
    """Combinations (length to count) and how often each is used; together they hold all pieces."""
    left = np.zeros(size + 1, np.int64)
    for length, n in counts.items():
        left[length] = n
    out = []
    while True:
        lengths = np.flatnonzero(left)[::-1]
        if not len(lengths):
            return out
        longest = int(lengths[0])
        left[longest] -= 1
        chosen = fullest(left, lengths if left[longest] else lengths[1:], size - longest)
        left[longest] += 1
        chosen[longest] = chosen.get(longest, 0) + 1
        times = min(int(left[length]) // n for length, n in chosen.items())
        for length, n in chosen.items():
            left[length] -= n * times
        out.append((chosen, times))


def places(patterns: list[tuple[dict[int, int], int]]) -> dict[str, np.ndarray]:
    """For each length, which ranks a combination takes and where it puts them."""
    taken: dict[int, int] = {}
    rows, sequence = [], 0
    for chosen, times in patterns:
        offset = 0
        for length in sorted(chosen, reverse=True):
            each, first = chosen[length], taken.get(length, 0)
            rows.append((length, first, each, sequence, offset))
            taken[length] = first + each * times
            offset += each * length
        sequence += times
    table = np.array(sorted(rows), np.int64).reshape(-1, 5)
    return dict(zip(("length", "first", "each", "sequence", "offset"), table.T, strict=True))


def pack(docs: DataFrame, path: str, size: int = 2048, end_id: int = 0, split: str | None = SPLIT, with_ids: bool = False) -> DataFrame:
    """Pack all documents into few sequences of at most ``size`` ids.

    Returns a row for each piece: doc_id, piece (from 0), start, length, ids_crc32, sequence_id
    (from 0), offset, and ids with ``with_ids``. A null text is empty and becomes the end id alone;
    rows that repeat are packed each and a null doc_id stays null; an empty table gives no rows;
    other columns are ignored. A text of any length is cut; only it itself must fit a worker.
    The driver holds the histogram of lengths and the combinations: at most ``size`` lengths, each
    of which some combination uses up, whatever the number of documents.
    """
    spark = ready(docs.sparkSession)
    cuts = Cuts(spark, "slack")
    pieces = cuts.save("pieces", cut_long(docs, path, size, end_id, split, with_ids))
    # a row for each partition and length
    held = cuts.save("held", pieces.groupBy("part", "length").agg(F.count("*").alias("n")))
    counts = {r["length"]: r["n"] for r in held.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    where = places(fill(counts, size))
    # lengths spread over few keys, so the running sum of a length sees one row for each partition
    earlier = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    before = held.select("part", "length", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before"))
    ranked = pieces.join(before, ["part", "length"]).withColumn("rank", F.col("before") + F.col("nth"))
    carried = [*PIECE, *(["ids"] if with_ids else [])]

    def run(batches):
        key = where["length"] << 44 | where["first"]
        for batch in batches:
            length, rank = (batch.column(i).to_numpy().astype(np.int64) for i in (0, 1))
            at = np.searchsorted(key, length << 44 | rank, side="right") - 1
            turn, slot = np.divmod(rank - where["first"][at], where["each"][at])
            columns = [batch.column(i + 2) for i in range(len(carried))]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(where["sequence"][at] + turn), pa.array(where["offset"][at] + slot * length)], [*carried, "sequence_id", "offset"])

    fields = "doc_id long, piece int, start long, length long, ids_crc32 long" + (", ids array<int>" if with_ids else "") + ", sequence_id long, offset long"
    wide = [F.col(c).cast("long").alias(c) if c == "length" else F.col(c) for c in carried]
    return ranked.select(F.col("length").alias("_length"), "rank", *wide).mapInArrow(tidy(run), fields)
