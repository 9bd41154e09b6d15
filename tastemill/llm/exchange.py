"""Blocks of documents, and questions from blocks to buckets of a hash and back.

Statistics over all windows or n-grams of a corpus need a shuffle by the window's hash, and the
answer is wanted where the window stands. Rows for single windows would cost many times the text.
So some megabytes of documents make a block, a row of a written table; a block sends each bucket
one row with all its distinct keys as packed bytes, and gets one row with packed answers in the
order of the keys. A block forms its keys anew when the answers come, so positions never travel.
Keys are spread by their hash, so buckets are even, and a block sends a key that it holds often
only once, so a hot key costs a bucket at most one entry a block.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tastemill.llm.words import SLICE_BYTES, Texts, column_bytes, tidy

BUCKET_BYTES = 4 << 20
_U = np.uint64


def block_batches(batches: Iterator[pa.RecordBatch], text_at: int, limit: int) -> Iterator[pa.RecordBatch]:
    """(block, size, rows) of a task: its consecutive rows, compressed, ``limit`` bytes of text at a time."""
    from pyspark import TaskContext

    number = TaskContext.get().partitionId() << 40
    held, size = [], 0

    def close():
        nonlocal number, held, size
        sink = pa.BufferOutputStream()
        table = pa.Table.from_batches(held).combine_chunks()
        with pa.ipc.new_stream(sink, table.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as writer:
            writer.write_table(table)
        out = pa.RecordBatch.from_arrays([pa.array([number]), pa.array([size]), pa.array([sink.getvalue().to_pybytes()], pa.binary())], ["block", "size", "rows"])
        number, held, size = number + 1, [], 0
        return out

    for batch in batches:
        sizes = np.diff(column_bytes(batch.column(text_at))[1])
        at = 0
        while at < len(sizes):
            total = np.cumsum(sizes[at:]) + size
            n = max(int(np.searchsorted(total, limit, side="right")), 0 if held else 1)
            if n:
                held.append(batch.slice(at, n))
                size = int(total[n - 1])
                at += n
            if at < len(sizes):
                yield close()
    if held:
        yield close()


def blocks(rows: DataFrame, text_at: int = 1, limit: int = SLICE_BYTES) -> DataFrame:
    """(block, size, rows): consecutive rows of a partition, compressed; column ``text_at`` is binary."""

    def run(batches):
        yield from block_batches(batches, text_at, limit)

    return rows.mapInArrow(tidy(run), "block long, size long, rows binary")


def open_block(rows: bytes) -> pa.RecordBatch:
    return pa.ipc.open_stream(rows).read_all().combine_chunks().to_batches()[0]


def texts_of(batch: pa.RecordBatch, column: int = 1, fold: bool = False) -> Texts:
    data, at = column_bytes(batch.column(column))
    return Texts(data[at[0] : at[-1]], at - at[0], 0, fold).find_words()


def bucket_count(blocks_table: DataFrame) -> int:
    total = blocks_table.agg(F.sum("size")).first()[0] or 0
    return max(1, math.ceil(total / BUCKET_BYTES))


def bucket_bounds(sorted_keys: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """Buckets that sorted 64-bit keys fall into, and where each one's keys begin and end."""
    of = ((sorted_keys >> _U(32)) * _U(buckets)) >> _U(32)
    turns = np.flatnonzero(np.concatenate(([True], of[1:] != of[:-1]))) if len(of) else np.zeros(0, np.int64)
    return of[turns].astype(np.int64), np.append(turns, len(of))


def planes(values: np.ndarray, keep: int | None = None) -> bytes:
    """Bytes of numbers, first bytes first; zero bytes of small numbers lie together and compress."""
    raw = np.ascontiguousarray(values).view(np.uint8).reshape(len(values), values.itemsize)
    return np.ascontiguousarray(raw[:, :keep].T).tobytes()


def from_planes(raw: bytes, dtype, keep: int | None = None) -> np.ndarray:
    width = np.dtype(dtype).itemsize
    stored = np.frombuffer(raw, np.uint8).reshape(keep or width, -1)
    full = np.zeros((stored.shape[1], width), np.uint8)
    full[:, : stored.shape[0]] = stored.T
    return full.view(dtype).ravel()


def with_answers(blocks_table: DataFrame, *answers: DataFrame) -> DataFrame:
    """Blocks with a list of (bucket, reply) for each table of answers; null where there is none."""
    out = blocks_table.select("block", "rows")
    for i, answer in enumerate(answers):
        listed = answer.groupBy("block").agg(F.sort_array(F.collect_list(F.struct("bucket", "reply"))).alias(f"replies{i}"))
        out = out.join(listed, "block", "left")
    return out


def replies(column: pa.Array, row: int) -> list[bytes]:
    """Replies of one block in the order of the buckets."""
    value = column[row]
    return [r["reply"] for r in value.as_py()] if value.is_valid else []
