"""Ranked lexical search over bit-sliced Bloom signatures.

Documents stand in blocks of some megabytes. A block's signatures are slices: row r holds a bit for
each document, and a term sets the bits of its document in a few rows that its hash names. The AND of
a term's rows is a bitmap of documents that may hold it: all that do, and a few more. Terms enter
once for each step of their frequency (at least once, twice, ...), so bitmaps also bound how often.
Weighted sums of bitmaps give an upper bound of every document's score. The documents with the best
bounds are scored exactly first; their 50th score is a floor, and every document whose bound reaches
the floor is scored exactly from its text. A document is passed over only when its bound proves that
it cannot be among the best.

Signatures have rows in proportion to a document's entries: documents of like size share a matrix.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tastemill.llm.exchange import block_batches, open_block
from tastemill.llm.shared import Cuts, ready
from tastemill.llm.words import Texts, column_bytes, mix, tidy

_U = np.uint64
BLOCK_BYTES = 2 << 20
ITEM_BYTES = 1 << 18  # of item texts in one block of queries
STEPS = (1, 2, 3, 5, 9)  # frequencies that a term's entries stand for: at least so often
PROBES, PROBE_BITS = 3, 21
BITS_AN_ENTRY = 10
LEAST_ROWS = 6  # as a power of two
CELLS = 1 << 23  # terms times documents whose bitmaps are open at once
PAIRS = 1 << 20  # terms of documents scored at once
BLOCKS_AT_ONCE = 16  # blocks of queries sent to all tasks together
HELD = 1 << 22  # best bounds that a task holds before it hands them on
TERM = np.zeros(256, bool)
TERM[0x30:0x3A] = TERM[0x41:0x5B] = TERM[0x61:0x7B] = TERM[0x80:] = True


def terms_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hash of every term in the texts, and which text it stands in."""
    data, bounds = column_bytes(column)
    part = Texts(data[bounds[0] : bounds[-1]], bounds - bounds[0], 0, fold=True)
    inside = TERM[part.data]
    n = len(inside)
    first, last = inside.copy(), inside.copy()
    first[1:] &= ~inside[:-1]
    last[:-1] &= ~inside[1:]
    edge = part.bounds[1:-1]
    edge = edge[(edge > 0) & (edge < n)]
    first[edge], last[edge - 1] = inside[edge], inside[edge - 1]
    starts = np.flatnonzero(first)
    counts = np.diff(np.searchsorted(starts, part.bounds))
    h = part.hashes(starts, np.flatnonzero(last) + 1)
    part.forget()
    return h, np.repeat(np.arange(len(counts)), counts)


def grouped(h: np.ndarray, of: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Each text's distinct terms: text, term, occurrences."""
    by = np.lexsort((h, of))
    h, of = h[by], of[by]
    heads = np.flatnonzero(np.append(True, (h[1:] != h[:-1]) | (of[1:] != of[:-1]))[: len(h)])
    return of[heads], h[heads], np.diff(heads, append=len(h))


def entry(terms: np.ndarray, step: int) -> np.ndarray:
    return mix(terms + _U(step * 0x9E3779B97F4A7C15 % (1 << 64)))


def rows_of(entries: np.ndarray, power: int, probe: int) -> np.ndarray:
    return (entries >> _U(probe * PROBE_BITS) & _U((1 << power) - 1)).astype(np.int64)


def sliced(of: np.ndarray, terms: np.ndarray, tf: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, bytes]:
    """Documents in the order of their columns, each one's power of rows, and the slices of all matrices."""
    entries = np.zeros(n, np.int64)
    for least in STEPS:
        entries += np.bincount(of[tf >= least], minlength=n)
    power = np.ceil(np.log2(np.maximum(entries * BITS_AN_ENTRY, 1 << LEAST_ROWS))).astype(np.int64).clip(LEAST_ROWS, PROBE_BITS)
    order = np.argsort(power, kind="stable")
    column = np.empty(n, np.int64)
    column[order] = np.arange(n)
    out = []
    for p in np.unique(power):
        low, high = np.searchsorted(power[order], [p, p + 1])
        bits = np.zeros((1 << int(p), high - low), bool)
        mine = power[of] == p
        for step, least in enumerate(STEPS):
            some = mine & (tf >= least)
            keys, at = entry(terms[some], step), column[of[some]] - low
            for probe in range(PROBES):
                bits[rows_of(keys, int(p), probe), at] = True
        out.append(np.packbits(bits, axis=1, bitorder="little").tobytes())
    return order, power[order], b"".join(out)


INDEX = "block long, docs int, filled int, total long, lengths binary, most binary, columns binary, powers binary, slices binary, terms array<long>, df array<int>, rows binary"


def signatures(docs: DataFrame) -> DataFrame:
    """A row for each block: signatures, lengths, the block's dictionary and its documents."""
    limit = BLOCK_BYTES

    def run(batches):
        for batch in block_batches(batches, 1, limit):
            for block, _, rows in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                texts = open_block(rows)
                h, of = terms_of(texts.column(1))
                n = texts.num_rows
                length = np.bincount(of, minlength=n)
                of, terms, tf = grouped(h, of)
                most = np.zeros(n, np.int64)
                np.maximum.at(most, of, tf)
                order, power, slices = sliced(of, terms, tf, n)
                known, df = np.unique(terms, return_counts=True)
                values = [block, n, int((length > 0).sum()), int(length.sum()), length.astype(np.int64).tobytes(), most.tobytes(), order.astype(np.int32).tobytes(), power.astype(np.uint8).tobytes(), slices]
                kinds = [pa.int64(), pa.int32(), pa.int32(), pa.int64(), *[pa.binary()] * 5]
                lists = [pa.ListArray.from_arrays(pa.array([0, len(known)], pa.int32()), pa.array(known.view(np.int64))), pa.ListArray.from_arrays(pa.array([0, len(known)], pa.int32()), pa.array(df.astype(np.int32)))]
                names = ["block", "docs", "filled", "total", "lengths", "most", "columns", "powers", "slices", "terms", "df", "rows"]
                yield pa.RecordBatch.from_arrays([*[pa.array([v], k) for v, k in zip(values, kinds)], *lists, pa.array([rows], pa.binary())], names)

    return docs.mapInArrow(tidy(run), INDEX)


@dataclass
class Index:
    """Signatures of a corpus, with its number of documents that have terms and all their terms."""

    cuts: Cuts
    table: DataFrame
    documents: int
    terms: int


def build(docs: DataFrame) -> Index:
    cuts = Cuts(ready(docs.sparkSession), "slices")
    narrow = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").cast("binary").alias("text"))
    table = cuts.save("index", signatures(narrow))
    sums = table.agg(F.sum("filled"), F.sum("total")).first()
    return Index(cuts, table, sums[0] or 0, sums[1] or 0)


class Queries:
    """A block of items: the terms of each with their weights."""

    def __init__(self, number: np.ndarray, term: np.ndarray, weight: np.ndarray):
        self.items = int(number.max()) + 1 if len(number) else 0
        self.terms, self.of = np.unique(term.view(_U), return_inverse=True)
        self.weight, self.bounds = weight, np.searchsorted(number, np.arange(self.items + 1))


def damping(length: np.ndarray, documents: int, terms: int) -> np.ndarray:
    """100 less 50, and 50 times the length in average lengths; whole numbers of any size."""
    if int(length.max(initial=0)) * 50 * documents < 1 << 62:
        return 50 + 50 * length.astype(np.int64) * documents // terms
    return np.array([50 + 50 * int(n) * documents // terms for n in length], np.int64)


def impact(tf: np.ndarray, m: np.ndarray) -> np.ndarray:
    return 1_000_000_000 * tf // (1000 * tf + 20 * m)


def bounds_of(row: dict, queries: Queries, documents: int, terms: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(documents, upper bound of each item's score in each of them), some columns at a time."""
    order, powers = np.frombuffer(row["columns"], np.int32), np.frombuffer(row["powers"], np.uint8)
    length, most = (np.frombuffer(row[k], np.int64)[order] for k in ("lengths", "most"))
    m = damping(length, documents, terms)
    limits = [*[s - 1 for s in STEPS[1:]], None]
    gains = [impact(np.minimum(most, most if x is None else x), m).astype(np.float64) for x in limits]
    keys = [entry(queries.terms, step) for step in range(len(STEPS))]
    wide = max(8, CELLS // max(1, len(queries.terms)) // 8 * 8)
    at = 0
    for p in np.unique(powers).tolist():
        low, high = np.searchsorted(powers, [p, p + 1])
        width = (high - low + 7) // 8
        matrix = np.frombuffer(row["slices"], np.uint8, (1 << p) * width, at).reshape(1 << p, width)
        at += matrix.size
        rows = [[rows_of(k, p, probe) for probe in range(PROBES)] for k in keys]
        for first in range(0, high - low, wide):
            here = slice(low + first, min(low + first + wide, high))
            sums = np.zeros((queries.items, here.stop - here.start))
            before, reached = np.zeros(here.stop - here.start), None
            for step in range(len(STEPS)):
                part = matrix[:, first // 8 : (first + wide) // 8]
                found = part[rows[step][0]]
                for other in rows[step][1:]:
                    found = found & part[other]
                reached = found if reached is None else reached & found
                if not reached.any():
                    break
                bits = np.unpackbits(reached, axis=1, count=here.stop - here.start, bitorder="little")
                gain = gains[step][here] - before
                for i in range(queries.items):
                    mine = slice(queries.bounds[i], queries.bounds[i + 1])
                    sums[i] += (queries.weight[mine].astype(np.float64) @ bits[queries.of[mine]]) * gain
                before = gains[step][here]
            yield order[here], sums


def exact_scores(rows: bytes, docs: np.ndarray, number: np.ndarray, queries: Queries, documents: int, terms: int) -> tuple[pa.Array, np.ndarray]:
    """doc_id and exact score of each pair of a document of the block and an item."""
    batch = open_block(rows)
    some, which = np.unique(docs, return_inverse=True)
    texts = batch.take(pa.array(some))
    h, of = terms_of(texts.column(1))
    m = damping(np.bincount(of, minlength=len(some)), documents, terms)
    near = np.searchsorted(queries.terms, h).clip(0, max(0, len(queries.terms) - 1))
    hit = queries.terms[near] == h
    key, tf = np.unique(of[hit] * len(queries.terms) + near[hit], return_counts=True)
    sizes = np.diff(queries.bounds)[number]
    scores = np.zeros(len(docs), np.int64)
    ends = np.cumsum(sizes)
    at = 0
    while at < len(docs):
        stop = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + PAIRS, side="right")))
        mine, size = slice(at, stop), sizes[at:stop]
        inside = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
        place = np.repeat(queries.bounds[number[mine]], size) + inside
        owner = np.repeat(which[mine], size)
        wanted = owner * len(queries.terms) + queries.of[place]
        found = np.searchsorted(key, wanted).clip(0, max(0, len(key) - 1))
        times = np.where(key[found] == wanted, tf[found], 0) if len(key) else np.zeros(len(wanted), np.int64)
        scores[mine] = np.add.reduceat(queries.weight[place] * impact(times, m[owner]), np.cumsum(size) - size)
        at = stop
    return texts.column(0).take(pa.array(which)), scores


def parsed(items: DataFrame) -> DataFrame:
    """(q, number, item_id, term): the distinct terms of every item, items numbered within a block of queries."""

    limit = ITEM_BYTES

    def run(batches):
        for batch in block_batches(batches, 1, limit):
            for block, _, rows in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                texts = open_block(rows)
                number, term, _ = grouped(*terms_of(texts.column(1)))
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(term), block)), pa.array(number.astype(np.int32)), texts.column(0).take(pa.array(number)), pa.array(term.view(np.int64))], ["q", "number", "item_id", "term"])

    narrow = items.select("item_id", F.col("text").cast("string").cast("binary").alias("text"))
    kind = items.schema["item_id"].dataType.simpleString()
    return narrow.mapInArrow(tidy(run), f"q long, number int, item_id {kind}, term long")


def weighted(index: Index, wanted: DataFrame) -> DataFrame:
    """A row for each block of queries with the lists number, term and weight, in the order of the items."""
    local = index.table.select(F.explode(F.arrays_zip("terms", "df")).alias("t")).select(F.col("t.terms").alias("term"), F.col("t.df").alias("df"))
    df = local.join(wanted.select("term").distinct(), "term").groupBy("term").agg(F.sum("df").alias("df"))
    weight = F.floor(1000 * F.log((2 * F.lit(index.documents).cast("double") + 2) / (2 * F.col("df").cast("double") + 1))).cast("long")
    rows = wanted.join(df, "term").select("q", F.struct("number", "term", weight.alias("weight")).alias("t"))
    # the items of a block of queries are bounded in bytes
    lists = rows.groupBy("q").agg(F.sort_array(F.collect_list("t")).alias("t"))
    return lists.select("q", *[F.col(f"t.{c}").alias(c) for c in ("number", "term", "weight")])


def rows_with_queries(batch: pa.RecordBatch, met: dict[int, Queries]) -> Iterator[tuple[dict, Queries]]:
    for i in range(batch.num_rows):
        row = {name: batch.column(name)[i].as_py() for name in batch.schema.names if name not in ("number", "term", "weight")}
        if row["q"] not in met:
            met[row["q"]] = Queries(*[batch.column(c)[i].values.to_numpy() for c in ("number", "term", "weight")])
        yield row, met[row["q"]]


def search(index: Index, items: DataFrame, top: int = 50) -> DataFrame:
    """The ``top`` best documents of every item: item_id, rank (from 1), doc_id, score (above 0).

    Every row of ``items`` is an item and every row of the corpus a document of its own, whatever ids
    repeat. A null or empty text has no terms: such an item has no rows, such a document no rank. A
    null doc_id comes after all others of its score, a null item_id stays null. Empty tables give no
    rows; extra columns are ignored. Items go in blocks of bounded bytes, some blocks at a time.
    """
    wanted = index.cuts.save("wanted", parsed(items))
    queries = index.cuts.save("queries", weighted(index, wanted))
    blocks_asked = sorted(r["q"] for r in queries.select("q").collect())
    answers = items.sparkSession.createDataFrame([], "q long, number int, doc_id long, score long")
    for i in range(0, len(blocks_asked), BLOCKS_AT_ONCE):
        some = blocks_asked[i : i + BLOCKS_AT_ONCE]
        found = found_for(index, queries.where(F.col("q").isin(some)), some, top)
        answers = answers.unionByName(found) if i else found
    place = F.row_number().over(Window.partitionBy("q", "number").orderBy(F.desc("score"), F.asc_nulls_last("doc_id")))
    listed = answers.withColumn("rank", place).where(F.col("rank") <= top)
    names = wanted.select("q", "number", "item_id").distinct()
    return listed.join(names, ["q", "number"]).select("item_id", F.col("rank").cast("int").alias("rank"), "doc_id", "score")


def asked(rows: DataFrame, queries: DataFrame, blocks_asked: list[int]) -> DataFrame:
    """Every row of the index next to each block of queries; these are bounded in bytes and number."""
    return rows.withColumn("q", F.explode(F.array(*[F.lit(q) for q in blocks_asked]))).join(F.broadcast(queries), "q")


def found_for(index: Index, queries: DataFrame, blocks_asked: list[int], top: int) -> DataFrame:
    """(q, number, doc_id, score): all documents whose bounds do not exclude them, with exact scores at the floor or above."""
    n, total = index.documents, index.terms
    signed = ["block", "docs", "lengths", "most", "columns", "powers", "slices"]

    def pilots(batches):
        """The documents with the best bounds that a task has met, for each item."""
        held, met = {}, {}

        def handed():
            for q, (bound, block, doc) in held.items():
                number, place = np.nonzero(bound > 0)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(number), q, np.int64)), pa.array(number.astype(np.int32)), pa.array(block[number, place]), pa.array(doc[number, place].astype(np.int32)), pa.array(bound[number, place].astype(np.int64))], ["q", "number", "block", "doc", "bound"])

        for batch in batches:
            for row, mine in rows_with_queries(batch, met):
                for docs, bound in bounds_of(row, mine, n, total):
                    block = np.full(bound.shape, row["block"], np.int64)
                    docs = np.broadcast_to(docs, bound.shape)
                    if row["q"] in held:
                        bound, block, docs = (np.concatenate(pair, axis=1) for pair in zip(held[row["q"]], (bound, block, docs)))
                    if bound.shape[1] > top:
                        keep = np.argpartition(-bound, top - 1, axis=1)[:, :top]
                        bound, block, docs = (np.take_along_axis(x, keep, axis=1) for x in (bound, block, docs))
                    held[row["q"]] = (bound, block, docs)
                if sum(x[0].size for x in held.values()) > HELD:
                    yield from handed()
                    held = {}
        yield from handed()

    found = asked(index.table.select(*signed), queries, blocks_asked).mapInArrow(tidy(pilots), "q long, number int, block long, doc int, bound long")
    order = Window.partitionBy("q", "number").orderBy(F.desc("bound"), "block", "doc")
    chosen = found.withColumn("place", F.row_number().over(order)).where(F.col("place") <= top)
    packed = index.cuts.save("pilots", chosen.groupBy("block", "q").agg(F.collect_list(F.struct("number", "doc")).alias("pairs")).select("block", "q", F.col("pairs.number").alias("numbers"), F.col("pairs.doc").alias("at")))

    def rescored(batches):
        met = {}
        for batch in batches:
            for row, mine in rows_with_queries(batch, met):
                numbers, docs = np.array(row["numbers"], np.int64), np.array(row["at"], np.int64)
                _, score = exact_scores(row["rows"], docs, numbers, mine, n, total)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(score), row["q"], np.int64)), pa.array(numbers.astype(np.int32)), pa.array(score)], ["q", "number", "score"])

    scored = index.table.select("block", "rows").join(packed, "block").join(F.broadcast(queries), "q").mapInArrow(tidy(rescored), "q long, number int, score long")
    ranked = Window.partitionBy("q", "number").orderBy(F.desc("score"))
    reached = scored.withColumn("place", F.row_number().over(ranked)).where((F.col("place") == top) & (F.col("score") > 0))
    floors = reached.groupBy("q").agg(F.sort_array(F.collect_list(F.struct("number", "score"))).alias("f")).select("q", F.col("f.number").alias("floor_of"), F.col("f.score").alias("floor"))
    floored = index.cuts.save("floors", queries.join(floors, "q", "left"))

    def final(batches):
        met = {}
        for batch in batches:
            for row, mine in rows_with_queries(batch, met):
                floor = np.ones(mine.items)
                if row["floor_of"] is not None:
                    floor[np.array(row["floor_of"], np.int64)] = row["floor"]
                pairs = [(np.zeros(0, np.int64), np.zeros(0, np.int64))]
                for docs, bound in bounds_of(row, mine, n, total):
                    number, place = np.nonzero(bound >= floor[:, None])
                    pairs.append((docs[place].astype(np.int64), number))
                docs, number = (np.concatenate(x) for x in zip(*pairs, strict=True))
                if not len(docs):
                    continue
                ids, score = exact_scores(row["rows"], docs, number, mine, n, total)
                good = pa.array(np.flatnonzero(score >= floor[number]))
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(good), row["q"], np.int64)), pa.array(number.astype(np.int32)).take(good), ids.take(good), pa.array(score).take(good)], ["q", "number", "doc_id", "score"])

    return asked(index.table.select(*signed, "rows"), floored, blocks_asked).mapInArrow(tidy(final), "q long, number int, doc_id long, score long")
