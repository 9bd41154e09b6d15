"""Packing token sequences as a cutting-stock problem.

Token lists are cut at multiples of the sequence length; the rests are the items. Their lengths,
rounded up to a class, form a histogram that is bounded whatever the corpus holds; as many short
pieces of one length as a class has ids make one item, which needs no rounding. Column generation
solves the linear program over patterns of classes: a knapsack dynamic program prices the next
pattern from the duals until the bound that the price gives is near. Patterns are rounded down,
what is left is filled first-fit, and the slots of all patterns are dealt to the pieces by rank.
Ranks are counted while texts are cut and shifted by a sum over partitions.
"""

from __future__ import annotations

import math
import re
import zlib
from array import array
from collections.abc import Callable, Iterable
from functools import lru_cache
from itertools import islice

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tastemill.llm.shared import Cuts, ready
from tastemill.llm.words import tidy

SHORT = 64  # pieces up to this length are put together before they are rounded
MAX_COLUMNS = 6000  # patterns tried at most; fewer mean more padding, never a lost piece
GAP = 0.0005  # share of sequences by which the linear program may miss its optimum
CACHE_BYTES = 64 << 20  # of pre-tokens and their ids
ENTRY_BYTES = 200  # of an entry besides its characters and ids
TEXTS_AT_ONCE = 2 << 20
# The split that a byte-level tokenizer file of this kind makes before its merges.
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
# The same split for texts of ASCII alone, where the standard library's engine is faster.
ASCII_SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?[A-Za-z]+| ?[0-9]+| ?[^\t-\r A-Za-z0-9]+|[\t-\r ]+(?![^\t-\r ])|[\t-\r ]+"


def wide_split() -> Callable[[str], list[str]]:
    """``SPLIT`` for texts of the first 65,536 code points, by the standard library's engine: its classes are
    bitmaps there. Letters, numbers and spaces are those of the engine that knows them by name."""
    every = "".join(map(chr, [*range(0xD800), *range(0xE000, 0x10000)]))

    def ranges(name: str) -> str:
        return "".join(f"{re.escape(run[0])}-{re.escape(run[-1])}" for run in regex.findall(f"{name}+", every) if run)

    letter, number, space = map(ranges, (r"\p{L}", r"\p{N}", r"\s"))
    # surrogates lie between the two parts of the range and are neither
    return re.compile(
        rf"'s|'t|'re|'ve|'m|'ll|'d| ?[{letter}]+| ?[{number}]+| ?[^{space}{letter}{number}]+|[{space}]+(?![^{space}])|[{space}]+").findall


def byte_letters() -> dict[int, str]:
    """The letter that stands for each byte in a byte-level vocabulary."""
    own = {*range(33, 127), *range(161, 173), *range(174, 256)}
    others = (b for b in range(256) if b not in own)
    return {b: chr(b) for b in own} | {b: chr(256 + i) for i, b in enumerate(others)}


def coder_of_pieces(tokenizer) -> Callable[[list[str]], Iterable[list[int]]]:
    """Ids of single pre-tokens. Where the file only maps bytes to letters before its merges, the
    merges are asked directly, which saves most of a call; otherwise the whole tokenizer is."""
    from tokenizers.models import BPE
    from tokenizers.pre_tokenizers import ByteLevel

    before, model = tokenizer.pre_tokenizer, tokenizer.model
    if not (tokenizer.normalizer is None and tokenizer.post_processor is None and isinstance(model, BPE) and type(before) is ByteLevel and not before.add_prefix_space):
        return lambda pieces: (e.ids for e in tokenizer.encode_batch_fast(pieces, add_special_tokens=False))
    letters = byte_letters()

    def lettered(piece: str) -> str:
        # of printable ASCII only the space has another letter
        if piece.isascii() and piece.isprintable():
            return piece.replace(" ", letters[32])
        return piece.encode().decode("latin-1").translate(letters)

    return lambda pieces: ([t.id for t in model.tokenize(lettered(piece))] for piece in pieces)


class Known(dict):
    """Ids of pre-tokens as bytes. A pre-token that is not known stands for itself and waits in
    ``asked`` to be encoded with others."""

    def __init__(self, tokenizer):
        super().__init__()
        self.code, self.asked, self.held = coder_of_pieces(tokenizer), [], 0

    def __missing__(self, piece: str) -> str:
        self.asked.append(piece)
        return piece

    def learn(self) -> None:
        pieces = list(set(self.asked))
        self.asked.clear()
        for at in range(0, len(pieces), 4096):
            some = pieces[at : at + 4096]
            for piece, coded in zip(some, self.code(some), strict=True):
                self[piece] = ids = array("I", coded).tobytes()
                self.held += ENTRY_BYTES + len(piece) + len(ids)

    def shrink(self) -> None:
        """Let the older half go once the entries pass their bound."""
        if self.held > CACHE_BYTES:
            for piece in list(islice(self, len(self) // 2)):
                self.held -= ENTRY_BYTES + len(piece) + len(self.pop(piece))


class Ids:
    """Ids of texts by a tokenizer file, each distinct pre-token encoded once while cached.

    A text that spells one of the file's added tokens goes through the tokenizer as a whole,
    because such tokens are found before the split.
    """

    def __init__(self, path: str, split: str | None):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.find = regex.compile(split).findall if split else None
        self.find_ascii = re.compile(ASCII_SPLIT).findall if split == SPLIT else self.find
        self.find_wide = wide_split() if split == SPLIT else self.find
        self.known = Known(self.tokenizer)

    def finder(self, text: str) -> Callable[[str], list[str]]:
        if text.isascii():
            return self.find_ascii
        # a code point beyond the first 65,536 takes two units
        return self.find_wide if len(text.encode("utf-16-le", "surrogatepass")) == 2 * len(text) else self.find

    def of(self, texts: list[str]) -> list[np.ndarray]:
        whole = [i for i, t in enumerate(texts) if self.find is None or any(a in t for a in self.added)]
        out: list[np.ndarray | None] = [None] * len(texts)
        for i, e in zip(whole, self.tokenizer.encode_batch_fast([texts[i] for i in whole], add_special_tokens=False), strict=True):
            out[i] = np.array(e.ids, np.uint32)
        self.known.shrink()
        known, waiting = self.known, []
        for i, text in enumerate(texts):
            if out[i] is None:
                before = len(known.asked)
                parts = list(map(known.__getitem__, self.finder(text)(text)))
                if len(known.asked) > before:
                    waiting.append((i, parts))
                else:
                    out[i] = np.frombuffer(b"".join(parts), np.uint32)
        known.learn()
        for i, parts in waiting:
            out[i] = np.frombuffer(b"".join([x if type(x) is bytes else known[x] for x in parts]), np.uint32)
        return out


@lru_cache(maxsize=2)
def _ids(path: str, split: str | None) -> Ids:
    return Ids(path, split)


def cut_pieces(docs: DataFrame, path: str, size: int = 1024, end_id: int = 0, split: str | None = SPLIT, with_ids: bool = False) -> DataFrame:
    """Pieces of at most ``size`` ids of every document (its ids, then ``end_id``), with their
    partition and their number among its pieces of that length."""
    ready(docs.sparkSession)
    fields = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, _part int, _nth long" + (", ids array<int>" if with_ids else "")

    def run(batches):
        from pyspark import TaskContext

        part, seen = TaskContext.get().partitionId(), [0] * (size + 1)
        coder = _ids(path, split)
        for batch in batches:
            docs_of, texts, at = batch.column(0).to_pylist(), batch.column(1).fill_null("").to_pylist(), 0
            while at < len(texts):
                end, chars = at, 0
                while end < len(texts) and (chars < TEXTS_AT_ONCE or end == at):
                    chars += len(texts[end])
                    end += 1
                rows: dict[str, list] = {k: [] for k in ("doc_id", "start", "length", "ids_crc32", "doc_tokens", "_part", "_nth", "ids")}
                for doc, ids in zip(docs_of[at:end], coder.of(texts[at:end]), strict=True):
                    ids = np.append(ids, np.uint32(end_id)).astype("<u4")
                    for start in range(0, len(ids), size):
                        piece = ids[start : start + size]
                        for k, v in zip(rows, (doc, start, len(piece), zlib.crc32(piece.tobytes()), len(ids), part, seen[len(piece)], piece.astype(np.int32) if with_ids else None), strict=True):
                            rows[k].append(v)
                        seen[len(piece)] += 1
                kinds = {"_part": pa.int32(), "ids": pa.list_(pa.int32())}
                names = [k for k in rows if with_ids or k != "ids"]
                yield pa.RecordBatch.from_arrays([pa.array(rows[k], kinds.get(k, pa.int64())) for k in names], names)
                at = end

    narrow = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return narrow.mapInArrow(tidy(run), fields)


def price(duals: np.ndarray, sizes: np.ndarray, room: int) -> tuple[float, np.ndarray]:
    """The best pattern for the duals: a knapsack over whole capacities."""
    value, took = np.zeros(room + 1), np.full(room + 1, -1)
    for c in range(1, room + 1):
        fit = int(np.searchsorted(sizes, c, side="right"))
        value[c] = value[c - 1]
        if fit:
            gains = duals[:fit] + value[c - sizes[:fit]]
            best = int(gains.argmax())
            if gains[best] > value[c] + 1e-12:
                value[c], took[c] = gains[best], best
    pattern, c = np.zeros(len(sizes), np.int64), room
    while c > 0:
        if took[c] < 0:
            c -= 1
        else:
            pattern[took[c]] += 1
            c -= sizes[took[c]]
    return float(value[room]), pattern


def solve_patterns(sizes: np.ndarray, demand: np.ndarray, room: int) -> list[tuple[np.ndarray, int]]:
    """Patterns (counts by class) and how often each is used; together they hold the demand exactly.

    A price w proves that no solution needs less than the present one divided by w, so columns are
    added until the best such bound is GAP away or nearer, or MAX_COLUMNS have been tried, which
    bounds the driver's time on histograms that are far from any pattern.
    """
    m = len(sizes)
    if m == 0:
        return []
    columns = [np.where(np.arange(m) == i, room // sizes[i], 0) for i in range(m)]
    inverse = np.diag([1.0 / c[i] for i, c in enumerate(columns)])
    amounts = inverse @ demand.astype(float)
    bound = float(sizes @ demand) / room
    for _ in range(MAX_COLUMNS):
        duals = inverse.sum(axis=0)
        worth, pattern = price(duals, sizes, room)
        bound = max(bound, amounts.sum() / max(worth, 1))
        if worth <= 1 + 1e-9 or amounts.sum() <= bound * (1 + GAP):
            break
        step = inverse @ pattern
        ratio = np.where(step > 1e-9, amounts / np.where(step > 1e-9, step, 1), np.inf)
        out = int(ratio.argmin())
        columns[out] = pattern
        amounts = np.maximum(amounts - ratio[out] * step, 0)
        amounts[out] = ratio[out]
        inverse[out] /= step[out]
        rest = step.copy()
        rest[out] = 0
        inverse -= np.outer(rest, inverse[out])
    used = [(np.asarray(c), int(np.floor(x + 1e-9))) for c, x in zip(columns, amounts, strict=True)]
    left, chosen = demand.astype(np.int64).copy(), []
    for c, n in used:
        held = int(min(n, (left[c > 0] // c[c > 0]).min()))
        if held > 0:
            chosen.append((c, held))
            left -= held * c
    # the rest is a few pieces for each pattern: fill bins largest first
    while left.sum():
        pattern, free = np.zeros(m, np.int64), room
        for i in range(m - 1, -1, -1):
            n = int(min(left[i], free // sizes[i]))
            pattern[i] += n
            free -= n * int(sizes[i])
        times = int((left[pattern > 0] // pattern[pattern > 0]).min())
        chosen.append((pattern, times))
        left -= times * pattern
    return chosen


def items_of(counts: dict[int, int], size: int, grain: int) -> tuple[list[tuple[int, ...]], dict[int, int]]:
    """What ranks of each length become, and how many items each class (in units of ``grain``) gets.

    Rows are (length, first rank, rank behind the last, pieces an item, class, first item).
    ``grain`` short pieces of a length fill a class of that many units to the last id.
    """
    rows, demand = [], {}
    for length, n in sorted(counts.items()):
        together = n // grain if length <= min(SHORT, size // grain) else 0
        for first, last, each, unit in ((0, together * grain, grain, length), (together * grain, n, 1, -(-length // grain))):
            if last > first:
                rows.append((length, first, last, each, unit, demand.get(unit, 0)))
                demand[unit] = demand.get(unit, 0) + (last - first) // each
    return rows, demand


def slots_of(demand: dict[int, int], room: int) -> list[tuple[int, ...]]:
    """Where the items of each class go: (class, first item, item behind the last, items a sequence, first sequence)."""
    classes = sorted(demand)
    slots, filled, sequence = [], {c: 0 for c in classes}, 0
    for pattern, times in solve_patterns(np.array(classes, np.int64), np.array([demand[c] for c in classes], np.int64), room):
        for i in np.flatnonzero(pattern):
            c, each = classes[i], int(pattern[i])
            slots.append((c, filled[c], filled[c] + each * times, each, sequence))
            filled[c] += each * times
        sequence += times
    return slots


def deal(cuts: Cuts, pieces: DataFrame, size: int = 1024, grain: int = 4) -> DataFrame:
    """Give every piece of ``cut_pieces`` a sequence and an offset."""
    spark, grain = pieces.sparkSession, math.gcd(size, grain)
    # a row for each partition and length
    held = cuts.save("held", pieces.groupBy("_part", "length").agg(F.count("*").alias("n")))
    # at most ``size`` lengths, whatever the corpus
    counts = {r["length"]: r["n"] for r in held.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    rows, demand = items_of(counts, size, grain)
    # at most two rows a length, and at most (size / grain) squared: patterns times classes of one
    items = spark.createDataFrame(rows, "_length long, _first long, _last long, _pieces long, _class long, _item long")
    where = spark.createDataFrame(slots_of(demand, size // grain), "_unit long, _from long, _to long, _each long, _sequence long")
    earlier = Window.partitionBy("length").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    before = held.select("_part", "length", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("_before"))
    ranked = pieces.join(before, ["_part", "length"]).withColumn("_rank", F.col("_before") + F.col("_nth"))
    known = ranked.join(F.broadcast(items), F.expr("length = _length AND _rank >= _first AND _rank < _last"))
    known = known.withColumn("_number", F.col("_item") + F.floor((F.col("_rank") - F.col("_first")) / F.col("_pieces")))
    placed = known.join(F.broadcast(where), F.expr("_class = _unit AND _number >= _from AND _number < _to"))
    placed = placed.withColumn("sequence_id", F.col("_sequence") + F.floor((F.col("_number") - F.col("_from")) / F.col("_each")))
    order = Window.partitionBy("sequence_id").orderBy(F.desc("_class"), "_number", "length", "_rank").rowsBetween(Window.unboundedPreceding, -1)
    placed = placed.withColumn("offset", F.coalesce(F.sum("length").over(order), F.lit(0)).cast("long"))
    return placed.select(*[c for c in pieces.columns if c[0] != "_"], F.col("sequence_id").cast("long").alias("sequence_id"), "offset")


def pack(docs: DataFrame, path: str, size: int = 1024, end_id: int = 0, grain: int = 4, split: str | None = SPLIT, with_ids: bool = False) -> DataFrame:
    """Pack all documents into sequences of at most ``size`` ids.

    Returns a row for each piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset,
    and ids with ``with_ids``. A null text is empty and becomes the end id alone; rows that repeat
    are packed each; an empty table gives no rows; other columns are ignored. ``split`` is the
    tokenizer's own split and only saves time; None leaves it to the tokenizer.
    """
    cuts = Cuts(docs.sparkSession, "packing")
    pieces = cuts.save("pieces", cut_pieces(docs, path, size, end_id, split, with_ids))
    return deal(cuts, pieces, size, grain)
