"""Phrase collocations by SON partitioning.

The corpus is cut into shards of some megabytes. Each shard is mined completely at a support
lowered to its share of the language's words: a phrase that reaches the global support reaches the
lowered one in some shard. The union of what is frequent somewhere are the candidates, and these
are counted over all shards exactly, by their words and not by a hash. This is done level by level,
words, then pairs, then triples; a shard skips a phrase unless both phrases one word shorter are
frequent, by a bitmap of bounded size that has every frequent phrase and may have others too.

The more shards a language has, the lower its local support, down to one; then no shard leaves
anything out and the union's counts are the global ones. For languages of which some shard may leave
a phrase out, their shards are counted once more, for the candidates only.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tastemill.llm.exchange import blocks, open_block
from tastemill.llm.shared import Cuts, ready, shuffles_once
from tastemill.llm.words import Texts, column_bytes, mix, tidy, windows

_U = np.uint64
SHARD_BYTES = 2 << 20
ROWS_AT_ONCE = 1 << 16
FILTER_BITS = 27  # at most 16 MB, whatever the number of frequent phrases
HARD = np.zeros(256, bool)
HARD[[ord(c) for c in ".,;:!?\n\x0b\x0c\r"]] = True
BETWEEN = HARD.copy()
BETWEEN[[0x20, 0x09]] = True
UNKNOWN = "und"
SHARES = 8


class Shard:
    """The words of a shard's texts: hashes, which piece each stands in, which language it has."""

    def __init__(self, rows: bytes):
        batch = open_block(rows)
        langs = batch.column(0).dictionary_encode()
        self.langs = langs.dictionary
        # a line break after every text, so that no phrase runs over its end
        closed = pc.binary_join_element_wise(pc.fill_null(batch.column(1), b""), pa.scalar(b""), pa.scalar(b"\n"))
        data, bounds = column_bytes(closed)
        self.part = part = Texts(data[bounds[0] : bounds[-1]], bounds - bounds[0], 0, fold=True)
        inside = ~BETWEEN[part.data]
        turns = np.flatnonzero(np.diff(inside, prepend=False, append=False))
        self.starts, self.ends = turns[::2], turns[1::2]
        self.piece = np.cumsum(HARD[part.data], dtype=np.int32)[self.starts]
        of_text = langs.indices.to_numpy(zero_copy_only=False).astype(np.int32)
        self.lang = np.repeat(of_text, np.diff(np.searchsorted(self.starts, part.bounds)))
        self.size = np.bincount(self.lang, minlength=len(self.langs))
        self.names = hashes_of(self.langs)
        self.hashes = []
        for which in (0, 1):
            self.hashes.append(part.hashes(self.starts, self.ends, which))
            part.forget()
        self.plain = None

    def keys(self, length: int, which: int = 0) -> np.ndarray:
        """A hash of the language and the ``length`` words from each word on."""
        keys = windows(self.hashes[which], length, which)
        return mix(keys ^ self.names[self.lang[: len(keys)]])

    def count(self, length: int, known: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
        """First word and occurrences of every distinct phrase within a piece."""
        n = len(self.starts) - length + 1
        if n <= 0:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        good = self.piece[:n] == self.piece[length - 1 :]
        if known is not None:
            shorter = held(known, self.keys(length - 1))
            good &= shorter[:n] & shorter[1 : n + 1]
        at = np.flatnonzero(good)
        first, second = self.keys(length)[at], self.keys(length, 1)[at]
        by = np.argsort(first, kind="stable")
        first, second = first[by], second[by]
        same = first[1:] == first[:-1]
        if (second[1:] != second[:-1])[same].any():  # two phrases share a hash
            again = np.lexsort((second, first))
            by, first, second = by[again], first[again], second[again]
        heads = np.flatnonzero(np.append(True, (first[1:] != first[:-1]) | (second[1:] != second[:-1]))[: len(first)])
        return at[by[heads]], np.diff(heads, append=len(first))

    def phrases(self, at: np.ndarray, length: int) -> pa.Array:
        """The phrases that begin at these words, their words joined by one space."""
        if self.plain is None:
            inside = ~BETWEEN[self.part.data]
            inside[self.ends] = True
            spaced = self.part.data.copy()
            spaced[self.ends] = 0x20
            self.plain = spaced[inside]
            self.begins = np.concatenate(([0], np.cumsum(self.ends - self.starts + 1)))
        sizes = self.begins[at + length] - self.begins[at] - 1
        bounds = np.concatenate(([0], np.cumsum(sizes)))
        raw = self.plain[np.repeat(self.begins[at] - bounds[:-1], sizes) + np.arange(bounds[-1])]
        return pa.Array.from_buffers(pa.binary(), len(at), [None, pa.py_buffer(bounds.astype(np.int32)), pa.py_buffer(raw)]).cast(pa.string())


def hashes_of(strings: pa.Array) -> np.ndarray:
    data, bounds = column_bytes(strings.cast(pa.binary()))
    part = Texts(data[bounds[0] : bounds[-1]], bounds - bounds[0], 0)
    return part.hashes(part.bounds[:-1], part.bounds[1:])


def held(known: np.ndarray, keys: np.ndarray) -> np.ndarray:
    at = keys & _U(len(known) * 8 - 1)
    return known[(at >> _U(3)).astype(np.int64)] >> (at & _U(7)).astype(np.uint8) & 1 > 0


def mine(shards: DataFrame, length: int, known: Broadcast | None) -> DataFrame:
    """(lang, phrase, n, size): counts of every shard, with its number of words in that language."""

    def run(batches):
        bits = None if known is None else np.frombuffer(known.value, np.uint8)
        for batch in batches:
            for row in range(batch.num_rows):
                shard = Shard(batch.column(0)[row].as_py())
                at, n = shard.count(length, bits)
                for i in range(0, len(at), ROWS_AT_ONCE):
                    some, codes = at[i : i + ROWS_AT_ONCE], shard.lang[at[i : i + ROWS_AT_ONCE]]
                    yield pa.RecordBatch.from_arrays(
                        [shard.langs.take(pa.array(codes)), shard.phrases(some, length), pa.array(n[i : i + ROWS_AT_ONCE]), pa.array(shard.size[codes])],
                        ["lang", "phrase", "n", "size"])

    return shards.select("rows").mapInArrow(tidy(run), "lang string, phrase string, n long, size long")


def shard_sizes(shards: DataFrame) -> DataFrame:
    """(block, lang, size): words of every shard in each of its languages."""

    def run(batches):
        for batch in batches:
            for row in range(batch.num_rows):
                shard = Shard(batch.column(1)[row].as_py())
                block = pa.array(np.full(len(shard.langs), batch.column(0)[row].as_py(), np.int64))
                yield pa.RecordBatch.from_arrays([block, shard.langs, pa.array(shard.size)], ["block", "lang", "size"])

    return shards.select("block", "rows").mapInArrow(tidy(run), "block long, lang string, size long")


@contextmanager
def bitmap(frequent: DataFrame, length: int) -> Iterator[Broadcast]:
    """A bit for the hash of every frequent phrase, sixteen bits a phrase up to a fixed size.

    Phrases only add bits, so none is missing; where they are too many for the size, more of the
    others pass, which costs rows and changes nothing."""
    spark = frequent.sparkSession
    width = min(FILTER_BITS, max(15, (frequent.count() * 16).bit_length()))

    def places(batches):
        for batch in batches:
            data, bounds = column_bytes(batch.column(1).cast(pa.binary()))
            part = Texts(data[bounds[0] : bounds[-1]], bounds - bounds[0], 0).find_words()
            keys = mix(windows(part.word_hashes(), length)[part.words[:-1]] ^ hashes_of(batch.column(0))) & _U((1 << width) - 1)
            yield pa.RecordBatch.from_arrays([pa.array((keys >> _U(15)).astype(np.int64)), pa.array((keys & _U(32767)).astype(np.int64))], ["page", "place"])

    rows = frequent.select("lang", "phrase").mapInArrow(places, "page long, place long")
    bits = np.zeros(1 << (width - 3), np.uint8)
    with shuffles_once(spark):
        for r in rows.groupBy("page").agg(F.bitmap_construct_agg("place").alias("bits")).collect():
            bits[r["page"] << 12 : (r["page"] + 1) << 12] = np.frombuffer(r["bits"], np.uint8)
    known = spark.sparkContext.broadcast(bits.tobytes())
    try:
        yield known
    finally:
        known.destroy()


def whole(column: str) -> Column:
    return F.col(column).cast("decimal(20,0)")


def frequent(cuts: Cuts, shards: DataFrame, loose: DataFrame | None, totals: DataFrame, length: int, min_count: int, known: Broadcast | None) -> DataFrame:
    """(lang, phrase, f): all phrases of ``length`` words found ``min_count`` times in their language.

    ``totals`` has every language's words and ``slack``, how many occurrences of a phrase the shards
    can leave out together; ``loose`` are the shards of languages with a slack. The local support is
    compared in doubles and a billionth too low, which only adds candidates.
    """
    local = mine(shards, length, known).join(totals, "lang").where(F.col("n") * F.col("total").cast("double") * (1 + 1e-9) >= F.col("size") * F.lit(float(min_count)))
    union = local.groupBy("lang", "phrase").agg(F.sum("n").alias("f")).join(totals, "lang").where(F.col("f") + F.col("slack") >= min_count)
    found = cuts.save(f"found{length}", union.select("lang", "phrase", "f", "slack"))
    counted = found.where(f"slack = 0 and f >= {min_count}").select("lang", "phrase", "f")
    if loose is None:
        return counted
    candidates, among = found.where("slack > 0").select("lang", "phrase"), totals.where("slack > 0").select("lang")
    rows = mine(loose, length, known).join(among, "lang").join(candidates, ["lang", "phrase"], "left_semi")
    again = cuts.save(f"again{length}", rows.groupBy("lang", "phrase").agg(F.sum("n").alias("f")).where(F.col("f") >= min_count))
    return counted.unionByName(again)


def all_frequent(cuts: Cuts, docs: DataFrame, min_count: int, longest: int) -> tuple[DataFrame, list[DataFrame]]:
    """Words of every language, and the frequent phrases of one word, two words and so on."""
    lang = F.coalesce(F.col("lang").cast("string"), F.lit(UNKNOWN)).alias("lang")
    shards = cuts.save("shards", blocks(docs.select(lang, F.col("text").cast("string").cast("binary").alias("text")), limit=SHARD_BYTES))
    sizes = cuts.save("sizes", shard_sizes(shards).where("size > 0"))
    of_lang = sizes.groupBy("lang").agg(F.sum("size").alias("total"))
    lowered = F.ceil(whole("size") * min_count / whole("total"))
    totals = cuts.save("totals", sizes.join(of_lang, "lang").groupBy("lang", "total").agg(F.sum(lowered - 1).cast("long").alias("slack")))
    loose = None
    if not totals.where("slack > 0").isEmpty():
        ids = sizes.join(totals.where("slack > 0"), "lang").select("block").distinct()
        loose = shards.join(ids, "block", "left_semi")
    levels = [frequent(cuts, shards, loose, totals, 1, min_count, None)]
    for length in range(2, longest + 1):
        with bitmap(levels[-1], length - 1) as known:
            levels.append(frequent(cuts, shards, loose, totals, length, min_count, known))
    cuts.drop("shards", "sizes")
    return totals.select("lang", F.col("total").alias("n")), levels


def weakest_cut(candidates: DataFrame, counts: DataFrame) -> DataFrame:
    """(lang, phrase, a, l, r, score) at the cut with the lowest score, the first of equal ones.

    Whole numbers throughout: the product of a million and two counts has room up to 10^15 each."""
    words = F.split("phrase", " ")
    cut = candidates.withColumn("k", F.explode(F.sequence(F.lit(1), F.size(words) - 1)))
    cut = cut.withColumn("left", F.array_join(F.slice(words, 1, F.col("k")), " ")).withColumn("right", F.array_join(F.slice(words, F.col("k") + 1, F.size(words)), " "))
    cut = cut.join(counts.select("lang", F.col("phrase").alias("left"), F.col("f").alias("l")), ["lang", "left"])
    cut = cut.join(counts.select("lang", F.col("phrase").alias("right"), F.col("f").alias("r")), ["lang", "right"])
    score = F.expr("cast(1000000 * cast(f as decimal(15,0)) * cast(f as decimal(15,0)) div (cast(l as decimal(15,0)) * cast(r as decimal(15,0))) as long)")
    return cut.groupBy("lang", "phrase", F.col("f").alias("a")).agg(F.min(F.struct(score.alias("score"), "k", "l", "r")).alias("c")).select("lang", "phrase", "a", "c.l", "c.r", "c.score")


def inner_share(candidates: DataFrame) -> DataFrame:
    """(lang, phrase, around): for phrases inside longer candidates, the largest count of these."""
    words = F.split("phrase", " ")
    inner = candidates.where(F.size(words) > 2).withColumn("k", F.explode(F.sequence(F.lit(2), F.size(words) - 1)))
    inner = inner.withColumn("at", F.explode(F.sequence(F.lit(1), F.size(words) - F.col("k") + 1)))
    return inner.groupBy("lang", F.array_join(F.slice(words, F.col("at"), F.col("k")), " ").alias("phrase")).agg(F.max("f").alias("around"))


def phrases(docs: DataFrame, min_count: int = 10, longest: int = 3, inside_percent: int = 50, top: int = 2000) -> DataFrame:
    """The best phrases of 2 to ``longest`` words of every language: lang, rank, phrase, a, l, r, n, score.

    Texts are lower-cased in A to Z, cut into pieces at ``.,;:!?`` and line ends and into words at
    spaces and tabs. A phrase needs ``min_count`` occurrences within pieces of its language; it is
    dropped if a longer candidate around it has ``inside_percent`` of its occurrences. A null lang is
    ``und``; a null or empty text has no words; repeated rows count each; a language without words
    and an empty table give no rows; doc_id and other columns are ignored. Equal scores go by count,
    then by the phrase's bytes.
    """
    cuts = Cuts(ready(docs.sparkSession), "phrases")
    totals, levels = all_frequent(cuts, docs, min_count, longest)
    counts, candidates = levels[0], levels[1]
    for level in levels[1:]:
        counts = counts.unionByName(level)
    for level in levels[2:]:
        candidates = candidates.unionByName(level)
    scored = weakest_cut(candidates, counts).join(inner_share(candidates), ["lang", "phrase"], "left")
    kept = scored.where(F.col("around").isNull() | (whole("around") * 100 < whole("a") * inside_percent))
    best_first = [F.desc("score"), F.desc("a"), "phrase"]
    # the best of each share first, so that the last step sees few rows of a language, however many tasks had them
    share = F.pmod(F.xxhash64("phrase"), F.lit(SHARES))
    some = kept.withColumn("share", share).withColumn("rank", F.row_number().over(Window.partitionBy("lang", "share").orderBy(*best_first))).where(F.col("rank") <= top)
    place = F.row_number().over(Window.partitionBy("lang").orderBy(*best_first))
    best = some.withColumn("rank", place).where(F.col("rank") <= top).join(totals, "lang")
    return best.select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")
