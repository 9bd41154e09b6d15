"""Language identification by cross-parsing.

A suffix automaton of a bounded sample of labelled text stands for each language. A text is parsed
greedily into the longest phrases that occur in the sample; the language that needs the fewest
phrases, normalised by the sample's size, wins. Automata are completed into tables whose entries
also say how many phrases end, so one gather advances a text by one byte under a language, and
many pieces of texts advance together.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tastemill.llm.shared import ready
from tastemill.llm.words import slices

SAMPLED_DOCS = 48
SAMPLED_CHARS = 400
SAMPLED_WINDOW = 100
# Bytes of the samples of all languages together. Automata have at most two states a byte and tables at
# most 157 symbols, so entries stay below 2 * 157 * 4 * MAX_BYTES < 2^31 and tables below 330 MB.
MAX_BYTES = 1 << 18
SEGMENT = 384
BREAK, UNSEEN, PAD = 0, 1, 2


def suffix_automaton(text: bytes) -> list[dict[int, int]]:
    """Transitions of the smallest automaton that accepts every substring of the text."""
    step: list[dict[int, int]] = [{}]
    link, length, last = [-1], [0], 0
    for c in text:
        new = len(step)
        step.append({})
        length.append(length[last] + 1)
        link.append(0)
        p = last
        while p >= 0 and c not in step[p]:
            step[p][c] = new
            p = link[p]
        if p >= 0:
            q = step[p][c]
            if length[p] + 1 == length[q]:
                link[new] = q
            else:
                twin = len(step)
                step.append(dict(step[q]))
                length.append(length[p] + 1)
                link.append(link[q])
                while p >= 0 and step[p].get(c) == q:
                    step[p][c] = twin
                    p = link[p]
                link[q] = link[new] = twin
        last = new
    return step


def bounded(samples: dict[str, list[bytes]], most: int = MAX_BYTES) -> dict[str, list[bytes]]:
    """The samples with at most ``most`` bytes together. Where they have more, every language gets the
    same allowance, and what small ones leave goes to the others; each passage gives an equal part."""
    left, out = most, {}
    for n, k in enumerate(sorted(samples, key=lambda k: (sum(map(len, samples[k])) + len(samples[k]), k))):
        some = samples[k]
        allowed = left // (len(samples) - n)
        if sum(map(len, some)) + len(some) > allowed:
            # a passage and the break after it; a few passages where there isn't room for all
            some = some[:: max(1, -(-len(some) * 16 // max(allowed, 1)))]
            each = max(0, allowed // len(some) - 1)
            some = [t[:each].decode(errors="ignore").encode() for t in some]
        out[k] = some
        left -= min(allowed, sum(map(len, some)) + len(some))
    return out


class Parser:
    """Automata of all languages in one table; symbols are classes of lower-cased bytes."""

    def __init__(self, samples: dict[str, list[str]]):
        self.languages = sorted(samples)
        raw = {k: b"\n".join(some) for k, some in bounded({k: [t.lower().encode() for t in samples[k]] for k in self.languages}).items()}
        letters = np.zeros(256, bool)
        letters[97:123] = True
        letters[128:] = True
        seen = np.zeros(256, bool)
        for text in raw.values():
            seen[np.frombuffer(text, np.uint8)] = True
        self.classes = np.zeros(256, np.uint8)
        known = np.flatnonzero(letters & seen)
        self.classes[known] = 3 + np.arange(len(known))
        self.classes[letters & ~seen] = UNSEEN
        self.width = 3 + len(known)
        tables, roots, base = [], [], 0
        self.cost = []
        for k in self.languages:
            text = self.symbols(np.frombuffer(raw[k], np.uint8))[0].tobytes()
            steps = suffix_automaton(text)
            table = np.zeros((len(steps), self.width), np.int32)
            root = np.zeros(self.width, np.int64)
            if (base + len(steps)) * self.width * 4 > np.iinfo(np.int32).max:
                raise ValueError("the samples of all languages pass the bound of the tables")
            for c, to in steps[0].items():
                root[c] = to
            lone = root == 0
            # a missing step ends the phrase; the symbol starts the next, or is one of its own
            table[:] = (base + root) * self.width * 4 + np.where(lone, 2, 1)
            table[0] = (base + root) * self.width * 4 + np.where(lone, 1, 0)
            for s, out in enumerate(steps):
                for c, to in out.items():
                    table[s, c] = (base + to) * self.width * 4
                table[s, PAD] = (base + s) * self.width * 4
            tables.append(table)
            roots.append(base * self.width)
            self.cost.append(math.log2(max(2, len(text))))
            base += len(steps)
        self.table = np.concatenate(tables).ravel() if tables else np.zeros(0, np.int32)
        self.roots = np.array(roots, np.int64)

    def symbols(self, data: np.ndarray, bounds: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Classes of the bytes with runs of breaks made one, and the bounds among them."""
        classes = self.classes[data]
        keep = np.ones(len(classes), bool)
        keep[1:] = (classes[1:] != BREAK) | (classes[:-1] != BREAK)
        if bounds is None:
            return classes[keep], np.zeros(0, np.int64)
        keep[bounds[:-1][bounds[:-1] < len(keep)]] = True
        return classes[keep], np.concatenate(([0], np.cumsum(keep)))[bounds]

    def phrases(self, data: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        """Phrases of every text under every language; a phrase stays inside a segment."""
        symbols, at = self.symbols(data, bounds)
        sizes = np.diff(at)
        lanes_of = -(-sizes // SEGMENT)
        text_of = np.repeat(np.arange(len(sizes)), lanes_of)
        nth = np.arange(len(text_of)) - np.repeat(np.cumsum(lanes_of) - lanes_of, lanes_of)
        begins = at[text_of] + nth * SEGMENT
        long = np.minimum(SEGMENT, at[text_of + 1] - begins) if len(text_of) else np.zeros(0, np.int64)
        order = np.argsort(-long, kind="stable")
        begins, long = begins[order], long[order]
        state = np.tile(self.roots, (len(order), 1))
        count = np.zeros(state.shape, np.int32)
        active = np.searchsorted(-long, -np.arange(SEGMENT), side="left")  # lanes longer than the step
        for t in range(int(long[0]) if len(long) else 0):
            n = active[t]
            got = self.table.take(state[:n] + symbols[begins[:n] + t].astype(np.int64)[:, None])
            count[:n] += got & 3
            state[:n] = got >> 2
        count += state != self.roots
        out = np.zeros((len(sizes), len(self.languages)), np.int64)
        np.add.at(out, text_of[order], count)
        return out


def passages(text: Column, seed: Column, chars: int, size: int = SAMPLED_WINDOW) -> Column:
    """The whole text where it has at most ``chars`` code points; of a longer one windows that have so
    many together, one at a hashed place in each of as many equal stretches of the whole text."""
    size = min(size, chars)
    n, stretches = F.char_length(text), chars // size
    wide = F.floor(n / stretches)

    def window(i: Column) -> Column:
        return F.substr(text, (1 + i * wide + F.pmod(F.xxhash64(seed, i), wide - size + 1)).cast("int"), F.lit(size))

    return F.when(n <= chars, F.array(text)).otherwise(F.transform(F.sequence(F.lit(0), F.lit(stretches - 1)), window))


def learn(docs: DataFrame, wanted: Column, sampled_docs: int = SAMPLED_DOCS, sampled_chars: int = SAMPLED_CHARS) -> Parser:
    """Automata from at most ``sampled_docs`` labelled documents with a letter a language, and of each
    at most ``sampled_chars`` code points from all over its text. The documents are those with the
    smallest hashes of their ids, so the choice is the same whatever the partitions."""
    spark = ready(docs.sparkSession)
    lettered = docs.where(wanted & F.col("lang").isNotNull() & F.col("doc_id").isNotNull() & F.col("text").rlike(r"\p{L}")).select("lang", "doc_id", "text")
    order = Window.partitionBy("lang").orderBy(F.xxhash64("doc_id"), "doc_id")
    ranked = lettered.select("lang", "doc_id").distinct().withColumn("_n", F.row_number().over(order))
    chosen = ranked.where(F.col("_n") <= sampled_docs).select("lang", "doc_id")
    # bounded by the sample
    chosen = spark.createDataFrame(chosen.collect(), chosen.schema)
    texts = lettered.join(F.broadcast(chosen), ["lang", "doc_id"]).select("lang", "doc_id", passages(F.col("text"), F.col("doc_id"), sampled_chars).alias("t"))
    rows = texts.groupBy("lang", "doc_id").agg(F.min("t").alias("t")).collect()
    samples: dict[str, list[str]] = {}
    for r in sorted(rows, key=lambda r: (r["lang"], r["doc_id"])):
        samples.setdefault(r["lang"], []).extend(r["t"])
    return Parser(samples)


def predict(docs: DataFrame, parser: Parser) -> DataFrame:
    """doc_id, lang_pred, score of every row, from its whole text alone.

    ``und`` with score 0 where the text is null, has no letter, or nothing was learned. Ties go to
    the language that sorts first. The score is the share of the runner-up in the two best phrase
    counts, rescaled to 0 to 1. Rows that repeat are judged each; other columns are ignored.
    """
    spark = ready(docs.sparkSession)
    shared = spark.sparkContext.broadcast(parser)  # bounded by the sample

    def run(batches):
        model = shared.value
        names = np.array([*model.languages, "und"], object)
        for batch in batches:
            text = batch.column(1).fill_null("")
            lettered = pc.match_substring_regex(text, r"\p{L}").to_numpy(zero_copy_only=False).astype(bool)
            lowered = pc.utf8_lower(text)
            best, score = np.full(len(text), len(model.languages)), np.zeros(len(text))
            for part in slices(lowered) if model.languages else ():
                bits = model.phrases(part.data, part.bounds) * np.array(model.cost)
                rows = slice(part.first, part.first + part.count)
                best[rows] = bits.argmin(axis=1)
                two = np.sort(bits, axis=1)[:, :2]
                score[rows] = 1 - two[:, 0] / np.maximum(two[:, -1], 1e-9) if two.shape[1] > 1 else 1.0
            best[~lettered], score[~lettered] = len(model.languages), 0.0
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(names[best], pa.string()), pa.array(np.clip(score, 0, 1))], ["doc_id", "lang_pred", "score"])

    narrow = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return narrow.mapInArrow(run, "doc_id long, lang_pred string, score double")
