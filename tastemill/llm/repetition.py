"""Quality rules on repetition, from suffix arrays of words.

The suffix array of every text is built by prefix doubling on its words, for many texts at once:
a text's words get ranks of their own, so suffixes of different texts never share a prefix, and
only suffixes that are still tied are sorted again. Ranks of all doubling steps give the longest
common prefix of neighbours. A suffix's longest repeat is the larger one of its two neighbours';
these intervals hold every maximal repeated substring, and their union is what a text repeats.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from tastemill.llm.shared import ready, text_bytes, with_rows
from tastemill.llm.words import Texts, mix, slices, tidy

_U = np.uint64
SYMBOLS = np.zeros(256, bool)
SYMBOLS[list(b"#*$%&|<>")] = True


@dataclass(frozen=True)
class RepetitionRules:
    """Limits of the verdict, on whole texts."""

    least_words: int = 50
    most_window_percent: int = 50  # words in repeated 3-word windows
    repeat_words: int = 8  # a repeat of fewer words doesn't count as one
    most_covered_percent: int = 40  # words covered by repeats
    longest_repeat_percent: int = 30  # the longest repeat, of the text's words
    most_symbols_percent: int = 10  # symbols, of the words


def doubled_ranks(words: np.ndarray) -> list[np.ndarray]:
    """Ranks of all positions by their first 1, 2, 4 ... entries; the last ones are all distinct.

    ``words`` are numbers that no two texts share, texts lying one after another. ``ends`` need
    not be known: past a text's end the next text's numbers follow, which are equal in no two
    places of one text, so the order of suffixes stays total.
    """
    n = len(words)
    order = np.argsort(words, kind="stable")
    ordered = words[order]
    fresh = np.ones(n, bool)
    fresh[1:] = ordered[1:] != ordered[:-1]
    rank = np.empty(n, np.int64)
    first = np.flatnonzero(fresh)
    rank[order] = np.repeat(first, np.diff(np.append(first, n)))
    tied = order[_tied(fresh)]
    levels, step = [rank], 1
    while len(tied):
        rank = rank.copy()
        behind = tied + step
        second = np.where(behind < n, levels[-1][np.minimum(behind, n - 1)] + 1, 0)
        key = levels[-1][tied] * (n + 1) + second
        by = np.argsort(key, kind="stable")
        tied, key = tied[by], key[by]
        group = key // (n + 1)
        fresh, head = np.ones(len(tied), bool), np.ones(len(tied), bool)
        fresh[1:] = key[1:] != key[:-1]
        head[1:] = group[1:] != group[:-1]
        at = np.arange(len(tied))
        start = np.maximum.accumulate(np.where(head, at, 0))
        first = np.maximum.accumulate(np.where(fresh, at, 0))
        rank[tied] = group + first - start
        levels.append(rank)
        tied = tied[_tied(fresh)]
        step *= 2
    return levels


def _tied(fresh: np.ndarray) -> np.ndarray:
    """Of sorted entries, those with an equal one beside them; ``fresh`` marks firsts."""
    alone = fresh.copy()
    alone[:-1] &= fresh[1:]
    return ~alone


def longest_repeats(levels: list[np.ndarray]) -> np.ndarray:
    """For every position the length of the longest prefix of its suffix that occurs elsewhere."""
    n = len(levels[0])
    longest = np.zeros(n, np.int64)
    if n < 2:
        return longest
    array = np.empty(n, np.int64)
    array[levels[-1]] = np.arange(n)
    same = np.flatnonzero(levels[0][array[1:]] == levels[0][array[:-1]])
    left, right = array[same], array[same + 1]
    common = np.zeros(len(same), np.int64)
    for k in range(len(levels) - 1, -1, -1):
        level = np.append(levels[k], -1)
        i, j = left + common, right + common
        equal = level[np.minimum(i, n)] == level[np.minimum(j, n)]
        equal &= (i < n) & (j < n)
        common += equal << k
    np.maximum.at(longest, left, common)
    np.maximum.at(longest, right, common)
    return longest


def covered(lengths: np.ndarray) -> np.ndarray:
    """Which positions lie in the union of [p, p + lengths[p])."""
    n = len(lengths)
    reach = np.maximum.accumulate(np.arange(n) + lengths) if n else lengths
    return reach > np.arange(n)


def measure(part: Texts) -> dict[str, np.ndarray]:
    """Counts of each text in a slice."""
    part.find_words()
    h, text_of = part.word_hashes(), part.text_of_word()
    own = mix(h + (text_of.astype(_U) + _U(1)) * _U(0x9E3779B97F4A7C15))
    levels = doubled_ranks(own)
    longest = longest_repeats(levels)
    bounds = part.words

    def sums(per_word: np.ndarray) -> np.ndarray:
        total = np.concatenate(([0], np.cumsum(per_word, dtype=np.int64)))
        return total[bounds[1:]] - total[bounds[:-1]]

    most = np.zeros(part.count, np.int64)
    np.maximum.at(most, text_of, longest)
    out = {
        "n_words": np.diff(bounds),
        "word_chars": part.per_text(part.inside & ((part.data & 0xC0) != 0x80)),
        "n_symbols": part.per_text(SYMBOLS[part.data]),
        "n_repeat_words": sums(covered(np.where(longest >= 3, 3, 0))),
        "longest_repeat": most,
    }
    # lines: cut at line feeds and at the texts' ends
    feeds = np.flatnonzero(part.data == 0x0A)
    starts = np.unique(np.concatenate((part.bounds[:-1], feeds + 1)))
    text_of_line = np.searchsorted(part.bounds, starts, side="right") - 1
    inside = (text_of_line < part.count) & (starts < len(part.data))
    starts, text_of_line = starts[inside], text_of_line[inside]
    ends = part.bounds[text_of_line + 1].copy()
    ends[:-1] = np.minimum(ends[:-1], np.maximum(starts[1:] - 1, starts[:-1]))
    # a line that ends at a feed stops before it; the last one of a text runs to its end
    last = np.ones(len(starts), bool)
    last[:-1] = text_of_line[1:] != text_of_line[:-1]
    ends[last] = part.bounds[text_of_line[last] + 1]
    trailing = last & (ends > starts) & (part.data[np.maximum(ends - 1, 0)] == 0x0A)
    ends[trailing] -= 1
    worded = np.searchsorted(part.starts, starts) < np.searchsorted(part.starts, ends)
    lines = mix(part.hashes(starts[worded], ends[worded]) + (text_of_line[worded].astype(_U) + _U(1)) * _U(0xD1342543DE82EF95))
    _, first = np.unique(lines, return_index=True)
    again = np.ones(len(lines), bool)
    again[first] = False
    out["n_dup_lines"] = np.bincount(text_of_line[worded][again], minlength=part.count)
    out["_longest"], out["_sums"] = longest, sums
    return out


FIELDS = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, n_covered_words long, longest_repeat long, base_failed boolean, kept boolean"


def judge(docs: DataFrame, rules: RepetitionRules = RepetitionRules(), carry: bool = False) -> DataFrame:
    """Counts and verdict of every row of ``docs`` (doc_id, text), by its whole text.

    n_covered_words: words in the union of all repeats of ``repeat_words`` or more words;
    longest_repeat: words of the longest repeat. With ``carry`` also text (bytes) and row (a struct
    of all other columns). A null or empty text has no words and fails.
    Rows that repeat are judged each; a null doc_id stays null; other columns are ignored.
    """
    ready(docs.sparkSession)
    rows = with_rows(docs) if carry else text_bytes(docs)
    schema = T.StructType([*T._parse_datatype_string(FIELDS), *(rows.schema[1:] if carry else ())])

    def run(batches):
        for batch in batches:
            for part in slices(batch.column(1)):
                m = measure(part)
                longest = m.pop("_longest")
                n, m["n_covered_words"] = m["n_words"], m.pop("_sums")(covered(np.where(longest >= rules.repeat_words, longest, 0)))
                base = (n < rules.least_words) | (100 * m["n_repeat_words"] > rules.most_window_percent * n)
                bad = 100 * m["n_covered_words"] > rules.most_covered_percent * n
                bad |= (m["longest_repeat"] >= rules.repeat_words) & (100 * m["longest_repeat"] > rules.longest_repeat_percent * n)
                bad |= 100 * m["n_symbols"] > rules.most_symbols_percent * n
                m["base_failed"], m["kept"] = base, ~(base | bad)
                names = [f.split()[0] for f in FIELDS.split(", ")][1:]
                columns = [pa.array(m[c], pa.bool_() if c in ("base_failed", "kept") else pa.int64()) for c in names]
                some = batch.slice(part.first, part.count)
                yield pa.RecordBatch.from_arrays([some.column(0), *columns, *(some.columns[1:] if carry else ())], schema.names)

    return rows.mapInArrow(tidy(run), schema)
