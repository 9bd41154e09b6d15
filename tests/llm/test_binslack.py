"""Minimum bin slack: combinations against exhaustive search, every id in one place."""

from __future__ import annotations

import itertools
import math
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
import regex
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from tastemill.llm import binslack, cutting
from tastemill.llm.queries import QUERIES

FILE = public_tokenizers.path("byte_bpe_50k.json")


@settings(max_examples=150, deadline=None)
@given(st.lists(st.integers(1, 20), max_size=9), st.integers(0, 40))
def test_combination_is_the_fullest(lengths, room):
    left = np.zeros(41, np.int64)
    for n in lengths:
        left[n] += 1
    chosen = binslack.fullest(left, np.flatnonzero(left)[::-1], room)
    assert all(n <= left[length] for length, n in chosen.items())
    sums = {sum(s) for k in range(len(lengths) + 1) for s in itertools.combinations(lengths, k)}
    assert sum(length * n for length, n in chosen.items()) == max(s for s in sums if s <= room)


@settings(max_examples=60, deadline=None)
@given(st.dictionaries(st.integers(1, 50), st.integers(1, 10**9), max_size=30))
def test_combinations_hold_all_pieces(counts):
    used = Counter()
    for chosen, times in binslack.fill(counts, 50):
        assert 0 < sum(length * n for length, n in chosen.items()) <= 50
        for length, n in chosen.items():
            used[length] += n * times
    assert used == Counter(counts)


def test_few_sequences_on_mixed_lengths():
    rng = np.random.default_rng(3)
    counts = Counter(np.minimum(2048, rng.lognormal(6, 1, 20_000).astype(int) + 1).tolist())
    patterns = binslack.fill(counts, 2048)
    need = math.ceil(sum(length * n for length, n in counts.items()) / 2048)
    assert sum(times for _, times in patterns) <= need * 1.001 + 1


def test_as_few_as_exact_search():
    """Small instances, the least number of bins by trying all assignments."""
    rng = np.random.default_rng(11)
    for _ in range(25):
        lengths = sorted(rng.integers(1, 11, 7).tolist(), reverse=True)

        def least(rest, bins):
            if not rest:
                return len(bins)
            tries = [least(rest[1:], [*bins[:i], b + rest[0], *bins[i + 1 :]]) for i, b in enumerate(bins) if b + rest[0] <= 12]
            return min([*tries, least(rest[1:], [*bins, rest[0]])])

        got = sum(times for _, times in binslack.fill(Counter(lengths), 12))
        assert got <= least(lengths, []) + 1


@pytest.mark.parametrize("size", [2048, 64])
def test_every_id_has_one_place(spark, docs, size):
    special = spark.createDataFrame([(-5, "a <|endoftext|> b"), (-6, "word " * 700), (-7, "word " * (size - 2) + "word")], "doc_id long, text string")
    frame = docs.select("doc_id", "text").unionByName(special)
    tokenizer = Tokenizer.from_file(FILE)
    want = Counter()
    for r in frame.collect():
        ids = [*tokenizer.encode(r["text"] or "", add_special_tokens=False).ids, 0]
        first = len(ids) % size or size
        bounds = [0, *range(first, len(ids) + 1, size)]
        assert len(ids) > size or len(bounds) == 2
        for piece, (a, b) in enumerate(zip(bounds, bounds[1:])):
            want[r["doc_id"], piece, a, tuple(ids[a:b])] += 1
    rows = binslack.pack(frame, FILE, size=size, with_ids=True).collect()
    assert Counter((r["doc_id"], r["piece"], r["start"], tuple(r["ids"])) for r in rows) == want
    sequences = defaultdict(list)
    for r in rows:
        assert r["length"] == len(r["ids"]) and r["ids_crc32"] == zlib.crc32(np.array(r["ids"], "<u4").tobytes())
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
    for held in sequences.values():
        end = 0
        for offset, length in sorted(held):
            assert offset == end
            end += length
        assert end <= size
    assert len(sequences) <= best_fit([r["length"] for r in rows], size)


def best_fit(lengths: list[int], size: int) -> int:
    """Bins of best-fit decreasing, the usual yardstick."""
    room: list[int] = []
    for n in sorted(lengths, reverse=True):
        open_bins = [(free, i) for i, free in enumerate(room) if free >= n]
        if open_bins:
            room[min(open_bins)[1]] -= n
        else:
            room.append(size - n)
    return len(room)


def test_short_documents_leave_no_room(spark):
    frame = spark.range(5000, numPartitions=7).selectExpr("id AS doc_id", "repeat('a b ', int(id % 6)) AS text", "1 AS length", "2 AS part", "3 AS nth")
    rows = binslack.pack(frame, FILE).collect()
    assert len(rows) == 5000
    assert len({r["sequence_id"] for r in rows}) == math.ceil(sum(r["length"] for r in rows) / 2048)


def test_text_longer_than_a_batch(spark):
    frame = spark.createDataFrame([(1, "x y z " * 1_600_000), (2, "")], "doc_id long, text string")
    rows = binslack.pack(frame, FILE).collect()
    assert sum(r["length"] for r in rows if r["doc_id"] == 1) == rows_of(frame)
    assert [r["length"] for r in rows if r["doc_id"] == 2] == [1]


def rows_of(frame) -> int:
    text = frame.where("doc_id = 1").first()["text"]
    return len(Tokenizer.from_file(FILE).encode(text, add_special_tokens=False).ids) + 1


def test_empty_table(none):
    assert binslack.pack(none, FILE).collect() == []


def test_query_columns(spark, root):
    out = QUERIES["op11_minimum_bin_slack"](spark, root)
    assert out.columns == ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]
    assert dict(out.dtypes) | {"piece": "int"} == {c: "bigint" for c in out.columns} | {"piece": "int"}
    total = out.selectExpr("sum(length)").first()[0]
    assert out.select("sequence_id").distinct().count() <= math.ceil(total / 2048) + 1


def test_split_of_wide_texts_is_the_split_by_class_names():
    wide, named = cutting.wide_split(), regex.compile(cutting.SPLIT).findall
    for code in [*range(0xD800), *range(0xE000, 0x10000)]:
        c = chr(code)
        text = f"a{c}{c} {c}9 é{c}  {c}\n {c}'s"
        assert wide(text) == named(text), hex(code)
    pool = [chr(c) for c in [*range(0x250), *range(0x2000, 0x2070), 0x3000, 0xFEFF, 0x661, 0x2164]] + [" "] * 80 + list("'strevmld") * 5
    draw = random.Random(3)
    for _ in range(3000):
        text = "".join(draw.choices(pool, k=draw.randrange(60)))
        assert wide(text) == named(text), ascii(text)


def test_texts_choose_their_engine():
    coder = cutting._ids(FILE, cutting.SPLIT)
    assert coder.finder("plain") is coder.find_ascii
    assert coder.finder("naïve 中") is coder.find_wide
    assert coder.finder("\U0001d400 \U00020000") is coder.find
    texts = ["naïve café’s 中文 ٣", "\U0001d400b \U00020000c é", "", "﻿　 x"]
    assert [list(ids) for ids in coder.of(texts)] == [coder.tokenizer.encode(t, add_special_tokens=False).ids for t in texts]
