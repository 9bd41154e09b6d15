"""Near-duplicate groups and repeated passages against brute force."""

from __future__ import annotations

import re
from collections import Counter

import pytest

from tastemill.llm import anchors, minhash

WORD = re.compile(r"[^ \t-\r]+")


def lowered(text):
    return [re.sub("[A-Z]", lambda m: m[0].lower(), w) for w in WORD.findall(text or "")]


def shingles(text, size):
    w = lowered(text)
    if len(w) < size:
        return frozenset([tuple(w)] if w else [])
    return frozenset(tuple(w[i : i + size]) for i in range(len(w) - size + 1))


def brute_groups(rows, size, percent):
    sets = {}
    for i, t in rows:
        sets[i] = shingles(t, size)
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in sets:
        for b in sets:
            if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {i: (len(s), find(i)) for i, s in sets.items()}


@pytest.mark.parametrize("size", [4, 5])
def test_groups_match_brute_force(spark, docs, size):
    rows = [(r["doc_id"], r["text"]) for r in docs.collect() if r["doc_id"] is not None]
    expected = brute_groups(rows, size, 80)
    got = minhash.groups(docs, size).collect()
    assert len(got) == docs.count()
    for r in got:
        if r["doc_id"] is None:
            assert r["component_id"] is None and r["kept"]
            continue
        assert (r["n_shingles"], r["component_id"]) == expected[r["doc_id"]]
        assert r["kept"] == (r["component_id"] == r["doc_id"])
    assert max(Counter(r["component_id"] for r in got).values()) > 2


def test_groups_of_a_dense_cluster(spark):
    """Many texts around one centre, some of them linked only through others; tiles of several sizes."""
    import random

    rng = random.Random(3)
    base = [f"b{i}" for i in range(100)]
    rows = []
    for i in range(120):
        words = list(base)
        for _ in range(rng.choice([0, 1, 2, 3, 4, 6, 8])):
            words[rng.randrange(100)] = f"x{rng.random()}"
        rows.append((i, " ".join(words)))
    expected = brute_groups(rows, 4, 80)
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    before, minhash.TILE = minhash.TILE, 16
    try:
        got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in minhash.groups(frame).collect()}
    finally:
        minhash.TILE = before
    assert got == expected
    assert len({c for _, c in expected.values()}) > 1


def test_estimate_is_corrected_for_chance():
    import numpy as np

    rng = np.random.default_rng(0)
    bits = rng.integers(0, 1 << 62, (2, minhash.LONGS)).astype(np.uint64)
    side = lambda x, c: {"c": np.array([c]), "outside": np.array([True]), "doc_id": np.array([c]), "n": np.array([9]), "bits": x[None, :], "bands": np.zeros((1, minhash.BANDS), np.uint64)}
    assert len(minhash.meet(side(bits[0], 1), side(bits[1], 2), 0, 80)[0]) == 0
    assert len(minhash.meet(side(bits[0], 1), side(bits[0], 2), 0, 80)[0]) == 1


def test_a_tile_of_near_copies_is_met_in_little_memory():
    import tracemalloc

    import numpy as np

    n, key = minhash.TILE, 7
    side = {"doc_id": np.arange(n), "c": np.arange(n), "n": np.full(n, 50), "outside": np.ones(n, bool),
            "bits": np.zeros((n, minhash.LONGS), np.uint64), "bands": np.full((n, minhash.BANDS), key, np.uint64)}
    tracemalloc.start()
    i, j = minhash.meet(side, side, key, 80)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert list(zip(i, j)) == [(a, b) for a in range(n) for b in range(a + 1, n)]
    assert peak < 32 << 20


def brute_strip(rows, window):
    first = {}
    for i, t in rows:
        w = WORD.findall(t or "")
        for k in range(len(w) - window + 1):
            key = tuple(w[k : k + window])
            first[key] = min(first.get(key, i), i)
    out = {}
    for i, t in rows:
        w = WORD.findall(t or "")
        keep = [True] * len(w)
        for k in range(len(w) - window + 1):
            if first[tuple(w[k : k + window])] < i:
                keep[k : k + window] = [False] * window
        out[i] = (len(w), keep.count(False), " ".join(x for x, y in zip(w, keep, strict=True) if y))
    return out


@pytest.mark.parametrize("window", [13, 20])
def test_passages_match_brute_force(docs, window):
    rows = [(r["doc_id"] if r["doc_id"] is not None else 1 << 62, r["text"]) for r in docs.collect()]
    expected = brute_strip(rows, window)
    got = anchors.strip_repeats(docs, window).collect()
    assert len(got) == len(rows)
    for r in got:
        assert (r["n_words"], r["n_removed"], r["kept_text"]) == expected[r["doc_id"] if r["doc_id"] is not None else 1 << 62]
    assert any(r["n_removed"] for r in got)


def test_layout_stays_where_nothing_goes(docs):
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    for r in anchors.strip_repeats(docs, keep_layout=True).collect():
        if r["n_removed"] == 0:
            assert r["kept_text"] == texts[r["doc_id"]]
        assert r["row"]["block"] == 3


def test_cover_meets_every_pair_of_places():
    cover = set(anchors.COVER)
    for i in range(anchors.PERIOD):
        for j in range(anchors.PERIOD):
            assert any((i + d) % anchors.PERIOD in cover and (j + d) % anchors.PERIOD in cover for d in range(anchors.PERIOD))


def test_empty_tables(none):
    assert minhash.groups(none).collect() == []
    assert anchors.strip_repeats(none).collect() == []
