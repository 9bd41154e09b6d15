"""Ranked search over bit-sliced signatures against scoring every document."""

from __future__ import annotations

import math
import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from tastemill.llm import bitslices
from tastemill.llm.queries import QUERIES

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
FOLD = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def terms(text):
    return TERM.findall((text or "").translate(FOLD))


def brute(docs, items, top=50):
    """(item_id, rank, doc_id, score), every document scored for every item."""
    held = [(doc, Counter(terms(text))) for doc, text in docs]
    held = [(doc, tf, sum(tf.values())) for doc, tf in held if tf]
    total, df = sum(n for *_, n in held), Counter(t for _, tf, _ in held for t in tf)
    out = []
    for item, text in items:
        scored = []
        for doc, tf, n in held:
            m = 100 - 50 + 50 * n * len(held) // total
            score = sum(math.floor(1000 * math.log((2 * len(held) + 2) / (2 * df[t] + 1))) * (10**9 * tf[t] // (1000 * tf[t] + 20 * m)) for t in set(terms(text)) if t in tf)
            if score > 0:
                scored.append((-score, doc is None, doc or 0, doc))
        out += [(item, rank, doc, -score) for rank, (score, _, _, doc) in enumerate(sorted(scored)[:top], 1)]
    return sorted(out, key=repr)


def got(df):
    assert df.columns == ["item_id", "rank", "doc_id", "score"] and df.schema["rank"].dataType.simpleString() == "int"
    return sorted((tuple(r) for r in df.collect()), key=repr)


@pytest.fixture(scope="module")
def corpus():
    rng = random.Random(21)
    words = [f"w{i}" for i in range(300)] + ["Été", "ß1", "naïve", "X2"]
    weights = [1 / (i + 1) for i in range(len(words))]
    rows = [(i, " ".join(rng.choices(words, weights, k=int(rng.lognormvariate(3.5, 1.2)))).replace(" w7 ", "-w7, ")) for i in range(600)]
    rows += [(700 + i, rows[5][1]) for i in range(60)]  # ties beyond the 50th place
    return [*rows, (900, None), (901, ""), (902, " .,- "), (None, rows[9][1]), rows[9], (903, "w1 " * 20_000 + "rare")]


@pytest.fixture(scope="module")
def asked(corpus):
    rng = random.Random(4)
    items = [(i, " ".join(rng.sample((corpus[rng.randrange(500)][1] + " w0 w1 w2 w3").split(), 4))) for i in range(40)]
    return [*items, (50, corpus[5][1]), (51, None), (52, "..."), (53, "nowhere to be found"), (54, "rare RARE w299"), (55, "été X2"), (None, "w3 w3 w4"), (56, "w0")]


@pytest.fixture(scope="module")
def frames(spark, corpus, asked):
    docs = spark.createDataFrame([(d, t, "x", 1, 2, 3) for d, t in corpus], "doc_id long, text string, q string, block int, number int, score int").repartition(3)
    return docs, spark.createDataFrame([(i, t, 9, "y") for i, t in asked], "item_id long, text string, doc_id int, rank string").repartition(2)


@pytest.mark.parametrize("size", [1 << 11, 1 << 14, 1 << 22])
def test_as_scoring_everything(frames, corpus, asked, monkeypatch, size):
    monkeypatch.setattr(bitslices, "BLOCK_BYTES", size)
    docs, items = frames
    assert got(bitslices.search(bitslices.build(docs), items)) == brute(corpus, asked)


def test_blocks_of_queries_and_small_tables_of_bounds(frames, corpus, asked, monkeypatch):
    for name, value in {"BLOCK_BYTES": 4000, "ITEM_BYTES": 60, "BLOCKS_AT_ONCE": 3, "CELLS": 1, "PAIRS": 5, "HELD": 40}.items():
        monkeypatch.setattr(bitslices, name, value)
    docs, items = frames
    assert got(bitslices.search(bitslices.build(docs), items, top=7)) == brute(corpus, asked, top=7)


def index_row(texts):
    h, of = bitslices.terms_of(pa.array([t.encode() for t in texts], pa.binary()))
    length = np.bincount(of, minlength=len(texts)).astype(np.int64)
    of, term, tf = bitslices.grouped(h, of)
    most = np.zeros(len(texts), np.int64)
    np.maximum.at(most, of, tf)
    order, power, slices = bitslices.sliced(of, term, tf, len(texts))
    return {"lengths": length.tobytes(), "most": most.tobytes(), "columns": order.astype(np.int32).tobytes(), "powers": power.astype(np.uint8).tobytes(), "slices": slices}, length


def test_bounds_hold_and_exclude(corpus, asked):
    texts = [t or "" for _, t in corpus]
    row, length = index_row(texts)
    n, total = int((length > 0).sum()), int(length.sum())
    items = [sorted(set(terms(t))) for _, t in asked if terms(t)]
    number = np.repeat(np.arange(len(items)), [len(i) for i in items])
    term, _ = bitslices.terms_of(pa.array([t.encode() for i in items for t in i], pa.binary()))
    queries = bitslices.Queries(number, term.view(np.int64), np.full(len(number), 1000, np.int64))
    bound = np.zeros((len(items), len(texts)))
    for docs, some in bitslices.bounds_of(row, queries, n, total):
        bound[:, docs] = some
    m = bitslices.damping(length, n, total)
    exact = np.array([[sum(1000 * (10**9 * tf[t] // (1000 * tf[t] + 20 * int(m[d]))) for t in i if t in tf) for d, tf in enumerate(map(Counter, map(terms, texts)))] for i in items])
    assert (bound >= exact).all()
    assert (bound == exact).mean() > 0.5 and bound.sum() < 1.25 * exact.sum()


def test_matching_of_terms_at_text_edges():
    texts = ["ab", "cd", "", "é", " x-Y9 ", "a"]
    h, of = bitslices.terms_of(pa.array([t.encode() for t in texts], pa.binary()))
    one = [bitslices.terms_of(pa.array([t.encode()], pa.binary()))[0][0] for t in ("ab", "cd", "é", "x", "y9", "a")]
    assert of.tolist() == [0, 1, 3, 4, 4, 5] and h.tolist() == [int(x) for x in one]


def test_whole_numbers_of_any_size():
    assert bitslices.damping(np.array([10**9, 3]), 10**12, 10**15).tolist() == [50 + 50 * 10**9 * 10**12 // 10**15, 50]


def test_text_longer_than_a_batch(spark):
    rows = [(1, "alpha beta " * 900_000 + "gamma"), (2, "gamma delta"), (3, "delta")]
    items = [(1, "gamma delta alpha")]
    index = bitslices.build(spark.createDataFrame(rows, "doc_id long, text string"))
    assert got(bitslices.search(index, spark.createDataFrame(items, "item_id long, text string"))) == brute(rows, items)


def test_empty_tables(frames, none):
    docs, items = frames
    assert got(bitslices.search(bitslices.build(none), items)) == []
    assert got(bitslices.search(bitslices.build(docs.where("doc_id > 899 and doc_id < 903")), items)) == []
    assert got(bitslices.search(bitslices.build(docs), items.where("false"))) == []


def test_query(spark, root):
    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{root}/documents.parquet").collect()]
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{root}/benchmark.parquet").collect()]
    assert got(QUERIES["op13_bit_sliced_search"](spark, root)) == brute(docs, items)
