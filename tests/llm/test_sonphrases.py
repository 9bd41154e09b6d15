"""Phrases by SON partitioning against counting everything at once."""

from __future__ import annotations

import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from tastemill.llm import sonphrases
from tastemill.llm.queries import QUERIES

COLUMNS = ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]


def brute(rows, min_count=10, longest=3, inside_percent=50, top=2000):
    counts, totals = defaultdict(Counter), Counter()
    fold = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
    for lang, text in rows:
        lang = "und" if lang is None else lang
        for piece in re.split("[.,;:!?\n-\r]", (text or "").translate(fold)):
            words = re.findall("[^ \t]+", piece)
            totals[lang] += len(words)
            for k in range(1, longest + 1):
                for i in range(len(words) - k + 1):
                    counts[lang][tuple(words[i : i + k])] += 1
    out = []
    for lang, f in counts.items():
        candidates = {p for p, n in f.items() if len(p) > 1 and n >= min_count}
        ranked = []
        for p in candidates:
            around = [f[q] for q in candidates if len(q) > len(p) and any(q[i : i + len(p)] == p for i in range(len(q)))]
            if any(100 * n >= inside_percent * f[p] for n in around):
                continue
            score, k = min((1000000 * f[p] ** 2 // (f[p[:k]] * f[p[k:]]), k) for k in range(1, len(p)))
            ranked.append((-score, -f[p], " ".join(p).encode(), f[p[:k]], f[p[k:]]))
        for rank, (score, a, phrase, left, right) in enumerate(sorted(ranked)[:top], 1):
            out.append((lang, rank, phrase.decode(), -a, left, right, totals[lang], -score))
    return sorted(out)


@pytest.fixture(scope="module")
def prose():
    """Frequent pairs and triples in two large languages, a rare one, a null one; odd separators."""
    rng = random.Random(8)
    words = ["the", "of", "New", "York", "city", "Été", "x\x01y", "ß", "a-b"]
    rows = []
    for i in range(400):
        text = ""
        for _ in range(rng.randint(0, 30)):
            text += rng.choice([*words, "new york city", "the of"]) + rng.choice([" ", " ", " ", "\t", "  ", ". ", ",", "\n", "\x0b", "!?", " \x0c"])
        rows.append((["en", "fr", "en", None, "en"][i % 5] if i % 40 else "zz", text))
    return [*rows, ("en", None), ("en", ""), (None, " \t "), ("empty", "..."), rows[3], rows[3]]


@pytest.fixture(scope="module")
def frame(spark, prose):
    rows = [(i, lang, text, 1, "x", 2, 3) for i, (lang, text) in enumerate(prose)]
    return spark.createDataFrame(rows, "doc_id long, lang string, text string, n int, phrase string, total long, size long").repartition(4)


def got(df):
    assert df.columns == COLUMNS
    return sorted(tuple(r) for r in df.collect())


@pytest.mark.parametrize("shard", [1 << 9, 1 << 12, 1 << 22])
def test_as_counting_everything(frame, prose, monkeypatch, shard):
    monkeypatch.setattr(sonphrases, "SHARD_BYTES", shard)
    assert got(sonphrases.phrases(frame)) == brute(prose)


def test_longer_phrases_and_other_limits(frame, prose, monkeypatch):
    monkeypatch.setattr(sonphrases, "SHARD_BYTES", 2000)
    options = {"min_count": 6, "longest": 4, "inside_percent": 80, "top": 25}
    assert got(sonphrases.phrases(frame, **options)) == brute(prose, **options)


def test_support_reached_only_over_all_shards(spark, monkeypatch):
    """Eleven occurrences, one or two in each of seven shards, others in a shard of their own."""
    monkeypatch.setattr(sonphrases, "SHARD_BYTES", 200)
    rows = [("en", "far apart. " + f"filler{i} " * 20) for i in range(11)] + [("en", "close by. " * 10), ("en", "not enough. " * 9)]
    frame = spark.createDataFrame(rows, "lang string, text string").repartition(7)
    found = got(sonphrases.phrases(frame))
    assert found == brute(rows) and {"far apart", "close by"} <= {r[2] for r in found} and "not enough" not in {r[2] for r in found}


def test_bitmap_has_every_frequent_phrase(spark):
    pairs = [("en" if i % 3 else "é", f"w{i} v{i * i}") for i in range(5000)]
    frame = spark.createDataFrame(pairs, "lang string, phrase string").repartition(3)
    import pyarrow as pa

    from tastemill.llm.words import Texts, column_bytes, mix, windows

    data, bounds = column_bytes(pa.array([p.encode() for _, p in pairs], pa.binary()))
    part = Texts(data, bounds, 0).find_words()
    keys = mix(windows(part.word_hashes(), 2)[part.words[:-1]] ^ sonphrases.hashes_of(pa.array([lang for lang, _ in pairs])))
    with sonphrases.bitmap(frame, 2) as known:
        bits = np.frombuffer(known.value, np.uint8)
        assert sonphrases.held(bits, keys).all()
        assert len(bits) == 1 << 14 and sonphrases.held(bits, mix(keys)).mean() < 0.1


def test_text_longer_than_a_shard_and_a_batch(spark):
    long = "one two three. " * 700_000 + "three " * 9
    rows = [("en", long), ("en", "one two")]
    frame = spark.createDataFrame(rows, "lang string, text string")
    assert got(sonphrases.phrases(frame)) == brute(rows)


def test_empty_table(frame, none):
    assert got(sonphrases.phrases(none)) == []
    assert got(sonphrases.phrases(frame.where("lang = 'empty' or text is null"))) == []


def test_query(spark, root):
    out = QUERIES["op12_son_phrases"](spark, root)
    rows = [(r["lang"], r["text"]) for r in spark.read.parquet(f"{root}/documents.parquet").collect()]
    assert got(out) == brute(rows)
