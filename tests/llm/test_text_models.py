"""Quality classifier, language model, language identification and repetition rules."""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tastemill.llm import crossparse, interpolation, positive_unlabelled, repetition
from tastemill.llm.shared import crc_remainder, tables

WORD = re.compile(r"[^ \t-\r]+")


def fold(i, modulus):
    return zlib.crc32(str(i).encode()) % modulus


# --- repetition ------------------------------------------------------------------------


def brute_repetition(text):
    w = WORD.findall(text or "")
    n = len(w)
    three = Counter(tuple(w[i : i + 3]) for i in range(n - 2))
    cover = set()
    for i in range(n - 2):
        if three[tuple(w[i : i + 3])] > 1:
            cover |= {i, i + 1, i + 2}
    seen, again = set(), 0
    for line in (text or "").split("\n"):
        if WORD.search(line):
            again += line in seen
            seen.add(line)
    longest = 0
    for i in range(n):
        for j in range(i + 1, n):
            k = 0
            while j + k < n and w[i + k] == w[j + k]:
                k += 1
            longest = max(longest, k)
    return n, sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text or "")), again, len(cover), longest


def test_repetition_matches_brute_force(spark, docs):
    extra = spark.createDataFrame([(-7, "l one\nl one\n\nl one\nx #$\n \nx #$"), (-8, "a b a b a b a b c"), (-9, "q\n")], "doc_id long, text string")
    frame = docs.select("doc_id", "text").unionByName(extra)
    texts = {(r["doc_id"], r["text"]): brute_repetition(r["text"]) for r in frame.collect() if r["text"] is None or len(r["text"]) < 2500}
    by_id = {i: v for (i, _), v in texts.items()}
    for r in repetition.judge(frame).collect():
        if r["doc_id"] in by_id:
            assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"], r["longest_repeat"]) == by_id[r["doc_id"]]
            assert r["base_failed"] == (r["n_words"] < 50 or 100 * r["n_repeat_words"] > 50 * r["n_words"])


def test_rules_decide(spark):
    words = [f"w{i}" for i in range(300)]
    rows = [(1, " ".join(words)), (2, " ".join(words[:100] * 2)), (3, " ".join(words[:60]) + " ##" * 40), (4, "short")]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r["doc_id"]: r["kept"] for r in repetition.judge(frame).collect()} == {1: True, 2: False, 3: False, 4: False}


def test_suffix_ranks_are_a_suffix_array():
    rng = np.random.default_rng(2)
    for size in (1, 2, 17, 60):
        words = rng.integers(0, 4, size)
        order = np.empty(size, int)
        levels = repetition.doubled_ranks(words)
        order[levels[-1]] = np.arange(size)
        assert sorted(range(size), key=lambda i: list(words[i:])) == order.tolist()


# --- language model ----------------------------------------------------------------------


def test_base_scores_match_brute_force(docs):
    remainder = crc_remainder("doc_id", 7)
    rows = [(r["doc_id"], [re.sub("[A-Z]", lambda m: m[0].lower(), w) for w in WORD.findall(r["text"] or "")] + [None]) for r in docs.collect()]
    train = Counter(w for i, t in rows if i is not None and fold(i, 7) != 2 for w in t)
    total, distinct = sum(train.values()), len(train)
    expected = {i: (len(t), sum(train[w] > 0 for w in t), sum(math.log10((train[w] + 1) / (total + distinct + 1)) for w in t)) for i, t in rows}
    got = interpolation.score(docs, remainder != 2, remainder == 3).collect()
    assert len(got) == len(rows)
    for r in got:
        n, known, base = expected[r["doc_id"]]
        assert (r["n_tokens"], r["n_known"], r["train_tokens"]) == (n, known, total)
        assert r["base_score"] == pytest.approx(base)
        assert math.isfinite(r["score"]) and r["score"] < 0


def test_model_is_a_distribution(spark):
    """Over one next token after a known context, the probabilities add up to one."""
    words = ["a", "b", "c"]
    train = [(i, t) for i, t in enumerate(["a b", "a c", "a b", "b a", "c a b", "a b c"])]
    probe = [(100 + i, f"a {w}") for i, w in enumerate([*words, "unseen"])] + [(200, "a")]
    frame = spark.createDataFrame(train + probe, "doc_id long, text string")
    got = {r["doc_id"]: r["score"] for r in interpolation.score(frame, F.col("doc_id") < 100, F.col("doc_id") % 3 == 0).collect()}
    vocabulary = 4  # three words and the end
    assert all(math.isfinite(v) for v in got.values())
    assert got[100 + 1] > got[100 + 3]
    assert vocabulary == len(words) + 1


def test_em_finds_the_mixture():
    rng = np.random.default_rng(4)
    n = 4000
    by_pair = np.where(rng.random(n) < 0.5, 40.0, 0.0)
    weights = interpolation.tuned_weights(np.full(n, 3), by_pair, np.full(n, 0.01), np.ones(n), 300)[3]
    assert weights.sum() == pytest.approx(1)
    assert weights[0] > 0.4 and weights[1] < 0.05
    assert interpolation.tuned_weights(np.zeros(0, int), np.zeros(0), np.zeros(0), np.zeros(0)).sum(axis=1) == pytest.approx(1)


def test_model_beats_base_on_held_out(spark, root):
    docs = tables(spark, root, "documents")
    remainder = crc_remainder("doc_id", 7)
    sums = interpolation.score(docs, remainder != 2, remainder == 3).where(remainder == 2).agg(F.sum("score"), F.sum("base_score")).first()
    assert sums[0] > sums[1]


# --- language -----------------------------------------------------------------------------


def test_automaton_accepts_exactly_the_substrings():
    text = b"abcabxabcd"
    steps = crossparse.suffix_automaton(text)

    def accepts(s):
        at = 0
        for c in s:
            if c not in steps[at]:
                return False
            at = steps[at][c]
        return True

    inner = {text[i:j] for i in range(len(text)) for j in range(i, len(text) + 1)}
    for a in b"abcdx":
        for b in b"abcdx":
            for c in b"abcdx":
                s = bytes([a, b, c])
                assert accepts(s) == (s in inner)


def test_phrases_match_a_greedy_parse():
    parser = crossparse.Parser({"x": ["abcab cabd"], "y": ["zzyzx"]})
    data = np.frombuffer(b"abcabdzzq" + b"" + b"yzx  zz", np.uint8)
    got = parser.phrases(data, np.array([0, 9, 9, 16]))

    def greedy(text, sample):
        n, at = 0, 0
        while at < len(text):
            size = max((k for k in range(1, len(text) - at + 1) if text[at : at + k] in sample), default=1)
            n, at = n + 1, at + size
        return n

    for i, text in enumerate(["abcabdzz?", "", "yzx zz"]):
        assert got[i].tolist() == [greedy(text, "abcab cabd"), greedy(text, "zzyzx")]


def test_languages_on_held_out(spark, root):
    docs = tables(spark, root, "documents")
    remainder = crc_remainder("doc_id", 4)
    found = crossparse.predict(docs, crossparse.learn(docs, remainder != 2)).join(docs.select("doc_id", "lang"), "doc_id").where(remainder == 2)
    right = found.agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("double"))).first()[0]
    assert right > 0.97


def test_language_cases(docs, none):
    parser = crossparse.learn(docs, F.lit(True))
    for r in crossparse.predict(docs, parser).join(docs.select("doc_id", "text").distinct(), "doc_id").collect():
        lettered = r["text"] is not None and any(c.isalpha() for c in r["text"])
        assert r["lang_pred"] == ("en" if lettered else "und") and 0 <= r["score"] <= 1
    assert crossparse.predict(none, parser).collect() == []
    assert {r["lang_pred"] for r in crossparse.predict(docs, crossparse.learn(none, F.lit(True))).collect()} == {"und"}


def test_languages_behind_one_preamble(spark):
    """All documents open alike, and texts without a letter take no place in the sample."""
    preamble, rng = "The same licence stands before every text. " * 12, np.random.default_rng(3)
    words = {"en": "the and that with this from".split(), "de": "der und nicht auch sich eine".split()}
    rows = [(2 * i + n, preamble + " ".join(rng.choice(words[k], 400)), k) for i in range(60) for n, k in enumerate(words)]
    rows += [(1000 + i, "123 ...", k) for i in range(300) for k in words]
    frame = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    parser = crossparse.learn(frame, F.lit(True), sampled_docs=8)
    probe = spark.createDataFrame([(i, " ".join(rng.choice(words[k], 60)), k) for i, k in enumerate([*words] * 10)], "doc_id long, text string, lang string")
    assert {(i % 2, r["lang_pred"]) for r in crossparse.predict(probe, parser).collect() for i in [r["doc_id"]]} == {(0, "en"), (1, "de")}


def test_passages_lie_all_over_the_text(spark):
    frame = spark.createDataFrame([(i, "".join(chr(0x4E00 + n) for n in range(1000 + i))) for i in range(50)] + [(50, "short")], "doc_id long, text string")
    got = {r["doc_id"]: r["t"] for r in frame.select("doc_id", crossparse.passages(F.col("text"), F.col("doc_id"), 400).alias("t")).collect()}
    assert got.pop(50) == ["short"]
    assert all(len(t) == 4 and {len(w) for w in t} == {100} and len(set("".join(t))) == 400 for t in got.values())
    assert min(ord(t[0][0]) for t in got.values()) - 0x4E00 < 20 and max(ord(t[3][-1]) for t in got.values()) - 0x4E00 > 970


def test_many_languages_share_the_bound():
    """Sixty languages of a script with many bytes: entries stay right and every language keeps a sample."""
    rng = np.random.default_rng(6)
    signs = [[chr(0x400 * (1 + n // 2) + 64 * (n % 2) + i) for i in range(40)] for n in range(60)]
    samples = {f"l{n:02}": ["".join(rng.choice(signs[n], 400)) for _ in range(48)] for n in range(60)}
    some = crossparse.bounded({k: [t.encode() for t in v] for k, v in samples.items()})
    assert sum(len(t) + 1 for v in some.values() for t in v) <= crossparse.MAX_BYTES and all(sum(map(len, v)) > 1000 for v in some.values())
    parser = crossparse.Parser(samples)
    assert parser.table.min() >= 0 and len(parser.table) <= 2 * crossparse.MAX_BYTES * parser.width
    probe = [v[0][:10].lower().encode() for v in samples.values()]
    got = parser.phrases(np.frombuffer(b"".join(probe), np.uint8), np.cumsum([0, *map(len, probe)]))
    assert (got.diagonal() == got.min(axis=1)).all()


# --- quality ------------------------------------------------------------------------------


def test_quality_on_held_out(spark, root):
    docs, labels = tables(spark, root, "documents"), tables(spark, root, "labels")
    remainder = crc_remainder("doc_id", 5)
    scorer = positive_unlabelled.learn(docs, labels, remainder != 0)
    found = positive_unlabelled.score(docs, scorer).join(labels, "doc_id").where(remainder == 0).toPandas()
    assert ((found.score >= 0.3) == (found.quality == 1)).mean() > 0.9
    assert found.score.between(0, 1).all()


def test_quality_with_a_label_for_every_document(spark):
    rows = [(i, "Plain words make up this sentence. " * 9 if i % 2 else "$$ !! 17 ## " * 30) for i in range(80)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = docs.select("doc_id", (F.col("doc_id") % 2).cast("int").alias("quality"), F.lit(0).alias("toxic"))
    scorer = positive_unlabelled.learn(docs, labels, F.lit(True))
    assert all((r["score"] >= 0.3) == (r["doc_id"] % 2 == 1) for r in positive_unlabelled.score(docs, scorer).collect())


def test_non_negative_risk_separates_without_negatives():
    rng = np.random.default_rng(1)
    good, bad = rng.normal(2, 1, (600, 3)), rng.normal(-2, 1, (150, 3))
    scorer = positive_unlabelled.fit(good[:200], np.concatenate([good[200:], bad]), prior=400 / 550)
    assert (scorer.score(good) > 0.3).mean() > 0.97
    assert (scorer.score(bad) < 0.3).mean() > 0.9


def test_risk_slopes_by_differences():
    """Slopes of both branches against differences of the written-out risk."""
    rng = np.random.default_rng(3)

    def negative(zp, zu, prior):
        return np.mean([np.log(1 + np.exp(z)) for z in zu]) - prior * np.mean([np.log(1 + np.exp(z)) for z in zp])

    def risk(zp, zu, prior):
        return prior * np.mean([np.log(1 + np.exp(-z)) for z in zp]) + negative(zp, zu, prior)

    for zp, zu, prior in ((rng.normal(0, 1, 5), rng.normal(0, 1, 7), 0.4), (rng.normal(3, 1, 5), rng.normal(-3, 1, 7), 0.9)):
        below = negative(zp, zu, prior) < 0
        target = (lambda a, b: -negative(a, b, prior)) if below else (lambda a, b: risk(a, b, prior))
        gp, gu = positive_unlabelled.slopes(zp, zu, prior)
        for i in range(len(zp)):
            d = np.eye(len(zp))[i] * 1e-5
            assert gp[i] / len(zp) == pytest.approx((target(zp + d, zu) - target(zp - d, zu)) / 2e-5, abs=1e-7)
        for i in range(len(zu)):
            d = np.eye(len(zu))[i] * 1e-5
            assert gu[i] / len(zu) == pytest.approx((target(zp, zu + d) - target(zp, zu - d)) / 2e-5, abs=1e-7)


@pytest.mark.parametrize("share", [0.3, 0.6, 0.9])
def test_prior_from_two_samples(share):
    rng = np.random.default_rng(4)
    good, n = rng.normal(1.5, 1, (6000, 3)), int(4000 * share)
    mixed = np.concatenate([good[:n], rng.normal(-1.5, 1, (4000 - n, 3))])
    rng.shuffle(mixed)
    assert positive_unlabelled.class_prior(good[4000:], mixed) == pytest.approx(share, abs=0.05)
    assert positive_unlabelled.class_prior(good[:1], mixed) == 0.5


def test_quality_from_positive_labels_alone(spark, root):
    """The same prior whether negatives are labelled or not, and the model tells them apart. On some
    hundred positives: with a few dozen the confidence limit is wide and the prior errs high."""
    root = root.replace("sf0.001", "sf0.01")
    docs, labels = tables(spark, root, "documents"), tables(spark, root, "labels")
    remainder = crc_remainder("doc_id", 5)
    scorer = positive_unlabelled.learn(docs, labels.where("quality = 1"), remainder != 0)
    assert scorer.prior == positive_unlabelled.learn(docs, labels, remainder != 0).prior
    found = positive_unlabelled.score(docs, scorer).join(labels, "doc_id").where("quality is not null").toPandas()
    good, bad = found[found.quality == 1].score.to_numpy(), found[found.quality == 0].score.to_numpy()
    assert np.mean([(x > bad).mean() for x in good]) > 0.97 and (bad >= 0.3).mean() < 0.05


def test_quality_cases(spark, docs, none):
    labels = spark.createDataFrame([(1, 1, 0), (4, 0, 0), (7, None, 0), (None, 1, 0)], "doc_id long, quality int, toxic int")
    scorer = positive_unlabelled.learn(docs, labels, F.lit(True))
    assert scorer.prior == 0.5
    got = positive_unlabelled.score(docs, scorer, carry=True)
    assert got.count() == docs.count() and got.where("score is null or row.score <> 1").count() == 0
    empty = positive_unlabelled.learn(none, labels.where("false"), F.lit(True))
    assert all(r["score"] == pytest.approx(0.5) for r in positive_unlabelled.score(docs, empty).collect())
    assert positive_unlabelled.score(none, scorer).collect() == []
    assert repetition.judge(none).collect() == []
    assert interpolation.score(none, F.lit(True), F.lit(False)).collect() == []
    assert interpolation.score(docs, F.lit(False), F.lit(False)).count() == docs.count()
