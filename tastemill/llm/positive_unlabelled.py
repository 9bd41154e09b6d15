"""Quality classifier learned from trusted positives and unlabelled text alone.

The non-negative risk: pi * R+(P) + max(0, R-(U) - pi * R-(P)), with a logistic loss and pi the
estimated share of positives in the corpus. When the second term falls below zero, the step goes
against it, so the model doesn't learn to call every unlabelled text negative.

pi comes from the two samples alone: a plain model ranks both, fitted on halves and applied to the
other half, and the share of unlabelled texts above a rank, divided by that of positives, is least
where hardly any negative ranks as high. No label of a negative is needed or used.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tastemill.llm.shared import ready, text_bytes, with_rows
from tastemill.llm.words import Texts, mix, slices, tidy, windows

_U = np.uint64
POSITIVE_SAMPLE = 8_000
UNLABELLED_SAMPLE = 16_000
STEPS = 400
# One group for each ASCII byte but letters and digits, and one for each of these kinds.
_GROUP = np.zeros(256, np.int64)
_GROUP[48:58], _GROUP[65:91], _GROUP[97:123], _GROUP[128:192], _GROUP[192:] = 0, 1, 2, 3, 4
_REST = [b for b in range(128) if not chr(b).isalnum()]
_GROUP[_REST] = 5 + np.arange(len(_REST))
GROUPS = 5 + len(_REST)
WORD_FEATURES = 10
WIDTH = GROUPS + WORD_FEATURES


def features(part: Texts) -> np.ndarray:
    """Shares of kinds of bytes, and shares and sizes of words, of whole texts."""
    part.find_words()
    n_bytes = np.maximum(np.diff(part.bounds), 1)
    text_of_byte = np.repeat(np.arange(part.count), np.diff(part.bounds))
    kinds = np.bincount(text_of_byte * GROUPS + _GROUP[part.data], minlength=part.count * GROUPS).reshape(part.count, GROUPS)
    n = np.diff(part.words)
    some = np.maximum(n, 1)
    text_of = part.text_of_word()
    h = part.word_hashes() + (text_of.astype(_U) + _U(1)) * _U(0x9E3779B97F4A7C15)

    def distinct(x: np.ndarray, at: np.ndarray) -> np.ndarray:
        _, first = np.unique(x, return_index=True)
        return np.bincount(at[first], minlength=part.count)

    def share(flags: np.ndarray) -> np.ndarray:
        return np.bincount(text_of[: len(flags)][flags], minlength=part.count) / some

    size = part.ends - part.starts
    last, head = part.data[np.maximum(part.ends - 1, 0)], part.data[part.starts] if len(part.starts) else part.data[:0]
    three = windows(h, 3)
    lines = part.per_text(part.data == 0x0A) + 1
    columns = [
        np.log1p(n),
        np.bincount(text_of, weights=size, minlength=part.count) / some / 4,
        distinct(h, text_of) / some * 3,
        distinct(mix(three), text_of[: len(three)]) / some * 3 if len(three) else np.zeros(part.count),
        share(h[1:] == h[:-1]) * 3,
        share((last == 0x2E) | (last == 0x2C)) * 3,
        share((last == 0x21) | (last == 0x3F)) * 3,
        share((head >= 65) & (head <= 90)) * 3,
        share(size == 1) * 3,
        np.log1p(n / lines),
    ]
    return np.concatenate([np.log1p(100 * kinds / n_bytes[:, None]), np.stack(columns, axis=1)], axis=1).astype(np.float32)


@dataclass(frozen=True)
class Scorer:
    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    bias: float
    prior: float

    def score(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.mean) / self.scale, -8, 8) @ self.weights + self.bias
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def slopes(zp: np.ndarray, zu: np.ndarray, prior: float) -> tuple[np.ndarray, np.ndarray]:
    """Slopes of the non-negative risk by the outputs of positives and of unlabelled, each times its
    sample's size; where the risk of negatives has fallen below zero, those of its descent back."""
    sp, su = 1 / (1 + np.exp(-zp)), 1 / (1 + np.exp(-zu))
    if np.logaddexp(0, zu).mean() - prior * np.logaddexp(0, zp).mean() >= 0:
        return -prior * (1 - sp) - prior * sp, su
    return prior * sp, -su


def fit(positive: np.ndarray, unlabelled: np.ndarray, prior: float, steps: int = STEPS) -> Scorer:
    """The model of least non-negative risk over the whole samples."""
    return _descend(positive, unlabelled, lambda zp, zu: slopes(zp, zu, prior), prior, steps)


def _descend(positive: np.ndarray, unlabelled: np.ndarray, slope: Callable, prior: float, steps: int, rate: float = 0.05, decay: float = 1e-4) -> Scorer:
    """Adam over the whole samples, from zero weights."""
    everything = np.concatenate([positive, unlabelled]) if len(positive) + len(unlabelled) else np.zeros((1, WIDTH), np.float32)
    mean, scale = everything.mean(axis=0), np.maximum(everything.std(axis=0), 0.05)
    if not len(positive) or not len(unlabelled):
        # nothing to tell apart: everybody gets the prior
        odds = min(max(prior, 1e-6), 1 - 1e-6)
        return Scorer(mean, scale, np.zeros(everything.shape[1]), float(np.log(odds / (1 - odds))), prior)
    p, u = (np.clip((x - mean) / scale, -8, 8).astype(np.float64) for x in (positive, unlabelled))
    w = np.zeros(p.shape[1] + 1)
    first, second = np.zeros_like(w), np.zeros_like(w)
    p, u = (np.concatenate([x, np.ones((len(x), 1))], axis=1) for x in (p, u))
    for t in range(1, steps + 1):
        gp, gu = slope(p @ w, u @ w)
        g = (gp @ p) / len(p) + (gu @ u) / len(u)
        g[:-1] += decay * w[:-1]
        first = 0.9 * first + 0.1 * g
        second = 0.999 * second + 0.001 * g * g
        w -= rate * (first / (1 - 0.9**t)) / (np.sqrt(second / (1 - 0.999**t)) + 1e-8)
    return Scorer(mean, scale, w[:-1], float(w[-1]), prior)


def class_prior(positive: np.ndarray, unlabelled: np.ndarray, folds: int = 2, doubt: float = 0.1) -> float:
    """Share of positives among the unlabelled: the least ratio of upper tails, at the rank where its
    upper confidence limit is least. It errs high on a few dozen texts, where that limit is wide, and is
    one half where either sample can't be split."""
    if min(len(positive), len(unlabelled)) < folds:
        return 0.5
    ranks = [np.zeros(len(positive)), np.zeros(len(unlabelled))]
    for k in range(folds):
        mine = [np.arange(len(x)) % folds == k for x in (positive, unlabelled)]
        plain = _plain(positive[~mine[0]], unlabelled[~mine[1]])
        for rank, x, m in zip(ranks, (positive, unlabelled), mine, strict=True):
            rank[m] = plain.score(x[m])
    p, u = (np.sort(r) for r in ranks)
    # every positive's rank is a place to look; tails are counted from above, ties included
    above_p = (len(p) - np.searchsorted(p, p, side="left")) / len(p)
    above_u = (len(u) - np.searchsorted(u, p, side="left")) / len(u)
    slack = sum(math.sqrt(math.log(4 / doubt) / (2 * len(x))) for x in (p, u))
    at = int(((above_u + slack) / above_p).argmin())
    return float(np.clip(above_u[at] / above_p[at], 0.01, 0.99))


def _plain(positive: np.ndarray, unlabelled: np.ndarray, steps: int = 200) -> Scorer:
    """Logistic model of positives against all unlabelled texts, both samples weighing alike."""
    return _descend(positive, unlabelled, lambda zp, zu: (-1 / (1 + np.exp(zp)), 1 / (1 + np.exp(-zu))), 0.5, steps)


def _vectors(docs: DataFrame, kind: Column) -> DataFrame:
    """(kind, features) of the rows, features as bytes."""
    narrow = docs.select(kind.alias("kind"), F.col("text").cast("string").cast("binary").alias("text"))

    def run(batches):
        for batch in batches:
            for part in slices(batch.column(1)):
                rows = [x.tobytes() for x in features(part)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(part.first, part.count), pa.array(rows, pa.binary())], ["kind", "x"])

    return narrow.mapInArrow(tidy(run), "kind int, x binary")


def learn(docs: DataFrame, labels: DataFrame, allowed: Column, positives: int = POSITIVE_SAMPLE, unlabelled: int = UNLABELLED_SAMPLE) -> Scorer:
    """Fit on bounded samples of the rows that ``allowed`` lets in.

    ``positives`` documents with quality 1 and ``unlabelled`` documents, whatever their
    label, are chosen by a hash of their id, so the risk is defined at every coverage of the labels.
    The class prior is estimated from the two samples; labels of negatives are not used. An id with
    several labels is positive if all of them say so.
    """
    ready(docs.sparkSession)
    marks = labels.where(allowed & F.col("doc_id").isNotNull() & F.col("quality").isNotNull()).groupBy("doc_id").agg(F.avg("quality").alias("q"))
    ids = docs.where(allowed & F.col("doc_id").isNotNull()).select("doc_id").distinct().join(marks, "doc_id", "left")
    order = F.xxhash64("doc_id")
    chosen = (
        ids.where("q = 1").orderBy(order, "doc_id").limit(positives).select("doc_id", F.lit(1).alias("kind"))
        .unionByName(ids.orderBy(order, "doc_id").limit(unlabelled).select("doc_id", F.lit(0).alias("kind")))
    )
    chosen = docs.sparkSession.createDataFrame(chosen.collect(), "doc_id long, kind int")
    # bounded by the two sample sizes
    rows = _vectors(docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id"), F.col("kind")).collect()
    # one order, whatever the tasks' order, so that folds are the same in every run
    rows.sort(key=lambda r: zlib.crc32(r["x"]))
    x = {k: np.array([np.frombuffer(bytes(r["x"]), np.float32) for r in rows if r["kind"] == k]).reshape(-1, WIDTH) for k in (0, 1)}
    return fit(x[1], x[0], class_prior(x[1], x[0]))


def score(docs: DataFrame, scorer: Scorer, carry: bool = False) -> DataFrame:
    """doc_id and score (0 to 1, higher is better) of every row, from its whole text alone.

    With ``carry`` also text (bytes) and row (a struct of all other columns). A null text counts as
    empty and is scored like one. Rows that repeat are scored each; a null doc_id stays null; other
    columns are ignored.
    """
    ready(docs.sparkSession)
    rows = with_rows(docs) if carry else text_bytes(docs)
    schema = T.StructType([rows.schema["doc_id"], T.StructField("score", T.DoubleType()), *rows.schema[1:]] if carry else [rows.schema["doc_id"], T.StructField("score", T.DoubleType())])

    def run(batches):
        for batch in batches:
            for part in slices(batch.column(1)):
                some = batch.slice(part.first, part.count)
                found = [some.column(0), pa.array(scorer.score(features(part)).astype(np.float64)), *(some.columns[1:] if carry else ())]
                yield pa.RecordBatch.from_arrays(found, schema.names)

    return rows.mapInArrow(tidy(run), schema)
