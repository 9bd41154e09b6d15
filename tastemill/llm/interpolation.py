"""Language-model scores by deleted interpolation.

Maximum-likelihood estimates of bigrams, of single tokens and of a uniform choice are mixed with
weights that depend on how often the context was seen, in buckets that double. The weights come
from expectation-maximisation on counts of a part of the training text that is deleted from the
estimates; the final estimates use all training text. Counts are kept by hash buckets over the
whole corpus; blocks of documents ask for the counts of their distinct tokens and bigrams.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tastemill.llm.exchange import blocks, bucket_bounds, bucket_count, from_planes, open_block, planes, replies, texts_of, with_answers
from tastemill.llm.shared import Cuts, shuffles_once
from tastemill.llm.words import mix, tidy

_U = np.uint64
END, START = _U(0x517CC1B727220A95), _U(0x2545F4914F6CDD1D)
PAIR_BYTES = 6  # of a bigram's hash, besides its bucket
CONTEXT_BUCKETS = 16
GRID = 8  # steps of a natural logarithm in which tuning counts are gathered
EM_STEPS = 60
LEAST_WEIGHT = 1e-5
FOLDS = {"other": 0, "training": 1, "tuning": 2}


def pack_counts(values: np.ndarray) -> bytes:
    keep = max(1, (int(values.max(initial=0)).bit_length() + 7) // 8)
    return bytes([keep]) + planes(values.astype(np.int64), keep)


def unpack_counts(raw: bytes) -> np.ndarray:
    return from_planes(raw[1:], np.int64, raw[0])


class Block:
    """Tokens of a block: distinct ones and distinct bigrams, and which stand where."""

    def __init__(self, rows: bytes):
        self.batch = open_block(rows)
        part = texts_of(self.batch, fold=True)
        n = len(part.starts) + part.count
        self.ends = part.words[1:] + np.arange(part.count)
        tokens = np.full(n, END)
        inner = np.ones(n, bool)
        inner[self.ends] = False
        tokens[inner] = part.word_hashes()
        self.heads = part.words[:-1] + np.arange(part.count)
        before = np.empty(n, _U)
        before[1:] = tokens[:-1]
        before[self.heads] = START
        self.doc_of = np.repeat(np.arange(part.count), np.diff(part.words) + 1)
        self.fold = self.batch.column(2).to_numpy()[self.doc_of]
        self.count = part.count
        self.tokens, self.token_at = np.unique(tokens, return_inverse=True)
        self.pairs, self.pair_at = np.unique(mix(before * _U(0x9E3779B97F4A7C15) + tokens), return_inverse=True)

    def counts(self, at: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
        """Occurrences of each distinct key in training, and in its tuning part."""
        return np.bincount(at[self.fold > 0], minlength=size), np.bincount(at[self.fold == 2], minlength=size)

    def known(self, column: pa.Array, row: int, buckets: int) -> tuple[np.ndarray, ...]:
        """For every token in place: counts of itself, of its bigram and of its context, over all
        training text and over the tuning part."""
        got = replies(column, row)
        out, at = [], 0
        for keys, where in ((self.tokens, self.token_at), (self.pairs, self.pair_at)):
            n = len(bucket_bounds(keys, buckets)[0])
            both = []
            for r in got[at : at + n]:
                cut = int.from_bytes(r[:4], "little")
                both.append((unpack_counts(r[4 : 4 + cut]), unpack_counts(r[4 + cut :])))
            at += n
            out += [np.concatenate([b[i] for b in both])[where] for i in (0, 1)]
        return tuple(out)

    def contexts(self, counts: np.ndarray, starts: int) -> np.ndarray:
        """A context's count is that of the token before; the start has one for each document."""
        before = np.empty_like(counts)
        before[1:] = counts[:-1]
        before[self.heads] = starts
        return before


def ask_counts(table: DataFrame, buckets: int) -> DataFrame:
    def run(batches):
        for batch in batches:
            for block, rows in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                b = Block(rows)
                for kind, (keys, at, keep) in enumerate(((b.tokens, b.token_at, 8), (b.pairs, b.pair_at, PAIR_BYTES))):
                    all_counts, tuning = b.counts(at, len(keys))
                    of, bounds = bucket_bounds(keys, buckets)
                    spans = list(zip(bounds[:-1], bounds[1:], strict=True))
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array(of + kind * buckets), pa.array(np.full(len(of), block, np.int64)), pa.array(np.diff(bounds)),
                            pa.array([planes(keys[i:j], keep) for i, j in spans], pa.binary()),
                            pa.array([pack_counts(all_counts[i:j]) for i, j in spans], pa.binary()),
                            pa.array([pack_counts(tuning[i:j]) for i, j in spans], pa.binary()),
                        ],
                        ["bucket", "block", "n", "keys", "training", "tuning"],
                    )

    return table.select("block", "rows").mapInArrow(tidy(run), "bucket long, block long, n long, keys binary, training binary, tuning binary")


def answer_counts(asked: DataFrame, buckets: int) -> DataFrame:
    """Corpus counts for every block and bucket; of single tokens also how many there are."""

    def answer(key, group):
        single = key[0].as_py() < buckets
        n = group.column("n").to_pylist()
        keys = np.concatenate([from_planes(r, np.uint64, 8 if single else PAIR_BYTES) for r in group.column("keys").to_pylist()])
        _, at = np.unique(keys, return_inverse=True)
        sums = []
        for name in ("training", "tuning"):
            counts = np.concatenate([unpack_counts(r) for r in group.column(name).to_pylist()])
            total = np.zeros(int(at.max(initial=-1)) + 1, np.int64)
            np.add.at(total, at, counts)
            sums.append(total)
        bounds = np.cumsum([0, *n])
        reply = []
        for i, j in zip(bounds[:-1], bounds[1:], strict=True):
            first = pack_counts(sums[0][at[i:j]])
            reply.append(len(first).to_bytes(4, "little") + first + pack_counts(sums[1][at[i:j]]))
        facts = np.zeros((4, len(n)), np.int64)
        if single:
            rest = sums[0] - sums[1]
            facts[:, 0] = (sums[0] > 0).sum(), sums[0].sum(), (rest > 0).sum(), rest.sum()
        return pa.table({
            "block": group.column("block"), "bucket": group.column("bucket"), "reply": pa.array(reply, pa.binary()),
            "distinct": pa.array(facts[0]), "tokens": pa.array(facts[1]), "distinct_rest": pa.array(facts[2]), "tokens_rest": pa.array(facts[3]),
        })

    return asked.groupBy("bucket").applyInArrow(answer, "block long, bucket long, reply binary, distinct long, tokens long, distinct_rest long, tokens_rest long")


def context_bucket(count: np.ndarray) -> np.ndarray:
    """0 for an unseen context, then one bucket for each doubling."""
    return np.minimum(np.frexp(count.astype(float))[1], CONTEXT_BUCKETS - 1)


def estimates(pair: np.ndarray, token: np.ndarray, context: np.ndarray, tokens: int, distinct: int) -> tuple[np.ndarray, np.ndarray, float]:
    """Maximum-likelihood estimates by bigram and by token, and the uniform one."""
    return pair / np.maximum(context, 1), token / max(tokens, 1), 1.0 / (distinct + 1)


def tuned_weights(bucket: np.ndarray, by_pair: np.ndarray, by_token: np.ndarray, n: np.ndarray, steps: int = EM_STEPS) -> np.ndarray:
    """Mixture weights (bigram, token, uniform) of every context bucket by EM.

    The estimates are given relative to the uniform one, with how often each combination was met.
    """
    weights = np.tile([0.4, 0.4, 0.2], (CONTEXT_BUCKETS, 1))
    weights[0] = 0.0, 0.8, 0.2  # nothing is known of an unseen context
    parts = np.stack([by_pair, by_token, np.ones(len(n))], axis=1)
    for _ in range(steps):
        share = weights[bucket] * parts
        share *= (n / share.sum(axis=1))[:, None]
        gathered = np.stack([np.bincount(bucket, weights=share[:, i], minlength=CONTEXT_BUCKETS) for i in range(3)], axis=1)
        total = gathered.sum(axis=1)
        met = total > 0
        weights[met] = np.maximum(gathered[met] / total[met, None], LEAST_WEIGHT)
        weights /= weights.sum(axis=1, keepdims=True)
    return weights


@dataclass(frozen=True)
class Facts:
    tokens: int
    distinct: int
    tokens_rest: int
    distinct_rest: int
    starts: int
    starts_tuning: int


def score(docs: DataFrame, training: Column, tuning: Column) -> DataFrame:
    """doc_id, n_tokens, n_known, train_tokens, base_score, score of every row of ``docs``.

    ``training`` says which rows are learned from, ``tuning`` which of these are deleted for the
    weights. Words are lower-cased in A-Z; an end follows the last and counts as a token, so a null
    or empty text has one. base_score: log10 with one added to each count; score: log10 by the
    model. Without training text every token has the uniform probability. Rows that repeat count
    and are scored each; other columns are ignored; an empty table gives no rows.
    """
    spark = docs.sparkSession
    cuts = Cuts(spark, "interpolation")
    fold = F.when(F.coalesce(training, F.lit(False)), F.when(F.coalesce(tuning, F.lit(False)), 2).otherwise(1)).otherwise(0)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").cast("binary").alias("text"), fold.cast("int").alias("fold"))
    starts = {r["fold"]: r["count"] for r in rows.groupBy("fold").count().collect()}
    table = cuts.save("blocks", blocks(rows))
    buckets = bucket_count(table)
    answers = cuts.save("counts", answer_counts(ask_counts(table, buckets), buckets))
    f = answers.agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("tokens", "distinct", "tokens_rest", "distinct_rest")]).first()
    facts = Facts(f["tokens"], f["distinct"], f["tokens_rest"], f["distinct_rest"], starts.get(1, 0) + starts.get(2, 0), starts.get(2, 0))
    both = with_answers(table, answers)

    def gather(batches):
        for batch in batches:
            for row in range(batch.num_rows):
                b = Block(batch.column(1)[row].as_py())
                token, token_held, pair, pair_held = b.known(batch.column(2), row, buckets)
                token, pair = token - token_held, pair - pair_held
                context = b.contexts(token, facts.starts - facts.starts_tuning)
                held = b.fold == 2
                by_pair, by_token, uniform = estimates(pair[held], token[held], context[held], facts.tokens_rest, facts.distinct_rest)
                with np.errstate(divide="ignore"):
                    grid = [np.where(p > 0, np.rint(GRID * np.log(np.maximum(p, 1e-300) / uniform)).astype(np.int64) + 400, 0) for p in (by_pair, by_token)]
                code, n = np.unique((context_bucket(context[held]) * 1024 + grid[0]) * 1024 + grid[1], return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(code.astype(np.int64)), pa.array(n)], ["code", "n"])

    # bounded by the grid, whatever the corpus: buckets times steps of two logarithms
    with shuffles_once(spark):
        met = both.mapInArrow(tidy(gather), "code long, n long").groupBy("code").agg(F.sum("n").alias("n")).toPandas()
    code = met["code"].to_numpy().astype(np.int64)
    pair_step, token_step = code // 1024 % 1024, code % 1024
    ratio = [np.where(s > 0, np.exp((s - 400) / GRID), 0.0) for s in (pair_step, token_step)]
    weights = tuned_weights(code // (1024 * 1024), ratio[0], ratio[1], met["n"].to_numpy().astype(float))

    def run(batches):
        for batch in batches:
            for row in range(batch.num_rows):
                b = Block(batch.column(1)[row].as_py())
                token, _, pair, _ = b.known(batch.column(2), row, buckets)
                context = b.contexts(token, facts.starts)
                by_pair, by_token, uniform = estimates(pair, token, context, facts.tokens, facts.distinct)
                w = weights[context_bucket(context)]
                p = w[:, 0] * by_pair + w[:, 1] * by_token + w[:, 2] * uniform
                base = np.log10((token + 1) / (facts.tokens + facts.distinct + 1))
                sums = [np.bincount(b.doc_of, weights=x, minlength=b.count) for x in (base, np.log10(p))]
                n = np.bincount(b.doc_of, minlength=b.count)
                known = np.bincount(b.doc_of[token > 0], minlength=b.count)
                yield pa.RecordBatch.from_arrays(
                    [b.batch.column(0), pa.array(n), pa.array(known), pa.array(np.full(b.count, facts.tokens)), *(pa.array(s) for s in sums)],
                    ["doc_id", "n_tokens", "n_known", "train_tokens", "base_score", "score"],
                )

    return both.mapInArrow(tidy(run), "doc_id long, n_tokens long, n_known long, train_tokens long, base_score double, score double")
