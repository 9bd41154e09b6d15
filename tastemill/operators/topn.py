"""One-sided exact top-n of a factor model: users walk the products, longest factors first.

A user's score of a product is at most the product of the two lengths. Products are sorted by length
and cut into blocks; a user scores a block at a time and stops where its length times the longest
factor still to come falls below its n-th score so far. No pair beyond that is formed, nothing is
shuffled on the user side, and a list is never larger than n.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tastemill.session import cut

CHUNK = 1 << 17  # products sent to the executors at a time: some megabytes at the usual ranks
BLOCK = 64
USERS_AT_ONCE = 2048
SLACK = 1 + 1e-6  # scores are rounded to single precision


def by_length(products: DataFrame, chunk: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(ids, factors, lengths) of ``chunk`` products at a time, longest first, ties by id."""
    square = F.aggregate("features", F.lit(0.0), lambda total, x: total + x.cast("double") * x)
    rows = products.select("id", "features", F.sqrt(square).alias("length")).orderBy(F.desc("length"), "id")
    held: list = []

    def packed():
        ids, factors, lengths = zip(*held, strict=True)
        return np.array(ids, np.int32), np.array(factors, np.float32), np.array(lengths)

    for row in rows.toLocalIterator():
        held.append(row)
        if len(held) == chunk:
            yield packed()
            held = []
    if held:
        yield packed()


def walk(state: DataFrame, products: tuple, longest_after: float, n: int, block: int) -> DataFrame:
    """Every user's best n after these products, and whether later ones could still change them."""
    sent = state.sparkSession.sparkContext.broadcast(products)
    nobody = np.iinfo(np.int32).max

    def run(batches):
        import pyarrow as pa

        ids, factors, lengths = sent.value
        wide = factors.astype(np.float64)

        def padded(column, fill, kind):
            sizes = np.diff(column.offsets.to_numpy())
            out = np.full((len(column), n), fill, kind)
            out[np.arange(n) < sizes[:, None]] = column.flatten().to_numpy()
            return out

        def ordered(score, product):
            """One whole number for score and id: the larger comes first, ties to the smaller id."""
            bits = (score + np.float32(0)).view(np.int32)  # no zero below another
            bits = bits ^ ((bits >> 31) & nobody)
            number = bits.astype(np.int64) << 32 | (nobody - product)
            return np.where(np.isnan(score), np.iinfo(np.int64).min, number)

        def opened(number):
            """Scores and ids of such numbers."""
            bits = (number >> 32).astype(np.int32)
            return (bits ^ ((bits >> 31) & nobody)).view(np.float32), nobody - (number & nobody).astype(np.int32)

        def best(user, score, product):
            """One block after the other for the users it may concern."""
            norm, at = np.sqrt((user * user).sum(1)), np.arange(len(user))
            for first in range(0, len(ids), block):
                at = at[norm[at] * lengths[first] * SLACK >= score[at, -1]]
                if not len(at):
                    return
                part = np.zeros((len(at), len(ids[first : first + block])))
                for k in range(user.shape[1]):
                    part += user[at, k, None] * wide[None, first : first + block, k]
                part = part.astype(np.float32)
                better = (part >= score[at, -1:]).any(1)
                rows, part = at[better], part[better]
                both = np.concatenate((ordered(score[rows], product[rows]), ordered(part, ids[first : first + block])), 1)
                most = np.partition(both, both.shape[1] - n, axis=1)[:, -n:]
                most.sort(axis=1)
                score[rows], product[rows] = opened(most[:, ::-1])

        for batch in batches:
            for first in range(0, batch.num_rows, USERS_AT_ONCE):
                some = batch.slice(first, USERS_AT_ONCE)
                features = some.column(1)
                user = features.flatten().to_numpy().reshape(len(features), -1).astype(np.float64)
                product, score = padded(some.column(2), nobody, np.int32), padded(some.column(3), -np.inf, np.float32)
                best(user, score, product)
                is_open = np.sqrt((user * user).sum(1)) * longest_after * SLACK >= score[:, -1]
                real = product != nobody
                bounds = pa.array(np.concatenate(([0], np.cumsum(real.sum(1)))).astype(np.int32))
                lists = [pa.ListArray.from_arrays(bounds, pa.array(x[real])) for x in (product, score)]
                yield pa.RecordBatch.from_arrays([some.column(0), features, *lists, pa.array(is_open)], ["user_id", "features", "products", "ratings", "is_open"])

    return state.mapInArrow(run, "user_id int, features array<float>, products array<int>, ratings array<float>, is_open boolean")


def best_products(users: DataFrame, products: DataFrame, n: int = 15, chunk: int = CHUNK, block: int = BLOCK) -> DataFrame:
    """(user_id, recommendations): the n products with the largest inner product, best first, ties
    to the smaller id; ``users`` and ``products`` have id and features.

    Products come through the driver ``chunk`` at a time and only as long as some user is open; with
    a chunk that holds them all, as for categories, nothing runs here but the sort of the products.
    Fewer than n products give shorter lists, none give no rows.
    """
    state = users.select(F.col("id").alias("user_id"), "features", F.array().cast("array<int>").alias("products"), F.array().cast("array<float>").alias("ratings"))
    chunks, done = by_length(products, chunk), None
    part = next(chunks, None)
    if part is None:
        state = state.where("false")
    while part is not None:
        following = next(chunks, None)
        walked = walk(state, part, -np.inf if following is None else float(following[2][0]), n, block)
        if following is not None:
            walked = cut(walked, "walk")
            closed = walked.where("not is_open")
            done = closed if done is None else done.unionByName(closed)
            walked = walked.where("is_open")
            if walked.isEmpty():
                following = None
        state, part = walked.drop("is_open"), following
    lists = F.arrays_zip(F.col("products").alias("product_id"), F.col("ratings").alias("rating")).alias("recommendations")
    state = state.select("user_id", lists)
    return state if done is None else state.unionByName(done.select("user_id", lists))
