"""Nearest neighbours by largest inner product, with vantage-point trees per shard.

Vectors get one more component that makes all of them equally long; the distance to a query (with
a zero there) then falls as the inner product grows, so a metric tree finds the largest products.
A node stores a vantage point and, for both halves, the range of distances to it. A half is
skipped when the triangle inequality rules out that it holds anything as near as the k-th found
so far; ``relax`` scales the bound, and 1 restores exact search. Every row is in a tree. A block of
queries walks a tree together: first each query to its home leaf, then all to every node left over.
"""

from __future__ import annotations

import math
import pickle

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tastemill.llm.shared import Cuts

SHARD_ROWS = 8192
QUERY_BLOCK = 1024
LEAF = 64
RELAX = 1.6


class VantageTree:
    """A tree over the rows of ``points``; ``order`` lists them leaf by leaf."""

    def __init__(self, points: np.ndarray, leaf: int = LEAF, seed: int = 7):
        self.points, self.order = points, np.arange(len(points))
        # node: first row, past the last, vantage point's row, nearest and farthest of both halves, children
        self.nodes: list[tuple] = []
        pick = np.random.default_rng(seed)
        if len(points):
            self._grow(0, len(points), leaf, pick)

    def _grow(self, begin: int, end: int, leaf: int, pick) -> int:
        at = len(self.nodes)
        self.nodes.append((begin, end, -1, None, -1, -1))
        if end - begin <= leaf:
            return at
        rows = self.order[begin:end]
        some = pick.choice(rows, min(8, len(rows)), replace=False)
        probe = self.points[pick.choice(rows, min(64, len(rows)), replace=False)]
        spread = [np.var(np.linalg.norm(probe - self.points[v], axis=1)) for v in some]
        vantage = int(some[int(np.argmax(spread))])
        far = np.linalg.norm(self.points[rows] - self.points[vantage], axis=1)
        by = np.argsort(far, kind="stable")
        self.order[begin:end], far = rows[by], far[by]
        middle = begin + (end - begin) // 2
        half = middle - begin
        ranges = (far[0], far[half - 1], far[half], far[-1])
        left = self._grow(begin, middle, leaf, pick)
        right = self._grow(middle, end, leaf, pick)
        self.nodes[at] = (begin, end, vantage, ranges, left, right)
        return at


def _merge(best: np.ndarray, found: np.ndarray, rows: np.ndarray, scores: np.ndarray, ids: np.ndarray) -> None:
    """Keep the k largest scores of each query, ties to the smaller id; in place for ``rows``."""
    k = best.shape[1]
    s = np.concatenate([best[rows], scores], axis=1)
    i = np.concatenate([found[rows], np.broadcast_to(ids, scores.shape)], axis=1)
    if s.shape[1] > 4 * k:
        # everything equal to the k-th score stays in the running for the tie rule
        kth = -np.partition(-s, k - 1, axis=1)[:, k - 1 : k]
        width = int((s >= kth).sum(axis=1).max())
        near = np.argpartition(-s, min(width, s.shape[1] - 1), axis=1)[:, :width] if width < s.shape[1] else np.arange(s.shape[1])[None, :].repeat(len(s), 0)
        s, i = np.take_along_axis(s, near, 1), np.take_along_axis(i, near, 1)
    by = np.lexsort((i, -s), axis=1)[:, :k]
    best[rows], found[rows] = np.take_along_axis(s, by, 1), np.take_along_axis(i, by, 1)


def search(tree: VantageTree, vectors: np.ndarray, ids: np.ndarray, longest: float, queries: np.ndarray, query_ids: np.ndarray, k: int, relax: float) -> tuple[np.ndarray, np.ndarray]:
    """Scores and ids of the k best rows of the tree for every query; -inf where there are fewer."""
    n = len(queries)
    best, found = np.full((n, k), -np.inf), np.full((n, k), np.iinfo(np.int64).max)
    reach = np.einsum("ij,ij->i", queries, queries) + longest * longest
    flat = np.concatenate([queries, np.zeros((n, 1))], axis=1)
    slack = 1e-9 * (1 + math.sqrt(float(reach.max()))) if n else 0.0

    def visit(node: tuple, rows: np.ndarray) -> None:
        members = tree.order[node[0] : node[1]]
        # not a matrix product of BLAS: equal vectors must get equal scores wherever they stand
        scores = np.einsum("id,jd->ij", queries[rows], vectors[members])
        scores[query_ids[rows][:, None] == ids[members][None, :]] = -np.inf
        _merge(best, found, rows, scores, ids[members])

    # down to each query's home leaf
    home = np.full(n, -1)
    level = [(0, np.arange(n))] if tree.nodes and n else []
    while level:
        at, rows = level.pop()
        node = tree.nodes[at]
        if node[2] < 0:
            home[rows] = at
            visit(node, rows)
            continue
        d = np.linalg.norm(flat[rows] - tree.points[node[2]], axis=1)
        near = d <= (node[3][1] + node[3][2]) / 2
        level += [(child, part) for child, part in ((node[4], rows[near]), (node[5], rows[~near])) if len(part)]
    # every other leaf that may hold something as near as the k-th so far
    stack = [(0, np.arange(n))] if tree.nodes and n else []
    while stack:
        at, rows = stack.pop()
        node = tree.nodes[at]
        if node[2] < 0:
            rows = rows[home[rows] != at]
            if len(rows):
                visit(node, rows)
            continue
        d = np.linalg.norm(flat[rows] - tree.points[node[2]], axis=1)
        with np.errstate(invalid="ignore"):
            limit = np.sqrt(np.maximum(reach[rows] - 2 * best[rows, k - 1], 0)) + slack
        near0, far0, near1, far1 = node[3]
        for child, lo, hi in ((node[5], near1, far1), (node[4], near0, far0)):
            bound = np.maximum(np.maximum(d - hi, lo - d), 0)
            keep = ~(bound * relax > limit)
            if keep.any():
                stack.append((child, rows[keep]))
    return best, found


def usable(vector: Column) -> Column:
    """Whether a vector has only finite components, and not only zeros."""
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return vector.isNotNull() & ~bad & F.exists(vector, lambda x: x != 0)


def nearest(rows: DataFrame, wanted: Column, k: int = 20, relax: float = RELAX, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """query_id, rank, vec_id, score: the k largest inner products for each query row.

    ``rows`` has vec_id and embedding; queries are the rows that ``wanted`` names, candidates all
    rows but those with the query's own vec_id. Vectors that are null, zero, empty or hold a null
    or non-finite component take no part, nor do rows without an id. Vectors of different widths
    have no inner product: each query meets the candidates of its own width, and every width has
    its own shards. Of rows that repeat an id and vector one counts.
    """
    cuts = Cuts(rows.sparkSession, "vptree")
    vector = F.col("embedding").cast("array<double>")
    table = rows.where(F.col("vec_id").isNotNull()).select(F.col("vec_id").cast("long").alias("vec_id"), vector.alias("v")).where(usable(F.col("v")))
    table = table.withColumn("_q", wanted)
    square = F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x)
    facts = table.groupBy(F.size("v").alias("width")).agg(F.count("*").alias("n"), F.sqrt(F.max(square)).alias("longest"))
    facts = cuts.save("facts", facts.select("width", F.ceil(F.col("n") / shard_rows).cast("int").alias("shards"), (F.col("longest") * (1 + 1e-12)).alias("longest")))
    table = table.withColumn("width", F.size("v")).join(facts, "width")
    shard = F.pmod(F.xxhash64("vec_id", F.lit("shard")), F.col("shards")).cast("int")

    def build(key, group):
        ids = group.column("vec_id").to_numpy()
        vectors = np.stack(group.column("v").to_numpy()).astype(np.float64)
        by = np.lexsort((*vectors.T[::-1], ids))
        ids, vectors = ids[by], vectors[by]
        once = np.ones(len(ids), bool)
        once[1:] = (ids[1:] != ids[:-1]) | (vectors[1:] != vectors[:-1]).any(axis=1)
        ids, vectors, longest = ids[once], vectors[once], group.column("longest")[0].as_py()
        rest = np.sqrt(np.maximum(longest**2 - np.einsum("ij,ij->i", vectors, vectors), 0))
        tree = VantageTree(np.concatenate([vectors, rest[:, None]], axis=1))
        width, number = (pa.array([k.as_py()], pa.int32()) for k in key)
        return pa.table({"width": width, "shard": number, "tree": pa.array([pickle.dumps((tree, vectors, ids, longest))], pa.binary())})

    sharded = table.select("width", shard.alias("shard"), "longest", "vec_id", "v")
    index = cuts.save("index", sharded.groupBy("width", "shard").applyInArrow(build, "width int, shard int, tree binary"))

    def block(batches):
        for batch in batches:
            widths = batch.column(0).to_numpy()
            for width in np.unique(widths).tolist():
                mine = batch.filter(pa.array(widths == width))
                ids, v = mine.column(1).to_numpy(), mine.column(2).to_numpy(zero_copy_only=False)
                for at in range(0, len(ids), QUERY_BLOCK):
                    some = slice(at, at + QUERY_BLOCK)
                    packed = pickle.dumps((ids[some], np.stack(v[some]).astype(np.float64)))
                    yield pa.RecordBatch.from_arrays([pa.array([width], pa.int32()), pa.array([packed], pa.binary())], ["width", "queries"])

    blocks = cuts.save("queries", table.where("_q").select("width", "vec_id", "v").distinct().mapInArrow(block, "width int, queries binary"))

    def walk(batches):
        for batch in batches:
            for packed_tree, packed_queries in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                tree, vectors, ids, longest = pickle.loads(packed_tree)
                query_ids, queries = pickle.loads(packed_queries)
                best, found = search(tree, vectors, ids, longest, queries, query_ids, k, relax)
                q, nth = np.nonzero(np.isfinite(best))
                ids_found = found[q, nth]
                yield pa.RecordBatch.from_arrays([pa.array(query_ids[q]), pa.array(ids_found), pa.array(best[q, nth])], ["query_id", "vec_id", "score"])

    # each block of queries visits each shard: the stated queries against all rows, in blocks
    visits = blocks.join(facts, "width").select("width", "queries", F.explode(F.sequence(F.lit(0), F.col("shards") - 1)).alias("shard"))
    found = index.join(visits, ["width", "shard"]).select("tree", "queries").mapInArrow(walk, "query_id long, vec_id long, score double")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
