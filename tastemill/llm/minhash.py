"""Near-duplicates by b-bit MinHash, confirmed on full shingle sets.

Texts with equal sets are one class, found by a fingerprint of the set. For each class the minima
of many hashes give band keys; of every minimum only the low bits are kept, packed into a few
longs. Candidates from the bands are estimated by counting equal bit groups, corrected for the
chance that low bits agree by accident, and what may reach the threshold is confirmed on the full
sets. Candidates are never all pairs of a bucket:

1. every member of a bucket meets the bucket's smallest member; links make components;
2. in buckets that still hold several components, members outside the smallest member's component
   meet all members, tile by tile, and only pairs of different components are estimated, each in
   the first band that it shares.

After that, every pair that shares a bucket either is in one component or has been compared; a
tile gives back links, at most one less than its rows, never its pairs.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tastemill.llm.shared import Cuts, components, text_bytes
from tastemill.llm.words import Texts, mix, runs_inside, slices, tidy, windows

_U = np.uint64
BANDS, ROWS = 32, 4  # on the first 128 minima
BITS = 4
HASHES = 256
PER_LONG = 64 // BITS
LONGS = HASHES // PER_LONG
MARGIN = 0.12  # four and a half standard deviations of the estimate at a similarity of 0.8
TILE = 512
ROWS_AT_ONCE = 64  # of a tile's one side; a pair that is looked at holds the bands of both
LOW = sum(1 << (BITS * i) for i in range(PER_LONG))
_FACTORS = np.random.default_rng(91).integers(1, 1 << 62, HASHES, dtype=np.int64).astype(_U) * _U(2) + _U(1)


def shingle_sets(part: Texts, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the distinct shingles of every text, sorted in each, and their bounds."""
    part.find_words()
    h = part.word_hashes()
    words = np.diff(part.words)
    w = windows(h, size)
    text_of = part.text_of_word()
    inside = runs_inside(part.words, size, len(w))
    hashes, owner = [w[inside]], [text_of[: len(w)][inside]]
    # with fewer words the whole sequence is the only shingle
    for n in range(1, size):
        short = np.flatnonzero(words == n)
        if len(short):
            whole = windows(h, n)[part.words[short]]
            hashes.append(mix(whole + _U(n * 0x9E3779B97F4A7C15 % 2**64)))
            owner.append(short)
    hashes, owner = np.concatenate(hashes), np.concatenate(owner)
    by = np.lexsort((hashes, owner))
    hashes, owner = hashes[by], owner[by]
    fresh = np.ones(len(hashes), bool)
    fresh[1:] = (hashes[1:] != hashes[:-1]) | (owner[1:] != owner[:-1])
    hashes, owner = hashes[fresh], owner[fresh]
    return hashes, np.searchsorted(owner, np.arange(part.count + 1))


def signatures(docs: DataFrame, size: int) -> DataFrame:
    """Of every row: set size, fingerprint, band keys, and the packed low bits of the minima."""

    def run(batches):
        for batch in batches:
            for part in slices(batch.column(1), fold=True):
                hashes, at = shingle_sets(part, size)
                n = np.diff(at)
                some = np.flatnonzero(n)
                minima = np.zeros((len(some), HASHES), _U)
                sums = np.zeros((2, part.count), _U)
                if len(some):
                    starts = at[some]
                    for j in range(HASHES):
                        minima[:, j] = np.minimum.reduceat(hashes * _FACTORS[j], starts)
                    sums[0, some] = np.add.reduceat(mix(hashes), starts)
                    sums[1, some] = np.add.reduceat(mix(hashes ^ _U(0xA5A5A5A5A5A5A5A5)), starts)
                bands = windows_of_rows(minima[:, : BANDS * ROWS].reshape(len(some), BANDS, ROWS))
                low = (minima & _U((1 << BITS) - 1)).reshape(len(some), LONGS, PER_LONG)
                packed = np.bitwise_or.reduce(low << (_U(BITS) * np.arange(PER_LONG, dtype=_U)), axis=2)

                def lists(values: np.ndarray) -> pa.Array:
                    counts = np.zeros(part.count + 1, np.int32)
                    counts[1:][some] = values.shape[1]
                    return pa.ListArray.from_arrays(pa.array(np.cumsum(counts, dtype=np.int32)), pa.array(np.ascontiguousarray(values).ravel().view(np.int64)))

                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(part.first, part.count), pa.array(n), *(pa.array(s.view(np.int64)) for s in sums), lists(bands), lists(packed)],
                    ["doc_id", "n_shingles", "f1", "f2", "bands", "bits"],
                )

    return text_bytes(docs).mapInArrow(tidy(run), "doc_id long, n_shingles long, f1 long, f2 long, bands array<long>, bits array<long>")


def windows_of_rows(minima: np.ndarray) -> np.ndarray:
    """One key for the minima of each band, different in every band."""
    key = np.zeros(minima.shape[:2], _U) + np.arange(BANDS, dtype=_U) * _U(0x9E3779B97F4A7C15)
    for r in range(minima.shape[2]):
        key = mix(key + minima[:, :, r])
    return key


def estimate(a: str, b: str):
    """Similarity by counting equal groups of bits, corrected for groups that agree by chance."""
    differ = None
    for i in range(LONGS):
        x = F.col(a)[i].bitwiseXOR(F.col(b)[i])
        for half in (2, 1):
            x = x.bitwiseOR(F.shiftrightunsigned(x, half))
        n = F.bit_count(x.bitwiseAND(F.lit(LOW)))
        differ = n if differ is None else differ + n
    chance = 2.0**-BITS
    return ((1 - differ / HASHES) - chance) / (1 - chance)


def meet(e: dict[str, np.ndarray], f: dict[str, np.ndarray], key: int, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """Of one tile, the pairs of different components that may reach the threshold."""
    found = [(np.zeros(0, np.int64),) * 2]
    for at in range(0, len(e["c"]), ROWS_AT_ONCE):
        i, j = _meet({k: v[at : at + ROWS_AT_ONCE] for k, v in e.items()}, f, key, percent)
        found.append((i + at, j))
    return tuple(np.concatenate(x) for x in zip(*found, strict=True))


def _meet(e: dict[str, np.ndarray], f: dict[str, np.ndarray], key: int, percent: int) -> tuple[np.ndarray, np.ndarray]:
    i, j = np.nonzero(
        (e["c"][:, None] != f["c"][None, :])
        & ~(e["outside"][:, None] & (e["doc_id"][:, None] >= f["doc_id"][None, :]))
        & (100 * np.minimum(e["n"][:, None], f["n"][None, :]) >= percent * np.maximum(e["n"][:, None], f["n"][None, :]))
    )
    if len(i) == 0:
        return i, j
    differ = np.zeros(len(i), np.int64)
    for part in range(LONGS):
        x = e["bits"][i, part] ^ f["bits"][j, part]
        x |= x >> _U(2)
        x |= x >> _U(1)
        differ += np.bitwise_count(x & _U(LOW))
    chance = 2.0**-BITS
    near = ((1 - differ / HASHES) - chance) / (1 - chance) >= percent / 100 - MARGIN
    i, j = i[near], j[near]
    shared = e["bands"][i] == f["bands"][j]
    here = e["bands"][i, shared.argmax(axis=1)] == np.uint64(key) if len(i) else np.zeros(0, bool)
    return i[here], j[here]


def tiles_of(batches) -> Iterator[tuple[tuple[int, int, int], dict[str, np.ndarray]]]:
    """The rows of one (key, tile, strip) after another from batches sorted by them."""
    rest = None
    for batch in chain(batches, (None,)):
        table = pa.Table.from_batches([batch]) if batch is not None else None
        if rest is not None:
            table = rest if table is None else pa.concat_tables([rest, table])
        if table is None or table.num_rows == 0:
            continue
        table = table.combine_chunks()
        place = np.stack([table.column(k).to_numpy().astype(np.int64) for k in ("key", "tile", "strip")], axis=1)
        turns = np.flatnonzero((place[1:] != place[:-1]).any(axis=1)) + 1
        bounds = np.concatenate(([0], turns, [len(place)] if batch is None else [])).astype(int)
        rest = table.slice(int(bounds[-1])) if batch is not None else None
        values = {k: table.column(k).to_numpy() for k in ("doc_id", "c", "n", "role")}
        values["outside"] = table.column("outside").to_numpy().astype(bool)
        for k, width in (("bits", LONGS), ("bands", BANDS)):
            values[k] = lists_of(table, k)[0].view(np.uint64).reshape(-1, width)
        sets = lists_of(table, "set") if "set" in table.column_names else None
        for at, end in zip(bounds[:-1], bounds[1:], strict=True):
            rows = {k: v[at:end] for k, v in values.items()}
            if sets is not None:
                rows["set"] = np.empty(end - at, object)
                for r in range(at, end):
                    rows["set"][r - at] = sets[0][sets[1][r] : sets[1][r + 1]]
            yield tuple(int(x) for x in place[at]), rows


def lists_of(table: pa.Table, name: str) -> tuple[np.ndarray, np.ndarray]:
    """Values and offsets of a list column."""
    column = table.column(name).combine_chunks()
    column = column.chunk(0) if isinstance(column, pa.ChunkedArray) else column
    at = column.offsets.to_numpy()
    return column.flatten().to_numpy(), at - at[0]


def sides(rows: dict[str, np.ndarray]) -> tuple[dict[str, np.ndarray], dict[str, np.ndarray]]:
    return tuple({k: v[rows["role"] == r] for k, v in rows.items()} for r in (0, 1))


def likely_in_tiles(rows: DataFrame, percent: int) -> DataFrame:
    """The rows of each tile that may have a link there, as (key, tile, strip, doc_id)."""

    def run(batches):
        for (key, tile, strip), group in tiles_of(batches):
            e, f = sides(group)
            i, j = meet(e, f, key & (2**64 - 1), percent)
            docs = np.unique(np.concatenate([e["doc_id"][i], f["doc_id"][j]]))
            if len(docs):
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(docs), x)) for x in (key, tile, strip)] + [pa.array(docs)], ["key", "tile", "strip", "doc_id"])

    return rows.mapInArrow(tidy(run), "key long, tile long, strip long, doc_id long")


def linked_in_tiles(rows: DataFrame, percent: int) -> DataFrame:
    """Links (a, b) of each tile, confirmed on full sets; of those between the same two
    components or documents that are already joined in the tile one is enough."""

    def run(batches):
        for (key, _, _), group in tiles_of(batches):
            e, f = sides(group)
            i, j = meet(e, f, key & (2**64 - 1), percent)
            if not len(i):
                continue
            number = np.unique(np.concatenate([*e["set"], *f["set"]]))
            local = [np.searchsorted(number, x) for x in e["set"]]
            mark = np.zeros(len(number), bool)
            joined: dict[int, int] = {}
            a, b = [], []
            by = np.argsort(j, kind="stable")
            for y, some in zip(*_runs(j[by], i[by]), strict=True):
                own = np.searchsorted(number, f["set"][y])
                mark[own] = True
                sizes = np.array([len(local[x]) for x in some])
                common = np.add.reduceat(mark[np.concatenate([local[x] for x in some])].astype(np.int64), np.cumsum(sizes) - sizes)
                mark[own] = False
                for x in some[100 * common >= percent * (sizes + len(own) - common)]:
                    left, right = _root(joined, int(e["c"][x])), _root(joined, int(f["c"][y]))
                    if left != right:
                        joined[max(left, right)] = min(left, right)
                        a.append(int(e["doc_id"][x]))
                        b.append(int(f["doc_id"][y]))
            if a:
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    return rows.mapInArrow(tidy(run), "a long, b long")


def _runs(keys: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
    first = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
    return keys[first], np.split(values, first[1:])


def _root(joined: dict[int, int], x: int) -> int:
    while x in joined:
        x = joined[x]
    return x


def full_sets(docs: DataFrame, wanted: DataFrame, size: int) -> DataFrame:
    """doc_id and sorted set of the documents named by ``wanted`` (doc_id)."""

    def run(batches):
        for batch in batches:
            for part in slices(batch.column(1), fold=True):
                hashes, at = shingle_sets(part, size)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(part.first, part.count), pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.array(hashes.view(np.int64)))],
                    ["doc_id", "set"],
                )

    return text_bytes(docs).join(wanted, "doc_id", "left_semi").mapInArrow(tidy(run), "doc_id long, set array<long>")


def confirmed(cuts: Cuts, docs: DataFrame, pairs: DataFrame, size: int, percent: int, name: str) -> DataFrame:
    """Of the pairs (a, b) of representatives those whose full sets are similar enough."""
    wanted = cuts.save(f"{name}-wanted", pairs.select(F.explode(F.array("a", "b")).alias("doc_id")).distinct())
    sets = cuts.save(f"{name}-sets", full_sets(docs, wanted, size))
    both = pairs.join(sets.select(F.col("doc_id").alias("a"), F.col("set").alias("sa")), "a").join(sets.select(F.col("doc_id").alias("b"), F.col("set").alias("sb")), "b")
    common = F.size(F.array_intersect("sa", "sb"))
    union = F.size("sa") + F.size("sb") - common
    found = cuts.save(f"{name}-links", both.where(100 * common >= percent * union).select("a", "b"))
    cuts.drop(f"{name}-wanted", f"{name}-sets")
    return found


def groups(docs: DataFrame, size: int = 4, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id, kept of every row of ``docs`` (doc_id, text).

    Texts are linked when 100 * intersection >= percent * union of their sets of ``size``-word
    shingles, words lower-cased in A-Z; component_id is the smallest doc_id reachable. A null,
    empty or wordless text has an empty set and is linked with nothing, nor is a row without
    doc_id. Rows that repeat an id are one document in the result of links; other columns are
    ignored; an empty table gives no rows.
    """
    cuts = Cuts(docs.sparkSession, "minhash")
    signed = cuts.save("signed", signatures(docs, size))
    linkable = signed.where("n_shingles > 0 and doc_id is not null")
    classes = cuts.save("classes", linkable.groupBy("f1", "f2", "n_shingles").agg(F.min("doc_id").alias("rep")))
    reps = classes.select(F.col("rep").alias("doc_id"), "f1", "f2", "n_shingles")
    # a representative may stand in several rows with its id; those with its fingerprint are equal
    heads = cuts.save("heads", linkable.join(reps, ["doc_id", "f1", "f2", "n_shingles"]).dropDuplicates(["doc_id", "f1", "f2"]).select("doc_id", F.col("n_shingles").alias("n"), "bands", "bits"))
    members = heads.select("doc_id", F.explode("bands").alias("key"))
    buckets = cuts.save("buckets", members.groupBy("key").agg(F.count("*").alias("n"), F.min("doc_id").alias("first")).where("n > 1"))
    held = cuts.save("held", members.join(buckets, "key"))
    bits = heads.select("doc_id", "bits")

    def likely(pairs: DataFrame) -> DataFrame:
        both = pairs.join(bits.select(F.col("doc_id").alias("a"), F.col("bits").alias("xa")), "a").join(bits.select(F.col("doc_id").alias("b"), F.col("bits").alias("xb")), "b")
        return both.where(estimate("xa", "xb") >= percent / 100 - MARGIN).select("a", "b")

    stars = held.where("doc_id <> first").select(F.col("first").alias("a"), F.col("doc_id").alias("b")).distinct()
    links = confirmed(cuts, docs, cuts.save("stars", likely(stars)), size, percent, "star")
    label = components(cuts, links, "star-component")
    held = cuts.save("labelled", held.join(label, held.doc_id == label.node, "left").select("key", "doc_id", "first", F.coalesce("component", "doc_id").alias("c")))
    mixed = held.groupBy("key").agg(F.count("*").alias("k"), F.max(F.when(F.col("doc_id") == F.col("first"), F.col("c"))).alias("c0"), F.min("c").alias("lo"), F.max("c").alias("hi")).where("lo <> hi")
    mixed = cuts.save("mixed", mixed.select("key", "k", "c0"))
    apart = cuts.save("apart", held.join(mixed, "key").select("key", "doc_id", "c", "k", (F.col("c") != F.col("c0")).alias("outside")))
    outside = cuts.save("outside", apart.where("outside").groupBy("key").agg(F.count("*").alias("s")))
    tiles, strips = F.ceil(F.col("k") / TILE).cast("int"), F.ceil(F.col("s") / TILE).cast("int")
    place = F.xxhash64("doc_id")
    sized = apart.join(outside, "key").join(heads.select("doc_id", "n", "bits", "bands"), "doc_id")
    every = sized.withColumn("tile", F.pmod(place, tiles).cast("int")).withColumn("strip", F.explode(F.sequence(F.lit(0), strips - 1))).withColumn("role", F.lit(0))
    few = sized.where("outside").withColumn("tile", F.explode(F.sequence(F.lit(0), tiles - 1))).withColumn("strip", F.pmod(place, strips).cast("int")).withColumn("role", F.lit(1))
    placed = every.unionByName(few).select("key", "tile", "strip", "doc_id", "c", "n", "outside", "role", "bits", "bands")
    tile = ["key", "tile", "strip"]

    def dealt(rows: DataFrame) -> DataFrame:
        return rows.repartition(*tile).sortWithinPartitions(*tile)

    near = cuts.save("near", likely_in_tiles(dealt(placed), percent))
    if not near.isEmpty():
        sets = cuts.save("sets", full_sets(docs, cuts.save("wanted", near.select("doc_id").distinct()), size))
        again = placed.join(near, [*tile, "doc_id"], "left_semi").join(sets, "doc_id")
        more = cuts.save("more", linked_in_tiles(dealt(again), percent))
        label = components(cuts, links.unionByName(more), "component")
    cuts.drop("held", "labelled", "mixed", "apart", "outside", "buckets", "heads", "stars", "near")
    final = cuts.save("final", classes.join(label, classes.rep == label.node, "left").select("f1", "f2", "n_shingles", F.coalesce("component", "rep").alias("component_id")))
    found = signed.select("doc_id", "n_shingles", "f1", "f2").join(final, ["f1", "f2", "n_shingles"], "left")
    found = found.select("doc_id", "n_shingles", F.when((F.col("n_shingles") > 0) & F.col("doc_id").isNotNull(), F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"))
    return found.withColumn("kept", F.coalesce(F.col("component_id") == F.col("doc_id"), F.lit(True)))
