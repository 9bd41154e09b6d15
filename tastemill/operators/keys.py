"""Row-set tools: anti and semi joins, first row per key, dense ids, hot keys."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tastemill.session import cut

# A key is hot when it holds more than one row in HOT_SHARE. At most HOT_SHARE - 1 keys can
# hold that share, whatever the data, so a list of hot keys is always safe to broadcast.
# The rule is the same at every size, so small runs take the path that large ones take.
HOT_SHARE = 1000
# Counters of the heavy-hitter sketch: its counts are off by at most 3.5 rows in COUNTERS.
COUNTERS = 1 << 14


def drop_incomplete(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Drop a row when one of its columns is null."""
    return df.dropna("any", subset=columns)


def without_keys(df: DataFrame, removed: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Rows whose key does not occur in ``removed``.

    A null in the removed keys removes nothing, unlike NOT IN.
    """
    keys = keys or removed.columns
    return df.join(removed.select(*keys), keys, "left_anti")


def with_keys(df: DataFrame, kept: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Rows whose key occurs in ``kept``; never repeats a row."""
    keys = keys or kept.columns
    return df.join(kept.select(*keys), keys, "left_semi")


def detached(lookup: DataFrame) -> DataFrame:
    """Give up the partitioning a join or an aggregate left behind.

    AQE splits the hot partitions of a join only when both inputs come straight from
    an exchange. A key list that is already partitioned by the key skips its exchange,
    and a hot key of the big side would then stay in one task. One more shuffle of
    the small list buys the split.
    """
    return lookup.hint("rebalance")


def first_per_key(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The first row of every key in a declared order.

    Catalyst keeps one row per key and map task before the shuffle
    (``WindowGroupLimit``), so a hot key never travels whole.
    """
    position = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn("_first", position).where("_first = 1").drop("_first")


def union_distinct(*frames: DataFrame) -> DataFrame:
    """All rows of all frames, each once."""
    first, *rest = frames
    for other in rest:
        first = first.unionByName(other)
    return first.distinct()


def distinct_count(df: DataFrame, key: str, name: str = "n") -> DataFrame:
    return df.agg(F.count_distinct(key).alias(name))


def key_counts(df: DataFrame, keys: list[str], name: str = "n") -> DataFrame:
    """Rows per key; nulls in the key are left out, as a data-frame group-by would."""
    return drop_incomplete(df.select(*keys)).groupBy(*keys).agg(F.count("*").alias(name))


def hot_keys(counts: DataFrame, keys: list[str], name: str = "n") -> DataFrame:
    """Keys that hold more than one row in ``HOT_SHARE``; fewer than ``HOT_SHARE`` rows."""
    total = counts.agg(F.sum(name)).scalar()
    n = F.col(name)
    return counts.where(n * HOT_SHARE > total).select(*keys)


def heavy_hitters(rows: DataFrame, keys: list[str]) -> DataFrame:
    """(_hash, _hot): hashes of keys with more than half a row in ``HOT_SHARE``, hot above a whole one.

    Every task sketches its rows in bounded space and the sketches merge, so no row is shuffled and
    nothing runs before the plan does. Counts are off by a fifth of ``1 / HOT_SHARE`` at most: a key
    that one evaluation finds hot is listed by any other, in whatever order sketches were merged.
    """
    seen = rows.dropna("any", subset=keys).select(F.xxhash64(*keys).alias("_hash"))
    top = F.expr(f"approx_top_k(_hash, {2 * HOT_SHARE}, {COUNTERS})")
    found = seen.agg(F.count("*").alias("_all"), top.alias("_top")).select("_all", F.explode("_top").alias("_t"))
    n = F.col("_t.count") * HOT_SHARE
    return found.where(n * 2 > F.col("_all")).select(F.col("_t.item").alias("_hash"), (n > F.col("_all")).alias("_hot"))


def attach_per_key(rows: DataFrame, lookup: DataFrame, keys: list[str], slices: int = 64) -> DataFrame:
    """Inner join of rows to a lookup with one row per key, hot keys cut into slices.

    A lookup aggregated on the join key keeps its partitioning, and AQE cannot split
    such a join. So the rows of a hot key get a slice number, and its lookup row is
    repeated once per slice, as is that of every key that may be hot. The slice depends on
    the row and its input partition, never on a random number, so a lost task that runs
    again fills the same slices. ``rows`` are read twice, by the sketch and by the join.
    """
    heavy = F.broadcast(heavy_hitters(rows, keys))
    spread = F.pmod(F.xxhash64(*rows.columns) + F.spark_partition_id(), F.lit(slices)).cast("int")
    every = F.sequence(F.lit(0), F.lit(slices - 1))
    sliced = rows.withColumn("_hash", F.xxhash64(*keys)).join(heavy, "_hash", "left").withColumn("_slice", F.when(F.col("_hot"), spread).otherwise(0))
    copies = (
        lookup.withColumn("_hash", F.xxhash64(*keys)).join(heavy, "_hash", "left")
        .withColumn("_slice", F.explode(F.when(F.col("_hot").isNotNull(), every).otherwise(F.array(F.lit(0)))))
    )
    return sliced.drop("_hash", "_hot").join(copies.drop("_hash", "_hot"), [*keys, "_slice"]).drop("_slice")


def ordered_index(labels: DataFrame, order: list[Column], name: str) -> DataFrame:
    """Number rows 0, 1, 2 ... in a global order without one task seeing them all.

    The sort leaves every partition a contiguous range; a row's number is its position
    in the partition plus the sizes of the partitions before it. The ranges are fixed
    by a cut first, since they would be sampled anew on every evaluation.
    The order must be total.
    """
    position = F.monotonically_increasing_id()
    ranged = cut(labels.orderBy(*order).withColumn("_at", position), "ranges")
    partition = F.shiftrightunsigned("_at", 33)
    within = F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))
    sizes = ranged.groupBy(partition.alias("_part")).agg(F.count("*").alias("_size"))
    # One row per partition of the sort, a number set by configuration.
    before = F.sum("_size").over(Window.orderBy("_part")) - F.col("_size")
    offsets = F.broadcast(sizes.select("_part", before.alias("_offset")))
    return (
        ranged.withColumn("_part", partition)
        .join(offsets, "_part")
        .withColumn(name, F.col("_offset") + within)
        .drop("_at", "_part", "_offset")
    )


def number_within(rows: DataFrame, keys: list[str], order: list[Column], name: str, size: str) -> DataFrame:
    """Rows with their place within their key, from 0 in a declared order, and the key's size.

    A global range sort by key and order spreads a key that no task could hold over neighbouring
    partitions. A row's place is its place among the key's rows in its partition plus the key's
    rows in the partitions before: a running sum over one row per key and partition. The ranges
    are fixed by a cut, as in ``ordered_index``. Null keys have no place and drop out.
    """
    at = F.monotonically_increasing_id()
    ranged = cut(rows.dropna("any", subset=keys).orderBy(*keys, *order).withColumn("_at", at), "runs")
    ranged = ranged.withColumn("_part", F.shiftrightunsigned("_at", 33))
    runs = ranged.groupBy(*keys, "_part").agg(F.min("_at").alias("_first"), F.count("*").alias("_rows"))
    key = Window.partitionBy(*keys)
    earlier = F.coalesce(F.sum("_rows").over(key.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    runs = runs.select(*keys, "_part", "_first", earlier.alias("_before"), F.sum("_rows").over(key).alias(size))
    placed = ranged.join(detached(runs), [*keys, "_part"]).withColumn(name, F.col("_before") + F.col("_at") - F.col("_first"))
    return placed.drop("_at", "_part", "_first", "_before")
