"""Taste profiles: weighted browse and purchase counts scored by global quantiles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tastemill.functions import fixed, scoring
from tastemill.functions.text import concat_key
from tastemill.levels import Level
from tastemill.operators.filters import UNKNOWN_KEY, coalesce_counts
from tastemill.operators.keys import attach_per_key, key_counts, without_keys
from tastemill.session import cut

BANDS_PER_DOUBLING = 1024


def with_category(df: DataFrame, level: Level) -> DataFrame:
    """Put the level's name, its parts joined by a blank, next to the customer."""
    name = concat_key(*[F.col(p) for p in level.parts], sep=" ")
    return df.select("cust_id", name.alias("category"), *level.columns)


def browse_by_level(views: DataFrame, level: Level) -> DataFrame:
    """The level's columns of the click table; only the unknown customer is left out."""
    unknown = F.col("cust_id").cast("string") == UNKNOWN_KEY
    return with_category(views.where(unknown.isNull() | ~unknown), level)


def trans_by_level(sales: DataFrame, level: Level) -> DataFrame:
    """The level's columns of the purchase history."""
    return with_category(sales, level)


def count_by_level(df: DataFrame, level: Level, name: str) -> DataFrame:
    """Rows per customer and category; incomplete rows count nowhere."""
    return key_counts(df, level.keys, name)


def outer_merge_counts(browses: DataFrame, purchases: DataFrame, level: Level) -> DataFrame:
    """Browse and purchase counts side by side, 0 where one is missing."""
    joined = browses.join(purchases, level.keys, "full_outer")
    return coalesce_counts(joined, ["times_browse", "total_transactions"])


def taste_counts(views: DataFrame, sales: DataFrame, level: Level) -> DataFrame:
    """Browses and purchases per customer and category in one shuffle.

    Equal to merging the two counts, but both sides are tagged, stacked and counted
    together: one partial aggregate and one exchange instead of two and an outer join.
    The name is made of the parts, so it is put to the counts and not shuffled with the rows.
    """
    keys = ["cust_id", *level.columns]
    browses = browse_by_level(views, level).withColumns({"_browse": F.lit(1), "_trans": F.lit(0)})
    buys = trans_by_level(sales, level).withColumns({"_browse": F.lit(0), "_trans": F.lit(1)})
    rows = browses.unionByName(buys).drop("category").dropna("any", subset=keys)
    counts = rows.groupBy(*keys).agg(F.sum("_browse").alias("times_browse"), F.sum("_trans").alias("total_transactions"))
    name = concat_key(*[F.col(p) for p in level.parts], sep=" ")
    return counts.withColumn("category", name).select(*level.keys, "times_browse", "total_transactions")


def with_implicit_rank(counts: DataFrame) -> DataFrame:
    value = scoring.implicit_rank(F.col("total_transactions"), F.col("times_browse"))
    return counts.withColumn("rank_implicit", value)


def _cells(bands: DataFrame, places: Column) -> DataFrame:
    """The bands that hold wanted places, as one row with one list: least and greatest value,
    place, number of values before, and of all."""
    upto, everything = F.sum("n").over(Window.orderBy("band")), F.sum("n").over(Window.partitionBy())
    counted = bands.withColumn("upto", upto).withColumn("before", F.col("upto") - F.col("n")).withColumn("all", everything)
    placed = counted.withColumn("place", F.explode(places))
    held = placed.where((F.col("before") <= F.col("place")) & (F.col("place") < F.col("upto")))
    return held.agg(F.collect_list(F.struct("low", "high", "before", "place", "all")).alias("cells"))


def _opened(values: DataFrame, cells: DataFrame) -> DataFrame:
    """Values inside the cells, with the cell's columns."""
    inside = values.withColumn("_cells", cells.scalar())
    return inside.select("v", "n", F.inline(F.filter("_cells", lambda c: F.col("v").between(c["low"], c["high"]))))


def taste_quantiles(ranked: DataFrame) -> DataFrame:
    """Exact interpolated quantiles of the implicit rank, as one row with one array.

    Rows are folded once to one per distinct value. Bands of the logarithm, at most
    ``BANDS_PER_DOUBLING`` for each power of two, make a bounded histogram, all that one task sees;
    only the values of the few bands that hold a wanted place are then counted one by one, each
    band in a task of its own. No values give a null.
    """
    value = F.col("rank_implicit")
    values = ranked.where(value.isNotNull()).groupBy(value.alias("v")).agg(F.count("*").alias("n"))
    band = F.floor(F.signum("v") * F.log2(1 + F.abs("v")) * BANDS_PER_DOUBLING)
    exact = [(F.col("all") - 1) * q for q in fixed.TASTE_QUANTILES]
    places = F.array_distinct(F.array(*[edge(place) for place in exact for edge in (F.floor, F.ceil)]))
    bands = values.groupBy(band.alias("band")).agg(F.sum("n").alias("n"), F.min("v").alias("low"), F.max("v").alias("high"))
    last = _opened(values, _cells(bands, places))
    upto = F.col("before") + F.sum("n").over(Window.partitionBy("place").orderBy("v"))
    ends = last.withColumn("_upto", upto).where(F.col("_upto") > F.col("place")).groupBy("place", "all").agg(F.min("v").alias("v"))
    found = ends.agg(F.max("all").alias("all"), F.map_from_entries(F.collect_list(F.struct("place", "v"))).alias("at"))
    between = []
    for place in exact:
        low, high = F.element_at("at", F.floor(place)), F.element_at("at", F.ceil(place))
        between.append(F.when(low == high, low).otherwise((F.ceil(place) - place) * low + (place - F.floor(place)) * high))
    return found.select(F.when(F.col("all").isNotNull(), F.array(*between)).alias("quantiles"))


def score_taste(ranked: DataFrame) -> DataFrame:
    """The score next to the rank; the quantiles become a column, so the plan holds them once."""
    score = scoring.taste_score(F.col("rank_implicit"), F.col("_q"))
    return ranked.withColumn("_q", taste_quantiles(ranked).scalar()).withColumn("score", score).drop("_q")


def taste_profile(views: DataFrame, sales: DataFrame, level: Level, held: bool = False) -> DataFrame:
    """Score 1 to 5 per customer and category of a level.

    ``held`` cuts the ranks: the quantiles and the scores both read them, and in a plan of their own
    that runs adaptively the counts behind may run once for each.
    """
    ranked = with_implicit_rank(taste_counts(views, sales, level))
    if held:
        ranked = cut(ranked.select(*level.keys, "rank_implicit"), "ranks")
    return score_taste(ranked).select(*level.keys, "score")


def top_n_per_customer(profile: DataFrame, n: int = 15, score: str = "score", place: str | None = None,
                       ties: list[str] | None = None) -> DataFrame:
    """Best-scored categories of every customer; ties go by category name, then by ``ties``.

    ``place`` names a column for the position. Catalyst keeps n rows per customer and
    map task before the shuffle.
    """
    order = Window.partitionBy("cust_id").orderBy(F.col(score).desc(), "category", *(ties or []))
    top = profile.withColumn("_place", F.row_number().over(order)).where(F.col("_place") <= n)
    return top.withColumnRenamed("_place", place) if place else top.drop("_place")


def combined_rating(profile: DataFrame, ratings: DataFrame, score: str = "score") -> DataFrame:
    """Profile rows next to every rating of the customer; 0 without any.

    The rating side is the large and skewed one, so it is the sliced side of the
    join, and each customer's few profile rows travel as one array. The ratings are read
    three times: where they are dear to make, hand them over cut.
    """
    held = profile.select("cust_id", F.struct(*[c for c in profile.columns if c != "cust_id"]).alias("_row"))
    # At most the n rows of top_n_per_customer, so the array is small.
    packed = held.groupBy("cust_id").agg(F.collect_list("_row").alias("_rows"))
    rated = ratings.select("cust_id", "rating")
    matched = (
        attach_per_key(rated, packed, ["cust_id"])
        .select("cust_id", "rating", F.explode("_rows").alias("_row"))
        .select("cust_id", "_row.*", (F.col(f"_row.{score}") + F.col("rating")).alias("combined_rating"))
    )
    unrated = without_keys(profile, rated.select("cust_id").distinct()).withColumn("combined_rating", F.lit(0.0))
    return matched.withColumn("combined_rating", F.coalesce("combined_rating", F.lit(0.0))).unionByName(unrated)
