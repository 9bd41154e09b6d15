"""Collaborative filtering on taste scores with Spark ML's ALS."""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.ml.recommendation import ALS, ALSModel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tastemill.functions import scoring
from tastemill.functions.text import concat_key
from tastemill.levels import Level
from tastemill.operators.keys import ordered_index
from tastemill.operators.topn import best_products
from tastemill.session import cut, side_by_side

TASKS_PER_CORE = 4  # in which lists are made: enough that none waits long for the last


@dataclass(frozen=True)
class ALSSettings:
    """Best parameters found for the category levels, and what makes a run repeatable."""

    rank: int = 3
    reg: float = 0.05
    iterations: int = 10
    train_share: float = 0.8
    refit_on_all: bool = False
    seed: int = 7
    # User blocks grow with the data and follow the session's shuffle partitions. A level has few
    # categories, but their side of a step reads every rating: its blocks are the tasks it runs in.
    user_blocks: int | None = None
    item_blocks: int = 8

    def users_in(self, df: DataFrame) -> int:
        return self.user_blocks or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def product_key(level: Level):
    """Readable label of a category; joins use its columns, never this text."""
    return concat_key(*[F.col(c) for c in level.product_columns], sep="_")


def index_ids(df: DataFrame, columns: list[str], name: str) -> DataFrame:
    """Dense ids 0..n-1 for the distinct values, most frequent first, ties by value.

    The numbers a string indexer would give, without its label list on the driver.
    """
    counts = df.groupBy(*columns).agg(F.count("*").alias("_freq"))
    ids = ordered_index(counts, [F.col("_freq").desc(), *[F.col(c) for c in columns]], name).drop("_freq")
    # the factor model's ids are whole numbers of 32 bits
    return ids.withColumn(name, F.col(name).cast("int"))


def label_encode(df: DataFrame, column: str, name: str) -> DataFrame:
    """Dense ids in sorted order of the distinct values."""
    return ordered_index(df.select(column).distinct(), [F.col(column)], name)


def in_train_split(keys: list[str], share: float = 0.8, seed: int = 7):
    """Whether a key falls into the training part; the same on every run and cluster."""
    digest = F.md5(concat_key(F.lit(seed), *[F.col(k) for k in keys], sep="|"))
    number = F.conv(F.substring(digest, 1, 8), 16, 10).cast("bigint")
    return number < int(share * (1 << 32))


def split_train_validation(df: DataFrame, keys: list[str], share: float = 0.8, seed: int = 7) -> tuple[DataFrame, DataFrame]:
    chosen = in_train_split(keys, share, seed)
    return df.where(chosen), df.where(~chosen)


def als(settings: ALSSettings, user_blocks: int) -> ALS:
    return ALS(
        rank=settings.rank, regParam=settings.reg, maxIter=settings.iterations, implicitPrefs=False,
        coldStartStrategy="drop", userCol="user_id", itemCol="product_id", ratingCol="score",
        numUserBlocks=user_blocks, numItemBlocks=settings.item_blocks, seed=settings.seed,
    )


def steady_layout(ratings: DataFrame, blocks: int) -> DataFrame:
    """Same rows, same partitions, same order: ALS then gives the same factors again.

    A partition holds the users of one ALS block, which are those of one remainder, so it hands on one
    part for each block of products. Users spread by another rule make parts for every pair of blocks.
    """
    return ratings.repartitionById(blocks, F.pmod(F.col("user_id"), F.lit(blocks)).cast("int")).sortWithinPartitions("user_id", "product_id")


def fit_als(train: DataFrame, settings: ALSSettings = ALSSettings()) -> ALSModel:
    """A model of the ratings. The layout is held while it is fitted: the fit asks for its rows twice, and
    the split and the shuffle behind them would run each time."""
    blocks = settings.users_in(train)
    layout = steady_layout(train, blocks).persist()
    try:
        return als(settings, blocks).fit(layout)
    finally:
        layout.unpersist()


def evaluate(predictions: DataFrame, label: str = "score", prediction: str = "prediction") -> DataFrame:
    """Root mean square and mean absolute error, as one row."""
    error = F.col(label) - F.col(prediction)
    return predictions.agg(
        F.sqrt(F.avg(error * error)).alias("rmse"), F.avg(F.abs(error)).alias("mae"), F.count("*").alias("n"))


def als_residuals(model: ALSModel, ratings: DataFrame, settings: ALSSettings = ALSSettings()) -> DataFrame:
    """(user_id, n_ratings, residual): how far each user's factors are from solving the ridge
    equations of the user's ratings.

    A fit solves the products' side and then the users' side. With the product factors v fixed, the
    user factors u must then make the gradient zero: the sum of v (v.u - rating) plus n times reg times
    u. The residual is the largest component, divided by the number n of ratings, so it is the same
    for short and long histories. Sums combine before the shuffle; users without ratings have no row.
    """
    users = model.userFactors.select(F.col("id").alias("user_id"), F.col("features").alias("_u"))
    products = model.itemFactors.select(F.col("id").alias("product_id"), F.col("features").alias("_v"))
    dot = F.aggregate(F.zip_with("_u", "_v", lambda a, b: a.cast("double") * b), F.lit(0.0), lambda total, x: total + x)
    rows = ratings.join(products, "product_id").join(users, "user_id").withColumn("_error", dot - F.col("score"))
    each = range(model.rank)
    sums = rows.groupBy("user_id").agg(
        F.count("*").alias("n_ratings"), F.first("_u").alias("_u"), *[F.sum(F.get("_v", F.lit(k)) * F.col("_error")).alias(f"_g{k}") for k in each])
    gradient = [F.abs(F.col(f"_g{k}") / F.col("n_ratings") + settings.reg * F.get("_u", F.lit(k))) for k in each]
    return sums.select("user_id", "n_ratings", F.array_max(F.array(*gradient)).alias("residual"))


def tune_als(train: DataFrame, validation: DataFrame, ranks: tuple = (3, 5), regs: tuple = (0.05, 0.1),
             settings: ALSSettings = ALSSettings()) -> tuple[DataFrame, ALSSettings]:
    """Validation error of every pair of the grid, and the settings with the least RMSE.

    The fits run side by side over one layout of the ratings that is held for all of them. A row
    of error for each fit is all that reaches the driver.
    """
    spark = train.sparkSession
    layout = steady_layout(train, settings.users_in(train)).persist()
    tries = [replace(settings, rank=rank, reg=reg) for rank in ranks for reg in regs]

    def error_of(tried: ALSSettings) -> tuple[float, float]:
        model = als(tried, tried.users_in(train)).fit(layout)
        row = evaluate(model.transform(validation)).first()
        return row["rmse"], row["mae"]

    try:
        errors = side_by_side(spark, error_of, tries, "tuning")
    finally:
        layout.unpersist()
    rows = [(tried.rank, tried.reg, *error) for tried, error in zip(tries, errors, strict=True)]
    grid = spark.createDataFrame(rows, "rank int, reg double, rmse double, mae double")
    return grid, min(zip(rows, tries, strict=True), key=lambda pair: pair[0][2])[1]


def indexed_scores(profile: DataFrame, level: Level, held: bool = True) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Scores by dense user and product id, with the two id tables.

    Profile and scores are cut, since indexes and scores read the one, and every
    fit and every iteration of a grid the other. Without ``held`` the scores are not cut, for a
    single fit, which reads them once.
    """
    profile = cut(profile)
    wanted = [(["cust_id"], "user_id"), (level.product_columns, "product_id")]
    users, products = side_by_side(profile.sparkSession, lambda of: index_ids(profile, *of), wanted, "index")
    scores = (
        profile.join(users, "cust_id")
        .join(products, level.product_columns)
        .select("user_id", "product_id", F.col("score").cast("double").alias("score"))
    )
    return cut(scores) if held else scores, users, products


def open_recommendations(packed: DataFrame, user: str = "user_id") -> DataFrame:
    """One row per recommendation, ranked from 1 in the order of the list."""
    return packed.select(user, F.posexplode("recommendations").alias("pos", "rec")).select(
        user,
        F.col("rec.product_id").alias("product_id"),
        (F.col("pos") + 1).alias("propensity_rank"),
        F.col("rec.rating").cast("double").alias("propensity_score"),
    )


def scale_scores(recs: DataFrame) -> DataFrame:
    """Scores moved to 1..100 over all recommendations; the range is one scalar row.

    The scalar becomes a column first, so that the plan holds its query once.
    """
    score = F.col("propensity_score")
    span = recs.agg(F.struct(F.min(score).alias("low"), F.max(score).alias("high"))).scalar()
    scaled = scoring.minmax_scale(score, F.col("_span.low"), F.col("_span.high"))
    return recs.withColumn("_span", span).withColumn("propensity_score", scaled).drop("_span")


def recommend(profile: DataFrame, level: Level, settings: ALSSettings = ALSSettings(), n: int = 15,
              indexed: tuple[DataFrame, DataFrame, DataFrame] | None = None) -> DataFrame:
    """The n best categories per customer, scored 1 to 100.

    The recommendations are cut once, since score range and output both read them. Lists meet their
    customers before they are opened, a row for each customer. ``indexed`` are the ``indexed_scores`` of
    the profile, where they are there already.
    """
    scores, users, products = indexed or indexed_scores(profile, level, held=False)
    train = scores
    if not settings.refit_on_all:
        train, _ = split_train_validation(scores, ["user_id", "product_id"], settings.train_share, settings.seed)
    model = fit_als(train, settings)
    # Factors lie in a partition for each user block; starting a Python task for each took longer than its lists.
    factors = model.userFactors.coalesce(TASKS_PER_CORE * profile.sparkSession.sparkContext.defaultParallelism)
    packed = best_products(factors, model.itemFactors, n)
    recs = cut(open_recommendations(packed.join(users, "user_id"), "cust_id"))
    named = scale_scores(recs).join(products, "product_id")
    return named.select(*level.keys, "propensity_score", "propensity_rank")
