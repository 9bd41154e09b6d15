"""One-feature clustering with Spark ML's k-means."""

from __future__ import annotations

from pyspark.ml.clustering import KMeans, KMeansModel
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tastemill.session import cut, side_by_side


def cluster_means(df: DataFrame, cluster: str, feature: str) -> DataFrame:
    return df.groupBy(cluster).agg(F.avg(feature).alias("mean_value"))


def relabel_clusters(df: DataFrame, cluster: str, feature: str, ascending: bool = True) -> DataFrame:
    """Replace cluster ids by the rank of their mean."""
    mean = F.col("mean_value").asc() if ascending else F.col("mean_value").desc()
    # One row per cluster, so the window and the broadcast hold k rows.
    ranks = cluster_means(df, cluster, feature).select(
        cluster, (F.row_number().over(Window.orderBy(mean, F.col(cluster))) - 1).alias("_rank"))
    return df.join(F.broadcast(ranks), cluster).withColumn(cluster, F.col("_rank")).drop("_rank")


def _weighted_values(df: DataFrame, feature: str, held: bool = False) -> DataFrame:
    """Distinct values with their counts: the same clustering from far fewer rows.

    ``held`` writes the fold once. Read again it has as many partitions as its size asks for, not as
    many as the shuffle behind it: a fit runs a job for each of its steps over all of them. Where a
    fit begins depends on that layout, as on the session's shuffle partitions.
    """
    values = df.select(F.col(feature).cast("double").alias(feature)).dropna()
    counted = values.groupBy(feature).agg(F.count("*").cast("double").alias("weight"))
    return VectorAssembler(inputCols=[feature], outputCol="features").transform(cut(counted, "values") if held else counted)


def _kmeans(k: int, seed: int, iterations: int) -> KMeans:
    return KMeans(k=k, seed=seed, maxIter=iterations, featuresCol="features", weightCol="weight")


def single_cluster_spread(df: DataFrame, feature: str) -> DataFrame:
    """Within-cluster squares for one cluster: population variance times the rows."""
    value = F.col(feature).cast("double")
    return df.agg(F.lit(1).alias("k"), (F.var_pop(value) * F.count(value)).alias("within_ss"))


def kmeans_elbow(df: DataFrame, feature: str, ks: range = range(1, 10), seed: int = 7, iterations: int = 1000) -> DataFrame:
    """Within-cluster squares per number of clusters. Spark fits k from 2 on, all at once; 1 is the variance."""
    models = fit_all(_weighted_values(df, feature), [k for k in ks if k > 1], seed, iterations)
    found = [(k, model.summary.trainingCost) for k, model in models.items()]
    fitted = df.sparkSession.createDataFrame(found, "k int, within_ss double")
    return single_cluster_spread(df, feature).unionByName(fitted) if 1 in ks else fitted


def fit_all(values: DataFrame, ks: list[int], seed: int = 7, iterations: int = 1000) -> dict[int, KMeansModel]:
    """A model for every number of clusters, fitted side by side over one fold of the values, held in memory."""
    points = values.cache()
    try:
        return dict(zip(ks, side_by_side(values.sparkSession, lambda k: _kmeans(k, seed, iterations).fit(points), ks, "clusters"), strict=True))
    finally:
        points.unpersist()


def fixed_points(df: DataFrame, feature: str, ks: list[int], seed: int = 7, iterations: int = 1000) -> DataFrame:
    """(k, n_clusters, n_astray, off): whether each clustering is one that k-means leaves alone.

    Counted are the clusters with members and the distinct values that lie nearer to another
    cluster's mean than to their own; ``off`` is the largest distance of a centre from the mean of
    its members. The list of means has k entries, all values meet it row by row.
    """
    points = _weighted_values(df, feature, held=True)
    found = []
    for k, model in fit_all(points, ks, seed, iterations).items():
        centres = F.array(*[F.lit(float(c[0])) for c in model.clusterCenters()])
        labelled = model.setPredictionCol("_own").transform(points)
        means = labelled.groupBy("_own").agg((F.sum(F.col(feature) * F.col("weight")) / F.sum("weight")).alias("_mean"))
        listed = means.agg(F.map_from_entries(F.collect_list(F.struct("_own", "_mean")))).scalar()
        apart = F.transform(F.map_values("m"), lambda mean: F.abs(F.col(feature) - mean))
        own = F.abs(F.col(feature) - F.element_at("m", F.col("_own")))
        moved = F.array_max(F.transform(F.map_entries("m"), lambda e: F.abs(e["value"] - F.get(centres, e["key"]))))
        found.append(labelled.withColumn("m", listed).agg(
            F.lit(k).alias("k"), F.first(F.size("m")).alias("n_clusters"), F.count_if(own > F.array_min(apart) * (1 + 1e-9) + 1e-9).alias("n_astray"), F.first(moved).alias("off")))
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    return out


def cluster_feature(df: DataFrame, feature: str, k: int, ascending: bool = True, seed: int = 7) -> DataFrame:
    """Add ``<feature>_cluster``, numbered by the mean of the feature; null where that is null."""
    name = f"{feature}_cluster"
    model = _kmeans(k, seed, 300).fit(_weighted_values(df, feature))
    points = VectorAssembler(inputCols=["_x"], outputCol="features").transform(
        df.where(F.col(feature).isNotNull()).withColumn("_x", F.col(feature).cast("double")))
    labelled = model.setPredictionCol(name).transform(points).drop("features", "_x")
    missing = df.where(F.col(feature).isNull()).withColumn(name, F.lit(None).cast("int"))
    return relabel_clusters(labelled, name, feature, ascending).unionByName(missing)
