"""What the operators share: settings for Arrow batches, cuts that go away again, components."""

from __future__ import annotations

import tempfile
import zipfile
from collections.abc import Iterator
from contextlib import contextmanager
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tastemill.session import configure, fresh_folder

# Batches between the JVM and Python workers stay small, however long the rows are.
BATCHES = {
    "spark.sql.execution.arrow.maxRecordsPerBatch": "1000",
    "spark.sql.execution.arrow.maxBytesPerBatch": str(8 << 20),
}


PACKAGE = Path(__file__).resolve().parents[1]


def ship(spark: SparkSession) -> None:
    """Send this package's code to the executors once, so they need no installation."""
    context = spark.sparkContext
    if getattr(context, "_tastemill_shipped", False):
        return
    archive = Path(tempfile.mkdtemp(prefix="tastemill-code-")) / "tastemill.zip"
    with zipfile.ZipFile(archive, "w") as z:
        for path in sorted(PACKAGE.rglob("*.py")):
            z.write(path, path.relative_to(PACKAGE.parent))
    context.addPyFile(str(archive))
    context._tastemill_shipped = True


def ready(spark: SparkSession) -> SparkSession:
    configure(spark)
    ship(spark)
    for key, value in BATCHES.items():
        if spark.conf.get(key, None) != value:
            spark.conf.set(key, value)
    return spark


class Cuts:
    """Intermediate tables in the shared folder, each dropped as soon as nothing needs it."""

    def __init__(self, spark: SparkSession, label: str):
        self.spark, self.label, self.paths = ready(spark), label, {}

    def save(self, name: str, df: DataFrame) -> DataFrame:
        path = self.paths[name] = fresh_folder(self.spark, f"{self.label}-{name}")
        with shuffles_once(self.spark):
            df.write.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, *names: str) -> None:
        jvm = self.spark.sparkContext._jvm
        for name in names:
            path = jvm.org.apache.hadoop.fs.Path(self.paths.pop(name))
            path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


@contextmanager
def shuffles_once(spark: SparkSession) -> Iterator[None]:
    """What runs inside lets its shuffle files go as soon as it is done. For actions on frames that
    nobody runs again; results handed to a caller keep theirs."""
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key, "false")
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        spark.conf.set(key, before)


def tables(spark: SparkSession, root: str, name: str) -> DataFrame:
    ready(spark)
    return spark.read.parquet(f"{root.rstrip('/')}/{name}.parquet")


def text_bytes(docs: DataFrame) -> DataFrame:
    """doc_id and the text as bytes, whatever other columns there are."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").cast("binary").alias("text"))


def with_rows(docs: DataFrame) -> DataFrame:
    """doc_id, the text as bytes, and all other columns as one struct that passes through a task."""
    others = F.struct(*[F.col(f"`{c}`") for c in docs.columns if c != "text"])
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").cast("binary").alias("text"), others.alias("row"))


def restored(df: DataFrame, columns: list[str]) -> DataFrame:
    """The columns that ``with_rows`` has packed, in their order."""
    return df.select(*[F.col("text").cast("string").alias(c) if c == "text" else F.col(f"row.`{c}`").alias(c) for c in columns])


def crc_remainder(column: str, modulus: int):
    return F.pmod(F.crc32(F.col(column).cast("string")), F.lit(modulus))


def components(cuts: Cuts, links: DataFrame, name: str) -> DataFrame:
    """Smallest node reachable from each linked node: columns node, component.

    Large-star and small-star steps: every node's larger neighbours are hung onto its smallest
    neighbour, then its smaller ones; stars merge until nothing changes. A node with very many
    neighbours costs one partial minimum and one join that Spark can split.
    """
    edges = cuts.save(f"{name}-0", links.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    step = 0
    while True:
        both = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = cuts.save(f"{name}-least", both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = cuts.save(f"{name}-large", large.where("u <> v").distinct())
        low = cuts.save(f"{name}-low", large.groupBy("u").agg(F.min("v").alias("m")))
        small = large.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").unionByName(low.select("u", F.col("m").alias("v"))).distinct()
        step += 1
        after = cuts.save(f"{name}-{step}", small)
        moved = F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))
        same = edges.agg(F.count("*"), moved).first() == after.agg(F.count("*"), moved).first()
        cuts.drop(f"{name}-{step - 1}", f"{name}-least", f"{name}-large", f"{name}-low")
        edges = after
        if same:
            break
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component"))
