"""Session settings the operators rely on, and the shared folder for cut points."""

from __future__ import annotations

import math
import re
import uuid
from collections.abc import Callable, Iterable
from concurrent.futures import ThreadPoolExecutor

from pyspark import inheritable_thread_target
from pyspark.sql import DataFrame, SparkSession

# Runtime settings only, so they can be applied to a session somebody else made.
RUNTIME_SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # A join whose output partitioning a later step would reuse is left unsplit
    # by default; one hot customer costs more than the extra exchange.
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
}

# What one task reads or gets from a shuffle, at most: its rows, unpacked for a sort or an
# aggregate, take tens of times that. Smaller settings of a session stay.
TASK_BYTES = {"spark.sql.files.maxPartitionBytes": 16 << 20, "spark.sql.adaptive.advisoryPartitionSizeInBytes": 16 << 20}
# Bytes of input for each partition of a shuffle, before AQE puts small ones together again.
INPUT_PER_PARTITION = 4 << 20
INITIAL_PARTITIONS = "spark.sql.adaptive.coalescePartitions.initialPartitionNum"


def configure(spark: SparkSession) -> SparkSession:
    """Apply the runtime settings and make sure a checkpoint folder is known."""
    for key, value in RUNTIME_SETTINGS.items():
        if spark.conf.get(key, None) != value:
            spark.conf.set(key, value)
    shared_folder(spark)
    return spark


def setting_bytes(text: str) -> int:
    """A size as Spark's settings write it: 64MB, 16m, 4096b, 4096."""
    number, unit = re.fullmatch(r"(\d+)([kmgt]?)b?", text.strip().lower()).groups()
    return int(number) << 10 * " kmgt".index(unit or " ")


def bound_tasks(spark: SparkSession, paths: Iterable[str]) -> None:
    """Let the number of tasks grow with the input, so that none of them does.

    Reads and shuffles are cut into parts of at most ``TASK_BYTES``. A shuffle starts with a partition for
    every ``INPUT_PER_PARTITION`` bytes below ``paths``, or the session's number where that is more.
    """
    for key, most in TASK_BYTES.items():
        if setting_bytes(spark.conf.get(key)) > most:
            spark.conf.set(key, str(most))
    partitions = math.ceil(sum(stored_bytes(spark, path) for path in paths) / INPUT_PER_PARTITION)
    if partitions > int(spark.conf.get("spark.sql.shuffle.partitions")):
        spark.conf.set(INITIAL_PARTITIONS, str(partitions))
    else:
        spark.conf.unset(INITIAL_PARTITIONS)


def stored_bytes(spark: SparkSession, path: str) -> int:
    """Size of a file or folder in any store that Spark reads; 0 where there is none."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    store = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return store.getContentSummary(path).getLength() if store.exists(path) else 0


def shared_folder(spark: SparkSession) -> str:
    """The folder every executor can reach, as named in ``spark.checkpoint.dir``.

    A session without that setting gets a folder in its warehouse, which all executors reach too.
    """
    named, context = spark.conf.get("spark.checkpoint.dir", None), spark.sparkContext
    if not named:
        named = f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/checkpoints"
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(named)
    return named


def run_folder(spark: SparkSession) -> str:
    """This application's own part of the shared folder."""
    return f"{shared_folder(spark).rstrip('/')}/tastemill/{spark.sparkContext.applicationId}"


def fresh_folder(spark: SparkSession, label: str) -> str:
    """A new, unused path in this application's part of the shared folder."""
    return f"{run_folder(spark)}/{label}-{uuid.uuid4().hex}"


def cut(df: DataFrame, label: str = "cut") -> DataFrame:
    """Write an intermediate result to the shared folder and go on from there.

    The plan behind it runs once, however often the result is read, and the loss of
    executors costs nothing that was written. Parquet rather than ``checkpoint()``:
    that would run the plan twice, and its files know neither columns nor sizes,
    so the planner could neither prune nor pick a broadcast by size. A frame that is a cut
    already is handed back.
    """
    if getattr(df, "_is_cut", False):
        return df
    path = fresh_folder(df.sparkSession, label)
    df.write.parquet(path)
    held = df.sparkSession.read.schema(df.schema).parquet(path)
    held._is_cut = True
    return held


def side_by_side(spark: SparkSession, run: Callable, items: Iterable, pool: str) -> list:
    """``run`` on every item at once, each in a driver thread and all in one scheduler pool.

    For fits of many short stages: one fills the cores that another leaves idle.
    """
    @inheritable_thread_target(spark)
    def one(item):
        spark.sparkContext.setLocalProperty("spark.scheduler.pool", pool)
        return run(item)

    items = list(items)
    if not items:
        return []
    with ThreadPoolExecutor(len(items)) as threads:
        return list(threads.map(one, items))


def release_cuts(spark: SparkSession) -> bool:
    """Remove what this application has cut. Frames read from it are unusable afterwards."""
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(run_folder(spark))
    return path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def local_session(cores: str = "*", partitions: int = 8, memory: str = "8g", **extra: str) -> SparkSession:
    """A session for tests and benchmarks on one machine."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("tastemill")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", memory)
        .config("spark.sql.shuffle.partitions", str(partitions))
    )
    for key, value in {**RUNTIME_SETTINGS, **extra}.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return configure(spark)
