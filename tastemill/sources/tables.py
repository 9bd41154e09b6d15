"""Readers and writers for tables, CSV, delimited text and parquet."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, StringType, StructField, StructType

BAD, REJECTED = "_corrupt_record", "rejected_line"


def lower_names(df: DataFrame) -> DataFrame:
    return df.toDF(*[c.lower() for c in df.columns])


# --- sources --------------------------------------------------------------------

def read_relation(spark: SparkSession, name: str, distinct: bool = True, format: str | None = None, **options) -> DataFrame:
    """A catalog table, or with ``format`` a path or a JDBC relation.

    Names come out in lower case; exact duplicates go unless ``distinct`` is off.
    """
    if format is None:
        df = spark.table(name)
    elif format == "jdbc":
        df = spark.read.format("jdbc").options(dbtable=name, **options).load()
    else:
        df = spark.read.format(format).options(**options).load(name)
    df = lower_names(df)
    return df.dropDuplicates() if distinct else df


def read_csv(spark: SparkSession, path: str, schema: StructType, columns: list[str] | None = None) -> DataFrame:
    """CSV with a header and a declared schema, optionally a few of its columns."""
    df = lower_names(spark.read.schema(schema).option("header", True).csv(path))
    return df.select(*columns) if columns else df


def read_csv_gz(spark: SparkSession, path: str, columns: list[str]) -> DataFrame:
    """Gzip CSV with a header; every column is text. One gzip file is one task, so
    writers should leave many files."""
    text = StructType([StructField(c, StringType()) for c in columns])
    return spark.read.schema(text).option("header", True).csv(path)


def read_delimited(spark: SparkSession, path: str, schema: StructType, sep: str = "|", header: bool = False) -> DataFrame:
    """All part files under a folder."""
    return spark.read.schema(schema).option("sep", sep).option("header", header).csv(path)


def read_parquet_dataset(spark: SparkSession, *paths: str, schema: StructType | None = None) -> DataFrame:
    reader = spark.read if schema is None else spark.read.schema(schema)
    return reader.parquet(*paths)


# --- sinks -----------------------------------------------------------------------

def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).csv(path)


def write_csv_gz(df: DataFrame, path: str, sep: str = ",", header: bool = True) -> None:
    df.write.mode("overwrite").option("compression", "gzip").option("sep", sep).option("header", header).csv(path)


def write_parquet(df: DataFrame, path: str, partition_by: list[str] | None = None) -> None:
    writer = df.write.mode("overwrite")
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)


def write_single_csv(df: DataFrame, path: str, gzip: bool = False, header: bool = False) -> None:
    """A folder with one file that has all rows, in the order of the frame.

    Tasks write their parts side by side; the parts are then put together byte by byte in their
    order, the header first. Gzip allows that: a file of several members reads as one. No task and
    no driver sees all rows as rows.
    """
    spark, ending = df.sparkSession, ".csv.gz" if gzip else ".csv"
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    at = jvm.org.apache.hadoop.fs.Path
    files = at(path).getFileSystem(conf)
    parts, names = f"{path.rstrip('/')}.parts-{uuid.uuid4().hex}", []
    compression = "gzip" if gzip else "none"
    if header:
        names_only = spark.createDataFrame([tuple(df.columns)], StructType([StructField(f"c{i}", StringType()) for i in range(len(df.columns))]))
        names_only.coalesce(1).write.option("compression", compression).csv(f"{parts}/0")
    df.write.option("compression", compression).csv(f"{parts}/1")
    for folder in ("0", "1") if header else ("1",):
        names += sorted(str(f.getPath()) for f in files.listStatus(at(f"{parts}/{folder}")) if f.getPath().getName().startswith("part-"))
    files.delete(at(path), True)
    whole = files.create(at(f"{path.rstrip('/')}/part-00000{ending}"))
    try:
        for name in names:
            part = files.open(at(name))
            jvm.org.apache.hadoop.io.IOUtils.copyBytes(part, whole, 1 << 20, False)
            part.close()
    finally:
        whole.close()
    files.create(at(f"{path.rstrip('/')}/_SUCCESS")).close()
    files.delete(at(parts), True)


def create_table_as(df: DataFrame, name: str, refresh: bool = True, path: str | None = None) -> DataFrame:
    """Replace a table by a query's result, or reuse the table that is there."""
    spark = df.sparkSession
    if refresh:
        writer = df.write.mode("overwrite").format("parquet")
        (writer.option("path", path) if path else writer).saveAsTable(name)
    return spark.table(name)


def read_marked(spark: SparkSession, path: str, schema: StructType, sep: str, header: bool) -> DataFrame:
    """Rows of a delimited file; a line that does not fit the schema stands whole in column ``BAD``."""
    marked = StructType([*schema.fields, StructField(BAD, StringType())])
    reader = spark.read.schema(marked).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", BAD)
    return reader.option("sep", sep).option("header", header).csv(path)


def load_delimited(spark: SparkSession, path: str, schema: StructType, sep: str = ",", header: bool = False) -> tuple[DataFrame, DataFrame]:
    """Readable rows of a delimited file, and the lines that were not."""
    rows = read_marked(spark, path, schema, sep, header)
    good = rows.where(F.col(BAD).isNull()).drop(BAD)
    # Read as text with the whole schema in use: Spark refuses to read the
    # bad-record column alone from a raw file.
    bad = rows.where(F.col(BAD).isNotNull())
    return good, bad


def full_refresh_load(spark: SparkSession, path: str, name: str, schema: StructType, sep: str = ",", header: bool = False,
                      table_path: str | None = None, seen: Observation | None = None) -> tuple[DataFrame, DataFrame]:
    """Replace a table's rows by a file's; unreadable lines are skipped and handed back.

    The file is parsed once, into a new folder: readable rows in one part of it, the others in
    another, counted on the way (``n_rows`` and ``n_rejected`` of ``seen``). Only when all is
    written does the table point to the new folder, so readers see the old rows or the new ones,
    and a load that breaks off changes nothing. The table keeps its columns. The folder before is
    left for those who still read it.
    """
    exists = spark.catalog.tableExists(name)
    kinds = spark.table(name).schema if exists else schema
    base = table_path or f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/{name.replace('.', '/')}"
    stage, is_bad = f"{base.rstrip('/')}-loads/{uuid.uuid4().hex}", F.col(BAD).isNotNull()
    columns = [F.when(is_bad, F.col(f.name).try_cast(f.dataType)).otherwise(F.col(f.name).cast(f.dataType)).alias(f.name) for f in kinds]
    rows = read_marked(spark, path, schema, sep, header)
    counted = rows.observe(seen or Observation(), F.count_if(~is_bad).alias("n_rows"), F.count_if(is_bad).alias("n_rejected"))
    counted.select(*columns, BAD, is_bad.alias(REJECTED)).write.partitionBy(REJECTED).parquet(stage)
    loaded = f"{stage}/{REJECTED}=false"
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(loaded)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).mkdirs(at)  # a file may have no readable line
    if exists:
        spark.sql(f"ALTER TABLE {name} SET LOCATION '{loaded}'")
    else:
        spark.catalog.createTable(name, path=loaded, source="parquet", schema=kinds)
    spark.catalog.refreshTable(name)
    both = StructType([*kinds.fields, StructField(BAD, StringType()), StructField(REJECTED, BooleanType())])
    return spark.table(name), spark.read.schema(both).parquet(stage).where(REJECTED).drop(REJECTED)


def as_strings(df: DataFrame, width: int = 50) -> tuple[DataFrame, DataFrame]:
    """Every column as text; rows with a value wider than allowed come out apart."""
    text = df.select(*[F.col(c).cast("string").alias(c) for c in df.columns])
    widest = F.greatest(*[F.coalesce(F.length(c), F.lit(0)) for c in text.columns], F.lit(0))
    return text.where(widest <= width), text.where(widest > width)


def load_as_strings(df: DataFrame, name: str, width: int = 50, path: str | None = None) -> tuple[DataFrame, DataFrame]:
    """Replace a table whose columns are all text; too wide rows are handed back."""
    fitting, rejected = as_strings(df, width)
    return create_table_as(fitting, name, path=path), rejected


def copy_dataset(spark: SparkSession, source: str, target: str, schema: StructType) -> None:
    """Read a CSV dataset and write it elsewhere."""
    write_csv(read_csv(spark, source, schema), target)
