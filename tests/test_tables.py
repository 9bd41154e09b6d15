"""Sources and sinks."""

from __future__ import annotations

from pathlib import Path

import pytest
from pyspark.sql import Observation
from pyspark.sql.types import DoubleType, IntegerType, StringType, StructField, StructType

from tastemill import session
from tastemill.sources import tables

SCHEMA = StructType([StructField("a", IntegerType()), StructField("b", StringType()), StructField("c", DoubleType())])
ROWS = [(1, "x", 1.5), (2, "y, z", None), (3, None, -2.0)]


def test_gzip_files_are_written(spark, tmp_path, rows):
    df = spark.createDataFrame(ROWS, SCHEMA)
    path = str(tmp_path / "out")
    tables.write_csv_gz(df, path, sep="|", header=False)
    assert list(Path(path).glob("*.csv.gz"))
    assert rows(tables.read_delimited(spark, path, SCHEMA)) == rows(df)


def test_single_file(spark, tmp_path):
    df = spark.range(100).repartition(7)
    tables.write_single_csv(df, str(tmp_path / "one"))
    assert len(list((tmp_path / "one").glob("part-*"))) == 1


def test_rejects_are_handed_back(spark, tmp_path, rows):
    (tmp_path / "in.csv").write_text("1,x,1.5\nnot a number,y,2\n3,z,0.5\n")
    loaded, bad = tables.full_refresh_load(spark, str(tmp_path / "in.csv"), "refresh_target", SCHEMA, table_path=str(tmp_path / "t"))
    assert rows(loaded) == [(1, "x", 1.5), (3, "z", 0.5)]
    assert [r[tables.BAD] for r in bad.collect()] == ["not a number,y,2"]
    (tmp_path / "next.csv").write_text("9,q,1\n")
    loaded, _ = tables.full_refresh_load(spark, str(tmp_path / "next.csv"), "refresh_target", SCHEMA)
    assert rows(spark.table("refresh_target")) == [(9, "q", 1.0)]


def test_load_that_breaks_off_leaves_the_old_rows(spark, tmp_path, rows):
    """The second file has a number that the table's column cannot hold; it is met while writing."""
    from pyspark.sql.types import LongType

    long = StructType([StructField("a", LongType()), *SCHEMA.fields[1:]])
    (tmp_path / "in.csv").write_text("1,x,1.5\n2,y,2\n")
    tables.full_refresh_load(spark, str(tmp_path / "in.csv"), "broken_target", SCHEMA, table_path=str(tmp_path / "t"))
    before = rows(spark.table("broken_target"))
    (tmp_path / "next.csv").write_text("7,q,1\n" + "8,r,2\n" * 5000 + "99999999999,s,3\n")
    with pytest.raises(Exception, match="OVERFLOW"):
        tables.full_refresh_load(spark, str(tmp_path / "next.csv"), "broken_target", long, table_path=str(tmp_path / "t"))
    assert rows(spark.table("broken_target")) == before == [(1, "x", 1.5), (2, "y", 2.0)]


def test_file_is_parsed_once_and_counted(spark, tmp_path, rows):
    (tmp_path / "in.csv").write_text("1,x,1.5\nno,y,2\n3,z,0.5\nno,q,2\n")
    seen, context = Observation("load"), spark.sparkContext
    context.setJobGroup("load", "")
    try:
        loaded, bad = tables.full_refresh_load(spark, str(tmp_path / "in.csv"), "counted_target", SCHEMA, table_path=str(tmp_path / "t"), seen=seen)
        assert len(context.statusTracker().getJobIdsForGroup("load")) == 1
    finally:
        context.setLocalProperty("spark.jobGroup.id", None)
    assert seen.get == {"n_rows": 2, "n_rejected": 2}
    # what comes back does not read the file any more
    assert not any("in.csv" in f for f in [*loaded.inputFiles(), *bad.inputFiles()])
    assert rows(loaded) == [(1, "x", 1.5), (3, "z", 0.5)] and bad.count() == 2
    (tmp_path / "none.csv").write_text("no,x,1\n")
    loaded, bad = tables.full_refresh_load(spark, str(tmp_path / "none.csv"), "counted_target", SCHEMA, table_path=str(tmp_path / "t"))
    assert loaded.count() == 0 and bad.count() == 1


@pytest.mark.parametrize("gzip", [False, True])
def test_single_file_keeps_the_order(spark, tmp_path, gzip):
    """Several tasks write, none of them all rows; the file has them in the frame's order."""
    df = spark.range(5000).selectExpr("id * 7919 % 5000 AS k", "concat('a,\"', id) AS v").repartition(6).orderBy("k")
    tables.write_single_csv(df, str(tmp_path / "one"), gzip=gzip, header=True)
    files = [p for p in (tmp_path / "one").iterdir() if p.name.startswith("part-")]
    assert len(files) == 1 and not list(tmp_path.glob("*.parts-*"))
    lines = (zlib_text(files[0]) if gzip else files[0].read_text()).splitlines()
    assert lines[0] == "k,v" and [int(line.split(",")[0]) for line in lines[1:]] == list(range(5000))
    back = spark.read.option("header", True).option("escape", "\\").csv(str(tmp_path / "one"))
    assert back.count() == 5000 and back.columns == ["k", "v"]


def zlib_text(path) -> str:
    import gzip

    with gzip.open(path, "rt") as f:
        return f.read()


def test_wide_values_are_rejected(spark, tmp_path, rows):
    df = spark.createDataFrame([(1, "x" * 50), (2, "x" * 51)], "a int, b string")
    loaded, wide = tables.load_as_strings(df, "text_target", path=str(tmp_path / "t"))
    assert rows(loaded) == [("1", "x" * 50)] and wide.count() == 1
    assert {t for _, t in loaded.dtypes} == {"string"}


def test_table_is_reused_unless_refreshed(spark, tmp_path):
    first = spark.range(3)
    tables.create_table_as(first, "kept", path=str(tmp_path / "k"))
    assert tables.create_table_as(spark.range(9), "kept", refresh=False).count() == 3


def test_relation_names_and_duplicates(spark):
    spark.createDataFrame([(1, 2), (1, 2)], "A int, B int").createOrReplaceTempView("dup")
    assert tables.read_relation(spark, "dup").columns == ["a", "b"]
    assert tables.read_relation(spark, "dup").count() == 1
    assert tables.read_relation(spark, "dup", distinct=False).count() == 2


def test_cut_lives_in_the_named_folder_and_can_be_released(spark):
    df = session.cut(spark.range(10), "t")
    assert df.count() == 10
    named = spark.conf.get("spark.checkpoint.dir")
    assert all(f.replace("file://", "").startswith(named) for f in df.inputFiles())
