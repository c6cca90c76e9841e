"""Files written and read back."""

import datetime as dt
import os
import time

import pytest

from epitally.session import materialize, scratch_path, shared_folder
from epitally.sources import readers, writers


def test_missing_and_empty_cells(spark, folder, rows):
    path = f"{folder}/t"
    os.makedirs(path)
    with open(f"{path}/a.csv", "w") as out:
        out.write('k,v\na,NA\nb,\nc,""\nNA,1\n')
    df = readers.read_table(spark, path, "k string, v string")
    assert rows(df, "k") == [(None, "1"), ("a", None), ("b", None), ("c", "")]


def test_a_wrong_header_is_an_error(spark, folder):
    path = f"{folder}/t"
    os.makedirs(path)
    with open(f"{path}/a.csv", "w") as out:
        out.write("k,w\na,1\n")
    with pytest.raises(Exception, match="header"):
        readers.read_table(spark, path, "k string, v string").collect()


def test_tables_round_trip(spark, folder, rows):
    df = spark.createDataFrame([("a", 1.5, None), (None, None, "")], "k string, x double, s string")
    writers.write_table(df, f"{folder}/out")
    assert rows(readers.read_table(spark, f"{folder}/out", "k string, x double, s string"), "k") == [
        (None, None, ""), ("a", 1.5, None),
    ]


def test_columns_of_a_write_without_rows(spark, folder):
    none = spark.createDataFrame([], "region string, v int")
    writers.write_by(none, f"{folder}/by", ["region"])
    writers.write_table(none, f"{folder}/table")
    for name in ("by", "table"):
        df = readers.read_columns(spark, f"{folder}/{name}", "region string, v int")
        assert df.dtypes == [("region", "string"), ("v", "int")] and df.collect() == []
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        readers.read_columns(spark, f"{folder}/nowhere", "region string, v int")


def test_only_the_named_drops_are_read(spark, folder, plan):
    df = spark.createDataFrame([("2020-06-28", "a", 1), ("2020-06-29", "b", 2)], "upload_date string, k string, v int")
    writers.write_by(df, f"{folder}/drops", ["upload_date"])
    one = readers.read_drop(spark, f"{folder}/drops", "2020-06-29", "k string, v int")
    assert [tuple(r) for r in one.collect()] == [("b", 2)]
    both = readers.read_drops(spark, f"{folder}/drops", "k string, v int").where("upload_date = '2020-06-28'")
    assert both.count() == 1
    assert "PartitionFilters: [isnotnull(upload_date" in plan(both)


def test_newest_files(spark, folder):
    for i, name in enumerate(["b.csv", "a.csv", "c.csv"]):
        path = f"{folder}/{name}"
        with open(path, "w") as out:
            out.write("v\n1\n")
        os.utime(path, (time.time() - 100 * i,) * 2)
    paths = readers.newest_paths(spark, f"{folder}/*.csv", 2)
    assert [os.path.basename(p) for p in paths] == ["b.csv", "a.csv"]
    assert readers.read_table(spark, paths, "v int").count() == 2


def test_run_date_from_the_file_name(spark, folder, rows):
    for day, value in (("2020-08-22", 1), ("2020-08-29", 2)):
        with open(f"{folder}/{day}_model_run.csv", "w") as out:
            out.write(f"v\n{value}\n")
    df = readers.read_runs(spark, folder, "v int")
    assert rows(df.select("run_date", "v"), "v") == [("2020-08-22", 1), ("2020-08-29", 2)]


def test_wide_text(spark, folder):
    df = spark.createDataFrame([("a", "41, 42", "[3],[7]")], "region string, times_wide string, values_wide string")
    writers.write_wide_text(df, f"{folder}/wide", ["region"])
    lines = [r.value for r in spark.read.text(f"{folder}/wide/region=a").collect()]
    assert lines == ["41, 42", "[3],[7]"]


def test_a_run_written_twice_is_kept_once(spark, folder, rows):
    schema = "model_run_date date, v int"
    first = spark.createDataFrame([(dt.date(2020, 8, 1), 1), (dt.date(2020, 8, 2), 2)], schema)
    again = spark.createDataFrame([(dt.date(2020, 8, 2), 3)], schema)
    writers.append_run(first, f"{folder}/runs")
    writers.append_run(again, f"{folder}/runs")
    df = readers.read_archive(spark, f"{folder}/runs").select("model_run_date", "v")
    assert rows(df, "v") == [(dt.date(2020, 8, 1), 1), (dt.date(2020, 8, 2), 3)]


def test_a_shared_folder_must_be_named_on_a_cluster():
    class Context:
        master = "spark://somewhere:7077"

        def getCheckpointDir(self):
            return None

    class Session:
        sparkContext = Context()
        conf = {}

    with pytest.raises(RuntimeError):
        shared_folder(Session())


def test_counts_written_with_a_point_are_read(spark, folder, rows):
    with open(f"{folder}/x.csv", "w") as file:
        file.write("a,b\n3.0,1\n2.5,2\nx,3\n7,4\n")
    assert rows(readers.read_columns(spark, folder, "a int, b int"), "b") == [(3, 1), (None, 2), (None, 3), (7, 4)]


def test_written_tables_lie_in_the_shared_folder(spark, plan):
    assert scratch_path(spark, "x").startswith(shared_folder(spark))
    df = materialize(spark.range(10).selectExpr("id", "CASE WHEN id > 3 THEN id END AS v"), "x")
    assert df.count() == 10 and df.columns == ["id", "v"]
    assert "BroadcastHashJoin" in plan(spark.range(100).join(df, "id"))
