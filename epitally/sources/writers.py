"""Sinks. One output per region is a partitioned write, never a loop."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def write_table(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """CSV with a header; null is written as ``NA`` so that it differs from an empty text."""
    df.write.mode(mode).option("header", True).option("nullValue", "NA").csv(path)


def _gathered(df: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of a key together, so that a folder gets few files; a key with most rows is split again."""
    return df.hint("rebalance", *keys)


def write_by(df: DataFrame, path: str, keys: list[str], mode: str = "errorifexists") -> None:
    """One folder per key combination."""
    rows = _gathered(df, keys)
    rows.write.mode(mode).partitionBy(*keys).option("header", True).option("nullValue", "NA").csv(path)


def write_wide_text(df: DataFrame, path: str, keys: list[str], mode: str = "errorifexists") -> None:
    """Two lines per key combination: the times, then the values."""
    lines = df.select(*keys, F.concat_ws("\n", "times_wide", "values_wide").alias("value"))
    _gathered(lines, keys).write.mode(mode).partitionBy(*keys).text(path)


def append_run(df: DataFrame, path: str) -> None:
    """Add a model run to the archive; one folder per run date, replaced when it is written again."""
    (
        _gathered(df, ["model_run_date"])
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy("model_run_date")
        .parquet(path)
    )
