"""Operators over finished series: one row per group and day.

They take aggregated rows, so a group is bounded by the days of the calendar however many
cases it has, and a window over the group is small.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.dates import week_start


def fill_days(df: DataFrame, by: Sequence[str], date: str = "date", value: str = "values") -> DataFrame:
    """One row per day between the first and last of each group; added days have no value.

    Each row is stretched to the day before the next one, which needs neither a calendar
    table nor a join, and keeps the partitioning for the windows that follow.
    """
    following = F.lead(date).over(Window.partitionBy(*by).orderBy(date))
    last = F.coalesce(F.date_sub(following, 1), F.col(date))
    return (
        df.select(*by, F.col(date).alias("_first"), F.col(value).alias("_value"), last.alias("_until"))
        .select(*by, "_first", "_value", F.explode(F.sequence("_first", "_until")).alias(date))
        .select(*by, date, F.when(F.col(date) == F.col("_first"), F.col("_value")).alias(value))
    )


def rolling(
    by: Sequence[str],
    order: str,
    value: str,
    width: int,
    align: str = "left",
    agg: Callable[[Column], Column] = F.avg,
) -> Column:
    """Aggregate over a frame of ``width`` rows; null where the frame is not full.

    ``left`` starts at the row, ``center`` has it in the middle, an even width having its
    extra row after it, ``right`` ends at it. Missing values are skipped.
    """
    before = {"left": 0, "center": (width - 1) // 2, "right": width - 1}[align]
    frame = Window.partitionBy(*by).orderBy(order).rowsBetween(-before, width - 1 - before)
    return F.when(F.count(F.lit(1)).over(frame) == width, agg(F.col(value)).over(frame))


def weekly(df: DataFrame, by: Sequence[str], date: str = "date", value: str = "values",
           agg: Callable[[Column], Column] = F.avg) -> DataFrame:
    """Weeks from Monday to Sunday, over the days observed, stamped with the last of them."""
    return (
        df.groupBy(*by, week_start(date).alias("_week"))
        .agg(F.max(date).alias(date), agg(F.col(value)).alias(value))
        .drop("_week")
    )


def last_observed(df: DataFrame, by: Sequence[str], order: Sequence[str], value: str, date: str, named: str) -> DataFrame:
    """Date of the last row, in the given order, that has a value. An aggregate, not a window."""
    return (
        df.where(F.col(value).isNotNull())
        .groupBy(*by)
        .agg(F.max_by(date, F.struct(*order)).alias(named))
    )


def carry_forward(curve: DataFrame, until: Column, order: str, value: str) -> DataFrame:
    """The curve, then its last value on every step up to ``until``; ``extended`` tells the added rows."""
    last = curve.agg(F.max(order).alias("_from"), F.max_by(value, order).alias(value))
    # The empty range of a curve that already reaches the end must not run backwards.
    steps = F.when(until > F.col("_from"), F.sequence(F.col("_from") + 1, until))
    added = last.select(F.explode(steps).alias(order), F.col(value))
    return (
        curve.select(order, value, F.lit(False).alias("extended"))
        .unionByName(added.select(order, value, F.lit(True).alias("extended")))
    )
