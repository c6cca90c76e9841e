"""Aggregates with the missing-value rules of the reports."""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import bracketed_list, joined_list, number_text


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def row_count() -> Column:
    """Rows, those with missing values too."""
    return F.count(F.lit(1))


def strict_sum(c: Column | str) -> Column:
    """Sum; missing as soon as one value is missing."""
    value = _col(c)
    return F.when(F.count(F.lit(1)) == F.count(value), F.sum(value))


def skip_sum(c: Column | str) -> Column:
    """Sum of the values present; zero when there are none."""
    value = _col(c)
    return F.coalesce(F.sum(value), F.lit(0))


def adjusted_r2(y: Column | str, x: Column | str) -> Column:
    """Adjusted R² of the straight line of y on x, over rows that have both."""
    n = F.regr_count(_col(y), _col(x))
    r2 = F.regr_r2(_col(y), _col(x))
    # Fewer than three pairs leave no degree of freedom.
    return F.when(n > 2, 1 - (1 - r2) * (n - 1) / (n - 2))


def daily_counts(cases: DataFrame, by: Sequence[str], dates: dict[str, str],
                 until: dt.date | None = None, after: dt.date | None = None, weight: str | None = None) -> DataFrame:
    """Rows per group and day for several date columns, in one scan.

    ``dates`` maps a series name to the date column it counts by. A case takes part once per
    date it has, up to ``until`` and later than ``after``. The counts are combined before the shuffle, so a group that
    holds most cases still sends at most one row per series and day from each task. With a ``weight`` a row
    counts as often as this column says, and groups that add up to nothing are left out.
    """
    weights = [weight] if weight else []
    rows = cases.select(*by, *weights, *[F.col(c).alias(s) for s, c in dates.items()])

    def counts(c: str) -> Column:
        bounds = [F.col(c) <= F.lit(until)] if until is not None else []
        bounds += [F.col(c) > F.lit(after)] if after is not None else []
        return reduce(lambda a, b: a & b, bounds) if bounds else F.col(c).isNotNull()

    # Cases without any date to count are left out at the scan.
    rows = rows.where(reduce(lambda a, b: a | b, [counts(s) for s in dates]))
    if len(dates) == 1:
        (series,) = dates
        days = rows.select(F.lit(series).alias("series"), *by, *weights, F.col(series).alias("date"))
    else:
        days = rows.unpivot([*by, *weights], list(dates), "series", "date").where(counts("date"))
    grouped = days.groupBy("series", *by, "date")
    if not weight:
        return grouped.agg(row_count().alias("values"))
    return grouped.agg(F.sum(weight).alias("values")).where(F.col("values") != 0)


def with_national(
    daily: DataFrame, keys: Sequence[str], label: str, value: str = "values", region: str = "region"
) -> DataFrame:
    """Regional rows together with their sum over all regions, the unnamed region included.

    Takes rows that are already aggregated, so only those are doubled and not the cases.
    """
    doubled = daily.withColumn(region, F.explode(F.array(F.col(region), F.lit(label))))
    return doubled.groupBy(*[k for k in keys if k != region], region).agg(F.sum(value).alias(value))


def national_and_regional(df: DataFrame, keys: Sequence[str], label: str, aggregates: Sequence[Column],
                          region: str = "region") -> DataFrame:
    """The same in one aggregation, for aggregates that cannot be summed afterwards.

    The national row is told by its grouping id, since a missing region is a group of its own.
    """
    others = [k for k in keys if k != region]
    grouped = df.groupingSets([[region, *others], others], region, *others)
    out = grouped.agg(F.grouping(region).alias("_national"), *aggregates)
    return out.withColumn(
        region, F.when(F.col("_national") == 1, F.lit(label)).otherwise(F.col(region))
    ).drop("_national")


def ordered_text(df: DataFrame, keys: Sequence[str], order: str = "times", value: str = "values",
                 named: tuple[str, str, str] = ("times_wide", "values_plain", "values_wide")) -> DataFrame:
    """One row per group with the series as text: ``41, 42``, ``3, 7`` and ``[3],[7]``.

    The group is a finished daily or weekly series, so its length is bounded by the calendar.
    """
    pairs = F.array_sort(
        F.collect_list(F.struct(F.col(order).alias("t"), number_text(value).alias("v")))
    ).alias("_pairs")
    grouped = df.groupBy(*keys).agg(pairs) if keys else df.agg(pairs)
    # A national series has no key; an empty one yields no row.
    grouped = grouped.where(F.size("_pairs") > 0)
    times = F.transform(F.col("_pairs.t"), lambda t: t.cast("string"))
    values = F.col("_pairs.v")
    return grouped.select(
        *keys,
        joined_list(times).alias(named[0]),
        joined_list(values).alias(named[1]),
        bracketed_list(values).alias(named[2]),
    )


def share_of_total(df: DataFrame, by: str | Sequence[str], value: str, total: str, share: str) -> DataFrame:
    """Group total beside each row and the row's share of it; rows must be aggregated already."""
    keys = [by] if isinstance(by, str) else list(by)
    return df.withColumn(total, F.sum(value).over(Window.partitionBy(*keys))).withColumn(
        share, F.col(value) / F.col(total)
    )
