"""Calibration targets: daily, weekly and rolling series from case and hospital reports."""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.dates import EPOCH_DEC31, day_offset, impute_date, lag_days
from ..functions.numbers import half_even
from ..functions.text import bracketed_list, joined_list, number_text, padded_cell, with_comma
from ..operators.aggregates import (
    daily_counts,
    ordered_text,
    row_count,
    skip_sum,
    strict_sum,
    with_national,
)
from ..operators.filters import complete_rows, in_regions, rows_at_max, trim_tail
from ..operators.joins import group_statistic
from ..operators.series import fill_days, rolling, weekly

FIRST_DAY = 40


def calibration_series(daily: DataFrame, epoch: dt.date, lower: int | None, date: str = "date") -> DataFrame:
    """Day offsets instead of dates, incomplete rows and days up to ``lower`` left out."""
    out = complete_rows(daily.withColumn("times", day_offset(date, epoch)).drop(date))
    return out if lower is None else out.where(F.col("times") > lower)


def with_wide_text(series: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Each row of a series with the whole series of its group as text beside it.

    The group is collected once and unrolled again, which needs no join. It is a finished
    daily series, bounded by the calendar.
    """
    pairs = F.array_sort(F.collect_list(F.struct("times", "values")))
    grouped = series.groupBy(*keys).agg(pairs.alias("_rows"))
    cells = F.transform(F.col("_rows.values"), lambda v: number_text(v))
    # The texts are made once per group; in one step with the unrolling they would be made per row.
    texts = grouped.select(
        *keys, "_rows",
        joined_list(F.transform(F.col("_rows.times"), lambda t: t.cast("string"))).alias("times_wide"),
        bracketed_list(cells).alias("values_wide"),
    )
    return texts.select(*keys, "times_wide", "values_wide", F.explode("_rows").alias("_row")).select(
        *keys, "_row.times", "_row.values", "times_wide", "values_wide"
    )


def padded_series(series: DataFrame, before: str = "     ", extra: Sequence[str] = (),
                  scope: Sequence[str] = ()) -> DataFrame:
    """Times and values as padded cells; all cells of a column are equally wide.

    The width is taken over each ``scope`` group, or over all rows when there is none.
    """
    # A finished series is bounded by regions and the calendar, also where all of it is one group.
    group = Window.partitionBy(*(scope or [F.lit(0)]))
    width = F.struct(*[F.max(F.length(number_text(c))).over(group).alias(n) for c, n in (("times", "t"), ("values", "v"))])
    keys = [c for c in series.columns if c not in ("times", "values", *extra)]
    return series.withColumn("_w", width).select(
        *keys,
        F.col("times").alias("day"),
        padded_cell("times", F.col("_w.t"), before).alias("times"),
        padded_cell("values", F.col("_w.v")).alias("values"),
        padded_cell("values", F.col("_w.v"), "     [", "],").alias("values_bracketed"),
        *extra,
    )


def daily_text(cases: DataFrame, dates: dict[str, str], epoch: dt.date, lower: int = FIRST_DAY) -> DataFrame:
    """National daily series as text, one row per series: onset, death or any other date."""
    counts = daily_counts(cases, [], dates, after=epoch + dt.timedelta(lower))
    return ordered_text(calibration_series(counts, epoch, lower), ["series"])


def confirmed_daily(cases: DataFrame, date: str, epoch: dt.date) -> DataFrame:
    """Cases per report date, as offsets, without text."""
    counts = daily_counts(cases, [], {"cases": date}).drop("series")
    return calibration_series(counts, epoch, None)


def regional_daily_text(cases: DataFrame, dates: dict[str, str], regions: Sequence[str], epoch: dt.date) -> DataFrame:
    """Regional daily series as text, one row per series and region."""
    counts = daily_counts(cases.where(in_regions(regions)), ["region"], dates)
    return ordered_text(calibration_series(counts, epoch, None), ["series", "region"])


def icu_daily(hospital: DataFrame, by: Sequence[str] = (), regions: Sequence[str] | None = None) -> DataFrame:
    """Occupied beds per day; a day with a missing report has no total."""
    kept = hospital.where(F.col("reportdate").isNotNull())
    if regions:
        kept = kept.where(in_regions(regions))
    return kept.groupBy(*by, F.col("reportdate").alias("date")).agg(strict_sum("icu_o").alias("values"))


def icu_text(hospital: DataFrame, epoch: dt.date, lower: int | None = None) -> DataFrame:
    """National occupancy as one row of text."""
    return ordered_text(calibration_series(icu_daily(hospital), epoch, lower).withColumn("series", F.lit("icu")),
                        ["series"])


def national_beds(daily: DataFrame) -> DataFrame:
    """National days from regional ones; a day that one region lacks has no total."""
    return daily.groupBy("date").agg(strict_sum("values").alias("values"))


def icu_national(daily: DataFrame, epoch: dt.date = EPOCH_DEC31, lower: int = FIRST_DAY) -> DataFrame:
    """National occupancy: padded cells with the whole series as text beside them."""
    series = calibration_series(daily, epoch, lower).withColumn("series", F.lit("icu"))
    return padded_series(with_wide_text(series, ["series"]), extra=("times_wide", "values_wide"), scope=["series"])


def icu_regional(daily: DataFrame, epoch: dt.date = EPOCH_DEC31) -> DataFrame:
    """Occupancy of each region as padded cells, one output per region."""
    return padded_series(calibration_series(daily, epoch, None), before="    ")


def icu_regional_wide(daily: DataFrame, epoch: dt.date = EPOCH_DEC31) -> DataFrame:
    """The same with the region's whole series as text beside each row."""
    series = calibration_series(daily, epoch, None)
    return padded_series(with_wide_text(series, ["region"]), extra=("times_wide", "values_wide"))


def impute_admission(cases: DataFrame, region: str = "region") -> DataFrame:
    """Each case with its region's mean lag in whole days and its admission date, imputed where missing.

    For outputs that need the cases; :func:`imputed_daily` gets the daily counts in one scan.
    """
    lagged = cases.withColumn("lag", lag_days("report", "admitted"))
    mean = half_even(F.avg("lag")).cast("int").alias("region_lag")
    return group_statistic(lagged, [region], [mean]).withColumn(
        "admitted_adjusted", impute_date("admitted", "report", "region_lag")
    )


def imputed_daily(cases: DataFrame, by: Sequence[str] = ("region",)) -> DataFrame:
    """Daily deaths and notifications per region, admission dates imputed, in one scan of the cases.

    All cases of a region that lack an admission date move by the same lag, so they are
    counted by report date first and the counts are moved. The lag comes from sums that ride
    along with the counts. Nothing after the first aggregation sees a case.
    """
    dates = cases.select(
        *by,
        lag_days("report", "admitted").alias("lag"),
        F.col("died").alias("deaths"),
        "admitted",
        F.when(F.col("admitted").isNull(), F.col("report")).alias("unadmitted"),
    )
    lag = F.when(F.col("series") == "admitted", F.col("lag"))
    counts = (
        dates.unpivot([*by, "lag"], ["deaths", "admitted", "unadmitted"], "series", "date")
        .where(F.col("date").isNotNull())
        .groupBy(*by, "series", "date")
        .agg(row_count().alias("n"), F.sum(lag).alias("lag_sum"), F.count(lag).alias("lag_n"))
    )
    region = Window.partitionBy(*by)
    lag = half_even(F.sum("lag_sum").over(region) / F.sum("lag_n").over(region)).cast("int")
    moved = counts.withColumn("_lag", lag).select(
        *by,
        F.when(F.col("series") == "deaths", "deaths").otherwise("notifications").alias("series"),
        F.when(F.col("series") == "unadmitted", F.date_sub("date", F.col("_lag")))
        .otherwise(F.col("date")).alias("date"),
        "n",
    )
    return moved.where(F.col("date").isNotNull()).groupBy(*by, "series", "date").agg(F.sum("n").alias("values"))


def imputed_regional(daily: DataFrame, epoch: dt.date = EPOCH_DEC31, lower: int = FIRST_DAY) -> DataFrame:
    """Deaths and notifications of each region, cells with a comma and the whole series beside them.

    A region's lag depends on its own cases only, so a region filter may come before the counts.
    """
    rows = with_wide_text(calibration_series(daily, epoch, lower), ["series", "region"])
    return rows.select(
        "series", "region", F.col("times").alias("day"),
        with_comma("times").alias("times"), with_comma("values").alias("values"), "times_wide", "values_wide",
    )


def imputed_national(daily: DataFrame, epoch: dt.date = EPOCH_DEC31, lower: int = FIRST_DAY) -> DataFrame:
    """The same for the nation, as padded cells per series."""
    national = daily.groupBy("series", "date").agg(F.sum("values").alias("values"))
    rows = with_wide_text(calibration_series(national, epoch, lower), ["series"])
    return padded_series(rows, extra=("times_wide", "values_wide"), scope=["series"])


def regional_series(cases: DataFrame, hospital: DataFrame, regions: Sequence[str], national: str,
                    until: dt.date) -> DataFrame:
    """Daily notifications, deaths and occupancy of the nation and the regions up to a date.

    The nation holds all regions; the list is applied after it is formed.
    """
    beds = (
        hospital.where(F.col("reportdate") <= F.lit(until))
        .groupBy("region", F.col("reportdate").alias("date"))
        .agg(skip_sum("icu_o").alias("values"))
        .withColumn("series", F.lit("icu"))
    )
    daily = case_days(cases, until).unionByName(beds)
    both = with_national(daily, ["series", "region", "date"], national)
    return both.where(in_regions([national, *regions]))


def weekly_targets(cases: DataFrame, hospital: DataFrame, regions: Sequence[str], national: str,
                   until: dt.date, epoch: dt.date = EPOCH_DEC31, lower: int = FIRST_DAY) -> DataFrame:
    """Weekly means of three series, the last week of each left out."""
    daily = regional_series(cases, hospital, regions, national, until)
    means = weekly(daily, ["series", "region"]).select(
        "series", "region", day_offset("date", epoch).alias("times"), half_even("values").alias("values")
    )
    return trim_tail(means, ["series", "region"], lower)


def long_text(series: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows with a comma behind each number, as the long calibration files hold them."""
    return series.select(*keys, F.col("times").alias("day"), with_comma("times").alias("times"),
                         with_comma("values").alias("values"))


# The dates by which cases are counted.
CASE_DATES = {"notifications": "admitted", "deaths": "died"}


def case_days(cases: DataFrame, until: dt.date, dates: dict[str, str] = CASE_DATES) -> DataFrame:
    """Notifications and deaths per region and day up to a date."""
    return daily_counts(cases, ["region"], dates, until)


def rolling_notifications(daily: DataFrame, regions: Sequence[str], national: str, epoch: dt.date = EPOCH_DEC31,
                          lower: int = 60, tail: int = 9, width: int = 7) -> DataFrame:
    """Mean of the observed days among each day and the six after it, for the nation and the regions."""
    counts = daily.where(F.col("series") == "notifications")
    both = with_national(counts, ["region", "date"], national).where(in_regions([national, *regions]))
    days = fill_days(both, ["region"])
    smooth = days.withColumn("values", half_even(rolling(["region"], "date", "values", width)))
    series = smooth.select("region", "date", day_offset("date", epoch).alias("times"), "values")
    return complete_rows(trim_tail(series, ["region"], lower, tail))


def cumulative_deaths(daily: DataFrame, regions: Sequence[str], national: str,
                      epoch: dt.date = EPOCH_DEC31) -> DataFrame:
    """Deaths to date and the date of the last one, for the nation and the regions."""
    deaths = daily.where(F.col("series") == "deaths")
    both = deaths.withColumn("region", F.explode(F.array(F.col("region"), F.lit(national))))
    return (
        both.where(in_regions([national, *regions]))
        .groupBy("region")
        .agg(F.sum("values").alias("values"), F.max("date").alias("date"))
        .withColumn("times", day_offset("date", epoch))
    )


def icu_by_day(hospital: DataFrame, regions: Sequence[str], national: str, until: dt.date,
               epoch: dt.date = EPOCH_DEC31) -> DataFrame:
    """Occupancy per day for the nation and the regions; missing reports count nothing."""
    daily = (
        hospital.where(F.col("reportdate") <= F.lit(until))
        .groupBy("region", F.col("reportdate").alias("date"))
        .agg(skip_sum("icu_o").alias("values"))
    )
    both = with_national(daily, ["region", "date"], national).where(in_regions([national, *regions]))
    return both.withColumn("times", day_offset("date", epoch))


def latest_icu(hospital: DataFrame, regions: Sequence[str], national: str, until: dt.date,
               epoch: dt.date = EPOCH_DEC31) -> DataFrame:
    """Occupancy on the last day of each."""
    return rows_at_max(icu_by_day(hospital, regions, national, until, epoch), ["region"], "date")
