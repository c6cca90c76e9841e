"""Model bands: scenarios, indicators, peak, lookups."""

from __future__ import annotations

import datetime as dt
from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.dates import EPOCH_DEC31, offset_date
from ..functions.labels import (
    INDICATOR_LABELS,
    MODEL_REGIONS,
    SCENARIO_LABELS,
    SERIES_REGIONS,
    recode,
)
from ..operators.filters import offset_between, rows_at_max
from ..operators.joins import with_labels
from ..operators.quantiles import bounded_quantiles
from ..operators.reshape import quantile_wide
from ..operators.series import carry_forward
from ..sources.readers import literal_table

BAND_KEYS = ["region", "scenario", "type", "times", "date"]
INTERVAL = {0.025: "q025", 0.5: "q50", 0.975: "q975"}


def model_table(df: DataFrame, epoch: dt.date = EPOCH_DEC31) -> DataFrame:
    """A model table with display names of its regions and, where it has days, their dates."""
    out = df.withColumn("region", recode("region", MODEL_REGIONS))
    return out.withColumn("date", offset_date("times", epoch)) if "times" in df.columns else out


def processed_series(df: DataFrame) -> DataFrame:
    return df.withColumn("region", recode("region", SERIES_REGIONS))


def bands(uncertainty: DataFrame) -> DataFrame:
    """One row per region, scenario, type and day with a column per quantile."""
    return quantile_wide(uncertainty, BAND_KEYS)


def bands_vs_reported(uncertainty: DataFrame, reported: DataFrame, scenarios: Sequence[int],
                      regions: Sequence[str] | None = None, leave_out: Sequence[str] = (),
                      kind: str = "notifications") -> DataFrame:
    """Bands of the scenarios (with and without behaviour change, say) beside the reported values."""
    kept = uncertainty.where(F.col("scenario").isin(list(scenarios)) & (F.col("type") == kind))
    if regions:
        kept = kept.where(F.col("region").isin(list(regions)))
    if leave_out:
        kept = kept.where(~F.col("region").isin(list(leave_out)))
    series = reported.select("region", "times", F.col("value").alias("reported"))
    return bands(kept).join(series, ["region", "times"], "left")


def behaviour_overlay(curve: DataFrame, banded: DataFrame, until: int | None = None, cutoff: int = 314,
                      epoch: dt.date = EPOCH_DEC31) -> DataFrame:
    """The behaviour curve on the scale of each region's bands, its last value held to ``until`` or the model's last day.

    The scale is twice the highest upper bound of the region. There are as many scales as
    regions, and the curve repeats for each.
    """
    known = curve.where(offset_between(upper=cutoff))
    end = banded.agg(F.max("times")).scalar() if until is None else F.lit(until)
    whole = carry_forward(known, end, "times", "inverse_mhs_values")
    tops = banded.groupBy("region").agg((F.max("q975") * 2).alias("top"))
    scales = tops.agg(F.array_sort(F.collect_list(F.struct("region", "top")))).scalar()
    return whole.withColumn("_s", F.explode(scales)).select(
        F.col("_s.region").alias("region"), "times", offset_date("times", epoch).alias("date"), "extended",
        "inverse_mhs_values", ((F.lit(1.0) - F.col("inverse_mhs_values")) * F.col("_s.top")).alias("scaled"),
    )


def indicators_vs_reported(uncertainty: DataFrame, reported: DataFrame, scenario: int = 0,
                           labels: Mapping[str, str] = INDICATOR_LABELS) -> DataFrame:
    """Bands of several indicators with reported values; either side may lack a day."""
    model = uncertainty.where((F.col("scenario") == scenario) & F.col("type").isin(list(labels)))
    observed = reported.select("region", "times", "type", F.col("value").alias("reported"))
    joined = model.join(observed, ["region", "times", "type"], "full")
    wide = quantile_wide(joined, [*BAND_KEYS, "reported"])
    return wide.withColumn("type", recode("type", labels))


def scenario_comparison(uncertainty: DataFrame, after: int = 425, without: Sequence[int] = (1,),
                        kind: str = "notifications", labels: Mapping[int, str] = SCENARIO_LABELS) -> DataFrame:
    """Bands of the scenarios after a day, with their labels and display order."""
    kept = uncertainty.where(
        (F.col("type") == kind) & (F.col("times") > after) & ~F.col("scenario").isin(list(without))
    )
    rows = [(number, label, i) for i, (number, label) in enumerate(labels.items(), start=1)]
    table = literal_table(uncertainty.sparkSession, rows, "scenario int, label string, position int")
    return with_labels(bands(kept), "scenario", table)


def contrast(comparison: DataFrame, pair: Sequence[int] = (0, 5), after: int = 424) -> DataFrame:
    """The two scenarios whose bands are drawn against each other."""
    return comparison.where(F.col("scenario").isin(list(pair)) & (F.col("times") > after))


def recovered_band(uncertainty: DataFrame, region: str, before: dt.date, scenario: int = 0) -> DataFrame:
    """Share of the population that has been infected, before a date."""
    kept = uncertainty.where(
        (F.col("scenario") == scenario) & (F.col("region") == region)
        & (F.col("type") == "proportion_seropositive") & (F.col("date") < F.lit(before))
    )
    return bands(kept)


def incidence_by_day(uncertainty: DataFrame, region: str, until: dt.date, scenario: int | None = None) -> DataFrame:
    """Incidence rows up to a date; all scenarios unless one is named."""
    kept = uncertainty.where(
        (F.col("region") == region) & (F.col("type") == "incidence") & (F.col("date") <= F.lit(until))
    )
    return kept if scenario is None else kept.where(F.col("scenario") == scenario)


def incidence_peak(uncertainty: DataFrame, region: str, until: dt.date, scenario: int | None = None) -> DataFrame:
    """The day or days of highest median incidence."""
    rows = incidence_by_day(uncertainty, region, until, scenario)
    medians = rows.groupBy("region", "date").agg(*bounded_quantiles("value", {0.5: "q50"}))
    return rows_at_max(medians, ["region"], "q50")


def incidence_peak_interval(uncertainty: DataFrame, region: str, until: dt.date,
                            scenario: int | None = None) -> DataFrame:
    """Quantiles of the incidence rows on the peak day.

    The rows of a day are one per scenario and stored quantile.
    """
    peak = incidence_peak(uncertainty, region, until, scenario).select("date")
    rows = incidence_by_day(uncertainty, region, until, scenario).join(peak, "date", "left_semi")
    return rows.groupBy("region").agg(F.max("date").alias("peak_date"), *bounded_quantiles("value", INTERVAL))


def lookup(banded: DataFrame, region: str, date: dt.date, kind: str | None = None) -> DataFrame:
    """Lower, middle and upper value of one region and day."""
    hit = (F.col("region") == region) & (F.col("date") == F.lit(date))
    if kind is not None:
        hit = hit & (F.col("type") == kind)
    return banded.where(hit).select("region", "date", *INTERVAL.values())


