"""Laboratory tests: positivity, per-capita testing, case detection rate."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.dates import parse_iso_date, parse_long_date
from ..functions.numbers import NATIONAL_POPULATION, detection_rate, half_even, number_from_text, per_10k, tested_share
from ..operators.aggregates import daily_counts, skip_sum, strict_sum, with_national
from ..operators.quantiles import bounded_quantiles, interpolated, ordered_draws
from ..operators.reshape import QUANTILES
from ..operators.sampling import sample_rows
from ..operators.series import rolling

DETECTION_PARAMETER = "testing_to_detection.assumed_cdr_parameter"
SAMPLED_DRAWS = 500


def test_totals(rows: DataFrame) -> DataFrame:
    """Tests per day with the shares positive and negative, from texts with thousands commas.

    The rows are summed per date text first, so that each text is parsed once and not per row.
    """
    counts = ("tested", "positive", "negative")
    by_text = rows.groupBy("date").agg(*[strict_sum(number_from_text(c)).alias(c) for c in counts])
    totals = by_text.groupBy(parse_long_date("date").alias("date")).agg(
        *[strict_sum(c).alias(f"total_{c}") for c in counts]
    )
    return totals.withColumns({
        "percent_positive": half_even(F.col("total_positive") / F.col("total_tested"), 2),
        "percent_negative": half_even(F.col("total_negative") / F.col("total_tested"), 2),
    })


def cases_times_tests(cases: DataFrame, report: str, totals: DataFrame,
                      population: int = NATIONAL_POPULATION) -> DataFrame:
    """Cases of each day scaled by the share of the population tested that day."""
    daily = daily_counts(cases, [], {"cases": report}).select(
        F.col("date").alias("report_date"), F.col("values").alias("total_cases")
    )
    both = daily.join(totals, daily["report_date"] == totals["date"])
    return both.select(
        "report_date", "total_cases", "total_tested",
        tested_share("total_tested", population).alias("tested_share"),
        (F.col("total_cases") * tested_share("total_tested", population)).alias("scaled_cases"),
    )


def tests_by_region(tests: DataFrame, facilities: DataFrame, national: str) -> DataFrame:
    """Tests per region and day with the nation; facilities missing from the list count nowhere.

    The tests are summed per facility and day first, so that a busy facility stays small however the
    list is joined.
    """
    rows = tests.groupBy("facility", "report_date").agg(skip_sum("n_tests").alias("n_tests"))
    regional = (
        rows.join(facilities, "facility")
        .groupBy("region", "report_date")
        .agg(skip_sum("n_tests").alias("tests"))
    )
    return with_national(regional, ["region", "report_date"], national, value="tests")


def per_capita_tests(daily: DataFrame, population: DataFrame, width: int = 20) -> DataFrame:
    """Tests per ten thousand people and their centred mean over ``width`` rows of the region."""
    rated = daily.join(population, "region", "left").withColumn("per_capita", per_10k("tests", "population"))
    return rated.withColumn(
        "smoothed", rolling(["region"], "report_date", "per_capita", width, align="center")
    ).drop("population")


def detection_draws(draws: DataFrame, seed: int, n: int = SAMPLED_DRAWS, name: str = DETECTION_PARAMETER,
                    key: str = "draw_id") -> DataFrame:
    """n draws of the detection parameter per region."""
    kept = draws.where(F.col("name") == name).select("region", key, "value")
    return sample_rows(kept, ["region"], n, key, seed)


def detection_rates(sampled: DataFrame, per_capita: DataFrame, scale: Mapping[str, float] | None = None) -> DataFrame:
    """The detection rate of every sampled draw on every day of its region.

    The result has n rows per region and day; :func:`detection_band` needs none of them.
    """
    joined = per_capita.join(sampled.select("region", "id", "value"), "region")
    rate = detection_rate("value", "smoothed")
    return joined.withColumn("rate", _scaled(rate, scale))


def detection_band_of_rates(rates: DataFrame) -> DataFrame:
    """Quantiles over the draws of each region and day, at most n of them."""
    return rates.groupBy("region", "report_date").agg(*bounded_quantiles("rate", QUANTILES))


def detection_band(sampled: DataFrame, per_capita: DataFrame, scale: Mapping[str, float] | None = None) -> DataFrame:
    """The same band without a row per draw.

    The rate never falls as the draw grows, so each quantile over the draws is found from the
    two draws around its rank. Below zero smoothed tests, or a negative scale, it never rises; then
    the ranks are counted from the other end. The sampled draws of a region travel as one ordered array.
    """
    arrays = ordered_draws(sampled, ["region"], "value")
    falls = _scaled(F.col("smoothed"), scale) < 0
    joined = per_capita.join(arrays, "region").withColumn(
        "draws", F.when(falls, F.reverse("draws")).otherwise(F.col("draws"))
    )
    return joined.select(
        "region", "report_date",
        *[
            _scaled(
                interpolated(F.col("draws"), p, lambda v: detection_rate(v, F.col("smoothed"))), scale
            ).alias(name)
            for p, name in QUANTILES.items()
        ],
    )


def _scaled(rate, scale: Mapping[str, float] | None):
    if not scale:
        return rate
    factor = F.lit(1.0)
    for region, value in scale.items():
        factor = F.when(F.col("region") == region, F.lit(float(value))).otherwise(factor)
    return rate * factor


def facility_positivity(reports: DataFrame, columns: Sequence[str] = ("facility_name", "report_date",
                                                                      "pct_positive_cumulative")) -> DataFrame:
    """Positivity of each facility and day, the date parsed."""
    return reports.select(*columns).withColumn("report_date", parse_iso_date("report_date"))
