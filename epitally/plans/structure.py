"""Age structure of the population and mobility relative to the baseline."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.bands import AGE_LEVELS, OLD_BANDS, POPULATION_BANDS
from ..functions.labels import MOBILITY_LABELS, ordinal, recode
from ..functions.numbers import relative_change, row_mean, row_sum, thousands_to_millions, to_number
from ..operators.filters import area, is_blank
from ..operators.reshape import to_long

OTHER_PLACES = [
    "retail_and_recreation_percent_change_from_baseline",
    "grocery_and_pharmacy_percent_change_from_baseline",
    "parks_percent_change_from_baseline",
    "transit_stations_percent_change_from_baseline",
]
WORK = "workplaces_percent_change_from_baseline"
HOME = "residential_percent_change_from_baseline"


def numeric_bands(population: DataFrame) -> DataFrame:
    """The band columns as numbers; texts such as ``...`` become null."""
    return population.withColumns({band: to_number(F.col(f"`{band}`")) for band in POPULATION_BANDS})


def age_structure(population: DataFrame, areas: Sequence[str], year: int, leave_out: Sequence[str] = ()) -> DataFrame:
    """Population in millions per area and band, all from 75 on in one band."""
    kept = population.where(F.col("area").isin(list(areas)) & (F.col("reference_year") == year))
    bands = numeric_bands(kept).withColumn("75+", row_sum([F.col(f"`{b}`") for b in OLD_BANDS]))
    shown = [band for band in AGE_LEVELS if band not in leave_out]
    long = to_long(bands, ["area"], shown, "age_group", "population")
    return long.select(
        "area", "age_group", ordinal("age_group", AGE_LEVELS).alias("position"),
        thousands_to_millions("population").alias("millions"),
    )


def population_totals(population: DataFrame, year: int) -> DataFrame:
    """Total of all bands per area, in thousands."""
    kept = numeric_bands(population.where(F.col("reference_year") == year))
    return kept.select(F.col("area").alias("region"), row_sum([F.col(f"`{b}`") for b in POPULATION_BANDS])
                       .alias("population"))


def mobility_index(mobility: DataFrame, country: str, sub_regions: Sequence[str],
                   labels: Mapping[str, str] = MOBILITY_LABELS) -> DataFrame:
    """Mobility at work, at home and elsewhere as a multiple of the baseline, per area and day.

    Areas are the country as a whole and the listed sub-regions, found in one scan.
    """
    kept = mobility.where(
        area(country) | ((F.col("country_region") == country) & F.col("sub_region_1").isin(list(sub_regions)))
    )
    named = kept.withColumn("area", F.when(is_blank("sub_region_1"), F.lit(country)).otherwise(F.col("sub_region_1")))
    places = named.withColumn("other", row_mean(OTHER_PLACES))
    long = to_long(places, ["area", "metro_area", "date"], [WORK, HOME, "other"], "location", "percent")
    return long.select(
        "area", "metro_area", "date",
        recode("location", labels).alias("location"),
        ordinal("location", list(labels)).alias("position"),
        relative_change("percent").alias("mobility"),
    )
