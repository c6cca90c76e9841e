"""Age shares of reported and modelled cases."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.bands import AGE_LEVELS, age_band, band_of_start
from ..functions.labels import ordinal
from ..functions.numbers import strip_text
from ..operators.aggregates import row_count, share_of_total, strict_sum
from ..operators.filters import in_regions
from ..operators.reshape import append, matching_columns, to_long

PREFIX = "notificationsXagegroup_"


def reported_age_share(cases: DataFrame, regions: Sequence[str], national: str, age: str = "age",
                       report: str = "report") -> DataFrame:
    """Cases per region and age band, over the region's dated cases whose age falls in a band."""
    banded = cases.select("region", age_band(age).alias("age_group"), F.col(report).alias("_report"))
    counts = (
        banded.where(F.col("age_group").isNotNull())
        .groupBy("region", "age_group")
        .agg(row_count().alias("cases"), F.count("_report").alias("dated"))
    )
    doubled = counts.withColumn("region", F.explode(F.array(F.col("region"), F.lit(national))))
    summed = (
        doubled.where(in_regions([national, *regions]))
        .groupBy("region", "age_group")
        .agg(F.sum("cases").alias("cases"), F.sum("dated").alias("dated"))
    )
    shared = share_of_total(summed, "region", "dated", "total_cases", "_unused")
    return shared.select(
        "region", "age_group", F.col("cases").cast("double").alias("cases"),
        F.col("total_cases").cast("double").alias("total_cases"),
        (F.col("cases") / F.col("total_cases")).alias("share"), F.lit("Reported").alias("type"),
    )


def modelled_age_share(derived: DataFrame, scenario: int | None = 0) -> DataFrame:
    """Modelled cases per region and age band and their share; ``scenario=None`` sums all scenarios.

    The columns are summed before they are turned to rows, so rows grow with the bands and
    not with the table.
    """
    columns = matching_columns(derived, PREFIX)
    kept = derived if scenario is None else derived.where(F.col("scenario") == scenario)
    sums = kept.groupBy("region").agg(*[strict_sum(c).alias(c) for c in columns])
    cells = F.array(*[F.struct(F.lit(c).alias("age_group"), F.col(f"`{c}`").alias("cases")) for c in columns])
    long = sums.select("region", F.inline(cells))
    named = long.withColumn("age_group", band_of_start(strip_text("age_group", PREFIX)))
    shared = share_of_total(named, "region", "cases", "total_cases", "share")
    return shared.select("region", "age_group", "cases", "total_cases", "share", F.lit("Modeled").alias("type"))


def age_shares(cases: DataFrame, derived: DataFrame, regions: Sequence[str], national: str,
               scenario: int | None = 0) -> DataFrame:
    """Both, one under the other, with the display order of the bands."""
    both = append(modelled_age_share(derived, scenario), reported_age_share(cases, regions, national))
    return both.withColumn("position", ordinal("age_group", AGE_LEVELS))
