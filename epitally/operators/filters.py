"""Filters whose missing-value or ordering rules matter."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def in_regions(regions: Sequence[str], region: str = "region") -> Column:
    return F.col(region).isin(list(regions))


def complete_rows(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Rows without a missing value; NaN counts as missing."""
    return df.na.drop("any", subset=list(columns) if columns else None)


def is_blank(c: str) -> Column:
    """Empty text. CSV gives null for an empty cell, so both count."""
    return F.coalesce(F.col(c), F.lit("")) == ""


def area(country: str, sub_region: str | None = None) -> Column:
    """Rows of one sub-region, or of the country as a whole (neither sub-region nor metro area named)."""
    inside = F.col("country_region") == country
    if sub_region is None:
        return inside & is_blank("metro_area") & is_blank("sub_region_1")
    return inside & (F.col("sub_region_1") == sub_region)


def offset_between(lower: int | None = None, upper: int | None = None, c: str = "times") -> Column:
    """Strictly above ``lower``, at most ``upper``."""
    keep = F.lit(True)
    if lower is not None:
        keep = keep & (F.col(c) > lower)
    if upper is not None:
        keep = keep & (F.col(c) <= upper)
    return keep


def trim_tail(df: DataFrame, by: Sequence[str], lower: int, tail: int = 0, c: str = "times") -> DataFrame:
    """Rows above ``lower`` and more than ``tail`` before the last of their group.

    The last one is taken over the whole group, before the lower bound applies.
    """
    last = F.max(c).over(Window.partitionBy(*by))
    return (
        df.withColumn("_last", last)
        .where((F.col(c) > lower) & (F.col(c) < F.col("_last") - tail))
        .drop("_last")
    )


def rows_at_max(df: DataFrame, by: Sequence[str], c: str) -> DataFrame:
    """Rows equal to the maximum of their group; ties are kept."""
    top = F.max(c).over(Window.partitionBy(*by))
    return df.withColumn("_top", top).where(F.col(c) == F.col("_top")).drop("_top")
