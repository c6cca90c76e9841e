"""Raw tables, all text as the files hold them, to the columns the reports use."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.dates import parse_iso_date, parse_us_date
from ..functions.labels import HOSPITAL_REGIONS_SHORT, LINE_LIST_REGIONS_SHORT, SERIES_REGIONS, recode


def cases_by_residence(raw: DataFrame) -> DataFrame:
    return raw.select(
        F.col("RegionRes").alias("region"),
        parse_iso_date("DateRepConf").alias("report"),
        parse_iso_date("DateOnset").alias("onset"),
        parse_iso_date("DateDied").alias("died"),
    )


def cases_by_admission(raw: DataFrame) -> DataFrame:
    """Dates as month, day, year; the admission date may be missing."""
    return raw.select(
        F.col("Region").alias("region"),
        parse_us_date("Date Admitted").alias("admitted"),
        parse_us_date("Report Date").alias("report"),
        parse_us_date("Date Recovered").alias("recovered"),
        parse_us_date("Date Died").alias("died"),
    )


def cases_imputed(raw: DataFrame) -> DataFrame:
    """Admission dates already imputed; codes become the names of the weekly series."""
    return raw.select(
        recode("Region", LINE_LIST_REGIONS_SHORT).alias("region"),
        parse_iso_date("imputed_Date_Admitted").alias("admitted"),
        parse_iso_date("Date_Died").alias("died"),
    )


def cases_aged(raw: DataFrame) -> DataFrame:
    return raw.select(
        recode("Region", SERIES_REGIONS).alias("region"), F.col("Age").alias("age"), F.col("Report_Date").alias("report")
    )


def hospital_daily(raw: DataFrame, short_names: bool = False) -> DataFrame:
    region = recode("region", HOSPITAL_REGIONS_SHORT) if short_names else F.col("region")
    return raw.select(region.alias("region"), parse_iso_date("reportdate").alias("reportdate"), "icu_o")


def test_volume(raw: DataFrame) -> DataFrame:
    return raw.select(
        F.col("facility_name").alias("facility"),
        parse_iso_date("report_date").alias("report_date"),
        F.col("daily_output_samples_tested").alias("n_tests"),
    )


def facilities(raw: DataFrame) -> DataFrame:
    return raw.select(F.col("facility_name").alias("facility"), F.col("Region").alias("region"))


def mobility(raw: DataFrame) -> DataFrame:
    return raw.withColumn("date", parse_iso_date("date"))
