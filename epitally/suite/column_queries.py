"""Scalar functions and projections."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.bands import OLD_BANDS, age_band
from ..functions.dates import (
    day_offset,
    impute_date,
    lag_days,
    offset_date,
    parse_iso_date,
    parse_long_date,
    parse_us_date,
    week_start,
    weeks_after,
)
from ..functions.labels import (
    HOSPITAL_REGIONS,
    HOSPITAL_REGIONS_SHORT,
    LINE_LIST_REGIONS,
    METRICS,
    REGION_ORDER,
    ordinal,
    recode,
    tag,
)
from ..functions.numbers import (
    half_even,
    number_from_text,
    relative_change,
    row_mean,
    row_sum,
    strip_text,
    tested_share,
    thousands_to_millions,
)
from ..functions.text import number_text, with_comma
from ..operators.reshape import append, matching_columns, rename_headers, to_long
from ..plans.calibration import impute_admission
from ..plans.scenarios import model_table, processed_series
from ..plans.structure import OTHER_PLACES, numeric_bands
from ..plans.validation import by_metric
from ..sources.readers import fixed_part
from . import views
from .registry import query, rounded


@query("parse_dates", """
SELECT o_orderkey AS case_id,
  CASE WHEN o_orderkey % 17 = 0 THEN NULL ELSE CAST(o_orderdate AS DATE) END AS iso,
  CAST(o_orderdate AS DATE) AS us, CAST(o_orderdate AS DATE) AS long
FROM orders""")
def parse_dates(spark, folder):
    """Texts with one or two digits, with a time behind the date, and texts that are no date."""
    raw = views.table(spark, folder, "orders").selectExpr(
        "o_orderkey AS case_id",
        """CASE WHEN o_orderkey % 17 = 0 THEN 'unknown'
           WHEN o_orderkey % 3 = 0 THEN date_format(o_orderdate, 'yyyy-M-d')
           WHEN o_orderkey % 3 = 1 THEN date_format(o_orderdate, "yyyy-MM-dd'T'HH:mm:ss")
           ELSE date_format(o_orderdate, 'yyyy-MM-dd') END AS iso""",
        """CASE WHEN o_orderkey % 2 = 0 THEN date_format(o_orderdate, 'M/d/yyyy')
           ELSE date_format(o_orderdate, 'MM/dd/yyyy HH:mm') END AS us""",
        """CASE WHEN o_orderkey % 2 = 0 THEN upper(date_format(o_orderdate, 'MMMM d, yyyy'))
           ELSE date_format(o_orderdate, 'MMMM d, yyyy') END AS long""",
    )
    return raw.select(
        "case_id", parse_iso_date("iso").alias("iso"), parse_us_date("us").alias("us"),
        parse_long_date("long").alias("long"),
    )


@query("day_offsets", """
SELECT case_id, CAST(admitted - DATE '1994-12-31' AS INTEGER) AS times, admitted AS again,
  CAST(report - admitted AS INTEGER) AS lag,
  CASE WHEN admitted IS NOT NULL THEN
    greatest(round_even(CAST(admitted - DATE '1998-01-01' AS DOUBLE) / 7.0, 0) + 0.0, 0.0) END AS week,
  CAST(date_trunc('week', report) AS DATE) AS monday
FROM line_list""", ["line_list"])
def day_offsets(spark, folder):
    cases = views.line_list(spark, folder).withColumn("times", day_offset("admitted", views.ORDERS_EPOCH))
    return cases.select(
        "case_id", "times", offset_date("times", views.ORDERS_EPOCH).alias("again"),
        lag_days("report", "admitted").alias("lag"),
        weeks_after("admitted", F.lit("1998-01-01").cast("date")).alias("week"),
        week_start("report").alias("monday"),
    )


@query("admission_imputation", """
SELECT case_id, region, region_lag, coalesce(admitted, report - region_lag) AS admitted_adjusted
FROM (SELECT *, CAST(round_even(avg(CAST(report - admitted AS DOUBLE)) OVER (PARTITION BY region), 0) AS INTEGER)
        AS region_lag FROM line_list)""", ["line_list"])
def admission_imputation(spark, folder):
    """Regional mean lag beside each case; cases without a region share one lag."""
    cases = impute_admission(views.line_list(spark, folder))
    return cases.select("case_id", "region", "region_lag", "admitted_adjusted")


@query("region_recode", """
SELECT case_id, CASE region WHEN '4A' THEN 'Region_IV_A_Calabarzon' WHEN '5' THEN 'Region_V_Bicol'
  WHEN '7' THEN 'Region_VII_Central_Visayas' ELSE region END AS region, region AS code
FROM line_list""", ["line_list"])
def region_recode(spark, folder):
    """Codes become names, unmatched codes stay; the code is kept under another name."""
    return views.line_list(spark, folder).select(
        "case_id", recode("region", LINE_LIST_REGIONS).alias("region"), F.col("region").alias("code")
    )


@query("hospital_region_recode", """
SELECT region, short, count(*) AS n FROM (
  SELECT CASE region WHEN 'NATIONAL CAPITAL REGION (NCR)' THEN 'NCR'
      WHEN 'REGION IV-A (CALABAR ZON)' THEN 'Region_IV_A_Calabarzon'
      WHEN 'REGION V (BICOL REGION)' THEN 'Region_V_Bicol'
      WHEN 'REGION VII (CENTRAL VISAYAS)' THEN 'Region_VII_Central_Visayas' ELSE region END AS region,
    CASE region WHEN 'NATIONAL CAPITAL REGION (NCR)' THEN 'manila' WHEN 'REGION IV-A (CALABAR ZON)' THEN 'calabarzon'
      WHEN 'REGION VII (CENTRAL VISAYAS)' THEN 'central-visayas' ELSE region END AS short
  FROM hospital) GROUP BY ALL""", ["hospital"])
def hospital_region_recode(spark, folder):
    rows = views.hospital(spark, folder).select(
        recode("region", HOSPITAL_REGIONS).alias("region"), recode("region", HOSPITAL_REGIONS_SHORT).alias("short")
    )
    return rows.groupBy("region", "short").agg(F.count(F.lit(1)).alias("n"))


@query("conditional_value", """
SELECT case_id, CASE WHEN admitted <= report THEN 'in order' WHEN admitted > report THEN 'reversed' END AS dates,
  CASE WHEN age >= 60 THEN 0.5 * age ELSE age END AS scaled
FROM line_list""", ["line_list"])
def conditional_value(spark, folder):
    """A condition on missing values gives a missing value, not the second branch."""
    known = F.col("admitted") <= F.col("report")
    return views.line_list(spark, folder).select(
        "case_id", F.when(known, "in order").when(~known, "reversed").alias("dates"),
        F.when(F.col("age") >= 60, F.col("age") * 0.5).otherwise(F.col("age")).alias("scaled"),
    )


AGE_BAND_SQL = "CASE WHEN age <= 4 THEN '0-4' " + " ".join(
    f"WHEN age BETWEEN {s} AND {s + 4} THEN '{s}-{s + 4}'" for s in range(5, 75, 5)
) + " WHEN age >= 75 THEN '75+' END"


@query("age_bands", f"SELECT {AGE_BAND_SQL} AS age_group, count(*) AS n FROM line_list GROUP BY ALL", ["line_list"])
def age_bands(spark, folder):
    """Ages between two whole years at a band's edge fall in none."""
    return views.line_list(spark, folder).groupBy(age_band("age").alias("age_group")).agg(
        F.count(F.lit(1)).alias("n")
    )


@query("renamed_headers", f"""
SELECT area, band, sum(millions) AS millions FROM (
  UNPIVOT (SELECT area, {", ".join(f'"{b}"' for b in views.POPULATION_BANDS)} FROM population
           WHERE reference_year = 2020)
  ON {", ".join(f'"{b}"' for b in views.POPULATION_BANDS)} INTO NAME band VALUE millions) GROUP BY ALL""", ["population"])
def renamed_headers(spark, folder):
    """Headers as a CSV reader mangles them (``X0.4``) turned back by pattern."""
    rows = numeric_bands(views.population(spark, folder)).where(F.col("reference_year") == views.POPULATION_YEAR)
    mangled = rows.toDF(*[
        "X" + c.replace("-", ".").replace("+", ".") if c in views.POPULATION_BANDS else c for c in rows.columns
    ])
    plain = rename_headers(mangled, (r"^X", ""), (r"\.$", "+"), (r"\.", "-"))
    bands = matching_columns(plain, r"^\d+[-+]")
    long = to_long(plain, ["area"], bands, "band", "millions").where(F.col("millions").isNotNull())
    return long.groupBy("area", "band").agg(F.sum("millions").alias("millions"))


OLD_SUM = " + ".join(f'"{b}"' for b in OLD_BANDS)


@query("population_rows", f"""
SELECT area, reference_year, {OLD_SUM} AS old, ({OLD_SUM}) / 1000.0::DOUBLE AS old_millions
FROM population""", ["population"])
def population_rows(spark, folder):
    """Sum across columns; one missing band makes it missing."""
    rows = numeric_bands(views.population(spark, folder))
    old = row_sum([F.col(f"`{b}`") for b in OLD_BANDS])
    return rows.select("area", "reference_year", old.alias("old"), thousands_to_millions(old).alias("old_millions"))


@query("mobility_rows", f"""
SELECT country_region, sub_region_1, metro_area, date,
  round(({" + ".join(OTHER_PLACES)}) / 4.0, 6) AS other,
  round((workplaces_percent_change_from_baseline + 100) / 100.0, 6) AS work
FROM mobility""", ["mobility"])
def mobility_rows(spark, folder):
    rows = views.mobility(spark, folder).select(
        "country_region", "sub_region_1", "metro_area", "date", row_mean(OTHER_PLACES).alias("other"),
        relative_change("workplaces_percent_change_from_baseline").alias("work"),
    )
    return rounded(rows, "other", "work")


@query("half_even_rounding", """
SELECT l_orderkey, l_linenumber, l_partkey, round_even(l_quantity / 2.0, 0) AS half,
  round_even(l_quantity / 8.0, 2) AS eighth FROM lineitem""")
def half_even_rounding(spark, folder):
    return views.table(spark, folder, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", half_even(F.col("l_quantity") / 2).alias("half"),
        half_even(F.col("l_quantity") / 8, 2).alias("eighth"),
    )


@query("numbers_from_text", """
SELECT date, count(tested) AS n, CAST(sum(tested) AS DOUBLE) AS tested, CAST(sum(positive) AS DOUBLE) AS positive,
  CAST(sum(negative) AS DOUBLE) AS negative
FROM test_totals GROUP BY ALL""", ["test_totals"])
def numbers_from_text(spark, folder):
    """One function over several columns; a text that is no number is missing."""
    rows = views.test_totals(spark, folder)
    names = ("tested", "positive", "negative")
    numbers = rows.withColumns({c: number_from_text(c) for c in names}).withColumn("date", parse_long_date("date"))
    return numbers.groupBy("date").agg(F.count("tested").alias("n"), *[F.sum(c).alias(c) for c in names])


@query("text_cells", """
SELECT case_id, CAST(admitted - DATE '1994-12-31' AS VARCHAR) || ',' AS times,
  '[' || CAST(CAST(floor(age) AS BIGINT) AS VARCHAR) || ']' AS cell, region || '_' || case_id AS level
FROM line_list""", ["line_list"])
def text_cells(spark, folder):
    return views.line_list(spark, folder).select(
        "case_id", with_comma(day_offset("admitted", views.ORDERS_EPOCH)).alias("times"),
        F.concat(F.lit("["), number_text(F.floor("age")), F.lit("]")).alias("cell"),
        F.concat(F.col("region"), F.lit("_"), F.col("case_id").cast("string")).alias("level"),
    )


@query("fixed_substring", """
SELECT s_suppkey, substr(s_name, 10, length(s_name) - 9) AS number, CAST(length(s_name) AS INTEGER) AS n,
  replace(s_name, 'Supplier#', '') AS stripped FROM supplier""")
def fixed_substring(spark, folder):
    return views.table(spark, folder, "supplier").select(
        "s_suppkey", fixed_part("s_name", 10, 0).alias("number"), F.length("s_name").alias("n"),
        strip_text("s_name", "Supplier#").alias("stripped"),
    )


@query("category_order", """
SELECT region, CASE region WHEN 'Philippines' THEN 1 WHEN 'Calabarzon' THEN 2 WHEN 'Central Visayas' THEN 3
  WHEN 'National Capital Region' THEN 4 END AS position, count(*) AS n FROM draws GROUP BY ALL""", ["draws"])
def category_order(spark, folder):
    rows = model_table(views.draws_raw(spark, folder))
    return rows.groupBy("region").agg(F.count(F.lit(1)).alias("n")).withColumn(
        "position", ordinal("region", REGION_ORDER)
    )


@query("tested_shares", """
SELECT report_date, CAST(sum(n_tests) AS BIGINT) AS tests, round(sum(n_tests) / 106700000.0::DOUBLE, 12) AS share
FROM tests GROUP BY ALL""", ["tests"])
def tested_shares(spark, folder):
    daily = views.tests(spark, folder).groupBy("report_date").agg(F.sum("n_tests").alias("tests"))
    return rounded(daily.withColumn("share", tested_share("tests")), "share", digits=12)


@query("constant_tags", """
SELECT region, times, 'accum_deaths' AS type, value FROM reported WHERE type = 'accum_deaths'
UNION ALL SELECT region, times, 'icu_occupancy', value FROM reported WHERE type = 'icu_occupancy'""", ["reported"])
def constant_tags(spark, folder):
    """Two tables of one series each, tagged and put under each other."""
    rows = processed_series(views.reported_raw(spark, folder))
    parts = [
        tag(rows.where(F.col("type") == kind).select("region", "times", "value"), type=kind)
        for kind in ("accum_deaths", "icu_occupancy")
    ]
    return append(*parts).select("region", "times", "type", "value")


@query("metric_pairs", f"""
SELECT model_run_date, region, scenario, times, date, metric, reported, round(q25, 6) AS q25, round(q50, 6) AS q50,
  round(q75, 6) AS q75
FROM ({" UNION ALL ".join(
    f"SELECT *, '{m}' AS metric, local_data_{m} AS reported, {o}_q25 AS q25, {o}_q50 AS q50, {o}_q75 AS q75 "
    f"FROM archived_runs" for m, o in views.OUTPUTS.items())})""", ["archived_runs"])
def metric_pairs(spark, folder):
    """Each reported metric beside the model output it is compared with."""
    assert {m for m, _, _ in METRICS} == set(views.OUTPUTS)
    rows = by_metric(views.archived_runs(spark, folder), views.OUTPUTS).drop("data_acquired_date")
    return rounded(rows, "q25", "q50", "q75")


@query("imputed_dates", """
SELECT case_id, coalesce(admitted, report - 4) AS admitted FROM line_list""", ["line_list"])
def imputed_dates(spark, folder):
    return views.line_list(spark, folder).select("case_id", impute_date("admitted", "report", F.lit(4)).alias("admitted"))
