"""Whole jobs over files made from the supplied tables; the files they write are read back."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.dates import EPOCH_DEC31, offset_date
from ..functions.labels import HOSPITAL_REGIONS, LINE_LIST_REGIONS, RESIDENCE_REGIONS, recode
from ..plans import jobs, validation
from ..plans.calibration import long_text
from ..plans.scenarios import processed_series
from ..session import scratch_path
from ..sources.publish import published
from ..sources.readers import read_columns, read_table
from ..sources.writers import write_by, write_table
from . import report_queries as reports
from . import views
from .registry import TWINS, query, rounded


def cases_file(spark, folder):
    path = scratch_path(spark, "cases")
    write_table(
        views.line_list(spark, folder).selectExpr(
            "case_id", "region AS Region", "CAST(died AS STRING) AS Date_Died",
            "CAST(admitted AS STRING) AS imputed_Date_Admitted",
        ),
        path,
    )
    return path


def admissions_file(spark, folder):
    path = scratch_path(spark, "admissions")
    day = "date_format({}, 'M/d/yyyy') AS `{}`"
    write_table(
        views.line_list(spark, folder).selectExpr(
            "case_id", "region AS Region", day.format("admitted", "Date Admitted"), day.format("report", "Report Date"),
            day.format("report", "Date Recovered"), day.format("died", "Date Died"),
        ),
        path,
    )
    return path


def hospital_file(spark, folder):
    path = scratch_path(spark, "hospital")
    write_table(
        views.hospital(spark, folder).selectExpr("facility", "region", "CAST(reportdate AS STRING) AS reportdate", "icu_o"),
        path,
    )
    return path


CELL = "times string, values string, "


@query("weekly_job", f"""
WITH {reports.WEEKLY} SELECT series, region, t || ',' AS times, n || ',' AS values FROM k
UNION ALL SELECT series, region, {reports.WIDE_TIMES}, 'wide' FROM k GROUP BY ALL
UNION ALL SELECT series, region, {reports.WIDE_VALUES}, 'wide' FROM k GROUP BY ALL""", ["line_list", "hospital"])
def weekly_job(spark, folder):
    out = scratch_path(spark, "weekly")
    jobs.weekly_job(
        spark, cases_file(spark, folder), hospital_file(spark, folder), out, reports.SHORT_REGIONS, views.NATIONAL,
        views.ORDERS_UNTIL, views.ORDERS_EPOCH,
    )
    long = read_table(spark, f"{out}/long", CELL + "series string, region string")
    wide = spark.read.schema("value string, series string, region string").text(f"{out}/wide")
    lines = wide.select("series", "region", F.col("value").alias("times"), F.lit("wide").alias("values"))
    return long.select("series", "region", "times", "values").unionByName(lines)


@query("rolling_job", f"""
SELECT 'notifications' AS output, region, CAST(NULL AS VARCHAR) AS date, times || ',' AS times,
  CAST(values AS BIGINT) || ',' AS values FROM ({TWINS["rolling_notifications"]})
UNION ALL SELECT 'deaths', region, CAST(date AS VARCHAR), CAST(times AS VARCHAR), CAST(values AS VARCHAR)
FROM ({TWINS["cumulative_deaths"]})
UNION ALL SELECT 'icu', region, CAST(date AS VARCHAR), CAST(times AS VARCHAR), CAST(values AS VARCHAR)
FROM ({TWINS["latest_icu"]})""")
def rolling_job(spark, folder):
    """All three outputs."""
    out = scratch_path(spark, "rolling")
    jobs.rolling_job(
        spark, cases_file(spark, folder), hospital_file(spark, folder), out, reports.SHORT_REGIONS, views.NATIONAL,
        views.ORDERS_UNTIL, views.ORDERS_EPOCH,
    )
    cells = read_table(spark, f"{out}/notifications", CELL + "region string").withColumn("date", F.lit(None).cast("string"))
    tables = {"notifications": cells}
    for name in ("deaths", "icu"):
        tables[name] = read_columns(spark, f"{out}/{name}", "region string, date string, times string, values string")
    return reduce(DataFrame.unionByName, [
        t.select(F.lit(n).alias("output"), "region", "date", "times", "values") for n, t in tables.items()
    ])


def both_outputs(spark, out, columns, regional, national):
    """The rows of ``out/regional`` and ``out/national``, cells without the blanks before them."""
    parts = []
    for name, keys in (("regional", regional), ("national", national)):
        rows = read_columns(spark, f"{out}/{name}", ", ".join(f"{c} string" for c in [*keys, *columns]))
        parts.append(rows.select(F.lit(name).alias("output"), *keys, *[F.trim(c).alias(c) for c in columns]))
    return parts[0].unionByName(parts[1], allowMissingColumns=True)


@query("imputed_job", f"""
SELECT 'regional' AS output, series, CASE region WHEN '4A' THEN 'Region_IV_A_Calabarzon' WHEN '5' THEN 'Region_V_Bicol'
    WHEN '7' THEN 'Region_VII_Central_Visayas' ELSE region END AS region, times, values, times_wide, values_wide
FROM ({TWINS["imputed_regional"]})
UNION ALL SELECT 'national', series, NULL, trim(times), trim(values), times_wide, values_wide
FROM ({TWINS["imputed_national"]})""")
def imputed_job(spark, folder):
    """Both outputs."""
    out = scratch_path(spark, "imputed")
    jobs.imputed_job(spark, admissions_file(spark, folder), out, LINE_LIST_REGIONS, views.ORDERS_EPOCH)
    columns = ["times", "values", "times_wide", "values_wide"]
    return both_outputs(spark, out, columns, ["series", "region"], ["series"])


CELLS = ["times", "values", "values_bracketed", "times_wide", "values_wide"]
TRIMMED = ", ".join(f"trim({c}) AS {c}" for c in CELLS)


@query("icu_job", f"""
SELECT 'regional' AS output, region, {TRIMMED} FROM ({TWINS["icu_regional_wide"]})
UNION ALL SELECT 'national', NULL, {TRIMMED} FROM ({TWINS["icu_national"]})""")
def icu_job(spark, folder):
    """Both outputs."""
    out = scratch_path(spark, "icu")
    jobs.icu_job(spark, hospital_file(spark, folder), out, HOSPITAL_REGIONS, views.ORDERS_EPOCH)
    return both_outputs(spark, out, CELLS, ["region"], [])


@query("validation_job", f"""
SELECT s.*, adj_r2 FROM ({TWINS["calibrated_split"]}) s
LEFT JOIN ({TWINS["fit_adjusted_r2"]}) f USING (model_run_date, region, metric)""")
def validation_job(spark, folder):
    """A run per date, each with the calibration files of its day; the last one fills the older ones."""
    root, archive = scratch_path(spark, "model"), scratch_path(spark, "archive")
    views.uncertainty_raw(spark, folder).write.partitionBy("region").parquet(f"{root}/uncertainty")
    names = {o: m for m, o in views.OUTPUTS.items()}
    reported = processed_series(views.reported_raw(spark, folder)).select(
        recode("type", names).alias("series"), "region", "times", F.col("value").alias("values")
    )
    for run_date in views.RUN_DATES:
        files = scratch_path(spark, "files")
        known = reported.where(offset_date("times", EPOCH_DEC31) <= F.lit(run_date))
        write_by(long_text(known, ["series", "region"]).drop("day"), files, ["series", "region"])
        split = jobs.validation_job(
            spark, root, files, archive, run_date, list(views.OUTPUTS.values()), views.OUTPUTS, "0"
        )
    keys = ["model_run_date", "region", "metric"]
    rows = split.select(*keys, "date", "reported", "q50", "model").join(validation.fit(split), keys, "left")
    return rounded(rows, "q50", "adj_r2")


# Raw names of the residence line list, by code of the line list.
RESIDENCES = dict(zip(["NCR", "4A", "5", "7"], RESIDENCE_REGIONS))
RESIDENCE_CASE = "CASE region " + " ".join(f"WHEN '{c}' THEN '{RESIDENCE_REGIONS[n]}'" for c, n in RESIDENCES.items()) + " END"


@query("residence_job", f"""
SELECT 'regional' AS output, series, {RESIDENCE_CASE} AS region,
  string_agg(CAST(t AS VARCHAR), ', ' ORDER BY t) AS line FROM (
  SELECT 'notifications' AS series, region, onset - DATE '1994-12-31' AS t FROM line_list WHERE onset IS NOT NULL GROUP BY ALL
  UNION ALL SELECT 'deaths', region, died - DATE '1994-12-31' FROM line_list WHERE died IS NOT NULL GROUP BY ALL)
WHERE region IN ('NCR', '4A', '5', '7') GROUP BY ALL
UNION ALL SELECT 'daily', series, NULL, string_agg(CAST(t AS VARCHAR), ', ' ORDER BY t) FROM (
  SELECT 'notifications' AS series, onset - DATE '1994-12-31' AS t FROM line_list WHERE onset IS NOT NULL GROUP BY ALL
  UNION ALL SELECT 'deaths', died - DATE '1994-12-31' FROM line_list WHERE died IS NOT NULL GROUP BY ALL)
WHERE t > 40 GROUP BY ALL
UNION ALL SELECT 'confirmed', NULL, NULL, CAST(report - DATE '1994-12-31' AS VARCHAR) || ':' || CAST(count(*) AS VARCHAR)
FROM line_list WHERE report IS NOT NULL GROUP BY report""", ["line_list"])
def residence_job(spark, folder):
    """From the raw layout to published files; of each text file its line of times."""
    cases, out = scratch_path(spark, "residence"), scratch_path(spark, "published")
    raw = views.line_list(spark, folder).selectExpr(
        "region AS RegionRes", "CAST(report AS STRING) AS DateRepConf", "CAST(onset AS STRING) AS DateOnset",
        "CAST(died AS STRING) AS DateDied",
    )
    write_table(raw.withColumn("RegionRes", recode("RegionRes", RESIDENCES)), cases)
    jobs.residence_job(spark, cases, out, epoch=views.ORDERS_EPOCH, lower=40)
    paths = published(spark, out)

    def lines(name, *keys):
        rows = spark.read.schema(", ".join(["value string", *[f"{k} string" for k in keys]])).text(paths[name], wholetext=True)
        region = F.col("region") if "region" in keys else F.lit(None).cast("string")
        return rows.select(F.lit(name).alias("output"), "series", region.alias("region"),
                           F.substring_index("value", "\n", 1).alias("line"))

    confirmed = read_columns(spark, paths["confirmed"], "times int, values long").select(
        F.lit("confirmed").alias("output"), F.lit(None).cast("string").alias("series"),
        F.lit(None).cast("string").alias("region"), F.concat_ws(":", "times", "values").alias("line"),
    )
    return lines("regional", "series", "region").union(lines("daily", "series")).union(confirmed)
