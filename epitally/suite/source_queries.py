"""Sources and sinks: what is written and read back again.

Files go to a fresh path under the folder the session names as shared.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.dates import day_offset, parse_iso_date
from ..operators.aggregates import daily_counts, ordered_text, row_count
from ..operators.changes import changes, daily_changes, merged_counts
from ..plans import calibration, posterior, scenarios, testing, validation
from ..session import materialize, scratch_path
from ..sources import schemas
from ..sources.readers import (
    file_part,
    newest_paths,
    path_part,
    read_archive,
    read_calibration_files,
    read_drop,
    read_drops,
    read_model_table,
    read_runs,
    read_table,
)
from ..sources.writers import append_run, write_by, write_table, write_wide_text
from . import report_queries as reports
from . import views
from .operator_queries import uncertainty
from .registry import TWINS, query, rounded

RAW_CASES = [
    "region AS RegionRes", "CAST(report AS STRING) AS DateRepConf", "CAST(onset AS STRING) AS DateOnset",
    "CAST(died AS STRING) AS DateDied",
]


def raw_cases(spark, folder):
    columns = [c.split()[0] for c in schemas.CASES_RESIDENCE.split(", ")]
    return views.line_list(spark, folder).selectExpr(*RAW_CASES).select(*columns)


@query("csv_round_trip", """
SELECT region AS "RegionRes", report, onset, died, count(*) AS n FROM line_list GROUP BY ALL""", ["line_list"])
def csv_round_trip(spark, folder):
    """Dates go out as text with ``NA`` for the missing ones and come back parsed."""
    path = scratch_path(spark, "cases")
    write_table(raw_cases(spark, folder), path)
    rows = read_table(spark, path, schemas.CASES_RESIDENCE)
    dates = {"report": "DateRepConf", "onset": "DateOnset", "died": "DateDied"}
    parsed = rows.select("RegionRes", *[parse_iso_date(c).alias(n) for n, c in dates.items()])
    return parsed.groupBy("RegionRes", *dates).agg(row_count().alias("n"))


def _drops(spark, folder):
    path = scratch_path(spark, "drops")
    dated = raw_cases(spark, folder).withColumn(
        "upload_date", F.concat(F.lit("2020-0"), F.coalesce(F.month(F.col("DateOnset").cast("date")) % 3, F.lit(0)) + 6)
    )
    write_by(dated, path, ["upload_date"])
    return path


@query("dated_drop", """
SELECT region AS "RegionRes", count(*) AS n, count(died) AS deaths FROM line_list
WHERE coalesce(month(onset) % 3, 0) = 2 GROUP BY ALL""", ["line_list"])
def dated_drop(spark, folder):
    """One drop, its date part of the path."""
    rows = read_drop(spark, _drops(spark, folder), "2020-08", schemas.CASES_RESIDENCE)
    return rows.groupBy("RegionRes").agg(row_count().alias("n"), F.count("DateDied").alias("deaths"))


@query("dated_drops_pruned", """
SELECT '2020-0' || (coalesce(month(onset) % 3, 0) + 6) AS upload_date, count(*) AS n FROM line_list
WHERE coalesce(month(onset) % 3, 0) > 0 GROUP BY ALL""", ["line_list"])
def dated_drops_pruned(spark, folder):
    """All drops as one table; the filter on the date reads only the folders it names."""
    rows = read_drops(spark, _drops(spark, folder), schemas.CASES_RESIDENCE)
    return rows.where(F.col("upload_date") > "2020-06").groupBy("upload_date").agg(row_count().alias("n"))


@query("run_directory", """
SELECT type, CAST(scenario AS VARCHAR) AS run, count(*) AS n, round(sum(value), 4) AS total
FROM uncertainty GROUP BY ALL""", ["uncertainty"])
def run_directory(spark, folder):
    """A tree of run files as one table; type and run are taken from the file's path."""
    path = scratch_path(spark, "runs")
    rows = uncertainty(spark, folder).select("type", F.col("scenario").alias("run"), "times", "quantile", "value")
    write_by(rows, path, ["run", "type"])
    read = read_table(spark, f"{path}/*/*/*.csv", "times int, quantile double, value double")
    tagged = read.select(
        path_part(r"/type=([^/]+)/").alias("type"), path_part(r"/run=([^/]+)/").alias("run"),
        file_part(r"^(part)-").alias("kind"), "value",
    )
    out = tagged.where(F.col("kind") == "part").groupBy("type", "run").agg(
        row_count().alias("n"), F.sum("value").alias("total")
    )
    return rounded(out, "total", digits=4)


@query("run_files", """
SELECT count(*) AS rows, 'part' AS stem FROM uncertainty""", ["uncertainty"])
def run_files(spark, folder):
    """A folder of run files; the file name gives the run."""
    path = scratch_path(spark, "files")
    write_table(uncertainty(spark, folder).select("times", "quantile", "value"), path)
    rows = read_runs(spark, path, "times int, quantile double, value double")
    return rows.groupBy(F.substring("run_date", 1, 4).alias("stem")).agg(row_count().alias("rows"))


@query("newest_files", """
SELECT type, count(*) AS n, round(max(value), 6) AS top FROM uncertainty WHERE type <> 'accum_deaths' GROUP BY ALL""",
       ["uncertainty"])
def newest(spark, folder):
    """One file per type written after the other; the four that changed last are read."""
    path = scratch_path(spark, "newest")
    rows = materialize(uncertainty(spark, folder).select("type", "times", "value"), "types")
    for kind in views.MODEL_TYPES:
        # Rows of regions, scenarios and days fit one file.
        rows.where(F.col("type") == kind).coalesce(1).write.parquet(f"{path}/{kind}")
    read = spark.read.schema(rows.schema).parquet(*newest_paths(spark, f"{path}/*/*.parquet", 4))
    return rounded(read.groupBy("type").agg(row_count().alias("n"), F.max("value").alias("top")), "top")


def stored_draws(spark, folder):
    """The posterior draws as they lie in the model's tables, by region."""
    path = scratch_path(spark, "draws")
    views.draws_raw(spark, folder).write.partitionBy("region").parquet(f"{path}/draws")
    rows = read_model_table(spark, path, "draws")
    names = [field.split()[0] for field in schemas.MODEL_DRAWS.split(", ")]
    return scenarios.model_table(rows.select("region", *names))


@query("stored_parameter_table", TWINS["parameter_table"])
def stored_parameter_table(spark, folder):
    out = posterior.parameter_table(stored_draws(spark, folder), "Philippines")
    return rounded(out, "q025", "q50", "q975", digits=9)


@query("stored_prior_and_posterior", TWINS["prior_and_posterior"])
def stored_prior_and_posterior(spark, folder):
    both = posterior.prior_and_posterior(stored_draws(spark, folder), "Philippines", reports.SEED)
    out = both.groupBy("label", "position", "type", "type_position").agg(
        row_count().alias("n"), F.min("value").alias("least"), F.max("value").alias("most")
    )
    return rounded(out, "least", "most")


@query("stored_detection_band", TWINS["detection_rate_band"])
def stored_detection_band(spark, folder):
    sampled = testing.detection_draws(stored_draws(spark, folder), reports.SEED)
    return rounded(testing.detection_band(sampled, reports.per_capita(spark, folder)), *reports.Q)


@query("model_tables", """
SELECT region, type, count(*) AS n, round(max(value), 6) AS top FROM uncertainty
WHERE region IN ('Philippines', 'Calabarzon') GROUP BY ALL""", ["uncertainty"])
def model_tables(spark, folder):
    """Model output stored by region; only the folders of the wanted regions are read."""
    path = scratch_path(spark, "model")
    views.uncertainty_raw(spark, folder).write.partitionBy("region").parquet(f"{path}/uncertainty")
    rows = read_model_table(spark, path, "uncertainty", ["covid_19-philippines", "covid_19-calabarzon"])
    named = scenarios.model_table(rows)
    return rounded(named.groupBy("region", "type").agg(row_count().alias("n"), F.max("value").alias("top")), "top")


@query("calibration_files", f"""
WITH {reports.WEEKLY}
SELECT region, t AS times, CAST(max(n) FILTER (series = 'notifications') AS DOUBLE) AS local_data_notifications,
  CAST(max(n) FILTER (series = 'icu') AS DOUBLE) AS local_data_icu,
  CAST(max(n) FILTER (series = 'deaths') AS DOUBLE) AS local_data_deaths
FROM k GROUP BY ALL""", ["line_list", "hospital"])
def calibration_files(spark, folder):
    """Text files per region and series, read in one go, cleaned and set side by side."""
    path = scratch_path(spark, "long")
    text = calibration.long_text(reports.weekly_targets(spark, folder), ["series", "region"])
    write_by(text.drop("day"), path, ["series", "region"])
    return validation.calibration_wide(read_calibration_files(spark, path))


@query("wide_text_files", f"""
WITH k AS (SELECT region, {reports.DAY.format("died")} AS t, count(*) AS n FROM line_list
  WHERE died IS NOT NULL AND region IN ('NCR', '4A', '5', '7') GROUP BY ALL)
SELECT region, {reports.WIDE_TIMES} AS value FROM k GROUP BY ALL
UNION ALL SELECT region, {reports.WIDE_VALUES} FROM k GROUP BY ALL""", ["line_list"])
def wide_text_files(spark, folder):
    """Two lines per region: times, then values."""
    path = scratch_path(spark, "wide")
    cases = views.line_list(spark, folder).where(F.col("region").isin(reports.CASE_REGIONS))
    daily = daily_counts(cases, ["region"], {"deaths": "died"})
    series = daily.select("region", day_offset("date", views.ORDERS_EPOCH).alias("times"), "values")
    write_wide_text(ordered_text(series, ["region"]), path, ["region"])
    return spark.read.schema("value string, region string").text(path).select("region", "value")


@query("run_archive", """
SELECT model_run_date, scenario, count(*) AS n, count(local_data_notifications) AS reported,
  round(max(notifications_q50), 6) AS top
FROM archived_runs GROUP BY ALL""", ["archived_runs"])
def run_archive(spark, folder):
    """Runs added one after the other, one of them twice; the archive keeps each once."""
    path = scratch_path(spark, "archive")
    runs = views.archived_runs(spark, folder)
    append_run(runs.where(F.col("model_run_date") < F.lit(views.RUN_DATES[2])), path)
    append_run(runs.where(F.col("model_run_date") > F.lit(views.RUN_DATES[0])), path)
    out = read_archive(spark, path).groupBy("model_run_date", "scenario").agg(
        row_count().alias("n"), F.count("local_data_notifications").alias("reported"),
        F.max("notifications_q50").alias("top"),
    )
    return rounded(out, "top")


def two_drops(spark, folder):
    """An older drop, with rows missing, altered, later taken away and repeated, and the one after it."""
    new = views.line_list(spark, folder)
    old = new.where("case_id % 11 <> 0").withColumn("report", F.expr("if(case_id % 13 = 0, report + 2, report)"))
    gone = new.where("case_id % 17 = 0").withColumn("case_id", F.expr("-case_id - 1"))
    return old.unionByName(gone).unionByName(new.where("case_id % 19 = 0")), new


OLD_DROP = """old AS (
  SELECT * REPLACE (CASE WHEN case_id % 13 = 0 THEN report + 2 ELSE report END AS report) FROM line_list WHERE case_id % 11 <> 0
  UNION ALL SELECT * REPLACE (-case_id - 1 AS case_id) FROM line_list WHERE case_id % 17 = 0
  UNION ALL SELECT * FROM line_list WHERE case_id % 19 = 0)"""


@query("drop_changes", f"""
WITH {OLD_DROP}, signed AS (SELECT *, 1 AS n FROM line_list UNION ALL SELECT *, -1 FROM old)
SELECT * EXCLUDE n, CAST(sum(n) AS BIGINT) AS change FROM signed GROUP BY ALL HAVING sum(n) <> 0""", ["line_list"])
def drop_changes(spark, folder):
    """Rows by which a drop differs from the one before it."""
    return changes(*two_drops(spark, folder))


@query("counts_after_drop", """
SELECT 'cases' AS series, region, report AS date, count(*) AS values FROM line_list WHERE report IS NOT NULL GROUP BY ALL
UNION ALL SELECT 'deaths', region, died, count(*) FROM line_list WHERE died IS NOT NULL GROUP BY ALL""", ["line_list"])
def counts_after_drop(spark, folder):
    """Counts of the older drop brought up to date by the changes; equal to counting the new drop."""
    old, new = two_drops(spark, folder)
    dates = {"cases": "report", "deaths": "died"}
    stored = materialize(daily_counts(old, ["region"], dates), "counts")
    delta = daily_changes(changes(old, new), ["region"], dates)
    return merged_counts(stored, delta)
