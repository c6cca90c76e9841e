"""The reports, end to end."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from ..functions import normal
from ..functions.bands import AGE_LEVELS, BAND_STARTS
from ..functions.labels import HOSPITAL_REGIONS, HOSPITAL_REGIONS_SHORT, INDICATOR_LABELS, recode
from ..operators.aggregates import ordered_text
from ..operators.filters import in_regions
from ..operators.joins import merge_series
from ..plans import ages, calibration, posterior, scenarios, structure, testing, validation
from ..session import materialize, scratch_path
from ..sources import schemas
from ..sources.readers import read_archive, read_columns
from ..sources.versions import append_version, compacted
from ..sources.writers import append_run, write_table
from . import views
from .column_queries import AGE_BAND_SQL
from .operator_queries import reported, uncertainty
from .registry import query, rounded

EPOCH = views.ORDERS_EPOCH
UNTIL = views.ORDERS_UNTIL
CASE_REGIONS = ["NCR", "4A", "5", "7"]
SHORT_REGIONS = ["manila", "calabarzon", "central-visayas"]
AREAS = ["Philippines", "Calabarzon", "Central Visayas", "National Capital Region"]
Q = ["q025", "q25", "q50", "q75", "q975"]
SEED = 7

DAY = "CAST({} - DATE '1994-12-31' AS INTEGER)"
WIDE_TIMES = "string_agg(CAST(t AS VARCHAR), ', ' ORDER BY t)"
WIDE_VALUES = "string_agg('[' || n || ']', ',' ORDER BY t)"
PLAIN_VALUES = "string_agg(CAST(n AS VARCHAR), ', ' ORDER BY t)"


def short_names(hospital):
    return hospital.withColumn("region", recode("region", HOSPITAL_REGIONS_SHORT))


def case_names(cases):
    return cases.withColumn("region", recode("region", {"NCR": "manila", "4A": "calabarzon", "07": "central-visayas"}))


CASES_SHORT = """SELECT * REPLACE (CASE region WHEN 'NCR' THEN 'manila' WHEN '4A' THEN 'calabarzon'
  WHEN '07' THEN 'central-visayas' ELSE region END AS region) FROM line_list"""
HOSPITAL_SHORT = """SELECT * REPLACE (CASE region WHEN 'NATIONAL CAPITAL REGION (NCR)' THEN 'manila'
  WHEN 'REGION IV-A (CALABAR ZON)' THEN 'calabarzon' WHEN 'REGION VII (CENTRAL VISAYAS)' THEN 'central-visayas'
  ELSE region END AS region) FROM hospital"""
SHORT_LIST = "('philippines', 'manila', 'calabarzon', 'central-visayas')"

# Calibration targets


@query("daily_onset_and_death_text", f"""
SELECT series, {WIDE_TIMES} AS times_wide, {PLAIN_VALUES} AS values_plain, {WIDE_VALUES} AS values_wide
FROM (SELECT 'notifications' AS series, {DAY.format("onset")} AS t, count(*) AS n FROM line_list GROUP BY ALL
  UNION ALL SELECT 'deaths', {DAY.format("died")}, count(*) FROM line_list GROUP BY ALL)
WHERE t > 40 GROUP BY ALL""", ["line_list"])
def daily_onset_and_death_text(spark, folder):
    return calibration.daily_text(
        views.line_list(spark, folder), {"notifications": "onset", "deaths": "died"}, EPOCH
    )


@query("confirmed_daily", f"""
SELECT {DAY.format("report")} AS times, count(*) AS values FROM line_list WHERE report IS NOT NULL GROUP BY ALL""",
       ["line_list"])
def confirmed_daily(spark, folder):
    return calibration.confirmed_daily(views.line_list(spark, folder), "report", EPOCH)


@query("regional_onset_and_death_text", f"""
SELECT series, region, {WIDE_TIMES} AS times_wide, {PLAIN_VALUES} AS values_plain, {WIDE_VALUES} AS values_wide
FROM (SELECT 'notifications' AS series, region, {DAY.format("onset")} AS t, count(*) AS n FROM line_list GROUP BY ALL
  UNION ALL SELECT 'deaths', region, {DAY.format("died")}, count(*) FROM line_list GROUP BY ALL)
WHERE t IS NOT NULL AND region IN ('NCR', '4A', '5', '7') GROUP BY ALL""", ["line_list"])
def regional_onset_and_death_text(spark, folder):
    return calibration.regional_daily_text(
        views.line_list(spark, folder), {"notifications": "onset", "deaths": "died"}, CASE_REGIONS, EPOCH
    )


ICU_DAYS = """SELECT {keys}reportdate AS date, CAST(CASE WHEN count(*) = count(icu_o) THEN sum(icu_o) END AS BIGINT) AS n
  FROM hospital WHERE reportdate IS NOT NULL{where} GROUP BY ALL"""
HOSPITAL_LIST = ", ".join(f"'{r}'" for r in HOSPITAL_REGIONS)
HOSPITAL_CASE = "CASE region " + " ".join(f"WHEN '{a}' THEN '{b}'" for a, b in HOSPITAL_REGIONS.items()) + " END"


@query("icu_text", f"""
SELECT 'icu' AS series, {WIDE_TIMES} AS times_wide, {PLAIN_VALUES} AS values_plain, {WIDE_VALUES} AS values_wide
FROM (SELECT {DAY.format("date")} AS t, n FROM ({ICU_DAYS.format(keys="", where="")})) WHERE n IS NOT NULL""",
       ["hospital"])
def icu_text(spark, folder):
    return calibration.icu_text(views.hospital(spark, folder), EPOCH)


@query("icu_national", f"""
WITH d AS (SELECT {DAY.format("date")} AS t, n FROM ({ICU_DAYS.format(keys="", where="")})
  WHERE n IS NOT NULL AND {DAY.format("date")} > 40),
w AS (SELECT max(length(CAST(t AS VARCHAR))) AS tw, max(length(CAST(n AS VARCHAR))) AS vw,
  {WIDE_TIMES} AS times_wide, {WIDE_VALUES} AS values_wide FROM d)
SELECT 'icu' AS series, t AS day, '     ' || lpad(CAST(t AS VARCHAR), CAST(tw AS INTEGER), ' ') || ',' AS times,
  '     ' || lpad(CAST(n AS VARCHAR), CAST(vw AS INTEGER), ' ') || ',' AS values,
  '     [' || lpad(CAST(n AS VARCHAR), CAST(vw AS INTEGER), ' ') || '],' AS values_bracketed, times_wide, values_wide
FROM d, w""", ["hospital"])
def icu_national(spark, folder):
    return calibration.icu_national(calibration.icu_daily(views.hospital(spark, folder)), EPOCH)


ICU_REGIONAL = f"""
WITH d AS (SELECT {HOSPITAL_CASE} AS region, {DAY.format("date")} AS t, n
  FROM ({ICU_DAYS.format(keys="region, ", where=f" AND region IN ({HOSPITAL_LIST})")}) WHERE n IS NOT NULL),
w AS (SELECT max(length(CAST(t AS VARCHAR))) AS tw, max(length(CAST(n AS VARCHAR))) AS vw FROM d),
s AS (SELECT region, {WIDE_TIMES} AS times_wide, {WIDE_VALUES} AS values_wide FROM d GROUP BY ALL)
SELECT d.region, t AS day, '{{indent}}' || lpad(CAST(t AS VARCHAR), CAST(tw AS INTEGER), ' ') || ',' AS times,
  '     ' || lpad(CAST(n AS VARCHAR), CAST(vw AS INTEGER), ' ') || ',' AS values,
  '     [' || lpad(CAST(n AS VARCHAR), CAST(vw AS INTEGER), ' ') || '],' AS values_bracketed{{more}}
FROM d, w, s WHERE d.region = s.region"""


@query("icu_regional", ICU_REGIONAL.format(indent="    ", more=""), ["hospital"])
def icu_regional(spark, folder):
    daily = calibration.icu_daily(views.hospital(spark, folder), ["region"], list(HOSPITAL_REGIONS))
    out = calibration.icu_regional(daily, EPOCH)
    return out.withColumn("region", recode("region", HOSPITAL_REGIONS))


@query("icu_regional_wide", ICU_REGIONAL.format(indent="     ", more=", times_wide, values_wide"), ["hospital"])
def icu_regional_wide(spark, folder):
    daily = calibration.icu_daily(views.hospital(spark, folder), ["region"], list(HOSPITAL_REGIONS))
    out = calibration.icu_regional_wide(daily, EPOCH)
    return out.withColumn("region", recode("region", HOSPITAL_REGIONS))


IMPUTED = f"""i AS (SELECT *, coalesce(admitted, report - lag) AS adjusted FROM (
  SELECT *, CAST(round_even(avg(CAST(report - admitted AS DOUBLE)) OVER (PARTITION BY region), 0) AS INTEGER) AS lag
  FROM line_list)),
d AS (SELECT 'deaths' AS series, region, {DAY.format("died")} AS t, count(*) AS n FROM i GROUP BY ALL
  UNION ALL SELECT 'notifications', region, {DAY.format("adjusted")}, count(*) FROM i GROUP BY ALL)"""


@query("imputed_regional", f"""
WITH {IMPUTED},
k AS (SELECT * FROM d WHERE t > 40 AND region IN ('NCR', '4A', '5', '7'))
SELECT k.series, k.region, t AS day, t || ',' AS times, n || ',' AS values, times_wide, values_wide
FROM k JOIN (SELECT series, region, {WIDE_TIMES} AS times_wide, {WIDE_VALUES} AS values_wide FROM k GROUP BY ALL) w
  ON k.series = w.series AND k.region = w.region""", ["line_list"])
def imputed_regional(spark, folder):
    cases = views.line_list(spark, folder).where(in_regions(CASE_REGIONS))
    return calibration.imputed_regional(calibration.imputed_daily(cases), EPOCH)


@query("imputed_national", f"""
WITH {IMPUTED},
k AS (SELECT series, t, CAST(sum(n) AS BIGINT) AS n FROM d WHERE t > 40 GROUP BY ALL),
w AS (SELECT series, max(length(CAST(t AS VARCHAR))) AS tw, max(length(CAST(n AS VARCHAR))) AS vw,
  {WIDE_TIMES} AS times_wide, {WIDE_VALUES} AS values_wide FROM k GROUP BY ALL)
SELECT k.series, t AS day, '     ' || lpad(CAST(t AS VARCHAR), CAST(tw AS INTEGER), ' ') || ',' AS times,
  '     ' || lpad(CAST(n AS VARCHAR), CAST(vw AS INTEGER), ' ') || ',' AS values,
  '     [' || lpad(CAST(n AS VARCHAR), CAST(vw AS INTEGER), ' ') || '],' AS values_bracketed, times_wide, values_wide
FROM k JOIN w USING (series)""", ["line_list"])
def imputed_national(spark, folder):
    return calibration.imputed_national(calibration.imputed_daily(views.line_list(spark, folder)), EPOCH)


WEEKLY = f"""c AS ({CASES_SHORT}),
h AS ({HOSPITAL_SHORT}),
d AS (SELECT 'notifications' AS series, region, admitted AS date, count(*) AS n FROM c GROUP BY ALL
  UNION ALL SELECT 'deaths', region, died, count(*) FROM c GROUP BY ALL
  UNION ALL SELECT 'icu', region, reportdate, coalesce(sum(icu_o), 0) FROM h GROUP BY ALL),
b AS (SELECT * FROM d UNION ALL SELECT series, 'philippines', date, sum(n) FROM d GROUP BY ALL),
m AS (SELECT series, region, {DAY.format("max(date)")} AS t, round_even(avg(n), 0) AS v FROM b
  WHERE date <= DATE '{UNTIL}' AND region IN {SHORT_LIST} GROUP BY series, region, date_trunc('week', date)),
k AS (SELECT series, region, t, CAST(v AS BIGINT) AS n FROM (
  SELECT *, max(t) OVER (PARTITION BY series, region) AS last FROM m) WHERE t > 40 AND t < last)"""


@query("weekly_targets", f"""
WITH {WEEKLY} SELECT series, region, t AS times, CAST(n AS DOUBLE) AS values FROM k""", ["line_list", "hospital"])
def weekly_targets(spark, folder):
    return calibration.weekly_targets(
        case_names(views.line_list(spark, folder)), short_names(views.hospital(spark, folder)),
        SHORT_REGIONS, views.NATIONAL, UNTIL, EPOCH,
    )


@query("weekly_text_wide", f"""
WITH {WEEKLY} SELECT series, region, {WIDE_TIMES} AS times_wide, {WIDE_VALUES} AS values_wide FROM k GROUP BY ALL""",
       ["line_list", "hospital"])
def weekly_text_wide(spark, folder):
    return ordered_text(weekly_targets(spark, folder), ["series", "region"]).drop("values_plain")


@query("calibration_text_long", f"""
WITH {WEEKLY} SELECT series, region, t AS day, t || ',' AS times, n || ',' AS values FROM k""",
       ["line_list", "hospital"])
def calibration_text_long(spark, folder):
    return calibration.long_text(weekly_targets(spark, folder), ["series", "region"])


ROLLING = f"""c AS ({CASES_SHORT}),
d AS (SELECT region, admitted AS date, count(*) AS n FROM c WHERE admitted <= DATE '{UNTIL}' GROUP BY ALL),
b AS (SELECT region, date, n FROM d WHERE region IN {SHORT_LIST}
  UNION ALL SELECT 'philippines', date, CAST(sum(n) AS BIGINT) FROM d GROUP BY ALL),
g AS (SELECT region, CAST(unnest(generate_series(min(date), max(date), INTERVAL 1 DAY)) AS DATE) AS date
  FROM b GROUP BY region),
f AS (SELECT g.region, g.date, b.n FROM g LEFT JOIN b ON g.region = b.region AND g.date = b.date),
r AS (SELECT region, date, CASE WHEN count(*) OVER w = 7 THEN round_even(avg(n) OVER w, 0) END AS values,
  {DAY.format("date")} AS times, max({DAY.format("date")}) OVER (PARTITION BY region) AS last
  FROM f WINDOW w AS (PARTITION BY region ORDER BY date ROWS BETWEEN CURRENT ROW AND 6 FOLLOWING))"""


@query("rolling_notifications", f"""
WITH {ROLLING} SELECT region, date, times, values FROM r
WHERE values IS NOT NULL AND times > 60 AND times < last - 9""", ["line_list"])
def rolling_notifications(spark, folder):
    cases = case_names(views.line_list(spark, folder))
    daily = calibration.case_days(cases, UNTIL, {"notifications": "admitted"})
    return calibration.rolling_notifications(daily, SHORT_REGIONS, views.NATIONAL, EPOCH)


@query("cumulative_deaths", f"""
WITH c AS ({CASES_SHORT}),
b AS (SELECT region, died FROM c UNION ALL SELECT 'philippines', died FROM c)
SELECT region, count(*) AS values, max(died) AS date, {DAY.format("max(died)")} AS times FROM b
WHERE died <= DATE '{UNTIL}' AND region IN {SHORT_LIST} GROUP BY region""", ["line_list"])
def cumulative_deaths(spark, folder):
    daily = calibration.case_days(case_names(views.line_list(spark, folder)), UNTIL, {"deaths": "died"})
    return calibration.cumulative_deaths(daily, SHORT_REGIONS, views.NATIONAL, EPOCH)


ICU_BY_DAY = f"""h AS ({HOSPITAL_SHORT}),
b AS (SELECT region, reportdate, icu_o FROM h UNION ALL SELECT 'philippines', reportdate, icu_o FROM h),
d AS (SELECT region, reportdate AS date, CAST(coalesce(sum(icu_o), 0) AS BIGINT) AS values,
  {DAY.format("reportdate")} AS times FROM b
  WHERE reportdate <= DATE '{UNTIL}' AND region IN {SHORT_LIST} GROUP BY ALL)"""


@query("icu_by_day", f"WITH {ICU_BY_DAY} SELECT * FROM d", ["hospital"])
def icu_by_day(spark, folder):
    return calibration.icu_by_day(
        short_names(views.hospital(spark, folder)), SHORT_REGIONS, views.NATIONAL, UNTIL, EPOCH
    )


@query("latest_icu", f"""
WITH {ICU_BY_DAY} SELECT * EXCLUDE (last) FROM (SELECT *, max(date) OVER (PARTITION BY region) AS last FROM d)
WHERE date = last""", ["hospital"])
def latest_icu(spark, folder):
    return calibration.latest_icu(
        short_names(views.hospital(spark, folder)), SHORT_REGIONS, views.NATIONAL, UNTIL, EPOCH
    )


# Model runs against reported data

SNAPSHOT_COLUMNS = [f"{t}_{n}" for t in views.OUTPUTS.values() for n in ("q25", "q50", "q75")]
LOCAL = [f"local_data_{m}" for m in views.OUTPUTS]


@query("run_snapshot", f"""
SELECT u.region, u.scenario, u.times, {", ".join(
    f"round(max(CASE WHEN u.type = '{t}' AND quantile = {q} THEN u.value END), 6) AS {t}_{n}"
    for t in views.OUTPUTS.values() for q, n in ((0.25, "q25"), (0.5, "q50"), (0.75, "q75")))},
  {", ".join(f"max(CASE WHEN r.type = '{t}' THEN r.value END) AS local_data_{m}" for m, t in views.OUTPUTS.items())},
  'calibration' AS data_type, DATE '2024-01-22' AS model_run_date, DATE '2024-01-22' AS data_acquired_date, u.date
FROM uncertainty u LEFT JOIN reported r ON u.region = r.region AND u.times = r.times
WHERE u.type IN ('notifications', 'icu_occupancy', 'accum_deaths') AND quantile IN (0.25, 0.5, 0.75)
GROUP BY u.region, u.scenario, u.times, u.date""", ["uncertainty", "reported"])
def run_snapshot(spark, folder):
    names = {o: f"local_data_{m}" for m, o in views.OUTPUTS.items()}
    local = merge_series(reported(spark, folder), ["region", "times"], "type", "value", names)
    out = validation.run_snapshot(
        uncertainty(spark, folder), local, views.RUN_DATES[-1], list(views.OUTPUTS.values())
    )
    return rounded(out, *SNAPSHOT_COLUMNS)


def archive(spark, folder):
    """The runs as they lie in the archive, one folder per run date."""
    path = scratch_path(spark, "archive")
    append_run(views.archived_runs(spark, folder), path)
    return read_archive(spark, path)


BACKFILL = f"""cut AS (SELECT model_run_date, arg_max(date, {{'region': region, 'times': times}}) AS cutoff
  FROM archived_runs WHERE local_data_notifications IS NOT NULL GROUP BY ALL),
stale AS (SELECT a.* REPLACE (CASE WHEN a.model_run_date < DATE '2024-01-22' AND a.date >= cutoff
    THEN DATE '2024-01-22' ELSE data_acquired_date END AS data_acquired_date)
  FROM archived_runs a LEFT JOIN cut USING (model_run_date)),
older AS (SELECT DISTINCT model_run_date FROM archived_runs WHERE model_run_date < DATE '2024-01-22'),
newest AS (SELECT o.model_run_date, region, date, scenario, {", ".join(f"{c} AS new_{c}" for c in LOCAL)}
  FROM archived_runs a, older o WHERE a.model_run_date = DATE '2024-01-22'),
filled AS (SELECT * EXCLUDE ({", ".join(LOCAL)}, {", ".join(f"new_{c}" for c in LOCAL)}), {", ".join(
    f"CASE WHEN {c} IS NULL AND data_acquired_date = DATE '2024-01-22' AND model_run_date < DATE '2024-01-22' "
    f"THEN new_{c} ELSE {c} END AS {c}" for c in LOCAL)}
  FROM stale FULL JOIN newest USING (model_run_date, region, date, scenario))"""


@query("run_backfill", f"""
WITH {BACKFILL} SELECT model_run_date, data_acquired_date, region, date, times, scenario, {", ".join(LOCAL)},
  round(notifications_q50, 6) AS notifications_q50 FROM filled""", ["archived_runs"])
def run_backfill(spark, folder):
    out = validation.backfill_runs(archive(spark, folder))
    return rounded(out, "notifications_q50").select(
        "model_run_date", "data_acquired_date", "region", "date", "times", "scenario", *LOCAL, "notifications_q50"
    )


@query("run_backfill_by_region", f"""
WITH {BACKFILL.replace("SELECT model_run_date, arg_max(date, {'region': region, 'times': times}) AS cutoff",
                       "SELECT model_run_date, region, arg_max(date, times) AS cutoff")
      .replace("LEFT JOIN cut USING (model_run_date)", "LEFT JOIN cut USING (model_run_date, region)")}
SELECT model_run_date, data_acquired_date, region, date, times, scenario, {", ".join(LOCAL)} FROM filled""",
       ["archived_runs"])
def run_backfill_by_region(spark, folder):
    """The cut-off taken in each region by itself."""
    return validation.backfill_runs(archive(spark, folder), per_region=True).select(
        "model_run_date", "data_acquired_date", "region", "date", "times", "scenario", *LOCAL
    )


CELL_KEYS = ["region", "scenario", "times", "date"]
CELLS = [*LOCAL, *[f"{t}_{n}" for t in views.OUTPUTS.values() for n in ("q25", "q50", "q75")]]


def versions(spark, folder):
    """Three runs stored one after the other by what they change, the second one twice."""
    path = scratch_path(spark, "versions")
    runs = materialize(views.archived_runs(spark, folder), "runs")
    first, second, third = views.RUN_DATES
    for date, rows in ((first, runs), (second, runs.where("times % 2 = 0")), (second, runs), (third, runs)):
        append_version(rows.where(F.col("model_run_date") == F.lit(date)), path, date, CELL_KEYS, CELLS)
    return path


@query("versioned_backfill", f"""
WITH {BACKFILL} SELECT model_run_date, data_acquired_date, region, date, times, scenario, {", ".join(LOCAL)},
  round(notifications_q50, 6) AS notifications_q50 FROM filled""", ["archived_runs"])
def versioned_backfill(spark, folder):
    """The back-fill from an archive of changed cells equals the one from full copies."""
    runs = validation.read_run_versions(spark, versions(spark, folder), CELL_KEYS, CELLS)
    return rounded(validation.backfill_runs(runs), "notifications_q50").select(
        "model_run_date", "data_acquired_date", "region", "date", "times", "scenario", *LOCAL, "notifications_q50"
    )


@query("stored_versions", f"""
WITH cells AS (SELECT model_run_date AS run, region, scenario, times, date, unnest({CELLS}) AS cell,
    unnest([{", ".join(f"CAST({c} AS DOUBLE)" for c in CELLS)}]) AS value FROM archived_runs)
SELECT n.run AS run_date, count(*) AS cells,
  count(*) FILTER (o.cell IS NULL OR n.value IS DISTINCT FROM o.value) AS stored
FROM cells n LEFT JOIN cells o ON o.run = n.run - 7 AND n.region = o.region AND n.scenario = o.scenario
  AND n.times = o.times AND n.date = o.date AND n.cell = o.cell
GROUP BY n.run""", ["archived_runs"])
def stored_versions(spark, folder):
    """Cells stored per run against those a full copy would hold."""
    return compacted(spark, versions(spark, folder), CELL_KEYS, CELLS)


SPLIT = f"""{BACKFILL},
long AS ({" UNION ALL ".join(
    f"SELECT model_run_date, data_acquired_date, region, scenario, times, date, '{m}' AS metric, "
    f"local_data_{m} AS reported, {o}_q25 AS q25, {o}_q50 AS q50, {o}_q75 AS q75 FROM filled"
    for m, o in views.OUTPUTS.items())}),
kept AS (SELECT * FROM long WHERE scenario = 'S_0' AND date <= model_run_date + 49),
split AS (SELECT *, CASE WHEN model_run_date = DATE '2024-01-22'
    THEN CASE WHEN date <= last THEN 'calibrated' WHEN date > last THEN 'uncalibrated' END
    WHEN model_run_date = data_acquired_date THEN 'calibrated'
    WHEN model_run_date <> data_acquired_date THEN 'uncalibrated' END AS model
  FROM (SELECT *, max(CASE WHEN reported IS NOT NULL THEN date END)
    OVER (PARTITION BY model_run_date, region, metric) AS last FROM kept))"""


def split(spark, folder):
    runs = archive(spark, folder)
    return validation.calibrated_split(
        validation.backfill_runs(runs, scenario="S_0"), "S_0", validation.latest_run(runs), views.OUTPUTS
    )


@query("calibrated_split", f"""
WITH {SPLIT} SELECT model_run_date, region, metric, date, reported, round(q50, 6) AS q50, model FROM split""",
       ["archived_runs"])
def calibrated_split(spark, folder):
    out = split(spark, folder).select("model_run_date", "region", "metric", "date", "reported", "q50", "model")
    return rounded(out, "q50")


@query("fit_adjusted_r2", f"""
WITH {SPLIT} SELECT model_run_date, region, metric, CASE WHEN regr_count(reported, q50) > 2 THEN
  round(1 - (1 - regr_r2(reported, q50)) * (regr_count(reported, q50) - 1) / (regr_count(reported, q50) - 2), 6)
  END AS adj_r2 FROM split GROUP BY ALL""", ["archived_runs"])
def fit_adjusted_r2(spark, folder):
    return rounded(validation.fit(split(spark, folder)), "adj_r2")


@query("fit_r2_by_week", f"""
WITH {SPLIT} SELECT model_run_date, region, metric,
  greatest(round_even(CAST(date - model_run_date AS DOUBLE) / 7.0, 0) + 0.0, 0.0) AS week,
  round(regr_r2(reported, q50), 6) AS r2 FROM split GROUP BY ALL""", ["archived_runs"])
def fit_r2_by_week(spark, folder):
    return rounded(validation.fit_by_week(split(spark, folder)), "r2")


@query("panel_limits", f"""
WITH {SPLIT} SELECT model_run_date, region, metric, round(max(q75) + 100, 6) AS y_max, max(date) AS x_max
FROM split GROUP BY ALL""", ["archived_runs"])
def panel_limits(spark, folder):
    return rounded(validation.plot_limits(split(spark, folder)), "y_max")


# Population and mobility

LONG_AGES = ", ".join([f'"{b}"' for b in AGE_LEVELS])
POSITIONS = " ".join(f"WHEN '{b}' THEN {i}" for i, b in enumerate(AGE_LEVELS, start=1))
SHOWN = ", ".join(f"'{a}'" for a in AREAS)


@query("age_structure", f"""
SELECT area, age_group, CASE age_group {POSITIONS} END AS position, round(population / 1000.0, 6) AS millions
FROM (SELECT area, {", ".join(f'"{b}"' for b in AGE_LEVELS[:-1])},
    "75-79" + "80-84" + "85-89" + "90-94" + "95-99" + "100+" AS "75+"
  FROM population WHERE reference_year = 2020 AND area IN ({SHOWN}))
  UNPIVOT INCLUDE NULLS (population FOR age_group IN ({LONG_AGES}))""", ["population"])
def age_structure(spark, folder):
    out = structure.age_structure(views.population(spark, folder), AREAS, views.POPULATION_YEAR)
    return rounded(out, "millions")


@query("age_structure_from_file", f"""
SELECT area, age_group, CASE age_group {POSITIONS} END AS position, round(population / 1000.0, 6) AS millions
FROM (SELECT area, {", ".join(f'"{b}"' for b in AGE_LEVELS[:-1] if b != "5-9")},
    "75-79" + "80-84" + "85-89" + "90-94" + "95-99" + "100+" AS "75+"
  FROM population WHERE reference_year = 2020 AND area IN ({SHOWN}))
  UNPIVOT INCLUDE NULLS (population FOR age_group IN ({", ".join(f'"{b}"' for b in AGE_LEVELS if b != "5-9")}))""",
       ["population"])
def age_structure_from_file(spark, folder):
    """The population sheet exported to text, read by column name; one band left out."""
    path = scratch_path(spark, "population")
    write_table(views.population(spark, folder).withColumn("notes", F.lit("x")), path)
    sheet = read_columns(spark, path, schemas.POPULATION)
    out = structure.age_structure(sheet, AREAS, views.POPULATION_YEAR, leave_out=["5-9"])
    return rounded(out, "millions")


@query("mobility_index", """
SELECT coalesce(sub_region_1, 'Philippines') AS area, metro_area, date,
  CASE location WHEN 'work' THEN 'Work' WHEN 'home' THEN 'Home' ELSE 'Other locations' END AS location,
  CASE location WHEN 'home' THEN 1 WHEN 'work' THEN 2 ELSE 3 END AS position, round((v + 100) / 100.0, 6) AS mobility
FROM (SELECT sub_region_1, metro_area, date, workplaces_percent_change_from_baseline AS work,
    residential_percent_change_from_baseline AS home,
    (retail_and_recreation_percent_change_from_baseline + grocery_and_pharmacy_percent_change_from_baseline
     + parks_percent_change_from_baseline + transit_stations_percent_change_from_baseline) / 4.0 AS other
  FROM mobility WHERE country_region = 'Philippines'
    AND (sub_region_1 IS NOT NULL OR coalesce(metro_area, '') = ''))
  UNPIVOT INCLUDE NULLS (v FOR location IN (work, home, other))""",
       ["mobility"])
def mobility_index(spark, folder):
    out = structure.mobility_index(views.mobility(spark, folder), "Philippines", AREAS[1:])
    return rounded(out, "mobility")


# Model bands

BANDS = ", ".join(
    f"round(max(CASE WHEN quantile = {q} THEN value END), 6) AS {n}" for q, n in zip((0.025, 0.25, 0.5, 0.75, 0.975), Q)
)
REPORTED_NOTIFICATIONS = "(SELECT region, times, value AS reported FROM reported WHERE type = 'notifications')"


def notifications(spark, folder):
    return reported(spark, folder).where(F.col("type") == "notifications")


@query("band_vs_reported", f"""
SELECT b.*, r.reported FROM (SELECT region, scenario, type, times, date, {BANDS} FROM uncertainty
  WHERE scenario IN (0, 1) AND type = 'notifications' GROUP BY ALL) b
LEFT JOIN {REPORTED_NOTIFICATIONS} r ON b.region = r.region AND b.times = r.times""", ["uncertainty", "reported"])
def band_vs_reported(spark, folder):
    out = scenarios.bands_vs_reported(uncertainty(spark, folder), notifications(spark, folder), [0, 1])
    return rounded(out, *Q)


@query("regional_band_vs_reported", f"""
SELECT b.*, r.reported FROM (SELECT region, scenario, type, times, date, {BANDS} FROM uncertainty
  WHERE scenario = 0 AND type = 'notifications' AND region <> 'Philippines' GROUP BY ALL) b
LEFT JOIN {REPORTED_NOTIFICATIONS} r ON b.region = r.region AND b.times = r.times""", ["uncertainty", "reported"])
def regional_band_vs_reported(spark, folder):
    out = scenarios.bands_vs_reported(
        uncertainty(spark, folder), notifications(spark, folder), [0], leave_out=["Philippines"]
    )
    return rounded(out, *Q)


OVERLAY = """
WITH k AS (SELECT * FROM behaviour WHERE times <= 1484),
c AS (SELECT times, inverse_mhs_values AS v, false AS extended FROM k
  UNION ALL SELECT CAST(unnest(generate_series((SELECT max(times) + 1 FROM k), {end})) AS INTEGER),
    (SELECT arg_max(inverse_mhs_values, times) FROM k), true),
s AS (SELECT region, max(value) * 2 AS top FROM uncertainty
  WHERE scenario = 0 AND type = 'notifications' AND quantile = 0.975 GROUP BY ALL)
SELECT region, times, DATE '2019-12-31' + times AS date, extended, round(v, 6) AS inverse_mhs_values,
  round((1 - v) * top, 6) AS scaled FROM c, s"""


@query("behaviour_overlay", OVERLAY.format(end=1510), ["behaviour", "uncertainty"])
def behaviour_overlay(spark, folder):
    model = uncertainty(spark, folder).where((F.col("scenario") == 0) & (F.col("type") == "notifications"))
    out = scenarios.behaviour_overlay(views.behaviour(spark, folder), scenarios.bands(model), 1510, cutoff=1484)
    return rounded(out, "inverse_mhs_values", "scaled")


@query("behaviour_overlay_to_model_end", OVERLAY.format(
    end="(SELECT max(times) FROM uncertainty WHERE scenario = 0 AND type = 'notifications')"),
       ["behaviour", "uncertainty"])
def behaviour_overlay_to_model_end(spark, folder):
    """The curve held to the last day of the model's table."""
    model = uncertainty(spark, folder).where((F.col("scenario") == 0) & (F.col("type") == "notifications"))
    out = scenarios.behaviour_overlay(views.behaviour(spark, folder), scenarios.bands(model), cutoff=1484)
    return rounded(out, "inverse_mhs_values", "scaled")


INDICATORS = "CASE type " + " ".join(f"WHEN '{a}' THEN '{b}'" for a, b in INDICATOR_LABELS.items()) + " ELSE type END"
INDICATOR_ROWS = f"""SELECT region, scenario, {INDICATORS} AS type, times, date, reported, {BANDS} FROM (
  SELECT coalesce(u.region, r.region) AS region, u.scenario, coalesce(u.type, r.type) AS type,
    coalesce(u.times, r.times) AS times, u.date, u.quantile, u.value, r.value AS reported
  FROM (SELECT * FROM uncertainty WHERE scenario = 0
    AND type IN ('accum_deaths', 'icu_occupancy', 'incidence', 'proportion_seropositive')) u
  FULL JOIN (SELECT * FROM reported WHERE type <> 'notifications') r
    ON u.region = r.region AND u.times = r.times AND u.type = r.type) GROUP BY ALL"""


def indicators(spark, folder):
    observed = reported(spark, folder).where(F.col("type") != "notifications")
    return scenarios.indicators_vs_reported(uncertainty(spark, folder), observed)


@query("indicators_vs_reported", INDICATOR_ROWS, ["uncertainty", "reported"])
def indicators_vs_reported(spark, folder):
    return rounded(indicators(spark, folder), *Q)


@query("scenario_comparison", f"""
SELECT region, scenario, type, times, date, {BANDS}, CASE scenario
    WHEN 0 THEN 'Baseline (current' || chr(10) || 'conditions sustained)'
    WHEN 2 THEN '50% home workers' || chr(10) || 'return onsite' END AS label,
  CASE scenario WHEN 0 THEN 1 WHEN 2 THEN 2 END AS position
FROM uncertainty WHERE type = 'notifications' AND times > 1470 AND scenario <> 1 GROUP BY ALL""", ["uncertainty"])
def scenario_comparison(spark, folder):
    return rounded(scenarios.scenario_comparison(uncertainty(spark, folder), after=1470), *Q)


@query("scenario_contrast", f"""
SELECT region, scenario, times, date, {BANDS} FROM uncertainty
WHERE type = 'notifications' AND times > 1475 AND scenario IN (0, 2) GROUP BY ALL""", ["uncertainty"])
def scenario_contrast(spark, folder):
    compared = scenarios.scenario_comparison(uncertainty(spark, folder), after=1470)
    out = scenarios.contrast(compared, (0, 2), after=1475).drop("type", "label", "position")
    return rounded(out, *Q)


@query("recovered_band", f"""
SELECT region, scenario, type, times, date, {BANDS} FROM uncertainty WHERE scenario = 0 AND region = 'Philippines'
  AND type = 'proportion_seropositive' AND date < DATE '2024-01-20' GROUP BY ALL""", ["uncertainty"])
def recovered_band(spark, folder):
    out = scenarios.recovered_band(uncertainty(spark, folder), "Philippines", dt.date(2024, 1, 20))
    return rounded(out, *Q)


PEAK = """y AS (SELECT * FROM uncertainty WHERE region = 'Philippines' AND type = 'incidence'
    AND date <= DATE '2024-01-25'),
m AS (SELECT region, date, quantile_cont(value, 0.5) AS q50 FROM y GROUP BY ALL),
p AS (SELECT region, date, q50 FROM m WHERE q50 = (SELECT max(q50) FROM m))"""


@query("incidence_peak", f"WITH {PEAK} SELECT region, date, round(q50, 6) AS q50 FROM p", ["uncertainty"])
def incidence_peak(spark, folder):
    out = scenarios.incidence_peak(uncertainty(spark, folder), "Philippines", dt.date(2024, 1, 25))
    return rounded(out, "q50")


@query("incidence_peak_interval", f"""
WITH {PEAK} SELECT region, max(date) AS peak_date, round(quantile_cont(value, 0.025), 8) AS q025,
  round(quantile_cont(value, 0.5), 8) AS q50, round(quantile_cont(value, 0.975), 8) AS q975
FROM y WHERE date IN (SELECT date FROM p) GROUP BY region""", ["uncertainty"])
def incidence_peak_interval(spark, folder):
    out = scenarios.incidence_peak_interval(uncertainty(spark, folder), "Philippines", dt.date(2024, 1, 25))
    return rounded(out, "q025", "q50", "q975", digits=8)


@query("incidence_peak_baseline", """
WITH y AS (SELECT * FROM uncertainty WHERE region = 'Philippines' AND type = 'incidence' AND scenario = 0
    AND date <= DATE '2024-01-25'),
m AS (SELECT region, date, quantile_cont(value, 0.5) AS q50 FROM y GROUP BY ALL)
SELECT region, date, round(q50, 6) AS q50 FROM m WHERE q50 = (SELECT max(q50) FROM m)""", ["uncertainty"])
def incidence_peak_baseline(spark, folder):
    out = scenarios.incidence_peak(uncertainty(spark, folder), "Philippines", dt.date(2024, 1, 25), scenario=0)
    return rounded(out, "q50")


@query("attack_rate", f"""
SELECT region, date, q025, q50, q975 FROM ({INDICATOR_ROWS})
WHERE region = 'Philippines' AND type = 'Percentage recovered' AND date = DATE '2024-01-20'""",
       ["uncertainty", "reported"])
def attack_rate(spark, folder):
    found = scenarios.lookup(indicators(spark, folder), "Philippines", dt.date(2024, 1, 20), "Percentage recovered")
    return rounded(found, "q025", "q50", "q975")


# Parameters

PARAMETERS = """SELECT name, round(quantile_cont(value, 0.025), 9) AS q025, round(quantile_cont(value, 0.5), 9) AS q50,
  round(quantile_cont(value, 0.975), 9) AS q975 FROM draws WHERE region = 'Philippines' GROUP BY ALL"""


def draws(spark, folder):
    return scenarios.model_table(views.draws_raw(spark, folder))


@query("parameter_table", PARAMETERS, ["draws"])
def parameter_table(spark, folder):
    return rounded(posterior.parameter_table(draws(spark, folder), "Philippines"), "q025", "q50", "q975", digits=9)


def _ratio_sql(x, pair):
    def polynomial(coefficients):
        out = f"{coefficients[-1]!r}::DOUBLE"
        for c in reversed(coefficients[:-1]):
            out = f"({out} * {x} + {c!r}::DOUBLE)"
        return out

    return f"({polynomial(pair[0])} / {polynomial(pair[1])})"


# A normal cut off below, from a uniform number: chances above the draw, scaled to what is left above the bound.
NORMAL_SQL = f"""CASE WHEN abs(q) <= 0.425 THEN q * {_ratio_sql("(0.180625::DOUBLE - q * q)", normal.MIDDLE)}
  ELSE sign(q) * CASE WHEN r <= 5 THEN {_ratio_sql("(r - 1.6::DOUBLE)", normal.TAIL)} ELSE {_ratio_sql("(r - 5)", normal.FAR)} END END"""


def _prior_value(p):
    if p["kind"] == "uniform":
        return f"CAST({p['low']} AS DOUBLE) + CAST({p['high'] - p['low']!r} AS DOUBLE) * u"
    return f"greatest({p['mean']}::DOUBLE - {p['sd']}::DOUBLE * z, {p['lower']}::DOUBLE)"


def _prior_left(p):
    return 1.0 if p["kind"] == "uniform" else normal.upper_tail((p["lower"] - p["mean"]) / p["sd"])


def _by_name(value):
    return f"""CASE name {" ".join(f"WHEN '{p['name']}' THEN {value(p)}" for p in posterior.PRIORS)} END"""


PRIOR_SQL = f"""prior AS (SELECT draw_id, name, {_by_name(_prior_value)} AS value
  FROM (SELECT *, {NORMAL_SQL} AS z
  FROM (SELECT *, p - 0.5::DOUBLE AS q, sqrt(-ln(least(p, 1 - p))) AS r
  FROM (SELECT *, u * {_by_name(lambda p: f"{_prior_left(p)!r}::DOUBLE")} AS p
  FROM (SELECT draw_id, name, (CAST('0x' || substr(md5(draw_id || '|' || name || '|0|{SEED}'), 1, 13) AS BIGINT)
      + CAST(0.5 AS DOUBLE)) / CAST(4503599627370496 AS DOUBLE) AS u
    FROM (SELECT draw_id FROM draws WHERE name = 'contact_rate' AND region = 'Philippines'),
      (SELECT unnest([{", ".join(f"'{p['name']}'" for p in posterior.PRIORS)}]) AS name))))))"""


@query("prior_samples", f"WITH {PRIOR_SQL} SELECT draw_id, name, round(value, 6) AS value FROM prior", ["draws"])
def prior_samples(spark, folder):
    kept = draws(spark, folder).where(F.col("region") == "Philippines")
    return rounded(posterior.prior_samples(kept, SEED), "value")


@query("prior_and_posterior", f"""
WITH {PRIOR_SQL},
x AS (SELECT name, value, 'Posterior' AS type, 2 AS type_position FROM draws WHERE region = 'Philippines'
  UNION ALL SELECT name, value, 'Prior', 1 FROM prior)
SELECT label, position, type, type_position, count(*) AS n, round(min(value), 6) AS least, round(max(value), 6) AS most
FROM x JOIN (VALUES {", ".join(
    f"('{p['name']}', replace('{p['label']}', '~', chr(10)), {i})".replace(chr(10), "~")
    for i, p in enumerate(posterior.PRIORS, start=1))}) l(name, label, position) USING (name) GROUP BY ALL""", ["draws"])
def prior_and_posterior(spark, folder):
    """Draws with labels and display order, counted by parameter and kind."""
    both = posterior.prior_and_posterior(draws(spark, folder), "Philippines", SEED)
    out = both.groupBy("label", "position", "type", "type_position").agg(
        F.count(F.lit(1)).alias("n"), F.min("value").alias("least"), F.max("value").alias("most")
    )
    return rounded(out, "least", "most")


@query("prior_posterior_density", f"""
WITH {PRIOR_SQL},
x AS (SELECT name, value, 'Posterior' AS type FROM draws WHERE region = 'Philippines'
  UNION ALL SELECT name, value, 'Prior' FROM prior),
s AS (SELECT name, type, count(*) AS n, stddev_samp(value) AS sd, min(value) AS a, max(value) AS b,
    quantile_cont(value, 0.75) - quantile_cont(value, 0.25) AS iqr FROM x GROUP BY ALL),
h AS (SELECT name, type, n, 0.9::DOUBLE * least(sd, iqr / 1.34::DOUBLE) * pow(n, -0.2::DOUBLE) AS bw,
    min(a) OVER (PARTITION BY name) AS a, max(b) OVER (PARTITION BY name) AS b FROM s),
g AS (SELECT *, a - 4 * bw AS low, (b - a + 8 * bw) / 511.0::DOUBLE AS step FROM h),
p AS (SELECT g.*, (x.value - low) / step AS pos FROM x JOIN g ON x.name = g.name AND x.type = g.type),
bins AS (SELECT name, type, bin, sum(w) AS w FROM (
    SELECT name, type, floor(pos) AS bin, (1 - (pos - floor(pos))) / n AS w FROM p
    UNION ALL SELECT name, type, floor(pos) + 1, (pos - floor(pos)) / n FROM p) GROUP BY ALL),
pts AS (SELECT g.*, CAST(i AS INTEGER) AS point, a + i * (b - a) / 511.0::DOUBLE AS px,
    (a + i * (b - a) / 511.0::DOUBLE - low) / step AS place FROM g, generate_series(0, 511) t(i))
SELECT pts.name, pts.type, point, round(max(px), 6) AS x, round(sum(w * (
    (1 - (place - floor(place))) * exp(-0.5::DOUBLE * pow((floor(place) - bin) * step / bw, 2))
    + (place - floor(place)) * exp(-0.5::DOUBLE * pow((floor(place) + 1 - bin) * step / bw, 2)))
    / (bw * sqrt(2 * pi()))), 6) AS density
FROM pts JOIN bins ON pts.name = bins.name AND pts.type = bins.type GROUP BY pts.name, pts.type, point""", ["draws"])
def prior_posterior_density(spark, folder):
    out = posterior.prior_posterior_density(draws(spark, folder), "Philippines", SEED)
    return rounded(out, "x", "density")


# Tests and detection

PER_CAPITA = f"""t AS (SELECT region, report_date, CAST(coalesce(sum(n_tests), 0) AS BIGINT) AS tests
  FROM tests JOIN facilities USING (facility) GROUP BY ALL),
b AS (SELECT * FROM t UNION ALL SELECT 'Philippines', report_date, CAST(sum(tests) AS BIGINT) FROM t GROUP BY ALL),
pop AS (SELECT area AS region, {" + ".join(f'"{b}"' for b in views.POPULATION_BANDS)} AS total
  FROM population WHERE reference_year = 2020),
c AS (SELECT b.*, tests / (total * 1000) * 10000 AS per_capita FROM b LEFT JOIN pop USING (region)),
r AS (SELECT *, CASE WHEN count(*) OVER w = 20 THEN avg(per_capita) OVER w END AS smoothed FROM c
  WINDOW w AS (PARTITION BY region ORDER BY report_date ROWS BETWEEN 9 PRECEDING AND 10 FOLLOWING))"""
DETECTION_VIEWS = ["tests", "facilities", "population", "draws"]


def per_capita(spark, folder):
    daily = testing.tests_by_region(views.tests(spark, folder), views.facilities(spark, folder), "Philippines")
    totals = structure.population_totals(views.population(spark, folder), views.POPULATION_YEAR)
    return testing.per_capita_tests(daily, totals)


@query("per_capita_tests", f"""
WITH {PER_CAPITA} SELECT region, report_date, tests, round(per_capita, 9) AS per_capita, round(smoothed, 9) AS smoothed
FROM r""", DETECTION_VIEWS[:3])
def per_capita_tests(spark, folder):
    return rounded(per_capita(spark, folder), "per_capita", "smoothed", digits=9)


RATES = f"""{PER_CAPITA},
s AS (SELECT region, value FROM (SELECT *, row_number() OVER (PARTITION BY region
    ORDER BY md5(draw_id || '|{SEED}'), draw_id) AS id FROM draws
  WHERE name = 'testing_to_detection.assumed_cdr_parameter') WHERE id <= 500),
f AS (SELECT r.region, report_date, 1 - exp(-value * smoothed) AS rate FROM r JOIN s ON r.region = s.region),
q AS (SELECT region, report_date, {", ".join(
    f"round(quantile_cont(rate, {p}), 6) AS {n}" for p, n in zip((0.025, 0.25, 0.5, 0.75, 0.975), Q))}
  FROM f GROUP BY ALL)"""


def band(spark, folder):
    return testing.detection_band(testing.detection_draws(draws(spark, folder), SEED), per_capita(spark, folder))


@query("detection_rate_band", f"WITH {RATES} SELECT * FROM q", DETECTION_VIEWS)
def detection_rate_band(spark, folder):
    return rounded(band(spark, folder), *Q)


@query("detection_rate_scaled", f"""
WITH {RATES} SELECT region, report_date, {", ".join(
    f"CASE WHEN region = 'National Capital Region' THEN round({n} * 0.5, 5) ELSE round({n}, 5) END AS {n}" for n in Q)}
FROM (SELECT region, report_date, {", ".join(
    f"quantile_cont(rate, {p}) AS {n}" for p, n in zip((0.025, 0.25, 0.5, 0.75, 0.975), Q))} FROM f GROUP BY ALL)""",
       DETECTION_VIEWS)
def detection_rate_scaled(spark, folder):
    """The band with the rate of one region scaled."""
    sampled = testing.detection_draws(draws(spark, folder), SEED)
    out = testing.detection_band(sampled, per_capita(spark, folder), {"National Capital Region": 0.5})
    return rounded(out, *Q, digits=5)


@query("detection_rate_draws", f"""
WITH {RATES} SELECT region, count(rate) AS rates, round(avg(rate), 6) AS mean FROM f GROUP BY ALL""", DETECTION_VIEWS)
def detection_rate_draws(spark, folder):
    """Every sampled draw on every day of its region, summed up."""
    sampled = testing.detection_draws(draws(spark, folder), SEED)
    rates = testing.detection_rates(sampled, per_capita(spark, folder))
    out = rates.groupBy("region").agg(F.count("rate").alias("rates"), F.avg("rate").alias("mean"))
    return rounded(out, "mean")


@query("detection_rate_lookup", f"""
WITH {RATES} SELECT region, report_date AS date, q025, q50, q975 FROM q
WHERE region = 'Philippines' AND report_date = DATE '1998-06-01'""", DETECTION_VIEWS)
def detection_rate_lookup(spark, folder):
    rows = band(spark, folder).withColumnRenamed("report_date", "date")
    return rounded(scenarios.lookup(rows, "Philippines", dt.date(1998, 6, 1)), "q025", "q50", "q975")


TOTALS = """t AS (SELECT date, CAST(CASE WHEN count(*) = count(tested) THEN sum(tested) END AS DOUBLE) AS total_tested,
  CAST(sum(positive) AS DOUBLE) AS total_positive, CAST(sum(negative) AS DOUBLE) AS total_negative
  FROM test_totals GROUP BY ALL)"""


@query("positivity", f"""
WITH {TOTALS} SELECT date, total_tested, total_positive, total_negative,
  round_even(total_positive / total_tested, 2) AS percent_positive,
  round_even(total_negative / total_tested, 2) AS percent_negative FROM t""", ["test_totals"])
def positivity(spark, folder):
    return testing.test_totals(views.test_totals(spark, folder))


@query("cases_times_tests", f"""
WITH {TOTALS}, c AS (SELECT report AS report_date, count(*) AS total_cases FROM line_list GROUP BY ALL)
SELECT report_date, total_cases, total_tested, round(total_tested / 106700000.0::DOUBLE, 9) AS tested_share,
  round(total_cases * (total_tested / 106700000.0::DOUBLE), 9) AS scaled_cases
FROM c JOIN t ON c.report_date = t.date""", ["test_totals", "line_list"])
def cases_times_tests(spark, folder):
    totals = testing.test_totals(views.test_totals(spark, folder))
    out = testing.cases_times_tests(views.line_list(spark, folder), "report", totals)
    return rounded(out, "tested_share", "scaled_cases", digits=9)


@query("facility_positivity", """
SELECT l_suppkey AS facility_name, CAST(l_shipdate AS DATE) AS report_date, l_discount AS pct_positive_cumulative
FROM lineitem""")
def facility_positivity(spark, folder):
    reports = views.table(spark, folder, "lineitem").selectExpr(
        "l_suppkey AS facility_name", "date_format(l_shipdate, 'yyyy-MM-dd') AS report_date",
        "l_discount AS pct_positive_cumulative",
    )
    return testing.facility_positivity(reports)


# Age shares

REPORTED_AGES = f"""b AS (SELECT region, {AGE_BAND_SQL} AS age_group, report FROM ({CASES_SHORT})),
a AS (SELECT * FROM b UNION ALL SELECT 'philippines', age_group, report FROM b),
rep AS (SELECT region, age_group, CAST(count(*) AS DOUBLE) AS cases, CAST(sum(count(report)) OVER (PARTITION BY region)
    AS DOUBLE) AS total_cases FROM a WHERE age_group IS NOT NULL AND region IN {SHORT_LIST} GROUP BY region, age_group)"""


@query("age_band_share", f"""
WITH {REPORTED_AGES} SELECT region, age_group, cases, total_cases, round(cases / total_cases, 9) AS share,
  'Reported' AS type FROM rep""", ["line_list"])
def age_band_share(spark, folder):
    out = ages.reported_age_share(case_names(views.line_list(spark, folder)), SHORT_REGIONS, views.NATIONAL)
    return rounded(out, "share", digits=9)


def _modelled(where: str) -> str:
    starts = BAND_STARTS + [75]
    cells = ", ".join(f'sum(notificationsXagegroup_{s}) AS "{b}"' for s, b in zip(starts, AGE_LEVELS))
    return f"""SELECT region, age_group, cases, sum(cases) OVER (PARTITION BY region) AS total_cases,
  cases / sum(cases) OVER (PARTITION BY region) AS share
FROM (UNPIVOT (SELECT region, {cells} FROM derived{where} GROUP BY region) ON {LONG_AGES}
  INTO NAME age_group VALUE cases)"""


def derived(spark, folder):
    return scenarios.model_table(views.derived_raw(spark, folder))


@query("modelled_age_share", f"""
SELECT region, age_group, round(cases, 4) AS cases, round(total_cases, 4) AS total_cases, round(share, 9) AS share,
  'Modeled' AS type FROM ({_modelled(" WHERE scenario = 0")})""", ["derived"])
def modelled_age_share(spark, folder):
    out = ages.modelled_age_share(derived(spark, folder))
    return rounded(rounded(out, "cases", "total_cases", digits=4), "share", digits=9)


@query("age_shares", f"""
WITH {REPORTED_AGES}
SELECT *, CASE age_group {POSITIONS} END AS position FROM (
  SELECT region, age_group, round(cases, 4) AS cases, round(total_cases, 4) AS total_cases, round(share, 9) AS share,
    'Modeled' AS type FROM ({_modelled("")})
  UNION ALL SELECT region, age_group, cases, total_cases, round(cases / total_cases, 9), 'Reported' FROM rep)""",
       ["derived", "line_list"])
def age_shares(spark, folder):
    """Both kinds under each other, the modelled one over all scenarios."""
    cases = case_names(views.line_list(spark, folder))
    out = ages.age_shares(cases, derived(spark, folder), SHORT_REGIONS, views.NATIONAL, scenario=None)
    return rounded(rounded(out, "cases", "total_cases", digits=4), "share", digits=9)
