"""The logical tables, derived from the supplied ones, in Spark and in SQL.

The supplied tables have no missing values, so these make them by remainder, alike on both sides.
Each view reads one supplied table and its columns only; nothing is limited or sampled.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.bands import BAND_STARTS, POPULATION_BANDS
from ..operators.joins import merge_series
from ..plans.posterior import PRIORS
from ..plans.scenarios import model_table, processed_series
from ..plans.validation import run_snapshot

# Day zero, last day and areas of the two groups of tables.
ORDERS_EPOCH = dt.date(1994, 12, 31)
ORDERS_UNTIL = dt.date(2001, 6, 30)
EVENTS_EPOCH = dt.date(2019, 12, 31)
NATIONAL = "philippines"
POPULATION_YEAR = 2020
RUN_DATES = [dt.date(2024, 1, 8), dt.date(2024, 1, 15), dt.date(2024, 1, 22)]
MODEL_TYPES = ["accum_deaths", "icu_occupancy", "incidence", "notifications", "proportion_seropositive"]
OUTPUTS = {"notifications": "notifications", "icu": "icu_occupancy", "deaths": "accum_deaths"}


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def line_list(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "orders").selectExpr(
        "o_orderkey AS case_id",
        """CASE WHEN o_orderkey % 97 = 0 THEN NULL WHEN o_orderpriority = '1-URGENT' THEN 'NCR'
           WHEN o_orderpriority = '2-HIGH' THEN '4A' WHEN o_orderpriority = '3-MEDIUM' THEN '5'
           WHEN o_orderpriority = '4-NOT SPECIFIED' THEN '7' ELSE '07' END AS region""",
        "CASE WHEN o_orderkey % 5 = 0 THEN NULL ELSE CAST(o_orderdate AS DATE) END AS admitted",
        """CASE WHEN o_orderkey % 41 = 0 THEN NULL ELSE date_add(CAST(o_orderdate AS DATE),
           CAST(o_orderkey % 9 + length(o_orderpriority) % 5 AS INT)) END AS report""",
        """CASE WHEN o_orderkey % 20 = 1 THEN date_add(CAST(o_orderdate AS DATE),
           CAST(7 + o_orderkey % 9 AS INT)) END AS died""",
        """CASE WHEN o_orderkey % 7 = 0 THEN NULL ELSE date_sub(CAST(o_orderdate AS DATE),
           CAST(o_orderkey % 4 AS INT)) END AS onset""",
        """CASE WHEN o_orderkey % 31 = 0 THEN NULL ELSE CAST(o_custkey % 100 AS DOUBLE)
           + CASE WHEN o_orderkey % 53 = 0 THEN 0.5D ELSE 0.0D END END AS age""",
    )


LINE_LIST = """
SELECT o_orderkey AS case_id,
  CASE WHEN o_orderkey % 97 = 0 THEN NULL WHEN o_orderpriority = '1-URGENT' THEN 'NCR'
       WHEN o_orderpriority = '2-HIGH' THEN '4A' WHEN o_orderpriority = '3-MEDIUM' THEN '5'
       WHEN o_orderpriority = '4-NOT SPECIFIED' THEN '7' ELSE '07' END AS region,
  CASE WHEN o_orderkey % 5 = 0 THEN NULL ELSE CAST(o_orderdate AS DATE) END AS admitted,
  CASE WHEN o_orderkey % 41 = 0 THEN NULL ELSE CAST(o_orderdate AS DATE)
       + CAST(o_orderkey % 9 + length(o_orderpriority) % 5 AS INTEGER) END AS report,
  CASE WHEN o_orderkey % 20 = 1 THEN CAST(o_orderdate AS DATE) + CAST(7 + o_orderkey % 9 AS INTEGER) END AS died,
  CASE WHEN o_orderkey % 7 = 0 THEN NULL ELSE CAST(o_orderdate AS DATE) - CAST(o_orderkey % 4 AS INTEGER) END AS onset,
  CASE WHEN o_orderkey % 31 = 0 THEN NULL ELSE CAST(o_custkey % 100 AS DOUBLE)
       + CASE WHEN o_orderkey % 53 = 0 THEN 0.5 ELSE 0.0 END END AS age
FROM orders"""

HOSPITAL_NAMES = """CASE WHEN l_suppkey % 29 = 0 THEN NULL WHEN l_suppkey % 5 = 0 THEN 'NATIONAL CAPITAL REGION (NCR)'
       WHEN l_suppkey % 5 = 1 THEN 'REGION IV-A (CALABAR ZON)' WHEN l_suppkey % 5 = 2 THEN 'REGION V (BICOL REGION)'
       WHEN l_suppkey % 5 = 3 THEN 'REGION VII (CENTRAL VISAYAS)' ELSE 'REGION XI (DAVAO REGION)' END AS region"""


def hospital(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "lineitem").selectExpr(
        "l_suppkey AS facility",
        HOSPITAL_NAMES,
        "CASE WHEN l_orderkey % 83 = 0 THEN NULL ELSE CAST(l_shipdate AS DATE) END AS reportdate",
        "CASE WHEN l_orderkey % 211 = 0 THEN NULL ELSE CAST(l_quantity AS INT) END AS icu_o",
    )


HOSPITAL = f"""
SELECT l_suppkey AS facility,
  {HOSPITAL_NAMES},
  CASE WHEN l_orderkey % 83 = 0 THEN NULL ELSE CAST(l_shipdate AS DATE) END AS reportdate,
  CASE WHEN l_orderkey % 211 = 0 THEN NULL ELSE CAST(l_quantity AS INTEGER) END AS icu_o
FROM lineitem"""


def tests(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "lineitem").selectExpr(
        "l_suppkey AS facility",
        "CAST(l_shipdate AS DATE) AS report_date",
        "CASE WHEN l_orderkey % 13 = 0 THEN NULL ELSE CAST(l_quantity AS INT) END AS n_tests",
    )


TESTS = """
SELECT l_suppkey AS facility, CAST(l_shipdate AS DATE) AS report_date,
  CASE WHEN l_orderkey % 13 = 0 THEN NULL ELSE CAST(l_quantity AS INTEGER) END AS n_tests
FROM lineitem"""

AREA_NAMES = """CASE n_regionkey WHEN 0 THEN 'Calabarzon' WHEN 1 THEN 'Central Visayas'
       WHEN 2 THEN 'National Capital Region' WHEN 3 THEN 'Bicol' ELSE 'Davao' END"""


def nations(spark: SparkSession, folder: str) -> DataFrame:
    """25 rows at any scale."""
    return F.broadcast(table(spark, folder, "nation").select("n_nationkey", "n_regionkey"))


def facilities(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "supplier").where("s_acctbal >= 500")
    joined = rows.join(nations(spark, folder), F.col("s_nationkey") == F.col("n_nationkey"))
    return joined.selectExpr("s_suppkey AS facility", f"{AREA_NAMES} AS region")


FACILITIES = f"""
SELECT s_suppkey AS facility, {AREA_NAMES} AS region
FROM supplier JOIN nation ON s_nationkey = n_nationkey WHERE s_acctbal >= 500"""


def test_totals(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "lineitem").selectExpr(
        "date_format(l_shipdate, 'MMMM d, yyyy') AS date",
        "CASE WHEN l_orderkey % 1009 = 0 THEN 'n/a' ELSE format_number(CAST(floor(l_extendedprice) AS BIGINT), 0) END"
        " AS tested",
        "format_number(CAST(floor(l_extendedprice * l_discount) AS BIGINT), 0) AS positive",
        "format_number(CAST(floor(l_extendedprice) - floor(l_extendedprice * l_discount) AS BIGINT), 0) AS negative",
    )


TEST_TOTALS = """
SELECT CAST(l_shipdate AS DATE) AS date,
  CASE WHEN l_orderkey % 1009 = 0 THEN NULL ELSE floor(l_extendedprice) END AS tested,
  floor(l_extendedprice * l_discount) AS positive,
  floor(l_extendedprice) - floor(l_extendedprice * l_discount) AS negative
FROM lineitem"""


def population(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "customer").join(
        nations(spark, folder), F.col("c_nationkey") == F.col("n_nationkey")
    ).selectExpr(f"{AREA_NAMES} AS area", "CAST(2015 + 5 * (c_custkey % 2) AS INT) AS reference_year",
                 "c_custkey % 21 AS band")
    cells = [F.count(F.when(F.col("band") == i, F.lit(1))).alias(b) for i, b in enumerate(POPULATION_BANDS)]
    regional = rows.groupBy("area", "reference_year").agg(*cells)
    doubled = regional.withColumn("area", F.explode(F.array("area", F.lit("Philippines"))))
    summed = doubled.groupBy("area", "reference_year").agg(
        *[F.sum(f"`{b}`").alias(b) for b in POPULATION_BANDS]
    )
    return summed.select("area", "reference_year", *[
        F.when(F.col(f"`{b}`") == 0, F.lit("...")).otherwise(F.col(f"`{b}`").cast("string")).alias(b)
        for b in POPULATION_BANDS
    ])


POPULATION = f"""
SELECT a.area, reference_year, {", ".join(
    f'CAST(nullif(count(*) FILTER (band = {i}), 0) AS DOUBLE) AS "{b}"' for i, b in enumerate(POPULATION_BANDS))}
FROM (SELECT {AREA_NAMES} AS area, CAST(2015 + 5 * (c_custkey % 2) AS INTEGER) AS reference_year,
        c_custkey % 21 AS band
      FROM customer JOIN nation ON c_nationkey = n_nationkey) p,
  LATERAL (SELECT unnest([p.area, 'Philippines']) AS area) a
GROUP BY ALL"""

MOBILITY_COLUMNS = [
    f"{place}_percent_change_from_baseline"
    for place in ("retail_and_recreation", "grocery_and_pharmacy", "parks", "transit_stations", "workplaces",
                  "residential")
]
_MOBILITY_KEYS = [
    "CASE WHEN event_type = 'error' THEN 'Elsewhere' ELSE 'Philippines' END AS country_region",
    """CASE user_id % 4 WHEN 0 THEN NULL WHEN 1 THEN 'Calabarzon' WHEN 2 THEN 'Central Visayas'
       ELSE 'National Capital Region' END AS sub_region_1""",
    "CASE user_id % 8 WHEN 0 THEN '' WHEN 4 THEN 'Metro' WHEN 1 THEN '' END AS metro_area",
    "CAST(ts AS DATE) AS date",
]


def mobility(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "events").selectExpr(*_MOBILITY_KEYS, "event_id % 6 AS place", "value")
    cells = [
        (F.avg(F.when(F.col("place") == i, F.col("value"))) - 100.0).alias(c) for i, c in enumerate(MOBILITY_COLUMNS)
    ]
    return rows.groupBy("country_region", "sub_region_1", "metro_area", "date").agg(*cells)


MOBILITY = f"""
SELECT {", ".join(_MOBILITY_KEYS)}, {", ".join(
    f"avg(value) FILTER (event_id % 6 = {i}) - 100.0 AS {c}" for i, c in enumerate(MOBILITY_COLUMNS))}
FROM events GROUP BY ALL"""

_MODEL_KEYS = [
    """CASE user_id % 4 WHEN 0 THEN 'covid_19-philippines' WHEN 1 THEN 'covid_19-calabarzon'
       WHEN 2 THEN 'covid_19-central-visayas' ELSE 'covid_19-manila' END AS region""",
    "CAST(event_id % 3 AS INT) AS scenario",
    """CASE event_type WHEN 'click' THEN 'notifications' WHEN 'view' THEN 'incidence'
       WHEN 'purchase' THEN 'icu_occupancy' WHEN 'signup' THEN 'accum_deaths'
       ELSE 'proportion_seropositive' END AS type""",
]
# Quantiles of the model tables and their distance from the mean in deviations.
SPREADS = {0.025: -1.96, 0.25: -0.674, 0.5: 0.0, 0.75: 0.674, 0.975: 1.96}


def uncertainty_raw(spark: SparkSession, folder: str) -> DataFrame:
    """Model quantiles: mean and deviation of each cell, spread out to five rows."""
    cells = (
        table(spark, folder, "events")
        .selectExpr(*_MODEL_KEYS, "datediff(CAST(ts AS DATE), DATE'2019-12-31') AS times", "value")
        .groupBy("region", "scenario", "type", "times")
        .agg(F.avg("value").alias("m"), F.stddev_pop("value").alias("s"))
    )
    spread = F.array(*[F.struct(F.lit(q).alias("quantile"), F.lit(z).alias("z")) for q, z in SPREADS.items()])
    return cells.select("region", "scenario", "type", "times", "m", "s", F.explode(spread).alias("e")).select(
        "region", "scenario", "type", "times", "e.quantile", (F.col("m") + F.col("e.z") * F.col("s")).alias("value")
    )


UNCERTAINTY_RAW = f"""
SELECT region, scenario, type, times, quantile, m + z * s AS value
FROM (SELECT {", ".join(_MODEL_KEYS)}, CAST(CAST(ts AS DATE) - DATE '2019-12-31' AS INTEGER) AS times,
        avg(value) AS m, stddev_pop(value) AS s FROM events GROUP BY ALL),
  (VALUES {", ".join(f"(CAST({q} AS DOUBLE), CAST({z} AS DOUBLE))" for q, z in SPREADS.items())}) v(quantile, z)"""

DISPLAY = """CASE region WHEN 'covid_19-philippines' THEN 'Philippines' WHEN 'covid_19-calabarzon' THEN 'Calabarzon'
  WHEN 'covid_19-central-visayas' THEN 'Central Visayas' WHEN 'covid_19-manila' THEN 'National Capital Region'
  WHEN 'philippines' THEN 'Philippines' WHEN 'calabarzon' THEN 'Calabarzon'
  WHEN 'central_visayas' THEN 'Central Visayas' WHEN 'manila' THEN 'National Capital Region' ELSE region END"""

UNCERTAINTY = f"""
SELECT {DISPLAY} AS region, scenario, type, times, quantile, value, DATE '2019-12-31' + times AS date
FROM uncertainty_raw"""

_NAME_LIST = [p["name"] for p in PRIORS]
_DRAW_NAME = "CASE event_id % 9 " + " ".join(f"WHEN {i} THEN '{n}'" for i, n in enumerate(_NAME_LIST)) + " END AS name"


def draws_raw(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "events").selectExpr(
        "event_id AS draw_id", _MODEL_KEYS[0], _DRAW_NAME, "value / 1000.0D AS value"
    )


DRAWS = f"""
SELECT draw_id, {DISPLAY} AS region, name, value
FROM (SELECT event_id AS draw_id, {_MODEL_KEYS[0]}, {_DRAW_NAME}, value / CAST(1000.0 AS DOUBLE) AS value FROM events)"""


def derived_raw(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "events").selectExpr(
        _MODEL_KEYS[0], _MODEL_KEYS[1], "datediff(CAST(ts AS DATE), DATE'2019-12-31') AS times",
        "event_id % 16 AS band", "value",
    )
    cells = [
        F.sum(F.when(F.col("band") == i, F.col("value")).otherwise(F.lit(0.0))).alias(f"notificationsXagegroup_{s}")
        for i, s in enumerate(BAND_STARTS + [75])
    ]
    return rows.groupBy("region", "scenario", "times").agg(*cells)


DERIVED = f"""
SELECT {DISPLAY} AS region, scenario, times, {", ".join(
    f"sum(CASE WHEN band = {i} THEN value ELSE 0 END) AS notificationsXagegroup_{s}"
    for i, s in enumerate(BAND_STARTS + [75]))}
FROM (SELECT {_MODEL_KEYS[0]}, {_MODEL_KEYS[1]}, CAST(CAST(ts AS DATE) - DATE '2019-12-31' AS INTEGER) AS times,
        event_id % 16 AS band, value FROM events)
GROUP BY ALL"""

_REPORTED_KEYS = [
    """CASE user_id % 4 WHEN 0 THEN 'philippines' WHEN 1 THEN 'calabarzon' WHEN 2 THEN 'central_visayas'
       ELSE 'manila' END AS region""",
    """CASE event_type WHEN 'click' THEN 'notifications' WHEN 'signup' THEN 'accum_deaths'
       WHEN 'purchase' THEN 'icu_occupancy' END AS type""",
]


def reported_raw(spark: SparkSession, folder: str) -> DataFrame:
    """Daily counts, shifted so that the first model days have none and the last ones no model value."""
    return (
        table(spark, folder, "events")
        .selectExpr(*_REPORTED_KEYS, "datediff(CAST(ts AS DATE), DATE'2019-12-31') + 10 AS times")
        .where("type IS NOT NULL")
        .groupBy("region", "type", "times")
        .agg(F.count(F.lit(1)).cast("double").alias("value"))
    )


REPORTED = f"""
SELECT {DISPLAY} AS region, type, times, CAST(count(*) AS DOUBLE) AS value
FROM (SELECT {", ".join(_REPORTED_KEYS)}, CAST(CAST(ts AS DATE) - DATE '2019-12-31' AS INTEGER) + 10 AS times
      FROM events)
WHERE type IS NOT NULL GROUP BY ALL"""


def behaviour(spark: SparkSession, folder: str) -> DataFrame:
    return (
        table(spark, folder, "events")
        .selectExpr("datediff(CAST(ts AS DATE), DATE'2019-12-31') AS times", "value")
        .groupBy("times")
        .agg((F.avg("value") / 500.0).alias("inverse_mhs_values"))
    )


BEHAVIOUR = """
SELECT CAST(CAST(ts AS DATE) - DATE '2019-12-31' AS INTEGER) AS times,
  avg(value) / CAST(500 AS DOUBLE) AS inverse_mhs_values
FROM events GROUP BY ALL"""


def archived_runs(spark: SparkSession, folder: str) -> DataFrame:
    """The snapshots of three run dates; a run holds reported values up to its date."""
    model = model_table(uncertainty_raw(spark, folder))
    names = {output: f"local_data_{metric}" for metric, output in OUTPUTS.items()}
    local = merge_series(processed_series(reported_raw(spark, folder)), ["region", "times"], "type", "value", names)
    # One snapshot stands for the runs of all dates and is stamped again with each of them.
    runs = run_snapshot(model, local, RUN_DATES[-1], list(OUTPUTS.values())).withColumn(
        "model_run_date", F.explode(F.array(*[F.lit(d) for d in RUN_DATES]))
    )
    known = F.col("date") <= F.col("model_run_date")
    return runs.withColumns({
        "scenario": F.concat(F.lit("S_"), F.col("scenario")),
        "data_acquired_date": F.col("model_run_date"),
        **{c: F.when(known, F.col(c)) for c in names.values()},
    })


RUN_VALUES = ", ".join(f"(DATE '{d}')" for d in RUN_DATES)
ARCHIVED_RUNS = f"""
SELECT u.region, u.times, 'S_' || u.scenario AS scenario, {", ".join(
    f"max(CASE WHEN u.type = '{t}' AND quantile = {q} THEN u.value END) AS {t}_{n}"
    for t in OUTPUTS.values() for q, n in ((0.25, "q25"), (0.5, "q50"), (0.75, "q75")))},
  {", ".join(
    f"max(CASE WHEN r.type = '{t}' AND u.date <= d.run THEN r.value END) AS local_data_{m}"
    for m, t in OUTPUTS.items())},
  'calibration' AS data_type, d.run AS model_run_date, d.run AS data_acquired_date, u.date
FROM uncertainty u LEFT JOIN reported r ON u.region = r.region AND u.times = r.times, (VALUES {RUN_VALUES}) d(run)
WHERE u.type IN ('notifications', 'icu_occupancy', 'accum_deaths') AND quantile IN (0.25, 0.5, 0.75)
GROUP BY u.region, u.times, u.scenario, u.date, d.run"""

# Raw daily reports, two thirds of them of one region; beds are sometimes missing. The order columns tell all rows apart.
REPORT_ORDER = ["day", "report_id", "line", "part", "facility", "cost"]
BED_REPORTS = """
SELECT CASE WHEN l_suppkey % 3 <> 0 THEN 'NCR' WHEN l_suppkey % 29 = 0 THEN NULL ELSE l_returnflag END AS region,
  CAST(l_shipdate AS DATE) AS day, l_orderkey AS report_id, l_linenumber AS line, l_partkey AS part,
  l_suppkey AS facility, l_extendedprice AS cost,
  CASE WHEN l_orderkey % 7 < 3 THEN NULL ELSE CAST(l_quantity AS INT) END AS beds
FROM lineitem"""


def bed_reports(spark: SparkSession, folder: str) -> DataFrame:
    return spark.sql(BED_REPORTS.replace("FROM lineitem", "FROM {lines}"), lines=table(spark, folder, "lineitem"))


# Views in the order in which they build on each other.
SQL_VIEWS = {
    "line_list": LINE_LIST,
    "hospital": HOSPITAL,
    "tests": TESTS,
    "facilities": FACILITIES,
    "test_totals": TEST_TOTALS,
    "population": POPULATION,
    "mobility": MOBILITY,
    "uncertainty_raw": UNCERTAINTY_RAW,
    "uncertainty": UNCERTAINTY,
    "draws": DRAWS,
    "derived": DERIVED,
    "reported": REPORTED,
    "behaviour": BEHAVIOUR,
    "archived_runs": ARCHIVED_RUNS,
    "bed_reports": BED_REPORTS,
}
NEEDS = {
    "uncertainty": ["uncertainty_raw"],
    "archived_runs": ["uncertainty_raw", "uncertainty", "reported"],
}


def with_views(body: str, *names: str) -> str:
    """A statement with the views it uses written in front of it."""
    wanted = {n for name in names for n in [*NEEDS.get(name, []), name]}
    parts = [f"{n} AS ({sql})" for n, sql in SQL_VIEWS.items() if n in wanted]
    body = body.strip()
    if body.upper().startswith("WITH "):
        return "WITH " + ",\n".join(parts) + ",\n" + body[5:]
    return "WITH " + ",\n".join(parts) + "\n" + body
