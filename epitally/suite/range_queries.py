"""Windows, running values and ranks over raw rows, of which one group holds most."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators.ranges import fill_days_rows, halo_window, prefix_scan, ranked, rolling_rows, trim_tail_rows
from . import views
from .registry import query, rounded

ORDER = views.REPORT_ORDER
ORDERED = ", ".join(f"{c} NULLS FIRST" for c in ORDER)


@query("rolling_reports", f"""
SELECT region, {", ".join(ORDER)}, CASE WHEN count(*) OVER w = 7 THEN round(avg(beds) OVER w, 6) END AS mean
FROM bed_reports
WINDOW w AS (PARTITION BY region ORDER BY {ORDERED} ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING)""", ["bed_reports"])
def rolling_reports(spark, folder):
    """A mean over seven reports of a region, on raw rows."""
    out = rolling_rows(views.bed_reports(spark, folder), ["region"], ORDER, "beds", 7, "mean", "center")
    return rounded(out.drop("beds"), "mean")


@query("report_gaps", f"""
SELECT region, {", ".join(ORDER)}, date_diff('day', lag(day) OVER w, day) AS since,
  date_diff('day', day, lead(day, 2) OVER w) AS until
FROM bed_reports WINDOW w AS (PARTITION BY region ORDER BY {ORDERED})""", ["bed_reports"])
def report_gaps(spark, folder):
    """Days from the report before and to the next but one."""
    out = halo_window(views.bed_reports(spark, folder).drop("beds"), ["region"], ORDER, 1, 2, lambda w: {
        "since": F.datediff("day", F.lag("day").over(w)).cast("long"),
        "until": F.datediff(F.lead("day", 2).over(w), "day").cast("long"),
    })
    return out


@query("filled_facility_days", """
WITH d AS (SELECT facility, day, sum(beds) AS beds FROM bed_reports GROUP BY ALL),
g AS (SELECT facility, CAST(unnest(generate_series(min(day), max(day), INTERVAL 1 DAY)) AS DATE) AS day FROM d GROUP BY facility)
SELECT g.facility, g.day, CAST(d.beds AS BIGINT) AS beds FROM g LEFT JOIN d ON g.facility = d.facility AND g.day = d.day""",
       ["bed_reports"])
def filled_facility_days(spark, folder):
    """Every facility's days without a gap."""
    daily = views.bed_reports(spark, folder).groupBy("facility", "day").agg(F.sum("beds").alias("beds"))
    return fill_days_rows(daily, ["facility"], "day", "beds")


@query("running_reports", f"""
SELECT region, {", ".join(ORDER)}, CAST(sum(beds) OVER w AS BIGINT) AS beds_so_far, max(cost) OVER w AS cost_so_far,
  last_value(beds IGNORE NULLS) OVER w AS beds_known, round(sum(beds) OVER w / sum(beds) OVER g, 6) AS share_so_far,
  max(CASE WHEN beds IS NOT NULL THEN day END) OVER g AS last_observed
FROM bed_reports
WINDOW w AS (PARTITION BY region ORDER BY {ORDERED} ROWS UNBOUNDED PRECEDING), g AS (PARTITION BY region)""", ["bed_reports"])
def running_reports(spark, folder):
    """Running total, peak, last known value and share of the region's total, on raw rows."""
    rows = views.bed_reports(spark, folder).withColumn("_seen", F.when(F.col("beds").isNotNull(), F.col("day")))
    out = prefix_scan(
        rows, ["region"], ORDER, sums={"beds_so_far": "beds"}, maxima={"cost_so_far": "cost", "_last": "_seen"},
        last={"beds_known": "beds"}, whole={"beds_so_far": "_total", "_last": "last_observed"},
    )
    share = F.col("beds_so_far") / F.col("_total")
    return rounded(out.withColumn("share_so_far", share).drop("beds", "_seen", "_last", "_total"), "share_so_far")


@query("trimmed_reports", """
SELECT region, report_id, line, part, day - DATE '1994-12-31' AS times FROM (
  SELECT *, max(day - DATE '1994-12-31') OVER (PARTITION BY region) AS last FROM bed_reports)
WHERE day - DATE '1994-12-31' > 500 AND day - DATE '1994-12-31' < last - 13""", ["bed_reports"])
def trimmed_reports(spark, folder):
    """Reports of no region's last two weeks; no report is gathered by region."""
    times = F.datediff("day", F.lit(views.ORDERS_EPOCH)).cast("long").alias("times")
    rows = views.bed_reports(spark, folder).select("region", "report_id", "line", "part", times)
    return trim_tail_rows(rows, ["region"], 500, 13)


@query("ranked_reports", f"""
SELECT region, report_id, line, part, row_number() OVER (PARTITION BY region ORDER BY {ORDERED}) - 1 AS rank,
  count(*) OVER (PARTITION BY region) AS size FROM bed_reports""", ["bed_reports"])
def ranked_reports(spark, folder):
    out = ranked(views.bed_reports(spark, folder), ["region"], ORDER)
    return out.select("region", "report_id", "line", "part", "rank", "size")
