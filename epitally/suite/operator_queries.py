"""Filters, joins, aggregates, series operators, reshaping, sampling."""

from __future__ import annotations


from pyspark.sql import functions as F

from ..functions.dates import day_offset
from ..functions.numbers import half_even
from ..operators.aggregates import (
    adjusted_r2,
    daily_counts,
    national_and_regional,
    ordered_text,
    row_count,
    share_of_total,
    skip_sum,
    strict_sum,
    with_national,
)
from ..operators.filters import area, complete_rows, in_regions, offset_between, rows_at_max, trim_tail
from ..operators.joins import join_null_safe, merge_series
from ..operators.quantiles import bounded_quantiles, exact_quantiles
from ..operators.regression import least_squares
from ..operators.reshape import quantile_wide, to_long, type_quantile_wide
from ..operators.sampling import sample_rows
from ..operators.series import carry_forward, fill_days, last_observed, rolling, weekly
from ..plans.scenarios import model_table, processed_series
from . import views
from .registry import query, rounded

EPOCH = views.ORDERS_EPOCH


def uncertainty(spark, folder):
    return model_table(views.uncertainty_raw(spark, folder))


def reported(spark, folder):
    return processed_series(views.reported_raw(spark, folder))


# Filters


@query("region_filter", """
SELECT case_id, region FROM line_list WHERE region IN ('NCR', '4A', '5', '7')""", ["line_list"])
def region_filter(spark, folder):
    return views.line_list(spark, folder).where(in_regions(["NCR", "4A", "5", "7"])).select("case_id", "region")


@query("complete_rows", """
SELECT case_id, region, admitted, report FROM line_list
WHERE region IS NOT NULL AND admitted IS NOT NULL AND report IS NOT NULL""", ["line_list"])
def complete(spark, folder):
    return complete_rows(views.line_list(spark, folder).select("case_id", "region", "admitted", "report"))


@query("not_missing", "SELECT case_id, died FROM line_list WHERE died IS NOT NULL", ["line_list"])
def not_missing(spark, folder):
    return views.line_list(spark, folder).where(F.col("died").isNotNull()).select("case_id", "died")


@query("offset_bounds", """
SELECT case_id, CAST(onset - DATE '1994-12-31' AS INTEGER) AS times FROM line_list
WHERE onset - DATE '1994-12-31' > 40 AND onset - DATE '1994-12-31' <= 1314""", ["line_list"])
def offset_bounds(spark, folder):
    rows = views.line_list(spark, folder).select("case_id", day_offset("onset", EPOCH).alias("times"))
    return rows.where(offset_between(40, 1314))


@query("tail_trim", """
SELECT region, times, n AS values FROM (
  SELECT *, max(times) OVER (PARTITION BY region) AS last FROM (
    SELECT region, CAST(admitted - DATE '1994-12-31' AS INTEGER) AS times, count(*) AS n FROM line_list
    WHERE admitted IS NOT NULL GROUP BY ALL))
WHERE times > 60 AND times < last - 9""", ["line_list"])
def tail_trim(spark, folder):
    daily = daily_counts(views.line_list(spark, folder), ["region"], {"notifications": "admitted"})
    return trim_tail(daily.select("region", day_offset("date", EPOCH).alias("times"), "values"), ["region"], 60, 9)


@query("date_bound", "SELECT case_id, admitted FROM line_list WHERE admitted <= DATE '2001-06-30'", ["line_list"])
def date_bound(spark, folder):
    return views.line_list(spark, folder).where(F.col("admitted") <= F.lit(views.ORDERS_UNTIL)).select(
        "case_id", "admitted"
    )


@query("membership", """
SELECT draw_id, name, value FROM draws WHERE name IN ('contact_rate', 'infectious_seed')
  AND region = 'Philippines'""", ["draws"])
def membership(spark, folder):
    rows = model_table(views.draws_raw(spark, folder))
    kept = rows.where(F.col("name").isin("contact_rate", "infectious_seed") & (F.col("region") == "Philippines"))
    return kept.select("draw_id", "name", "value")


@query("scenario_filter", """
SELECT region, type, times, quantile, round(value, 6) AS value FROM uncertainty
WHERE scenario = 0 AND type <> 'incidence' AND (quantile = 0.25 OR quantile = 0.5 OR quantile = 0.75)""", ["uncertainty"])
def scenario_filter(spark, folder):
    kept = uncertainty(spark, folder).where(
        (F.col("scenario") == 0) & (F.col("type") != "incidence") & F.col("quantile").isin(0.25, 0.5, 0.75)
    )
    return rounded(kept.select("region", "type", "times", "quantile", "value"), "value")


@query("geography_filter", """
SELECT 'whole' AS kind, date, round(workplaces_percent_change_from_baseline, 6) AS work FROM mobility
WHERE country_region = 'Philippines' AND coalesce(metro_area, '') = '' AND coalesce(sub_region_1, '') = ''
UNION ALL SELECT 'part', date, round(workplaces_percent_change_from_baseline, 6) FROM mobility
WHERE country_region = 'Philippines' AND sub_region_1 = 'Calabarzon'""", ["mobility"])
def geography_filter(spark, folder):
    """The country as a whole, with empty and missing names alike, and one part of it."""
    rows = views.mobility(spark, folder)
    work = F.col("workplaces_percent_change_from_baseline").alias("work")
    whole = rows.where(area("Philippines")).select(F.lit("whole").alias("kind"), "date", work)
    part = rows.where(area("Philippines", "Calabarzon")).select(F.lit("part").alias("kind"), "date", work)
    return rounded(whole.unionByName(part), "work")


@query("rows_at_max", """
SELECT region, date, n FROM (SELECT *, max(n) OVER (PARTITION BY region) AS top FROM (
  SELECT region, report AS date, count(*) AS n FROM line_list WHERE report IS NOT NULL GROUP BY ALL))
WHERE n = top""", ["line_list"])
def at_max(spark, folder):
    daily = daily_counts(views.line_list(spark, folder), ["region"], {"cases": "report"})
    return rows_at_max(daily.select("region", "date", F.col("values").alias("n")), ["region"], "n")


# Aggregates


@query("daily_count", """
SELECT CAST(onset - DATE '1994-12-31' AS INTEGER) AS times, count(*) AS n FROM line_list GROUP BY ALL""", ["line_list"])
def daily_count(spark, folder):
    """Rows per day; cases without a date are a group."""
    rows = views.line_list(spark, folder).groupBy(day_offset("onset", EPOCH).alias("times"))
    return rows.agg(row_count().alias("n"))


@query("daily_count_by_region", """
SELECT 'deaths' AS series, region, died AS date, count(*) AS values FROM line_list
WHERE died IS NOT NULL GROUP BY ALL
UNION ALL SELECT 'notifications', region, admitted, count(*) FROM line_list
WHERE admitted IS NOT NULL GROUP BY ALL""", ["line_list"])
def daily_count_by_region(spark, folder):
    return daily_counts(
        views.line_list(spark, folder), ["region"], {"notifications": "admitted", "deaths": "died"}
    )


@query("strict_sum", """
SELECT region, reportdate, CAST(CASE WHEN count(*) = count(icu_o) THEN sum(icu_o) END AS BIGINT) AS icu
FROM hospital GROUP BY ALL""", ["hospital"])
def strict(spark, folder):
    return views.hospital(spark, folder).groupBy("region", "reportdate").agg(strict_sum("icu_o").alias("icu"))


@query("skip_na_sum", """
SELECT facility, reportdate, CAST(coalesce(sum(icu_o), 0) AS BIGINT) AS icu FROM hospital GROUP BY ALL""", ["hospital"])
def skip(spark, folder):
    return views.hospital(spark, folder).groupBy("facility", "reportdate").agg(skip_sum("icu_o").alias("icu"))


@query("national_and_regional", """
SELECT CASE WHEN grouping(region) = 1 THEN 'philippines' ELSE region END AS region, report AS date,
  count(*) AS n, count(admitted) AS admitted, round(avg(age), 6) AS age
FROM line_list GROUP BY GROUPING SETS ((region, report), (report))""", ["line_list"])
def nation_and_regions(spark, folder):
    """One aggregation for both levels; cases without a region are a region of their own."""
    rows = views.line_list(spark, folder).withColumn("date", F.col("report"))
    out = national_and_regional(
        rows, ["region", "date"], views.NATIONAL,
        [row_count().alias("n"), F.count("admitted").alias("admitted"), F.avg("age").alias("age")],
    )
    return rounded(out, "age")


@query("national_from_regions", """
SELECT 'notifications' AS series, CASE WHEN grouping(region) = 1 THEN 'philippines' ELSE region END AS region,
  admitted AS date, count(*) AS values
FROM line_list WHERE admitted IS NOT NULL GROUP BY GROUPING SETS ((region, admitted), (admitted))""", ["line_list"])
def nation_from_regions(spark, folder):
    """The same for counts: regional days are formed first and summed to the nation."""
    daily = daily_counts(views.line_list(spark, folder), ["region"], {"notifications": "admitted"})
    return with_national(daily, ["series", "region", "date"], views.NATIONAL)


@query("skip_na_mean", """
SELECT region, round(avg(report - admitted), 6) AS lag, round_even(avg(report - admitted), 0) AS days
FROM line_list GROUP BY ALL""", ["line_list"])
def skip_na_mean(spark, folder):
    lag = F.avg(F.datediff("report", "admitted"))
    out = views.line_list(spark, folder).groupBy("region").agg(lag.alias("lag"), half_even(lag).alias("days"))
    return rounded(out, "lag")


@query("non_missing_count", """
SELECT region, count(report) AS reported, count(*) AS rows FROM line_list GROUP BY ALL""", ["line_list"])
def non_missing_count(spark, folder):
    return views.line_list(spark, folder).groupBy("region").agg(
        F.count("report").alias("reported"), row_count().alias("rows")
    )


@query("quantiles", """
SELECT region, name, round(quantile_cont(value, 0.025), 9) AS q025, round(quantile_cont(value, 0.25), 9) AS q25,
  round(quantile_cont(value, 0.5), 9) AS q50, round(quantile_cont(value, 0.75), 9) AS q75,
  round(quantile_cont(value, 0.975), 9) AS q975
FROM draws GROUP BY ALL""", ["draws"])
def quantiles(spark, folder):
    """Exact quantiles of groups without a size bound, in two passes."""
    rows = model_table(views.draws_raw(spark, folder))
    probs = {0.025: "q025", 0.25: "q25", 0.5: "q50", 0.75: "q75", 0.975: "q975"}
    return rounded(exact_quantiles(rows, ["region", "name"], "value", probs), *probs.values(), digits=9)


@query("quantiles_ungrouped", """
SELECT quantile_cont(l_quantity, 0.025) AS q025, quantile_cont(l_quantity, 0.5) AS q50,
  quantile_cont(l_quantity, 0.975) AS q975 FROM lineitem""")
def quantiles_ungrouped(spark, folder):
    return exact_quantiles(
        views.table(spark, folder, "lineitem"), [], "l_quantity", {0.025: "q025", 0.5: "q50", 0.975: "q975"}
    )


@query("quantiles_bounded", """
SELECT region, type, times, round(quantile_cont(value, 0.025), 8) AS q025, round(quantile_cont(value, 0.5), 8) AS q50
FROM uncertainty GROUP BY ALL""", ["uncertainty"])
def quantiles_bounded(spark, folder):
    """Quantiles of small groups: the model's rows of one day."""
    out = uncertainty(spark, folder).groupBy("region", "type", "times").agg(
        *bounded_quantiles("value", {0.025: "q025", 0.5: "q50"})
    )
    return rounded(out, "q025", "q50", digits=8)


@query("group_share", """
SELECT region, name, n, total, round(n / total, 9) AS share FROM (
  SELECT *, CAST(sum(n) OVER (PARTITION BY region) AS BIGINT) AS total FROM (
    SELECT region, name, count(*) AS n FROM draws GROUP BY ALL))""", ["draws"])
def group_share(spark, folder):
    rows = model_table(views.draws_raw(spark, folder)).groupBy("region", "name").agg(row_count().alias("n"))
    return rounded(share_of_total(rows, "region", "n", "total", "share"), "share", digits=9)


@query("calibration_text_wide", """
SELECT series, string_agg(CAST(t AS VARCHAR), ', ' ORDER BY t) AS times_wide,
  string_agg(CAST(n AS VARCHAR), ', ' ORDER BY t) AS values_plain,
  string_agg('[' || n || ']', ',' ORDER BY t) AS values_wide
FROM (SELECT 'onset' AS series, CAST(onset - DATE '1994-12-31' AS INTEGER) AS t, count(*) AS n FROM line_list GROUP BY ALL)
WHERE t > 40 GROUP BY ALL""", ["line_list"])
def calibration_text_wide(spark, folder):
    daily = daily_counts(views.line_list(spark, folder), [], {"onset": "onset"})
    series = daily.select("series", day_offset("date", EPOCH).alias("times"), "values")
    return ordered_text(series.where(F.col("times") > 40), ["series"])


@query("regression_fit", """
SELECT region, times, CAST(n AS BIGINT) AS n, CASE WHEN n > 2 THEN round(1 - (1 - r2) * (n - 1) / (n - 2), 6) END AS adj_r2,
  round(r2, 6) AS r2
FROM (SELECT l_suppkey AS region, CAST(l_linenumber AS INTEGER) AS times,
    regr_count(l_extendedprice, CASE WHEN l_partkey % 7 <> 0 THEN l_quantity END) AS n,
    regr_r2(l_extendedprice, CASE WHEN l_partkey % 7 <> 0 THEN l_quantity END) AS r2
  FROM lineitem GROUP BY ALL)""")
def regression_fit(spark, folder):
    """Fit over complete pairs only."""
    x = F.when(F.col("l_partkey") % 7 != 0, F.col("l_quantity"))
    out = views.table(spark, folder, "lineitem").groupBy(
        F.col("l_suppkey").alias("region"), F.col("l_linenumber").alias("times")
    ).agg(
        F.regr_count("l_extendedprice", x).alias("n"),
        adjusted_r2("l_extendedprice", x).alias("adj_r2"), F.regr_r2("l_extendedprice", x).alias("r2"),
    )
    return rounded(out, "adj_r2", "r2")


@query("regression_two", """
WITH m AS (SELECT l_returnflag AS flag, count(*) AS n, covar_pop(l_quantity, l_quantity) AS aa, covar_pop(l_discount, l_discount) AS bb,
  covar_pop(l_quantity, l_discount) AS ab, covar_pop(l_quantity, l_extendedprice) AS ay, covar_pop(l_discount, l_extendedprice) AS by_,
  var_pop(l_extendedprice) AS yy, avg(l_quantity) AS a, avg(l_discount) AS b, avg(l_extendedprice) AS y FROM lineitem GROUP BY ALL),
s AS (SELECT *, (ay * bb - by_ * ab) / (aa * bb - ab * ab) AS p, (by_ * aa - ay * ab) / (aa * bb - ab * ab) AS q FROM m),
r AS (SELECT *, (p * ay + q * by_) / yy AS r2 FROM s)
SELECT flag, n, round(y - p * a - q * b, 3) AS intercept, round(p, 3) AS slope_quantity, round(q, 3) AS slope_discount,
  round(r2, 9) AS r2, round(1 - (1 - r2) * (n - 1) / (n - 3), 9) AS adj_r2 FROM r""")
def regression_two(spark, folder):
    """Two regressors, by group, from merged sums."""
    rows = views.table(spark, folder, "lineitem").selectExpr(
        "l_returnflag AS flag", "l_extendedprice AS price", "l_quantity AS quantity", "l_discount AS discount"
    )
    out = least_squares(rows, ["flag"], "price", ["quantity", "discount"])
    return rounded(rounded(out, "intercept", "slope_quantity", "slope_discount", digits=3), "r2", "adj_r2", digits=9)


@query("column_extremes", """
SELECT region, max(admitted) AS last, count(DISTINCT admitted) AS days, count(*) AS rows FROM line_list GROUP BY ALL""",
       ["line_list"])
def column_extremes(spark, folder):
    """Maximum, row count and distinct days; the days are made distinct before they are counted."""
    daily = views.line_list(spark, folder).groupBy("region", "admitted").agg(row_count().alias("n"))
    return daily.groupBy("region").agg(
        F.max("admitted").alias("last"), F.count("admitted").alias("days"), F.sum("n").alias("rows")
    )


@query("distinct_values", "SELECT DISTINCT region, report FROM line_list", ["line_list"])
def distinct_values(spark, folder):
    return views.line_list(spark, folder).select("region", "report").distinct()


# Series


@query("gap_filled_series", """
WITH d AS (SELECT region, died AS date, count(*) AS n FROM line_list WHERE died IS NOT NULL GROUP BY ALL),
g AS (SELECT region, CAST(unnest(generate_series(min(date), max(date), INTERVAL 1 DAY)) AS DATE) AS date FROM d GROUP BY region)
SELECT g.region, g.date, d.n AS values FROM g LEFT JOIN d ON g.region IS NOT DISTINCT FROM d.region AND g.date = d.date""",
       ["line_list"])
def gap_filled_series(spark, folder):
    daily = daily_counts(views.line_list(spark, folder), ["region"], {"deaths": "died"})
    return fill_days(daily, ["region"])


@query("rolling7_left", """
WITH d AS (SELECT region, died AS date, count(*) AS n FROM line_list WHERE died IS NOT NULL GROUP BY ALL),
g AS (SELECT region, CAST(unnest(generate_series(min(date), max(date), INTERVAL 1 DAY)) AS DATE) AS date FROM d GROUP BY region),
f AS (SELECT g.region, g.date, d.n FROM g LEFT JOIN d ON g.region IS NOT DISTINCT FROM d.region AND g.date = d.date)
SELECT region, date, CASE WHEN count(*) OVER w = 7 THEN round(avg(n) OVER w, 6) END AS mean FROM f
WINDOW w AS (PARTITION BY region ORDER BY date ROWS BETWEEN CURRENT ROW AND 6 FOLLOWING)""", ["line_list"])
def rolling7_left(spark, folder):
    """Missing days are missing in the mean, not zero."""
    daily = daily_counts(views.line_list(spark, folder), ["region"], {"deaths": "died"})
    days = fill_days(daily, ["region"])
    return rounded(days.select("region", "date", rolling(["region"], "date", "values", 7).alias("mean")), "mean")


@query("rolling20_center", """
SELECT region, date, CASE WHEN count(*) OVER w = 20 THEN round(avg(n) OVER w, 6) END AS mean,
  CASE WHEN count(*) OVER w = 20 THEN max(n) OVER w END AS top
FROM (SELECT region, report AS date, count(*) AS n FROM line_list WHERE report IS NOT NULL GROUP BY ALL)
WINDOW w AS (PARTITION BY region ORDER BY date ROWS BETWEEN 9 PRECEDING AND 10 FOLLOWING)""", ["line_list"])
def rolling20_center(spark, folder):
    """The aggregate is an argument."""
    daily = daily_counts(views.line_list(spark, folder), ["region"], {"cases": "report"})
    out = daily.select(
        "region", "date", rolling(["region"], "date", "values", 20, "center").alias("mean"),
        rolling(["region"], "date", "values", 20, "center", agg=F.max).alias("top"),
    )
    return rounded(out, "mean")


@query("weekly_mean", """
SELECT region, max(date) AS date, round(avg(icu), 6) AS values FROM (
  SELECT region, reportdate AS date, coalesce(sum(icu_o), 0) AS icu FROM hospital
  WHERE reportdate IS NOT NULL GROUP BY ALL)
GROUP BY region, date_trunc('week', date)""", ["hospital"])
def weekly_mean(spark, folder):
    daily = views.hospital(spark, folder).where(F.col("reportdate").isNotNull()).groupBy(
        "region", F.col("reportdate").alias("date")
    ).agg(skip_sum("icu_o").alias("values"))
    return rounded(weekly(daily, ["region"]), "values")


@query("last_observed", """
SELECT model_run_date, arg_max(date, {'region': region, 'times': times}) AS cutoff FROM archived_runs
WHERE local_data_notifications IS NOT NULL GROUP BY ALL""", ["archived_runs"])
def observed_last(spark, folder):
    return last_observed(
        views.archived_runs(spark, folder), ["model_run_date"], ["region", "times"], "local_data_notifications",
        "date", "cutoff",
    )


@query("carry_forward", """
WITH k AS (SELECT * FROM behaviour WHERE times <= 1484)
SELECT times, round(inverse_mhs_values, 6) AS value, false AS extended FROM k
UNION ALL SELECT CAST(unnest(generate_series((SELECT max(times) + 1 FROM k), 1510)) AS INTEGER),
  (SELECT round(arg_max(inverse_mhs_values, times), 6) FROM k), true""", ["behaviour"])
def carried(spark, folder):
    curve = views.behaviour(spark, folder).where(offset_between(upper=1484))
    out = carry_forward(curve, F.lit(1510), "times", "inverse_mhs_values")
    return rounded(out.withColumnRenamed("inverse_mhs_values", "value"), "value")


@query("sampled_rows", """
SELECT region, draw_id, CAST(id AS INTEGER) AS id FROM (
  SELECT *, row_number() OVER (PARTITION BY region ORDER BY md5(draw_id || '|7'), draw_id) AS id FROM draws)
WHERE id <= 500""", ["draws"])
def sampled_rows(spark, folder):
    """500 rows of each region without replacement, the same ones on every run."""
    rows = model_table(views.draws_raw(spark, folder)).select("region", "draw_id")
    return sample_rows(rows, ["region"], 500, "draw_id", 7)


# Reshaping


@query("quantile_band", """
SELECT region, scenario, type, times, date, round(max(CASE WHEN quantile = 0.025 THEN value END), 6) AS q025,
  round(max(CASE WHEN quantile = 0.25 THEN value END), 6) AS q25,
  round(max(CASE WHEN quantile = 0.5 THEN value END), 6) AS q50,
  round(max(CASE WHEN quantile = 0.75 THEN value END), 6) AS q75,
  round(max(CASE WHEN quantile = 0.975 THEN value END), 6) AS q975
FROM uncertainty GROUP BY ALL""", ["uncertainty"])
def quantile_band(spark, folder):
    wide = quantile_wide(uncertainty(spark, folder), ["region", "scenario", "type", "times", "date"])
    return rounded(wide, "q025", "q25", "q50", "q75", "q975")


@query("type_quantile_wide", f"""
SELECT region, scenario, times, {", ".join(
    f"round(max(CASE WHEN type = '{t}' AND quantile = {q} THEN value END), 6) AS {t}_{n}"
    for t in views.OUTPUTS.values() for q, n in ((0.25, "q25"), (0.5, "q50"), (0.75, "q75")))}
FROM uncertainty WHERE type IN ('notifications', 'icu_occupancy', 'accum_deaths') AND quantile IN (0.25, 0.5, 0.75)
GROUP BY ALL""", ["uncertainty"])
def by_type_and_quantile(spark, folder):
    wide = type_quantile_wide(uncertainty(spark, folder), ["region", "scenario", "times"], list(views.OUTPUTS.values()))
    return rounded(wide, *[c for c in wide.columns if "_q" in c])


@query("wide_to_long", f"""
SELECT country_region, sub_region_1, metro_area, date, location, round(percent, 6) AS percent
FROM mobility UNPIVOT INCLUDE NULLS (percent FOR location IN ({", ".join(views.MOBILITY_COLUMNS)}))""",
       ["mobility"])
def wide_to_long(spark, folder):
    long = to_long(
        views.mobility(spark, folder), ["country_region", "sub_region_1", "metro_area", "date"],
        views.MOBILITY_COLUMNS, "location", "percent",
    )
    return rounded(long, "percent")


# Joins


@query("null_safe_join", """
SELECT a.region, a.n AS cases, b.n AS deaths FROM (SELECT region, count(*) AS n FROM line_list GROUP BY ALL) a
LEFT JOIN (SELECT region, count(*) AS n FROM line_list WHERE died IS NOT NULL GROUP BY ALL) b
  ON a.region IS NOT DISTINCT FROM b.region""", ["line_list"])
def null_safe_join(spark, folder):
    """A missing key meets a missing key."""
    rows = views.line_list(spark, folder)
    cases = rows.groupBy("region").agg(row_count().alias("cases"))
    deaths = rows.where(F.col("died").isNotNull()).groupBy("region").agg(row_count().alias("deaths"))
    return join_null_safe(cases, deaths, ["region"])


@query("reported_wide", """
SELECT coalesce(n.region, i.region, d.region) AS region, coalesce(n.times, i.times, d.times) AS times,
  n.value AS local_data_notifications, i.value AS local_data_icu, d.value AS local_data_deaths
FROM (SELECT * FROM reported WHERE type = 'notifications') n
FULL JOIN (SELECT * FROM reported WHERE type = 'icu_occupancy') i ON n.region = i.region AND n.times = i.times
FULL JOIN (SELECT * FROM reported WHERE type = 'accum_deaths') d
  ON coalesce(n.region, i.region) = d.region AND coalesce(n.times, i.times) = d.times""", ["reported"])
def reported_wide(spark, folder):
    """Three series side by side as a chain of full joins gives them."""
    names = {o: f"local_data_{m}" for m, o in views.OUTPUTS.items()}
    return merge_series(reported(spark, folder), ["region", "times"], "type", "value", names)


@query("left_join_reported", """
SELECT u.region, u.times, u.type, u.scenario, r.value AS reported
FROM (SELECT DISTINCT region, times, type, scenario FROM uncertainty) u
LEFT JOIN reported r ON u.region = r.region AND u.times = r.times AND u.type = r.type""", ["uncertainty", "reported"])
def left_join_reported(spark, folder):
    keys = uncertainty(spark, folder).where(F.col("quantile") == 0.5).select("region", "times", "type", "scenario")
    observed = reported(spark, folder).withColumnRenamed("value", "reported")
    return keys.join(observed, ["region", "times", "type"], "left")


@query("full_join_indicator", """
SELECT coalesce(u.region, r.region) AS region, coalesce(u.times, r.times) AS times, coalesce(u.type, r.type) AS type,
  round(u.value, 6) AS value, r.value AS reported
FROM (SELECT * FROM uncertainty WHERE scenario = 0 AND quantile = 0.5) u
FULL JOIN reported r ON u.region = r.region AND u.times = r.times AND u.type = r.type""", ["uncertainty", "reported"])
def full_join_indicator(spark, folder):
    model = uncertainty(spark, folder).where((F.col("scenario") == 0) & (F.col("quantile") == 0.5))
    observed = reported(spark, folder).withColumnRenamed("value", "reported")
    joined = model.select("region", "times", "type", "value").join(observed, ["region", "times", "type"], "full")
    return rounded(joined, "value")


@query("facility_join", """
SELECT region, count(*) AS rows, CAST(sum(n_tests) AS BIGINT) AS tests FROM tests JOIN facilities USING (facility)
GROUP BY ALL""", ["tests", "facilities"])
def facility_join(spark, folder):
    """Facilities missing from the list drop out; the tests are summed per facility before they meet it."""
    sums = views.tests(spark, folder).groupBy("facility").agg(row_count().alias("rows"), F.sum("n_tests").alias("tests"))
    joined = sums.join(views.facilities(spark, folder), "facility")
    return joined.groupBy("region").agg(F.sum("rows").alias("rows"), F.sum("tests").alias("tests"))


@query("peak_semi_join", """
WITH m AS (SELECT region, type, times, quantile_cont(value, 0.5) AS q50 FROM uncertainty GROUP BY ALL),
p AS (SELECT region, type, times FROM (SELECT *, max(q50) OVER (PARTITION BY region, type) AS top FROM m) WHERE q50 = top)
SELECT u.region, u.type, u.times, count(*) AS rows, round(max(value), 6) AS top FROM uncertainty u SEMI JOIN p
  ON u.region = p.region AND u.type = p.type AND u.times = p.times GROUP BY ALL""", ["uncertainty"])
def peak_semi_join(spark, folder):
    rows = uncertainty(spark, folder)
    medians = rows.groupBy("region", "type", "times").agg(*bounded_quantiles("value", {0.5: "q50"}))
    peaks = rows_at_max(medians, ["region", "type"], "q50")
    kept = rows.join(peaks, ["region", "type", "times"], "left_semi")
    out = kept.groupBy("region", "type", "times").agg(row_count().alias("rows"), F.max("value").alias("top"))
    return rounded(out, "top")


