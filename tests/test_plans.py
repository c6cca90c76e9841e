"""Reports on small tables, and the shape of their plans."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from epitally.functions.numbers import half_even
from epitally.operators.filters import in_regions
from epitally.plans import ages, calibration, scenarios, testing, validation
from epitally.sources.readers import read_archive
from epitally.sources.writers import append_run

D = dt.date
CASES = "region string, admitted date, report date, died date"


def test_imputation_by_lag_of_the_region(spark, rows):
    data = [
        ("a", D(2020, 5, 1), D(2020, 5, 3), None),
        ("a", D(2020, 5, 1), D(2020, 5, 4), None),
        ("a", None, D(2020, 5, 10), D(2020, 5, 20)),
        (None, D(2020, 5, 1), D(2020, 5, 2), None),
        (None, None, D(2020, 5, 10), None),
        ("b", None, D(2020, 5, 10), None),
    ]
    cases = spark.createDataFrame(data, CASES)
    out = calibration.impute_admission(cases).where("admitted IS NULL").select("region", "region_lag",
                                                                                "admitted_adjusted")
    assert rows(out, "region") == [(None, 1, D(2020, 5, 9)), ("a", 2, D(2020, 5, 8)), ("b", None, None)]


def test_counts_in_one_scan_equal_counts_of_imputed_cases(spark, folder, rows, plan):
    path = f"{folder}/cases"
    (
        spark.range(5000)
        .selectExpr(
            "CASE id % 4 WHEN 0 THEN NULL WHEN 1 THEN 'a' ELSE 'b' END AS region",
            "CASE WHEN id % 3 > 0 THEN date_add(DATE'2020-03-01', CAST(id % 50 AS INT)) END AS admitted",
            "CASE WHEN id % 7 > 0 THEN date_add(DATE'2020-03-04', CAST(id % 50 + id % 5 AS INT)) END AS report",
            "CASE WHEN id % 11 = 0 THEN date_add(DATE'2020-03-20', CAST(id % 50 AS INT)) END AS died",
            "repeat('x', 50) AS unused",
        )
        .write.parquet(path)
    )
    cases = spark.read.parquet(path)
    counted = calibration.imputed_daily(cases)
    imputed = calibration.impute_admission(cases)
    slow = (
        imputed.where("admitted_adjusted IS NOT NULL")
        .groupBy("region", F.lit("notifications").alias("series"), F.col("admitted_adjusted").alias("date"))
        .agg(F.count(F.lit(1)).alias("values"))
        .unionByName(
            imputed.where("died IS NOT NULL")
            .groupBy("region", F.lit("deaths").alias("series"), F.col("died").alias("date"))
            .agg(F.count(F.lit(1)).alias("values"))
        )
    )
    order = ("region", "series", "date", "values")
    assert rows(counted.select(*order), *order) == rows(slow.select(*order), *order)
    text = plan(counted)
    final = text.split("== Initial Plan ==")[0]
    assert final.count("FileScan parquet") == 1
    assert "unused" not in text


def test_region_filter_reaches_the_scan(spark, folder, plan):
    path = f"{folder}/cases"
    spark.createDataFrame([("a", D(2020, 5, 1), D(2020, 5, 3), None)], CASES).write.parquet(path)
    cases = spark.read.parquet(path).where(in_regions(["a", "b"]))
    text = plan(calibration.imputed_regional(calibration.imputed_daily(cases)))
    assert "PushedFilters: [In(region, [a,b])]" in text


def test_padding_width_is_shared(spark, rows):
    df = spark.createDataFrame([("a", 9, 5), ("b", 10, 123)], "region string, times int, values long")
    out = calibration.padded_series(df, before="  ").select("region", "times", "values", "values_bracketed")
    assert rows(out, "region") == [
        ("a", "   9,", "       5,", "     [  5],"),
        ("b", "  10,", "     123,", "     [123],"),
    ]


def test_wide_text_is_made_once_per_group(spark, plan):
    df = spark.range(30).selectExpr("'a' AS region", "CAST(id AS INT) AS times", "id AS values")
    text = plan(calibration.with_wide_text(df, ["region"]).select("region", "times", "times_wide"))
    # The text is below the generator in the plan, that is after it in the tree.
    assert text.index("Generate explode") < text.index("array_join")


RUN = ("model_run_date date, data_acquired_date date, region string, scenario string, times int, date date, "
       "local_data_notifications double, local_data_icu double, local_data_deaths double, "
       "n_q25 double, n_q50 double, n_q75 double")


def runs(spark):
    old, new = D(2020, 8, 1), D(2020, 8, 8)
    data = []
    for run, seen in ((old, 3), (new, 6)):
        for t in range(1, 8):
            value = float(t) if t <= seen else None
            data.append((run, run, "a", "S_0", t, old + dt.timedelta(t), value, value, value, t - 1.0, t * 1.0, t + 1.0))
    return spark.createDataFrame(data, RUN)


def test_backfill_takes_newer_values_after_the_cutoff(spark, rows):
    out = validation.backfill_runs(runs(spark)).where(F.col("model_run_date") == D(2020, 8, 1))
    got = rows(out.select("times", "local_data_notifications", "data_acquired_date"), "times")
    old, new = D(2020, 8, 1), D(2020, 8, 8)
    assert got == [
        (1, 1.0, old), (2, 2.0, old), (3, 3.0, new), (4, 4.0, new), (5, 5.0, new), (6, 6.0, new), (7, None, new),
    ]


def test_backfill_keeps_days_of_the_latest_run_only(spark, rows):
    base = runs(spark)
    extra = base.where("times = 7 AND model_run_date = DATE'2020-08-08'").withColumns(
        {"times": F.lit(8), "date": F.lit(D(2020, 8, 9))}
    )
    out = validation.backfill_runs(base.unionByName(extra)).where("date = DATE'2020-08-09'")
    assert rows(out.select("model_run_date", "times", "local_data_icu"), "model_run_date") == [
        (D(2020, 8, 1), None, None), (D(2020, 8, 8), 8, None),
    ]


def test_backfill_of_one_scenario_reads_only_it(spark, folder, rows, plan):
    base = runs(spark)
    other = base.withColumns({"scenario": F.lit("S_1"), "local_data_icu": F.col("local_data_icu") + 100})
    append_run(base.unionByName(other), f"{folder}/archive")
    archive = read_archive(spark, f"{folder}/archive")
    one = validation.backfill_runs(archive, scenario="S_0")
    order = ["model_run_date", "times"]
    assert rows(one, *order) == rows(validation.backfill_runs(archive).where("scenario = 'S_0'"), *order)
    scans = [x for x in plan(one).split("== Initial Plan ==")[0].splitlines() if "FileScan" in x and "scenario" in x]
    assert 0 < len(scans) <= 4 and all("EqualTo(scenario,S_0)" in x for x in scans)


def test_cells_of_equal_width_take_one_scan(spark, folder, plan):
    spark.sql("SELECT 'a' AS region, DATE'2020-08-01' AS reportdate, 7 AS icu_o").write.parquet(f"{folder}/beds")
    daily = calibration.icu_daily(spark.read.parquet(f"{folder}/beds"), ["region"])
    text = plan(calibration.icu_regional(daily, D(2019, 12, 31)))
    assert text.split("== Initial Plan ==")[0].count("FileScan") == 1


def test_first_day_of_daily_text_reaches_the_scan(spark, folder, plan):
    spark.sql("SELECT DATE'2020-08-01' AS onset").write.parquet(f"{folder}/cases")
    cases = spark.read.parquet(f"{folder}/cases")
    text = plan(calibration.daily_text(cases, {"notifications": "onset"}, D(2019, 12, 31)))
    assert "GreaterThan(onset,2020-02-09)" in text


def test_split_and_fit(spark, rows):
    base = runs(spark)
    outputs = {"notifications": "n"}
    split = validation.calibrated_split(validation.backfill_runs(base), "S_0", validation.latest_run(base), outputs)
    got = rows(split.groupBy("model_run_date", "model").count(), "model_run_date", "model")
    assert got == [
        (D(2020, 8, 1), "calibrated", 2), (D(2020, 8, 1), "uncalibrated", 5),
        (D(2020, 8, 8), "calibrated", 6), (D(2020, 8, 8), "uncalibrated", 1),
    ]
    assert [r.adj_r2 for r in validation.fit(split).collect()] == pytest.approx([1.0, 1.0])


def test_band_from_order_statistics_equals_band_of_all_rates(spark):
    draws = spark.range(700).selectExpr(
        "CASE WHEN id % 3 = 0 THEN 'a' ELSE 'b' END AS region", "id AS draw_id",
        "'testing_to_detection.assumed_cdr_parameter' AS name", "0.02 + (id * 7919 % 1000) / 10000.0D AS value",
    )
    tests = spark.range(120).selectExpr(
        "CASE WHEN id % 2 = 0 THEN 'a' ELSE 'b' END AS region", "date_add(DATE'2020-03-01', CAST(id AS INT)) AS report_date",
        "id AS tests",
    )
    population = spark.createDataFrame([("a", 3.0), ("b", 5.0)], "region string, population double")
    rated = testing.per_capita_tests(tests, population)
    sampled = testing.detection_draws(draws, seed=1, n=100)
    scale = {"b": 0.5}
    order = ["region", "report_date"]
    fast = testing.detection_band(sampled, rated, scale).orderBy(*order).collect()
    slow = testing.detection_band_of_rates(testing.detection_rates(sampled, rated, scale)).orderBy(*order).collect()
    assert len(fast) == len(slow) == 120
    for f, s in zip(fast, slow):
        assert f.region == s.region and f.report_date == s.report_date
        for q in ("q025", "q25", "q50", "q75", "q975"):
            assert (f[q] is None) == (s[q] is None)
            assert f[q] is None or f[q] == pytest.approx(s[q], abs=1e-12)


def test_long_facility_lists_are_not_broadcast(spark, rows):
    tests = spark.createDataFrame([(1, D(2020, 1, 1), 5), (1, D(2020, 1, 1), None), (2, D(2020, 1, 1), 1),
                                   (3, D(2020, 1, 1), 9)], "facility long, report_date date, n_tests int")
    places = spark.createDataFrame([(1, "a"), (2, "b")], "facility long, region string")
    want = [("a", 5), ("b", 1), ("nation", 6)]
    out = testing.tests_by_region(tests, places, "nation").select("region", "tests")
    assert rows(out, "region") == want
    limit = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        shuffled = testing.tests_by_region(tests, places, "nation").select("region", "tests")
        assert "BroadcastHashJoin" not in shuffled._jdf.queryExecution().executedPlan().toString()
        assert rows(shuffled, "region") == want
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)


def test_band_of_negative_tests_or_scale_is_that_of_the_rates(spark):
    sampled = spark.createDataFrame([("a", i, 0.1 * i) for i in range(1, 8)], "region string, id int, value double")
    tests = spark.createDataFrame(
        [("a", D(2020, 1, d), v) for d, v in ((1, 2.0), (2, -1.5), (3, 0.0), (4, None))],
        "region string, report_date date, smoothed double",
    )
    for scale in (None, {"a": -0.5}, {"a": 2.0}):
        fast = testing.detection_band(sampled, tests, scale).orderBy("report_date").collect()
        slow = testing.detection_band_of_rates(testing.detection_rates(sampled, tests, scale))
        for f, s in zip(fast, slow.orderBy("report_date").collect()):
            for q in ("q025", "q25", "q50", "q75", "q975"):
                assert (f[q] is None) == (s[q] is None)
                assert f[q] is None or f[q] == pytest.approx(s[q], abs=1e-12)


def test_positivity_of_a_day_with_a_bad_text(spark, rows):
    df = spark.createDataFrame(
        [("June 5, 2020", "1,000", "250", "750"), ("JUNE 5, 2020", "200", "50", "150"), ("June 6, 2020", "n/a", "1", "2")],
        "date string, tested string, positive string, negative string",
    )
    assert rows(testing.test_totals(df), "date") == [
        (D(2020, 6, 5), 1200.0, 300.0, 900.0, 0.25, 0.75), (D(2020, 6, 6), None, 1.0, 2.0, None, None),
    ]


def test_age_shares_leave_out_unknown_ages(spark, rows):
    df = spark.createDataFrame(
        [("a", 3.0, D(2020, 1, 1)), ("a", 3.0, None), ("a", 80.0, D(2020, 1, 1)), ("a", 4.5, D(2020, 1, 1)),
         ("z", 3.0, D(2020, 1, 1))], "region string, age double, report date",
    )
    out = ages.reported_age_share(df, ["a"], "nation").select("region", "age_group", "cases", "total_cases")
    assert rows(out, "region", "age_group") == [
        ("a", "0-4", 2.0, 2.0), ("a", "75+", 1.0, 2.0), ("nation", "0-4", 3.0, 3.0), ("nation", "75+", 1.0, 3.0),
    ]


def test_modelled_shares_by_scenario(spark, rows):
    df = spark.createDataFrame(
        [("a", 0, 1.0, 3.0), ("a", 1, 6.0, 0.0)],
        "region string, scenario int, notificationsXagegroup_0 double, notificationsXagegroup_75 double",
    )
    got = rows(ages.modelled_age_share(df).select("age_group", "share"), "age_group")
    assert got == [("0-4", 0.25), ("75+", 0.75)]
    got = rows(ages.modelled_age_share(df, None).select("age_group", "cases"), "age_group")
    assert got == [("0-4", 7.0), ("75+", 3.0)]


def test_tied_peak_days_are_pooled(spark, rows):
    data = [("P", "incidence", D(2020, 1, d), 0, q, v) for d, m in ((1, 5.0), (2, 5.0), (3, 1.0))
            for q, v in ((0.25, m - 1), (0.5, m), (0.75, m + 1))]
    df = spark.createDataFrame(data, "region string, type string, date date, scenario int, quantile double, value double")
    assert scenarios.incidence_peak(df, "P", D(2020, 2, 1)).count() == 2
    row = scenarios.incidence_peak_interval(df, "P", D(2020, 2, 1)).first()
    assert (row.peak_date, row.q50) == (D(2020, 1, 2), 5.0)


def test_half_even_lag_of_two_and_three(spark):
    assert spark.createDataFrame([(2,), (3,)], "v int").agg(half_even(F.avg("v"))).first()[0] == 2


def test_national_beds_from_regional_days(spark, rows):
    day = D(2020, 5, 1)
    data = [("a", day, 3), ("a", day, 4), (None, day, 5), ("a", D(2020, 5, 2), 1), ("b", D(2020, 5, 2), None),
            ("a", None, 9)]
    hospital = spark.createDataFrame(data, "region string, reportdate date, icu_o int")
    want = [(day, 12), (D(2020, 5, 2), None)]
    assert rows(calibration.icu_daily(hospital).select("date", "values"), "date") == want
    daily = calibration.icu_daily(hospital, ["region"])
    assert rows(calibration.national_beds(daily).select("date", "values"), "date") == want


def test_counts_stop_at_the_bound_of_each_date(spark, folder, rows, plan):
    path = f"{folder}/cases"
    spark.createDataFrame([("a", D(2020, 5, 1), None, D(2020, 6, 1)), ("a", D(2020, 6, 2), None, None)], CASES) \
        .write.parquet(path)
    cases = spark.read.parquet(path)
    out = calibration.case_days(cases, D(2020, 5, 31))
    assert rows(out.select("series", "date", "values")) == [("notifications", D(2020, 5, 1), 1)]
    assert "PushedFilters: [Or(LessThanOrEqual(admitted,2020-05-31),LessThanOrEqual(died,2020-05-31))]" in plan(out)
