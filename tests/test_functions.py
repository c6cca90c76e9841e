"""Scalar rules on hand-written values."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from epitally.functions import bands, dates, labels, numbers, text

D = dt.date


def values(spark, schema, data, column):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(data)], f"i int, v {schema}")
    return [r[0] for r in df.orderBy("i").select(column.alias("x")).collect()]


def test_iso_dates(spark):
    data = ["2020-06-01", "2020-6-1", "2020-06-01T10:00", "2020-06-01 x", "2020-6-1 09:00", " 2020-06-01", "2020-06",
            "2020", "", "01/06/2020", "2020-13-01", "2020-02-30", None]
    want = [D(2020, 6, 1)] * 6 + [None] * 7
    assert values(spark, "string", data, dates.parse_iso_date("v")) == want


def test_us_dates(spark):
    data = ["6/1/2020", "06/01/2020", "06/01/2020 10:00", "2020-06-01", "13/1/2020", "", None]
    assert values(spark, "string", data, dates.parse_us_date("v")) == [D(2020, 6, 1)] * 3 + [None] * 4


def test_long_dates(spark):
    data = ["June 5, 2020", "JUNE 05, 2020", "Jun 5, 2020", "june 5, 2020 x", "5 June 2020", None]
    assert values(spark, "string", data, dates.parse_long_date("v")) == [D(2020, 6, 5)] * 4 + [None] * 2


def test_offsets_follow_the_epoch(spark):
    data = [D(2020, 1, 1), None]
    assert values(spark, "date", data, dates.day_offset("v")) == [1, None]
    assert values(spark, "date", data, dates.day_offset("v", dates.EPOCH_JAN1)) == [0, None]
    assert values(spark, "int", [366], dates.offset_date("v")) == [D(2020, 12, 31)]


def test_weeks_are_rounded_half_to_even_and_not_negative(spark):
    day = D(2020, 1, 1)
    data = [day - dt.timedelta(9), day, day + dt.timedelta(4), day + dt.timedelta(17), day + dt.timedelta(18)]
    assert values(spark, "date", data, dates.weeks_after("v", F.lit(day))) == [0, 0, 1, 2, 3]


def test_half_even(spark):
    assert values(spark, "double", [0.5, 1.5, 2.5, -0.5, None], numbers.half_even("v")) == [0, 2, 2, 0, None]


def test_numbers_from_text(spark):
    data = ["1,234", "7,", "NA", "", "12", None]
    assert values(spark, "string", data, numbers.number_from_text("v")) == [1234, 7, None, None, 12, None]


def test_missing_cells_poison_row_sums(spark):
    df = spark.createDataFrame([(1.0, 2.0), (1.0, None)], "a double, b double")
    out = df.select(numbers.row_sum(["a", "b"]).alias("s"), numbers.row_mean(["a", "b"]).alias("m")).collect()
    assert [tuple(r) for r in out] == [(3.0, 1.5), (None, None)]


def test_rates(spark):
    df = spark.createDataFrame([(0.05, 10.0, 2.0)], "r double, t double, p double")
    row = df.select(numbers.detection_rate("r", "t"), numbers.per_10k("t", "p"), numbers.relative_change("t")).first()
    assert row[0] == pytest.approx(0.3934693402873666)
    assert row[1] == pytest.approx(50.0)
    assert row[2] == pytest.approx(1.1)


def test_recode_keeps_what_it_does_not_know(spark):
    out = values(spark, "string", ["4A", "NCR", "BARMM", None], labels.recode("v", labels.LINE_LIST_REGIONS))
    assert out == ["Region_IV_A_Calabarzon", "NCR", "BARMM", None]


def test_ordinals(spark):
    out = values(spark, "string", ["75+", "0-4", "100+", None], labels.ordinal("v", bands.AGE_LEVELS))
    assert out == [16, 1, None, None]


def test_age_bands(spark):
    data = [0.0, 4.0, 4.5, 5.0, 74.0, 74.5, 75.0, 101.0, -1.0, None]
    assert values(spark, "double", data, bands.age_band("v")) == [
        "0-4", "0-4", None, "5-9", "70-74", None, "75+", "75+", "0-4", None,
    ]


def test_band_of_start(spark):
    data = ["0", "5", "70", "75", "7", "x", None]
    assert values(spark, "string", data, bands.band_of_start("v")) == ["0-4", "5-9", "70-74", "75+", "7", "x", None]


def test_number_text(spark):
    assert values(spark, "double", [41.0, 2.5, None], text.with_comma("v")) == ["41,", "2.5,", None]
    cell = text.padded_cell("v", F.lit(3), "  [", "],")
    assert values(spark, "int", [7, 123], cell) == ["  [  7],", "  [123],"]


def test_numbers_with_a_letter_behind_are_none(spark):
    df = spark.createDataFrame([(v,) for v in ("1d", "2f", "3", " -4.5e2 ", ".5", "6.", "NaN", "")], "v string")
    assert [r[0] for r in df.select(numbers.to_number("v")).collect()] == [None, None, 3, -450, 0.5, 6, None, None]


def test_weeks_of_a_missing_date_are_missing(spark):
    df = spark.sql("SELECT * FROM VALUES (DATE '2020-01-01'), (NULL), (DATE '2020-01-19') AS t(d)")
    weeks = dates.weeks_after("d", F.lit("2020-01-05").cast("date"))
    assert sorted((r[0] for r in df.select(weeks).collect()), key=str) == [0.0, 2.0, None]


def test_large_whole_numbers_are_written_out(spark):
    df = spark.createDataFrame([(1e15,), (-3e20,), (2.5,), (4.0,)], "v double")
    assert [r[0] for r in df.select(text.number_text("v")).collect()] == [
        "1000000000000000", "-300000000000000000000", "2.5", "4"]
