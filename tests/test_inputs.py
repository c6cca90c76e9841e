"""Raw files, read by column name, to the tables of the reports."""

import datetime as dt
import os

from epitally.plans import inputs, testing
from epitally.sources import schemas
from epitally.sources.readers import literal_table, read_columns

D = dt.date


def file(folder, name, text):
    path = f"{folder}/{name}"
    os.makedirs(path)
    with open(f"{path}/a.csv", "w") as out:
        out.write(text)
    return path


def test_cases_by_residence(spark, folder, rows):
    path = file(folder, "c", "CaseCode,RegionRes,DateDied,DateOnset,DateRepConf\n1,NCR,,2020-05-01,2020-05-03\n")
    out = inputs.cases_by_residence(read_columns(spark, path, schemas.CASES_RESIDENCE))
    assert rows(out) == [("NCR", D(2020, 5, 3), D(2020, 5, 1), None)]


def test_cases_by_admission(spark, folder, rows):
    path = file(folder, "c", "Region,Date Admitted,Report Date,Date Recovered,Date Died,x\n4A,,5/3/2020,NA,05/20/2020,1\n")
    out = inputs.cases_by_admission(read_columns(spark, path, schemas.CASES_ADMISSION))
    assert rows(out) == [("4A", None, D(2020, 5, 3), None, D(2020, 5, 20))]


def test_cases_imputed_and_aged(spark, folder, rows):
    path = file(folder, "c", "Region,imputed_Date_Admitted,Date_Died\n07,2020-05-01,NA\n08,2020-05-02,\n")
    out = inputs.cases_imputed(read_columns(spark, path, schemas.CASES_IMPUTED))
    assert rows(out, "region") == [("08", D(2020, 5, 2), None), ("central-visayas", D(2020, 5, 1), None)]
    path = file(folder, "a", "Region,Age,Report_Date\nmanila,31,2020-05-01\nmanila,unknown,NA\n")
    out = inputs.cases_aged(read_columns(spark, path, schemas.CASES_AGED))
    assert rows(out, "age") == [
        ("National Capital Region", None, None), ("National Capital Region", 31.0, "2020-05-01"),
    ]


def test_hospital_names(spark, folder, rows):
    path = file(folder, "h", "cfname,region,reportdate,icu_o\nx,REGION IV-A (CALABAR ZON),2020-05-01 10:00,3\n")
    raw = read_columns(spark, path, schemas.HOSPITAL_DAILY)
    assert rows(inputs.hospital_daily(raw, short_names=True)) == [("calabarzon", D(2020, 5, 1), 3)]
    assert rows(inputs.hospital_daily(raw).select("region")) == [("REGION IV-A (CALABAR ZON)",)]


def test_tests_of_listed_facilities(spark, folder, rows):
    path = file(folder, "t", "facility_name,report_date,daily_output_samples_tested\nA,2020-05-01,5\nB,2020-05-01,NA\n"
                             "C,2020-05-01,7\n")
    places = file(folder, "f", "facility_name,Region\nA,Calabarzon\nB,Calabarzon\n")
    out = testing.tests_by_region(
        inputs.test_volume(read_columns(spark, path, schemas.TEST_VOLUME)),
        inputs.facilities(read_columns(spark, places, schemas.FACILITIES)), "Philippines",
    )
    assert rows(out.select("region", "tests"), "region") == [("Calabarzon", 5), ("Philippines", 5)]


def test_mobility_dates(spark, folder, rows):
    header = [c.split()[0] for c in schemas.MOBILITY.split(", ")]
    path = file(folder, "m", ",".join(header) + "\nP,,,2020-05-01" + ",1" * 6 + "\n")
    out = inputs.mobility(read_columns(spark, path, schemas.MOBILITY))
    assert rows(out.select("sub_region_1", "date")) == [(None, D(2020, 5, 1))]


def test_literal_tables(spark, rows):
    assert rows(literal_table(spark, {"a": "A", "b": "B"}, "name string, label string"), "name") == [
        ("a", "A"), ("b", "B"),
    ]
