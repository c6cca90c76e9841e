"""Explicit schemas of the input tables; nothing is inferred from data."""

from __future__ import annotations

from ..functions.bands import BAND_STARTS, POPULATION_BANDS

CASES_RESIDENCE = "DateRepConf string, DateOnset string, DateDied string, RegionRes string"
CASES_ADMISSION = (
    "Region string, `Date Admitted` string, `Report Date` string, `Date Recovered` string, `Date Died` string"
)
CASES_IMPUTED = "Region string, imputed_Date_Admitted string, Date_Died string"
CASES_AGED = "Region string, Age double, Report_Date string"
HOSPITAL_DAILY = "region string, reportdate string, icu_o int"
TEST_POSITIVITY = "facility_name string, report_date string, pct_positive_cumulative double"
TEST_VOLUME = "facility_name string, report_date string, daily_output_samples_tested int"
TEST_TOTALS = "Date string, tested string, positive string, negative string"
FACILITIES = "facility_name string, Region string"
POPULATION = "area string, reference_year int, " + ", ".join(f"`{band}` string" for band in POPULATION_BANDS)
MOBILITY = (
    "country_region string, sub_region_1 string, metro_area string, date string, "
    "retail_and_recreation_percent_change_from_baseline double, "
    "grocery_and_pharmacy_percent_change_from_baseline double, "
    "parks_percent_change_from_baseline double, "
    "transit_stations_percent_change_from_baseline double, "
    "workplaces_percent_change_from_baseline double, "
    "residential_percent_change_from_baseline double"
)
MODEL_UNCERTAINTY = "scenario int, type string, times int, quantile double, value double"
MODEL_DERIVED = "scenario int, times int, " + ", ".join(
    f"notificationsXagegroup_{start} double" for start in BAND_STARTS + [75]
)
MODEL_DRAWS = "draw_id long, name string, value double"
PROCESSED_SERIES = "Region string, times int, value double"
BEHAVIOUR_CURVE = "times int, inverse_mhs_values double"
CALIBRATION_LONG = "times string, values string"
