"""Whole jobs: read the files, make the report, write its files.

A report that is written in two forms is kept once in between, so that its inputs are read once.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession

from ..functions.dates import EPOCH_DEC31
from ..functions.labels import HOSPITAL_REGIONS, RESIDENCE_REGIONS, recode
from ..operators.aggregates import ordered_text
from ..operators.filters import in_regions
from ..session import materialize
from ..sources import schemas
from ..sources.publish import publish
from ..sources.readers import read_archive, read_calibration_files, read_columns, read_newest_model_tables
from ..sources.writers import append_run, write_by, write_table, write_wide_text
from . import calibration, inputs, scenarios, validation

SERIES_KEYS = ["series", "region"]


def weekly_job(spark: SparkSession, cases_path: str, hospital_path: str, out: str, regions: Sequence[str],
               national: str, until: dt.date, epoch: dt.date = EPOCH_DEC31) -> None:
    """``out/long`` with cells and ``out/wide`` with two lines of text, by series and region."""
    cases = inputs.cases_imputed(read_columns(spark, cases_path, schemas.CASES_IMPUTED))
    hospital = inputs.hospital_daily(read_columns(spark, hospital_path, schemas.HOSPITAL_DAILY), short_names=True)
    weeks = materialize(
        calibration.weekly_targets(cases, hospital, regions, national, until, epoch), "weekly"
    )
    write_by(calibration.long_text(weeks, SERIES_KEYS).drop("day"), f"{out}/long", SERIES_KEYS)
    write_wide_text(ordered_text(weeks, SERIES_KEYS), f"{out}/wide", SERIES_KEYS)


def rolling_job(spark: SparkSession, cases_path: str, hospital_path: str, out: str, regions: Sequence[str],
                national: str, until: dt.date, epoch: dt.date = EPOCH_DEC31) -> None:
    """``out/notifications`` by region, ``out/deaths`` and ``out/icu``."""
    cases = inputs.cases_imputed(read_columns(spark, cases_path, schemas.CASES_IMPUTED))
    hospital = inputs.hospital_daily(read_columns(spark, hospital_path, schemas.HOSPITAL_DAILY), short_names=True)
    daily = materialize(calibration.case_days(cases, until), "days")
    smooth = calibration.rolling_notifications(daily, regions, national, epoch)
    write_by(calibration.long_text(smooth, ["region"]).drop("day"), f"{out}/notifications", ["region"])
    write_table(calibration.cumulative_deaths(daily, regions, national, epoch), f"{out}/deaths")
    write_table(calibration.latest_icu(hospital, regions, national, until, epoch), f"{out}/icu")


def imputed_job(spark: SparkSession, cases_path: str, out: str, names: dict[str, str],
                epoch: dt.date = EPOCH_DEC31) -> None:
    """``out/regional`` by series and region and ``out/national`` by series; ``names`` maps codes to regions."""
    cases = inputs.cases_by_admission(read_columns(spark, cases_path, schemas.CASES_ADMISSION))
    daily = materialize(calibration.imputed_daily(cases), "days")
    regional = calibration.imputed_regional(daily.where(in_regions(list(names))), epoch)
    write_by(regional.withColumn("region", recode("region", names)).drop("day"), f"{out}/regional", SERIES_KEYS)
    national = calibration.imputed_national(daily, epoch)
    write_by(national.drop("day", "values_bracketed"), f"{out}/national", ["series"])


def residence_job(spark: SparkSession, cases_path: str, out: str, names: dict[str, str] = RESIDENCE_REGIONS,
                  epoch: dt.date = EPOCH_DEC31, lower: int = calibration.FIRST_DAY) -> None:
    """Onsets and deaths by day of the line list by residence: ``daily`` for the nation by series, ``regional`` by series
    and region, whose raw ``names`` become those of the files, and ``confirmed`` cases. They are published together."""
    raw = read_columns(spark, cases_path, schemas.CASES_RESIDENCE)
    cases = inputs.cases_by_residence(raw)
    dates = {"notifications": "onset", "deaths": "died"}
    regional = calibration.regional_daily_text(cases, dates, list(names), epoch)
    recoded = regional.withColumn("region", recode("region", names))
    publish(spark, out, {
        "daily": lambda path: write_wide_text(calibration.daily_text(cases, dates, epoch, lower), path, ["series"]),
        "regional": lambda path: write_wide_text(recoded, path, SERIES_KEYS),
        "confirmed": lambda path: write_table(calibration.confirmed_daily(cases, "report", epoch), path),
    })


def icu_job(spark: SparkSession, hospital_path: str, out: str, names: dict[str, str] = HOSPITAL_REGIONS,
            epoch: dt.date = EPOCH_DEC31) -> None:
    """``out/regional`` by region and ``out/national``."""
    hospital = inputs.hospital_daily(read_columns(spark, hospital_path, schemas.HOSPITAL_DAILY))
    daily = materialize(calibration.icu_daily(hospital, ["region"]), "days")
    regional = calibration.icu_regional_wide(daily.where(in_regions(list(names))), epoch)
    write_by(regional.withColumn("region", recode("region", names)).drop("day"), f"{out}/regional", ["region"])
    write_table(calibration.icu_national(calibration.national_beds(daily), epoch).drop("day", "series"), f"{out}/national")


def validation_job(spark: SparkSession, model_root: str, calibration_root: str, archive: str, run_date: dt.date,
                   types: Sequence[str], outputs: dict[str, str], scenario: str,
                   epoch: dt.date = EPOCH_DEC31, newest: int = 4) -> DataFrame:
    """Add the current run to the archive and compare all runs with the data known by now.

    The model's tables are the ``newest`` ones, one per region.
    """
    model = scenarios.model_table(read_newest_model_tables(spark, model_root, "uncertainty", newest), epoch)
    local = validation.calibration_wide(read_calibration_files(spark, calibration_root))
    append_run(validation.run_snapshot(model, local, run_date, types, epoch), archive)
    runs = read_archive(spark, archive)
    filled = validation.backfill_runs(runs, list(outputs), scenario=scenario)
    return validation.calibrated_split(filled, scenario, validation.latest_run(runs), outputs)
