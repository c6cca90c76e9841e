"""Model runs against reported data: snapshot, back-fill of older runs, fit."""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.dates import EPOCH_DEC31, offset_date, weeks_after
from ..functions.labels import METRICS
from ..functions.numbers import number_from_text
from ..operators.aggregates import adjusted_r2
from ..operators.joins import join_null_safe, merge_series
from ..operators.reshape import type_quantile_wide
from ..session import materialize
from ..sources.versions import read_versions

# A projection is shown for this many days after its run date.
HORIZON_DAYS = 49


def calibration_wide(files: DataFrame, series: Sequence[str] = ("notifications", "icu", "deaths")) -> DataFrame:
    """Long calibration files (``"41,"``, ``"7,"``) as one row per region and day."""
    numbers = files.withColumns(
        {"times": number_from_text("times").cast("int"), "values": number_from_text("values")}
    )
    names = {s: f"local_data_{s}" for s in series}
    return merge_series(numbers, ["region", "times"], "series", "values", names)


def run_snapshot(uncertainty: DataFrame, local: DataFrame, run_date: dt.date, types: Sequence[str],
                 epoch: dt.date = EPOCH_DEC31) -> DataFrame:
    """Model quantiles by type beside the reported data, stamped with the run date."""
    wide = type_quantile_wide(uncertainty, ["region", "scenario", "times"], types)
    return (
        wide.join(local, ["region", "times"], "left")
        .withColumns({
            "data_type": F.lit("calibration"),
            "model_run_date": F.lit(run_date),
            "data_acquired_date": F.lit(run_date),
            "date": offset_date("times", epoch),
        })
    )


def read_run_versions(spark: SparkSession, path: str, keys: Sequence[str], columns: Sequence[str],
                      dates: Sequence[dt.date] | None = None) -> DataFrame:
    """The runs from an archive of changed cells, stamped as :func:`run_snapshot` stamps them."""
    runs = read_versions(spark, path, keys, columns, dates, "model_run_date")
    return runs.withColumns({"data_type": F.lit("calibration"), "data_acquired_date": F.col("model_run_date")})


def backfill_runs(runs: DataFrame, metrics: Sequence[str] = ("notifications", "icu", "deaths"),
                  per_region: bool = False, scenario: str | None = None) -> DataFrame:
    """Older runs with the reported values that the latest run brought since.

    The latest run's rows are set beside every older run by region, date and scenario; those an older run lacks
    are added to it without values. A missing value is filled from the cut-off on: the date of the older run's last
    row, ordered by region and day, that has notifications (``per_region``: of each region). The cut-off
    is taken over all scenarios; ``scenario`` then keeps one, at the scan.
    """
    local = [f"local_data_{m}" for m in metrics]
    by = ["model_run_date", "region"] if per_region else ["model_run_date"]
    order = F.struct("times") if per_region else F.struct("region", "times")
    # A row per run (and region), which also holds the dates of all runs.
    cutoff = materialize(
        runs.groupBy(*by).agg(F.max_by("date", F.when(F.col(local[0]).isNotNull(), order)).alias("_cutoff")), "cutoff"
    )
    latest = latest_run(cutoff)
    kept = runs if scenario is None else runs.where(F.col("scenario") == scenario)

    older = F.col("model_run_date") < latest
    stale = join_null_safe(kept, cutoff, by).withColumn(
        "data_acquired_date",
        F.when(older & (F.col("date") >= F.col("_cutoff")), latest).otherwise(F.col("data_acquired_date")),
    ).drop("_cutoff")
    newest = kept.where(F.col("model_run_date") == latest)
    brought = newest.select(
        F.lit(True).alias("_older"), "region", "date", "scenario", *[F.col(c).alias(f"new_{c}") for c in local]
    )
    # The latest run's own rows meet none; a missing region meets a missing one.
    joined = join_null_safe(stale.withColumn("_older", older), brought, ["_older", "region", "date", "scenario"])
    fill = {
        c: F.when(F.col(c).isNull() & (F.col("data_acquired_date") == latest) & older, F.col(f"new_{c}"))
        .otherwise(F.col(c))
        for c in local
    }
    filled = joined.withColumns(fill).select(*runs.columns)

    keys = ["model_run_date", "region", "date", "scenario"]
    dates = cutoff.where(older).agg(F.collect_set("model_run_date")).scalar()
    every = newest.select(F.explode(dates).alias("model_run_date"), *keys[1:])
    added = join_null_safe(every, kept.where(older).select(*keys), keys, "left_anti")
    return filled.unionByName(added, allowMissingColumns=True)


def by_metric(runs: DataFrame, outputs: dict[str, str] | None = None) -> DataFrame:
    """One row per metric with the reported value and the model's quantiles, instead of a loop over metrics."""
    pairs = outputs or {metric: output for metric, output, _ in METRICS}
    rows = F.array(*[
        F.struct(
            F.lit(metric).alias("metric"),
            F.col(f"local_data_{metric}").alias("reported"),
            *[F.col(f"{output}_{q}").alias(q) for q in ("q25", "q50", "q75")],
        )
        for metric, output in pairs.items()
    ])
    keys = ["model_run_date", "data_acquired_date", "region", "scenario", "times", "date"]
    return runs.select(*keys, F.explode(rows).alias("m")).select(*keys, "m.*")


def latest_run(archive: DataFrame) -> Column:
    """Date of the latest run; reads the run dates of the archive only."""
    return archive.agg(F.max("model_run_date")).scalar()


def calibrated_split(runs: DataFrame, scenario: str, latest: Column, outputs: dict[str, str] | None = None,
                     horizon: int = HORIZON_DAYS) -> DataFrame:
    """Rows within the horizon of their run, told apart by whether the model had seen the data.

    In the latest run the model is calibrated up to the last reported day of the metric in the
    region, in older runs where the data date is the run date.
    """
    kept = by_metric(runs.where(F.col("scenario") == scenario), outputs).where(
        F.col("date") <= F.date_add("model_run_date", horizon)
    )
    # A panel is one scenario of one region, a row per day.
    panel = Window.partitionBy("model_run_date", "region", "metric")
    end = F.max(F.when(F.col("reported").isNotNull(), F.col("date"))).over(panel)
    seen = F.when(F.col("model_run_date") == latest, F.col("date") <= F.col("_end")).otherwise(
        F.col("model_run_date") == F.col("data_acquired_date")
    )
    return (
        kept.withColumn("_end", end)
        .withColumn("model", F.when(seen, "calibrated").when(~seen, "uncalibrated"))
        .drop("_end")
    )


def fit(split: DataFrame) -> DataFrame:
    """Adjusted R² of reported on modelled values, per run, region and metric."""
    return split.groupBy("model_run_date", "region", "metric").agg(adjusted_r2("reported", "q50").alias("adj_r2"))


def fit_by_week(split: DataFrame) -> DataFrame:
    """Plain R² per week since the run; all weeks before it count as week zero."""
    weeks = split.withColumn("week", weeks_after("date", "model_run_date"))
    return weeks.groupBy("model_run_date", "region", "metric", "week").agg(
        F.regr_r2("reported", "q50").alias("r2")
    )


def plot_limits(split: DataFrame) -> DataFrame:
    """Upper bounds of the value and date axes of each panel."""
    return split.groupBy("model_run_date", "region", "metric").agg(
        (F.max("q75") + F.lit(100.0)).alias("y_max"), F.max("date").alias("x_max")
    )
