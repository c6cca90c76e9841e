"""An archive that stores of each run only the cells it changed, and gives back any past state.

``path/changes`` holds one row per changed cell, in a folder per run; ``path/runs`` names the folder that counts for each run
date and is written last, so a run that died half-way, or was stored again, leaves nothing that is read. A cell is a
value column of a key; a cell may be present without a value, which is not the same as being absent. A version
is valid from its run date to the date of the next version of the same cell.
"""

from __future__ import annotations

import datetime as dt
import uuid
from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import materialize

CELL, VALUE, PRESENT, VERSION = "cell", "value", "present", "version"
FROM, TO = "valid_from", "valid_to"


def _cells(snapshot: DataFrame, keys: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """One row per key and value column; values are doubles."""
    pairs = F.array(*[F.struct(F.lit(c).alias(CELL), F.col(f"`{c}`").cast("double").alias(VALUE)) for c in columns])
    return snapshot.select(*keys, F.inline(pairs))


def stored_runs(spark: SparkSession, path: str) -> dict[dt.date, str]:
    """The run dates in order and the folder of each, one row a run; empty where nothing is stored yet."""
    try:
        rows = spark.read.schema("run_date date, version string, published timestamp").parquet(f"{path}/runs")
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return {}
    last = rows.groupBy("run_date").agg(F.max_by(VERSION, F.struct("published", VERSION)).alias(VERSION))
    return {r["run_date"]: r[VERSION] for r in last.orderBy("run_date").collect()}


def stored_changes(spark: SparkSession, path: str, first: dt.date | None = None, last: dt.date | None = None) -> DataFrame:
    """Changed cells of the runs between two dates, both included; folders of other runs are not read."""
    named = [v for d, v in stored_runs(spark, path).items() if (first is None or d >= first) and (last is None or d <= last)]
    rows = spark.read.parquet(f"{path}/changes").where(F.col(VERSION).isin(named))
    return rows.withColumn(FROM, F.col(FROM).cast("date")).drop(VERSION)


def intervals(spark: SparkSession, path: str, keys: Sequence[str], last: dt.date | None = None) -> DataFrame:
    """Every version of every cell with the dates from which and before which it holds; the last one has no end.

    The window is over the versions of one cell, at most one per run.
    """
    versions = Window.partitionBy(*keys, CELL).orderBy(FROM)
    rows = stored_changes(spark, path, last=last)
    return rows.withColumn(TO, F.lead(FROM).over(versions)).where(PRESENT).drop(PRESENT)


def state_at(spark: SparkSession, path: str, keys: Sequence[str], date: dt.date) -> DataFrame:
    """The cells as the runs up to ``date`` left them; later versions are not read."""
    rows = stored_changes(spark, path, last=date).groupBy(*keys, CELL)
    last = rows.agg(F.max_by(F.struct(VALUE, PRESENT), FROM).alias("_s"))
    return last.where(f"_s.{PRESENT}").select(*keys, CELL, f"_s.{VALUE}")


def append_version(snapshot: DataFrame, path: str, date: dt.date, keys: Sequence[str], columns: Sequence[str]) -> None:
    """Add a run: the cells that differ from the state before it, those it no longer has among them.

    Old and new cells meet in one aggregation by key and cell, in which missing keys are equal; a key
    stands in one row of a snapshot. The latest run may be added again and replaces itself; an earlier one may not, as
    the runs after it are stored as changes against it.
    """
    spark = snapshot.sparkSession
    known = stored_runs(spark, path)
    if any(d > date for d in known):
        raise ValueError(f"a run after {date} is stored already")
    new = _cells(snapshot, keys, columns).withColumn("_new", F.lit(True))
    earlier = [d for d in known if d < date]
    if earlier:
        both = new.unionByName(state_at(spark, path, keys, max(earlier)).withColumn("_new", F.lit(False)))
    else:
        both = new
    meeting = both.groupBy(*keys, CELL).agg(
        F.bool_or("_new").alias(PRESENT), F.bool_or(~F.col("_new")).alias("_was"),
        F.max(F.when(F.col("_new"), F.col(VALUE))).alias(VALUE),
        F.max(F.when(~F.col("_new"), F.col(VALUE))).alias("_old"),
    )
    same = F.col(PRESENT) & F.col("_was") & F.col(VALUE).eqNullSafe(F.col("_old"))
    version = uuid.uuid4().hex
    changed = meeting.where(~same).select(*keys, CELL, VALUE, PRESENT)
    changed.write.parquet(f"{path}/changes/{FROM}={date}/{VERSION}=v{version}")
    run = spark.range(1).select(F.lit(date).alias("run_date"), F.lit(f"v{version}").alias(VERSION),
                                F.current_timestamp().alias("published"))
    run.write.mode("append").parquet(f"{path}/runs")


def read_versions(spark: SparkSession, path: str, keys: Sequence[str], columns: Sequence[str],
                  dates: Sequence[dt.date] | None = None, named: str = "run_date") -> DataFrame:
    """The full state at each of ``dates`` (of all runs, if not given), the date beside keys and value columns.

    Each interval is laid over the dates at which it holds, so the as-of join is an expression over the
    list of dates and not a join by range.
    """
    days = sorted(dates if dates is not None else stored_runs(spark, path))
    valid = intervals(spark, path, keys, max(days, default=None))
    listed = F.array(*[F.lit(d) for d in days]).cast("array<date>")
    holds = F.filter(listed, lambda d: (d >= F.col(FROM)) & (F.col(TO).isNull() | (d < F.col(TO))))
    laid = valid.select(*keys, CELL, VALUE, F.explode(holds).alias(named))
    values = [F.max(F.when(F.col(CELL) == c, F.col(VALUE))).alias(c) for c in columns]
    return laid.groupBy(named, *keys).agg(*values)


def compacted(spark: SparkSession, path: str, keys: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """How many cells each run stored, beside the number a full copy of it would hold."""
    full = read_versions(spark, path, keys, columns).groupBy("run_date").agg(
        (F.count(F.lit(1)) * F.lit(len(columns))).alias("cells")
    )
    stored = stored_changes(spark, path).groupBy(F.col(FROM).alias("run_date")).agg(F.count(F.lit(1)).alias("stored"))
    return full.join(materialize(stored, "stored"), "run_date", "left").na.fill(0, ["stored"])
