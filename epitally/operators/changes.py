"""What a new snapshot changes, and counts that follow changes instead of being made anew.

A snapshot is a bag of rows: equal rows count as often as they occur. A change is a row with the number of times it
was added (positive) or taken away (negative); a row that was altered is taken away once and added once.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import materialize
from .aggregates import daily_counts

CHANGE = "change"


def row_hash(columns: Sequence[str]) -> list[Column]:
    """128 bits of a row. Spark's hash passes over missing values, so where they are is hashed too."""
    cells = [F.col(f"`{c}`") for c in columns]
    missing = F.concat(*[F.when(c.isNull(), "1").otherwise("0") for c in cells])
    return [F.xxhash64(F.lit(seed), missing, *cells).alias(f"_h{seed}") for seed in (1, 2)]


def changes(old: DataFrame, new: DataFrame) -> DataFrame:
    """The rows by which ``new`` differs from ``old``, each once, with its signed number in ``change``.

    Only hashes are exchanged for all rows, combined before the shuffle; whole rows are fetched for the hashes that
    changed, a join in which the changes are broadcast when they are few. Missing values are equal to each other.
    """
    columns = old.columns
    both = old.withColumn("_sign", F.lit(-1)).unionByName(new.select(*columns).withColumn("_sign", F.lit(1)))
    hashed = both.select(*row_hash(columns), *columns, "_sign")
    keys = ["_h1", "_h2"]
    net = hashed.groupBy(*keys).agg(F.sum("_sign").alias(CHANGE)).where(F.col(CHANGE) != 0)
    net = materialize(net, "changes")
    rows = hashed.drop("_sign").join(net.select(*keys), keys, "left_semi").dropDuplicates(keys)
    return rows.join(net, keys).select(*columns, CHANGE)


def applied(snapshot: DataFrame, changed: DataFrame) -> DataFrame:
    """The snapshot after the changes: rows added as often as told, and rows taken away as often."""
    columns = snapshot.columns
    signed = snapshot.withColumn(CHANGE, F.lit(1).cast("long")).unionByName(changed)
    left = signed.groupBy(*columns).agg(F.sum(CHANGE).alias("_n")).where(F.col("_n") > 0)
    return left.select(*columns, F.explode(F.array_repeat(F.lit(1), F.col("_n").cast("int"))).alias("_i")).drop("_i")


def daily_changes(changed: DataFrame, by: Sequence[str], dates: dict[str, str], until: dt.date | None = None,
                  after: dt.date | None = None) -> DataFrame:
    """:func:`epitally.operators.aggregates.daily_counts` of changes; a row taken away counts below zero."""
    return daily_counts(changed, by, dates, until, after, weight=CHANGE)


def merged_counts(stored: DataFrame, delta: DataFrame, value: str = "values") -> DataFrame:
    """Stored counts after a change of counts; a count that falls to zero leaves the table, as no row made it.

    Reads the stored counts and the changes, not the rows behind them.
    """
    keys = [c for c in stored.columns if c != value]
    total = stored.unionByName(delta).groupBy(*keys).agg(F.sum(value).alias(value))
    return total.where(F.col(value) != 0)
