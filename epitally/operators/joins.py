"""Joins that keep the rules for missing keys and broadcast where Spark finds them small."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import materialize


def join_null_safe(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "left") -> DataFrame:
    """Equi-join in which a missing key matches a missing key; the left keys are kept."""
    renamed = right.withColumnsRenamed({k: f"_r_{k}" for k in keys})
    condition = reduce(lambda a, b: a & b, [left[k].eqNullSafe(renamed[f"_r_{k}"]) for k in keys])
    return left.join(renamed, condition, how).drop(*[f"_r_{k}" for k in keys])


# Groups that may be set beside rows by broadcast: as many as can each hold a thousandth of all rows.
LARGE_GROUPS = 1000


def join_groups(rows: DataFrame, groups: DataFrame, keys: Sequence[str], size: str) -> DataFrame:
    """Rows beside the row of their group, of which ``size`` says how many rows it has; missing keys meet.

    No task gets a large group: the groups with more than a thousandth of all rows, hence fewer than a thousand, are
    broadcast, and the others, when there are any more, are joined by key. ``groups`` must be a written table.
    """
    count, total = groups.agg(F.count(F.lit(1)), F.sum(size)).first()
    if count <= LARGE_GROUPS:
        return join_null_safe(rows, F.broadcast(groups), keys, "inner")
    large = F.coalesce(F.col(size) * LARGE_GROUPS > total, F.lit(False))
    return join_null_safe(rows, F.broadcast(groups.where(large)), keys, "inner").unionByName(
        join_null_safe(rows, groups.where(~large), keys, "inner")
    )


def group_statistic(df: DataFrame, by: Sequence[str], aggregates: Sequence) -> DataFrame:
    """A statistic of each group set beside its rows.

    The statistic is aggregated first and joined back, so a group that holds most rows is
    never gathered in one task, as it would be in a window. It is written before the join, so
    that its size decides whether it is broadcast.
    """
    stats = materialize(df.groupBy(*by).agg(*aggregates), "statistic")
    return join_null_safe(df, stats, by)


def merge_series(series: DataFrame, keys: Sequence[str], tag: str, value: str, names: dict[str, str]) -> DataFrame:
    """Several series as columns beside each other, as a chain of full joins would give.

    ``series`` is long with a tag column; ``names`` maps a tag to its column. One aggregation
    replaces one shuffle per join.
    """
    columns = [F.max(F.when(F.col(tag) == t, F.col(value))).alias(n) for t, n in names.items()]
    return series.where(F.col(tag).isin(list(names))).groupBy(*keys).agg(*columns)


def with_labels(df: DataFrame, key: str, labels: DataFrame) -> DataFrame:
    """Label columns by key, null where there is none. The labels are a literal table, so they are broadcast."""
    return df.join(F.broadcast(labels), key, "left")
