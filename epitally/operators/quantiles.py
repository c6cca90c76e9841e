"""Exact quantiles by linear interpolation between order statistics.

``F.percentile`` computes the same for a group whose distinct values fit one task.
:func:`exact_quantiles` is for groups without such a bound.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialize
from .joins import join_groups, join_null_safe
from .ranges import prefix_scan


def bounded_quantiles(value: Column | str, probs: dict[float, str]) -> list[Column]:
    """Aggregates for groups of bounded size, such as 500 sampled draws."""
    c = F.col(value) if isinstance(value, str) else value
    found = F.percentile(c.cast("double"), F.array(*[F.lit(float(p)) for p in probs]))
    return [found[i].alias(name) for i, name in enumerate(probs.values())]


# One over the share of a group's ranks by which an approximate quantile may be off.
ACCURACY = 10_000
# Bracketed values of a group that one task may put in order.
IN_TASK = 1_000_000


def exact_quantiles(
    df: DataFrame,
    by: Sequence[str],
    value: str,
    probs: dict[float, str],
    extra: Sequence[Column] = (),
    accuracy: int = ACCURACY,
    in_task: int = IN_TASK,
) -> DataFrame:
    """Quantiles of groups of any size, exact and without gathering a group, in two passes.

    The first pass finds the size of each group and, from a mergeable sketch with a stated error, values
    on both sides of each wanted rank; a group of no more values than the sketch keeps is bracketed by its ends.
    The second keeps the distinct values inside the brackets and only a count of the values in each gap between
    them. Both combine before their shuffle, and no task meets a group's raw rows. What is inside the brackets of a
    group is ordered in one task up to ``in_task`` values, and in range partitions beyond. A rank that no
    bracket holds is an error. A group without values gets missing quantiles. ``extra`` aggregates ride along
    in the first pass.
    """
    keys = list(by)
    number = F.col(value).cast("double")
    rows = df.withColumn("_v", F.when(~F.isnan(number), number))
    if not keys:
        keys, rows = ["_all"], rows.withColumn("_all", F.lit(1))
    wanted = [float(p) for p in probs]
    # The sketch is off by one part in ``accuracy``, and a rank by two at most, which is less than two parts.
    margin = 4 / accuracy
    around = [min(1.0, max(0.0, p + side * margin)) for p in wanted for side in (-1, 1)]
    found = rows.groupBy(*keys).agg(
        F.count("_v").alias("_n"), F.min("_v").alias("_min"), F.max("_v").alias("_max"),
        F.percentile_approx("_v", around, accuracy).alias("_near"), *extra,
    )
    few = F.col("_n") <= accuracy
    ends = {
        name: F.array(*[F.when(few, end).otherwise(F.col("_near")[2 * i + side]) for i in range(len(wanted))])
        for name, end, side in (("_lo", F.col("_min"), 0), ("_hi", F.col("_max"), 1))
    }
    sizes = materialize(found.withColumns(ends).drop("_min", "_max", "_near"), "sizes")
    values = rows.where(F.col("_v").isNotNull()).select(*keys, "_v")
    largest = sizes.agg(F.max("_n")).first()[0] or 0
    ordered_in_task = min(largest, 2 * margin * len(wanted) * largest + 2 * accuracy) <= in_task
    steps = _distribution(values, keys, sizes, len(wanted), ordered_in_task)
    out = steps.groupBy(*keys).agg(*[_interpolated(p).alias(n) for p, n in zip(wanted, probs.values())])
    riders = [c for c in sizes.columns if c not in (*keys, "_n", "_lo", "_hi")]
    out = join_null_safe(sizes.select(*keys, *riders), out, keys, "left").select(*keys, *probs.values(), *riders)
    return out if list(by) else out.drop("_all")


def _ranks(prob: float) -> tuple[Column, Column]:
    """The two ranks, from 0, between which a quantile lies."""
    h = F.lit(prob) * (F.col("_n") - 1)
    return F.floor(h), F.ceil(h)


def _holds(rank: Column) -> Column:
    return (F.col("_cum") - F.col("_c") <= rank) & (rank < F.col("_cum"))


def _distribution(values: DataFrame, keys: list[str], brackets: DataFrame, count: int, in_task: bool) -> DataFrame:
    """The values inside the brackets and the gaps between them, with cumulative counts in their order."""
    v = F.col("_v")
    inside = reduce(
        lambda x, y: x | y, [(v >= F.col("_lo")[j]) & (v <= F.col("_hi")[j]) for j in range(count)]
    )
    # A value in a gap is known by the number of brackets that lie below it.
    gap = reduce(lambda x, y: x + y, [(v > F.col("_hi")[j]).cast("int") for j in range(count)])
    steps = (
        join_groups(values, brackets.select(*keys, "_n", "_lo", "_hi"), keys, "_n")
        .groupBy(*keys, "_n", F.when(inside, v).alias("_exact"), F.when(~inside, gap).alias("_gap"))
        .agg(F.count(F.lit(1)).alias("_c"), F.min("_v").alias("_least"))
    )
    if not in_task:
        return prefix_scan(materialize(steps, "steps"), keys, ["_least"], sums={"_cum": "_c"})
    order = Window.partitionBy(*keys).orderBy("_least").rowsBetween(Window.unboundedPreceding, 0)
    return steps.withColumn("_cum", F.sum("_c").over(order))


def _interpolated(prob: float) -> Column:
    low, high = _ranks(prob)

    def at(rank: Column) -> Column:
        found = F.max(F.when(_holds(rank), F.col("_exact")))
        return F.coalesce(found, F.raise_error(F.lit(f"no bracket holds the rank of quantile {prob}")).cast("double"))

    part = F.max(F.lit(prob) * (F.col("_n") - 1) - low)
    # Equal ends, infinite ones too, need no interpolation.
    return F.when(at(low) == at(high), at(low)).otherwise(at(low) + part * (at(high) - at(low)))


def ordered_draws(draws: DataFrame, by: Sequence[str], value: str) -> DataFrame:
    """One row per group with its draws in order, as array ``draws``; for groups of bounded size."""
    return draws.groupBy(*by).agg(F.sort_array(F.collect_list(value)).alias("draws"))


def interpolated(ordered: Column, prob: float, through) -> Column:
    """Quantile of ``through(draw)`` for a function that never decreases in the draw.

    Such a function keeps the order of the draws, so the quantile needs it at two draws only.
    """
    h = (F.size(ordered) - 1) * F.lit(float(prob))
    low, high = F.floor(h).cast("int"), F.ceil(h).cast("int")
    at_low, at_high = through(ordered[low]), through(ordered[high])
    return at_low + (h - F.floor(h)) * (at_high - at_low)


