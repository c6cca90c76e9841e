"""Ranks, windows and running values over groups that no calendar bounds.

A window over a group gathers it in one task. Here the rows are range-partitioned by group and order,
so that a group with most rows is split, and written; each part of a group is summed up in one row, and what a
part must know of the ones before it is carried over these rows only.

Rows that are equal in the group and the whole order stay together, so the order should end in columns that tell
rows apart. Missing keys form a group; missing values of the order come first.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from ..session import materialize
from .joins import join_null_safe

PART, PLACE = "_part", "_place"
# Digits of monotonically_increasing_id that number the rows of a partition; those above number the partition.
PLACE_BITS = 33
# Rows of a group that one window takes in halo_window.
BLOCK_ROWS = 1 << 16


def in_ranges(df: DataFrame, by: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The rows in range partitions by group and order, written with their part and their place in it.

    The ranges are found from a sample, so ``df`` is read twice.
    """
    keys = [*by, *order]
    numbered = df.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn(
        "_id", F.monotonically_increasing_id()
    )
    return materialize(
        numbered.select(
            *[F.col(f"`{c}`") for c in df.columns], F.shiftright("_id", PLACE_BITS).alias(PART),
            F.col("_id").bitwiseAND(F.lit((1 << PLACE_BITS) - 1)).alias(PLACE),
        ),
        "ranges",
    )


def _with_summaries(parts: DataFrame, summaries: DataFrame, by: Sequence[str]) -> DataFrame:
    """Each row beside what was summed up or carried for its part of its group.

    The summaries are written first: Spark broadcasts them when they are small, and else joins by part and
    group, which holds a part's rows at most.
    """
    return join_null_safe(parts, materialize(summaries, "summaries"), [PART, *by], "left")


def _earlier(by: Sequence[str]) -> WindowSpec:
    """The parts of the same group before this one; a window over summaries."""
    return Window.partitionBy(*by).orderBy(PART).rowsBetween(Window.unboundedPreceding, -1)


def ranked(df: DataFrame, by: Sequence[str], order: Sequence[str], rank: str = "rank", size: str = "size") -> DataFrame:
    """Each row with its rank in its group, from 0, and the number of rows of the group."""
    parts = in_ranges(df, by, order)
    counts = parts.groupBy(PART, *by).agg(F.count(F.lit(1)).alias("_rows"), F.min(PLACE).alias("_first"))
    carried = counts.select(
        PART, *by, (F.coalesce(F.sum("_rows").over(_earlier(by)), F.lit(0)) - F.col("_first")).alias("_shift"),
        F.sum("_rows").over(Window.partitionBy(*by)).alias(size),
    )
    return _with_summaries(parts, carried, by).select(
        *df.columns, (F.col("_shift") + F.col(PLACE)).alias(rank), size
    )


def halo_window(
    df: DataFrame,
    by: Sequence[str],
    order: Sequence[str],
    before: int,
    after: int,
    columns: Callable[[WindowSpec], dict[str, Column]],
    block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """Window columns that look at most ``before`` rows back and ``after`` rows ahead in their group.

    ``columns`` gets the ordered window and returns the new columns. Each group is cut by rank into blocks of
    ``block_rows``; a block also gets the rows next to it, its halo, and every window runs inside a block. The
    result is that of a window over the whole group, but no task needs more than a block.
    """
    rows = max(block_rows, before, after, 1)
    placed = ranked(df, by, order, "_rank", "_size")
    block = F.floor(F.col("_rank") / rows)
    place = F.col("_rank") % rows
    last = F.floor((F.col("_size") - 1) / rows)
    copies = F.array(
        block,
        F.when((place < after) & (block > 0), block - 1),
        F.when((place >= rows - before) & (block < last), block + 1),
    )
    spread = placed.withColumn("_home", block).withColumn("_block", F.explode(F.array_compact(copies)))
    window = Window.partitionBy(*by, "_block").orderBy("_rank")
    return (
        spread.withColumns(columns(window))
        .where(F.col("_block") == F.col("_home"))
        .drop("_rank", "_size", "_home", "_block")
    )


def rolling_rows(df: DataFrame, by: Sequence[str], order: Sequence[str], value: str, width: int, named: str,
                 align: str = "left", agg: Callable[[Column], Column] = F.avg,
                 block_rows: int = BLOCK_ROWS) -> DataFrame:
    """:func:`epitally.operators.series.rolling` for groups of any size."""
    back = {"left": 0, "center": (width - 1) // 2, "right": width - 1}[align]
    ahead = width - 1 - back

    def columns(window: WindowSpec) -> dict[str, Column]:
        frame = window.rowsBetween(-back, ahead)
        return {named: F.when(F.count(F.lit(1)).over(frame) == width, agg(F.col(value)).over(frame))}

    return halo_window(df, by, order, back, ahead, columns, block_rows)


def fill_days_rows(df: DataFrame, by: Sequence[str], date: str = "date", value: str = "values",
                   block_rows: int = BLOCK_ROWS) -> DataFrame:
    """:func:`epitally.operators.series.fill_days` for groups with any number of days, one row per day."""
    ahead = halo_window(df.select(*by, date, value), by, [date], 0, 1,
                        lambda window: {"_following": F.lead(date).over(window)}, block_rows)
    until = F.coalesce(F.date_sub("_following", 1), F.col(date))
    return (
        ahead.select(*by, F.col(date).alias("_first"), F.col(value).alias("_value"), until.alias("_until"))
        .select(*by, "_first", "_value", F.explode(F.sequence("_first", "_until")).alias(date))
        .select(*by, date, F.when(F.col(date) == F.col("_first"), F.col("_value")).alias(value))
    )


def prefix_scan(
    df: DataFrame,
    by: Sequence[str],
    order: Sequence[str],
    sums: dict[str, str] | None = None,
    maxima: dict[str, str] | None = None,
    last: dict[str, str] | None = None,
    whole: dict[str, str] | None = None,
) -> DataFrame:
    """Running values up to each row, and values of its whole group, without gathering the group.

    ``sums``, ``maxima`` and ``last`` map a new column to the one it runs over: the sum, the greatest and the last
    value at or before the row, missing values skipped, missing while there is none. ``whole`` maps the name of one of
    these to a name for its value over the whole group. Every part of a group is summed up, and a part takes over what
    the parts before it add up to; the rows themselves are scanned inside their part only.
    """
    sums, maxima, last, whole = sums or {}, maxima or {}, last or {}, whole or {}
    kinds = {**dict.fromkeys(sums, "sum"), **dict.fromkeys(maxima, "max"), **dict.fromkeys(last, "last")}
    sources = {**sums, **maxima, **last}
    parts = in_ranges(df, by, order)

    def of_part(name: str) -> Column:
        c = F.col(sources[name])
        found = {"sum": F.sum(c), "max": F.max(c), "last": F.max_by(c, F.when(c.isNotNull(), F.col(PLACE)))}
        return found[kinds[name]].alias(name)

    def over(name: str, c: Column, window: WindowSpec) -> Column:
        if kinds[name] == "sum":
            return F.sum(c).over(window)
        return F.max(c).over(window) if kinds[name] == "max" else F.last(c, ignorenulls=True).over(window)

    everything = Window.partitionBy(*by).orderBy(PART).rowsBetween(
        Window.unboundedPreceding, Window.unboundedFollowing
    )
    carried = parts.groupBy(PART, *by).agg(*[of_part(n) for n in kinds]).select(
        PART, *by, *[over(n, F.col(n), _earlier(by)).alias(f"_carry_{n}") for n in kinds],
        *[over(n, F.col(n), everything).alias(new) for n, new in whole.items()],
    )
    inside = Window.partitionBy(PART, *by).orderBy(PLACE).rowsBetween(Window.unboundedPreceding, 0)

    def running(name: str) -> Column:
        here, carry = over(name, F.col(sources[name]), inside), F.col(f"_carry_{name}")
        if kinds[name] == "sum":
            return F.when(here.isNull(), carry).otherwise(here + F.coalesce(carry, F.lit(0)))
        return F.greatest(here, carry) if kinds[name] == "max" else F.coalesce(here, carry)

    scanned = _with_summaries(parts, carried, by).withColumns({n: running(n) for n in kinds})
    return scanned.select(*df.columns, *kinds, *whole.values())


def trim_tail_rows(df: DataFrame, by: Sequence[str], lower: int, tail: int = 0, c: str = "times") -> DataFrame:
    """:func:`epitally.operators.filters.trim_tail` for groups of any size: an aggregate set beside the rows."""
    last = materialize(df.groupBy(*by).agg(F.max(c).alias("_last")), "last")
    kept = join_null_safe(df, last, by, "left").where((F.col(c) > lower) & (F.col(c) < F.col("_last") - tail))
    return kept.drop("_last")
