"""Numeric rules: rounding, coercion, missing-value arithmetic, rates."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def half_even(c: Column | str, digits: int = 0) -> Column:
    """Round with ties to the even digit: 0.5, 1.5, 2.5 give 0, 2, 2."""
    return F.bround(_col(c), digits)


# What counts as a number; Java's own reading would also take 1d and 2f.
NUMBER = r"^\s*[+-]?(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:[eE][+-]?[0-9]+)?\s*$"


def to_number(c: Column | str) -> Column:
    """Text to double; anything that is no number becomes null."""
    value = _col(c)
    return F.when(value.rlike(NUMBER), value.try_cast("double"))


def strip_text(c: Column | str, pattern: str = ",") -> Column:
    return F.regexp_replace(_col(c), pattern, "")


def number_from_text(c: Column | str) -> Column:
    """``1,234`` or ``7,`` to a number."""
    return to_number(F.translate(_col(c), ",", ""))


def row_sum(columns: Sequence[Column | str]) -> Column:
    """Sum across columns; one missing cell makes the sum missing."""
    return reduce(lambda a, b: a + b, [_col(c) for c in columns])


def row_mean(columns: Sequence[Column | str]) -> Column:
    """Mean across columns; one missing cell makes the mean missing."""
    return row_sum(columns) / F.lit(float(len(columns)))


def relative_change(percent: Column | str) -> Column:
    """Percent change from baseline as a multiple of the baseline."""
    return (_col(percent) + F.lit(100.0)) / F.lit(100.0)


def thousands_to_millions(c: Column | str) -> Column:
    return _col(c) / F.lit(1000.0)


def per_10k(count: Column | str, population_thousands: Column | str) -> Column:
    """Count per ten thousand people, the population given in thousands."""
    return count_over(count, population_thousands) * F.lit(10000.0)


def count_over(count: Column | str, population_thousands: Column | str) -> Column:
    return _col(count) / (_col(population_thousands) * F.lit(1000.0))


def detection_rate(rate: Column | str, tests: Column | str) -> Column:
    """Share of cases found when tests act as an exponential hazard."""
    return F.lit(1.0) - F.exp(-_col(rate) * _col(tests))


# Fixed value: the national population behind the tested share.
NATIONAL_POPULATION = 106_700_000


def tested_share(tested: Column | str, population: int = NATIONAL_POPULATION) -> Column:
    return _col(tested) / F.lit(float(population))
