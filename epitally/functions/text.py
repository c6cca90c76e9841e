"""Text forms of a series, as the calibration files hold them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def number_text(c: Column | str) -> Column:
    """A number as text; whole doubles are written without a decimal point."""
    value = _col(c)
    plain = value.cast("string")
    # A whole double has at most 309 digits; 38 are the most that can be written out.
    exact = value.cast("double").try_cast("decimal(38,0)")
    return F.when(exact == value, exact.cast("string")).otherwise(plain)


def with_comma(c: Column | str) -> Column:
    """``41`` → ``41,``."""
    return F.concat(number_text(c), F.lit(","))


def padded_cell(c: Column | str, width: Column, before: str = "     ", after: str = ",") -> Column:
    """A right-justified cell between fixed text, all cells of a column equally wide."""
    return F.concat(F.lit(before), F.lpad(number_text(c), width, " "), F.lit(after))


def joined_list(cells: Column, separator: str = ", ") -> Column:
    """``41, 42, 43`` from an array of texts."""
    return F.array_join(cells, separator)


def bracketed_list(cells: Column) -> Column:
    """``[3],[7]`` from an array of texts."""
    return F.array_join(F.transform(cells, lambda v: F.concat(F.lit("["), v, F.lit("]"))), ",")
