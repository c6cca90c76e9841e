"""Long to wide and back."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

QUANTILES = {0.025: "q025", 0.25: "q25", 0.5: "q50", 0.75: "q75", 0.975: "q975"}


def _single(hit: Column, value: Column, label: str) -> Column:
    """The one value where the condition holds; two of them are an error, as a wide cell holds one."""
    cell = F.when(hit, value)
    return F.when(F.count(F.when(hit, F.lit(1))) <= 1, F.max(cell)).otherwise(
        F.raise_error(F.lit(f"more than one row for cell {label}")).cast("double")
    )


def quantile_wide(df: DataFrame, keys: Sequence[str], quantiles: dict[float, str] | None = None) -> DataFrame:
    """One column per quantile. A row without a quantile keeps its key and adds no column."""
    wanted = quantiles or QUANTILES
    cells = [_single(F.col("quantile") == F.lit(q), F.col("value"), n).alias(n) for q, n in wanted.items()]
    return df.groupBy(*keys).agg(*cells)


def type_quantile_wide(df: DataFrame, keys: Sequence[str], types: Sequence[str],
                       quantiles: dict[float, str] | None = None) -> DataFrame:
    """One column per type and quantile, ``notifications_q50``."""
    wanted = quantiles or {0.25: "q25", 0.5: "q50", 0.75: "q75"}
    cells = [
        _single((F.col("type") == t) & (F.col("quantile") == F.lit(q)), F.col("value"), f"{t}_{n}").alias(f"{t}_{n}")
        for t in types
        for q, n in wanted.items()
    ]
    kept = df.where(F.col("type").isin(list(types)) & F.col("quantile").isin(list(wanted)))
    return kept.groupBy(*keys).agg(*cells)


def to_long(df: DataFrame, keys: Sequence[str], columns: Sequence[str], name: str, value: str) -> DataFrame:
    return df.unpivot([F.col(f"`{k}`") for k in keys], [F.col(f"`{c}`") for c in columns], name, value)


def matching_columns(df: DataFrame, pattern: str) -> list[str]:
    return [c for c in df.columns if re.search(pattern, c)]


def rename_headers(df: DataFrame, *rules: tuple[str, str]) -> DataFrame:
    """Every header through the patterns in turn: ``X0.4`` → ``0-4``."""
    def renamed(header: str) -> str:
        for pattern, replacement in rules:
            header = re.sub(pattern, replacement, header)
        return header

    return df.toDF(*[renamed(c) for c in df.columns])


def append(*tables: DataFrame) -> DataFrame:
    """All rows, columns matched by name, duplicates kept."""
    out = tables[0]
    for table in tables[1:]:
        out = out.unionByName(table)
    return out
