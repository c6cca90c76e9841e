"""Kernel density of draws, on one grid per panel.

The draws are binned first, each shared between its two nearest bins, so the kernel meets
bins and not draws: its cost is fixed by the grid whatever the number of draws.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialize
from .joins import join_groups
from .quantiles import exact_quantiles

# The reach of the bins beyond the data in bandwidths, and the grid size.
REACH = 4.0
GRID = 512


def bandwidths(draws: DataFrame, panel: Sequence[str], by: Sequence[str], value: str = "value") -> DataFrame:
    """Rule-of-thumb bandwidth of each group and the value range of its panel.

    0.9 · min(standard deviation, quartile range / 1.34) · n^(-1/5); a range of zero falls back
    on the deviation, then on the size of the value, then on 1.
    """
    stats = exact_quantiles(
        draws, [*panel, *by], value, {0.25: "q25", 0.75: "q75"},
        extra=[F.count(F.lit(1)).alias("n"), F.stddev_samp(value).alias("sd"),
               F.min(value).alias("least"), F.max(value).alias("most")],
    )
    spread = F.least(F.col("sd"), (F.col("q75") - F.col("q25")) / F.lit(1.34))
    spread = (
        F.when(spread != 0, spread).when(F.col("sd") != 0, F.col("sd"))
        .when(F.col("least") != 0, F.abs("least")).otherwise(F.lit(1.0))
    )
    whole = Window.partitionBy(*panel)
    return stats.select(
        *panel, *by, "n",
        (F.lit(0.9) * spread * F.pow(F.col("n").cast("double"), F.lit(-0.2))).alias("bw"),
        F.min("least").over(whole).alias("from"),
        F.max("most").over(whole).alias("to"),
    )


def density(draws: DataFrame, panel: Sequence[str], by: Sequence[str], value: str = "value",
            grid: int = GRID) -> DataFrame:
    """``x`` and ``density`` at ``grid`` points between the least and greatest value of the panel."""
    keys = [*panel, *by]
    shape = materialize(bandwidths(draws, panel, by, value), "bandwidths")
    last = F.lit(float(grid - 1))
    shape = shape.withColumn("low", F.col("from") - F.lit(REACH) * F.col("bw")).withColumn(
        "step", (F.col("to") - F.col("from") + F.lit(2 * REACH) * F.col("bw")) / last
    )
    placed = (
        join_groups(draws.where(F.col(value).isNotNull()).select(*keys, value), shape, keys, "n")
        .withColumn("_pos", (F.col(value) - F.col("low")) / F.col("step"))
        .withColumn("bin", F.floor("_pos").cast("int"))
    )
    bins = placed.groupBy(*keys, *[c for c in shape.columns if c not in keys], "bin").agg(
        F.count(F.lit(1)).alias("_c"), F.sum(F.col("_pos") - F.col("bin")).alias("_right")
    )
    # A point lies between two bin centres; the density there is interpolated between theirs.
    x = F.col("from") + F.col("point") * (F.col("to") - F.col("from")) / last
    points = (
        bins.withColumn("point", F.explode(F.sequence(F.lit(0), F.lit(grid - 1))))
        .withColumn("x", x)
        .withColumn("_at", (F.col("x") - F.col("low")) / F.col("step"))
        .withColumn("_share", F.col("_at") - F.floor("_at"))
        .withColumn("_off", F.floor("_at") - F.col("bin"))
    )

    def kernel(steps):
        z = steps * F.col("step") / F.col("bw")
        return F.exp(F.lit(-0.5) * z * z) / (F.col("bw") * F.lit(math.sqrt(2 * math.pi)))

    # A draw in the right part of its bin counts in part for the next one.
    left, right = F.col("_c") - F.col("_right"), F.col("_right")
    near, far = F.lit(1.0) - F.col("_share"), F.col("_share")
    weight = (
        right * near * kernel(F.col("_off") - 1)
        + (left * near + right * far) * kernel(F.col("_off"))
        + left * far * kernel(F.col("_off") + 1)
    ) / F.col("n")
    return points.groupBy(*keys, "point").agg(F.max("x").alias("x"), F.sum(weight).alias("density"))
