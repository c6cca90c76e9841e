"""Least squares on several regressors by group, from mergeable sums of squares and products.

Spark's covariances are sums around the mean that tasks update and merge, so large offsets cost no digits and no group
is gathered. The small systems are solved in expressions.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# A regressor of which less than this share of its squares is left beside the ones before it adds nothing.
TOLERANCE = 1e-12


def least_squares(df: DataFrame, by: Sequence[str], y: str, xs: Sequence[str]) -> DataFrame:
    """Per group ``n``, ``intercept``, ``slope_<x>`` for each regressor, ``r2`` and ``adj_r2``.

    Rows with a missing value are left out. A regressor that is constant, or a combination of the ones before it, has
    no slope and counts no degree of freedom. Missing keys form a group.
    """
    names = [*xs, y]
    complete = reduce(lambda a, b: a & b, [F.col(c).isNotNull() & ~F.isnan(F.col(c).cast("double")) for c in names])
    values = {c: F.when(complete, F.col(c).cast("double")) for c in names}
    k = len(xs)
    products = [F.covar_pop(values[names[i]], values[names[j]]).alias(f"_{i}_{j}") for i in range(k + 1) for j in range(i, k + 1)]
    means = [F.avg(values[c]).alias(f"_mean_{i}") for i, c in enumerate(names)]
    out = df.groupBy(*by).agg(F.count(F.when(complete, 1)).alias("n"), *products, *means)

    # Symmetric elimination: after regressor i, what is left of each product beside the ones before.
    out = out.withColumns({f"_own_{i}": F.col(f"_{i}_{i}") for i in range(k + 1)})
    for i in range(k):
        pivot = F.when(F.col(f"_{i}_{i}") > F.lit(TOLERANCE) * F.col(f"_own_{i}"), F.col(f"_{i}_{i}"))
        out = out.withColumn(f"_p_{i}", pivot)
        out = out.withColumns({f"_l_{i}_{j}": F.coalesce(F.col(f"_{i}_{j}") / F.col(f"_p_{i}"), F.lit(0.0)) for j in range(i + 1, k + 1)})
        out = out.withColumns({
            f"_{a}_{b}": F.col(f"_{a}_{b}") - F.col(f"_l_{i}_{a}") * F.when(F.col(f"_p_{i}").isNotNull(), F.col(f"_{i}_{b}")).otherwise(0.0)
            for a in range(i + 1, k + 1) for b in range(a, k + 1)
        })
    slopes: dict[int, Column] = {}
    for i in range(k - 1, -1, -1):
        rest = reduce(lambda s, j: s - F.col(f"_l_{i}_{j}") * F.col(f"_b_{j}"), range(i + 1, k), F.col(f"_l_{i}_{k}"))
        out = out.withColumn(f"_b_{i}", F.when(F.col(f"_p_{i}").isNotNull(), rest).otherwise(0.0))
        slopes[i] = F.when(F.col(f"_p_{i}").isNotNull(), F.col(f"_b_{i}")).alias(f"slope_{xs[i]}")
    intercept = reduce(lambda s, i: s - F.col(f"_b_{i}") * F.col(f"_mean_{i}"), range(k), F.col(f"_mean_{k}"))
    used = reduce(lambda a, b: a + b, [F.when(F.col(f"_p_{i}").isNotNull(), 1).otherwise(0) for i in range(k)], F.lit(0))
    out = out.withColumn("r2", F.when(F.col(f"_own_{k}") > 0, 1 - F.greatest(F.col(f"_{k}_{k}"), F.lit(0.0)) / F.col(f"_own_{k}")))
    free = F.col("n") - used - 1
    adjusted = F.when(free > 0, 1 - (1 - F.col("r2")) * (F.col("n") - 1) / free)
    return out.select(*by, "n", intercept.alias("intercept"), *[slopes[i] for i in range(k)], "r2", adjusted.alias("adj_r2"))
