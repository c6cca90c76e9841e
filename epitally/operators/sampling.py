"""Repeatable sampling.

Random numbers are hashes of a row's key and a seed, not a generator's state, so a task that
runs again on another executor draws the same numbers.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.normal import normal_quantile, upper_tail
from ..session import materialize
from .joins import join_null_safe

# Hexadecimal digits of a hash by which rows are counted: 4096 counts per group.
LEAD_DIGITS = 3
# Parts into which the candidates of one group are split before the last choice.
SALTS = 1024
# The session's setting up to which Spark cuts ranked rows before their shuffle, and its default.
CUT_IN_TASK, CUT_DEFAULT = "spark.sql.optimizer.windowGroupLimitThreshold", 1000


def draw_hash(key: Column | str, seed: int, *parts: Column | str) -> Column:
    texts = [F.col(key).cast("string") if isinstance(key, str) else key.cast("string")]
    texts += [F.lit(p) if isinstance(p, str) else p for p in parts]
    return F.md5(F.concat_ws("|", *texts, F.lit(str(seed))).cast("binary"))


def hash_uniform(digest: Column, start: int = 1) -> Column:
    """A number strictly between 0 and 1 from 13 hex digits (52 bits) of a digest."""
    bits = F.conv(F.substring(digest, start, 13), 16, 10).cast("bigint")
    return (bits + F.lit(0.5)) / F.lit(float(2**52))


def _near_enough(hashed: DataFrame, by: Sequence[str], n: int) -> DataFrame:
    """The rows whose hashes begin no later than the n-th: hashes are counted by their leading digits first."""
    lead = F.substring("_h", 1, LEAD_DIGITS)
    counts = hashed.groupBy(*by, lead.alias("_lead")).agg(F.count(F.lit(1)).alias("_c"))
    before = F.coalesce(
        F.sum("_c").over(
            Window.partitionBy(*by).orderBy("_lead").rowsBetween(Window.unboundedPreceding, -1)
        ),
        F.lit(0),
    )
    last = counts.withColumn("_before", before).where(F.col("_before") < n).groupBy(*by).agg(
        F.max("_lead").alias("_last")
    )
    kept = join_null_safe(hashed, materialize(last, "sample"), by, "inner").where(lead <= F.col("_last"))
    return kept.drop("_last")


def sample_rows(df: DataFrame, by: Sequence[str], n: int, key: str, seed: int, rank: str = "id") -> DataFrame:
    """n rows of each group without replacement, numbered from 1 in random order.

    The rows of a group are those whose hashes come first, a state that can be merged: every task keeps its first n
    of each group before any shuffle, those are cut to n per salt, then per group, so no task sees more than n rows
    from each task or salt and a group of any size is read once. The salt is the partition a
    row was read in; it cannot change which rows come first. Spark cuts rows in their task for an n up to ``CUT_IN_TASK``;
    for a larger one a pass before that counts hashes and leaves out most rows.
    """
    hashed = df.withColumn("_h", draw_hash(key, seed))
    cut = int(df.sparkSession.conf.get(CUT_IN_TASK, str(CUT_DEFAULT)))
    kept = hashed if n <= cut else _near_enough(hashed, by, n)

    # Equal keys are told apart by the other columns, so that the choice never depends on where rows lie.
    order = [F.col("_h"), F.col(key), *[F.col(c) for c in df.columns if c != key and c not in by]]
    marked = kept.withColumn("_salt", F.spark_partition_id() % F.lit(SALTS))
    first = (
        marked.withColumn("_r", F.row_number().over(Window.partitionBy(*by, "_salt").orderBy(*order)))
        .where(F.col("_r") <= n)
        .drop("_r")
    )
    return (
        first.withColumn(rank, F.row_number().over(Window.partitionBy(*by).orderBy(*order)))
        .where(F.col(rank) <= n)
        .drop("_h", "_salt")
    )


def prior_draws(anchors: DataFrame, key: str, priors: Sequence[dict], seed: int, name: str = "name",
                value: str = "value") -> DataFrame:
    """One draw from each prior per anchor row.

    A prior is uniform (``low``, ``high``) or normal cut off below (``mean``, ``sd``, ``lower``). A cut normal is drawn by
    inversion: a uniform number scaled to the chance that is left above the bound, counted from the upper end,
    is the chance above the draw. So every draw takes one number, whatever the bound.
    """
    specs = F.array(*[
        F.struct(
            F.lit(p["name"]).alias("name"),
            F.lit(p["kind"] == "uniform").alias("uniform"),
            F.lit(float(p["low"] if p["kind"] == "uniform" else p["mean"])).alias("a"),
            F.lit(float(p["high"] - p["low"] if p["kind"] == "uniform" else p["sd"])).alias("b"),
            F.lit(1.0 if p["kind"] == "uniform" else upper_tail((p["lower"] - p["mean"]) / p["sd"])).alias("left"),
            F.lit(float(p.get("lower", p.get("low", 0.0)))).alias("lower"),
        )
        for p in priors
    ])
    drawn = anchors.select(key, F.explode(specs).alias("s")).select(
        key, "s.*", hash_uniform(draw_hash(key, seed, F.col("s.name"), F.lit("0"))).alias("u")
    )
    # Rounding must not carry a draw over the bound.
    normal = F.greatest(F.col("a") - F.col("b") * normal_quantile(F.col("u") * F.col("left")), F.col("lower"))
    return drawn.select(
        key, F.col("name").alias(name),
        F.when(F.col("uniform"), F.col("a") + F.col("b") * F.col("u")).otherwise(normal).alias(value),
    )
