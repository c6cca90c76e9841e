"""Several outputs that appear together.

A job writes each output into a folder of its own run; one row of the manifest, written last, makes them the current
ones. A run that dies leaves what was published before, and can simply be started again.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Mapping

from pyspark.errors import AnalysisException
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

MANIFEST = "run string, outputs array<string>, published timestamp"


def publish(spark: SparkSession, out: str, outputs: Mapping[str, Callable[[str], None]]) -> str:
    """Run the writers, each with the path it writes to, then name the run in the manifest; the run's name."""
    run = uuid.uuid4().hex
    for name, write in outputs.items():
        write(f"{out}/runs/{run}/{name}")
    row = spark.range(1).select(
        F.lit(run).alias("run"), F.array(*[F.lit(n) for n in outputs]).alias("outputs"), F.current_timestamp().alias("published")
    )
    row.write.mode("append").json(f"{out}/manifest")
    return run


def published(spark: SparkSession, out: str) -> dict[str, str]:
    """The paths of the current outputs by name; none before the first run was complete."""
    try:
        rows = spark.read.schema(MANIFEST).json(f"{out}/manifest")
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return {}
    last = rows.agg(F.max_by(F.struct("run", "outputs"), F.struct("published", "run")).alias("last")).first()["last"]
    return {name: f"{out}/runs/{last['run']}/{name}" for name in last["outputs"]} if last else {}
