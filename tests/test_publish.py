"""Outputs published together, and least squares from merged sums."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from epitally.operators.regression import least_squares
from epitally.plans import validation
from epitally.sources.publish import publish, published
from epitally.sources.writers import write_table


def test_a_run_that_fails_between_outputs(spark, folder):
    """What was published stays as it is, and the next run replaces it as a whole."""
    def write(value):
        return lambda path: write_table(spark.createDataFrame([(value,)], "v int"), path)

    def fail(path):
        raise RuntimeError("lost")

    def current():
        return {n: spark.read.option("header", True).csv(p).first()["v"] for n, p in published(spark, folder).items()}

    assert published(spark, folder) == {}
    with pytest.raises(RuntimeError):
        publish(spark, folder, {"a": write(0), "b": fail})
    assert published(spark, folder) == {}
    publish(spark, folder, {"a": write(1), "b": write(2)})
    with pytest.raises(RuntimeError):
        publish(spark, folder, {"a": write(3), "b": fail})
    assert current() == {"a": "1", "b": "2"}
    publish(spark, folder, {"a": write(3), "c": write(4)})
    assert current() == {"a": "3", "c": "4"}


@pytest.mark.parametrize("offset", [0.0, 1e8])
def test_least_squares(spark, offset):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(500, 3)) + offset
    y = x @ [2.0, -1.0, 0.5] - 1.5 * offset + rng.normal(size=500)
    rows = [("a", *map(float, r), float(v)) for r, v in zip(x, y)]
    rows += [("a", None, 1.0, 1.0, 1.0), ("a", 1.0, 1.0, 1.0, float("nan")), (None, 1.0, 2.0, 3.0, 4.0)]
    df = spark.createDataFrame(rows, "g string, p double, q double, r double, y double").repartition(7)
    got = {r["g"]: r for r in least_squares(df, ["g"], "y", ["p", "q", "r"]).collect()}
    centred = x - x.mean(axis=0)
    slopes, *_ = np.linalg.lstsq(centred, y - y.mean(), rcond=None)
    rest = ((y - y.mean() - centred @ slopes) ** 2).sum() / ((y - y.mean()) ** 2).sum()
    one = got["a"]
    assert one["n"] == 500 and [one[f"slope_{c}"] for c in "pqr"] == pytest.approx(slopes, rel=1e-6)
    assert one["adj_r2"] == pytest.approx(1 - rest * 499 / 496, abs=1e-9 if offset == 0 else 1e-7)
    assert (got[None]["n"], got[None]["r2"], got[None]["adj_r2"]) == (1, None, None)


def test_regressors_that_add_nothing(spark):
    """A constant one and a multiple of another have no slope; the fit is that of the rest."""
    df = spark.range(50).selectExpr("id % 7 AS p", "2 * (id % 7) AS twice", "3 AS same", "id % 7 * 4.0D + id % 2 AS y")
    out = least_squares(df, [], "y", ["p", "twice", "same"]).first()
    alone = least_squares(df, [], "y", ["p"]).first()
    assert out["slope_twice"] is None and out["slope_same"] is None
    assert out["slope_p"] == pytest.approx(alone["slope_p"]) and out["adj_r2"] == pytest.approx(alone["adj_r2"])


def test_backfill_with_a_missing_region(spark):
    """Rows without a region of older runs are filled from those of the latest one, and added where they lack."""
    rows = [(d, r, t, "S", v) for d, known in (("2024-01-08", 2), ("2024-01-15", 4)) for r in (None, "a")
            for t, v in ((t, float(t) if t <= known else None) for t in range(1, 6 if d > "2024-01-10" else 5))]
    runs = spark.createDataFrame(rows, "run string, region string, times int, scenario string, local_data_notifications double")
    runs = runs.withColumns({"model_run_date": F.col("run").cast("date"), "data_acquired_date": F.col("run").cast("date"),
                             "date": F.expr("date_add(DATE '2024-01-01', times)")}).drop("run")
    for per_region in (False, True):
        out = validation.backfill_runs(runs, ["notifications"], per_region).where("model_run_date = '2024-01-08'").collect()
        values = {(r["region"], r["date"].day): r["local_data_notifications"] for r in out}
        assert len(out) == 10
        assert values[None, 4] == 3.0 if per_region else values["a", 4] == 3.0
        assert values["a", 5] == 4.0 and values["a", 6] is None
