"""Change sets and the archive of changed cells against full copies."""

import collections
import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from epitally.operators import aggregates, changes
from epitally.sources import versions

SCHEMA = "id long, region string, onset date, note string"
DAYS = [dt.date(2021, 1, d) for d in range(1, 8)]


def bag(df):
    return collections.Counter(map(tuple, df.collect()))


@pytest.fixture(scope="module")
def drops(spark):
    rng = random.Random(8)

    def row(i):
        return i, rng.choice(["a", "b", None]), rng.choice([None, *DAYS]), rng.choice([None, "", "x"])

    old = [row(i % 60) for i in range(200)] + [(1, "a", DAYS[0], "same")] * 90
    new = [r for r in old if rng.random() < 0.8] + [row(i) for i in range(60, 90)] + [(1, "a", DAYS[0], "same")] * 5
    # Missing cells in different places make different rows.
    old += [(None, "x", None, None), (None, None, None, "x")]
    new += [(None, None, None, "x"), (None, None, None, "x"), (None,) * 4]
    return spark.createDataFrame(old, SCHEMA).repartition(3), spark.createDataFrame(new, SCHEMA).repartition(4)


def test_changes(drops):
    old, new = drops
    got = {tuple(r)[:-1]: r["change"] for r in changes.changes(old, new).collect()}
    want = bag(new)
    want.subtract(bag(old))
    assert got == {k: v for k, v in want.items() if v}


def test_applied(drops):
    old, new = drops
    assert bag(changes.applied(old, changes.changes(old, new))) == bag(new)


def test_nothing_changed(drops, spark):
    old, _ = drops
    assert changes.changes(old, old.repartition(2)).collect() == []
    assert bag(changes.applied(spark.createDataFrame([], SCHEMA), changes.changes(spark.createDataFrame([], SCHEMA), old))) == bag(old)


def test_columns_in_another_order(drops):
    old, new = drops
    assert bag(changes.changes(old, new)) == bag(changes.changes(old, new.select(*reversed(new.columns))))


@pytest.mark.parametrize("dates", [{"onset": "onset"}, {"a": "onset", "b": "onset"}])
def test_counts_follow_changes(drops, dates):
    """Counts brought up to date equal a full recount, back again too; days without a case vanish."""
    old, new = drops
    for before, after in ((old, new), (new, old), (old, old.limit(0))):
        stored = aggregates.daily_counts(before, ["region"], dates, until=DAYS[5], after=DAYS[0])
        delta = changes.daily_changes(changes.changes(before, after), ["region"], dates, until=DAYS[5], after=DAYS[0])
        want = aggregates.daily_counts(after, ["region"], dates, until=DAYS[5], after=DAYS[0])
        assert bag(changes.merged_counts(stored, delta)) == bag(want)


KEYS, CELLS = ["region", "day"], ["v", "w"]
RUNS = [dt.date(2022, 1, d) for d in (1, 4, 9, 20)]


def snapshot(spark, rows):
    return spark.createDataFrame(rows, "region string, day int, v double, w double")


@pytest.fixture(scope="module")
def history():
    rng = random.Random(9)
    states, now = [], {}
    for _ in RUNS:
        for region in ("a", None, "b"):
            for day in range(6):
                roll = rng.random()
                if roll < 0.3:
                    now[region, day] = (rng.choice([None, 1.0, 2.5]), rng.choice([None, 0.0]))
                elif roll < 0.45:
                    now.pop((region, day), None)
        states.append(dict(now))
    return states


def stored(spark, folder, history):
    for date, state in zip(RUNS, history):
        versions.append_version(snapshot(spark, [(*k, *v) for k, v in state.items()]), folder, date, KEYS, CELLS)
    return folder


def test_any_past_state(spark, folder, history):
    """Every run can be read, and any day between two runs; rows that went are gone and may come back."""
    stored(spark, folder, history)
    for date, state in zip(RUNS, history):
        got = {(r["region"], r["day"]): (r["v"], r["w"]) for r in
               versions.read_versions(spark, folder, KEYS, CELLS, [date + dt.timedelta(1)]).collect()}
        assert got == state
    every = versions.read_versions(spark, folder, KEYS, CELLS).groupBy("run_date").count().collect()
    assert {r["run_date"]: r["count"] for r in every} == {d: len(s) for d, s in zip(RUNS, history) if s}
    assert versions.read_versions(spark, folder, KEYS, CELLS, [RUNS[0] - dt.timedelta(1)]).collect() == []


def test_same_run_again(spark, folder, history):
    """An unchanged run stores no cell; the latest one is replaced, with fewer changes too; earlier ones are refused."""
    stored(spark, folder, history[:2])
    same = snapshot(spark, [(*k, *v) for k, v in history[1].items()])
    versions.append_version(same, folder, RUNS[2], KEYS, CELLS)
    assert versions.stored_changes(spark, folder, RUNS[2]).count() == 0
    other = snapshot(spark, [("z", 1, 5.0, None)])
    versions.append_version(other, folder, RUNS[3], KEYS, CELLS)
    versions.append_version(same, folder, RUNS[3], KEYS, CELLS)
    got = versions.read_versions(spark, folder, KEYS, CELLS, [RUNS[3]]).drop("run_date")
    assert bag(got) == bag(same)
    with pytest.raises(ValueError):
        versions.append_version(other, folder, RUNS[1], KEYS, CELLS)


def test_run_that_died(spark, folder, history):
    """Cells whose run was never named are not read."""
    stored(spark, folder, history[:1])
    lost = spark.createDataFrame([("a", 1, "v", 9.0, True)], "region string, day int, cell string, value double, present boolean")
    lost.write.parquet(f"{folder}/changes/valid_from=2022-01-04/version=vlost")
    assert versions.state_at(spark, folder, KEYS, RUNS[1]).where("value = 9").count() == 0


def test_other_runs_are_not_read(spark, folder, history, plan):
    stored(spark, folder, history)
    text = plan(versions.stored_changes(spark, folder, RUNS[1], RUNS[1]))
    assert "PartitionFilters: [" in text and "version" in text.split("PartitionFilters: [")[1].split("]")[0]
    files = versions.stored_changes(spark, folder, RUNS[1], RUNS[1]).select(F.input_file_name().alias("f")).distinct().collect()
    assert all("valid_from=2022-01-04" in r["f"] for r in files)
