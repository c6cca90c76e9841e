"""Windows and running values of split groups against windows over the whole group."""

import datetime as dt
import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from epitally.operators import ranges, series

SCHEMA = "g string, o long, id long, v int"


@pytest.fixture(scope="module")
def data(spark):
    rng = random.Random(3)
    rows = [("hot" if rng.random() < 0.7 else rng.choice(["a", "b", None]), rng.choice([None, *range(40)]), i,
             rng.choice([None, None, 1, 5, -3])) for i in range(3000)]
    return spark.createDataFrame([*rows, ("one", 1, 1, None)], SCHEMA).repartition(5).cache()


def window(*frame):
    w = Window.partitionBy("g").orderBy("o", "id")
    return w.rowsBetween(*frame) if frame else w


def same(a, b):
    assert sorted(map(tuple, a.collect()), key=repr) == sorted(map(tuple, b.select(*a.columns).collect()), key=repr)


def test_ranked(data):
    got = ranges.ranked(data, ["g"], ["o", "id"])
    same(got, data.withColumn("rank", F.row_number().over(window()).cast("long") - 1)
         .withColumn("size", F.count(F.lit(1)).over(Window.partitionBy("g"))))


@pytest.mark.parametrize("align,frame", [("left", (0, 6)), ("center", (-3, 3)), ("right", (-6, 0))])
@pytest.mark.parametrize("block", [1, 8, 100_000])
def test_rolling(data, align, frame, block):
    """A block no longer than the halo is made as long as the halo."""
    got = ranges.rolling_rows(data, ["g"], ["o", "id"], "v", 7, "m", align, F.sum, block)
    want = data.withColumn("m", F.when(F.count(F.lit(1)).over(window(*frame)) == 7, F.sum("v").over(window(*frame))))
    same(got, want)


def test_leads(data):
    got = ranges.halo_window(data, ["g"], ["o", "id"], 2, 1,
                             lambda w: {"x": F.lag("id", 2).over(w), "y": F.lead("id").over(w)}, 16)
    same(got, data.withColumn("x", F.lag("id", 2).over(window())).withColumn("y", F.lead("id").over(window())))


def test_fill_days(spark):
    days = [("a", dt.date(2020, 1, 1) + dt.timedelta(d), d) for d in (0, 1, 5, 6, 30)] + [(None, dt.date(2020, 1, 1), None)]
    df = spark.createDataFrame(days, "g string, date date, values int")
    same(ranges.fill_days_rows(df, ["g"], block_rows=2), series.fill_days(df, ["g"]))


def test_prefix_scan(data):
    got = ranges.prefix_scan(data, ["g"], ["o", "id"], {"s": "v"}, {"t": "v"}, {"l": "v"}, {"s": "all", "l": "end"})
    up, whole = window(Window.unboundedPreceding, 0), window(Window.unboundedPreceding, Window.unboundedFollowing)
    same(got, data.withColumns({
        "s": F.sum("v").over(up), "t": F.max("v").over(up), "l": F.last("v", ignorenulls=True).over(up),
        "all": F.sum("v").over(whole), "end": F.last("v", ignorenulls=True).over(whole),
    }))


def test_trim_tail(data):
    got = ranges.trim_tail_rows(data, ["g"], 3, 5, "o")
    last = F.max("o").over(Window.partitionBy("g"))
    same(got, data.withColumn("last", last).where((F.col("o") > 3) & (F.col("o") < F.col("last") - 5)))


def test_empty(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert ranges.rolling_rows(none, ["g"], ["o", "id"], "v", 3, "m").collect() == []
    assert ranges.prefix_scan(none, ["g"], ["o"], {"s": "v"}).columns == ["g", "o", "id", "v", "s"]
    assert ranges.ranked(none, [], ["o"]).collect() == []


def test_no_group(data):
    """Without a key the whole table is one group."""
    w = Window.orderBy("o", "id")
    got = ranges.ranked(data, [], ["o", "id"])
    same(got, data.withColumn("rank", F.row_number().over(w).cast("long") - 1).withColumn("size", F.lit(3001)))


def test_one_large_group(spark, plan):
    """Two million rows of one group: the same result, and no window holds more than a block or a part."""
    rows = spark.range(2_000_000).select(F.lit("hot").alias("g"), (F.col("id") * 7919 % 2_000_000).alias("id"),
                                         (F.col("id") % 11).alias("v"))
    w = Window.partitionBy("g").orderBy("id")
    parts = ranges.in_ranges(rows, ["g"], ["id"]).groupBy(ranges.PART).count().collect()
    assert len(parts) == 8 and max(r["count"] for r in parts) < 2 * 2_000_000 / 8

    rolled = ranges.rolling_rows(rows, ["g"], ["id"], "v", 7, "m", agg=F.sum, block_rows=1 << 14)
    frame = w.rowsBetween(0, 6)
    want = rows.withColumn("m", F.when(F.count(F.lit(1)).over(frame) == 7, F.sum("v").over(frame)))
    assert rolled.exceptAll(want).count() == 0 and rolled.count() == 2_000_000

    scanned = ranges.prefix_scan(rows, ["g"], ["id"], {"s": "v"}, whole={"s": "all"})
    want = rows.withColumn("s", F.sum("v").over(w)).withColumn("all", F.lit(int(rows.agg(F.sum("v")).first()[0])))
    assert scanned.exceptAll(want).count() == 0 and scanned.count() == 2_000_000

    for text, split in ((plan(rolled), "_block"), (plan(scanned), ranges.PART)):
        windows = [line for line in text.splitlines() if " Window [" in line]
        assert windows and all(split in line for line in windows)
