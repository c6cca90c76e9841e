"""Operators on small hand-written tables."""

import datetime as dt
import math
from statistics import NormalDist

import numpy as np
import pytest
from pyspark.sql import functions as F

from epitally.functions.normal import normal_quantile, upper_tail
from epitally.operators import aggregates as A
from epitally.operators import filters as L
from epitally.operators import joins as J
from epitally.operators import quantiles, ranges
from epitally.operators import reshape as R
from epitally.operators import series as S
from epitally.operators.density import density
from epitally.operators.quantiles import bounded_quantiles, exact_quantiles
from epitally.operators.sampling import prior_draws, sample_rows

D = dt.date


def days(spark, values, start=D(2020, 1, 1)):
    data = [("a", start + dt.timedelta(i), float(v)) for i, v in enumerate(values)]
    return spark.createDataFrame(data, "region string, date date, values double")


def test_sums_and_missing_values(spark, rows):
    df = spark.createDataFrame([("a", 1), ("a", None), ("b", 2), ("c", None)], "g string, v int")
    out = df.groupBy("g").agg(A.strict_sum("v"), A.skip_sum("v"), A.row_count())
    assert rows(out, "g") == [("a", None, 1, 2), ("b", 2, 2, 1), ("c", None, 0, 1)]


def test_daily_counts_of_several_dates(spark, rows):
    day = D(2020, 3, 1)
    df = spark.createDataFrame(
        [("a", day, None), ("a", day, day), (None, None, day)], "region string, x date, y date"
    )
    out = A.daily_counts(df, ["region"], {"seen": "x", "dead": "y"})
    assert rows(out.select("series", "region", "values"), "series", "region") == [
        ("dead", None, 1), ("dead", "a", 1), ("seen", "a", 2),
    ]
    assert rows(A.daily_counts(df, [], {"seen": "x"}).select("series", "values")) == [("seen", 2)]


def test_the_nation_holds_the_region_without_a_name(spark, rows):
    day = D(2020, 3, 1)
    df = spark.createDataFrame([("a", day, 2), (None, day, 3)], "region string, date date, values long")
    want = [(None, 3), ("a", 2), ("nation", 5)]
    assert rows(A.with_national(df, ["region", "date"], "nation").select("region", "values"), "region") == want
    out = A.national_and_regional(df, ["region", "date"], "nation", [F.sum("values").alias("values")])
    assert rows(out.select("region", "values"), "region") == want


def test_ordered_text(spark, rows):
    df = spark.createDataFrame([(42, 7), (41, 3)], "times int, values long")
    assert rows(A.ordered_text(df, [])) == [("41, 42", "3, 7", "[3],[7]")]
    assert rows(A.ordered_text(df.where("times > 99"), [])) == []


def test_adjusted_r2_needs_three_pairs(spark):
    data = [("a", 1.0, 1.0), ("a", 2.0, 2.5), ("a", 3.0, 2.0), ("a", 4.0, None), ("b", 1.0, 1.0), ("b", 2.0, 2.0)]
    df = spark.createDataFrame(data, "g string, y double, x double")
    out = dict(df.groupBy("g").agg(A.adjusted_r2("y", "x")).collect())
    r = np.corrcoef([1, 2, 3], [1, 2.5, 2])[0, 1]
    assert out["a"] == pytest.approx(1 - (1 - r * r) * 2 / 1)
    assert out["b"] is None


def test_left_rolling_mean(spark):
    df = days(spark, range(1, 10)).select("date", S.rolling(["region"], "date", "values", 7).alias("m"))
    assert [r.m for r in df.orderBy("date").collect()] == [4, 5, 6] + [None] * 6


def test_centred_rolling_mean(spark):
    df = days(spark, range(1, 23)).select("date", S.rolling(["region"], "date", "values", 20, "center").alias("m"))
    assert [r.m for r in df.orderBy("date").collect()] == [None] * 9 + [10.5, 11.5, 12.5] + [None] * 10


def test_an_absent_day_is_not_zero(spark):
    start = D(2020, 1, 1)
    data = [("a", start + dt.timedelta(i), 7.0) for i in (0, 2, 3, 4, 5, 6)]
    df = S.fill_days(spark.createDataFrame(data, "region string, date date, values double"), ["region"])
    assert [r["values"] for r in df.orderBy("date").collect()] == [7, None, 7, 7, 7, 7, 7]
    means = df.select("date", S.rolling(["region"], "date", "values", 7).alias("m")).orderBy("date").collect()
    assert means[0].m == 7


def test_weeks_end_on_sunday(spark, rows):
    df = spark.createDataFrame(
        [("a", D(2020, 8, 22), 2.0), ("a", D(2020, 8, 23), 4.0), ("a", D(2020, 8, 24), 9.0)],
        "region string, date date, values double",
    )
    assert rows(S.weekly(df, ["region"]), "date") == [("a", D(2020, 8, 23), 3.0), ("a", D(2020, 8, 24), 9.0)]


def test_tail_is_cut_from_the_last_day_of_the_group(spark):
    df = spark.createDataFrame([("a", t) for t in range(50, 101)], "region string, times int")
    kept = [r.times for r in L.trim_tail(df, ["region"], 60, 9).orderBy("times").collect()]
    assert kept == list(range(61, 91))


def test_ties_at_the_maximum_are_kept(spark, rows):
    df = spark.createDataFrame([("a", 1, 5), ("a", 2, 5), ("a", 3, 4), (None, 4, 1)], "g string, i int, v int")
    assert rows(L.rows_at_max(df, ["g"], "v").select("i"), "i") == [(1,), (2,), (4,)]


def test_blank_and_missing_names_are_alike(spark, rows):
    df = spark.createDataFrame(
        [(1, "P", "", None), (2, "P", None, ""), (3, "P", "x", ""), (4, "P", "", "M"), (5, "Q", "", "")],
        "i int, country_region string, sub_region_1 string, metro_area string",
    )
    assert rows(df.where(L.area("P")).select("i"), "i") == [(1,), (2,)]
    assert rows(df.where(L.area("P", "x")).select("i"), "i") == [(3,)]


def test_missing_keys_meet(spark, rows):
    left = spark.createDataFrame([(None, 1), ("a", 2), ("b", 3)], "k string, x int")
    right = spark.createDataFrame([(None, 10), ("a", 20)], "k string, y int")
    assert rows(J.join_null_safe(left, right, ["k"]), "x") == [(None, 1, 10), ("a", 2, 20), ("b", 3, None)]


def test_group_statistic(spark, rows):
    df = spark.createDataFrame([("a", 1.0), ("a", 3.0), (None, 5.0)], "g string, v double")
    out = J.group_statistic(df, ["g"], [F.avg("v").alias("m")])
    assert rows(out, "v") == [("a", 1.0, 2.0), ("a", 3.0, 2.0), (None, 5.0, 5.0)]


def test_wide_cells_hold_one_value(spark, rows):
    df = spark.createDataFrame(
        [("a", 0.5, 1.0), ("a", 0.25, 2.0), ("b", None, None)], "k string, quantile double, value double"
    )
    out = R.quantile_wide(df, ["k"], {0.25: "q25", 0.5: "q50"})
    assert rows(out, "k") == [("a", 2.0, 1.0), ("b", None, None)]
    with pytest.raises(Exception, match="more than one row"):
        R.quantile_wide(df.union(df), ["k"]).collect()


def test_headers_by_pattern(spark):
    df = spark.createDataFrame([(1, 2, 3)], "`X0.4` int, `X100.` int, region int")
    out = R.rename_headers(df, (r"^X", ""), (r"\.$", "+"), (r"\.", "-"))
    assert out.columns == ["0-4", "100+", "region"]


def test_carry_forward(spark, rows):
    df = spark.createDataFrame([(1, 0.5), (3, 0.7)], "times int, v double")
    out = S.carry_forward(df, F.lit(5), "times", "v")
    assert rows(out, "times") == [(1, 0.5, False), (3, 0.7, False), (4, 0.7, True), (5, 0.7, True)]
    assert S.carry_forward(df, F.lit(2), "times", "v").count() == 2


def test_last_observed(spark, rows):
    df = spark.createDataFrame(
        [("r", "a", 9, D(2020, 1, 9), 1.0), ("r", "b", 1, D(2020, 1, 1), 1.0), ("r", "b", 2, D(2020, 1, 2), None)],
        "run string, region string, times int, date date, v double",
    )
    assert rows(S.last_observed(df, ["run"], ["region", "times"], "v", "date", "d")) == [("r", D(2020, 1, 1))]


PROBS = {0.0: "q0", 0.025: "q025", 0.25: "q25", 0.5: "q50", 0.975: "q975", 1.0: "q1"}


def check_quantiles(spark, groups, **sizes):
    data = [(g, float(v)) for g, vs in groups.items() for v in vs]
    df = spark.createDataFrame(data + [("x", None)], "g string, v double").repartition(5)
    out = {r.g: r for r in exact_quantiles(df, ["g"], "v", PROBS, **sizes).collect()}
    assert set(out) == {*groups, "x"}
    assert all(out["x"][n] is None for n in PROBS.values())
    for g, vs in groups.items():
        for p, n in PROBS.items():
            assert out[g][n] == pytest.approx(np.quantile(vs, p), rel=1e-12, abs=1e-12), (g, p)


def test_exact_quantiles_of_small_groups(spark):
    check_quantiles(spark, {"a": [1, 2, 4], "b": [5], "c": [1, 1, 1, 2], "d": range(10), "e": [3, 1]})


def test_exact_quantiles_of_groups_that_are_narrowed(spark):
    rng = np.random.default_rng(3)
    check_quantiles(
        spark,
        {
            "normal": rng.normal(size=20_000),
            "skewed": np.exp(rng.normal(size=9_001) * 3),
            "tied": rng.integers(0, 4, size=15_000),
            "hot": np.concatenate([np.full(20_000, 7.0), rng.normal(size=999)]),
            "one": np.full(5_000, 1.5),
            "far": np.concatenate([rng.normal(size=5_000), [1e12, -1e12]]),
        },
        accuracy=400,
    )


def test_exact_quantiles_with_infinite_values(spark):
    inf = float("inf")
    groups = {"up": [*range(3_000), inf], "both": [-inf, *range(2_000), inf], "all": [inf] * 2_000}
    df = spark.createDataFrame([(g, float(v)) for g, vs in groups.items() for v in vs], "g string, v double")
    for accuracy in (100, 10_000):
        out = {r.g: r.m for r in exact_quantiles(df, ["g"], "v", {0.5: "m"}, accuracy=accuracy).collect()}
        assert out == {"up": 1500.0, "both": 999.5, "all": inf}


def test_samples_with_equal_keys_do_not_depend_on_partitions(spark):
    df = spark.createDataFrame([("a", i % 3, float(i)) for i in range(60)], "g string, k int, v double")
    first, second = (
        {(r.id, r.v) for r in sample_rows(df.repartition(n, "v"), ["g"], 7, "k", 1).collect()} for n in (2, 9)
    )
    assert first == second and len(first) == 7


def test_prior_cut_far_out(spark):
    prior = [{"name": "p", "kind": "normal", "mean": 0.0, "sd": 1.0, "lower": 6.0}]
    drawn = [r.value for r in prior_draws(spark.range(400), "id", prior, 1).collect()]
    # The mean of a normal beyond six deviations is 6.158.
    assert min(drawn) >= 6.0 and np.mean(drawn) == pytest.approx(6.158, abs=0.03)


@pytest.mark.parametrize("lower", [-6.0, 0.0, 0.01, 0.5, 6.0])
def test_cut_normals_follow_their_distribution(spark, lower):
    """Shares below exact quantiles of the cut normal, at bounds in the middle, just above it and far out."""
    prior = [{"name": "p", "kind": "normal", "mean": 2.0, "sd": 3.0, "lower": 2.0 + 3.0 * lower}]
    n, normal = 40_000, NormalDist()
    drawn = np.array([r.value for r in prior_draws(spark.range(n), "id", prior, 5).collect()])
    left = upper_tail(lower)
    assert drawn.min() >= 2.0 + 3.0 * lower
    for p in (0.02, 0.1, 0.3, 0.5, 0.7, 0.9, 0.98):
        exact = 2.0 - 3.0 * normal.inv_cdf(left * (1 - p))
        assert np.mean(drawn <= exact) == pytest.approx(p, abs=4.5 * (p * (1 - p) / n) ** 0.5)


def test_normal_quantile(spark):
    ps = [1e-300, 1e-20, 1e-9, 0.001, 0.07, 0.0751, 0.3, 0.5, 0.7, 0.925, 0.99, 1 - 1e-12]
    got = spark.createDataFrame([(p,) for p in [*ps, 0.0, 1.0, -0.5, None]], "p double").select(normal_quantile(F.col("p"))).collect()
    assert [r[0] for r in got[:-4]] == pytest.approx([NormalDist().inv_cdf(p) for p in ps], rel=1e-13, abs=1e-15)
    assert [r[0] for r in got[-4:]] == [-math.inf, math.inf, None, None]


def test_samples_of_one_large_group(spark, plan):
    """One scan, no count before it, and the same rows as by a plain sort; more rows than Spark cuts in tasks, too."""
    df = spark.range(300_000).select(F.when(F.col("id") >= 0, "hot").alias("g"), "id").repartition(16)
    h = F.md5(F.concat_ws("|", F.col("id").cast("string"), F.lit("4")).cast("binary"))
    for n in (500, 3000):
        got = sample_rows(df, ["g"], n, "id", seed=4, rank="n")
        want = [r["id"] for r in df.orderBy(h, "id").limit(n).collect()]
        assert [r["id"] for r in got.orderBy("n").collect()] == want
    text = plan(sample_rows(df, ["g"], 500, "id", seed=4, rank="n"))
    assert text.split("Initial Plan")[0].count("Range (") == 1 and text.count("WindowGroupLimit") >= 4 and "Broadcast" not in text


def test_exact_quantiles_of_a_missing_group(spark):
    df = spark.createDataFrame([(None, 1.0), (None, 3.0), ("a", 5.0)], "g string, v double")
    out = {r.g: r.m for r in exact_quantiles(df, ["g"], "v", {0.5: "m"}).collect()}
    assert out == {None: 2.0, "a": 5.0}


def test_quantiles_of_one_large_group(spark, monkeypatch):
    """Values in brackets are ordered in range partitions, no more than its share in any; nothing is gathered by group."""
    df = spark.range(400_000).select(F.when(F.col("id") >= 0, "hot").alias("g"), (F.col("id") * 7919 % 400_000).cast("double").alias("v"))
    probs = {0.025: "a", 0.5: "b", 0.975: "c"}
    seen = []

    def scan(steps, *rest, **named):
        seen.append(ranges.in_ranges(steps, ["g"], ["_least"]).groupBy(ranges.PART).count().collect())
        return ranges.prefix_scan(steps, *rest, **named)

    monkeypatch.setattr(quantiles, "prefix_scan", scan)
    off = {"spark.sql.autoBroadcastJoinThreshold": -1, "spark.sql.adaptive.coalescePartitions.enabled": False}
    for name, setting in off.items():
        spark.conf.set(name, setting)
    try:
        got = exact_quantiles(df, ["g"], "v", probs, accuracy=200, in_task=1000).first()
        many = exact_quantiles(df.unionByName(spark.range(3000).select(F.col("id").cast("string").alias("g"), F.lit(1.0).alias("v"))),
                               ["g"], "v", probs, accuracy=200).where("g in ('hot', '77')").orderBy("g").collect()
    finally:
        for name in off:
            spark.conf.unset(name)
    want = [399_999 * p for p in probs]
    assert list(got)[1:] == pytest.approx(want) and list(many[1])[1:] == pytest.approx(want) and list(many[0])[1:] == [1.0] * 3
    sizes = [r["count"] for r in seen[0]]
    assert len(sizes) == 8 and max(sizes) < 2 * sum(sizes) / 8


def test_a_rank_outside_every_bracket_is_an_error(spark, monkeypatch):
    df = spark.range(5000).select(F.lit("a").alias("g"), F.col("id").cast("double").alias("v"))
    wrong = lambda *_: F.array(*[F.lit(float(x)) for x in (10, 20)])
    monkeypatch.setattr(quantiles.F, "percentile_approx", wrong)
    with pytest.raises(Exception, match="no bracket holds"):
        exact_quantiles(df, ["g"], "v", {0.5: "m"}, accuracy=100).collect()


def test_bounded_quantiles(spark):
    df = spark.createDataFrame([(1.0,), (2.0,), (4.0,)], "v double")
    row = df.agg(*bounded_quantiles("v", {0.025: "a", 0.5: "b", 0.975: "c"})).first()
    assert tuple(row) == pytest.approx((1.05, 2.0, 3.9))


def test_samples_are_repeatable_and_whole(spark, plan):
    df = spark.range(20_000).select(F.when(F.col("id") % 3 > 0, "hot").otherwise("cold").alias("g"), "id")
    one = sample_rows(df.repartition(7), ["g"], 50, "id", seed=1, rank="n")
    two = sample_rows(df.repartition(3), ["g"], 50, "id", seed=1, rank="n")
    other = sample_rows(df, ["g"], 50, "id", seed=2, rank="n")
    key = lambda d: sorted(tuple(r) for r in d.collect())
    assert key(one) == key(two) != key(other)
    assert one.groupBy("g").agg(F.count_distinct("id")).collect() == one.groupBy("g").count().collect()
    assert all(r["count"] == 50 for r in one.groupBy("g").count().collect())
    assert "WindowGroupLimit" in plan(one)
    small = sample_rows(df.where("id < 9"), ["g"], 50, "id", seed=1, rank="n")
    assert small.count() == 9


def test_prior_draws(spark):
    priors = [
        {"name": "u", "kind": "uniform", "low": 2.0, "high": 4.0},
        {"name": "n", "kind": "normal", "mean": 1.0, "sd": 0.2, "lower": 0.9},
    ]
    out = prior_draws(spark.range(20_000), "id", priors, seed=5).toPandas()
    u, n = out[out.name == "u"].value, out[out.name == "n"].value
    assert len(u) == len(n) == 20_000
    assert u.between(2, 4).all() and abs(u.mean() - 3) < 0.02
    assert (n >= 0.9).all()
    a = (0.9 - 1.0) / 0.2
    tail = 0.5 * math.erfc(a / math.sqrt(2))
    mean = 1.0 + 0.2 * math.exp(-a * a / 2) / math.sqrt(2 * math.pi) / tail
    assert abs(n.mean() - mean) < 0.005


def test_density_against_the_plain_sum(spark):
    rng = np.random.default_rng(1)
    values = {"x": rng.normal(size=400), "y": rng.normal(loc=2, size=300)}
    df = spark.createDataFrame([("p", t, float(v)) for t, vs in values.items() for v in vs],
                               "name string, type string, value double")
    out = density(df, ["name"], ["type"], grid=512).toPandas()
    both = np.concatenate(list(values.values()))
    for t, vs in values.items():
        got = out[out.type == t].sort_values("point")
        grid = np.linspace(both.min(), both.max(), 512)
        assert got.x.to_numpy() == pytest.approx(grid)
        iqr = np.quantile(vs, 0.75) - np.quantile(vs, 0.25)
        bw = 0.9 * min(np.std(vs, ddof=1), iqr / 1.34) * len(vs) ** -0.2
        z = (grid[:, None] - vs[None, :]) / bw
        plain = np.exp(-0.5 * z * z).sum(axis=1) / (len(vs) * bw * math.sqrt(2 * math.pi))
        # Binning costs a little accuracy, as in the usual fast density estimate.
        assert np.abs(got.density.to_numpy() - plain).max() < 2e-3
