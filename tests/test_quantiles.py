import numpy as np
import pytest
from pyspark.sql import functions as F

from tenura.operators.distributions import box_stats, density, histogram, scatter_bins
from tenura.operators.ltv import cap_quantile, capped_and_segmented, quartile_segment
from tenura.operators.quantiles import SHIFTS, approximate_quantiles, counted_values, digit_cells, quantiles, rank_values

PROBABILITIES = {"a": 0.0, "b": 0.25, "c": 0.5, "d": 0.9, "e": 0.99, "f": 1.0}
RANDOM = np.random.default_rng(7)
CASES = {
    "normal": RANDOM.normal(size=3001),
    "outlier": np.append(RANDOM.uniform(0, 1, 2000), [1e12]),
    "one hot value": np.append(np.full(2000, 3.25), RANDOM.uniform(0, 10, 1000)),
    "constant": np.full(17, 4.5),
    "single": np.array([2.0]),
    "two": np.array([1.0, 2.0]),
    "negative": -RANDOM.exponential(size=999),
    "close together": 1.0 + np.arange(500) * 1e-15,
}


@pytest.mark.parametrize("case", CASES)
def test_quantiles_match_numpy(spark, case):
    values = CASES[case]
    df = spark.createDataFrame([(float(v),) for v in values], "v double").repartition(5)
    got = quantiles(df, "v", PROBABILITIES).first()
    want = np.quantile(values, list(PROBABILITIES.values()))
    assert np.allclose([got[n] for n in PROBABILITIES], want, rtol=1e-13, atol=0)


@pytest.mark.parametrize("case", ["outlier", "lognormal", "clusters", "bits"])
def test_no_aggregation_holds_more_than_its_cells(spark, case):
    """What is counted to find a rank is 65,536 cells at most; no value is sorted, no file written, four digits are enough."""
    n = 40_000
    values = {
        "outlier": np.append(RANDOM.uniform(0, 1, n), [1e13]),
        "lognormal": RANDOM.lognormal(0, 8, n),
        "clusters": 1e6 * RANDOM.integers(0, 3, n) + RANDOM.uniform(0, 1e-6, n),
        "bits": (np.float64(1.0).view(np.int64) + np.arange(70_000)).view(np.float64),  # neighbours in the last places
    }[case]
    df = spark.createDataFrame([(float(v),) for v in values], "v double").repartition(8)
    counted = counted_values(df, "v")
    one = spark.createDataFrame([(0,)], "_prefix long")
    for shift in SHIFTS:
        wanted = None
        if shift != SHIFTS[0]:  # the fullest prefix is the worst that can be wanted
            best = digit_cells(counted, [], shift + 16).orderBy(F.desc("_c")).first()["_at"]
            wanted = one.select(F.lit(best).alias("_prefix"))
        assert digit_cells(counted, [], shift, wanted).count() <= 65_536
    found = quantiles(df, "v", PROBABILITIES)
    assert np.allclose(list(found.first()), np.quantile(values, list(PROBABILITIES.values())), rtol=1e-13)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "rangepartitioning" not in plan and "FileScan" not in plan


def test_quantiles_of_signed_zeros_and_infinities(spark):
    df = spark.createDataFrame([(v,) for v in (-np.inf, -1.5, -0.0, 0.0, 2.0, np.inf, None)], "v double")
    got = rank_values(df, "v", [0.0, 0.4, 0.5, 0.6, 1.0]).orderBy("probability").collect()
    assert [(r.lower, r.upper) for r in got] == [(-np.inf,) * 2, (0.0, 0.0), (0.0, 0.0), (0.0, 0.0), (np.inf,) * 2]


def test_quantiles_per_group_skip_nulls(spark):
    rows = [("x", float(i)) for i in range(100)] + [("y", 5.0), ("y", None), (None, 1.0)]
    df = spark.createDataFrame(rows, "g string, v double")
    got = {r["g"]: r["m"] for r in quantiles(df, "v", {"m": 0.5}, ["g"]).collect()}
    assert got == {"x": 49.5, "y": 5.0}


def test_ranks_of_nothing(spark):
    empty = spark.createDataFrame([], "v double")
    assert rank_values(empty, "v", [0.5]).count() == 0


def test_cap_and_segments_as_pandas_would(spark):
    import pandas as pd

    for n in (2, 3, 4, 5, 9, 400):
        values = np.round(RANDOM.uniform(0, 5000, n), 2)
        df = spark.createDataFrame([(i, float(v)) for i, v in enumerate(values)], "k int, ltv_projected double")
        got = capped_and_segmented(df).toPandas().sort_values("k")
        s = pd.Series(values)
        capped = s.clip(upper=s.quantile(0.99))
        want = pd.qcut(capped, 4, labels=["Low", "Medium", "High", "Premium"]).astype(str)
        assert np.allclose(got["ltv_projected"], capped)
        assert list(got["ltv_segment"]) == list(want)


def test_ties_at_a_quartile_edge_stay_together(spark):
    df = spark.createDataFrame([(float(v),) for v in [1, 2, 2, 2, 2, 2, 8, 9]], "ltv_projected double")
    got = quartile_segment(df).groupBy("ltv_projected").agg(F.collect_set("ltv_segment").alias("s")).collect()
    assert all(len(r["s"]) == 1 for r in got)


def test_cap_alone(spark):
    df = spark.createDataFrame([(float(v),) for v in range(101)], "v double")
    assert cap_quantile(df, "v", 0.5).agg(F.max("v")).first()[0] == 50.0


def test_approximate_cap_is_close_in_rank(spark):
    df = spark.range(10000).select(F.col("id").cast("double").alias("v"))
    assert abs(cap_quantile(df, "v", 0.9, accuracy=1000).agg(F.max("v")).first()[0] - 9000) <= 10
    by = approximate_quantiles(df.withColumn("g", F.col("v") % 2), "v", {"m": 0.5}, ["g"], accuracy=1000)
    assert by.count() == 2


@pytest.mark.parametrize("bins", [1, 7, 30])
def test_histogram_matches_numpy(spark, bins):
    for values in (np.arange(73.0), CASES["normal"], np.round(RANDOM.uniform(0, 1, 500), 2), CASES["constant"]):
        df = spark.createDataFrame([(float(v),) for v in values], "v double")
        got = histogram(df, "v", bins).orderBy("bin").toPandas()
        want, edges = np.histogram(values, bins)
        assert list(got["rows"]) == list(want)
        assert np.allclose(got["left_edge"], edges[:-1])


def test_density_matches_the_formula(spark):
    values = RANDOM.integers(0, 40, 300).astype(float)
    df = spark.createDataFrame([(float(v),) for v in values], "v double")
    got = density(df, "v", grid=50).orderBy("point").toPandas()
    h = values.std(ddof=1) * len(values) ** -0.2
    x = np.linspace(values.min() - np.ptp(values) / 2, values.max() + np.ptp(values) / 2, 50)
    want = np.exp(-0.5 * ((x[:, None] - values) / h) ** 2).sum(axis=1) / (len(values) * h * np.sqrt(2 * np.pi))
    assert np.allclose(got["x"], x)
    assert np.allclose(got["density"], want)


def test_density_of_a_continuous_column_is_close(spark):
    values = CASES["normal"]
    df = spark.createDataFrame([(float(v),) for v in values], "v double")
    got = density(df, "v", grid=40).orderBy("point").toPandas()
    h = values.std(ddof=1) * len(values) ** -0.2
    x = got["x"].to_numpy()
    want = np.exp(-0.5 * ((x[:, None] - values) / h) ** 2).sum(axis=1) / (len(values) * h * np.sqrt(2 * np.pi))
    assert np.allclose(got["density"], want, atol=1e-5)
    assert np.abs(got["density"] - want).max() < 1e-12 * want.max()


@pytest.mark.parametrize("tail", ["lognormal", "outlier", "pareto"])
def test_density_of_a_heavy_tail(spark, tail):
    values = {
        "lognormal": RANDOM.lognormal(0, 3, 4000),
        "outlier": np.append(RANDOM.normal(size=3000), [1e9]),
        "pareto": RANDOM.pareto(0.7, 4000),
    }[tail]
    df = spark.createDataFrame([(float(v),) for v in values], "v double").repartition(6)
    got = density(df, "v", grid=500).orderBy("point").toPandas()
    h = values.std(ddof=1) * len(values) ** -0.2
    x = np.linspace(values.min() - np.ptp(values) / 2, values.max() + np.ptp(values) / 2, 500)
    want = np.exp(-0.5 * ((x[:, None] - values) / h) ** 2).sum(axis=1) / (len(values) * h * np.sqrt(2 * np.pi))
    assert len(got) == 500 and np.abs(got["density"] - want).max() < 1e-9 * want.max()


def test_box_by_hand(spark):
    df = spark.createDataFrame([(float(v),) for v in [1, 2, 3, 4, 5, 6, 7, 8, 100]], "v double")
    box = box_stats(df, "v").first()
    assert (box["q1"], box["median"], box["q3"]) == (3.0, 5.0, 7.0)
    assert (box["whisker_low"], box["whisker_high"], box["outliers"], box["n"]) == (1.0, 8.0, 1, 9)


def test_scatter_counts_every_row(spark):
    df = spark.range(1000).select(F.rand(1).alias("x"), F.rand(2).alias("y"))
    got = scatter_bins(df, "x", "y", 10)
    assert got.agg(F.sum("rows")).first()[0] == 1000
    assert got.agg(F.max("x_bin"), F.max("y_bin")).first()[:] == (9, 9)
