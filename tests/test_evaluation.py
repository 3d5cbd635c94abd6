import itertools
import math
from statistics import NormalDist

import numpy as np
import pytest
from pyspark.sql import functions as F

from barspark.functions.normal import normal_cdf, normal_ppf
from barspark.operators import evaluation as E


def test_normal_distribution(spark):
    xs = [-9.0, -6.5, -3.0, -1.0, -1e-9, 0.0, 0.3, 2.5, 5.0, 8.5]
    got = spark.createDataFrame([(x,) for x in xs], "x DOUBLE").select("x", normal_cdf(F.col("x")).alias("p")).collect()
    for r in got:
        assert abs(r["p"] - NormalDist().cdf(r["x"])) < 1e-14
    ps = [1e-6, 0.01, 0.3, 0.5, 0.9, 0.999999]
    for r in spark.createDataFrame([(p,) for p in ps], "p DOUBLE").select("p", normal_ppf(F.col("p")).alias("x")).collect():
        assert abs(r["x"] - NormalDist().inv_cdf(r["p"])) < 1e-9
    assert spark.range(1).select(normal_ppf(F.lit(1.0))).first()[0] is None


@pytest.fixture(scope="module")
def returns(spark):
    rng = np.random.default_rng(5)
    values = rng.normal(0.001, 0.02, (61, 4))
    rows = [(i, f"s{j}", float(values[i, j])) for i in range(61) for j in range(4)]
    df = spark.createDataFrame(rows, "i INT, strategy STRING, ret DOUBLE").withColumn("period", F.date_add(F.lit("2023-11-20").cast("date"), F.col("i")))
    return values, df


def test_overfitting_probability_matches_the_definition(returns):
    values, df = returns
    blocks = np.array_split(np.arange(61), 6)
    ratio = lambda x: x.mean(axis=0) / x.std(axis=0, ddof=1)
    logits, lost = [], []
    for chosen in itertools.combinations(range(6), 3):
        a = ratio(values[np.concatenate([blocks[b] for b in chosen])])
        b = ratio(values[np.concatenate([blocks[b] for b in range(6) if b not in chosen])])
        w = int(a.argmax())
        rank = ((b < b[w]).sum() + 1) / 5
        logits.append(math.log(rank / (1 - rank)))
        lost.append(a[w] - b[w])
    got = E.overfitting_probability(df.select("period", "strategy", "ret"), 6).first()
    assert got["combinations"] == 20
    assert got["probability_of_overfitting"] == pytest.approx(np.mean(np.array(logits) <= 0))
    assert got["mean_oos_degradation"] == pytest.approx(np.mean(lost), rel=1e-9)
    with pytest.raises(ValueError):
        E.overfitting_splits(df, 5)


def test_deflated_sharpe_matches_the_formula(returns):
    values, df = returns
    m = E.sharpe_moments(df)
    got = {r["strategy"]: r for r in E.deflated_sharpe(m, m).collect()}
    trials = values.mean(axis=0) / values.std(axis=0, ddof=1)
    z, n, g = NormalDist(), 4, E.EULER_GAMMA
    bench = trials.mean() + trials.std(ddof=1) * ((1 - g) * z.inv_cdf(1 - 1 / n) + g * z.inv_cdf(1 - 1 / (n * math.e)))
    for j in range(4):
        x = values[:, j] - values[:, j].mean()
        skew, kurt = (x**3).mean() / (x**2).mean() ** 1.5, (x**4).mean() / (x**2).mean() ** 2
        s = trials[j]
        want = z.cdf((s - bench) * math.sqrt(60) / math.sqrt(1 - skew * s + (kurt - 1) / 4 * s * s))
        assert got[f"s{j}"]["deflated_probability"] == pytest.approx(want, rel=1e-8)
        assert got[f"s{j}"]["benchmark"] == pytest.approx(bench, rel=1e-9)


def test_portfolio_metrics_of_a_short_series(spark):
    navs = [100.0, 110.0, 99.0, 120.0]
    df = spark.createDataFrame([("a", i, v) for i, v in enumerate(navs)], "strategy STRING, i INT, nav DOUBLE").withColumn("date", F.date_add(F.lit("2023-12-30").cast("date"), F.col("i")))
    r = E.portfolio_metrics(df).first()
    x = np.array(navs)[1:] / np.array(navs)[:-1] - 1
    assert r["maximum_drawdown"] == pytest.approx(0.1) and r["total_return"] == pytest.approx(0.2)
    assert r["sharpe"] == pytest.approx(x.mean() / x.std(ddof=1) * math.sqrt(252))
    assert r["sortino"] == 0.0 and r["positive_day_ratio"] == pytest.approx(2 / 3)  # one losing day has no deviation


def test_walk_forward_needs_enough_days(spark):
    days = spark.range(100).select(F.date_add(F.lit("2024-01-01").cast("date"), F.col("id").cast("int")).alias("date"))
    parts = E.walk_forward(days, validation=10, test=20, embargo=5, folds=2).groupBy("fold", "part").count().collect()
    got = {(r["fold"], r["part"]): r["count"] for r in parts}
    assert got[(1, "test")] == 20 and got[(1, "validation")] == 10 and got[(2, "embargo")] == 10 and got[(2, "train")] == 60
    with pytest.raises(Exception, match="needs"):
        E.walk_forward(days).collect()


def test_splits_are_every_half(spark):
    for n in (2, 6, 12):
        masks = [r[0] for r in spark.range(math.comb(n, n // 2)).select(E.split_mask(F.col("id"), n)).collect()]
        assert sorted(masks) == [m for m in range(2**n) if m.bit_count() == n // 2]


def test_more_than_twenty_partitions(spark):
    """24 partitions: every set once."""
    n, splits = 24, math.comb(24, 12)
    masks = spark.range(splits).select(E.split_mask(F.col("id"), n).alias("m"))
    assert tuple(masks.agg(F.min("m"), F.max("m"), F.count_distinct("m"), F.min(F.bit_count("m")), F.max(F.bit_count("m"))).first()) == (2**12 - 1, (2**12 - 1) << 12, splits, 12, 12)
