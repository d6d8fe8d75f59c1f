"""Operators that spread what a single task once held, against plain versions on small fixtures."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from loxodrome.functions import distributions
from loxodrome.operators import analysis, spatial, stats


@pytest.fixture(scope="module")
def points():
    rng = random.Random(3)
    return [(i, rng.gauss(0, 3) if i % 3 else rng.uniform(-40, 40), rng.gauss(0, 3) if i % 3 else rng.uniform(-40, 40)) for i in range(250)]


def frame_of(spark, rows, schema="k bigint, x double, y double"):
    return spark.createDataFrame(rows, schema)


def test_running_sums(spark):
    rows = [(i * 7919 % 1000, i % 5) for i in range(700)]
    got = stats.running(spark.createDataFrame(rows, "o int, v int").repartition(5), ["o"], F.col("v"), "s").collect()
    # rows of equal order come in any order, so the largest sum of each is held
    last = {}
    for r in got:
        last[r["o"]] = max(last.get(r["o"], 0), r["s"])
    assert all(last[o] == sum(v for p, v in rows if p <= o) for o in last)
    assert stats.running(spark.createDataFrame([], "o int, v int"), ["o"], F.col("v"), "s").count() == 0


def test_quantiles(spark):
    rng = random.Random(1)
    rows = [(g, rng.choice([None, float(rng.randint(0, 20)), rng.random()])) for g in ("a", "b", None) for _ in range(rng.randint(1, 60))] + [("c", None), ("d", 4.0)]
    shares = [0.0, 0.1, 0.25, 0.5, 0.9, 1.0]
    got = {r["g"]: [r[f"q{i}"] for i in range(6)] for r in stats.quantiles(spark.createDataFrame(rows, "g string, v double"), "v", shares, ["g"]).collect()}
    for g in {r[0] for r in rows}:
        values = [float(v) for h, v in rows if h == g and v is not None]
        assert got.get(g) == (pytest.approx(np.quantile(values, shares).tolist()) if values else None)


@pytest.mark.parametrize("seed", [1, 2])
def test_kendall(spark, seed):
    rng = random.Random(seed)
    rows = [(rng.randint(0, 30), rng.randint(0, 12)) for _ in range(150)]
    want = sum(np.sign(b[0] - a[0]) * np.sign(b[1] - a[1]) for i, a in enumerate(rows) for b in rows[i + 1 :]) / (150 * 149 / 2)
    assert stats.kendall(spark.createDataFrame(rows, "x int, y int"), "x", "y").first()[0] == pytest.approx(want)
    one = spark.createDataFrame([(1, 1), (1, 2)], "x int, y int")
    assert stats.kendall(one, "x", "y").first()[0] == 0.0


@pytest.mark.parametrize("alpha", [0.9, 0.3, 0.01])
def test_ewma_of_long_series(spark, alpha):
    rng = random.Random(7)
    values = [rng.uniform(-5, 9) for _ in range(6000)]
    got = stats.ewma(spark.createDataFrame(list(enumerate(values)), "i int, v double").withColumn("g", F.lit(1)), "v", alpha, ["i"], ["g"]).orderBy("position").collect()
    e = values[0]
    for r, v in zip(got, values, strict=True):
        e = v if r["position"] == 0 else alpha * v + (1 - alpha) * e
        assert r["ewma"] == pytest.approx(e, rel=1e-9, abs=1e-9)


@pytest.mark.parametrize(("k", "size"), [(1, 0.5), (4, 5.0), (300, 10.0)])
def test_knn_against_all_pairs(spark, points, k, size):
    a, b = points[:60], points[60:]
    got = {}
    for r in spatial.knn_join(frame_of(spark, a), frame_of(spark, b), k, "k", "k", size).collect():
        got.setdefault(r["k"], []).append((r["rank"], r["k_b"]))
    for i, x, y in a:
        near = sorted((math.hypot(x - u, y - v), j) for j, u, v in b)[:k]
        assert [j for _, j in sorted(got[i])] == [j for _, j in near]


def test_dbscan_against_plain(spark, points):
    eps, least = 1.2, 4
    near = {i: [j for j, u, v in points if math.hypot(x - u, y - v) <= eps] for i, x, y in points}
    core = {i for i in near if len(near[i]) >= least}
    label, number = {}, 0
    for i in sorted(core):
        if i in label:
            continue
        number += 1
        todo = [i]
        while todo:
            j = todo.pop()
            if j not in label:
                label[j] = number
                todo += [n for n in near[j] if n in core]
    want = label | {i: min(label[j] for j in near[i] if j in core) for i in near if i not in core and any(j in core for j in near[i])}
    assert {r["k"]: r["cluster"] for r in analysis.dbscan(frame_of(spark, points), "k", eps, least).collect()} == want and number > 1


def test_idw_in_blocks(spark, points, monkeypatch):
    p, t = [(i, x, y, float(i)) for i, x, y in points[:50]], points[50:90]
    monkeypatch.setattr(analysis, "BLOCK", 7)
    got = {r["k"]: r["idw"] for r in analysis.idw(frame_of(spark, p, "k bigint, x double, y double, v double"), frame_of(spark, t), "k", "v").collect()}
    for i, x, y in t:
        w = [1 / ((x - u) ** 2 + (y - v) ** 2) for _, u, v, _ in p]
        assert got[i] == pytest.approx(sum(a * q[3] for a, q in zip(w, p, strict=True)) / sum(w))
    assert len(got) == len(t)


def test_bootstrap_is_near_the_normal_interval(spark):
    df = spark.range(2000).select("id", (F.col("id") * 7919 % 1000 / 100).alias("v"))
    a = stats.bootstrap_ci(df, "v", "id", 200).first()
    b = df.agg(stats.confidence_interval("v").alias("c")).first()["c"]
    assert abs(a["lo"] - b["lo"]) < 0.06 and abs(a["hi"] - b["hi"]) < 0.06
    assert stats.bootstrap_ci(df.repartition(7), "v", "id", 200).first() == pytest.approx(a)


def test_distributions(spark):
    """Known quantiles, and inverses that meet their distribution functions."""
    d = distributions
    one = lambda c: spark.range(1).select(c).first()[0]
    for dist, p, x in ((d.normal(), 0.975, 1.959963984540054), (d.t(10), 0.975, 2.2281388519649385), (d.chisquare(3), 0.95, 7.814727903251179), (d.f(5, 10), 0.95, 3.325834530413011), (d.gamma(3.0, 2.0), 0.5, 5.348120627447118), (d.beta(2.0, 5.0), 0.5, 0.26444998329511416)):
        assert one(dist.ppf(F.lit(p))) == pytest.approx(x, rel=1e-9) and one(dist.cdf(F.lit(x))) == pytest.approx(p, rel=1e-9)
    assert one(d.poisson(4.0).ppf(F.lit(0.9))) == 7 and one(d.binomial(10, 0.3).ppf(F.lit(0.5))) == 3 and one(d.poisson(4.0).cdf(F.lit(-1.0))) == 0.0
    drawn = spark.range(4000).select(d.normal(10.0, 2.0).sample("id", seed=1).alias("v")).agg(F.avg("v"), F.stddev("v")).first()
    assert abs(drawn[0] - 10) < 0.15 and abs(drawn[1] - 2) < 0.1


def test_p_values(spark):
    """Welch's test against its formula, with the chance by adding up the density."""
    rng = np.random.default_rng(4)
    x, y = rng.normal(20, 3, 15), rng.normal(23, 2, 15)
    r = spark.createDataFrame([(float(a), float(b)) for a, b in zip(x, y, strict=True)], "x double, y double").agg(stats.t_test("x", "y").alias("t")).select(stats.with_p_value(F.col("t")).alias("r")).first()["r"]
    a, b = x.var(ddof=1) / 15, y.var(ddof=1) / 15
    t, df = (x.mean() - y.mean()) / math.sqrt(a + b), (a + b) ** 2 / (a * a / 14 + b * b / 14)
    grid = np.linspace(-abs(t), abs(t), 20_001)
    density = math.gamma((df + 1) / 2) / math.gamma(df / 2) / math.sqrt(df * math.pi) * (1 + grid**2 / df) ** (-(df + 1) / 2)
    assert r["statistic"] == pytest.approx(t) and r["degrees_of_freedom"] == pytest.approx(df) and r["p_value"] == pytest.approx(1 - np.trapezoid(density, grid), abs=1e-6)


def test_sample_is_stable(spark):
    from loxodrome.operators import frame

    df = spark.range(20_000)
    some = frame.sample(df, 0.25, "id")
    assert abs(some.count() - 5000) < 200 and some.exceptAll(frame.sample(df.repartition(9), 0.25, "id")).isEmpty()


def test_hdbscan_leaves_noise_out():
    rng = np.random.default_rng(5)
    xy = np.vstack([rng.normal(0, 0.5, (60, 2)), rng.normal(20, 0.5, (40, 2)), np.array([[10.0, -30.0], [-40.0, 40.0], [60.0, 3.0]])])
    got = analysis.persistent_clusters(xy, 10)
    assert set(got[:60]) - {0} == {1} and set(got[60:100]) - {0} == {2} and (got[100:] == 0).all() and (got[:100] == 0).mean() < 0.2
