import math

import numpy as np
import pandas as pd
import pytest
from frames import returns

from pyspark.sql import functions as F

from tidemark.operators import resample as rs, tails

KEYS = ["series_id"]


@pytest.fixture(scope="module")
def pools(spark):
    r = np.random.default_rng(2).standard_t(4, 600) * 0.01
    df = returns(spark, r).withColumn("regime_state", (F.dayofmonth("date") % 2).cast("int"))
    return rs.return_pools(df, KEYS, "ret", "regime_state")


def test_pools_are_numbered(pools):
    n = {r["pool"]: (r["n"], r["hi"]) for r in pools.groupBy("pool").agg(F.count(F.lit(1)).alias("n"), F.max("idx").alias("hi")).collect()}
    assert n[-1] == (600, 599) and n[0][0] + n[1][0] == 600


def test_same_seed_same_paths_whatever_the_partitioning(pools):
    a = rs.bootstrap_paths(pools, KEYS, 300, [10])
    b = rs.bootstrap_paths(pools.repartition(13), KEYS, 300, [10])
    assert a.count() == 300 * 11 and a.exceptAll(b).isEmpty()
    assert not a.exceptAll(rs.bootstrap_paths(pools, KEYS, 300, [10], seed=7)).isEmpty()


def test_paths_start_at_one_and_stay_positive(pools):
    p = rs.bootstrap_paths(pools, KEYS, 100, [30], scenario="covid", multiplier=10).toPandas()
    assert (p[p.step == 0].value == 1).all() and (p.value > 0).all()
    with pytest.raises(ValueError):
        rs.bootstrap_paths(pools, KEYS, 1, [1], scenario="unknown")


def test_fan_is_ordered_and_exact(pools):
    paths = rs.stage(rs.bootstrap_paths(pools, KEYS, 200, [5]))
    f = rs.fan(paths, KEYS).toPandas().sort_values("step")
    cols = [f"fan_{p}" for p in (5, 25, 50, 75, 95)]
    assert (f[cols].diff(axis=1).iloc[:, 1:] >= 0).all().all()
    last = paths.filter("step = 5").toPandas().value
    assert np.allclose(f[cols].iloc[-1], np.percentile(last, [5, 25, 50, 75, 95]))


def test_path_statistics(spark):
    rows = [("a", 1, i, s, 1.0 if s == 0 else 1 + v) for i, v in enumerate(np.round(np.arange(-0.5, 0.45, 0.1), 1)) for s in (0, 1)]
    paths = spark.createDataFrame([(k, h, i, s, float(v)) for k, h, i, s, v in rows], "series_id string, horizon int, path int, step int, value double")
    r = rs.path_stats(paths, KEYS).first()
    assert r["Daily_VaR_95"] == pytest.approx(0.5) and r["Daily_CVaR_95"] == pytest.approx(0.5)
    assert r["probability_of_loss"] == pytest.approx(0.5) and r["worst_5pct_return"] == pytest.approx(-0.5)
    assert r["best_5pct_return"] == pytest.approx(np.percentile(np.arange(-0.5, 0.45, 0.1), 95))


def test_stressed_matrix(spark):
    m = spark.createDataFrame([("a", 0, 0, 0.9), ("a", 0, 1, 0.1), ("a", 1, 0, 0.1), ("a", 1, 1, 0.9)], "series_id string, from_state int, to_state int, p double")
    pool = spark.createDataFrame([("a", -1, 0, 0.0), ("a", 0, 0, 0.01), ("a", 1, 0, -0.01)], "series_id string, pool int, idx long, r double")
    p = {(r["from_state"], r["to_state"]): r["p"] for r in rs.stressed_matrix(m, pool, KEYS).collect()}
    assert p[0, 0] == pytest.approx(0.18) and p[0, 1] == pytest.approx(0.82) and p[1, 1] == 0.9


def test_digamma_is_the_slope_of_the_log_gamma():
    for x in (0.03, 0.5, 1.0, 3.7, 8.0, 120.5, 6000.0):
        h = 1e-5 * x
        assert tails.digamma(x) == pytest.approx((math.lgamma(x + h) - math.lgamma(x - h)) / (2 * h), rel=1e-6, abs=1e-7)


@pytest.mark.parametrize("size", [64, 16384])
def test_student_fit_is_the_joint_maximum(pools, size):
    """At the fit no direction gains; a Newton step in any parameter is below 1e-4 of its size."""
    fit = {r["pool"]: r for r in tails.student_t_fit(pools, KEYS, size=size).collect()}
    assert set(fit) == {-1, 0, 1} and 3 <= fit[-1]["nu"] <= 6 and fit[-1]["scale"] == pytest.approx(0.01, rel=0.15)
    for pool, f in fit.items():
        r = pools.filter(f"pool = {pool}").toPandas().r.to_numpy()
        at = [f["nu"], f["loc"], f["scale"]]
        top = tails.log_likelihood(r, *at)
        assert f["converged"] and f["log_likelihood"] == pytest.approx(top)
        for i, unit in enumerate((f["nu"], f["scale"], f["scale"])):
            h = 1e-3 * unit
            up, down = (tails.log_likelihood(r, *[x + s * h * (j == i) for j, x in enumerate(at)]) for s in (1, -1))
            assert max(up, down) < top
            assert abs((up - down) / 2 / (up - 2 * top + down)) * h < 1e-4 * unit


def test_student_fit_without_heavy_tails_is_normal(spark):
    r = np.random.default_rng(3).uniform(-1, 1, 500)
    flat = spark.createDataFrame(pd.DataFrame({"series_id": "a", "pool": -1, "idx": range(500), "r": r}))
    f = tails.student_t_fit(flat, KEYS).first()
    assert math.isinf(f["nu"]) and f["converged"]
    assert f["loc"] == pytest.approx(r.mean()) and f["scale"] == pytest.approx(r.std()) and f["log_likelihood"] == pytest.approx(tails.log_likelihood(r, math.inf, r.mean(), r.std()))


def test_student_fit_of_equal_rows_and_of_none(spark):
    same = spark.createDataFrame(pd.DataFrame({"series_id": "a", "pool": -1, "idx": range(9), "r": [0.5] * 9}))
    f = tails.student_t_fit(same, KEYS).first()
    assert (f["nu"], f["loc"]) == (3.0, 0.5) and f["scale"] == pytest.approx(1e-5)
    assert tails.student_t_fit(same.limit(0), KEYS).count() == 0


def test_student_fit_of_few_rows(spark):
    few = spark.createDataFrame(pd.DataFrame({"series_id": "a", "pool": -1, "idx": [0, 1, 2], "r": [0.01, 0.02, 0.03]}))
    r = tails.student_t_fit(few, KEYS).first()
    assert (r["nu"], r["loc"]) == (3.0, pytest.approx(0.02)) and r["scale"] == pytest.approx(np.std([0.01, 0.02, 0.03]) + 1e-5)
