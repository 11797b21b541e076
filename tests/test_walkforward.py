import numpy as np
import pandas as pd
import pytest

from pyspark.sql import functions as F

from tidemark.operators import walkforward as wf
from tidemark.operators.packing import pack
from tidemark.operators.selection import select_features

KEYS = ["series_id"]
FEATS = ["feat1", "feat2", "feat3", "late"]
FIT = {"max_iter": 2, "gmm_iter": 2, "kmeans_iter": 2}


def raw(n=500, seed=42):
    rng = np.random.default_rng(seed)
    f1 = rng.normal(0, 1, n)
    close = 100 * np.cumprod(1 + rng.normal(0.0005, 0.01, n))
    pdf = pd.DataFrame(
        {"series_id": "a", "date": pd.date_range("2015-01-01", periods=n).date, "feat1": f1, "feat2": rng.normal(0, 1, n),
         "feat3": 0.95 * f1 + rng.normal(0, 0.05, n), "late": np.where(np.arange(n) < 300, 0.0, rng.normal(5, 1, n)), "raw_close": close}
    )
    pdf.loc[:9, "feat2"] = None  # warm-up
    return pdf


SCHEMA = "series_id string, date date, feat1 double, feat2 double, feat3 double, late double, raw_close double"


def frame(spark, pdf):
    return spark.createDataFrame(pdf.astype(object).where(pdf.notna(), None), SCHEMA)


def test_expanding_folds(spark):
    n = spark.createDataFrame([("a", 100), ("b", 40)], "series_id string, n_rows long")
    got = [tuple(r) for r in wf.expanding_folds(n, KEYS, 60, 25).orderBy("series_id", "fold").select("series_id", "train_hi", "test_lo", "test_hi").collect()]
    assert got == [("a", 60, 60, 85), ("a", 85, 85, 100), ("b", 40, 40, 40)]


def test_fold_scaling_equals_refitting_each_fold(spark):
    pdf = raw()
    rows = wf._numbered(frame(spark, pdf), KEYS, "raw_close")
    counts = rows.groupBy(*KEYS).agg(F.count(F.lit(1)).alias("n_rows"))
    folds = wf.expanding_folds(counts, KEYS, 250, 100)
    out = wf.fold_scaling(pack(rows, KEYS, FEATS, size=64), rows, folds, KEYS, FEATS, size=64).orderBy("fold").collect()
    assert len(out) == 3
    for r in out:
        train = pdf.iloc[: r["train_hi"]]
        want, _ = select_features(frame(spark, train), FEATS)
        assert r["selected"] == want and r["lo"] == (10 if "feat2" in want else 0)
        for i, f in enumerate(FEATS):
            if f in want:
                assert r["shift"][i] == pytest.approx(train[f].mean())
                assert 1 / r["inv"][i] == pytest.approx(train[f].std(ddof=0))
            else:
                assert r["inv"][i] == 0
    # constant in the first training range, useful later
    assert "late" not in out[0]["selected"] and "late" in out[2]["selected"]
    assert not {"feat1", "feat3"} <= set(out[0]["selected"])


def oos(spark, pdf):
    # one year of training, steps of two months
    out, _ = wf.walk_forward_oos(frame(spark, pdf), FEATS, 3, KEYS, years=1, months=2, **FIT)
    return out.orderBy("date").toPandas()


def test_future_does_not_reach_the_past(spark):
    pdf = raw()
    a = oos(spark, pdf)
    assert (a.regime_label[:252] == "Warmup / Undefined").all() and (a.regime_state[:252] == -1).all()
    assert (a.regime_state[252:] >= 0).all() and (a.regime_label[252:] != "Warmup / Undefined").all()
    changed = pdf.copy()
    changed.loc[420:, ["feat1", "feat2", "late"]] += 3.0
    changed.loc[420:, "raw_close"] *= 2
    b = oos(spark, changed)
    # the fold that starts at 252 + 4 * 42 = 420 is the first to see the change
    assert a.regime_label[:420].tolist() == b.regime_label[:420].tolist()


def test_a_short_series_keeps_its_warm_up_label(spark):
    both = pd.concat([raw(300), raw(200).assign(series_id="b")])
    out, folds = wf.walk_forward_oos(frame(spark, both), FEATS, 3, KEYS, years=1, months=2, **FIT)
    pdf = out.toPandas()
    assert (pdf[pdf.series_id == "b"].regime_label == "Warmup / Undefined").all() and (pdf.series_id == "b").sum() == 200
    assert (pdf[pdf.series_id == "a"].regime_state >= 0).sum() == 48
    assert {(r["series_id"], r["test_hi"] - r["test_lo"]) for r in folds.collect()} == {("a", 42), ("a", 6), ("b", 0)}


def test_overlapping_splits_keep_all_their_rows(spark):
    splits = {"train": ("2015-01-01", "2016-02-15"), "val": ("2016-01-01", "2016-03-31")}
    rows, _ = wf.oos_partitions(frame(spark, raw()), FEATS, splits, 3, KEYS, **FIT)
    counts = {r["split"]: r["count"] for r in rows.groupBy("split").count().collect()}
    assert counts == {"train": 411, "val": 91} and rows.filter("regime_state < 0").count() <= 10


def test_partitions(spark):
    splits = {"train": ("2015-01-01", "2015-12-31"), "val": ("2016-01-01", "2016-03-31"), "test": ("2016-04-01", "2016-05-10")}
    rows, folds = wf.oos_partitions(frame(spark, raw()), FEATS, splits, 3, KEYS, **FIT)
    pdf = rows.orderBy("date").toPandas()
    assert pdf.groupby("split").size().to_dict() == {"train": 365, "val": 91, "test": 40}
    warm = pdf[pdf.regime_label == "Warmup / Undefined"]
    assert set(warm.split) <= {"train"} and len(warm) <= 10
    assert folds.count() == 1


@pytest.mark.parametrize("first,expected_seen", [(300, 300), (600, 490)])
def test_walk_forward_labels(spark, first, expected_seen):
    df = frame(spark, raw()).withColumn("ret", F.lit(0.001) * F.dayofmonth("date"))
    out = wf.walk_forward_regimes(df, ["feat1", "feat2"], 3, KEYS, first=first, step=100, **FIT).orderBy("date").toPandas()
    assert len(out) == 500 and out.in_sample.sum() == expected_seen
    assert (out.regime_label[:10] == "Distribution / Risk-Off Regime").all() and (out.regime_state[:10] == -1).all()
    assert (out.regime_state[10:] >= 0).all()


def test_stability_and_sweep(spark):
    df = frame(spark, raw()).withColumn("ret", F.col("feat1") * 0.01)
    states, verdict = wf.train_test_stability(df, ["feat1", "feat2"], 2, KEYS, **FIT)
    s = states.toPandas()
    assert s.train_days.sum() == 343 and s.test_days.sum() == 147 and verdict.count() == 1
    table = wf.model_sweep(df, ["feat1", "feat2"], KEYS, ks=[2], max_iter=2).toPandas()
    assert set(table.model_type) == {"GMM", "KMeans", "HMM", "MSR"}
    assert (table[table.model_type == "KMeans"].aic == 9999).all()
    best = wf.best_model(spark.createDataFrame(table), KEYS).first()
    assert best["model_type"] == "HMM"
    assert wf.best_model(spark.createDataFrame(table), KEYS, ("GMM", 2)).first()["model_type"] == "GMM"
