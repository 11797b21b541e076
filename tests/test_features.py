import numpy as np
import pandas as pd
import pytest
from frames import bars, ohlcv

from pyspark.sql import functions as F

from tidemark.operators import features as ft, layout
from tidemark.operators.ewm import add_ewm, from_span
from tidemark.operators.layout import by_position, drop_halo


@pytest.fixture(scope="module")
def frame():
    return ohlcv(420)


@pytest.fixture(scope="module")
def computed(spark, frame):
    return ft.compute_features(bars(spark, frame)).orderBy("date").toPandas()


def same(got, want, tol=1e-9):
    got, want = np.asarray(got, dtype=float), np.asarray(want, dtype=float)
    assert (np.isnan(got) == np.isnan(want)).all()
    assert np.allclose(got, want, rtol=tol, atol=tol, equal_nan=True)


def test_every_feature_is_present(computed):
    assert set(ft.feature_names()) <= set(computed.columns)
    assert len(ft.feature_names()) == 62


def test_against_pandas(frame, computed):
    c, h, l, o = frame.close, frame.high, frame.low, frame.open
    lr = np.log(c / c.shift())
    same(computed.ret_cum_21d, np.exp(lr.rolling(21).sum()) - 1)
    same(computed.vol_close_63d, lr.rolling(63).std())
    same(computed["skewness"], lr.rolling(21).skew(), 1e-7)
    same(computed["kurtosis"], lr.rolling(21).kurt(), 1e-7)
    for n in (9, 21, 50, 200):
        e = c.ewm(span=n, adjust=False).mean()
        same(computed[f"dist_ema_{n}"], (c - e) / e)
        slope = e.rolling(5).apply(lambda y: np.polyfit(np.arange(1, 6), y, 1)[0], raw=True)
        same(computed[f"slope_ema_{n}"], slope, 1e-7)
    d = c.diff()
    up, down = d.clip(lower=0).ewm(alpha=1 / 14, adjust=False).mean(), (-d.clip(upper=0)).ewm(alpha=1 / 14, adjust=False).mean()
    same(computed.rsi_14, 100 - 100 / (1 + up / (down + 1e-10)))
    macd = c.ewm(span=12, adjust=False).mean() - c.ewm(span=26, adjust=False).mean()
    same(computed.macd_signal, macd.ewm(span=9, adjust=False).mean())
    tr = pd.concat([h - l, (h - c.shift()).abs(), (l - c.shift()).abs()], axis=1).max(axis=1)
    same(computed.atr_14, tr.ewm(alpha=1 / 14, adjust=False).mean())
    same(computed.vol_regime_pct_21d, lr.rolling(21).std().rolling(252).apply(lambda v: pd.Series(v).rank(pct=True).iloc[-1], raw=True))

    def entropy(v):
        p = np.histogram(v, 10)[0] / (63 + 1e-10)
        return -np.sum(p[p > 0] * np.log(p[p > 0]))

    same(computed.entropy, lr.rolling(63).apply(entropy, raw=True))

    def hurst(v):
        s = pd.Series(v)
        return np.polyfit(np.log([2, 4, 8, 16]), np.log([(s - s.shift(k)).std() for k in (2, 4, 8, 16)]), 1)[0]

    same(computed.hurst_exponent, c.rolling(126).apply(hurst, raw=True), 1e-8)


def test_ranges(computed):
    t = computed.dropna()
    assert t.rsi_14.between(0, 100).all() and t.williams_r.between(-100, 0).all()
    assert t.trend_strength_score.between(0, 1 + 1e-9).all() and (t.vol_close_21d >= 0).all()
    assert set(t.cross_ema_9_21) <= {1.0, -1.0}
    # warm-up counts as "not above"
    assert computed.cross_sma_50_200.iloc[0] == -1.0


def test_last_price_does_not_change_the_past(spark, frame, computed):
    changed = frame.copy()
    changed.loc[changed.index[-1], ["high", "close"]] *= 1.5
    other = ft.compute_features(bars(spark, changed)).orderBy("date").toPandas()
    names = ft.feature_names()
    pd.testing.assert_frame_equal(computed[names].iloc[:-1], other[names].iloc[:-1])


def test_constant_and_random_complexity(spark):
    flat = ohlcv(140)
    flat[["open", "high", "low", "close"]] = 100.0
    out = ft.compute_features(bars(spark, flat), "statistical_complexity").orderBy("date").toPandas()
    assert abs(out.entropy.iloc[-1]) < 1e-9 and out.hurst_exponent.isna().all()
    walk = ft.compute_features(bars(spark, ohlcv(300, seed=7)), "statistical_complexity").toPandas()
    assert walk.entropy.dropna().min() > 1.0
    assert 0.25 < walk.hurst_exponent.dropna().mean() < 0.75


def test_ewm_over_many_blocks(spark, small_blocks):
    small_blocks(4096)
    n = 13000
    x = pd.Series(np.random.default_rng(0).normal(50, 5, n)).cumsum()
    pdf = pd.DataFrame({"series_id": "a", "date": pd.date_range("1980-01-01", periods=n).date, "x": x})
    df = by_position(spark.createDataFrame(pdf, "series_id string, date date, x double"), ["series_id"])
    spans = (9, 50, 200)
    out = add_ewm(df, ["series_id"], {f"e{s}": ("x", from_span(s), 0) for s in spans})
    assert out.select("_blk").distinct().count() > 3
    got = drop_halo(out).orderBy("date").toPandas()
    for s in spans:
        assert np.allclose(got[f"e{s}"], x.ewm(span=s, adjust=False).mean(), rtol=1e-12)


def test_ewm_refuses_a_short_halo(spark, small_blocks):
    small_blocks(300)
    with pytest.raises(ValueError):
        ft.compute_features(bars(spark, ohlcv(50)), "trend")


def test_covariate_features(spark, frame):
    pdf = frame.assign(vix_close=np.linspace(10, 20, len(frame)))
    df = spark.createDataFrame(pdf)
    out = ft.compute_features(df, "returns").orderBy("date").toPandas()
    assert out.vix_close_ret.iloc[0] == 0 and out.vix_close_ret.iloc[1:].gt(0).all()
    long = df.select(F.lit("oil").alias("name"), "date", "close").unionByName(df.select(F.lit("gold").alias("name"), "date", "close"))
    ext = ft.covariate_returns(long)
    assert set(ext.columns) == {"date", "ext_gold_ret", "ext_oil_ret"} and ext.count() == len(frame)


@pytest.mark.parametrize("group", ["returns", "market_structure", "statistical_complexity", "volatility", "momentum"])
def test_halo_is_what_the_family_needs(spark, monkeypatch, group):
    """Blocks hardly longer than the halo give the rows of one block, with no more copies than the halo."""
    need = ft.halo_of(group)
    pdf = ohlcv(2 * need + 50)
    whole = ft.compute_features(bars(spark, pdf), group).orderBy("date").toPandas()
    monkeypatch.setattr(layout, "BLOCK_ROWS", need + 7)
    cut = ft.compute_features(bars(spark, pdf), group).orderBy("date").toPandas()
    names = ft.feature_names(group)
    pd.testing.assert_frame_equal(cut[names], whole[names], rtol=1e-9, atol=1e-12)
    copies = ft.feature_layout(bars(spark, pdf), group).filter("not _own").groupBy("_blk").count().collect()
    assert copies and all(r["count"] <= max(need, 63) for r in copies)
