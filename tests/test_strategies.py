import numpy as np
import pytest
from frames import bars, ohlcv

from pyspark.sql import functions as F

from tidemark.operators import strategies as sg

KEYS = ["series_id"]


@pytest.fixture(scope="module")
def labelled(spark):
    df = bars(spark, ohlcv(300))
    day = F.dayofmonth("date")
    return df.withColumn("regime_label", F.when(day < 12, "Bullish Low Volatility").when(day < 20, "Bearish High Volatility").otherwise("Recovery Regime"))


def summary(df, **costs):
    rows = sg.backtest_summary(sg.strategy_returns(df, KEYS, **costs), KEYS).collect()
    return {r["strategy"]: r for r in rows}


def test_weights_use_the_day_before(labelled):
    rows = sg.strategy_returns(labelled, KEYS).toPandas()
    label = labelled.orderBy("date").toPandas().regime_label
    w = rows[rows.strategy == "regime_aware"].sort_values("date").weight.to_numpy()
    want = label.map({"Bullish Low Volatility": 1.0, "Bearish High Volatility": 0.0, "Recovery Regime": 0.75}).to_numpy()
    assert w[0] == 0.0 and np.allclose(w[1:], want[:-1])
    first = rows[rows.date == rows.date.min()].set_index("strategy").weight
    assert first.to_dict() == {"buy_and_hold": 1, "ema_crossover": 0, "vol_targeting": 1, "regime_aware": 0, "hybrid": 0}


def test_changing_the_last_day_keeps_its_weights(spark, labelled):
    last = labelled.agg(F.max("date")).first()[0]
    moved = labelled.withColumn("close", F.when(F.col("date") == last, F.col("close") * 3).otherwise(F.col("close")))
    a, b = (sg.strategy_returns(d, KEYS).select("date", "strategy", "weight") for d in (labelled, moved))
    assert a.exceptAll(b).isEmpty()


def test_costs_lower_growth(labelled):
    free, dear = summary(labelled, fee_bps=0, slip_bps=0), summary(labelled, fee_bps=50, slip_bps=50)
    assert len(free) == 5
    for s in ("ema_crossover", "vol_targeting", "regime_aware", "hybrid"):
        assert dear[s]["CAGR"] < free[s]["CAGR"]


def test_turnover_and_drawdown_agree_with_the_curves(labelled):
    rets = sg.strategy_returns(labelled, KEYS)
    rep = {r["strategy"]: r for r in sg.backtest_summary(rets, KEYS).collect()}
    curves = sg.wide_curves(sg.equity_curves(rets, KEYS), KEYS).orderBy("date").toPandas()
    for s in sg.STRATEGIES:
        eq = curves[f"equity_{s}"]
        assert rep[s]["Max_Drawdown"] == pytest.approx(((eq - eq.cummax()) / (eq.cummax() + 1e-15)).min())
        turnover = np.abs(np.diff(curves[f"weight_{s}"], prepend=0.0)).sum()
        assert rep[s]["Total_Turnover"] == pytest.approx(turnover)
    assert rep["buy_and_hold"]["strategy_name"] == "Buy And Hold"


def test_liquidation_is_final(spark):
    pdf = ohlcv(6)
    pdf["close"] = [100.0, 120.0, -10.0, 5.0, 50.0, 60.0]
    curve = sg.equity_curves(sg.strategy_returns(bars(spark, pdf), KEYS), KEYS)
    eq = curve.filter("strategy = 'buy_and_hold'").orderBy("date").toPandas().equity.tolist()
    assert eq[1] > 0 and eq[2:] == [0.0] * 4


def test_stress_window_starts_flat(spark, labelled):
    rets = sg.strategy_returns(labelled, KEYS)
    windows = [("w", "2015-03-01", "2015-03-31"), ("none", "1990-01-01", "1990-02-01")]
    out = sg.stress_report(rets, spark, windows).toPandas()
    assert set(out.period) == {"w"} and len(out) == 5
    c = labelled.filter("date between '2015-03-01' and '2015-03-31'").orderBy("date").toPandas().close
    r = c.pct_change().fillna(0)
    r.iloc[0] -= 0.0015
    got = out[out.strategy == "buy_and_hold"].Total_Return.iloc[0]
    assert got == pytest.approx((1 + r).prod() - 1)
