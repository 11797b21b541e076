import numpy as np
import pandas as pd
import pytest
from frames import returns

from tidemark.operators import risk
from tidemark.operators.orderstats import linear, lower_rank, pick_ranks

KEYS = ["series_id"]


def report(spark, values):
    return risk.risk_report(returns(spark, values), KEYS).first()


def test_constant_returns(spark):
    r = report(spark, [0.01] * 252)
    assert r["Annualized_Volatility"] == 0 and r["Sharpe_Ratio"] == 0 and r["Max_Drawdown"] == 0
    assert r["Sortino_Ratio"] == 0 and r["Calmar_Ratio"] == 0 and r["Drawdown_Duration_Days"] == 0
    assert r["CAGR"] == pytest.approx(1.01**252 - 1)
    assert r["Win_Rate"] == 1 and r["Profit_Factor"] == 999.0


def test_drawdown_and_duration(spark):
    assert report(spark, [0.10, -0.10, -0.11111111, 0.375])["Max_Drawdown"] == pytest.approx(-0.20, abs=1e-7)
    assert report(spark, [0.10, -0.10, 0.0, 0.22222222])["Drawdown_Duration_Days"] == 2


def test_value_at_risk(spark):
    r = report(spark, np.arange(-0.50, 0.50, 0.01)[:100])
    assert r["Daily_VaR_95"] == pytest.approx(0.45) and r["Daily_CVaR_95"] == pytest.approx(0.475)


def pandas_report(r):
    cum = (1 + r).cumprod()
    dd = (cum - cum.cummax()) / (cum.cummax() + 1e-15)
    under, best, run = dd < 0, 0, 0
    for u in under:
        run = run + 1 if u else 0
        best = max(best, run)
    s = np.sort(r)
    i = int((1 - 0.95) * len(s))
    return {
        "Annualized_Volatility": r.std() * 252**0.5,
        "Sharpe_Ratio": r.mean() * 252 / (r.std() * 252**0.5),
        "Max_Drawdown": dd.min(), "Average_Drawdown": dd[dd < 0].mean(), "Drawdown_Duration_Days": best,
        "Win_Rate": (r > 0).mean(), "Profit_Factor": r[r > 0].sum() / -r[r < 0].sum(),
        "Daily_VaR_95": abs(s[i]), "Daily_CVaR_95": abs(s[: i + 1].mean()),
        "Downside_Deviation": np.sqrt((r.clip(upper=0) ** 2).mean()) * 252**0.5,
    }


@pytest.mark.parametrize("block", [7, 64, 16384])
def test_blocks_do_not_change_the_report(spark, small_blocks, block):
    small_blocks(block)
    r = pd.Series(np.random.default_rng(1).normal(0.0002, 0.02, 400))
    got = report(spark, r)
    for name, value in pandas_report(r).items():
        assert got[name] == pytest.approx(value, rel=1e-9), name


def test_wealth_with_total_loss(spark, small_blocks):
    small_blocks(2)
    path = risk.drawdown_path(returns(spark, [0.1, -1.5, 0.2, -2.0, 0.3]), KEYS).orderBy("date").toPandas()
    want = np.cumprod([1.1, -0.5, 1.2, -1.0, 1.3])
    assert np.allclose(path["wealth"], want)
    assert np.allclose(path["peak"], np.maximum.accumulate(want))
    assert np.allclose(path["lowest"], np.minimum.accumulate(want))


def test_order_statistics_with_ties_and_tails(spark):
    values = [0.0] * 60 + [-0.3] * 25 + list(np.random.default_rng(3).normal(0, 1e-3, 115))
    got = pick_ranks(returns(spark, values), KEYS, "ret", {"a": lower_rank(0.8), "b": linear(0.37), "c": linear(1.0)}).first()
    s = np.sort(values)
    i = int((1 - 0.8) * len(s))
    assert got["a"] == s[i] and got["a_tail"] == pytest.approx(s[: i + 1].mean())
    assert got["b"] == pytest.approx(np.percentile(values, 37)) and got["c"] == s[-1]


def test_monthly_table(spark):
    r = np.random.default_rng(5).normal(0, 0.01, 500)
    df = returns(spark, r)
    s = pd.Series(r, index=pd.to_datetime(df.toPandas()["date"]))
    heat = risk.monthly_heatmap(df, KEYS).toPandas().set_index("year")
    assert heat.loc[2015, "Mar"] == pytest.approx((1 + s["2015-03"]).prod() - 1)
    assert heat.loc[2015, "YTD"] == pytest.approx((1 + s["2015"]).prod() - 1)
    assert heat.loc[2016, "Dec"] == 0.0
    worst = (1 + s).groupby(s.index.to_period("M")).prod().min() - 1
    assert risk.worst_month(df, KEYS).first()["Worst_Month"] == pytest.approx(worst)
