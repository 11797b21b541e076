"""Queries on returns and risk."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.columns import round_doubles
from ..operators import risk
from ..operators.layout import BLK, POS, block_window, by_position, drop_halo, plain
from ..sources.tables import daily_bars, daily_covariate
from .sqlparts import (
    BARS, COVARIATE, RETURNS, RISK_COLUMNS, YEAR, frame, query, risk_ctes, rounded, whole,
)

KEYS = ["series_id"]


def daily_returns(bars: DataFrame, keys: list[str] = KEYS) -> DataFrame:
    """Simple returns of the close, first row 0."""
    rows = by_position(bars, keys, halo=1)
    step = F.col("close") / F.lag("close").over(block_window(keys)) - 1.0
    return drop_halo(rows.withColumn("ret", F.coalesce(step, F.lit(0.0))))


def returns(spark, sf):
    return daily_returns(daily_bars(spark, sf)).select("series_id", "date", "ret", POS, BLK)


def with_benchmark(spark, sf):
    """Series returns beside the covariate's own returns, inner join on the date."""
    market = daily_covariate(spark, sf, "close").withColumn("market", F.lit("all"))
    market = daily_returns(market, ["market"]).select("date", F.col("ret").alias("bench"))
    return plain(returns(spark, sf)).join(market, "date")


def q_bars(spark, sf):
    return round_doubles(plain(daily_bars(spark, sf)))


def q_risk_report(spark, sf):
    return round_doubles(risk.risk_report(returns(spark, sf), KEYS))


def q_risk_with_beta(spark, sf):
    return round_doubles(risk.risk_report(with_benchmark(spark, sf), KEYS, benchmark="bench"))


def q_wealth_and_drawdown(spark, sf):
    path = risk.drawdown_path(returns(spark, sf), KEYS)
    return round_doubles(path.select("series_id", "date", "wealth", "peak", "drawdown"))


def q_rolling_risk(spark, sf):
    out = risk.rolling_risk(with_benchmark(spark, sf), KEYS, benchmark="bench")
    return round_doubles(out.drop("ret", "bench"))


def q_rolling_drawdown(spark, sf):
    return round_doubles(risk.rolling_drawdown(returns(spark, sf), KEYS).drop("ret"))


def q_monthly_returns(spark, sf):
    return round_doubles(risk.monthly_returns(returns(spark, sf), KEYS))


def q_monthly_heatmap(spark, sf):
    return round_doubles(risk.monthly_heatmap(returns(spark, sf), KEYS))


def q_return_quartiles(spark, sf):
    return round_doubles(risk.return_quartiles(returns(spark, sf), KEYS))


QUERIES = {
    "daily_bars": q_bars,
    "risk_report": q_risk_report,
    "risk_report_with_beta": q_risk_with_beta,
    "wealth_and_drawdown": q_wealth_and_drawdown,
    "rolling_risk": q_rolling_risk,
    "rolling_drawdown": q_rolling_drawdown,
    "monthly_returns": q_monthly_returns,
    "monthly_heatmap": q_monthly_heatmap,
    "return_quartiles": q_return_quartiles,
}

_BENCH = """bench AS (
  SELECT date, coalesce(vix_close / lag(vix_close) OVER (ORDER BY date) - 1.0, 0.0) AS bench FROM cov)"""
_BOTH = "both_ AS (SELECT r.series_id, r.date, r.ret, b.bench FROM rets r JOIN bench b USING (date))"

_months = ", ".join(
    f'coalesce(max(CASE WHEN month = {i} THEN g - 1.0 END), 0.0) AS "{m}"'
    for i, m in enumerate(risk.MONTHS, 1)
)
_GROWTH = """growth AS (SELECT series_id, CAST(year(date) AS INTEGER) AS year, CAST(month(date) AS INTEGER) AS month,
  product(1.0 + ret) AS g FROM rets GROUP BY ALL)"""

_roll = frame(63)
ORACLES = {
    "daily_bars": query(BARS, f"SELECT series_id, date, {rounded(['open', 'high', 'low', 'close', 'volume'])} FROM bars"),
    "risk_report": query(BARS, RETURNS, *risk_ctes("rets", KEYS), f"SELECT series_id, {rounded(RISK_COLUMNS)} FROM risk"),
    "risk_report_with_beta": query(
        BARS, RETURNS, COVARIATE, _BENCH, _BOTH, *risk_ctes("both_", KEYS),
        "bt AS (SELECT series_id, covar_samp(ret, bench) / (var_samp(bench) + 1e-15) AS \"Beta\" FROM both_ GROUP BY 1)",
        f"SELECT series_id, {rounded([*RISK_COLUMNS, 'Beta'])} FROM risk JOIN bt USING (series_id)",
    ),
    "wealth_and_drawdown": query(
        BARS, RETURNS, *risk_ctes("rets", KEYS)[:3],
        "SELECT series_id, date, round(cum, 6) + 0.0 AS wealth, round(peak, 6) + 0.0 AS peak, "
        "round(dd, 6) + 0.0 AS drawdown FROM dd",
    ),
    "rolling_risk": query(
        BARS, RETURNS, COVARIATE, _BENCH, _BOTH,
        f"""roll AS (SELECT series_id, date,
          ({whole(63, 'avg', 'ret')}) / (({whole(63, 'stddev_samp', 'ret')}) + 1e-15) * {YEAR} AS rolling_sharpe_63d,
          ({whole(63, 'avg', 'ret')}) * 252.0 / (({whole(63, 'stddev_samp', 'ret')}) * {YEAR} + 1e-15) AS rolling_sharpe_scaled_63d,
          ({whole(63, 'stddev_samp', 'ret')}) * {YEAR} AS rolling_volatility_63d,
          CASE WHEN count(bench) {_roll} = 63 THEN covar_samp(ret, bench) {_roll} / (var_samp(bench) {_roll} + 1e-15) END AS rolling_beta_63d
          FROM both_)""",
        f"SELECT series_id, date, {rounded(['rolling_sharpe_63d', 'rolling_sharpe_scaled_63d', 'rolling_volatility_63d', 'rolling_beta_63d'])} FROM roll",
    ),
    "rolling_drawdown": query(
        BARS, RETURNS, "wl AS (SELECT *, product(1.0 + ret) OVER (PARTITION BY series_id ORDER BY date) AS cum FROM rets)",
        f"pk AS (SELECT *, max(cum) {frame(252)} AS peak FROM wl)",
        "SELECT series_id, date, round((cum - peak) / (peak + 1e-15), 6) + 0.0 AS rolling_drawdown_252d FROM pk",
    ),
    "monthly_returns": query(
        BARS, RETURNS, _GROWTH,
        "SELECT series_id, year, month, round(product(g) - 1.0, 6) + 0.0 AS ret FROM growth "
        "GROUP BY GROUPING SETS ((series_id, year, month), (series_id, year))",
    ),
    "monthly_heatmap": query(
        BARS, RETURNS, _GROWTH,
        f"hm AS (SELECT series_id, year, {_months}, product(g) - 1.0 AS \"YTD\" FROM growth GROUP BY 1, 2)",
        f"SELECT series_id, year, {rounded([*risk.MONTHS, 'YTD'])} FROM hm",
    ),
    "return_quartiles": query(
        BARS, RETURNS,
        "q AS (SELECT series_id, quantile_cont(ret, 0.25) AS q1, quantile_cont(ret, 0.5) AS median, "
        "quantile_cont(ret, 0.75) AS q3 FROM rets GROUP BY 1)",
        """SELECT series_id, round(q1, 6) + 0.0 AS q1, round(median, 6) + 0.0 AS median, round(q3, 6) + 0.0 AS q3,
           count(*) FILTER (ret < q1 - (q3 - q1) * 1.5 OR ret > q3 + (q3 - q1) * 1.5) AS outliers, count(*) AS n
           FROM rets JOIN q USING (series_id) GROUP BY series_id, q.q1, q.median, q.q3""",
    ),
}
