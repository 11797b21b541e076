"""Queries on strategies: weights, curves, backtests, stress windows."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.columns import round_doubles
from ..operators import strategies as sg
from ..operators.ingest import between_dates
from ..operators.layout import plain
from ..session import stage
from .regimes import STATES, labelled
from .sqlparts import BARS, LOGS, RISK_COLUMNS, YEAR, ewm, frame, query, risk_ctes, rounded, span, whole

KEYS = ["series_id"]
PERIODS = [
    ("Spring 1996", "1996-02-01", "1996-05-31"),
    ("First half 1998", "1998-01-01", "1998-06-30"),
    ("Overlap 1998", "1998-06-01", "1998-09-30"),
    ("Before all data", "1980-01-01", "1980-12-31"),
]
SPLITS = {"train": ("1995-01-01", "1998-12-31"), "validation": ("1999-01-01", "1999-12-31"), "test": ("2000-01-01", "2001-12-31")}
SUMMARY = [c for c in RISK_COLUMNS if not c.endswith("_99")] + ["Total_Turnover", "Average_Exposure"]


def net_returns(spark, sf, **options):
    return sg.strategy_returns(labelled(spark, sf), KEYS, **options)


def split_rows(spark, sf):
    """Labelled rows with the name of their date split; splits do not overlap."""
    d = F.col("date")
    name = F.lit(None).cast("string")
    for s, (a, b) in SPLITS.items():
        name = F.when(d.between(F.lit(a).cast("date"), F.lit(b).cast("date")), s).otherwise(name)
    return stage(plain(labelled(spark, sf)).withColumn("split", name).filter(F.col("split").isNotNull()))


def split_summary(spark, sf):
    """Backtest of every split on its own: returns, averages and costs start anew."""
    keys = ["series_id", "split"]
    return sg.backtest_summary(sg.strategy_returns(split_rows(spark, sf), keys), keys)


def q_weights(spark, sf):
    out = net_returns(spark, sf, cash_yield=0.03)
    return round_doubles(out.select("series_id", "date", "strategy", "weight", "prev_weight", "ret"))


def q_curves(spark, sf):
    return round_doubles(sg.equity_curves(net_returns(spark, sf)).drop("ret", "weight"))


def q_curves_wide(spark, sf):
    return round_doubles(sg.wide_curves(sg.equity_curves(net_returns(spark, sf))))


def q_summary(spark, sf):
    return round_doubles(sg.backtest_summary(net_returns(spark, sf), KEYS))


def q_rolling(spark, sf):
    return round_doubles(sg.rolling_metrics(net_returns(spark, sf)))


def q_log(spark, sf):
    return round_doubles(sg.rebalance_log(net_returns(spark, sf)))


def q_log_hybrid(spark, sf):
    """The rebalance viewer: one strategy, the five newest rows of each series' report."""
    log = sg.for_strategy(sg.rebalance_log(net_returns(spark, sf)), "hybrid")
    return round_doubles(sg.newest_rows(log, 5))


def q_stress(spark, sf):
    return round_doubles(sg.stress_report(net_returns(spark, sf), spark, PERIODS))


def q_splits(spark, sf):
    return round_doubles(split_summary(spark, sf))


def _parts(spark, sf):
    s = stage(split_summary(spark, sf))
    return [s.filter(F.col("split") == n).drop("split") for n in SPLITS]


def q_degradation(spark, sf):
    return round_doubles(sg.degradation(*_parts(spark, sf)))


def q_reduction(spark, sf):
    return round_doubles(sg.reduction_vs_benchmark(sg.backtest_summary(net_returns(spark, sf), KEYS)))


def q_robustness(spark, sf):
    train, _, test = _parts(spark, sf)
    runs = train.select("series_id", F.col("strategy").alias("mapping"), F.col("Sharpe_Ratio").alias("is_sharpe")).join(
        test.select("series_id", F.col("strategy").alias("mapping"), F.col("Sharpe_Ratio").alias("oos_sharpe"),
                    F.col("Max_Drawdown").alias("oos_max_dd")), ["series_id", "mapping"])
    return round_doubles(sg.robustness(runs))


QUERIES = {
    "strategy_returns": q_weights,
    "equity_curves": q_curves,
    "equity_curves_wide": q_curves_wide,
    "backtest_summary": q_summary,
    "rolling_strategy_metrics": q_rolling,
    "rebalance_log": q_log,
    "rebalance_log_latest": q_log_hybrid,
    "stress_report": q_stress,
    "split_backtests": q_splits,
    "oos_degradation": q_degradation,
    "reduction_vs_benchmark": q_reduction,
    "robustness_summary": q_robustness,
}

SPLIT_LAB = "lab2 AS (SELECT *, CASE " + " ".join(
    f"WHEN date BETWEEN DATE '{a}' AND DATE '{b}' THEN '{s}'" for s, (a, b) in SPLITS.items()
) + " END AS split FROM lab)"


def weight_ctes(source: str, keys: str, cash: str = "0.0") -> list[str]:
    """CTEs that end in ``net``: weights and net returns per strategy."""
    w = f"(PARTITION BY {keys} ORDER BY date)"
    ew = lambda n: ewm("close", span(n)).replace(frame(None), frame(None, keys))
    long = " UNION ALL ".join(
        f"SELECT {keys}, date, pd, aret, '{s}' AS strategy, w_{s} AS weight FROM wt" for s in sg.STRATEGIES
    )
    return [
        f"""a0 AS (SELECT *, coalesce(close / lag(close) OVER {w} - 1.0, 0.0) AS aret, lag(date) OVER {w} AS pd,
          {ew(50)} AS e50, {ew(200)} AS e200 FROM {source})""",
        f"""a1 AS (SELECT *, CASE WHEN e50 > e200 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS up,
          least(1.0::DOUBLE, 0.15::DOUBLE / (coalesce(({whole(21, 'stddev_samp', 'aret', keys)}) * {YEAR}, 0.15::DOUBLE) + 1e-15)) AS sz,
          CASE regime_label WHEN 'Bullish Low Volatility' THEN 1.0::DOUBLE WHEN 'Bullish High Volatility' THEN 0.75::DOUBLE
            WHEN 'Recovery Regime' THEN 0.75::DOUBLE WHEN 'Sideways Low Volatility' THEN 0.5::DOUBLE
            WHEN 'Distribution / Risk-Off Regime' THEN 0.25::DOUBLE ELSE 0.0::DOUBLE END AS rw FROM a0)""",
        f"""wt0 AS (SELECT *, 1.0::DOUBLE AS w_buy_and_hold, coalesce(lag(up) OVER {w}, 0.0) AS w_ema_crossover,
          coalesce(lag(sz) OVER {w}, 1.0) AS w_vol_targeting, coalesce(lag(rw) OVER {w}, 0.0) AS w_regime_aware FROM a1)""",
        "wt AS (SELECT *, w_regime_aware * w_ema_crossover AS w_hybrid FROM wt0)",
        f"lw AS ({long})",
        f"""pw AS (SELECT *, coalesce(lag(weight) OVER (PARTITION BY {keys}, strategy ORDER BY date), 0.0) AS prev_weight FROM lw)""",
        f"""net AS (SELECT *, weight * aret + greatest(0.0::DOUBLE, 1.0 - abs(weight)) * ({cash}::DOUBLE / 252.0)
          - abs(weight - prev_weight) * 0.0015::DOUBLE AS ret FROM pw)""",
    ]


_LAB = [BARS, LOGS, STATES]
_NET = [*_LAB, *weight_ctes("lab", "series_id")]
_SNET = [*_LAB, SPLIT_LAB, *weight_ctes("(SELECT * FROM lab2 WHERE split IS NOT NULL)", "series_id, split")]
_G = ["series_id", "strategy"]
_SG = ["series_id", "split", "strategy"]
_NICE = "list_aggregate(list_transform(string_split(strategy, '_'), lambda s: upper(s[1:1]) || s[2:]), 'string_agg', ' ')"


def _summary(keys: list[str]) -> list[str]:
    k = ", ".join(keys)
    return [
        *risk_ctes("net", keys),
        f"tv AS (SELECT {k}, sum(abs(weight - prev_weight)) AS \"Total_Turnover\", avg(abs(weight)) AS \"Average_Exposure\" FROM net GROUP BY {k})",
        f"bs AS (SELECT * FROM risk JOIN tv USING ({k}))",
    ]


_W = "(PARTITION BY series_id, strategy ORDER BY date)"
_EQ = [
    f"wl AS (SELECT *, product(1.0 + ret) OVER {_W} AS cum FROM net)",
    f"eq AS (SELECT *, CASE WHEN min(cum) OVER {_W} <= 0 THEN 0.0 ELSE cum END AS equity FROM wl)",
]
_periods = " UNION ALL ".join(
    f"SELECT '{n}' AS period, DATE '{a}' AS start_date, DATE '{b}' AS end_date" for n, a, b in PERIODS
)
_g2 = "series_id, strategy"
ORACLES = {
    "strategy_returns": query(*_LAB, *weight_ctes("lab", "series_id", "0.03"),
                              f"SELECT series_id, date, strategy, {rounded(['weight', 'prev_weight', 'ret'])} FROM net"),
    "equity_curves": query(*_NET, *_EQ, "SELECT series_id, strategy, date, round(equity, 6) + 0.0 AS equity FROM eq"),
    "equity_curves_wide": query(
        *_NET, *_EQ, "SELECT series_id, date, " + ", ".join(
            f"round(max({c}) FILTER (strategy = '{s}'), 6) + 0.0 AS {c}_{s}" for s in sg.STRATEGIES for c in ("equity", "weight")
        ) + " FROM eq GROUP BY 1, 2"),
    "backtest_summary": query(*_NET, *_summary(_G), f"SELECT series_id, strategy, {_NICE} AS strategy_name, {rounded(SUMMARY)} FROM bs"),
    "rolling_strategy_metrics": query(
        *_NET, *_EQ[:1], f"""rm AS (SELECT series_id, strategy, date,
          ({whole(252, 'avg', 'ret', _g2)}) / (({whole(252, 'stddev_samp', 'ret', _g2)}) + 1e-15) * {YEAR} AS rolling_sharpe_252d,
          (cum - max(cum) {frame(252, _g2)}) / (max(cum) {frame(252, _g2)} + 1e-15) AS rolling_drawdown_252d FROM wl)""",
        f"SELECT series_id, strategy, date, {rounded(['rolling_sharpe_252d', 'rolling_drawdown_252d'])} FROM rm"),
    "rebalance_log": query(
        *_NET, f"""SELECT series_id, strftime(date, '%Y-%m-%d') AS "Date", {_NICE} AS "Strategy",
          round(prev_weight, 6) + 0.0 AS "Old_Weight", round(weight, 6) + 0.0 AS "New_Weight",
          round(abs(weight - prev_weight), 6) + 0.0 AS "Rebalance_Size",
          round(abs(weight - prev_weight) * 0.0015::DOUBLE, 6) + 0.0 AS "Transaction_Cost" FROM net WHERE weight <> prev_weight"""),
    "rebalance_log_latest": query(
        *_NET, f"""SELECT series_id, strftime(date, '%Y-%m-%d') AS "Date", {_NICE} AS "Strategy",
          round(prev_weight, 6) + 0.0 AS "Old_Weight", round(weight, 6) + 0.0 AS "New_Weight",
          round(abs(weight - prev_weight), 6) + 0.0 AS "Rebalance_Size",
          round(abs(weight - prev_weight) * 0.0015::DOUBLE, 6) + 0.0 AS "Transaction_Cost"
          FROM net WHERE weight <> prev_weight AND strategy = 'hybrid' QUALIFY row_number() OVER (PARTITION BY series_id ORDER BY date DESC) <= 5"""),
    "stress_report": query(
        *_NET, f"per AS ({_periods})",
        """sr AS (SELECT n.series_id, n.strategy, n.date, p.*, n.pd IS NULL OR n.pd < p.start_date AS opening, weight, prev_weight, aret
          FROM net n JOIN per p ON n.date BETWEEN p.start_date AND p.end_date)""",
        """s2 AS (SELECT *, weight * CASE WHEN opening THEN 0.0 ELSE aret END
          - abs(weight - CASE WHEN opening THEN 0.0 ELSE prev_weight END) * 0.0015::DOUBLE AS ret FROM sr)""",
        "s3 AS (SELECT *, product(1.0 + ret) OVER (PARTITION BY series_id, strategy, period ORDER BY date) AS cum FROM s2)",
        "s4 AS (SELECT *, max(cum) OVER (PARTITION BY series_id, strategy, period ORDER BY date) AS peak FROM s3)",
        'SELECT series_id, period, strategy, start_date, end_date, round(product(1.0 + ret) - 1.0, 6) + 0.0 AS "Total_Return", '
        'round(min((cum - peak) / (peak + 1e-15)), 6) + 0.0 AS "Max_Drawdown" FROM s4 GROUP BY 1, 2, 3, 4, 5'),
    "split_backtests": query(*_SNET, *_summary(_SG), f"SELECT series_id, split, strategy, {_NICE} AS strategy_name, {rounded(SUMMARY)} FROM bs"),
    "oos_degradation": query(
        *_SNET, *_summary(_SG),
        "dg AS (SELECT series_id, strategy, " + ", ".join(
            f'max("{c}") FILTER (split = \'{s}\') AS "{t}_{n}"'
            for s, t in (("train", "Train"), ("validation", "Val"), ("test", "Test"))
            for c, n in (("CAGR", "CAGR"), ("Sharpe_Ratio", "Sharpe"), ("Max_Drawdown", "Max_DD"))
        ) + " FROM bs GROUP BY 1, 2)",
        "dd2 AS (SELECT *, CASE WHEN \"Train_Sharpe\" <> 0 THEN (\"Test_Sharpe\" - \"Train_Sharpe\") / \"Train_Sharpe\" * 100.0 ELSE 0.0 END AS \"Sharpe_Degradation_Pct\" FROM dg)",
        "SELECT series_id, strategy, " + rounded(
            [f"{t}_{n}" for t in ("Train", "Val", "Test") for n in ("CAGR", "Sharpe", "Max_DD")] + ["Sharpe_Degradation_Pct"]) + " FROM dd2"),
    "reduction_vs_benchmark": query(
        *_NET, *_summary(_G),
        """SELECT a.series_id, a.strategy, round((abs(b."Max_Drawdown") - abs(a."Max_Drawdown")) / nullif(abs(b."Max_Drawdown"), 0), 6) + 0.0 AS drawdown_cut,
          round((b."Annualized_Volatility" - a."Annualized_Volatility") / nullif(b."Annualized_Volatility", 0), 6) + 0.0 AS volatility_cut
          FROM bs a JOIN bs b ON a.series_id = b.series_id AND b.strategy = 'buy_and_hold'"""),
    "robustness_summary": query(
        *_SNET, *_summary(_SG),
        f"""SELECT {_NICE} AS mapping, round(avg("Sharpe_Ratio") FILTER (split = 'train'), 6) + 0.0 AS avg_is_sharpe,
          round(avg("Sharpe_Ratio") FILTER (split = 'test'), 6) + 0.0 AS avg_oos_sharpe,
          round(avg("Max_Drawdown") FILTER (split = 'test'), 6) + 0.0 AS avg_oos_max_dd FROM bs GROUP BY strategy"""),
}
