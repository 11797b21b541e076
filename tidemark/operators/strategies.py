"""Signals to lagged weights, cost-aware returns, backtest and stress reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.columns import full, if_zero
from ..session import stage
from . import risk
from .ewm import add_ewm, from_span
from .layout import BLK, OWN, POS, block_window, by_position, plain
from .regimes import label_weight

STRATEGIES = ["buy_and_hold", "ema_crossover", "vol_targeting", "regime_aware", "hybrid"]


def pretty(name: Column) -> Column:
    return F.initcap(F.replace(name, F.lit("_"), F.lit(" ")))


def strategy_returns(
    df: DataFrame, keys: list[str] = ["series_id"], price: str = "close", target_vol: float = 0.15,
    lookback: int = 21, fee_bps: float = 10.0, slip_bps: float = 5.0, cash_yield: float = 0.0,
) -> DataFrame:
    """Weight and net return of the five strategies, one row per strategy and day.

    Signals act one row later. The first row pays for the whole position it
    opens. ``df`` needs the price and, for the regime strategies, a
    ``regime_label``. Output: keys, date, strategy, weight, prev_weight,
    asset_ret, ret, prev_date, and the layout columns.

    Weights are computed wide in one block layout and turned into rows at the
    end, so the five strategies share one exchange and one sort.
    """
    cost = (fee_bps + slip_bps) / 10000.0
    rows, w = by_position(df, keys), block_window(keys)
    step = F.col(price) / F.lag(price).over(w) - 1.0
    rows = rows.withColumn("asset_ret", if_zero(step)).withColumn("prev_date", F.lag("date").over(w))
    rows = add_ewm(rows, keys, {"_e50": (price, from_span(50), 0), "_e200": (price, from_span(200), 0)})
    vol = F.coalesce(full(lookback, F.col("asset_ret"), F.stddev_samp, w) * 252.0**0.5, F.lit(target_vol))
    label = F.col("regime_label") if "regime_label" in df.columns else F.lit(None).cast("string")
    rows = rows.withColumns(
        {
            "_up": F.when(F.col("_e50") > F.col("_e200"), 1.0).otherwise(0.0),
            "_size": F.least(F.lit(1.0), target_vol / (vol + 1e-15)),
            "_regime": label_weight(label),
        }
    )
    before = lambda c, first: F.coalesce(F.lag(c).over(w), F.lit(first))
    rows = rows.withColumns(
        {
            "w_buy_and_hold": F.lit(1.0),
            "w_ema_crossover": before("_up", 0.0),
            "w_vol_targeting": before("_size", 1.0),
            "w_regime_aware": before("_regime", 0.0),
        }
    ).withColumn("w_hybrid", F.col("w_regime_aware") * F.col("w_ema_crossover"))
    rows = rows.withColumns({f"p_{s}": F.lag(f"w_{s}", 1, 0.0).over(w) for s in STRATEGIES})
    long = F.inline(
        F.array(
            *[
                F.struct(
                    F.lit(s).alias("strategy"),
                    F.col(f"w_{s}").alias("weight"),
                    F.col(f"p_{s}").alias("prev_weight"),
                )
                for s in STRATEGIES
            ]
        )
    )
    rows = rows.filter(OWN).select(*keys, "date", "prev_date", POS, BLK, "asset_ret", long)
    return rows.withColumn(
        "ret", net_return(F.col("weight"), F.col("prev_weight"), F.col("asset_ret"), cost, cash_yield)
    )


def net_return(weight: Column, prev: Column, asset: Column, cost: float, cash_yield: float = 0.0) -> Column:
    """Position return, plus cash interest on the unused part, minus trading cost."""
    cash = F.greatest(F.lit(0.0), 1.0 - F.abs(weight)) * (cash_yield / 252.0)
    return weight * asset + cash - F.abs(weight - prev) * cost


def equity_curves(returns: DataFrame, keys: list[str] = ["series_id"]) -> DataFrame:
    """Equity per strategy; once it touches 0 it stays there."""
    path = risk.wealth_path(returns, [*keys, "strategy"])
    equity = F.when(F.col("lowest") <= 0, 0.0).otherwise(F.col("wealth"))
    return path.select(*keys, "strategy", "date", "weight", "ret", equity.alias("equity"))


def wide_curves(curves: DataFrame, keys: list[str] = ["series_id"]) -> DataFrame:
    """One row per day with ``equity_<strategy>`` and ``weight_<strategy>`` columns."""
    cells = [
        F.max(F.when(F.col("strategy") == s, F.col(c))).alias(f"{c}_{s}")
        for s in STRATEGIES
        for c in ("equity", "weight")
    ]
    return curves.groupBy(*keys, "date").agg(*cells)


def backtest_summary(returns: DataFrame, keys: list[str] = ["series_id"]) -> DataFrame:
    """Risk report, turnover and exposure per strategy."""
    group = [*keys, "strategy"]
    returns = stage(returns)
    traded = returns.groupBy(*group).agg(
        F.sum(F.abs(F.col("weight") - F.col("prev_weight"))).alias("Total_Turnover"),
        F.avg(F.abs("weight")).alias("Average_Exposure"),
    )
    report = risk.risk_report(returns, group).drop("Daily_VaR_99", "Daily_CVaR_99")
    return report.join(traded, group).withColumn("strategy_name", pretty(F.col("strategy")))


def rolling_metrics(returns: DataFrame, keys: list[str] = ["series_id"], n: int = 252) -> DataFrame:
    """Rolling Sharpe and drawdown per strategy, long form."""
    group = [*keys, "strategy"]
    rows, w, r = by_position(returns, group), block_window(group), F.col("ret")
    wealth = F.product(r + 1.0).over(w.rowsBetween(Window.unboundedPreceding, 0))
    rows = rows.withColumn("_w", wealth).withColumns(
        {
            "_top": F.max("_w").over(w.rowsBetween(-(n - 1), 0)),
            f"rolling_sharpe_{n}d": risk.rolling_sharpe(r, n, w),
        }
    )
    rows = rows.withColumn(
        f"rolling_drawdown_{n}d", (F.col("_w") - F.col("_top")) / (F.col("_top") + 1e-15)
    )
    return rows.filter(OWN).select(*group, "date", f"rolling_sharpe_{n}d", f"rolling_drawdown_{n}d")


def rebalance_log(returns: DataFrame, keys: list[str] = ["series_id"], fee_bps: float = 10.0, slip_bps: float = 5.0) -> DataFrame:
    """Days on which a strategy changes its weight, all strategies together."""
    size = F.abs(F.col("weight") - F.col("prev_weight"))
    return returns.filter(F.col("weight") != F.col("prev_weight")).select(
        *keys,
        F.date_format("date", "yyyy-MM-dd").alias("Date"),
        pretty(F.col("strategy")).alias("Strategy"),
        F.col("prev_weight").alias("Old_Weight"),
        F.col("weight").alias("New_Weight"),
        size.alias("Rebalance_Size"),
        (size * ((fee_bps + slip_bps) / 10000.0)).alias("Transaction_Cost"),
    )


def newest_rows(log: DataFrame, k: int, keys: list[str] = ["series_id"]) -> DataFrame:
    """The ``k`` newest rows of every report; the rank limit prunes rows before the exchange."""
    newest = F.row_number().over(Window.partitionBy(*keys).orderBy(F.col("Date").desc()))
    return log.withColumn("_k", newest).filter(F.col("_k") <= k).drop("_k")


def for_strategy(df: DataFrame, name: str) -> DataFrame:
    """Rows of one strategy, whatever the case of its name."""
    return df.filter(F.lower("Strategy") == name.lower())


# fixed values: crisis windows evaluated by default
STRESS_PERIODS = [
    ("COVID Crash (Spring 2020)", "2020-02-01", "2020-05-31"),
    ("2022 Volatility & Growth Selloff", "2022-01-01", "2022-06-30"),
]


def stress_report(
    returns: DataFrame, spark: SparkSession, periods: list[tuple[str, str, str]] = STRESS_PERIODS,
    keys: list[str] = ["series_id"], fee_bps: float = 10.0, slip_bps: float = 5.0, cash_yield: float = 0.0,
) -> DataFrame:
    """Total return and maximum drawdown per stress window and strategy.

    Windows may overlap; windows without rows do not appear. A window starts
    flat: its first row has no asset return and pays for the whole position.
    The window list is given by the caller, so broadcasting it is safe.
    """
    cost = (fee_bps + slip_bps) / 10000.0
    table = spark.createDataFrame(periods, "period string, start_date string, end_date string")
    table = table.select("period", *[F.to_date(c).alias(c) for c in ("start_date", "end_date")])
    inside = F.col("date").between(F.col("start_date"), F.col("end_date"))
    rows = returns.join(F.broadcast(table), inside)
    opening = F.col("prev_date").isNull() | (F.col("prev_date") < F.col("start_date"))
    prev = F.when(opening, 0.0).otherwise(F.col("prev_weight"))
    asset = F.when(opening, 0.0).otherwise(F.col("asset_ret"))
    rows = rows.withColumn("ret", net_return(F.col("weight"), prev, asset, cost, cash_yield))
    group = [*keys, "period", "strategy"]
    path = risk.wealth_path(rows, group)
    return path.groupBy(*group, "start_date", "end_date").agg(
        (F.product(F.col("ret") + 1.0) - 1.0).alias("Total_Return"), F.min("drawdown").alias("Max_Drawdown")
    )


def degradation(train: DataFrame, validation: DataFrame, test: DataFrame, keys: list[str] = ["series_id"]) -> DataFrame:
    """Train, validation and test metrics side by side, and the loss of Sharpe in percent."""
    group = [*keys, "strategy"]

    def part(df: DataFrame, tag: str) -> DataFrame:
        names = {"CAGR": "CAGR", "Sharpe_Ratio": "Sharpe", "Max_Drawdown": "Max_DD"}
        return df.select(*group, *[F.col(c).alias(f"{tag}_{n}") for c, n in names.items()])

    out = part(train, "Train").join(part(validation, "Val"), group, "left").join(part(test, "Test"), group, "left")
    out = out.fillna(0.0)
    loss = F.when(
        F.col("Train_Sharpe") != 0,
        (F.col("Test_Sharpe") - F.col("Train_Sharpe")) / F.col("Train_Sharpe") * 100.0,
    ).otherwise(0.0)
    return out.withColumn("Sharpe_Degradation_Pct", loss)


def reduction_vs_benchmark(summary: DataFrame, keys: list[str] = ["series_id"], benchmark: str = "buy_and_hold") -> DataFrame:
    """Cut of drawdown and volatility against the benchmark strategy."""
    base = summary.filter(F.col("strategy") == benchmark).select(
        *keys, F.abs("Max_Drawdown").alias("_dd"), F.col("Annualized_Volatility").alias("_vol")
    )
    cut = lambda x, base: F.when(F.col(base) != 0, (F.col(base) - x) / F.col(base))
    return summary.join(base, keys).select(
        *keys, "strategy",
        cut(F.abs("Max_Drawdown"), "_dd").alias("drawdown_cut"),
        cut(F.col("Annualized_Volatility"), "_vol").alias("volatility_cut"),
    )


def robustness(runs: DataFrame, by: str = "mapping") -> DataFrame:
    """Mean in-sample and out-of-sample results per mapping, best first."""
    means = runs.groupBy(by).agg(
        F.avg("is_sharpe").alias("avg_is_sharpe"),
        F.avg("oos_sharpe").alias("avg_oos_sharpe"),
        F.avg("oos_max_dd").alias("avg_oos_max_dd"),
    )
    return means.withColumn(by, pretty(F.col(by))).orderBy(F.col("avg_oos_sharpe").desc(), by)
