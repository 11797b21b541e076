"""Wealth, drawdown and risk reports for return rows with free grouping keys."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import SALT, TINY, TRADING_DAYS, full, salted
from ..session import stage
from .layout import BLK, POS, block_window, by_position, cut_blocks, drop_halo, located, plain
from .orderstats import linear, lower_rank, pick_ranks

YEAR_ROOT = TRADING_DAYS**0.5


# --- expressions for groupBy().agg() ---------------------------------------

def spread(c: Column) -> Column:
    """Sample deviation; 0 where rounding leaves a constant series a trace of it."""
    s = F.coalesce(F.stddev_samp(c), F.lit(0.0))
    return F.when(s < TINY, 0.0).otherwise(s)


def cagr(r: Column) -> Column:
    total, years = F.product(1.0 + r), F.count(r) / TRADING_DAYS
    return F.when(total > 0, F.pow(total, 1.0 / years) - 1.0).otherwise(0.0)


def annual_volatility(r: Column) -> Column:
    return spread(r) * YEAR_ROOT


def ratio(top: Column, bottom: Column) -> Column:
    """top / bottom, 0 where the bottom is not positive."""
    return F.when(bottom > 0, top / bottom).otherwise(0.0)


def sharpe(r: Column, risk_free: float = 0.0) -> Column:
    return ratio(F.avg(r - risk_free / TRADING_DAYS) * TRADING_DAYS, annual_volatility(r))


def downside_deviation(r: Column, target: float = 0.0) -> Column:
    below = F.least(r - target / TRADING_DAYS, F.lit(0.0))
    return F.sqrt(F.avg(below * below)) * YEAR_ROOT


def sortino(r: Column, risk_free: float = 0.0) -> Column:
    excess = F.avg(r - risk_free / TRADING_DAYS) * TRADING_DAYS
    return ratio(excess, downside_deviation(r, risk_free))


def win_rate(r: Column) -> Column:
    return F.avg((r > 0).cast("double"))


def profit_factor(r: Column) -> Column:
    gain = F.coalesce(F.sum(F.when(r > 0, r)), F.lit(0.0))
    loss = F.abs(F.coalesce(F.sum(F.when(r < 0, r)), F.lit(0.0)))
    return F.when(loss > 0, gain / loss).when(gain > 0, 999.0).otherwise(0.0)


def beta(r: Column, bench: Column) -> Column:
    return F.coalesce(F.covar_samp(r, bench) / (F.var_samp(bench) + 1e-15), F.lit(1.0))


# --- paths ------------------------------------------------------------------

def wealth_path(df: DataFrame, keys: list[str], ret: str = "ret", eps: float = 1e-15) -> DataFrame:
    """Add ``wealth``, ``peak``, ``drawdown`` and ``lowest`` (running low of wealth).

    Needs ``_pos`` and ``_blk``. A block contributes its product and the extremes
    of its inner path; the block table turns them into the entry wealth and the
    entry peak of the next block, so one join replaces nested running windows.
    The peak starts at the first wealth value.
    """
    w = block_window(keys).rowsBetween(Window.unboundedPreceding, 0)
    inner = (
        df.withColumn("_w", F.product(F.col(ret) + 1.0).over(w))
        .withColumn("_hi", F.max("_w").over(w))
        .withColumn("_lo", F.min("_w").over(w))
    )
    before = Window.partitionBy(*keys).orderBy(BLK).rowsBetween(Window.unboundedPreceding, -1)
    ends = [F.col("_in") * F.col("_top"), F.col("_in") * F.col("_bottom")]
    entry = (
        inner.groupBy(*keys, BLK)
        .agg(F.max_by("_w", POS).alias("_all"), F.max("_w").alias("_top"), F.min("_w").alias("_bottom"))
        .withColumn("_in", F.coalesce(F.product("_all").over(before), F.lit(1.0)))
        .withColumn("_peak_in", F.max(F.greatest(*ends)).over(before))
        .withColumn("_low_in", F.min(F.least(*ends)).over(before))
        .select(*keys, BLK, "_in", "_peak_in", "_low_in")
    )
    highs = [F.col("_in") * F.col("_hi"), F.col("_in") * F.col("_lo")]
    return (
        inner.join(entry, [*keys, BLK])
        .withColumn("wealth", F.col("_in") * F.col("_w"))
        .withColumn("peak", F.greatest("_peak_in", *highs))
        .withColumn("lowest", F.least("_low_in", *highs))
        .withColumn("drawdown", (F.col("wealth") - F.col("peak")) / (F.col("peak") + eps))
        .drop("_w", "_hi", "_lo", "_in", "_peak_in", "_low_in")
    )


def drawdown_path(df: DataFrame, keys: list[str], ret: str = "ret", date: str = "date") -> DataFrame:
    """Wealth, peak and drawdown of every row, ordered by ``date``."""
    return wealth_path(cut_blocks(located(df, keys, date)), keys, ret)


def longest_run(df: DataFrame, keys: list[str], flag: Column, out: str) -> DataFrame:
    """Longest run of consecutive rows with ``flag``, per key.

    Inside a block a run's length is the distance to the last row without the
    flag; runs that cross a border are put together from the block summaries.
    """
    w = block_window(keys).rowsBetween(Window.unboundedPreceding, 0)
    stop = F.when(~flag, F.col(POS))
    rows = df.withColumn("_stop", stop).withColumn("_back", F.max("_stop").over(w))
    blocks = rows.groupBy(*keys, BLK).agg(
        F.max(F.when(F.col("_back").isNotNull(), F.col(POS) - F.col("_back"))).alias("_inside"),
        F.min("_stop").alias("_first"),
        F.max("_stop").alias("_last"),
        F.min(POS).alias("_start"),
        F.max(POS).alias("_end"),
    )
    before = Window.partitionBy(*keys).orderBy(BLK).rowsBetween(Window.unboundedPreceding, -1)
    open_since = F.coalesce(F.max("_last").over(before), F.min("_start").over(Window.partitionBy(*keys)) - 1)
    leading = F.coalesce(F.col("_first") - 1, F.col("_end")) - F.col("_since")
    return (
        blocks.withColumn("_since", open_since)
        .groupBy(*keys)
        .agg(F.max(F.greatest(F.coalesce("_inside", F.lit(0)), leading)).alias(out))
    )


# --- reports ----------------------------------------------------------------

def monthly_returns(df: DataFrame, keys: list[str], ret: str = "ret", date: str = "date") -> DataFrame:
    """Compounded return per calendar month, and per year in the rows with NULL month."""
    year, month = F.year(date).alias("year"), F.month(date).alias("month")
    per_month = df.groupBy(*keys, year, month).agg(F.product(F.col(ret) + 1.0).alias("_g"))
    yearly = per_month.groupBy(*keys, "year").agg(F.product("_g").alias("_g"))
    both = per_month.unionByName(yearly.withColumn("month", F.lit(None).cast("int")))
    return both.select(*keys, "year", "month", (F.col("_g") - 1.0).alias("ret"))


# fixed values: column names of the month table
MONTHS = ["Jan", "Feb", "Mar", "Apr", "May", "Jun", "Jul", "Aug", "Sep", "Oct", "Nov", "Dec"]


def monthly_heatmap(df: DataFrame, keys: list[str], ret: str = "ret", date: str = "date") -> DataFrame:
    """Year by month table with missing months 0 and the year's return in YTD."""
    growth = df.groupBy(*keys, F.year(date).alias("year"), F.month(date).alias("month")).agg(
        F.product(F.col(ret) + 1.0).alias("_g")
    )
    cells = [
        F.coalesce(F.max(F.when(F.col("month") == i, F.col("_g") - 1.0)), F.lit(0.0)).alias(m)
        for i, m in enumerate(MONTHS, 1)
    ]
    return growth.groupBy(*keys, "year").agg(*cells, (F.product("_g") - 1.0).alias("YTD"))


def worst_month(df: DataFrame, keys: list[str], ret: str = "ret", date: str = "date") -> DataFrame:
    month = F.trunc(date, "month").alias("_month")
    growth = df.groupBy(*keys, month).agg((F.product(F.col(ret) + 1.0) - 1.0).alias("_m"))
    return growth.groupBy(*keys).agg(F.min("_m").alias("Worst_Month"))


def tail_losses(df: DataFrame, keys: list[str], ret: str = "ret", alphas=(0.95, 0.99)) -> DataFrame:
    """Historical VaR and CVaR as positive losses."""
    picks = {f"a{round(a * 100)}": lower_rank(a) for a in alphas}
    found = pick_ranks(df, keys, ret, picks)
    cols = []
    for n in picks:
        level = n[1:]
        cols.append(F.abs(n).alias(f"Daily_VaR_{level}"))
        cols.append(F.abs(f"{n}_tail").alias(f"Daily_CVaR_{level}"))
    return found.select(*keys, *cols)


def return_quartiles(df: DataFrame, keys: list[str], ret: str = "ret") -> DataFrame:
    """Quartiles per key, and the number of values beyond 1.5 interquartile ranges."""
    q = pick_ranks(df, keys, ret, {"q1": linear(0.25), "median": linear(0.5), "q3": linear(0.75)})
    q = q.select(*keys, "q1", "median", "q3")
    reach = (F.col("q3") - F.col("q1")) * 1.5
    outside = (F.col(ret) < F.col("q1") - reach) | (F.col(ret) > F.col("q3") + reach)
    rows, q = salted(df.select(*keys, ret), q)
    parts = rows.join(q, [*keys, SALT]).groupBy(*keys, SALT, "q1", "median", "q3").agg(
        F.count_if(outside).alias("outliers"), F.count(F.lit(1)).alias("n")
    )
    return parts.groupBy(*keys, "q1", "median", "q3").agg(F.sum("outliers").alias("outliers"), F.sum("n").alias("n"))


def risk_report(
    df: DataFrame, keys: list[str], ret: str = "ret", date: str = "date", benchmark: str | None = None
) -> DataFrame:
    """All risk metrics, one row per key.

    ``keys`` is free: series, strategy, regime, split. Rows with a NULL return
    are left out; rows that carry ``_pos`` must be numbered without gaps per key.
    ``benchmark`` names a return column and adds Beta.
    """
    need = [*keys, date, ret] + ([benchmark] if benchmark else [])
    need += [c for c in (POS, BLK) if c in df.columns]
    rows = df.select(*need).filter(F.col(ret).isNotNull())
    # five reports read the path, so it is staged instead of computed five times
    path = stage(drawdown_path(rows, keys, ret, date))
    r, dd = F.col(ret), F.col("drawdown")
    metrics = [
        cagr(r).alias("CAGR"),
        annual_volatility(r).alias("Annualized_Volatility"),
        sharpe(r).alias("Sharpe_Ratio"),
        sortino(r).alias("Sortino_Ratio"),
        F.min(dd).alias("Max_Drawdown"),
        F.coalesce(F.avg(F.when(dd < 0, dd)), F.lit(0.0)).alias("Average_Drawdown"),
        win_rate(r).alias("Win_Rate"),
        profit_factor(r).alias("Profit_Factor"),
        downside_deviation(r).alias("Downside_Deviation"),
    ]
    if benchmark:
        both = F.col(benchmark).isNotNull()
        metrics.append(beta(F.when(both, r), F.col(benchmark)).alias("Beta"))
    base = path.groupBy(*keys).agg(*metrics)
    calmar = F.when(F.col("Max_Drawdown") < 0, F.col("CAGR") / F.abs("Max_Drawdown")).otherwise(0.0)
    report = (
        base.withColumn("Calmar_Ratio", calmar)
        .join(longest_run(path, keys, dd < 0, "Drawdown_Duration_Days"), keys)
        .join(tail_losses(path, keys, ret), keys)
        .join(worst_month(path, keys, ret, date), keys)
    )
    order = [
        "CAGR", "Annualized_Volatility", "Sharpe_Ratio", "Sortino_Ratio", "Calmar_Ratio",
        "Max_Drawdown", "Average_Drawdown", "Drawdown_Duration_Days", "Win_Rate", "Profit_Factor",
        "Daily_VaR_95", "Daily_CVaR_95", "Daily_VaR_99", "Daily_CVaR_99", "Downside_Deviation",
        "Worst_Month",
    ]
    report = report.withColumn("Drawdown_Duration_Days", F.col("Drawdown_Duration_Days").cast("double"))
    return report.select(*keys, *order, *(["Beta"] if benchmark else []))


# --- rolling risk -----------------------------------------------------------

def rolling_sharpe(r: Column, n: int, w) -> Column:
    return full(n, r, F.avg, w) / (full(n, r, F.stddev_samp, w) + 1e-15) * YEAR_ROOT


def rolling_sharpe_scaled(r: Column, n: int, w) -> Column:
    """Variant that guards the annualised deviation instead of the daily one."""
    return full(n, r, F.avg, w) * TRADING_DAYS / (full(n, r, F.stddev_samp, w) * YEAR_ROOT + 1e-15)


def rolling_volatility(r: Column, n: int, w) -> Column:
    return full(n, r, F.stddev_samp, w) * YEAR_ROOT


def rolling_beta(r: Column, bench: Column, n: int, w) -> Column:
    """Needs rows where both returns are present."""
    frame = w.rowsBetween(-(n - 1), 0)
    slope = F.covar_samp(r, bench).over(frame) / (F.var_samp(bench).over(frame) + 1e-15)
    return F.when(F.count(bench).over(frame) == n, slope)


def rolling_risk(
    df: DataFrame, keys: list[str], ret: str = "ret", benchmark: str | None = None,
    n: int = 63, date: str = "date",
) -> DataFrame:
    """Rolling Sharpe, both forms, volatility and, with a benchmark, beta."""
    if benchmark:
        df = df.dropna(subset=[ret, benchmark])
    rows, w, r = by_position(df, keys, date), block_window(keys), F.col(ret)
    cols = {
        f"rolling_sharpe_{n}d": rolling_sharpe(r, n, w),
        f"rolling_sharpe_scaled_{n}d": rolling_sharpe_scaled(r, n, w),
        f"rolling_volatility_{n}d": rolling_volatility(r, n, w),
    }
    if benchmark:
        cols[f"rolling_beta_{n}d"] = rolling_beta(r, F.col(benchmark), n, w)
    return plain(drop_halo(rows.withColumns(cols)))


def rolling_drawdown(df: DataFrame, keys: list[str], ret: str = "ret", n: int = 252, date: str = "date") -> DataFrame:
    """Drawdown of wealth against its highest value in the last ``n`` rows.

    Only the ratio of wealth to peak counts, so wealth may start anew in every
    halo block: the common factor drops out.
    """
    rows, w = by_position(df, keys, date), block_window(keys)
    wealth = F.product(F.col(ret) + 1.0).over(w.rowsBetween(Window.unboundedPreceding, 0))
    rows = rows.withColumn("_w", wealth)
    peak = F.max("_w").over(w.rowsBetween(-(n - 1), 0))
    out = rows.withColumn(f"rolling_drawdown_{n}d", (F.col("_w") - peak) / (peak + 1e-15))
    return plain(drop_halo(out)).drop("_w")
