"""Bar features: returns, volatility, trend, momentum, structure, complexity.

All families work on one layout, ``by_position(bars)``: one exchange by series
and block, and windows that share its ordering. Every family is its own
projection so that no generated class grows too large.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.columns import (
    change, full, if_zero, rolling_slope, sample_kurtosis, sample_skew,
)
from . import layout
from .ewm import add_ewm, from_span, memory_rows
from .layout import POS, block_window, by_position, drop_halo

KEYS = ["series_id"]
EPS = 1e-10
YEAR_ROOT = math.sqrt(252.0)
LN2 = math.log(2.0)

RETURN_DAYS = (3, 5, 10, 21, 63)
VOL_WINDOWS = (5, 10, 21, 63)
SMA_WINDOWS = (20, 50, 100, 200)
EMA_WINDOWS = (9, 21, 50, 200)

# fixed values: feature groups and their titles
GROUP_TITLES = {
    "returns": "Returns Indicators",
    "volatility": "Volatility & Range Measures",
    "trend": "Trend Distances & Crossover States",
    "momentum": "Momentum Oscillators",
    "market_structure": "Market Structure & Wicks/Gaps",
    "statistical_complexity": "Statistical Moments & Information Entropy",
    "external": "External Macro Drivers",
}

FEATURES = {
    "returns": ["ret_simple", "ret_log"]
    + [f"ret_{n}d" for n in RETURN_DAYS]
    + ["ret_cum_21d", "ret_cum_63d"],
    "volatility": [f"vol_close_{n}d" for n in VOL_WINDOWS]
    + ["vol_parkinson_21d", "vol_garman_klass_21d", "vol_ewma_21", "vol_regime_pct_21d",
       "vol_ratio_5_21", "atr_14", "atr_pct_14", "hl_range_pct"],
    "trend": [f"{kind}_sma_{n}" for n in SMA_WINDOWS for kind in ("dist", "slope")]
    + [f"{kind}_ema_{n}" for n in EMA_WINDOWS for kind in ("dist", "slope")]
    + ["cross_ema_9_21", "cross_sma_50_200"],
    "momentum": ["rsi_14", "macd_line", "macd_signal", "macd_hist", "roc_10",
                 "stoch_k", "stoch_d", "williams_r"],
    "market_structure": ["candle_body_pct", "upper_wick_pct", "lower_wick_pct", "gap_pct",
                         "drawdown", "max_drawdown_63d", "trend_strength_score", "max_min_dist_21d"],
    "statistical_complexity": ["skewness", "kurtosis", "z_score_ret", "sharpe_ratio",
                               "sortino_ratio", "hurst_exponent", "entropy"],
}


def covariate_return_maps(covariates: DataFrame, name: str = "name", value: str = "close") -> DataFrame:
    """Long external series ``(name, date, close)`` to (date, external): a map from name to log return per date.

    The names stay data: any number of series is one aggregation, and none
    reaches the driver. Names are the keys that have a previous row.
    """
    rows = by_position(covariates.select(name, "date", value), [name], halo=1)
    moved = F.log(F.col(value) / F.lag(value).over(block_window([name])))
    rows = drop_halo(rows.withColumn("_r", moved)).filter("_r is not null")
    return rows.groupBy("date").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct(F.col(name), "_r")))).alias("external"))


def with_external(df: DataFrame, maps: DataFrame) -> DataFrame:
    """Rows with the map of their date, an empty one where no external series moved."""
    kind = dict(maps.dtypes)["external"]
    return df.join(maps, "date", "left").withColumn("external", F.coalesce("external", F.create_map().cast(kind)))


def feature_names(*groups: str) -> list[str]:
    return [f for g in (groups or FEATURES) for f in FEATURES[g]]


def feature_registry(spark: SparkSession) -> DataFrame:
    """Static table ``(feature, group, title, halo)``: ``halo`` is what the group needs before a row."""
    rows = [(f, g, GROUP_TITLES[g], halo_of(g)) for g, names in FEATURES.items() for f in names]
    rows += [("vix_close_ret", "external", GROUP_TITLES["external"], 1)]
    return spark.createDataFrame(rows, "feature string, feature_group string, title string, halo int")


#: What a family's features read: (what they are made of, rows before the current one). Chains of
#: features add up; ``halo_of`` walks them from the features to the bars.
READS = {
    "bars": [],
    "log_return": [("bars", 1)],
    "returns": [("bars", max(RETURN_DAYS)), ("log_return", 62)],
    "close_volatility": [("log_return", max(VOL_WINDOWS) - 1)],
    "volatility": [
        ("close_volatility", 0), ("close_volatility", 251), ("log_return", memory_rows(from_span(21))), ("bars", 1 + memory_rows(1.0 / 14)),
    ],
    "trend": [("bars", max(SMA_WINDOWS) - 1 + 4), ("bars", memory_rows(from_span(max(EMA_WINDOWS))) + 4)],
    "macd_line": [("bars", memory_rows(from_span(26)))],
    "momentum": [("macd_line", memory_rows(from_span(9))), ("bars", 1 + memory_rows(1.0 / 14)), ("bars", 10), ("bars", 13 + 2)],
    "drawdown": [("bars", 62)],
    "market_structure": [("drawdown", 62), ("bars", 14), ("bars", 20)],
    "statistical_complexity": [("log_return", 62), ("bars", 125 + 16)],
}


def halo_of(*groups: str) -> int:
    """Rows before a block that the features of the given groups (all by default) need, and no more."""
    def depth(node: str) -> int:
        return max((rows + depth(child) for child, rows in READS[node]), default=0)

    return max(depth(g) for g in (groups or FEATURES))


def feature_layout(bars: DataFrame, *groups: str) -> DataFrame:
    """Positions, blocks and halos, plus the log return every family uses.

    A block gets the rows that the groups need, at most the layout's own halo.
    """
    rows = by_position(bars, KEYS, halo=min(max(halo_of(*groups), halo_of("returns")), layout.HALO_ROWS))
    w = block_window(KEYS)
    return rows.withColumn("ret_log", F.log(F.col("close") / F.lag("close").over(w)))


def add_returns(df: DataFrame) -> DataFrame:
    w, c, lr = block_window(KEYS), F.col("close"), F.col("ret_log")
    cols = {"ret_simple": change(c, 1, w)}
    cols |= {f"ret_{n}d": change(c, n, w) for n in RETURN_DAYS}
    cols |= {f"ret_cum_{n}d": F.exp(full(n, lr, F.sum, w)) - 1.0 for n in (21, 63)}
    return df.withColumns(cols)


def _range_log() -> Column:
    return F.log(F.greatest(F.col("high") / (F.col("low") + EPS), F.lit(1.00001)))


def percentile_rank(x: Column, n: int, w) -> Column:
    """Average-tie percentile rank of the current value among the last ``n``."""
    frame = w.rowsBetween(-(n - 1), 0)
    seen = F.collect_list(x).over(frame)
    return F.when(F.count(x).over(frame) == n, F.struct(seen.alias("seen"), x.alias("now")))


def add_volatility(df: DataFrame) -> DataFrame:
    w, lr = block_window(KEYS), F.col("ret_log")
    hl = _range_log()
    co = F.log(F.greatest(F.col("close") / (F.col("open") + EPS), F.lit(1e-5)))
    prev = F.lag("close").over(w)
    df = df.withColumns(
        {
            "_pk": hl * hl / (4.0 * LN2),
            "_gk": F.greatest(0.5 * hl * hl - (2.0 * LN2 - 1.0) * co * co, F.lit(0.0)),
            "_lr2": lr * lr,
            "_tr": F.greatest(
                F.col("high") - F.col("low"), F.abs(F.col("high") - prev), F.abs(F.col("low") - prev)
            ),
        }
    )
    cols = {f"vol_close_{n}d": full(n, lr, F.stddev_samp, w) for n in VOL_WINDOWS}
    cols["vol_parkinson_21d"] = F.sqrt(full(21, F.col("_pk"), F.avg, w))
    cols["vol_garman_klass_21d"] = F.sqrt(full(21, F.col("_gk"), F.avg, w))
    df = df.withColumns(cols)
    df = add_ewm(df, KEYS, {"_ev": ("_lr2", from_span(21), 1), "atr_14": ("_tr", 1.0 / 14, 0)})
    ranked = df.withColumn("_rank", percentile_rank(F.col("vol_close_21d"), 252, w))
    less = F.size(F.filter(F.col("_rank.seen"), lambda v: v < F.col("_rank.now")))
    same = F.size(F.filter(F.col("_rank.seen"), lambda v: v == F.col("_rank.now")))
    return ranked.withColumns(
        {
            "vol_ewma_21": F.sqrt("_ev"),
            "vol_regime_pct_21d": F.when(F.col("_rank").isNotNull(), (less + (same + 1) / 2.0) / 252.0),
            "vol_ratio_5_21": F.col("vol_close_5d") / (F.col("vol_close_21d") + EPS),
            "atr_pct_14": F.col("atr_14") / (F.col("close") + EPS),
            "hl_range_pct": (F.col("high") - F.col("low")) / (F.col("close") + EPS),
        }
    ).drop("_pk", "_gk", "_lr2", "_tr", "_ev", "_rank")


def add_trend(df: DataFrame) -> DataFrame:
    w, c, pos = block_window(KEYS), F.col("close"), F.col(POS)
    df = df.withColumns({f"_sma_{n}": full(n, c, F.avg, w) for n in SMA_WINDOWS})
    df = add_ewm(df, KEYS, {f"_ema_{n}": ("close", from_span(n), 0) for n in EMA_WINDOWS})
    cols = {}
    for kind, windows in (("sma", SMA_WINDOWS), ("ema", EMA_WINDOWS)):
        for n in windows:
            m = F.col(f"_{kind}_{n}")
            cols[f"dist_{kind}_{n}"] = (c - m) / m
            cols[f"slope_{kind}_{n}"] = rolling_slope(m, 5, pos, w)
    # a comparison with a missing mean counts as "not above"
    above = lambda a, b: F.when(F.col(a) > F.col(b), 1.0).otherwise(-1.0)
    cols["cross_ema_9_21"] = above("_ema_9", "_ema_21")
    cols["cross_sma_50_200"] = above("_sma_50", "_sma_200")
    means = [f"_sma_{n}" for n in SMA_WINDOWS] + [f"_ema_{n}" for n in EMA_WINDOWS]
    return df.withColumns(cols).drop(*means)


def add_momentum(df: DataFrame) -> DataFrame:
    w, c = block_window(KEYS), F.col("close")
    delta = c - F.lag("close").over(w)
    df = df.withColumns({"_up": F.when(delta > 0, delta).otherwise(delta * 0.0),
                         "_down": F.when(delta < 0, -delta).otherwise(delta * 0.0)})
    df = add_ewm(
        df, KEYS,
        {
            "_eu": ("_up", 1.0 / 14, 1), "_ed": ("_down", 1.0 / 14, 1),
            "_fast": ("close", from_span(12), 0), "_slow": ("close", from_span(26), 0),
        },
    )
    df = df.withColumn("macd_line", F.col("_fast") - F.col("_slow"))
    df = add_ewm(df, KEYS, {"macd_signal": ("macd_line", from_span(9), 0)})
    low, high = full(14, F.col("low"), F.min, w), full(14, F.col("high"), F.max, w)
    df = df.withColumns({"_low": low, "_high": high})
    width = F.col("_high") - F.col("_low") + EPS
    df = df.withColumns(
        {
            "rsi_14": 100.0 - 100.0 / (1.0 + F.col("_eu") / (F.col("_ed") + EPS)),
            "macd_hist": F.col("macd_line") - F.col("macd_signal"),
            "roc_10": change(c, 10, w),
            "stoch_k": (c - F.col("_low")) / width * 100.0,
            "williams_r": (F.col("_high") - c) / width * -100.0,
        }
    )
    df = df.withColumn("stoch_d", full(3, F.col("stoch_k"), F.avg, w))
    return df.drop("_up", "_down", "_eu", "_ed", "_fast", "_slow", "_low", "_high")


def add_structure(df: DataFrame) -> DataFrame:
    w = block_window(KEYS)
    o, h, l, c = (F.col(n) for n in ("open", "high", "low", "close"))
    prev = F.lag("close").over(w)
    reach = w.rowsBetween(-62, 0)
    span = h - l + EPS
    df = df.withColumns({"_step": F.abs(c - prev), "_top": F.max(c).over(reach)})
    df = df.withColumns(
        {
            "candle_body_pct": F.abs(c - o) / span,
            "upper_wick_pct": (h - F.greatest(o, c)) / span,
            "lower_wick_pct": (F.least(o, c) - l) / span,
            "gap_pct": (o - prev) / (prev + EPS),
            "drawdown": (c - F.col("_top")) / (F.col("_top") + EPS),
            "trend_strength_score": F.abs(c - F.lag("close", 14).over(w))
            / (full(14, F.col("_step"), F.sum, w) + EPS),
            "max_min_dist_21d": (full(21, h, F.max, w) - full(21, l, F.min, w)) / (c + EPS),
        }
    )
    return df.withColumn("max_drawdown_63d", F.min("drawdown").over(reach)).drop("_step", "_top")


def hurst(price: Column, n: int, w) -> Column:
    """Slope of ln std(x_t - x_{t-L}) on ln L for L = 2, 4, 8, 16, inside n rows."""
    lags = (2, 4, 8, 16)
    xs = [math.log(v) for v in lags]
    mean_x = sum(xs) / len(xs)
    sxx = sum((x - mean_x) ** 2 for x in xs)
    logs = []
    for lag in lags:
        s = F.col(f"_sd_{lag}")
        logs.append(F.when(s > 0, F.log(s)))
    return reduce(lambda a, b: a + b, [y * ((x - mean_x) / sxx) for x, y in zip(xs, logs)])


def bin_index(values: Column, low: Column, high: Column, bins: int) -> Column:
    """Equal-width bin of every array element; both edges belong to the histogram.

    One single value falls into the middle of a range of width 1.
    """
    flat = low == high
    start = F.when(flat, low - 0.5).otherwise(low)
    width = F.when(flat, F.lit(1.0)).otherwise(high - low)
    return F.transform(values, lambda v: F.least(F.floor((v - start) / width * bins), F.lit(bins - 1)))


def entropy_of_bins(index: Column, bins: int) -> Column:
    """Entropy (natural log) of an array of bin numbers."""
    def share(b: int) -> Column:
        return F.size(F.filter(index, lambda i: i == b)) / (F.size(index) + EPS)

    def term(p: Column) -> Column:
        return F.when(p > 0, -p * F.log(p)).otherwise(0.0)

    return reduce(lambda a, b: a + b, [term(share(b)) for b in range(bins)])


def add_complexity(df: DataFrame) -> DataFrame:
    w, c, lr = block_window(KEYS), F.col("close"), F.col("ret_log")
    spans = {
        f"_sd_{k}": F.stddev_samp(F.col(f"_d_{k}")).over(w.rowsBetween(-(125 - k), 0))
        for k in (2, 4, 8, 16)
    }
    recent = w.rowsBetween(-62, 0)
    df = df.withColumns({f"_d_{k}": c - F.lag("close", k).over(w) for k in (2, 4, 8, 16)})
    df = df.withColumns(
        {
            **spans,
            "_mean": full(21, lr, F.avg, w),
            "_std": full(21, lr, F.stddev_samp, w),
            "_dstd": full(21, F.least(lr, lr * 0.0), F.stddev_samp, w),
            "skewness": sample_skew(lr, 21, w),
            "kurtosis": sample_kurtosis(lr, 21, w),
            "_bag": F.when(F.count(lr).over(recent) == 63, F.collect_list(lr).over(recent)),
            "_least": F.min(lr).over(recent),
            "_most": F.max(lr).over(recent),
        }
    )
    df = df.withColumn("_bins", bin_index(F.col("_bag"), F.col("_least"), F.col("_most"), 10))
    return df.withColumns(
        {
            "z_score_ret": (lr - F.col("_mean")) / (F.col("_std") + EPS),
            "sharpe_ratio": F.col("_mean") / (F.col("_std") + EPS) * YEAR_ROOT,
            "sortino_ratio": F.col("_mean") / (F.col("_dstd") + EPS) * YEAR_ROOT,
            "hurst_exponent": F.when(F.col(POS) >= 125, hurst(c, 126, w)),
            "entropy": F.when(F.col("_bins").isNotNull(), entropy_of_bins(F.col("_bins"), 10)),
        }
    ).drop("_mean", "_std", "_dstd", "_bag", "_bins", "_least", "_most", *[f"_d_{k}" for k in (2, 4, 8, 16)], *spans)


FAMILIES = {
    "returns": add_returns,
    "volatility": add_volatility,
    "trend": add_trend,
    "momentum": add_momentum,
    "market_structure": add_structure,
    "statistical_complexity": add_complexity,
}


def compute_features(bars: DataFrame, *groups: str) -> DataFrame:
    """Features of the given groups (all by default), with the raw bar columns.

    Output: series_id, date, features, ``raw_open`` .. ``raw_volume``. A
    ``vix_close`` column adds its log change as ``vix_close_ret``.
    """
    groups = groups or tuple(FAMILIES)
    df = feature_layout(bars, *groups)
    for g in groups:
        df = FAMILIES[g](df)
    names = feature_names(*groups)
    if "vix_close" in bars.columns:
        w = block_window(KEYS)
        moved = F.log(F.col("vix_close") / F.lag("vix_close").over(w))
        df = df.withColumn("vix_close_ret", if_zero(moved))
        names = [*names, "vix_close_ret"]
    raw = [F.col(c).alias(f"raw_{c}") for c in ("open", "high", "low", "close", "volume")]
    return drop_halo(df).select(*KEYS, "date", *names, *raw)


def covariate_returns(covariates: DataFrame, name: str = "name", value: str = "close") -> DataFrame:
    """Long external series ``(name, date, close)`` to ``ext_<name>_ret`` columns.

    The reference point of a log return is the series' own previous row. All
    series are pivoted at once instead of chained outer joins.
    """
    rows = by_position(covariates.select(name, "date", value), [name], halo=1)
    w = block_window([name])
    rows = drop_halo(rows.withColumn("_r", F.log(F.col(value) / F.lag(value).over(w))))
    # the covariate names are a short list, so they are read to name the columns
    names = sorted(r[0] for r in covariates.select(name).distinct().collect())
    cells = [F.max(F.when(F.col(name) == n, F.col("_r"))).alias(f"ext_{n}_ret") for n in names]
    return rows.groupBy("date").agg(*cells)
