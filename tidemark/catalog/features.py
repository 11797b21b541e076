"""Queries on bar features, one per family."""

from __future__ import annotations

from ..functions.columns import round_doubles
from ..operators import features as ft
from ..sources.tables import daily_bars
from .sqlparts import BARS, LOGS, YEAR, ewm, frame, query, rounded, span, whole

EMA, SMA = ft.EMA_WINDOWS, ft.SMA_WINDOWS
DIGITS = {"trend": {f"slope_{k}_{n}": 3 for k, ns in (("sma", SMA), ("ema", EMA)) for n in ns},
          "momentum": {"macd_line": 3, "macd_signal": 3, "macd_hist": 3},
          "volatility": {"atr_14": 3}}


def _family(group):
    def run(spark, sf):
        df = ft.compute_features(daily_bars(spark, sf), group)
        df = df.select("series_id", "date", *ft.feature_names(group))
        return round_doubles(df, 6, **DIGITS.get(group, {}))

    return run


QUERIES = {f"features_{g}": _family(g) for g in ft.FAMILIES}


def _oracle(group: str, *ctes: str) -> str:
    cols = {n: DIGITS.get(group, {}).get(n, 6) for n in ft.feature_names(group)}
    return query(BARS, LOGS, *ctes, f"SELECT series_id, date, {rounded(cols)} FROM f")


def _lag(n: int, c: str = "close") -> str:
    return f"lag({c}, {n}) OVER (PARTITION BY series_id ORDER BY date)"


_hl = "ln(greatest(high / (low + 1e-10), 1.00001::DOUBLE))"
_co = "ln(greatest(close / (open + 1e-10), 1e-5::DOUBLE))"
_returns = ", ".join(
    ["close / prev - 1.0 AS ret_simple", "ret_log"]
    + [f"close / {_lag(n)} - 1.0 AS ret_{n}d" for n in ft.RETURN_DAYS]
    + [f"exp({whole(n, 'sum', 'ret_log')}) - 1.0 AS ret_cum_{n}d" for n in (21, 63)]
)


def _slope(c: str) -> str:
    f = frame(5)
    return f"CASE WHEN count({c}) {f} = 5 THEN regr_slope({c}, pos) {f} END"


_means = ", ".join(
    [f"{whole(n, 'avg', 'close')} AS sma_{n}" for n in SMA]
    + [f"{ewm('close', span(n))} AS ema_{n}" for n in EMA]
)
_trend = ", ".join(
    f"(close - {k}_{n}) / {k}_{n} AS dist_{k}_{n}, {_slope(f'{k}_{n}')} AS slope_{k}_{n}"
    for k, ns in (("sma", SMA), ("ema", EMA))
    for n in ns
)
_lags = (2, 4, 8, 16)
_hurst_sd = ", ".join(
    f"stddev_samp(d{k}) {frame(126 - k)} AS s{k}" for k in _lags
)
_hurst_ok = " AND ".join(f"s{k} > 0" for k in _lags)
_mx = "((ln(2.0::DOUBLE) + ln(4.0::DOUBLE) + ln(8.0::DOUBLE) + ln(16.0::DOUBLE)) / 4)"
_sxx = "(" + " + ".join(f"(ln({k}.0::DOUBLE) - {_mx}) * (ln({k}.0::DOUBLE) - {_mx})" for k in _lags) + ")"
_hurst = (
    f"CASE WHEN pos >= 125 AND {_hurst_ok} THEN ("
    + " + ".join(f"ln(s{k}) * (ln({k}.0::DOUBLE) - {_mx})" for k in _lags)
    + f") / {_sxx} END"
)
_bin = "lambda v: least(9, CAST(floor((v - lo) / wd * 10) AS INTEGER))"
_ent = """-list_sum(list_transform(range(0, 10), lambda b:
  CASE WHEN len(list_filter(ix, lambda i: i = b)) > 0
       THEN (len(list_filter(ix, lambda i: i = b)) / (63 + 1e-10::DOUBLE)) * ln(len(list_filter(ix, lambda i: i = b)) / (63 + 1e-10::DOUBLE))
       ELSE 0.0::DOUBLE END))"""

ORACLES = {
    "features_returns": _oracle("returns", f"f AS (SELECT series_id, date, {_returns} FROM logs)"),
    "features_volatility": _oracle(
        "volatility",
        f"""p AS (SELECT *, {_hl} * {_hl} / (4.0 * ln(2.0::DOUBLE)) AS pk,
          greatest(0.5 * {_hl} * {_hl} - (2.0 * ln(2.0::DOUBLE) - 1.0) * {_co} * {_co}, 0.0::DOUBLE) AS gk,
          ret_log * ret_log AS lr2,
          CASE WHEN prev IS NULL THEN high - low ELSE greatest(high - low, abs(high - prev), abs(low - prev)) END AS tr
          FROM logs)""",
        f"""v AS (SELECT *, {', '.join(f"{whole(n, 'stddev_samp', 'ret_log')} AS vol_close_{n}d" for n in ft.VOL_WINDOWS)},
          sqrt({whole(21, 'avg', 'pk')}) AS vol_parkinson_21d, sqrt({whole(21, 'avg', 'gk')}) AS vol_garman_klass_21d,
          sqrt({ewm('lr2', span(21))}) AS vol_ewma_21, {ewm('tr', '(1.0::DOUBLE / 14)')} AS atr_14 FROM p)""",
        f"""g AS (SELECT *, list(vol_close_21d) {frame(252)} AS seen, count(vol_close_21d) {frame(252)} AS have FROM v)""",
        """f AS (SELECT *, CASE WHEN have = 252 THEN (len(list_filter(seen, lambda x: x < vol_close_21d))
            + (len(list_filter(seen, lambda x: x = vol_close_21d)) + 1) / 2.0::DOUBLE) / 252.0::DOUBLE END AS vol_regime_pct_21d,
          vol_close_5d / (vol_close_21d + 1e-10) AS vol_ratio_5_21, atr_14 / (close + 1e-10) AS atr_pct_14,
          (high - low) / (close + 1e-10) AS hl_range_pct FROM g)""",
    ),
    "features_trend": _oracle(
        "trend",
        f"m AS (SELECT *, {_means} FROM logs)",
        f"""f AS (SELECT series_id, date, {_trend},
          CASE WHEN ema_9 > ema_21 THEN 1.0::DOUBLE ELSE -1.0::DOUBLE END AS cross_ema_9_21,
          CASE WHEN sma_50 > sma_200 THEN 1.0::DOUBLE ELSE -1.0::DOUBLE END AS cross_sma_50_200 FROM m)""",
    ),
    "features_momentum": _oracle(
        "momentum",
        "d AS (SELECT *, greatest(close - prev, 0.0) + 0.0 * (close - prev) AS up, "
        "greatest(prev - close, 0.0) + 0.0 * (close - prev) AS down FROM logs)",
        f"""e AS (SELECT *, {ewm('up', '(1.0::DOUBLE / 14)')} AS eu, {ewm('down', '(1.0::DOUBLE / 14)')} AS ed,
          {ewm('close', span(12))} - {ewm('close', span(26))} AS macd_line,
          {whole(14, 'min', 'low')} AS lo, {whole(14, 'max', 'high')} AS hi FROM d)""",
        f"""k AS (SELECT *, {ewm('macd_line', span(9))} AS macd_signal,
          (close - lo) / (hi - lo + 1e-10) * 100.0 AS stoch_k FROM e)""",
        f"""f AS (SELECT *, CASE WHEN prev IS NOT NULL THEN 100.0 - 100.0 / (1.0 + eu / (ed + 1e-10)) END AS rsi_14,
          macd_line - macd_signal AS macd_hist, close / {_lag(10)} - 1.0 AS roc_10,
          {whole(3, 'avg', 'stoch_k')} AS stoch_d, (hi - close) / (hi - lo + 1e-10) * -100.0 AS williams_r FROM k)""",
    ),
    "features_market_structure": _oracle(
        "market_structure",
        f"s AS (SELECT *, abs(close - prev) AS step, max(close) {frame(63)} AS top, high - low + 1e-10 AS rng FROM logs)",
        f"""t AS (SELECT *, (close - top) / (top + 1e-10) AS drawdown FROM s)""",
        f"""f AS (SELECT series_id, date, abs(close - open) / rng AS candle_body_pct,
          (high - greatest(open, close)) / rng AS upper_wick_pct, (least(open, close) - low) / rng AS lower_wick_pct,
          (open - prev) / (prev + 1e-10) AS gap_pct, drawdown, min(drawdown) {frame(63)} AS max_drawdown_63d,
          abs(close - {_lag(14)}) / (({whole(14, 'sum', 'step')}) + 1e-10) AS trend_strength_score,
          (({whole(21, 'max', 'high')}) - ({whole(21, 'min', 'low')})) / (close + 1e-10) AS max_min_dist_21d FROM t)""",
    ),
    "features_statistical_complexity": _oracle(
        "statistical_complexity",
        f"d AS (SELECT *, {', '.join(f'close - {_lag(k)} AS d{k}' for k in _lags)}, "
        "CASE WHEN ret_log IS NOT NULL THEN least(ret_log, 0.0) END AS neg FROM logs)",
        f"""m AS (SELECT *, {_hurst_sd}, {whole(21, 'avg', 'ret_log')} AS mean, {whole(21, 'stddev_samp', 'ret_log')} AS sd,
          {whole(21, 'stddev_samp', 'neg')} AS dsd, {whole(21, 'skewness', 'ret_log')} AS skewness,
          {whole(21, 'kurtosis', 'ret_log')} AS kurtosis,
          CASE WHEN count(ret_log) {frame(63)} = 63 THEN list(ret_log) {frame(63)} END AS bag FROM d)""",
        """l AS (SELECT *, list_min(bag) AS lo0, list_max(bag) AS hi0 FROM m)""",
        """h AS (SELECT *, CASE WHEN lo0 = hi0 THEN lo0 - 0.5 ELSE lo0 END AS lo,
          CASE WHEN lo0 = hi0 THEN 1.0 ELSE hi0 - lo0 END AS wd FROM l)""",
        f"i AS (SELECT *, list_transform(bag, {_bin}) AS ix FROM h)",
        f"""f AS (SELECT series_id, date, skewness, kurtosis, (ret_log - mean) / (sd + 1e-10) AS z_score_ret,
          mean / (sd + 1e-10) * {YEAR} AS sharpe_ratio, mean / (dsd + 1e-10) * {YEAR} AS sortino_ratio,
          {_hurst} AS hurst_exponent, CASE WHEN bag IS NOT NULL THEN {_ent} END AS entropy FROM i)""",
    ),
}
