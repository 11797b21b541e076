"""Queries on discrete states: of bars (momentum rule) and of user events."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.columns import change, full, if_zero, round_doubles
from ..operators import regimes as rg
from ..operators.layout import POS, block_window, by_position, drop_halo, index_rows, plain
from ..session import stage
from ..sources.tables import daily_bars, table
from .sqlparts import BARS, LOGS, YEAR, frame, query, rounded, whole

KEYS = ["series_id"]
LABEL_OF = {-1: "Warmup / Undefined", 0: "Bearish High Volatility", 1: "Sideways Low Volatility", 2: "Bullish Low Volatility"}
EVENT_TYPES = ["click", "error", "purchase", "signup", "view"]


def bar_states(spark, sf):
    """Bars with two rule-made state columns: 3 states by the 21-day return with a
    warm-up of 63 rows, and 4 states by 5-day return and volatility ratio."""
    rows, w, c = by_position(daily_bars(spark, sf), KEYS), block_window(KEYS), F.col("close")
    rows = rows.withColumn("_lr", F.log(c / F.lag("close").over(w)))
    sd = lambda n: full(n, F.col("_lr"), F.stddev_samp, w)
    rows = rows.withColumns({"ret": if_zero(change(c, 1, w)), "_m": change(c, 21, w), "_q": change(c, 5, w), "_v": sd(5) / sd(21)})
    early = F.col(POS) < 63
    s3 = F.when(early, -1).when(F.col("_m") < -0.1, 0).when(F.col("_m") > 0.1, 2).otherwise(1)
    s4 = F.when(early, -1).otherwise(F.when(F.col("_q") >= 0, 2).otherwise(0) + F.when(F.col("_v") >= 1, 1).otherwise(0))
    rows = rows.withColumns({"regime_state": s3, "state4": s4})
    return drop_halo(rows).drop("_lr", "_m", "_q", "_v")


def labelled(spark, sf):
    """Three-state rows with a fixed label per state."""
    pairs = [x for k, v in LABEL_OF.items() for x in (F.lit(k), F.lit(v))]
    return stage(bar_states(spark, sf).withColumn("regime_label", F.create_map(*pairs)[F.col("regime_state")]))


def event_states(spark, sf):
    """User events in order, the event type as state 0..4.

    Order chunks are hours, so a user with a large share of all events is
    spread over as many sorts as hours.
    """
    ids = F.array_position(F.array(*[F.lit(t) for t in EVENT_TYPES]), F.col("event_type")).cast("int") - 1
    ev = table(spark, sf, "events").select("user_id", "ts", "event_id", "event_type", ids.alias("state"))
    hour = F.unix_date(F.to_date("ts")) * 24 + F.hour("ts")
    return stage(index_rows(ev, ["user_id"], ["ts", "event_id"], hour))


def q_summary(spark, sf):
    return round_doubles(rg.regime_summary(stage(bar_states(spark, sf)), KEYS, 3))


def q_summary4(spark, sf):
    return round_doubles(rg.regime_summary(stage(bar_states(spark, sf)), KEYS, 4, "state4"))


def q_risk(spark, sf):
    return round_doubles(rg.regime_risk(labelled(spark, sf), KEYS, 3))


def q_appetite(spark, sf):
    return round_doubles(rg.risk_appetite(labelled(spark, sf), KEYS, 3))


def q_matrix(spark, sf):
    return round_doubles(rg.transition_matrix(stage(bar_states(spark, sf)), KEYS, 3))


def q_event_matrix(spark, sf):
    return round_doubles(rg.transition_matrix(event_states(spark, sf), ["user_id"], 5, "state", absorbing=False, date="ts"))


def q_event_matrix_wide(spark, sf):
    m = rg.transition_matrix(event_states(spark, sf), ["user_id"], 5, "state", date="ts")
    return round_doubles(rg.wide_matrix(m, ["user_id"], 5))


def q_event_runs(spark, sf):
    return round_doubles(rg.run_lengths(event_states(spark, sf), ["user_id"], "state", "ts"))


def q_event_blocks(spark, sf):
    out = rg.regime_blocks(event_states(spark, sf), ["user_id"], "event_type", "ts")
    text = lambda c: F.date_format(c, "yyyy-MM-dd HH:mm:ss").alias(c)
    return out.select("user_id", "block", "event_type", text("start_date"), text("end_date"), "duration")


def q_blocks(spark, sf):
    return rg.regime_blocks(labelled(spark, sf), KEYS, "regime_label")


def q_mean_run(spark, sf):
    return round_doubles(rg.mean_run_length(stage(bar_states(spark, sf)), KEYS))


def q_stability(spark, sf):
    ev = event_states(spark, sf)
    return round_doubles(rg.stability(ev, rg.transition_matrix(ev, ["user_id"], 5, "state", date="ts"), ["user_id"], "state"))


def q_current(spark, sf):
    df = labelled(spark, sf)
    out = rg.current_state(df, KEYS, ["regime_state", "regime_label"])
    return out.withColumns({"weight": rg.label_weight(F.col("regime_label")), "risk_score": rg.label_risk_score(F.col("regime_label"))})


def q_profile(spark, sf):
    df = stage(bar_states(spark, sf))
    out = rg.state_profile(df, KEYS, "state4", "ret", "close", "volume")
    return round_doubles(rg.assign_rank_labels(out, KEYS, "state4"))


def q_rand(spark, sf):
    df = bar_states(spark, sf).filter("regime_state >= 0")
    return round_doubles(rg.adjusted_rand(stage(df), KEYS, "regime_state", "state4"))


QUERIES = {
    "regime_summary": q_summary,
    "regime_summary_four_states": q_summary4,
    "regime_risk": q_risk,
    "risk_appetite": q_appetite,
    "transition_matrix": q_matrix,
    "event_transitions": q_event_matrix,
    "event_transitions_wide": q_event_matrix_wide,
    "event_run_lengths": q_event_runs,
    "event_blocks": q_event_blocks,
    "regime_blocks": q_blocks,
    "mean_run_length": q_mean_run,
    "state_stability": q_stability,
    "current_regime": q_current,
    "state_profile_labels": q_profile,
    "adjusted_rand": q_rand,
}

STATES = f"""st0 AS (SELECT series_id, date, close, volume, pos, coalesce(close / prev - 1.0, 0.0) AS ret,
  close / lag(close, 21) OVER w - 1.0 AS m, close / lag(close, 5) OVER w - 1.0 AS q,
  ({whole(5, 'stddev_samp', 'ret_log')}) / ({whole(21, 'stddev_samp', 'ret_log')}) AS v
  FROM logs WINDOW w AS (PARTITION BY series_id ORDER BY date)),
st AS (SELECT series_id, date, close, volume, pos, ret,
  CASE WHEN pos < 63 THEN -1 WHEN m < -0.1 THEN 0 WHEN m > 0.1 THEN 2 ELSE 1 END AS regime_state,
  CASE WHEN pos < 63 THEN -1 ELSE (CASE WHEN q >= 0 THEN 2 ELSE 0 END) + (CASE WHEN v >= 1 THEN 1 ELSE 0 END) END AS state4
  FROM st0),
lab AS (SELECT *, CASE regime_state WHEN -1 THEN 'Warmup / Undefined' WHEN 0 THEN 'Bearish High Volatility'
  WHEN 1 THEN 'Sideways Low Volatility' ELSE 'Bullish Low Volatility' END AS regime_label FROM st)"""
EVENTS = """ev AS (SELECT user_id, ts, event_id, event_type,
  CAST(list_position(['click', 'error', 'purchase', 'signup', 'view'], event_type) - 1 AS INTEGER) AS state,
  row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS rn FROM events)"""


def matrix_sql(source: str, key: str, state: str, order: str, k: int, absorbing: bool = True, tag: str = "") -> str:
    rest = "CASE WHEN g.f = g.t THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END" if absorbing else "0.0::DOUBLE"
    return f"""pr{tag} AS (SELECT {key}, lag({state}) OVER (PARTITION BY {key} ORDER BY {order}) AS f, {state} AS t FROM {source}),
ct{tag} AS (SELECT {key}, f, t, count(*) AS n FROM pr{tag} WHERE f >= 0 AND t >= 0 GROUP BY ALL),
gr{tag} AS (SELECT {key}, a.i AS f, b.i AS t FROM (SELECT DISTINCT {key} FROM {source}), range({k}) a(i), range({k}) b(i)),
tm{tag} AS (SELECT g.{key}, CAST(g.f AS INTEGER) AS from_state, CAST(g.t AS INTEGER) AS to_state,
  CASE WHEN sum(n) OVER (PARTITION BY g.{key}, g.f) > 0
    THEN coalesce(n, 0) / CAST(sum(n) OVER (PARTITION BY g.{key}, g.f) AS DOUBLE) ELSE {rest} END AS p
  FROM gr{tag} g LEFT JOIN ct{tag} c ON g.{key} = c.{key} AND g.f = c.f AND g.t = c.t)"""


def summary_sql(state: str, k: int, label: str) -> list[str]:
    w = f"(PARTITION BY series_id, {state} ORDER BY date)"
    return [
        f"cm AS (SELECT *, product(1.0 + ret) OVER {w} AS cum FROM st WHERE {state} >= 0)",
        f"pk AS (SELECT *, max(cum) OVER {w} AS peak FROM cm)",
        f"""ag AS (SELECT series_id, {state}, count(*) AS daily_count, avg(ret) AS average_daily_return,
          avg(ret) * 252.0 AS annualized_return, stddev_samp(ret) * {YEAR} AS annualized_volatility,
          avg(ret) * 252.0 / (stddev_samp(ret) * {YEAR}) AS sharpe_ratio,
          avg(ret) * 252.0 / (stddev_samp(least(ret, 0.0)) * {YEAR}) AS sortino_ratio,
          min((cum - peak) / (peak + 1e-10)) AS max_drawdown, avg(CASE WHEN ret > 0 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) AS win_rate,
          min(ret) AS worst_day_return, max(ret) AS best_day_return,
          skewness(ret) * (count(*) - 2) / sqrt(CAST(count(*) AS DOUBLE) * (count(*) - 1)) AS skewness,
          kurtosis_pop(ret) AS kurtosis FROM pk GROUP BY 1, 2)""",
        f"tot AS (SELECT series_id, count(*) AS total FROM st GROUP BY 1)",
        f"""chg AS (SELECT series_id, {state}, CASE WHEN lag({state}) OVER (PARTITION BY series_id ORDER BY date) = {state} THEN 0 ELSE 1 END AS c
          FROM st WHERE {state} >= 0)""",
        f"rn AS (SELECT series_id, {state}, count(*) / CAST(sum(c) AS DOUBLE) AS average_duration_days FROM chg GROUP BY 1, 2)",
        matrix_sql("st", "series_id", state, "date", k),
        f"""sm AS (SELECT ag.*, daily_count / CAST(total AS DOUBLE) AS percentage_days, average_duration_days, p AS prob_staying
          FROM ag JOIN tot USING (series_id) JOIN rn USING (series_id, {state})
          JOIN tm ON tm.series_id = ag.series_id AND tm.from_state = ag.{state} AND tm.to_state = ag.{state})""",
        label,
    ]


_SUMMARY = ["average_daily_return", "annualized_return", "annualized_volatility", "sharpe_ratio", "sortino_ratio",
            "max_drawdown", "win_rate", "worst_day_return", "best_day_return", "skewness", "kurtosis",
            "percentage_days", "average_duration_days", "prob_staying"]
LABEL3 = """lb AS (SELECT *, CASE
    WHEN k = 2 THEN CASE WHEN r = 1 THEN CASE WHEN annualized_return < 0 THEN 'Bearish High Volatility' ELSE 'Sideways Low Volatility' END
      ELSE 'Bullish Low Volatility' END
    WHEN r = 1 THEN CASE WHEN annualized_return < -0.05 THEN 'Bearish High Volatility' ELSE 'Distribution / Risk-Off Regime' END
    WHEN r = 2 THEN CASE WHEN abs(annualized_return) < 0.05 THEN 'Sideways Low Volatility' ELSE 'Recovery Regime' END
    WHEN v = 3 THEN 'Bullish High Volatility' ELSE 'Bullish Low Volatility' END AS regime_label
  FROM (SELECT *, count(*) OVER (PARTITION BY series_id) AS k,
    row_number() OVER (PARTITION BY series_id ORDER BY annualized_return, regime_state) AS r,
    row_number() OVER (PARTITION BY series_id ORDER BY annualized_volatility, regime_state) AS v FROM sm))"""
_LABEL4 = """l1 AS (SELECT *, CASE WHEN row_number() OVER (PARTITION BY series_id ORDER BY annualized_return, state4) = 1 THEN 'Bearish High Volatility' END AS a FROM sm),
l2 AS (SELECT * REPLACE (coalesce(a, CASE WHEN row_number() OVER (PARTITION BY series_id ORDER BY a IS NOT NULL, sharpe_ratio DESC, state4) = 1 THEN 'Bullish Low Volatility' END) AS a) FROM l1),
l3 AS (SELECT * REPLACE (coalesce(a, CASE WHEN row_number() OVER (PARTITION BY series_id ORDER BY a IS NOT NULL, annualized_return DESC, state4 DESC) = 1 THEN 'Bullish High Volatility' END) AS a) FROM l2),
l4 AS (SELECT * REPLACE (coalesce(a, CASE WHEN row_number() OVER (PARTITION BY series_id ORDER BY a IS NOT NULL, annualized_volatility, state4) = 1 THEN 'Sideways Low Volatility' END) AS a) FROM l3),
lb AS (SELECT *, coalesce(a, CASE WHEN annualized_return > 0 THEN 'Recovery Regime' ELSE 'Distribution / Risk-Off Regime' END) AS regime_label FROM l4)"""
_COMB = "n * (n - 1.0::DOUBLE) / 2.0"

ORACLES = {
    "regime_summary": query(BARS, LOGS, STATES, *summary_sql("regime_state", 3, LABEL3),
                            f"SELECT series_id, regime_state, daily_count, regime_label, {rounded(_SUMMARY)} FROM lb"),
    "regime_summary_four_states": query(BARS, LOGS, STATES, *summary_sql("state4", 4, _LABEL4),
                                        f"SELECT series_id, state4, daily_count, regime_label, {rounded(_SUMMARY)} FROM lb"),
    "regime_risk": query(
        BARS, LOGS, STATES, matrix_sql("st", "series_id", "regime_state", "date", 3),
        "cm AS (SELECT *, product(1.0 + ret) OVER (PARTITION BY series_id, regime_state ORDER BY date) AS cum FROM lab WHERE regime_state >= 0)",
        """pk AS (SELECT *, max(cum) OVER (PARTITION BY series_id, regime_state ORDER BY date) AS peak,
          row_number() OVER (PARTITION BY series_id, regime_state ORDER BY ret) - 1 AS rk,
          CAST(floor((1.0::DOUBLE - 0.95::DOUBLE) * count(*) OVER (PARTITION BY series_id, regime_state)) AS BIGINT) AS ix FROM cm)""",
        f"""ag AS (SELECT series_id, regime_state, any_value(regime_label) AS regime_label, count(*) AS total_days,
          avg(ret) AS average_daily_return, quantile_cont(ret, 0.5) AS median_daily_return,
          stddev_samp(ret) * {YEAR} AS annualized_volatility,
          sqrt(avg(least(ret, 0.0) * least(ret, 0.0))) * {YEAR} AS annualized_downside_volatility,
          abs(max(ret) FILTER (rk = ix)) AS daily_var_95, abs(avg(ret) FILTER (rk <= ix)) AS daily_cvar_95,
          min((cum - peak) / (peak + 1e-15)) AS max_drawdown,
          avg(CASE WHEN ret > 0 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) AS probability_positive_day,
          avg(CASE WHEN ret < -0.015 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) AS probability_crash_day FROM pk GROUP BY 1, 2)""",
        """tr AS (SELECT tm.series_id, tm.from_state, sum(p) AS transition_risk_to_bearish FROM tm JOIN ag ON tm.series_id = ag.series_id
          AND tm.to_state = ag.regime_state WHERE regime_label LIKE '%Bearish%' OR regime_label LIKE '%Distribution%' OR regime_label LIKE '%Risk-Off%' GROUP BY 1, 2)""",
        "fin AS (SELECT ag.*, coalesce(transition_risk_to_bearish, 0.0) AS transition_risk_to_bearish FROM ag LEFT JOIN tr ON tr.series_id = ag.series_id AND tr.from_state = ag.regime_state)",
        "SELECT series_id, regime_state, regime_label, total_days, " + rounded([
            "average_daily_return", "median_daily_return", "annualized_volatility", "annualized_downside_volatility",
            "daily_var_95", "daily_cvar_95", "max_drawdown", "probability_positive_day", "probability_crash_day",
            "transition_risk_to_bearish"]) + " FROM fin",
    ),
    "risk_appetite": query(
        BARS, LOGS, STATES, matrix_sql("st", "series_id", "regime_state", "date", 3),
        "cur AS (SELECT series_id, arg_max(regime_state, date) AS s FROM st GROUP BY 1)",
        """sp AS (SELECT tm.series_id, s AS regime_state, coalesce(sum(p) FILTER (to_state = 2), 0.0) AS a,
          coalesce(sum(p) FILTER (to_state <> 2), 0.0) AS b FROM tm JOIN cur ON tm.series_id = cur.series_id AND from_state = s GROUP BY 1, 2)""",
        "SELECT series_id, regime_state, round(a / (a + b), 6) + 0.0 AS risk_on_probability, round(b / (a + b), 6) + 0.0 AS risk_off_probability FROM sp",
    ),
    "transition_matrix": query(BARS, LOGS, STATES, matrix_sql("st", "series_id", "regime_state", "date", 3),
                               "SELECT series_id, from_state, to_state, round(p, 6) + 0.0 AS p FROM tm"),
    "event_transitions": query(EVENTS, matrix_sql("ev", "user_id", "state", "rn", 5, absorbing=False),
                               "SELECT user_id, from_state, to_state, round(p, 6) + 0.0 AS p FROM tm"),
    "event_transitions_wide": query(
        EVENTS, matrix_sql("ev", "user_id", "state", "rn", 5),
        "SELECT user_id, from_state, " + ", ".join(f"round(max(p) FILTER (to_state = {j}), 6) + 0.0 AS to_{j}" for j in range(5))
        + " FROM tm GROUP BY 1, 2"),
    "event_run_lengths": query(
        EVENTS, "c AS (SELECT *, CASE WHEN lag(state) OVER (PARTITION BY user_id ORDER BY rn) = state THEN 0 ELSE 1 END AS ch FROM ev)",
        "SELECT user_id, state, count(*) AS n_rows, CAST(sum(ch) AS BIGINT) AS n_runs, "
        "round(count(*) / CAST(sum(ch) AS DOUBLE), 6) + 0.0 AS average_duration_days FROM c GROUP BY 1, 2"),
    "event_blocks": query(
        EVENTS, "c AS (SELECT *, CASE WHEN lag(state) OVER (PARTITION BY user_id ORDER BY rn) = state THEN 0 ELSE 1 END AS ch FROM ev)",
        "b AS (SELECT *, CAST(sum(ch) OVER (PARTITION BY user_id ORDER BY rn) AS BIGINT) AS block FROM c)",
        "SELECT user_id, block, any_value(event_type) AS event_type, strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS start_date, "
        "strftime(max(ts), '%Y-%m-%d %H:%M:%S') AS end_date, count(*) AS duration FROM b GROUP BY 1, 2"),
    "regime_blocks": query(
        BARS, LOGS, STATES,
        "c AS (SELECT *, CASE WHEN lag(regime_label) OVER (PARTITION BY series_id ORDER BY date) = regime_label THEN 0 ELSE 1 END AS ch FROM lab)",
        "b AS (SELECT *, CAST(sum(ch) OVER (PARTITION BY series_id ORDER BY date) AS BIGINT) AS block FROM c)",
        "SELECT series_id, block, any_value(regime_label) AS regime_label, min(date) AS start_date, max(date) AS end_date, "
        "count(*) AS duration FROM b GROUP BY 1, 2"),
    "mean_run_length": query(
        BARS, LOGS, STATES,
        "c AS (SELECT *, CASE WHEN lag(regime_state) OVER (PARTITION BY series_id ORDER BY date) = regime_state THEN 0 ELSE 1 END AS ch FROM st WHERE regime_state >= 0)",
        "SELECT series_id, round(count(*) / CAST(sum(ch) AS DOUBLE), 6) + 0.0 AS avg_duration FROM c GROUP BY 1"),
    "state_stability": query(
        EVENTS, matrix_sql("ev", "user_id", "state", "rn", 5),
        "oc AS (SELECT user_id, state, count(*) AS n, count(*) / CAST(sum(count(*)) OVER (PARTITION BY user_id) AS DOUBLE) AS occupancy FROM ev GROUP BY 1, 2)",
        "pe AS (SELECT user_id, from_state, max(p) FILTER (from_state = to_state) AS persistence, abs(sum(p) - 1.0) <= 1e-5 AS matrix_sane FROM tm GROUP BY 1, 2)",
        "SELECT oc.user_id, state, n, round(occupancy, 6) + 0.0 AS occupancy, occupancy < 0.05 OR n < 30 AS under_occupied, "
        "round(persistence, 6) + 0.0 AS persistence, matrix_sane FROM oc LEFT JOIN pe ON pe.user_id = oc.user_id AND from_state = state"),
    "current_regime": query(
        BARS, LOGS, STATES,
        "c AS (SELECT series_id, max(date) AS date, arg_max(regime_state, date) AS regime_state, arg_max(regime_label, date) AS regime_label FROM lab GROUP BY 1)",
        "SELECT *, CASE regime_state WHEN 2 THEN 1.0::DOUBLE WHEN 1 THEN 0.5::DOUBLE ELSE 0.0::DOUBLE END AS weight, "
        "CASE regime_state WHEN 2 THEN 15 WHEN 1 THEN 45 WHEN 0 THEN 95 ELSE 50 END AS risk_score FROM c"),
    "state_profile_labels": query(
        BARS, LOGS, STATES,
        "t AS (SELECT *, max(close) OVER (PARTITION BY series_id, state4 ORDER BY date) AS top FROM st)",
        f"""p AS (SELECT series_id, state4, avg(ret) * 252.0 AS ann_ret, stddev_samp(ret) * {YEAR} AS ann_vol, skewness(ret) AS skew,
          min((close - top) / (top + 1e-10)) AS max_dd, avg(volume) AS mean_vix, count(*) AS n_rows FROM t GROUP BY 1, 2)""",
        "r AS (SELECT *, row_number() OVER (PARTITION BY series_id ORDER BY ann_ret / (ann_vol + 1e-10) DESC, state4) AS rk FROM p)",
        f"SELECT series_id, state4, n_rows, {rounded(['ann_ret', 'ann_vol', 'skew', 'max_dd', 'mean_vix'])}, "
        "['Bullish Low Volatility', 'Bullish High Volatility', 'Recovery Regime', 'Sideways / Range-Bound', 'Bearish High Volatility'][rk] AS regime_label FROM r"),
    "adjusted_rand": query(
        BARS, LOGS, STATES,
        "c AS (SELECT series_id, regime_state AS a, state4 AS b, CAST(count(*) AS DOUBLE) AS n FROM st WHERE regime_state >= 0 GROUP BY ALL)",
        f"x AS (SELECT series_id, sum({_COMB}) AS ab, sum(n) AS n FROM c GROUP BY 1)",
        f"l AS (SELECT series_id, sum({_COMB}) AS sa FROM (SELECT series_id, a, sum(n) AS n FROM c GROUP BY 1, 2) GROUP BY 1)",
        f"r AS (SELECT series_id, sum({_COMB}) AS sb FROM (SELECT series_id, b, sum(n) AS n FROM c GROUP BY 1, 2) GROUP BY 1)",
        f"SELECT series_id, round((ab - sa * sb / ({_COMB})) / ((sa + sb) / 2.0 - sa * sb / ({_COMB})), 6) + 0.0 AS ari "
        "FROM x JOIN l USING (series_id) JOIN r USING (series_id)"),
}
