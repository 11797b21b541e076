"""Queries on bootstrap paths."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.columns import round_doubles
from ..operators import regimes as rg
from ..operators import resample as rs, tails
from ..session import stage
from .regimes import STATES, labelled, matrix_sql
from .sqlparts import BARS, LOGS, query, rounded

KEYS = ["series_id"]
PATHS, DAYS = 5000, 21
HORIZONS = [21, 63, 126, 252]


def pools(spark, sf):
    return rs.return_pools(labelled(spark, sf), KEYS, "ret", "regime_state")


def _boot(spark, sf, **options):
    return rs.bootstrap_paths(pools(spark, sf), KEYS, PATHS, options.pop("horizons", [DAYS]), **options)


def q_boot(spark, sf):
    return round_doubles(_boot(spark, sf))


def q_boot_state(spark, sf):
    return round_doubles(_boot(spark, sf, pool=2))


def q_boot_covid(spark, sf):
    return round_doubles(_boot(spark, sf, scenario="covid", multiplier=1.2))


def q_stressed_matrix(spark, sf):
    df = labelled(spark, sf)
    p = rs.return_pools(df, KEYS, "ret", "regime_state")
    # one state made costly, so that a bearish state exists at every scale
    p = p.withColumn("r", F.when(F.col("pool") == 0, F.col("r") - 1.0).otherwise(F.col("r")))
    return round_doubles(rs.stressed_matrix(stage(rg.transition_matrix(df, KEYS, 3)), p, KEYS))


def q_horizons(spark, sf):
    return round_doubles(rs.path_stats(stage(_boot(spark, sf, horizons=HORIZONS)), KEYS))


def q_fan(spark, sf):
    return round_doubles(rs.fan(stage(_boot(spark, sf)), KEYS))


def q_histogram(spark, sf):
    ends = stage(rs.path_summaries(_boot(spark, sf), KEYS))
    return round_doubles(rs.terminal_histogram(ends, KEYS))


def q_student(spark, sf):
    return tails.student_t_fit(pools(spark, sf), KEYS)


def q_student_conditions(spark, sf):
    """What must vanish at a maximum of the likelihood: the weighted gaps, and the weighted squares less one."""
    p = pools(spark, sf)
    rows = p.join(tails.student_t_fit(p, KEYS).select(*KEYS, "pool", "nu", "loc", "scale"), [*KEYS, "pool"])
    z = (F.col("r") - F.col("loc")) / F.col("scale")
    w = F.when(F.col("nu") == float("inf"), 1.0).otherwise((F.col("nu") + 1.0) / (F.col("nu") + z * z))
    return round_doubles(rows.groupBy(*KEYS, "pool").agg(F.count(F.lit(1)).alias("n"), F.avg(w * z).alias("gap"), (F.avg(w * z * z) - 1.0).alias("spread")), 5)


QUERIES = {
    "bootstrap_paths": q_boot,
    "bootstrap_paths_one_state": q_boot_state,
    "bootstrap_paths_covid": q_boot_covid,
    "stressed_transitions": q_stressed_matrix,
    "path_stats_by_horizon": q_horizons,
    "path_fan": q_fan,
    "terminal_histogram": q_histogram,
    "student_t_fits": q_student,
    "student_t_conditions": q_student_conditions,
}


def _u(*parts: str) -> str:
    text = ", ".join(parts)
    return f"(('0x' || substr(md5(concat_ws('|', {text})), 1, 13))::BIGINT / 4503599627370496.0::DOUBLE)"


_POOLS = """pl AS MATERIALIZED (SELECT series_id, -1 AS pool, row_number() OVER (PARTITION BY series_id ORDER BY date) - 1 AS idx, ret AS r FROM lab
UNION ALL SELECT series_id, regime_state, row_number() OVER (PARTITION BY series_id, regime_state ORDER BY date) - 1, ret FROM lab WHERE regime_state >= 0),
pn AS MATERIALIZED (SELECT series_id, pool, count(*) AS n FROM pl GROUP BY 1, 2)"""
_BASE = [BARS, LOGS, STATES, _POOLS]


def _draws(pool: int, horizons: list[int], change: str = "r") -> list[str]:
    hs = ", ".join(f"({h})" for h in horizons)
    return [
        f"""stp AS MATERIALIZED (SELECT series_id, n, h.horizon, p.path, s.step FROM pn, (VALUES {hs}) h(horizon), range({PATHS}) p(path),
          range(1, {max(horizons) + 1}) s(step) WHERE pool = {pool} AND s.step <= h.horizon)""",
        f"""ix AS MATERIALIZED (SELECT *, CAST(floor({_u("'42'", "'draw'", "series_id", "horizon", "path", "step")} * n) AS BIGINT) AS idx FROM stp)""",
        f"dr0 AS MATERIALIZED (SELECT ix.series_id, horizon, path, step, r FROM ix JOIN pl ON pl.series_id = ix.series_id AND pl.pool = {pool} AND pl.idx = ix.idx)",
        f"dr AS MATERIALIZED (SELECT series_id, horizon, path, step, greatest({change}, -0.999) AS r FROM dr0 JOIN (SELECT series_id, horizon, avg(r) AS m FROM dr0 GROUP BY 1, 2) USING (series_id, horizon))",
    ]


_PATHS = """pt AS (SELECT series_id, horizon, path, step, product(1.0 + r) OVER (PARTITION BY series_id, horizon, path ORDER BY step) AS value FROM dr
UNION ALL SELECT series_id, horizon, path, 0, 1.0 FROM dr WHERE step = 1)"""
_OUT = ("SELECT series_id, CAST(horizon AS INTEGER) AS horizon, CAST(path AS BIGINT) AS path, CAST(step AS INTEGER) AS step, "
        "round(value, 6) + 0.0 AS value FROM pt")
_ENDS = """tp AS (SELECT *, max(value) OVER (PARTITION BY series_id, horizon, path ORDER BY step) AS top FROM pt),
en AS (SELECT series_id, horizon, path, arg_max(value, step) - 1.0 AS r, min((value - top) / (top + 1e-15)) AS dd FROM tp GROUP BY 1, 2, 3)"""


def _stressed(pool_return: str) -> str:
    return f"""mn AS (SELECT series_id, pool, avg({pool_return}) AS m FROM pl GROUP BY 1, 2),
bc AS (SELECT tm.*, coalesce(a.m, b.m) < 0 AS bear FROM tm LEFT JOIN mn a ON a.series_id = tm.series_id AND a.pool = tm.to_state
  JOIN mn b ON b.series_id = tm.series_id AND b.pool = -1),
bs AS (SELECT *, sum(CASE WHEN bear THEN p ELSE 0.0 END) OVER w AS onn, sum(CASE WHEN bear THEN 0.0 ELSE p * 0.2::DOUBLE END) OVER w AS off,
  sum(CASE WHEN bear THEN 1 ELSE 0 END) OVER w AS k FROM bc WINDOW w AS (PARTITION BY series_id, from_state)),
sm AS (SELECT series_id, from_state, to_state, CASE WHEN k > 0 AND onn < 0.8 THEN CASE WHEN bear THEN (1.0 - off) / k ELSE p * 0.2::DOUBLE END ELSE p END AS p FROM bs)"""


_TM = matrix_sql("st", "series_id", "regime_state", "date", 3)
ORACLES = {
    "bootstrap_paths": query(*_BASE, *_draws(-1, [DAYS]), _PATHS, _OUT),
    "bootstrap_paths_one_state": query(*_BASE, *_draws(2, [DAYS]), _PATHS, _OUT),
    "bootstrap_paths_covid": query(*_BASE, *_draws(-1, [DAYS], "(r - m) * (2.5::DOUBLE * 1.2::DOUBLE) + m"), _PATHS, _OUT),
    "student_t_conditions": query(*_BASE, "SELECT series_id, pool, n, 0.0::DOUBLE AS gap, 0.0::DOUBLE AS spread FROM pn"),
    "stressed_transitions": query(*_BASE, _TM, _stressed("CASE WHEN pool = 0 THEN r - 1.0 ELSE r END"),
                                  "SELECT series_id, from_state, to_state, round(p, 6) + 0.0 AS p FROM sm"),
    "path_stats_by_horizon": query(
        *_BASE, *_draws(-1, HORIZONS), _PATHS, _ENDS,
        "rk AS (SELECT *, row_number() OVER (PARTITION BY series_id, horizon ORDER BY r) - 1 AS k FROM en)",
        f"""ag AS (SELECT series_id, CAST(horizon AS INTEGER) AS horizon, count(*) AS paths_simulated, avg(r) AS expected_return,
          avg(CASE WHEN r < 0 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) AS probability_of_loss,
          avg(CASE WHEN dd < -0.10 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) AS probability_of_drawdown_10pct,
          avg(CASE WHEN dd < -0.20 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) AS probability_of_drawdown_20pct,
          avg(CASE WHEN dd < -0.15 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) AS probability_of_drawdown_custom,
          avg(dd) AS average_simulated_max_drawdown, quantile_cont(r, 0.5) AS median_return, quantile_cont(r, 0.95) AS best_5pct_return,
          -abs(max(r) FILTER (k = {int(PATHS * 0.05)})) AS worst_5pct_return, abs(max(r) FILTER (k = {int(PATHS * 0.05)})) AS "Daily_VaR_95",
          abs(avg(r) FILTER (k <= {int(PATHS * 0.05)})) AS "Daily_CVaR_95", abs(max(r) FILTER (k = {int(PATHS * 0.01)})) AS "Daily_VaR_99",
          abs(avg(r) FILTER (k <= {int(PATHS * 0.01)})) AS "Daily_CVaR_99" FROM rk GROUP BY 1, 2)""",
        "SELECT series_id, horizon, paths_simulated, " + rounded([
            "expected_return", "probability_of_loss", "probability_of_drawdown_10pct", "probability_of_drawdown_20pct",
            "probability_of_drawdown_custom", "average_simulated_max_drawdown", "median_return", "best_5pct_return",
            "worst_5pct_return", "Daily_VaR_95", "Daily_CVaR_95", "Daily_VaR_99", "Daily_CVaR_99"]) + " FROM ag"),
    "path_fan": query(
        *_BASE, *_draws(-1, [DAYS]), _PATHS,
        "SELECT series_id, CAST(horizon AS INTEGER) AS horizon, CAST(step AS INTEGER) AS step, "
        + ", ".join(f"round(quantile_cont(value, {p / 100}), 6) + 0.0 AS fan_{p}" for p in (5, 25, 50, 75, 95))
        + " FROM pt GROUP BY 1, 2, 3"),
    "terminal_histogram": query(
        *_BASE, *_draws(-1, [DAYS]), _PATHS, _ENDS,
        "e AS (SELECT series_id, horizon, min(r) AS lo, max(r) AS hi FROM en GROUP BY 1, 2)",
        """b AS (SELECT series_id, CAST(horizon AS INTEGER) AS horizon, CAST(least(floor((r - lo) / (hi - lo) * 50), 49) AS BIGINT) AS bin, lo, hi
          FROM en JOIN e USING (series_id, horizon))""",
        "SELECT series_id, horizon, bin, count(*) AS paths, round(lo + (hi - lo) * bin / 50, 6) + 0.0 AS bin_start FROM b GROUP BY series_id, horizon, bin, lo, hi"),
}
