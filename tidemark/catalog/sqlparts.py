"""Building blocks of the oracle SQL (DuckDB dialect)."""

from __future__ import annotations

YEAR = "sqrt(252.0::DOUBLE)"

BARS = """bars AS (
  SELECT l_returnflag AS series_id, CAST(l_shipdate AS DATE) AS date,
         arg_min(l_extendedprice, row(l_orderkey, l_linenumber, l_extendedprice)) AS open,
         max(l_extendedprice) AS high, min(l_extendedprice) AS low,
         CAST(sum(CAST(round(l_extendedprice * 100) AS BIGINT)) AS DOUBLE) / (count(*) * 100.0::DOUBLE) AS close,
         CAST(sum(l_quantity) AS DOUBLE) AS volume
  FROM lineitem GROUP BY 1, 2)"""

COVARIATE = """cov AS (
  SELECT CAST(o_orderdate AS DATE) AS date,
         CAST(sum(CAST(round(o_totalprice * 100) AS BIGINT)) AS DOUBLE) / (count(*) * 100.0::DOUBLE) AS vix_close
  FROM orders GROUP BY 1)"""

# simple returns with a first value of 0
RETURNS = """rets AS (
  SELECT series_id, date, close,
         coalesce(close / lag(close) OVER (PARTITION BY series_id ORDER BY date) - 1.0, 0.0) AS ret
  FROM bars)"""

LOGS = """logs AS (
  SELECT *, ln(close / lag(close) OVER w) AS ret_log, lag(close) OVER w AS prev,
         row_number() OVER w - 1 AS pos
  FROM bars WINDOW w AS (PARTITION BY series_id ORDER BY date))"""


def rnd(expr: str, digits: int = 6) -> str:
    return f"round({expr}, {digits}) + 0.0"


def rounded(columns: list[str] | dict[str, int], digits: int = 6) -> str:
    """Select list that rounds the given double columns."""
    if not isinstance(columns, dict):
        columns = {c: digits for c in columns}
    return ", ".join(f'round("{c}", {d}) + 0.0 AS "{c}"' for c, d in columns.items())


def frame(n: int | None, keys: str = "series_id", order: str = "date") -> str:
    """Window of the last n rows, or of all rows so far."""
    start = "UNBOUNDED PRECEDING" if n is None else f"{n - 1} PRECEDING"
    return f"OVER (PARTITION BY {keys} ORDER BY {order} ROWS BETWEEN {start} AND CURRENT ROW)"


def whole(n: int, agg: str, expr: str, keys: str = "series_id", order: str = "date") -> str:
    """Aggregate over n rows, NULL unless n values are present."""
    f = frame(n, keys, order)
    return f"CASE WHEN count({expr}) {f} = {n} THEN {agg}({expr}) {f} END"


def ewm(expr: str, alpha: str) -> str:
    """Recursive weighted mean; leading NULLs are skipped."""
    f = frame(None)
    return (
        f"list_reduce(list({expr}) FILTER (({expr}) IS NOT NULL) {f}, "
        f"lambda a, b: a * (1.0::DOUBLE - {alpha}) + b * {alpha})"
    )


def span(n: int) -> str:
    return f"(2.0::DOUBLE / {n + 1})"


def query(*ctes_and_select: str) -> str:
    *ctes, select = ctes_and_select
    return ("WITH " + ",\n".join(ctes) + "\n" if ctes else "") + select


# --- risk report over (keys, date, ret) -------------------------------------

def risk_ctes(source: str, keys: list[str], tag: str = "") -> list[str]:
    """CTEs that end in ``risk<tag>``: one row per key with all metrics."""
    k = ", ".join(keys)
    on = " AND ".join(f"a.{c} = b.{c}" for c in keys)
    using = f"USING ({k})"
    w = f"(PARTITION BY {k} ORDER BY date)"
    return [
        f"""wl{tag} AS (SELECT *, product(1.0 + ret) OVER {w} AS cum FROM {source})""",
        f"""pk{tag} AS (SELECT *, max(cum) OVER {w} AS peak FROM wl{tag})""",
        f"""dd{tag} AS (SELECT *, (cum - peak) / (peak + 1e-15) AS dd,
              row_number() OVER (PARTITION BY {k} ORDER BY ret) - 1 AS rk,
              count(*) OVER (PARTITION BY {k}) AS cnt FROM pk{tag})""",
        f"""isl{tag} AS (SELECT *, sum(CASE WHEN dd >= 0 THEN 1 ELSE 0 END) OVER {w} AS island FROM dd{tag})""",
        f"""dur{tag} AS (SELECT {k}, max(n) AS duration FROM (
              SELECT {k}, island, sum(CASE WHEN dd < 0 THEN 1 ELSE 0 END) AS n
              FROM isl{tag} GROUP BY {k}, island) GROUP BY {k})""",
        f"""wm{tag} AS (SELECT {k}, min(m) AS worst FROM (
              SELECT {k}, date_trunc('month', date) AS mo, product(1.0 + ret) - 1.0 AS m
              FROM {source} GROUP BY {k}, mo) GROUP BY {k})""",
        f"""agg{tag} AS (SELECT {k}, product(1.0 + ret) AS total, count(*) AS n, avg(ret) AS mean,
              CASE WHEN coalesce(stddev_samp(ret), 0) < 1e-12 THEN 0 ELSE stddev_samp(ret) END AS sd,
              sqrt(avg(least(ret, 0.0) * least(ret, 0.0))) * {YEAR} AS down,
              min(dd) AS mdd, coalesce(avg(dd) FILTER (dd < 0), 0.0) AS add_,
              avg(CASE WHEN ret > 0 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) AS wins,
              coalesce(sum(ret) FILTER (ret > 0), 0.0) AS gain,
              abs(coalesce(sum(ret) FILTER (ret < 0), 0.0)) AS loss,
              abs(max(ret) FILTER (rk = CAST(floor((1.0::DOUBLE - 0.95::DOUBLE) * cnt) AS BIGINT))) AS v95,
              abs(avg(ret) FILTER (rk <= CAST(floor((1.0::DOUBLE - 0.95::DOUBLE) * cnt) AS BIGINT))) AS c95,
              abs(max(ret) FILTER (rk = CAST(floor((1.0::DOUBLE - 0.99::DOUBLE) * cnt) AS BIGINT))) AS v99,
              abs(avg(ret) FILTER (rk <= CAST(floor((1.0::DOUBLE - 0.99::DOUBLE) * cnt) AS BIGINT))) AS c99
              FROM dd{tag} GROUP BY {k})""",
        f"""risk{tag} AS (SELECT {k},
              CASE WHEN total > 0 THEN pow(total, 252.0::DOUBLE / n) - 1.0 ELSE 0.0 END AS "CAGR",
              sd * {YEAR} AS "Annualized_Volatility",
              CASE WHEN sd > 0 THEN mean * 252.0 / (sd * {YEAR}) ELSE 0.0 END AS "Sharpe_Ratio",
              CASE WHEN down > 0 THEN mean * 252.0 / down ELSE 0.0 END AS "Sortino_Ratio",
              CASE WHEN mdd < 0 THEN (CASE WHEN total > 0 THEN pow(total, 252.0::DOUBLE / n) - 1.0 ELSE 0.0 END)
                   / abs(mdd) ELSE 0.0 END AS "Calmar_Ratio",
              mdd AS "Max_Drawdown", add_ AS "Average_Drawdown",
              CAST(duration AS DOUBLE) AS "Drawdown_Duration_Days", wins AS "Win_Rate",
              CASE WHEN loss > 0 THEN gain / loss WHEN gain > 0 THEN 999.0 ELSE 0.0 END AS "Profit_Factor",
              v95 AS "Daily_VaR_95", c95 AS "Daily_CVaR_95", v99 AS "Daily_VaR_99", c99 AS "Daily_CVaR_99",
              down AS "Downside_Deviation", worst AS "Worst_Month"
              FROM agg{tag} JOIN dur{tag} {using} JOIN wm{tag} {using})""",
    ]


RISK_COLUMNS = [
    "CAGR", "Annualized_Volatility", "Sharpe_Ratio", "Sortino_Ratio", "Calmar_Ratio",
    "Max_Drawdown", "Average_Drawdown", "Drawdown_Duration_Days", "Win_Rate", "Profit_Factor",
    "Daily_VaR_95", "Daily_CVaR_95", "Daily_VaR_99", "Daily_CVaR_99", "Downside_Deviation",
    "Worst_Month",
]
