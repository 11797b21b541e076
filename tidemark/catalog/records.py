"""Queries on reports, parameter tables, labels and external series, written to files and read back where files are the point."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..functions.columns import round_doubles
from ..operators import features as ft
from ..operators import ingest, models as md, regimes as rg, validate
from ..operators.layout import plain
from ..session import ensure_checkpoint_dir, stage
from ..sources import sinks
from ..sources.tables import daily_bars, first_existing, read_report, read_transition_matrix, table
from .given import CALM_WILD, _given
from .regimes import LABEL3, STATES, bar_states, matrix_sql, summary_sql, _SUMMARY
from .sqlparts import BARS, LOGS, RETURNS, query, rounded

KEYS = ["series_id"]


def _folder(spark, name: str) -> str:
    ensure_checkpoint_dir(spark)
    return f"{spark.sparkContext.getCheckpointDir()}/{name}-{uuid.uuid4().hex}"


def q_two_states(spark, sf):
    """Two states by the sign of the 5-day return, with their labels."""
    state = F.when(F.col("state4") < 0, -1).otherwise(F.floor(F.col("state4") / 2).cast("int"))
    rows = stage(bar_states(spark, sf).withColumn("regime_state", state))
    return round_doubles(rg.regime_summary(rows, KEYS, 2))


def q_state_labels(spark, sf):
    """Rows that carry the label of their state's profile; warm-up rows have their own."""
    rows = stage(bar_states(spark, sf))
    named = rg.apply_labels(rows, rg.regime_summary(rows, KEYS, 3), KEYS)
    return named.groupBy(*KEYS, "regime_state", "regime_label").agg(F.count(F.lit(1)).alias("n"), F.min("date").alias("first_date"))


def q_matrix_file(spark, sf):
    """Transition matrices written as one wide CSV per series and read back as long rows."""
    path, wide = _folder(spark, "matrices"), rg.transition_matrix(stage(bar_states(spark, sf)), KEYS, 3)
    cells = wide.groupBy(*KEYS, "from_state").pivot("to_state", [0, 1, 2]).agg(F.max("p"))
    cells = cells.withColumn("name", F.concat_ws(":", *KEYS, "from_state")).select("name", "0", "1", "2")
    sinks.write_report_csv(cells, path)
    back = read_transition_matrix(spark, path)
    name = F.split("from_state", ":")
    return round_doubles(back.select(name[0].alias("series_id"), name[1].cast("int").alias("from_state"), F.col("to_state").cast("int"), "p"))


def q_reports(spark, sf):
    """Reports as CSV, JSON and Parquet, the first one that exists, and one that is extended by a section."""
    path = _folder(spark, "reports")
    rets = stage(rows_with_returns(spark, sf))
    stats = rets.groupBy(*KEYS).agg(F.count(F.lit(1)).alias("n_rows"), F.round(F.avg("ret"), 9).alias("mean"))
    spread = rets.groupBy(*KEYS).agg(F.round(F.min("ret"), 9).alias("worst"), F.round(F.max("ret"), 9).alias("best"))
    sinks.write_report_csv(stats, f"{path}/stats.csv")
    sinks.write_report_json(sinks.extend_report(read_report(spark, f"{path}/no.csv", f"{path}/stats.csv"), "spread", spread), f"{path}/all.json")
    back = read_report(spark, first_existing(spark, f"{path}/none.parquet", f"{path}/all.json"))
    return round_doubles(back.select("series_id", F.col("n_rows").cast("long").alias("n_rows"), "mean", "spread.worst", "spread.best"))


def rows_with_returns(spark, sf):
    df = ft.compute_features(daily_bars(spark, sf), "returns")
    return df.select(*KEYS, "date", F.coalesce("ret_simple", F.lit(0.0)).alias("ret"))


def q_parameters(spark, sf):
    """Transition, emission and summary tables of models with given parameters, saved and loaded."""
    _, packed, params = _given(spark, sf, ["ret"], CALM_WILD)
    path = _folder(spark, "params")
    md.save_params(params, path)
    params = md.load_params(spark, path)
    moves = md.transition_table(params, KEYS).select(*KEYS, F.lit("move").alias("kind"), "from_state", "to_state", F.col("p").alias("value"))
    emits = md.emission_table(params, KEYS, ["ret"]).select(
        *KEYS, F.col("state").alias("from_state"), F.expr("stack(2, 'mean', mean, 'var', var) as (kind, value)")
    )
    return round_doubles(moves.unionByName(emits.select(*KEYS, "kind", "from_state", F.col("from_state").alias("to_state"), "value")))


def q_absent(spark, sf):
    """Validation of a table that lacks columns, and of one that has no rows: neither is valid."""
    bars = daily_bars(spark, sf)
    report = validate.validate_bars(bars.drop("volume", "low"), as_of="2001-06-30")
    none = validate.dataset_verdict(validate.validate_bars(bars.filter("close < 0"), as_of="2001-06-30"))
    lacking = report.select("series_id", "total_rows", F.concat_ws(",", F.sort_array("missing_columns")).alias("missing"), "is_valid")
    return lacking.unionByName(none.select(F.lit("no rows").alias("series_id"), "total_rows", F.lit("").alias("missing"), "is_valid"))


def q_feature_metadata(spark, sf):
    """Groups of selected and dropped features with the rows and dates that they cover."""
    df = plain(daily_bars(spark, sf))
    names = ft.feature_names("returns", "momentum")
    out = sinks.feature_metadata(df, names[::2], names[1::2])
    return out.select("feature_group", "status", F.concat_ws(",", "features").alias("features"), "feature_count", "total_records", "start_date", "end_date")


def q_hinted(spark, sf):
    """Bars whose date column has no usual name, only one that hints at a date."""
    b = plain(daily_bars(spark, sf))
    raw = b.select("series_id", F.date_format("date", "dd-MMM-yyyy").alias("trade_timestamp"), *[F.col(c).cast("string").alias(c.upper()) for c in ("open", "high", "low", "close")])
    return round_doubles(ingest.normalize_bars(raw).select("series_id", "date", "open", "high", "low", "close"))


def q_external(spark, sf):
    """Log returns of every customer's mean order value, as one map per day, beside the bars."""
    orders = table(spark, sf, "orders").groupBy(F.col("o_custkey").cast("string").alias("name"), F.to_date("o_orderdate").alias("date")).agg(F.avg("o_totalprice").alias("close"))
    maps = ft.covariate_return_maps(stage(orders))
    rows = ft.with_external(plain(daily_bars(spark, sf)), maps)
    values = F.map_values("external")
    total = F.aggregate(values, F.lit(0.0), lambda a, v: a + v)
    return round_doubles(rows.select(*KEYS, "date", F.size("external").alias("n_external"), total.alias("sum_external"), F.array_max(values).alias("most_external")))


QUERIES = {
    "regime_summary_two_states": q_two_states,
    "state_labels": q_state_labels,
    "transition_matrix_file": q_matrix_file,
    "report_files": q_reports,
    "parameter_tables": q_parameters,
    "absent_columns_and_rows": q_absent,
    "feature_metadata": q_feature_metadata,
    "hinted_date": q_hinted,
    "external_return_maps": q_external,
}

_TWO = """lb AS (SELECT *, CASE WHEN row_number() OVER (PARTITION BY series_id ORDER BY annualized_return, regime_state) = 2 THEN 'Bullish Low Volatility'
  WHEN annualized_return < 0 THEN 'Bearish High Volatility' ELSE 'Sideways Low Volatility' END AS regime_label FROM sm)"""
_STATES2 = STATES.replace("st AS (SELECT", "s4 AS (SELECT", 1).split("lab AS (")[0].rstrip().rstrip(",")
_CELLS = ", ".join(
    [f"('move', {i}, {j}, {CALM_WILD['trans'][2 * i + j]}::DOUBLE)" for i in (0, 1) for j in (0, 1)]
    + [f"('{k}', {i}, {i}, {CALM_WILD[k + 's'][i]}::DOUBLE)" for k in ("mean", "var") for i in (0, 1)]
)
_NAMES = ft.feature_names("returns", "momentum")
_GROUP = {f: g for g in ("returns", "momentum") for f in ft.feature_names(g)}
_STATUS = {f: ("selected", "dropped")[i % 2] for i, f in enumerate(_NAMES)}

ORACLES = {
    "regime_summary_two_states": query(
        BARS, LOGS, _STATES2, "st AS (SELECT * REPLACE (CAST(CASE WHEN state4 < 0 THEN -1 ELSE state4 // 2 END AS INTEGER) AS regime_state) FROM s4)",
        *summary_sql("regime_state", 2, _TWO), f"SELECT series_id, regime_state, daily_count, regime_label, {rounded(_SUMMARY)} FROM lb",
    ),
    "state_labels": query(
        BARS, LOGS, STATES, *summary_sql("regime_state", 3, LABEL3),
        """SELECT st.series_id, st.regime_state, coalesce(regime_label, 'Warmup / Undefined') AS regime_label, count(*) AS n, min(date) AS first_date
          FROM st LEFT JOIN lb ON lb.series_id = st.series_id AND lb.regime_state = st.regime_state GROUP BY 1, 2, 3""",
    ),
    "transition_matrix_file": query(
        BARS, LOGS, STATES, matrix_sql("st", "series_id", "regime_state", "date", 3), "SELECT series_id, from_state, to_state, round(p, 6) + 0.0 AS p FROM tm",
    ),
    "report_files": query(
        BARS, RETURNS, "SELECT series_id, count(*) AS n_rows, round(round(avg(ret), 9), 6) + 0.0 AS mean, round(round(min(ret), 9), 6) + 0.0 AS worst, "
        "round(round(max(ret), 9), 6) + 0.0 AS best FROM rets GROUP BY 1",
    ),
    "parameter_tables": query(
        BARS, f"SELECT series_id, kind, from_state, to_state, value FROM (SELECT DISTINCT series_id FROM bars), (VALUES {_CELLS}) v(kind, from_state, to_state, value)",
    ),
    "absent_columns_and_rows": query(
        BARS, "SELECT series_id, count(*) AS total_rows, 'low,volume' AS missing, false AS is_valid FROM bars GROUP BY 1 UNION ALL SELECT 'no rows', 0, '', false",
    ),
    "feature_metadata": query(
        BARS, "n AS (SELECT * FROM (VALUES " + ", ".join(f"('{_GROUP[f]}', '{_STATUS[f]}', '{f}')" for f in _NAMES) + ") t(feature_group, status, feature))",
        "t AS (SELECT count(*) AS total_records, min(date) AS start_date, max(date) AS end_date FROM bars)",
        "SELECT feature_group, status, string_agg(feature, ',' ORDER BY feature) AS features, count(*) AS feature_count, total_records, start_date, end_date "
        "FROM n, t GROUP BY ALL",
    ),
    "hinted_date": query(BARS, f"SELECT series_id, date, {rounded(['open', 'high', 'low', 'close'])} FROM bars"),
    "external_return_maps": query(
        BARS, "o AS (SELECT o_custkey AS name, CAST(o_orderdate AS DATE) AS date, avg(o_totalprice) AS close FROM orders GROUP BY 1, 2)",
        "r AS (SELECT date, ln(close / lag(close) OVER (PARTITION BY name ORDER BY date)) AS r FROM o)",
        "m AS (SELECT date, count(r) AS n, sum(r) AS s, max(r) AS most FROM r WHERE r IS NOT NULL GROUP BY 1)",
        "SELECT series_id, b.date, CAST(coalesce(n, 0) AS INTEGER) AS n_external, round(coalesce(s, 0.0), 6) + 0.0 AS sum_external, round(most, 6) + 0.0 AS most_external "
        "FROM bars b LEFT JOIN m ON m.date = b.date",
    ),
}
