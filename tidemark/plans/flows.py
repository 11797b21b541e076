"""The batch flows: raw files to features, models, backtests and validation.

Each flow reads tables, composes operators and writes tables and reports. Paths
are folders on any file system Spark can reach.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.columns import if_zero
from ..operators import features as ft
from ..operators import ingest, models, regimes, resample, risk, selection, strategies, validate, walkforward
from ..operators.layout import POS, block_window, by_position, drop_halo, plain
from ..operators.packing import number_complete_rows, pack
from ..session import stage
from ..sources.sinks import (
    dataset_metadata, extend_report, feature_metadata, write_report_csv, write_report_json, write_table,
)
from ..sources.tables import read_parquet_table

KEYS = ["series_id"]


def prepare_bars(
    spark: SparkSession, bars_csv: str, out: str, covariate_csv: str | None = None,
    source: str = "csv", strict: bool = True, backfill: bool = True,
) -> str:
    """CSV files to a clean, validated bar table with its reports."""
    rows, broken = ingest.read_bars_files(spark, bars_csv)
    write_table(broken, f"{out}/quarantine.parquet", ["file"])
    bars = ingest.normalize_bars(rows)
    if "series_id" not in bars.columns:
        bars = bars.withColumn("series_id", F.lit("main"))
    bars = stage(bars)
    has_covariate = covariate_csv is not None
    if has_covariate:
        cov = ingest.normalize_bars(ingest.read_bars_csv(spark, covariate_csv))
        cov = cov.select("date", F.col("close").alias("vix_close"))
        bars = stage(plain(ingest.align_covariate(bars, cov, ["vix_close"], backfill=backfill)))
    report = stage(validate.validate_bars(bars, order="arrival", covariate=has_covariate))
    write_report_json(report, f"{out}/validation_report.json")
    write_table(validate.validation_issues(bars, order="arrival", covariate=has_covariate), f"{out}/validation_issues.parquet", ["check_name"])
    if strict:
        validate.require_valid(report)
    bars = bars.drop("arrival")
    write_report_json(dataset_metadata(bars, source), f"{out}/dataset_metadata.json")
    write_table(bars, f"{out}/cleaned.parquet")
    return f"{out}/cleaned.parquet"


def build_features(
    spark: SparkSession, cleaned: str, out: str, policy: str = "keep", external: DataFrame | None = None,
    var_min: float = 1e-4, corr_max: float = 0.90, prune_correlation: bool = True,
) -> list[str]:
    """Clean bars to selected features, standardised and raw, with their metadata.

    ``external`` is a long table (name, date, close) of other series. Selection
    and scaling are those of each series, from its whole history here;
    ``validate_out_of_sample`` does not look ahead. The tables have the features
    that any series selected; one that a series has dropped is 0 in all of its
    standardised rows, so it tells its states nothing. ``selection.parquet``
    has the choice of every series.
    """
    bars = read_parquet_table(spark, cleaned)
    df = ft.compute_features(bars)
    names = [c for c in df.columns if c not in (*KEYS, "date") and not c.startswith("raw_")]
    if external is not None:
        ext = ft.covariate_returns(external)
        extra = [c for c in ext.columns if c != "date"]
        df = plain(ingest.align_covariate(df, ext, extra))
        names += extra
    df = stage(ingest.apply_missing_policy(df, names, "keep"))
    chosen = stage(selection.selection_table(df, names, KEYS, var_min, corr_max, prune_correlation))
    used = {r["feature"] for r in chosen.select(F.explode("selected").alias("feature")).distinct().collect()}
    selected, dropped = [c for c in names if c in used], [c for c in names if c not in used]
    scaler = stage(selection.scaler_table(df.dropna("any", subset=names), selected, KEYS))
    raw_columns = [c for c in df.columns if c.startswith("raw_")]
    raw = df.select(*KEYS, "date", *selected, *raw_columns)
    raw = ingest.complete_rows(raw, selected) if policy == "drop" else raw
    scaled = selection.standardize(raw, scaler, selected, KEYS).join(chosen.select(*KEYS, "selected"), KEYS)
    off = {c: F.when(F.array_contains("selected", c), F.col(c)).otherwise(0.0) for c in selected}
    scaled = scaled.withColumns(off).drop("selected")
    write_table(scaled, f"{out}/features.parquet")
    chosen.write.mode("overwrite").parquet(f"{out}/selection.parquet")
    write_table(raw, f"{out}/features_raw.parquet")
    scaler.write.mode("overwrite").parquet(f"{out}/scaler.parquet")
    write_report_json(feature_metadata(raw, selected, dropped), f"{out}/feature_metadata.json")
    return selected


def _with_returns(df: DataFrame) -> DataFrame:
    """Simple return of the raw close, first row 0."""
    rows, w = by_position(df, KEYS, halo=1), block_window(KEYS)
    step = F.col("raw_close") / F.lag("raw_close").over(w) - 1.0
    return plain(drop_halo(rows.withColumn("ret", if_zero(step))))


def fit_regimes(
    spark: SparkSession, features: str, names: list[str], out: str, ks: list[int] = [2, 3, 4, 5, 6],
    override: tuple[str, int] | None = None, **fit,
) -> None:
    """Compare models, fit each series' chosen HMM on all its rows and write labelled data.

    Every series has the state count that is best for it (``override`` sets one
    for all); the labelled table carries it as ``n_states``.
    """
    df = stage(_with_returns(read_parquet_table(spark, features)))
    comparison = stage(walkforward.model_sweep(df, names, KEYS, ks=ks, **fit))
    write_report_csv(comparison, f"{out}/model_comparison.csv")
    best = walkforward.best_model(comparison, KEYS, override)
    counts = stage(best.select(*KEYS, F.col("n_components").alias("k")))
    rows = stage(number_complete_rows(df, KEYS, names))
    packed = pack(rows, KEYS, names, "ret")
    params = models.hmm_fit(packed, stage(models.model_table(packed, KEYS, counts)), KEYS, len(names), **fit)
    models.save_params(params, f"{out}/hmm_parameters.parquet")
    states = models.hmm_decode(packed, params, KEYS, len(names)).join(params.select("model_id", *KEYS), "model_id")
    placed = rows.select(*KEYS, "date", F.col(POS).alias("pos")).join(states, [*KEYS, "pos"])
    placed = placed.select(*KEYS, "date", F.col("state").alias("regime_state"))
    labelled = stage(
        df.join(placed, [*KEYS, "date"], "left").fillna(regimes.WARMUP, subset=["regime_state"])
        .join(counts.withColumnRenamed("k", "n_states"), KEYS, "left")
    )
    summary = stage(regimes.regime_summary(labelled, KEYS, "n_states"))
    labelled = regimes.apply_labels(labelled, summary, KEYS)
    write_table(labelled, f"{out}/labelled.parquet")
    write_report_csv(summary, f"{out}/regime_summary.csv")
    matrix = regimes.transition_matrix(labelled, KEYS, "n_states")
    write_report_csv(matrix, f"{out}/transition_matrix.csv")
    states_report, verdict = walkforward.train_test_stability(df, names, counts, KEYS, **fit)
    report = extend_report(best, "walk_forward_stability", verdict, KEYS)
    write_report_json(report, f"{out}/selected_model_report.json")
    write_report_csv(states_report, f"{out}/state_stability.csv")


def run_backtests(
    spark: SparkSession, labelled: str, names: list[str], out: str, n_paths: int = 5000,
    horizons: list[int] = [21, 63, 126, 252], periods=strategies.STRESS_PERIODS,
    walk_forward: bool = True, first: int = 1260, step: int = 63, costs: dict | None = None, **fit,
) -> None:
    """Risk reports, strategy backtests, stress windows and bootstrap summaries."""
    costs = costs or {}
    df = stage(read_parquet_table(spark, labelled))
    write_report_csv(risk.risk_report(df, KEYS), f"{out}/risk_report.csv")
    write_report_csv(regimes.regime_risk(df, KEYS, "n_states"), f"{out}/regime_risk.csv")
    signals = df
    if walk_forward:
        counts = df.groupBy(*KEYS).agg(F.max("n_states").alias("k"))
        signals = stage(walkforward.walk_forward_regimes(df, names, counts, KEYS, first=first, step=step, **fit))
    returns = stage(strategies.strategy_returns(signals, KEYS, "raw_close", **costs))
    curves = strategies.equity_curves(returns, KEYS)
    write_table(strategies.wide_curves(curves, KEYS), f"{out}/equity_curves.parquet")
    write_report_csv(strategies.backtest_summary(returns, KEYS), f"{out}/backtest_summary.csv")
    write_report_csv(risk.monthly_heatmap(returns, [*KEYS, "strategy"]), f"{out}/monthly_heatmap.csv")
    write_report_csv(strategies.rebalance_log(returns, KEYS), f"{out}/rebalance_log.csv")
    write_table(strategies.rolling_metrics(returns, KEYS), f"{out}/rolling_metrics.parquet")
    stress = {c: v for c, v in costs.items() if c in ("fee_bps", "slip_bps", "cash_yield")}
    write_report_csv(strategies.stress_report(returns, spark, periods, KEYS, **stress), f"{out}/stress_report.csv")
    pools = resample.return_pools(df, KEYS, "ret", "regime_state")
    paths = resample.bootstrap_paths(pools, KEYS, n_paths, horizons)
    write_report_csv(resample.path_stats(stage(paths), KEYS), f"{out}/bootstrap_summary.csv")


def validate_out_of_sample(
    spark: SparkSession, raw_features: str, names: list[str], out: str, splits: dict[str, tuple[str, str]],
    k: int = 3, years: int = 4, months: int = 6, **fit,
) -> None:
    """Partition and expanding validation, both without look-ahead, and the loss table."""
    df = stage(read_parquet_table(spark, raw_features))
    parts, _ = walkforward.oos_partitions(df, names, splits, k, KEYS, **fit)
    keys = [*KEYS, "split"]
    summary = stage(strategies.backtest_summary(strategies.strategy_returns(stage(parts), keys, "raw_close"), keys))
    train, validation, test = [summary.filter(F.col("split") == s).drop("split") for s in splits]
    write_report_csv(strategies.degradation(train, validation, test), f"{out}/oos_degradation_report.csv")
    rows, folds = walkforward.walk_forward_oos(df, names, k, KEYS, years=years, months=months, **fit)
    returns = stage(strategies.strategy_returns(stage(rows), KEYS, "raw_close"))
    write_table(strategies.wide_curves(strategies.equity_curves(returns, KEYS)), f"{out}/walk_forward_curves.parquet")
    write_report_csv(strategies.backtest_summary(returns, KEYS), f"{out}/walk_forward_summary.csv")
    write_report_json(folds.drop("shift", "inv"), f"{out}/walk_forward_folds.json")
