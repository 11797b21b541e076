"""The batch flows on a small CSV, from raw text to reports."""

import os

import numpy as np
import pytest
from frames import ohlcv

from tidemark.plans import flows
from tidemark.sources import sinks, tables

FIT = {"max_iter": 2, "gmm_iter": 2, "kmeans_iter": 2}


@pytest.fixture(scope="module")
def raw_csv(tmp_path_factory):
    folder = tmp_path_factory.mktemp("raw")
    pdf = ohlcv(700).drop(columns="series_id")
    pdf["close"] = 5000 * np.cumprod(1 + np.random.default_rng(1).normal(0.0004, 0.01, len(pdf)))
    pdf["open"], pdf["high"], pdf["low"] = pdf.close * 1.001, pdf.close * 1.01, pdf.close * 0.99
    text = pdf.rename(columns={"date": "Date", "open": "Open Price", "volume": "Shares Traded"})
    text["Open Price"] = [f"₹ {v:,.6f}" for v in text["Open Price"]]
    text.to_csv(folder / "bars.csv", index=False)
    pdf.iloc[::2][["date", "close"]].to_csv(folder / "vix.csv", index=False)
    return folder


def test_from_csv_to_reports(spark, raw_csv, tmp_path):
    out = str(tmp_path)
    cleaned = flows.prepare_bars(spark, f"{raw_csv}/bars.csv", out, f"{raw_csv}/vix.csv")
    clean = tables.read_parquet_table(spark, cleaned)
    assert clean.count() == 700 and clean.filter("vix_close IS NULL").isEmpty()
    selected = flows.build_features(spark, cleaned, out)
    names = [f for f in selected if f in ("ret_10d", "vol_ratio_5_21", "z_score_ret", "stoch_d")]
    assert 5 < len(selected) < 63 and len(names) >= 3
    flows.fit_regimes(spark, f"{out}/features.parquet", names, out, ks=[2], **FIT)
    flows.run_backtests(spark, f"{out}/labelled.parquet", names, out, n_paths=50, horizons=[5], first=300, step=150,
                        periods=[("spring", "2015-09-01", "2015-12-31")], **FIT)
    flows.validate_out_of_sample(
        spark, f"{out}/features_raw.parquet", names, out,
        {"train": ("2015-01-01", "2016-03-31"), "val": ("2016-04-01", "2016-07-31"), "test": ("2016-08-01", "2016-12-31")},
        years=2, months=4, **FIT)
    for name in ("validation_report.json", "dataset_metadata.json", "feature_metadata.json", "model_comparison.csv",
                 "regime_summary.csv", "transition_matrix.csv", "selected_model_report.json", "risk_report.csv", "regime_risk.csv",
                 "backtest_summary.csv", "monthly_heatmap.csv", "rebalance_log.csv", "stress_report.csv",
                 "bootstrap_summary.csv", "oos_degradation_report.csv", "walk_forward_summary.csv"):
        assert tables.read_report(spark, f"{out}/missing_{name}", f"{out}/{name}").count() > 0, name
    for name in ("equity_curves.parquet", "rolling_metrics.parquet", "labelled.parquet", "walk_forward_curves.parquet"):
        assert tables.read_parquet_table(spark, f"{out}/{name}").count() > 0, name


def test_strict_mode_raises(spark, raw_csv, tmp_path):
    bad = tmp_path / "bad.csv"
    bad.write_text("Date,Open,High,Low,Close,Volume\n2020-01-01,1,2,0.5,1,10\n2020-01-02,-1,2,0.5,1,10\n")
    with pytest.raises(ValueError):
        flows.prepare_bars(spark, str(bad), str(tmp_path / "o"))
    flows.prepare_bars(spark, str(bad), str(tmp_path / "o"), strict=False)
    assert os.path.exists(tmp_path / "o" / "cleaned.parquet")


def test_fingerprint_ignores_order(spark):
    df = spark.range(1000).selectExpr("'a' AS series_id", "date_add(date'2020-01-01', cast(id as int)) AS date", "id * 1.5D AS close")
    a, b = (sinks.dataset_metadata(d, "x").first() for d in (df, df.orderBy("close", ascending=False).repartition(5)))
    assert a == b and a["row_count"] == 1000
    assert a["fingerprint"] != sinks.dataset_metadata(df.filter("close > 0"), "x").first()["fingerprint"]


def test_wide_matrix_file(spark, tmp_path):
    (tmp_path / "m.csv").write_text("from,s0,s1\ns0,0.9,0.1\ns1,0.2,0.8\n")
    got = {(r["from_state"], r["to_state"]): r["p"] for r in tables.read_transition_matrix(spark, str(tmp_path / "m.csv")).collect()}
    assert got["s1", "s0"] == 0.2 and len(got) == 4
    with pytest.raises(FileNotFoundError):
        tables.read_report(spark, str(tmp_path / "none.csv"))
