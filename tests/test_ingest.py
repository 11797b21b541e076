import datetime as dt

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F
from frames import BARS, bars, ohlcv

from tidemark.operators import ingest, selection, validate
from tidemark.operators.layout import plain

GOOD = pd.DataFrame(
    {
        "series_id": "a", "date": [dt.date(2026, 5, d) for d in (1, 4, 5, 6)],
        "open": [100.0, 101.0, 102.0, 103.0], "high": [105.0, 106.0, 107.0, 108.0],
        "low": [99.0, 100.0, 101.0, 102.0], "close": [103.0, 102.0, 104.0, 105.0],
        "volume": [1000.0, 1500.0, 1200.0, 1600.0],
    }
)
AS_OF = "2026-06-01"


def check(spark, **cells):
    pdf = GOOD.copy()
    for name, (row, value) in cells.items():
        pdf[name] = pdf[name].astype(object)
        pdf.loc[row, name] = value
    schema = BARS.replace("open double", "open string") if "open" in cells and isinstance(cells["open"][1], str) else BARS
    if schema != BARS:
        pdf["open"] = pdf["open"].astype(str)
    return validate.validate_bars(spark.createDataFrame(pdf.assign(arrival=range(len(pdf))), schema + ", arrival long"), order="arrival", as_of=AS_OF).first()


def test_good_bars_pass(spark):
    r = check(spark)
    assert r["is_valid"] and r["total_rows"] == 4 and r["missing_dates_count"] == 0


@pytest.mark.parametrize(
    "cells,count,n",
    [
        ({"close": (1, -5.0)}, "invalid_price_count", 1),
        ({"high": (1, 50.0)}, "invalid_ohlc_relation_count", 2),
        ({"volume": (2, -1.0)}, "negative_volume_count", 1),
        ({"volume": (2, None)}, "missing_values_count", 1),
        ({"date": (3, dt.date(2030, 1, 1))}, "future_dates_count", 1),
        ({"date": (3, dt.date(2026, 5, 5))}, "duplicate_rows_count", 1),
        ({"date": (3, dt.date(2026, 4, 30))}, "unsorted_dates_count", 1),
        ({"close": (3, 200.0)}, "impossible_returns_count", 1),
        ({"open": (1, "abc")}, "non_numeric_count", 1),
    ],
)
def test_one_fault_each(spark, cells, count, n):
    r = check(spark, **cells)
    assert not r["is_valid"] and r[count] == n


def test_missing_days_inform_only(spark):
    pdf = GOOD.drop(index=1)
    r = validate.validate_bars(bars(spark, pdf), as_of=AS_OF).first()
    assert r["missing_dates_count"] == 1 and r["is_valid"]


def test_empty_and_missing_columns(spark):
    empty = bars(spark, GOOD).limit(0)
    assert not validate.dataset_verdict(validate.validate_bars(empty)).first()["is_valid"]
    r = validate.validate_bars(bars(spark, GOOD).drop("volume")).first()
    assert r["missing_columns"] == ["volume"] and not r["is_valid"]
    with pytest.raises(ValueError):
        validate.require_valid(validate.validate_bars(empty))


def test_aliases_and_text_numbers(spark):
    raw = spark.createDataFrame(
        [("2026-05-01", "1,000.0", 1010.0, 990.0, 1005.0, 5000), ("05/05/2026", "1,010.0", 1020.0, 1000.0, 1015.0, 6000),
         ("nonsense", "1", 1.0, 1.0, 1.0, 1), ("2026-05-06", "1", None, 1.0, 1.0, 1)],
        "`Date ` string, `Open Price` string, `High Price` double, `Low Price` double, `Close Price` double, `Shares Traded` long",
    )
    out = ingest.normalize_bars(raw).orderBy("date").toPandas()
    assert list(out.columns) == ["date", "open", "high", "low", "close", "volume"]
    assert out.open.tolist() == [1000.0, 1010.0] and out.date.astype(str).tolist() == ["2026-05-01", "2026-05-05"]


def test_date_column_is_guessed_or_required():
    assert ingest.canonical_names(["Trade Timestamp", "Close"])["Trade Timestamp"] == "date"
    with pytest.raises(ValueError):
        ingest.canonical_names(["foo", "Close"])


def test_covariate_fill(spark, small_blocks):
    small_blocks(2)
    pdf = ohlcv(6)
    vix = pd.DataFrame({"date": [pdf.date[1], pdf.date[3]], "vix_close": [15.0, 16.0]})
    cov = spark.createDataFrame(vix, "date date, vix_close double")
    out = ingest.align_covariate(bars(spark, pdf), cov, ["vix_close"]).orderBy("date").toPandas()
    assert out.vix_close.tolist() == [15.0, 15.0, 15.0, 16.0, 16.0, 16.0]
    no = ingest.align_covariate(bars(spark, pdf), cov, ["vix_close"], backfill=False).orderBy("date").toPandas()
    assert no.vix_close.isna().tolist() == [True] + [False] * 5


def test_selection_and_scaling(spark):
    pdf = pd.DataFrame({"feature1": [1.0, 2, 3, 4, 5], "feature2": [10.0, 20, 30, 40, 50]})
    df = spark.createDataFrame(pdf)
    scaled = selection.standardize(df, selection.scaler_table(df, list(pdf)), list(pdf)).toPandas()
    assert scaled.mean().abs().max() < 1e-12 and (scaled.std(ddof=0) - 1).abs().max() < 1e-12
    # equal strength: the later one goes
    assert selection.select_features(df, list(pdf)) == (["feature1"], ["feature2"])
    flat = df.selectExpr("*", "0.5D AS flat")
    assert selection.select_features(flat, ["feature1", "flat"]) == (["feature1"], ["flat"])
    assert selection.select_features(flat, ["feature1", "feature2", "flat"], correlated=False) == (["feature1", "feature2"], ["flat"])


def test_prune_walks_pairs_in_order():
    feats = ["a", "b", "c"]
    corr = {("a", "b"): 0.95, ("a", "c"): 0.5, ("b", "c"): -0.97}
    assert selection.prune(feats, dict.fromkeys(feats, 1.0), corr) == (["a", "c"], ["b"])


def test_layout_columns_can_be_dropped(spark):
    assert plain(bars(spark, GOOD)).columns == bars(spark, GOOD).columns


def clean_bars(n=80):
    import numpy as np
    import pandas as pd

    days = pd.bdate_range("2020-01-01", periods=n).date
    close = 100 + np.sin(np.arange(n))
    return pd.DataFrame({"series_id": "a", "date": days, "open": close, "high": close + 1, "low": close - 1, "close": close, "volume": 10.0})


def test_nan_is_a_missing_cell(spark, tmp_path):
    from tidemark.operators import ingest, validate
    from tidemark.sources.tables import read_parquet_table

    pdf = clean_bars()
    pdf.loc[40, "close"] = float("nan")
    pdf.to_parquet(tmp_path / "bars.parquet")
    raw = spark.read.parquet(str(tmp_path / "bars.parquet"))
    for df in (raw, read_parquet_table(spark, str(tmp_path / "bars.parquet"))):
        r = validate.validate_bars(df).first()
        assert (r["non_numeric_count"], r["missing_values_count"], r["is_valid"]) == (1, 1, False)
        assert {x["column_name"]: x["missing"] for x in ingest.count_missing(df).collect()}["close"] == 1
    assert read_parquet_table(spark, str(tmp_path / "bars.parquet")).filter("close is null").count() == 1


def test_files_of_unequal_size_have_no_order_of_their_own(spark, tmp_path):
    from tidemark.operators import validate

    df, path = clean_bars(), str(tmp_path / "parts")
    for part in (df[:10], df[10:]):
        spark.createDataFrame(part).coalesce(1).write.mode("append").parquet(path)
    r = validate.validate_bars(spark.read.parquet(path)).first()
    assert (r["unsorted_dates_count"], r["impossible_returns_count"], r["is_valid"]) == (0, 0, True)


def test_slash_dates_are_month_first_unless_told(spark):
    from tidemark.functions.columns import parse_date

    df = spark.createDataFrame([("03/04/2020",), ("25/12/2020",), ("2020-02-01",), ("x",)], "d string")
    got = lambda first: [str(r[0]) for r in df.select(parse_date("d", first)).collect()]
    assert got(False) == ["2020-03-04", "2020-12-25", "2020-02-01", "None"]
    assert got(True) == ["2020-04-03", "2020-12-25", "2020-02-01", "None"]


def plain_selection(pdf, feats, var_min, corr_max):
    var = pdf[feats].var().to_dict()
    corr = pdf[feats].corr()
    pairs = {(a, b): corr.loc[a, b] for i, a in enumerate(feats) for b in feats[i + 1:] if corr.loc[a, b] == corr.loc[a, b]}
    return selection.prune(feats, var, pairs, var_min, corr_max)


def correlated_frame(n=400, seed=0, level=0.0):
    rng = np.random.default_rng(seed)
    base = rng.normal(size=(n, 3))
    mix = rng.normal(size=(3, 7))
    x = base @ mix + 0.4 * rng.normal(size=(n, 7)) + level
    x[:, 6] = 3.0
    x[rng.random((n, 7)) < 0.01] = np.nan
    return pd.DataFrame(x, columns=[f"f{i}" for i in range(7)])


def test_selection_per_key_equals_the_plain_walk(spark):
    feats = [f"f{i}" for i in range(7)]
    parts = {k: correlated_frame(seed=k, level=10.0**k) for k in range(4)}
    df = spark.createDataFrame(pd.concat([p.assign(k=k) for k, p in parts.items()])).repartition(5)
    found = {r["k"]: r for r in selection.selection_table(df, feats, ["k"], 1e-4, 0.6).collect()}
    assert len(found) == 4
    for k, p in parts.items():
        assert (list(found[k]["selected"]), list(found[k]["dropped"])) == plain_selection(p.dropna(), feats, 1e-4, 0.6)
    flat = df.select("k", *[F.lit(1.0).alias(f) for f in feats])
    assert all(r["selected"] == feats and r["dropped"] == [] for r in selection.selection_table(flat, feats, ["k"]).collect())
    assert selection.selection_table(df.limit(0), feats, ["k"]).count() == 0


def test_moments_keep_digits_at_large_levels(spark):
    p = correlated_frame(seed=9, level=1e9).dropna()
    got = selection.moments(spark.createDataFrame(p).repartition(7), list(p), []).first()
    x = p.to_numpy() - p.to_numpy().mean(0)
    assert got["n"] == len(p) and np.allclose(np.reshape(got["cross"], (7, 7)), x.T @ x, rtol=1e-5, atol=1e-2)


def test_components_per_key(spark):
    feats = [f"f{i}" for i in range(6)]
    parts = {k: correlated_frame(seed=k).dropna() for k in range(3)}
    df = spark.createDataFrame(pd.concat([p.assign(k=k, i=range(len(p))) for k, p in parts.items()]))
    scores = selection.principal_components(df, feats, 2, ["k", "i"], ["k"]).toPandas()
    for k, p in parts.items():
        z = ((p - p.mean()) / p.std(ddof=0))[feats].to_numpy()
        _, _, v = np.linalg.svd(z, full_matrices=False)
        v = v[:2] * np.sign(v[np.arange(2), np.abs(v[:2]).argmax(1)])[:, None]
        mine = scores[scores.k == k].sort_values("i")[["pc1", "pc2"]].to_numpy()
        assert np.allclose(mine, z @ v.T, atol=1e-8)
    few = df.filter("i < 5")
    assert selection.principal_components(few, feats, 2, ["k"], ["k"]).count() == 0


def write_files(folder, files):
    folder.mkdir(parents=True, exist_ok=True)
    for name, lines in files.items():
        (folder / name).write_text("\n".join(["Date,Open,High,Low,Close,Volume", *lines]) + "\n")
    return str(folder)


@pytest.mark.parametrize("split", [97, 1 << 27])
def test_files_keep_their_order_and_broken_lines_are_set_aside(spark, tmp_path, split):
    line = lambda d: f"{d},1,2,0.5,1.5,100"
    days = [f"2020-01-{i:02d}" for i in range(1, 29)]
    files = {"b.csv": [line(d) for d in days[20:]], "a.csv": [line(d) for d in [days[3], days[1], *days[4:20]]] + ["2020-02-01,1,2", "03/02/2020,1,2,3,4,5,6,7"]}
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", str(split))
    try:
        rows, broken = ingest.read_bars_files(spark, write_files(tmp_path / "in", files))
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    got = [r.Date for r in rows.orderBy("arrival").collect()]
    assert got == [days[3], days[1], *days[4:20], *days[20:]]
    assert {r.line for r in broken.collect()} == {"2020-02-01,1,2", "03/02/2020,1,2,3,4,5,6,7"} and rows.select("arrival").distinct().count() == len(got)
    report = validate.validate_bars(ingest.normalize_bars(rows).withColumn("series_id", F.lit("s")), order="arrival").first()
    assert report["unsorted_dates_count"] == 1 and report["total_rows"] == len(got)


def test_commit_leaves_one_version_and_notices_other_files(spark, tmp_path):
    from tidemark.sources import sinks

    df = spark.createDataFrame([(s, dt.date(2020, 1, d), float(d)) for s in "ab" for d in range(1, 20)], "series_id string, date date, close double")
    path = str(tmp_path / "t")
    first = sinks.commit_table(df.limit(5), path)
    second = sinks.commit_table(df, path)
    table, manifest = sinks.read_committed(spark, path)
    assert sinks.versions(spark, path) == [second] != [first] and table.count() == 38
    assert manifest.agg(F.sum("n_rows"), F.min("least_date"), F.max("most_series_id")).first()[:] == (38, dt.date(2020, 1, 1), "b")
    assert sorted(map(tuple, table.collect())) == sorted(map(tuple, df.collect()))
    known = next(p for p in (tmp_path / "t" / second).glob("part-*.parquet"))
    (known.parent / "part-99999-foreign.parquet").write_bytes(known.read_bytes())
    with pytest.raises(ValueError):
        sinks.read_committed(spark, path)
