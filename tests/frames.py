"""Small frames for the tests."""

import datetime as dt

import numpy as np
import pandas as pd

START = dt.date(2015, 1, 1)


def dates(n, start=START):
    return [start + dt.timedelta(days=i) for i in range(n)]


def returns(spark, values, series="a"):
    pdf = pd.DataFrame({"series_id": series, "date": dates(len(values)), "ret": [float(v) for v in values]})
    return spark.createDataFrame(pdf, "series_id string, date date, ret double")


def states(spark, values, series="a"):
    pdf = pd.DataFrame({"series_id": series, "date": dates(len(values)), "regime_state": values})
    return spark.createDataFrame(pdf, "series_id string, date date, regime_state int")


def ohlcv(n=250, seed=42, series="a"):
    rng = np.random.default_rng(seed)
    close = 100 + np.cumsum(rng.normal(0.2, 1, n))
    open_ = close + rng.normal(0, 0.5, n)
    high = np.maximum(open_, close) + rng.uniform(0.1, 1, n)
    low = np.minimum(open_, close) - rng.uniform(0.1, 1, n)
    return pd.DataFrame(
        {"series_id": series, "date": dates(n), "open": open_, "high": high, "low": low, "close": close,
         "volume": rng.integers(1000, 5000, n).astype(float)}
    )


BARS = "series_id string, date date, open double, high double, low double, close double, volume double"


def bars(spark, pdf):
    return spark.createDataFrame(pdf, BARS)
