"""Data checks on bars: counts per series, the offending dates, a verdict."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import finite
from .layout import BLK, OWN, POS, block_window, index_rows, with_halo

REQUIRED = ["date", "open", "high", "low", "close", "volume"]
RANGE_EPS = 1e-5
MAX_MOVE = 0.30


def missing_columns(df: DataFrame, covariate: bool = False) -> list[str]:
    need = REQUIRED + (["vix_close"] if covariate else [])
    return [c for c in need if c not in df.columns]


def in_file_order(df: DataFrame, order: str | None = None) -> DataFrame:
    """Add ``_row``, the order in which the rows arrived.

    A table of many files has no order of its own, so without an order column
    the dates are the order, as after sorting; rows without a date come first.
    """
    if order:
        return df.withColumn("_row", F.col(order))
    return df.withColumn("_row", F.coalesce(F.unix_date(F.to_date("date")), F.lit(-(1 << 30))))


def _numbers(covariate: bool) -> list[str]:
    return REQUIRED[1:] + (["vix_close"] if covariate else [])


def _with_checks(df: DataFrame, keys: list[str], order: str | None, as_of: Column, covariate: bool) -> DataFrame:
    """Typed rows with the previous date and close in arrival order and one flag per check."""
    numbers = _numbers(covariate)
    typed = {f"_n_{c}": finite(F.col(c).try_cast("double")) for c in numbers}
    rows = in_file_order(df, order).withColumns(typed).withColumn("date", F.to_date("date"))
    rows = index_rows(rows.drop(POS, BLK), keys, ["_row"], F.floor(F.col("_row") / (16384 if order else 1024)))
    rows = with_halo(rows, halo=1)
    w = block_window(keys)
    rows = rows.withColumns({"_prev_date": F.lag("date").over(w), "_prev_close": F.lag("_n_close").over(w)})
    o, h, l, c, v = (F.col(f"_n_{n}") for n in ("open", "high", "low", "close", "volume"))
    outside = (o > h + RANGE_EPS) | (o < l - RANGE_EPS) | (c > h + RANGE_EPS) | (c < l - RANGE_EPS)
    # division by a previous close of 0 is an infinite move for the check
    move = F.when(F.col("_prev_close") == 0, F.lit(float("inf"))).otherwise(
        F.abs(c / F.nullif("_prev_close", F.lit(0.0)) - 1.0)
    )
    checks = {f"non_numeric_{n}": F.col(f"_n_{n}").isNull() for n in numbers}
    checks |= {
        "invalid_prices": (c <= 0) | (o <= 0),
        "high_less_than_low": h < l,
        "price_outside_high_low": outside,
        "future_dates": F.col("date") > as_of,
        "negative_volume": v < 0,
        "impossible_returns": move > MAX_MOVE,
        "unsorted_dates": F.col("date") < F.col("_prev_date"),
    }
    rows = rows.withColumns({k: F.coalesce(x, F.lit(False)) for k, x in checks.items()})
    return rows.filter(OWN).drop(OWN)


def missing_business_days(df: DataFrame, keys: list[str] = ["series_id"]) -> DataFrame:
    """Weekdays between a series' first and last date that it has no row for."""
    days = df.select(*keys, F.to_date("date").alias("date")).dropna().distinct()
    span = days.groupBy(*keys).agg(F.min("date").alias("_a"), F.max("date").alias("_b"))
    expected = span.select(*keys, F.explode(F.sequence("_a", "_b")).alias("date"))
    return expected.filter(F.weekday("date") < 5).join(days, [*keys, "date"], "left_anti")


def validate_bars(
    df: DataFrame, keys: list[str] = ["series_id"], order: str | None = None,
    as_of: str | None = None, covariate: bool = False,
) -> DataFrame:
    """One row of counts per series, with ``is_valid`` and the missing columns.

    ``order`` names the column with the arrival order (default: by date);
    ``as_of`` replaces the current time for the future-date check. Missing
    business days are information only.
    """
    absent = missing_columns(df, covariate)
    if absent:
        return df.groupBy(*keys).agg(
            F.count(F.lit(1)).alias("total_rows"),
            F.array(*[F.lit(c) for c in absent]).alias("missing_columns"),
            F.lit(False).alias("is_valid"),
        )
    today = F.lit(as_of).cast("date") if as_of else F.current_timestamp()
    rows = _with_checks(df, keys, order, today, covariate)
    numbers = _numbers(covariate)
    total = lambda names: reduce(lambda a, b: a + b, [F.count_if(F.col(n)) for n in names])
    counts = rows.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("total_rows"),
        total([f"non_numeric_{n}" for n in numbers]).alias("non_numeric_count"),
        total(["high_less_than_low", "price_outside_high_low"]).alias("invalid_ohlc_relation_count"),
        total(["invalid_prices"]).alias("invalid_price_count"),
        total(["unsorted_dates"]).alias("unsorted_dates_count"),
        total(["future_dates"]).alias("future_dates_count"),
        total(["negative_volume"]).alias("negative_volume_count"),
        total(["impossible_returns"]).alias("impossible_returns_count"),
        reduce(
            lambda a, b: a + b,
            [F.count_if(F.col(n).isNull()) for n in ["date", *[f"_n_{c}" for c in numbers]]],
        ).alias("missing_values_count"),
    )
    twice = (
        df.groupBy(*keys, F.to_date("date").alias("_d")).count().filter("count > 1 AND _d IS NOT NULL")
        .groupBy(*keys).agg(F.count(F.lit(1)).alias("duplicate_rows_count"))
    )
    gaps = missing_business_days(df, keys).groupBy(*keys).agg(F.count(F.lit(1)).alias("missing_dates_count"))
    zero = ["duplicate_rows_count", "missing_dates_count"]
    report = counts.join(twice, keys, "left").join(gaps, keys, "left").fillna(0, subset=zero)
    failing = [c for c in report.columns if c.endswith("_count") and c != "missing_dates_count"]
    clean = reduce(lambda a, b: a & b, [F.col(c) == 0 for c in failing])
    return report.withColumn("missing_columns", F.array().cast("array<string>")).withColumn("is_valid", clean)


def dataset_verdict(report: DataFrame) -> DataFrame:
    """One row for all series; a table without rows is invalid."""
    return report.agg(
        F.count(F.lit(1)).alias("series"),
        F.coalesce(F.sum("total_rows"), F.lit(0)).alias("total_rows"),
        F.coalesce(F.bool_and("is_valid"), F.lit(False)).alias("is_valid"),
    )


def require_valid(report: DataFrame) -> None:
    """Strict mode: raise when any series fails a check."""
    if not dataset_verdict(report).first()["is_valid"]:
        bad = [r.asDict() for r in report.filter(~F.col("is_valid")).limit(5).collect()]
        raise ValueError(f"data validation failed, first findings: {bad}")


def validation_issues(
    df: DataFrame, keys: list[str] = ["series_id"], order: str | None = None,
    as_of: str | None = None, covariate: bool = False,
) -> DataFrame:
    """Long table ``(series, check_name, date)`` of every finding."""
    today = F.lit(as_of).cast("date") if as_of else F.current_timestamp()
    rows = _with_checks(df, keys, order, today, covariate)
    names = [f"non_numeric_{n}" for n in _numbers(covariate)] + [
        "invalid_prices", "high_less_than_low", "price_outside_high_low", "future_dates",
        "negative_volume", "impossible_returns", "unsorted_dates",
    ]
    hits = F.filter(F.array(*[F.when(F.col(n), F.lit(n)) for n in names]), lambda x: x.isNotNull())
    found = rows.select(*keys, F.explode(hits).alias("check_name"), "date")
    twice = (
        df.groupBy(*keys, F.to_date("date").alias("date")).count().filter("count > 1")
        .select(*keys, F.lit("duplicate_dates").alias("check_name"), "date")
    )
    gaps = missing_business_days(df, keys).select(
        *keys, F.lit("missing_business_days").alias("check_name"), "date"
    )
    return found.unionByName(twice).unionByName(gaps)
