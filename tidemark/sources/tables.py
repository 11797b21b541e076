"""Reading tables, and the bar, covariate and state inputs derived from them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.columns import finite_columns
from ..operators.layout import date_chunk, index_rows
from ..session import stage


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder.rstrip('/')}/{name}.parquet")


def whole_cents(price: Column) -> Column:
    """Cents of a two-decimal price; ``floor`` stays in generated code, ``round`` does not."""
    return F.floor(price * 100 + 0.5)


def exact_mean(price: Column) -> Column:
    """Mean of two-decimal prices through whole cents: the same on every engine."""
    return F.sum(whole_cents(price)).cast("double") / (F.count(F.lit(1)) * F.lit(100.0))


def arrival_key(order: str, line: str, price: Column) -> Column:
    """Order number, line and cents as one decimal.

    A struct would order the same way, but a decimal fits a hash aggregate's
    buffer; with a struct Spark sorts the raw rows instead.
    """
    part = lambda c, digits: c.cast(f"decimal({digits},0)")
    high = part(F.col(order), 19) * F.lit(10**13).cast("decimal(14,0)")
    middle = part(F.col(line), 2) * F.lit(10**11).cast("decimal(12,0)")
    return (high + middle + part(whole_cents(price), 11)).cast("decimal(38,0)")


def daily_bars(spark: SparkSession, folder: str, start: str | None = None, end: str | None = None) -> DataFrame:
    """Daily bars per return flag: one partial aggregation over the line items.

    Staged, because every later operator reads the bars in several branches and
    the raw scan must not be repeated. The second, bar-level stage carries the
    row positions ``_pos`` that all windows use. ``start`` and ``end``, both
    included, are compared with the raw timestamp, so the scan can skip row groups.
    """
    price, shipped = F.col("l_extendedprice"), F.col("l_shipdate")
    raw = table(spark, folder, "lineitem")
    if start:
        raw = raw.filter(shipped >= F.lit(start).cast("timestamp_ntz"))
    if end:
        raw = raw.filter(shipped < F.date_add(F.lit(end).cast("date"), 1).cast("timestamp_ntz"))
    rows = raw.select(
        F.col("l_returnflag").alias("series_id"),
        F.to_date("l_shipdate").alias("date"),
        "l_orderkey", "l_linenumber", "l_extendedprice", "l_quantity",
    )
    first = arrival_key("l_orderkey", "l_linenumber", price)
    bars = stage(
        rows.groupBy("series_id", "date").agg(
            F.min_by(price, first).alias("open"),
            F.max(price).alias("high"),
            F.min(price).alias("low"),
            exact_mean(price).alias("close"),
            F.sum("l_quantity").alias("volume"),
        )
    )
    return stage(index_rows(bars, ["series_id"], ["date"], date_chunk("date")))


def daily_covariate(spark: SparkSession, folder: str, name: str = "vix_close") -> DataFrame:
    """Daily average order value, the market-wide series beside the bars."""
    return (
        table(spark, folder, "orders")
        .groupBy(F.to_date("o_orderdate").alias("date"))
        .agg(exact_mean(F.col("o_totalprice")).alias(name))
    )


def read_parquet_table(spark: SparkSession, path: str, date: str | None = "date") -> DataFrame:
    """Cleaned, feature or labelled table; the date column comes back as a date, NaN and infinities as NULL."""
    df = spark.read.parquet(path)
    df = finite_columns(df, [c for c, kind in df.dtypes if kind in ("double", "float")])
    return df.withColumn(date, F.to_date(date)) if date and date in df.columns else df


def _exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def first_existing(spark: SparkSession, *paths: str) -> str:
    """The first path that exists: primary place, then fallbacks."""
    for path in paths:
        if _exists(spark, path):
            return path
    raise FileNotFoundError(f"none of these paths exists: {list(paths)}")


def read_report(spark: SparkSession, *paths: str, multi_line: bool = False) -> DataFrame:
    """Report from the first existing path, by its ending: parquet, csv or json.

    ``multi_line``: JSON that spans lines, one document per file.
    """
    path = first_existing(spark, *paths)
    if path.rstrip("/").endswith(".csv"):
        return spark.read.option("header", True).option("inferSchema", True).csv(path)
    if path.rstrip("/").endswith(".json"):
        return spark.read.option("multiLine", multi_line).json(path)
    return spark.read.parquet(path)


def read_transition_matrix(spark: SparkSession, path: str) -> DataFrame:
    """Wide matrix CSV with the row label in the first column, as long rows."""
    wide = spark.read.option("header", True).csv(path)
    label, *states = wide.columns
    return wide.unpivot(label, states, "to_state", "p").select(
        F.col(label).alias("from_state"), "to_state", F.col("p").cast("double").alias("p")
    )
