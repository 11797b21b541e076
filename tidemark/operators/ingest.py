"""From raw text tables to clean bars: names, types, filters, covariates."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.columns import finite, finite_columns, parse_date, parse_number
from ..session import stage
from .layout import POS, cut_blocks, located, running

# fixed values: header names accepted for each column
ALIASES = {
    "date": ["Date", "date", "DATE", "Date ", "Record Date"],
    "open": ["Open", "open", "OPEN", "Open Price"],
    "high": ["High", "high", "HIGH", "High Price"],
    "low": ["Low", "low", "LOW", "Low Price"],
    "close": ["Close", "close", "CLOSE", "Close Price", "Index Value"],
    "volume": ["Volume", "volume", "VOLUME", "Shares Traded", "No. of Shares"],
    "turnover": ["Turnover", "turnover", "TURNOVER", "Turnover (Rs. Cr)", "Turnover (₹ Cr)"],
}
# fixed values: parts of a header that mark a date column when no alias fits
DATE_HINTS = ("date", "time", "record")

PRICES = ["open", "high", "low", "close"]
NUMBERS = [*PRICES, "volume", "turnover"]


def read_bars_csv(spark: SparkSession, path: str) -> DataFrame:
    """CSV with a header, every column as text; types come from ``normalize_bars``."""
    return spark.read.option("header", True).csv(path)


def read_bars_files(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """CSV files with a header as text rows in their arrival order, and the lines that are no record.

    ``arrival`` orders files by path and rows by their place in the file: the
    start of the split a row comes from plus its number there, which is below
    the start of the next split, as a row has a byte at least. Lines with too few
    or too many fields go to the quarantine (file, arrival, line) and not to the
    rows. Both are staged.
    """
    names = spark.read.option("header", True).csv(path).columns
    schema = ", ".join(f"`{c}` string" for c in [*names, "_line"])
    raw = (
        spark.read.option("header", True).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_line").schema(schema).csv(path)
        .select("*", F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_block_start").alias("_from"))
        .withColumn("_at", F.monotonically_increasing_id())
    )
    raw = stage(raw)
    # one row per split and one per file, not per row
    splits = raw.groupBy("_file", "_from").agg(F.min("_at").alias("_first"))
    files = splits.select("_file").distinct().withColumn("_number", F.dense_rank().over(Window.orderBy("_file")))
    placed = raw.join(splits, ["_file", "_from"]).join(files, "_file").withColumn(
        "arrival", F.shiftleft(F.col("_number").cast("long"), 40) + F.col("_from") + F.col("_at") - F.col("_first")
    )
    rows = stage(placed.filter("_line is null").select(*raw.columns[: len(raw.columns) - 4], "arrival"))
    return rows, stage(placed.filter("_line is not null").select(F.col("_file").alias("file"), "arrival", F.col("_line").alias("line")))


def canonical_names(columns: list[str], aliases: dict[str, list[str]] = ALIASES) -> dict[str, str]:
    """Map from header to canonical name: the first header found per alias list.

    Headers are compared without surrounding blanks. Without a date alias the
    first header that hints at a date is taken; without any, ValueError.
    """
    stripped = {c: c.strip() for c in columns}
    found = {}
    for target, names in aliases.items():
        match = next((c for c in columns if stripped[c] in names), None)
        if match is not None:
            found[match] = target
    if "date" not in found.values():
        hint = next((c for c in columns if any(h in c.lower() for h in DATE_HINTS)), None)
        if hint is None:
            raise ValueError(f"no date column among {columns}")
        found[hint] = "date"
    return found


def rename_bars(df: DataFrame, aliases: dict[str, list[str]] = ALIASES) -> DataFrame:
    found = canonical_names(df.columns, aliases)
    return df.toDF(*[found.get(c, c.strip()) for c in df.columns])


def normalize_bars(df: DataFrame, aliases: dict[str, list[str]] = ALIASES, day_first: bool = False) -> DataFrame:
    """Canonical names, dates and doubles; rows without a date or a price are dropped.

    One projection and one filter. Text numbers lose commas, currency signs and
    blanks; what is still no number becomes NULL.
    """
    df = rename_bars(df, aliases)
    numbers = [c for c in NUMBERS if c in df.columns]
    typed = df.withColumns({"date": parse_date("date", day_first), **{c: parse_number(c) for c in numbers}})
    return typed.dropna(subset=["date", *[c for c in PRICES if c in numbers]])


def align_covariate(
    bars: DataFrame, covariate: DataFrame, names: list[str], keys: list[str] = ["series_id"],
    on: list[str] | None = None, backfill: bool = True,
) -> DataFrame:
    """Left join on the date, then fill forward, then the leading gap backward.

    The backward fill looks ahead; ``backfill=False`` leaves the leading gap
    NULL. ``on`` defaults to the keys the covariate shares plus the date.
    """
    on = on or [k for k in keys if k in covariate.columns] + ["date"]
    rows = cut_blocks(located(bars, keys).join(covariate.select(*on, *names), on, "left"))
    out = running(rows, keys, {f"_ff_{n}": (n, "last") for n in names})
    if backfill:
        first = rows.groupBy(*keys).agg(
            *[F.min_by(n, F.when(F.col(n).isNotNull(), F.col(POS))).alias(f"_bf_{n}") for n in names]
        )
        out = out.join(first, keys)
    filled = {
        n: F.coalesce(f"_ff_{n}", f"_bf_{n}") if backfill else F.col(f"_ff_{n}") for n in names
    }
    return out.withColumns(filled).drop(*[f"_ff_{n}" for n in names], *[f"_bf_{n}" for n in names])


def join_external(frames: list[DataFrame], on: list[str] = ["date"]) -> DataFrame:
    """External series side by side, every date of any of them.

    Stacked and aggregated once instead of a chain of full outer joins; each
    frame must have one row per key.
    """
    names = [c for f in frames for c in f.columns if c not in on]
    stacked = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)
    return stacked.groupBy(*on).agg(*[F.max(n).alias(n) for n in names])


def between_dates(df: DataFrame, start: str, end: str, date: str = "date") -> DataFrame:
    """Rows from start to end, both included; the filter reaches the scan."""
    return df.filter(F.col(date).between(F.lit(start).cast("date"), F.lit(end).cast("date")))


def complete_rows(df: DataFrame, features: list[str]) -> DataFrame:
    return df.dropna("any", subset=features)


def flag_complete(df: DataFrame, features: list[str], out: str = "valid") -> DataFrame:
    """Keep all rows and mark those without a missing feature."""
    return df.withColumn(out, reduce(lambda a, b: a & b, [F.col(f).isNotNull() for f in features]))


def apply_missing_policy(df: DataFrame, features: list[str], policy: str = "keep") -> DataFrame:
    """``keep``: all rows stay, warm-up cells are NULL. ``drop``: complete rows only."""
    if policy not in ("keep", "drop"):
        raise ValueError(f"policy must be keep or drop, not {policy!r}")
    df = finite_columns(df, features)
    return complete_rows(df, features) if policy == "drop" else df


def count_missing(df: DataFrame) -> DataFrame:
    """Missing cells per column, long form ``(column_name, missing)``; NaN and infinities count."""
    cell = {c: finite(F.col(c)) if kind in ("double", "float") else F.col(c) for c, kind in df.dtypes}
    counts = df.agg(*[F.count_if(x.isNull()).alias(c) for c, x in cell.items()])
    return counts.unpivot([], df.columns, "column_name", "missing")
