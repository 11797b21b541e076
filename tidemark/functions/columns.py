"""Column expressions shared by the operators. All of them stay in the JVM."""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

TRADING_DAYS = 252.0
TINY = 1e-12  # a spread below this counts as zero: sums run in another order on Spark


def finite(c: Column) -> Column:
    """NaN and both infinities become NULL, so that aggregates skip them."""
    bad = F.isnan(c) | c.isin(float("inf"), float("-inf"))
    return F.when(~bad, c)


def finite_columns(df: DataFrame, names: Iterable[str]) -> DataFrame:
    return df.withColumns({n: finite(F.col(n).cast("double")) for n in names})


def parse_number(name: str) -> Column:
    """Text such as ``"1,010.0"`` or ``" ₹ 12 "`` to double; anything else to NULL."""
    bare = F.trim(F.replace(F.replace(F.col(name).cast("string"), F.lit(",")), F.lit("₹")))
    return finite(bare.try_cast("double"))


def parse_date(name: str, day_first: bool = False) -> Column:
    """ISO dates and timestamps, then dates with slashes or dashes, else NULL.

    ``03/04/2020`` is 4 March, or 3 April if ``day_first``; what only the other
    reading allows, as ``25/12/2020``, takes that one.
    """
    c = F.trim(F.col(name).cast("string"))
    patterns = ["MM-dd-yyyy", "MM/dd/yyyy", "dd-MM-yyyy", "dd/MM/yyyy"]
    patterns = [*(patterns[2:] + patterns[:2] if day_first else patterns), "dd-MMM-yyyy"]
    tries = [c.try_cast("timestamp")]
    tries += [F.try_to_timestamp(c, F.lit(p)) for p in patterns]
    return F.coalesce(*tries).cast("date")


def full(n: int, value: Column, agg: Callable[[Column], Column], w: WindowSpec) -> Column:
    """Aggregate over the last ``n`` rows, NULL unless all ``n`` values are present.

    ``w`` is the ordered window without a frame.
    """
    frame = w.rowsBetween(-(n - 1), 0)
    return F.when(F.count(value).over(frame) == n, agg(value).over(frame))


def change(value: Column, n: int, w: WindowSpec) -> Column:
    """Relative change against the value ``n`` rows earlier."""
    return value / F.lag(value, n).over(w) - 1.0


def rolling_slope(value: Column, n: int, position: Column, w: WindowSpec) -> Column:
    """Least-squares slope of the last ``n`` values against 1..n.

    With x_i = position_i - position_t + n the cross sum needs two plain window
    sums. Values are centred on the current one first: the slope ignores a
    shift, and the sums then keep their digits for large prices.
    """
    frame = w.rowsBetween(-(n - 1), 0)
    sx, sxx = n * (n + 1) / 2.0, n * (n + 1) * (2 * n + 1) / 6.0
    lags = [F.lag(value, k).over(w) - value for k in range(1, n)]
    sy = sum(lags[1:], lags[0])
    sxy = sum((lag * float(n - k) for k, lag in enumerate(lags[1:], 2)), lags[0] * float(n - 1))
    slope = (n * sxy - sx * sy) / (n * sxx - sx * sx)
    return F.when(F.count(value).over(frame) == n, slope)


def sample_skew(value: Column, n: int, w: WindowSpec) -> Column:
    """Bias-corrected skewness over the last ``n`` rows."""
    pop = full(n, value, F.skewness, w)
    return pop * ((n * (n - 1)) ** 0.5 / (n - 2))


def sample_kurtosis(value: Column, n: int, w: WindowSpec) -> Column:
    """Bias-corrected excess kurtosis over the last ``n`` rows."""
    pop = full(n, value, F.kurtosis, w)
    return ((n + 1) * pop + 6.0) * ((n - 1) / ((n - 2) * (n - 3)))


def uniform(*parts: Column) -> Column:
    """Uniform number in [0, 1) from an MD5 of the given parts.

    Depends only on the parts, so a retried task or another partitioning draws
    the same numbers.
    """
    digest = F.md5(F.concat_ws("|", *[p.cast("string") for p in parts]))
    return F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") / F.lit(float(2**52))


def ordered(keys: list[str], *order: str) -> WindowSpec:
    return Window.partitionBy(*keys).orderBy(*order)


def if_zero(c: Column, value: float = 0.0) -> Column:
    return F.coalesce(c, F.lit(value))


def round_doubles(df: DataFrame, digits: int = 6, **special: int) -> DataFrame:
    """Round every double column; used for reports and for comparisons."""
    out = []
    for name, kind in df.dtypes:
        c = F.col(name)
        out.append(F.round(c, special.get(name, digits)).alias(name) if kind == "double" else c)
    return df.select(*out)


def attach(df: DataFrame, one_row: DataFrame) -> DataFrame:
    """Put the columns of a global aggregate, always exactly one row, beside every row."""
    return df.join(F.broadcast(one_row), F.lit(True))


SALT, SALTS = "_salt", 32


def salted(rows: DataFrame, small: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Both sides of a join with a salt column to join on as well: rows by the hash of their
    cells, the small side once per salt. An aggregate by (key, salt) after the join needs no
    exchange, and one by key sums at most ``SALTS`` rows, so a hot key is never one task."""
    by = F.pmod(F.xxhash64(*rows.columns), F.lit(SALTS)).cast("int")
    return rows.withColumn(SALT, by), small.withColumn(SALT, F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
