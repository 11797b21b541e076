"""Exact order statistics without sorting a group in one task.

Values fall into buckets by a monotone log-like key. Bucket counts locate the
bucket of every wanted rank; only the rows of those buckets, collapsed to
distinct values, are ranked.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def value_bucket(v: Column) -> Column:
    """Monotone bucket number: about 0.4 % relative width, finer near zero."""
    return F.floor(F.signum(v) * F.log1p(F.abs(v) * 1e4) * 256)


def lower_rank(alpha: float) -> Callable[[Column], Column]:
    """0-based rank ``int((1 - alpha) * n)``."""
    return lambda n: F.floor((F.lit(1.0) - F.lit(alpha)) * n).cast("double")


def share_rank(p: float) -> Callable[[Column], Column]:
    """0-based rank ``int(n * p)``."""
    return lambda n: F.floor(n * F.lit(p)).cast("double")


def linear(p: float) -> Callable[[Column], Column]:
    """Interpolated percentile position ``p * (n - 1)``."""
    return lambda n: F.lit(p) * (n - 1)


def pick_ranks(
    df: DataFrame, keys: list[str], value: str, picks: dict[str, Callable[[Column], Column]]
) -> DataFrame:
    """One row per key with ``<name>`` and ``<name>_tail`` per pick.

    A pick maps the row count to a 0-based position. ``<name>`` is the value
    there (between two rows: interpolated), ``<name>_tail`` the mean of the
    values from rank 0 to that position.
    """
    rows = df.select(*keys, F.col(value).alias("_v")).filter(F.col("_v").isNotNull())
    rows = rows.withColumn("_b", value_bucket(F.col("_v")))
    per_key = Window.partitionBy(*keys)
    before = per_key.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    buckets = (
        rows.groupBy(*keys, "_b")
        .agg(F.count(F.lit(1)).alias("_n"), F.sum("_v").alias("_s"))
        .withColumns(
            {
                "_n0": F.coalesce(F.sum("_n").over(before), F.lit(0)),
                "_s0": F.coalesce(F.sum("_s").over(before), F.lit(0.0)),
                "_all": F.sum("_n").over(per_key),
            }
        )
    )
    names = list(picks)
    buckets = buckets.withColumns({f"_h_{n}": picks[n](F.col("_all")) for n in names})
    end = F.col("_n0") + F.col("_n")
    wanted = F.lit(False)
    holds_lower = {}
    for n in names:
        lo, hi = F.floor(f"_h_{n}"), F.ceil(f"_h_{n}")
        holds_lower[f"_in_{n}"] = (F.col("_n0") <= lo) & (lo < end)
        wanted = wanted | holds_lower[f"_in_{n}"] | ((F.col("_n0") <= hi) & (hi < end))
    hit = (
        buckets.filter(wanted)
        .withColumns(holds_lower)
        .select(*keys, "_b", "_n0", "_s0", *holds_lower, *[f"_h_{n}" for n in names])
    )
    upto = Window.partitionBy(*keys, "_b").orderBy("_v").rowsBetween(Window.unboundedPreceding, 0)
    ranked = (
        rows.groupBy(*keys, "_b", "_v")
        .agg(F.count(F.lit(1)).alias("_c"))
        .join(hit, [*keys, "_b"])
        .withColumn("_hi", F.col("_n0") + F.sum("_c").over(upto))
        .withColumn("_lo", F.col("_hi") - F.col("_c"))
    )
    aggs, cols = [], [F.col(k) for k in keys]
    for n in names:
        lo, hi = F.floor(f"_h_{n}"), F.ceil(f"_h_{n}")
        mine = F.col(f"_in_{n}")
        take = F.col("_v") * F.least(F.col("_c"), lo + 1 - F.col("_lo"))
        aggs += [
            F.max(F.when((F.col("_lo") <= lo) & (lo < F.col("_hi")), F.col("_v"))).alias(f"_a_{n}"),
            F.max(F.when((F.col("_lo") <= hi) & (hi < F.col("_hi")), F.col("_v"))).alias(f"_z_{n}"),
            F.max(f"_h_{n}").alias(f"_p_{n}"),
            F.max(F.when(mine, F.col("_s0"))).alias(f"_s_{n}"),
            F.sum(F.when(mine & (F.col("_lo") <= lo), take)).alias(f"_t_{n}"),
        ]
        part = F.col(f"_p_{n}") - F.floor(f"_p_{n}")
        between = F.col(f"_a_{n}") + (F.col(f"_z_{n}") - F.col(f"_a_{n}")) * part
        cols.append(between.alias(n))
        cols.append(((F.col(f"_s_{n}") + F.col(f"_t_{n}")) / (F.floor(f"_p_{n}") + 1)).alias(f"{n}_tail"))
    return ranked.groupBy(*keys).agg(*aggs).select(*cols)
