"""Exponentially weighted means as two window passes.

y_t = (1 - a) y_{t-1} + a x_t is a recursion. Inside a short stretch of rows it
has the closed form q^j * sum(u_i q^-i) with q = 1 - a, and the stretches before
it enter through their last value times a power of q. Stretches older than
``_REACH`` weigh less than 1e-17 and are left out.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import layout
from .layout import BLK, POS, block_window

STRETCH = 128  # 0.8 ** -128 is about 2.5e12, still far from losing digits
_REACH = 39.0  # e**-39 is below 1e-17


def from_span(span: int) -> float:
    return 2.0 / (span + 1)


def memory_rows(alpha: float) -> int:
    """Rows after which a value weighs less than 1e-17 in the mean."""
    return math.ceil(_REACH / -math.log(1.0 - alpha))


def _power(q: float, exponent: Column) -> Column:
    return F.exp(exponent * math.log(q))


def _decay(step: float):
    return lambda acc, x: acc * step + x


def add_ewm(
    df: DataFrame, keys: list[str], outputs: dict[str, tuple[str, float, int]]
) -> DataFrame:
    """Add weighted means. ``outputs``: new column -> (input, alpha, first position).

    The first position is that of the series' first non-null input (0 for
    prices, 1 for returns); rows before it stay NULL. Needs ``_pos``, ``_blk``
    and a halo as long as the memory of the mean: 3,900 rows for a span of 200,
    so that what lies before the halo weighs less than 1e-17.
    """
    slowest = min(alpha for _, alpha, _ in outputs.values())
    memory = memory_rows(slowest)
    if memory > layout.HALO_ROWS:
        raise ValueError(f"the weighted mean remembers {memory} rows, the halo has {layout.HALO_ROWS}")
    part = [*keys, BLK]
    rows = df.withColumn("_st", F.floor(F.col(POS) / STRETCH)).withColumn("_j", F.col(POS) % STRETCH)
    inside = Window.partitionBy(*part, "_st").orderBy(POS).rowsBetween(Window.unboundedPreceding, 0)
    local = {}
    for out, (src, alpha, first) in outputs.items():
        q = 1.0 - alpha
        u = F.when(F.col(POS) == first, F.col(src)).otherwise(F.col(src) * alpha)
        scaled = F.coalesce(u, F.lit(0.0)) * _power(q, -F.col("_j"))
        local[out] = F.sum(scaled).over(inside) * _power(q, F.col("_j"))
    earlier = block_window(keys).rowsBetween(Window.unboundedPreceding, -1)
    last = F.col("_j") == STRETCH - 1
    tails = {f"_t_{out}": F.collect_list(F.when(last, F.col(out))).over(earlier) for out in outputs}
    merged = {}
    for out, (_, alpha, first) in outputs.items():
        q = 1.0 - alpha
        step = q**STRETCH
        reach = max(1, math.ceil(_REACH / (-STRETCH * math.log(q))))
        t = F.col(f"_t_{out}")
        recent = F.slice(t, F.greatest(F.size(t) - reach + 1, F.lit(1)), F.lit(reach))
        carry = F.aggregate(recent, F.lit(0.0), _decay(step))
        merged[out] = F.when(
            F.col(POS) >= first, F.col(out) + carry * _power(q, F.col("_j") + 1)
        )
    return rows.withColumns(local).withColumns(tails).withColumns(merged).drop("_st", "_j", *tails)
