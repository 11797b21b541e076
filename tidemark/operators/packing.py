"""Feature rows packed into links of bounded length for array work inside tasks.

A packed row holds at most ``PACK`` consecutive rows of one series as one flat
array, so a batch moves to Python in few large cells and a long series is many
links, not one group.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import stage
from .layout import BLK, POS, date_chunk, index_rows

PACK = 16384


def number_complete_rows(df: DataFrame, keys: list[str], features: list[str], date: str = "date") -> DataFrame:
    """Complete rows with positions of their own, 0, 1, 2, ... per key."""
    rows = df.drop(POS, BLK).dropna("any", subset=features)
    return index_rows(rows, keys, [date], date_chunk(date))


def pack(rows: DataFrame, keys: list[str], features: list[str], ret: str | None = None, size: int = PACK) -> DataFrame:
    """(keys, blk, n, xs, rs): ``xs`` holds n times len(features) numbers, row by row.

    Missing features become NaN. ``rs`` holds the returns of the rows, for state
    statistics. Staged, because every round of a fit reads it.
    """
    lost = F.lit(float("nan"))
    x = F.array(*[F.coalesce(F.col(f).cast("double"), lost) for f in features])
    r = F.coalesce(F.col(ret).cast("double"), F.lit(0.0)) if ret else F.lit(0.0)
    cells = F.array_sort(F.collect_list(F.struct(POS, x.alias("x"), r.alias("r"))))
    packed = rows.groupBy(*keys, F.floor(F.col(POS) / size).alias("blk")).agg(cells.alias("_c"))
    return stage(
        packed.select(
            *keys, "blk", F.size("_c").alias("n"),
            F.flatten(F.transform("_c", lambda c: c["x"])).alias("xs"),
            F.transform("_c", lambda c: c["r"]).alias("rs"),
        )
    )


def row_counts(packed: DataFrame, keys: list[str]) -> DataFrame:
    return packed.groupBy(*keys).agg(F.sum("n").cast("long").alias("n_rows"))
