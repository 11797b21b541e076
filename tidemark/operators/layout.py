"""Row positions, blocks and halos: windows that never hold a whole key.

A window over ``partitionBy(series)`` sorts a series in one task. Here a series
is cut into blocks of consecutive positions instead:

* ``index_rows`` numbers the rows of each key. Rows are sorted inside small
  order chunks (calendar spans, value ranges); only the chunk counts, one row
  per chunk, meet in a per-key window.
* ``with_halo`` copies the last rows of a block into the next block, so every
  frame of at most ``halo`` rows is complete inside one (key, block) task.
* ``running`` gives prefix aggregates: a window inside the block plus a carry
  from the block totals.

A task therefore holds at most ``block + halo`` rows of a key, however hot the
key is.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

POS = "_pos"  # 0-based position inside the key
BLK = "_blk"  # block of consecutive positions
OWN = "_own"  # false for halo copies

BLOCK_ROWS = 16384
HALO_ROWS = 4096


def date_chunk(name: str = "date", days: int = 1024) -> Column:
    """Order chunk for a date column: spans of ``days`` calendar days."""
    return F.floor(F.unix_date(F.col(name)) / days)


def index_rows(df: DataFrame, keys: list[str], order: list[str], chunk: Column) -> DataFrame:
    """Add ``_pos``. ``chunk`` must not decrease along ``order``."""
    cut = df.withColumn("_chunk", chunk)
    before = Window.partitionBy(*keys).orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    starts = (
        cut.groupBy(*keys, "_chunk")
        .agg(F.count(F.lit(1)).alias("_n"))
        .select(*keys, "_chunk", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    )
    inside = Window.partitionBy(*keys, "_chunk").orderBy(*order)
    return (
        cut.join(starts, [*keys, "_chunk"])
        .withColumn(POS, F.col("_start") + F.row_number().over(inside) - 1)
        .drop("_chunk", "_start")
    )


def located(df: DataFrame, keys: list[str], date: str = "date") -> DataFrame:
    """Rows with ``_pos``; numbered here only if they do not carry it yet."""
    return df if POS in df.columns else index_rows(df, keys, [date], date_chunk(date))


def cut_blocks(df: DataFrame, block: int | None = None) -> DataFrame:
    """Rows with ``_blk``; a block kept from an earlier step is used as it is."""
    block = block or BLOCK_ROWS
    return df if BLK in df.columns else df.withColumn(BLK, F.floor(F.col(POS) / block))


def with_halo(df: DataFrame, block: int | None = None, halo: int | None = None) -> DataFrame:
    """Add ``_blk`` and ``_own``; the last ``halo`` rows of a block also open the next."""
    block, halo = block or BLOCK_ROWS, halo or HALO_ROWS
    if halo > block:
        raise ValueError("halo must not exceed the block")
    home = F.floor(F.col(POS) / block)
    near_end = F.col(POS) % block >= block - halo
    homes = F.when(near_end, F.array(home, home + 1)).otherwise(F.array(home))
    return df.withColumn(BLK, F.explode(homes)).withColumn(OWN, F.col(BLK) == home)


def drop_halo(df: DataFrame) -> DataFrame:
    """Only the rows a block owns. ``_pos`` and ``_blk`` stay, and with them the
    partitioning, so that later windows on (key, block) need no exchange."""
    return df.filter(OWN).drop(OWN)


def plain(df: DataFrame) -> DataFrame:
    """Without the layout columns."""
    return df.drop(POS, BLK)


def block_window(keys: list[str]):
    return Window.partitionBy(*keys, BLK).orderBy(POS)


def by_position(df: DataFrame, keys: list[str], date: str = "date", **halo: int) -> DataFrame:
    """Positions, blocks and halos for rows ordered by a date column."""
    return with_halo(located(df, keys, date), **halo)


# name -> (aggregate, how a block's carry and its local value combine)
_RUNNING = {
    "sum": (F.sum, lambda carry, local: F.coalesce(carry + local, local, carry)),
    "product": (F.product, lambda carry, local: F.coalesce(carry * local, local, carry)),
    "max": (F.max, lambda carry, local: F.greatest(carry, local)),
    "min": (F.min, lambda carry, local: F.least(carry, local)),
}


def running(df: DataFrame, keys: list[str], outputs: dict[str, tuple[str, str]]) -> DataFrame:
    """Prefix aggregates along ``_pos`` for rows that carry ``_pos`` and ``_blk``.

    ``outputs`` maps a new column to ``(input column, op)`` with op one of sum,
    product, max, min, last. ``last`` is the last non-null value so far, i.e. a
    forward fill. Block totals, not rows, travel to the per-key window.
    """
    inside = block_window(keys).rowsBetween(Window.unboundedPreceding, 0)
    before = Window.partitionBy(*keys).orderBy(BLK).rowsBetween(Window.unboundedPreceding, -1)
    totals, carries, local, merged = [], {}, {}, {}
    for out, (src, op) in outputs.items():
        if op == "last":
            totals.append(F.max_by(src, F.when(F.col(src).isNotNull(), F.col(POS))).alias(f"_t_{out}"))
            carries[f"_c_{out}"] = F.last(f"_t_{out}", ignorenulls=True).over(before)
            local[out] = F.last(src, ignorenulls=True).over(inside)
            merged[out] = F.coalesce(F.col(out), F.col(f"_c_{out}"))
        else:
            agg, join = _RUNNING[op]
            totals.append(agg(src).alias(f"_t_{out}"))
            carries[f"_c_{out}"] = agg(f"_t_{out}").over(before)
            local[out] = agg(src).over(inside)
            merged[out] = join(F.col(f"_c_{out}"), F.col(out))
    carry = (
        df.groupBy(*keys, BLK).agg(*totals).withColumns(carries)
        .select(*keys, BLK, *carries)
    )
    return df.withColumns(local).join(carry, [*keys, BLK]).withColumns(merged).drop(*carries)


def previous(df: DataFrame, keys: list[str], outputs: dict[str, str]) -> DataFrame:
    """Value of the row before along ``_pos``, NULL on a key's first row.

    Also right where rows were filtered out, even whole blocks: each block gets
    the last values of the nearest earlier block that has rows. ``outputs`` maps
    a new column to its input.
    """
    w = block_window(keys)
    before = Window.partitionBy(*keys).orderBy(BLK)
    tail = {o: F.lag(f"_t_{o}").over(before).alias(f"_c_{o}") for o in outputs}
    tails = (
        df.groupBy(*keys, BLK)
        .agg(*[F.max_by(src, POS).alias(f"_t_{o}") for o, src in outputs.items()])
        .select(*keys, BLK, *tail.values())
    )
    lagged = df.withColumn("_first", F.row_number().over(w) == 1).withColumns(
        {o: F.lag(src).over(w) for o, src in outputs.items()}
    )
    cols = {o: F.when(F.col("_first"), F.col(f"_c_{o}")).otherwise(F.col(o)) for o in outputs}
    return (
        lagged.join(tails, [*keys, BLK]).withColumns(cols).drop("_first", *[f"_c_{o}" for o in outputs])
    )
