"""Bootstrap paths from return history, stress transforms and path statistics.

Every draw is a hash of (seed, what, key, path, step): it does not depend on the
partitioning and a lost task draws the same again. History is looked up by an
equi-join on a row number, so it may be far larger than one executor.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import SALT, salted, uniform
from ..session import stage
from .layout import POS, date_chunk, index_rows
from .orderstats import linear, pick_ranks, share_rank

ALL_ROWS = -1  # pool of all rows of a key, whatever their state
PATHS_PER_TASK = 256

# fixed values: (volatility factor, daily drift) of the stress scenarios
SCENARIOS = {
    "none": (1.0, 0.0),
    "covid": (2.5, 0.0),
    "selloff_2022": (1.5, -0.0006),
    "inflation_risk_off": (2.0, -0.0010),
}


# --- pools ------------------------------------------------------------------

def return_pools(df: DataFrame, keys: list[str], ret: str = "ret", state: str | None = None, date: str = "date") -> DataFrame:
    """Numbered history ``(keys, pool, idx, r)``: all rows, and the rows of each state."""
    cols = [*keys, date, F.col(ret).alias("r")]
    pools = df.select(*cols, F.lit(ALL_ROWS).alias("pool"))
    if state:
        own = df.filter(F.col(state) >= 0).select(*cols, F.col(state).cast("int").alias("pool"))
        pools = pools.unionByName(own)
    numbered = index_rows(pools, [*keys, "pool"], [date], date_chunk(date))
    return stage(numbered.select(*keys, "pool", F.col(POS).alias("idx"), "r"))


def pool_sizes(pools: DataFrame, keys: list[str]) -> DataFrame:
    return pools.groupBy(*keys, "pool").agg(F.count(F.lit(1)).alias("n"))


def path_ids(heads: DataFrame, n_paths: int) -> DataFrame:
    """One row per path of every head row, spread over tasks in groups of paths."""
    groups = F.sequence(F.lit(0), F.lit((n_paths - 1) // PATHS_PER_TASK))
    spread = heads.withColumn("_g", F.explode(groups)).repartition(*heads.columns, "_g")
    last = F.least((F.col("_g") + 1) * PATHS_PER_TASK, F.lit(n_paths)) - 1
    ids = F.sequence(F.col("_g") * PATHS_PER_TASK, last)
    return spread.withColumn("path", F.explode(ids)).drop("_g")


# --- draws ------------------------------------------------------------------

def _lookup(steps: DataFrame, pools: DataFrame, keys: list[str], seed: int, tag: list[str]) -> DataFrame:
    """Draw one return per step row from its pool; steps carry ``pool``."""
    sized = steps.join(pool_sizes(pools, keys), [*keys, "pool"])
    u = uniform(F.lit(seed), F.lit("draw"), *[F.col(c) for c in (*keys, *tag, "path", "step")])
    drawn = sized.withColumn("idx", F.floor(u * F.col("n"))).drop("n")
    return drawn.join(pools, [*keys, "pool", "idx"]).drop("idx")


def stress(draws: DataFrame, group: list[str], scenario: str = "none", multiplier: float = 1.0) -> DataFrame:
    """Spread the drawn returns around their mean, shift them, keep them above -99.9 %.

    The mean is that of the drawn sample per ``group``; it is aggregated, not
    windowed, because a group is the whole sample of a key.
    """
    if scenario not in SCENARIOS:
        raise ValueError(f"unknown scenario {scenario!r}; one of {list(SCENARIOS)}")
    factor, drift = SCENARIOS[scenario]
    if scenario == "none":
        return draws.withColumn("r", F.greatest("r", F.lit(-0.999)))
    draws = stage(draws)
    means = draws.groupBy(*group).agg(F.avg("r").alias("_mean"))
    moved = (F.col("r") - F.col("_mean")) * (factor * multiplier) + F.col("_mean") + drift * multiplier
    rows, means = salted(draws, means)
    return rows.join(means, [*group, SALT]).withColumn("r", F.greatest(moved, F.lit(-0.999))).drop("_mean", SALT)


def _compound(draws: DataFrame, keys: list[str], tag: list[str]) -> DataFrame:
    """Path values from 1.0 at step 0; a window holds one path, ``horizon`` rows."""
    group = [*keys, *tag, "path"]
    w = Window.partitionBy(*group).orderBy("step").rowsBetween(Window.unboundedPreceding, 0)
    values = draws.select(*group, "step", F.product(F.col("r") + 1.0).over(w).alias("value"))
    start = draws.filter(F.col("step") == 1).select(*group, F.lit(0).alias("step"), F.lit(1.0).alias("value"))
    return values.unionByName(start)


def _steps(paths: DataFrame) -> DataFrame:
    return paths.withColumn("step", F.explode(F.sequence(F.lit(1), F.col("horizon"))))


def bootstrap_paths(
    pools: DataFrame, keys: list[str], n_paths: int, horizons: list[int], pool: int = ALL_ROWS, seed: int = 42,
    scenario: str = "none", multiplier: float = 1.0,
) -> DataFrame:
    """Independent draws from one pool: (keys, horizon, path, step, value).

    ``pool`` is ALL_ROWS or one state. Several horizons run in one job.
    """
    heads = pool_sizes(pools, keys).filter(F.col("pool") == pool).select(
        *keys, "pool", F.explode(F.array(*[F.lit(h) for h in horizons])).alias("horizon")
    )
    steps = _steps(path_ids(heads, n_paths))
    tag = ["horizon"]
    draws = _lookup(steps, pools, keys, seed, tag)
    return _compound(stress(draws, [*keys, "horizon"], scenario, multiplier), keys, tag)


def stressed_matrix(matrix: DataFrame, pools: DataFrame, keys: list[str]) -> DataFrame:
    """Move transition mass to bearish states, those with a negative mean return.

    Rows with less than 0.8 on bearish states keep a fifth of the rest; what is
    left is spread evenly over the bearish states. A state without rows of its
    own takes the mean of all rows.
    """
    means = pools.groupBy(*keys, "pool").agg(F.avg("r").alias("_m"))
    everything = means.filter(F.col("pool") == ALL_ROWS).select(*keys, F.col("_m").alias("_all"))
    cells = (
        matrix.join(means.withColumnRenamed("pool", "to_state"), [*keys, "to_state"], "left")
        .join(everything, keys)
        .withColumn("_bear", F.coalesce("_m", "_all") < 0)
    )
    row = Window.partitionBy(*keys, "from_state")  # as many rows as states
    bear = F.col("_bear")
    cells = cells.withColumns(
        {
            "_on": F.sum(F.when(bear, F.col("p")).otherwise(0.0)).over(row),
            "_off": F.sum(F.when(~bear, F.col("p") * 0.2).otherwise(0.0)).over(row),
            "_k": F.count_if(bear).over(row),
        }
    )
    moved = F.when(bear, (1.0 - F.col("_off")) / F.col("_k")).otherwise(F.col("p") * 0.2)
    p = F.when((F.col("_k") > 0) & (F.col("_on") < 0.8), moved).otherwise(F.col("p"))
    return cells.select(*keys, "from_state", "to_state", p.alias("p"))


# --- statistics of paths ----------------------------------------------------

def path_summaries(paths: DataFrame, keys: list[str]) -> DataFrame:
    """Terminal return and maximum drawdown of every path, the start included."""
    group = [*keys, "horizon", "path"]
    w = Window.partitionBy(*group).orderBy("step").rowsBetween(Window.unboundedPreceding, 0)
    peaks = paths.withColumn("_top", F.max("value").over(w))
    return peaks.groupBy(*group).agg(
        (F.max_by("value", "step") - 1.0).alias("terminal_return"),
        F.min((F.col("value") - F.col("_top")) / (F.col("_top") + 1e-15)).alias("max_drawdown"),
    )


def path_stats(paths: DataFrame, keys: list[str], threshold: float = -0.15) -> DataFrame:
    """Mean, median, tails and drawdown chances per key and horizon."""
    group = [*keys, "horizon"]
    ends = stage(path_summaries(paths, keys))
    r, dd = F.col("terminal_return"), F.col("max_drawdown")
    share = lambda c: F.avg(c.cast("double"))
    plain = ends.groupBy(*group).agg(
        F.count(F.lit(1)).alias("paths_simulated"),
        F.avg(r).alias("expected_return"),
        share(r < 0).alias("probability_of_loss"),
        share(dd < -0.10).alias("probability_of_drawdown_10pct"),
        share(dd < -0.20).alias("probability_of_drawdown_20pct"),
        share(dd < threshold).alias("probability_of_drawdown_custom"),
        F.avg(dd).alias("average_simulated_max_drawdown"),
    )
    picks = {"t5": share_rank(0.05), "t1": share_rank(0.01), "median_return": linear(0.5), "best_5pct_return": linear(0.95)}
    ranks = pick_ranks(ends, group, "terminal_return", picks).select(
        *group, "median_return", "best_5pct_return",
        (-F.abs("t5")).alias("worst_5pct_return"),
        F.abs("t5").alias("Daily_VaR_95"), F.abs("t5_tail").alias("Daily_CVaR_95"),
        F.abs("t1").alias("Daily_VaR_99"), F.abs("t1_tail").alias("Daily_CVaR_99"),
    )
    return plain.join(ranks, group)


def fan(paths: DataFrame, keys: list[str]) -> DataFrame:
    """Percentiles 5, 25, 50, 75 and 95 of the path values at every step."""
    group = [*keys, "horizon", "step"]
    names = {f"fan_{p}": linear(p / 100.0) for p in (5, 25, 50, 75, 95)}
    return pick_ranks(paths, group, "value", names).select(*group, *names)


def terminal_histogram(ends: DataFrame, keys: list[str], bins: int = 50) -> DataFrame:
    """Counts of terminal returns in equal-width bins between their extremes."""
    group = [*keys, "horizon"]
    r = F.col("terminal_return")
    edges = ends.groupBy(*group).agg(F.min(r).alias("lo"), F.max(r).alias("hi"))
    at = F.least(F.floor((r - F.col("lo")) / F.nullif(F.col("hi") - F.col("lo"), F.lit(0.0)) * bins), F.lit(bins - 1))
    rows, edges = salted(ends, edges)
    counts = rows.join(edges, [*group, SALT]).groupBy(*group, SALT, F.coalesce(at, F.lit(0)).alias("bin"), "lo", "hi").count()
    return (
        counts.groupBy(*group, "bin", "lo", "hi").agg(F.sum("count").alias("paths"))
        .withColumn("bin_start", F.col("lo") + (F.col("hi") - F.col("lo")) * F.col("bin") / bins)
        .drop("lo", "hi")
    )
