"""Student-t fits of return pools: location, scale and degrees of freedom.

A pass over a pool sums the log likelihood, its gradient and its second
derivatives in location, logarithm of the scale and logarithm of the degrees of
freedom. The update is a Newton step for all three at once; where the likelihood
curves the wrong way the step follows the gradient, and a step that loses
likelihood is halved. Degrees of freedom beyond ``MOST`` mean the normal limit,
which has its parameters in closed form.

Sums can be merged: a pool of up to ``PACK`` rows is fitted inside its task, a
longer one takes one job per pass over its links.
"""

from __future__ import annotations

import math
import sys

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import stage, unstage
from .packing import PACK

cloudpickle.register_pickle_by_value(sys.modules[__name__])

MOST = 1e4  # degrees of freedom; a pool that wants more is normal
LONGEST = 1.0  # step of a logarithm, and of the location in scales
FEW = 4  # rows that are too few for a fit


def digamma(x):
    """Derivative of the logarithm of the gamma function, for positive numbers."""
    x, out = np.array(x, dtype=float), 0.0
    for _ in range(8):
        small = x < 8
        out = out - np.where(small, 1.0 / x, 0.0)
        x = np.where(small, x + 1.0, x)
    y = 1.0 / (x * x)
    return out + np.log(x) - 0.5 / x - y * (1 / 12 - y * (1 / 120 - y * (1 / 252 - y * (1 / 240 - y / 132))))


def log_likelihood(r: np.ndarray, nu: float, loc: float, scale: float) -> float:
    z = (r - loc) / scale
    if math.isinf(nu):
        return float(-0.5 * (z * z).sum() - len(r) * (math.log(scale) + 0.5 * math.log(2 * math.pi)))
    const = math.lgamma((nu + 1) / 2) - math.lgamma(nu / 2) - 0.5 * math.log(nu * math.pi) - math.log(scale)
    return float(len(r) * const - (nu + 1) / 2 * np.log1p(z * z / nu).sum())


# --- one pool: (n, mean, deviation) begin a state, passes move it on ---------

STATE = ["n", "mean", "dev", "nu", "loc", "scale", "last", "step", "ll", "rounds", "phase", "rest"]


def begin(n: int, mean: float, dev: float) -> dict:
    few = n <= FEW or not dev > 0
    scale = dev + 1e-5 if few else max(0.7 * dev, 1e-12)
    return {
        "n": n, "mean": mean, "dev": dev, "nu": 3.0 if few else 5.0, "loc": mean, "scale": scale, "last": [], "step": [],
        "ll": float("-inf"), "rounds": 0, "phase": "score" if few else "fit", "rest": True,
    }


def gather(state: dict, r: np.ndarray) -> np.ndarray:
    """Sums of one pass: the log likelihood and, in a fit, three first and six second derivatives."""
    nu, scale = state["nu"], state["scale"]
    ll = log_likelihood(r, nu, state["loc"], scale)
    if state["phase"] == "score":
        return np.array([ll])
    z = (r - state["loc"]) / scale
    z2 = z * z
    q, over = z2 / nu, nu + z2
    d, n, h = 1 + q, len(r), 1e-4 * nu
    trigamma = lambda x: (digamma(x + h) - digamma(x - h)) / (2 * h)
    slope = 0.5 * (digamma((nu + 1) / 2) - digamma(nu / 2) - 1 / nu - np.log(d) + (nu + 1) * z2 / (nu * over))
    bend = 0.5 * (0.5 * trigamma((nu + 1) / 2) - 0.5 * trigamma(nu / 2) + 1 / nu**2 + q / (nu * d) + z2 * (nu * over - (nu + 1) * (2 * nu + z2)) / (nu * over) ** 2)
    # location in units of the scale
    first = [(nu + 1) * z / (nu * d), (nu + 1) * q / d - 1, nu * slope]
    second = [
        -(nu + 1) / nu * (1 - q) / d**2, -2 * (nu + 1) * z / (nu * d**2), nu * z * (z2 - 1) / over**2,
        -2 * (nu + 1) * q / d**2, nu * z2 * (z2 - 1) / over**2, nu * nu * bend + nu * slope,
    ]
    return np.array([ll] + [x.sum() for x in first + second])


def absorb(state: dict, sums: np.ndarray, max_iter: int, tol: float) -> None:
    """Move on by one pass; ``last`` and ``step`` are the point that the step came from and the step."""
    ll = float(sums[0])
    if state["phase"] == "score":
        state["ll"], state["phase"] = ll, "done"
        return
    state["rounds"] += 1
    if len(state["last"]) and not ll >= state["ll"] - 1e-12 * abs(ll):
        state["step"] = [0.5 * x for x in state["step"]]
        _to(state, state["last"], state["step"])
        return _ended(state, state["step"], max_iter, tol)
    g, (mm, ms, ma, ss, sa, aa) = sums[1:4], sums[4:]
    values, vectors = np.linalg.eigh(np.array([[mm, ms, ma], [ms, ss, sa], [ma, sa, aa]]))
    step = vectors @ ((vectors.T @ g) / np.maximum(np.abs(values), 1e-9 * state["n"]))
    step = step * min(1.0, LONGEST / max(np.abs(step).max(), 1e-300))
    state["ll"], state["last"] = ll, [state["loc"], state["scale"], state["nu"]]
    state["step"] = [float(x) for x in step]
    _to(state, state["last"], state["step"])
    _ended(state, state["step"], max_iter, tol)


def _to(state: dict, at, step) -> None:
    loc, scale, nu = at
    state |= {"loc": float(loc + scale * step[0]), "scale": float(scale * math.exp(step[1])), "nu": float(nu * math.exp(step[2]))}


def _ended(state: dict, step, max_iter: int, tol: float) -> None:
    if state["nu"] > MOST:
        state |= {"nu": math.inf, "loc": state["mean"], "scale": state["dev"], "phase": "score"}
    elif max(map(abs, step)) < tol or state["rounds"] >= max_iter:
        state |= {"phase": "score", "rest": max(map(abs, step)) < tol}


def _row(state: dict) -> dict:
    return {n: state[n] for n in STATE}


# --- Spark ------------------------------------------------------------------


def student_t_fit(pools: DataFrame, keys: list[str], max_iter: int = 200, tol: float = 1e-7, size: int = PACK) -> DataFrame:
    """Degrees of freedom, location and scale per (keys, pool), with the rounds taken and whether they came to rest.

    ``pools`` has (keys, pool, idx, r) with idx from 0 in every pool. Rounds end
    when neither the location, in scales, nor the logarithms of scale and degrees
    of freedom move by ``tol``. Pools of up to 4 rows get 3
    degrees of freedom, their mean and their population deviation plus 1e-5; a
    pool without heavier tails than the normal distribution gets infinity.
    """
    group = [*keys, "pool"]
    links = stage(pools.groupBy(*group, F.floor(F.col("idx") / size).alias("link")).agg(F.collect_list(F.col("r").cast("double")).alias("rs")))
    heads = stage(pools.groupBy(*group).agg(F.count(F.lit(1)).alias("n"), F.avg("r").alias("mean"), F.stddev_pop("r").alias("dev")))
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in heads.select(*group).schema)
    held = f"{kinds}, n long, mean double, dev double, nu double, loc double, scale double, last array<double>, step array<double>, ll double, rounds int, phase string, rest boolean"

    def whole(batches):
        for pdf in batches:
            out = []
            for row in pdf.to_dict("records"):
                state, r = begin(row["n"], row["mean"], row["dev"]), np.asarray(row["rs"], dtype=float)
                while state["phase"] != "done":
                    absorb(state, gather(state, r), max_iter, tol)
                out.append({c: row[c] for c in group} | _row(state))
            if out:
                yield pd.DataFrame(out)

    n_parts = int(pools.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    short = links.join(heads.filter(F.col("n") <= size), group).repartition(n_parts, *group).mapInPandas(whole, held)
    long = heads.filter(F.col("n") > size)
    fit = short if long.isEmpty() else short.unionByName(_long_pools(links, long, group, held, max_iter, tol))
    return fit.select(
        *group, "n", "nu", "loc", "scale", F.col("ll").alias("log_likelihood"), "rounds", F.col("rest").alias("converged")
    )


def _long_pools(links, heads, group, held, max_iter, tol) -> DataFrame:
    """Pools over several links: one job per pass, the states written in between."""

    def start(batches):
        for pdf in batches:
            rows = [{c: row[c] for c in group} | _row(begin(row["n"], row["mean"], row["dev"])) for row in pdf.to_dict("records")]
            if rows:
                yield pd.DataFrame(rows)

    def sums(batches):
        for pdf in batches:
            rows = [{c: row[c] for c in group} | {"sums": gather(row, np.asarray(row["rs"], dtype=float))} for row in pdf.to_dict("records")]
            if rows:
                yield pd.DataFrame(rows)

    def move(states: pd.DataFrame, parts: pd.DataFrame) -> pd.DataFrame:
        out = []
        for row in states.to_dict("records"):
            state = {n: row[n] for n in STATE}
            if len(parts):
                absorb(state, np.sum(np.stack(parts["sums"].to_list()), axis=0), max_iter, tol)
            out.append({c: row[c] for c in group} | state)
        return pd.DataFrame(out, columns=[*group, *STATE])

    kinds = held.split(", n long")[0]
    moving = stage(heads.mapInPandas(start, held))
    while not moving.filter("phase <> 'done'").isEmpty():
        part = links.join(moving.filter("phase <> 'done'"), group).mapInPandas(sums, f"{kinds}, sums array<double>")
        moved = stage(moving.groupBy(*group).cogroup(part.groupBy(*group)).applyInPandas(move, held))
        unstage(moving)
        moving = moved
    return moving
