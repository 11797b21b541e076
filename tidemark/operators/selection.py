"""Feature selection and standardisation without look-ahead."""

from __future__ import annotations

import sys

import numpy as np
import pandas as pd
from pyspark import TaskContext, cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.columns import SALT, SALTS, attach, finite, salted

cloudpickle.register_pickle_by_value(sys.modules[__name__])


def _long(df: DataFrame, features: list[str], keys: list[str]) -> DataFrame:
    """(keys, feature, x): one aggregation then serves any number of features."""
    cells = df.select(*keys, *[F.col(f).cast("double").alias(f) for f in features])
    return cells.unpivot(keys, features, "feature", "x")


def variances(df: DataFrame, features: list[str], keys: list[str] = []) -> DataFrame:
    """Sample variance per feature, long form ``(keys, feature, variance)``."""
    return _long(df, features, keys).groupBy(*keys, "feature").agg(F.var_samp("x").alias("variance"))


# --- moments that can be merged ---------------------------------------------

TIE = 1e-9  # strengths as close as this are equal
KEPT_KEYS = 256  # keys whose moments a task holds before it sends them on


def moments(df: DataFrame, features: list[str], keys: list[str] = []) -> DataFrame:
    """(keys, n, mean, cross) of complete rows: means, and the matrix of centred cross products as one array.

    A task turns its rows into one such triple per key; triples are merged per
    (key, salt) and per key, so a hot key is never one task. Every part is
    centred on its own means, so large levels cost no digits.
    """
    d = len(features)
    rows = df.select(*keys, *[F.col(f).cast("double").alias(f) for f in features]).dropna("any", subset=features)
    kinds = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in rows.select(*keys).schema)
    schema = f"{kinds}part int, n long, mean array<double>, cross array<double>"

    def local(batches):
        held, part = {}, TaskContext.get().partitionId() % SALTS

        def send():
            cells = [(*key, part, n, mean, cross.ravel()) for key, (n, mean, cross) in held.items()]
            held.clear()
            return pd.DataFrame(cells, columns=[*keys, "part", "n", "mean", "cross"])

        for pdf in batches:
            groups = pdf.groupby(keys, dropna=False, sort=False) if keys else [((), pdf)]
            for key, own in groups:
                x = own[features].to_numpy()
                mean = x.mean(0)
                triple = len(x), mean, (x - mean).T @ (x - mean)
                held[key] = _merged(held[key], triple) if key in held else triple
            if len(held) > KEPT_KEYS:
                yield send()
        if held:
            yield send()

    def together(pdf):
        total = None
        for n, mean, cross in zip(pdf["n"], pdf["mean"], pdf["cross"]):
            triple = int(n), np.asarray(mean), np.asarray(cross).reshape(d, d)
            total = triple if total is None else _merged(total, triple)
        head = pdf.iloc[[0]][[*keys, "part"]].copy()
        head["n"], head["mean"], head["cross"] = total[0], [total[1]], [total[2].ravel()]
        return head

    found = rows.mapInPandas(local, schema)
    for by in ([*keys, "part"], [*keys] or [F.lit("all")]):
        found = found.groupBy(*by).applyInPandas(together, schema)
    return found.drop("part")


def _merged(a: tuple, b: tuple) -> tuple:
    """Moments of two disjoint sets of rows."""
    n = a[0] + b[0]
    gap = b[1] - a[1]
    return n, a[1] + gap * (b[0] / n), a[2] + b[2] + np.outer(gap, gap) * (a[0] * b[0] / n)


def _cell(d: int, i, j):
    return F.get("cross", i * d + j)


def correlations(df: DataFrame, features: list[str], keys: list[str] = []) -> DataFrame:
    """Pearson correlations of complete rows, long form ``(keys, a, b, r)``, a before b."""
    d, names = len(features), F.array(*[F.lit(f) for f in features])
    pairs = moments(df, features, keys).select(*keys, "cross", F.posexplode(names).alias("_i", "a"))
    pairs = pairs.select(*keys, "cross", "_i", "a", F.posexplode(names).alias("_j", "b")).filter("_i < _j")
    r = F.try_divide(_cell(d, F.col("_i"), F.col("_j")), F.sqrt(_cell(d, F.col("_i"), F.col("_i")) * _cell(d, F.col("_j"), F.col("_j"))))
    return pairs.select(*keys, "a", "b", r.alias("r"))


def selection_table(df: DataFrame, features: list[str], keys: list[str] = [], var_min: float = 1e-4, corr_max: float = 0.90,
                    correlated: bool = True) -> DataFrame:
    """(keys, selected, dropped): arrays of features, chosen per key from its complete rows.

    Low variance goes first. Then pairs above the correlation limit are walked
    by the later feature and the earlier one; of a pair with both still in, the
    one with the larger mean absolute correlation goes, on a tie the later one.
    If no feature has variance enough, all stay. The walk is a fold over the
    pairs inside each row of moments; nothing comes to the driver.
    """
    d, names = len(features), F.array(*[F.lit(f) for f in features])
    ids = F.sequence(F.lit(0), F.lit(d - 1))
    var = lambda i: F.try_divide(_cell(d, i, i), F.col("n") - 1)
    found = moments(df, features, keys).withColumn("_high", F.filter(ids, lambda i: ~F.coalesce(var(i) < var_min, F.lit(False))))
    size = lambda i, j: F.when(i == j, 1.0).otherwise(F.abs(F.try_divide(_cell(d, i, j), F.sqrt(_cell(d, i, i) * _cell(d, j, j)))))

    def strength(i):
        known = F.filter(F.transform("_high", lambda j: size(i, j)), lambda v: v.isNotNull() & ~F.isnan(v))
        return F.try_divide(F.aggregate(known, F.lit(0.0), lambda a, v: a + v), F.size(known))

    found = found.withColumn("_strength", F.transform(ids, strength))
    later = lambda j: F.transform(F.filter("_high", lambda i: i < j), lambda i: F.struct(j.alias("j"), i.alias("i"), size(i, j).alias("r")))
    pairs = F.filter(F.flatten(F.transform("_high", later)), lambda p: p["r"] > corr_max) if correlated else F.array().cast("array<struct<j:int,i:int,r:double>>")

    def walk(gone, p):
        out = F.when(F.get("_strength", p["i"]) > F.get("_strength", p["j"]) + TIE, p["i"]).otherwise(p["j"])
        return F.when(F.array_contains(gone, p["i"]) | F.array_contains(gone, p["j"]), gone).otherwise(F.concat(gone, F.array(out)))

    found = found.withColumn("_gone", F.aggregate(pairs, F.array().cast("array<int>"), walk))
    low = F.filter(ids, lambda i: ~F.array_contains("_high", i))
    kept = F.filter("_high", lambda i: ~F.array_contains("_gone", i))
    called = lambda some: F.transform(some, lambda i: F.get(names, i))
    flat = F.size("_high") == 0
    return found.select(
        *keys, F.when(flat, names).otherwise(called(kept)).alias("selected"),
        F.when(flat, F.array().cast("array<string>")).otherwise(called(F.concat(low, F.col("_gone")))).alias("dropped"),
    )


def prune(features: list[str], variance: dict[str, float], corr: dict[tuple[str, str], float],
          var_min: float = 1e-4, corr_max: float = 0.90, correlated: bool = True) -> tuple[list[str], list[str]]:
    """The walk of ``selection_table`` over given statistics of one set of rows."""
    low = [f for f in features if variance.get(f) is not None and variance[f] < var_min]
    kept = [f for f in features if f not in low]
    if not kept:
        return list(features), []
    r = lambda a, b: 1.0 if a == b else abs(corr.get((a, b), corr.get((b, a), float("nan"))))
    gone: list[str] = []
    if correlated:
        known = {f: [v for v in (r(f, g) for g in kept) if v == v] for f in kept}
        strength = {f: sum(v) / len(v) for f, v in known.items()}
        for j, later in enumerate(kept):
            for earlier in kept[:j]:
                if r(earlier, later) > corr_max and earlier not in gone and later not in gone:
                    gone.append(earlier if strength[earlier] > strength[later] + TIE else later)
    return [f for f in kept if f not in gone], low + gone


def select_features(df: DataFrame, features: list[str], var_min: float = 1e-4, corr_max: float = 0.90,
                    correlated: bool = True) -> tuple[list[str], list[str]]:
    """Selected and dropped features of all complete rows of ``df``, whatever their key; all stay if there is no such row."""
    found = selection_table(df, features, [], var_min, corr_max, correlated).first()
    return (list(found["selected"]), list(found["dropped"])) if found else (list(features), [])


def scaler_table(df: DataFrame, features: list[str], keys: list[str] = []) -> DataFrame:
    """Mean and population deviation per feature; a deviation below 1e-10 becomes 1.

    Long form ``(keys, feature, mean, scale)``. NULL and infinite cells do not count.
    """
    cells = _long(df, features, keys).withColumn("x", finite(F.col("x")))
    rows = cells.groupBy(*keys, "feature").agg(F.avg("x").alias("mean"), F.stddev_pop("x").alias("scale"))
    return rows.withColumn("scale", F.when(F.col("scale") < 1e-10, 1.0).otherwise(F.col("scale")))


def standardize(df: DataFrame, scaler: DataFrame, features: list[str], keys: list[str] = []) -> DataFrame:
    """(x - mean) / scale with stored parameters; infinite cells become NULL.

    The parameters, one array pair per key, are joined on the keys; without keys
    they are a single row.
    """
    order = F.array_position(F.array(*[F.lit(f) for f in features]), F.col("feature"))
    wide = scaler.filter(F.col("feature").isin(features)).groupBy(*keys).agg(
        F.array_sort(F.collect_list(F.struct(order.alias("i"), "mean", "scale"))).alias("_p")
    )
    joined = df.join(wide, keys, "left") if keys else attach(df, wide)
    scaled = {}
    for i, f in enumerate(features):
        p = F.col("_p")[i]
        scaled[f] = (finite(F.col(f).cast("double")) - p["mean"]) / p["scale"]
    return joined.withColumns(scaled).drop("_p")


def components(df: DataFrame, features: list[str], k: int = 2, keys: list[str] = []) -> DataFrame:
    """(keys, n, mean, scale, values, loadings): principal components of standardised complete rows per key.

    ``values`` are the variances of the ``k`` components, ``loadings`` their
    rows, one after the other. The largest loading of a component is positive,
    which fixes the sign. Keys with fewer than 10 complete rows have none.
    """
    d = len(features)
    found = moments(df, features, keys).filter("n >= 10")
    kinds = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in found.select(*keys).schema)

    def solve(batches):
        for pdf in batches:
            out = pdf[[*keys, "n", "mean"]].copy()
            scales, values, loadings = [], [], []
            for n, cross in zip(pdf["n"], pdf["cross"]):
                cross = np.asarray(cross).reshape(d, d)
                scale = np.sqrt(np.diag(cross) / n)
                scale = np.where(scale < 1e-10, 1.0, scale)
                top, vectors = np.linalg.eigh(cross / np.outer(scale, scale) / (n - 1))
                vectors = vectors.T[::-1][:k]
                largest = np.abs(vectors).argmax(1)
                vectors = vectors * np.where(vectors[np.arange(len(vectors)), largest] < 0, -1.0, 1.0)[:, None]
                scales.append(scale), values.append(top[::-1][:k]), loadings.append(vectors.ravel())
            out["scale"], out["values"], out["loadings"] = scales, values, loadings
            yield out

    schema = f"{kinds}n long, mean array<double>, scale array<double>, values array<double>, loadings array<double>"
    return found.mapInPandas(solve, schema)


def principal_components(df: DataFrame, features: list[str], k: int = 2, keep: list[str] = [], keys: list[str] = []) -> DataFrame:
    """Scores ``pc1`` ... of complete rows on the first ``k`` components of all rows, or of those of their key."""
    d = len(features)
    rows = df.select(*dict.fromkeys([*keys, *keep]), *features).dropna("any", subset=features)
    found = components(df, features, k, keys).select(*keys, "mean", "scale", "loadings")
    if keys:
        rows, found = salted(rows, found)
        rows = rows.join(found, [*keys, SALT]).drop(SALT)
    else:
        rows = attach(rows, found)
    x = F.zip_with(F.zip_with(F.array(*[F.col(f).cast("double") for f in features]), "mean", lambda a, m: a - m), "scale", lambda a, s: a / s)
    rows = rows.withColumn("_x", x)
    score = lambda i: F.aggregate(F.zip_with("_x", F.slice("loadings", i * d + 1, d), lambda a, w: a * w), F.lit(0.0), lambda a, v: a + v)
    return rows.select(*keep, *[score(i).alias(f"pc{i + 1}") for i in range(k)])
