"""Selection, scaling, models and labels fitted on a past range and used on a later one."""

from __future__ import annotations

import sys

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import if_zero
from ..session import stage
from . import models as md
from . import selection
from .layout import BLK, POS, block_window, date_chunk, drop_halo, index_rows, with_halo
from .packing import PACK, number_complete_rows, pack
from .regimes import (
    DEFAULT_LABEL, WARMUP, WARMUP_LABEL, adjusted_rand, assign_labels, mean_run_length,
)

cloudpickle.register_pickle_by_value(sys.modules[__name__])


# --- folds ------------------------------------------------------------------

def expanding_folds(counts: DataFrame, keys: list[str], first: int, step: int) -> DataFrame:
    """Fold table (keys, fold, train_hi, test_lo, test_hi) from ``(keys, n_rows)``.

    Training always starts at row 0. A series with at most ``first`` rows gets one
    fold over all its rows and an empty test range.
    """
    n = F.col("n_rows")
    ends = F.sequence(F.lit(first).cast("long"), n - 1, F.lit(step).cast("long"))
    ends = F.when(n > first, ends).otherwise(F.array(n))
    rows = counts.select(*keys, "n_rows", F.posexplode(ends).alias("fold", "train_hi"))
    return rows.select(
        *keys, "fold", "train_hi", F.col("train_hi").alias("test_lo"),
        F.least(F.col("train_hi") + step, n).alias("test_hi"),
    )


def fold_models(folds: DataFrame, keys: list[str], k: int | DataFrame, seed: int = 42) -> DataFrame:
    """One model per fold, fitted on [lo, train_hi); ``k`` for all series, or a table (keys, k)."""
    lo = F.col("lo") if "lo" in folds.columns else F.lit(0)
    folds = folds.join(k, keys) if isinstance(k, DataFrame) else folds.withColumn("k", F.lit(k))
    return folds.withColumns(
        {
            "seed": F.lit(seed).cast("long"), "lo": lo.cast("long"), "hi": F.col("train_hi"),
            "model_id": F.concat_ws("|", *keys, "k", F.lit(seed), F.concat(F.lit("fold"), F.col("fold"))),
        }
    ).drop("train_hi", "test_lo", "test_hi", "fold")


def shift_range(params: DataFrame, folds: DataFrame, keys: list[str]) -> DataFrame:
    """Parameters with the row range moved to the fold's test rows."""
    tagged = folds.select(
        *keys, F.concat(F.lit("fold"), F.col("fold")).alias("_f"), "test_lo", "test_hi"
    )
    own = F.element_at(F.split("model_id", r"\|"), -1)
    moved = params.withColumn("_f", own).join(tagged, [*keys, "_f"]).drop("_f")
    return (
        moved.withColumns({"lo": F.greatest("lo", "test_lo"), "hi": F.col("test_hi")})
        .drop("test_lo", "test_hi").filter("lo < hi")
    )


# --- selection and scaling per fold -----------------------------------------

def _moments(d: int, size: int):
    """Counts, sums and cross products of a batch's rows per (series, segment)."""

    def run(batches):
        for pdf in batches:
            for i in range(len(pdf)):
                row = pdf.iloc[i]
                x = np.asarray(row["xs"], dtype=float).reshape(-1, d) - np.asarray(row["base"])
                pos = row["blk"] * size + np.arange(len(x))
                x = x[(pos >= row["seg_lo"]) & (pos < row["seg_hi"])]
                known = ~np.isnan(x)
                whole, filled = x[known.all(1)], np.where(known, x, 0.0)
                flat = [
                    [len(whole)], whole.sum(0), (whole.T @ whole).ravel(),
                    known.sum(0), filled.sum(0), (filled**2).sum(0),
                ]
                yield pd.DataFrame({"sid": [row["sid"]], "seg": [row["seg"]], "s": [np.concatenate(flat).astype(float)]})

    return run


def _choose(features: list[str], var_min: float, corr_max: float, correlated: bool):
    """Selected features, shift and inverse scale per fold, from its moments."""
    d = len(features)
    prune = selection.prune

    def run(batches):
        for pdf in batches:
            out = []
            for i in range(len(pdf)):
                s, base = np.asarray(pdf["s"].iloc[i]), np.asarray(pdf["base"].iloc[i])
                n = s[0]
                sx, sxx = s[1 : 1 + d], s[1 + d : 1 + d + d * d].reshape(d, d)
                cnt, sums, sq = np.split(s[1 + d + d * d :], 3)
                cov = (sxx - np.outer(sx, sx) / max(n, 1)) / max(n - 1, 1)
                var = np.diag(cov)
                with np.errstate(divide="ignore", invalid="ignore"):
                    corr = cov / np.sqrt(np.outer(var, var))
                pairs = {
                    (features[a], features[b]): float(corr[a, b])
                    for a in range(d) for b in range(a + 1, d) if np.isfinite(corr[a, b])
                }
                chosen, _ = prune(features, dict(zip(features, var)), pairs, var_min, corr_max, correlated)
                mean = sums / np.maximum(cnt, 1)
                scale = np.sqrt(np.maximum(sq / np.maximum(cnt, 1) - mean**2, 0.0))
                scale = np.where(scale < 1e-10, 1.0, scale)
                used = np.array([f in set(chosen) for f in features])
                out.append((chosen, mean + base, np.where(used, 1.0 / scale, 0.0)))
            res = pdf.drop(columns=["s", "base"]).copy()
            res["selected"] = [o[0] for o in out]
            res["shift"] = [o[1] for o in out]
            res["inv"] = [o[2] for o in out]
            yield res

    return run


def fold_scaling(
    packed: DataFrame, rows: DataFrame, folds: DataFrame, keys: list[str], features: list[str],
    var_min: float = 1e-4, corr_max: float = 0.90, correlated: bool = True, size: int = PACK,
) -> DataFrame:
    """Folds with ``selected``, ``shift``, ``inv`` and ``lo``, from training rows only.

    Moments are summed once per segment between two fold ends and accumulated
    over the segments, so no row is copied into the folds that contain it. ``lo``
    is the first row at which every selected feature is known.
    """
    d = len(features)
    base = rows.groupBy(*keys).agg(
        F.array(*[F.coalesce(F.avg(f), F.lit(0.0)) for f in features]).alias("base"),
        F.array(*[F.coalesce(F.min(F.when(F.col(f).isNotNull(), F.col(POS))), F.lit(2**62)) for f in features]).alias("known_from"),
    )
    origin = folds["train_lo"] if "train_lo" in folds.columns else F.lit(0)
    before = Window.partitionBy(*keys).orderBy("train_hi")
    segments = folds.select(*keys, origin.cast("long").alias("_o"), "train_hi").distinct().select(
        *keys, F.col("train_hi").alias("seg"),
        F.coalesce(F.lag("train_hi").over(before), F.col("_o")).alias("seg_lo"), F.col("train_hi").alias("seg_hi"),
    ).withColumn("sid", F.concat_ws("|", *keys))
    overlap = (F.col("blk") * size < F.col("seg_hi")) & ((F.col("blk") + 1) * size > F.col("seg_lo"))
    parts = (
        packed.join(segments, keys).filter(overlap).join(base.select(*keys, "base"), keys)
        .select("sid", "seg", "seg_lo", "seg_hi", "blk", "xs", "base")
        .mapInPandas(_moments(d, size), "sid string, seg long, s array<double>")
    )
    cells = parts.select("sid", "seg", F.posexplode("s").alias("i", "v")).groupBy("sid", "seg", "i").agg(F.sum("v").alias("v"))
    upto = Window.partitionBy("sid", "i").orderBy("seg").rowsBetween(Window.unboundedPreceding, 0)
    cells = cells.withColumn("v", F.sum("v").over(upto))
    sums = cells.groupBy("sid", "seg").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("i", "v"))), lambda c: c["v"]).alias("s")
    )
    wanted = (
        folds.withColumn("sid", F.concat_ws("|", *keys))
        .join(sums.withColumnRenamed("seg", "train_hi"), ["sid", "train_hi"]).drop("sid")
        .join(base, keys)
    )
    kinds = {f.name: f.dataType.simpleString() for f in wanted.schema}
    kept = [c for c in wanted.columns if c not in ("s", "base")]
    schema = ", ".join(f"`{c}` {kinds[c]}" for c in kept) + ", selected array<string>, shift array<double>, inv array<double>"
    out = wanted.mapInPandas(_choose(features, var_min, corr_max, correlated), schema)
    late = F.array_max(F.transform(F.arrays_zip("known_from", "inv"), lambda z: F.when(z["inv"] != 0, z["known_from"]).otherwise(0)))
    first = out["train_lo"] if "train_lo" in folds.columns else F.lit(0)
    return out.withColumn("lo", F.greatest(late, first.cast("long"))).drop("known_from")


# --- whole procedures -------------------------------------------------------

def _labels(packed, params, keys, d) -> DataFrame:
    """Label of every state of every model, from its own training rows."""
    stats = md.hmm_state_returns(packed, params, keys, d)
    return assign_labels(stats, ["model_id"], "state").select("model_id", "state", "regime_label")


def walk_forward_regimes(
    df: DataFrame, features: list[str], k: int | DataFrame, keys: list[str] = ["series_id"], ret: str = "ret",
    first: int = 1260, step: int = 63, **fit,
) -> DataFrame:
    """Rows with ``regime_label`` decoded without looking ahead.

    The first ``first`` complete rows carry labels of the fit on themselves
    (``in_sample``); afterwards the model is refitted every ``step`` rows on all
    rows before. Rows with a missing feature get the default label. All folds of
    all series are fitted together.
    """
    rows = stage(number_complete_rows(df, keys, features))
    packed = pack(rows, keys, features, ret)
    counts = packed.groupBy(*keys).agg(F.sum("n").cast("long").alias("n_rows"))
    folds = stage(expanding_folds(counts, keys, first, step))
    models = md.unscaled(fold_models(folds, keys, k), packed)
    d = len(features)
    params = md.hmm_fit(packed, models, keys, d, **fit)
    labels = stage(_labels(packed, params, keys, d))
    opening = params.filter(F.element_at(F.split("model_id", r"\|"), -1) == "fold0")
    seen = md.hmm_decode(packed, opening, keys, d).withColumn("in_sample", F.lit(True))
    later = md.hmm_decode(packed, shift_range(params, folds, keys), keys, d).withColumn("in_sample", F.lit(False))
    named = seen.unionByName(later).join(labels, ["model_id", "state"])
    named = named.join(params.select("model_id", *keys), "model_id")
    placed = rows.select(*keys, "date", F.col(POS).alias("pos")).join(named, [*keys, "pos"], "left")
    placed = placed.select(*keys, "date", F.col("state").alias("regime_state"), "regime_label", "in_sample")
    out = df.drop("regime_state", "regime_label", "in_sample").join(placed, [*keys, "date"], "left")
    return out.withColumns(
        {
            "regime_state": F.coalesce("regime_state", F.lit(WARMUP)),
            "regime_label": F.coalesce("regime_label", F.lit(DEFAULT_LABEL)),
            "in_sample": F.coalesce("in_sample", F.lit(False)),
        }
    )


def _project(rows, packed, params, labels, ranges, keys, d) -> DataFrame:
    """Decode the test ranges and attach states and labels to their rows."""
    states = md.hmm_decode(packed, shift_range(params, ranges, keys), keys, d)
    named = states.join(labels, ["model_id", "state"]).join(params.select("model_id", *keys), "model_id")
    named = named.select(*keys, F.col("pos").alias(POS), F.col("state").alias("_s"), F.col("regime_label").alias("_l"))
    return _placed(rows, named, [*keys, POS])


def _placed(rows: DataFrame, named: DataFrame, on: list[str]) -> DataFrame:
    return rows.join(named, on, "left").withColumns(
        {"regime_state": F.coalesce("_s", F.lit(WARMUP)), "regime_label": F.coalesce("_l", F.lit(WARMUP_LABEL))}
    ).drop("_s", "_l")


def _numbered(df: DataFrame, keys: list[str], price: str) -> DataFrame:
    """All rows, complete or not, with positions and the simple return."""
    rows = index_rows(df.drop(POS, BLK), keys, ["date"], date_chunk("date"))
    if "ret" in rows.columns:
        return stage(rows)
    w = block_window(keys)
    step = F.col(price) / F.lag(price).over(w) - 1.0
    return stage(drop_halo(with_halo(rows, halo=1).withColumn("ret", if_zero(step))).drop(BLK))


def oos_folds(
    df: DataFrame, features: list[str], keys: list[str] = ["series_id"], start: str | None = None,
    years: int = 4, months: int = 6, price: str = "raw_close",
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Numbered rows, packed blocks and the fold table with selection and scaling of every fold; no model.

    A series that is not longer than the training window has one fold with an
    empty test range.
    """
    if start:
        df = df.filter(F.col("date") >= F.lit(start).cast("date"))
    rows = _numbered(df, keys, price)
    counts = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_rows"))
    first, step = years * 252, months * 21
    packed = pack(rows, keys, features, "ret")
    return rows, packed, stage(fold_scaling(packed, rows, expanding_folds(counts, keys, first, step), keys, features))


def walk_forward_oos(
    df: DataFrame, features: list[str], k: int = 3, keys: list[str] = ["series_id"], start: str | None = None,
    years: int = 4, months: int = 6, price: str = "raw_close", **fit,
) -> tuple[DataFrame, DataFrame]:
    """Expanding validation without look-ahead: labelled rows and the fold table.

    Selection, scaling, model and labels of a fold come from its training rows
    alone; the next ``months`` are decoded as their own sequence. The first
    ``years`` stay "Warmup / Undefined", and so does a series without more rows.
    """
    rows, packed, folds = oos_folds(df, features, keys, start, years, months, price)
    d = len(features)
    models = fold_models(folds.filter("test_lo < test_hi"), keys, k).drop("selected")
    params = md.hmm_fit(packed, models, keys, d, **fit)
    labels = stage(_labels(packed, params, keys, d))
    return _project(rows, packed, params, labels, folds, keys, d), folds


def oos_partitions(
    df: DataFrame, features: list[str], splits: dict[str, tuple[str, str]], k: int = 3,
    keys: list[str] = ["series_id"], price: str = "raw_close", **fit,
) -> tuple[DataFrame, DataFrame]:
    """Everything fitted on the first split, all splits decoded: rows and fold table.

    ``splits`` maps a name to its first and last date; the first entry is the
    training split. A row is in every split that holds its date; rows outside
    the splits are dropped.
    """
    names = list(splits)
    inside = lambda s: F.col("date").between(*[F.lit(v).cast("date") for v in splits[s]])
    numbered = _numbered(df, keys, price)
    held = F.filter(F.array(*[F.when(inside(s), F.lit(s)) for s in names]), lambda s: s.isNotNull())
    rows = numbered.withColumn("split", F.explode(held))
    ranges = stage(
        rows.groupBy(*keys, "split")
        .agg(F.min(POS).alias("test_lo"), (F.max(POS) + 1).alias("test_hi"))
    )
    train = ranges.filter(F.col("split") == names[0]).select(
        *keys, F.lit(0).alias("fold"), F.col("test_lo").alias("train_lo"), F.col("test_hi").alias("train_hi"),
        "test_lo", "test_hi",
    )
    packed = pack(numbered, keys, features, "ret")
    folds = stage(fold_scaling(packed, numbered, train, keys, features))
    d = len(features)
    models = fold_models(folds.drop("train_lo"), keys, k).drop("selected")
    params = md.hmm_fit(packed, models, keys, d, **fit)
    labels = stage(_labels(packed, params, keys, d))
    # one decode: every split is a range of its own of the same parameters
    moved = params.join(ranges, keys).withColumns(
        {
            "_base": F.col("model_id"), "model_id": F.concat_ws("|", "model_id", "split"),
            "lo": F.greatest("lo", "test_lo"), "hi": F.col("test_hi"),
        }
    ).filter("lo < hi")
    states = md.hmm_decode(packed, moved, keys, d).join(moved.select("model_id", "_base", "split", *keys), "model_id")
    named = states.join(labels.withColumnRenamed("model_id", "_base"), ["_base", "state"])
    out = _placed(rows, named.select(*keys, "split", F.col("pos").alias(POS), F.col("state").alias("_s"), F.col("regime_label").alias("_l")), [*keys, "split", POS])
    return out, folds


def train_test_stability(
    df: DataFrame, features: list[str], k: int | DataFrame, keys: list[str] = ["series_id"], ret: str = "ret",
    share: float = 0.70, **fit,
) -> tuple[DataFrame, DataFrame]:
    """Fit on the first ``share`` of the complete rows, compare state returns with the rest."""
    rows = stage(number_complete_rows(df, keys, features))
    packed = pack(rows, keys, features, ret)
    n = packed.groupBy(*keys).agg(F.sum("n").cast("long").alias("n"))
    cut = F.floor(F.col("n") * share)
    folds = stage(n.select(*keys, F.lit(0).alias("fold"), cut.alias("train_hi"), cut.alias("test_lo"), F.col("n").alias("test_hi")))
    d = len(features)
    params = md.hmm_fit(packed, md.unscaled(fold_models(folds, keys, k), packed), keys, d, **fit)
    train = md.hmm_state_returns(packed, params, keys, d)
    test = md.hmm_state_returns(packed, shift_range(params, folds, keys), keys, d)
    return stability_report(train, test, params, keys)


def stability_report(train: DataFrame, test: DataFrame, params: DataFrame, keys: list[str]) -> tuple[DataFrame, DataFrame]:
    """State returns in and out of sample side by side, and the verdict per series."""

    def side(df, tag):
        return df.select(
            "model_id", "state", F.col("n").alias(f"{tag}_days"),
            F.col("annualized_return").alias(f"{tag}_annualized_return"),
            F.col("annualized_volatility").alias(f"{tag}_annualized_vol"),
        )

    both = side(train, "train").join(side(test, "test"), ["model_id", "state"], "left").fillna(0)
    gap = lambda c: F.abs(F.col(f"train_annualized_{c}") - F.col(f"test_annualized_{c}"))
    states = both.join(params.select("model_id", *keys), "model_id").withColumns(
        {"return_stability_delta": gap("return"), "vol_stability_delta": gap("vol")}
    ).withColumnRenamed("state", "regime_state")
    verdict = states.groupBy(*keys).agg(
        F.avg("return_stability_delta").alias("average_return_delta"),
        F.avg("vol_stability_delta").alias("average_volatility_delta"),
    )
    stable = (F.col("average_return_delta") < 0.15) & (F.col("average_volatility_delta") < 0.10)
    return states.drop("model_id"), verdict.withColumn("is_stable_oos", stable)


# --- model comparison -------------------------------------------------------

def model_sweep(
    df: DataFrame, features: list[str], keys: list[str] = ["series_id"], ret: str = "ret",
    ks: list[int] = [2, 3, 4, 5, 6], seeds: list[int] = [42], **fit,
) -> DataFrame:
    """Comparison of k-means, mixture, HMM and, up to 3 states, switching models.

    All state counts of all series are fitted together. The silhouette is the
    squared-distance form. k-means reports minus the inertia as likelihood.
    """
    rows = stage(number_complete_rows(df, keys, features))
    d = len(features)
    packed = pack(rows, keys, features, ret)
    models = stage(md.model_table(packed, keys, ks, seeds))
    at = rows.select(*keys, F.col(POS).alias("pos"), *features)

    def quality(params, states, kind, dims):
        placed = states.join(params.select("model_id", *keys), "model_id").join(at, [*keys, "pos"])
        sil = md.silhouette_squared(placed, ["model_id"], "state", features)
        return md.information_criteria(params, kind, dims).join(sil, "model_id", "left")

    def shaped(table, name, duration=None):
        table = table.withColumn("model_type", F.lit(name))
        if duration is None:
            table = table.withColumn("avg_duration", F.lit(1.0))
        if "silhouette" not in table.columns:
            table = table.withColumn("silhouette", F.lit(0.0))
        return table.select(
            *keys, "model_type", F.col("k").alias("n_components"), "seed", "log_likelihood", "aic", "bic",
            F.coalesce("silhouette", F.lit(0.0)).alias("silhouette_score"), "avg_duration", "rounds",
            (~F.col("active")).alias("converged"),
        )

    # each model starts from the one before, as ``hmm_fit`` alone would fit them
    steps = {"kmeans": fit.get("kmeans_iter", 100), "gmm": fit.get("gmm_iter", 100)}
    last = {n: fit[n] for n in ("max_iter", "tol") if n in fit}
    km = md.kmeans_fit(packed, models, keys, d, steps["kmeans"])
    gm = md.gmm_fit(packed, models, keys, d, steps["gmm"], start=km)
    hm = md.hmm_fit(packed, models, keys, d, start=gm, **last)
    decoded = stage(md.hmm_decode(packed, hm, keys, d))
    # positions serve as the order of the decoded rows
    runs = decoded.withColumnRenamed("pos", POS).withColumn("date", F.lit(None).cast("date"))
    runs = mean_run_length(runs, ["model_id"], "state")
    tables = [
        shaped(quality(gm, md.gmm_assign(packed, gm, keys, d), "gmm", d), "GMM"),
        shaped(quality(km, md.kmeans_assign(packed, km, keys, d), "kmeans", d), "KMeans"),
        shaped(quality(hm, decoded, "hmm", d).join(runs, "model_id", "left"), "HMM", "avg_duration"),
    ]
    small = [k for k in ks if k <= 3]
    if small:
        scaled = selection.standardize(rows, selection.scaler_table(rows, [ret], keys), [ret], keys)
        single = pack(scaled, keys, [ret], ret)
        ms = md.msr_fit(single, stage(md.model_table(single, keys, small, seeds)), keys, **last)
        # likelihood of the unscaled returns: the scaling adds n * ln(scale)
        scale = rows.groupBy(*keys).agg(F.stddev_pop(ret).alias("_sd"))
        ms = ms.join(scale, keys).withColumn(
            "log_likelihood", F.col("log_likelihood") - (F.col("hi") - F.col("lo")) * F.log("_sd")
        )
        tables.append(shaped(md.information_criteria(ms, "msr", 1), "MSR"))
    out = tables[0]
    for t in tables[1:]:
        out = out.unionByName(t)
    return out


def best_model(comparison: DataFrame, keys: list[str] = ["series_id"], override: tuple[str, int] | None = None) -> DataFrame:
    """Per series the HMM with the lowest BIC, else the mixture; or the given choice."""
    if override:
        kind, k = override
        pool = comparison.filter((F.col("model_type") == kind) & (F.col("n_components") == k))
        order = F.struct("bic", "n_components")
    else:
        pool = comparison.filter(F.col("model_type").isin("HMM", "GMM"))
        order = F.struct((F.col("model_type") != "HMM").alias("_other"), "bic", "n_components")
    rest = [c for c in comparison.columns if c not in keys]
    return pool.groupBy(*keys).agg(F.min_by(F.struct(*rest), order).alias("_b")).select(*keys, "_b.*")


def seed_sensitivity(
    df: DataFrame, features: list[str], k: int, keys: list[str] = ["series_id"], base: int = 42,
    seeds: list[int] = [100, 2026, 999, 123, 777], **fit,
) -> DataFrame:
    """Mean adjusted Rand index of refits with other seeds against the base seed."""
    rows = number_complete_rows(df, keys, features)
    packed = pack(rows, keys, features)
    d = len(features)
    params = md.hmm_fit(packed, stage(md.model_table(packed, keys, [k], [base, *seeds])), keys, d, **fit)
    states = stage(md.hmm_decode(packed, params, keys, d).join(params.select("model_id", "seed", *keys), "model_id"))
    first = states.filter(F.col("seed") == base).select(*keys, "pos", F.col("state").alias("base_state"))
    pairs = states.filter(F.col("seed") != base).join(first, [*keys, "pos"])
    ari = adjusted_rand(pairs, [*keys, "seed"], "state", "base_state")
    return ari.groupBy(*keys).agg(F.avg("ari").alias("mean_ari"), F.min("ari").alias("min_ari"))
