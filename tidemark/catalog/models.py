"""Queries on regime models. Fits have no SQL form; they are checked by rows."""

from __future__ import annotations

from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

from ..functions.columns import if_zero, round_doubles
from ..operators import models as md
from ..operators import regimes as rg
from ..operators import selection, strategies, walkforward as wf
from ..operators.features import compute_features
from ..operators.layout import POS
from ..operators.packing import number_complete_rows, pack
from ..session import stage
from ..sources.tables import daily_bars, table
from .features import ORACLES as FEATURE_SQL
from .ingest import selection_sql
from .sqlparts import query
from .strategies import SPLITS

KEYS = ["series_id"]
FEATS = ["ret_log", "vol_close_21d", "ret_21d", "hl_range_pct"]


def scaled_features(spark, sf):
    df = compute_features(daily_bars(spark, sf), "returns", "volatility")
    df = stage(df.withColumn("ret", if_zero(F.col("ret_simple"))).withColumn("raw_ret", F.col("ret")))
    return stage(selection.standardize(df, selection.scaler_table(df, FEATS, KEYS), FEATS, KEYS))


def prepared(spark, sf):
    rows = stage(number_complete_rows(scaled_features(spark, sf), KEYS, FEATS))
    return rows, pack(rows, KEYS, FEATS, "ret")


def _fit(kind, ks=(3,), seeds=(42,), **options):
    def run(spark, sf):
        rows, packed = prepared(spark, sf)
        models = stage(md.model_table(packed, KEYS, list(ks), list(seeds)))
        return rows, packed, getattr(md, f"{kind}_fit")(packed, models, KEYS, len(FEATS), **options)

    return run


def _rest(params):
    """Rounds of every model, and whether it came to rest."""
    return md.summarize(params, KEYS).select("model_id", "rounds", "converged")


def q_kmeans(spark, sf):
    rows, packed, params = _fit("kmeans", seeds=(42, 7, 11))(spark, sf)
    best = md.best_seed(params, KEYS)
    out = md.kmeans_assign(packed, best, KEYS, len(FEATS)).join(best.select("model_id", *KEYS), "model_id")
    return out.groupBy(*KEYS, "state").agg(F.count(F.lit(1)).alias("n"), F.avg(F.array_max("proba")).alias("mean_share"))


def q_gmm(spark, sf):
    _, packed, params = _fit("gmm")(spark, sf)
    out = md.information_criteria(params, "gmm", len(FEATS)).withColumn("converged", ~F.col("active"))
    return out.drop("means", "vars", "start", "trans", "shift", "inv", "active", "scores")


def q_kmeans_conditions(spark, sf):
    """What must vanish at rest: the gap between a centre and the mean of the rows that are nearest to it."""
    rows, packed, params = _fit("kmeans", ks=(2, 3, 4))(spark, sf)
    d = len(FEATS)
    found = md.kmeans_assign(packed, params, KEYS, d).join(params.select("model_id", "k", "means", *KEYS), "model_id")
    placed = rows.withColumnRenamed(POS, "pos").join(found, [*KEYS, "pos"])
    own = placed.groupBy(*KEYS, "k", "state").agg(
        F.count(F.lit(1)).alias("n"), F.array(*[F.avg(c) for c in FEATS]).alias("mean"), F.first(F.slice("means", F.col("state") * d + 1, F.lit(d))).alias("centre")
    )
    gap = F.array_max(F.zip_with("mean", "centre", lambda a, b: F.abs(a - b)))
    return own.groupBy(*KEYS, "k").agg(F.sum("n").alias("n"), F.round(F.max(gap), 3).alias("gap"))


def q_kmeans_starts(spark, sf):
    """Inertia of every start of the seeding; the model is the best one."""
    _, _, params = _fit("kmeans", ks=(2, 3, 4))(spark, sf)
    return params.select(*KEYS, "k", (-F.col("log_likelihood")).alias("inertia"), F.posexplode("scores").alias("start", "_s"), "rounds").select(
        *KEYS, "k", "inertia", "start", (-F.col("_s")).alias("start_inertia"), "rounds"
    )


def q_switching(spark, sf):
    """Switching regressions of 2 and 3 states on the daily return, from 20 starts each."""
    df = scaled_features(spark, sf)
    df = selection.standardize(df, selection.scaler_table(df, ["ret"], KEYS), ["ret"], KEYS)
    packed = pack(stage(number_complete_rows(df, KEYS, ["ret"])), KEYS, ["ret"])
    params = stage(md.msr_fit(packed, stage(md.model_table(packed, KEYS, [2, 3])), KEYS))
    best = F.array_max("scores").alias("best_start")
    table = md.information_criteria(params, "msr", 1).select("model_id", "k", "log_likelihood", "aic", "bic", F.size("scores").alias("starts"), best)
    return md.emission_table(params, KEYS, ["ret"]).drop("feature").join(table, "model_id").join(_rest(params), "model_id")


def q_hmm(spark, sf):
    _, packed, params = _fit("hmm")(spark, sf)
    return md.emission_table(params, KEYS, FEATS).join(_rest(params), "model_id")


def q_hmm_states(spark, sf):
    rows, packed, params = _fit("hmm")(spark, sf)
    states = md.hmm_decode(packed, params, KEYS, len(FEATS)).join(params.select("model_id", *KEYS), "model_id")
    placed = rows.withColumnRenamed(POS, "pos").join(states, [*KEYS, "pos"])
    placed = placed.select(*KEYS, "date", "ret", F.col("state").alias("regime_state"))
    return rg.regime_summary(stage(placed), KEYS, 3)


def q_posterior(spark, sf):
    _, packed, params = _fit("hmm")(spark, sf)
    post = md.hmm_posterior(packed, params, KEYS, len(FEATS))
    total = F.aggregate("proba", F.lit(0.0), lambda a, x: a + x)
    return post.groupBy("model_id").agg(
        F.count(F.lit(1)).alias("n"), F.min(total).alias("least_total"), F.max(total).alias("most_total")
    ).join(md.hmm_score(packed, params, KEYS, len(FEATS)), "model_id").join(_rest(params), "model_id")


def q_sweep(spark, sf):
    return wf.model_sweep(scaled_features(spark, sf), FEATS, KEYS)


def q_best(spark, sf):
    return wf.best_model(wf.model_sweep(scaled_features(spark, sf), FEATS, KEYS), KEYS)


def q_seeds(spark, sf):
    return wf.seed_sensitivity(scaled_features(spark, sf), FEATS, 3, KEYS)


def q_stability(spark, sf):
    states, _ = wf.train_test_stability(scaled_features(spark, sf), FEATS, 3, KEYS)
    return states


def q_walk(spark, sf):
    df = scaled_features(spark, sf)
    out = wf.walk_forward_regimes(df, FEATS, 3, KEYS, first=1260, step=63)
    rets = strategies.strategy_returns(stage(out), KEYS, "raw_close")
    return strategies.backtest_summary(rets, KEYS)


OOS_FEATS = ["ret_log", "ret_21d", "ret_63d", "vol_close_21d", "vol_ratio_5_21", "atr_pct_14", "hl_range_pct"]


def _raw_features(spark, sf):
    return stage(compute_features(daily_bars(spark, sf), "returns", "volatility"))


def q_walk_oos(spark, sf):
    out, _ = wf.walk_forward_oos(_raw_features(spark, sf), OOS_FEATS, 3, KEYS, years=4, months=6)
    return strategies.backtest_summary(strategies.strategy_returns(stage(out), KEYS, "raw_close"), KEYS)


def q_folds(spark, sf):
    _, _, folds = wf.oos_folds(_raw_features(spark, sf), OOS_FEATS, KEYS, years=4, months=6)
    return folds.select(*KEYS, "fold", "train_hi", "test_lo", "test_hi", "lo", F.concat_ws(",", "selected").alias("selected"))


def q_partitions(spark, sf):
    out, _ = wf.oos_partitions(_raw_features(spark, sf), OOS_FEATS, SPLITS, 3, KEYS)
    keys = [*KEYS, "split"]
    return strategies.backtest_summary(strategies.strategy_returns(stage(out), keys, "raw_close"), keys)


def embeddings(spark, sf):
    """Vectors, all coordinates as one array; whole table."""
    e = table(spark, sf, "embeddings")
    return e.select("vec_id", "label", F.transform("embedding", lambda v: v.cast("double")).alias("x"))


def q_embedding_kmeans(spark, sf):
    """One model over one large table: the ML library's k-means, compared with the labels."""
    df = embeddings(spark, sf).withColumn("features", array_to_vector("x"))
    fits = [KMeans(k=4, seed=s, maxIter=100).fit(df) for s in (42, 7)]
    best = min(fits, key=lambda m: m.summary.trainingCost)
    out = stage(best.transform(df).withColumnRenamed("prediction", "state").drop("features"))
    ari = rg.adjusted_rand(out, [], "state", "label")
    sil = md.silhouette_squared(out, [], "state", "x")
    return ari.join(F.broadcast(sil), F.lit(True))


def q_silhouette(spark, sf):
    return round_doubles(md.silhouette_squared(embeddings(spark, sf), [], "label", "x"))


QUERIES = {
    "kmeans_states": q_kmeans,
    "kmeans_starts": q_kmeans_starts,
    "kmeans_conditions": q_kmeans_conditions,
    "gmm_models": q_gmm,
    "switching_fits": q_switching,
    "hmm_emissions": q_hmm,
    "hmm_regime_summary": q_hmm_states,
    "hmm_posterior_check": q_posterior,
    "model_sweep": q_sweep,
    "best_model": q_best,
    "seed_sensitivity": q_seeds,
    "train_test_stability": q_stability,
    "walk_forward_backtest": q_walk,
    "walk_forward_oos_backtest": q_walk_oos,
    "walk_forward_folds": q_folds,
    "oos_partition_backtests": q_partitions,
    "embedding_clusters": q_embedding_kmeans,
    "silhouette_squared": q_silhouette,
}

_feats = ", ".join(OOS_FEATS)
_known = " AND ".join(f"{c} IS NOT NULL" for c in OOS_FEATS)
#: Expanding folds of 4 years and 6 months, and what is selected from the complete rows before each.
_FOLDS = query(
    f"vol AS ({FEATURE_SQL['features_volatility']})", f"ret AS ({FEATURE_SQL['features_returns']})",
    f"x AS (SELECT series_id, date, row_number() OVER (PARTITION BY series_id ORDER BY date) - 1 AS pos, {_feats} FROM vol JOIN ret USING (series_id, date))",
    "cn AS (SELECT series_id, count(*) AS n FROM x GROUP BY 1)",
    """fo AS (SELECT series_id, CAST(i AS INTEGER) AS fold, CASE WHEN n > 1008 THEN 1008 + 126 * i ELSE n END AS train_hi, n
      FROM cn, range(0, 2000) t(i) WHERE 1008 + 126 * i < n OR (n <= 1008 AND i = 0))""",
    f"ok AS (SELECT series_id || '|' || fold AS series_id, {_feats} FROM x JOIN fo USING (series_id) WHERE pos < train_hi AND {_known})",
    *selection_sql(OOS_FEATS, 1e-4, 0.9),
    "fk AS (" + " UNION ALL ".join(f"SELECT series_id AS s, '{c}' AS feature, min(pos) FILTER ({c} IS NOT NULL) AS known FROM x GROUP BY 1" for c in OOS_FEATS) + ")",
    "sl AS (SELECT series_id AS sid, string_agg(feature, ',' ORDER BY i) AS selected, max(known) AS lo FROM chosen JOIN fk USING (feature) "
    "WHERE selected AND s = split_part(series_id, '|', 1) GROUP BY 1)",
    "SELECT series_id, fold, train_hi, train_hi AS test_lo, least(train_hi + 126, n) AS test_hi, lo, selected FROM fo JOIN sl ON sid = series_id || '|' || fold",
).replace("WITH ", "WITH RECURSIVE ", 1)

_vec = "v AS (SELECT vec_id, label, embedding::DOUBLE[] AS x FROM embeddings)"
ORACLES = {
    "kmeans_conditions": query(
        f"vol AS ({FEATURE_SQL['features_volatility']})", f"ret AS ({FEATURE_SQL['features_returns']})",
        "SELECT series_id, CAST(k AS INTEGER) AS k, count(*) AS n, 0.0::DOUBLE AS gap FROM vol JOIN ret USING (series_id, date), range(2, 5) t(k) "
        "WHERE " + " AND ".join(f"{c} IS NOT NULL" for c in FEATS) + " GROUP BY 1, 2",
    ),
    "walk_forward_folds": _FOLDS,
    "silhouette_squared": query(
        _vec,
        "p AS (SELECT a.vec_id, a.label, b.label AS other, a.vec_id = b.vec_id AS self, "
        "list_sum(list_transform(list_zip(a.x, b.x), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) AS d FROM v a, v b)",
        "m AS (SELECT vec_id, label, other, avg(d) FILTER (NOT self) AS md FROM p GROUP BY 1, 2, 3)",
        "s AS (SELECT vec_id, max(md) FILTER (label = other) AS a, min(md) FILTER (label <> other) AS b FROM m GROUP BY 1)",
        "SELECT round(avg((b - a) / greatest(a, b)), 6) + 0.0 AS silhouette FROM s",
    ),
}
