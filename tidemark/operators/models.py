"""Regime models of many series at once: k-means, Gaussian mixture, Gaussian HMM, switching regression.

One model is one row of a model table (series, number of states, seed, row
range). Its rows come in links of at most ``PACK`` rows (``packing.py``).

A fit alternates passes over the rows with small updates (``em.py``). A model
whose range is one link needs no exchange between its passes: its task goes on
until the fit rests, and all such models of a table are one job. A model over
several links advances by one job per pass: tasks sum up their links, sums meet
per model, the new state is written. Models that have come to rest leave the
job with their links. Both ways call the same functions on the same sums.

The HMM recursions run along a series, yet no task walks a long series. Every
link gives the product of its step matrices; the short chain of products yields
the state vectors at the link borders; then all links are independent. Inside a
link its blocks do the same, all blocks of a link at once.
"""

from __future__ import annotations

import pickle
import sys
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.columns import SALT, salted
from ..session import stage, unstage
from . import em
from . import kernels as kn
from .em import MIN_COVAR, REG_COVAR  # noqa: F401
from .packing import PACK

# task functions travel by value: executors need no copy of this package
cloudpickle.register_pickle_by_value(kn)
cloudpickle.register_pickle_by_value(em)
cloudpickle.register_pickle_by_value(sys.modules[__name__])

CHAIN = 512  # links per walk along the chain of link products
KMEANS_STARTS = 10
SWITCHING_STARTS = 20


def model_table(packed: DataFrame, keys: list[str], ks: list[int] | DataFrame, seeds: list[int] = [42]) -> DataFrame:
    """One model per series, state count and seed, over all rows of the series.

    ``ks``: state counts of every series, or a table (keys, k) with its own ones.
    """
    own = isinstance(ks, DataFrame)
    counts = [F.col("k")] if own else [F.lit(k) for k in ks]
    combos = F.array(*[F.struct(k.alias("k"), F.lit(s).cast("long").alias("seed")) for k in counts for s in seeds])
    rows = packed.groupBy(*keys).agg(F.sum("n").cast("long").alias("hi"))
    rows = rows.join(ks.select(*keys, "k"), keys) if own else rows
    rows = rows.select(*keys, F.lit(0).cast("long").alias("lo"), "hi", F.inline(combos))
    return unscaled(rows.withColumn("model_id", F.concat_ws("|", *keys, "k", "seed", "hi")), packed)


def unscaled(models: DataFrame, packed: DataFrame) -> DataFrame:
    """Models that take the packed features as they are."""
    width = packed.select((F.size("xs") / F.col("n")).cast("int").alias("d")).first()["d"]
    return models.withColumns(
        {"shift": F.array_repeat(F.lit(0.0), width), "inv": F.array_repeat(F.lit(1.0), width)}
    )


def _blocks(packed: DataFrame, models: DataFrame, keys: list[str], size: int) -> DataFrame:
    """Blocks of every model: those that overlap its row range."""
    overlap = (F.col("blk") * size < F.col("hi")) & ((F.col("blk") + 1) * size > F.col("lo"))
    return packed.join(models, keys).filter(overlap)


def _rows_of(row, d: int, size: int) -> kn.Rows:
    return kn.rows_of(row["xs"], int(row["n"]), int(row["blk"]), size, d, int(row["lo"]), int(row["hi"]), row["shift"], row["inv"])


def _each(pdf: pd.DataFrame) -> Iterator[dict]:
    """Rows of a batch as dictionaries."""
    names = list(pdf.columns)
    for values in zip(*(pdf[c].to_numpy() for c in names)):
        yield dict(zip(names, values))


def _n_links(size: int):
    return F.floor((F.col("hi") - 1) / size) - F.floor(F.col("lo") / size) + 1


def _levels(params: DataFrame, size: int) -> int:
    """How often link products must be joined until the longest range is one walk; 0: every range is one link."""
    most, levels = params.agg(F.max(_n_links(size))).first()[0] or 0, 0
    while most > 1:
        most, levels = -(-most // CHAIN), levels + 1
    return levels


# --- chains of links --------------------------------------------------------

_MATS = "model_id string, blk long, start array<double>, m array<double>, scale array<double>"
_BORDER = "model_id string, blk long, entry array<double>, exit array<double>, last int, log_likelihood array<double>"


def _square(cells: list, s: int, k: int) -> np.ndarray:
    return np.stack([np.asarray(c, dtype=float) for c in cells]).reshape(len(cells), s, k, k)


def _sizes(row) -> tuple[int, int]:
    """Starts and states from the lengths of a row's scales and openings."""
    s = len(row["scale"])
    return s, len(row["start"]) // s


def _walk(pdf: pd.DataFrame, best: bool) -> pd.DataFrame:
    """Border vectors along one chain of link matrices, for all starts of a model.

    The chain starts at ``entry`` and ends at ``exit`` (probabilities) or at the
    state ``last`` (best path; -1 picks the best one).
    """
    pdf = pdf.sort_values("blk")
    s, k = _sizes(pdf.iloc[0])
    ms = _square(list(pdf["m"]), s, k)
    entry = np.asarray(pdf["entry"].iloc[0], dtype=float).reshape(s, k)
    if best:
        entries, v = [], entry[0]
        for m in ms[:, 0]:
            entries.append(v)
            v = (v[:, None] + m).max(0)
        lasts, now = [0] * len(ms), int(pdf["last"].iloc[0])
        now = int(v.argmax()) if now < 0 else now
        for i in range(len(ms) - 1, -1, -1):
            lasts[i] = now
            now = int((entries[i] + ms[i, 0][:, now]).argmax())
        exits, ll = entries, np.zeros(1)
    else:
        scale = np.stack([np.asarray(c, dtype=float) for c in pdf["scale"]], 1)
        into, out, ll = em.borders(ms.swapaxes(0, 1), scale, entry, np.asarray(pdf["exit"].iloc[0], dtype=float).reshape(s, k))
        entries, exits, lasts = list(into.swapaxes(0, 1)), list(out.swapaxes(0, 1)), [0] * len(ms)
    return pd.DataFrame(
        {
            "model_id": pdf["model_id"].to_numpy(), "blk": pdf["blk"].to_numpy(), "entry": [np.ravel(e) for e in entries],
            "exit": [np.ravel(e) for e in exits], "last": lasts, "log_likelihood": [ll] * len(ms),
        }
    )


def _link(pdf: pd.DataFrame, best: bool) -> pd.DataFrame:
    """One matrix for a run of link matrices."""
    pdf = pdf.sort_values("blk")
    s, k = _sizes(pdf.iloc[0])
    ms = _square(list(pdf["m"]), s, k)
    out, log = ms[0], np.asarray(pdf["scale"].iloc[0], dtype=float)
    for m, c in zip(ms[1:], list(pdf["scale"])[1:]):
        if best:
            out = (out[:, :, :, None] + m[:, None]).max(2)
        else:
            out = out @ m
            top = out.max((1, 2))
            out, log = out / top[:, None, None], log + np.asarray(c, dtype=float) + np.log(top)
    head = pdf.iloc[[0]][["model_id", "start"]].copy()
    head["blk"], head["m"], head["scale"] = int(pdf["sup"].iloc[0]), [out.ravel()], [log]
    return head[["model_id", "blk", "start", "m", "scale"]]


def _borders(mats: DataFrame, best: bool, levels: int) -> DataFrame:
    """Entry and exit vectors of every link.

    ``CHAIN`` links make one of the next level, until a range is one walk of at
    most CHAIN steps; then every run is walked inside. No task holds more than
    one run, however long a series is.
    """
    opening = F.transform("start", lambda p: F.log(p + kn.EPS) if best else p + kn.EPS)
    closing = F.transform("start", lambda p: F.lit(1.0))
    walk = lambda pdf: _walk(pdf, best)

    if levels <= 1:
        ends = mats.withColumns({"entry": opening, "exit": closing, "last": F.lit(-1)})
        return ends.groupBy("model_id").applyInPandas(walk, _BORDER)
    mats = mats.withColumn("sup", F.floor(F.col("blk") / CHAIN))
    links = mats.groupBy("model_id", "sup").applyInPandas(lambda pdf: _link(pdf, best), _MATS)
    outer = _borders(links, best, levels - 1).withColumnRenamed("blk", "sup").withColumnRenamed("log_likelihood", "_ll")
    total = outer.groupBy("model_id").agg(F.first("_ll").alias("_ll"))
    inner = mats.join(outer.drop("_ll"), ["model_id", "sup"]).groupBy("model_id", "sup").applyInPandas(walk, _BORDER)
    return inner.drop("log_likelihood").join(total, "model_id").withColumnRenamed("_ll", "log_likelihood")


def _matrices(blocks: DataFrame, d: int, size: int, current: Callable, best: bool) -> DataFrame:
    """Matrices and log scales of every link; ``current`` gives (means, vars, start, trans) of a row's starts, or None."""

    def run(batches):
        for pdf in batches:
            out = []
            for row in _each(pdf):
                found = current(row)
                if found is None:
                    continue
                means, vars_, start, trans = found
                rows = _rows_of(row, d, size)
                if best:
                    log_trans = np.log(trans[0] + kn.EPS)
                    w = kn.best_chain(em.densities(rows, means, vars_), np.tile(log_trans, (len(rows.x), 1, 1)), rows.ok, rows.first)
                    m, log = w[0], np.zeros(1)
                    for step in w[1:]:
                        m = (m[:, :, None] + step[None]).max(1)
                else:
                    ms, scale = em.products(rows, means, vars_, trans)
                    m, log = ms[:, 0], scale[:, 0]
                    for i in range(1, ms.shape[1]):
                        m = m @ ms[:, i]
                        top = m.max((1, 2))
                        m, log = m / top[:, None, None], log + scale[:, i] + np.log(top)
                out.append((row["model_id"], row["blk"], start.ravel(), m.ravel(), log))
            yield pd.DataFrame(out, columns=["model_id", "blk", "start", "m", "scale"])

    return blocks.mapInPandas(run, _MATS)


# --- fits -------------------------------------------------------------------

_INPUT = ["model_id", "k", "lo", "hi", "shift", "inv", "blk", "n", "xs"]
_FITTED = (
    "means array<double>, vars array<double>, start array<double>, trans array<double>, "
    "log_likelihood double, active boolean, rounds int, scores array<double>"
)
_THETA = ["means", "vars", "start", "trans"]


def _result(state: dict) -> dict:
    theta = state["theta"]
    return {n: np.ravel(theta[n]) for n in _THETA} | {
        "log_likelihood": state["ll"], "active": not state["rest"], "rounds": state["rounds"], "scores": np.asarray(state["scores"], dtype=float),
    }


def _settings(phases, limits, starts, floor=MIN_COVAR, **more) -> dict:
    return {"phases": phases, "limits": limits, "starts": starts, "floor": floor, "more": more}


def _begun(row: dict, d: int, settings: dict) -> dict:
    theta = {n: row[n] for n in _THETA} if "means" in row else None
    return em.begin(
        int(row["k"]), d, int(row["seed"]), settings["phases"], settings["starts"], settings["limits"], theta, settings["floor"], **settings["more"]
    )


def _fit(packed: DataFrame, models: DataFrame, keys: list[str], d: int, size: int, settings: dict) -> DataFrame:
    """Fitted parameters of every model that has rows.

    ``models`` may carry parameters to begin with.
    """
    base = [c for c in models.columns if c not in ("log_likelihood", "active", "rounds", "scores")]
    models = models.select(base)
    own = [c for c in base if c not in _THETA]
    kinds = {f.name: f.dataType.simpleString() for f in models.schema}
    schema = ", ".join(f"`{c}` {kinds[c]}" for c in own) + ", " + _FITTED
    n_parts = int(packed.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def whole(batches):
        for pdf in batches:
            out = []
            for row in _each(pdf):
                state, rows = _begun(row, d, settings), _rows_of(row, d, size)
                while state["phase"] != "done":
                    em.absorb(state, em.gather(state, rows))
                out.append({c: row[c] for c in own} | _result(state))
            if out:
                yield pd.DataFrame(out)

    alone = _blocks(packed, models.filter(_n_links(size) <= 1), keys, size)
    alone = alone.select(*base, "blk", "n", "xs").repartition(n_parts, "model_id").mapInPandas(whole, schema)
    levels = _levels(models, size)
    if not levels:
        return stage(alone)
    return stage(alone.unionByName(_fit_long(packed, models.filter(_n_links(size) > 1), keys, d, size, settings, levels, own, schema)))


def _fit_long(packed, models, keys, d, size, settings, levels, own, schema) -> DataFrame:
    """Models over several links: one job per pass, the states written in between."""
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in models.select(own).schema)
    held = f"{kinds}, phase string, state binary"

    def packed_state(row: dict, state: dict) -> dict:
        return {c: row[c] for c in own} | {"phase": state["phase"], "state": pickle.dumps(state)}

    def begin(batches):
        for pdf in batches:
            rows = [packed_state(row, _begun(row, d, settings)) for row in _each(pdf)]
            if rows:
                yield pd.DataFrame(rows)

    moving = stage(models.mapInPandas(begin, held))
    links = packed.join(models.select(*keys).distinct(), keys, "left_semi")
    ends = settings["phases"][-1]
    while True:
        phases = {r["phase"] for r in moving.select("phase").distinct().collect()}
        if phases <= {"done"}:
            break
        chained = "hmm" in phases or ("score" in phases and ends == "hmm")
        moved = stage(_pass(links, moving, keys, d, size, levels, chained, held, own))
        unstage(moving)
        moving = moved

    def finish(batches):
        for pdf in batches:
            rows = [{c: row[c] for c in own} | _result(pickle.loads(row["state"])) for row in _each(pdf)]
            if rows:
                yield pd.DataFrame(rows)

    return moving.mapInPandas(finish, schema)


def _pass(links, moving, keys, d, size, levels, chained: bool, held: str, own: list[str]) -> DataFrame:
    """One pass over the links of the models that still move, and their new states."""
    blocks = _blocks(links, moving.filter("phase <> 'done'"), keys, size).select(*_INPUT, "state")

    def current(row):
        state = pickle.loads(row["state"])
        kind = state["plan"][-1] if state["phase"] == "score" else state["phase"]
        return em.current(state, np.flatnonzero(state["active"]) if state["phase"] == "hmm" else np.arange(1)) if kind == "hmm" else None

    if chained:
        mats = _matrices(blocks, d, size, current, best=False)
        blocks = blocks.join(_borders(mats, False, levels).drop("last"), ["model_id", "blk"], "left")

    def gather(batches):
        sums = {}
        for pdf in batches:
            for row in _each(pdf):
                state, ends = pickle.loads(row["state"]), []
                if chained and row["entry"] is not None:
                    ll = np.asarray(row["log_likelihood"], dtype=float)
                    ends = [np.asarray(row[c], dtype=float).reshape(len(ll), -1) for c in ("entry", "exit")] + [ll]
                found = em.gather(state, _rows_of(row, d, size), *ends)
                mid = row["model_id"]
                sums[mid] = em.merge(sums[mid], found) if mid in sums else found
        if sums:
            yield pd.DataFrame({"model_id": list(sums), "sums": [pickle.dumps(v) for v in sums.values()]})

    sums = blocks.mapInPandas(gather, "model_id string, sums binary")

    def absorb(models: pd.DataFrame, parts: pd.DataFrame) -> pd.DataFrame:
        out = []
        for row in _each(models):
            state, total = pickle.loads(row["state"]), None
            for part in parts["sums"]:
                part = pickle.loads(part)
                total = part if total is None else em.merge(total, part)
            if total is not None:
                em.absorb(state, total)
            out.append({c: row[c] for c in own} | {"phase": state["phase"], "state": pickle.dumps(state)})
        return pd.DataFrame(out, columns=[*own, "phase", "state"])

    return moving.groupBy("model_id").cogroup(sums.groupBy("model_id")).applyInPandas(absorb, held)


def kmeans_fit(packed, models, keys, d, max_iter=100, tol=1e-4, size=PACK, starts=KMEANS_STARTS) -> DataFrame:
    """k-means for every model; ``log_likelihood`` is minus the inertia, ``scores`` that of every start.

    Every start draws candidates in rounds of weighted races (rows far from what
    was drawn win), weighs them by the rows that are near, and takes the k
    centres of the weighted candidates.
    """
    return _fit(packed, models, keys, d, size, _settings(["seed", "kmeans"], {"kmeans": (max_iter, tol)}, starts))


def best_seed(params: DataFrame, keys: list[str]) -> DataFrame:
    """Per series, state count and range the seed with the highest likelihood."""
    group = [*keys, "k", "lo", "hi"]
    rest = [c for c in params.columns if c not in group]
    # seeds are a handful per group; max_by keeps one row without collecting them
    return params.groupBy(*group).agg(
        F.max_by(F.struct(*rest), F.struct("log_likelihood", -F.col("seed"))).alias("_b")
    ).select(*group, "_b.*")


def gmm_fit(packed, models, keys, d, max_iter=100, tol=1e-3, size=PACK, kmeans_iter=100, start=None, starts=KMEANS_STARTS) -> DataFrame:
    """Diagonal Gaussian mixtures, started from k-means (``start``, or fitted here).

    ``tol`` bounds the change of the mean log likelihood of a row.
    """
    limits = {"kmeans": (kmeans_iter, 1e-4), "gmm": (max_iter, tol)}
    phases = ["seed", "kmeans", "gmm"] if start is None else ["gmm"]
    return _fit(packed, models if start is None else start, keys, d, size, _settings(phases, limits, starts))


def hmm_fit(packed, models, keys, d, max_iter=100, tol=1e-3, size=PACK, gmm_iter=100, kmeans_iter=100, start=None,
            starts=KMEANS_STARTS) -> DataFrame:
    """Diagonal Gaussian HMMs by Baum-Welch, started from mixtures (``start``, or fitted here).

    Start probabilities are uniform, transitions uniform with a bias to stay.
    """
    limits = {"kmeans": (kmeans_iter, 1e-4), "gmm": (gmm_iter, 1e-3), "hmm": (max_iter, tol)}
    phases = ["seed", "kmeans", "gmm", "hmm"] if start is None else ["hmm"]
    return _fit(packed, models if start is None else start, keys, d, size, _settings(phases, limits, starts))


def msr_fit(packed, models, keys, max_iter=100, tol=1e-3, size=PACK, starts=SWITCHING_STARTS) -> DataFrame:
    """Switching mean and variance of one return column, as a regression on a constant.

    The chain begins in the stationary distribution of its transitions.
    ``starts`` drawn points are taken through one round of k-means and then move
    side by side by EM; one that has come to rest leaves the passes, and the
    best of all is the model (``scores`` has the likelihood of each). Returns
    are scaled to unit variance before packing by the caller (``standardize``).
    """
    limits = {"kmeans": (1, 0.0), "hmm": (max_iter, tol)}
    return _fit(packed, models, keys, 1, size, _settings(["seed", "kmeans", "hmm"], limits, starts, 1e-6, steady=True, many=True))


def em_round(kind: str, packed, params, keys, d, size=PACK) -> DataFrame:
    """One round of ``kind`` (kmeans, gmm, hmm) from the parameters as they are; the likelihood is that of the new ones."""
    return _fit(packed, params, keys, d, size, _settings([kind], {kind: (1, 0.0)}, 1, given=True))


# --- using the models -------------------------------------------------------

_PROBA = "model_id string, pos long, state int, proba array<double>"


def _theta(row: dict, d: int) -> tuple:
    """(means, vars, start, trans) of a parameter row, with a first axis of one start."""
    k = int(row["k"])
    return tuple(np.asarray(row[n], dtype=float).reshape(1, *shape) for n, shape in em.shapes(k, d).items())


def _by_rows(rows: kn.Rows, model_id: str, states=None, proba=None) -> pd.DataFrame:
    """One output row per row that the model uses."""
    out = {"model_id": model_id, "pos": rows.pos[rows.ok]}
    if states is not None:
        out["state"] = states[rows.ok]
    if proba is not None:
        out["proba"] = list(proba[rows.ok])
    return pd.DataFrame(out)


def _over_rows(packed, params, keys, d, size, of: Callable, schema: str) -> DataFrame:
    """``of(row, rows, parameters)`` for every link of every model."""

    def run(batches):
        for pdf in batches:
            for row in _each(pdf):
                yield of(row, _rows_of(row, d, size), _theta(row, d))

    return _blocks(packed, params, keys, size).select(*_INPUT, *_THETA).mapInPandas(run, schema)


def kmeans_assign(packed, params, keys, d, size=PACK) -> DataFrame:
    """Nearest centre of every row, and soft shares by inverse distance."""

    def of(row, rows, theta):
        dist = np.sqrt(kn.squared_distance(rows.x, np.tile(theta[0], (len(rows.x), 1, 1))))
        share = 1.0 / (dist + 1e-10)
        return _by_rows(rows, row["model_id"], dist.argmin(2), share / share.sum(2, keepdims=True))

    return _over_rows(packed, params, keys, d, size, of, _PROBA)


def _components(rows, theta):
    logs = em.densities(rows, theta[0], theta[1]) + np.log(theta[2][0] + 1e-300)
    return kn.softmax(logs)


def gmm_assign(packed, params, keys, d, size=PACK) -> DataFrame:
    """Most likely component of every row, and the component probabilities."""

    def of(row, rows, theta):
        resp, _ = _components(rows, theta)
        return _by_rows(rows, row["model_id"], resp.argmax(2), resp)

    return _over_rows(packed, params, keys, d, size, of, _PROBA)


def _chained(packed, params, keys, d, size, best: bool) -> DataFrame:
    """Links of every model with the vectors at their borders (NULL where a range is one link)."""
    blocks = _blocks(packed, params, keys, size).select(*_INPUT, *_THETA, "rs")
    levels = _levels(params, size)
    if not levels:
        null = F.lit(None)
        return blocks.withColumns({"entry": null.cast("array<double>"), "exit": null.cast("array<double>"), "last": F.lit(-1), "log_likelihood": null.cast("array<double>")})
    # ranges of one link are walks of one step
    mats = _matrices(blocks.drop("rs"), d, size, lambda row: _theta(row, d), best)
    return blocks.join(_borders(mats, best, levels), ["model_id", "blk"])


def _ends(row: dict, theta: tuple, name: str, otherwise: np.ndarray) -> np.ndarray:
    return otherwise if row[name] is None else np.asarray(row[name], dtype=float).reshape(theta[2].shape)


def hmm_decode(packed, params, keys, d, size=PACK) -> DataFrame:
    """Most likely state path (Viterbi) of every model: (model_id, pos, state).

    To decode rows the model was not fitted on, set ``lo`` and ``hi`` of the
    parameter rows to that range; it then counts as a sequence of its own.
    """
    return _decode(packed, params, keys, d, size, sums=False)


def hmm_state_returns(packed, params, keys, d, size=PACK) -> DataFrame:
    """Return statistics of the decoded states: (model_id, state, n, ...).

    Deviation in the population form. The rows stay inside the tasks: only three
    sums per model, state and link leave them. States without rows are present
    with zeros.
    """
    sums = _decode(packed, params, keys, d, size, sums=True)
    found = sums.groupBy("model_id", "state").agg(*[F.sum(c).alias(c) for c in ("n", "s", "ss")])
    grid = params.select("model_id", F.explode(F.sequence(F.lit(0), F.col("k") - 1)).alias("state"))
    mean = F.coalesce(F.try_divide("s", "n"), F.lit(0.0))
    var = F.greatest(F.coalesce(F.try_divide("ss", "n"), F.lit(0.0)) - mean * mean, F.lit(0.0))
    out = grid.join(found, ["model_id", "state"], "left").select(
        "model_id", "state", F.coalesce("n", F.lit(0)).alias("n"),
        (mean * 252.0).alias("annualized_return"),
        (F.sqrt(var) * 252.0**0.5).alias("annualized_volatility"),
    )
    ret, vol = F.col("annualized_return"), F.col("annualized_volatility")
    return out.withColumn("sharpe_ratio", F.when(vol > 0, ret / vol).otherwise(0.0))


def _decode(packed, params, keys, d, size, sums: bool) -> DataFrame:
    def run(batches):
        for pdf in batches:
            for row in _each(pdf):
                rows, theta = _rows_of(row, d, size), _theta(row, d)
                entry = _ends(row, theta, "entry", np.log(theta[2] + kn.EPS))[0]
                dens = em.densities(rows, theta[0], theta[1])
                states = kn.best_states(rows, dens, np.log(theta[3][0] + kn.EPS), entry, int(row["last"]))
                out = _by_rows(rows, row["model_id"], states)
                if sums:
                    out["s"] = np.asarray(row["rs"], dtype=float)[out["pos"].to_numpy() - int(row["blk"]) * size]
                    out["ss"] = out["s"] ** 2
                    out = out.groupby(["model_id", "state"]).agg(n=("pos", "size"), s=("s", "sum"), ss=("ss", "sum")).reset_index()
                yield out

    schema = "model_id string, state int, n long, s double, ss double" if sums else "model_id string, pos long, state int"
    return _chained(packed, params, keys, d, size, best=True).mapInPandas(run, schema)


def hmm_posterior(packed, params, keys, d, size=PACK) -> DataFrame:
    """Smoothed state probabilities of every row: (model_id, pos, proba)."""
    return _smoothed(packed, params, keys, d, size, lambda row, rows, theta, entry, exit_: _by_rows(
        rows, row["model_id"], proba=em.smoothed(rows, *theta, entry, exit_)[0][0]
    ), "model_id string, pos long, proba array<double>")


def msr_probabilities(packed, params, keys, size=PACK) -> DataFrame:
    """Filtered and smoothed state probabilities of a switching regression: (model_id, pos, filtered, smoothed).

    Filtered ones know the rows up to their own, smoothed ones all rows.
    """

    def of(row, rows, theta, entry, exit_):
        out = _by_rows(rows, row["model_id"], proba=em.filtered(rows, *theta, entry)).rename(columns={"proba": "filtered"})
        out["smoothed"] = list(em.smoothed(rows, *theta, entry, exit_)[0][0][rows.ok])
        return out

    return _smoothed(packed, params, keys, 1, size, of, "model_id string, pos long, filtered array<double>, smoothed array<double>")


def _smoothed(packed, params, keys, d, size, of: Callable, schema: str) -> DataFrame:
    def run(batches):
        for pdf in batches:
            for row in _each(pdf):
                theta = _theta(row, d)
                ends = _ends(row, theta, "entry", theta[2] + kn.EPS), _ends(row, theta, "exit", np.ones(theta[2].shape))
                yield of(row, _rows_of(row, d, size), theta, *ends)

    return _chained(packed, params, keys, d, size, best=False).mapInPandas(run, schema)


def hmm_score(packed, params, keys, d, size=PACK) -> DataFrame:
    """Log likelihood of every model's row range: (model_id, log_likelihood)."""
    blocks = _blocks(packed, params, keys, size).select(*_INPUT, *_THETA)
    mats = _matrices(blocks, d, size, lambda row: _theta(row, d), best=False)
    borders = _borders(mats, False, max(1, _levels(params, size)))
    return borders.groupBy("model_id").agg(F.max(F.col("log_likelihood")[0]).alias("log_likelihood"))


def gmm_score(packed, params, keys, d, size=PACK) -> DataFrame:
    """Log likelihood of every mixture: (model_id, log_likelihood)."""

    def of(row, rows, theta):
        _, ll = _components(rows, theta)
        return pd.DataFrame({"model_id": [row["model_id"]], "ll": [float(ll[rows.ok].sum())]})

    parts = _over_rows(packed, params, keys, d, size, of, "model_id string, ll double")
    return parts.groupBy("model_id").agg(F.sum("ll").alias("log_likelihood"))


def nearest_mean(df: DataFrame, params: DataFrame, keys: list[str], value: str) -> DataFrame:
    """State whose mean is nearest to one value column, for one-feature models."""
    joined = df.join(params.select(*keys, "model_id", "means"), keys)
    gaps = F.transform("means", lambda m: F.abs(F.col(value) - m))
    state = (F.array_position(gaps, F.array_min(gaps)) - 1).cast("int")
    return joined.withColumn("state", state).drop("means")


def information_criteria(params: DataFrame, kind: str, d: int) -> DataFrame:
    """AIC and BIC. k-means has no likelihood and reports 9999 for both."""
    k, n = F.col("k"), F.col("hi") - F.col("lo")
    free = {
        "hmm": (k - 1) + k * (k - 1) + 2 * k * d,
        "gmm": (k - 1) + 2 * k * d,
        "msr": k * (k - 1) + 2 * k,
    }.get(kind)
    if free is None:
        return params.withColumns({"aic": F.lit(9999.0), "bic": F.lit(9999.0)})
    ll = F.col("log_likelihood")
    return params.withColumns({"aic": 2.0 * free - 2.0 * ll, "bic": free * F.log(n) - 2.0 * ll})


def transition_table(params: DataFrame, keys: list[str]) -> DataFrame:
    """Model transitions as long rows (keys, model_id, from_state, to_state, p)."""
    cells = params.select(*keys, "model_id", "k", F.posexplode("trans").alias("i", "p"))
    return cells.select(
        *keys, "model_id", F.floor(F.col("i") / F.col("k")).cast("int").alias("from_state"),
        (F.col("i") % F.col("k")).alias("to_state"), "p",
    )


def emission_table(params: DataFrame, keys: list[str], features: list[str]) -> DataFrame:
    """Means and variances as long rows (keys, model_id, state, feature, mean, var)."""
    d = len(features)
    names = F.array(*[F.lit(f) for f in features])
    cells = params.select(
        *keys, "model_id", F.posexplode(F.arrays_zip("means", "vars")).alias("i", "mv")
    )
    return cells.select(
        *keys, "model_id", F.floor(F.col("i") / d).cast("int").alias("state"),
        F.get(names, F.col("i") % d).alias("feature"), F.col("mv.means").alias("mean"), F.col("mv.vars").alias("var"),
    )


def summarize(params: DataFrame, keys: list[str]) -> DataFrame:
    """One row per model: size, likelihood, rounds and whether it came to rest."""
    return params.select(
        *keys, "model_id", "k", "seed", "lo", "hi", "log_likelihood", "rounds",
        (~F.col("active")).alias("converged"),
    )


def save_params(params: DataFrame, path: str) -> None:
    params.write.mode("overwrite").parquet(path)


def load_params(spark, path: str) -> DataFrame:
    return spark.read.parquet(path)


# --- silhouette -------------------------------------------------------------

def silhouette_squared(df: DataFrame, keys: list[str], state: str, features: list[str] | str) -> DataFrame:
    """Mean silhouette with squared Euclidean distances, exact on all rows.

    ``features`` are columns, or the name of one array column. The mean squared
    distance to a cluster follows from its count, sum and square sum, so no pair
    of rows is formed. The cluster table has as many rows as there are
    (key, state) pairs and meets the rows on (key, salt), so that a hot key is
    many tasks and is summed twice.
    """
    if not keys:
        return silhouette_squared(df.withColumn("_all", F.lit(0)), ["_all"], state, features).drop("_all")
    if isinstance(features, str):
        width = df.agg(F.max(F.size(features)).alias("w")).first()["w"] or 0
        x = F.transform(features, lambda v: v.cast("double"))
    else:
        width, x = len(features), F.array(*[F.col(f).cast("double") for f in features])
    rows = df.select(*keys, state, x.alias("_x"))
    clusters = rows.groupBy(*keys, state).agg(
        F.count(F.lit(1)).alias("n"),
        F.array(*[F.avg(F.get("_x", F.lit(i))) for i in range(width)]).alias("mu"),
        F.avg(_square_sum(F.col("_x"))).alias("sq"),
    )
    per_key = clusters.groupBy(*keys).agg(F.collect_list(F.struct(F.col(state).alias("c"), "n", "mu", "sq")).alias("_cl"))
    rows, per_key = salted(rows, per_key)
    rows = rows.join(per_key, [*keys, SALT])
    rows = rows.withColumn("_xx", _square_sum(F.col("_x")))
    dist = F.transform(
        "_cl",
        lambda c: F.struct(
            c["c"].alias("c"), c["n"].alias("n"),
            (F.col("_xx") + c["sq"] - 2.0 * _dot(F.col("_x"), c["mu"])).alias("d"),
        ),
    )
    rows = rows.withColumn("_d", dist)
    own = F.filter("_d", lambda c: c["c"] == F.col(state))[0]
    other = F.array_min(F.transform(F.filter("_d", lambda c: c["c"] != F.col(state)), lambda c: c["d"]))
    a = own["d"] * own["n"] / F.nullif(own["n"] - 1, F.lit(0))
    rows = rows.withColumns({"_a": a, "_b": other})
    s = F.when(F.col("_a").isNull() | F.col("_b").isNull(), 0.0).otherwise(
        F.coalesce(F.try_divide(F.col("_b") - F.col("_a"), F.greatest("_a", "_b")), F.lit(0.0))
    )
    parts = rows.groupBy(*keys, SALT).agg(F.sum(s).alias("_s"), F.count(F.lit(1)).alias("_n"))
    return parts.groupBy(*keys).agg((F.sum("_s") / F.sum("_n")).alias("silhouette"))


def _square_sum(x):
    return F.aggregate(x, F.lit(0.0), lambda acc, v: acc + v * v)


def _dot(x, y):
    return F.aggregate(F.zip_with(x, y, lambda a, b: a * b), F.lit(0.0), lambda acc, v: acc + v)
