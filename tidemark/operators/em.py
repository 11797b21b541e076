"""One fit as a state: what a pass over rows sums up, and how the sums move it on.

A fit goes through phases: ``seed`` (oversampled drawing of candidate centres),
``weigh`` (rows per candidate), ``kmeans``, ``gmm``, ``hmm``, ``score``, ``done``.
``gather`` turns the rows of one link into sums, ``merge`` adds the sums of two
links, ``absorb`` updates the state. Sums do not care how rows are cut, so the
same three functions serve a model inside one task and a model over a cluster.

Several starts of a model move together (first axis S). A start that has come
to rest takes no further part; the best one goes on to the next phase.

Mixtures and HMMs are accelerated by squared extrapolation: two EM steps give a
direction and its change, the next point lies further along it. A point whose
likelihood is below that of the first of the two steps is given up for the
second one, so the likelihood does not fall and the resting points are those of
plain EM. A fit rests when one plain EM step gains less than the tolerance.
"""

from __future__ import annotations

import numpy as np

from . import kernels as kn

MIN_COVAR = 1e-3  # HMM variance floor
REG_COVAR = 1e-6  # mixture variance offset
SEED_ROUNDS = 4  # of oversampling, after the first row
OVERSAMPLE = 2  # rows per state that a round of oversampling adds
FARTHEST = 16.0  # longest extrapolation, in steps


def begin(k: int, d: int, seed: int, phases: list[str], starts: int, limits: dict, theta: dict | None = None, floor: float = MIN_COVAR, steady: bool = False, many: bool = False,
          given: bool = False) -> dict:
    """The state before the first pass; ``theta`` (means, vars, start, trans) replaces seeding and k-means.

    ``steady``: an HMM begins in the stationary distribution of its transitions.
    ``many``: all starts go on after k-means, not the best one alone. ``given``:
    an HMM keeps the opening and the transitions of ``theta``.
    """
    state = {
        "k": k, "d": d, "seed": seed, "plan": list(phases), "phase": phases[0], "starts": starts, "limits": limits, "floor": floor, "steady": steady, "many": many, "given": given,
        "rounds": 0, "ll": float("-inf"), "rest": False, "scores": np.zeros(0),
    }
    if theta is None:
        state |= {"round": 0, "found": [np.zeros((0, d)) for _ in range(starts)]}
    else:
        state["theta"] = {n: np.array(theta[n], float).reshape(s) for n, s in shapes(k, d).items()}
        _enter(state, phases[0])
    return state


def shapes(k: int, d: int) -> dict:
    return {"means": (k, d), "vars": (k, d), "start": (k,), "trans": (k, k)}


def sticky(k: int) -> np.ndarray:
    """Transitions with a bias to stay."""
    return (0.5 * np.eye(k) + 1.0 / k) / 1.5


def stationary(trans: np.ndarray) -> np.ndarray:
    """The distribution that transitions leave as it is."""
    k = len(trans)
    a = np.vstack([trans.T - np.eye(k), np.ones(k)])
    p = np.maximum(np.linalg.lstsq(a, np.append(np.zeros(k), 1.0), rcond=None)[0], 0.0)
    return p / p.sum()


# --- parameters as one vector per start -----------------------------------------------------


def _vector(means, vars_, start, trans):
    s = len(means)
    return np.concatenate([means.reshape(s, -1), np.log(vars_).reshape(s, -1), start, trans.reshape(s, -1)], 1)


def parameters(state: dict, v: np.ndarray) -> tuple:
    """(means, vars, start, trans) with the first axis S; probabilities are made whole again."""
    k, d, s = state["k"], state["d"], len(v)
    m, lv, p, t = np.split(v, np.cumsum([k * d, k * d, k]), axis=1)
    p, t = np.maximum(p, 0.0), np.maximum(t.reshape(s, k, k), 0.0)
    least = state["floor"] if state["phase"] == "hmm" else REG_COVAR
    return (
        m.reshape(s, k, d), np.maximum(np.exp(np.clip(lv, -60, 60)), least).reshape(s, k, d),
        p / np.maximum(p.sum(1, keepdims=True), 1e-300), t / np.maximum(t.sum(2, keepdims=True), 1e-300),
    )


def _enter(state: dict, phase: str) -> None:
    """Begin a phase from ``theta``, the parameters of one start or of S starts."""
    state["phase"], state["rounds"] = phase, 0
    if phase == "kmeans":
        _centres(state, state["theta"]["means"][None])
    if phase in ("gmm", "hmm"):
        t = {n: np.asarray(v) for n, v in state["theta"].items()}
        t = {n: v if v.ndim > len(shapes(state["k"], state["d"])[n]) else v[None] for n, v in t.items()}
        if phase == "hmm" and not state["given"]:
            k, s = state["k"], len(t["means"])
            t["start"], t["trans"] = np.full((s, k), 1.0 / k), np.tile(sticky(k), (s, 1, 1))
            t["vars"] = np.maximum(t["vars"], state["floor"])
        v = _vector(t["means"], np.maximum(t["vars"], 1e-300), t["start"], t["trans"])
        s = len(v)
        state |= {
            "v": v, "base": v.copy(), "safe": v.copy(), "step": np.zeros(s, int), "before": np.full(s, -np.inf), "floor_ll": np.full(s, -np.inf),
            "lls": np.full(s, -np.inf), "active": np.ones(s, bool), "still": np.zeros(s, bool),
        }


# --- passes ---------------------------------------------------------------------------------


def gather(state: dict, rows: kn.Rows, entry=None, exit_=None, ll=None) -> dict:
    """Sums of one link's rows. ``entry``, ``exit_`` (S, k) and ``ll`` (S) are those of a longer chain."""
    phase = state["phase"]
    if phase in ("seed", "weigh", "kmeans"):
        x = rows.x[rows.ok]
        return {"seed": _draw, "weigh": _weigh, "kmeans": _nearest}[phase](state, x, rows.pos[rows.ok])
    if state["plan"][-1] == "kmeans":  # score of k-means
        centres = state["theta"]["means"][None]
        return _nearest(state | {"centres": centres, "moving": np.ones(1, bool)}, rows.x[rows.ok], None)
    kind = state["plan"][-1] if phase == "score" else phase
    live = np.flatnonzero(state["active"]) if phase != "score" else np.arange(1)
    means, vars_, start, trans = current(state, live)
    if kind == "gmm":
        return _mixture(rows, live, means, vars_, start)
    return _chain(rows, live, means, vars_, start, trans, entry, exit_, ll)


def current(state: dict, live: np.ndarray) -> tuple:
    """Parameters of the starts that the next pass is for."""
    if state["phase"] == "score":
        t = state["theta"]
        return t["means"][None], t["vars"][None], t["start"][None], t["trans"][None]
    return parameters(state, state["v"][live])


def _draw(state, x, pos):
    """For every start the rows that win the race: uniform first, then weighted by the distance to what was found."""
    take = 1 if state["round"] == 0 else OVERSAMPLE * state["k"]
    keys, best = np.full((state["starts"], take), np.inf), np.zeros((state["starts"], take, state["d"]))
    for s in range(state["starts"] if len(x) else 0):
        u = kn.draw_keys(pos[None], np.array([state["seed"] * 1_000_003 + 1009 * s + state["round"]]))[0]
        race = -np.log((u + 0.5) / 2.0**53)
        if state["round"]:
            far = kn.squared_distance(x[None], state["found"][s][None])[0].min(1)
            race = np.where(far > 0, race / np.where(far > 0, far, 1.0), np.inf)
        at = np.argsort(race, kind="stable")[:take]
        keys[s, : len(at)], best[s, : len(at)] = race[at], x[at]
    return {"keys": keys, "best": best}


def _weigh(state, x, pos):
    width = max(len(f) for f in state["found"])
    out = np.zeros((state["starts"], width))
    for s, found in enumerate(state["found"]):
        if len(x) and len(found):
            near = kn.squared_distance(x[None], found[None])[0].argmin(1)
            out[s, : len(found)] = np.bincount(near, minlength=len(found))
    return {"weights": out}


def _nearest(state, x, pos):
    live = np.flatnonzero(state["moving"])
    k, d = state["k"], state["d"]
    out = {"live": live, "w": np.zeros((len(live), k)), "sx": np.zeros((len(live), k, d)), "sxx": np.zeros((len(live), k, d)), "ll": np.zeros(len(live))}
    for i, s in enumerate(live if len(x) else []):
        dist = kn.squared_distance(x[None], state["centres"][s][None])[0]
        resp = (dist.argmin(1)[:, None] == np.arange(k)).astype(float)
        out["w"][i], out["sx"][i], out["sxx"][i], out["ll"][i] = resp.sum(0), resp.T @ x, resp.T @ (x * x), -dist.min(1).sum()
    return out


def _mixture(rows, live, means, vars_, start):
    x = rows.x[rows.ok]
    out = {"live": live, "w": [], "sx": [], "sxx": [], "ll": []}
    for m, v, p in zip(means, vars_, start):
        resp, ll = kn.softmax(kn.log_density(x[None], m[None], v[None])[0] + np.log(p + 1e-300))
        for name, value in (("w", resp.sum(0)), ("sx", resp.T @ x), ("sxx", resp.T @ (x * x)), ("ll", ll.sum())):
            out[name].append(value)
    return {n: np.array(v) for n, v in out.items()} | {"rows": float(len(x))}


def _tiled(rows, s):
    return (np.tile(a, (s,) + (1,) * (a.ndim - 1)) for a in (rows.x, rows.ok, rows.first))


def densities(rows, means, vars_):
    """(S * B, L, K) log densities of the B blocks under S starts."""
    b = len(rows.x)
    return np.concatenate([kn.log_density(rows.x, np.tile(m, (b, 1, 1)), np.tile(v, (b, 1, 1))) for m, v in zip(means, vars_)])


def products(rows, means, vars_, trans) -> tuple[np.ndarray, np.ndarray]:
    """Matrices (S, B, k, k) of the blocks and their log scales (S, B)."""
    s, k, b = len(means), means.shape[1], len(rows.x)
    _, ok, first = _tiled(rows, s)
    m, scale = kn.chain_product(densities(rows, means, vars_), np.repeat(trans + kn.EPS, b, 0), ok, first)
    return m.reshape(s, b, k, k), scale.reshape(s, b)


def borders(m, scale, entry, exit_):
    """Vectors before and after every block, and the log likelihood of the walk from ``entry``."""
    s, b, k, _ = m.shape
    into, out, ll = np.zeros((s, b, k)), np.zeros((s, b, k)), np.zeros(s)
    v = entry
    for i in range(b):
        into[:, i] = v
        v = np.einsum("sk,skj->sj", v, m[:, i])
        total = v.sum(1)
        ll += scale[:, i] + np.log(total)
        v = v / total[:, None]
    back = exit_
    for i in range(b - 1, -1, -1):
        out[:, i] = back
        back = np.einsum("skj,sj->sk", m[:, i], back)
        back = back / back.sum(1, keepdims=True)
    return into, out, ll


def smoothed(rows, means, vars_, start, trans, entry=None, exit_=None):
    """Row probabilities (S, B, L, k), expected transitions (S, k, k) and the log likelihood (S) of a link."""
    s, k, b = len(means), means.shape[1], len(rows.x)
    m, scale = products(rows, means, vars_, trans)
    into, out, ll = borders(m, scale, start + kn.EPS if entry is None else entry, np.ones((s, k)) if exit_ is None else exit_)
    _, ok, first = _tiled(rows, s)
    gamma, moves = kn.forward_backward(
        densities(rows, means, vars_), np.repeat(trans + kn.EPS, b, 0), ok, first, into.reshape(-1, k), out.reshape(-1, k)
    )
    return gamma.reshape(s, b, -1, k), moves.reshape(s, b, k, k).sum(1), ll


def filtered(rows, means, vars_, start, trans, entry=None) -> np.ndarray:
    """State probabilities (B, L, k) given the rows up to each, of one start."""
    m, scale = products(rows, means, vars_, trans)
    into, _, _ = borders(m, scale, start + kn.EPS if entry is None else entry, np.ones(start.shape))
    b = len(rows.x)
    return kn.forward(densities(rows, means, vars_), np.repeat(trans + kn.EPS, b, 0), rows.ok, rows.first, into[0])


def _chain(rows, live, means, vars_, start, trans, entry, exit_, ll):
    gamma, moves, own = smoothed(rows, means, vars_, start, trans, entry, exit_)
    # of a chain over several links the whole likelihood counts once, where the chain begins
    total = own if ll is None else np.where(rows.first.any(), ll, 0.0) * np.ones(len(live))
    return {
        "live": live, "w": gamma.sum((1, 2)), "sx": np.einsum("sblk,bld->skd", gamma, rows.x), "sxx": np.einsum("sblk,bld->skd", gamma, rows.x**2),
        "moves": moves, "opening": (gamma * rows.first[None, :, :, None]).sum((1, 2)), "ll": total,
    }


def merge(a: dict, b: dict) -> dict:
    """Sums of two parts of a model's rows."""
    if "keys" in a:
        keys, best = np.concatenate([a["keys"], b["keys"]], 1), np.concatenate([a["best"], b["best"]], 1)
        at = np.argsort(keys, axis=1, kind="stable")[:, : a["keys"].shape[1]]
        return {"keys": np.take_along_axis(keys, at, 1), "best": np.take_along_axis(best, at[..., None], 1)}
    return {n: v if n == "live" else v + b[n] for n, v in a.items()}


# --- updates --------------------------------------------------------------------------------


def absorb(state: dict, sums: dict) -> None:
    """Move the state on by one pass."""
    {"seed": _found, "weigh": _recluster, "kmeans": _moved, "gmm": _stepped, "hmm": _stepped, "score": _scored}[state["phase"]](state, sums)


def _found(state, sums):
    for s in range(state["starts"]):
        new = sums["best"][s][np.isfinite(sums["keys"][s])]
        state["found"][s] = np.concatenate([state["found"][s], new])
    state["round"] += 1
    if state["round"] > SEED_ROUNDS:
        state["phase"] = "weigh"


def _recluster(state, sums):
    """k centres of the weighted candidates of every start."""
    k, d, out = state["k"], state["d"], []
    for s, found in enumerate(state["found"]):
        weight = sums["weights"][s, : len(found)]
        if not len(found):
            out.append(np.zeros((k, d)))
            continue
        rng = np.random.default_rng([abs(int(state["seed"])), s])
        share = weight.copy()
        at = []
        for _ in range(k):
            share = np.where(share > 0, share, 0.0)
            at.append(int(rng.choice(len(found), p=share / share.sum())) if share.sum() > 0 else len(at) % len(found))
            far = kn.squared_distance(found[None], found[at][None])[0].min(1)
            share = weight * far
        centres = found[at]
        for _ in range(20):
            near = kn.squared_distance(found[None], centres[None])[0].argmin(1)
            resp = (near[:, None] == np.arange(k)) * weight[:, None]
            total = resp.sum(0)[:, None]
            centres = np.where(total > 0, resp.T @ found / np.maximum(total, 1e-300), centres)
        out.append(centres)
    _centres(state, np.array(out))
    del state["found"]


def _centres(state, centres):
    """Begin k-means at centres (S, k, d)."""
    s, k, d = centres.shape
    state |= {
        "phase": "kmeans", "rounds": 0, "centres": centres, "moving": np.ones(s, bool), "cost": np.full(s, -np.inf),
        "spread": np.ones((s, k, d)), "share": np.full((s, k), 1.0 / k),
    }


def _moved(state, sums):
    limit, tol = state["limits"]["kmeans"]
    state["rounds"] += 1
    for i, s in enumerate(sums["live"]):
        w = sums["w"][i]
        full, safe = (w > 0)[:, None], np.maximum(w, 1e-10)[:, None]
        means = np.where(full, sums["sx"][i] / safe, state["centres"][s])
        spread = np.maximum(sums["sxx"][i] / safe - means**2, 0.0) + REG_COVAR
        state["moving"][s] = abs(sums["ll"][i] - state["cost"][s]) >= tol
        state["centres"][s], state["cost"][s] = means, sums["ll"][i]
        state["spread"][s], state["share"][s] = np.where(full, spread, 1.0), w / max(w.sum(), 1e-300)
    if state["moving"].any() and state["rounds"] < limit:
        return
    best = int(np.argmax(state["cost"]))
    k, own = state["k"], np.arange(len(state["cost"])) if state["many"] else best
    state["theta"] = {
        "means": state["centres"][own], "vars": state["spread"][own], "start": state["share"][own],
        "trans": np.tile(sticky(k), (len(state["cost"]), 1, 1)) if state["many"] else sticky(k),
    }
    state["scores"], state["rest"] = state["cost"].copy(), not state["moving"][best]
    for n in ("centres", "moving", "cost", "spread", "share"):
        del state[n]
    _next(state)


def _next(state):
    at = state["plan"].index(state["phase"])
    if at + 1 < len(state["plan"]):
        _enter(state, state["plan"][at + 1])
    else:
        state["phase"] = "score"


def _improved(state, old, sums, i):
    """One EM step from the sums of one start."""
    means, vars_, start, trans = (a[0] for a in parameters(state, old[None]))
    w = sums["w"][i]
    safe, full = np.maximum(w, 1e-10)[:, None], (w > 1e-10)[:, None]
    new = np.where(full, sums["sx"][i] / safe, means)
    spread = np.maximum(sums["sxx"][i] / safe - new**2, 0.0)
    hmm = state["phase"] == "hmm"
    spread = np.maximum(spread, state["floor"]) if hmm else spread + REG_COVAR
    vars_ = np.where(full, spread, vars_)
    if hmm:
        total = sums["moves"][i].sum(1, keepdims=True)
        trans = np.where(total > 0, sums["moves"][i] / np.maximum(total, 1e-300), trans)
        opening = sums["opening"][i].sum()
        start = stationary(trans) if state["steady"] else sums["opening"][i] / opening if opening > 0 else start
    else:
        start = w / w.sum() if w.sum() > 0 else start
    return _vector(new[None], vars_[None], start[None], trans[None])[0]


def _stepped(state, sums):
    limit, tol = state["limits"][state["phase"]]
    tol = tol * max(1.0, float(sums.get("rows", 1.0)))
    state["rounds"] += 1
    for i, s in enumerate(sums["live"]):
        ll, at = float(sums["ll"][i]), state["v"][s].copy()
        new = _improved(state, at, sums, i)
        if state["step"][s] == 2 and not ll >= state["floor_ll"][s]:
            state["v"][s], state["step"][s] = state["safe"][s], 0  # the jump led down
            continue
        state["lls"][s] = ll
        if state["step"][s] != 1:
            state["base"][s], state["before"][s], state["v"][s], state["step"][s] = at, ll, new, 1
            continue
        if abs(ll - state["before"][s]) < tol:
            state["active"][s], state["still"][s] = False, True
            continue
        first = at - state["base"][s]
        change = new - at - first
        size = np.sqrt((change**2).sum())
        far = -min(FARTHEST, max(1.0, np.sqrt((first**2).sum()) / size)) if size > 0 else -1.0
        state["safe"][s], state["floor_ll"][s] = new, ll
        state["v"][s], state["step"][s] = state["base"][s] - 2 * far * first + far**2 * change, 2
    if state["active"].any() and state["rounds"] < limit:
        return
    jumped = (state["step"] == 2) & state["active"]
    state["v"][jumped] = state["safe"][jumped]
    best = int(np.argmax(np.where(np.isnan(state["lls"]), -np.inf, state["lls"])))
    if len(state["lls"]) > 1:
        state["scores"] = state["lls"].copy()
    state["theta"] = dict(zip(("means", "vars", "start", "trans"), (a[0] for a in parameters(state, state["v"][[best]]))))
    state["rest"] = bool(state["still"][best])
    for n in ("v", "base", "safe", "step", "before", "floor_ll", "lls", "active", "still"):
        del state[n]
    rounds = state["rounds"]
    _next(state)
    if state["phase"] == "score":
        state["rounds"] = rounds


def _scored(state, sums):
    state["ll"], state["phase"] = float(sums["ll"][0]), "done"
