"""Small array helpers used inside tasks. Each works on a stack of blocks.

Shapes: B blocks, L rows per block, D features, K states. Rows outside a
block's valid range are skipped by the mask ``ok``. A link is a run of blocks
that one task holds.
"""

from __future__ import annotations

import numpy as np

EPS = 1e-15  # keeps the logarithm of a zero probability finite
WIDTH = 256  # rows of a block


class Rows:
    """Rows of one link as B blocks of at most ``WIDTH`` rows: x (B, L, D) scaled, ok, pos and first (B, L)."""

    def __init__(self, x, ok, pos, first):
        self.x, self.ok, self.pos, self.first = x, ok, pos, first


def rows_of(flat, n: int, link: int, size: int, d: int, lo: int, hi: int, shift, inv) -> Rows:
    """The rows of a packed link that a model uses.

    The mask keeps the rows whose position lies in the model's range [lo, hi)
    and that have every feature the model uses. Features are scaled with the
    model's ``shift`` and ``inv``; a feature with inv 0 is switched off.
    """
    a, b = max(0, lo - link * size), min(n, hi - link * size)
    count = max(0, b - a)
    width = max(1, min(WIDTH, count))
    blocks = max(1, -(-count // width))
    x = np.zeros((blocks * width, d))
    x[:count] = np.asarray(flat, dtype=float).reshape(-1, d)[a:b] if count else 0.0
    inv = np.asarray(inv, dtype=float)
    x = np.where(inv == 0, 0.0, (x - np.asarray(shift, dtype=float)) * inv)
    ok = (np.arange(len(x)) < count) & ~np.isnan(x).any(1)
    pos = link * size + a + np.arange(len(x))
    shape = (blocks, width)
    return Rows(np.where(ok[:, None], x, 0.0).reshape(*shape, d), ok.reshape(shape), pos.reshape(shape), (pos == lo).reshape(shape))


def stack(column, *shape):
    """Array cells of a column as one array."""
    return np.stack([np.asarray(v) for v in column]).reshape(len(column), *shape)


def log_density(x, means, vars_):
    """Diagonal Gaussian log density of every row under every state: B, L, K."""
    d = x.shape[2]
    out = np.empty((*x.shape[:2], means.shape[1]))
    for k in range(means.shape[1]):
        diff = x - means[:, None, k]
        out[:, :, k] = -0.5 * (
            d * np.log(2 * np.pi)
            + np.log(vars_[:, k]).sum(1)[:, None]
            + (diff * diff / vars_[:, None, k]).sum(2)
        )
    return out


def squared_distance(x, means):
    return np.stack([((x - means[:, None, k]) ** 2).sum(2) for k in range(means.shape[1])], 2)


def softmax(logs):
    top = logs.max(-1, keepdims=True)
    e = np.exp(logs - top)
    total = e.sum(-1, keepdims=True)
    return e / total, (top + np.log(total))[..., 0]


def chain_product(dens, trans, ok, first):
    """Product of the step matrices of every block, scaled, and its log scale.

    A step is trans * density; the sequence's first row has no transition.
    """
    b, width, k = dens.shape
    m = np.broadcast_to(np.eye(k), (b, k, k)).copy()
    scale = np.zeros(b)
    top = dens.max(2)
    e = np.exp(dens - top[..., None])
    for t in range(width):
        step = np.where(first[:, t, None, None], m, m @ trans) * e[:, t, None, :]
        c = step.max((1, 2))
        use = ok[:, t]
        m = np.where(use[:, None, None], step / c[:, None, None], m)
        scale += np.where(use, np.log(c) + top[:, t], 0.0)
    return m, scale


def best_chain(dens, log_trans, ok, first):
    """Best score from every entry state to every exit state of a block."""
    b, width, k = dens.shape
    w = np.where(np.eye(k) > 0, 0.0, -np.inf) * np.ones((b, 1, 1))
    for t in range(width):
        moved = (w[:, :, :, None] + log_trans[:, None, :, :]).max(2)
        step = np.where(first[:, t, None, None], w, moved) + dens[:, t, None, :]
        w = np.where(ok[:, t, None, None], step, w)
    return w


def forward(dens, trans, ok, first, entry):
    """State probabilities of every row given the rows up to it."""
    b, width, k = dens.shape
    e = np.exp(dens - dens.max(2, keepdims=True))
    alpha, a = np.zeros((b, width, k)), entry
    for t in range(width):
        step = np.where(first[:, t, None], a, (a[:, None, :] @ trans)[:, 0]) * e[:, t]
        step /= step.sum(1, keepdims=True)
        a = np.where(ok[:, t, None], step, a)
        alpha[:, t] = a
    return alpha


def forward_backward(dens, trans, ok, first, entry, exit_):
    """State probabilities of every row, and the expected transitions per block."""
    b, width, k = dens.shape
    e = np.exp(dens - dens.max(2, keepdims=True))
    alpha = forward(dens, trans, ok, first, entry)
    gamma = np.zeros((b, width, k))
    moves = np.zeros((b, k, k))
    back = exit_
    for t in range(width - 1, -1, -1):
        use = ok[:, t, None]
        g = alpha[:, t] * back
        gamma[:, t] = np.where(use, g / g.sum(1, keepdims=True), 0.0)
        before = alpha[:, t - 1] if t else entry
        xi = before[:, :, None] * trans * (e[:, t] * back)[:, None, :]
        total = xi.sum((1, 2), keepdims=True)
        moves += np.where((use & ~first[:, t, None])[..., None], xi / total, 0.0)
        prior = (trans @ (e[:, t] * back)[:, :, None])[:, :, 0]
        prior = np.where(first[:, t, None], back, prior)
        prior /= prior.sum(1, keepdims=True)
        back = np.where(use, prior, back)
    return gamma, moves


def best_path(dens, log_trans, ok, first, entry, last):
    """Most likely states of every block from its entry scores to its last state."""
    b, width, k = dens.shape
    score, came = entry.copy(), np.zeros((b, width, k), dtype=np.int64)
    for t in range(width):
        options = score[:, :, None] + log_trans
        step = np.where(first[:, t, None], score, options.max(1)) + dens[:, t]
        came[:, t] = options.argmax(1)
        score = np.where(ok[:, t, None], step, score)
    states = np.full((b, width), -1, dtype=np.int64)
    now, rows = last.copy(), np.arange(b)
    for t in range(width - 1, -1, -1):
        use = ok[:, t]
        states[:, t] = np.where(use, now, -1)
        now = np.where(use & ~first[:, t], came[rows, t, now], now)
    return states


def best_states(rows: Rows, dens, log_trans, entry, last: int):
    """Most likely states (B, L) of a link, from the scores before it and its last state (-1: the best one)."""
    b, k = len(rows.x), dens.shape[2]
    tiled = np.tile(log_trans, (b, 1, 1))
    w = best_chain(dens, tiled, rows.ok, rows.first)
    into, v = np.zeros((b, k)), entry
    for i in range(b):
        into[i], v = v, (v[:, None] + w[i]).max(0)
    lasts, now = np.zeros(b, dtype=np.int64), int(v.argmax()) if last < 0 else last
    for i in range(b - 1, -1, -1):
        lasts[i], now = now, int((into[i] + w[i][:, now]).argmax())
    return best_path(dens, tiled, rows.ok, rows.first, into, lasts)


def draw_keys(pos, seed):
    """Pseudo-random key per (seed, row), the same wherever the row is processed."""
    z = pos.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + (
        seed.astype(np.uint64)[:, None] + np.uint64(1)
    ) * np.uint64(0xBF58476D1CE4E5B9)
    z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return ((z ^ (z >> np.uint64(31))) >> np.uint64(11)).astype(np.float64)
