"""Maximum likelihood of conditional volatility, for many series at once.

Constant mean, normal errors. ``p`` lags of the squared residual, ``q`` lags of the
variance; ``GJR-Garch`` adds one lag of squared negative residuals, ``EGarch``
models the logarithm. Every parameter is free; the level is searched as the
long-run variance. Series are padded to one length, so that a pass over time
serves all series and all points that the search tries.
"""

from __future__ import annotations

from itertools import combinations, product

import numpy as np

KINDS = ("Garch", "EGarch", "GJR-Garch")
#: Variance before the first value: squares of this many values, each weighted by this share of the one before.
BACKCAST, DECAY = 75, 0.94
#: Least variance, as a share of the series' own: values that mostly repeat would have no highest likelihood without it.
FLOOR = 1e-6
#: Persistence stays below this, so that the long-run variance exists.
STATIONARY = 0.9995
#: The search ends when its step is this share of the first one; a step shrinks when the log likelihood rises by less than this.
FINEST, ENOUGH = 2.0**-9, 1e-5
#: A search over kinks starts again with long steps until it gains less than this.
AGAIN = 1e-3
#: Moves that a Newton step is long at the most.
LONGEST = 64.0
#: Points that one pass over time evaluates, about.
WIDTH = 8192
MEAN_ABS = np.sqrt(2 / np.pi)


class Model:
    """Parameters are a row (mean, log level, p alphas, gamma if GJR, q betas), in units of a series' own deviation."""

    def __init__(self, kind: str, p: int, q: int):
        self.kind, self.p, self.q = kind, p, q
        self.g = int(kind == "GJR-Garch")
        self.size = 2 + p + self.g + q
        self.alphas, self.betas = slice(2, 2 + p), slice(2 + p + self.g, self.size)
        self.scale = np.array([0.1, 0.3, *[0.05] * (p + self.g), *[0.1] * q])

    def starts(self) -> np.ndarray:
        """Coarse points: totals of alpha and beta, dealt evenly to their lags."""
        rows = []
        for a, b in product((0.0, 0.03, 0.1, 0.25), (0.0, 0.4, 0.7, 0.85, 0.95)):
            if a + b < STATIONARY or self.kind == "EGarch":
                row = np.zeros(self.size)
                row[self.alphas], row[self.betas] = a / max(self.p, 1), b / max(self.q, 1)
                rows.append(row)
        return np.array(rows)

    def moves(self) -> np.ndarray:
        """Steps along each axis and each diagonal of two axes."""
        eye = np.eye(self.size)
        single = [s * row for row in eye for s in (1, -1)]
        double = [s * eye[i] + t * eye[j] for i, j in combinations(range(self.size), 2) for s, t in product((1, -1), repeat=2)]
        return np.array(single + double) * self.scale

    def bounded(self, points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Points moved onto the bounds, and which of them are stationary."""
        beta = points[..., self.betas]
        if self.kind == "EGarch":
            return points, np.abs(beta.sum(-1)) < STATIONARY
        out = points.copy()
        out[..., self.alphas] = np.maximum(out[..., self.alphas], 0)
        out[..., self.betas] = np.maximum(beta, 0)
        if self.g:
            first = out[..., 2] if self.p else 0.0
            out[..., 2 + self.p] = np.maximum(out[..., 2 + self.p], -first)
        return out, self.persistence(out) < STATIONARY

    def persistence(self, points: np.ndarray) -> np.ndarray:
        half = points[..., 2 + self.p] / 2 if self.g else 0.0
        return points[..., self.alphas].sum(-1) + half + points[..., self.betas].sum(-1)

    def run(self, x: np.ndarray, n: np.ndarray, before: np.ndarray, points: np.ndarray, keep: bool = False):
        """Log likelihoods of points (series, tried, parameters); with ``keep`` also residuals over deviations, for one point each."""
        mean, level = points[..., 0], points[..., 1]
        alpha, beta = np.moveaxis(points[..., self.alphas], -1, 0), np.moveaxis(points[..., self.betas], -1, 0)
        gamma = points[..., 2 + self.p] if self.g else None
        logs = self.kind == "EGarch"
        if logs:
            base = (1 - beta.sum(0)) * level
            start = np.broadcast_to(np.log(before)[:, None], mean.shape)
            shocks = [np.zeros(mean.shape)] * self.p
        else:
            base = (1 - self.persistence(points)) * np.exp(level)
            start = np.broadcast_to(before[:, None], mean.shape)
            shocks = [start] * self.p
        states, down = [start] * self.q, start / 2
        total = np.zeros(mean.shape)
        z = np.full(x.shape, np.nan) if keep else None
        for t in range(x.shape[1]):
            state = base + sum((a * s for a, s in zip(alpha, shocks)), 0.0) + sum((b * s for b, s in zip(beta, states)), 0.0)
            if gamma is not None:
                state = state + gamma * down
            state = np.clip(state, np.log(FLOOR), -np.log(FLOOR)) if logs else np.maximum(state, FLOOR)
            e = x[:, t, None] - mean
            square, var = e * e, np.exp(state) if logs else state
            total += np.where(t < n[:, None], (state if logs else np.log(var)) + square / var, 0.0)
            if keep:
                z[:, t] = np.where(t < n, (e / np.sqrt(var))[:, 0], np.nan)
            if self.p:
                shocks = [np.abs(e) / np.sqrt(var) - MEAN_ABS if logs else square, *shocks[:-1]]
            if self.q:
                states = [state, *states[:-1]]
            if gamma is not None:
                down = np.where(e < 0, square, 0.0)
        like = -0.5 * (total + n[:, None] * np.log(2 * np.pi))
        return (like, z) if keep else like


def _curved(model: Model, like: np.ndarray, center: np.ndarray) -> np.ndarray:
    """Newton's step in units of the moves, from the likelihoods of all moves; directions that curve upwards are followed uphill."""
    d = model.size
    like = np.where(np.isfinite(like), like, center[:, None])
    axis = like[:, : 2 * d].reshape(-1, d, 2)
    slope = (axis[..., 0] - axis[..., 1]) / 2
    bend = np.zeros((len(like), d, d))
    bend[:, range(d), range(d)] = axis.sum(-1) - 2 * center[:, None]
    first, second = np.triu_indices(d, 1)
    corner = like[:, 2 * d :].reshape(-1, len(first), 4)
    bend[:, first, second] = bend[:, second, first] = (corner[..., 0] - corner[..., 1] - corner[..., 2] + corner[..., 3]) / 4
    values, axes = np.linalg.eigh(bend)
    along = np.einsum("sij,si->sj", axes, slope) / np.maximum(np.abs(values), 1e-9)
    step = np.einsum("sij,sj->si", axes, along)
    return step * np.minimum(1, LONGEST / np.maximum(np.abs(step).max(1, keepdims=True), 1e-300))


def _search(model: Model, x: np.ndarray, n: np.ndarray, before: np.ndarray, rounds: int) -> np.ndarray:
    """Best points by moves and Newton's steps from them, in at most so many rounds.

    A local search from the best of the starts: exact to about a tenth of an AIC unit
    for most series, less so for EGarch of several lags, whose likelihood has kinks. Only a higher likelihood is ever accepted. The step shrinks when nothing helps,
    and a series leaves the pass when its step is at its finest.
    """
    starts, moves = model.starts(), model.moves()
    first = model.run(x, n, before, np.broadcast_to(starts, (len(x), *starts.shape)))
    at, best, step = starts[first.argmax(1)], first.max(1), np.ones(len(x))
    since = best.copy()
    for _ in range(rounds):
        live = np.flatnonzero(step > FINEST)
        if not len(live):
            break
        here, span, held = at[live][:, None], step[live][:, None, None], (x[live, : n[live].max()], n[live], before[live])

        def tried(offsets):
            points, fits = model.bounded(here + span * offsets)
            points = np.where(fits[..., None], points, here)
            return points, np.where(fits, model.run(*held, points), -np.inf)

        points, like = tried(moves)
        newton = _curved(model, like, best[live])[:, None] * model.scale
        more, higher = tried(newton * np.array([2.0, 1.0, 0.5, 0.25, 0.0625])[:, None])
        points, like = np.concatenate([points, more], 1), np.concatenate([like, higher], 1)
        k, rows = like.argmax(1), np.arange(len(live))
        rise = like[rows, k] - best[live]
        up = rise > 0
        at[live[up]], best[live[up]] = points[rows, k][up], like[rows, k][up]
        step[live[rise < ENOUGH]] /= 4
        if model.kind == "EGarch":  # a residual that changes sign is a kink, where short steps can stick
            again = live[(step[live] <= FINEST) & (best[live] > since[live] + AGAIN)]
            step[again], since[again] = 1.0, best[again]
    return at


def fit_many(series: list[np.ndarray], kind: str = "Garch", p: int = 1, q: int = 1, rounds: int = 100) -> list[dict | None]:
    """For each series (no missing values): z, aic, mean, omega, alpha, gamma, beta; None where it is constant or empty."""
    model = Model(kind, p, q)
    out: list[dict | None] = [None] * len(series)
    spread = [float(np.std(s)) if len(s) else 0.0 for s in series]
    # A deviation within the rounding of the values is a constant series.
    able = [i for i, s in enumerate(series) if np.isfinite(spread[i]) and spread[i] > 1e-12 * float(np.abs(s).max(initial=0.0))]
    able.sort(key=lambda i: len(series[i]))
    width = max(1, WIDTH // len(model.moves()))
    for i in range(0, len(able), width):
        ids = able[i : i + width]
        n = np.array([len(series[k]) for k in ids])
        x = np.zeros((len(ids), n.max()))
        for row, k in zip(x, ids):
            row[: len(series[k])] = (series[k] - series[k].mean()) / spread[k]
        weights = np.where(np.arange(BACKCAST) < n[:, None], DECAY ** np.arange(BACKCAST), 0.0)
        squares = np.zeros(weights.shape)
        squares[:, : min(BACKCAST, x.shape[1])] = x[:, :BACKCAST] ** 2
        before = np.maximum((squares * weights).sum(1) / weights.sum(1), 1e-12)
        at = _search(model, x, n, before, rounds)
        like, z = model.run(x, n, before, at[:, None], keep=True)
        for row, k in enumerate(ids):
            unit, point = spread[k], at[row]
            if kind == "EGarch":
                omega = (1 - point[model.betas].sum()) * (point[1] + 2 * np.log(unit))
            else:
                omega = float((1 - model.persistence(point)) * np.exp(point[1])) * unit**2
            out[k] = {
                "z": z[row, : n[row]], "aic": float(2 * model.size - 2 * (like[row, 0] - n[row] * np.log(unit))),
                "mean": float(series[k].mean() + unit * point[0]), "omega": float(omega),
                "alpha": point[model.alphas].tolist(), "gamma": float(point[2 + p]) if model.g else 0.0, "beta": point[model.betas].tolist(),
            }
    return out
