"""Maximum likelihood of GARCH(1,1) for many series at once: h = omega + alpha e^2 + beta h.

Three free parameters per series stand for persistence (a logistic of at most LIMIT), alpha's
share of it, and the logarithm of the long-run variance over the sample's, so that every
point is a valid model. A grid gives each series its start; quasi-Newton steps (BFGS) with
backtracking then only ever raise the likelihood. Series of different lengths are padded at
their front, where they change nothing.
"""

from __future__ import annotations

import numpy as np

LIMIT, STEPS, LEAST = 0.999, 60, 10
GRID = [(p, a, 0.0) for p in (0.3, 0.6, 0.8, 0.9, 0.95, 0.98) for a in (0.05, 0.1, 0.2, 0.4)]


def _logit(x: float) -> float:
    return float(np.log(x / (1 - x)))


def model(z: np.ndarray, var: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """omega, alpha, beta of free parameters z (series, 3)."""
    persistence, share = LIMIT / (1 + np.exp(-z[:, 0])), 1 / (1 + np.exp(-z[:, 1]))
    return var * np.exp(z[:, 2]) * (1 - persistence), persistence * share, persistence * (1 - share)


def loss(z: np.ndarray, e2: np.ndarray, live: np.ndarray, var: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Mean of log h + e^2 / h of each series, its gradient, and the variance after the last return."""
    omega, alpha, beta = model(z, var)
    d_p = LIMIT * np.exp(-z[:, 0]) / (1 + np.exp(-z[:, 0])) ** 2
    share = 1 / (1 + np.exp(-z[:, 1]))
    p, d_s = alpha + beta, share * (1 - share)
    zero = np.zeros_like(p)
    d_omega = np.stack([-var * np.exp(z[:, 2]) * d_p, zero, omega], 1)
    d_alpha = np.stack([d_p * share, p * d_s, zero], 1)
    d_beta = np.stack([d_p * (1 - share), -p * d_s, zero], 1)
    h, dh, total, slope = var.copy(), np.zeros((len(z), 3)), np.zeros(len(z)), np.zeros((len(z), 3))
    for t in range(e2.shape[1]):
        on, x = live[:, t], e2[:, t]
        total += np.where(on, np.log(h) + x / h, 0.0)
        slope += np.where(on, (1 - x / h) / h, 0.0)[:, None] * dh
        dh = np.where(on[:, None], d_omega + d_alpha * x[:, None] + d_beta * h[:, None] + beta[:, None] * dh, dh)
        h = np.where(on, omega + alpha * x + beta * h, h)
    n = live.sum(axis=1)
    return total / n, slope / n[:, None], h


def minimise(z: np.ndarray, e2: np.ndarray, live: np.ndarray, var: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(parameters, whether the gradient vanished) of quasi-Newton steps from z."""
    inverse = np.tile(np.eye(3), (len(z), 1, 1))
    f, g, _ = loss(z, e2, live, var)
    for _ in range(STEPS):
        step = -np.einsum("sij,sj->si", inverse, g)
        down = (step * g).sum(axis=1)
        step = np.where((down < 0)[:, None], step, -g)
        down = (step * g).sum(axis=1)
        step *= np.minimum(1.0, 4.0 / np.maximum(np.abs(step).max(axis=1), 1e-12))[:, None]
        size, todo = np.ones(len(z)), np.abs(g).max(axis=1) > 1e-7
        if not todo.any():
            break
        new, f_new, g_new = z.copy(), f.copy(), g.copy()
        for _ in range(25):
            at = np.flatnonzero(todo)
            if not len(at):
                break
            trial = np.clip(z[at] + size[at, None] * step[at], -12, 12)
            ft, gt, _ = loss(trial, e2[at], live[at], var[at])
            good = ft <= f[at] + 1e-4 * size[at] * down[at]
            new[at[good]], f_new[at[good]], g_new[at[good]] = trial[good], ft[good], gt[good]
            todo[at[good]] = False
            size *= np.where(todo, 0.4, 1.0)
        s, y = new - z, g_new - g
        sy = (s * y).sum(axis=1)
        fit = sy > 1e-12
        rho = np.where(fit, 1 / np.where(fit, sy, 1), 0.0)
        left = np.eye(3) - rho[:, None, None] * s[:, :, None] * y[:, None, :]
        fresh = left @ inverse @ left.transpose(0, 2, 1) + rho[:, None, None] * s[:, :, None] * s[:, None, :]
        inverse = np.where(fit[:, None, None], fresh, np.eye(3))
        if not np.abs(s).max(initial=0):
            break
        z, f, g = new, f_new, g_new
    return z, np.abs(g).max(axis=1) < 1e-3


def fit(series: list[np.ndarray]) -> list[dict]:
    """cond_vol (of the next return), omega, alpha, beta, n, converged of each series of returns."""
    out = [{"cond_vol": float(r.std()) if len(r) else 0.0, "omega": 0.0, "alpha": 0.0, "beta": 0.0, "n": len(r), "converged": False} for r in series]
    own = [k for k, r in enumerate(series) if len(r) >= LEAST and r.var() > 0]
    if not own:
        return out
    longest = max(len(series[k]) for k in own)
    e2, live = np.zeros((len(own), longest)), np.zeros((len(own), longest), bool)
    for i, k in enumerate(own):
        r = series[k]
        e2[i, longest - len(r) :], live[i, longest - len(r) :] = (r - r.mean()) ** 2, True
    var = e2.sum(axis=1) / live.sum(axis=1)
    best, z = np.full(len(own), np.inf), np.zeros((len(own), 3))
    for p, a, c in GRID:
        start = np.tile([_logit(p / LIMIT), _logit(a), c], (len(own), 1))
        f = loss(start, e2, live, var)[0]
        z, best = np.where((f < best)[:, None], start, z), np.minimum(f, best)
    z, done = minimise(z, e2, live, var)
    h, (omega, alpha, beta) = loss(z, e2, live, var)[2], model(z, var)
    for i, k in enumerate(own):
        out[k] |= {"cond_vol": float(np.sqrt(h[i])), "omega": float(omega[i]), "alpha": float(alpha[i]), "beta": float(beta[i]), "converged": bool(done[i])}
    return out
