"""Plain versions that operators are held against."""

from __future__ import annotations

from itertools import combinations
from math import exp, log

import numpy as np


def poisson_fit(x: np.ndarray, y: np.ndarray, rounds: int = 100) -> tuple[np.ndarray, float, bool]:
    """Iteratively reweighted least squares: coefficients, log-likelihood and whether it settled."""
    mu = y + 0.5
    eta = np.log(mu)
    beta = np.zeros(x.shape[1])
    for _ in range(rounds):
        z = eta + (y - mu) / mu
        w = np.sqrt(mu)
        new = np.linalg.lstsq(x * w[:, None], z * w, rcond=None)[0]
        eta = np.clip(x @ new, -30, 30)
        mu = np.exp(eta)
        done = np.allclose(new, beta, rtol=1e-9, atol=1e-9)
        beta = new
        if done:
            break
    fit = float((y * eta - mu).sum() - sum(log(k) for v in y for k in range(2, int(v) + 1)))
    return beta, fit, bool(done and np.isfinite(beta).all())


def loglinear(counts: dict[str, int], limit: float = 3.0) -> dict:
    """The log-linear model of least AIC over main effects and every set of pairwise terms.

    counts: pattern -> n, all patterns but the empty one (a row for each; their number is bounded by the arms).
    Refusals in order: no records, no model settled, an empty arm, a chosen interaction with an empty cell of just that
    pair, and an estimate above ``limit`` times what was seen. No interval is given.
    """
    patterns = sorted(counts)
    y = np.array([counts[p] for p in patterns], float)
    seen = int(y.sum())
    out: dict = {"n_observed": seen, "estimable": False, "reason": None, "n_hat": None, "recall": None, "terms": None, "aic": None}
    if not seen:
        return out | {"reason": "no_records"}
    k = len(patterns[0])
    hit = np.array([[int(c) for c in p] for p in patterns], float)
    pairs = list(combinations(range(k), 2))
    best: tuple | None = None
    for size in range(len(pairs) + 1):
        for terms in combinations(pairs, size):
            x = np.column_stack([np.ones(len(y)), hit, *(hit[:, i] * hit[:, j] for i, j in terms)])
            if x.shape[1] > len(y):
                continue
            beta, fit, ok = poisson_fit(x, y)
            aic = 2 * x.shape[1] - 2 * fit
            if ok and (best is None or aic < best[0] - 1e-9):
                best = aic, terms, exp(beta[0])
    if best is None:
        return out | {"reason": "not_converged"}
    aic, terms, unseen = best
    out |= {"terms": [f"{i}:{j}" for i, j in terms], "aic": aic}
    if any(not (hit[:, i] * y).sum() for i in range(k)):
        return out | {"reason": "empty_arm"}
    only = {p: "".join("1" if i in p else "0" for i in range(k)) for p in pairs}
    if terms and any(not counts[only[p]] for p in pairs):
        return out | {"reason": "empty_pair_cell"}
    if seen + unseen > limit * seen:
        return out | {"reason": "implausible"}
    return out | {"estimable": True, "n_hat": seen + unseen, "recall": seen / (seen + unseen)}
