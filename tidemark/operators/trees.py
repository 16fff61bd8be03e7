"""Models fitted within one task, on NumPy arrays: features scaled to deviation 1, and a function that predicts.

Trees are grown level by level for all features at once from histograms of up to `bins` quantile bins, so that a level
is one count over (node, feature, bin).
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np

Predict = Callable[[np.ndarray], np.ndarray]


def _edges(x: np.ndarray, bins: int) -> list[np.ndarray]:
    return [np.unique(np.quantile(c, np.arange(1, bins) / bins, method="lower")) for c in x.T]


def _binned(x: np.ndarray, edges: list[np.ndarray]) -> np.ndarray:
    return np.column_stack([np.searchsorted(e, c, "left") for e, c in zip(edges, x.T)])


def _grow(binned: np.ndarray, bins: int, y: np.ndarray, weight: np.ndarray, depth: int, leaf: float, chosen: Callable | None = None) -> list[tuple]:
    """Levels of (feature, bin, goes on) by node, and the mean of each node. Rows at or below the bin go left. A split needs `leaf` weight on either side and less variance."""
    k = binned.shape[1]
    node = np.zeros(len(y), np.int64)
    levels = []
    for level in range(depth + 1):
        n = 1 << level
        total, count = np.bincount(node, weight * y, n), np.bincount(node, weight, n)
        mean = np.divide(total, count, out=np.zeros(n), where=count > 0)
        if level == depth:
            levels.append((np.zeros(n, int), np.zeros(n, int), np.zeros(n, bool), mean, count))
            break
        slot = ((node[:, None] * k + np.arange(k)) * bins + binned).ravel()
        c = np.bincount(slot, np.repeat(weight, k), n * k * bins).reshape(n, k, bins).cumsum(2)
        s = np.bincount(slot, np.repeat(weight * y, k), n * k * bins).reshape(n, k, bins).cumsum(2)
        rest_c, rest_s = count[:, None, None] - c, total[:, None, None] - s
        ok = (c >= leaf) & (rest_c >= leaf)
        gain = np.where(ok, s**2 / np.maximum(c, 1e-12) + rest_s**2 / np.maximum(rest_c, 1e-12), -np.inf)
        if chosen is not None:
            gain[~chosen(n, k)] = -np.inf
        best = gain.reshape(n, -1).argmax(1)
        value = gain.reshape(n, -1)[np.arange(n), best]
        goes = value > np.divide(total**2, count, out=np.zeros(n), where=count > 0) + 1e-12
        feature, cut = np.divmod(best, bins)
        levels.append((feature, cut, goes, mean, count))
        right = binned[np.arange(len(y)), feature[node]] > cut[node]
        node = node * 2 + (right & goes[node])
    return levels


def _apply(levels: list[tuple], binned: np.ndarray) -> np.ndarray:
    node, out, live = np.zeros(len(binned), np.int64), np.zeros(len(binned)), np.ones(len(binned), bool)
    for feature, cut, goes, mean, _ in levels:
        out[live] = mean[node[live]]
        live = live & goes[node]
        right = binned[np.arange(len(binned)), feature[node]] > cut[node]
        node = node * 2 + (right & goes[node])
    return out


def forest(x: np.ndarray, y: np.ndarray, trees: int = 100, depth: int = 5, leaf: int = 20, bins: int = 32, seed: int = 42) -> Predict:
    """The mean of trees grown on bootstrap samples, all features at every split."""
    rng = np.random.default_rng(seed)
    edges = _edges(x, bins)
    own = _binned(x, edges)
    grown = []
    for _ in range(trees):
        weight = np.bincount(rng.integers(0, len(y), len(y)), minlength=len(y)).astype(float)
        grown.append(_grow(own, bins, y, weight, depth, leaf))

    def predict(new: np.ndarray) -> np.ndarray:
        codes = _binned(new, edges)
        return np.mean([_apply(t, codes) for t in grown], axis=0)

    return predict


def boosting(x: np.ndarray, y: np.ndarray, trees: int = 100, depth: int = 3, rate: float = 0.1, leaf: int = 20, bins: int = 32) -> Predict:
    """Gradient boosting of squared errors."""
    edges = _edges(x, bins)
    own = _binned(x, edges)
    base, weight, grown = float(y.mean()), np.ones(len(y)), []
    now = np.full(len(y), base)
    for _ in range(trees):
        grown.append(_grow(own, bins, y - now, weight, depth, leaf))
        now = now + rate * _apply(grown[-1], own)

    def predict(new: np.ndarray) -> np.ndarray:
        codes = _binned(new, edges)
        return base + rate * np.sum([_apply(t, codes) for t in grown], axis=0)

    return predict


def svr(x: np.ndarray, y: np.ndarray, c: float = 1.0, epsilon: float = 0.0, rounds: int = 100) -> Predict:
    """Linear support vector regression: half the squared weights plus c times the sum of absolute errors beyond epsilon.

    Newton steps on errors smoothed within a band that narrows; the intercept is penalised like a weight.
    """
    z = np.column_stack([x, np.ones(len(x))])
    w = np.zeros(z.shape[1])
    band = max(float(np.abs(y).max(initial=0)), 1e-6)

    def loss(w, band):
        over = np.maximum(np.abs(y - z @ w) - epsilon, 0)
        return w @ w / 2 + c * np.where(over < band, over**2 / (2 * band), over - band / 2).sum()

    for _ in range(rounds):
        r = y - z @ w
        over = np.maximum(np.abs(r) - epsilon, 0)
        slope = np.sign(r) * np.minimum(over / band, 1)
        inner = (over > 0) & (over < band)
        step = np.linalg.solve(np.eye(len(w)) + c / band * z[inner].T @ z[inner], w - c * z.T @ slope)
        size, at = 1.0, loss(w, band)
        while size > 1e-6 and loss(w - size * step, band) > at:
            size /= 2
        w = w - size * step
        if np.abs(size * step).max() < 1e-3 * max(np.abs(w).max(), 1e-9):
            if band < 1e-5:
                break
            band /= 4
    return lambda new: np.column_stack([new, np.ones(len(new))]) @ w


def pca_ridge(x: np.ndarray, y: np.ndarray, components: int = 10, alpha: float = 1.0) -> Predict:
    """Ridge regression on the leading principal components."""
    _, _, axes = np.linalg.svd(x - x.mean(0), full_matrices=False)
    axes = axes[: min(components, x.shape[1])].T
    z = (x - x.mean(0)) @ axes
    w = np.linalg.solve(z.T @ z + alpha * np.eye(z.shape[1]), z.T @ (y - y.mean()))
    return lambda new: y.mean() + (new - x.mean(0)) @ axes @ w


MODELS = {"forest": forest, "boosting": boosting, "svr": svr, "pca_ridge": pca_ridge}
