"""Split search on one histogram: every cut or bipartition that is looked at, and the best."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np

#: The missing bin counts as empty where both its sums are under this share of the absolute sums.
NEGLIGIBLE = 1e-4


@dataclass
class Split:
    """``go`` is true for bins in the predicate: missing by missing_go, b <= threshold, or b in the set. Where ``left`` is
    set rows that go are the left child. Child sums and weights are those of the left and right child."""

    col: int
    missing_go: bool
    is_seq: bool
    data: tuple[int, ...]
    left: bool
    gain: float
    wl: float
    gl: float
    hl: float
    wr: float
    gr: float
    hr: float

    def goes_left(self, b: int) -> bool:
        go = self.missing_go if b == 0 else b <= self.data[0] if self.is_seq else b in self.data
        return go if self.left else not go


def leaf_weight(g, h, reg_lambda: float, reg_alpha: float = 0.0, base=0.0):
    """argmin of (H + l) w^2 / 2 + (G + l b) w + a |w + b|; numpy or floats."""
    d = h + reg_lambda
    d = np.where(d == 0, np.nan, d)
    t = g - h * base
    return -np.sign(t) * np.maximum(np.abs(t) - reg_alpha, 0) / d - base


def leaf_score(g, h, reg_lambda: float, reg_alpha: float = 0.0, base=0.0):
    """Minus the minimum."""
    w = leaf_weight(g, h, reg_lambda, reg_alpha, base)
    return -(0.5 * (h + reg_lambda) * w * w + (g + reg_lambda * base) * w + reg_alpha * np.abs(w + base))


def _cuts(g, h, order, p, base, total) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(gains, G and H of the first part) of a cut after each place of ``order``; -inf where it is no cut."""
    gs, hs = np.cumsum(g[order]), np.cumsum(h[order])
    full = (g[order] != 0) | (h[order] != 0)
    rest_g, rest_h = total[0] - gs, total[1] - hs
    with np.errstate(all="ignore"):
        gain = leaf_score(gs, hs, p.reg_lambda, p.reg_alpha, base) + leaf_score(rest_g, rest_h, p.reg_lambda, p.reg_alpha, base)
        gain = gain - leaf_score(total[0], total[1], p.reg_lambda, p.reg_alpha, base)
    ok = full & (hs >= p.min_node_hess) & (rest_h >= p.min_node_hess) & np.isfinite(gain) & (gain >= p.min_gain)
    ok[-1:] = False
    return np.where(ok, gain, -np.inf), gs, hs


def _oriented(col, missing_go, is_seq, data, gain, g1, h1, total, p, base) -> Split | None:
    g2, h2 = total[0] - g1, total[1] - h1
    w1, w2 = (float(leaf_weight(g, h, p.reg_lambda, p.reg_alpha, base)) for g, h in ((g1, h1), (g2, h2)))
    if not (np.isfinite(w1) and np.isfinite(w2)):
        return None
    one, two = (w1, float(g1), float(h1)), (w2, float(g2), float(h2))
    left = h1 >= h2  # the left child has the larger hessian
    return Split(col, missing_go, is_seq, tuple(map(int, data)), bool(left), float(gain), *(one + two if left else two + one))


@dataclass
class Candidates:
    """Every way to part the filled bins of a histogram that the search looks at: gain (-inf where it is not allowed), and
    G and H of the first part. Of equal gains the first counts."""

    col: int
    categorical: bool
    g: np.ndarray
    h: np.ndarray
    total: tuple[float, float]
    gain: np.ndarray
    first_g: np.ndarray
    first_h: np.ndarray
    bins: Callable[[int], np.ndarray]  # of the first part
    missing_first: np.ndarray | None = None  # sequential: whether the missing bin is in the first part
    cut: np.ndarray | None = None  # sequential: its last bin

    def allowed(self) -> np.ndarray:
        return np.flatnonzero(np.isfinite(self.gain))

    def split(self, i: int, p, base: float = 0.0) -> Split | None:
        """The i-th as a split. Of a categorical column the smaller side is the set, at a tie this one; bin 0 becomes missing_go."""
        if not self.categorical:
            return _oriented(self.col, bool(self.missing_first[i]), True, (self.cut[i],), self.gain[i], self.first_g[i], self.first_h[i], self.total, p, base)
        ids, full = self.bins(i), np.flatnonzero((self.g != 0) | (self.h != 0))
        if len(ids) > len(full) - len(ids):
            ids = np.setdiff1d(full, ids)
        return _oriented(self.col, bool((ids == 0).any()), False, np.sort(ids[ids != 0]), self.gain[i], self.g[ids].sum(), self.h[ids].sum(), self.total, p, base)


def candidates(col: int, g: np.ndarray, h: np.ndarray, categorical: bool, p, base: float = 0.0) -> Candidates | None:
    """p: reg_lambda, reg_alpha, min_gain, min_node_hess, max_brute_bins."""
    g, h = g.astype(float).copy(), h.astype(float).copy()
    if abs(g[0]) < NEGLIGIBLE * np.abs(g).sum() and abs(h[0]) < NEGLIGIBLE * np.abs(h).sum():
        g[0] = h[0] = 0
    full = np.flatnonzero((g != 0) | (h != 0))
    if len(g) < 2 or len(full) < 2:
        return None
    total, n = (g.sum(), h.sum()), len(g)
    if not categorical:
        orders = [np.arange(n)] + ([np.append(np.arange(1, n), 0)] if g[0] != 0 or h[0] != 0 else [])
        found = [_cuts(g, h, order, p, base, total) for order in orders]
        gain, gs, hs = (np.concatenate(x) for x in zip(*found, strict=True))
        missing = np.repeat(np.arange(len(orders)) == 0, n)
        cut = np.concatenate([np.arange(n) + k for k in range(len(orders))])
        return Candidates(col, False, g, h, total, gain, gs, hs, lambda i: orders[i // n][: i % n + 1], missing, cut)
    if len(full) <= p.max_brute_bins:
        m = len(full) - 1  # the last bin is always on the other side
        side = (np.arange(1, 1 << m)[:, None] >> np.arange(m)) & 1
        gs, hs = (side * g[full[:m]]).sum(axis=1), (side * h[full[:m]]).sum(axis=1)
        with np.errstate(all="ignore"):
            gain = leaf_score(gs, hs, p.reg_lambda, p.reg_alpha, base) + leaf_score(total[0] - gs, total[1] - hs, p.reg_lambda, p.reg_alpha, base)
            gain = gain - leaf_score(*total, p.reg_lambda, p.reg_alpha, base)
        ok = (hs >= p.min_node_hess) & (total[1] - hs >= p.min_node_hess) & np.isfinite(gain) & (gain >= p.min_gain)
        return Candidates(col, True, g, h, total, np.where(ok, gain, -np.inf), gs, hs, lambda i: full[:m][side[i] == 1])
    ratio = g[full] / (h[full] + p.reg_lambda / n)
    order = full[np.argsort(ratio, kind="stable")]
    return Candidates(col, True, g, h, total, *_cuts(g, h, order, p, base, total), lambda i: order[: i + 1])


def best_split(col: int, g: np.ndarray, h: np.ndarray, categorical: bool, p, base: float = 0.0) -> Split | None:
    """The best split of one histogram."""
    found = candidates(col, g, h, categorical, p, base)
    if found is None:
        return None
    i = int(np.argmax(found.gain))
    return found.split(i, p, base) if np.isfinite(found.gain[i]) else None
