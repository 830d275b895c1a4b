import itertools
import math

import numpy as np
import pytest

from arborlane.operators import splits as P
from arborlane.params import Params


@pytest.mark.parametrize("g,h,lam,alpha,base,expected", [(3, 2, 1, 0.5, 0, -0.8333), (-3, 2, 1, 0.5, 0, 0.8333), (0.2, 2, 1, 0.5, 0, 0), (1, 2, 1, 0.5, 0.7, -0.7), (-1, 2, 1, 2, 0.4, -0.4)])
def test_weight_is_the_minimum(g, h, lam, alpha, base, expected):
    w = float(P.leaf_weight(g, h, lam, alpha, base))
    assert w == pytest.approx(expected, abs=1e-4)
    at = lambda w: 0.5 * (h + lam) * w * w + (g + lam * base) * w + alpha * abs(w + base)
    grid = np.linspace(-3, 3, 60_001)
    assert at(w) <= min(map(at, grid)) + 1e-9
    assert float(P.leaf_score(g, h, lam, alpha, base)) == pytest.approx(-at(w))


def _direct(g, h, p):
    """All cuts of both scans, by loops."""
    best = None
    n = len(g)
    score = lambda a, b: a * a / (2 * (b + p.reg_lambda))
    G, H = sum(g), sum(h)
    for right, order in ((0, list(range(n))), (1, [*range(1, n), 0])):
        if right and not (g[0] or h[0]):
            continue
        a = b = 0.0
        for i in order[:-1]:
            a, b = a + g[i], b + h[i]
            if not (g[i] or h[i]) or b < p.min_node_hess or H - b < p.min_node_hess:
                continue
            gain = score(a, b) + score(G - a, H - b) - score(G, H)
            if gain >= p.min_gain and (best is None or gain > best[0] + 1e-12):
                best = (gain, right, i)
    return best


def test_sequential_against_loops():
    rng = np.random.default_rng(1)
    p = Params(min_node_hess=1.0)
    for _ in range(6):
        g, h = rng.integers(-9, 10, 9).astype(float), rng.integers(0, 4, 9).astype(float)
        g[h == 0] = 0
        s, d = P.best_split(0, g, h, False, p), _direct(g, h, p)
        assert (s is None) == (d is None)
        if s is None:
            continue
        assert s.gain == pytest.approx(d[0]) and s.missing_go == (d[1] == 0) and s.data == (d[2],)
        assert s.hl >= s.hr and s.hl + s.hr == pytest.approx(h.sum()) and s.gl + s.gr == pytest.approx(g.sum())


def test_brute_is_the_best_bipartition():
    g, h = np.array([0.0, 5, -4, 3, -2]), np.array([0.0, 1, 1, 1, 1])
    p = Params(min_node_hess=0.5)
    s = P.best_split(0, g, h, True, p)
    assert s.data == (1, 3) and not s.is_seq  # halves of equal size: the side without the last bin is the set
    score = lambda a, b: a * a / (2 * (b + 1))
    best = max(score(g[list(c)].sum(), len(c)) + score(g.sum() - g[list(c)].sum(), 4 - len(c)) for k in (1, 2, 3) for c in itertools.combinations((1, 2, 3, 4), k)) - score(g.sum(), 4)
    assert s.gain == pytest.approx(best)
    heuristic = P.best_split(0, g, h, True, Params(min_node_hess=0.5, max_brute_bins=0))
    assert heuristic.data == (2, 4) and heuristic.gain == pytest.approx(best)
    assert P.candidates(0, g, h, True, p).gain.max() == pytest.approx(best)


def test_missing_goes_where_it_gains():
    p = Params(min_node_hess=0.5)
    low = P.best_split(0, np.array([-9.0, -9, 9, 9]), np.ones(4), False, p)
    high = P.best_split(0, np.array([9.0, -9, 9, 9]), np.ones(4), False, p)
    assert low.missing_go and low.data == (1,) and not high.missing_go and high.data == (1,)


def test_no_split():
    p = Params()
    assert P.best_split(0, np.array([0.0, 4, 0]), np.array([0.0, 4, 0]), False, p) is None
    assert P.best_split(0, np.zeros(3), np.zeros(3), True, p) is None
    flat = P.best_split(0, np.array([0.0, 0, 0]), np.array([0.0, 2, 2]), False, p)
    assert flat.gain == 0 and not math.isnan(flat.wl)  # a gain of zero meets min_gain 0
