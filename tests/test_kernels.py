"""Certificates of the dense kernels: sums, bounds, optimality against grids, known constants."""

import math

import numpy as np
import pytest

from quantloom.functions import kernels as K
from quantloom.functions import stats
from quantloom.operators.volatility import fit_garch


def random_cov(n, seed):
    rng = np.random.default_rng(seed)
    a = rng.normal(size=(n + 3, n)) * rng.uniform(0.05, 0.4, n)
    return a.T @ a / (n + 2), rng.normal(0.06, 0.08, n)


def grid(n, steps=40):
    if n == 3:
        for i in range(steps + 1):
            for j in range(steps + 1 - i):
                yield np.array([i, j, steps - i - j]) / steps


@pytest.mark.parametrize("seed", range(6))
@pytest.mark.parametrize("cap", [1.0, 0.6])
def test_three_assets_beat_the_grid(seed, cap):
    cov, mu = random_cov(3, seed)
    w = K.min_volatility(cov, cap)
    inside = [x for x in grid(3) if x.max() <= cap + 1e-12]
    assert w @ cov @ w <= min(x @ cov @ x for x in inside) + 1e-12
    mu = np.abs(mu) + 0.01
    s = K.max_sharpe(mu, cov, 0.0, cap)
    assert mu @ s / math.sqrt(s @ cov @ s) >= max(mu @ x / math.sqrt(x @ cov @ x) for x in inside) - 1e-7
    for x in (w, s):
        assert abs(x.sum() - 1) < 1e-10 and x.min() >= 0 and x.max() <= cap + 1e-9


@pytest.mark.parametrize("seed", range(5))
@pytest.mark.parametrize("n,cap", [(8, 1.0), (8, 0.2), (25, 0.08), (25, 1.0)])
def test_minimum_variance_conditions(seed, n, cap):
    cov, _ = random_cov(n, seed + 100)
    w = K.min_volatility(cov, cap)
    g = cov @ w
    inner = (w > 1e-9) & (w < cap - 1e-9)
    level = g[inner].mean() if inner.any() else np.median(g)
    scale = np.abs(cov).max()
    assert np.abs(g[inner] - level).max(initial=0) < 1e-7 * scale
    assert (g[w <= 1e-9] >= level - 1e-7 * scale).all() and (g[w >= cap - 1e-9] <= level + 1e-7 * scale).all()


@pytest.mark.parametrize("seed", range(4))
def test_frontier_meets_targets(seed):
    cov, mu = random_cov(10, seed + 50)
    last = None
    for t in np.linspace(mu.min(), mu.max(), 9):
        w = K.min_volatility_at(cov, mu, t, 1.0)
        assert abs(w @ mu - t) < 1e-8 and abs(w.sum() - 1) < 1e-8 and w.min() > -1e-9
        last = w
    assert last[np.argmax(mu)] > 1 - 1e-6


@pytest.mark.parametrize("seed", range(4))
def test_risk_parity(seed):
    cov, _ = random_cov(7, seed)
    w = K.risk_parity(cov)
    c = w * (cov @ w) / (w @ cov @ w)
    assert np.abs(c - 1 / 7).max() < 1e-8
    capped = K.risk_parity(cov, 0.16)
    assert capped.max() <= 0.16 + 1e-9 and abs(capped.sum() - 1) < 1e-9


def test_hrp_leaves_and_cap():
    corr = np.array([[1, 0.9, 0.1, 0.2], [0.9, 1, 0.15, 0.1], [0.1, 0.15, 1, 0.8], [0.2, 0.1, 0.8, 1]])
    assert K.single_linkage_leaves(corr) == [0, 1, 2, 3]
    cov, _ = random_cov(9, 3)
    for cap in (1.0, 0.2):
        w = K.hierarchical_risk_parity(cov, cap)
        assert abs(w.sum() - 1) < 1e-12 and w.min() >= 0 and w.max() <= cap + 1e-9


def test_infeasible_and_special():
    with pytest.raises(K.Infeasible):
        K.min_volatility(np.eye(3), 0.2)
    with pytest.raises(K.Infeasible):
        K.min_volatility(np.array([[1.0, 2], [2, 1]]))
    assert np.allclose(K.min_volatility(np.zeros((3, 3))), 1 / 3)
    w = K.max_sharpe(np.array([-0.1, -0.2, -0.3]), np.diag([0.04, 0.09, 0.01]), 0.0, 0.5)
    assert sorted(w) == [0, 0.5, 0.5]
    assert np.allclose(K.redistribute(np.array([0.8, 0.1, 0.1]), 0.5), [0.5, 0.25, 0.25])


def test_budget():
    assert abs(K.self_financing_budget(100.0, lambda b: 0.01 * b) - 100 / 1.01) < 1e-9
    with pytest.raises(K.Infeasible):
        K.self_financing_budget(1.0, lambda b: 5.0)


def test_tails():
    v, e = stats.var_es(0, 1, 0.95)
    assert (round(v, 9), round(e, 9)) == (1.644853627, 2.062712808)
    v, e = stats.var_es(0, 1, 0.95, 5)
    assert (round(v, 6), round(e, 6)) == (1.560850, 2.238684)
    assert abs(stats.chi2_1_sf(3.841458820694124) - 0.05) < 1e-12


def test_garch_recovers_persistence():
    rng, h, r = np.random.default_rng(48), 0.05 / 0.05, []
    for _ in range(1500):
        z = rng.standard_t(7) * math.sqrt(5 / 7)
        x = math.sqrt(h) * z
        r.append(x / 100)
        h = 0.05 + 0.1 * x * x + 0.85 * h
    got = fit_garch(r)
    o, a, _, b, nu = got["params"]
    assert 0.85 < a + b < 0.999 and 0.03 < a < 0.2 and 4 < nu < 15
    assert fit_garch(r[:50]) is None
