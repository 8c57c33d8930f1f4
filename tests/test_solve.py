import weakref

import numpy as np
import pandas as pd
import pytest

from tessera.operators import solve


def grid(rows, cols):
    """The edges of a grid with tiles numbered along its columns; more than the solvers once took."""
    at = np.arange(rows * cols).reshape(cols, rows)
    src, dst = np.concatenate([at[:, :-1].ravel(), at[:-1].ravel()]), np.concatenate([at[:, 1:].ravel(), at[1:].ravel()])
    assert len(src) > 400_000
    return src, dst


def test_positions_of_a_long_scan_are_recovered():
    rng, (src, dst) = np.random.default_rng(1), grid(50, 4200)
    place = np.arange(210_000) // 50 * 100.0 + rng.random(210_000), np.arange(210_000) % 50 * 80.0 + rng.random(210_000)
    edges = pd.DataFrame({"src": src, "dst": dst, "dx": place[0][dst] - place[0][src], "dy": place[1][dst] - place[1][src], "w": rng.uniform(0.1, 3, len(src))})
    got = solve._positions(edges.sample(frac=1, random_state=1))
    for c, true in zip("xy", place, strict=True):
        off = got[c].to_numpy() - true[got["id"].to_numpy()]
        assert np.ptp(off) < 1e-5


def test_gains_of_a_long_scan_meet_the_normal_equations():
    rng, (src, dst) = np.random.default_rng(2), grid(50, 4200)
    r = rng.normal(0, 0.02, len(src)) + (rng.random(len(src)) < 0.01) * 0.2
    edges = pd.DataFrame({"src": src, "dst": dst, "src_col": src // 50, "dst_col": dst // 50, "r": r, "n": 1})
    rounds = [solve._gains(0.03, 0.5, k)(edges)["g"].to_numpy() for k in (1, 2)]
    error = np.abs(rounds[0][dst] - rounds[0][src] - r)
    for g, w in zip(rounds, (np.ones(len(r)), np.where(error <= 0.03, 1.0, 0.03 / error)), strict=True):
        pull = w * (g[dst] - g[src] - r)
        left = np.bincount(dst, pull, len(g)) - np.bincount(src, pull, len(g))
        own = g - g.reshape(-1, 50).mean(axis=1).repeat(50)
        assert np.abs(left + 0.5 * own).max() < 1e-8 and np.abs(left.reshape(-1, 50).sum(axis=1)).max() < 1e-8


def test_solvers_take_stars_pairs_and_repeated_edges():
    hub = pd.DataFrame({"src": 0, "dst": np.arange(1, 3001), "dx": np.arange(1, 3001) / 7, "dy": 1.0, "w": 2.0})
    got = solve._positions(pd.concat([hub, hub.rename(columns={"src": "dst", "dst": "src"}).assign(dx=-hub["dx"], dy=-1.0)]))
    assert np.allclose(got["x"].to_numpy()[1:], hub["dx"], atol=1e-8) and np.allclose(got["y"].to_numpy()[1:], 1.0, atol=1e-8)
    pair = solve._positions(pd.DataFrame({"src": [5], "dst": [9], "dx": [3.0], "dy": [-2.0], "w": [1.0]}))
    assert np.allclose(pair[["x", "y"]], [[0, 0], [3, -2]]) and set(pair["component"]) == {5}


@pytest.mark.parametrize(("odd", "solved"), [(0.0, 1), (0.2, 4)])
def test_gains_hold_one_graph_at_a_time_and_solve_no_round_twice(monkeypatch, odd, solved):
    made = []

    class Watched(solve.Laplacian):
        def __init__(self, src, dst, w, n):
            if n == 40 * 30 + 30:
                assert all(r() is None for r in made)
                made.append(weakref.ref(self))
            super().__init__(src, dst, w, n)

    rng, at = np.random.default_rng(5), np.arange(40 * 30).reshape(30, 40)
    src, dst = np.concatenate([at[:, :-1].ravel(), at[:-1].ravel()]), np.concatenate([at[:, 1:].ravel(), at[1:].ravel()])
    r = rng.normal(0, 0.002, len(src)) + (rng.random(len(src)) < 0.05) * odd
    edges = pd.DataFrame({"src": src, "dst": dst, "src_col": src // 40, "dst_col": dst // 40, "r": r, "n": 1})
    monkeypatch.setattr(solve, "Laplacian", Watched)
    g = solve._gains(0.03, 0.5, 4)(edges)["g"].to_numpy()
    assert len(made) == solved and len(g) == 1200
    # the fourth round of weights, solved densely
    x = np.zeros(1230)
    for k in range(4):
        error = np.abs(x[dst] - x[src] - r) if k else np.zeros(len(r))
        w = np.concatenate([np.full(1200, 0.5), np.where(error <= 0.03, 1.0, 0.03 / np.maximum(error, 1e-12))])
        a = np.zeros((1200 + len(r), 1230))
        a[np.arange(len(a)), np.concatenate([1200 + np.arange(1200) // 40, src])] -= 1
        a[np.arange(len(a)), np.concatenate([np.arange(1200), dst])] += 1
        x = np.linalg.pinv(a.T @ (w[:, None] * a), hermitian=True) @ (a.T @ (w * np.concatenate([np.zeros(1200), r])))
    assert np.allclose(g, x[:1200] - x[1200:].mean(), atol=1e-8)
