"""What COVERAGE.md names is there, and the queries without a twin agree with dense solutions."""

import importlib
import re
from pathlib import Path

import numpy as np

from tessera.operators import fitting, joins, solve
from tessera.plans import catalogue, models

ROWS = re.findall(r"^\| (\w+) \| (.*?) \| (.*?) \|$", (Path(__file__).resolve().parents[1] / "COVERAGE.md").read_text(), re.M)


def test_all_names_exist():
    queries = catalogue.queries()
    assert len(ROWS) > 300
    for _, functions, query in ROWS[1:]:
        for name in re.findall(r"`([\w.]+)`", functions):
            module, _, function = name.rpartition(".")
            assert hasattr(importlib.import_module(f"tessera.{module}"), function), name
        assert all(q in queries for q in re.findall(r"`(\w+)`", query)), query
    assert set(queries) - set(catalogue.oracle_sql()) == {"position_solve", "gain_solve", "spectrum_fits"}


def test_positions_match_dense_least_squares(spark, sf_dir):
    edges = models._edges(spark, sf_dir)
    rows = edges.collect()
    ids = sorted({r.src for r in rows} | {r.dst for r in rows})
    at = {i: n for n, i in enumerate(ids)}
    a = np.zeros((len(rows), len(ids)))
    for n, r in enumerate(rows):
        a[n, at[r.src]], a[n, at[r.dst]] = -1, 1
    got = {r.id: r for r in solve.solve_positions(edges).collect()}
    for axis in "xy":
        want = np.linalg.lstsq(a, np.array([r[f"d{axis}"] for r in rows], float), rcond=None)[0]
        mine = np.array([got[i][axis] for i in ids])
        assert np.allclose(a @ mine, a @ want, atol=1e-5)


def test_gains_even_out_what_a_plain_fit_does(spark, sf_dir):
    """Without outliers the solved gains leave no more than a dense fit of the same equations leaves, and a little."""
    edges = models._edges(spark, sf_dir)
    rows = edges.collect()
    gains = {r.id: r.gain for r in solve.solve_gains(edges).collect()}
    before = np.sqrt(np.mean([np.log(r.ratio) ** 2 for r in rows]))
    after = np.sqrt(np.mean([(np.log(r.ratio) + np.log(gains[r.dst]) - np.log(gains[r.src])) ** 2 for r in rows]))
    assert after < before or before < 1e-9


def test_fits_find_known_parameters():
    rng, x = np.random.default_rng(2), np.linspace(1.6, 2.3, 1000)
    for _ in range(10):
        p = np.array([rng.uniform(1.78, 1.9), rng.uniform(0.02, 0.05), rng.uniform(0.5, 2), rng.uniform(1.95, 2.05), rng.uniform(0.02, 0.05), rng.uniform(0.5, 2), 0.1, 0.2, 0.1])
        f = fitting.fit_one(x, fitting.model(p, x) + rng.normal(0, 0.004, len(x)))
        assert abs(f["ea"] - p[0]) < 0.003 and abs(f["eb"] - p[3]) < 0.003 and abs(f["split_mev"] - 1000 * (p[3] - p[0])) < 5
    near_edge = np.array([1.763, 0.03, 1.0, 2.0, 0.03, 1.0, 0.1, 0.0, 0.0])
    assert fitting.fit_one(x, fitting.model(near_edge, x)) is None
    assert fitting.fit_one(x, rng.normal(0, 1, len(x))) is None


def test_greedy_groups_on_a_chain(spark):
    pairs = [(i, i + 1) for i in range(9)] + [(20, 22), (20, 21), (21, 23)]
    got = {(r.leader, r.member) for r in joins.first_seen_groups(spark.createDataFrame(pairs, "a long, b long")).collect()}
    assert got == {(0, 1), (2, 3), (4, 5), (6, 7), (8, 9), (20, 21), (20, 22)}
