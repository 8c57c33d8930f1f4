import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.functions import scalar
from tessera.operators import fitting, graph, grid, raster, solve, spectra, votes, windows
from tessera.operators.grid import bin_of


@pytest.mark.parametrize(("size", "bins"), [(7, 3), (5, 2), (37, 8), (480, 8), (53, 53)])
def test_bins_match_integer_edges(spark, size, bins):
    edges = np.linspace(0, size, bins + 1, dtype=int)
    want = [int(np.searchsorted(edges, x, "right") - 1) for x in range(size)]
    got = [r[0] for r in spark.range(size).select(bin_of(F.col("id"), size, bins)).collect()]
    assert got == want


def test_grid_conserves_and_nulls_percentages(spark):
    rows = [(x, y, (x + y) % 4, not (y == 0), x == 1) for x in range(7) for y in range(5)]
    px = spark.createDataFrame(rows, "x int, y int, label int, valid boolean, excluded boolean")
    assert grid.conservation_faults(px, 7, 5, 3, 2).count() == 0
    none = grid.composition(px.withColumn("valid", F.lit(False)), 7, 5, 3, 2)
    assert {r.status for r in none.collect()} == {"no_scan"}
    assert none.where("layer1_coverage is not null or layer1_composition is not null").count() == 0


def test_overlapping_rectangles_count_once(spark):
    px = spark.createDataFrame([(x, y) for x in range(4) for y in range(4)], "x int, y int")
    boxes = spark.createDataFrame([(0, 0, 2, 2), (1, 1, 3, 3)], "x1 int, y1 int, x2 int, y2 int")
    assert grid.mark_rectangles(px, boxes).where("excluded").count() == 7
    assert grid.mark_rectangles(px, boxes.limit(0)).where("excluded").count() == 0
    assert sorted(map(str, grid._mark_by_cells(px, boxes, "excluded", 2).collect())) == sorted(map(str, grid.mark_rectangles(px, boxes).collect()))


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_components_match_union_find(spark, seed):
    rng = np.random.default_rng(seed)
    edges = [(int(a), int(b)) for a, b in rng.integers(0, 120, (90, 2))] + [(i, i + 1) for i in range(200, 240)]
    parent = {x: x for e in edges for x in e}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        a, b = root(a), root(b)
        parent[max(a, b)] = min(a, b)
    got = {r.node: r.component for r in graph.connected_components(spark.createDataFrame(edges, "src long, dst long")).collect()}
    assert got == {x: root(x) for x in parent}


def _shapes(n):
    up = list(range(n))
    half = n // 2
    return {
        "path": list(zip(up, up[1:], strict=False)),
        "zigzag": list(zip([0, *up[:0:-1]], up[:0:-1], strict=False)),
        "comb": [(i, i + 1) for i in range(half - 1)] + [(i, i + half) for i in range(half)],
        "outer comb": [(i + half, i + half + 1) for i in range(half - 1)] + [(i, i + half) for i in range(half)],
        "star": [(n - 1, i) for i in range(n - 1)],
    }


@pytest.mark.parametrize("shape", ["path", "zigzag", "comb", "outer comb", "star"])
def test_components_of_long_shapes(spark, shape, monkeypatch):
    rounds = []
    starry = graph._is_starry
    monkeypatch.setattr(graph, "_is_starry", lambda e: rounds.append(1) or starry(e))
    edges = _shapes(20_000)[shape]
    found = graph.connected_components(spark.createDataFrame(edges, "src long, dst long"))
    assert found.where("component <> 0").isEmpty()
    assert found.count() == len({x for e in edges for x in e})
    assert len(rounds) <= 20


def test_components_keep_loops_and_names(spark):
    edges = [("b", "c"), ("c", "a"), ("d", "d"), ("c", "c"), (None, "e")]
    found = graph.connected_components(spark.createDataFrame(edges, "src string, dst string"))
    assert {r.node: r.component for r in found.collect()} == {"a": "a", "b": "a", "c": "a", "d": "d"}


def test_components_of_nothing(spark):
    assert graph.connected_components(spark.createDataFrame([(None, 1)], "src long, dst long")).count() == 0


@pytest.mark.parametrize("held", [graph.HELD, 20])
def test_components_by_ranges_cross_them(spark, held, monkeypatch):
    """Shapes side by side, by names; with few edges held the parts are linked by rounds."""
    monkeypatch.setattr(graph, "HELD", held)
    edges, want = [(None, "a"), ("z", "z")], {("z", "z")}
    for name, pairs in _shapes(60).items():
        name = name.replace(" ", "-")
        edges += [(f"{name}{a:03}", f"{name}{b:03}") for a, b in pairs]
        want |= {(f"{name}{x:03}", f"{name}000") for p in pairs for x in p}
    found = graph.range_components(spark.createDataFrame(edges, "src string, dst string"))
    assert {tuple(r) for r in found.collect()} == want


def test_a_long_scan_is_parted_without_rounds(spark, monkeypatch):
    rounds = []
    starry = graph._is_starry
    monkeypatch.setattr(graph, "_is_starry", lambda e: rounds.append(1) or starry(e))
    at = spark.range(20_000)
    edges = at.selectExpr("id as src", "id + 1 as dst", "1.5D as dx", "0.0D as dy", "1.0D as w").where("src <> 9999")
    found = solve.solve_positions(edges)
    assert {tuple(r) for r in found.groupBy("component").count().collect()} == {(0, 10_000), (10_000, 10_001)}
    assert not rounds


def _flood(mask):
    names, seen = {}, np.zeros(mask.shape, bool)
    for y, x in zip(*np.nonzero(mask), strict=True):
        todo, name = [(y, x)], (y, x)
        while todo:
            a, b = todo.pop()
            if 0 <= a < mask.shape[0] and 0 <= b < mask.shape[1] and mask[a, b] and not seen[a, b]:
                seen[a, b] = True
                names[(a, b)] = name
                todo += [(a + 1, b), (a - 1, b), (a, b + 1), (a, b - 1)]
    return names


def test_raster_components_and_holes(spark):
    mask = np.random.default_rng(5).random((12, 15)) < 0.55
    rows = [("i", int(x), int(y), bool(mask[y, x])) for y in range(12) for x in range(15)]
    px = spark.createDataFrame(rows, "image string, x int, y int, m boolean")
    got = {(r.y, r.x): r.component for r in raster.label_components(px, "image", F.col("m")).collect()}
    want = _flood(mask)
    assert set(got) == set(want)
    assert len(set(got.values())) == len(set(want.values()))
    assert all(got[k] == v[0] * 1_000_003 + v[1] for k, v in want.items())
    outside = {v for k, v in _flood(~mask).items() if k[0] in (0, 11) or k[1] in (0, 14)}
    holes = sum(v not in outside for v in _flood(~mask).values())
    assert raster.fill_holes(px, "image", "m").where("m").count() == mask.sum() + holes


def test_stencils_match_numpy(spark):
    a = np.random.default_rng(2).integers(0, 255, (9, 11)).astype(float)
    px = spark.createDataFrame([("i", x, y, float(a[y, x])) for y in range(9) for x in range(11)], "image string, x int, y int, grey double")
    m = raster.tile_metrics(px, "image").head()
    lap = a[1:-1, :-2] + a[1:-1, 2:] + a[:-2, 1:-1] + a[2:, 1:-1] - 4 * a[1:-1, 1:-1]
    assert m["mean"] == pytest.approx(a.mean()) and m["std"] == pytest.approx(a.std()) and m["focus"] == pytest.approx(lap.var())
    var = {(r.y, r.x): r.variance for r in raster.local_variance(px, "image", 1).collect()}
    assert var[4, 5] == pytest.approx(a[3:6, 4:7].var()) and var[0, 0] == pytest.approx(a[:2, :2].var())


def test_border_trim(spark):
    px = spark.createDataFrame(
        [("i", x, y, not (x == 5 and y == 5)) for x in range(11) for y in range(11)], "image string, x int, y int, valid boolean"
    )
    kept = raster.trim_border(px, "image", 11, 11, 3).where("valid").count()
    assert kept == sum((x - 5) ** 2 + (y - 5) ** 2 >= 9 for x in range(11) for y in range(11))


def test_positions_are_recovered(spark):
    rng = np.random.default_rng(4)
    place = {i: (100.0 * (i % 5) + rng.random(), 80.0 * (i // 5) + rng.random()) for i in range(20)}
    pairs = [(i, i + 1) for i in range(20) if i % 5 < 4] + [(i, i + 5) for i in range(15)]
    rows = [(a, b, place[b][0] - place[a][0], place[b][1] - place[a][1], 1.0) for a, b in pairs] + [(50, 51, 1.0, 2.0, 1.0)]
    edges = spark.createDataFrame(rows, "src long, dst long, dx double, dy double, w double")
    got = {r.id: r for r in solve.solve_positions(edges).collect()}
    assert got[50].component == 50 and got[0].component == 0
    assert all(abs(got[i].x - got[0].x - place[i][0] + place[0][0]) < 1e-6 for i in range(20))
    assert solve.residuals(edges, solve.solve_positions(edges)).agg(F.max("residual")).head()[0] < 1e-6


def test_gains_even_out_a_step(spark):
    true = {i: 1.0 if i % 4 < 2 else 0.9 for i in range(12)}
    pairs = [(i, i + 1) for i in range(12) if i % 4 < 3] + [(i, i + 4) for i in range(8)]
    rows = [(a, b, a % 4, b % 4, true[b] / true[a]) for a, b in pairs]
    gains = {r.id: r.gain for r in solve.solve_gains(spark.createDataFrame(rows, "src long, dst long, src_col int, dst_col int, ratio double")).collect()}
    levels = [gains[i] * true[i] for i in true]
    assert max(levels) / min(levels) < 1.01


def test_fit_recovers_two_peaks():
    x = np.linspace(1.55, 2.5, 1300)
    y = 0.1 + 0.02 * x + np.exp(-((x - 1.85) ** 2) / (2 * 0.03**2)) + 0.5 * np.exp(-((x - 2.0) ** 2) / (2 * 0.04**2)) + np.random.default_rng(1).normal(0, 0.01, 1300)
    f = fitting.fit_one(x, y)
    assert f["ea"] == pytest.approx(1.85, abs=0.003) and f["eb"] == pytest.approx(2.0, abs=0.005)
    assert fitting.fit_one(x[:100], y[:100]) is None


def test_ties_are_undecided(spark):
    rows = [(1, "a", 0.5), (1, "b", 0.9), (2, "a", 0.1), (2, "a", 0.1), (2, None, 1.0), (3, None, 1.0)]
    got = {r.item: r for r in votes.tally(spark.createDataFrame(rows, "item int, category string, confidence double"), "item", "category", "confidence").collect()}
    assert got[1].label is None and got[1].split and got[2].label == "a" and not got[2].split and 3 not in got


def test_split_vote_keeps_and_asks(spark):
    rows = [(1, "x", 0.5, True), (1, "y", 0.9, False), (1, "y", 0.9, True), (2, "x", 0.1, True)]
    tally = votes.tally(spark.createDataFrame(rows, "item int, category string, confidence double, ex boolean"), "item", "category", "confidence", "ex")
    got = {r.item: r for r in votes.keep_or_exclude(tally).collect()}
    assert not got[1].exclude and got[1].needs_human and got[2].exclude and not got[2].needs_human


def test_chain_and_snake(spark):
    got = windows.snake_path(spark, 3, 2, 1.0, 1.0).orderBy("sequence").collect()
    assert [(r.col, r.row) for r in got] == [(0, 0), (0, 1), (1, 1), (1, 0), (2, 0), (2, 1)]


def test_scalars(spark):
    row = spark.range(1).select(
        scalar.as_bool(F.lit(" YES ")), scalar.human_bytes(F.lit(1536)), scalar.json_part(F.lit('so: {"a": {"b": 1}} ok')),
        scalar.vertex(F.lit(1.0), F.lit(3.0), F.lit(1.0)), scalar.shape_of(F.lit("a12_b3")), scalar.apply_gain(F.lit(250), F.lit(1.5))
    ).head()
    assert list(row) == [True, "1.5 KB", '{"a": {"b": 1}}', 0.0, "a#_b#", 255]


def test_interpolation_clamps(spark):
    df = spark.createDataFrame([([0.0, 1.0, 3.0], [0.0, 10.0, 30.0])], "x array<double>, y array<double>")
    assert df.select(spectra.interpolate([-1.0, 0.5, 2.0, 9.0], "y", "x")).head()[0] == [0.0, 5.0, 20.0, 30.0]
