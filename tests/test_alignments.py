"""Registration, overlaps, distances and blurs against plain numpy."""

import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.operators import lines, raster, registration
from tessera.plans import catalogue


def scene(seed, h, w):
    """Grain with some structure, brighter on one side."""
    rng = np.random.default_rng(seed)
    fine = rng.random((h, w)) * 60
    coarse = np.kron(rng.random((h // 8 + 1, w // 8 + 1)), np.ones((8, 8)))[:h, :w] * 80
    return fine + coarse + np.linspace(0, 40, w)


def overlap_ncc(a, b, dx, dy):
    h, w = a.shape
    x0, x1, y0, y1 = max(0, dx), min(w, w + dx), max(0, dy), min(h, h + dy)
    return np.corrcoef(a[y0:y1, x0:x1].ravel(), b[y0 - dy : y1 - dy, x0 - dx : x1 - dx].ravel())[0, 1]


def test_surface_is_the_correlation_of_every_overlap():
    a, b = scene(1, 21, 30), scene(2, 21, 30)
    surface, oy, ox = registration.overlap_surface(a, b, 8, 100)
    for dx, dy in ((0, 0), (7, -3), (-15, 5), (22, 0), (-4, -10)):
        assert surface[dy + oy, dx + ox] == pytest.approx(overlap_ncc(a, b, dx, dy), abs=1e-9)
    assert surface[0, 0] == -1  # 8 by 8 pixels
    flat = np.full((21, 30), 7.0)
    assert (registration.overlap_surface(registration.high_pass(flat), b, 8, 64)[0] == -1).all()


@pytest.mark.parametrize("dx,dy", [(0, 0), (40, 3), (-45, -20), (12, 30), (-3, -31)])
def test_displacements_beyond_half_an_image(dx, dy):
    whole = scene(5, 140, 180)
    y, x = np.mgrid[0:48, 0:64]
    dark = 1 - 0.4 * (((x - 32) / 32) ** 2 + ((y - 24) / 24) ** 2) / 2
    a, b = whole[40:88, 50:114] * dark, whole[40 + dy : 88 + dy, 50 + dx : 114 + dx] * dark
    a, b = registration.high_pass(a), registration.high_pass(b)
    for prior, tolerance in ((None, None), ((dx + 3.0, dy - 2.0), 5.0), ((float(dx), float(dy)), None)):
        fx, fy, ncc = registration.find_displacement(a, b, prior, tolerance)
        assert (round(fx), round(fy)) == (dx, dy) and ncc > 0.8
    # a box that doesn't hold the displacement doesn't find it
    fx, fy, ncc = registration.find_displacement(a, b, (dx + 12.0, float(dy)), 4.0)
    assert abs(fx - dx - 12) <= 5.5 and ncc < 0.5


def test_edges_with_hypotheses_and_odd_images(spark):
    whole = scene(6, 100, 140)
    cut = {1: whole[20:60, 20:70], 2: whole[25:65, 52:102], 3: np.full((40, 50), 9.0), 4: whole[:30, :30]}
    images = spark.createDataFrame([(k, *v.shape, v.ravel().tolist()) for k, v in cut.items()], "image long, h int, w int, v array<double>")
    rows = [(1, 2, 0.0, 0.0, 3.0), (1, 2, 30.0, 4.0, 5.0), (1, 2, -30.0, -4.0, 5.0), (1, 3, 5.0, 6.0, 2.0), (1, 4, 1.0, 2.0, 3.0), (2, 1, None, None, None), (1, 9, None, None, None)]
    edges = spark.createDataFrame(rows, "src long, dst long, ex double, ey double, tolerance double")
    got = {(r.src, r.dst): r for r in registration.register_edges(edges, images).collect()}
    assert set(got) == {(1, 2), (1, 3), (1, 4), (2, 1)}
    assert (round(got[1, 2].dx), round(got[1, 2].dy)) == (32, 5) and got[1, 2].ncc > 0.9
    assert (round(got[2, 1].dx), round(got[2, 1].dy)) == (-32, -5)
    assert (got[1, 3].dx, got[1, 3].dy, got[1, 3].ncc) == (5, 6, 0) and (got[1, 4].dx, got[1, 4].ncc) == (1, 0)
    assert registration.register_edges(edges.limit(0), images).count() == 0


def test_strips_slide_on_every_side():
    whole = scene(7, 200, 260)
    h, w = 80, 96
    a = whole[60 : 60 + h, 80 : 80 + w]
    for side, dx, dy in (("right", 61, 3), ("left", -63, -4), ("below", 2, 50), ("above", -5, -52)):
        b = whole[60 + dy : 60 + dy + h, 80 + dx : 80 + dx + w]
        assert registration.match_strip(a, b, side)[:2] == (dx, dy)
        assert registration.match_strip(a, b, side)[2] > 0.99
    region, strip = whole[:30, :40], whole[11:19, 5:20]
    scores = registration.slide(region, strip)
    assert scores[11, 5] == pytest.approx(1) and scores.shape == (23, 26)
    assert scores[3, 9] == pytest.approx(np.corrcoef(region[3:11, 9:24].ravel(), strip.ravel())[0, 1])
    assert registration.match_strip(a[:10, :10], a[:10, :10], "left")[2] == -1
    assert registration.match_strip(np.full((h, w), 3.0), a, "left")[2] == 0


def pixels(spark, images):
    rows = [(k, x, y, float(v[y, x])) for k, v in images.items() for y in range(v.shape[0]) for x in range(v.shape[1])]
    px = spark.createDataFrame(rows, "image long, x int, y int, grey double")
    return px.select("*", F.col("grey").alias("r"), (F.col("grey") * 0.9).alias("g"), (F.col("grey") * 0.8).alias("b"))


def test_grid_that_runs_to_the_left(spark):
    whole = scene(8, 180, 330)
    numbers = [(i, j, row, col) for i, row in enumerate((2, 5)) for j, col in enumerate((1, 3, 4))]  # with gaps
    place = {(row, col): (200 - 60 * j + (row * 3 + col) % 4, 10 + 50 * i + col % 3) for i, j, row, col in numbers}
    gains = {k: 1 + 0.1 * i for i, k in enumerate(place)}
    ids = {k: i for i, k in enumerate(place)}
    images = {ids[k]: whole[y : y + 80, x : x + 96] * gains[k] for k, (x, y) in place.items()}
    grid = spark.createDataFrame([(i, *k) for k, i in ids.items()], "image long, row int, col int")
    got = {(r.src, r.dst): r for r in registration.measured_edges(grid, pixels(spark, images)).collect()}
    at = {i: k for k, i in ids.items()}
    assert len(got) == 7
    for (a, b), r in got.items():
        ka, kb = at[a], at[b]
        assert r.side == ("left" if ka[0] == kb[0] else "below") and r.kind == ("h" if ka[0] == kb[0] else "v")
        assert (r.dx, r.dy) == (place[kb][0] - place[ka][0], place[kb][1] - place[ka][1])
        assert r.rejected is None and r.ratio_r == pytest.approx(gains[ka] / gains[kb]) and r.bright_g == pytest.approx(gains[ka] / gains[kb])
    noise = {i: np.random.default_rng(i).random((80, 96)) * 100 + 50 for i in ids.values()}
    with pytest.raises(ValueError):
        registration.measured_edges(grid, pixels(spark, noise))


def test_edges_are_measured_by_blocks_of_packed_images(spark, monkeypatch):
    """Pixels are packed before they are dealt out, and what is found doesn't depend on the blocks."""
    whole = scene(18, 180, 330)
    place = {f"{row}-{col}": (10 + 60 * col + row, 10 + 50 * row + col % 3, row, col) for row in range(2) for col in range(3)}
    images = {k: whole[y : y + 80, x : x + 96] * (1 + 0.1 * i) for i, (k, (x, y, _, _)) in enumerate(place.items())}
    rows = [(k, x, y, *(float(v[y, x]) * c for c in (1, 0.9, 0.8))) for k, v in images.items() for y in range(80) for x in range(96)]
    px = spark.createDataFrame(rows, "image string, x int, y int, r double, g double, b double")
    assert registration.pieces(px, "image").count() < 40 and registration.pieces(px.repartition(3), "image").agg(F.sum("n")).head()[0] == len(rows)
    grid = spark.createDataFrame([(k, row, col) for k, (_, _, row, col) in place.items()], "image string, row int, col int")
    found = []
    for held in (registration.HELD, 1):
        monkeypatch.setattr(registration, "HELD", held)
        found.append(sorted(map(tuple, registration.measured_edges(grid, px.repartition(3), least_ncc=0.5).collect())))
    assert found[0] == found[1] and len(found[0]) == 7
    edges = spark.createDataFrame([(i, r[1], r[2], r[3], r[4]) for i, r in enumerate(found[0])], "edge long, src string, dst string, dx int, dy int")
    for r in registration.overlap_ratios(edges, px).collect():
        one = registration.pair_ratios(*(np.stack([images[k] * c for c in (1, 0.9, 0.8)]) for k in (r.src, r.dst)), r.dx, r.dy)
        assert {k: r[k] for k in one} == pytest.approx(one)


def test_overlaps_of_many_edges(spark):
    images = {1: scene(9, 70, 150), 2: scene(10, 70, 150), 3: scene(11, 70, 150)}
    px = pixels(spark, images)
    rows = [(10, 1, 2, 70, 5), (11, 2, 3, -100, -30), (12, 1, 3, 130, 0), (13, 3, 1, 200, 0), (14, 1, 1, 0, 0), (15, 2, 1, 100, 45)]
    edges = spark.createDataFrame(rows, "edge long, src long, dst long, dx int, dy int")
    got = {r.edge: r for r in registration.overlap_ratios(edges, px).collect()}
    ncc = {r.edge: r for r in registration.overlap_correlations(edges, px).collect()}
    assert set(got) == set(ncc) == {r[0] for r in rows}
    for e, i, j, dx, dy in rows:
        a, b = images[i], images[j]
        x0, x1, y0, y1 = max(0, dx), min(150, 150 + dx), max(0, dy), min(70, 70 + dy)
        if x0 >= x1:
            assert got[e].pixels == ncc[e].pixels == 0 and ncc[e].ncc == -1 and got[e].ratio_r is None
            continue
        pa, pb = a[y0:y1, x0:x1], b[y0 - dy : y1 - dy, x0 - dx : x1 - dx]
        assert ncc[e].pixels == pa.size and ncc[e].ncc == pytest.approx(np.corrcoef(pa.ravel(), pb.ravel())[0, 1])
        if x1 - x0 < 24 or y1 - y0 < 24:
            assert got[e].ratio_r is None and (got[e].overlap_w, got[e].overlap_h) == (x1 - x0, y1 - y0)
            continue
        soft = [np.mean([p[3 + k : p.shape[0] - 3 + k, 3 + m : p.shape[1] - 3 + m] for k in range(-2, 3) for m in range(-2, 3)], axis=0) for p in (pa, pb)]
        ok = (np.minimum(*soft) * 0.8 > 20) & (np.maximum(*soft) < 245)
        assert got[e].pixels == ok.sum() and got[e].ratio_g == pytest.approx(np.median(soft[0][ok]) / np.median(soft[1][ok]))
        light = soft[0][ok] >= np.median(soft[0][ok])
        assert got[e].bright_r == pytest.approx(np.median(soft[0][ok][light]) / np.median(soft[1][ok][light]), rel=1e-3)


def test_distances_are_exact(spark):
    rng = np.random.default_rng(12)
    masks = {1: rng.random((23, 31)) < 0.02, 2: rng.random((17, 40)) < 0.5, 3: np.zeros((5, 6), bool), 4: np.eye(12, dtype=bool), 5: np.ones((3, 3), bool)}
    masks[1][0, 0] = True
    rows = [(k, x, y, bool(m[y, x])) for k, m in masks.items() for y in range(m.shape[0]) for x in range(m.shape[1])]
    px = spark.createDataFrame(rows, "image long, x int, y int, bad boolean").repartition(5)
    got = {(r.image, r.x, r.y): r.d2 for r in lines.squared_distance(px, "image", "bad").collect()}
    assert len(got) == len(rows)
    for k, m in masks.items():
        ys, xs = np.nonzero(m)
        for y in range(m.shape[0]):
            for x in range(m.shape[1]):
                assert got[k, x, y] == (int(((xs - x) ** 2 + (ys - y) ** 2).min()) if len(xs) else None)
    kept = raster.trim_border(px.withColumn("valid", ~F.col("bad")), "image", 0, 0, 4).where("valid").count()
    assert kept == sum(v is None or v >= 16 for v in got.values())


def test_envelope_of_lines_with_gaps():
    rng = np.random.default_rng(13)
    places = np.sort(rng.choice(90, 40, replace=False))
    heights = rng.integers(0, 900, (60, 40))
    heights[rng.random(heights.shape) < 0.4] = lines.FAR**2
    heights[0] = lines.FAR**2
    best = ((places[None, :, None] - places[None, None, :]) ** 2 + heights[:, None, :]).min(axis=2)
    best[0] = lines.FAR**2
    assert (lines.envelope(places, heights) == best).all()


@pytest.mark.parametrize("sigma", [0.7, 5.0, 40.0])
def test_wide_blurs_equal_convolution(spark, sigma):
    images = {1: scene(14, 20, 33), 2: scene(15, 9, 12)}
    px = pixels(spark, images).select("image", "x", "y", "grey").repartition(3)
    weights = lines.kernel(sigma)
    reach = len(weights) // 2
    got = {(r.image, r.x, r.y): r.grey for r in lines.gaussian(px, "image", "grey", sigma).collect()}
    for k, v in images.items():
        for axis in (0, 1):
            wide = np.pad(v, [(reach, reach) if a == axis else (0, 0) for a in (0, 1)], mode="edge")
            v = np.apply_along_axis(lambda line: np.convolve(line, weights, "valid"), axis, wide)
        assert all(abs(got[k, x, y] - v[y, x]) < 1e-9 for y in range(v.shape[0]) for x in range(v.shape[1]))


@pytest.mark.parametrize("name", ["registered_pairs", "border_distance", "trimmed_border", "overlap_correlation"])
def test_no_places_of_images_are_brought_to_the_driver(spark, sf_dir, name):
    plan = catalogue.queries()[name](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin [image" in plan
    assert not re.search(r"BroadcastHashJoin \[image#\d+L?, _?x#", plan)
