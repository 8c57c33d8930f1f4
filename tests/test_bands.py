from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.operators import graph, joins
from tessera.plans import catalogue


@pytest.fixture
def points(spark):
    """Places with many points, some points null or not finite, and places just as far apart as the band is wide."""
    rng = np.random.default_rng(7)
    rows = [(int(i), float(x) * 1.5, float(y) * 2) for i, x, y in zip(rng.permutation(300), rng.integers(0, 14, 300), rng.integers(-6, 6, 300), strict=True)]
    rows += [(400, float("nan"), 0.0), (401, float("nan"), 0.0), (402, float("inf"), 0.0), (403, float("inf"), 0.0), (404, None, 0.0), (405, 0.0, -0.0), (406, -0.0, 0.0)]
    return rows, spark.createDataFrame(rows, "id long, x double, y double")


def pairs_of(rows, dx, dy):
    known = [r for r in rows if r[1] is not None]
    return sorted((a, b) for a, ax, ay in known for b, bx, by in known if a < b and abs(ax - bx) < dx and abs(ay - by) < dy)


@pytest.mark.parametrize(("dx", "dy"), [(3.0, 2.0), (1.6, 4.5), (0.5, 0.5)])
def test_band_pairs_by_place_are_all_pairs(spark, points, dx, dy):
    rows, df = points
    assert sorted(map(tuple, joins.band_pairs(df, dx, dy, "id").collect())) == pairs_of(rows, dx, dy)


def test_band_pairs_bring_no_side_to_the_driver(spark, sf_dir):
    plan = catalogue.queries()["spatial_duplicates"](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert "Broadcast" not in plan


def test_components_of_a_band_are_found_on_its_places(spark, points, monkeypatch):
    rows, df = points
    seen = []
    monkeypatch.setattr(joins, "connected_components", lambda edges: seen.append(edges.count()) or graph.connected_components(edges))
    for dx, dy in ((1.6, 2.5), (0.5, 0.5)):
        pairs = pairs_of(rows, dx, dy)
        low = {n: n for p in pairs for n in p}
        for _ in low:
            for a, b in pairs:
                low[a] = low[b] = min(low[a], low[b])
        assert {tuple(r) for r in joins.band_components(df, dx, dy, "id").collect()} == {(c, n) for c, n in Counter(low.values()).items()}
        assert seen.pop() < len(pairs)


def test_groups_of_a_band_are_those_of_its_pairs(spark, points, monkeypatch):
    _, df = points
    seen = []
    grouped = joins.first_seen_groups
    for dx, dy in ((1.6, 2.5), (3.1, 4.5), (0.5, 0.5)):
        pairs = joins.band_pairs(df, dx, dy, "id")
        want = sorted(map(tuple, grouped(pairs).collect()))
        with monkeypatch.context() as m:
            m.setattr(joins, "first_seen_groups", lambda edges: seen.append(edges.count()) or grouped(edges))
            assert sorted(map(tuple, joins.band_groups(df, dx, dy, "id").collect())) == want
        assert seen.pop() < pairs.count()


def test_coverage_brings_no_cells_to_the_driver(spark, sf_dir):
    plan = catalogue.queries()["coverage_rescue"](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert "Broadcast" not in plan


def test_box_overlaps_are_those_of_all_pairs(spark):
    """Boxes that repeat, lie on borders of cells, are empty, or overlap by less than one across a border."""
    rng = np.random.default_rng(3)
    corners = rng.integers(-20, 60, (80, 2)) / 2
    boxes = [(i, *map(float, c), *map(float, c + rng.integers(0, 50, 2) / 2)) for i, c in enumerate(corners)]
    boxes += [(80 + i, *b[1:]) for i, b in enumerate(boxes[:40])] + [(120, 31.75, 0.0, 32.5, 1.0), (121, 32.25, 0.0, 33.0, 1.0), (121, 32.25, 0.0, 33.0, 1.0)]
    want = sorted((a[0], w[0]) for a in boxes for w in boxes if a[1] < w[3] and w[1] < a[3] and a[2] < w[4] and w[2] < a[4])
    df = spark.createDataFrame(boxes, "id long, x1 double, y1 double, x2 double, y2 double")
    found = joins.box_overlaps(df.withColumnRenamed("id", "alarm"), df.withColumnRenamed("id", "window"), 8)
    assert sorted(map(tuple, found.collect())) == want


def test_pairs_of_boxes_are_made_once(spark, sf_dir):
    """No pair is made and then dropped as one that was there: the result is joined, not made distinct."""
    plan = catalogue.queries()["box_overlaps"](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert "Broadcast" not in plan and "Join" in plan.split("Aggregate")[0]


def greedy(pairs):
    larger, seen, out = {}, set(), set()
    for a, b in pairs:
        larger.setdefault(a, set()).add(b)
    for i in sorted({x for p in pairs for x in p}):
        if i not in seen:
            seen.add(i)
            own = larger.get(i, set()) - seen
            seen |= own
            out |= {(i, m) for m in own}
    return out


def test_long_chains_take_few_rounds(spark, monkeypatch):
    kept, rounds = joins.stored, []
    monkeypatch.setattr(joins, "stored", lambda df, what="rows", gather=True: (rounds.append(what) if what == "pairs" else None) or kept(df, what, gather))
    path = spark.range(100_000).selectExpr("id as a", "id + 1 as b")
    got = joins.first_seen_groups(path, held=5_000)
    assert got.count() == 50_000 and got.where("member <> leader + 1 or leader % 2 = 1").count() == 0
    assert len(rounds) <= 30


def test_groups_across_ranges_equal_greedy(spark):
    rng = np.random.default_rng(21)
    pairs = {(int(min(p)), int(max(p))) for p in rng.integers(0, 400, (700, 2)) if p[0] != p[1]} | {(7, i) for i in range(8, 300)}
    df = spark.createDataFrame(sorted(pairs), "a long, b long")
    for held in (60, 100_000):
        assert {(r.leader, r.member) for r in joins.first_seen_groups(df, held=held).collect()} == greedy(pairs)
    assert joins.first_seen_groups(df.limit(0)).count() == 0


def test_coverage_counts_cells_in_blocks(spark):
    rng = np.random.default_rng(5)
    rows = [(i, int(x), int(y), bool(i % 3)) for i, (x, y) in enumerate(rng.integers(-400, 400, (90, 2)))]
    tiles = spark.createDataFrame([*rows, (90, 5000, 0, False)], "id long, x long, y long, kept boolean")
    found = joins.coverage_rescue(tiles, "not kept", 130, 70, 10)
    cells = lambda x, y: {(i, j) for i in range(x // 10, (x + 129) // 10 + 1) for j in range(y // 10, (y + 69) // 10 + 1)}
    hit = set().union(*(cells(x, y) for _, x, y, kept in rows if kept))
    want = {(i, len(cells(x, y)), len(cells(x, y) & hit)) for i, x, y, kept in [*rows, (90, 5000, 0, False)] if not kept}
    assert {(r.id, r.cells, r.covered) for r in found.collect()} == want
    # a tile is a row for each block of cells that it touches, not one for each cell
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "bit_or" in plan


def test_pairs_of_a_crowd_of_boxes_are_dealt_out(spark, monkeypatch):
    """Alarms and windows that have one box each are one pair of boxes, and more than one task's pairs."""
    monkeypatch.setattr(joins, "PART", 10)
    monkeypatch.setattr(joins, "MADE", 1_000)
    box = spark.range(150).selectExpr("id", "0.0D as x1", "-0.0D as y1", "5.0D as x2", "5.0D as y2")
    found = joins.box_overlaps(box.withColumnRenamed("id", "alarm"), box.withColumnRenamed("id", "window"), 8)
    assert found.count() == found.distinct().count() == 22_500
    assert found.groupBy(F.spark_partition_id()).count().agg(F.max("count")).head()[0] <= 9_000


def test_pairs_of_a_crowded_place_are_dealt_out(spark, monkeypatch):
    """Points of one place and of its neighbour are more than one task's pairs."""
    monkeypatch.setattr(joins, "PART", 10)
    monkeypatch.setattr(joins, "MADE", 1_000)
    points = spark.range(200).selectExpr("id", "if(id % 4 = 0, 1.0D, 0.0D) as x", "if(id % 3 = 0, -0.0D, 0.0D) as y")
    found = joins.band_pairs(points, 2.0, 2.0, "id")
    assert found.count() == found.where("a < b").distinct().count() == 19_900
    assert found.groupBy(F.spark_partition_id()).count().agg(F.max("count")).head()[0] <= 8_000


def test_many_pairs_are_not_made_in_one_loop(spark, sf_dir, monkeypatch):
    """A generated loop keeps copies of all that it makes of one row: the two sides' members are two loops if these are many."""
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        for name, most, first in (("spatial_duplicates", 0, False), ("spatial_duplicates", 50_000, True), ("box_overlaps", 50_000, True)):
            monkeypatch.setattr(joins, "COPIED", most)
            plan = catalogue.queries()[name](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
            made = [line for line in plan.splitlines() if "Generate explode(" in line and "sequence" not in line][:2]
            assert len(made) == 2 and ["*(" in line.split("Generate")[0] for line in made] == [True, first], made
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
