from pyspark.sql import functions as F

from tessera.functions import scalar
from tessera.operators import acquisition as acq
from tessera.operators import raster, spectra


def test_tiles_from_names(spark):
    rows = [("a_L2_up.zip", "1.png"), ("a_L2_up.zip", "2.5.png"), ("a_L2_up.zip", "10.png"), ("a_L7_down.zip", "3.png"), ("notes", "x.txt")]
    got = {(r.col, r.key): (r.order, r.nominal_row, r.col_idx) for r in acq.tile_table(spark.createDataFrame(rows, "container string, member string")).collect()}
    assert got == {(2, 1.0): (0, 2, 0), (2, 2.5): (1, 1, 0), (2, 10.0): (2, 0, 0), (7, 3.0): (0, 0, 1)}


def test_capture_faults(spark):
    caps = spark.createDataFrame(
        [("a", 0, 0, 5, "h"), ("b", 0, 1, 5, "h"), ("c", 9, 0, 5, "h"), ("d", 1, 1, 5, "x"), ("e", 0, 0, 5, "h")],
        "name string, row int, col int, bytes int, sha256 string"
    )
    tiles = spark.createDataFrame(
        [("a", 5, "h"), ("c", 5, "h"), ("d", 5, "h"), ("e", 6, "h"), ("z", 1, "h")], "name string, bytes int, sha256 string"
    )
    got = sorted((r.name, r.fault) for r in acq.check_captures(caps, tiles, 2, 2).collect())
    assert got == [
        ("b", "capture without tile"), ("c", "outside the grid"), ("d", "hash differs"), ("e", "place captured twice"), ("e", "size differs"),
        ("z", "tile without capture")
    ]


def test_transfer_and_zip(spark):
    s = spark.createDataFrame(
        [("s", "completed", 2), ("t", "completed", 1), ("u", "failed", 0)], "session_id string, status string, photos_saved int"
    )
    c = spark.createDataFrame([("s",), ("s",), ("t",), ("t",)], "session_id string")
    assert {r.session_id: r.whole for r in acq.transfer_is_whole(s, c, c).collect()} == {"s": True, "t": False, "u": False}
    files = spark.createDataFrame([("s", "f2"), ("s", "f1"), ("t", "f1")], "run string, f string")
    points = spark.createDataFrame([("s", 1), ("s", 2), ("t", 1), ("t", 2)], "run string, p int")
    assert sorted((r.f, r.p) for r in acq.zip_by_position(files, points, "run", "f", "p").collect()) == [("f1", 1), ("f2", 2)]


def test_outside_neighbours(spark):
    rows = [(0, i, g) for i, g in enumerate([None, "a", "a", None, "b"])]
    got = {r.g: (r.before, r.after) for r in acq.outside_neighbours(spark.createDataFrame(rows, "col int, id int, g string"), "col", "id", "g", "id").collect()}
    assert got == {"a": (0, 3), "b": (3, None)}


def test_reference_verdicts(spark):
    rows = [([100.0, 100.0, 100.0],), ([0.0, 10.0, 10.0],), ([10.0, 100.0, 100.0],), ([80.0, 100.0, 100.0],)]
    df = spark.createDataFrame(rows, "o array<double>").withColumn("ref", F.array(F.lit(100.0), F.lit(100.0), F.lit(100.0)))
    assert [r.v.verdict for r in df.select(acq.reference_verdict(F.col("o"), F.col("ref")).alias("v")).collect()] == ["within_tolerance", "black", "implausible", "differs"]


def test_scale_plans_and_candidates(spark):
    df = spark.createDataFrame([(640, 480, 320, 240), (640, 480, 300, 240)], "w int, h int, a int, b int")
    assert [r[0] for r in df.select(acq.scale_plan(F.col("w"), F.col("h"), F.col("a"), F.col("b"))).collect()] == [2, None]
    cands = acq.congruent("v", "p", spark.createDataFrame([(1, 5.0, 10.0)], "id int, v double, p double"))
    assert sorted(r.candidate for r in cands.collect()) == [-5.0, 5.0, 15.0]
    assert acq.best_candidates(cands, "id", "candidate", "v", 2).count() == 2


def test_clean_field(spark):
    rows = [(0.9, 0.9, 0, 3.0, 0.0, 120.0), (0.9, 0.8, 0, 30.0, 0.01, 120.0), (0.4, 0.9, 1, 3.0, 0.0, 30.0), (0.9, None, 0, 3.0, 0.0, 120.0)]
    df = spark.createDataFrame(rows, "flat_fraction double, plateau_share double, other_plateaus int, std double, saturated double, luminance double")
    got = [(r.clean, r.reasons, r.exposure) for r in acq.clean_field(df).collect()]
    assert got == [(True, [], "ok"), (False, ["plateau", "spread"], "saturated"), (False, ["flat", "other_material"], "too_dark"), (False, ["plateau"], "ok")]


def test_regions_around_a_seed(spark):
    rows = [("i", x, y, *((200, 200, 200) if x < 3 or x in (5, 8) else (0, 0, 0))) for x in range(10) for y in range(4)]
    px = spark.createDataFrame(rows, "image string, x int, y int, r int, g int, b int")
    assert raster.grow_region(px, "image", (1, 1), 10).count() == 12
    parts = raster.label_components(px, "image", F.col("r") > 100)
    near = raster.satellites(parts, "image", 0, 4).collect()
    assert [(r.component, r["size"]) for r in near] == [(5, 4)]
    colour = raster.background_colour(px, "image").head()
    assert (colour.r, colour.source) == (200.0, "plateau")


def test_clean_spectrum_and_text(spark):
    rows = [("s", i / 100, 1.0 + i % 3 / 100 if i != 50 else 99.0) for i in range(100)] + [("s", float("nan"), 1.0), ("s", 9.0, 1.0)]
    got = spectra.clean(spark.createDataFrame(rows, "id string, x double, y double"), "id", 0.0, 1.0)
    assert got.count() == 99 and got.agg(F.max("y")).head()[0] < 2
    assert spark.range(1).select(scalar.nfc(F.lit("é"))).head()[0] == "é"
