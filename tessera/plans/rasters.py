"""Queries on the label raster."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import scalar
from tessera.operators import aggregates, grid
from tessera.plans.base import COLUMNS, HEIGHT, PX, ROWS, WIDTH, Registry, px
from tessera.session import table

registry = Registry()
QUERIES, SQL = registry.queries, registry.sql

COUNTS = """count(*) AS canvas_px, count(*) FILTER (WHERE valid) AS valid_px, count(*) FILTER (WHERE NOT valid) AS non_scan_px,
  count(*) FILTER (WHERE valid AND excluded) AS excluded_px, count(*) FILTER (WHERE valid AND NOT excluded) AS retained_px,
  count(*) FILTER (WHERE valid AND NOT excluded AND label = 0) AS background_px,
  count(*) FILTER (WHERE valid AND NOT excluded AND label = 1) AS layer1_px,
  count(*) FILTER (WHERE valid AND NOT excluded AND label = 2) AS layer2_px,
  count(*) FILTER (WHERE valid AND NOT excluded AND label = 3) AS layer3_px,
  count(*) FILTER (WHERE valid AND NOT excluded AND label > 0) AS crystal_px"""
FRACTIONS = """CASE WHEN valid_px = 0 THEN 'no_scan' WHEN retained_px = 0 THEN 'excluded' WHEN crystal_px = 0 THEN 'no_crystal' ELSE 'valid' END AS status,
  round(100.0::DOUBLE * layer1_px / nullif(crystal_px, 0), 6) AS layer1_composition, round(100.0::DOUBLE * layer1_px / nullif(retained_px, 0), 6) AS layer1_coverage,
  round(100.0::DOUBLE * layer2_px / nullif(crystal_px, 0), 6) AS layer2_composition, round(100.0::DOUBLE * layer2_px / nullif(retained_px, 0), 6) AS layer2_coverage,
  round(100.0::DOUBLE * layer3_px / nullif(crystal_px, 0), 6) AS layer3_composition, round(100.0::DOUBLE * layer3_px / nullif(retained_px, 0), 6) AS layer3_coverage"""
BINS = "floor(((y + 1) * 8 - 1) / 480)::INT + 1 AS grid_row, floor(((x + 1) * 15 - 1) / 640)::INT + 1 AS grid_col"


@registry.add(f"""WITH {PX}, c AS (SELECT *, {BINS} FROM px), g AS (SELECT grid_row, grid_col, {COUNTS} FROM c GROUP BY ALL)
SELECT *, {FRACTIONS}, ((grid_row - 1) * 480 // 8)::INT AS y1, (grid_row * 480 // 8)::INT AS y2, ((grid_col - 1) * 640 // 15)::INT AS x1, (grid_col * 640 // 15)::INT AS x2 FROM g""")
def grid_composition(spark: SparkSession, d: str) -> DataFrame:
    return grid.composition(px(spark, d), WIDTH, HEIGHT, COLUMNS, ROWS)


@registry.add(f"""WITH {PX}, c AS (SELECT *, {BINS} FROM px),
g AS (SELECT grid_row, grid_col, {COUNTS}, grouping(grid_row, grid_col) AS gid FROM c GROUP BY GROUPING SETS ((grid_row), (grid_col), ()))
SELECT * EXCLUDE (gid), CASE gid WHEN 1 THEN 'row' WHEN 2 THEN 'column' ELSE 'map' END AS level, {FRACTIONS} FROM g""")
def grid_margins(spark: SparkSession, d: str) -> DataFrame:
    return grid.margins(px(spark, d), WIDTH, HEIGHT, COLUMNS, ROWS)


@registry.add(f"""WITH {PX}, w AS (SELECT count(*) FILTER (WHERE valid AND excluded AND label > 0) AS excluded_crystal_px, count(*) FILTER (WHERE valid AND label > 0) AS bt, count(*) FILTER (WHERE valid AND NOT excluded AND label > 0) AS tot_after FROM px),
l AS (SELECT label AS layer, count(*) FILTER (WHERE valid) AS before_px, count(*) FILTER (WHERE valid AND NOT excluded) AS after_px FROM px WHERE label > 0 GROUP BY label)
SELECT excluded_crystal_px, layer, before_px, after_px, round(100.0::DOUBLE * before_px / nullif(bt, 0), 6) AS before_pct, round(100.0::DOUBLE * after_px / nullif(tot_after, 0), 6) AS after_pct,
  round(100.0::DOUBLE * after_px / nullif(tot_after, 0) - 100.0::DOUBLE * before_px / nullif(bt, 0), 6) AS delta_pp, round(after_px * 0.5::DOUBLE * 0.5 / 1e6, 9) AS area_mm2,
  abs(round(100.0::DOUBLE * after_px / nullif(tot_after, 0) - 100.0::DOUBLE * before_px / nullif(bt, 0), 6)) > 2.0 AS alarm FROM l, w""")
def exclusion_sensitivity(spark: SparkSession, d: str) -> DataFrame:
    return grid.exclusion_sensitivity(px(spark, d), 2.0, 0.5)


BOXES = ((0, 0, 100, 60), (50, 30, 200, 200), (600, 400, 640, 480))


@registry.add(f"""WITH {PX}, boxes(x1, y1, x2, y2) AS (VALUES (0, 0, 100, 60), (50, 30, 200, 200), (600, 400, 640, 480)),
m AS (SELECT px.* EXCLUDE (excluded), excluded OR EXISTS (SELECT 1 FROM boxes WHERE x >= x1 AND x < x2 AND y >= y1 AND y < y2) AS excluded FROM px)
SELECT label, count(*) AS n, count(*) FILTER (WHERE valid AND excluded) AS excluded_px, count(*) FILTER (WHERE valid AND NOT excluded) AS retained_px FROM m GROUP BY label""")
def rectangle_exclusion(spark: SparkSession, d: str) -> DataFrame:
    boxes = spark.range(1).select(F.inline(F.array(*(F.struct(*(F.lit(v).alias(k) for k, v in zip(("x1", "y1", "x2", "y2"), b, strict=True))) for b in BOXES))))
    marked = grid.mark_rectangles(px(spark, d), boxes)
    return marked.groupBy("label").agg(
        F.count("*").alias("n"), F.count_if(F.expr("valid and excluded")).alias("excluded_px"),
        F.count_if(F.expr("valid and not excluded")).alias("retained_px")
    )


@registry.add(f"WITH {PX} SELECT label, count(*) AS n FROM px WHERE x % 8 = 0 AND y % 8 = 0 GROUP BY label")
def stride_sample_counts(spark: SparkSession, d: str) -> DataFrame:
    return grid.stride_sample(px(spark, d), 8).groupBy("label").agg(F.count("*").alias("n"))


@registry.add(f"WITH {PX}, m AS (SELECT [0, 2, 1, 3][label + 1] AS label FROM px) SELECT label, count(*) AS n FROM m GROUP BY label")
def label_remap(spark: SparkSession, d: str) -> DataFrame:
    return grid.remap_labels(px(spark, d)).groupBy("label").agg(F.count("*").alias("n"))


@registry.add(f"""WITH {PX}, c AS (SELECT *, {BINS} FROM px), g AS (SELECT grid_row, grid_col, {COUNTS} FROM c GROUP BY ALL)
SELECT count(*) AS faults FROM g WHERE retained_px + excluded_px + non_scan_px <> canvas_px OR background_px + crystal_px <> retained_px""")
def pixel_conservation(spark: SparkSession, d: str) -> DataFrame:
    return grid.conservation_faults(px(spark, d), WIDTH, HEIGHT, COLUMNS, ROWS).agg(F.count("*").alias("faults"))


@registry.add(f"""WITH {PX}, k AS (SELECT *, x % 64 < 6 OR x % 64 >= 58 OR y % 64 < 6 OR y % 64 >= 58 AS seam FROM px WHERE valid AND label > 0),
g AS (SELECT count(*) FILTER (WHERE seam) AS seam_px, count(*) FILTER (WHERE NOT seam) AS interior_px, count(*) FILTER (WHERE seam AND label = 2) AS seam_hits, count(*) FILTER (WHERE NOT seam AND label = 2) AS interior_hits FROM k),
s AS (SELECT *, CASE WHEN seam_px > 1000 AND interior_px > 1000 THEN round(100.0::DOUBLE * seam_hits / seam_px - 100.0::DOUBLE * interior_hits / interior_px, 6) END AS shift_pp FROM g)
SELECT *, coalesce(abs(shift_pp) > 5.0, false) AS alarm FROM s""")
def seam_band_check(spark: SparkSession, d: str) -> DataFrame:
    return grid.seam_check(px(spark, d), 64, 6)


@registry.add(f"""WITH {PX}, g AS (SELECT count(*) AS canvas_px, count(*) FILTER (WHERE NOT valid) AS non_scan_px, count(*) FILTER (WHERE valid AND label = 0) AS class0_px, count(*) FILTER (WHERE valid AND label = 1) AS class1_px, count(*) FILTER (WHERE valid AND label = 2) AS class2_px, count(*) FILTER (WHERE valid AND label = 3) AS class3_px FROM px)
SELECT *, round(100.0::DOUBLE * non_scan_px / canvas_px, 6) AS non_scan_pct, CASE WHEN 100.0 * non_scan_px / canvas_px > 25 THEN 'fail' WHEN 100.0 * non_scan_px / canvas_px > 0.5 THEN 'warn' ELSE 'ok' END AS verdict,
  concat_ws(',', CASE WHEN class0_px = 0 THEN '0' END, CASE WHEN class1_px = 0 THEN '1' END, CASE WHEN class2_px = 0 THEN '2' END, CASE WHEN class3_px = 0 THEN '3' END) AS empty_classes FROM g""")
def segmentation_check(spark: SparkSession, d: str) -> DataFrame:
    return grid.segmentation_check(px(spark, d))


@registry.add(f"""WITH {PX}, w AS (SELECT *, x // 8 AS cx, y // 8 AS cy, greatest(least(x % 64 + 1, 64 - x % 64) * least(y % 48 + 1, 48 - y % 48) / 768.0::DOUBLE, 1e-4::DOUBLE) AS w FROM px),
g AS (SELECT cx, cy, count(*) AS n, round(sum(value * w) / sum(w), 6) AS blended FROM w GROUP BY cx, cy)
SELECT cx, cy, n, blended, floor(blended + 0.5)::BIGINT AS pixel FROM g""")
def feather_blend(spark: SparkSession, d: str) -> DataFrame:
    cells = px(spark, d).withColumn("cx", F.expr("x div 8").cast("int")).withColumn("cy", F.expr("y div 8").cast("int"))
    return grid.feather_blend(cells, "value", 64, 48, ["cx", "cy"])


@registry.add(f"""WITH {PX}, g AS (SELECT label, quantile_cont(value, 0.5) AS r, quantile_cont(value * 2 + 1, 0.5) AS g, quantile_cont(value + 20, 0.5) AS b FROM px GROUP BY label),
s AS (SELECT *, exp((ln(r) + ln(g) + ln(b)) / 3.0) AS bright FROM g)
SELECT label, round(bright, 6) AS brightness, round(r / bright, 6) AS balance_r, round(g / bright, 6) AS balance_g, round(b / bright, 6) AS balance_b,
  round(greatest(abs(r / bright - 1), abs(g / bright - 1), abs(b / bright - 1)), 6) AS max_deviation FROM s""")
def gain_split(spark: SparkSession, d: str) -> DataFrame:
    channels = px(spark, d).selectExpr("label", "value as r", "value * 2 + 1 as g", "value + 20 as b")
    return aggregates.split_gain(channels, ["label"], "r", "g", "b")


@registry.add(f"""WITH {PX}, c AS (SELECT label, 5 * value AS r, 4 * value AS g, 3 * value AS b FROM px)
SELECT label, round(avg(0.299 * r + 0.587 * g + 0.114 * b), 6) AS luminance, count(*) FILTER (WHERE r >= 250 AND g >= 200) AS white_px, sum(greatest(0, least(255, round_even(r * 1.1, 0))))::BIGINT AS gained FROM c GROUP BY label""")
def colour_gain(spark: SparkSession, d: str) -> DataFrame:
    c = px(spark, d).selectExpr("label", "5 * value as r", "4 * value as g", "3 * value as b")
    return c.groupBy("label").agg(
        F.round(F.avg(scalar.luminance(F.col("r"), F.col("g"), F.col("b"))), 6).alias("luminance"),
        F.count_if(F.expr("r >= 250 and g >= 200")).alias("white_px"), F.sum(scalar.apply_gain(F.col("r"), F.lit(1.1))).alias("gained")
    )


@registry.add("""WITH h AS (SELECT range AS bin FROM range(64)), c AS (SELECT floor(l_quantity)::INT AS bin, count(*) AS n FROM lineitem GROUP BY 1),
f AS (SELECT h.bin::INT AS bin, coalesce(n, 0) AS n FROM h LEFT JOIN c USING (bin)),
s AS (SELECT *, sum(n) OVER (ORDER BY bin ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING) / 7.0::DOUBLE AS smooth, sum(n) OVER (ORDER BY bin ROWS BETWEEN 12 PRECEDING AND 12 FOLLOWING)::DOUBLE / sum(n) OVER () AS share FROM f),
p AS (SELECT * FROM (SELECT *, max(smooth) OVER (ORDER BY bin ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING) AS top FROM s) WHERE smooth = top AND n > 0 AND share >= 0.1),
g AS (SELECT *, coalesce((bin - lag(bin) OVER (ORDER BY bin) > 18)::INT, 0) AS gap FROM p)
SELECT bin, n, round(smooth, 6) AS smooth, round(share, 6) AS share, (sum(gap) OVER (ORDER BY bin))::INT AS plateau FROM g""")
def plateau_histogram(spark: SparkSession, d: str) -> DataFrame:
    return aggregates.plateaus(table(spark, d, "lineitem"), F.floor("l_quantity"), 64)


@registry.add("""SELECT count(*) AS edges, round(sqrt(sum(w * r * r) / sum(w)), 6) AS rms, round(sqrt(sum(w * r * r) FILTER (WHERE w > 0.03) / sum(w) FILTER (WHERE w > 0.03)), 6) AS strong_rms,
  round(quantile_cont(abs(r), 0.95), 6) AS p95, round(max(abs(r)), 6) AS worst FROM (SELECT l_quantity - 25 AS r, l_discount + 0.001 AS w FROM lineitem)""")
def weighted_rms(spark: SparkSession, d: str) -> DataFrame:
    return aggregates.edge_diagnostics(table(spark, d, "lineitem"), F.col("l_quantity") - 25, F.col("l_discount") + 0.001, 0.03)


@registry.add("SELECT l_returnflag, count(*) AS n, round(sqrt(avg(pow(ln(l_quantity / 25.0), 2))), 6) AS log_rms FROM lineitem GROUP BY l_returnflag")
def log_ratio_rms(spark: SparkSession, d: str) -> DataFrame:
    return aggregates.log_rms(table(spark, d, "lineitem"), ["l_returnflag"], F.col("l_quantity") / 25.0)
