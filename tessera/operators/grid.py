"""Grid statistics of label rasters: cells, margins, exclusions.

A pixel table has ``x, y, label`` (0 background, 1..3 layers), ``valid`` (inside the scan) and ``excluded``; excluded
counts only inside the valid part. Composition divides by the layers' pixels, coverage by the retained canvas; both are
null where nothing is to be divided by. All counts come from one pass with map-side partial sums.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Boxes that are gathered into one array.
MOST = 10_000

LAYERS = (1, 2, 3)


def bin_of(position: Column, size: int, bins: int) -> Column:
    """The 0-based bin of a pixel: edges at ``i * size // bins``."""
    return F.floor(((position + 1) * bins - 1) / F.lit(size)).cast("int")


def cell_edges(df: DataFrame, index: str, size: int, bins: int, low: str, high: str) -> DataFrame:
    """Half-open pixel edges of 1-based bins."""
    edge = lambda i: F.floor(i * size / bins).cast("int")
    return df.withColumn(low, edge(F.col(index) - 1)).withColumn(high, edge(F.col(index)))


def remap_labels(df: DataFrame, order: Sequence[int] = (0, 2, 1, 3), label: str = "label") -> DataFrame:
    """Native class ids to canonical ones by position; ids outside the table become null."""
    return df.withColumn(label, F.try_element_at(F.array(*map(F.lit, order)), F.col(label).cast("int") + 1))


def stride_sample(px: DataFrame, step: int) -> DataFrame:
    return px.where(f"x % {step} = 0 and y % {step} = 0")


def mark_rectangles(px: DataFrame, rectangles: DataFrame, name: str = "excluded") -> DataFrame:
    """Set ``name`` where a pixel lies in any half-open box ``(x1, y1, x2, y2)``, or was set before.

    Up to MOST boxes, which are counted first, are gathered into one array, so pixels are neither shuffled nor
    multiplied. More of them meet the pixels on the cells of a raster that they cover. Overlapping boxes count once.
    """
    if rectangles.limit(MOST + 1).count() > MOST:
        return _mark_by_cells(px, rectangles, name)
    boxes = rectangles.agg(F.collect_list(F.struct("x1", "y1", "x2", "y2")).alias("boxes"))
    hit = F.exists("boxes", lambda b: (F.col("x") >= b["x1"]) & (F.col("x") < b["x2"]) & (F.col("y") >= b["y1"]) & (F.col("y") < b["y2"]))
    before = F.coalesce(F.col(name), F.lit(False)) if name in px.columns else F.lit(False)
    # one row of MOST boxes at most
    return px.join(F.broadcast(boxes)).withColumn(name, before | hit).drop("boxes")


def _mark_by_cells(px: DataFrame, rectangles: DataFrame, name: str, cell: int = 64) -> DataFrame:
    cells = lambda a, b: F.sequence(F.floor(F.col(a) / cell), F.floor((F.col(b) - 1) / cell))
    spread = rectangles.where("x1 < x2 and y1 < y2").withColumn("_cx", F.explode(cells("x1", "x2"))).withColumn("_cy", F.explode(cells("y1", "y2")))
    places = px.select(F.col("x").alias("_x"), F.col("y").alias("_y")).distinct()
    met = places.withColumn("_cx", F.floor(F.col("_x") / cell)).withColumn("_cy", F.floor(F.col("_y") / cell)).join(spread, ["_cx", "_cy"])
    inside = met.where("_x >= x1 and _x < x2 and _y >= y1 and _y < y2").select("_x", "_y").distinct()
    before = F.coalesce(F.col(name), F.lit(False)) if name in px.columns else F.lit(False)
    out = px.join(inside, (F.col("x") == F.col("_x")) & (F.col("y") == F.col("_y")), "left")
    return out.withColumn(name, before | F.col("_x").isNotNull()).drop("_x", "_y")


def _counts() -> list[Column]:
    kept = F.expr("valid and not excluded")
    return [
        F.count("*").alias("canvas_px"),
        F.count_if("valid").alias("valid_px"),
        F.count_if(~F.col("valid")).alias("non_scan_px"),
        F.count_if(F.expr("valid and excluded")).alias("excluded_px"),
        F.count_if(kept).alias("retained_px"),
        F.count_if(kept & (F.col("label") == 0)).alias("background_px"),
        *(F.count_if(kept & (F.col("label") == i)).alias(f"layer{i}_px") for i in LAYERS),
        F.count_if(kept & (F.col("label") > 0)).alias("crystal_px"),
    ]


def _fractions(df: DataFrame) -> DataFrame:
    status = F.when(F.col("valid_px") == 0, "no_scan").when(F.col("retained_px") == 0, "excluded").when(F.col("crystal_px") == 0, "no_crystal").otherwise("valid")
    out = df.withColumn("status", status)
    for i in LAYERS:
        share = 100.0 * F.col(f"layer{i}_px")
        out = out.withColumn(
            f"layer{i}_composition", F.round(F.try_divide(share, F.col("crystal_px")), 6)
        ).withColumn(f"layer{i}_coverage", F.round(F.try_divide(share, F.col("retained_px")), 6))
    return out


def composition(px: DataFrame, width: int, height: int, columns: int, rows: int) -> DataFrame:
    """One row per occupied cell, 1-based, with edges, disjoint counts, status and both fractions."""
    cells = px.withColumn("grid_row", bin_of(F.col("y"), height, rows) + 1).withColumn("grid_col", bin_of(F.col("x"), width, columns) + 1)
    out = _fractions(cells.groupBy("grid_row", "grid_col").agg(*_counts()))
    return cell_edges(cell_edges(out, "grid_row", height, rows, "y1", "y2"), "grid_col", width, columns, "x1", "x2")


def margins(px: DataFrame, width: int, height: int, columns: int, rows: int) -> DataFrame:
    """Row, column and whole-map totals from summed counts, by grouping sets; ``level`` tells which."""
    cells = px.select(
        "label", "valid", "excluded", (bin_of(F.col("y"), height, rows) + 1).alias("grid_row"),
        (bin_of(F.col("x"), width, columns) + 1).alias("grid_col")
    )
    sets = [[F.col("grid_row")], [F.col("grid_col")], []]
    out = cells.groupingSets(sets, "grid_row", "grid_col").agg(*_counts(), F.grouping_id("grid_row", "grid_col").alias("gid"))
    level = F.when(F.col("gid") == 1, "row").when(F.col("gid") == 2, "column").otherwise("map")
    return _fractions(out.withColumn("level", level).drop("gid"))


def conservation_faults(px: DataFrame, width: int, height: int, columns: int, rows: int) -> DataFrame:
    """Cells whose parts do not add up: none, if all is well."""
    return composition(px, width, height, columns, rows).where(
        "retained_px + excluded_px + non_scan_px <> canvas_px or background_px + crystal_px <> retained_px or layer1_px + layer2_px + layer3_px <> crystal_px"
    )


def exclusion_sensitivity(px: DataFrame, limit_pp: float = 2.0, um_per_px: float = 1.0) -> DataFrame:
    """Each layer's composition with and without the excluded pixels, the shift in points, an alarm above the limit,
    and the retained area in square millimetres."""
    before = [F.count_if(F.expr(f"valid and label = {i}")).alias(f"b{i}") for i in LAYERS]
    after = [F.count_if(F.expr(f"valid and not excluded and label = {i}")).alias(f"a{i}") for i in LAYERS]
    whole = px.agg(*before, *after, F.count_if(F.expr("valid and excluded and label > 0")).alias("excluded_crystal_px"))
    share = lambda p, i: F.try_divide(100.0 * F.col(f"{p}{i}"), F.col(f"{p}1") + F.col(f"{p}2") + F.col(f"{p}3"))
    lines = [F.struct(F.lit(i).alias("layer"), F.col(f"b{i}").alias("before_px"), F.col(f"a{i}").alias("after_px"), F.round(share("b", i), 6).alias("before_pct"), F.round(share("a", i), 6).alias("after_pct"), F.round(share("a", i) - share("b", i), 6).alias("delta_pp"), F.round(F.col(f"a{i}") * um_per_px * um_per_px / 1e6, 9).alias("area_mm2")) for i in LAYERS]
    out = whole.select("excluded_crystal_px", F.inline(F.array(*lines)))
    return out.withColumn("alarm", F.abs("delta_pp") > limit_pp)


def seam_check(px: DataFrame, step: int, band: int, label: int = 2, least: int = 1000, limit_pp: float = 5.0) -> DataFrame:
    """A class's share among crystal in the bands around tile seams and elsewhere; null unless both have enough pixels."""
    seam = F.expr(f"(x % {step}) < {band} or (x % {step}) >= {step - band} or (y % {step}) < {band} or (y % {step}) >= {step - band}")
    kept = px.where("valid and label > 0").withColumn("seam", seam)
    out = kept.agg(
        F.count_if("seam").alias("seam_px"), F.count_if(~F.col("seam")).alias("interior_px"),
        F.count_if(F.col("seam") & (F.col("label") == label)).alias("seam_hits"),
        F.count_if(~F.col("seam") & (F.col("label") == label)).alias("interior_hits")
    )
    enough = (F.col("seam_px") > least) & (F.col("interior_px") > least)
    shift = F.when(
        enough,
        F.round(100.0 * F.try_divide(F.col("seam_hits"), F.col("seam_px")) - 100.0 * F.try_divide(F.col("interior_hits"), F.col("interior_px")), 6)
    )
    return out.withColumn("shift_pp", shift).withColumn("alarm", F.coalesce(F.abs("shift_pp") > limit_pp, F.lit(False)))


def segmentation_check(px: DataFrame, warn: float = 0.5, fail: float = 25.0) -> DataFrame:
    """The share outside the scan against two limits, and which classes are empty."""
    out = px.agg(
        F.count("*").alias("canvas_px"), F.count_if(~F.col("valid")).alias("non_scan_px"),
        *(F.count_if(F.expr(f"valid and label = {i}")).alias(f"class{i}_px") for i in (0, *LAYERS))
    )
    share = F.try_divide(100.0 * F.col("non_scan_px"), F.col("canvas_px"))
    out = out.withColumn("non_scan_pct", F.round(share, 6)).withColumn(
        "verdict", F.when(share > fail, "fail").when(share > warn, "warn").otherwise("ok")
    )
    return out.withColumn("empty_classes", F.concat_ws(",", *(F.when(F.col(f"class{i}_px") == 0, F.lit(str(i))) for i in (0, *LAYERS))))


def feather_blend(px: DataFrame, value: str, tile_w: int, tile_h: int, by: Sequence[str]) -> DataFrame:
    """Weighted mean of overlapping observations, heavier towards a tile's middle, rounded by adding a half."""
    tx, ty = F.col("x") % tile_w, F.col("y") % tile_h
    top = float((tile_w + 1) // 2 * ((tile_h + 1) // 2))
    weight = F.greatest(F.least(tx + 1, tile_w - tx) * F.least(ty + 1, tile_h - ty) / F.lit(top), F.lit(1e-4))
    out = px.withColumn("w", weight).groupBy(*by).agg(F.sum(F.col(value) * F.col("w")).alias("s"), F.sum("w").alias("w"), F.count("*").alias("n"))
    return out.select(*by, "n", F.round(F.col("s") / F.col("w"), 6).alias("blended"), F.floor(F.round(F.col("s") / F.col("w"), 6) + 0.5).cast("long").alias("pixel"))


def overlay(labels: DataFrame, support: DataFrame, exclusion: DataFrame, rectangles: DataFrame) -> DataFrame:
    """Pixels ``(x, y, label, valid, excluded)`` from label, support and exclusion sources put together by place.

    A place that the support lacks is not valid. What the exclusion raster holds or a rectangle covers is excluded,
    once, and only inside the support.
    """
    held = exclusion.select("x", "y").distinct().withColumn("_e", F.lit(True))
    px = labels.join(support.select("x", "y", "valid"), ["x", "y"], "left").join(held, ["x", "y"], "left")
    px = px.withColumn("valid", F.coalesce("valid", F.lit(False))).withColumn("excluded", F.col("_e").isNotNull()).drop("_e")
    return mark_rectangles(px, rectangles).withColumn("excluded", F.col("valid") & F.col("excluded"))
