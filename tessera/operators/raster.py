"""Pixel operators: metrics and stencils as windows, regions as components of runs."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.scalar import luminance
from tessera.operators.graph import connected_components
from tessera.operators.lines import gaussian, squared_distance
from tessera.session import remove, settle, small, stored


def valid_region(px: DataFrame, filler: str = "white", tolerance: int = 5) -> DataFrame:
    """``valid``: false where all channels are near the filler's colour; other fillers leave all valid."""
    near = {"white": F.least("r", "g", "b") >= 255 - tolerance, "black": F.greatest("r", "g", "b") <= tolerance}.get(filler)
    return px.withColumn("valid", ~near if near is not None else F.lit(True))


def flat_mask(px: DataFrame, by: str, tolerance: float = 6.0) -> DataFrame:
    """``flat``: grey differs by no more than the tolerance from each neighbour that is there."""
    rows, cols = Window.partitionBy(by, "y").orderBy("x"), Window.partitionBy(by, "x").orderBy("y")
    g = px.withColumn("grey", luminance(F.col("r"), F.col("g"), F.col("b")))
    near = lambda other, step: F.coalesce((F.abs(F.col("grey") - other) <= tolerance) | ~step, F.lit(True))
    flat = F.lit(True)
    for w, axis in ((rows, "x"), (cols, "y")):
        for shift in (F.lag, F.lead):
            flat = flat & near(shift("grey").over(w), F.abs(shift(axis).over(w) - F.col(axis)) == 1)
    return g.withColumn("flat", flat)


def tile_metrics(px: DataFrame, by: str, value: str = "grey") -> DataFrame:
    """Mean, deviation, Laplacian variance, Tenengrad and the share at the rails, per image."""
    rows, cols = Window.partitionBy(by, "y").orderBy("x"), Window.partitionBy(by, "x").orderBy("y")
    v = F.col(value)
    near = px.withColumns({"_l": F.lag(value).over(rows), "_r": F.lead(value).over(rows), "_u": F.lag(value).over(cols), "_d": F.lead(value).over(cols)})
    lap = F.col("_l") + F.col("_r") + F.col("_u") + F.col("_d") - 4 * v
    grad = F.pow(F.col("_r") - F.col("_l"), 2) + F.pow(F.col("_d") - F.col("_u"), 2)
    return near.groupBy(by).agg(
        F.avg(v).alias("mean"), F.stddev_pop(v).alias("std"), F.var_pop(lap).alias("focus"), F.avg(grad).alias("tenengrad"),
        F.avg(((v >= 250) | (v <= 5)).cast("double")).alias("clip_frac"), F.count("*").alias("n")
    )


def local_variance(px: DataFrame, by: str, reach: int, value: str = "grey") -> DataFrame:
    """The variance in a box around each pixel, cut at the image's border, from two running sums per axis."""
    rows = Window.partitionBy(by, "y").orderBy("x").rangeBetween(-reach, reach)
    cols = Window.partitionBy(by, "x").orderBy("y").rangeBetween(-reach, reach)
    v = F.col(value).cast("double")
    s = px.withColumns({"_s": F.sum(v).over(rows), "_q": F.sum(v * v).over(rows), "_n": F.count(v).over(rows)})
    s = s.withColumns({"_s2": F.sum("_s").over(cols), "_q2": F.sum("_q").over(cols), "_n2": F.sum("_n").over(cols)})
    var = F.greatest(F.lit(0.0), F.col("_q2") / F.col("_n2") - F.pow(F.col("_s2") / F.col("_n2"), 2))
    return s.withColumn("variance", var).drop("_s", "_q", "_n", "_s2", "_q2", "_n2")


def dilate(px: DataFrame, by: str, name: str, reach: int) -> DataFrame:
    """A mask widened by a box: the largest value within reach along x, then along y."""
    rows = Window.partitionBy(by, "y").orderBy("x").rangeBetween(-reach, reach)
    cols = Window.partitionBy(by, "x").orderBy("y").rangeBetween(-reach, reach)
    return px.withColumn(name, F.max(name).over(rows)).withColumn(name, F.max(name).over(cols))


def erode(px: DataFrame, by: str, name: str, reach: int) -> DataFrame:
    return dilate(px.withColumn(name, ~F.col(name)), by, name, reach).withColumn(name, ~F.col(name))


def close_mask(px: DataFrame, by: str, name: str, reach: int = 4) -> DataFrame:
    return erode(dilate(px, by, name, reach), by, name, reach)


def trim_border(px: DataFrame, by: str, width: int, height: int, trim: int) -> DataFrame:
    """``valid`` only where no invalid pixel lies nearer than the trim, by exact distances: the work is the same for any
    trim."""
    far = squared_distance(px, by, "not valid", "_d2")
    return far.withColumn("valid", F.col("valid") & (F.coalesce("_d2", F.lit(trim * trim)) >= trim * trim)).drop("_d2")


def label_components(px: DataFrame, by: str, mask: Column) -> DataFrame:
    """Four-connected components of a mask over tables of any size: ``(by, x, y, component)``, components named after
    their first pixel in scan order. Runs of pixels in a row are found first and are the nodes; runs that touch in
    neighbouring rows are linked."""
    kept = px.where(mask).select(by, F.col("x").cast("int").alias("x"), F.col("y").cast("int").alias("y"))
    row = Window.partitionBy(by, "y").orderBy("x")
    runs = kept.withColumn("_g", F.col("x") - F.row_number().over(row)).withColumn("_s", F.min("x").over(Window.partitionBy(by, "y", "_g")))
    runs = settle(runs.select(by, "x", "y", F.struct(by, (F.col("y").cast("long") * 1_000_003 + F.col("_s")).alias("node")).alias("run")))
    below = runs.select(by, "x", (F.col("y") + 1).alias("y"), F.col("run").alias("src")).join(
        runs.select(by, "x", "y", F.col("run").alias("dst")), [by, "x", "y"]
    )
    alone = runs.select(F.col("run").alias("src"), F.col("run").alias("dst"))
    found = connected_components(below.select("src", "dst").unionByName(alone).distinct())
    return runs.join(found, F.col("run") == F.col("node")).select(by, "x", "y", F.col("component.node").alias("component"))


def fill_holes(px: DataFrame, by: str, mask: str) -> DataFrame:
    """Set the mask on background components that touch no border of their image."""
    background = label_components(px, by, ~F.col(mask))
    frame = px.groupBy(by).agg(F.min("x").alias("x0"), F.max("x").alias("x1"), F.min("y").alias("y0"), F.max("y").alias("y1"))
    touching = F.max(((F.col("x") == F.col("x0")) | (F.col("x") == F.col("x1")) | (F.col("y") == F.col("y0")) | (F.col("y") == F.col("y1"))))
    inner = background.join(frame, by).groupBy(by, "component").agg(touching.alias("open")).where("not open")
    holes = background.join(inner, [by, "component"], "left_semi").select(by, "x", "y").withColumn("_hole", F.lit(True))
    return px.join(holes, [by, "x", "y"], "left").withColumn(mask, F.col(mask) | F.col("_hole").isNotNull()).drop("_hole")


def regions(px: DataFrame, by: str, target: int, least_share: float = 0.01, most: int = 8) -> DataFrame:
    """The largest components of a class per image above a share of the class: area, box, fill, mean colour."""
    comp = label_components(px, by, F.col("label") == target)
    stats = comp.join(px, [by, "x", "y"]).groupBy(by, "component").agg(
        F.count("*").alias("area_px"), F.min("x").alias("x0"), (F.max("x") + 1).alias("x1"), F.min("y").alias("y0"), (F.max("y") + 1).alias("y1")
    )
    whole = stats.groupBy(by).agg(F.sum("area_px").alias("class_px"))
    out = stats.join(whole, by).withColumn("pct_of_class", 100.0 * F.col("area_px") / F.col("class_px")).withColumn(
        "bbox_fill", F.col("area_px") / ((F.col("x1") - F.col("x0")) * (F.col("y1") - F.col("y0")))
    )
    rank = F.row_number().over(Window.partitionBy(by).orderBy(F.desc("area_px"), "component"))
    return out.where(F.col("area_px") >= least_share * F.col("class_px")).withColumn("rank", rank).where(F.col("rank") <= most).drop("class_px")


def central_exclusion(found: DataFrame, by: str, width: int, height: int, pad: float = 0.08) -> DataFrame:
    """Per image: the box of the one component whose box holds the centre, padded and cut to the image; with none or
    several a review is asked for."""
    cx, cy = width // 2, height // 2
    inside = F.col("x0").between(0, cx) & (F.col("x1") > cx) & F.col("y0").between(0, cy) & (F.col("y1") > cy)
    px_, py_ = F.ceil((F.col("x1") - F.col("x0")) * pad), F.ceil((F.col("y1") - F.col("y0")) * pad)
    box = F.struct(
        F.greatest(F.lit(0), F.col("x0") - px_).alias("x1"), F.greatest(F.lit(0), F.col("y0") - py_).alias("y1"),
        F.least(F.lit(width), F.col("x1") + px_).alias("x2"), F.least(F.lit(height), F.col("y1") + py_).alias("y2")
    )
    out = found.withColumn("inside", inside).withColumn("box", box).groupBy(by).agg(
        F.count_if("inside").alias("candidates"), F.min(F.when(F.col("inside"), F.col("box"))).alias("box")
    )
    return out.select(
        by, F.when(F.col("candidates") == 1, F.col("box")).alias("box"),
        F.when(F.col("candidates") == 1, "accepted").otherwise("needs_review").alias("status")
    )


def usable_samples(px: DataFrame, by: str, value: str, least_std: float = 3.0, mean: tuple[float, float] = (8.0, 247.0), rails: tuple[float, float] = (2.0, 253.0)) -> DataFrame:
    """Per image whether it says anything about the light: not blank, not too dark or bright, and less than half of it
    at the ends of the range."""
    v = F.col(value)
    m = px.groupBy(by).agg(F.avg(v).alias("mean"), F.stddev_pop(v).alias("std"), F.avg(((v <= rails[0]) | (v >= rails[1])).cast("double")).alias("rails"))
    return m.withColumn("usable", (F.col("std") >= least_std) & F.col("mean").between(*mean) & (F.col("rails") <= 0.5))


def flat_field(px: DataFrame, value: str = "grey", least: int = 8, blur: float | None = None) -> DataFrame:
    """Per pixel the median over tiles of values divided by their tile's mean, blurred by an eighth of the longer side
    (or by ``blur``; 0: not at all), kept above a thousandth of the largest, and scaled to a mean of 1. The pixels and
    the medians are stored, as both are read again."""
    px, kept_px = stored(px.select("tile", "x", "y", value), "pixels")
    tiles = px.groupBy("tile").agg(F.avg(value).alias("_m")).where("_m > 0")
    scaled = px.join(small(tiles, 100_000), "tile").select("x", "y", (F.col(value) / F.col("_m")).alias("_r"))
    ratio, _ = stored(scaled.groupBy("x", "y").agg(F.percentile("_r", 0.5).alias("gain"), F.count("*").alias("n")), "ratios")
    remove(px.sparkSession, kept_px)
    fewest = ratio.agg(F.min("n").alias("n"), F.max("x").alias("x"), F.max("y").alias("y")).head()
    if fewest.n is None or fewest.n < least:
        return ratio.select("x", "y", "gain").limit(0)
    sigma = (max(fewest.x, fewest.y) + 1) / 8 if blur is None else blur
    smooth = gaussian(ratio.withColumn("_t", F.lit(0)), "_t", "gain", sigma) if sigma else ratio
    top = smooth.agg(F.max("gain").alias("_top"))
    kept = smooth.join(F.broadcast(top)).select("x", "y", F.greatest("gain", F.col("_top") * 1e-3).alias("gain"))
    whole = kept.agg(F.avg("gain").alias("_g"))
    return kept.join(F.broadcast(whole)).select("x", "y", (F.col("gain") / F.col("_g")).alias("gain"))


def render(px: DataFrame, positions: DataFrame, tile_w: int, tile_h: int, background: float = 0.0) -> DataFrame:
    """The mosaic of tiles at their positions: feather-weighted mean per canvas pixel, rounded by a half and clamped."""
    placed = px.join(small(positions.select(F.col("tile").alias("_t"), "left", "top"), 100_000), F.col("tile") == F.col("_t"))
    w = F.greatest(
        F.least(F.col("x") + 1, tile_w - F.col("x")) * F.least(F.col("y") + 1, tile_h - F.col("y")) / F.lit(
            float((tile_w + 1) // 2 * ((tile_h + 1) // 2))
        ),
        F.lit(1e-4)
    )
    out = placed.select(
        (F.col("x") + F.col("left")).alias("x"), (F.col("y") + F.col("top")).alias("y"), (F.col("grey") * w).alias("v"), w.alias("w")
    ).groupBy("x", "y").agg((F.sum("v") / F.sum("w")).alias("v"), F.count("*").alias("tiles"))
    return out.select(
        "x", "y", "tiles",
        F.greatest(F.lit(0), F.least(F.lit(255), F.floor(F.round(F.coalesce("v", F.lit(background)), 9) + 0.5))).cast("int").alias("grey")
    )


def merge_first(preds: DataFrame) -> DataFrame:
    """Of overlapping predictions ``(tile_order, x, y, label)`` the first tile's."""
    return preds.groupBy("x", "y").agg(F.min_by("label", "tile_order").alias("label"))


def accept_edges(edges: DataFrame, prior_dx: float, prior_dy: float, least_ncc: float = 0.5, most_off: float = 20.0) -> DataFrame:
    """Edges of enough correlation near the prior keep their step and their correlation as weight; the others get the
    prior's step at a weight of a thousandth, with the reason."""
    off = F.hypot(F.col("dx") - prior_dx, F.col("dy") - prior_dy)
    why = F.when(F.col("ncc") < least_ncc, "correlation").when(off > most_off, "deviation")
    out = edges.withColumn("why", why)
    keep = F.col("why").isNull()
    return out.withColumn(
        "dx", F.when(keep, F.col("dx")).otherwise(prior_dx)
    ).withColumn("dy", F.when(keep, F.col("dy")).otherwise(prior_dy)).withColumn("w", F.when(keep, F.col("ncc")).otherwise(1e-3))


def grow_region(px: DataFrame, by: str, seed: tuple[int, int], tolerance: float) -> DataFrame:
    """The component around a seed pixel of the colours near the seed's."""
    x, y = seed
    at = px.where((F.col("x") == x) & (F.col("y") == y)).select(by, *(F.col(c).alias(f"_{c}") for c in "rgb"))
    near = px.join(small(at), by).withColumn("_near", F.sqrt(sum((F.col(c) - F.col(f"_{c}")) ** 2 for c in "rgb")) <= tolerance)
    parts = label_components(near, by, F.col("_near"))
    mine = parts.where((F.col("x") == x) & (F.col("y") == y)).select(by, "component")
    return parts.join(mine, [by, "component"], "left_semi")


def satellites(parts: DataFrame, by: str, main: int, radius: int, least: int = 1, most: int = 6) -> DataFrame:
    """Components of which a pixel lies within a radius of the main one, largest first. Pixels meet in boxes of the
    radius's size, by equal keys."""
    boxed = lambda df: df.withColumn("bx", F.floor(F.col("x") / radius)).withColumn("by_", F.floor(F.col("y") / radius))
    around = F.explode(F.array(*(F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in (-1, 0, 1) for j in (-1, 0, 1))))
    core = boxed(parts.where(F.col("component") == main)).select(by, F.col("x").alias("mx"), F.col("y").alias("my"), "bx", "by_", around.alias("d")).select(
        by, "mx", "my", (F.col("bx") + F.col("d.i")).alias("bx"), (F.col("by_") + F.col("d.j")).alias("by_")
    )
    near = boxed(parts.where(F.col("component") != main)).join(core, [by, "bx", "by_"]).where(
        (F.col("x") - F.col("mx")) ** 2 + (F.col("y") - F.col("my")) ** 2 <= radius * radius
    ).select(by, "component").distinct()
    sizes = parts.join(near, [by, "component"], "left_semi").groupBy(by, "component").agg(F.count("*").alias("size")).where(F.col("size") >= least)
    rank = F.row_number().over(Window.partitionBy(by).orderBy(F.desc("size"), "component"))
    return sizes.withColumn("rank", rank).where(F.col("rank") <= most)


def background_colour(px: DataFrame, by: str, tolerance: float = 6.0, least: float = 0.1) -> DataFrame:
    """Per image the median colour of the flat pixels in its brightest bin of luminance that holds a share of them; of
    all flat pixels where no bin does."""
    flat = flat_mask(px, by, tolerance).where("flat").withColumn("bin", F.floor(F.col("grey") / 16))
    bins = flat.groupBy(by, "bin").agg(F.count("*").alias("n"))
    total = bins.groupBy(by).agg(F.sum("n").alias("total"))
    best = bins.join(total, by).groupBy(by).agg(F.max(F.when(F.col("n") >= least * F.col("total"), F.col("bin"))).alias("best"))
    inside = flat.join(best, by).where(F.col("best").isNull() | (F.col("bin") == F.col("best")))
    return inside.groupBy(by).agg(
        *(F.percentile(c, 0.5).alias(c) for c in "rgb"), F.first(F.when(F.col("best").isNull(), "all_flat").otherwise("plateau")).alias("source"),
        F.count("*").alias("pixels")
    )


def mirrored_border(px: DataFrame, by: str, width: int, height: int, reach: int) -> DataFrame:
    """The image with a border of its own outermost pixels mirrored, each of them repeated."""
    out = px
    for c, size in (("x", width), ("y", height)):
        before = out.where(F.col(c).between(0, reach - 1)).withColumn(c, -1 - F.col(c))
        after = out.where(F.col(c).between(size - reach, size - 1)).withColumn(c, 2 * size - 1 - F.col(c))
        out = out.unionByName(before).unionByName(after)
    return out


def downsample(px: DataFrame, by: str, width: int, height: int, most: int = 1024) -> DataFrame:
    """Brightness by blocks of whole pixels, so that the longer side has ``most`` pixels at most; what is left over at
    the right and lower border is cut."""
    step = -(-max(width, height) // most)
    inside = px.where((F.col("x") < width // step * step) & (F.col("y") < height // step * step))
    return inside.groupBy(
        by, F.floor(F.col("x") / step).alias("x"), F.floor(F.col("y") / step).alias("y")
    ).agg(F.avg(luminance(F.col("r"), F.col("g"), F.col("b"))).alias("grey"))


def closed(px: DataFrame, by: str, name: str, reach: int, width: int, height: int) -> DataFrame:
    """A mask closed by a box: widened, then narrowed; what lies beyond the image counts as outside the mask, so nothing
    within reach of the border is left."""
    out = close_mask(px, by, name, reach)
    return out.withColumn(name, F.col(name) & F.col("x").between(reach, width - 1 - reach) & F.col("y").between(reach, height - 1 - reach))


def alarms(px: DataFrame, by: str, width: int, height: int, reach: int = 16, var_limit: float = 3.0, dark: float = 60.0, least: int = 1250) -> DataFrame:
    """Connected regions that are featureless or nearly black, yet labelled crystal: ``(by, component, area_px, x0, x1,
    y0, y1, dominant, pct_of_class, mean_grey, mean_var)``, from pixels ``(x, y, grey, label, valid)``.

    Variances are those of a box whose border is mirrored; regions of fewer pixels than ``least`` are no alarms.
    """
    inside = F.col("x").between(0, width - 1) & F.col("y").between(0, height - 1)
    rough = local_variance(mirrored_border(px, by, width, height, reach), by, reach).where(inside)
    crystal = (F.col("label") > 0) & F.col("valid")
    parts = label_components(rough, by, ((F.col("variance") < var_limit) | (F.col("grey") < dark)) & crystal)
    met = parts.join(rough, [by, "x", "y"])
    classes = rough.where("label > 0 and valid").groupBy(by, F.col("label").alias("dominant")).agg(F.count("*").alias("_all"))
    counts = met.groupBy(by, "component", "label").agg(F.count("*").alias("n"))
    top = counts.groupBy(by, "component").agg(F.max_by(F.struct("label", "n"), F.struct(F.col("n"), -F.col("label"))).alias("top"))
    out = met.groupBy(by, "component").agg(
        F.count("*").alias("area_px"), F.min("x").alias("x0"), (F.max("x") + 1).alias("x1"), F.min("y").alias("y0"), (F.max("y") + 1).alias("y1"),
        F.avg("grey").alias("mean_grey"), F.avg("variance").alias("mean_var")
    )
    out = out.where(F.col("area_px") >= least).join(top, [by, "component"]).withColumn("dominant", F.col("top.label"))
    return out.join(classes, [by, "dominant"]).withColumn("pct_of_class", 100.0 * F.col("top.n") / F.col("_all")).drop("top", "_all")


def closed_parts(px: DataFrame, by: str, target: int, width: int, height: int, reach: int = 2) -> DataFrame:
    """Components of a class after closing."""
    shut = closed(px.withColumn("_closed", (F.col("label") == target) & F.col("valid")), by, "_closed", reach, width, height)
    return label_components(shut, by, F.col("_closed"))


def filled_parts(px: DataFrame, by: str, boxes: DataFrame, own: DataFrame, columns: Sequence[str] = ()) -> DataFrame:
    """``(by, component, filled_px, mean_*)``: each component with its holes, and the means of ``columns`` over both.

    A component's holes are the four-connected pieces of what is not of it inside its own box ``(by, component, x0, x1,
    y0, y1)`` that don't reach the box's rim; other components lying inside it are holes too. ``own`` has its pixels
    ``(by, component, x, y)``.
    """
    inside = px.join(small(boxes), by).where("x >= x0 and x < x1 and y >= y0 and y < y1")
    inside = inside.join(own.withColumn("_mine", F.lit(True)), [by, "component", "x", "y"], "left").withColumn("_key", F.struct(by, "component"))
    inside = settle(inside.select("_key", "x", "y", "_mine", ((F.col("x") == F.col("x0")) | (F.col("x") == F.col("x1") - 1) | (F.col("y") == F.col("y0")) | (F.col("y") == F.col("y1") - 1)).alias("_rim"), *columns))
    back = label_components(inside, "_key", F.col("_mine").isNull()).withColumnRenamed("component", "_piece")
    open_ = back.join(inside.where("_rim").select("_key", "x", "y"), ["_key", "x", "y"], "left_semi").select("_key", "_piece").distinct()
    holes = back.join(open_, ["_key", "_piece"], "left_anti").select("_key", "x", "y").withColumn("_hole", F.lit(True))
    filled = inside.join(holes, ["_key", "x", "y"], "left").where(F.coalesce("_mine", "_hole"))
    out = filled.groupBy("_key").agg(F.count("*").alias("filled_px"), *(F.avg(c).alias(f"mean_{c}") for c in columns))
    return out.select(F.col(f"_key.{by}").alias(by), F.col("_key.component").alias("component"), "filled_px", *(f"mean_{c}" for c in columns))


def candidates(px: DataFrame, by: str, target: int, parts: DataFrame, least_pct: float = 1.0, most: int = 8, filled: bool = False) -> DataFrame:
    """The largest regions of a class, at most ``most`` of ``least_pct`` percent of it and more: area of the class's own
    pixels, shares of class and crystal, box, fill of the box, mean grey. From pixels ``(x, y, grey, label, valid)`` and
    the class's ``closed_parts``. With ``filled`` also ``solidity``, the share of a region filled up that is its own, and
    the mean ``r, g, b`` of the filled region."""
    own = px.withColumn("_sel", (F.col("label") == target) & F.col("valid"))
    box = parts.groupBy(by, "component").agg(
        F.min("x").alias("x0"), (F.max("x") + 1).alias("x1"), F.min("y").alias("y0"), (F.max("y") + 1).alias("y1")
    )
    mine = parts.join(own.where("_sel"), [by, "x", "y"])
    held = mine.groupBy(by, "component").agg(F.count("*").alias("area_px"), F.avg("grey").alias("mean_grey"))
    totals = own.groupBy(by).agg(F.count_if("_sel").alias("_class"), F.count_if((F.col("label") > 0) & F.col("valid")).alias("_crystal"))
    out = held.join(box, [by, "component"]).join(totals, by).withColumns(
        {
            "pct_of_class": 100.0 * F.col("area_px") / F.col("_class"), "pct_of_crystal": 100.0 * F.col("area_px") / F.col("_crystal"),
            "bbox_fill": F.col("area_px") / ((F.col("x1") - F.col("x0")) * (F.col("y1") - F.col("y0")))
        }
    )
    rank = F.row_number().over(Window.partitionBy(by).orderBy(F.desc("area_px"), "component"))
    out = out.where(F.col("pct_of_class") >= least_pct).withColumn("rank", rank).where(F.col("rank") <= most).drop("_class", "_crystal")
    if not filled:
        return out
    out = settle(out)
    boxes = out.select(by, "component", "x0", "x1", "y0", "y1")
    whole = filled_parts(px.select(by, "x", "y", "r", "g", "b"), by, boxes, mine.select(by, "component", "x", "y"), "rgb")
    return out.join(whole, [by, "component"]).withColumn("solidity", F.col("area_px") / F.col("filled_px")).drop("filled_px")


def exclusion_mask(px: DataFrame, by: str, parts: DataFrame, excluded: DataFrame, width: int, height: int, reach: int = 4) -> DataFrame:
    """Pixels with ``_out``: the excluded components closed and their holes filled, so that all inside a region's rim
    leaves the count. ``parts`` has ``(by, x, y, component)``, ``excluded`` ``(by, component)``."""
    painted = parts.join(excluded, [by, "component"], "left_semi").select(by, "x", "y").withColumn("_p", F.lit(True))
    marked = px.join(painted, [by, "x", "y"], "left").withColumn("_out", F.col("_p").isNotNull()).drop("_p")
    return fill_holes(closed(marked, by, "_out", reach, width, height), by, "_out")


def central_rectangle(px: DataFrame, by: str, target: int, width: int, height: int, pad: float = 0.08, margin: float = 0.02, least_area: float = 0.01, most_box: float = 0.40) -> DataFrame:
    """One row per candidate region with the reasons against it, its padded rectangle, and ``selected`` where just one
    region of the image has none: a large region in the interior whose box holds the middle."""
    parts = closed_parts(px, by, target, width, height)
    found = candidates(px, by, target, parts)
    box = (F.col("x1") - F.col("x0")) * (F.col("y1") - F.col("y0"))
    mx, my = -(-width * margin // 1), -(-height * margin // 1)
    sel = (F.col("label") == target) & F.col("valid")
    raw = label_components(px, by, sel)
    touching = raw.groupBy(by, "component").agg(F.max((F.col("x").isin(0, width - 1)) | (F.col("y").isin(0, height - 1))).alias("edge"))
    rim = raw.join(touching.where("edge"), [by, "component"], "left_semi").select(by, F.col("x").alias("_x"), F.col("y").alias("_y")).distinct()
    bound = parts.join(
        rim, (parts[by] == rim[by]) & (F.col("x") == F.col("_x")) & (F.col("y") == F.col("_y"))
    ).select(parts[by], "component").distinct().withColumn("_edge", F.lit(True))
    rules = [
        ("off_centre", ~((F.col("x0") <= width / 2) & (F.col("x1") > width / 2) & (F.col("y0") <= height / 2) & (F.col("y1") > height / 2))),
        ("too_small", F.col("area_px") < width * height * least_area),
        ("box_too_large", box > width * height * most_box),
        ("not_interior", (F.col("x0") < mx) | (F.col("y0") < my) | (F.col("x1") > width - mx) | (F.col("y1") > height - my)),
        ("connected_to_edge", F.col("_edge").isNotNull()),
    ]
    out = found.join(bound, [by, "component"], "left").withColumn("reasons", F.array_compact(F.array(*(F.when(c, F.lit(n)) for n, c in rules))))
    px_, py_ = F.ceil((F.col("x1") - F.col("x0")) * pad), F.ceil((F.col("y1") - F.col("y0")) * pad)
    out = out.withColumns({"rx1": F.greatest(F.lit(0), F.col("x0") - px_), "ry1": F.greatest(F.lit(0), F.col("y0") - py_), "rx2": F.least(F.lit(width), F.col("x1") + px_), "ry2": F.least(F.lit(height), F.col("y1") + py_)})
    lone = F.count_if(F.size("reasons") == 0).over(Window.partitionBy(by)) == 1
    return out.withColumn("selected", (F.size("reasons") == 0) & lone).drop("_edge")
