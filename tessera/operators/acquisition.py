"""Checks of acquisitions: captures against tiles, points against files, verdicts against references."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions import scalar
from tessera.operators import joins


def tile_table(members: DataFrame, container: str = "container", member: str = "member", pattern: str = r"_L(\d+)_(up|down)", number: str = r"(\d+(?:\.\d+)?)\.[A-Za-z]+$") -> DataFrame:
    """Tiles from containers named by column and direction and members named by number: sorted by number in each
    column, with the order and the row that a path up and down in turn gives. Names that don't fit stay out."""
    rows = members.withColumn(
        "col", F.nullif(F.regexp_extract(container, pattern, 1), F.lit("")).try_cast("int")
    ).withColumn("direction", F.regexp_extract(container, pattern, 2)).withColumn("key", F.nullif(F.regexp_extract(member, number, 1), F.lit("")).try_cast("double")).where("col is not null and key is not null")
    w = Window.partitionBy("col")
    rows = rows.withColumn("order", F.row_number().over(w.orderBy("key", member)) - 1)
    rows = rows.withColumn("nominal_row", F.when(F.col("direction") == "up", F.count("*").over(w) - 1 - F.col("order")).otherwise(F.col("order")).cast("int"))
    return joins.dense_index(rows, "col", "col_idx")


def check_captures(captures: DataFrame, tiles: DataFrame, rows: int, columns: int) -> DataFrame:
    """Captures ``(name, row, col, bytes, sha256)`` against tiles ``(name, bytes, sha256)``: one line per fault.

    Only one shuffle on the name on each side; captures outside the grid and repeated places are found beside it.
    """
    there = tiles.select(F.col("name").alias("_n"), F.col("bytes").alias("_b"), F.col("sha256").alias("_s"))
    met = captures.join(there, F.col("name") == F.col("_n"), "full_outer")
    fault = F.when(F.col("name").isNull(), "tile without capture").when(F.col("_n").isNull(), "capture without tile").when(F.col("bytes") != F.col("_b"), "size differs").when(F.col("sha256") != F.col("_s"), "hash differs").when(
        ~F.col("row").between(0, rows - 1) | ~F.col("col").between(0, columns - 1), "outside the grid"
    )
    out = met.select(F.coalesce("name", "_n").alias("name"), fault.alias("fault")).where("fault is not null")
    twice = captures.groupBy("row", "col").agg(
        F.count("*").alias("n"), F.max("name").alias("name")
    ).where("n > 1").select("name", F.lit("place captured twice").alias("fault"))
    return out.unionByName(twice)


def transfer_is_whole(sessions: DataFrame, captures: DataFrame, tiles: DataFrame, by: str = "session_id") -> DataFrame:
    """Per session: completed, and as many captures as photos said to be saved and tiles that are there."""
    count = lambda df, name: df.groupBy(by).agg(F.count("*").alias(name))
    out = sessions.select(by, "status", "photos_saved").join(
        count(captures, "captures"), by, "left"
    ).join(count(tiles, "tiles"), by, "left").fillna(0, ["captures", "tiles"])
    return out.withColumn("whole", (F.col("status") == "completed") & (F.col("captures") == F.col("photos_saved")) & (F.col("tiles") == F.col("photos_saved")))


def zip_by_position(files: DataFrame, points: DataFrame, by: str, file_order: str, point_order: str) -> DataFrame:
    """Files beside scan points in order, only in groups where there are as many of one as of the other."""
    place = lambda df, order: df.withColumn("_i", F.row_number().over(Window.partitionBy(by).orderBy(order))).withColumn("_n", F.count("*").over(Window.partitionBy(by)))
    return place(files, file_order).join(place(points, point_order), [by, "_i", "_n"]).drop("_i", "_n")


def newest(histories: DataFrame, name: str, n: int) -> DataFrame:
    return histories.orderBy(F.desc(name)).limit(n)


def outside_neighbours(tiles: DataFrame, column: str, order: str, group: str, ident: str) -> DataFrame:
    """For each group of tiles in a column the tile before its first and after its last."""
    w = Window.partitionBy(column).orderBy(order)
    near = tiles.withColumn("_p", F.lag(ident).over(w)).withColumn("_pg", F.lag(group).over(w)).withColumn("_f", F.lead(ident).over(w)).withColumn("_fg", F.lead(group).over(w))
    other = lambda g, v: F.when(~F.col(g).eqNullSafe(F.col(group)), F.col(v))
    return near.where(F.col(group).isNotNull()).groupBy(column, group).agg(
        F.max(other("_pg", "_p")).alias("before"), F.max(other("_fg", "_f")).alias("after")
    )


def reference_verdict(observed: Column, reference: Column, tolerance: float = 0.1, low: float = 0.5, high: float = 2.0) -> Column:
    """Three observed channel medians against reference ones, as ``(gain, verdict)``: black first, then an implausible
    gain, then within the tolerance, else different."""
    gain = F.zip_with(reference, observed, lambda r, o: F.try_divide(r, o))
    verdict = F.when(F.exists(observed, lambda v: v <= 0), "black").when(F.exists(gain, lambda g: (g < low) | (g > high)), "implausible").when(
        F.forall(gain, lambda g: F.abs(g - 1) <= tolerance), "within_tolerance"
    ).otherwise("differs")
    return F.struct(gain.alias("gain"), verdict.alias("verdict"))


def clean_field(metrics: DataFrame, flat: float = 0.5, plateau: float = 0.85, std: float = 12.0, saturated: float = 0.005, dark: float = 40.0) -> DataFrame:
    """Whether a frame shows bare ground alone, and why not; and, apart from that, whether it is exposed well.

    ``metrics`` has ``flat_fraction, plateau_share, other_plateaus, std, saturated, luminance``; what is missing speaks
    against the frame.
    """
    rules = [
        ("flat", F.col("flat_fraction") < flat), ("plateau", F.col("plateau_share") < plateau), ("other_material", F.col("other_plateaus") > 0),
        ("spread", F.col("std") > std)
    ]
    reasons = F.array_compact(F.array(*(F.when(F.coalesce(c, F.lit(True)), F.lit(n)) for n, c in rules)))
    exposure = F.when(F.col("saturated") > saturated, "saturated").when(F.col("luminance") < dark, "too_dark").otherwise("ok")
    return metrics.withColumn("reasons", reasons).withColumn("clean", F.size("reasons") == 0).withColumn("exposure", exposure)


def scale_plan(width: Column, height: Column, want_width: Column, want_height: Column, divisors: tuple[int, ...] = (1, 2, 4, 8)) -> Column:
    """The divisor by which both sides shrink to the wanted size without a rest, or null; compared in whole numbers."""
    fits = [F.when((width == want_width * d) & (height == want_height * d), d) for d in divisors]
    return F.coalesce(*fits)


def congruent(value: str, period: str, df: DataFrame, high: float | None = None, expected: float | None = None, tolerance: float | None = None) -> DataFrame:
    """Each measurement with those a period to either side, as candidates of the same phase: without those beyond
    ``high``, and, where something is expected with a tolerance, those further from it."""
    out = df.withColumn("candidate", F.explode(F.array(F.col(value) - F.col(period), F.col(value), F.col(value) + F.col(period))))
    if high is not None:
        out = out.where(F.abs("candidate") <= high)
    return out if expected is None or tolerance is None else out.where(F.abs(F.col("candidate") - expected) <= tolerance)


def best_candidates(rows: DataFrame, by: str, score: str, tie: str, n: int = 3) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy(by).orderBy(F.desc(score), tie))
    return rows.withColumn("rank", rank).where(F.col("rank") <= n)


def recent(files: DataFrame, name: str, at: str, since: float, slack: float = 2.0, extensions: Sequence[str] = ("png", "jpg", "jpeg", "bmp", "tif", "tiff")) -> DataFrame:
    """Image files that came after a moment, less a slack for clocks that differ."""
    return files.where(F.lower(F.regexp_extract(name, r"\.([A-Za-z]+)$", 1)).isin(*extensions) & (F.col(at) >= since - slack))


def tails(rows: DataFrame, content: str, limit: int) -> DataFrame:
    """The last bytes of each content, its whole size, whether it was cut, and the tail's digest."""
    size = F.octet_length(content).cast("long")
    tail = F.when(size > limit, F.expr(f"substring({content}, -{limit}, {limit})")).otherwise(F.col(content))
    return rows.withColumn("bytes", size).withColumn("cut", size > limit).withColumn("tail", tail).withColumn("sha256", F.sha2("tail", 256))


def mirrored(tiles: DataFrame, column: str, gains: Mapping[str, float]) -> DataFrame:
    """Tiles in mirrored columns, the last first, and their values times a gain, rounded half to even and clamped."""
    top = tiles.agg(F.max(column)).head()[0] or 0
    return tiles.withColumn(column, F.lit(top) - F.col(column)).withColumns({c: scalar.apply_gain(F.col(c), F.lit(g)) for c, g in gains.items()})


def select_runs(runs: DataFrame, key: str, names: DataFrame) -> DataFrame:
    """The runs that are named; a name that no run has is an error."""
    unknown = [r[0] for r in names.select(key).join(runs.select(key), key, "left_anti").limit(5).collect()]
    if unknown:
        raise ValueError(f"unknown runs: {unknown}")
    return runs.join(names.select(key), key, "left_semi")


def choose(runs: DataFrame, key: str, day: str, since: str | None = None, on: str | None = None) -> DataFrame:
    """All runs, those since a day, or those of a day; a run without a date is only among all."""
    if since is not None:
        return runs.where(F.col(day) >= since)
    return runs.where(F.col(day) == on) if on is not None else runs


def profile_faults(width: str = "width", height: str = "height", vectors: tuple[str, str, str, str] = ("dx_v", "dy_v", "dx_h", "dy_h"), divisor: str = "scale_div", least: int = 8) -> Column:
    """What is wrong with a geometry of tiles, as an array: steps that don't lead down and aside, neighbours that don't
    overlap, steps that span no grid of the right hand, a divisor that leaves a rest or tiles that are too small."""
    w, h, d = F.col(width), F.col(height), F.col(divisor)
    xv, yv, xh, yh = map(F.col, vectors)
    rules = [
        ("direction", (yv <= 0) | (xh == 0)),
        ("overlap", (F.abs(xv) >= w) | (yv >= h) | (F.abs(xh) >= w) | (F.abs(yh) >= h)),
        ("degenerate", F.signum(xh) * (xh * yv - xv * yh) <= 1e-9),
        ("divisor", (w % d != 0) | (h % d != 0)),
        ("too small", F.least(F.floor(w / d), F.floor(h / d)) < least),
    ]
    return F.array_compact(F.array(*(F.when(c, F.lit(n)) for n, c in rules)))


def inference_plan(native_w: Column, native_h: Column, model_w: Column, model_h: Column, confirmed: Column, tile: Column, overlap: Column) -> Column:
    """How a model's windows lie on images of another size, as ``(reason, native_tile, native_overlap)``: in whole
    numbers, by cross multiplication, or with the first reason why not."""
    positive = (native_w > 0) & (native_h > 0) & (model_w > 0) & (model_h > 0)
    size = lambda n: n.cast("long") * native_w
    whole = lambda n: size(n) % F.when(model_w != 0, model_w) == 0
    reason = F.when(~positive, "nonpositive_image_dimensions").when(~confirmed, "same_physical_field_of_view_not_confirmed").when(
        model_w * native_h != model_h * native_w, "anisotropic_dimension_ratio_requires_calibration"
    ).when(~(whole(tile) & whole(overlap)), "nonintegral_native_tile_or_overlap")
    scaled = lambda n: F.when(reason.isNull(), F.floor(size(n) / model_w)).cast("long")
    return F.struct(reason.alias("reason"), scaled(tile).alias("native_tile"), scaled(overlap).alias("native_overlap"))


def grid_policy(requested: Column, source: Column) -> Column:
    """Recorded rows are trusted for a whole flat grid alone: ``auto`` takes that into account, and asking for it with
    another source is refused (null), as is an unknown policy."""
    flat = source == "flat-physical-grid"
    return F.when(
        requested == "auto", F.when(flat, "preserve").otherwise("legacy")
    ).when(requested == "legacy", "legacy").when((requested == "preserve") & flat, "preserve")


def nominal_positions(tiles: DataFrame, down: tuple[float, float], aside: tuple[float, float]) -> DataFrame:
    """Where tiles ``(row, col)`` lie by the steps alone, moved so that the least is 0."""
    at = lambda i: F.col("col") * aside[i] + F.col("row") * down[i]
    placed = tiles.withColumns({"x": at(0), "y": at(1)})
    least = placed.agg(F.min("x").alias("_x"), F.min("y").alias("_y"))
    # one row
    return placed.join(F.broadcast(least)).withColumns({"x": F.col("x") - F.col("_x"), "y": F.col("y") - F.col("_y")}).drop("_x", "_y")
