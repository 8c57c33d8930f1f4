"""Where images lie against each other: overlaps correlated over boxes of displacements, strips that slide, and what the
pixels of many overlaps say. An edge is a row; a displacement is where the second image's origin lies in the first."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import product

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tessera.functions.scalar import luminance
from tessera.operators.lines import kernel
from tessera.session import Scratch, shuffle_partitions, small, stored

# Shares of the side at which a strip is cut, its margin, and how much of the other image it is sought in.
STRIP, MARGIN, SEARCH = 0.04, 0.14, 0.45
# An overlap counts from so much of the longer side (pixels at least) and so much of the area.
THIN, THIN_PX, AREA, AREA_PX = 0.03, 8, 0.012, 64
#: Pixels around a candidate that are searched again, and how many candidates.
NEAR, FIRST = 3, 3
#: Side of the blocks by which pixels are met, and the most edges whose rectangles are broadcast.
BLOCK, FEW = 64, 100_000
#: Pixels of a block of neighbouring images that are measured together, blocks of a task, the most images on a block's
#: side, and the most rows of images and their blocks that are broadcast.
HELD, BLOCKS, SIDE, ASKED = 500_000, 16, 8, 1_000_000


def images_of(px: DataFrame, by: str, value: str = "grey") -> DataFrame:
    """``(by, h, w, v)``: each image's values by rows, from a dense table of its pixels."""
    rows = F.array_sort(F.collect_list(F.struct("y", "x", F.col(value).cast("double").alias("v"))))
    return px.groupBy(by).agg((F.max("y") + 1).alias("h"), (F.max("x") + 1).alias("w"), F.transform(rows, lambda s: s["v"]).alias("v"))


# ---- one pair, in numpy


def high_pass(image: np.ndarray) -> np.ndarray:
    """The image less its blur by a 24th of the shorter side (2 at least), at mean 0 and deviation 1; a flat one is 0."""
    weights = kernel(max(2.0, min(image.shape) / 24))
    reach, smooth = len(weights) // 2, image
    for axis in (0, 1):
        wide = np.pad(smooth, [(reach, reach) if a == axis else (0, 0) for a in (0, 1)], mode="edge")
        smooth = sum(w * np.take(wide, np.arange(i, i + image.shape[axis]), axis) for i, w in enumerate(weights))
    rest = image - smooth
    rest = rest - rest.mean()
    spread = rest.std()
    return rest / spread if spread >= 1e-5 else np.zeros_like(rest)


def _sums(image: np.ndarray) -> np.ndarray:
    """A summed-area table with a row and a column of zeros before."""
    return np.pad(image, ((1, 0), (1, 0))).cumsum(axis=0).cumsum(axis=1)


def _inside(table: np.ndarray, y0: np.ndarray, y1: np.ndarray, x0: np.ndarray, x1: np.ndarray) -> np.ndarray:
    """Sums of the rectangles of all pairs of a row range and a column range."""
    return table[np.ix_(y1, x1)] - table[np.ix_(y0, x1)] - table[np.ix_(y1, x0)] + table[np.ix_(y0, x0)]


def overlap_surface(a: np.ndarray, b: np.ndarray, least_side: float, least_area: float) -> tuple[np.ndarray, int, int]:
    """The correlation of the overlap for every displacement that leaves enough of it, -1 for the others; and the row and
    the column of displacement 0. Products come from one transform, means and variances from summed areas."""
    h, w = a.shape
    far_y, far_x = max(0, int(h - least_side)), max(0, int(w - least_side))
    dy, dx = np.arange(-far_y, far_y + 1), np.arange(-far_x, far_x + 1)
    shape = (2 * h, 2 * w)
    cross = np.fft.irfft2(np.fft.rfft2(a, shape) * np.fft.rfft2(b, shape).conj(), shape)[np.ix_(dy % shape[0], dx % shape[1])]
    y0, y1, x0, x1 = np.maximum(0, dy), np.minimum(h, h + dy), np.maximum(0, dx), np.minimum(w, w + dx)
    n = np.outer(y1 - y0, x1 - x0).astype(float)
    sums = [_inside(_sums(v), y0, y1, x0, x1) for v in (a, a * a)] + [_inside(_sums(v), y0 - dy, y1 - dy, x0 - dx, x1 - dx) for v in (b, b * b)]
    va, vb = sums[1] - sums[0] ** 2 / n, sums[3] - sums[2] ** 2 / n
    fine = (n >= least_area) & (va > 1e-8) & (vb > 1e-8)
    out = np.where(fine, (cross - sums[0] * sums[2] / n) / np.sqrt(np.where(fine, va * vb, 1)), -1.0)
    return out, far_y, far_x


def phase_peak(a: np.ndarray, b: np.ndarray) -> tuple[int, int]:
    """The displacement of the highest phase correlation; it is known but for whole sides of the image."""
    window = np.outer(np.hanning(a.shape[0]), np.hanning(a.shape[1]))
    cross = np.fft.rfft2(a * window) * np.fft.rfft2(b * window).conj()
    peak = np.fft.irfft2(cross / np.maximum(np.abs(cross), 1e-12), a.shape)
    y, x = np.unravel_index(int(peak.argmax()), peak.shape)
    return int(x), int(y)


def _vertex(left: float, mid: float, right: float) -> float:
    """The offset of a parabola's top; none if it lies beyond its neighbours."""
    bend = left - 2 * mid + right
    off = 0.5 * (left - right) / bend if abs(bend) > 1e-9 else 0.0
    return off if -1 <= off <= 1 else 0.0


def find_displacement(a: np.ndarray, b: np.ndarray, prior: tuple[float, float] | None = None, tolerance: float | None = None) -> tuple[float, float, float]:
    """``(dx, dy, ncc)`` of two high-passed images of one size.

    Candidates are the phase peak plus or minus whole sides, those within the tolerance if there is a prior; the ones of
    the highest overlap correlation are searched again nearby. With a prior its whole box is searched too, without one
    all displacements that leave enough overlap. The highest overlap correlation wins and is refined by parabolas;
    without any, the prior or the peak comes back with 0.
    """
    h, w = a.shape
    surface, oy, ox = overlap_surface(a, b, max(THIN_PX, THIN * max(h, w)), max(AREA_PX, AREA * h * w))
    peak = phase_peak(a, b)
    found: list[tuple[float, int, int]] = []

    def search(x: float, y: float, reach: float) -> None:
        x0, x1 = max(0, int(np.floor(x - reach)) + ox), min(surface.shape[1], int(np.ceil(x + reach)) + ox + 1)
        y0, y1 = max(0, int(np.floor(y - reach)) + oy), min(surface.shape[0], int(np.ceil(y + reach)) + oy + 1)
        if x0 < x1 and y0 < y1:
            box = surface[y0:y1, x0:x1]
            i, j = np.unravel_index(int(box.argmax()), box.shape)
            found.append((float(box[i, j]), x0 + int(j), y0 + int(i)))

    around = [(peak[0] + i * w, peak[1] + j * h) for i, j in product((-1, 0, 1), repeat=2)]
    around = [(x, y) for x, y in around if abs(x) <= ox and abs(y) <= oy]
    if prior and tolerance is not None:
        around = [(x, y) for x, y in around if abs(x - prior[0]) <= tolerance and abs(y - prior[1]) <= tolerance]
    for x, y in sorted(around, key=lambda c: -surface[c[1] + oy, c[0] + ox])[:FIRST]:
        search(x, y, NEAR)
    search(*(prior or (0, 0)), max(NEAR, tolerance or 0) if prior else max(h, w))
    best = max(found, default=(-1.0, 0, 0), key=lambda f: f[0])
    if best[0] <= 0:
        return (*(prior or peak), 0.0)
    ncc, x, y = best
    line_x, line_y = surface[y, x - 1 : x + 2], surface[y - 1 : y + 2, x]
    fine_x = _vertex(*line_x) if 0 < x < surface.shape[1] - 1 and line_x.min() > -1 else 0.0
    fine_y = _vertex(*line_y) if 0 < y < surface.shape[0] - 1 and line_y.min() > -1 else 0.0
    return x - ox + fine_x, y - oy + fine_y, ncc


def slide(region: np.ndarray, strip: np.ndarray) -> np.ndarray:
    """The correlation of a strip with each place of a region that holds all of it; 0 where either is flat."""
    rows, cols = region.shape[0] - strip.shape[0] + 1, region.shape[1] - strip.shape[1] + 1
    region, strip = region - region.mean(), strip - strip.mean()
    cross = np.fft.irfft2(np.fft.rfft2(region) * np.fft.rfft2(strip, region.shape).conj(), region.shape)[:rows, :cols]
    y, x = np.arange(rows), np.arange(cols)
    total, squares = (_inside(_sums(v), y, y + strip.shape[0], x, x + strip.shape[1]) for v in (region, region * region))
    spread = (squares - total**2 / strip.size) * (strip * strip).sum()
    return np.where(spread > 1e-6, cross / np.sqrt(np.maximum(spread, 1e-6)), 0.0)


def match_strip(a: np.ndarray, b: np.ndarray, side: str) -> tuple[int, int, float]:
    """``(dx, dy, score)`` where b lies left, right, below or above of a: the strip of b along the edge that faces a is
    sought in the part of a that faces b. An image too small for that scores -1."""
    h, w = a.shape
    along = side in ("below", "above")
    long, across = (h, w) if along else (w, h)
    thick, margin, deep = max(8, round(long * STRIP)), round(across * MARGIN), round(long * SEARCH)
    if thick > deep or across <= 2 * margin or a.shape != b.shape:
        return 0, 0, -1.0
    first = side in ("right", "below")  # b's near edge is its first
    strip_at, region_at = (0, long - deep) if first else (long - thick, 0)
    cut = (slice(strip_at, strip_at + thick), slice(margin, across - margin))
    place = (slice(region_at, region_at + deep), slice(None))
    strip, region = (b[cut], a[place]) if along else (b[cut[::-1]], a[place[::-1]])
    scores = slide(region, strip)
    y, x = np.unravel_index(int(scores.argmax()), scores.shape)
    ahead, beside = (y, x) if along else (x, y)
    ahead, beside = int(ahead) + region_at - strip_at, int(beside) - margin
    return (beside, ahead, float(scores[y, x])) if along else (ahead, beside, float(scores[y, x]))


# ---- edge tables


def _with_images(edges: DataFrame, images: DataFrame, by: str) -> DataFrame:
    """Edges ``(src, dst, ...)`` with the values of both images. An image is sent once for each of its edges."""
    a = images.select(F.col(by).alias("src"), F.col("h").alias("_h"), F.col("w").alias("_w"), F.col("v").alias("_a"))
    b = images.select(F.col(by).alias("dst"), F.col("h").alias("_h2"), F.col("w").alias("_w2"), F.col("v").alias("_b"))
    return edges.join(a, "src").join(b, "dst").select(*edges.columns, "_h", "_w", "_a", "_h2", "_w2", "_b")


def _measured(pairs: DataFrame, measure, names: str) -> DataFrame:
    """The rows of ``_with_images`` with what ``measure(row, a, b)`` returns in place of the images."""
    columns = [c for c in pairs.columns if not c.startswith("_")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for t in batches:
            found = [measure(r, np.asarray(r[5], float), np.asarray(r[6], float)) for r in t[[*["_h", "_w", "_h2", "_w2"], columns[0], "_a", "_b", *columns[1:]]].itertuples(index=False, name=None)]
            out = t[columns].copy()
            for i, name in enumerate(n.split()[0] for n in names.split(",")):
                out[name] = [f[i] for f in found]
            yield out

    kind = StructType([f for f in pairs.schema.fields if not f.name.startswith("_")] + StructType.fromDDL(names).fields)
    return pairs.mapInPandas(run, kind)


def prepared(images: DataFrame) -> DataFrame:
    """Images ``(id, h, w, v)`` high-passed, once each however many edges they have."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for t in batches:
            t["v"] = [high_pass(np.asarray(v, float).reshape(h, w)).ravel() for h, w, v in zip(t["h"], t["w"], t["v"], strict=True)]
            yield t

    return images.mapInPandas(run, images.schema)


def register_edges(edges: DataFrame, images: DataFrame, by: str = "image") -> DataFrame:
    """``(src, dst, dx, dy, ncc)`` for edges ``(src, dst, ex, ey, tolerance)``: the prior and its box may be null.

    Several rows of one pair are its hypotheses, of which the highest correlation stays (ties: the smaller prior). Edges
    whose images are missing are left out; images of two sizes give their prior with 0.
    """
    pairs = _with_images(edges.select("src", "dst", *(F.col(c).cast("double").alias(c) for c in ("ex", "ey", "tolerance"))), prepared(images), by)

    def measure(r: tuple, a: np.ndarray, b: np.ndarray) -> tuple[float, float, float]:
        prior = None if np.isnan(r[8]) or np.isnan(r[9]) else (r[8], r[9])
        if r[:2] != r[2:4]:
            return (*(prior or (0.0, 0.0)), 0.0)
        return find_displacement(a.reshape(r[:2]), b.reshape(r[:2]), prior, None if np.isnan(r[10]) else r[10])

    found = _measured(pairs, measure, "dx double, dy double, ncc double")
    best = F.max_by(F.struct("dx", "dy", "ncc"), F.struct("ncc", -F.coalesce("ex", F.lit(0.0)), -F.coalesce("ey", F.lit(0.0))))
    return found.groupBy("src", "dst").agg(best.alias("_best")).select("src", "dst", "_best.*")


def next_in_grid(grid: DataFrame, by: str = "image") -> DataFrame:
    """``(kind, src, dst)`` from ``(by, row, col)``: "h" pairs of one row and the next column that the grid has, "v" pairs
    of one column and the next row. The columns, and the rows, of a grid are numbered in one task."""
    out = None
    for kind, step, other in (("h", "col", "row"), ("v", "row", "col")):
        order = grid.select(step).distinct().withColumn("_next", F.lead(step).over(Window.orderBy(step)))
        a = grid.join(small(order), step).select(F.col(by).alias("src"), F.col("_next").alias("_at"), F.col(other).alias("_along"))
        b = grid.select(F.col(by).alias("dst"), F.col(step).alias("_at"), F.col(other).alias("_along"))
        pairs = a.join(b, ["_at", "_along"]).select(F.lit(kind).alias("kind"), "src", "dst")
        out = pairs if out is None else out.unionByName(pairs)
    return out


def match_strips(edges: DataFrame, images: DataFrame, by: str = "image") -> DataFrame:
    """Edges ``(side, src, dst, ...)`` with the ``dx``, ``dy`` and ``score`` of ``match_strip``."""
    pairs = _with_images(edges.select("side", "src", "dst", *(c for c in edges.columns if c not in ("side", "src", "dst"))), images, by)

    def measure(r: tuple, a: np.ndarray, b: np.ndarray) -> tuple[int, int, float]:
        return match_strip(a.reshape(r[:2]), b.reshape(r[2:4]), r[4])

    return _measured(pairs, measure, "dx int, dy int, score double")


def sampled(pairs: DataFrame, samples: int) -> DataFrame:
    """The first pairs of each kind by the digests of their first images."""
    nth = F.row_number().over(Window.partitionBy("kind").orderBy(F.md5(F.col("src").cast("string").cast("binary")), "src"))
    return pairs.withColumn("_n", nth).where(F.col("_n") <= samples).select("kind", "src", "dst")


def grid_direction(pairs: DataFrame, images: DataFrame, samples: int = 6, by: str = "image") -> DataFrame:
    """``(kind, side, pdx, pdy, score)``, a row for each kind of pair: on which side the next column lies (both are tried,
    the higher median score of the sampled pairs decides, left at a tie), and medians of the displacements; the next
    row lies below."""
    sides = F.explode(F.when(F.col("kind") == "h", F.array(F.lit("left"), F.lit("right"))).otherwise(F.array(F.lit("below"))))
    tried = match_strips(sampled(pairs, samples).select(sides.alias("side"), "kind", "src", "dst"), images, by)
    judged = tried.groupBy("kind", "side").agg(F.median("score").alias("score"), F.median("dx").alias("pdx"), F.median("dy").alias("pdy"))
    best = F.max_by(F.struct("side", "pdx", "pdy", "score"), F.struct("score", F.col("side") == "left"))
    return judged.groupBy("kind").agg(best.alias("b")).select("kind", "b.*")


def pieces(px: DataFrame, by: str) -> DataFrame:
    """Pixels ``(by, x, y, r, g, b)`` as rows ``(by, n, data)``, each what a batch has of one image, compressed: pieces are
    dealt out afterwards, not pixels. The fewer they are, the better the pixels come image by image."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in batches:
            keys = t.column(0).dictionary_encode()
            codes, columns = keys.indices.to_numpy(), [c.to_numpy(zero_copy_only=False) for c in t.columns[1:]]
            order = np.argsort(codes, kind="stable")
            own = np.split(order, np.flatnonzero(np.diff(codes[order])) + 1) if len(order) else []
            data = [pa.compress(b"".join(c[i].tobytes() for c in columns), "zstd", asbytes=True) for i in own]
            yield pa.RecordBatch.from_arrays([keys.dictionary, pa.array([len(i) for i in own], pa.int32()), pa.array(data, pa.binary())], [by, "n", "data"])

    rows = px.where(F.col(by).isNotNull()).select(by, *(F.col(c).cast("int") for c in "xy"), *(F.col(c).cast("double") for c in "rgb"))
    return rows.mapInArrow(run, StructType([rows.schema[by], *StructType.fromDDL("n int, data binary").fields]))


def _whole(image: object, sizes: list[int], data: list[bytes]) -> np.ndarray:
    """The channels of an image from its pieces."""
    parts = [pa.decompress(d, n * 32, "zstd", asbytes=True) for n, d in zip(sizes, data, strict=True)]
    at = np.concatenate([np.frombuffer(p, np.int32, 2 * n).reshape(2, n) for n, p in zip(sizes, parts, strict=True)], axis=1)
    values = np.concatenate([np.frombuffer(p, np.float64, 3 * n, 8 * n).reshape(3, n) for n, p in zip(sizes, parts, strict=True)], axis=1)
    out = np.full((3, *(at.max(axis=1)[::-1] + 1)), np.nan)
    if values.shape[1] != out[0].size:
        raise ValueError(f"image {image}: {values.shape[1]} pixels, not {out[0].size}")
    out[:, at[1], at[0]] = values
    return out


def _light(v: np.ndarray) -> np.ndarray:
    return 0.299 * v[0] + 0.587 * v[1] + 0.114 * v[2]


RATIOS = ["ratio_r", "ratio_g", "ratio_b", "bright_r", "bright_g", "bright_b", "flat_fraction"]


def pair_ratios(a: np.ndarray, b: np.ndarray, dx: int, dy: int, low: float = 20, high: float = 245, least: int = 500, least_side: int = 24) -> dict:
    """What ``overlap_ratios`` says of an edge, from the channels of its two images."""
    h, w = a.shape[1:]
    x0, x1, y0, y1 = max(0, dx), min(w, w + dx), max(0, dy), min(h, h + dy)
    out = {"pixels": 0, "overlap_w": x1 - x0, "overlap_h": y1 - y0}
    if x1 - x0 < least_side or y1 - y0 < least_side:
        return out
    v = np.concatenate([a[:, y0:y1, x0:x1], b[:, y0 - dy : y1 - dy, x0 - dx : x1 - dx]])
    v = sum(v[:, :, 1 + k : v.shape[2] - 5 + k] for k in range(5)) / 5
    v = sum(v[:, 1 + k : v.shape[1] - 5 + k] for k in range(5)) / 5
    v = v[:, (v.min(axis=0) > low) & (v.max(axis=0) < high)]
    out["pixels"] = v.shape[1]
    if v.shape[1] < least:
        return out
    light = _light(v)
    middle = np.median(light)
    for name, kept in (("ratio", v), ("bright", v[:, light >= middle - 1e-9])):
        m = np.median(kept, axis=1)
        out |= {f"{name}_{c}": float(m[i] / m[i + 3]) if m[i + 3] else None for i, c in enumerate("rgb")}
    return out | {"flat_fraction": float((np.abs(light - middle) <= 0.1 * middle).mean())}


def measured_edges(grid: DataFrame, px: DataFrame, least_ncc: float = 0.6, least_direction: float = 0.5, by: str = "image") -> DataFrame:
    """``(kind, src, dst, dx, dy, ncc, side, rejected, ...)`` for all neighbours of a grid ``(by, row, col)`` of images
    whose pixels are ``(by, x, y, r, g, b)``, with the columns of ``overlap_ratios``.

    The side of the next column comes first. Pairs whose strips correlate too little are rejected for "registration";
    those too far from their kind's displacement (a tenth of the width, 0.15 of the height), and those whose overlap
    says nothing, for "overlap". If the next column's sampled pairs don't correlate, that is an error.

    Edges are measured by blocks of the grid, and an image goes once to each block that has an edge of it. A block holds
    some half a million pixels, or the edges of one image if images are larger.
    """
    spark, keep = grid.sparkSession, Scratch(grid.sparkSession)
    pairs = keep.keep(next_in_grid(grid, by), "pairs")
    sample = keep.keep(sampled(pairs, 6), "sample")
    # a dozen pairs
    named = sorted({i for r in sample.collect() for i in (r.src, r.dst)})
    images = keep.keep(images_of(px.where(F.col(by).isin(named)).withColumn("_grey", luminance(F.col("r"), F.col("g"), F.col("b"))), by, "_grey"), "images")
    way, _ = stored(grid_direction(sample, images, by=by), "direction")
    size = images.agg(F.max(F.col("h") * F.col("w"))).head()[0] or 1
    poor = way.where((F.col("kind") == "h") & (F.col("score") < least_direction)).head()
    if poor:
        keep.clear()
        raise ValueError(f"adjacent columns do not register (best correlation {poor.score:.2f}); do tiles overlap?")
    side = max(1, min(SIDE, int((HELD / size) ** 0.5)))
    block = F.concat_ws(",", *(F.floor(F.col(c) / side).cast("string") for c in ("row", "col")))
    edges = pairs.join(grid.select(F.col(by).alias("src"), block.alias("block")).dropDuplicates(["src"]), "src").join(F.broadcast(way.drop("score")), "kind")  # two rows
    edges, _ = stored(edges.select("block", "kind", "src", "dst", "side", "pdx", "pdy"), "edges")
    asked, _ = stored(edges.select("block", F.explode(F.array("src", "dst")).alias(by)).distinct(), "asked")
    n = asked.count()
    tasks = max(1, min(n, max(shuffle_partitions(spark), -(-n * size // (BLOCKS * HELD)))))
    dealt = pieces(px, by).join(small(asked, ASKED), by).select("block", F.col(by).alias("image"), "n", "data")
    ident = px.select(by).schema[0].dataType.simpleString()
    kind = StructType.fromDDL(f"kind string, src {ident}, dst {ident}, dx int, dy int, ncc double, side string, pixels long, overlap_w int, overlap_h int, {' double, '.join(RATIOS)} double, rejected string")

    def run(own: pa.Table, parts: pa.Table) -> pa.Table:
        found: dict = {}
        for image, n, data in zip(*(parts.column(c).to_pylist() for c in ("image", "n", "data")), strict=True):
            found.setdefault(image, ([], []))[0].append(n)
            found[image][1].append(data)
        whole = {image: _whole(image, *found.pop(image)) for image in list(found)}
        grey, out = {image: _light(v) for image, v in whole.items()}, []
        for r in own.to_pylist():
            a, b = whole.get(r["src"]), whole.get(r["dst"])
            if a is None or b is None:
                continue
            dx, dy, ncc = match_strip(grey[r["src"]], grey[r["dst"]], r["side"])
            far = abs(dx - r["pdx"]) > 0.1 * a.shape[2] or abs(dy - r["pdy"]) > 0.15 * a.shape[1]
            why = "registration" if ncc < least_ncc else "overlap" if far else None
            said = {} if why else pair_ratios(a, b, dx, dy)
            why = why or (None if said.get("ratio_r") is not None else "overlap")
            out.append({"kind": r["kind"], "src": r["src"], "dst": r["dst"], "dx": dx, "dy": dy, "ncc": ncc, "side": r["side"], **said, "rejected": why})
        types = {"src": own.schema.field("src").type, "dst": own.schema.field("dst").type, "dx": pa.int32(), "dy": pa.int32(), "pixels": pa.int64(), "overlap_w": pa.int32(), "overlap_h": pa.int32()}
        texts = ("kind", "side", "rejected")
        return pa.table({c: pa.array([r.get(c) for r in out], types.get(c, pa.string() if c in texts else pa.float64())) for c in kind.names})

    left, right = edges.repartition(tasks, "block"), dealt.repartition(tasks, "block")
    out, _ = stored(left.groupBy("block").cogroup(right.groupBy("block")).applyInArrow(run, kind), "measured", gather=False)
    keep.clear()
    return out


# ---- the pixels of many overlaps


def rectangles(edges: DataFrame, px: DataFrame, by: str) -> DataFrame:
    """Edges ``(edge, src, dst, dx, dy)`` with the overlap ``x0 <= x < x1, y0 <= y < y1`` in the first image's pixels."""
    size, _ = stored(px.groupBy(F.col(by).alias("src")).agg((F.max("x") + 1).alias("_w"), (F.max("y") + 1).alias("_h")), "sizes")
    whole = edges.select("edge", "src", "dst", F.col("dx").cast("int").alias("dx"), F.col("dy").cast("int").alias("dy")).join(small(size), "src")
    ends = {"x0": F.greatest(F.lit(0), "dx"), "x1": F.least(F.col("_w"), F.col("_w") + F.col("dx")), "y0": F.greatest(F.lit(0), "dy"), "y1": F.least(F.col("_h"), F.col("_h") + F.col("dy"))}
    return whole.withColumns(ends).drop("_w", "_h")


def overlap_pixels(rects: DataFrame, px: DataFrame, columns: list[str], by: str) -> DataFrame:
    """``(edge, x, y, *columns, *columns with a 2)``: both images' values in all overlaps, in one plan for any number of
    edges. Pixels are met by blocks: an edge asks for the blocks that its rectangle touches, no others."""

    def side(image: str, dx: str, dy: str, names: list[str]) -> DataFrame:
        asked = rects.where("x0 < x1 and y0 < y1").select("edge", F.col(image).alias("_i"), *(F.expr(e).alias(n) for n, e in (("_sx", dx), ("_sy", dy))), "x0", "x1", "y0", "y1")
        asked = asked.select("*", F.explode(F.expr(f"sequence((x0 - _sx) div {BLOCK}, (x1 - _sx - 1) div {BLOCK})")).alias("_bx"))
        asked = asked.select("*", F.explode(F.expr(f"sequence((y0 - _sy) div {BLOCK}, (y1 - _sy - 1) div {BLOCK})")).alias("_by"))
        own = px.select(F.col(by).alias("_j"), F.col("x").alias("_x"), F.col("y").alias("_y"), *(F.col(c).cast("double").alias(n) for c, n in zip(columns, names, strict=True)))
        at = (F.col("_i") == F.col("_j")) & (F.col("_bx") == F.expr(f"_x div {BLOCK}")) & (F.col("_by") == F.expr(f"_y div {BLOCK}"))
        met = own.join(small(asked, FEW), at).select("edge", (F.col("_x") + F.col("_sx")).alias("x"), (F.col("_y") + F.col("_sy")).alias("y"), "x0", "x1", "y0", "y1", *names)
        return met.where("x >= x0 and x < x1 and y >= y0 and y < y1")

    second = side("dst", "dx", "dy", [f"{c}2" for c in columns]).drop("x0", "x1", "y0", "y1")
    return side("src", "0", "0", columns).join(second, ["edge", "x", "y"])


def overlap_ratios(edges: DataFrame, px: DataFrame, low: float = 20, high: float = 245, least: int = 500, least_side: int = 24, by: str = "image") -> DataFrame:
    """Edges ``(edge, src, dst, dx, dy)`` with the ratios of the channels' medians, first image by second, over the pixels
    that are well exposed in both (``ratio_*``) and over their brighter half (``bright_*``), the number of those pixels,
    the share of them on one level of brightness and the overlap's sides.

    Values are means of five by five pixels, and three pixels along the overlap's rim don't count. An overlap with a side
    under ``least_side`` or fewer than ``least`` pixels has null ratios. Medians are exact; an overlap's values, those of
    a part of one image, are what a task holds.
    """
    rects, _ = stored(rectangles(edges, px, by), "overlaps")
    wide = rects.where(f"x1 - x0 >= {least_side} and y1 - y0 >= {least_side}")
    channels = ["r", "g", "b", "r2", "g2", "b2"]
    met = overlap_pixels(wide, px, ["r", "g", "b"], by)
    for line, along in (("y", "x"), ("x", "y")):
        near = Window.partitionBy("edge", line).orderBy(along).rangeBetween(-2, 2)
        met = met.withColumns({c: F.avg(c).over(near) for c in channels})
    met = met.where("x >= x0 + 3 and x < x1 - 3 and y >= y0 + 3 and y < y1 - 3").where(F.least(*channels) > low).where(F.greatest(*channels) < high)
    met, _ = stored(met.select("edge", *channels, luminance(F.col("r"), F.col("g"), F.col("b")).alias("_l")), "overlap")
    middle, _ = stored(met.groupBy("edge").agg(F.percentile("_l", 0.5).alias("_m")), "middles")
    met = met.join(small(middle, FEW), "edge")
    # sums of the same pixels in another order differ in their last digits
    bright = lambda c: F.percentile(F.when(F.col("_l") >= F.col("_m") - 1e-9, F.col(c)), 0.5).alias(f"{c}_bright")
    flat = F.avg((F.abs(F.col("_l") - F.col("_m")) <= 0.1 * F.col("_m")).cast("double"))
    stats = met.groupBy("edge").agg(F.count("*").alias("pixels"), flat.alias("flat_fraction"), *(F.percentile(c, 0.5).alias(c) for c in channels), *map(bright, channels))
    enough = lambda c, name: F.when(F.col("pixels") >= least, c).alias(name)
    return rects.join(stats, "edge", "left").select(
        "edge", "src", "dst", "dx", "dy", F.coalesce("pixels", F.lit(0)).alias("pixels"), (F.col("x1") - F.col("x0")).alias("overlap_w"), (F.col("y1") - F.col("y0")).alias("overlap_h"),
        *(enough(F.try_divide(F.col(c), F.col(f"{c}2")), f"ratio_{c}") for c in "rgb"), *(enough(F.try_divide(F.col(f"{c}_bright"), F.col(f"{c}2_bright")), f"bright_{c}") for c in "rgb"),
        enough(F.col("flat_fraction"), "flat_fraction")
    )


def overlap_correlations(edges: DataFrame, px: DataFrame, least_side: int = 1, least: int = 16, value: str = "grey", by: str = "image") -> DataFrame:
    """``(edge, pixels, ncc)``: the correlation of each overlap, -1 where it is thin, small or flat."""
    rects, _ = stored(rectangles(edges, px, by), "overlaps")
    wide = rects.where(f"x1 - x0 >= {least_side} and y1 - y0 >= {least_side}")
    found = overlap_pixels(wide, px, [value], by).groupBy("edge").agg(F.count("*").alias("pixels"), F.corr(value, f"{value}2").alias("r"))
    poor = (F.col("pixels") < least) | F.col("r").isNull() | F.isnan("r")
    out = rects.select("edge").join(found, "edge", "left")
    return out.select("edge", F.coalesce("pixels", F.lit(0)).alias("pixels"), F.when(F.coalesce(poor, F.lit(True)), -1.0).otherwise(F.col("r")).alias("ncc"))
