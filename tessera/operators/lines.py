"""Separable work on images of any number: a line of pixels is a row, along x first and along y after one shuffle."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Values that are worked on at once: some 32 MB.
AT_ONCE = 1 << 22
#: What stands for a distance that isn't there; its square and those of all images' sides add up within 64 bits.
FAR = 1 << 30


def kernel(sigma: float) -> np.ndarray:
    """A Gaussian's weights up to four sigma on both sides (a pixel at least), with a sum of 1."""
    reach = max(1, round(4 * sigma))
    weights = np.exp(-(np.arange(-reach, reach + 1) ** 2) / (2 * sigma * sigma))
    return weights / weights.sum()


def along(px: DataFrame, by: str, line: str, axis: str, value: str, work: Callable[[np.ndarray, np.ndarray], np.ndarray], kind: str) -> DataFrame:
    """``(by, line, axis, value)`` after ``work(places, values)`` on every line of every image. Lines of equal places are
    worked on together, (lines, pixels) at a time; a line is as long as its image, and nothing larger is held."""
    lists = F.array_sort(F.collect_list(F.struct(axis, value)))
    rows = px.select(by, line, F.col(axis).cast("int").alias(axis), value).groupBy(by, line).agg(lists.alias("_l"))
    rows = rows.select(by, line, F.col(f"_l.{axis}").alias("_p"), F.col(f"_l.{value}").alias("_v"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sizes = b.column(2).value_lengths().to_numpy()
            ends = np.concatenate(([0], np.cumsum(sizes)))
            places, values = (b.column(i).flatten().to_numpy(zero_copy_only=False) for i in (2, 3))
            out = np.empty(len(values), float if kind == "double" else np.int64)
            groups: dict[bytes, list[int]] = {}
            for i in range(b.num_rows):
                groups.setdefault(places[ends[i] : ends[i + 1]].tobytes(), []).append(i)
            for own in groups.values():
                n = int(sizes[own[0]])
                step = max(1, AT_ONCE // max(1, n))
                for s in range(0, len(own), step):
                    at = ends[own[s : s + step]][:, None] + np.arange(n)
                    out[at] = work(places[at[0]], values[at])
            made = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(out))
            yield pa.RecordBatch.from_arrays([*b.columns[:3], made], [by, line, "_p", "_v"])

    names = {f.name: f.dataType.simpleString() for f in rows.schema.fields}
    done = rows.mapInArrow(run, f"`{by}` {names[by]}, `{line}` {names[line]}, _p array<int>, _v array<{kind}>")
    both = done.select(by, line, F.explode(F.arrays_zip("_p", "_v")).alias("_e"))
    return both.select(by, line, F.col("_e._p").alias(axis), F.col("_e._v").alias(value))


def gaussian(px: DataFrame, by: str, value: str, sigma: float) -> DataFrame:
    """``(by, x, y, value)``: a Gaussian blur of dense images; beyond the border the outermost pixel goes on. A line is
    convolved by one transform, so the work hardly grows with sigma."""
    weights = kernel(sigma)
    reach = len(weights) // 2

    def smooth(_: np.ndarray, v: np.ndarray) -> np.ndarray:
        wide = np.pad(v.astype(float), ((0, 0), (reach, reach)), mode="edge")
        size = wide.shape[1] + len(weights) - 1
        both = np.fft.rfft(wide, size, axis=1) * np.fft.rfft(weights, size)
        return np.fft.irfft(both, size, axis=1)[:, 2 * reach : 2 * reach + v.shape[1]]

    own = px.select(by, "x", "y", F.col(value).cast("double").alias(value))
    across = along(own, by, "y", "x", value, smooth, "double")
    return along(across, by, "x", "y", value, smooth, "double").select(by, "x", "y", value)


def envelope(places: np.ndarray, heights: np.ndarray) -> np.ndarray:
    """For each place of each line the least ``(place - q)^2 + height(q)`` over the line's places q with a height under
    FAR squared: the lower envelope of parabolas, built for all lines at once with a stack for each.

    All in integers: the next parabola takes over at the first place where it is no higher, so results are exact.
    """
    n, size = heights.shape
    rows = np.arange(n)
    stack, start, top = np.zeros((n, size), np.int64), np.zeros((n, size), np.int64), np.full(n, -1)
    x = places.astype(np.int64)
    for q in range(size):
        live = rows[heights[:, q] < FAR * FAR]
        begin = np.full(n, x[0])
        while len(live):
            open_ = live[top[live] >= 0]
            p = stack[open_, top[open_]]
            # the first place at which q's parabola is no higher than p's
            begin[open_] = -((heights[open_, p] + x[p] ** 2 - heights[open_, q] - x[q] ** 2) // (2 * (x[q] - x[p])))
            beaten = begin[open_] <= start[open_, top[open_]]
            lost = open_[beaten]
            top[lost] -= 1
            begin[lost[top[lost] < 0]] = x[0]
            again = lost[top[lost] >= 0]
            keep = np.setdiff1d(live, again, assume_unique=True)
            top[keep] += 1
            stack[keep, top[keep]] = q
            start[keep, top[keep]] = begin[keep]
            live = again
    out, at = np.full((n, size), FAR * FAR, np.int64), np.zeros(n, np.int64)
    some = rows[top >= 0]
    for i in range(size):
        while True:
            more = some[(at[some] < top[some])]
            more = more[start[more, at[more] + 1] <= x[i]]
            if not len(more):
                break
            at[more] += 1
        q = stack[some, at[some]]
        out[some, i] = (x[i] - x[q]) ** 2 + heights[some, q]
    return out


def squared_distance(px: DataFrame, by: str, is_source: str, name: str = "d2") -> DataFrame:
    """Every pixel with the exact squared distance to its image's nearest pixel for which ``is_source`` holds (0 for
    these; null in images without any). Along x the nearest one is looked up by windows, along y lines are swept once:
    the work doesn't depend on how far anything is."""
    source = F.when(F.expr(is_source), F.col("x"))
    row = Window.partitionBy(by, "y").orderBy("x")
    before = F.last(source, ignorenulls=True).over(row.rowsBetween(Window.unboundedPreceding, 0))
    after = F.first(source, ignorenulls=True).over(row.rowsBetween(0, Window.unboundedFollowing))
    near = F.least(F.col("x") - before, after - F.col("x")).cast("long")
    flat = px.select(by, "x", "y", F.coalesce(near * near, F.lit(FAR * FAR)).alias("_h"))
    found = along(flat, by, "x", "y", "_h", envelope, "bigint")
    found = found.select(by, "x", "y", F.when(F.col("_h") < FAR * FAR, F.col("_h")).alias(name))
    # never broadcast: a line's list becomes a row a pixel, which estimates don't see
    return px.hint("merge").join(found, [by, "x", "y"])
