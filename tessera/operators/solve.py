"""Least squares on graphs of tiles: positions and gains. Edges are summed in Spark, and each connected scan is solved by
itself in a Python worker, which holds a row per edge of that scan, never one per pixel; the driver holds none."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.operators.graph import range_components
from tessera.session import Scratch, stored

#: A level of the hierarchy with so few nodes is solved densely.
DENSE = 200


class Laplacian:
    """The products of a weighted graph's Laplacian, and a multigrid cycle as its preconditioner.

    Nodes are put together along locally heaviest edges, twice a level; a coarse graph has the summed weights between
    the groups. A cycle smooths, corrects twice from the coarse graph, and smooths again.
    """

    def __init__(self, src: np.ndarray, dst: np.ndarray, w: np.ndarray, n: int):
        self.src, self.dst, self.w, self.n = src, dst, w, n
        self.degree = np.bincount(src, w, n) + np.bincount(dst, w, n)
        self.scale = 0.6 / np.maximum(self.degree, 1e-300)
        self.coarse = self.group = self.dense = None
        if n <= DENSE:
            full = np.diag(self.degree)
            np.subtract.at(full, (src, dst), w)
            np.subtract.at(full, (dst, src), w)
            self.dense = np.linalg.pinv(full, hermitian=True)
            return
        group, fewer = halved(src, dst, w, n)
        again, fewest = halved(*merged(group[src], group[dst], w, fewer), fewer)
        if fewest < n:
            self.group = again[group]
            self.coarse = Laplacian(*merged(self.group[src], self.group[dst], w, fewest), fewest)

    def spread(self, edge: np.ndarray) -> np.ndarray:
        return np.bincount(self.dst, edge, self.n) - np.bincount(self.src, edge, self.n)

    def step(self, v: np.ndarray) -> np.ndarray:
        return v[self.dst] - v[self.src]

    def times(self, v: np.ndarray) -> np.ndarray:
        return self.spread(self.w * self.step(v))

    def cycle(self, r: np.ndarray) -> np.ndarray:
        if self.dense is not None:
            return self.dense @ r
        x = self.scale * r
        x += self.scale * (r - self.times(x))
        if self.coarse is not None:
            below = np.bincount(self.group, r - self.times(x), self.coarse.n)
            y = self.coarse.cycle(below)
            if self.coarse.dense is None:
                y += self.coarse.cycle(below - self.coarse.times(y))
            x += y[self.group]
        for _ in range(2):
            x += self.scale * (r - self.times(x))
        return x


def halved(src: np.ndarray, dst: np.ndarray, w: np.ndarray, n: int) -> tuple[np.ndarray, int]:
    """A group for each node: pairs along edges that are the heaviest at both ends, and what is left joined to the pair
    of its heaviest neighbour."""
    mate, rng = np.full(n, -1, np.int64), np.random.default_rng(n)
    order = w * (1 + 0.1 * rng.random(len(w)))
    s, d, o = src, dst, order
    for _ in range(4):
        best = np.zeros(n)
        np.maximum.at(best, s, o)
        np.maximum.at(best, d, o)
        top = (o == best[s]) & (o == best[d])
        a, b = s[top], d[top]
        mate[np.maximum(a, b)], mate[np.minimum(a, b)] = np.minimum(a, b), np.minimum(a, b)
        free = (mate[s] < 0) & (mate[d] < 0)
        s, d, o = s[free], d[free], o[free]
        if not len(s):
            break
    lone = mate < 0
    from_src, from_dst = lone[src] & ~lone[dst], lone[dst] & ~lone[src]
    one, other = np.concatenate([src[from_src], dst[from_dst]]), np.concatenate([dst[from_src], src[from_dst]])
    at = np.argsort(np.concatenate([order[from_src], order[from_dst]]), kind="stable")
    heads = mate.copy()
    heads[one[at]] = mate[other[at]]
    heads = np.where(heads < 0, np.arange(n), heads)
    kept, group = np.unique(heads, return_inverse=True)
    return group, len(kept)


def merged(src: np.ndarray, dst: np.ndarray, w: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Edges between different nodes, those between the same two summed."""
    apart = src != dst
    keys = np.minimum(src, dst)[apart]
    keys *= n
    keys += np.maximum(src, dst)[apart]
    del src, dst
    keys, at = np.unique(keys, return_inverse=True)
    return keys // n, keys % n, np.bincount(at, w[apart], len(keys))


def conjugate(graph: Laplacian, right: np.ndarray, tolerance: float, rounds: int = 2_000) -> np.ndarray:
    """Solve ``L x = right`` by preconditioned conjugate gradients to a residual of the given length; an error if that
    isn't reached."""
    x, r = np.zeros_like(right), right.copy()
    z = graph.cycle(r)
    p, rz = z.copy(), float(r @ z)
    for _ in range(rounds):
        if float(r @ r) <= tolerance * tolerance:
            return x
        ap = graph.times(p)
        alpha = rz / max(float(p @ ap), 1e-300)
        x += alpha * p
        r -= alpha * ap
        z = graph.cycle(r)
        before, rz = rz, float(r @ z)
        p = z + rz / max(before, 1e-300) * p
    raise ArithmeticError(f"no solution in {rounds} rounds")


def steps(graph: Laplacian, want: np.ndarray, start: np.ndarray | None = None, tolerance: float = 1e-11) -> np.ndarray:
    """Values of nodes whose steps along the edges are, by weighted least squares, those wanted. What is left is found
    from the edges and solved again, so that long ways lose no digits."""
    x = np.zeros(graph.n) if start is None else start.copy()
    stop = tolerance * max(float(np.linalg.norm(graph.spread(graph.w * want))), 1e-300)
    for _ in range(4):
        right = graph.spread(graph.w * (want - graph.step(x)))
        left = float(np.linalg.norm(right))
        if left <= stop:
            break
        x += conjugate(graph, right, max(stop, 1e-9 * left))
    return x


def _numbered(*ends: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
    ids, at = np.unique(np.concatenate(ends), return_inverse=True)
    return ids, np.split(at.astype(np.int64), len(ends))


def _by_component(edges: DataFrame, src: str, dst: str, solve: Callable[[pd.DataFrame], pd.DataFrame], schema: str) -> DataFrame:
    """``solve`` on the edges of each component of the nodes in the two columns; the result is stored."""
    keep = Scratch(edges.sparkSession)
    edges = keep.keep(edges, "edges")
    parts = range_components(edges.select(src, dst), src, dst)
    placed = edges.join(parts.withColumnRenamed("node", src).hint("merge"), src)
    out, _ = stored(placed.groupBy("component").applyInPandas(solve, schema), "solved")
    keep.clear()
    return out


def _positions(edges: pd.DataFrame) -> pd.DataFrame:
    edges = edges.sort_values(["src", "dst"])
    ids, (src, dst) = _numbered(edges["src"].to_numpy(), edges["dst"].to_numpy())
    graph = Laplacian(src, dst, edges["w"].to_numpy(float), len(ids))
    x, y = (steps(graph, edges[c].to_numpy(float)) for c in ("dx", "dy"))
    anchor = int(np.argmax(graph.degree))
    return pd.DataFrame({"id": ids, "component": ids[0], "x": x - x[anchor], "y": y - y[anchor]})


def solve_positions(edges: DataFrame) -> DataFrame:
    """Positions from edges ``(src, dst, dx, dy, w)`` by weighted least squares, x and y on their own.

    In each component the tile of the largest summed weight (the smallest id of equals) is the anchor at 0. Returns
    ``(id, component, x, y)``.
    """
    mean = lambda c: (F.sum(F.col("w") * F.col(c)) / F.sum("w")).alias(c)
    summed = edges.groupBy("src", "dst").agg(F.sum("w").alias("w"), mean("dx"), mean("dy"))
    return _by_component(summed, "src", "dst", _positions, "id long, component long, x double, y double")


def residuals(edges: DataFrame, positions: DataFrame) -> DataFrame:
    """Edges with how far their measured step is from the solved one."""
    p = positions.select(F.col("id"), "x", "y")
    a, b = p.toDF("src", "ax", "ay"), p.toDF("dst", "bx", "by")
    out = edges.join(a.hint("merge"), "src").join(b.hint("merge"), "dst")
    return out.withColumn(
        "residual", F.hypot(F.col("bx") - F.col("ax") - F.col("dx"), F.col("by") - F.col("ay") - F.col("dy"))
    ).drop("ax", "ay", "bx", "by")


def _gains(huber: float, penalty: float, rounds: int) -> Callable[[pd.DataFrame], pd.DataFrame]:
    """A tile's gain and its column's level are nodes of one graph: deviations are steps between them that should be 0.
    A round whose weights are those of the round before would solve the same equations again, so it is left out; a
    graph is dropped before the next is made."""

    def solve(edges: pd.DataFrame) -> pd.DataFrame:
        edges = edges.sort_values(["src", "dst", "src_col", "dst_col"])
        ids, (src, dst) = _numbered(edges["src"].to_numpy(), edges["dst"].to_numpy())
        cols, (src_col, dst_col) = _numbered(edges["src_col"].to_numpy(), edges["dst_col"].to_numpy())
        n, size, own = len(ids), len(ids) + len(cols), np.zeros(len(ids), np.int64)
        own[src] = src_col
        own[dst] = dst_col
        starts, ends = np.concatenate([n + own, src]), np.concatenate([np.arange(n), dst])
        count, weight = edges["n"].to_numpy(float), np.ones(len(src))
        want, g = np.concatenate([np.zeros(n), edges["r"].to_numpy(float)]), None
        src, dst, y = starts[n:], ends[n:], want[n:]
        del edges, src_col, dst_col
        for _ in range(rounds):
            graph = Laplacian(starts, ends, np.concatenate([np.full(n, penalty), weight * count]), size)
            g = steps(graph, want, g)
            del graph
            error = np.abs(g[dst] - g[src] - y)
            before, weight = weight, np.where(error <= huber, 1.0, huber / np.maximum(error, 1e-12))
            if np.array_equal(before, weight):
                break
        return pd.DataFrame({"id": ids, "g": g[:n] - g[n:].mean()})

    return solve


def solve_gains(edges: DataFrame, huber: float = 0.03, penalty: float = 0.5, rounds: int = 4, least: float = 0.5, most: float = 2.0) -> DataFrame:
    """Gains per tile from brightness ratios ``(src, dst, src_col, dst_col, ratio)``: in logarithms, a level per column
    and a penalised deviation per tile, reweighted by Huber's rule; the mean over all tiles is 0.

    Returns ``(id, gain)``; an error if more than a twentieth lies outside the plausible range, and gains are clipped to it.
    """
    known = edges.where("ratio > 0").groupBy("src", "dst", "src_col", "dst_col").agg(F.avg(F.log("ratio")).alias("r"), F.count("*").alias("n"))
    found = _by_component(known, "src_col", "dst_col", _gains(huber, penalty, rounds), "id long, g double")
    mean = found.agg(F.avg("g")).head()[0] or 0.0
    gains = found.select("id", F.exp(mean - F.col("g")).alias("gain"))
    odd, n = gains.agg(F.count_if((F.col("gain") < least) | (F.col("gain") > most)), F.count("*")).head()
    if odd > 0.05 * n:
        raise ValueError("more than a twentieth of the gains is implausible")
    return gains.select("id", F.greatest(F.lit(float(least)), F.least(F.lit(float(most)), "gain")).alias("gain"))
