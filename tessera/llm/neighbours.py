"""Nearest neighbours: a permutation index of ordered pivots with inverted files, made exact by bounds."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.session import settle

#: Vectors and queries that meet in one task. A block gives k rows per query, so large blocks keep what is merged last
#: small against what is searched; a task holds some 15 MB of vectors and orders and 16 MB of distances.
BLOCK, QUERIES = 8192, 512
#: Queries of a set that are bounded and multiplied at once.
STEP = 64


def usable(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """``(vec_id, v)`` of the vectors that take part: an id, not null or empty, all components finite, not all zero."""
    v = F.col("v")
    fine = ~F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))) & F.exists(v, lambda x: x != 0)
    return vectors.select(
        F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("v")
    ).where(F.col("vec_id").isNotNull() & v.isNotNull() & fine)


def directions(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Unit vectors and lengths; scaled first, so that squares neither vanish nor overflow."""
    top = np.abs(x).max(axis=1, keepdims=True)
    x = x / top
    size = np.linalg.norm(x, axis=1, keepdims=True)
    with np.errstate(over="ignore"):
        return x / size, (size * top)[:, 0]


def choose_pivots(vectors: DataFrame, n: int = 256, sample: int = 2048) -> np.ndarray:
    """Pivots at unit length, from the ``sample`` vectors of the commonest length whose ids hash lowest: both numbers are
    fixed, so what comes to the driver and is sent along with the tasks is bounded."""
    common = vectors.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).head()
    if common is None:
        return np.zeros((0, 0))
    rows = vectors.where(F.size("v") == common.d).orderBy(F.xxhash64(F.lit(11), "vec_id"), "vec_id", F.xxhash64("v")).limit(sample).collect()
    return spread_out(np.array([r.v for r in rows]), n)


def spread_out(x: np.ndarray, n: int, near: float = 0.9) -> np.ndarray:
    """The first n directions that are not near one taken before; what was passed over fills up. A crowd of alike
    vectors so gets one pivot rather than its share, which would put the crowd first in every order."""
    x = directions(x)[0]
    taken: list[int] = []
    for i in range(len(x)):
        if len(taken) < n and (not taken or (x[taken] @ x[i]).max() < near):
            taken.append(i)
    passed = np.setdiff1d(np.arange(len(x)), taken).tolist()
    return x[(taken + passed)[:n]]


def orders(x: np.ndarray, pivots: np.ndarray, length: int) -> np.ndarray:
    """For each vector its nearest pivots (by angle), nearest first, ties to the lower pivot."""
    return np.argsort(-(x @ pivots.T), axis=1, kind="stable")[:, :length].astype(np.int16)


def footrule_gain(mine: np.ndarray, theirs: np.ndarray, pivots: int) -> np.ndarray:
    """How much below its maximum the footrule distance of each pair of truncated orders is.

    A pivot missing from an order counts with the order's length, so only pivots in both bring the distance down, by
    twice the length less the later of the two places. Each pivot's inverted file of either side is visited once.
    """
    length = mine.shape[1]
    gain = np.zeros((len(mine), len(theirs)), np.int32)

    def files(orders_: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
        rows, places = np.divmod(np.argsort(orders_, axis=None, kind="stable"), length)
        ends = np.searchsorted(np.sort(orders_, axis=None), np.arange(pivots + 1))
        return [(rows[a:b], places[a:b].astype(np.int32)) for a, b in zip(ends, ends[1:], strict=False)]

    for (q, at), (v, place) in zip(files(mine), files(theirs), strict=True):
        if len(q) and len(v):
            gain[np.ix_(q, v)] += length - np.maximum.outer(at, place)
    return gain


def _reachable(unit_q: np.ndarray, unit_x: np.ndarray, first: np.ndarray, points: np.ndarray) -> np.ndarray:
    """An upper bound of each pair's cosine: with the pivot that is the vector's nearest, what lies along it multiplies,
    and what lies across it is at most parallel. The margin is above what rounding can do."""
    along = np.clip(unit_q @ points.T, -1, 1)
    own = np.clip((unit_x * points[first]).sum(axis=1), -1, 1)
    return along[:, first] * own + np.sqrt(1 - along * along)[:, first] * np.sqrt(1 - own * own) + 1e-6


def _block_search(queries: pd.DataFrame, vectors: pd.DataFrame, k: int, share: float, least: int, points: np.ndarray) -> pd.DataFrame:
    """The best of one block for one set of queries by inner product.

    What the footrule ranks first is scored first; its k-th best is a floor. Every other vector whose length and nearest
    pivot still allow a product of the floor is scored too, so none that belongs to the best is left out.
    """
    if not len(queries) or not len(vectors):
        return pd.DataFrame({"query_id": [], "vec_id": [], "score": []})
    vectors = vectors.sort_values("vec_id", kind="stable")
    ids, own = vectors["vec_id"].to_numpy(), queries["vec_id"].to_numpy()
    x, q = np.stack(vectors["v"].to_numpy()), np.stack(queries["v"].to_numpy())
    near = np.stack(vectors["near"].to_numpy())
    known = near.shape[1] > 0  # vectors of a length that has no pivots are bounded by their own lengths alone
    gain = footrule_gain(np.stack(queries["near"].to_numpy()), near, len(points)) if known else np.zeros((len(own), len(ids)), np.int32)
    gain[own[:, None] == ids[None, :]] = -1
    n = min(len(ids), max(least, int(np.ceil(share * len(ids)))) + 1)
    (unit_q, long_q), (unit_x, long_x) = directions(q), directions(x)
    out = []
    for start in range(0, len(own), STEP):
        part = range(start, min(start + STEP, len(own)))
        floor = np.full(len(part), -np.inf)
        for at, i in enumerate(part):
            # what no file of the query's pivots holds is not ranked; of the rest the n of the largest gain, ties to the
            # smaller id: ids ascend, so the code falls along them
            first = np.flatnonzero(gain[i] > 0) if known else np.flatnonzero(gain[i] >= 0)
            if len(first) > n:
                code = gain[i, first].astype(np.int64) * len(ids) - first
                first = first[np.argpartition(-code, n - 1)[:n]]
            if len(first) >= k:
                floor[at] = -np.partition(-(x[first] * q[i]).sum(axis=1), k - 1)[k - 1]
        with np.errstate(over="ignore", invalid="ignore"):
            # comparisons are the other way round, so that what isn't a number stays
            most = long_q[part.start : part.stop, None] * long_x
            cosine = _reachable(unit_q[part.start : part.stop], unit_x, near[:, 0], points) if known else 1 + 1e-6
            some = np.flatnonzero((~(most * cosine < floor[:, None])).any(axis=0))
            product = q[part.start : part.stop] @ x[some].T
            blur = 4 * x.shape[1] * np.finfo(float).eps * most[:, some]
            for at, i in enumerate(part):
                other = np.flatnonzero(gain[i, some] >= 0)
                best = product[at, other]
                if len(best) > k:
                    low = best - blur[at, other]
                    other = other[~(best + blur[at, other] < -np.partition(-low, k - 1)[k - 1])]
                rows = some[other]
                score = (x[rows] * q[i]).sum(axis=1)
                best = np.lexsort((ids[rows], -score))[:k]
                out.append((np.full(len(best), own[i]), ids[rows][best], score[best]))
    query, vec, score = (np.concatenate(c) for c in zip(*out, strict=True))
    return pd.DataFrame({"query_id": query, "vec_id": vec, "score": score})


def nearest(vectors: DataFrame, is_query: Column | str, k: int = 20, pivots: int = 256, length: int = 16, share: float = 0.2, least: int = 128, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """``(query_id, rank, vec_id, score)``: for each query row its k nearest other rows by inner product.

    Every vector becomes the order of its nearest pivots. Vectors are dealt into blocks and queries into sets of a
    bounded size each by a hash of their id; each set meets each block once. There every vector is posted in the files
    of its pivots, and a query looks into those of its own: vectors of which no pivot is among the query's are not
    met. What is met is ranked by footrule distance, the ``share`` of the block (``least`` rows at least) that comes
    first is scored exactly in double precision, and so is all else that lengths and nearest pivots don't rule out; the
    block's k best go on, and last each query's are merged. The result is exact; ``length`` and ``share`` decide how
    much work it is.

    Left out are rows with a null id, null, empty and zero vectors, and those with null or non-finite components.
    Vectors have products with those of as many components alone: each number of components is searched for itself,
    the commonest with pivots, the others by the bounds of their lengths. Of rows that repeat an id each is a
    candidate, and an id that is a query more than once is searched with each of its vectors' best, merged; a query's
    own id is no candidate. Ties go to the smaller id. With k or fewer candidates all are returned; empty tables give
    no rows.
    """
    own = usable(vectors, id_col, vector_col)
    points = choose_pivots(own, pivots)
    length = min(length, max(1, len(points)))
    shared = own.sparkSession.sparkContext.broadcast(points)

    def permute(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pivots_of, kind = shared.value, pa.list_(pa.int16())
        for b in batches:
            sizes = np.asarray(pc.list_value_length(b.column(1)))
            for size in np.unique(sizes).tolist():
                part = b.filter(pa.array(sizes == size))
                x = np.array(part.column(1).to_pylist())
                near = orders(x, pivots_of, length) if len(pivots_of) and pivots_of.shape[1] == size else np.zeros((len(x), 0), np.int16)
                yield pa.RecordBatch.from_arrays(
                    [*part.columns, pa.array(list(near), kind), pa.array(np.full(len(x), size), pa.int32())], ["vec_id", "v", "near", "d"]
                )

    index = settle(own.mapInArrow(permute, "vec_id long, v array<double>, near array<smallint>, d int"))
    asked = index.where(F.expr(is_query) if isinstance(is_query, str) else is_query)
    blocks, sets = (max(1, -(-df.count() // size)) for df, size in ((index, BLOCK), (asked, QUERIES)))
    dealt = lambda seed, n: F.expr(f"cast(pmod(xxhash64({seed}, vec_id), {n}) as int)")
    every = lambda n: F.explode(F.expr(f"sequence(0, {n - 1})"))
    left = asked.select(dealt(1, sets).alias("set"), every(blocks).alias("block"), "vec_id", "v", "near", "d")
    right = index.select(dealt(2, blocks).alias("block"), every(sets).alias("set"), "vec_id", "v", "near", "d")

    def search(q: pd.DataFrame, v: pd.DataFrame) -> pd.DataFrame:
        return _block_search(q, v, k, share, least, shared.value)

    met = left.groupBy("set", "block", "d").cogroup(right.groupBy("set", "block", "d")).applyInPandas(
        search, "query_id long, vec_id long, score double"
    )
    rank = F.expr("row_number() over (partition by query_id order by score desc, vec_id)")
    return met.select("query_id", rank.alias("rank"), "vec_id", "score").where(F.col("rank") <= k)
