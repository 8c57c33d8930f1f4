"""Graph operators on edge tables."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from tessera.session import remove, shuffle_partitions, small, stored

#: Edges of a range that one task puts together at a time.
HELD = 500_000


def _lowest(edges: DataFrame) -> DataFrame:
    return edges.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("low"))


def connected_components(edges: DataFrame, src: str = "src", dst: str = "dst") -> DataFrame:
    """Components of an undirected edge table: one row ``(node, component)`` per node, component its least node.

    Edges are held from the larger to the smaller end. A round has two steps. First every edge moves its smaller end
    to the least neighbour of that end; then all smaller neighbours of a node, and the node, are linked to the least
    of them. Both keep the components, and in the end every node has one edge, to the least node of its component.
    Paths, combs and zigzags of 100,000 nodes take 13 to 18 rounds; there is no bound on them.

    What a round makes is written to the shared folder and removed after the next: plans stay short, their estimates
    true, and both sides of the joins are plain exchanges, so that a node with most of the edges can be split at run
    time. Only whether any row is left comes to the driver. Edges with a null end are ignored; a self-loop makes a
    component of one node; an empty table gives no rows.
    """
    spark = edges.sparkSession
    given, first = stored(edges.select(F.col(src).alias("x"), F.col(dst).alias("y")).where("x is not null and y is not null"), "links")
    now, folder = stored(given.where("x <> y").select(F.greatest("x", "y").alias("a"), F.least("x", "y").alias("b")).distinct(), "links")
    while not _is_starry(now):
        least, lows = stored(_lowest(now), "links")
        moved = now.join(least, F.col("b") == F.col("node"), "left").select("a", F.coalesce("low", "b").alias("b"))
        moved, moves = stored(moved.distinct(), "links")
        under, unders = stored(_lowest(moved), "links")
        pairs = F.array(F.struct("a", F.col("low").alias("b")), F.struct(F.col("b").alias("a"), F.col("low").alias("b")))
        linked = moved.join(under, F.col("a") == F.col("node")).select(F.explode(pairs).alias("p")).select("p.*").where("a <> b")
        was = folder
        now, folder = stored(linked.distinct(), "links")
        remove(spark, was, lows, moves, unders)
    loops = given.where("x = y").select("x", F.col("x").alias("y"))
    stars = now.select(F.col("a").alias("x"), F.col("b").alias("y")).unionByName(now.select(F.col("b").alias("x"), F.col("b").alias("y")))
    out, _ = stored(stars.unionByName(loops).groupBy(F.col("x").alias("node")).agg(F.min("y").alias("component")), "components")
    remove(spark, first, folder)
    return out


def _is_starry(edges: DataFrame) -> bool:
    """Whether every node is either the larger end of one edge or the smaller end of any number."""
    ends = F.explode(F.array(F.struct(F.col("a").alias("node"), F.lit(1).alias("up"), F.lit(0).alias("down")), F.struct(F.col("b").alias("node"), F.lit(0).alias("up"), F.lit(1).alias("down"))))
    nodes = edges.select(ends.alias("e")).groupBy("e.node").agg(F.sum("e.up").alias("up"), F.max("e.down").alias("down"))
    return nodes.where("up > 1 or (up = 1 and down = 1)").isEmpty()


def _stars(x: np.ndarray, y: np.ndarray) -> pd.DataFrame:
    """Each node of some edges with the least node that they link it to."""
    names, at = np.unique(np.concatenate([x, y]), return_inverse=True)
    low, (a, b) = np.arange(len(names)), np.split(at, 2)
    while len(a):
        a, b = low[a], low[b]
        apart = a != b
        a, b = a[apart], b[apart]
        np.minimum.at(low, np.maximum(a, b), np.minimum(a, b))
        while (low != low[low]).any():
            low = low[low]
    return pd.DataFrame({"node": names, "low": names[low]})


def _put_together(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The stars of a task's edges: what is held is reduced to its nodes whenever it has grown to twice as many."""
    held, n, most = [], 0, HELD
    for t in batches:
        held.append(t.set_axis(["node", "low"], axis=1))
        n += len(t)
        if n >= most:
            held = [_stars(*(pd.concat(held)[c].to_numpy() for c in ("node", "low")))]
            n, most = len(held[0]), max(HELD, 2 * len(held[0]))
    if held:
        yield _stars(*(pd.concat(held)[c].to_numpy() for c in ("node", "low")))


def range_components(edges: DataFrame, src: str = "src", dst: str = "dst") -> DataFrame:
    """``connected_components`` for nodes whose neighbours are mostly near in their order, as the tiles of a scan are.

    Edges are dealt into ranges, and a task puts its range's together, whatever the ways in it are long. Nodes that come
    in several ranges link these ranges' parts: that graph has an edge for each time a node comes again, and it takes
    one more such task if it has few, or else the rounds of ``connected_components``.
    """
    spark = edges.sparkSession
    given, first = stored(edges.select(F.col(src).alias("x"), F.col(dst).alias("y")).where("x is not null and y is not null"), "links")
    kind = StructType([StructField(c, given.schema["x"].dataType) for c in ("node", "low")])
    tasks = max(shuffle_partitions(spark), -(-given.count() // HELD))
    parts = given.repartitionByRange(tasks, "x", "y").mapInPandas(_put_together, kind)
    # a node comes once a range at most
    nodes, second = stored(parts.groupBy("node").agg(F.min("low").alias("low"), F.collect_set("low").alias("lows")), "parts")
    again, third = stored(nodes.where(F.size("lows") > 1).select(F.explode("lows").alias("src"), F.col("low").alias("dst")).where("src <> dst").distinct(), "links")
    if again.count() <= HELD:
        met = again.coalesce(1).mapInPandas(_put_together, kind).toDF("_n", "component")
    else:
        met = connected_components(again).withColumnRenamed("node", "_n")
    met, fourth = stored(met, "parts")
    out, _ = stored(nodes.join(small(met), F.col("low") == F.col("_n"), "left").select("node", F.coalesce("component", "low").alias("component")), "components")
    remove(spark, first, second, third, fourth)
    return out
