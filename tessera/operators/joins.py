"""Joins of neighbours, bands and nearest rows, as equi-joins on computed keys."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.operators.graph import connected_components
from tessera.session import Scratch, remove, shuffle_partitions, stored

#: Pairs of a range of ids that one task decides.
HELD = 200_000
#: Members of a class that are one row, and about how many pairs of members a task makes.
PART, MADE = 512, 20_000_000
#: Pairs of two linked classes on average, above which the members of both sides are made pairs in two loops.
COPIED = 50_000


def neighbour_pairs(tiles: DataFrame, value: str = "metric") -> DataFrame:
    """Each tile with the next below and the next to the right, by the place in the sorted list of rows and columns.

    Two equi-joins on shifted indexes; ``kind`` is v or h.
    """
    placed = dense_index(dense_index(tiles, "row", "ri"), "col", "ci")
    other = placed.select(F.col("ri").alias("ri2"), F.col("ci").alias("ci2"), F.col("row").alias("row2"), F.col("col").alias("col2"), F.col(value).alias("value2"))
    shifted = lambda dr, dc, kind: placed.join(other.hint("merge"), (F.col("ri2") == F.col("ri") + dr) & (F.col("ci2") == F.col("ci") + dc)).withColumn("kind", F.lit(kind))
    out = shifted(1, 0, "v").unionByName(shifted(0, 1, "h"))
    return out.select("kind", "row", "col", "row2", "col2", F.col(value).alias("value"), "value2")


def dense_index(df: DataFrame, column: str, name: str) -> DataFrame:
    """The place of a value among the sorted distinct values, from 0. The distinct values are found first, by partial
    aggregation, so the only global sort is of those."""
    places = df.select(F.col(column).alias("_v")).distinct().withColumn(name, F.dense_rank().over(Window.orderBy("_v")) - 1)
    return df.join(places, df[column] == places["_v"]).drop("_v")


def offset_candidates(tiles: DataFrame, reach: int, value: str = "metric") -> DataFrame:
    """Pairs of adjacent columns whose rows differ by an offset of up to ``reach``: an equi-join on the computed row."""
    offsets = F.explode(F.sequence(F.lit(-reach), F.lit(reach))).alias("offset")
    left = tiles.select("col", "row", F.col(value).alias("value"), offsets).withColumn("want", F.col("row") + F.col("offset"))
    right = tiles.select((F.col("col") - 1).alias("lcol"), F.col("row").alias("row2"), F.col(value).alias("value2"))
    return left.join(
        right, (F.col("lcol") == F.col("col")) & (F.col("row2") == F.col("want"))
    ).select("col", "row", "offset", "row2", "value", "value2")


def vote_offsets(pairs: DataFrame, score: Column, least_score: float, margin: float = 0.1, single: float = 0.5) -> DataFrame:
    """The best offset per column: most edges of enough score, then their mean.

    One edge alone must score ``single``; an offset other than 0 must beat 0 by the margin unless it has more edges.
    """
    good = pairs.withColumn("s", score).where(F.col("s") >= least_score)
    votes = good.groupBy("col", "offset").agg(
        F.count("*").alias("edges"), F.avg("s").alias("mean_score")
    ).where((F.col("edges") > 1) | (F.col("mean_score") >= single))
    zero = votes.where("offset = 0").select(F.col("col").alias("zc"), F.col("edges").alias("ze"), F.col("mean_score").alias("zs"))
    rank = F.row_number().over(Window.partitionBy("col").orderBy(F.desc("edges"), F.desc("mean_score"), F.abs("offset"), "offset"))
    best = votes.withColumn("rn", rank).where("rn = 1").drop("rn").join(zero, F.col("col") == F.col("zc"), "left")
    keep = (F.col("offset") == 0) | F.col("zc").isNull() | (F.col("edges") > F.col("ze")) | (F.col("mean_score") > F.col("zs") + margin)
    return best.select("col", F.when(keep, F.col("offset")).otherwise(0).alias("offset"), "edges", F.round("mean_score", 6).alias("mean_score"))


def nearest_by_key(left: DataFrame, right: DataFrame, key: str, at: str, right_at: str) -> DataFrame:
    """For each left row the right row of the same key whose position is nearest, ties to the smaller position.

    Not a product of both sides: both are merged in key and position order and look back and forward once.
    """
    both = left.withColumn("_side", F.lit(0)).withColumn("_at", F.col(at)).unionByName(
        right.select(F.col(key), F.col(right_at).alias("_at"), F.lit(1).alias("_side"), F.struct(*[c for c in right.columns if c != key]).alias("_row")),
        allowMissingColumns=True
    )
    order = Window.partitionBy(key).orderBy("_at", F.desc("_side"))
    back = F.last("_row", ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, 0))
    # looking back in the reversed order: a running value, where a frame to the end would be read anew for each row
    turned = Window.partitionBy(key).orderBy(F.desc("_at"), "_side")
    forth = F.last("_row", ignorenulls=True).over(turned.rowsBetween(Window.unboundedPreceding, 0))
    met = both.withColumn("_b", back).withColumn("_f", forth).where("_side = 0")
    nearer = F.when(
        F.col("_b").isNull() | (F.abs(F.col(f"_f.{right_at}") - F.col("_at")) < F.abs(F.col(f"_b.{right_at}") - F.col("_at"))), F.col("_f")
    ).otherwise(F.col("_b"))
    return met.withColumn("nearest", nearer).drop("_side", "_at", "_row", "_b", "_f")


def band_places(points: DataFrame, dx: float, dy: float, id_col: str, x: str = "x", y: str = "y") -> tuple[DataFrame, DataFrame, DataFrame]:
    """Points of a band by place: the points ``(id, x, y)``, the different places ``(x, y, place, n)``, ``place`` the
    least id there, and each pair of different places with ``|x - x'| < dx`` and ``|y - y'| < dy`` once, as
    ``(x, y, place, x2, y2, place2)``.

    Points at one place have the same partners, so places are compared, not points. They are put into boxes of the
    band's size; a place looks into its own box and the eight around it, so rows meet by an equi-join on the box. The
    joins are shuffled whatever the files' sizes say: columns computed from a small file can be many rows. Points that
    are not near themselves (null or not finite) are near none.
    """
    at = points.select(F.col(id_col).alias("id"), F.col(x).alias("x"), F.col(y).alias("y")).where((F.abs(F.col("x") - F.col("x")) < dx) & (F.abs(F.col("y") - F.col("y")) < dy))
    places = at.groupBy("x", "y").agg(F.min("id").alias("place"), F.count("*").alias("n"))
    boxed = places.select("x", "y", "place", F.floor(F.col("x") / dx).alias("bx"), F.floor(F.col("y") / dy).alias("by"))
    around = F.explode(F.array(*(F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in (-1, 0, 1) for j in (-1, 0, 1)))).alias("d")
    spread = boxed.select(F.col("x").alias("x2"), F.col("y").alias("y2"), F.col("place").alias("place2"), "bx", "by", around).select(
        "x2", "y2", "place2", (F.col("bx") + F.col("d.i")).alias("bx"), (F.col("by") + F.col("d.j")).alias("by")
    )
    met = boxed.join(spread.hint("merge"), ["bx", "by"]).where("x < x2 or (x = x2 and y < y2)")
    near = met.where((F.abs(F.col("x") - F.col("x2")) < dx) & (F.abs(F.col("y") - F.col("y2")) < dy))
    return at, places, near.select("x", "y", "place", "x2", "y2", "place2")


def _in_parts(rows: DataFrame, keys: list[str], ident: str) -> DataFrame:
    """The rows of each class as arrays ``(*keys, part, ident)`` of some ``PART`` members, dealt by the hash of the
    member, so that no class is one row or one task's."""
    sizes = rows.groupBy(*keys).agg(F.ceil(F.count("*") / PART).alias("_k"))
    return rows.join(sizes.hint("merge"), keys).groupBy(*keys, F.expr(f"pmod(xxhash64({ident}), _k)").alias("part")).agg(F.collect_list(ident).alias(ident))


def class_pairs(links: DataFrame, left: DataFrame, right: DataFrame, a: str, b: str) -> DataFrame:
    """Pairs ``(a, b, inner)`` of the members of linked classes. Rows ``(*keys, a)`` and ``(*keys, b)`` have the members, by
    different names of the keys, and ``links`` has the keys of both and ``same``, whether it links a class with itself;
    of such a class each two parts meet once, and ``inner`` tells the pairs of a part with itself.

    Members are joined by parts of many, which are only then made pairs. There are as many tasks as the number of pairs
    asks for, and what one makes is about the same, however many members or links a class has.
    """
    spark, one, other = links.sparkSession, [c for c in left.columns if c != a], [c for c in right.columns if c != b]
    firsts, seconds = _in_parts(left, one, a), _in_parts(right, other, b)
    many = left.groupBy(*one).agg(F.count("*").alias("_n")), right.groupBy(*other).agg(F.count("*").alias("_m"))
    links, _ = stored(links.join(many[0].hint("merge"), one).join(many[1].hint("merge"), other), "links")
    pairs, n = links.agg(F.sum(F.col("_n").cast("double") * F.col("_m")), F.count("*")).head()
    pairs = pairs or 0
    tasks = max(shuffle_partitions(spark), int(pairs // MADE) + 1)
    # one key, of which a join keeps the number of tasks; that parts are the same is asked besides, not as further keys
    asked = links.select(*one, *other, "same", F.explode(F.sequence(F.lit(0), F.ceil(F.col("_m") / PART) - 1)).alias("_part"))
    asked = asked.join(firsts.hint("merge"), one).where("not same or part <= _part").select(
        *(F.col(c).alias(f"_{c}") for c in other), "_part", a, (F.col("same") & (F.col("part") == F.col("_part"))).alias("inner"), F.xxhash64(*other, "_part").alias("_at")
    )
    met = asked.repartition(tasks, "_at").join(seconds.withColumn("_at", F.xxhash64(*other, "part")).hint("merge"), "_at")
    met = met.where(" and ".join(f"{c} between _{c} and _{c}" for c in ["part", *other]))
    # a generated loop keeps copies of all rows that it makes of one: those of two parts' pairs, were it one loop for both
    # sides. A lambda, for which none is generated, parts it, which pays if these are many.
    one_side = F.transform(a, lambda x: x) if pairs > COPIED * n else F.col(a)
    return met.select("inner", F.explode(one_side).alias(a), b).select(a, F.explode(b).alias(b), "inner")


def band_pairs(points: DataFrame, dx: float, dy: float, id_col: str, x: str = "x", y: str = "y") -> DataFrame:
    """Pairs with ``|x - x'| < dx`` and ``|y - y'| < dy``, the smaller id first: those of places that are near, and of
    places that several points share. What is written on the way are links of places, not pairs."""
    at, places, near = band_places(points, dx, dy, id_col, x, y)
    own = places.where("n > 1").select("x", "y", F.col("x").alias("x2"), F.col("y").alias("y2"), F.lit(True).alias("same"))
    links = near.select("x", "y", "x2", "y2", F.lit(False).alias("same")).unionByName(own)
    met = class_pairs(links, at.select("x", "y", F.col("id").alias("p")), at.select(F.col("x").alias("x2"), F.col("y").alias("y2"), F.col("id").alias("q")), "p", "q")
    return met.where("p < q or (p > q and not inner)").select(F.least("p", "q").alias("a"), F.greatest("p", "q").alias("b"))


def band_components(points: DataFrame, dx: float, dy: float, id_col: str, x: str = "x", y: str = "y") -> DataFrame:
    """Components ``(component, members)`` of the points that have a partner in the band, ids being keys; ``component``
    is the least id. Found on the places: points at one place are linked among themselves, and to the same others."""
    _, places, near = band_places(points, dx, dy, id_col, x, y)
    keep = Scratch(points.sparkSession)
    places = keep.keep(places.select("place", "n"))
    loops = places.where("n > 1").select(F.col("place").alias("src"), F.col("place").alias("dst"))
    nodes = connected_components(near.select(F.col("place").alias("src"), F.col("place2").alias("dst")).unionByName(loops))
    out, _ = stored(nodes.join(places.hint("merge"), nodes["node"] == places["place"]).groupBy("component").agg(F.sum("n").alias("members")), "components")
    keep.clear()
    return out


def band_groups(points: DataFrame, dx: float, dy: float, id_col: str, x: str = "x", y: str = "y") -> DataFrame:
    """``first_seen_groups`` of the pairs of a band, ids being keys, without making the pairs.

    Only the least id of a place can lead: it is a partner of all others there, and if it is a member, its leader is a
    smaller partner of theirs as well. So places are grouped by their least ids, and a place's other points are members
    of the leader of its least id, or of that.
    """
    at, places, near = band_places(points, dx, dy, id_col, x, y)
    keep = Scratch(points.sparkSession)
    groups = first_seen_groups(near.select(F.least("place", "place2").alias("a"), F.greatest("place", "place2").alias("b")))
    led = places.select("x", "y", "place").join(groups.hint("merge"), F.col("place") == F.col("member"), "left")
    led = keep.keep(led.select("x", "y", F.coalesce("leader", "place").alias("leader")), "groups")
    out, _ = stored(at.join(led.hint("merge"), ["x", "y"]).where("id <> leader").select("leader", F.col("id").alias("member")), "groups")
    keep.clear()
    return out


def tolerant_match(records: DataFrame, probes: DataFrame, key: str, tolerance: Sequence[tuple[str, float, float]], order: str) -> DataFrame:
    """Left join of probes to the first record (by ``order``) of the same key whose columns are all within
    ``max(absolute, relative * probe)``; probes without one keep nulls."""
    right = records.select(F.col(key).alias("_key"), F.col(order).alias("match_order"), *(F.col(c).alias(f"match_{c}") for c, _, _ in tolerance))
    near = [F.abs(F.col(c) - F.col(f"match_{c}")) <= F.greatest(F.lit(float(a)), F.abs(F.col(c)) * r) for c, a, r in tolerance]
    cond = F.col(key) == F.col("_key")
    for n in near:
        cond = cond & n
    met = probes.join(right, cond, "left").groupBy(*probes.columns).agg(F.min(F.struct("match_order", *(f"match_{c}" for c, _, _ in tolerance))).alias("m"))
    return met.select(*probes.columns, F.col("m.match_order").alias("match_order"), *(F.col(f"m.match_{c}").alias(f"match_{c}") for c, _, _ in tolerance))


def missing_positions(tiles: DataFrame) -> DataFrame:
    """Places of the grid spanned by the present rows and columns that have no tile."""
    rows, cols = tiles.select("row").distinct(), tiles.select("col").distinct()
    # the product is the grid itself: as many rows as the answer is about
    return rows.crossJoin(cols).join(tiles.select("row", "col"), ["row", "col"], "left_anti")


def coverage_rescue(tiles: DataFrame, dropped: str, w: int, h: int, step: int, least: float = 0.55) -> DataFrame:
    """Dropped tiles of whose cells less than the limit is covered by kept ones are rescued.

    Tiles ``(id, x, y)`` become the cells of a raster, and these the bits of blocks of eight by seven cells: a row for
    each block that a tile touches. Blocks of kept tiles are put together and joined.
    """
    low = lambda c: F.floor(F.col(c) / step)
    high = lambda c, size: F.floor((F.col(c) + size - 1) / step)
    spans = tiles.select("id", F.expr(dropped).alias("dropped"), low("x").alias("x0"), high("x", w).alias("x1"), low("y").alias("y0"), high("y", h).alias("y1"))
    blocks = lambda c, n: F.explode(F.sequence(F.floor(F.col(f"{c}0") / n), F.floor(F.col(f"{c}1") / n)))
    at = spans.withColumn("bx", blocks("x", 8)).withColumn("by", blocks("y", 7))
    # a row of eight cells is a byte, and a byte is repeated in each of the block's rows that the tile touches
    first, last = (lambda c, n: F.greatest(F.col(f"{c}0") - n * F.col(f"b{c}"), F.lit(0))), (lambda c, n: F.least(F.col(f"{c}1") - n * F.col(f"b{c}"), F.lit(n - 1)))
    ones = [sum(1 << 8 * i for i in range(n)) for n in range(8)]
    rows = F.element_at(F.array(*map(F.lit, ones)), (last("y", 7) - first("y", 7) + 2).cast("int"))
    line = F.expr("shiftleft(1L, cast(_b + 1 as int)) - shiftleft(1L, cast(_a as int))")
    at = at.withColumns({"_a": first("x", 8), "_b": last("x", 8), "_c": first("y", 7), "_n": rows})
    at = at.select("id", "dropped", "bx", "by", F.expr("shiftleft(_n, cast(8 * _c as int))").alias("_n"), line.alias("_l")).select("id", "dropped", "bx", "by", (F.col("_n") * F.col("_l")).alias("bits"))
    kept = at.where("not dropped").groupBy("bx", "by").agg(F.bit_or("bits").alias("hit"))
    # shuffled whatever the files' sizes say: a tile becomes several blocks
    met = at.where("dropped").join(kept.hint("merge"), ["bx", "by"], "left")
    out = met.groupBy("id").agg(F.sum(F.bit_count("bits")).alias("cells"), F.sum(F.coalesce(F.bit_count(F.col("bits").bitwiseAND(F.col("hit"))), F.lit(0))).alias("covered"))
    return out.withColumn("rescued", F.col("covered") / F.col("cells") < least)


def manifest_check(manifest: DataFrame, files: DataFrame, key: str = "path") -> DataFrame:
    """Each manifest line against what is there: ok, missing, or mismatch of bytes or digest."""
    there = files.select(F.col(key).alias("_k"), F.col("bytes").alias("_b"), F.col("sha256").alias("_s"))
    state = F.when(F.col("_k").isNull(), "missing").when(
        (F.col("bytes") != F.col("_b")) | (F.col("sha256") != F.col("_s")), "mismatch"
    ).otherwise("ok")
    return manifest.join(there, F.col(key) == F.col("_k"), "left").select(key, state.alias("state"))


def manifest_diff(a: DataFrame, b: DataFrame, key: str = "path") -> DataFrame:
    """Files that only one side has or whose digests differ."""
    left, right = a.select(key, F.col("sha256").alias("left_sha")), b.select(F.col(key).alias("_k"), F.col("sha256").alias("right_sha"))
    out = left.join(right, F.col(key) == F.col("_k"), "full_outer").where(~F.col("left_sha").eqNullSafe(F.col("right_sha")))
    return out.select(
        F.coalesce(key, "_k").alias(key),
        F.when(F.col("_k").isNull(), "left only").when(F.col(key).isNull(), "right only").otherwise("differs").alias("state")
    )


def lookup_with_fallback(rows: DataFrame, table: DataFrame, key: str, value: str, default: Column) -> DataFrame:
    """Left lookup with a default, and whether the value was the key's own."""
    right = table.select(F.col(key).alias("_k"), F.col(value).alias("_v"))
    out = rows.join(right, F.col(key) == F.col("_k"), "left")
    return out.withColumn(value, F.coalesce("_v", default)).withColumn("calibrated", F.col("_k").isNotNull()).drop("_k", "_v")


def insert_if_absent(target: DataFrame, new: DataFrame, key: str, value: str) -> tuple[DataFrame, DataFrame]:
    """What to append of the new rows, and the keys whose value differs from what is there."""
    fresh = new.join(target, key, "left_anti")
    conflict = new.join(
        target.select(F.col(key).alias("_k"), F.col(value).alias("_v")), F.col(key) == F.col("_k")
    ).where(~F.col(value).eqNullSafe(F.col("_v"))).select(key)
    return fresh, conflict


def box_overlaps(alarms: DataFrame, windows: DataFrame, cell: int) -> DataFrame:
    """Pairs ``(alarm, window)`` of half-open boxes that overlap on both axes.

    Different boxes meet on the cells of a raster that both touch, so the join is on equal keys; a pair counts in the
    cell of its larger left and upper edges only, which both touch if they overlap, so no pair is made twice. Pairs of
    boxes are then joined with the alarms and the windows that have these boxes.
    """
    edges = ("x1", "y1", "x2", "y2")
    named = lambda df, key: df.select(key, *(F.col(c).alias(f"{key}_{c}") for c in edges))
    cells = lambda a, b: F.explode(F.sequence(F.floor(F.col(a) / cell), F.greatest(F.floor(F.col(a) / cell), F.ceil(F.col(b) / cell) - 1)))
    spread = lambda df, key: df.drop(key).distinct().withColumn("cx", cells(f"{key}_x1", f"{key}_x2")).withColumn("cy", cells(f"{key}_y1", f"{key}_y2"))
    a, w = named(alarms, "alarm"), named(windows, "window")
    met = spread(a, "alarm").join(spread(w, "window").hint("merge"), ["cx", "cy"])
    inside = (F.col("alarm_x1") < F.col("window_x2")) & (F.col("window_x1") < F.col("alarm_x2")) & (F.col("alarm_y1") < F.col("window_y2")) & (F.col("window_y1") < F.col("alarm_y2"))
    own = (F.col("cx") == F.floor(F.greatest("alarm_x1", "window_x1") / cell)) & (F.col("cy") == F.floor(F.greatest("alarm_y1", "window_y1") / cell))
    boxes = met.where(inside & own).drop("cx", "cy")
    return class_pairs(boxes.withColumn("same", F.lit(False)), a, w, "alarm", "window").select("alarm", "window")


def first_label(rows: DataFrame, labels: DataFrame, keys: Sequence[str], label_key: str, value: str) -> DataFrame:
    """The label under the first of several keys that has one."""
    out, found = rows, []
    for i, k in enumerate(keys):
        out = out.join(labels.select(F.col(label_key).alias(f"_k{i}"), F.col(value).alias(f"_v{i}")), F.col(k) == F.col(f"_k{i}"), "left")
        found.append(F.col(f"_v{i}"))
    return out.withColumn(value, F.coalesce(*found)).drop(*(f"_{c}{i}" for i in range(len(keys)) for c in "kv"))


def attribute_lines(lines: DataFrame, log: str, order: str, mark: str, line: str) -> DataFrame:
    """Each line with what the last marked line before it (or itself) names."""
    named = F.nullif(F.regexp_extract(line, mark, 1), F.lit(""))
    w = Window.partitionBy(log).orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return lines.withColumn("run", F.last(named, ignorenulls=True).over(w))


def symmetric_difference(a: DataFrame, b: DataFrame) -> DataFrame:
    """Distinct rows that only one side has."""
    return a.exceptAll(b).distinct().withColumn("side", F.lit("left")).unionByName(b.exceptAll(a).distinct().withColumn("side", F.lit("right")))


def conflict_scores(edges: DataFrame, tiles: DataFrame) -> DataFrame:
    """Tiles that share a bucket (the whole part of their key) with others: their edges' number, mean and least score,
    and how many siblings there are."""
    ends = edges.select(F.col("src").alias("id"), "score").unionByName(edges.select(F.col("dst").alias("id"), "score"))
    buckets = tiles.select("id", "col", F.floor("key").alias("bucket"))
    many = buckets.groupBy("col", "bucket").agg((F.count("*") - 1).alias("siblings")).where("siblings > 0")
    return buckets.join(many, ["col", "bucket"]).join(ends, "id", "left").groupBy("id", "col", "bucket", "siblings").agg(
        F.count("score").alias("edges"), F.round(F.avg("score"), 6).alias("mean_score"), F.min("score").alias("least_score")
    )


def manifest_summary(manifest: DataFrame, files: DataFrame, key: str, by: str, total: str | None = None) -> DataFrame:
    """Per run: the outputs that its manifest names, those that are there with size and digest, those that are missing,
    and whether all are as they should be; with ``total`` the sum of a column."""
    there = files.select(F.col(key).alias("_k"), F.col("bytes").alias("_b"), F.col("sha256").alias("_s"))
    met = manifest.join(there, F.col(key) == F.col("_k"), "left")
    same = F.coalesce((F.col("bytes") == F.col("_b")) & (F.col("sha256") == F.col("_s")), F.lit(False))
    more = [F.sum(total).alias("total")] if total else []
    return met.groupBy(by).agg(
        F.count("*").alias("outputs"), F.count_if(same).alias("verified"), F.count_if(F.col("_k").isNull()).alias("missing"),
        F.bool_and(same).alias("whole"), *more
    )


def derived_state(selected: DataFrame, listed: DataFrame, by: str, name: str) -> DataFrame:
    """Per dataset: ``raw`` without a list of corrected tiles, ``already_corrected`` if the list holds just the selected
    tiles with their digests, else ``invalid``."""
    other = listed.select(F.col(by).alias("_b"), F.col(name).alias("_n"), F.col("sha256").alias("_s"))
    met = selected.join(other, (F.col(by) == F.col("_b")) & (F.col(name) == F.col("_n")), "full_outer")
    same = F.bool_and(F.col("sha256").eqNullSafe(F.col("_s")))
    state = F.when(F.count("_n") == 0, "raw").when(same, "already_corrected").otherwise("invalid")
    return met.groupBy(F.coalesce(by, "_b").alias(by)).agg(state.alias("state"), F.count("*").alias("tiles"))


def same_fingerprint(prepared: DataFrame, current: DataFrame, by: str, columns: Sequence[str]) -> DataFrame:
    """Per dataset: its rows, and whether its fingerprint is the same in both tables. A fingerprint sums the digests of
    the rows, so their order plays no part and no row is gathered anywhere."""
    digest = lambda df: df.groupBy(by).agg(F.count("*").alias("tiles"), *(F.sum(F.conv(F.substring(F.sha2(F.to_json(F.struct(*columns)), 256), at, 12), 16, 10).cast("decimal(30,0)")).alias(f"f{at}") for at in (1, 13, 25, 37)))
    now = digest(current)
    now = now.select(F.col(by).alias("_b"), F.struct("tiles", *(c for c in now.columns if c.startswith("f"))).alias("_f"))
    was = digest(prepared)
    own = F.struct("tiles", *(c for c in was.columns if c.startswith("f")))
    return was.join(now, F.col(by) == F.col("_b"), "left").select(by, "tiles", F.coalesce(own == F.col("_f"), F.lit(False)).alias("bound"))


def unmatched(parts: Sequence[DataFrame], known: DataFrame) -> DataFrame:
    """Distinct ids of any part that are not known."""
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.distinct().join(known, known.columns, "left_anti")


def first_seen(rows: DataFrame, key: Sequence[str], order: str) -> DataFrame:
    """A row per key, with the least order in which it was given."""
    return rows.groupBy(*key).agg(F.min(order).alias(order))


def equal_sets(left: DataFrame, right: DataFrame, by: str, ident: str) -> DataFrame:
    """Per group: whether both tables hold the same ids, and how many only one of them holds."""
    a, b = left.select(by, ident).distinct(), right.select(F.col(by).alias("_b"), F.col(ident).alias("_i")).distinct()
    met = a.join(b, (F.col(by) == F.col("_b")) & (F.col(ident) == F.col("_i")), "full_outer")
    lone = F.col(ident).isNull() | F.col("_i").isNull()
    return met.groupBy(F.coalesce(by, "_b").alias(by)).agg(F.bool_and(~lone).alias("same"), F.count_if(lone).alias("differing"))


def cached_answers(requests: DataFrame, stored_answers: DataFrame, payload: Sequence[str]) -> DataFrame:
    """Requests with the answer that is stored under the digest of their payload, if there is one: a request that was
    asked before is not asked again."""
    asked = requests.withColumn("request", F.sha2(F.to_json(F.struct(*payload), {"ignoreNullFields": "false"}), 256))
    known = stored_answers.select(F.col("request").alias("_r"), "answer")
    return asked.join(known, F.col("request") == F.col("_r"), "left").drop("_r").withColumn("cached", F.col("answer").isNotNull())


def _decide(nodes: pd.DataFrame, inner: pd.DataFrame) -> pd.DataFrame:
    """One block's ids in ascending order, as far as they can be told: ``some`` is whether a partner is known to lead,
    ``open`` whether one of another block isn't decided yet; ``inner`` has the undecided pairs inside the block."""
    nodes = nodes.sort_values("id")
    pairs = inner.sort_values("y")
    ids, xs, ys = nodes["id"].to_numpy(), pairs["x"].to_numpy(), pairs["y"].to_numpy()
    ends = np.searchsorted(ys, ids, "right")
    starts = np.searchsorted(ys, ids, "left")
    at = np.searchsorted(ids, xs)
    known = np.zeros(len(ids), np.int8)  # 1: leads, 2: doesn't, 0: not known
    for i, (some, open_) in enumerate(zip(nodes["some"].to_numpy(), nodes["open"].to_numpy(), strict=True)):
        smaller = known[at[starts[i] : ends[i]]]
        if some or (smaller == 1).any():
            known[i] = 2
        elif not open_ and (smaller == 2).all():
            known[i] = 1
    return pd.DataFrame({"id": ids[known > 0], "now": known[known > 0] == 1})


def first_seen_groups(pairs: DataFrame, a: str = "a", b: str = "b", held: int = HELD) -> DataFrame:
    """Greedy groups of pairs ``(a, b)``, a the smaller: ``(leader, member)``.

    In ascending order an id that is in no group yet leads one, of itself and all larger ids it is paired with that
    are in none. So an id leads if none of its smaller partners does, and is a member of its least partner that leads.

    Ids are numbers, dealt into ranges of about ``held`` pairs. A round decides in each range, in one task and in ascending order,
    all ids that don't wait for an undecided one of another range. What an id waits for is smaller, so a chain passes
    through a range once, and there are no more rounds than ranges on a chain, however long it is. What is decided is
    written and the last round's tables removed.
    """
    spark = pairs.sparkSession
    keep = Scratch(spark)
    edges = keep.keep(pairs.select(F.col(a).alias("x"), F.col(b).alias("y")).where("x < y").distinct())
    ranges = -(-edges.count() // held)
    ends = edges.agg(F.percentile_approx("y", [i / ranges for i in range(1, ranges)], 10_000)).head()[0] if ranges > 1 else []
    block = F.size(F.filter(F.array(*map(F.lit, sorted(set(ends)))), lambda e: e < F.col("id"))) if ends else F.lit(0)
    ids = edges.select(F.col("x").alias("id")).unionByName(edges.select(F.col("y").alias("id"))).distinct()
    state, folder = stored(ids.select("id", block.alias("block"), F.lit(None).cast("boolean").alias("leads")), "groups")
    kind = state.schema["id"].dataType.simpleString()
    while not state.where("leads is null").isEmpty():
        waiting = state.where("leads is null").select("id", "block")
        met = edges.join(state.select(F.col("id").alias("x"), F.col("block").alias("_b"), "leads"), "x")
        met, scratch = stored(met.join(waiting.withColumnRenamed("id", "y"), "y").withColumn("inner", F.col("leads").isNull() & (F.col("_b") == F.col("block"))), "pairs")
        told = met.groupBy("y").agg(F.bool_or(F.coalesce("leads", F.lit(False))).alias("some"), F.bool_or(F.col("leads").isNull() & ~F.col("inner")).alias("open"))
        nodes = waiting.join(told, waiting["id"] == told["y"], "left").select("block", "id", *(F.coalesce(c, F.lit(False)).alias(c) for c in ("some", "open")))
        inner = met.where("inner").select("block", "x", "y")
        decided = nodes.groupBy("block").cogroup(inner.groupBy("block")).applyInPandas(_decide, f"id {kind}, now boolean").withColumnRenamed("id", "_i")
        was = folder
        both = state.join(decided, state["id"] == decided["_i"], "left").select("id", "block", F.coalesce("leads", "now").alias("leads"))
        state, folder = stored(both, "groups")
        remove(spark, was, scratch)
    leaders = state.where("leads").select("id")
    own = edges.join(
        leaders, edges["x"] == leaders["id"], "left_semi"
    ).groupBy("y").agg(F.min("x").alias("leader")).select("leader", F.col("y").alias("member"))
    out, _ = stored(own.join(leaders, own["member"] == leaders["id"], "left_anti"), "groups")
    keep.clear()
    remove(spark, folder)
    return out
