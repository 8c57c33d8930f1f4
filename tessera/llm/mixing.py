"""Mixing sources to target weights: Efraimidis-Spirakis sampling in DataFrame functions only."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.session import settle

WORD = r"[^\x20\x09-\x0D]+"
#: Buckets per step of the search for the place where a source's budget ends.
WIDE = 1024
STEPS = 5
#: Up to so many sources their table is broadcast; beyond it the join is shuffled.
FEW = 10_000


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def prose_weight(text: Column, size: Column) -> Column:
    """A document's quality weight, 0.5 to 1.5: the nearer its characters per word are to 6, the higher."""
    return F.when(size > 0, 0.5 + 1.0 / (1.0 + F.abs(F.length(text) / size - 6.0))).otherwise(0.5)


def source_targets(sized: DataFrame, weights: Sequence[float] = (3, 1, 2), share: float = 1.5, most: float = 2.0) -> DataFrame:
    """``(source, source_size, target)`` from rows ``(source, size)``.

    Sources by code point, null last, take the weights in turn and share ``share`` times all sizes by weight; what is
    above ``most`` times a source's size is shared again among the rest. That ends where every open source has the
    same level per weight, found with prefix sums over the sources in the order in which they fill up.
    """
    per = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    ranked = per.withColumn("nth", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1)
    ranked = ranked.withColumn(
        "weight", F.element_at(F.array(*(F.lit(float(w)) for w in weights)), (F.col("nth") % len(weights) + 1).cast("int"))
    ).withColumn("cap", most * F.col("source_size"))
    order = Window.orderBy(F.col("cap") / F.col("weight"), "nth")
    everything = Window.partitionBy()
    level = (
        share * F.sum("source_size").over(everything) - F.coalesce(F.sum("cap").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    ) / F.sum("weight").over(order.rowsBetween(0, Window.unboundedFollowing))
    filled = ranked.withColumn("level", level).withColumn("open", F.when(F.col("level") < F.col("cap") / F.col("weight"), F.col("level")))
    found = F.first("open", ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    return filled.withColumn("found", found).select(
        "source", "source_size", F.coalesce(F.least("cap", F.col("found") * F.col("weight")), "cap").alias("target")
    )


def _by_source(left: DataFrame, right: DataFrame, few: bool) -> DataFrame:
    """Inner join on the null-safe source. The left side may hold a third of its rows in one source."""
    right = right.withColumnRenamed("source", "other")
    return left.join(F.broadcast(right) if few else right, F.col("source").eqNullSafe(F.col("other"))).drop("other")


def mix(docs: DataFrame, weights: Sequence[float] = (3, 1, 2), share: float = 1.5, most: float = 2.0, seed: int = 7, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weight_col: str | None = None, carry: Sequence[str] = ()) -> DataFrame:
    """One row ``(doc_id, size, source_size, target, taken)`` per document, with the columns named in ``carry``.

    A source is taken in complete epochs as often as its target holds its size; the rest of the target is a fractional
    epoch: documents in the order of their exponential keys ``-ln(u) / weight``, u from the hash of seed, id and whole
    text, until the rest is used up. The last one counts with the words that are left, so taken words meet the rounded
    target. The weight is ``weight_col``, a quality score such as the classifier's (null and below 0.001: 0.001), or
    without that column ``prose_weight``.

    Where a source's rest ends is found by buckets of the keys, 1,024 to a step, from sums per source and bucket; only
    the rows of the one bucket in which it ends are sorted. No source's rows ever meet in one task.

    Null texts have size 0 and take nothing, texts of any length count whole, null sources are one source, the last;
    rows without an id or that share one have keys of their own by their texts, equal keys go by id and size; repeated
    rows each count; an empty table gives no rows; ``most`` bounds each document's share as well.
    """
    size = word_count(F.col(text_col))
    weight = prose_weight(F.col(text_col), size) if weight_col is None else F.greatest(
        F.coalesce(F.col(weight_col).cast("double"), F.lit(0.0)), F.lit(0.001)
    )
    named = F.concat(
        F.lit(f"{seed}:"), F.coalesce(F.col(id_col).cast("long").cast("string"), F.lit("null")), F.lit(":"),
        F.md5(F.coalesce(F.col(text_col).cast("string"), F.lit("")).cast("binary"))
    )
    unit = (F.conv(F.substring(F.md5(named.cast("binary")), 1, 13), 16, 10).cast("long") + 0.5) / float(1 << 52)
    rows = docs.select(
        F.col(id_col).cast("long").alias("doc_id"), F.col(source_col).cast("string").alias("source"), size.alias("size"),
        (-F.log(unit) / weight).alias("key"), *(F.struct(*carry).alias("carried") for _ in carry[:1])
    )
    rows = rows.withColumn("place", F.least(F.floor((1.0 - F.exp(-F.col("key"))) * float(1 << 50)), F.lit((1 << 50) - 1)).cast("long"))
    sized = settle(rows.drop("carried"))

    sources = settle(source_targets(sized, weights, share, most))
    few = sources.limit(FEW + 1).count() <= FEW
    epochs = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long")
    sources = sources.withColumn("epochs", epochs).withColumn(
        "rest", F.floor(F.col("target") - F.col("epochs") * F.col("source_size") + 0.5).cast("long")
    )
    ends = settle(sources.select("*", F.lit(0).cast("long").alias("low"), F.lit(1 << 50).cast("long").alias("high"), F.lit(0).cast("long").alias("before")))
    upto = Window.partitionBy("source").orderBy("low")
    for step in range(1, STEPS + 1):
        span = 1 << (50 - 10 * step)
        inside = _by_source(sized.select("source", "size", "place"), ends.select("source", "low", "high"), few).where("place >= low and place < high")
        sums = inside.groupBy(
            "source", F.expr(f"place - pmod(place, {span}L)").alias("low")
        ).agg(F.sum("size").alias("words"), F.count("*").alias("n"))
        sums = sums.withColumn("earlier", F.sum("words").over(upto) - F.col("words"))
        reached = _by_source(
            sums, ends.select("source", "rest", "before"), few
        ).where("before + earlier <= rest").groupBy("source").agg(F.max(F.struct("low", "earlier", "n")).alias("at"))
        ends = ends.join(reached.withColumnRenamed("source", "other"), F.col("source").eqNullSafe(F.col("other")), "left")
        ends = settle(ends.select("source", "source_size", "target", "epochs", "rest", F.coalesce("at.low", "low").alias("low"), (F.coalesce("at.low", "low") + F.when(F.col("at").isNull(), F.col("high") - F.col("low")).otherwise(span)).alias("high"), (F.col("before") + F.coalesce("at.earlier", F.lit(0))).alias("before"), F.coalesce("at.n", F.lit(0)).alias("n")))
        if (ends.agg(F.max("n")).head()[0] or 0) <= WIDE // 4:
            break
        ends = ends.drop("n")
    ends = ends.drop("n")

    joined = _by_source(rows if carry else sized, ends, few)  # what is carried is read again rather than stored
    inner = joined.where("place >= low and place < high")
    nth = Window.partitionBy("source").orderBy("key", "doc_id", "size").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    inner = inner.withColumn("left", F.col("rest") - F.col("before") - F.sum("size").over(nth) + F.col("size"))
    outer = joined.where("place < low or place >= high").withColumn("left", F.when(F.col("place") < F.col("low"), F.col("size")).otherwise(0))
    taken = F.col("epochs") * F.col("size") + F.greatest(F.lit(0), F.least("left", "size"))
    return outer.unionByName(inner).select(
        F.col("doc_id").alias(id_col), "size", "source_size", "target", taken.cast("long").alias("taken"), *(["carried"] if carry else [])
    )
