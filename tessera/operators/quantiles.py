"""Exact quantiles of groups of any size.

The built-in ``percentile`` keeps a map of all different values of a group in one task. Where a group has more of them
than such a map should hold, the place of the quantile is narrowed down by counts instead.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.session import settle, small

#: Different values of a group up to which the built-in is taken, bins of a narrowing step, and rows of a bin that are
#: sorted in the end.
HELD, BINS, SORTED = 20_000, 4096, 200_000


def quantile(df: DataFrame, by: Sequence[str], value: str, p: float, name: str, held: int = HELD) -> DataFrame:
    """One row per group ``(*by, name, n)``: the quantile with linear interpolation, and the number of values.

    Null and NaN values don't count; a group without values has a null quantile. Both ways give the same number.
    """
    rows = df.select(*by, F.when(~F.isnan(F.col(value).cast("double")), F.col(value).cast("double")).alias("_v"))
    different = rows.groupBy(*by).agg(F.approx_count_distinct("_v", 0.05).alias("d")).agg(F.max("d")).head()[0] or 0
    if different <= held:
        return rows.groupBy(*by).agg(F.percentile("_v", p).alias(name), F.count("_v").alias("n"))
    return narrowed(rows, by, p, name)


def _same(left: DataFrame, right: DataFrame, by: Sequence[str]) -> DataFrame:
    """Inner join on null-safe group keys; the right side has a row per group."""
    other = right.withColumnsRenamed({c: f"_{c}_" for c in by})
    cond = reduce(lambda a, b: a & b, (F.col(c).eqNullSafe(F.col(f"_{c}_")) for c in by), F.lit(True))
    return left.join(other, cond).drop(*(f"_{c}_" for c in by))


def narrowed(rows: DataFrame, by: Sequence[str], p: float, name: str) -> DataFrame:
    """The quantile of ``_v`` by counting: each pass splits the values between two bounds into bins, by value, and goes
    on with the bin in which the wanted rank lies. Passes are map-side counts; nothing but bins is shuffled until the
    few rows of the last bin are sorted: bounds are broadcast if they have been counted to be few."""
    base = rows.groupBy(*by).agg(F.count("_v").alias("n"), F.min("_v").alias("lo"), F.max("_v").alias("hi"))
    base = base.withColumn("at", p * (F.col("n") - 1)).withColumn("k", F.floor("at"))
    bounds = settle(base.where("n > 0").select(*by, "n", "at", "k", "lo", "hi", F.lit(0).cast("long").alias("before"), F.col("n").alias("inside")))
    upto = Window.partitionBy(*by).orderBy("bin")
    for _ in range(40):
        if not bounds.where((F.col("inside") > SORTED) & (F.col("lo") < F.col("hi"))).limit(1).count():
            break
        share = (F.col("_v") - F.col("lo")) / (F.col("hi") - F.col("lo"))
        within = _same(rows, small(bounds.select(*by, "lo", "hi")), by).where("_v >= lo and _v <= hi")
        binned = within.withColumn("bin", F.when(F.col("lo") == F.col("hi"), 0).otherwise(F.least(F.floor(share * BINS), F.lit(BINS - 1))))
        counts = binned.groupBy(*by, "bin").agg(F.count("*").alias("c"), F.min("_v").alias("low"), F.max("_v").alias("high"))
        counts = counts.withColumn("earlier", F.sum("c").over(upto) - F.col("c"))
        hit = _same(counts, bounds.select(*by, "k", "before"), by).where("before + earlier <= k and before + earlier + c > k")
        step = hit.select(*by, "low", "high", "earlier", "c")
        bounds = settle(_same(bounds, step, by).select(*by, "n", "at", "k", F.col("low").alias("lo"), F.col("high").alias("hi"), (F.col("before") + F.col("earlier")).alias("before"), F.col("c").alias("inside")))
    near = _same(rows, small(bounds), by)
    after = near.where("_v > hi").groupBy(*by).agg(F.min("_v").alias("after"))
    place = F.row_number().over(Window.partitionBy(*by).orderBy("_v")) - 1 + F.col("before")
    # where all values of the last bin are equal, two of them stand for all
    last = near.where("_v >= lo and _v <= hi and lo < hi").withColumn("place", place)
    found = last.groupBy(*by).agg(
        F.max(F.when(F.col("place") == F.col("k"), F.col("_v"))).alias("a"), F.max(F.when(F.col("place") == F.col("k") + 1, F.col("_v"))).alias("b")
    )
    flat = bounds.where("lo = hi").select(
        *by, F.col("lo").alias("a"), F.when(F.col("k") + 1 < F.col("before") + F.col("inside"), F.col("lo")).alias("b")
    )
    values = _same(bounds, found.unionByName(flat), by)
    other = after.withColumnsRenamed({c: f"_{c}_" for c in by})
    cond = reduce(lambda a, b: a & b, (F.col(c).eqNullSafe(F.col(f"_{c}_")) for c in by), F.lit(True))
    values = values.join(other, cond, "left").withColumn("b", F.coalesce("b", "after", "a"))
    got = values.select(
        *by,
        F.when(F.col("at") == F.col("k"), F.col("a")).otherwise(
            (F.col("k") + 1 - F.col("at")) * F.col("a") + (F.col("at") - F.col("k")) * F.col("b")
        ).alias(name),
        "n"
    )
    return got.unionByName(base.where("n = 0").select(*by, F.lit(None).cast("double").alias(name), "n"))
