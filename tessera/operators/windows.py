"""Ordered operators: acquisition order, chains, gaps, last-wins, timelines."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def serpentine_order(tiles: DataFrame, column: str, key: str, up: Column) -> DataFrame:
    """``order`` of a tile in its column from 0, and the row that it shows where columns run up and down in turn."""
    w = Window.partitionBy(column)
    out = tiles.withColumn("order", F.row_number().over(w.orderBy(key)) - 1)
    return out.withColumn("nominal_row", F.when(up, F.count("*").over(w) - 1 - F.col("order")).otherwise(F.col("order")).cast("int"))


def snake_path(spark, columns: int, rows: int, dx: float, dy: float) -> DataFrame:
    """The order of a scan that runs down and up in turn, with running targets."""
    grid = spark.range(columns * rows).select(F.col("id").cast("int").alias("sequence"))
    col = F.floor(F.col("sequence") / rows).cast("int")
    within = (F.col("sequence") % rows).cast("int")
    out = grid.withColumn("col", col).withColumn("row", F.when(F.col("col") % 2 == 0, within).otherwise(rows - 1 - within))
    return out.withColumn("target_x", F.col("col") * dx).withColumn("target_y", F.col("row") * dy)


def chain_segments(rows: DataFrame, by: str, order: Sequence[str], step: Column, broken: Column, default: int = 1) -> DataFrame:
    """Positions by running sums of steps; a broken link steps by the default and starts a new segment; least is 0."""
    w = Window.partitionBy(by).orderBy(*order)
    run = w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    first = F.row_number().over(w) == 1
    out = rows.withColumn("_first", first).withColumn("_broken", ~F.col("_first") & F.coalesce(broken, F.lit(True)))
    out = out.withColumn("_step", F.when(F.col("_first"), 0).when(F.col("_broken"), default).otherwise(step))
    out = out.withColumn("_at", F.sum("_step").over(run)).withColumn("segment", F.sum(F.col("_broken").cast("int")).over(run).cast("int"))
    return out.withColumn("position", F.col("_at") - F.min("_at").over(Window.partitionBy(by))).drop("_first", "_broken", "_step", "_at")


def last_wins(rows: DataFrame, key: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """The last row per key by the order, and how many rows it stands for: one aggregation, no sort of groups."""
    rank = F.struct(*order)
    others = [c for c in rows.columns if c not in key]
    return rows.groupBy(*key).agg(F.max_by(F.struct(*others), rank).alias("r"), F.count("*").alias("captures")).select(*key, "r.*", "captures")


def restart_gaps(rows: DataFrame, by: str, run: str, start: str, end: str, per_minute: float) -> DataFrame:
    """Minutes from a run's end to the next run's start."""
    w = Window.partitionBy(by).orderBy(start, run)
    nxt = F.lead(start).over(w)
    return rows.withColumn("next_run", F.lead(run).over(w)).withColumn(
        "gap_minutes", F.round((nxt - F.col(end)) / F.lit(per_minute), 1)
    ).where("next_run is not null")


def incident_timeline(rows: DataFrame, by: str, order: Sequence[str], at: str, incident: Column, capture: Column, per_minute: float) -> DataFrame:
    """Incidents with their place, the captures before each, their share of the run, and minutes since its start."""
    w = Window.partitionBy(by).orderBy(*order)
    upto = w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    out = rows.withColumn("sequence", F.row_number().over(w)).withColumn("captures_before", F.count_if(capture).over(upto)).withColumn(
        "planned", F.count_if(capture).over(Window.partitionBy(by))
    )
    out = out.withColumn("elapsed_minutes", F.round((F.col(at) - F.first(at).over(upto)) / F.lit(per_minute), 1))
    return out.withColumn("fraction", F.round(F.try_divide(F.col("captures_before").cast("double"), F.col("planned")), 6)).where(incident)


def sequence_faults(rows: DataFrame, by: str, sequence: str, ident: str) -> DataFrame:
    """Streams whose sequence is not 1, 2, 3, … or whose ids repeat: gaps, the first missing number, duplicates."""
    w = Window.partitionBy(by).orderBy(sequence)
    before = F.coalesce(F.lag(sequence).over(w), F.lit(0))
    out = rows.withColumn("_gap", F.col(sequence) - before).withColumn("_before", before)
    out = out.groupBy(by).agg(
        F.count("*").alias("events"), F.count_if(F.col("_gap") != 1).alias("gaps"),
        F.min(F.when(F.col("_gap") > 1, F.col("_before") + 1)).alias("first_missing"), (F.count("*") - F.count_distinct(ident)).alias("duplicate_ids")
    )
    return out.where("gaps > 0 or duplicate_ids > 0")


def latest_state(rows: DataFrame, by: str, order: Sequence[str], reset: Column, value: Column) -> DataFrame:
    """After each event the last value set since the last reset."""
    w = Window.partitionBy(by).orderBy(*order)
    session = F.sum(F.coalesce(reset.cast("int"), F.lit(0))).over(w.rowsBetween(Window.unboundedPreceding, 0))
    out = rows.withColumn("session", session.cast("int")).withColumn("_v", value)
    inner = Window.partitionBy(by, "session").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return out.withColumn("state", F.last("_v", ignorenulls=True).over(inner)).drop("_v")


def rolling_median_clean(rows: DataFrame, by: str, order: Sequence[str], value: str, reach: int = 10, least: int = 5, factor: float = 8.0, enough: int = 25) -> DataFrame:
    """Keep what lies within ``factor`` median residuals of the centred rolling median; short series are kept whole."""
    w = Window.partitionBy(by).orderBy(*order).rowsBetween(-reach, reach)
    rolled = F.when(F.count(value).over(w) >= least, F.percentile(value, 0.5).over(w))
    out = rows.withColumn("rolling", rolled).withColumn("residual", F.abs(F.col(value) - F.col("rolling")))
    typical = out.groupBy(by).agg(F.percentile("residual", 0.5).alias("typical"), F.count("*").alias("n"))
    keep = (F.col("n") <= enough) | F.col("residual").isNull() | (F.col("typical") == 0) | (F.col("residual") < factor * F.col("typical"))
    return out.join(typical, by).where(keep).drop("typical", "n")


def column_steps(levels: DataFrame, column: str, level: str, least: float) -> DataFrame:
    """Segments of adjacent columns whose level does not jump; the longest (the first of equals) is the reference."""
    w = Window.orderBy(column)
    jump = F.coalesce((F.abs(F.col(level) - F.lag(level).over(w)) > least).cast("int"), F.lit(0))
    out = levels.withColumn("jump", jump).withColumn("segment", F.sum("jump").over(w.rowsBetween(Window.unboundedPreceding, 0)).cast("int"))
    size = F.count("*").over(Window.partitionBy("segment"))
    best = F.first("segment").over(Window.orderBy(F.desc("size"), "segment").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    return out.withColumn("size", size).withColumn("is_reference", F.col("segment") == best)


def consecutive(rows: DataFrame, by: Sequence[str], order: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """Each row beside the one after it within its group."""
    w = Window.partitionBy(*by).orderBy(*order)
    out = rows
    for c in columns:
        out = out.withColumn(f"next_{c}", F.lead(c).over(w))
    return out.where(F.col(f"next_{columns[0]}").isNotNull())


def smoothing_weights(size: int, degree: int) -> list[list[float]]:
    """What each of so many samples adds to the least-squares polynomial at each of them: the middle row smooths, the
    others are for the ends."""
    x = np.arange(size) - size // 2
    powers = np.vander(x, degree + 1, increasing=True).astype(float)
    return (powers @ np.linalg.pinv(powers)).tolist()


def smoothed(values: Column, n: int, size: int = 21, degree: int = 3) -> Column:
    """An array column of n samples smoothed by polynomials over a moving window; the first and last samples lie on the
    polynomial of the first and last window. All in array functions of the JVM."""
    rows = ",".join("array(" + ",".join(f"{w!r}D" for w in row) + ")" for row in smoothing_weights(size, degree))
    weights = F.expr(f"array({rows})")
    half = size // 2

    def at(i: Column) -> Column:
        start = F.least(F.greatest(i - half, F.lit(0)), F.lit(n - size))
        terms = F.zip_with(F.get(weights, i - start), F.slice(values, start + 1, F.lit(size)), lambda w, v: w * v)
        return F.aggregate(terms, F.lit(0.0), lambda a, b: a + b)

    return F.transform(F.sequence(F.lit(0), F.lit(n - 1)), at)
