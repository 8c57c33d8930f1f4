"""Repeatable samples and spread picks: by hash order, strata and even spacing."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def unit(ident: Column, seed: str) -> Column:
    """A number from 0 to 1 that only the id and the seed decide."""
    return (
        F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), ident.cast("string")).cast("binary")), 1, 13), 16, 10).cast("long") + 0.5
    ) / float(1 << 52)


def seeded_sample(rows: DataFrame, ident: str, n: int, seed: str = "0") -> DataFrame:
    """The n rows whose hashes are lowest: a top-n of each task, merged."""
    return rows.withColumn("_u", unit(F.col(ident), seed)).orderBy("_u", ident).limit(n).drop("_u")


def stratified_windows(cells: DataFrame, strata: Sequence[str], ident: str, weight: Column, per_stratum: int, seed: str = "0") -> DataFrame:
    """From each stratum the cells of the lowest exponential keys: heavier cells are likelier, round by round."""
    keyed = cells.withColumn("_k", -F.log(unit(F.col(ident), seed)) / weight)
    rank = F.row_number().over(Window.partitionBy(*strata).orderBy("_k", ident))
    return keyed.withColumn("round", rank).where(F.col("round") <= per_stratum).drop("_k")


def spread(rows: DataFrame, by: Sequence[str], order: Sequence[str], n: int, ends: bool = True) -> DataFrame:
    """Up to n rows of each group, evenly spaced in order, with or without the ends; each row once."""
    w = Window.partitionBy(*by)
    at = rows.withColumn("_i", F.row_number().over(w.orderBy(*order)) - 1).withColumn("_n", F.count("*").over(w))
    places = F.transform(
        F.sequence(F.lit(0), F.lit(n - 1)),
        lambda k: F.floor(k * (F.col("_n") - 1) / F.lit(max(1, n - 1)) + 0.5) if ends else F.floor((k + 1) * F.col("_n") / F.lit(n + 1))
    )
    return at.where(F.array_contains(places, F.col("_i"))).drop("_i", "_n")
