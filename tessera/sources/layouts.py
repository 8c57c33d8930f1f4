"""Names of files as tables: layouts by regular expressions, and their validation."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators import joins


def parse(names: DataFrame, column: str, fields: Mapping[str, str], whole: str, numbers: Sequence[str] = ()) -> DataFrame:
    """A column per field, from the first group of its expression, and ``matches``, whether the whole layout fits."""
    out = names
    for name, pattern in fields.items():
        part = F.regexp_extract(column, pattern, 1)
        out = out.withColumn(name, F.nullif(part, F.lit("")).try_cast("int") if name in numbers else part)
    return out.withColumn("matches", F.coalesce(F.col(column).rlike(whole), F.lit(False)))


def validate(parsed: DataFrame, container: str, index: str, least: float = 0.95) -> DataFrame:
    """Per container: how many names fit, how many repeat an index, and whether enough fit."""
    out = parsed.groupBy(container).agg(
        F.count("*").alias("n"), F.count_if("matches").alias("matched"), (F.count("*") - F.count_distinct(index)).alias("repeated")
    )
    return out.withColumn("accepted", F.col("matched") / F.col("n") >= least)


def containers(names: DataFrame, column: str = "name") -> DataFrame:
    """Names that do not start with a dot or an underscore."""
    return names.where(~F.col(column).rlike("^[._]") & ~F.col(column).contains("__MACOSX"))


def list_files(spark: SparkSession, folder: str, pattern: str = "*", since: str | None = None, hashes: bool = False) -> DataFrame:
    """Files below a folder: ``path, name, bytes, modified`` and, if asked for, their digest. Without digests the
    contents are not read."""
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern)
    if since:
        reader = reader.option("modifiedAfter", since)
    files = reader.load(folder)
    cols = [
        F.col("path"), F.regexp_extract("path", r"([^/]+)$", 1).alias("name"), F.col("length").alias("bytes"),
        F.col("modificationTime").alias("modified")
    ]
    return files.select(*cols, *([F.sha2("content", 256).alias("sha256")] if hashes else []))


def grid_inventory(names: DataFrame, column: str = "name", pattern: str = r"_r(\d+)_c(\d+)") -> tuple[DataFrame, DataFrame, DataFrame]:
    """Tiles with row and column, places named twice, and places without a tile."""
    part = lambda i: F.nullif(F.regexp_extract(column, pattern, i), F.lit("")).try_cast("int")
    tiles = names.withColumn("row", part(1)).withColumn("col", part(2)).where("row is not null and col is not null")
    twice = tiles.groupBy("row", "col").agg(F.count("*").alias("n")).where("n > 1")
    return tiles, twice, joins.missing_positions(tiles)


def shadowed(files: DataFrame, number: str, extension: str, by: str = "xlsx", what: str = "csv") -> DataFrame:
    """Files without those of one extension whose number another extension has; files without a number stay."""
    strong = files.where(F.col(extension) == by).select(F.col(number).alias("_n")).distinct()
    weak = files.where(F.col(extension) == what).join(strong, F.col(number) == F.col("_n"), "left_anti")
    return files.where(F.col(extension) != what).unionByName(weak)


def companions(logs: DataFrame, runs: DataFrame, stamp: str = "stamp", first: str = "first_day", last: str = "last_day") -> DataFrame:
    """Logs whose date lies from a day before the first run to a day after the last."""
    span = runs.agg(F.date_sub(F.min(first), 1).alias("_a"), F.date_add(F.max(last), 1).alias("_b"))
    return logs.join(F.broadcast(span)).where(F.col(stamp).between(F.col("_a"), F.col("_b"))).drop("_a", "_b")


def member_report(names: DataFrame, container: str = "container", member: str = "member", size: str = "bytes") -> DataFrame:
    """Per container: members and their bytes, and how many were skipped as dotfiles or parts of a resource folder."""
    skipped = F.col(member).contains("__MACOSX") | F.col(member).rlike(r"(^|/)\.")
    return names.groupBy(container).agg(
        F.count_if(~skipped).alias("members"), F.sum(F.when(~skipped, F.col(size))).alias("bytes"), F.count_if(skipped).alias("skipped")
    )


def spectra_names(files: DataFrame, column: str = "name") -> DataFrame:
    """Files of spectra by name, with ``ext`` and ``book``: names that end in ``-2`` are reference spots and stay out,
    as does a csv whose workbook number an xlsx has."""
    ext, book = F.regexp_extract(column, r"\.([A-Za-z]+)$", 1), F.regexp_extract(column, r"book(\d+)", 1)
    rows = files.withColumn("ext", F.lower(ext)).withColumn("book", F.nullif(book, F.lit("")).try_cast("long"))
    return shadowed(rows.where(F.col("ext").isin("csv", "xlsx") & ~F.col(column).rlike(r"-2\.[A-Za-z]+$")), "book", "ext")
