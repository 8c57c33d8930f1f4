"""URL filters: a sort-merge sweep of reversed-host keys over nested rule intervals, in DataFrame functions only."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.session import shuffle_partitions

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Copies of a repeated row that are made at a time.
COPIES = 4096
URL = r"(?s)^.*?://([^/?#]*)([^?#]*)"


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/ ? #`` or the end, A-Z lower-cased; empty without ``://`` or for null."""
    return F.translate(F.coalesce(F.regexp_extract(url, URL, 1), F.lit("")), UPPER, LOWER)


def path_of(url: Column) -> Column:
    """From the host's end up to ``? #`` or the end."""
    return F.coalesce(F.regexp_extract(url, URL, 2), F.lit(""))


def rule_table(spark: SparkSession, rules: Sequence[tuple[str, str, str]]) -> DataFrame:
    """Rules ``(action, host, path)`` given in Python as a table of the same columns."""
    rows = F.array(*(F.struct(F.lit(a).alias("action"), F.lit(h).alias("host"), F.lit(p).alias("path")) for a, h, p in rules))
    return spark.range(1).select(F.inline(rows))


def _labels(host: Column) -> Column:
    return F.reverse(F.split(host, r"\."))


def _key(labels: Column, path: Column) -> Column:
    """Reversed labels, then ``#`` (which no host holds), then the path: a rule's key is a prefix of what it fits."""
    return F.concat(F.array_join(labels, "."), F.lit("#"), path)


def _boundaries(rules: DataFrame) -> DataFrame:
    """Where intervals open and close: ``(at, top)``, top being the innermost rule from there on.

    A rule opens at its key and closes after all keys that it starts (key and byte FF, which UTF-8 never has).
    Prefix intervals nest, so what lies under a rule on the stack is the rule with the longest proper prefix of its
    key; the closing boundary carries that one.
    """
    top = F.struct(F.col("size"), F.col("host_size"), F.col("rule"), F.col("action"))
    own = rules.select("key", top.alias("top"))
    stem = rules.select(
        "key", F.explode(F.expr("transform(sequence(instr(key, '#'), greatest(length(key) - 1, instr(key, '#'))), i -> left(key, i))")).alias("stem")
    ).where("stem <> key")
    under = stem.join(own.select(F.col("key").alias("stem"), "top"), "stem").groupBy("key").agg(F.max("top").alias("under"))
    nothing = F.struct(F.lit(-1).alias("size"), F.lit(-1).alias("host_size"), F.lit(None).cast("string").alias("rule"), F.lit(None).cast("string").alias("action"))
    opens = own.select(F.col("key").cast("binary").alias("at"), "top")
    closes = own.join(under, "key", "left").select(
        F.concat(F.col("key").cast("binary"), F.expr("X'FF'")).alias("at"), F.coalesce("under", nothing).alias("top")
    )
    return opens.unionByName(closes)


def _starts(keys: DataFrame, m: int) -> list[tuple[bytes, int]]:
    """Where up to ``m`` ranges of about as many rows start, and into how many parts each is dealt: first bytes of keys,
    the least first, at weighted quantiles of the keys whose hashes are lowest (16 for each range, which bounds what
    comes to the driver). A start on which several quantiles fall holds so many ranges' rows."""
    short = keys.select(F.substring("at", 1, 64).alias("at"), "n").groupBy("at").agg(F.sum("n").alias("n"))
    rows = sorted((bytes(r["at"]), r["n"]) for r in short.orderBy(F.xxhash64("at"), "at").limit(16 * m).collect())
    total, seen, starts = sum(n for _, n in rows), 0, {b"": 1}
    for at, n in rows:
        passed = (seen + n) * m // total - seen * m // total
        if passed:
            starts[at] = max(1, passed)
        seen += n
    return sorted(starts.items())


def _ranged(rows: DataFrame, starts: list[tuple[bytes, int]]) -> DataFrame:
    """The rows with the number of the range that their key ``at`` lies in, and of the parts it is dealt into."""
    wide = math.isqrt(len(starts) - 1) + 1
    groups = [starts[i : i + wide] for i in range(0, len(starts), wide)]
    array = lambda xs: f"array({','.join(xs)})"
    keys = lambda xs: array(f"X'{k.hex()}'" for k, _ in xs)
    rows = rows.withColumn("c", F.expr(f"size(filter({keys([g[0] for g in groups])}, v -> v <= at)) - 1"))
    rows = rows.withColumn("bucket", F.expr(f"c * {wide} + size(filter(element_at({array(map(keys, groups))}, c + 1), v -> v <= at)) - 1"))
    return rows.withColumn("parts", F.expr(f"element_at({array(str(n) for _, n in starts)}, bucket + 1)")).drop("c")


def judge(pages: DataFrame, rules: DataFrame, default: str = "allow", id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """One row ``(page_id, host, path, rule, verdict)`` per page.

    A rule ``(action, host, path)`` fits its host and all subdomains where the url's path starts with its path. The
    longest (host and path together, then host) wins; of equal rules ``block`` wins. Without a rule the verdict is the
    default. Null urls and urls without ``://`` have an empty host and path; urls of any length are taken whole;
    repeated rows stay; empty tables give no rows; no rules leave the default. Only the id and the url are read.

    A url stands for each host suffix of as many labels as a rule may have, as reversed labels and path. Urls and rule
    boundaries are dealt into the same ranges of keys and swept in their order; what is open where a range starts is
    the last boundary before it. A range in which one key has many rows is dealt into parts, which get its boundaries
    each. So rules of any number are shuffled like the urls, and only a hot range's are repeated.
    """
    spark = pages.sparkSession
    own = rules.select(
        "action", F.translate(F.coalesce("host", F.lit("")), UPPER, LOWER).alias("host"), F.coalesce("path", F.lit("")).alias("path")
    ).where("action is not null")
    own = own.groupBy("host", "path").agg(F.max("action").alias("action"))
    size = F.length("host") + F.length("path")
    own = own.select(
        "host", "action", _key(_labels(F.col("host")), F.col("path")).alias("key"), F.concat("host", "path").alias("rule"),
        F.length("host").alias("host_size"), size.alias("size")
    )
    deepest = own.agg(F.max(F.size(F.split("host", r"\.")))).head()[0] or 1

    # rows that repeat id and url are one row with their number, so that the parts of a range follow from its rows alone
    urls = pages.select(
        F.col(id_col).cast("long").alias("page_id"), host_of(F.col(url_col)).alias("host"), path_of(F.col(url_col)).alias("path")
    ).groupBy("page_id", "host", "path").agg(F.count("*").alias("n"))
    labels = _labels(F.col("host"))
    suffixes = F.transform(F.sequence(F.lit(1), F.least(F.size(labels), F.lit(deepest))), lambda i: _key(F.slice(labels, F.lit(1), i), F.col("path")))
    keyed = urls.select("page_id", "host", "path", "n", F.explode(suffixes).alias("at")).withColumn("at", F.col("at").cast("binary"))
    starts = _starts(keyed, 4 * shuffle_partitions(spark))

    top = "struct<size:int,host_size:int,rule:string,action:string>"
    keyed = _ranged(keyed, starts).withColumn("part", F.pmod(F.xxhash64("page_id", "host", "path"), F.col("parts")).cast("int"))
    keyed = keyed.select("bucket", "part", "at", F.lit(1).alias("url"), "page_id", "host", "path", "n", F.lit(None).cast(top).alias("top"))
    edges = _ranged(_boundaries(own), starts)
    last = edges.groupBy("bucket").agg(F.max_by("top", "at").alias("last"))
    before = Window.orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    opened = spark.range(len(starts)).select(F.col("id").cast("int").alias("bucket")).join(last, "bucket", "left").select(
        "bucket", F.last("last", ignorenulls=True).over(before).alias("top")
    )
    parts = F.array(*(F.lit(n) for _, n in starts))
    opened = opened.select("bucket", F.lit(b"").alias("at"), F.col("top").cast(top).alias("top"), F.element_at(parts, F.col("bucket") + 1).alias("parts"))
    edges = edges.select("bucket", "at", F.col("top").cast(top).alias("top"), "parts").unionByName(opened)
    absent = [F.lit(None).cast(kind).alias(name) for name, kind in (("page_id", "long"), ("host", "string"), ("path", "string"), ("n", "long"))]
    edges = edges.select("bucket", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), "at", F.lit(0).alias("url"), *absent, "top")

    sweep = Window.partitionBy("bucket", "part").orderBy(
        "at", "url", F.col("top.size").asc_nulls_first()
    ).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    met = keyed.unionByName(edges).withColumn("best", F.last("top", ignorenulls=True).over(sweep)).where("url = 1")
    out = met.groupBy("page_id", "host", "path").agg(F.max("best").alias("best"), F.max("n").alias("n"))
    out = out.withColumn("block", F.explode(F.expr(f"sequence(0L, n - 1, {COPIES}L)")))
    out = out.withColumn("copy", F.explode(F.expr(f"sequence(1L, least({COPIES}L, n - block))")))
    return out.select(F.col("page_id").alias(id_col), "host", "path", F.col("best.rule").alias("rule"), F.coalesce("best.action", F.lit(default)).alias("verdict"))
