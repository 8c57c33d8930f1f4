"""SimHash near-duplicates by meet-in-the-middle ball hashing."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations, islice

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.portions import slices
from tessera.operators.graph import connected_components
from tessera.session import Scratch, shuffle_partitions, stored

PIECE = 50_000


def split(text: str | None) -> list[bytes]:
    """The words of a text: A-Z lower-cased, ended by ASCII white space."""
    return (text or "").encode("utf-8", "surrogatepass").lower().split()


def joined(parts: list[bytes], words: int) -> Iterator[bytes]:
    """All runs of so many words in order, repeats included; fewer words are one run."""
    if len(parts) < words:
        return iter([b" ".join(parts)])
    return map(b" ".join, zip(*(islice(parts, i, None) for i in range(words)), strict=False))


def fingerprint(text: str | None, words: int = 3, seed: int = 42) -> int:
    """The signed 64-bit SimHash of a text's word shingles, repeats included.

    A-Z are lower-cased, words end at ASCII white space; a text of fewer words is one shingle, one without words
    gives zero. A bit is set if more than half of the shingles' XXH64 values have it.
    """
    parts = split(text)
    if not parts:
        return 0
    shingles, votes, n, hashed = joined(parts, words), np.zeros(64, np.int64), 0, xxhash.xxh64_intdigest
    while block := [hashed(x, seed) for x in islice(shingles, PIECE)]:
        votes += np.unpackbits(np.array(block, dtype=">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
        n += len(block)
        if len(block) < PIECE:
            break
    return int(np.packbits(2 * votes > n).view(">i8")[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 3) -> DataFrame:
    """``(doc_id, fp)``, a row per document; a null text counts as empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, 1):
            out = np.fromiter((fingerprint(x, words) for x in b.column(1).to_pylist()), np.int64, b.num_rows)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out)], ["doc_id", "fp"])

    return docs.select(
        F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")
    ).mapInArrow(run, "doc_id long, fp long")


def ball(radius: int) -> list[int]:
    """The signed 64-bit masks of at most so many bits."""
    masks = [sum(1 << b for b in bits) for n in range(radius + 1) for bits in combinations(range(64), n)]
    return [m - (1 << 64) if m >> 63 else m for m in masks]


def links(prints: DataFrame, radius: int = 2) -> DataFrame:
    """Links ``(src, dst)`` that join all fingerprints (column ``fp``, distinct) within an even radius.

    Every fingerprint emits its variants within half the radius. Fingerprints that meet on a variant are at most the
    radius apart, and any two within the radius meet on one, so each bucket is linked as a star on its least member:
    the same components as all its pairs, with a row per member. A bucket holds no more than one ball of distinct
    fingerprints (65 for radius 2), however many documents share them.
    """
    if radius % 2 or radius < 0:
        raise ValueError("the radius must be even")
    masks = ",".join("-9223372036854775807L - 1L" if m == -(1 << 63) else f"{m}L" for m in ball(radius // 2))
    # a row becomes a ball of rows, so few rows are dealt to many tasks first
    prints = prints.repartition(shuffle_partitions(prints.sparkSession), "fp")
    variants = prints.select("fp", F.explode(F.expr(f"transform(array({masks}), m -> fp ^ m)")).alias("variant"))
    low = F.expr("min(fp) over (partition by variant)")
    met = variants.select("fp", low.alias("low")).where("fp <> low")
    return met.distinct().where(F.expr(f"bit_count(fp ^ low) <= {radius}")).select(F.col("low").alias("src"), F.col("fp").alias("dst"))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", radius: int = 2, words: int = 3) -> DataFrame:
    """One row ``(doc_id, fingerprint, component_id)`` per document.

    Documents link if their fingerprints differ in at most ``radius`` bits; component_id is the least id reachable.
    Null texts count as empty, repeated rows stay, a null id gets a row whose component counts only the other ids
    (null if there are none), an empty table gives no rows; other columns are not read.
    """
    keep = Scratch(docs.sparkSession)
    own, _ = stored(fingerprints(docs, id_col, text_col, words), "prints", gather=False)
    distinct = keep.keep(own.groupBy("fp").agg(F.min("doc_id").alias("least")))
    members = connected_components(links(distinct.select("fp"), radius)).withColumnRenamed("node", "fp")
    # stored, so that a component with most of the fingerprints, and a fingerprint with most of the rows, can be split
    linked = keep.keep(distinct.join(members, "fp", "left").select("fp", "least", F.coalesce("component", "fp").alias("component")))
    least = keep.keep(linked.groupBy("component").agg(F.min("least").alias("component_id")))
    groups, _ = stored(linked.join(least, "component").select(F.col("fp").alias("print"), "component_id"), "groups")
    keep.clear()
    out = own.join(groups, own["fp"] == groups["print"])
    return out.select(F.col("doc_id").alias(id_col), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
