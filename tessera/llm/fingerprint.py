"""Document fingerprints: a quartile bucket digest of hashed byte triplets."""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.portions import slices
from tessera.session import shuffle_partitions

BUCKETS = 256
#: The places of a triplet's second and third byte after its first: all that fit into five bytes.
SHAPES = ((1, 2), (1, 3), (2, 3), (1, 4), (2, 4), (3, 4))
#: What two unrelated digests differ by on average: the bound of the difference score.
BOUND = 416
STEP = 1 << 20


def _mixed(seed: int, n: int) -> np.ndarray:
    """n well-mixed bytes: the top byte of a multiply-xorshift sequence."""
    x = (np.arange(1, n + 1, dtype=np.uint64) + np.uint64(seed * 1000)) * np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return (x >> np.uint64(56)).astype(np.uint8)


FIRST, SECOND = _mixed(1, 256), _mixed(2, 256)
THIRD = [_mixed(3 + i, 256) for i in range(len(SHAPES))]
#: Score of two quartile codes by their distance.
APART = np.array([0, 1, 2, 6])


def bucket_counts(data: bytes) -> np.ndarray:
    """How many triplets of the bytes fall in each bucket; long inputs are taken in pieces of bounded size."""
    counts = np.zeros(BUCKETS, np.int64)
    for low in range(0, len(data), STEP):
        part = np.frombuffer(data, np.uint8, min(STEP + 4, len(data) - low), low)
        x, y = FIRST[part], SECOND[part]
        for (j, k), table in zip(SHAPES, THIRD, strict=True):
            n = min(STEP, len(part) - k)
            if n > 0:
                counts += np.bincount(x[:n] ^ y[j : j + n] ^ table[part[k : k + n]], minlength=BUCKETS)
    return counts


def digest(text: str | None) -> str:
    """136 hex digits: length code (2), the lower quartiles' shares of the upper (1 each), spare (4), codes (128)."""
    data = (text or "").encode("utf-8", "surrogatepass")
    counts = bucket_counts(data)
    ranked = np.sort(counts)
    low, middle, high = (int(ranked[BUCKETS * i // 4 - 1]) for i in (1, 2, 3))
    codes = (counts > low).astype(np.uint8) + (counts > middle) + (counts > high)
    packed = (codes[0::4] << 6) | (codes[1::4] << 4) | (codes[2::4] << 2) | codes[3::4]
    size = min(255, round(8 * math.log2(1 + len(data))))
    part = lambda q: min(15, q * 15 // high) if high else 0
    return f"{size:02x}{part(low):x}{part(middle):x}0000{packed.astype(np.uint8).tobytes().hex()}"


def _parts(fingerprint: str) -> tuple[np.ndarray, np.ndarray]:
    body = np.frombuffer(bytes.fromhex(fingerprint[8:]), np.uint8)
    codes = np.stack([body >> 6, body >> 4 & 3, body >> 2 & 3, body & 3]).astype(np.int16)
    return np.array([int(fingerprint[:2], 16), int(fingerprint[2], 16), int(fingerprint[3], 16)]), codes


def difference(a: str, b: str) -> int:
    """Distance of the codes, plus twice the length codes' distance (up to 64), plus the shares' distances."""
    (head, codes), (head2, codes2) = _parts(a), _parts(b)
    size, *shares = np.abs(head - head2).tolist()
    return int(APART[np.abs(codes - codes2)].sum()) + min(64, 2 * size) + sum(shares)


def likeness(a: str, b: str) -> float:
    """1 for equal digests, 0 from the bound on."""
    return 1.0 if a == b else 1.0 - min(difference(a, b), BOUND) / BOUND


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row ``(id, n_chars, fingerprint)`` per document. A null text counts as empty, a text of any length is read
    whole, repeated rows stay, an empty table gives no rows; other columns are not read."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, 1):
            texts = [x or "" for x in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array(map(len, texts), pa.int64()), pa.array(map(digest, texts), pa.string())], ["k", "n_chars", "fingerprint"]
            )

    out = docs.select(
        F.col(id_col).cast("long").alias("k"), F.col(text_col).cast("string").alias("t")
    ).mapInArrow(run, "k long, n_chars long, fingerprint string")
    return out.withColumnRenamed("k", id_col)


#: Below all text hashes: a bucket that starts with an id starts before all its texts.
BEFORE = -(1 << 63)


def _sampled(counted: DataFrame, m: int) -> list:
    """The keys of a table with counts ``n`` whose hashes are lowest, 64 for each of m parts, ascending."""
    keys = [c for c in counted.columns if c != "n"]
    return sorted(counted.orderBy(F.xxhash64(F.lit(5), *keys), *keys).limit(64 * m).collect())


def _cuts(rows: list, m: float) -> list[int]:
    """How many of the m quantiles of counted rows, ascending, fall on each."""
    total, seen, out = sum(r.n for r in rows), 0, []
    for r in rows:
        out.append(int((seen + r.n) * m // total) - int(seen * m // total))
        seen += r.n
    return out


def _starts(rows: DataFrame, m: int) -> list[tuple[int, int]]:
    """Up to about 2 m keys ``(k, h)``, ascending, that cut the rows into about equal parts: ids alone (h is BEFORE), and
    within ids on which several quantiles fall their texts' hashes.

    They are weighted quantiles of the distinct keys whose hashes are lowest, so what comes to the driver is bounded by
    m; the keys themselves are compared, never rounded. Texts are read only where ids repeat so often.
    """
    counted = rows.groupBy("k").agg(F.count("*").alias("n"))
    low, ids = rows.agg(F.min("k")).head()[0], _sampled(counted, m)
    starts, hot = {(low, BEFORE)} - {(None, BEFORE)}, {}
    for r, n in zip(ids, _cuts(ids, m), strict=True):
        if n:
            starts.add((r.k, BEFORE))
        if n > 1:
            hot[r.k] = n
    if hot:
        texts = rows.where(F.col("k").isin(*hot)).groupBy("k", "h").agg(F.count("*").alias("n"))
        found, least = _sampled(texts, m), {r.k: r.h for r in texts.groupBy("k").agg(F.min("h").alias("h")).collect()}
        for k, n in hot.items():
            own = [r for r in found if r.k == k]
            # an id's least hash starts no bucket of its own: the one that starts with the id would be empty
            starts |= {(k, r.h) for r, cut in zip(own, _cuts(own, n), strict=True) if cut and r.h != least[k]}
    return sorted(starts)


def _dealt(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Documents in buckets in the order of id and text hash, each bucket sorted and followed by the document that comes
    after it.

    A bucket starts at a key of the table (``_starts``). The rows of that key, of which the first starts the bucket, are
    also sent, as guests, to the bucket before; those of the very first to the last bucket. Rows that share an id, or
    have none, are split by their texts' hashes.
    """
    n = shuffle_partitions(docs.sparkSession)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    rows = rows.withColumn("k", F.expr(f"coalesce(doc_id, {_literal(-(1 << 63))})")).withColumn("h", F.xxhash64("text"))
    starts = _starts(rows.select("k", "h"), 4 * n) or [(0, BEFORE)]
    wide = math.isqrt(len(starts) - 1) + 1
    groups = [starts[i : i + wide] for i in range(0, len(starts), wide)]
    array = lambda xs: f"array({','.join(f'struct({_literal(k)} as k, {_literal(h)} as h)' for k, h in xs)})"
    inner = f"element_at(array({','.join(map(array, groups))}), c + 1)"
    rows = rows.withColumn("at", F.struct("k", "h"))
    rows = rows.withColumn("c", F.expr(f"greatest(size(filter({array([g[0] for g in groups])}, v -> v <= at)) - 1, 0)"))
    rows = rows.withColumn("b", F.expr(f"c * {wide} + greatest(size(filter({inner}, v -> v <= at)) - 1, 0)"))
    rows = rows.withColumn("s", F.expr(f"element_at({inner}, b - c * {wide} + 1)"))
    first = F.expr(f"s.k = k and s.h in (h, {_literal(BEFORE)})")
    places = F.array_compact(
        F.array(
            F.struct(F.col("b").alias("bucket"), F.lit(0).alias("guest")),
            F.when(first & (F.col("b") > 0), F.struct((F.col("b") - 1).alias("bucket"), F.lit(1).alias("guest"))),
            F.when(first & (F.col("b") == 0), F.struct(F.lit(len(starts) - 1).alias("bucket"), F.lit(1).alias("guest"))),
        )
    )
    placed = rows.select("doc_id", "k", "h", "text", F.explode(places).alias("p")).select("p.bucket", "p.guest", "k", "h", "doc_id", "text")
    return placed.repartition(n, "bucket").sortWithinPartitions("bucket", "guest", "k", "h", "text")


def _literal(x: int) -> str:
    return "(-9223372036854775807L - 1L)" if x == -(1 << 63) else f"{x}L"


def edited_fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Every whole text's digest beside that of its edited text, whose last quarter is the start of the next document.

    The next document is the next by ascending id (the first after the last). A null id counts as the least 64-bit
    number, equal ids go by their texts' XXH64 as signed numbers (``xxhash64``), then by text; a null text counts as
    empty, texts of any length are taken whole, repeated rows stay and follow each other, a single document is its own
    successor, an empty table gives no rows. Only the id and the text are read, so other columns may have any name.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = before = None
        for b in slices(batches, 3):
            out: list[tuple] = []
            for bucket, guest, doc, text in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if bucket != at:
                    at, before = bucket, None
                elif before is None:
                    continue  # a second guest: rows repeat the first one
                text = text or ""
                now = (doc, text, before[2] if before is not None and before[1] == text else digest(text))
                if before is not None:
                    out.append(_edited(before, now))
                before = None if guest else now
            yield pa.RecordBatch.from_pylist([dict(zip(EDITED.names, x, strict=True)) for x in out], EDITED)

    schema = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    return _dealt(docs, id_col, text_col).select("bucket", "guest", "doc_id", "text").mapInArrow(run, schema).withColumnRenamed("doc_id", id_col)


EDITED = pa.schema([("doc_id", pa.int64()), ("n_chars", pa.int64()), ("edited_sha256", pa.string()), ("fingerprint", pa.string()), ("edited_fingerprint", pa.string()), ("near_edited", pa.float64()), ("near_next", pa.float64())])


def _edited(now: tuple, after: tuple) -> tuple:
    doc, text, own = now
    cut = len(text) // 4
    other = text[: len(text) - cut] + after[1][:cut]
    edited = digest(other)
    return doc, len(text), hashlib.sha256(other.encode("utf-8", "surrogatepass")).hexdigest(), own, edited, likeness(own, edited), likeness(own, after[2])
