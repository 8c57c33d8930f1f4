"""Vector codes: product quantization by Lloyd rounds that skip scans with Hamerly's two bounds."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tessera.session import Scratch, remove, small, stored

#: Distances that are held at once: some 16 MB.
AT_ONCE = 1 << 21
STATE = "code array<smallint>, upper array<float>, lower array<float>, scanned int"


def components(vectors: DataFrame, scale: float = 256, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """``(vec_id, label, v)`` of the vectors that take part, v the integers ``floor(scale * x)``.

    Null vectors and those with null or non-finite components take no part. Integers are clipped to a power of two that
    depends on the number d of components (2^27 for 64), so that d squared differences fit 64 bits.
    """
    v = F.col("v")
    odd = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    bits = F.length(F.bin(F.greatest(F.lit(1), F.size(v) - 1)))
    most = F.pow(F.lit(2.0), F.floor((62 - bits) / 2) - 1)
    own = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(label_col).alias("label"), F.col(vector_col).cast("array<double>").alias("v"))
    own = own.where(v.isNotNull() & ~odd).select("*", most.alias("most"))
    # clipped as doubles: a finite component can be too large for an integer of any size
    cut = F.transform(v, lambda x: F.floor(F.greatest(-F.col("most"), F.least(F.col("most"), x * scale))).cast("int"))
    return own.select("vec_id", "label", cut.alias("v"))


def squares(x: np.ndarray, entries: np.ndarray) -> np.ndarray:
    """Exact squared distances of int64 rows to entries, (n, entries)."""
    top = max(int(np.abs(x).max(initial=0)), int(np.abs(entries).max(initial=0)))
    if 4 * x.shape[1] * top * top < 1 << 53:  # every sum is an integer that doubles hold
        a, b = x.astype(float), entries.astype(float)
        return ((a * a).sum(axis=1)[:, None] - 2 * (a @ b.T) + (b * b).sum(axis=1)).astype(np.int64)
    return np.stack([((x - e) ** 2).sum(axis=1) for e in entries], axis=1)


def above(square: np.ndarray) -> np.ndarray:
    """A float that is no less than the root of each integer: a step up after either rounding. Zero stays."""
    root = np.nextafter(np.nextafter(np.sqrt(square.astype(float)), np.inf).astype(np.float32), np.float32(np.inf))
    return np.where(square == 0, np.float32(0), root)


def below(square: np.ndarray) -> np.ndarray:
    """A float that is no more than the root of each integer."""
    return np.nextafter(np.nextafter(np.sqrt(square.astype(float)), -np.inf).astype(np.float32), np.float32(-np.inf))


def scan(x: np.ndarray, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Each row's nearest entry (ties to the lower index), an upper bound of its distance, and a lower bound of the
    distance of the second nearest (infinite without one)."""
    n, k = len(x), len(entries)
    code, upper, lower = np.zeros(n, np.int64), np.zeros(n, np.float32), np.full(n, np.inf, np.float32)
    step = max(1, AT_ONCE // k)
    for i in range(0, n, step):
        far, rows = squares(x[i : i + step], entries), slice(i, i + step)
        code[rows] = far.argmin(axis=1)  # the first of equals
        upper[rows] = above(far.min(axis=1))
        if k > 1:
            lower[rows] = below(np.partition(far, 1, axis=1)[:, 1])
    return code, upper, lower


def rescan(x: np.ndarray, old: np.ndarray, new: np.ndarray, code: np.ndarray, upper: np.ndarray, lower: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The same for the rows of one part after its entries moved from ``old`` to ``new``; and which rows were scanned.

    The upper bound grows by what the own entry moved, the lower one falls by the most that another one did. Only where
    they aren't strictly apart, also with the exact distance as upper bound, all entries are scanned: bounds never
    decide a tie, so it goes to the lower index.
    """
    moved = above(((new - old) ** 2).sum(axis=1))
    order = np.argsort(-moved, kind="stable")
    others = np.full(len(new), moved[order[0]], np.float32)
    others[order[0]] = moved[order[1]] if len(new) > 1 else 0
    code, upper = code.copy(), np.nextafter(upper + moved[code], np.float32(np.inf))
    lower = np.nextafter(lower - others[code], np.float32(-np.inf))
    near = np.flatnonzero(~(upper < lower))
    upper[near] = above(((x[near] - new[code[near]]) ** 2).sum(axis=1))
    near = near[~(upper[near] < lower[near])]
    if len(near):
        code[near], upper[near], lower[near] = scan(x[near], new)
    return code, upper, lower, near


def _cut(flat: np.ndarray, n: int, d: int, parts: int) -> np.ndarray:
    """(n, parts, width): zeros are appended until parts are equal and not empty."""
    width = max(1, -(-d // parts))
    return np.pad(flat.astype(np.int64).reshape(n, d), ((0, 0), (0, width * parts - d))).reshape(n, parts, width)


def _values(b: pa.RecordBatch, name: str) -> np.ndarray:
    return b.column(b.schema.get_field_index(name)).flatten().to_numpy(zero_copy_only=False)


def _lists(x: np.ndarray, kind: pa.DataType) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.arange(0, x.size + 1, x.shape[1]), pa.int32()), pa.array(x.ravel(), kind))


def _assigned(b: pa.RecordBatch, books: list[np.ndarray], d: int) -> tuple[np.ndarray, ...]:
    """A batch's parts, codes, bounds and how many parts of each row were scanned. With one codebook all are; with two,
    the batch holds the codes and bounds of the first."""
    parts, n = len(books[-1]), b.num_rows
    x = _cut(_values(b, "v"), n, d, parts)
    code, scanned = np.zeros((n, parts), np.int64), np.zeros(n, np.int32)
    upper, lower = np.zeros((n, parts), np.float32), np.zeros((n, parts), np.float32)
    if len(books) == 1:
        for p in range(parts):
            code[:, p], upper[:, p], lower[:, p] = scan(x[:, p], books[0][p])
        return x, code, upper, lower, scanned + parts
    was = [_values(b, c).reshape(n, parts) for c in ("code", "upper", "lower")]
    for p in range(parts):
        code[:, p], upper[:, p], lower[:, p], rows = rescan(x[:, p], books[0][p], books[1][p], *(w[:, p] for w in was))
        scanned[rows] += 1
    return x, code, upper, lower, scanned


def assign(rows: DataFrame, books: list[np.ndarray], d: int) -> DataFrame:
    """Rows ``(vec_id, label, v)`` with each part's nearest entry in the last of ``books`` (parts, entries, width), its
    bounds and ``scanned``. With two books, the rows are this function's for the first one."""
    shared = rows.sparkSession.sparkContext.broadcast(books)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                _, code, upper, lower, scanned = _assigned(b, shared.value, d)
                lists = [_lists(x, k) for x, k in ((code, pa.int16()), (upper, pa.float32()), (lower, pa.float32()))]
                yield pa.RecordBatch.from_arrays([*b.columns[:3], *lists, pa.array(scanned)], ["vec_id", "label", "v", "code", "upper", "lower", "scanned"])

    return rows.mapInArrow(run, StructType(rows.schema.fields[:3] + StructType.fromDDL(STATE).fields))


def moved_entries(rows: DataFrame, book: np.ndarray, d: int) -> np.ndarray:
    """The codebook with each entry replaced by ``floor(sum / count)`` of its parts, component by component; unused
    entries stay. Each task sums its own rows; what reaches the driver has a row for each entry."""
    parts, k, width = book.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, count = np.zeros((parts, k, width), np.int64), np.zeros((parts, k), np.int64)
        for b in batches:
            if b.num_rows:
                x, code = _cut(_values(b, "v"), b.num_rows, d, parts), _values(b, "code").reshape(b.num_rows, parts)
                for p in range(parts):
                    np.add.at(total[p], code[:, p], x[:, p])
                    count[p] += np.bincount(code[:, p], minlength=k)
        p, e = np.nonzero(count)
        if len(p):
            yield pa.RecordBatch.from_arrays([pa.array(p, pa.int32()), pa.array(e, pa.int32()), pa.array(count[p, e]), _lists(total[p, e], pa.int64())], ["part", "entry", "n", "sums"])

    partial = rows.select("v", "code").mapInArrow(run, "part int, entry int, n long, sums array<bigint>")
    sums = F.array(*(F.sum(F.col("sums")[i]) for i in range(width)))
    out = book.copy()
    for r in partial.groupBy("part", "entry").agg(F.sum("n").alias("n"), sums.alias("sums")).collect():
        out[r.part, r.entry] = [s // r.n for s in r.sums]
    return out


def _coded(rows: DataFrame, d: int, parts: int, entries: int, rounds: int) -> DataFrame:
    """``(vec_id, label, code, error, codebooks_sha256)`` of rows that all have d components."""
    first = rows.orderBy(F.col("vec_id").asc_nulls_last(), "v").limit(entries).select("v").collect()
    books = [np.ascontiguousarray(_cut(np.array([r.v for r in first]), len(first), d, parts).transpose(1, 0, 2))]
    folder = None
    for _ in range(rounds):
        rows, made = stored(assign(rows, books, d), "codes")
        if folder:
            remove(rows.sparkSession, folder)
        folder, books = made, [books[-1], moved_entries(rows, books[-1], d)]
    digest = hashlib.sha256(",".join(map(str, books[-1].ravel().tolist())).encode()).hexdigest()
    shared = rows.sparkSession.sparkContext.broadcast(books)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                x, code, *_ = _assigned(b, shared.value, d)
                own = shared.value[-1][np.arange(parts), code]
                text, wide = code.astype(np.uint8).tobytes().hex(), 2 * parts
                yield pa.RecordBatch.from_arrays(
                    [*b.columns[:2], pa.array([text[i * wide : (i + 1) * wide] for i in range(len(code))]), pa.array(((x - own) ** 2).sum(axis=(1, 2)))],
                    ["vec_id", "label", "code", "error"]
                )

    kind = StructType(rows.schema.fields[:2]).add("code", "string").add("error", "long")
    out, _ = stored(rows.mapInArrow(run, kind).withColumn("codebooks_sha256", F.lit(digest)), "coded")
    if folder:
        remove(rows.sparkSession, folder)
    return out


def compress(vectors: DataFrame, parts: int = 16, entries: int = 64, rounds: int = 2, scale: float = 256, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """``(vec_id, code, error, label_error, codebooks_sha256)``: a row for each vector that takes part.

    Components become integers, vectors are cut into equal consecutive parts, and each part position has a codebook of
    its own. It starts as that part of the vectors of the least ids; each round assigns every part to the nearest entry
    (ties to the lower index) and moves each entry to the floor of its parts' mean; last all parts are assigned again.
    All distances are exact integers. Between rounds a row keeps its codes and two bounds a part, and is compared with
    all entries only where the bounds say nothing. What is held and broadcast is two codebooks, whatever the table.

    ``code`` has two hex digits a part, ``error`` the squared distances summed, ``label_error`` these summed over equal
    labels (nulls are equal; the largest long, should it be more), ``codebooks_sha256`` the digest of all entries.

    Null vectors and those with null or non-finite components are left out; components beyond the range that
    ``components`` states are clipped. Vectors of each length are coded by themselves, with codebooks of their own, in
    one run a length; if parts can't be equal, zeros are appended. Rows without an id are coded and come last among
    those that start a codebook; equal ids start it by their components; repeated rows each count; with fewer vectors
    than entries there are as many entries as vectors. Empty tables give no rows; other columns are not read.
    """
    if not 1 <= entries <= 256 or parts < 1:
        raise ValueError("an index must fit two hex digits, and there must be parts")
    keep = Scratch(vectors.sparkSession)
    whole = keep.keep(components(vectors, scale, id_col, vector_col, label_col), "components")
    lengths = sorted(r[0] for r in whole.select(F.size("v").alias("d")).distinct().collect())
    coded = [_coded(whole.where(F.size("v") == d), d, parts, entries, rounds) for d in lengths]
    if coded:
        rows = reduce(DataFrame.unionByName, coded)
    else:
        rows = whole.select("vec_id", "label", F.lit("").alias("code"), F.lit(0).cast("long").alias("error"), F.lit("").alias("codebooks_sha256"))
        rows = rows.sparkSession.createDataFrame([], rows.schema)
    sums = rows.groupBy(F.col("label").alias("of")).agg(F.least(F.sum(F.col("error").cast("decimal(19,0)")), F.lit((1 << 63) - 1)).cast("long").alias("label_error"))
    sums, _ = stored(sums, "labels")
    keep.clear()
    joined = rows.join(small(sums), F.col("label").eqNullSafe(F.col("of")))
    return joined.select(F.col("vec_id").alias(id_col), "code", "error", "label_error", "codebooks_sha256")
