"""Readers of journals, sessions, tables of spectra and label images."""

from __future__ import annotations

import io
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tessera.functions import scalar
from tessera.session import small


def tolerant_lines(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """JSON lines in which a bad one becomes an event ``_unparseable_line`` with its text."""
    full = StructType([*schema.fields]).add("_corrupt_record", "string")
    rows = spark.read.schema(full).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_corrupt_record").json(path)
    bad = F.col("_corrupt_record").isNotNull()
    return rows.withColumn("event", F.when(bad, "_unparseable_line").otherwise(F.col("event"))).withColumnRenamed("_corrupt_record", "line_text")


#: What ends each document of a packed file (as in JSON text sequences); JSON can't hold it unescaped.
SEPARATOR = "\x1e"


def pack(documents: DataFrame, folder: str) -> None:
    """Write a column of documents, which may have several lines, as files of many documents each."""
    documents.write.option("lineSep", SEPARATOR).text(folder)


def strict_journals(spark: SparkSession, path: str, schema: str, packed: bool = False) -> DataFrame:
    """Committed events of journals: ``file, line_no, event, torn_tail``. A file is a journal, or ``packed`` with many.

    A last line without a newline is not committed: it is left out and ``torn_tail`` says so. A malformed committed
    line has a null event, which ``assert_clean`` refuses.
    """
    texts = spark.read.option("lineSep", SEPARATOR).text(path) if packed else spark.read.text(path, wholetext=True)
    files = texts.withColumn("file", F.input_file_name())
    parts = files.select("file", F.split("value", "\n").alias("lines"))
    torn = F.element_at("lines", -1) != ""
    lines = parts.select("file", torn.alias("torn_tail"), F.posexplode(F.expr("slice(lines, 1, size(lines) - 1)")).alias("n", "line"))
    return lines.select("file", (F.col("n") + 1).alias("line_no"), F.from_json("line", schema, {"mode": "PERMISSIVE"}).alias("event"), "line", "torn_tail")


def assert_clean(journal: DataFrame, key: str) -> DataFrame:
    """The journal, with the job failing on the first malformed committed line."""
    return journal.withColumn(
        "event",
        F.when(
            F.col(f"event.{key}").isNull(), F.raise_error(F.concat(F.lit("malformed line "), F.col("line_no").cast("string")))
        ).otherwise(F.col("event"))
    )


def sessions(spark: SparkSession, path: str, schema: StructType, packed: bool = False) -> DataFrame:
    """One row per session document; unreadable ones keep their text in ``error``. A file is a document, or ``packed`` with
    many."""
    full = StructType([*schema.fields]).add("error", "string")
    way = ("lineSep", SEPARATOR) if packed else ("multiLine", "true")
    return spark.read.schema(full).option(*way).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "error").json(path).withColumn("file", F.input_file_name())


def spectra_csv(spark: SparkSession, path: str) -> DataFrame:
    """Points of spectra from CSV: energy from the wavelength in column 0, signal in column 3; bad numbers are null."""
    cols = [f"c{i}" for i in range(4)]
    rows = spark.read.option("header", "true").schema(", ".join(f"{c} string" for c in cols)).csv(path)
    return rows.select(
        F.input_file_name().alias("file"), scalar.wavelength_to_energy(F.col("c0").try_cast("double")).alias("x"),
        F.col("c3").try_cast("double").alias("y")
    )


def npy_rasters(spark: SparkSession, path: str, name: str = "label") -> DataFrame:
    """Pixels ``(file, y, x, value)`` of two-dimensional .npy arrays; pickled objects are refused."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for file, content in zip(*(c.to_pylist() for c in b.columns), strict=True):
                a = np.load(io.BytesIO(content), allow_pickle=False)
                if a.ndim != 2:
                    raise ValueError(f"{file}: {a.ndim} dimensions")
                step = max(1, (1 << 18) // max(1, a.shape[1]))
                for top in range(0, a.shape[0], step):
                    part = a[top : top + step]
                    y, x = np.indices(part.shape, dtype=np.int32)
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array([file] * part.size, pa.string()), pa.array((y + top).ravel()), pa.array(x.ravel()),
                            pa.array(part.ravel().astype(np.float64))
                        ],
                        ["file", "y", "x", name]
                    )

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(run, f"file string, y int, x int, {name} double")


def image_pixels(spark: SparkSession, path: str) -> DataFrame:
    """Pixels ``(file, y, x, r, g, b)`` of PNG and JPEG images, grey ones too; the source keeps bytes as blue, green, red
    by rows."""
    img = spark.read.format("image").load(path).select("image.*").where("nChannels in (1, 3, 4)")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for origin, h, w, n, data in zip(*(c.to_pylist() for c in b.columns), strict=True):
                a = np.frombuffer(data, np.uint8).reshape(h, w, n)
                for top in range(0, h, max(1, (1 << 18) // w)):
                    part = a[top : top + max(1, (1 << 18) // w)]
                    y, x = np.indices(part.shape[:2], dtype=np.int32)
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array([origin] * y.size), pa.array((y + top).ravel()), pa.array(x.ravel()),
                            *(pa.array(part[..., c].ravel().astype(np.int32)) for c in ((2, 1, 0) if n > 1 else (0, 0, 0)))
                        ],
                        ["file", "y", "x", "r", "g", "b"]
                    )

    return img.select("origin", "height", "width", "nChannels", "data").mapInArrow(run, "file string, y int, x int, r int, g int, b int")


def palette_labels(pixels: DataFrame, palette: DataFrame) -> DataFrame:
    """Labels by exact colour ``(r, g, b, label)``; a colour that the palette lacks fails the job."""
    out = pixels.join(small(palette), ["r", "g", "b"], "left")
    return out.withColumn(
        "label",
        F.when(F.col("label").isNull(), F.raise_error(F.concat_ws(",", F.lit("unknown colour"), "r", "g", "b"))).otherwise(F.col("label")).cast("int")
    )


def reference_colour(json: Column, default: float = 0.1) -> Column:
    """A reference colour's record as ``(state, mean_rgb, tolerance)``: ``absent`` for null, ``invalid`` if schema, kind,
    values or tolerance are not as they must be, so that a damaged record is not taken for none."""
    r = F.from_json(json, "schema_version int, kind string, mean_rgb array<double>, std_rgb array<double>, tolerance_fraction double")
    channels = lambda c: (F.size(c) == 3) & F.forall(c, lambda v: v.between(0, 255))
    tolerance = F.coalesce(r["tolerance_fraction"], F.lit(default))
    fine = (r["schema_version"] == 1) & (
        r["kind"] == "reference_substrate_colour"
    ) & channels(r["mean_rgb"]) & channels(r["std_rgb"]) & (tolerance > 0) & (tolerance < 1)
    fine = F.coalesce(fine, F.lit(False))
    state = F.when(json.isNull(), "absent").when(fine, "valid").otherwise("invalid")
    return F.struct(state.alias("state"), F.when(fine, r["mean_rgb"]).alias("mean_rgb"), F.when(json.isNotNull() & fine, tolerance).alias("tolerance"))


def spectra(spark: SparkSession, path: str) -> DataFrame:
    """Points ``(file, x, y)`` of spectra by the path's extension: CSV, or Parquet with arrays ``x`` and ``y``."""
    if path.endswith(".csv"):
        return spectra_csv(spark, path)
    if path.endswith(".parquet"):
        return spark.read.parquet(path).select(F.input_file_name().alias("file"), F.inline(F.arrays_zip("x", "y")))
    raise ValueError(f"{path}: only .csv and .parquet are read")


def sheet_spectrum(cells: DataFrame, key: str) -> DataFrame:
    """``(key, x_col, x, y)`` of sheets given as cells ``(key, row, col, text)``.

    The heading is the first of the first three rows with a cell that starts with ``X [``. If the row above it names a
    column ``1-B/A``, the first such one holds x, else the last one headed ``X [``; y is the column after it. Sheets
    without a heading have no rows, cells that are no numbers are left out.
    """
    text = F.trim("text")
    heads = cells.where((F.col("row") < 3) & text.startswith("X [")).groupBy(key).agg(F.min("row").alias("head"))
    top = cells.join(heads, key).where("row between head - 1 and head")
    ratio = F.when((F.col("row") < F.col("head")) & (F.upper(text) == "1-B/A"), F.col("col"))
    last = F.when((F.col("row") == F.col("head")) & text.startswith("X ["), F.col("col"))
    chosen = top.groupBy(key).agg(F.coalesce(F.min(ratio), F.max(last)).alias("x_col"))
    near = cells.join(chosen, key).where("col = x_col or col = x_col + 1").withColumn("value", text.try_cast("double"))
    pick = lambda c: F.max(F.when(F.col("col") == c, F.col("value")))
    return near.groupBy(key, "x_col", "row").agg(
        pick(F.col("x_col")).alias("x"), pick(F.col("x_col") + 1).alias("y")
    ).where("x is not null and y is not null").drop("row")


def limited(rows: DataFrame, by: str, order: str, n: int) -> DataFrame:
    """The first n rows of each group by an order; the limit is kept while groups are sorted."""
    nth = F.row_number().over(Window.partitionBy(by).orderBy(order))
    return rows.withColumn("_n", nth).where(F.col("_n") <= n).drop("_n")


def png_pixels(files: DataFrame, column: str) -> DataFrame:
    """Pixels ``(image, y, x, value)`` of grey 8-bit PNG files whose rows carry no filter, as ``sinks.png_images`` makes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for image, data in zip(*(c.to_pylist() for c in b.columns), strict=True):
                at, parts, wide, high = 8, [], 0, 0
                while at < len(data):
                    size, kind = int.from_bytes(data[at : at + 4], "big"), data[at + 4 : at + 8]
                    body = data[at + 8 : at + 8 + size]
                    if zlib.crc32(kind + body) != int.from_bytes(data[at + 8 + size : at + 12 + size], "big"):
                        raise ValueError(f"{image}: a damaged chunk")
                    if kind == b"IHDR":
                        wide, high = int.from_bytes(body[:4], "big"), int.from_bytes(body[4:8], "big")
                    parts += [body] * (kind == b"IDAT")
                    at += 12 + size
                rows = np.frombuffer(zlib.decompress(b"".join(parts)), np.uint8).reshape(high, wide + 1)
                if rows[:, 0].any():
                    raise ValueError(f"{image}: filtered rows")
                y, x = np.indices((high, wide), dtype=np.int32)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([image] * y.size), pa.array(y.ravel()), pa.array(x.ravel()), pa.array(rows[:, 1:].ravel().astype(np.int32))],
                    ["image", "y", "x", "value"]
                )

    return files.select("image", column).mapInArrow(run, "image string, y int, x int, value int")
