"""Writers: publish by rename, tables of totals, content-addressed and keyed tables."""

from __future__ import annotations

import hashlib
import uuid
import zlib
from collections.abc import Iterator, Mapping

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators.votes import upsert
from tessera.session import new_folder, remove, shuffle_partitions
from tessera.sources.containers import PORTION, system_of
from tessera.sources.publishing import HashedParquet, manifest


def _system(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    place = jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), place, jvm


def publish(df: DataFrame, target: str, kind: str = "parquet", **options: str) -> str:
    """Write beside the target and rename last, so that a target is whole or absent; one that exists is refused. Each
    attempt has a staging folder of its own."""
    spark = df.sparkSession
    system, place, jvm = _system(spark, target)
    if system.exists(place):
        raise FileExistsError(target)
    staging = f"{target.rstrip('/')}.staging-{uuid.uuid4().hex}"
    df.write.mode("overwrite").format(kind).options(**options).save(staging)
    if not system.rename(jvm.org.apache.hadoop.fs.Path(staging), place):
        raise OSError(f"{staging} could not be renamed")
    return target


def export_csv(df: DataFrame, target: str) -> str:
    """A table of totals as one CSV file with a header; for results of bounded size."""
    return publish(df.coalesce(1), target, "csv", header="true")


def append_new(df: DataFrame, target: str, key: str) -> int:
    """Append rows whose key is not there yet; the number of rows appended. What is there is never rewritten, and a call
    that is made again finds nothing to add. For one writer at a time."""
    spark = df.sparkSession
    system, place, _ = _system(spark, target)
    fresh = df.dropDuplicates([key])
    if system.exists(place):
        fresh = fresh.join(spark.read.parquet(target).select(key), key, "left_anti")
    staged = new_folder(spark, "append")
    fresh.write.parquet(staged)
    rows = spark.read.parquet(staged)
    n = rows.count()
    if n:
        rows.write.mode("append").parquet(target)
    return n


def merge_queue(old: DataFrame, new: DataFrame, key: list[str], target: str) -> str:
    """The queue with new entries in place of old ones of the same key, published as a new version."""
    return publish(upsert(old, new, key), target)


def output_hashes(spark: SparkSession, folder: str) -> DataFrame:
    """``path, bytes, sha256`` of all files of a result, to hold them against its manifest. Files are read in portions, so
    they can be of any size."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = []
            for path in b.column(0).to_pylist():
                system, place = system_of(path)
                digest = hashlib.sha256()
                with system.open_input_stream(place) as raw:
                    while part := raw.read(PORTION):
                        digest.update(part)
                found.append(digest.hexdigest())
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(found, pa.string())], ["path", "bytes", "sha256"])

    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder).select("path", F.col("length").alias("bytes"))
    dealt = files.repartition(shuffle_partitions(spark), "path")  # large files aren't split, but lie in tasks of their own
    return dealt.mapInArrow(run, "path string, bytes long, sha256 string")


def append_events(rows: DataFrame, folder: str, batch: int) -> bool:
    """Append a batch of events as JSON lines; a batch whose write was completed is not written again."""
    path = f"{folder.rstrip('/')}/batch={batch}"
    system, mark, _ = _system(rows.sparkSession, f"{path}/_SUCCESS")
    if system.exists(mark):
        return False
    rows.write.mode("overwrite").json(path)
    return True


def store_contents(rows: DataFrame, folder: str, key: str = "sha256", size: str = "bytes") -> int:
    """Contents by their digest: each is kept once; one whose size is not that of what has its digest is refused."""
    spark = rows.sparkSession
    system, place, _ = _system(spark, folder)
    if system.exists(place):
        there = spark.read.parquet(folder).select(F.col(key).alias("_k"), F.col(size).alias("_s"))
        if not rows.join(there, (F.col(key) == F.col("_k")) & (F.col(size) != F.col("_s"))).isEmpty():
            raise ValueError("a content differs from what is stored under its digest")
    return append_new(rows, folder, key)


def resolve(queue: DataFrame, passed: DataFrame, decided: DataFrame, key: str) -> DataFrame:
    """The queue without the entries that passed since, and with those that a person decided marked so."""
    done = decided.select(F.col(key).alias("_k")).distinct()
    out = queue.join(passed.select(key), key, "left_anti").join(done, F.col(key) == F.col("_k"), "left")
    return out.withColumn("status", F.when(F.col("_k").isNotNull(), "decided").otherwise(F.col("status"))).drop("_k")


def raster_rows(px: DataFrame, value: str) -> DataFrame:
    """A raster as a row per line: ``y``, the places ``xs`` that have a value, ascending, and their values."""
    places = F.array_sort(F.collect_list(F.struct("x", value)))
    return px.groupBy("y").agg(places.alias("p")).select("y", F.col("p.x").alias("xs"), F.col(f"p.{value}").alias(value))


def publish_all(tables: Mapping[str, DataFrame], target: str) -> str:
    """Several tables published as one folder: staged, files hashed by the tasks that write them, the manifest written
    last, then renamed. Nothing is read again. A target that exists is refused; a failed attempt leaves nothing."""
    spark = next(iter(tables.values())).sparkSession
    system, place, jvm = _system(spark, target)
    if system.exists(place):
        raise FileExistsError(target)
    spark.dataSource.register(HashedParquet)
    staging = f"{target.rstrip('/')}.staging-{uuid.uuid4().hex}"
    try:
        noted = None
        for name, df in tables.items():
            df.write.format("hashed_parquet").mode("append").save(f"{staging}/{name}")
            part = manifest(spark, f"{staging}/{name}").withColumn("output", F.lit(name))
            noted = part if noted is None else noted.unionByName(part)
        noted.coalesce(1).write.json(f"{staging}/manifest")
        if not system.rename(jvm.org.apache.hadoop.fs.Path(staging), place):
            raise OSError(f"{staging} could not be renamed")
    except Exception:
        remove(spark, staging)
        raise
    return target


def read_published(spark: SparkSession, folder: str, schemas: Mapping[str, object], total: str) -> DataFrame:
    """Per output of a published folder: its rows, whether all its files are as the manifest says, and a column's sum."""
    noted = spark.read.schema("output string, path string, bytes long, sha256 string").json(f"{folder}/manifest")
    out = None
    for name, schema in schemas.items():
        there = output_hashes(spark, f"{folder}/{name}").where(F.col("path").endswith(".parquet")).select(
            F.regexp_extract("path", r"([^/]+)$", 1).alias("_p"), F.col("sha256").alias("_s")
        )
        same = noted.where(F.col("output") == name).join(there, F.col("path") == F.col("_p"), "full_outer").agg(
            F.coalesce(F.bool_and(F.coalesce(F.col("sha256") == F.col("_s"), F.lit(False))), F.lit(False)).alias("verified")
        )
        sums = spark.read.schema(schema).parquet(f"{folder}/{name}").agg(F.count("*").alias("rows"), F.sum(total).alias(total))
        # one row each
        part = sums.join(F.broadcast(same)).select(F.lit(name).alias("output"), "rows", "verified", total)
        out = part if out is None else out.unionByName(part)
    return out


def _chunk(kind: bytes, body: bytes) -> bytes:
    return len(body).to_bytes(4, "big") + kind + body + zlib.crc32(kind + body).to_bytes(4, "big")


def png_images(px: DataFrame, by: str, value: str, width: int, height: int, band: int = 64, background: int = 0) -> DataFrame:
    """``(image, png)``: grey images encoded band by band; only a band's pixels are ever held as an array.

    Each band is compressed by itself up to a full flush, so bands follow each other in one stream; the stream's check
    sum is put together from the bands' own. Places without a pixel get the background.
    """

    def encode(pdf: pd.DataFrame) -> pd.DataFrame:
        top = int(pdf["band"].iloc[0]) * band
        rows = np.zeros((min(band, height - top), width + 1), np.uint8)
        rows[:, 1:] = background
        there = pdf["x"].notna()
        rows[pdf["y"][there].astype(int) - top, pdf["x"][there].astype(int) + 1] = pdf["v"][there].clip(0, 255).astype(np.uint8)
        raw, deflate = rows.tobytes(), zlib.compressobj(6, zlib.DEFLATED, -15)
        return pd.DataFrame({"image": [str(pdf["image"].iloc[0])], "band": [int(pdf["band"].iloc[0])], "data": [deflate.compress(raw) + deflate.flush(zlib.Z_FULL_FLUSH)], "check": [zlib.adler32(raw)], "size": [len(raw)]})

    def assemble(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf, a, b = pdf.sort_values("band"), 1, 0
        for check, size in zip(pdf["check"].tolist(), pdf["size"].tolist(), strict=True):
            low, high = check & 0xFFFF, check >> 16
            a, b = (a + low - 1) % 65521, (b + high + size * (a - 1)) % 65521
        header = width.to_bytes(4, "big") + height.to_bytes(4, "big") + bytes([8, 0, 0, 0, 0])
        parts = [b"\x89PNG\r\n\x1a\n", _chunk(b"IHDR", header), _chunk(b"IDAT", b"\x78\x9c")]
        parts += [_chunk(b"IDAT", x) for x in pdf["data"]]
        parts += [_chunk(b"IDAT", b"\x03\x00" + (b << 16 | a).to_bytes(4, "big")), _chunk(b"IEND", b"")]
        return pd.DataFrame({"image": [pdf["image"].iloc[0]], "png": [b"".join(parts)]})

    inside = px.where(F.col("x").between(0, width - 1) & F.col("y").between(0, height - 1)).select(
        F.col(by).cast("string").alias("image"), F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y"),
        F.col(value).cast("double").alias("v")
    )
    # every band is there, also one without pixels
    none = F.lit(None).cast("double")
    empty = inside.select("image").distinct().select(
        "image", F.explode(F.sequence(F.lit(0), F.lit((height - 1) // band))).alias("band"), none.alias("x"), none.alias("y"), none.alias("v")
    )
    rows = inside.withColumn("band", F.floor(F.col("y") / band).cast("int")).select("image", "band", "x", "y", "v").unionByName(empty)
    bands = rows.groupBy("image", "band").applyInPandas(encode, "image string, band int, data binary, check long, size long")
    return bands.groupBy("image").applyInPandas(assemble, "image string, png binary")
