"""A sink that knows what it wrote: tasks hash files while they write them, the driver's commit writes the manifest last."""

from __future__ import annotations

import hashlib
import io
import json
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.fs
import pyarrow.parquet as pq
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage
from pyspark.sql.types import StructType

from tessera.sources.containers import system_of

#: Readers of the folder pass over names that begin like this.
MANIFEST = "_manifest.json"


@dataclass
class Written(WriterCommitMessage):
    """One file: its name, rows, size and digest."""

    path: str
    rows: int
    bytes: int
    sha256: str


def manifest(spark: SparkSession, folder: str) -> DataFrame:
    """``(path, rows, bytes, sha256)``, a row for each file that a commit wrote; a folder without a commit is an error."""
    system, place = system_of(folder)
    with system.open_input_stream(f"{place}/{MANIFEST}") as raw:
        lines = [json.loads(x) for x in raw.read().splitlines()]
    return spark.createDataFrame([(x["path"], x["rows"], x["bytes"], x["sha256"]) for x in lines], "path string, rows long, bytes long, sha256 string")


class Hashing(io.RawIOBase):
    """An output that hashes and counts what passes through it."""

    def __init__(self, to: pa.NativeFile):
        self.to, self.digest, self.n = to, hashlib.sha256(), 0

    def writable(self) -> bool:
        return True

    def write(self, data) -> int:
        data = memoryview(data).cast("B")
        self.to.write(data)
        self.digest.update(data)
        self.n += len(data)
        return len(data)


class HashedParquet(DataSource):
    """``df.write.format("hashed_parquet").mode("append").save(folder)``: Parquet files and a manifest of them, into a
    folder that is not there or empty. Without the manifest the folder isn't whole."""

    @classmethod
    def name(cls) -> str:
        return "hashed_parquet"

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceArrowWriter:
        return HashedParquetWriter(self.options["path"])


class HashedParquetWriter(DataSourceArrowWriter):
    def __init__(self, folder: str):
        self.folder = folder

    def write(self, iterator: Iterator[pa.RecordBatch]) -> WriterCommitMessage:
        """One file for a task, under a name that no other attempt has; a task that fails takes its file away."""
        system, place = system_of(self.folder)
        name = f"part-{uuid.uuid4().hex}.parquet"
        out, rows = None, 0
        try:
            for b in iterator:
                if out is None:
                    system.create_dir(place, recursive=True)
                    raw = system.open_output_stream(f"{place}/{name}")
                    hashing = Hashing(raw)
                    out = pq.ParquetWriter(pa.PythonFile(hashing, mode="w"), b.schema, compression="snappy")
                out.write_batch(b)
                rows += b.num_rows
            if out is None:
                return WriterCommitMessage()
            out.close()
            raw.close()
        except BaseException:
            if out is not None:
                raw.close()
                system.delete_file(f"{place}/{name}")
            raise
        return Written(name, rows, hashing.n, hashing.digest.hexdigest())

    def commit(self, messages: list[WriterCommitMessage | None]) -> None:
        """The manifest, after all files; what a task that was killed left behind is removed."""
        system, place = system_of(self.folder)
        system.create_dir(place, recursive=True)
        written = sorted((m for m in messages if isinstance(m, Written)), key=lambda m: m.path)
        names = {m.path for m in written}
        for info in system.get_file_info(pa.fs.FileSelector(place)):
            if info.type == pa.fs.FileType.File and info.base_name not in names:
                system.delete_file(info.path)
        with system.open_output_stream(f"{place}/{MANIFEST}") as out:
            for m in written:
                out.write((json.dumps({"path": m.path, "rows": m.rows, "bytes": m.bytes, "sha256": m.sha256}) + "\n").encode())

    def abort(self, messages: list[WriterCommitMessage | None]) -> None:
        system, place = system_of(self.folder)
        if system.get_file_info(place).type == pa.fs.FileType.Directory:
            system.delete_dir(place)
