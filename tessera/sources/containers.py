"""Archives read by ranges: members are listed from central directories, filtered as rows, and read where they lie."""

from __future__ import annotations

import io
import struct
import zipfile
import zlib
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.session import stored

#: Bytes that are read or held at once, and compressed bytes for a task.
PORTION, TASK = 8 << 20, 64 << 20
LISTED = "container string, member string, bytes long, compressed long, crc long, method int, flags int, offset long"


def system_of(path: str) -> tuple[pa.fs.FileSystem, str]:
    """The file system of a path or URI and the place in it; one that pyarrow can't open is an error."""
    if path.startswith("file:"):
        path = "/" + path.removeprefix("file:").lstrip("/")
    return (pa.fs.LocalFileSystem(), path) if path.startswith("/") else pa.fs.FileSystem.from_uri(path)


class Ended(io.RawIOBase):
    """A file to read, of which a place before its begin is an OSError, as zipfile expects when it looks for the end of an
    archive that has no members; pyarrow's own error is another."""

    def __init__(self, raw: pa.NativeFile):
        self.raw = raw

    def readable(self) -> bool:
        return True

    def seekable(self) -> bool:
        return True

    def readinto(self, to) -> int:
        return self.raw.readinto(to)

    def tell(self) -> int:
        return self.raw.tell()

    def seek(self, offset: int, whence: int = io.SEEK_SET) -> int:
        try:
            return self.raw.seek(offset, whence)
        except pa.ArrowInvalid as e:
            raise OSError(str(e)) from e


def members(spark: SparkSession, path: str) -> DataFrame:
    """The members of zip archives, without their contents: where each lies, how large it is and how it is packed.

    Only the ends of the archives are read; an archive may have no members. Folders, dotfiles and resource folders are left out; all else is for the
    caller to filter before ``contents``.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for file in b.column(0).to_pylist():
                system, place = system_of(file)
                with system.open_input_file(place) as raw, zipfile.ZipFile(Ended(raw)) as z:
                    found = z.infolist()
                    for i in range(0, len(found), 10_000):
                        rows = [(file, m.filename, m.file_size, m.compress_size, m.CRC, m.compress_type, m.flag_bits, m.header_offset) for m in found[i : i + 10_000]]
                        columns = [pa.array(c) for c in zip(*rows, strict=True)]
                        columns[5:7] = [c.cast(pa.int32()) for c in columns[5:7]]
                        yield pa.RecordBatch.from_arrays(columns, [f.split()[0] for f in LISTED.split(", ")])

    files = spark.read.format("binaryFile").load(path).select("path")  # the content column isn't read
    kept = ~F.col("member").endswith("/") & ~F.col("member").rlike(r"(^|/)\.[^/]*$") & ~F.col("member").contains("__MACOSX")
    return files.mapInArrow(run, LISTED).where(kept)


def _unpacked(raw: pa.NativeFile, member: str, offset: int, compressed: int, crc: int, method: int, flags: int) -> bytes:
    if flags & 1 or method not in (zipfile.ZIP_STORED, zipfile.ZIP_DEFLATED):
        raise ValueError(f"{member}: encrypted, or packed by method {method}")
    raw.seek(offset)
    head = raw.read(30)
    if head[:4] != b"PK\x03\x04":
        raise ValueError(f"{member}: no member begins there")
    raw.seek(offset + 30 + sum(struct.unpack("<HH", head[26:30])))
    inflate = zlib.decompressobj(-15) if method else None
    out = io.BytesIO()
    while compressed:
        part = raw.read(min(PORTION, compressed))
        if not part:
            raise ValueError(f"{member}: cut off")
        compressed -= len(part)
        out.write(inflate.decompress(part) if inflate else part)
    if inflate:
        out.write(inflate.flush())
    if zlib.crc32(out.getbuffer()) != crc:
        raise ValueError(f"{member}: damaged")
    return out.getvalue()


def contents(listed: DataFrame) -> DataFrame:
    """``(container, member, bytes, crc, content)`` of members that ``members`` listed.

    Neighbours in an archive go to one task, some 64 MB of packed bytes each, so one large archive is many tasks; a task
    holds a member, and some 8 MB that are not passed on yet. A damaged member is an error.
    """
    listed, _ = stored(listed, "members")
    tasks = max(1, -(-(listed.agg(F.sum("compressed")).head()[0] or 0) // TASK))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        held, now, raw = 0, None, None

        def made() -> pa.RecordBatch:
            columns = [pa.array(c) for c in zip(*rows, strict=True)]
            return pa.RecordBatch.from_arrays(columns, ["container", "member", "bytes", "crc", "content"])

        for b in batches:
            for file, member, size, compressed, crc, method, flags, offset in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if file != now:
                    if raw:
                        raw.close()
                    system, place = system_of(file)
                    now, raw = file, system.open_input_file(place)
                rows.append((file, member, size, crc, _unpacked(raw, member, offset, compressed, crc, method, flags)))
                held += size
                if held >= PORTION:
                    yield made()
                    rows, held = [], 0
        if rows:
            yield made()
        if raw:
            raw.close()

    dealt = listed.repartitionByRange(tasks, "container", "offset").sortWithinPartitions("container", "offset")
    return dealt.mapInArrow(run, "container string, member string, bytes long, crc long, content binary")


def write_archives(rows: DataFrame, folder: str) -> DataFrame:
    """Members ``(member, content)`` written as an archive for each partition: ``(container, members)``. A task that runs
    again replaces its own archive; nothing is ever held but a member. Run it by an action."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, place = system_of(folder)
        system.create_dir(place, recursive=True)
        context = TaskContext.get()
        name = f"{place.rstrip('/')}/part-{context.partitionId():05d}.zip"
        attempt, n = f"{name}.{context.taskAttemptId()}", 0
        with system.open_output_stream(attempt) as raw, zipfile.ZipFile(raw, "w", zipfile.ZIP_DEFLATED) as z:
            for b in batches:
                for member, content in zip(*(c.to_pylist() for c in b.columns), strict=True):
                    z.writestr(member, content or b"")
                    n += 1
        system.move(attempt, name)
        yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([n], pa.int64())], ["container", "members"])

    return rows.select("member", "content").mapInArrow(run, "container string, members long")
