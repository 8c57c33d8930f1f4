"""WARC archives: gzip members written through Spark's writer, read back by byte range."""

from __future__ import annotations

import base64
import gzip
import hashlib
import zlib
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.session import settle, shuffle_partitions

MAGIC = b"\x1f\x8b\x08"
EMPTY = gzip.compress(b"", mtime=0)
BLOCK = 1 << 20
END = b"\r\n\r\n"


def base32_sha1(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def _clean(value: str) -> str:
    """A header value on one line."""
    return "".join(c if c >= " " else f"%{ord(c):02X}" for c in value)


def record(kind: str, key: str, headers: dict[str, str], block: bytes, date: str = "2000-01-01T00:00:00Z") -> bytes:
    """A record as a gzip member of its own."""
    lines = [
        "WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <urn:page:{key}>", f"WARC-Date: {date}",
        *(f"{k}: {_clean(v)}" for k, v in headers.items()), f"Content-Length: {len(block)}"
    ]
    return gzip.compress("\r\n".join(lines).encode("utf-8", "surrogatepass") + END + block + END, 6, mtime=0)


def page_record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None) -> bytes:
    """A response with the whole payload, or a revisit with its HTTP head alone, which still says how long it is."""
    headers = ({"WARC-Target-URI": url} if url is not None else {}) | {
        "Content-Type": "application/http; msgtype=response", "WARC-Payload-Digest": f"sha1:{base32_sha1(payload)}"
    }
    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    key = "null" if page_id is None else str(page_id)
    if refers_to is None:
        return record("response", key, headers, head + payload)
    more = {"WARC-Profile": "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", "WARC-Refers-To": f"<urn:page:{refers_to}>"}
    return record("revisit", key, headers | more, head)


def write_pages(pages: DataFrame, folder: str, least: int = 0, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> None:
    """Write a record per page to archives in a folder, one file per task.

    Of the pages whose payloads (html in UTF-8, null: empty) are equal and have ``least`` bytes or more, the one with
    the smallest id becomes a response and the others revisit it; rows that repeat that id are responses too, and
    where all ids are null all are. An empty table leaves no records. Only the three columns are read; pages and urls
    of any length are written and read whole.

    The text writer puts a separator after each row; here it is a zero byte, the last byte of a member (its size's
    highest byte). Members of 16 MiB and more end otherwise and get an empty member added, which ends so.
    """
    rows = pages.select(
        F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"),
        F.coalesce(F.col(html_col).cast("binary"), F.lit(b"")).alias("payload")
    ).withColumn("sha", F.sha1("payload"))
    groups = rows.groupBy("sha").agg(F.min("page_id").alias("first"), F.count("*").alias("n"), F.min(F.octet_length("payload")).alias("bytes"))
    # stored, so that both sides of the join are plain shuffles and a payload that many pages share can be split
    groups = settle(groups.where((F.col("n") > 1) & (F.col("bytes") >= least)).select("sha", "first"))
    refers = F.when(F.col("first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first")), F.col("first"))
    typed = rows.join(groups, "sha", "left").select("page_id", "url", "payload", refers.alias("refers_to"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = [record("warcinfo", "info", {"Content-Type": "application/warc-fields"}, b"software: tessera\r\nformat: WARC File Format 1.1\r\n")]
        for b in batches:
            for r in zip(*(c.to_pylist() for c in b.columns), strict=True):
                out.append(page_record(*r))
                if len(out) >= 500:
                    yield pa.RecordBatch.from_arrays([pa.array([_ended(m) for m in out], pa.binary())], ["member"])
                    out = []
        yield pa.RecordBatch.from_arrays([pa.array([_ended(m) for m in out], pa.binary())], ["member"])

    members = typed.mapInArrow(run, "member binary").select(F.col("member").cast("string").alias("value"))
    members.write.mode("error").option("lineSep", "\0").option("compression", "none").text(folder)


def _ended(member: bytes) -> bytes:
    return (member if member[-1] == 0 else member + EMPTY)[:-1]


class _Member:
    """The decompressed bytes of the gzip member that starts at an offset, in pieces."""

    def __init__(self, file, start: int):
        self.file, self.at, self.inflate, self.buffer = file, start, zlib.decompressobj(31), bytearray()
        self.tail = 0

    def fill(self) -> bool:
        """Add more bytes to the buffer; False at the member's end."""
        while not self.inflate.eof:
            if waiting := self.inflate.unconsumed_tail:
                piece = waiting
            else:
                self.file.seek(self.at)
                piece = self.file.read(BLOCK // 8)
                if not piece:
                    raise zlib.error("the member is cut off")
                self.at += len(piece)
            got = self.inflate.decompress(piece, BLOCK)
            if self.inflate.eof:
                self.tail = len(self.inflate.unused_data)
            if got:
                self.buffer += got
                return True
        return False

    def head(self) -> bytes | None:
        """What comes before an empty line, however long it is; None where the member ends without one."""
        seen = 0
        while (end := self.buffer.find(END, seen)) < 0:
            seen = max(0, len(self.buffer) - len(END) + 1)
            if not self.fill():
                return None
        out, self.buffer = self.buffer[:end], self.buffer[end + len(END) :]
        return out

    def starts(self, mark: bytes) -> bool:
        while len(self.buffer) < len(mark) and self.fill():
            pass
        return self.buffer.startswith(mark)

    def take(self, n: int) -> Iterator[bytes]:
        while n:
            if not self.buffer and not self.fill():
                raise zlib.error("the record is cut off")
            piece = bytes(self.buffer[:n])
            del self.buffer[:n]
            n -= len(piece)
            yield piece

    def end(self) -> int:
        while self.fill():
            self.buffer.clear()
        return self.at - self.tail


def _fields(head: bytes) -> dict[str, str]:
    lines = head.decode("utf-8", "replace").split("\r\n")[1:]
    return {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines)}


def _record(member: _Member, head: bytes, payloads: bool) -> dict:
    """Read one record after its header. The payload is hashed as it comes and kept only if asked for."""
    f = _fields(head)
    left = int(f.get("content-length", 0))
    out = {
        "record_id": f.get("warc-record-id", "").strip("<>"), "kind": f.get("warc-type"), "url": f.get("warc-target-uri"),
        "refers_to": (f.get("warc-refers-to") or "").strip("<>") or None
    }
    digest, size, kept, front, is_http = hashlib.sha1(), 0, [], bytearray(), f.get("content-type", "").startswith("application/http")
    http: dict[str, str] = {}

    def payload(piece: bytes) -> None:
        nonlocal size
        digest.update(piece)
        size += len(piece)
        if payloads:
            kept.append(bytes(piece))

    for piece in member.take(left):
        if not is_http:
            payload(piece)
            continue
        seen = max(0, len(front) - len(END) + 1)
        front += piece
        if (at := front.find(END, seen)) >= 0:
            is_http, http = False, _fields(bytes(front[:at]))
            payload(front[at + len(END) :])
    if is_http:  # no empty line: all of it is payload
        payload(front)
    if out["kind"] == "revisit":
        return out | {
            "payload_bytes": int(http["content-length"]) if http.get("content-length", "").isdigit() else None,
            "payload_digest": f.get("warc-payload-digest", "").removeprefix("sha1:") or None, "payload": None
        }
    return out | {"payload_bytes": size, "payload_digest": base64.b32encode(digest.digest()).decode(), "payload": b"".join(kept) if payloads else None}


def read_range(file, start: int, end: int, payloads: bool = False) -> Iterator[dict]:
    """All records of the members that start in a byte range.

    The range is searched for the gzip magic. A candidate counts if what it inflates to begins as a record header does;
    the next one is then looked for at its end, else one byte on. Records of members that start before the range belong
    to the task before; a member that starts inside is read to its end, wherever that is, and its headers whatever
    their length. A member that begins so and then turns out damaged, cut off or without a whole header raises an
    error: no record is passed over.
    """
    at = start
    while at < end:
        file.seek(at)
        block = file.read(min(BLOCK, end - at) + len(MAGIC) - 1)
        if len(block) < len(MAGIC):  # the file ends
            return
        found = block.find(MAGIC)
        if found < 0 or at + found >= end:
            at += max(1, len(block) - len(MAGIC) + 1)
            continue
        at += found
        member = _Member(file, at)
        try:
            known = member.fill() and member.starts(b"WARC/")
        except zlib.error:
            known = False
        if not known:
            at += 1
            continue
        head = member.head()
        if head is None:
            raise ValueError(f"a record at byte {at} has no whole header")
        while head is not None:
            if head.lstrip().startswith(b"WARC/"):
                yield _record(member, bytes(head.lstrip()), payloads)
                for _ in member.take(len(END)):
                    pass
            head = member.head()
        at = member.end()


def _open(path: str):
    if path.startswith("file:"):
        path = "/" + path[5:].lstrip("/")
    system, place = (pa.fs.LocalFileSystem(), path) if path.startswith("/") else pa.fs.FileSystem.from_uri(path)
    return system.open_input_file(place)


SCHEMA = pa.schema([("record_id", pa.string()), ("kind", pa.string()), ("url", pa.string()), ("refers_to", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("payload", pa.binary())])


def read_archives(spark: SparkSession, folder: str, split: int = 16 << 20, payloads: bool = False) -> DataFrame:
    """All records of the archives in a folder, as ``(record_id, kind, url, refers_to, payload_bytes, payload_digest,
    payload)``; the payload is null unless asked for, and for revisits.

    Files are listed by Spark and cut into byte ranges, which are dealt to tasks; a file of any size is read by many.
    The tasks open files of the local (shared) file system, or of any store that pyarrow knows by its address. The
    digest and size of a payload are those of the bytes that were read; a revisit's are what its headers say.
    """
    files = spark.read.format("binaryFile").load(folder).select("path", "length").where("length > 0")
    ranges = files.select("path", F.explode(F.expr(f"sequence(0L, length - 1, {split}L)")).alias("start"))
    ranges = ranges.withColumn("end", F.col("start") + split)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, size = [], 0
        for b in batches:
            for path, start, end in zip(*(c.to_pylist() for c in b.columns), strict=True):
                with _open(path) as f:
                    for r in read_range(f, start, end, payloads):
                        out.append(r)
                        size += len(r["payload"] or b"") + 200
                        if size > 8 * BLOCK:
                            yield pa.RecordBatch.from_pylist(out, SCHEMA)
                            out, size = [], 0
        yield pa.RecordBatch.from_pylist(out, SCHEMA)

    schema = "record_id string, kind string, url string, refers_to string, payload_bytes long, payload_digest string, payload binary"
    return ranges.repartition(shuffle_partitions(spark)).mapInArrow(run, schema)


def page_rows(records: DataFrame) -> DataFrame:
    """``(page_id, payload_bytes, payload_digest, record_type, refers_to)`` of the records that ``write_pages`` makes."""
    number = lambda c: F.regexp_extract(c, r"^urn:page:(-?\d+)$", 1)
    pages = records.where(F.col("kind").isin("response", "revisit"))
    return pages.select(
        F.expr("try_cast(nullif(regexp_extract(record_id, '^urn:page:(-?[0-9]+)$', 1), '') as bigint)").alias("page_id"), "payload_bytes",
        "payload_digest", F.col("kind").alias("record_type"),
        F.when(F.col("refers_to").isNotNull(), number(F.col("refers_to"))).cast("long").alias("refers_to")
    )
