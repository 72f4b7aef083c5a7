"""Operator 2: WARC records in ZIP packages, and a reader that fetches records by range without extraction.

A package is a ZIP file whose members are stored, not deflated: ``archive/data.warc.gz`` with one gzip member per WARC
record, and ``indexes/index.cdxj`` with a line per record that names its offset and length. The reader parses the end
record, the ZIP64 records where there are any, and the central directory; finds where the stored members begin; and
reads the index and then single records by byte range.
"""

from __future__ import annotations

import base64
import hashlib
import io
import json
import struct
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import space

WARC_MEMBER, INDEX_MEMBER = "archive/data.warc.gz", "indexes/index.cdxj"
#: Payload bytes from which equal payloads are stored once.
REVISIT_BYTES = 1000
#: Bytes of compressed records after which a writer closes a package and opens the next.
PACKAGE_BYTES = 32 << 20
_U16, _U32 = 0xFFFF, 0xFFFFFFFF


# --- ZIP ----------------------------------------------------------------------------------------------------------


def zip_stored(members: list[tuple[str, bytes]], zip64: bool = False) -> bytes:
    """A ZIP file with the members stored. ZIP64 records are written where sizes need them, or always if ``zip64``."""
    out, directory = io.BytesIO(), []
    for name, data in members:
        raw, crc, at, big = name.encode(), zlib.crc32(data), out.tell(), zip64 or len(data) >= _U32
        extra = struct.pack("<HHQQ", 1, 16, len(data), len(data)) if big else b""
        size = _U32 if big else len(data)
        out.write(struct.pack("<IHHHHHIIIHH", 0x04034B50, 45 if big else 20, 0x800, 0, 0, 0x21, crc, size, size, len(raw), len(extra)) + raw + extra)
        out.write(data)
        far = zip64 or at >= _U32
        extra = b"".join([struct.pack("<QQ", len(data), len(data)) if big else b"", struct.pack("<Q", at) if far else b""])
        extra = struct.pack("<HH", 1, len(extra)) + extra if extra else b""
        directory.append(struct.pack("<IHHHHHHIIIHHHHHII", 0x02014B50, 45, 45 if big or far else 20, 0x800, 0, 0, 0x21, crc, size, size, len(raw), len(extra), 0, 0, 0, 0, _U32 if far else at) + raw + extra)
    begin, listed, n = out.tell(), b"".join(directory), len(members)
    out.write(listed)
    if zip64 or begin >= _U32 or n >= _U16:
        end = out.tell()
        out.write(struct.pack("<IQHHIIQQQQ", 0x06064B50, 44, 45, 45, 0, 0, n, n, len(listed), begin))
        out.write(struct.pack("<IIQI", 0x07064B50, 0, end, 1))
        out.write(struct.pack("<IHHHHIIH", 0x06054B50, _U16, _U16, _U16, _U16, _U32, _U32, 0))
    else:
        out.write(struct.pack("<IHHHHIIH", 0x06054B50, 0, 0, n, n, len(listed), begin, 0))
    return out.getvalue()


@dataclass
class Member:
    name: str
    start: int
    size: int


class Package:
    """A ZIP file that is read by range. ``file`` has size(), seek() and read()."""

    def __init__(self, file: pa.NativeFile) -> None:
        self.file = file
        self.members = {m.name: m for m in self._members()}

    def read(self, at: int, size: int) -> bytes:
        self.file.seek(at)
        data = self.file.read(size)
        if len(data) != size:
            raise ValueError(f"the package ends after {at + len(data)} bytes; {at + size} were asked for")
        return data

    def _members(self) -> Iterator[Member]:
        total = self.file.size()
        tail_at = max(0, total - (22 + _U16 + 20))
        tail = self.read(tail_at, total - tail_at)
        at = tail.rfind(b"PK\x05\x06")
        while at >= 0 and (len(tail) - at < 22 or at + 22 + struct.unpack_from("<H", tail, at + 20)[0] != len(tail)):
            at = tail.rfind(b"PK\x05\x06", 0, at)  # these four bytes may stand in the comment
        if at < 0:
            raise ValueError("not a ZIP file: it has no end record")
        n, size, begin = struct.unpack_from("<HII", tail, at + 10)
        if at >= 20 and tail[at - 20 : at - 16] == b"PK\x06\x07":
            end = self.read(struct.unpack_from("<Q", tail, at - 12)[0], 56)
            if end[:4] != b"PK\x06\x06":
                raise ValueError("the ZIP64 end record isn't where its locator says")
            n, size, begin = struct.unpack_from("<QQQ", end, 32)
        directory, at = self.read(begin, size), 0
        for _ in range(n):
            if directory[at : at + 4] != b"PK\x01\x02":
                raise ValueError("the central directory is damaged")
            flags, method = struct.unpack_from("<HH", directory, at + 8)
            packed, full, name_n, extra_n, comment_n = struct.unpack_from("<IIHHH", directory, at + 20)
            offset = struct.unpack_from("<I", directory, at + 42)[0]
            name = directory[at + 46 : at + 46 + name_n]
            extra, k = directory[at + 46 + name_n : at + 46 + name_n + extra_n], 0
            while k + 4 <= len(extra):
                tag, length = struct.unpack_from("<HH", extra, k)
                if tag == 1:  # holds the fields that didn't fit, in this order
                    big = list(struct.unpack_from(f"<{length // 8}Q", extra, k + 4))
                    full = big.pop(0) if full == _U32 else full
                    packed = big.pop(0) if packed == _U32 else packed
                    offset = big.pop(0) if offset == _U32 else offset
                k += 4 + length
            at += 46 + name_n + extra_n + comment_n
            if method == 0 and not flags & 1:  # a stored member can be read by range; others can't
                local = self.read(offset, 30)
                if local[:4] != b"PK\x03\x04":
                    raise ValueError("a local header isn't where the central directory says")
                yield Member(name.decode("utf-8" if flags & 0x800 else "cp437"), offset + 30 + sum(struct.unpack_from("<HH", local, 26)), packed)

    def part(self, name: str, at: int, size: int) -> bytes:
        """Bytes at:at + size of a stored member."""
        member = self.members[name]
        if at < 0 or at + size > member.size:
            raise ValueError(f"{name} has {member.size} bytes")
        return self.read(member.start + at, size)


# --- WARC ---------------------------------------------------------------------------------------------------------


def _b32(hex_digest: str) -> str:
    return "sha1:" + base64.b32encode(bytes.fromhex(hex_digest)).decode()


def warc_record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None) -> bytes:
    """One record, as one gzip member. With ``refers_to`` it is a revisit, which carries the HTTP header only."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if refers_to is not None else http + payload
    lines = [
        "WARC/1.1",
        f"WARC-Type: {'response' if refers_to is None else 'revisit'}",
        f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>",
        "WARC-Date: 1970-01-01T00:00:00Z",
        *([f"WARC-Target-URI: {' '.join(url.split())}"] if url else []),
        f"WARC-Payload-Digest: {_b32(digest)}",
        *(["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <urn:page:{refers_to}>"] if refers_to is not None else []),
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(block)}",
    ]
    packer = zlib.compressobj(1, zlib.DEFLATED, 31)
    return packer.compress("\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n") + packer.flush()


def parse_record(raw: bytes) -> dict:
    """A record from its gzip member: its headers (names in lower case), HTTP headers and payload; its digest is checked."""
    unpacker = zlib.decompressobj(31)
    data = unpacker.decompress(raw) + unpacker.flush()
    if not unpacker.eof or unpacker.unused_data:
        raise ValueError("a range must hold one whole record")
    head, _, rest = data.partition(b"\r\n\r\n")
    version, *lines = head.decode("utf-8").split("\r\n")
    if not version.startswith("WARC/"):
        raise ValueError("not a WARC record")
    fields = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines)}
    block = rest[: int(fields["content-length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    http_fields = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in http.decode("utf-8").split("\r\n")[1:])}
    digest = base64.b32decode(fields["warc-payload-digest"].removeprefix("sha1:")).hex()
    if fields["warc-type"] == "response" and hashlib.sha1(payload).hexdigest() != digest:
        raise ValueError(f"the payload of {fields['warc-record-id']} doesn't have its digest")
    return {"fields": fields, "http": http_fields, "payload": payload, "digest": digest}


def _page(urn: str | None) -> int | None:
    found = (urn or "").removeprefix("<urn:page:").removesuffix(">")
    return int(found) if found else None


# --- Spark --------------------------------------------------------------------------------------------------------


def open_fs(folder: str) -> tuple[pafs.FileSystem, str]:
    """The file system of a folder's URI, and the path in it."""
    return pafs.FileSystem.from_uri(folder if "://" in folder or folder.startswith("file:/") else f"file://{folder}")


def write_packages(pages: DataFrame, folder: str) -> DataFrame:
    """Write ``pages`` (page_id, url, html, digest, refers_to) as packages below ``folder``; each row of the result names one.

    Each task writes its own files under names never used before and reports those it has finished, so the files of a
    task that failed are never read. Holds PACKAGE_BYTES and one record in memory.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        target, root = open_fs(folder)
        target.create_dir(root, recursive=True)
        warc, index = bytearray(), []

        def close() -> pa.RecordBatch:
            name = f"{root}/{uuid.uuid4().hex}.wacz"
            with target.open_output_stream(name) as out:
                out.write(zip_stored([(WARC_MEMBER, bytes(warc)), (INDEX_MEMBER, "".join(index).encode())]))
            row = pa.RecordBatch.from_pydict({"path": [name], "records": pa.array([len(index)], pa.int64())})
            warc.clear()
            index.clear()
            return row

        for batch in batches:
            for row in range(batch.num_rows):
                page_id, url, html, digest, refers_to = (batch.column(k)[row].as_py() for k in range(5))
                record = warc_record(page_id, url, html.encode(), digest, refers_to)
                index.append(f"{'' if page_id is None else page_id} 19700101000000 " + json.dumps({"offset": len(warc), "length": len(record)}) + "\n")
                warc += record
                if len(warc) >= PACKAGE_BYTES:
                    yield close()
        if index:
            yield close()

    return pages.select("page_id", "url", "html", "digest", "refers_to").mapInArrow(run, "path string, records long")


def read_packages(packages: DataFrame, folder: str, *, with_payload: bool = False) -> DataFrame:
    """A row for each record in the packages (path, records), read by range: the index of the package, then each record."""
    schema = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long" + (", payload binary" if with_payload else "")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        source, _ = open_fs(folder)
        for batch in batches:
            for path in batch.column("path").to_pylist():
                with source.open_input_file(path) as file:
                    package = Package(file)
                    lines = package.part(INDEX_MEMBER, 0, package.members[INDEX_MEMBER].size).decode().splitlines()
                    for k in range(0, len(lines), 500):
                        rows: dict[str, list] = {c.split()[0]: [] for c in schema.split(", ")}
                        for line in lines[k : k + 500]:
                            where = json.loads(line.split(" ", 2)[2])
                            record = parse_record(package.part(WARC_MEMBER, where["offset"], where["length"]))
                            fields = record["fields"]
                            rows["page_id"].append(_page(fields["warc-record-id"]))
                            rows["payload_bytes"].append(len(record["payload"]) if fields["warc-type"] == "response" else int(record["http"]["content-length"]))
                            rows["payload_digest"].append(record["digest"])
                            rows["record_type"].append(fields["warc-type"])
                            rows["refers_to"].append(_page(fields.get("warc-refers-to")))
                            if with_payload:
                                rows["payload"].append(record["payload"])
                        kinds = {"page_id": pa.int64(), "payload_bytes": pa.int64(), "refers_to": pa.int64(), "payload": pa.binary()}
                        yield pa.RecordBatch.from_pydict({c: pa.array(v, kinds.get(c, pa.string())) for c, v in rows.items()})

    return packages.select("path").mapInArrow(run, schema)


def with_revisits(pages: DataFrame) -> DataFrame:
    """page_id, url, html (null: empty), its SHA-1 digest, and refers_to: the response's page_id for revisits, else null.

    Of rows with equal payloads of REVISIT_BYTES or more, those with the largest page_id are responses. Rows that share
    that page_id are all responses; a null page_id is less than any other, and rows with null alone are all responses.
    """
    pages = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.coalesce("html", F.lit("")).alias("html"))
    pages = pages.withColumn("digest", F.sha1("html"))
    large = pages.where(F.octet_length("html") >= REVISIT_BYTES)
    # Only digests that occur twice matter. They are written first: Spark can then split a hot digest in the join.
    responses = space.cut(large.groupBy("digest").agg(F.max("page_id").alias("response"), F.count(F.lit(1)).alias("n")).where("n > 1 AND response IS NOT NULL").select("digest", "response"), "responses")
    refers = F.when((F.octet_length("html") >= REVISIT_BYTES) & ~F.col("page_id").eqNullSafe(F.col("response")), F.col("response"))
    return pages.join(responses, "digest", "left").select("page_id", "url", "html", "digest", refers.alias("refers_to"))


def op2_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Write every page to packages in the shared folder, and read all packages back. An empty table gives no package and no row."""
    folder = space.fresh_dir(spark, "packages")
    packages = space.cut(write_packages(with_revisits(space.table(spark, sf_dir, "pages")), folder), "package-list")
    return read_packages(packages.repartition(spark.sparkContext.defaultParallelism, "path"), folder)


OP2_SQL = f"""
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
q AS (SELECT page_id, strlen(html) AS payload_bytes, sha1(html) AS payload_digest FROM p),
r AS (SELECT *, max(page_id) OVER (PARTITION BY payload_digest) AS response FROM q)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN payload_bytes >= {REVISIT_BYTES} AND page_id <> response THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN payload_bytes >= {REVISIT_BYTES} AND page_id <> response THEN response END AS refers_to
FROM r
"""
