"""Web archives packaged as ZIP files: writer, and a reader that never extracts.

A package holds ``archive/data.warc.gz`` (one gzip member per WARC record) and
``indexes/index.cdxj`` (a line per record with its offset and length), both stored without
compression, so that a record is a byte range of the package. The reader parses the end
records and central directory (ZIP64 forms too), locates the stored members, reads the index
and then only the byte ranges of records; packages are split into ranges, not whole files, for
the tasks. Packages are written by Spark's own text writer, one row a file, so output is
committed by task; the final byte of a row's file is the archive comment.

Ranges are read through Arrow's file systems (local paths, object stores, HDFS).

Edge cases: a null payload is empty; a null url is left out of the record; line breaks in urls
are escaped; a record larger than the package size gets a package of its own; an empty table
gives no packages and no rows. Ids are whole numbers of up to 64 bits and have to be unique for
``refers_to`` to be exact; a page without id gets a record without one, which no other refers to.
"""

from __future__ import annotations

import base64
import hashlib
import json
import struct
import zlib
from collections.abc import Iterator
from typing import BinaryIO

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from alphaloom.session import scratch_path

ARCHIVE, INDEX = "archive/data.warc.gz", "indexes/index.cdxj"
PACKAGE_BYTES = 16 * 2**20
RANGE_BYTES = 4 * 2**20
TASK_PACKAGES, TASK_BYTES = 64, 64 * 2**20
BATCH_BYTES = 2 * 2**20  # payloads that a reading task hands on at once
_COLUMNS = ["page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to", "payload"]
COMMENT = b"\n"
_LOCAL, _CENTRAL, _END, _END64, _LOCATOR = 0x04034B50, 0x02014B50, 0x06054B50, 0x06064B50, 0x07064B50
_FULL, _FULL16 = 0xFFFFFFFF, 0xFFFF
_DOS_DATE = 33  # 1980-01-01: packages are the same whenever they are written
CREATED = "1980-01-01T00:00:00Z"


def payload_digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


# ---- records


def record(page_id: int | str | None, url: str | None, payload: bytes, refers_to: int | str | None) -> bytes:
    """A response record, or a revisit that repeats the HTTP head of the payload it stands for; a page without id has an empty one."""
    block = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    head = [
        "WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>",
        f"WARC-Date: {CREATED}", "Content-Type: application/http; msgtype=response", f"WARC-Payload-Digest: sha1:{payload_digest(payload)}",
    ]
    if url is not None:
        head.append("WARC-Target-URI: " + url.replace("\r", "%0D").replace("\n", "%0A"))
    if refers_to is None:
        block += payload
    else:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <urn:page:{refers_to}>"]
    head.append(f"Content-Length: {len(block)}")
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse_record(data: bytes) -> tuple[dict[str, str], bytes, bytes]:
    """Named fields (lower-case), HTTP head and payload of one record."""
    head, _, rest = data.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("no WARC record at this offset")
    fields = {k.lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
    block = rest[: int(fields["content-length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    return fields, http, payload


# ---- packages


def _extra64(values: list[int]) -> bytes:
    big = [v for v in values if v >= _FULL]
    return struct.pack("<HH", 1, 8 * len(big)) + b"".join(struct.pack("<Q", v) for v in big) if big else b""


def package(members: list[tuple[str, bytes]], zip64: bool = False) -> bytes:
    """A ZIP of stored members, with ZIP64 end records if asked for or needed."""
    out, central, count = bytearray(), bytearray(), len(members)
    for name, data in members:
        at, size, crc, label = len(out), len(data), zlib.crc32(data), name.encode()
        force = zip64 or size >= _FULL
        local = struct.pack("<HHQQ", 1, 16, size, size) if force else b""
        shown = _FULL if force else size
        out += struct.pack("<IHHHHHIIIHH", _LOCAL, 45 if force else 20, 0x800, 0, 0, _DOS_DATE, crc, shown, shown, len(label), len(local)) + label + local + data
        extra = struct.pack("<HHQQQ", 1, 24, size, size, at) if zip64 else _extra64([size, size, at])
        where = _FULL if zip64 or at >= _FULL else at
        central += struct.pack("<IHHHHHHIIIHHHHHII", _CENTRAL, 45, 45 if force else 20, 0x800, 0, 0, _DOS_DATE, crc, shown, shown, len(label), len(extra), 0, 0, 0, 0, where)
        central += label + extra
    start = len(out)
    out += central
    if zip64 or start >= _FULL or count >= _FULL16:
        end64 = len(out)
        out += struct.pack("<IQHHIIQQQQ", _END64, 44, 45, 45, 0, 0, count, count, len(central), start)
        out += struct.pack("<IIQI", _LOCATOR, 0, end64, 1)
        count, central_size, start = _FULL16, _FULL, _FULL
    else:
        central_size = len(central)
    return bytes(out + struct.pack("<IHHHHIIH", _END, 0, 0, count, count, central_size, start, len(COMMENT)) + COMMENT)


def directory(file: BinaryIO, size: int) -> dict[str, tuple[int, int]]:
    """Name -> (first byte, bytes) of the stored members of a package, from its end records and central directory alone."""

    def read(at: int, n: int) -> bytes:
        file.seek(at)
        data = file.read(n)
        if len(data) != n:
            raise ValueError("package is cut short")
        return data

    tail_at = max(0, size - 22 - _FULL16)
    tail = read(tail_at, size - tail_at)
    k = len(tail) - 22
    while k >= 0 and not (tail[k : k + 4] == struct.pack("<I", _END) and k + 22 + struct.unpack_from("<H", tail, k + 20)[0] == len(tail)):
        k = tail.rfind(struct.pack("<I", _END), 0, k + 3)
    if k < 0:
        raise ValueError("no end of central directory")
    _, _, _, _, count, length, start, _ = struct.unpack_from("<IHHHHIIH", tail, k)
    if _FULL16 == count or _FULL in (length, start):
        sign, _, end64, _ = struct.unpack("<IIQI", read(tail_at + k - 20, 20))
        if sign != _LOCATOR:
            raise ValueError("no ZIP64 locator")
        sign, _, _, _, _, _, _, count, length, start = struct.unpack("<IQHHIIQQQQ", read(end64, 56))
        if sign != _END64:
            raise ValueError("no ZIP64 end record")
    entries, at, out = read(start, length), 0, {}
    for _ in range(count):
        sign, _, _, _, method, _, _, _, packed, full, n_name, n_extra, n_note, _, _, _, where = struct.unpack_from("<IHHHHHHIIIHHHHHII", entries, at)
        if sign != _CENTRAL:
            raise ValueError("central directory is damaged")
        name = entries[at + 46 : at + 46 + n_name].decode()
        extra, x = entries[at + 46 + n_name : at + 46 + n_name + n_extra], 0
        at += 46 + n_name + n_extra + n_note
        while x + 4 <= len(extra):
            kind, n = struct.unpack_from("<HH", extra, x)
            if kind == 1:
                wide = iter(struct.unpack_from(f"<{n // 8}Q", extra, x + 4))
                full = next(wide) if full == _FULL else full
                packed = next(wide) if packed == _FULL else packed
                where = next(wide) if where == _FULL else where
            x += 4 + n
        if method == 0:
            n_name, n_extra = struct.unpack_from("<HH", read(where, 30), 26)
            out[name] = where + 30 + n_name + n_extra, packed
    return out


# ---- Spark


def dedup_roles(pages: DataFrame, min_bytes: int) -> DataFrame:
    """``pages`` (``_id``, ``url``, ``payload``) with ``refers_to``: the least id of an equal payload of at least ``min_bytes``, if that is not its own."""
    marked = pages.withColumn("_sha", F.sha1("payload"))
    firsts = marked.filter(F.octet_length("payload") >= min_bytes).groupBy("_sha").agg(F.min("_id").alias("first"), F.count(F.lit(1)).alias("n"))
    firsts = firsts.filter("n > 1").drop("n")  # only digests that repeat
    out = marked.join(firsts, "_sha", "left")
    return out.select("_id", "url", "payload", F.expr("CASE WHEN NOT (first <=> _id) THEN first END").alias("refers_to"))


def write_packages(pages: DataFrame, path: str, page_id: str = "page_id", url: str = "url", payload: str = "html", min_bytes: int = 0, package_bytes: int = PACKAGE_BYTES) -> None:
    """One WARC record for each row, in packages of about ``package_bytes`` under ``path``."""

    def build(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        parts, lines, size = [], [], 0

        def close() -> pd.DataFrame:
            made = package([(ARCHIVE, b"".join(parts)), (INDEX, "".join(lines).encode())])
            parts.clear()
            lines.clear()
            return pd.DataFrame({"file": [made[: -len(COMMENT)]]})

        for b in batches:
            for i, u, p, r in zip(b["_id"], b["url"], b["payload"], b["refers_to"], strict=True):
                data = zlib.compressobj(1, zlib.DEFLATED, 31)
                member = data.compress(record(i, u, p, r)) + data.flush()
                lines.append(f"{i or '-'} {json.dumps({'offset': size, 'length': len(member)})}\n")
                parts.append(member)
                size += len(member)
                if size >= package_bytes:
                    yield close()
                    size = 0
        if parts:
            yield close()

    rows = pages.select(F.col(page_id).cast("long").alias("_id"), F.col(url).alias("url"), F.coalesce(F.col(payload), F.lit("")).cast("binary").alias("payload"))
    # ids pass through as text: a null would turn the longs of a batch into doubles
    rows = dedup_roles(rows, min_bytes).withColumns({c: F.col(c).cast("string") for c in ("_id", "refers_to")})
    files = rows.mapInPandas(build, "file BINARY").select(F.col("file").cast("string").alias("value"))
    files.write.option("maxRecordsPerFile", 1).option("compression", "none").option("lineSep", COMMENT.decode()).text(path)


def _open(path: str) -> BinaryIO:
    from pyarrow import fs

    system, inner = fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)
    return system.open_input_file(inner)


def _ranges(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Ranges of about ``RANGE_BYTES`` of neighbouring records, from each package's index."""
    for b in batches:
        rows = []
        for path, size in zip(b["path"], b["length"], strict=True):
            with _open(path) as f:
                members = directory(f, size)
                base, _ = members[ARCHIVE]
                at, n = members[INDEX]
                f.seek(at)
                entries = [json.loads(x.split(" ", 1)[1]) for x in f.read(n).decode().splitlines()]
            begin, sizes = None, []
            for e in sorted(entries, key=lambda e: e["offset"]):
                if begin is not None and (sum(sizes) + e["length"] > RANGE_BYTES or e["offset"] != begin + sum(sizes)):
                    rows.append((path, base + begin, sizes))
                    begin = None
                if begin is None:
                    begin, sizes = e["offset"], []
                sizes.append(e["length"])
            if begin is not None:
                rows.append((path, base + begin, sizes))
        yield pd.DataFrame(rows, columns=["path", "at", "sizes"])


def _read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in batches:
        for path, at, sizes in zip(b["path"], b["at"], b["sizes"], strict=True):
            with _open(path) as f:
                f.seek(at)
                data = f.read(int(sum(sizes)))
            rows, x, held = [], 0, 0
            for n in sizes:
                fields, http, payload = parse_record(zlib.decompress(data[x : x + n], 31))
                x += n
                names = dict(k.lower().split(": ", 1) for k in http.decode().split("\r\n")[1:])
                page, digest, kind = fields["warc-record-id"][10:-1] or None, fields["warc-payload-digest"][5:], fields["warc-type"]
                whole = kind == "revisit" or payload_digest(payload) == digest
                if not whole:
                    raise ValueError(f"payload of page {page} does not match its digest")
                refers = fields["warc-refers-to"][10:-1] if "warc-refers-to" in fields else None
                rows.append((page, fields.get("warc-target-uri"), int(names["content-length"]), digest, kind, refers, payload if kind == "response" else None))
                held += len(payload)
                if held >= BATCH_BYTES:
                    yield pd.DataFrame(rows, columns=_COLUMNS)
                    rows, held = [], 0
            yield pd.DataFrame(rows, columns=_COLUMNS)


def read_packages(spark: SparkSession, path: str) -> DataFrame:
    """One row per record of the packages under ``path``; payloads of revisits are null. Payloads are checked against their digests."""
    files = spark.read.format("binaryFile").load(path).select("path", "length").filter("length > 0")
    total = files.agg(F.sum("length"), F.count(F.lit(1))).first()
    # stated numbers of tasks: a few index rows would be merged to one, which would then read every range
    least = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ranges = files.repartition(max(least, total[1] // TASK_PACKAGES), "path").mapInPandas(_ranges, "path STRING, at BIGINT, sizes ARRAY<BIGINT>")
    schema = "page_id STRING, url STRING, payload_bytes BIGINT, payload_digest STRING, record_type STRING, refers_to STRING, payload BINARY"
    out = ranges.repartition(max(least, (total[0] or 0) // TASK_BYTES), "path", "at").mapInPandas(_read, schema)
    return out.withColumns({c: F.col(c).cast("long") for c in ("page_id", "refers_to")})


def round_trip(pages: DataFrame) -> DataFrame:
    """Packages of ``pages`` (``page_id``, ``url``, ``html``) in the shared folder, read back."""
    path = scratch_path(pages.sparkSession, "packages")
    write_packages(pages, path)
    return read_packages(pages.sparkSession, path)
