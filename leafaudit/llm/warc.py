"""Legacy web archives to WARC, and both written and read as Spark jobs.

An ARC file begins with a version block, which says by version and field names how the
header line of each record reads; a record is that line and as many bytes as it declares.
The converter parses the lines by the archive's own fields and synthesises what a WARC
record needs and ARC lacks: an identifier (from archive and offset, so that a repeated
task gives the same), an ISO timestamp, a record type and digests of payload and block.
Records of equal payload become one response and revisits of it.

Archives hold one gzip member per record and at most `archive_bytes` each (one longer
record makes a longer archive). Tasks build them; Spark's text writer, one archive a
row, commits them to the folder, so it works wherever Spark can write.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Callable, Iterator
from functools import partial

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leafaudit.llm.common import stored

ARCHIVE_BYTES = 32 << 20
BATCH_BYTES, BATCH_ROWS = 8 << 20, 2048
#: Fixed values of the two formats.
ARC_FIELDS = {
    1: ["URL", "IP-address", "Archive-date", "Content-type", "Archive-length"],
    2: ["URL", "IP-address", "Archive-date", "Content-type", "Result-code", "Checksum", "Location", "Offset", "Filename", "Archive-length"],
}
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
PAGE_FIELD, REFERS_PAGE_FIELD, SIZE_FIELD = "X-Page-Id", "X-Refers-To-Page-Id", "X-Payload-Bytes"


def gzip_member(data: bytes) -> bytes:
    packer = zlib.compressobj(1, zlib.DEFLATED, 31)
    return packer.compress(data) + packer.flush()


EMPTY_MEMBER = gzip_member(b"")


def payload_digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record_id(archive: str, offset: int) -> str:
    return f"urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{archive}#{offset}')}"


def header_safe(value: str) -> str:
    """Blanks and control characters as percent escapes: a header field is one word."""
    return "".join(c if c > " " and c != "\x7f" else "".join(f"%{b:02X}" for b in c.encode()) for c in value)


def members(data: bytes) -> Iterator[bytes]:
    """Content of each gzip member; data that isn't compressed is one piece."""
    view, at = memoryview(data), 0
    while at < len(view):
        if view[at : at + 2] != b"\x1f\x8b":
            yield bytes(view[at:])
            return
        unpack, parts, end = zlib.decompressobj(31), [], at
        while not unpack.eof and end < len(view):
            piece = view[end : end + (1 << 16)]
            parts.append(unpack.decompress(piece))
            end += len(piece)
        if not unpack.eof:
            raise ValueError(f"gzip member at {at} is cut off")
        at = end - len(unpack.unused_data)
        yield b"".join(parts)


def pieces(data: bytes, parse: Callable) -> Iterator[tuple[int, dict, bytes]]:
    """(offset in the uncompressed archive, fields, block) of each record; parse reads the
    one at a place of a piece and says where it ends."""
    base = 0
    for piece in members(data):
        at = 0
        while at < len(piece):
            if piece[at] in b"\r\n":
                at += 1
                continue
            fields, block, end = parse(piece, at)
            yield base + at, fields, block
            at = end
        base += len(piece)


# ---- ARC


def version_block(version: int, name: str, date: str) -> bytes:
    body = f"{version} 0 leafaudit\n{' '.join(ARC_FIELDS[version])}\n"
    return f"filedesc://{name} 0.0.0.0 {date} text/plain {len(body)}\n{body}\n".encode()


def arc_record(version: int, url: str, date: str, kind: str, block: bytes, offset: int, name: str) -> bytes:
    values = {"URL": header_safe(url), "IP-address": "0.0.0.0", "Archive-date": date, "Content-type": kind, "Result-code": "200",
              "Checksum": hashlib.md5(block).hexdigest(), "Location": "-", "Offset": str(offset), "Filename": name, "Archive-length": str(len(block))}
    return " ".join(values[f] for f in ARC_FIELDS[version]).encode() + b"\n" + block + b"\n"


class ArcReader:
    """Reads header lines by the version block of the archive."""

    def __init__(self) -> None:
        self.fields = ARC_FIELDS[1]

    def __call__(self, data: bytes, at: int) -> tuple[dict, bytes, int]:
        end = data.find(b"\n", at)
        line = data[at : end if end >= 0 else len(data)].decode("utf-8", "replace").rstrip("\r")
        first = line.startswith("filedesc://")
        names = ARC_FIELDS[1] if first and len(line.split(" ")) == 5 else self.fields
        parts = line.rsplit(" ", len(names) - 1)  # a URL may hold blanks
        if end < 0 or len(parts) != len(names) or not parts[-1].isdigit() or end + 1 + int(parts[-1]) > len(data):
            raise ValueError(f"no ARC header line: {line[:80]!r}")
        block = data[end + 1 : end + 1 + int(parts[-1])]
        if first:
            lines = block.decode("utf-8", "replace").splitlines()
            version = lines[0].split(" ")[0] if lines else ""
            if version not in ("1", "2"):
                raise ValueError(f"unknown ARC version {version!r}")
            self.fields = lines[1].split(" ") if len(lines) > 1 else ARC_FIELDS[int(version)]
        return {"first": first, **dict(zip(names, parts, strict=True))}, block, end + 1 + int(parts[-1])


def http_parts(block: bytes) -> tuple[dict[str, str], bytes, bytes] | None:
    """Header fields, header bytes and payload of an HTTP response; None for anything else."""
    end = block.find(b"\r\n\r\n")
    if not block.startswith(b"HTTP/") or end < 0:
        return None
    fields = {}
    for line in block[:end].decode("utf-8", "replace").split("\r\n")[1:]:
        name, _, value = line.partition(":")
        fields[name.strip().lower()] = value.strip()
    return fields, block[: end + 4], block[end + 4 :]


def iso_date(digits: str) -> str:
    """ARC dates have 14 digits, or fewer with the rest at its least."""
    d = digits + "00000101000000"[len(digits) :]
    return f"{d[:4]}-{d[4:6]}-{d[6:8]}T{d[8:10]}:{d[10:12]}:{d[12:14]}Z"


def whole_number(fields: dict[str, str], name: str) -> int | None:
    value = fields.get(name.lower(), "")
    return int(value) if value.lstrip("-").isdigit() else None


# ---- Spark


def batched(rows: Iterator[tuple], schema: pa.Schema, weight: Callable[[tuple], int]) -> Iterator[pa.RecordBatch]:
    held, size = [], 0
    for row in rows:
        held.append(row)
        size += weight(row)
        if size >= BATCH_BYTES or len(held) >= BATCH_ROWS:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held, strict=True), schema, strict=True)], schema=schema)
            held, size = [], 0
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held, strict=True), schema, strict=True)], schema=schema)


def archives_of(records: Iterator[Callable[[int, str, int], bytes]], first: Callable[[int, str], bytes], archive_bytes: int, label: str) -> Iterator[pa.RecordBatch]:
    """Archives as rows of bytes. A record is a function of (number of the archive, its name, offset)."""
    task, number, held, size = TaskContext.get().partitionId(), 0, [], 0

    def name() -> str:
        return f"{label}-{task:06d}-{number:06d}"

    for make in records:
        if not held:
            held = [gzip_member(first(task + number, name()))]
            size = len(held[0])
        held.append(gzip_member(make(task + number, name(), size)))
        size += len(held[-1])
        if size >= archive_bytes:
            yield pa.RecordBatch.from_arrays([pa.array([b"".join(held)], pa.binary())], ["value"])
            number, held = number + 1, []
    if held:
        yield pa.RecordBatch.from_arrays([pa.array([b"".join(held)], pa.binary())], ["value"])


def save_archives(archives: DataFrame, path: str) -> None:
    """One file per row. The writer's line end is an empty gzip member, so each file stays
    a sequence of members."""
    ends = {"lineSep": EMPTY_MEMBER.decode("latin-1"), "encoding": "ISO-8859-1", "maxRecordsPerFile": 1}
    archives.select(F.col("value").cast("string")).write.options(**ends).text(path)


def write_arc(pages: DataFrame, path: str, *, versions: tuple[int, ...] = (1, 2), date: str = "20240101000000", archive_bytes: int = ARCHIVE_BYTES, page_id: str = "page_id", url: str = "url", html: str = "html") -> None:
    """Legacy archives of pages, their versions in turn. Null html is an empty payload, a
    null url `about:blank`; the page's id travels in the HTTP header."""

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def records():
            for batch in batches:
                for i, u, h in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                    payload = (h or "").encode()
                    own = "" if i is None else f"{PAGE_FIELD}: {i}\r\n"
                    block = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n{own}Content-Length: {len(payload)}\r\n\r\n".encode() + payload
                    yield lambda n, name, at, u=u, block=block: arc_record(versions[n % len(versions)], u or "about:blank", date, "text/html", block, at, name)

        yield from archives_of(records(), lambda n, name: version_block(versions[n % len(versions)], name, date), archive_bytes, "arc")

    save_archives(pages.select(page_id, url, html).mapInArrow(build, "value binary"), path)


ARC_SCHEMA = pa.schema([
    ("archive", pa.string()), ("offset", pa.int64()), ("uri", pa.string()), ("address", pa.string()), ("date", pa.string()), ("kind", pa.string()), ("http", pa.bool_()),
    ("page_id", pa.int64()), ("payload_bytes", pa.int64()), ("digest", pa.string()), ("block", pa.binary())])
ARC_COLUMNS = "archive string, offset long, uri string, address string, date string, kind string, http boolean, page_id long, payload_bytes long, digest string, block binary"


def each_archive(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, bytes]]:
    for batch in batches:
        for path, content in zip(batch.column(0), batch.column(1), strict=True):
            yield path.as_py().rsplit("/", 1)[-1], content.as_py()


def archive_files(spark: SparkSession, path: str) -> DataFrame:
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return files.select("path", "content")


def read_arc(spark: SparkSession, path: str, *, blocks: bool = True) -> DataFrame:
    """Records of the ARC archives in a folder (version blocks left out). A header line
    that can't be read fails the job rather than losing records."""

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows():
            for name, data in each_archive(batches):
                for offset, fields, block in pieces(data, ArcReader()):
                    if fields["first"]:
                        continue
                    http = http_parts(block)
                    payload = http[2] if http else block
                    yield (name, offset, fields["URL"], fields["IP-address"], iso_date(fields["Archive-date"]), fields["Content-type"], http is not None,
                           whole_number(http[0], PAGE_FIELD) if http else None, len(payload), payload_digest(payload), block if blocks else None)

        yield from batched(rows(), ARC_SCHEMA, lambda r: len(r[-1] or b""))

    return archive_files(spark, path).mapInArrow(parse, ARC_COLUMNS)


def revisits(records: DataFrame, least_bytes: int) -> DataFrame:
    """(archive, offset, of) of the records that revisit another: of equal payloads of at
    least least_bytes bytes, that of the largest page id (then archive and offset) is the
    response `of`. Groups that hold many records, of which there can't be many, are joined
    apart, so that no task gets all copies of one payload."""
    known = records.filter(F.col("http") & (F.col("payload_bytes") >= least_bytes))
    place = F.struct("page_id", "archive", "offset", "uri", "date")
    groups = stored(known.groupBy("digest").agg(F.max(place).alias("of"), F.count("*").alias("n")).filter("n > 1"), "warc-groups")
    many = max(1000, records.count() // 1000)
    found = [known.join(F.broadcast(groups.filter(F.col("n") > many)), "digest"), known.join(groups.filter(F.col("n") <= many), "digest")]
    rows = found[0].unionByName(found[1])
    return rows.filter((F.col("archive") != F.col("of.archive")) | (F.col("offset") != F.col("of.offset"))).select("archive", "offset", "of")


def warc_record(fields: dict[str, str | None], block: bytes) -> bytes:
    lines = [f"{k}: {v}" for k, v in fields.items() if v is not None]
    return ("WARC/1.1\r\n" + "\r\n".join([*lines, f"Content-Length: {len(block)}"]) + "\r\n\r\n").encode() + block + b"\r\n\r\n"


def converted(row: dict) -> bytes:
    """The WARC record of an ARC record; `of` is the response that it revisits, if it does."""
    block, of = row["block"], row["of"]
    fields = {"WARC-Type": "revisit" if of else "response" if row["http"] else "resource", "WARC-Record-ID": f"<{record_id(row['archive'], row['offset'])}>",
              "WARC-Date": row["date"], "WARC-Target-URI": header_safe(row["uri"]), "WARC-IP-Address": row["address"], "WARC-Payload-Digest": f"sha1:{row['digest']}"}
    if of:
        block = http_parts(block)[1]
        fields |= {"WARC-Profile": REVISIT_PROFILE, "WARC-Refers-To": f"<{record_id(of['archive'], of['offset'])}>", "WARC-Refers-To-Target-URI": header_safe(of["uri"]),
                   "WARC-Refers-To-Date": of["date"], SIZE_FIELD: str(row["payload_bytes"]), REFERS_PAGE_FIELD: None if of["page_id"] is None else str(of["page_id"])}
    fields |= {"WARC-Block-Digest": f"sha1:{payload_digest(block)}", "Content-Type": "application/http;msgtype=response" if row["http"] else row["kind"]}
    return warc_record(fields, block)


def convert_arc(spark: SparkSession, arc_path: str, warc_path: str, *, least_bytes: int = 0, archive_bytes: int = ARCHIVE_BYTES) -> None:
    """Write the records of a folder of ARC archives (versions 1 and 2, compressed or not)
    as WARC archives. HTTP records are responses, or revisits that keep their header only;
    others are resources. Each archive begins with a warcinfo record."""
    found = stored(read_arc(spark, arc_path, blocks=False).drop("block"), "arc-records")
    again = stored(revisits(found, least_bytes), "warc-revisits")
    rows = read_arc(spark, arc_path).join(again, ["archive", "offset"], "left")

    def info(number: int, name: str) -> bytes:
        fields = {"WARC-Type": "warcinfo", "WARC-Record-ID": f"<{record_id(name, 0)}>", "WARC-Date": iso_date("2024"), "WARC-Filename": name, "Content-Type": "application/warc-fields"}
        return warc_record(fields, b"software: leafaudit\r\nformat: WARC File Format 1.1\r\n")

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def records():
            for batch in batches:
                for at in range(batch.num_rows):
                    row = {n: c[at].as_py() for n, c in zip(batch.schema.names, batch.columns, strict=True)}
                    yield partial(lambda row, n, name, offset: converted(row), row)

        yield from archives_of(records(), info, archive_bytes, "warc")

    save_archives(rows.mapInArrow(build, "value binary"), warc_path)


def parse_warc(data: bytes, at: int) -> tuple[dict, bytes, int]:
    end = data.find(b"\r\n\r\n", at)
    head = data[at : end if end >= 0 else at].decode("utf-8", "replace").split("\r\n")
    fields = {}
    for line in head[1:]:
        name, _, value = line.partition(":")
        fields[name.strip().lower()] = value.strip()
    length = fields.get("content-length", "")
    if not head[0].startswith("WARC/") or not length.isdigit() or end + 4 + int(length) > len(data):
        raise ValueError(f"no WARC record: {head[0][:80]!r}")
    stop = end + 4 + int(length)
    return fields, data[end + 4 : stop], stop


WARC_SCHEMA = pa.schema([
    ("archive", pa.string()), ("offset", pa.int64()), ("record_type", pa.string()), ("record_id", pa.string()), ("date", pa.string()), ("target_uri", pa.string()), ("page_id", pa.int64()),
    ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("refers_to_record", pa.string()), ("refers_to", pa.int64()), ("payload", pa.binary())])
WARC_COLUMNS = (
    "archive string, offset long, record_type string, record_id string, date string, target_uri string, page_id long, payload_bytes long, payload_digest string, "
    "refers_to_record string, refers_to long, payload binary")


def read_warc(spark: SparkSession, path: str, *, payloads: bool = True) -> DataFrame:
    """Records of the WARC archives in a folder. Size and digest are those of the whole
    payload: computed from the record, and for a revisit, which has none, as it states
    them. A block that does not match its digest, or a payload its own, fails the job."""

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows():
            for name, data in each_archive(batches):
                for offset, fields, block in pieces(data, parse_warc):
                    kind, http = fields.get("warc-type", ""), http_parts(block)
                    own, payload = (http[0], http[2]) if http else ({}, block)
                    stated = fields.get("warc-payload-digest", "").removeprefix("sha1:") or None
                    digest, size = stated, whole_number(fields, SIZE_FIELD)
                    if kind != "revisit":
                        digest, size = payload_digest(payload), len(payload)
                    whole = fields.get("warc-block-digest", "").removeprefix("sha1:")
                    if stated not in (None, digest) or whole not in ("", payload_digest(block)):
                        raise ValueError(f"record at {offset} of {name} does not match its digest")
                    yield (name, offset, kind, fields.get("warc-record-id", "").strip("<>"), fields.get("warc-date"), fields.get("warc-target-uri"), whole_number(own, PAGE_FIELD), size, digest,
                           fields["warc-refers-to"].strip("<>") if "warc-refers-to" in fields else None, whole_number(fields, REFERS_PAGE_FIELD), payload if payloads and kind != "revisit" else None)

        yield from batched(rows(), WARC_SCHEMA, lambda r: len(r[-1] or b""))

    return archive_files(spark, path).mapInArrow(parse, WARC_COLUMNS)
