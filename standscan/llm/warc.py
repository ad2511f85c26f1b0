"""WARC archives: a deduplicating writer and a salvage reader.

Writer: every row becomes one gzip member with one WARC/1.1 record. Of rows with equal
payloads, the one with the largest id is a ``response``; the others are ``revisit``
records that refer to it and keep the HTTP head, whose Content-Length is that of the
full payload. Archives are files in the shared folder, rolled at ``archive_bytes``; a
task writes under a name of its own attempt and reports it once complete, so a repeated
task leaves no half archive behind in the manifest.

Salvage reader: reads an archive from start to end. A member or record that fails a check
(gzip data and checksum, version line, header block, length, end mark, payload digest)
opens a gap; the reader then searches byte by byte for the next gzip member or version
line that starts a record passing all checks, and goes on there. Gaps are returned as rows
with their offset, length and first reason. A gzip member may hold many records; it is
inflated to a spooled file and read in the same way. All its rows have the member's offset,
and the first of them has its length, so that lengths add up to the archive's. Of a member
that is cut short, the records that more data follows are returned before the gap. A member
whose data or checksum is wrong is a gap as a whole, as its headers cannot be trusted.

Defined results: a null payload is empty. Payloads shorter than ``min_bytes`` are always
responses. A null id is written as a record without an id number and is never the one
referred to, unless all ids of its group are null; then all are responses. Rows that tie
for the largest id are all responses.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import re
import tempfile
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from standscan.llm.batches import slices
from standscan.session import discard, materialise, new_path

VERSION = re.compile(rb"WARC/1\.[01]\r\n")
START = re.compile(rb"\x1f\x8b\x08|WARC/1\.[01]\r\n")
MAGIC = b"\x1f\x8b\x08"
READ = 1 << 20
SPOOL = 32 << 20
CUT = "gzip member is cut short"
STAMP = "2024-01-01T00:00:00Z"


class Damaged(Exception):
    """A check that failed at some offset."""


def base32_sha1(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload, usedforsecurity=False).digest()).decode()


# ---------------------------------------------------------------- writing


def record_bytes(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, revisit: bool, stamp: str = STAMP) -> bytes:
    """One uncompressed record."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http if revisit else http + payload
    target = re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url or "")
    heads = [
        "WARC/1.1",
        f"WARC-Type: {'revisit' if revisit else 'response'}",
        f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>",
        f"WARC-Date: {stamp}",
        f"WARC-Target-URI: {target}",
        f"WARC-Payload-Digest: sha1:{base32_sha1(payload)}",
        f"WARC-Block-Digest: sha1:{base32_sha1(block)}",
    ]
    if revisit:
        heads.append("WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")
        heads.append(f"WARC-Refers-To: <urn:page:{refers_to}>")
    heads += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(heads).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def _writer(folder: str, archive_bytes: int, level: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = pafs.FileSystem.from_uri(folder)
        fs.create_dir(base, recursive=True)
        out, path, size, count, done = None, "", 0, 0, []

        def close() -> None:
            nonlocal out
            if out is not None:
                out.close()
                done.append((path, count, size))
                out = None

        for batch in slices(batches):
            for row in batch.to_pylist():
                if out is None:
                    path, size, count = f"{folder}/{uuid.uuid4().hex}.warc.gz", 0, 0
                    out = fs.open_output_stream(f"{base}/{path.rsplit('/', 1)[1]}", compression=None)
                raw = record_bytes(row["k"], row["u"], (row["h"] or "").encode("utf-8", "surrogatepass"), row["ref"], row["ref"] is not None)
                member = gzip.compress(raw, compresslevel=level, mtime=0)
                out.write(member)
                size, count = size + len(member), count + 1
                if size >= archive_bytes:
                    close()
        close()
        yield pa.RecordBatch.from_pydict({"path": [d[0] for d in done], "records": [d[1] for d in done], "bytes": [d[2] for d in done]}, pa.schema([("path", pa.string()), ("records", pa.int64()), ("bytes", pa.int64())]))

    return run


def write_archives(pages: DataFrame, id_col: str = "page_id", url: str = "url", payload: str = "html", min_bytes: int = 0, archive_bytes: int = 32 << 20, level: int = 1) -> DataFrame:
    """Write all rows and return the manifest ``(path, records, bytes)``, itself a written table."""
    spark = pages.sparkSession
    body = F.coalesce(F.col(payload), F.lit(""))
    rows = pages.select(F.col(id_col).cast("bigint").alias("k"), F.col(url).alias("u"), body.alias("h"), F.unhex(F.sha1(body)).alias("d"))
    groups = rows.where(F.octet_length("h") >= min_bytes).groupBy("d").agg(F.max("k").alias("top"), F.count("*").alias("n")).where("n > 1 and top is not null")
    tops = materialise(groups.select("d", "top"), "warc-tops")
    ref = F.when(F.col("top").isNotNull() & ~F.col("k").eqNullSafe(F.col("top")) & (F.octet_length("h") >= min_bytes), F.col("top"))
    typed = rows.join(tops, "d", "left").select("k", "u", "h", ref.alias("ref"))
    folder = new_path(spark, "warc")
    if "://" not in folder:
        folder = "file://" + folder
    manifest = materialise(typed.mapInArrow(_writer(folder, archive_bytes, level), "path string, records bigint, bytes bigint"), "warc-manifest")
    discard(tops)
    return manifest


# ---------------------------------------------------------------- reading


class Source:
    """Random access to a file through a window, so that a scan needs no whole file in memory."""

    def __init__(self, handle, size: int) -> None:
        self.handle, self.size, self.at, self.data = handle, size, 0, b""

    def read(self, at: int, n: int) -> bytes:
        n = max(0, min(n, self.size - at))
        if at < self.at or at + n > self.at + len(self.data):
            self.handle.seek(at)
            self.at, self.data = at, self.handle.read(max(n, READ))
        return self.data[at - self.at : at - self.at + n]


def _inflate(source: Source, at: int) -> tuple[Source, int, bool]:
    """The content of the gzip member at ``at``, where it ends, and whether it is cut short."""
    machine, out, pos = zlib.decompressobj(31), tempfile.SpooledTemporaryFile(max_size=SPOOL), at
    try:
        while not machine.eof:
            piece = source.read(pos, 1 << 16)
            pos += len(piece)
            more = machine.decompress(piece, READ)
            if not piece and not more:
                break
            out.write(more)
            while machine.unconsumed_tail and not machine.eof:
                out.write(machine.decompress(machine.unconsumed_tail, READ))
    except zlib.error as e:
        out.close()
        raise Damaged(f"gzip: {e}") from None
    return Source(out, out.tell()), pos - len(machine.unused_data), not machine.eof


def _parse(head_and_rest, total: int) -> tuple[dict[str, str], int, int]:
    """Headers, offset of the block and its length, from ``head_and_rest(at, n)``."""
    size = 1 << 16
    head = head_and_rest(0, size)
    if not VERSION.match(head):
        raise Damaged("no version line")
    while (stop := head.find(b"\r\n\r\n")) < 0:
        if size >= total:
            raise Damaged("header block has no end")
        if any(b":" not in line for line in head.split(b"\r\n")[1:-1]):
            raise Damaged("header line without a colon")
        size *= 2
        head = head_and_rest(0, size)
    heads: dict[str, str] = {}
    for line in head[:stop].split(b"\r\n")[1:]:
        name, colon, value = line.partition(b":")
        if not colon:
            raise Damaged("header line without a colon")
        heads[name.decode("latin-1").strip().lower()] = value.decode("utf-8", "replace").strip()
    if not re.fullmatch(r"\d{1,15}", heads.get("content-length", "")):
        raise Damaged("no content length")
    length = int(heads["content-length"])
    if stop + 4 + length + 4 > total:
        raise Damaged("record is longer than its data")
    if head_and_rest(stop + 4 + length, 4) != b"\r\n\r\n":
        raise Damaged("no end mark after the block")
    return heads, stop + 4, length


def _checked(heads: dict[str, str], block: bytes) -> tuple[dict[str, str], bytes]:
    """Payload of a block whose digests hold."""
    want = heads.get("warc-block-digest", "")
    if want.startswith("sha1:") and want[5:] != base32_sha1(block):
        raise Damaged("block digest differs")
    payload = block
    if heads.get("content-type", "").startswith("application/http"):
        _, mark, payload = block.partition(b"\r\n\r\n")
        if not mark:
            raise Damaged("HTTP head has no end")
    want = heads.get("warc-payload-digest", "")
    if heads.get("warc-type") != "revisit" and want.startswith("sha1:") and want[5:] != base32_sha1(payload):
        raise Damaged("payload digest differs")
    return heads, payload


def _record(source: Source, at: int) -> tuple[dict[str, str], bytes, bytes, int]:
    """``(headers, block, payload, end)`` of the plain record at ``at``, if it passes all checks."""
    heads, start, length = _parse(lambda i, n: source.read(at + i, n), source.size - at)
    heads, payload = _checked(heads, block := source.read(at + start, length))
    return heads, block, payload, at + start + length + 4


def _next_start(source: Source, at: int, start: re.Pattern = START) -> int:
    """The next offset at or after ``at`` that looks like a member or version line."""
    while at < source.size:
        piece = source.read(at, READ)
        found = start.search(piece)
        if found:
            return at + found.start()
        if at + len(piece) >= source.size:
            break
        at += max(1, len(piece) - 16)
    return source.size


def _walk(source: Source, packed: bool) -> Iterator[tuple]:
    """Records and gaps of a source; with ``packed``, also those inside its gzip members."""
    at, gap, reason, size = 0, None, "", source.size
    while at < size:
        try:
            if packed and source.read(at, 3) == MAGIC:
                rows, end, cut = _member(source, at)
            else:
                heads, block, payload, end = _record(source, at)
                rows, cut = iter([(None, heads, block, payload)]), False
        except Damaged as e:
            if gap is None:
                gap, reason = at, str(e)
            at = _next_start(source, at + 1, START if packed else VERSION)
            continue
        if gap is not None:
            yield gap, at - gap, reason, None, None, None
            gap = None
        length = 0 if cut else end - at
        for row in rows:
            yield at, length, *row
            length = 0
        if cut:
            gap, reason = at, CUT
            at = _next_start(source, at + 1)
        else:
            at = end
    if gap is not None:
        yield gap, size - gap, reason, None, None, None


def _member(source: Source, at: int) -> tuple[Iterator[tuple], int, bool]:
    """``(reason, headers, block, payload)`` of what the member at ``at`` holds, its end, and whether it is cut short."""
    inner, end, cut = _inflate(source, at)
    # What runs to the end of a member that is cut short is not known to be whole.
    items = (i for i in _walk(inner, False) if not (cut and i[0] + i[1] == inner.size))
    first = next(items, None)
    if first is None or first[2] and first[1] == inner.size:
        inner.handle.close()
        raise Damaged(CUT if cut else first[2] if first else "no version line")

    def rows() -> Iterator[tuple]:
        with inner.handle:
            yield first[2:]
            for item in items:
                yield item[2:]

    return rows(), end, cut


def salvage(handle, size: int) -> Iterator[tuple]:
    """``(offset, length, reason, headers, block, payload)`` of every record, or gap with a reason."""
    return _walk(Source(handle, size), True)


READ_SCHEMA = "path string, offset bigint, length bigint, gap_reason string, headers map<string,string>, http_length bigint, payload binary"


def _reader(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema(
        [("path", pa.string()), ("offset", pa.int64()), ("length", pa.int64()), ("gap_reason", pa.string()), ("headers", pa.map_(pa.string(), pa.string())), ("http_length", pa.int64()), ("payload", pa.binary())]
    )
    for batch in slices(batches):
        for path in batch.column("path").to_pylist():
            fs, inner = pafs.FileSystem.from_uri(path)
            rows, held = [], 0
            with fs.open_input_file(inner) as handle:
                for offset, length, reason, heads, block, payload in salvage(handle, handle.size()):
                    declared = re.search(rb"(?im)^content-length:\s*(\d{1,15})\s*$", (block or b"").partition(b"\r\n\r\n")[0])
                    rows.append((path, offset, length, reason, list(heads.items()) if heads else None, int(declared[1]) if declared else None, payload))
                    held += length + len(payload or b"")
                    if held > 4 * READ:
                        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)
                        rows, held = [], 0
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)


def read_archives(paths: DataFrame, path: str = "path", size: str = "bytes", task_bytes: int = 64 << 20) -> DataFrame:
    """Every record and every quarantined gap of the archives named in ``paths``.

    Archives are dealt out evenly to as many tasks as ``task_bytes`` asks for, by the sizes in
    the column ``size`` if there is one, but to no fewer than the cluster's cores; one task
    streams one archive at a time. ``gap_reason`` is null for records.
    """
    sizes = F.col(size).cast("bigint") if size in paths.columns else F.lit(task_bytes)
    names = paths.where(F.col(path).isNotNull()).groupBy(F.col(path).alias("path")).agg(F.max(sizes).alias("bytes"))
    names = materialise(names, "warc-paths")
    total = names.agg(F.count("*").alias("n"), F.sum("bytes").alias("b")).first()
    tasks = max(2 * paths.sparkSession.sparkContext.defaultParallelism, -(-(total["b"] or 0) // task_bytes))
    return names.select("path").repartition(max(1, min(total["n"], tasks))).mapInArrow(_reader, READ_SCHEMA)


def list_archives(spark, glob: str) -> DataFrame:
    """``(path, bytes)`` of the files that match, listed by Spark without reading them."""
    return spark.read.format("binaryFile").load(glob).select("path", F.col("length").alias("bytes"))


def summary(records: DataFrame, id_col: str = "page_id") -> DataFrame:
    """Per record: id, size and digest of the full payload, type, and the id it refers to.

    The size of a response is that of its payload; a revisit has none, so its HTTP head tells.
    """
    h = F.col("headers")
    number = lambda c: F.regexp_extract(c, r"<urn:page:(-?\d+)>", 1)
    as_id = lambda c: F.when(number(c) != "", number(c).cast("bigint"))
    own = F.octet_length("payload").cast("bigint")
    return records.where("gap_reason is null").select(
        as_id(h["warc-record-id"]).alias(id_col),
        F.when(h["warc-type"] == "revisit", F.coalesce("http_length", own)).otherwise(own).alias("payload_bytes"),
        F.substring_index(h["warc-payload-digest"], ":", -1).alias("payload_digest"),
        h["warc-type"].alias("record_type"),
        as_id(h["warc-refers-to"]).alias("refers_to"),
    )


#: The same result in DuckDB SQL. Base32 is spelled out from the hexadecimal digest.
ORACLE_SQL = """
with p as (select page_id, coalesce(html, '') as h from pages),
d as (select page_id, octet_length(encode(h))::bigint as payload_bytes, sha1(h) as x, max(page_id) over (partition by sha1(h)) as top from p),
b as (select *, array_to_string(list_transform(range(1, 41), lambda i:
        ['0000','0001','0010','0011','0100','0101','0110','0111','1000','1001','1010','1011','1100','1101','1110','1111']
        [instr('0123456789abcdef', substr(x, i, 1))]), '') as bits from d)
select page_id, payload_bytes,
       array_to_string(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
         1 + 16 * substr(bits, 5*i+1, 1)::int + 8 * substr(bits, 5*i+2, 1)::int + 4 * substr(bits, 5*i+3, 1)::int
           + 2 * substr(bits, 5*i+4, 1)::int + substr(bits, 5*i+5, 1)::int, 1)), '') as payload_digest,
       case when page_id = top then 'response' else 'revisit' end as record_type,
       case when page_id = top then null else top end as refers_to
from b
"""
