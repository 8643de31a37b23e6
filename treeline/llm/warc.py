"""Web-archive (WARC 1.1) writing with payload dedup, and a salvage reader.

Every record is written as a gzip member of its own.  The reader takes any WARC 1.x, plain or in
members of one or more records, and checks each member (gzip trailer) and record (version line,
Content-Length, block digest).  After a failed check it searches for the next gzip member that
starts with a version line, or in plain bytes for the next version line, and goes on there; the
bytes in between are logged as a quarantined gap.  Where a record should end is looked up before
its block is read, if the stream can seek.  Memory is that of the largest record and the compressed
bytes of the largest member.
"""

from __future__ import annotations

import base64
import hashlib
import io
import re
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from treeline.llm.shared import shared_dir, staged

VERSION = b"WARC/1.1"
VERSION_LINE = re.compile(rb"WARC/1\.[0-9]\r\n")
VERSION_BYTES = 10
GZIP = b"\x1f\x8b\x08"
READ = 1 << 20
#: Contents of a member up to this size are kept between its check and its reading.
HELD = 16 << 20
#: A header that has not ended after about this many bytes is unsound.
HEAD = 1 << 20
#: Salt values that spread the records of one payload over tasks.
SALTS = 32
HTTP_HEAD = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"


def record(headers: dict[str, str], block: bytes) -> bytes:
    """The bytes of one record."""
    head = {**headers, "WARC-Block-Digest": "sha256:" + hashlib.sha256(block).hexdigest(), "Content-Length": str(len(block))}
    lines = [VERSION.decode(), *(f"{k}: {v}" for k, v in head.items())]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def member(raw: bytes) -> bytes:
    """One gzip member, the same bytes for the same record."""
    z = zlib.compressobj(6, zlib.DEFLATED, 31)
    return z.compress(raw) + z.flush()


@dataclass
class Salvage:
    """What a reader found: records are yielded, ``gaps`` are (offset, length, reason)."""

    gaps: list[tuple[int, int, str]] = field(default_factory=list)


class _Window:
    """A forward window over a stream that can be looked at again from its start."""

    def __init__(self, stream):
        self.stream, self.data, self.base, self.ended = stream, bytearray(), 0, False

    def fill(self, n: int) -> bool:
        while len(self.data) < n and not self.ended:
            more = self.stream.read(max(READ, n - len(self.data)))
            self.ended = not more
            self.data += more
        return len(self.data) >= n

    def skip(self, n: int) -> None:
        del self.data[:n]
        self.base += n

    def holds(self, at: int, wanted: bytes) -> bool:
        """Whether ``wanted`` stands at ``at``, without keeping what lies before it if the stream can seek."""
        if len(self.data) < at + len(wanted) and getattr(self.stream, "seekable", lambda: False)():
            here = self.stream.tell()
            place = here - len(self.data) + at
            if hasattr(self.stream, "size") and place + len(wanted) > self.stream.size():
                return False
            self.stream.seek(place)
            found = self.stream.read(len(wanted))
            self.stream.seek(here)
            return found == wanted
        self.fill(at + len(wanted))
        return self.data[at : at + len(wanted)] == wanted


class _Member:
    """The content of the gzip member at a window's start; reading raises ValueError where it is unsound."""

    def __init__(self, window: _Window):
        self.window, self.z, self.at, self.rest, self.more, self.step = window, zlib.decompressobj(31), 0, b"", False, 1 << 13

    def read(self, n: int) -> bytes:
        while not self.z.eof:
            if not self.rest and not self.more:
                if not self.window.fill(self.at + 1):
                    raise ValueError("member cut off")
                self.rest = bytes(self.window.data[self.at : self.at + self.step])
                self.at += len(self.rest)
                self.step = min(2 * self.step, READ)
            try:
                out = self.z.decompress(self.rest, n)
            except zlib.error as error:
                raise ValueError(f"member unsound: {error}") from None
            self.rest, self.more = self.z.unconsumed_tail, len(out) == n
            if out:
                return out
        return b""

    def used(self) -> int:
        return self.at - len(self.z.unused_data)


def _content(window: _Window):
    """(content as a stream, compressed size) of the sound member at the window's start.

    The whole member is checked first; a content of more than ``HELD`` bytes is not kept but decompressed again as it is read.
    """
    member, pieces, size = _Member(window), [], 0
    while piece := member.read(READ):
        size += len(piece)
        if size <= HELD:
            pieces.append(piece)
        else:
            pieces.clear()
    return (io.BytesIO(b"".join(pieces)) if size <= HELD else _Member(window)), member.used()


def _headers(raw: bytes) -> dict[str, str]:
    lines = raw.decode("utf-8").split("\r\n")[1:]
    headers = {}
    for line in lines:
        name, colon, value = line.partition(":")
        if not colon:
            raise ValueError("header line without colon")
        headers[name.strip().lower()] = value.strip()
    return headers


def _differs(digest: str, block: bytes) -> bool:
    """Whether a digest, in hexadecimal or base32, of a known algorithm is not the block's."""
    name, _, value = digest.partition(":")
    if name.lower() not in ("md5", "sha1", "sha256"):
        return False
    own = hashlib.new(name.lower(), block).digest()
    return value.lower() != own.hex() and value.upper().rstrip("=") != base64.b32encode(own).decode().rstrip("=")


def _record(window: _Window) -> tuple[dict[str, str], bytes, int]:
    """(headers, block, bytes used) of the record at the window's start; ValueError if unsound."""
    window.fill(VERSION_BYTES)
    if not VERSION_LINE.match(window.data):
        raise ValueError("no version line")
    size = 1 << 12
    while (end := window.data.find(b"\r\n\r\n", 0, size)) < 0:
        if size > HEAD or not window.fill(size + 1):
            raise ValueError("header not ended")
        size *= 4
    headers = _headers(bytes(window.data[:end]))
    length = headers.get("content-length", "")
    if not (length.isascii() and length.isdigit()):
        raise ValueError("no content length")
    start, stop = end + 4, end + 4 + int(length)
    if not window.holds(stop, b"\r\n\r\n"):
        raise ValueError("record not ended where its length says")
    window.fill(stop + 4)
    block = bytes(window.data[start:stop])
    if _differs(headers.get("warc-block-digest", ""), block):
        raise ValueError("block digest differs")
    return headers, block, stop + 4


def _next_start(window: _Window, begin: int, members: bool = True) -> int:
    """Offset, from ``begin`` on, of the next version line or, unless switched off, member that opens a record."""
    at = begin
    while True:
        more = window.fill(at + READ)
        line = VERSION_LINE.search(window.data, at)
        spots = [line.start()] if line else []
        if members and (spot := window.data.find(GZIP, at)) >= 0:
            spots.append(spot)
        if not spots:
            if not more:
                return len(window.data)
            at = max(at, len(window.data) - VERSION_BYTES)
            continue
        at = min(spots)
        if window.data[at : at + 3] != GZIP:
            return at
        window.fill(at + 4096)
        try:
            if VERSION_LINE.match(zlib.decompressobj(31).decompress(bytes(window.data[at : at + 4096]), VERSION_BYTES)):
                return at
        except zlib.error:
            pass
        at += 1


def _inside(content, offset: int, used: int, log: Salvage) -> Iterator[tuple[int, dict[str, str], bytes]]:
    """Sound records of one member's content; what lies between them is logged as one gap of the member."""
    window, lost, first = _Window(content), 0, ""
    while window.fill(1):
        try:
            headers, block, size = _record(window)
        except ValueError as error:
            size = _next_start(window, 1, members=False)
            first = first or f"first at {window.base} of its content: {error}"
            lost += size
        else:
            yield offset, headers, block
        window.skip(size)
    if lost:
        log.gaps.append((offset, used, f"{lost} bytes inside a member, {first}"))


def read_records(stream, log: Salvage) -> Iterator[tuple[int, dict[str, str], bytes]]:
    """(offset, headers, block) of each sound record of a plain or gzip archive; gaps go to ``log``.

    Records of one member have the member's offset; a gap inside a member is logged with the whole member's range.
    An empty member holds no record and is no gap.
    """
    window = _Window(stream)
    while window.fill(1):
        content = None
        try:
            if window.data[:3] == GZIP or not window.fill(3):
                content, used = _content(window)
            else:
                headers, block, used = _record(window)
        except ValueError as error:
            used = _next_start(window, 1)
            log.gaps.append((window.base, used, str(error)))
        else:
            if content is None:
                yield window.base, headers, block
            else:
                yield from _inside(content, window.base, used, log)
        window.skip(used)


def with_originals(pages: DataFrame, min_bytes: int = 100, id_column: str = "page_id") -> DataFrame:
    """Adds ``digest, n_bytes, original``: the smallest id with the same payload of ``min_bytes`` or more.

    ``pages`` has ``id, url, payload``.  Counts are aggregated by task first; the rows of
    one payload, however many, are spread over ``SALTS`` values of a salt.
    """
    sized = pages.withColumn("n_bytes", F.length("payload").cast("long")).withColumn("digest", F.sha2("payload", 256))
    firsts = sized.where(F.col("n_bytes") >= min_bytes).groupBy("digest").agg(F.min("id").alias("original"), F.count("*").alias("n"))
    firsts = firsts.where(F.col("n") > 1).select("digest", "original", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    salted = sized.withColumn("salt", F.pmod(F.xxhash64("id"), F.lit(SALTS)).cast("int"))
    return salted.join(firsts, ["digest", "salt"], "left").drop("salt")


def write_archives(pages: DataFrame, folder: str, min_bytes: int = 100, id_column: str = "page_id", url_column: str = "url", html_column: str = "html") -> DataFrame:
    """One archive file for each partition; returns the manifest ``(file, records)``.

    Null html is an empty payload.  Of equal payloads of ``min_bytes`` or more, rows with
    the smallest id are response records and others revisit it; a row with a null id is a revisit
    if any row has an id, else a response.
    """
    plain = pages.select(F.col(id_column).cast("long").alias("id"), F.col(url_column).cast("string").alias("url"), F.coalesce(F.encode(html_column, "UTF-8"), F.lit(b"")).alias("payload"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        files, root = fs.FileSystem.from_uri(folder)
        name, hidden, n = f"part-{TaskContext.get().partitionId():06d}.warc.gz", f"{root}/.{uuid.uuid4().hex}", 0
        with files.open_output_stream(hidden, compression=None) as out:
            for batch in batches:
                columns = (batch.column(c).to_pylist() for c in ("id", "url", "payload", "n_bytes", "digest", "original"))
                for row in zip(*columns, strict=True):
                    out.write(member(_page_record(*row)))
                    n += 1
        files.move(hidden, f"{root}/{name}")
        yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([n])], names=["file", "records"])

    store, root = fs.FileSystem.from_uri(folder)
    store.create_dir(root, recursive=True)
    ready = with_originals(plain, min_bytes).select("id", "url", "payload", "n_bytes", "digest", "original")
    return staged(ready.mapInArrow(run, "file string, records long"), "warc-manifest")


def _page_record(page_id, url, payload, size, digest, original) -> bytes:
    headers = {"WARC-Record-ID": f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_OID, f'{page_id} {digest}')}>", "WARC-Date": "2000-01-01T00:00:00Z"}
    if page_id is not None:
        headers["X-Page-Id"] = str(page_id)
    if url is not None:
        headers["WARC-Target-URI"] = "".join(url.split())
    headers |= {"WARC-Payload-Digest": f"sha256:{digest}", "X-Payload-Bytes": str(size), "Content-Type": "application/http; msgtype=response"}
    if original is None or original == page_id:
        return record({"WARC-Type": "response", **headers}, HTTP_HEAD + payload)
    headers |= {"WARC-Profile": "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", "WARC-Refers-To": f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_OID, f'{original} {digest}')}>", "X-Refers-To-Page": str(original)}
    return record({"WARC-Type": "revisit", **headers}, HTTP_HEAD)


def read_archives(manifest: DataFrame, folder: str, with_payload: bool = True) -> DataFrame:
    """Records of all archives, and a row of type ``gap`` for each quarantined range.

    Columns: ``page_id, url, payload_bytes, payload_digest, record_type, refers_to, file,
    offset, gap_bytes, reason`` and, unless switched off, ``payload`` (null for revisits).
    A response's size and digest are those of the payload read; a revisit's are its headers'.
    """
    schema = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, file string, offset long, gap_bytes long, reason string" + ", payload binary" * with_payload
    names = [c.split()[0] for c in schema.split(", ")]
    kinds = {"long": pa.int64(), "string": pa.string(), "binary": pa.binary()}
    types = [kinds[c.split()[1]] for c in schema.split(", ")]
    number = lambda text: int(text) if text is not None and text.lstrip("-").isdigit() else None

    def rows(file: str, files, root: str) -> Iterator[tuple]:
        log, told = Salvage(), 0
        with files.open_input_file(f"{root}/{file}") as stream:
            for offset, h, block in read_records(stream, log):
                payload = block[block.find(b"\r\n\r\n") + 4 :]
                page, url, kind = number(h.get("x-page-id")), h.get("warc-target-uri"), h.get("warc-type")
                if kind == "response":
                    yield page, url, len(payload), hashlib.sha256(payload).hexdigest(), kind, None, file, offset, None, None, payload
                else:
                    yield page, url, number(h.get("x-payload-bytes")), h.get("warc-payload-digest", "").rpartition(":")[2], kind, number(h.get("x-refers-to-page")), file, offset, None, None, None
        for at, size, reason in log.gaps[told:]:
            yield None, None, None, None, "gap", None, file, at, size, reason, None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, root = fs.FileSystem.from_uri(folder)
        for batch in batches:
            for file in batch.column("file").to_pylist():
                held, size = [], 0
                for row in rows(file, files, root):
                    held.append(row)
                    size += 200 + (len(row[-1] or b"") if with_payload else 0)
                    if size > 4 << 20:
                        yield _rows(held, names, types)
                        held, size = [], 0
                if held:
                    yield _rows(held, names, types)

    tasks = max(1, min(manifest.count(), 4 * int(manifest.sparkSession.conf.get("spark.sql.shuffle.partitions"))))
    return manifest.select("file").repartition(tasks).mapInArrow(run, schema)


def _rows(held: list[tuple], names: list[str], types: list[pa.DataType]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in held], t) for i, t in enumerate(types)], names=names)


def archive_round_trip(pages: DataFrame) -> DataFrame:
    """Write all pages to archives in the shared folder and read their records back; a quarantined gap raises."""
    folder = shared_dir(pages.sparkSession, "warc")
    manifest = write_archives(pages, folder)
    found = read_archives(manifest, folder, with_payload=False)
    lost = F.raise_error(F.concat_ws(" ", F.lit("records lost in"), "file", F.lit("at"), "offset", F.lit(":"), "reason"))
    whole = found.withColumn("record_type", F.when(F.col("record_type") == "gap", lost.cast("string")).otherwise(F.col("record_type")))
    return whole.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
