"""WARC 1.1 archives: a writer with revisit records, and a reader that salvages what it can of damaged archives.

Archives are rows (name, content), as Spark's binaryFile source gives files. Records are gzip members of their own, or
plain. The reader checks each record (member checksum, version line, header block, content length, closing blank
lines, digests). After a check fails it searches for the next gzip member that begins a record or the next version line,
goes on from there, and logs the bytes between as a quarantined gap.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.scratch import Scratch

#: Bytes (compressed) after which the writer begins another archive.
ARCHIVE_BYTES = 8_000_000
_MAGIC = re.compile(rb"\x1f\x8b\x08")
_VERSION = re.compile(rb"WARC/\d+\.\d+\r\n")
_VERSION_ENDS = re.compile(rb"WARC/\d+\.\d+\Z")
#: A header line, with the lines that continue it; and how many of them a header block may have.
_LINE = re.compile(rb"([!#$%&'*+.^_`|~0-9A-Za-z-]{1,128})[ \t]*:([^\r\n]*(?:\r\n[ \t][^\r\n]*)*)\r\n")
_MOST_LINES = 1000
# Names that every record has, and those that a record may repeat.
_MANDATORY = ("warc-type", "warc-record-id", "warc-date", "content-length")
_REPEATED = ("warc-concurrent-to", "warc-protocol")
_SPACE = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")  # the namespace for URLs (fixed by RFC 4122)
_DATE = "2024-01-01T00:00:00Z"


def digest(payload: bytes) -> str:
    """Upper-case base32 of the SHA-1."""
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record_id(key: int | str) -> str:
    return f"<urn:uuid:{uuid.uuid5(_SPACE, f'page:{key}')}>"


def build_record(kind: str, key: int | str, uri: str | None, payload: bytes, refers_to: int | str | None = None, date: str = _DATE, own: str | None = None) -> bytes:
    """One plain record. A revisit keeps digest and length of the full payload but stores no block. `own` is what its record id is made of where the key names no record."""
    block = b"" if kind == "revisit" else payload
    uri = re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", uri or "")
    head = [f"WARC-Type: {kind}", f"WARC-Record-ID: {record_id(own or key)}", f"WARC-Date: {date}", f"WARC-Target-URI: {uri}", f"WARC-Payload-Digest: sha1:{digest(payload)}", f"WARC-Block-Digest: sha1:{digest(block)}", f"X-Page-ID: {key}", f"X-Payload-Length: {len(payload)}"]
    if kind == "revisit":
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: {record_id(refers_to)}", f"X-Refers-To-Page: {refers_to}"]
    head += ["Content-Type: text/html", f"Content-Length: {len(block)}"]
    return b"WARC/1.1\r\n" + "\r\n".join(head).encode("utf-8", "surrogatepass") + b"\r\n\r\n" + block + b"\r\n\r\n"


def gzip_member(data: bytes, level: int = 4) -> bytes:
    packer = zlib.compressobj(level, zlib.DEFLATED, 31)
    return packer.compress(data) + packer.flush()


@dataclass
class Record:
    """A record that passed every check: its place in the archive, headers (names in lower case) and block."""

    at: int
    size: int
    headers: dict[str, str]
    block: bytes


@dataclass
class Gap:
    """Bytes of the archive that belong to no valid record, and which check failed there; of a member with valid records too, the whole member."""

    at: int
    size: int
    reason: str


class _Bad(Exception):
    pass


def _headers(data: bytes | memoryview, at: int) -> tuple[dict[str, str], int]:
    """(headers, place of the block) of a header block that begins at `at`; raises _Bad where a check fails.

    A record that was cut off inside its header runs on into the next record's. That shows in a name that comes twice, or in a version
    line at the end of a value after which every mandatory name comes (once); so the next record keeps its own headers.
    """
    headers: dict[str, str] = {}
    after: set[str] | None = None
    for _ in range(_MOST_LINES):
        line = _LINE.match(data, at)
        if not line:
            break
        name, value = line[1].decode("ascii").lower(), line[2].strip()
        if name in headers and name not in _REPEATED:
            raise _Bad(f"{name} comes twice")
        headers.setdefault(name, value.decode("utf-8", "replace"))
        if after is not None:
            after.add(name)
        elif _VERSION_ENDS.search(value):
            after = set()
        at = line.end()
    if data[at : at + 2] != b"\r\n":
        raise _Bad("header line without a colon, or no end of the header")
    if after is not None and after.issuperset(_MANDATORY):
        raise _Bad("a version line inside the header")
    for name in _MANDATORY:
        if name not in headers:
            raise _Bad(f"no {name}")
    return headers, at + 2


def _agrees(labelled: str, block: bytes) -> bool:
    """Whether a digest with its label is the block's; True for algorithms that are not checked."""
    kind, _, value = labelled.partition(":")
    if kind.lower() != "sha1":
        return True
    sha1 = hashlib.sha1(block).digest()
    return value.upper() == base64.b32encode(sha1).decode() or value.lower() == sha1.hex()


def _plain_record(data: bytes | memoryview, at: int) -> tuple[dict[str, str], bytes, int]:
    """(headers, block, end) of the plain record at `at`; raises _Bad where a check fails."""
    version = _VERSION.match(data, at)
    if not version:
        raise _Bad("no version line")
    headers, start = _headers(data, version.end())
    length = headers["content-length"]
    if not re.fullmatch("[0-9]{1,18}", length):
        raise _Bad("no content length")
    stop = start + int(length)
    if data[stop : stop + 4] != b"\r\n\r\n":
        raise _Bad("record does not end where its length says")
    block = bytes(data[start:stop])
    # a payload inside an HTTP message, of a revisit or in segments is not the block
    is_payload = headers["warc-type"] != "revisit" and "warc-segment-number" not in headers and not headers.get("content-type", "").lower().startswith("application/http")
    for name, covers in (("warc-block-digest", True), ("warc-payload-digest", is_payload)):
        if covers and not _agrees(headers.get(name, ""), block):
            raise _Bad(f"{name} does not match")
    return headers, block, stop + 4


def _readable(reader, piece: bytes | memoryview) -> list[bytes]:
    """What can be decompressed of a piece that as a whole cannot: it is halved towards the damage."""
    parts = []
    while len(piece):
        half = (len(piece) + 1) // 2
        trial = reader.copy()
        try:
            parts.append(trial.decompress(piece[:half]))
            reader, piece = trial, piece[half:]
        except zlib.error:
            piece = piece[:half] if half < len(piece) else piece[:0]
    return parts


def _member(data: bytes | memoryview, at: int) -> tuple[bytes, int, str | None]:
    """(content, end, fault) of the gzip member at `at`; with a fault, what can be read of it."""
    reader = zlib.decompressobj(31)
    parts, next_ = [], at
    while not reader.eof and next_ < len(data):
        piece = data[next_ : next_ + (1 << 16)]
        before = reader.copy()
        try:
            parts.append(reader.decompress(piece))
        except zlib.error:
            return b"".join([*parts, *_readable(before, piece)]), at, "damaged gzip member"
        next_ += 1 << 16
    if not reader.eof:
        return b"".join(parts), at, "gzip member is cut off"
    return b"".join(parts), min(next_, len(data)) - len(reader.unused_data), None


def _inside(content: bytes, whole: bool) -> tuple[list[tuple[dict[str, str], bytes]], str | None]:
    """The valid records of a member's content, and the first check that failed. Of a damaged member the record that its readable bytes end with is not trusted."""
    found, fault, at = [], None, 0
    while at < len(content):
        try:
            headers, block, end = _plain_record(content, at)
            if whole or end < len(content):
                found.append((headers, block))
            at = end
        except _Bad as e:
            fault = fault or str(e)
            version = _VERSION.search(content, at + 1)
            at = version.start() if version else len(content)
    return found, fault


class _Starts:
    """Places that begin like a record. The next of either kind is kept until it is passed, so that every byte is searched once however many gaps there are."""

    def __init__(self, data: bytes | memoryview):
        self.data, self.version, self.member = data, -1, -1

    def after(self, at: int) -> int:
        """The first place from `at` on, or the end. Positions asked for must ascend."""
        if self.version < at:
            found = _VERSION.search(self.data, at)
            self.version = found.start() if found else len(self.data)
        while self.member < at:
            found = _MAGIC.search(self.data, at)
            while found and not self._begins_record(found.start()):
                found = _MAGIC.search(self.data, found.start() + 1)
            self.member = found.start() if found else len(self.data)
        return min(self.version, self.member)

    def _begins_record(self, at: int) -> bool:
        """Whether the gzip member that seems to start here begins like a record; the search skips chance matches."""
        try:
            return _VERSION.match(zlib.decompressobj(31).decompress(self.data[at : at + 512], 64)) is not None
        except zlib.error:
            return False


def _items(data: bytes | memoryview) -> Iterator[Record | Gap]:
    at, starts = 0, _Starts(data)
    while at < len(data):
        if _MAGIC.match(data, at):
            content, end, fault = _member(data, at)
            found, bad = _inside(content, fault is None)
            if fault:
                end = starts.after(at + 1)
            yield from (Record(at, end - at, headers, block) for headers, block in found)
            if fault or bad or not found:
                yield Gap(at, end - at, fault or bad or "empty member")
        else:
            try:
                headers, block, end = _plain_record(data, at)
                yield Record(at, end - at, headers, block)
            except _Bad as e:
                end = starts.after(at + 1)
                yield Gap(at, end - at, str(e))
        at = end


def read_archive(data: bytes | memoryview) -> Iterator[Record | Gap]:
    """Every record that can be told from the archive's bytes, in order, and the gaps between them; gaps that touch are one, with the first one's reason."""
    gap: Gap | None = None
    for item in _items(data):
        if isinstance(item, Gap) and gap and gap.at + gap.size == item.at:
            gap = Gap(gap.at, gap.size + item.size, gap.reason)
            continue
        if gap:
            yield gap
        gap = item if isinstance(item, Gap) else None
        if gap is None:
            yield item
    if gap:
        yield gap


def write_archives(records: DataFrame, compressed: bool = True) -> DataFrame:
    """Archives (name, content) of records(page_id, url, payload, record_type, refers_to); one task's records fill some archives.

    A record's id is made of its page_id, so rows that repeat a page_id repeat a record id; rows without page_id have an id each.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[bytes] = []
        size = nth = 0
        context = TaskContext.get()

        def flush() -> pa.RecordBatch:
            content = b"".join(held)
            name = hashlib.sha256(content).hexdigest()[:24] + (".warc.gz" if compressed else ".warc")
            return pa.RecordBatch.from_arrays([pa.array([name]), pa.array([content], pa.binary())], ["name", "content"])

        for batch in batches:
            for page, url, payload, kind, refers in zip(*(c for c in batch.columns), strict=True):
                key, nth = page.as_py(), nth + 1
                own = f"unnamed:{context.partitionId() if context else 0}:{nth}" if key is None else None
                record = build_record(kind.as_py(), "" if key is None else key, url.as_py(), (payload.as_py() or "").encode("utf-8", "surrogatepass"), refers.as_py(), own=own)
                held.append(gzip_member(record) if compressed else record)
                size += len(held[-1])
                if size >= ARCHIVE_BYTES:
                    yield flush()
                    held, size = [], 0
        if held:
            yield flush()

    return records.select("page_id", "url", "payload", "record_type", "refers_to").mapInArrow(run, "name string, content binary")


RECORDS = "archive string, at long, size long, page_id long, record_type string, payload_bytes long, payload_digest string, refers_to long, target_uri string, block binary, gap string"


def read_archives(archives: DataFrame, blocks: bool = True) -> DataFrame:
    """A row for each record and each quarantined gap of archives(name, content).

    Rows of a gap have `gap` (the failed check) and no record_type. blocks: whether to return the records' blocks. A null
    content gives no rows. An archive is a row, so it may have 2 GB at most; it is read in place, and besides it a task holds one member and
    one record at a time.
    """
    def number(x: str | None) -> int | None:
        return int(x) if x and re.fullmatch(r"-?[0-9]{1,19}", x) and -(1 << 63) <= int(x) < 1 << 63 else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [x.split()[0] for x in RECORDS.split(", ")]
        kinds = {"string": pa.string(), "long": pa.int64(), "binary": pa.binary()}
        schema = pa.schema([(x.split()[0], kinds[x.split()[1]]) for x in RECORDS.split(", ")])
        for batch in batches:
            for name, content in zip(batch.column(0), batch.column(1), strict=True):
                rows, size = [], 0
                for x in read_archive(memoryview(content.as_buffer()).cast("B") if content.is_valid else b""):  # no copy of the archive
                    row = dict.fromkeys(names) | {"archive": name.as_py(), "at": x.at, "size": x.size}
                    if isinstance(x, Gap):
                        row["gap"] = x.reason
                    else:
                        h = x.headers
                        full = h.get("x-payload-length")
                        row |= {"page_id": number(h.get("x-page-id")), "record_type": h.get("warc-type"), "payload_bytes": number(full) if h.get("warc-type") == "revisit" else len(x.block), "refers_to": number(h.get("x-refers-to-page")), "target_uri": h.get("warc-target-uri"), "block": x.block if blocks else None}
                        row["payload_digest"] = h.get("warc-payload-digest", "").removeprefix("sha1:") or digest(x.block)
                    rows.append(row)
                    size += len(row["block"] or b"")
                    if size > 16_000_000 or len(rows) >= 5000:
                        yield pa.RecordBatch.from_pylist(rows, schema=schema)
                        rows, size = [], 0
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, schema=schema)

    return archives.select("name", "content").mapInArrow(run, RECORDS)


def with_revisits(pages: DataFrame, scratch: Scratch, least_bytes: int = 0) -> DataFrame:
    """Records of pages(page_id, url, html): of equal payloads of at least `least_bytes` the largest page_id is a response, others revisit it.

    A null html is an empty payload. Rows that repeat a page_id with an equal payload are responses each, for
    there is no other page to refer to; rows without page_id are too. Only digests are aggregated, and the groups of several pages
    alone are joined back.
    """
    payload = F.coalesce(F.col("html"), F.lit(""))
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", payload.alias("payload"), F.sha2(payload, 256).alias("_key"))
    keys = pages.select(F.col("page_id").cast("long").alias("page_id"), F.sha2(payload, 256).alias("_key"), F.octet_length(payload).alias("_size")).where((F.col("_size") >= least_bytes) & F.col("page_id").isNotNull())
    groups = scratch.table(keys.groupBy("_key").agg(F.max("page_id").alias("_last"), F.min("page_id").alias("_first")).where("_first < _last").drop("_first"))
    scratch.keep(groups)
    rows = rows.join(groups, "_key", "left")
    revisit = F.col("page_id") < F.col("_last")
    return rows.select("page_id", "url", "payload", F.when(revisit, "revisit").otherwise("response").alias("record_type"), F.when(revisit, F.col("_last")).alias("refers_to"))


def archive_pages(pages: DataFrame, least_bytes: int = 0) -> DataFrame:
    """(page_id, payload_bytes, payload_digest, record_type, refers_to) of every page, written to archives and read back.

    The archives are written to the shared folder. Repeated rows are returned as often as they come; an empty table gives no rows.
    """
    scratch = Scratch(pages.sparkSession, "warc")
    archives = scratch.table(write_archives(with_revisits(pages, scratch, least_bytes)))
    scratch.keep(archives)
    return read_archives(archives, blocks=False).where("gap IS NULL").select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
