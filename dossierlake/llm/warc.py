"""Web archives in ZIP packages: written once, then read by ranges without extraction.

A package stores one member of gzip-compressed WARC records and one index member. The reader parses the
end-of-directory records (ZIP64 too), the central directory and the local headers, loads the index and
fetches records by byte range.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import io
import json
import struct
import uuid
import zipfile
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dossierlake.llm.common import shared_dir, staged

ARCHIVES, INDEXES = "archive/", "indexes/"
ARCHIVE, INDEX = ARCHIVES + "data.warc.gz", INDEXES + "index.cdxj"
HTTP_HEAD = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
PACKAGE_BYTES = 64 << 20
READ_BYTES = 4 << 20
DATE = "2000-01-01T00:00:00Z"


# ---- reading a package by ranges


@dataclass
class Member:
    name: str
    method: int
    size: int
    stored: int
    header: int


class ZipRanges:
    """The members of a ZIP file seen through a function (offset, length) -> bytes."""

    def __init__(self, read: Callable[[int, int], bytes], size: int):
        self.read, self.size = read, size
        self.members = {m.name: m for m in self._directory()}

    def _directory(self) -> Iterator[Member]:
        tail_at = max(0, self.size - 65557)
        tail = self.read(tail_at, self.size - tail_at)
        at = tail.rfind(b"PK\x05\x06")
        while at >= 0 and (len(tail) - at < 22 or at + 22 + struct.unpack_from("<H", tail, at + 20)[0] != len(tail)):
            at = tail.rfind(b"PK\x05\x06", 0, at)
        if at < 0:
            raise ValueError("no end of central directory: not a ZIP file, or cut short")
        count, length, start = struct.unpack_from("<H", tail, at + 10)[0], *struct.unpack_from("<II", tail, at + 12)
        where = tail_at + at - 20
        if where >= 0 and (locator := self.read(where, 20))[:4] == b"PK\x06\x07":
            end64 = self.read(struct.unpack_from("<Q", locator, 8)[0], 56)
            if end64[:4] != b"PK\x06\x06":
                raise ValueError("the ZIP64 locator points to no ZIP64 record")
            count, length, start = struct.unpack_from("<QQQ", end64, 32)
        data = self.read(start, length)
        at = 0
        for _ in range(count):
            if data[at : at + 4] != b"PK\x01\x02":
                raise ValueError("broken central directory")
            method = struct.unpack_from("<H", data, at + 10)[0]
            stored, size, n_name, n_extra, n_note = struct.unpack_from("<IIHHH", data, at + 20)
            header = struct.unpack_from("<I", data, at + 42)[0]
            name = data[at + 46 : at + 46 + n_name].decode("utf-8")
            extra = data[at + 46 + n_name : at + 46 + n_name + n_extra]
            size, stored, header = self._wide(extra, size, stored, header)
            yield Member(name, method, size, stored, header)
            at += 46 + n_name + n_extra + n_note

    @staticmethod
    def _wide(extra: bytes, *values: int) -> list[int]:
        """Values of 0xFFFFFFFF stand in the ZIP64 extra field, in order."""
        out, at = list(values), 0
        while at + 4 <= len(extra):
            tag, n = struct.unpack_from("<HH", extra, at)
            if tag == 1:
                field = at + 4
                for i, v in enumerate(out):
                    if v == 0xFFFFFFFF:
                        out[i] = struct.unpack_from("<Q", extra, field)[0]
                        field += 8
            at += 4 + n
        return out

    def data_start(self, name: str) -> int:
        m = self.members[name]
        if m.method != zipfile.ZIP_STORED:
            raise ValueError(f"{name} is compressed; only stored members can be read by ranges")
        head = self.read(m.header, 30)
        if head[:4] != b"PK\x03\x04":
            raise ValueError(f"{name} has no local header")
        return m.header + 30 + sum(struct.unpack_from("<HH", head, 26))

    def member(self, name: str) -> bytes:
        return self.read(self.data_start(name), self.members[name].size)


def parse_record(raw: bytes) -> tuple[dict[str, str], bytes]:
    """Headers (names in lower case) and block of one WARC record, gzip-compressed or plain."""
    plain = gzip.decompress(raw) if raw[:2] == b"\x1f\x8b" else raw
    head, _, rest = plain.partition(b"\r\n\r\n")
    first, *lines = head.decode("utf-8").split("\r\n")
    if not first.startswith("WARC/"):
        raise ValueError("not a WARC record")
    headers = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines)}
    return headers, rest[: int(headers["content-length"])]


def http_payload(block: bytes) -> bytes:
    """The payload of a response's block: what follows its HTTP head, or all of a block without one."""
    if not block.startswith(b"HTTP/"):
        return block
    return block.partition(b"\r\n\r\n")[2]


def index_lines(z: ZipRanges) -> Iterator[dict]:
    """The places of all records, from every index member (CDXJ, gzip-compressed or plain)."""
    for name in sorted(n for n in z.members if n.startswith(INDEXES) and n.rstrip("/") != INDEXES.rstrip("/")):
        if not name.endswith((".cdxj", ".cdxj.gz", ".cdx", ".cdx.gz")):
            continue
        data = z.member(name)
        for line in (gzip.decompress(data) if data[:2] == b"\x1f\x8b" else data).decode("utf-8").splitlines():
            at = line.find("{")
            if line[:1] != "!" and at >= 0:
                yield json.loads(line[at:])


def read_package(read: Callable[[int, int], bytes], size: int) -> Iterator[tuple[dict[str, str], bytes]]:
    """Headers and payload of all records of a package in index order, from whichever archive member each index line names; neighbouring records share a ranged read of at most READ_BYTES, or one record.

    Offsets and lengths may be numbers or their text. A name without a folder is looked for below ARCHIVES.
    """
    z = ZipRanges(read, size)
    places = []
    for x in index_lines(z):
        name = x.get("filename") or ARCHIVE
        places.append((name if name in z.members else ARCHIVES + name, int(x["offset"]), int(x["length"])))
    starts: dict[str, int] = {}
    at = 0
    while at < len(places):
        member, first, _ = places[at]
        if member not in z.members:
            raise ValueError(f"the index names {member}, which the package does not hold")
        base = starts.setdefault(member, -1)
        if base < 0:
            base = starts[member] = z.data_start(member)
        end = at + 1
        while end < len(places) and places[end][0] == member and places[end][1] == sum(places[end - 1][1:]) and sum(places[end][1:]) - first <= READ_BYTES:
            end += 1
        block = read(base + first, sum(places[end - 1][1:]) - first)
        for _, offset, length in places[at:end]:
            headers, own = parse_record(block[offset - first : offset - first + length])
            yield headers, http_payload(own)
        at = end


# ---- writing packages


def digest32(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(page_id: int | None, url: str, payload: bytes, original: int | None, record_id: str | None = None) -> bytes:
    """One WARC record; original: the page whose response this one revisits, or None for a response. record_id: by default the page's."""
    kind = "response" if original is None else "revisit"
    headers = {
        "WARC-Type": kind,
        "WARC-Record-ID": record_id or f"<urn:page:{'' if page_id is None else page_id}>",
        **({} if page_id is None else {"X-Page-ID": str(page_id)}),
        "WARC-Target-URI": "".join(url.split()),
        "WARC-Date": DATE,
        "WARC-Payload-Digest": f"sha1:{digest32(payload)}",
        "X-Payload-Length": str(len(payload)),
        "Content-Type": "application/http; msgtype=response",
    }
    if original is not None:
        headers |= {"WARC-Profile": "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", "WARC-Refers-To": f"<urn:page:{original}>"}
    block = HTTP_HEAD + (payload if original is None else b"")
    headers["Content-Length"] = str(len(block))
    head = "".join(f"{k}: {v}\r\n" for k, v in headers.items())
    return gzip.compress(b"WARC/1.1\r\n" + head.encode("utf-8") + b"\r\n" + block + b"\r\n\r\n", 1, mtime=0)


class PackageWriter:
    """Collects records up to PACKAGE_BYTES and hands out whole packages."""

    def __init__(self):
        self.archive, self.index, self.ids = io.BytesIO(), [], set()

    def add(self, page_id: int | None, url: str, payload: bytes, original: int | None) -> None:
        # a page that repeats, or has no id, is a record with an id of its own
        own = page_id is not None and page_id not in self.ids
        raw = record(page_id, url, payload, original, None if own else f"<urn:uuid:{uuid.uuid4()}>")
        if own:
            self.ids.add(page_id)
        place = {"offset": self.archive.tell(), "length": len(raw), "filename": ARCHIVE}
        self.index.append(f"{'' if page_id is None else page_id} {DATE} {json.dumps(place)}\n")
        self.archive.write(raw)

    def full(self) -> bool:
        return self.archive.tell() >= PACKAGE_BYTES

    def finish(self) -> bytes:
        out = io.BytesIO()
        with zipfile.ZipFile(out, "w", zipfile.ZIP_STORED) as z:
            for name, data in ((ARCHIVE, self.archive.getbuffer()), (INDEX, "".join(self.index).encode("utf-8"))):
                with z.open(zipfile.ZipInfo(name), "w", force_zip64=True) as f:
                    f.write(data)
        self.archive, self.index, self.ids = io.BytesIO(), [], set()
        return out.getvalue()


def _filesystem(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri)


def with_originals(pages: DataFrame, least_payload: int = 0) -> DataFrame:
    """page_id, url, html and `original`: the smallest page_id with an equal payload, or null for that page itself."""
    html = F.coalesce(F.col("html"), F.lit(""))
    rows = pages.select("page_id", F.coalesce(F.col("url"), F.lit("")).alias("url"), html.alias("html"), F.sha2(html.cast("binary"), 256).alias("same"))
    firsts = rows.filter(F.octet_length("html") >= least_payload).groupBy(F.col("same").alias("same_")).agg(F.min("page_id").alias("first"))
    joined = rows.join(staged(firsts, "first-pages"), F.col("same") == F.col("same_"), "left")
    return joined.select("page_id", "url", "html", F.when(~F.col("page_id").eqNullSafe(F.col("first")), F.col("first")).alias("original"))


def write_archives(pages: DataFrame, folder: str, least_payload: int = 0) -> DataFrame:
    """Write every page into ZIP packages under the folder (a URI); returns their path, size and record count.

    A package appears under a name of its own; only packages of tasks that ended well are listed, so a
    task that runs again leaves no double records.
    """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, root = _filesystem(folder)
        files.create_dir(root, recursive=True)
        writer = PackageWriter()

        def flush() -> pa.RecordBatch:
            n, data = len(writer.index), writer.finish()
            name = f"part-{uuid.uuid4().hex}.zip"
            with files.open_output_stream(f"{root}/{name}") as f:
                f.write(data)
            return pa.RecordBatch.from_pydict({"name": [name], "n_bytes": pa.array([len(data)], pa.int64()), "n_records": pa.array([n], pa.int64())})

        for batch in batches:
            columns = [batch.column(k) for k in ("page_id", "url", "html", "original")]
            for i in range(batch.num_rows):
                page_id, url, html, original = (c[i].as_py() for c in columns)
                writer.add(page_id, url, html.encode("utf-8"), original)
                if writer.full():
                    yield flush()
        if writer.index:
            yield flush()

    return staged(with_originals(pages, least_payload).mapInArrow(work, "name string, n_bytes long, n_records long"), "packages")


READ = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, payload string"


def read_archives(packages: DataFrame, folder: str, payloads: bool = True) -> DataFrame:
    """One row per record of the listed packages; a record's payload digest is checked where it has a payload."""

    def number(urn: str | None) -> int | None:
        digits = (urn or "").strip("<>").rpartition(":")[2]
        return int(digits) if digits else None

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, root = _filesystem(folder)
        schema = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("payload", pa.string())])
        for batch in batches:
            for name, size in zip(batch.column("name").to_pylist(), batch.column("n_bytes").to_pylist(), strict=True):
                with files.open_input_file(f"{root}/{name}") as f:
                    rows, held = [], 0
                    for headers, block in read_package(lambda at, n, f=f: f.read_at(n, at), size):
                        digest = headers["warc-payload-digest"].partition(":")[2]
                        kind = headers["warc-type"]
                        if kind == "response" and digest32(block) != digest:
                            raise ValueError(f"{name}: a payload differs from its digest")
                        rows.append({
                            "page_id": number(headers.get("x-page-id")), "url": headers["warc-target-uri"], "payload_bytes": int(headers["x-payload-length"]), "payload_digest": digest,
                            "record_type": kind, "refers_to": number(headers["warc-refers-to"]) if kind == "revisit" else None, "payload": block.decode("utf-8") if payloads and kind == "response" else None,
                        })
                        held += len(block)
                        if held > READ_BYTES or len(rows) >= 10000:
                            yield pa.RecordBatch.from_pylist(rows, schema)
                            rows, held = [], 0
                    if rows:
                        yield pa.RecordBatch.from_pylist(rows, schema)

    n = max(1, packages.count())
    return packages.repartition(n, "name").mapInArrow(work, READ)


def archive_round_trip(pages: DataFrame, least_payload: int = 0) -> DataFrame:
    """Archive every page and read the archives back: page_id, payload_bytes, payload_digest, record_type, refers_to.

    Null html is an empty payload; all empty payloads equal each other. Rows that repeat a page are
    records of their own: those with the smallest id are responses, as no smaller page stands for them.
    A null page_id never stands for others unless all equal payloads have none. An empty table writes
    no package and gives no rows. Columns besides page_id, url and html are not read.
    """
    folder = f"{shared_dir(pages.sparkSession)}/archives/{uuid.uuid4().hex}"
    packages = write_archives(pages, folder, least_payload)
    return read_archives(packages, folder, payloads=False).drop("url", "payload")
