"""WARC archives: a writer with revisit records, and a reader that salvages damage.

Archives are gzip members, one a record, in files of a bounded size in the
shared folder.  Tasks write files of their own and hand back their names, so a
repeated task leaves at most files that nobody reads.  The reader streams a
file in blocks; when a member or record fails its checks it searches for the
next gzip member or version line that begins a valid record, goes on there and
logs the bytes between as a quarantined gap.

Defined results: a null html is an empty payload; of rows with equal payload
(100 bytes or more) and equal smallest page_id each is a response; null
page_ids count as larger than any other; an empty table gives an empty result;
other columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import finished, read_table, scratch_path, written

MIN_REVISIT = 100
FILE_BYTES = 64 << 20
BLOCK, STEP = 1 << 20, 1 << 14  # bytes read, and unpacked, at a time
VERSION = b"WARC/1.1"
MEMBER = b"\x1f\x8b\x08"


# Records


def record_bytes(headers: dict[str, str], payload: bytes) -> bytes:
    lines = [VERSION.decode(), *(f"{k}: {v}" for k, v in headers.items()), f"Content-Length: {len(payload)}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + payload + b"\r\n\r\n"


def page_record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None, revisit: bool) -> bytes:
    name = "none" if page_id is None else str(page_id)
    head = {
        "WARC-Type": "revisit" if revisit else "response",
        "WARC-Record-ID": f"<urn:page:{name}>",
        "WARC-Date": "2024-01-01T00:00:00Z",
        "WARC-Target-URI": re.sub(r"\s", "%20", url or ""),
        "WARC-Payload-Digest": f"sha256:{digest}",
        "X-Payload-Length": str(len(payload)),
    }
    if revisit:
        head["WARC-Refers-To"] = f"<urn:page:{'none' if refers_to is None else refers_to}>"
        head["WARC-Profile"] = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
    return record_bytes(head, b"" if revisit else payload)


def gzip_member(data: bytes, level: int = 3) -> bytes:
    packer = zlib.compressobj(level, zlib.DEFLATED, 31)
    return packer.compress(data) + packer.flush()


# Salvage reader


class Source:
    """A window over a file that grows on demand and forgets what was consumed; places are kept, so nothing is searched twice."""

    def __init__(self, stream) -> None:
        self.stream, self.data, self.base, self.at, self.ended = stream, bytearray(), 0, 0, False
        self.marks: dict[bytes, tuple[int, int]] = {}  # place of the next mark (or -1), and up to where the file has been searched

    def need(self, n: int) -> bool:
        """Whether n bytes from here are there."""
        while self.base + len(self.data) < self.at + n and not self.ended:
            got = self.stream.read(max(BLOCK, self.at + n - self.base - len(self.data)))
            self.ended = not got
            self.data += got
        return self.base + len(self.data) >= self.at + n

    def view(self, start: int, n: int) -> bytes:
        """n bytes of what has been read, from start bytes after here."""
        k = self.at - self.base + start
        return bytes(self.data[k : k + n])

    def starts(self, mark: bytes) -> bool:
        return self.data.startswith(mark, self.at - self.base)

    def find(self, mark: bytes, grow: bool = True) -> int:
        """Distance of the next mark from here, -1 if none follows (in what has been read, unless grow)."""
        found, searched = self.marks.get(mark, (-1, 0))
        while found < self.at:
            start = max(self.at, searched - len(mark) + 1)
            place = self.data.find(mark, start - self.base)
            if place >= 0:
                found = self.base + place
                searched = found + len(mark)
                break
            found, searched = -1, self.base + len(self.data)
            if not (grow and self.need(searched - self.at + 1)):
                break
        self.marks[mark] = (found, searched)
        return found - self.at if found >= self.at else -1

    def holds(self, mark: bytes, start: int) -> bool:
        """Whether the mark stands start bytes after here; what lies between is not read."""
        place = self.at + start
        if place + len(mark) <= self.base + len(self.data):
            return self.data.startswith(mark, place - self.base)
        back = self.stream.tell()
        self.stream.seek(place)
        got = self.stream.read(len(mark))
        self.stream.seek(back)
        return got == mark

    def skip(self, n: int) -> None:
        self.at += n
        gone = self.at - self.base
        if gone >= BLOCK:
            del self.data[:gone]
            self.base = self.at


def parse_record(data: bytes) -> tuple[dict[str, str], bytes, int] | None:
    """The record at the start of data with its length, or None if it fails a check."""
    if not data.startswith(b"WARC/1."):
        return None
    end = data.find(b"\r\n\r\n")
    if end < 0:
        return None
    lines = data[:end].decode("utf-8", "replace").split("\r\n")
    headers = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
    length = headers.get("content-length", "")
    if not re.fullmatch(r"\d{1,18}", length) or "warc-type" not in headers:
        return None
    stop = end + 4 + int(length)
    payload = data[end + 4 : stop]
    if len(payload) < int(length) or data[stop : stop + 4] != b"\r\n\r\n":
        return None
    digest = headers.get("warc-payload-digest", "")
    if headers["warc-type"] == "response" and digest.startswith("sha256:") and hashlib.sha256(payload).hexdigest() != digest[7:]:
        return None
    return headers, payload, stop + 4


def plain_record(source: Source):
    """The uncompressed record at the source's place, or None; a wrong length in its header is seen before the payload is read."""
    source.need(12)
    if not source.starts(b"WARC/1."):
        return None
    end, other = source.find(b"\r\n\r\n"), source.find(b"\nWARC/1.")
    if end < 0 or 0 <= other < end:  # no header goes on past another version line
        return None
    found = re.search(rb"(?im)^content-length:[ \t]*(\d{1,12})[ \t]*\r?$", source.view(0, end))
    if not found or not source.holds(b"\r\n\r\n", end + 4 + int(found[1])):
        return None
    source.need(end + 8 + int(found[1]))
    return parse_record(source.view(0, end + 8 + int(found[1])))


def member_record(source: Source):
    """The record in the gzip member at the source's place with the member's length, or None."""
    if not source.need(18) or not source.starts(MEMBER):
        return None
    unpack, out, used = zlib.decompressobj(31), [], 0
    try:
        while not unpack.eof:
            if not source.need(used + 1):
                return None
            part = source.view(used, STEP)
            out.append(unpack.decompress(part))
            used += len(part) - len(unpack.unused_data)
    except zlib.error:
        return None
    got = parse_record(data := b"".join(out))
    return (got[0], got[1], used) if got and got[2] == len(data) else None


def salvage(stream) -> Iterator[tuple[str, int, int, dict[str, str] | None, bytes | None]]:
    """("record", offset, length, headers, payload) and ("gap", offset, length, None, None) in the order of a file that can be sought in."""
    source, gap = Source(stream), None
    while source.need(1):
        got = member_record(source) or plain_record(source)
        if got:
            if gap is not None:
                yield "gap", gap, source.at - gap, None, None
                gap = None
            yield "record", source.at, got[2], got[0], got[1]
            source.skip(got[2])
            continue
        gap = source.at if gap is None else gap
        source.skip(1)
        while source.need(8):
            places = [p for p in (source.find(MEMBER, False), source.find(b"WARC/1.", False)) if p >= 0]
            if places:
                source.skip(min(places))
                break
            source.skip(source.base + len(source.data) - source.at - 6)  # a mark may begin in the last bytes
        else:
            source.skip(source.base + len(source.data) - source.at)
    if gap is not None:
        yield "gap", gap, source.at - gap, None, None


# Spark


def _open(path: str, mode: str):
    from pyarrow import fs

    system, inner = fs.FileSystem.from_uri(path)
    if mode == "r":
        return system.open_input_file(inner)
    system.create_dir(inner.rsplit("/", 1)[0], recursive=True)
    return system.open_output_stream(inner, compression=None)  # the members are packed already


def with_revisits(pages: DataFrame) -> DataFrame:
    """Pages with payload, digest and the response that each revisits (null for responses).

    The first page of a digest is found by a pre-aggregated minimum; only
    digests that occur again are joined back, and are written first, so a digest
    with a third of all pages can be split in the join.
    """
    payload = F.encode(F.coalesce("html", F.lit("")), "utf-8")
    rows = pages.select("page_id", "url", payload.alias("payload")).withColumn("digest", F.sha2("payload", 256))
    firsts = rows.where(F.octet_length("payload") >= MIN_REVISIT).groupBy("digest").agg(F.min("page_id").alias("first"), F.count("*").alias("n")).where("n > 1").drop("n")
    joined = rows.join(written(firsts, "first-pages"), "digest", "left")
    is_first = F.col("page_id").eqNullSafe(F.col("first"))
    return joined.withColumn("revisit", F.octet_length("payload").__ge__(MIN_REVISIT) & F.col("first").isNotNull() & ~is_first)


def write_archives(pages: DataFrame, folder: str, file_bytes: int = FILE_BYTES) -> DataFrame:
    """Write pages (page_id, url, payload, digest, first, revisit); a row (path, records, bytes) a file."""

    def write(batches):
        out, path, count, size = None, None, 0, 0
        for batch in batches:
            columns = [batch.column(c) for c in ("page_id", "url", "payload", "digest", "first", "revisit")]
            for values in zip(*(c.to_pylist() for c in columns)):
                if out is None:
                    path, count, size = f"{folder}/{uuid.uuid4().hex}.warc.gz", 0, 0
                    out = _open(path, "w")
                data = gzip_member(page_record(*values))
                out.write(data)
                count, size = count + 1, size + len(data)
                if size >= file_bytes:
                    out.close()
                    out = None
                    yield _manifest([(path, count, size)])
        if out is not None:
            out.close()
            yield _manifest([(path, count, size)])

    rows = pages.select("page_id", "url", "payload", "digest", "first", "revisit")
    return written(rows.mapInArrow(write, "path string, records long, bytes long"), "manifest")


def _manifest(rows):
    import pyarrow as pa

    return pa.RecordBatch.from_pylist([dict(zip(("path", "records", "bytes"), r)) for r in rows])


def read_archives(manifest: DataFrame, tasks: int, whole: bool = False) -> DataFrame:
    """Records and gaps of the files, a row each, without payloads (their digests were checked).

    With whole, a file with other than the manifest's number of records is an error.
    """
    schema = "kind string, path string, offset long, length long, page_id long, record_type string, payload_bytes long, payload_digest string, refers_to long"

    def number(urn: str | None):
        found = re.fullmatch(r"<urn:page:(-?\d+)>", urn or "")
        return int(found[1]) if found else None

    def read(batches):
        import pyarrow as pa

        names = [x.split()[0] for x in schema.split(", ")]
        kinds = {"string": pa.string(), "long": pa.int64()}
        typed = pa.schema([(x.split()[0], kinds[x.split()[1]]) for x in schema.split(", ")])
        for batch in batches:
            for path, want in zip(batch.column("path").to_pylist(), batch.column("records").to_pylist()):
                rows, n = [], 0
                with _open(path, "r") as stream:
                    for kind, offset, length, head, _ in salvage(stream):
                        rest = (number(head.get("warc-record-id")), head["warc-type"], int(head.get("x-payload-length", 0)), head.get("warc-payload-digest", "").removeprefix("sha256:"), number(head.get("warc-refers-to"))) if head else (None,) * 5
                        rows.append((kind, path, offset, length, *rest))
                        n += kind == "record"
                        if len(rows) >= 5000:
                            yield pa.RecordBatch.from_pylist([dict(zip(names, r)) for r in rows], typed)
                            rows = []
                if whole and n != want:
                    raise ValueError(f"{path}: {n} records read, {want} written")
                if rows:
                    yield pa.RecordBatch.from_pylist([dict(zip(names, r)) for r in rows], typed)

    return manifest.select("path", "records").repartition(tasks).mapInArrow(read, schema)


def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Write every page's record, read the archives back, and return what was read; the archives are deleted then."""
    pages = read_table(spark, sf_dir, "pages", ["page_id", "url", "html"])

    def found():
        manifest = write_archives(with_revisits(pages), scratch_path(spark, "warc"))
        rows = read_archives(manifest, max(1, manifest.count()), whole=True)
        return rows.where("kind = 'record'").select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")

    return finished(spark, "warc-records", found)


SQL = f"""
WITH p AS (SELECT page_id, octet_length(encode(coalesce(html, ''))) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages),
f AS (SELECT payload_digest, min(page_id) AS first FROM p GROUP BY payload_digest)
SELECT page_id, payload_bytes::BIGINT AS payload_bytes, payload_digest,
  CASE WHEN payload_bytes >= {MIN_REVISIT} AND page_id IS DISTINCT FROM first THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN payload_bytes >= {MIN_REVISIT} AND page_id IS DISTINCT FROM first THEN first END AS refers_to
FROM p JOIN f USING (payload_digest)"""
