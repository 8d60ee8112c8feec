"""WARC records in ZIP-packaged archives: writer, and a reader by range reads without extraction.

An archive is a ZIP file whose members are stored (not deflated): ``archive/data.warc.gz``, one gzip member a record,
and ``indexes/index.jsonl``, one line a record with its offset and length. The writer always adds ZIP64 records to
members and directory, so a member or an archive may pass 4 GB.

Writer: payloads of at least ``min_revisit`` bytes that several pages share are written once, as the response of
the smallest page id; the others are revisit records that name it and carry no payload. Each task writes one archive to
the shared folder under a name of its own attempt and returns it in the manifest: an archive of a lost or repeated task
is in no manifest and is never read.

Reader: for each archive of the manifest it reads the end of the file, the ZIP64 locator and directory, finds the stored
members (local headers tell where their bytes start), reads the index members, and deals records over tasks, which
range-read their bytes, neighbours in one read of at most ``read_bytes``. Data are all stored members
``archive/*.warc`` and ``archive/*.warc.gz``; indexes are ``indexes/`` members of JSON lines or CDXJ (``offset``, ``length`` and,
where there are several data members, ``filename``). What no index names of a data member, between indexed records too, is
scanned record by record, so a partial index loses nothing. A compressed data or index member, an index line that names a
member that is not there, and ranges that overlap or pass the member's end raise an error.
Records of any type are read; ids other than this writer's are null. Revisits take length from their response.

Paths are URIs; Python tasks open them with Arrow file systems. Defined results: null html is an empty payload; a null
page id writes a record with an empty id and loses to every other as a response; repeated ids are records of their own,
of which one is the response; null urls are written empty; an empty table gives no records; other columns are ignored.
"""

from __future__ import annotations

import gzip
import hashlib
import json
import re
import struct
import uuid
import zlib
from array import array
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as C

DATA, INDEX = "archive/data.warc.gz", "indexes/index.jsonl"
_LOCAL, _CENTRAL, _END, _END64, _LOCATE64 = 0x04034B50, 0x02014B50, 0x06054B50, 0x06064B50, 0x07064B50
_BIG = 0xFFFFFFFF


def open_fs(uri: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(uri if "://" in uri or uri.startswith("file:") else "file://" + uri)


def record(kind: str, page_id, url: str | None, payload: bytes, digest: str, size: int, refers_to) -> bytes:
    """One WARC/1.1 record; a revisit has an empty block."""
    block = payload if kind == "response" else b""
    head = [
        "WARC/1.1",
        f"WARC-Type: {kind}",
        f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>",
        "WARC-Date: 1970-01-01T00:00:00Z",
        "WARC-Target-URI: " + (url or "").replace("\r", " ").replace("\n", " "),
        f"WARC-Payload-Digest: sha256:{digest}",
        "Content-Type: text/html",
        f"Content-Length: {len(block)}",
    ]
    if kind == "revisit":
        head[6:6] = ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <urn:page:{'' if refers_to is None else refers_to}>"]
    return "\r\n".join(head).encode("utf-8", "surrogatepass") + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse_record(raw: bytes) -> tuple[dict[str, str], bytes]:
    """Headers (lower-cased names) and block of one record."""
    head, sep, rest = raw.partition(b"\r\n\r\n")
    lines = head.decode("utf-8", "surrogatepass").split("\r\n")
    if not sep or not lines[0].startswith("WARC/"):
        raise ValueError("not a WARC record")
    headers = {}
    for line in lines[1:]:
        name, _, value = line.partition(":")
        headers[name.strip().lower()] = value.strip()
    size = int(headers["content-length"])
    if len(rest) < size:
        raise ValueError("a WARC block is cut short")
    return headers, rest[:size]


class ZipWriter:
    """Stored members written front to back, each with ZIP64 sizes in its local header's data descriptor."""

    def __init__(self, out):
        self.out, self.at, self.members = out, 0, []

    def _put(self, data: bytes) -> None:
        self.out.write(data)
        self.at += len(data)

    def begin(self, name: str) -> None:
        coded = name.encode()
        self.members.append([coded, self.at, 0, 0])
        extra = struct.pack("<HHQQ", 1, 16, 0, 0)
        self._put(struct.pack("<IHHHHHIIIHH", _LOCAL, 45, 0x0808, 0, 0, 33, 0, _BIG, _BIG, len(coded), len(extra)) + coded + extra)
        self.start = self.at

    def data(self, data: bytes) -> None:
        self.members[-1][3] = zlib.crc32(data, self.members[-1][3])
        self._put(data)

    def end(self) -> None:
        member = self.members[-1]
        member[2] = self.at - self.start
        self._put(struct.pack("<IIQQ", 0x08074B50, member[3], member[2], member[2]))

    def close(self) -> None:
        begin = self.at
        for name, at, size, crc in self.members:
            extra = struct.pack("<HHQQQ", 1, 24, size, size, at)
            self._put(struct.pack("<IHHHHHHIIIHHHHHII", _CENTRAL, 45, 45, 0x0808, 0, 0, 33, crc, _BIG, _BIG, len(name), len(extra), 0, 0, 0, 0, _BIG) + name + extra)
        size, end64 = self.at - begin, self.at
        n = len(self.members)
        self._put(struct.pack("<IQHHIIQQQQ", _END64, 44, 45, 45, 0, 0, n, n, size, begin))
        self._put(struct.pack("<IIQI", _LOCATE64, 0, end64, 1))
        self._put(struct.pack("<IHHHHIIH", _END, 0, 0, 0xFFFF, 0xFFFF, _BIG, _BIG, 0))


_DATA = re.compile(r"archive/.+\.warc(\.gz)?$")
_INDEX = re.compile(r"indexes/.+\.(jsonl|cdxj?|idx)(\.gz)?$")


def members_of(read_at, size: int) -> dict[str, tuple[int, int]]:
    """Name to (offset, length) of the stored members; ``read_at(length, offset)`` range-reads the archive."""
    tail = read_at(min(size, 65_557), max(0, size - 65_557))
    at = tail.rfind(struct.pack("<I", _END))
    if at < 0:
        raise ValueError("no end of a ZIP directory")
    _, _, _, _, n, length, begin, _ = struct.unpack_from("<IHHHHIIH", tail, at)
    if n == 0xFFFF or length == _BIG or begin == _BIG:
        sign, _, end64, _ = struct.unpack("<IIQI", read_at(20, size - len(tail) + at - 20))
        if sign != _LOCATE64:
            raise ValueError("no ZIP64 locator")
        sign, _, _, _, _, _, _, n, length, begin = struct.unpack("<IQHHIIQQQQ", read_at(56, end64))
        if sign != _END64:
            raise ValueError("no ZIP64 directory end")
    directory, at, found = read_at(length, begin), 0, {}
    for _ in range(n):
        sign, _, _, _, method, _, _, _, packed, plain, names, extras, notes, _, _, _, local = struct.unpack_from("<IHHHHHHIIIHHHHHII", directory, at)
        if sign != _CENTRAL:
            raise ValueError("a broken ZIP directory")
        name = directory[at + 46 : at + 46 + names].decode("utf-8", "replace")
        extra = directory[at + 46 + names : at + 46 + names + extras]
        at += 46 + names + extras + notes
        while len(extra) >= 4:
            kind, long = struct.unpack_from("<HH", extra)
            if kind == 1:
                wide = list(struct.unpack_from(f"<{long // 8}Q", extra, 4))
                plain = wide.pop(0) if plain == _BIG and wide else plain
                packed = wide.pop(0) if packed == _BIG and wide else packed
                local = wide.pop(0) if local == _BIG and wide else local
            extra = extra[4 + long :]
        if method and (_DATA.match(name) or _INDEX.match(name)):
            raise ValueError(f"{name} is compressed: archives and indexes are read in place, so they must be stored")
        if method == 0 and not name.endswith("/"):
            head = read_at(30, local)
            skip = struct.unpack_from("<HH", head, 26)
            found[name] = (local + 30 + sum(skip), packed)
    return found


_MANIFEST = pa.schema([("archive", pa.string()), ("records", pa.int64()), ("bytes", pa.int64())])


def _write(folder: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = C.rows_of(batches, ["page_id", "url", "html", "digest", "size", "refers_to", "revisit"])
        first = next(rows, None)
        if first is None:
            return
        uri = f"{folder}/{uuid.uuid4().hex}.zip"
        fs, path = open_fs(uri)
        fs.create_dir(path.rpartition("/")[0], recursive=True)
        index, n = [], 0
        with fs.open_output_stream(path) as out:
            zipped = ZipWriter(out)
            zipped.begin(DATA)
            while first is not None:
                page, url, html, digest, size, refers, revisit = first
                raw = record("revisit" if revisit else "response", page, url, (html or "").encode("utf-8", "surrogatepass"), digest, size, refers)
                packed = gzip.compress(raw, 6, mtime=0)
                index.append(json.dumps({"id": page, "offset": zipped.at - zipped.start, "length": len(packed)}))
                zipped.data(packed)
                n += 1
                first = next(rows, None)
            zipped.end()
            zipped.begin(INDEX)
            for low in range(0, len(index), 10_000):
                zipped.data(("\n".join(index[low : low + 10_000]) + "\n").encode())
            zipped.end()
            zipped.close()
        yield from C.emit(_MANIFEST, iter([(uri, n, zipped.at)]))

    return run


def write_archives(pages: DataFrame, folder: str, *, min_revisit: int = 100, archives: int | None = None) -> DataFrame:
    """Write ``pages`` (``page_id, url, html``) as archives under ``folder``; returns the manifest ``archive, records, bytes``."""
    spark = pages.sparkSession
    some = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.coalesce(F.col("html").cast("string"), F.lit("")).alias("html"))
    some = some.withColumn("digest", F.sha2("html", 256)).withColumn("size", F.octet_length("html").cast("long"))
    found = some.where(F.col("size") >= min_revisit).groupBy("digest").agg(F.min("page_id").alias("first"), F.count("*").alias("n")).where("n > 1")
    shared = C.table(found.select(F.col("digest").alias("same"), "first", "n"), "warc-shared")
    # Payloads of more than a 1 / (2 * partitions) share of the copies number at most twice the partitions: a bounded
    # broadcast. Their rows join the others under keys of their own, so that no task holds the copies of one payload.
    copies = shared.agg(F.sum("n")).first()[0] or 0
    often = F.col("n") > copies / (2 * C.width(spark))
    very = F.broadcast(shared.where(often).select(F.col("same").alias("hot"), F.col("first").alias("hot_first")))
    met = some.join(very, F.col("digest") == F.col("hot"), "left")
    key = F.when(F.col("hot").isNull(), F.col("digest")).otherwise(F.concat(F.lit("hot "), F.coalesce(F.col("page_id").cast("string"), F.lit(""))))
    met = met.join(shared.where(~often).select("same", "first"), key == F.col("same"), "left")
    met = met.withColumn("first", F.when(F.col("hot").isNotNull(), F.col("hot_first")).otherwise(F.col("first")))
    revisit = (F.col("same").isNotNull() | F.col("hot").isNotNull()) & ~F.col("page_id").eqNullSafe(F.col("first"))
    rows = met.select("page_id", "url", F.when(revisit, "").otherwise(F.col("html")).alias("html"), "digest", "size", F.when(revisit, F.col("first")).alias("refers_to"), revisit.alias("revisit"))
    return C.table(rows.repartition(archives or C.width(spark)).mapInArrow(_write(folder), "archive string, records long, bytes long"), "warc-manifest")


_ENTRIES = pa.schema([("archive", pa.string()), ("offset", pa.int64()), ("length", pa.int64()), ("packed", pa.bool_())])


def _index_lines(read_at, at: int, size: int, packed: bool) -> Iterator[bytes]:
    rest, unzip = b"", zlib.decompressobj(47)
    for low in range(0, size, 4 << 20):
        data = read_at(min(4 << 20, size - low), at + low)
        while packed and unzip.unused_data == b"" and data:
            rest += unzip.decompress(data)
            data = unzip.unused_data
            if unzip.eof:  # an index of several gzip members
                unzip = zlib.decompressobj(47)
        *lines, rest = (rest + (b"" if packed else data)).split(b"\n")
        yield from lines
    yield rest


def indexed(found: dict[str, tuple[int, int]], read_at) -> Iterator[tuple[str, int, int]]:
    """Data member, offset and length of every record that an index names."""
    data = [name for name in found if _DATA.match(name)]
    for name, (at, size) in found.items():
        if _INDEX.match(name):
            for line in _index_lines(read_at, at, size, name.endswith(".gz")):
                brace = line.find(b"{")
                entry = json.loads(line[brace:]) if brace >= 0 else {}
                if "offset" in entry and "length" in entry:
                    member = "archive/" + entry["filename"].rpartition("/")[2] if "filename" in entry else data[0] if len(data) == 1 else None
                    if member not in found:
                        raise ValueError(f"{name} names {member or 'no archive of several'}, which is not there")
                    yield member, int(entry["offset"]), int(entry["length"])


def scanned(read_at, at: int, size: int, packed: bool, step: int = 1 << 18) -> Iterator[tuple[int, int]]:
    """Offset and length, from ``at``, of every record of ``size`` bytes of a data member, by reading them through once."""
    block, begin = b"", 0

    def ahead(low: int) -> bytes:
        """Bytes from ``low`` on: what is left of the last block read, or the next one."""
        nonlocal block, begin
        if not begin <= low < begin + len(block):
            block, begin = read_at(min(step, size - low), at + low), low
        if not block:
            raise ValueError("a WARC record is cut short")
        return block[low - begin :]

    pos = 0
    while pos < size:
        low, done = pos, None
        if packed:
            unzip = zlib.decompressobj(31)
            while done is None:
                data = ahead(low)
                unzip.decompress(data)
                low += len(data)
                if unzip.eof:
                    done = low - len(unzip.unused_data)
        else:
            head = b""
            while b"\r\n\r\n" not in head:
                data = ahead(low)
                head += data
                low += len(data)
            end = head.index(b"\r\n\r\n")
            long = re.search(rb"(?im)^content-length:\s*(\d+)", head[:end])
            done = pos + end + 4 + int(long[1] if long else 0) + 4
        yield pos, min(done, size) - pos
        pos = done


def ranges_of(found: dict[str, tuple[int, int]], read_at, member: str, named: np.ndarray) -> Iterator[tuple[int, int]]:
    """Offset and length of every record of a data member: those that indexes name, and what a scan finds between them."""
    start, long = found[member]
    packed, at = member.endswith(".gz"), 0
    for low, size in [*np.unique(named.reshape(-1, 2), axis=0).tolist(), [long, 0]]:
        if low < at or size < 0 or low + size > long:
            raise ValueError(f"an index of {member} names bytes {low} to {low + size}, which do not fit")
        for offset, length in scanned(read_at, start + at, low - at, packed):
            yield at + offset, length
        if size:
            yield low, size
        at = low + size


def _list(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def rows():
        for (uri,) in C.rows_of(batches, ["archive"]):
            fs, path = open_fs(uri)
            with fs.open_input_file(path) as f:
                read_at = lambda n, at, f=f: f.read_at(n, at)
                found, named = members_of(read_at, f.size()), defaultdict(lambda: array("q"))
                for member, at, size in indexed(found, read_at):
                    named[member].extend((at, size))
                for member in found:
                    if _DATA.match(member):
                        for at, size in ranges_of(found, read_at, member, np.array(named[member], np.int64)):
                            yield uri, found[member][0] + at, size, member.endswith(".gz")

    yield from C.emit(_ENTRIES, rows(), 16_384)


RECORDS = "page_id long, record_type string, url string, payload_digest string, refers_to long, block_bytes long, block binary"
_RECORDS = pa.schema([("page_id", pa.int64()), ("record_type", pa.string()), ("url", pa.string()), ("payload_digest", pa.string()), ("refers_to", pa.int64()), ("block_bytes", pa.int64()), ("block", pa.binary())])


def _page(urn: str | None) -> int | None:
    number = re.fullmatch(r"<urn:page:(-?\d+)>", urn or "")
    return int(number[1]) if number else None


def _read(read_bytes: int, blocks: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def parsed(raw: bytes, packed: bool) -> tuple:
            headers, block = parse_record(gzip.decompress(raw) if packed else raw)
            kind, digest, page = headers.get("warc-type"), headers.get("warc-payload-digest", "").removeprefix("sha256:"), _page(headers.get("warc-record-id"))
            # Only this writer's blocks are bare payloads with hexadecimal digests.
            own = kind == "response" and headers.get("warc-record-id", "").startswith("<urn:page:")
            if own and hashlib.sha256(block).hexdigest() != digest:
                raise ValueError("a payload differs from its digest")
            return page, kind, headers.get("warc-target-uri"), digest, _page(headers.get("warc-refers-to")), len(block), block if blocks else None

        def rows():
            for (uri,), group in C.groups_of(C.rows_of(batches, ["archive", "offset", "length", "packed"]), 1):
                fs, path = open_fs(uri)
                with fs.open_input_file(path) as f:
                    held: list[tuple[int, int, bool]] = []
                    for _, at, size, packed in group:
                        if held and (at != held[-1][0] + held[-1][1] or at + size - held[0][0] > read_bytes):
                            yield from cut(f, held)
                            held = []
                        held.append((at, size, packed))
                    yield from cut(f, held)

        def cut(f, held: list[tuple[int, int, bool]]):
            start = held[0][0]
            raw = f.read_at(held[-1][0] + held[-1][1] - start, start)
            for at, size, packed in held:
                yield parsed(raw[at - start : at - start + size], packed)

        yield from C.emit(_RECORDS, rows())

    return run


def read_archives(manifest: DataFrame, *, blocks: bool = True, read_bytes: int = 4 << 20) -> DataFrame:
    """All records of the manifest's archives; ``block`` is null unless asked for."""
    spark = manifest.sparkSession
    listed = manifest.select("archive").repartition(C.width(spark), "archive").mapInArrow(_list, "archive string, offset long, length long, packed boolean")
    entries = C.table(listed, "warc-entries")
    spread = entries.repartitionByRange(C.width(spark), "archive", "offset").sortWithinPartitions("archive", "offset")
    return spread.mapInArrow(_read(read_bytes, blocks), RECORDS)


def page_records(pages: DataFrame, *, folder: str | None = None, min_revisit: int = 100) -> DataFrame:
    """Write and read back: ``page_id, payload_bytes, payload_digest, record_type, refers_to`` a page."""
    spark = pages.sparkSession
    manifest = write_archives(pages, folder or C.scratch_path(spark, "warc"), min_revisit=min_revisit)
    records = C.table(read_archives(manifest, blocks=False).drop("block"), "warc-records")
    # A revisit's length is its response's. Payloads with more than a 1 / (2 * partitions) share of the revisits number at most
    # twice the partitions and meet by a bounded broadcast; the others are joined by digest.
    again = records.where("record_type = 'revisit'")
    counted = again.groupBy(F.col("payload_digest").alias("of")).agg(F.count("*").alias("n"))
    response = records.where("record_type = 'response'")
    sizes = counted.join(response, F.col("of") == F.col("payload_digest")).groupBy("of").agg(F.max("block_bytes").alias("long"), F.first("n").alias("n"))
    sizes = C.table(sizes, "warc-sizes")
    often = F.col("n") > (sizes.agg(F.sum("n")).first()[0] or 0) / (2 * C.width(spark))
    very = F.broadcast(sizes.where(often).select(F.col("of").alias("hot"), F.col("long").alias("hot_long")))
    met = again.join(very, F.col("payload_digest") == F.col("hot"), "left")
    key = F.when(F.col("hot").isNull(), F.col("payload_digest")).otherwise(F.concat(F.lit("hot "), F.coalesce(F.col("page_id").cast("string"), F.lit(""))))
    met = met.join(sizes.where(~often).select("of", "long"), key == F.col("of"), "left").withColumn("long", F.coalesce("hot_long", "long")).where("long is not null")
    own = response.select("page_id", F.col("block_bytes").alias("payload_bytes"), "payload_digest", "record_type", F.lit(None).cast("long").alias("refers_to"))
    return own.unionByName(met.select("page_id", F.col("long").alias("payload_bytes"), "payload_digest", "record_type", "refers_to"))


ORACLE = """
WITH p AS (
  SELECT page_id, octet_length(encode(coalesce(html, ''))) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages
), f AS (
  SELECT payload_digest, min(page_id) AS first_id FROM p GROUP BY payload_digest
)
SELECT p.page_id, p.payload_bytes, p.payload_digest,
  CASE WHEN p.payload_bytes >= 100 AND f.first_id <> p.page_id THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN p.payload_bytes >= 100 AND f.first_id <> p.page_id THEN f.first_id END AS refers_to
FROM p JOIN f USING (payload_digest)
"""
