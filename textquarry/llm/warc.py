"""Legacy ARC archives: writing, parsing by version, and conversion to WARC.

`write_arc` puts each page into an ARC file as an HTTP response, one gzip member a record, under a version block that
names the fields of version 1 or 2. `scan_arc` walks any ARC file (plain, one gzip member, or one for each record) by the
lengths that its header lines declare, and parses these lines by the version block's field list. `convert` makes WARC records of them: a version-5 UUID from the ARC file and offset as identifier, the
14-digit date as WARC-Date, types response or revisit, and SHA-1 digests of block and payload. `scan_warc` reads the
WARC files back.

Of records with equal payloads of at least `least_bytes`, the one with the largest (page_id, record) is the response and
the others are revisits without payload, whose HTTP header keeps its full length; smaller ones are all responses.

Cases: a null or empty html is an empty payload; a null url is written as an empty one (`-` in the header line), spaces
and controls in a url are percent-escaped; a null page_id is carried as absent and never chosen before a numbered page;
repeated rows are records of their own, of which one is the response; an empty table gives no rows.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import new_folder, salted_join, spread, stage, table
from .storage import stream, written

FIELDS = {
    1: "URL IP-address Archive-date Content-type Archive-length",
    2: "URL IP-address Archive-date Content-type Result-code Checksum Location Offset Filename Archive-length",
}
FILES = "path string, n_records long"
RECORDS = "arc string, arc_offset long, record_id string, page_id long, url string, archived string, mime string, payload_bytes long, payload_digest string"
WARC_RECORDS = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to_id string, record_id string, target_uri string, archived string"
_DATE = "20260101000000"
_SPACE = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")
_UNSAFE = re.compile(rb"[\x00-\x20\x7f]")


def digest(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def _member(data: bytes) -> bytes:
    z = zlib.compressobj(1, zlib.DEFLATED, 31)
    return z.compress(data) + z.flush()


class Content:
    """What a plain or gzip file (of any number of members) holds, as one stream; `at` is the place in it."""

    def __init__(self, file, name: str) -> None:
        self.file, self.name, self.at = file, name, 0
        self.held, self.begin, self.rest, self.gzip, self.z = bytearray(), 0, b"", None, None

    def more(self) -> bool:
        data = self.rest or self.file.read(1 << 20)
        self.rest = b""
        if self.gzip is None:
            self.gzip = data[:2] == b"\x1f\x8b"
        if self.gzip and self.z is None:
            data = data.lstrip(b"\0") if self.at else data  # padding between members
        if not data:
            if self.z is not None:
                raise ValueError(f"{self.name} ends within a gzip member")
            return False
        if self.begin > 1 << 20:
            del self.held[: self.begin]
            self.begin = 0
        if not self.gzip:
            self.held += data
            return True
        self.z = self.z or zlib.decompressobj(31)
        self.held += self.z.decompress(data, 4 << 20)
        self.rest = self.z.unused_data if self.z.eof else self.z.unconsumed_tail
        self.z = None if self.z.eof else self.z
        return True

    def take(self, n: int) -> bytes:
        """The next n bytes, fewer only at the end."""
        while len(self.held) - self.begin < n and self.more():
            pass
        out = bytes(self.held[self.begin : self.begin + n])
        self.begin += len(out)
        self.at += len(out)
        return out

    def line(self) -> bytes:
        """Up to the next line feed and with it; empty at the end."""
        seen = self.begin
        while (end := self.held.find(b"\n", seen)) < 0:
            seen = len(self.held) - self.begin
            if not self.more():
                return self.take(len(self.held) - self.begin)
            seen += self.begin
        return self.take(end + 1 - self.begin)


def http_block(page_id: int | None, payload: bytes) -> bytes:
    tag = b"" if page_id is None else b"X-Page-Id: %d\r\n" % page_id
    return b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=UTF-8\r\n%sContent-Length: %d\r\n\r\n" % (tag, len(payload)) + payload


def http_fields(block: bytes) -> tuple[dict[str, str], int]:
    """Header fields, and where the payload begins."""
    end = block.find(b"\r\n\r\n")
    head, at = (block, len(block)) if end < 0 else (block[:end], end + 4)
    lines = head.decode("latin-1").split("\r\n")[1:]
    return {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines)}, at


def version_block(name: str, version: int) -> bytes:
    body = b"%d 0 textquarry\n%s\n" % (version, FIELDS[version].encode())
    line = {1: f"filedesc://{name} 0.0.0.0 {_DATE} text/plain {len(body)}", 2: f"filedesc://{name} 0.0.0.0 {_DATE} text/plain 200 - - 0 {name} {len(body)}"}[version]
    return line.encode() + b"\n" + body + b"\n"


def arc_record(version: int, name: str, offset: int, url: str, block: bytes) -> bytes:
    url = _UNSAFE.sub(lambda m: b"%%%02X" % m[0][0], url.encode()) or b"-"
    n = len(block)
    line = {1: b"%s 0.0.0.0 %s text/html %d" % (url, _DATE.encode(), n), 2: b"%s 0.0.0.0 %s text/html 200 %s - %d %s %d" % (url, _DATE.encode(), digest(block).encode(), offset, name.encode(), n)}[version]
    return line + b"\n" + block + b"\n"


def arc_fields(line: bytes, names: list[str]) -> dict[str, str]:
    """Fields of a record's header line by the names of its version. Only the URL, which comes first, may hold spaces."""
    parts = line.decode("utf-8", "replace").rstrip("\r\n").split(" ")
    if len(parts) < len(names):
        raise ValueError(f"{len(parts)} fields in an ARC header line of {len(names)}")
    more = len(parts) - len(names) + 1
    return dict(zip(names, [" ".join(parts[:more]), *parts[more:]], strict=True))


def arc_records(path: str) -> Iterator[tuple[int, dict[str, str], bytes]]:
    """(offset in the uncompressed archive, header fields, block) of the records after the version block; none in an empty file."""
    names: list[str] | None = None
    with stream(path) as file:
        content = Content(file, path)
        while True:
            offset, line = content.at, content.line()
            if not line:
                return
            if not line.strip():
                continue  # between records
            head = arc_fields(line, names) if names else {"Archive-length": line.split()[-1].decode()}
            n = int(head["Archive-length"])
            block = content.take(n)
            if len(block) < n:
                raise ValueError(f"{path}: the record at {offset} is shorter than it declares")
            if names:
                yield offset, head, block
                continue
            version, fields = (block.decode("utf-8", "replace").split("\n") + [""])[:2]
            if version.split(" ")[0] not in ("1", "2") or "Archive-length" not in fields:
                raise ValueError(f"{path} has ARC version {version}")
            names = fields.strip().split(" ")


def warc_records(path: str) -> Iterator[tuple[int, dict[str, str], bytes]]:
    """(offset in the uncompressed archive, header fields, block) of all records, by their declared lengths."""
    with stream(path) as file:
        content = Content(file, path)
        while True:
            offset, line = content.at, content.line()
            if not line:
                return
            if not line.strip():
                continue
            if not line.startswith(b"WARC/"):
                raise ValueError(f"{path} has no WARC record at {offset}")
            head = {}
            while (line := content.line()).strip():
                name, _, value = line.decode("utf-8", "replace").partition(":")
                head[name.strip().lower()] = value.strip()
            n = int(head["content-length"])
            block = content.take(n)
            if len(block) < n:
                raise ValueError(f"{path}: the record at {offset} is shorter than it declares")
            yield offset, head, block


def write_arc(pages: DataFrame, folder: str) -> DataFrame:
    """One ARC file a partition, versions 1 and 2 by turns; a row of FILES for each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        k = TaskContext.get().partitionId()
        version, name, n = 1 + k % 2, f"pages-{k:06d}.arc.gz", 0
        with written(f"{folder}/{name}") as out:
            first = version_block(name, version)
            out.write(_member(first))
            at = len(first)
            for batch in batches:
                for page_id, url, html in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                    data = arc_record(version, name, at, url or "", http_block(page_id, (html or "").encode()))
                    out.write(_member(data))
                    at += len(data)
                    n += 1
        yield pa.RecordBatch.from_pydict({"path": [f"{folder}/{name}"], "n_records": [n]})

    return pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), F.col("html").cast("string")).mapInArrow(run, FILES)


def _rows(rows: Iterator[tuple], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    kept: list[tuple] = []
    for x in rows:
        kept.append(x)
        if len(kept) == 2000:
            yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*kept, strict=True), schema, strict=True)], schema=schema)
            kept = []
    if kept:
        yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*kept, strict=True), schema, strict=True)], schema=schema)


def _arrow(ddl: str) -> pa.Schema:
    kinds = {"long": pa.int64(), "string": pa.string()}
    return pa.schema([(a, kinds[b]) for a, b in (x.split(" ") for x in ddl.split(", "))])


def scan_arc(files: DataFrame) -> DataFrame:
    """A row of RECORDS for each record of the ARC files."""
    schema = _arrow(RECORDS)

    def rows(paths: Iterator[str]) -> Iterator[tuple]:
        for path in paths:
            for offset, head, block in arc_records(path):
                fields, at = http_fields(block)
                payload, page = block[at:], fields.get("x-page-id")
                own = f"urn:uuid:{uuid.uuid5(_SPACE, f'{path}#{offset}')}"
                yield path, offset, own, None if page is None else int(page), "" if head["URL"] == "-" else head["URL"], head["Archive-date"], head["Content-type"], len(payload), digest(payload)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _rows(rows(p for b in batches for p in b.column(0).to_pylist()), schema)

    return files.select("path").repartition(spread(files.sparkSession), "path").mapInArrow(run, RECORDS)


def resolve(records: DataFrame, least_bytes: int = 0) -> DataFrame:
    """records with the response's record_id (refers_to) and url and date where they are revisits, else null."""
    equal = F.when(F.col("payload_bytes") >= least_bytes, F.concat_ws("/", "payload_digest", "payload_bytes"))
    given = records.withColumn("_same", equal)
    best = given.where("_same IS NOT NULL").groupBy("_same").agg(F.max(F.struct("page_id", "record_id", "url", "archived")).alias("_best"), F.count(F.lit(1)).alias("_n")).where("_n > 1").drop("_n")
    joined = salted_join(given, best, "_same", ["record_id"], "left")
    other = F.col("_best").isNotNull() & (F.col("_best.record_id") != F.col("record_id"))
    return joined.select(*records.columns, *(F.when(other, F.col(f"_best.{c}")).alias(f"refers_{c}") for c in ("record_id", "url", "archived")))


def warc_date(archived: str) -> str:
    d = (archived + "0" * 14)[:14]
    return f"{d[:4]}-{d[4:6]}-{d[6:8]}T{d[8:10]}:{d[10:12]}:{d[12:14]}Z"


def warc_record(own: str, url: str, archived: str, block: bytes, payload_digest: str, refers: tuple | None) -> bytes:
    head = ["WARC/1.1", f"WARC-Type: {'revisit' if refers else 'response'}", f"WARC-Record-ID: <{own}>", f"WARC-Date: {warc_date(archived)}", f"WARC-Target-URI: {url}", f"WARC-Payload-Digest: sha1:{payload_digest}"]
    if refers:
        block = block[: http_fields(block)[1]]
        head += [f"WARC-Refers-To: <{refers[0]}>", f"WARC-Refers-To-Target-URI: {refers[1]}", f"WARC-Refers-To-Date: {warc_date(refers[2])}", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
    head += [f"WARC-Block-Digest: sha1:{digest(block)}", "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def convert(resolved: DataFrame, folder: str) -> DataFrame:
    """One WARC file for each ARC file that resolved names, its records in the same order; a row of FILES for each."""
    wanted = ("arc", "arc_offset", "record_id", "payload_digest", "refers_record_id", "refers_url", "refers_archived")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def decisions() -> Iterator[tuple]:
            for b in batches:
                yield from zip(*(c.to_pylist() for c in b.columns), strict=True)

        todo, done = decisions(), []
        one = next(todo, None)
        while one is not None:
            arc, n = one[0], 0
            name = f"{folder}/{arc.rpartition('/')[2].removesuffix('.gz').removesuffix('.arc')}-{zlib.crc32(arc.encode()):08x}.warc.gz"
            with written(name) as out:
                info = b"software: textquarry\r\nformat: WARC File Format 1.1\r\n"
                out.write(_member(b"WARC/1.1\r\nWARC-Type: warcinfo\r\nWARC-Record-ID: <urn:uuid:%s>\r\nWARC-Date: %s\r\nContent-Type: application/warc-fields\r\nContent-Length: %d\r\n\r\n%s\r\n\r\n" % (str(uuid.uuid5(_SPACE, name.rpartition("/")[2])).encode(), warc_date(_DATE).encode(), len(info), info)))
                for offset, head, block in arc_records(arc):
                    if one is None or one[:2] != (arc, offset):
                        raise ValueError(f"{arc} has a record at {offset} without a decision")
                    url = "" if head["URL"] == "-" else head["URL"]
                    out.write(_member(warc_record(one[2], url, head["Archive-date"], block, one[3], one[4:7] if one[4] else None)))
                    n += 1
                    one = next(todo, None)
            done.append((name, n))
        if done:
            yield pa.RecordBatch.from_pydict({"path": [x[0] for x in done], "n_records": [x[1] for x in done]})

    dealt = resolved.select(*wanted).repartition(spread(resolved.sparkSession), "arc").sortWithinPartitions("arc", "arc_offset")
    return dealt.mapInArrow(run, FILES)


def scan_warc(files: DataFrame) -> DataFrame:
    """A row of WARC_RECORDS for each response and revisit of the WARC files; digests of present payloads are computed anew."""
    schema = _arrow(WARC_RECORDS)

    def rows(paths: Iterator[str]) -> Iterator[tuple]:
        for path in paths:
            for offset, head, block in warc_records(path):
                if head["warc-type"] not in ("response", "revisit"):
                    continue
                fields, start = http_fields(block)
                page, full = fields.get("x-page-id"), head["warc-payload-digest"].removeprefix("sha1:")
                if digest(block) != head["warc-block-digest"].removeprefix("sha1:") or head["warc-type"] == "response" and digest(block[start:]) != full:
                    raise ValueError(f"{path} has a damaged record at {offset}")
                uri = head["warc-target-uri"]
                yield None if page is None else int(page), int(fields["content-length"]), full, head["warc-type"], head.get("warc-refers-to", "<>")[1:-1] or None, head["warc-record-id"][1:-1], uri, head["warc-date"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _rows(rows(p for b in batches for p in b.column(0).to_pylist()), schema)

    return files.select("path").repartition(spread(files.sparkSession), "path").mapInArrow(run, WARC_RECORDS)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages to ARC, ARC to WARC, and the WARC files read back; refers_to is found through the record identifiers."""
    pages = table(spark, sf_dir, "pages")
    arcs = stage(write_arc(pages, new_folder(spark, "arc")), "arc-files")
    resolved = stage(resolve(stage(scan_arc(arcs), "arc-records")), "arc-resolved")
    back = stage(scan_warc(stage(convert(resolved, new_folder(spark, "warc")), "warc-files")), "warc-records")
    target = back.where("record_type = 'response'").select(F.col("record_id").alias("refers_to_id"), F.col("page_id").alias("refers_to"))
    return salted_join(back, target, "refers_to_id", ["record_id"], "left").select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "target_uri")
