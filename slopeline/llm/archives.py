"""Legacy ARC archives: writing, parsing by their version's header line, conversion to WARC.

An ARC file starts with a ``filedesc`` record whose body names the version and the fields of the
one-line header of every record; the last field is the declared length of the content. The
converter reads version 1 and 2 files, plain or compressed record by record, and writes WARC
records with identifiers, dates, types and digests made from what the ARC file has. Records with
equal payloads of at least ``LEAST`` bytes are stored once; the others become revisits.

Files lie in a folder that all executors share, are written under an attempt's own name and
renamed, and are read as streams, so memory is bounded by one record.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterable, Iterator
from urllib.parse import quote

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import open_folder, put_file, text_batches, written

#: Fixed values of the formats.
V1_FIELDS = "URL IP-address Archive-date Content-type Archive-length"
V2_FIELDS = "URL IP-address Archive-date Content-type Result-code Checksum Location Offset Filename Archive-length"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
LEAST = 1000
NAMESPACE = uuid.UUID("8d5cd8b6-6c35-5c63-9c0e-6a6f6a1f2b11")
LEVEL = 4

FILES = "number int, path string, n_records long"
INDEX = "number int, path string, position long, page_id long, payload_bytes long, payload_digest string, url string, date string"
RECORDS = "page_id long, record_id string, record_type string, payload_bytes long, payload_digest string, refers_to_id string, url string, date string"


def squeeze(record: bytes) -> bytes:
    """One gzip member."""
    z = zlib.compressobj(LEVEL, zlib.DEFLATED, 31)
    return z.compress(record) + z.flush()


class Stream:
    """Lines and byte counts of a plain file or of a row of gzip members."""

    def __init__(self, source, block: int = 1 << 16):
        self.source, self.block, self.buffer, self.position = source, block, b"", 0
        self.raw = source.read(block)
        self.inflate = zlib.decompressobj(31) if self.raw[:2] == b"\x1f\x8b" else None

    def _more(self) -> bool:
        if not self.raw:
            self.raw = self.source.read(self.block)
        if not self.raw:
            return False
        if self.inflate is None:
            self.buffer, self.raw = self.buffer + self.raw, b""
            return True
        if self.inflate.eof:
            self.inflate = zlib.decompressobj(31)
        self.buffer += self.inflate.decompress(self.raw)
        self.raw = self.inflate.unused_data
        return True

    def line(self) -> bytes | None:
        """The next line without its line feed; None at the end."""
        while (at := self.buffer.find(b"\n")) < 0:
            if not self._more():
                if not self.buffer:
                    return None
                at = len(self.buffer)
                break
        out, self.buffer = self.buffer[:at], self.buffer[at + 1 :]
        self.position += at + 1
        return out

    def take(self, n: int) -> bytes:
        have = [self.buffer]
        size = len(self.buffer)
        while size < n:
            self.buffer = b""
            if not self._more():
                raise ValueError(f"record cut short: {size} of {n} declared bytes")
            have.append(self.buffer)
            size += len(self.buffer)
        every = b"".join(have)
        self.buffer = every[n:]
        self.position += n
        return every[:n]


def arc_records(source) -> Iterator[tuple[int, dict, bytes]]:
    """Position, header fields and content of each record; the first is the ``filedesc`` one.

    The header is split from the right, as the fields after the URL hold no spaces (a version 2
    header has ten, a version 1 header five)."""
    stream, fields = Stream(source), None
    while True:
        at, line = stream.position, stream.line()
        if line is None:
            return
        if not line.strip():
            continue
        text = line.decode("utf-8", "replace")
        if fields is None:
            if not text.startswith("filedesc://"):
                raise ValueError("an ARC file starts with a filedesc record")
            body = stream.take(int(text.rsplit(" ", 1)[1]))
            version, names = body.decode("utf-8", "replace").split("\n")[:2]
            fields = names.split()
            if version.split()[:1] not in (["1"], ["2"]) or fields[0] != "URL" or fields[-1] != "Archive-length":
                raise ValueError(f"unknown ARC version line: {version!r} {names!r}")
        else:
            body = None
        values = text.rsplit(" ", len(fields) - 1)
        if len(values) != len(fields):
            raise ValueError(f"header has {len(values)} of {len(fields)} fields: {text[:200]!r}")
        header = dict(zip(fields, values))
        yield at, header, stream.take(int(header["Archive-length"])) if body is None else body


def http_parts(content: bytes) -> tuple[bytes | None, bytes]:
    """Head (with its blank line) and payload of an HTTP response; no head for other content."""
    if not content.startswith(b"HTTP/"):
        return None, content
    found = re.search(rb"\r?\n\r?\n", content)
    return (content[: found.end()], content[found.end() :]) if found else (content, b"")


def http_number(head: bytes | None, name: str) -> int | None:
    found = re.search(rb"(?im)^" + name.encode() + rb":\s*(-?\d+)\s*$", head or b"")
    return int(found[1]) if found else None


def safe_url(url: str | None) -> str:
    """A URL without white space or controls, as a header line needs; null becomes ``urn:none``."""
    return quote(url, safe="%/:=&?~#+!$,;'@()*[]") if url else "urn:none"


def arc_file(pages: Iterable[tuple[int | None, str | None, str | None]], name: str, version: int, date: str, totals: dict) -> Iterator[bytes]:
    """The members of one ARC file, a filedesc record and one record a page."""
    fields = V1_FIELDS if version == 1 else V2_FIELDS
    body = f"{version} 0 crawler\n{fields}\n\n".encode()
    extra = "" if version == 1 else f"200 - - 0 {name} "
    yield squeeze(f"filedesc://{name} 0.0.0.0 {date} text/plain {extra}{len(body)}\n".encode() + body + b"\n")
    at = 0
    for page_id, url, html in pages:
        payload = (html or "").encode("utf-8")
        known = "" if page_id is None else f"X-Page-Id: {page_id}\r\n"
        content = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n{known}Content-Length: {len(payload)}\r\n\r\n".encode() + payload
        extra = "" if version == 1 else f"200 {hashlib.md5(content).hexdigest()} - {at} {name} "
        head = f"{safe_url(url)} 0.0.0.0 {date} text/html {extra}{len(content)}\n"
        member = squeeze(head.encode("utf-8") + content + b"\n")
        at += len(member)
        totals["n"] += 1
        yield member


def write_arcs(pages: DataFrame, folder: str, date: str = "20200101000000") -> DataFrame:
    """Write ``pages`` (page_id, url, html) as ARC files, versions 1 and 2 by turns, one file a
    partition; returns the written list of files. Null html is an empty payload, a null url is
    ``urn:none``, a null page_id leaves the page's header out; repeated rows are all written."""
    text_batches(pages.sparkSession)

    def run(batches):
        task = TaskContext.get()
        number, totals = task.partitionId(), {"n": 0}

        def rows():
            for b in batches:
                yield from zip(b.column("page_id").to_pylist(), b.column("url").to_pylist(), b.column("html").to_pylist())

        source = rows()
        head = next(source, None)
        if head is None:
            return

        def chained():
            yield head
            yield from source

        name = f"pages-{number:07d}.arc.gz"
        path = put_file(folder, name, arc_file(chained(), name, 1 + number % 2, date, totals), str(task.taskAttemptId()))
        yield pa.RecordBatch.from_pydict({"number": pa.array([number], pa.int32()), "path": [path], "n_records": [totals["n"]]})

    rows = pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), F.col("html").cast("string"))
    return written(rows.mapInArrow(run, FILES), "arcs")


def _spread(files: DataFrame) -> DataFrame:
    return files.repartition(max(1, files.count()))


def index_arcs(files: DataFrame, folder: str) -> DataFrame:
    """One row per archived page: where it is, and length and SHA-1 of its payload."""

    def run(batches):
        fs, _ = open_folder(folder)
        for b in batches:
            for number, path in zip(b.column("number").to_pylist(), b.column("path").to_pylist()):
                out = {c.split()[0]: [] for c in INDEX.split(", ")}
                with fs.open_input_stream(path, compression=None) as source:
                    for place, (at, header, content) in enumerate(arc_records(source)):
                        if not place:  # the file's own description; a page may have such a URL too
                            continue
                        head, payload = http_parts(content)
                        for name, value in (("number", number), ("path", path), ("position", at), ("page_id", http_number(head, "X-Page-Id")), ("payload_bytes", len(payload)),
                                            ("payload_digest", hashlib.sha1(payload).hexdigest()), ("url", header["URL"]), ("date", header["Archive-date"])):
                            out[name].append(value)
                kinds = {"number": pa.int32(), "position": pa.int64(), "page_id": pa.int64(), "payload_bytes": pa.int64()}
                yield pa.RecordBatch.from_pydict({k: pa.array(v, kinds.get(k, pa.string())) for k, v in out.items()})

    return _spread(files).mapInArrow(run, INDEX)


def record_id(name: str, position: int) -> str:
    """A stable identifier of a record from its place in its archive."""
    return f"urn:uuid:{uuid.uuid5(NAMESPACE, f'{name} {position}')}"


def warc_date(date: str) -> str:
    """An ARC date (14 digits, or fewer of a shorter one) as WARC writes it."""
    d = re.sub(r"\D", "", date).ljust(4, "0")[:14]
    d += "00000101000000"[len(d):] if len(d) < 14 else ""
    return f"{d[:4]}-{d[4:6]}-{d[6:8]}T{d[8:10]}:{d[10:12]}:{d[12:14]}Z"


def sha1_label(content: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(content).digest()).decode()


def warc_record(headers: list[tuple[str, str]], block: bytes) -> bytes:
    lines = ["WARC/1.1", *(f"{k}: {v}" for k, v in headers), f"Content-Length: {len(block)}", "", ""]
    return "\r\n".join(lines).encode("utf-8") + block + b"\r\n\r\n"


def converted(name: str, records: Iterator[tuple[int, dict, bytes]], revisits: dict[int, tuple[str, str, str]], totals: dict) -> Iterator[bytes]:
    """WARC members for the records of one ARC file. ``revisits``: by position, the identifier,
    URL and date of the record that holds the same payload."""
    for place, (at, header, content) in enumerate(records):
        base = [("WARC-Record-ID", f"<{record_id(name, at)}>"), ("WARC-Date", warc_date(header["Archive-date"]))]
        if not place:  # the file's own description
            info = f"software: archive converter\r\nformat: WARC File Format 1.1\r\ndescription: {header['URL']}\r\n".encode()
            yield squeeze(warc_record([("WARC-Type", "warcinfo"), *base, ("Content-Type", "application/warc-fields")], info))
            continue
        head, payload = http_parts(content)
        base += [("WARC-Target-URI", header["URL"]), ("WARC-IP-Address", header["IP-address"]), ("WARC-Payload-Digest", sha1_label(payload))]
        if head is None:
            kind, media, block = ("response" if header["URL"].startswith("dns:") else "resource"), header["Content-type"], content
        elif at in revisits:
            other, url, date = revisits[at]
            kind, media, block = "revisit", "application/http; msgtype=response", head
            base += [("WARC-Profile", REVISIT_PROFILE), ("WARC-Refers-To", f"<{other}>"), ("WARC-Refers-To-Target-URI", url), ("WARC-Refers-To-Date", date)]
        else:
            kind, media, block = "response", "application/http; msgtype=response", content
        totals["n"] += 1
        yield squeeze(warc_record([("WARC-Type", kind), *base, ("WARC-Block-Digest", sha1_label(block)), ("Content-Type", media)], block))


def convert_arcs(index: DataFrame, arc_folder: str, folder: str, least: int = LEAST) -> DataFrame:
    """Convert every indexed ARC file to a WARC file; returns the written list of files.

    Of records with equal payloads of at least ``least`` bytes, the one with the largest page_id
    (then file and position) keeps the payload."""
    place = F.struct(F.col("page_id"), F.col("number"), F.col("position"))
    holders = (index.filter(F.col("payload_bytes") >= least).groupBy("payload_digest", "payload_bytes")
               .agg(F.max_by(F.struct("number", "position", "path", "url", "date"), place).alias("holder"), F.count(F.lit(1)).alias("n"))
               .filter("n > 1").drop("n"))
    judged = index.join(holders, ["payload_digest", "payload_bytes"], "left").select(
        "number", "path", "position",
        F.when((F.col("holder.number") != F.col("number")) | (F.col("holder.position") != F.col("position")), F.col("holder")).alias("holder"))

    def run(rows):
        fs, _ = open_folder(arc_folder)
        number, path = rows.column("number")[0].as_py(), rows.column("path")[0].as_py()
        revisits = {at: (record_id(h["path"].rsplit("/", 1)[1], h["position"]), h["url"], warc_date(h["date"]))
                    for at, h in zip(rows.column("position").to_pylist(), rows.column("holder").to_pylist()) if h}
        name, totals = path.rsplit("/", 1)[1], {"n": 0}
        with fs.open_input_stream(path, compression=None) as source:
            out = put_file(folder, name.removesuffix(".arc.gz") + ".warc.gz", converted(name, arc_records(source), revisits, totals), str(TaskContext.get().taskAttemptId()))
        return pa.table({"number": pa.array([number], pa.int32()), "path": pa.array([out]), "n_records": pa.array([totals["n"]], pa.int64())})

    # As many tasks as files: their index rows are few bytes, the archives that a task converts are not.
    spread = judged.repartition(max(1, index.select("number").distinct().count()), "number")
    return written(spread.groupBy("number").applyInArrow(run, FILES), "warcs")


def warc_records(source) -> Iterator[tuple[dict[str, str], bytes]]:
    """Headers and block of each WARC record."""
    stream = Stream(source)
    while True:
        line = stream.line()
        if line is None:
            return
        if not line.strip():
            continue
        if not line.startswith(b"WARC/"):
            raise ValueError(f"not a WARC record: {line[:80]!r}")
        headers = {}
        while (line := stream.line()) is not None and line.strip():
            name, _, value = line.decode("utf-8").partition(":")
            headers[name.strip()] = value.strip()
        yield headers, stream.take(int(headers["Content-Length"]))


def read_warcs(files: DataFrame, folder: str) -> DataFrame:
    """One row per response, revisit or resource record; digests of stored payloads are checked."""

    def run(batches):
        fs, _ = open_folder(folder)
        for b in batches:
            for path in b.column("path").to_pylist():
                out = {c.split()[0]: [] for c in RECORDS.split(", ")}
                with fs.open_input_stream(path, compression=None) as source:
                    for headers, block in warc_records(source):
                        if headers["WARC-Type"] == "warcinfo":
                            continue
                        head, payload = http_parts(block)
                        digest = headers["WARC-Payload-Digest"]
                        revisit = headers["WARC-Type"] == "revisit"
                        if sha1_label(block) != headers["WARC-Block-Digest"] or not revisit and sha1_label(payload) != digest:
                            raise ValueError(f"{path}: digest of {headers['WARC-Record-ID']} does not match")
                        for name, value in (("page_id", http_number(head, "X-Page-Id")), ("record_id", headers["WARC-Record-ID"]), ("record_type", headers["WARC-Type"]),
                                            ("payload_bytes", http_number(head, "Content-Length") if revisit else len(payload)),
                                            ("payload_digest", base64.b32decode(digest.partition(":")[2]).hex()), ("refers_to_id", headers.get("WARC-Refers-To")),
                                            ("url", headers.get("WARC-Target-URI")), ("date", headers["WARC-Date"])):
                            out[name].append(value)
                yield pa.RecordBatch.from_pydict({k: pa.array(v, pa.int64() if k in ("page_id", "payload_bytes") else pa.string()) for k, v in out.items()})

    return _spread(files).mapInArrow(run, RECORDS)


def resolve_revisits(records: DataFrame) -> DataFrame:
    """``records`` with ``refers_to``, the page_id of the record a revisit names (else null)."""
    plain = records.filter(F.col("refers_to_id").isNull()).withColumn("refers_to", F.lit(None).cast("long"))
    holders = records.filter(F.col("refers_to_id").isNull()).select(F.col("record_id").alias("refers_to_id"), F.col("page_id").alias("refers_to"))
    return plain.unionByName(records.filter(F.col("refers_to_id").isNotNull()).join(holders, "refers_to_id", "left"))


def archive_round_trip(pages: DataFrame, folder: str) -> DataFrame:
    """Pages to ARC files, those to WARC files, and the WARC records read back."""
    arcs = write_arcs(pages, f"{folder}/arc")
    index = written(index_arcs(arcs, f"{folder}/arc"), "arc-index")
    warcs = convert_arcs(index, f"{folder}/arc", f"{folder}/warc")
    return resolve_revisits(written(read_warcs(warcs, f"{folder}/warc"), "warc-records"))
