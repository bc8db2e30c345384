"""Legacy archives: ARC files of versions 1 and 2, converted to WARC, and WARC files read back.

An ARC file begins with a version block that names the fields of its records' header lines; each record is
such a line and as many bytes as it declares. A line that is no header, and a record that ends early, are
reported and left out, and reading goes on at the next header line. The converter reads a file twice: once for an index (digests
and sizes), from which the records to be stored once are chosen, and once to write its WARC file. Payloads
are never shuffled; the index is, by digest, after partial aggregation.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import io
import re
import uuid
import zlib
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gaugewright.llm.shared import opened, shared_folder, written

#: Bytes after which a worker begins another archive, and most tasks that archives are dealt out to.
FILE_BYTES = 16 << 20
TASKS = 20_000

#: The fields of a record's header line, by version.
ARC_FIELDS = {
    1: ["URL", "IP-address", "Archive-date", "Content-type", "Archive-length"],
    2: ["URL", "IP-address", "Archive-date", "Content-type", "Result-code", "Checksum", "Location", "Offset", "Filename", "Archive-length"],
}
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: Header lines by version: URL and content type may hold spaces, so fields are read from both ends, and an address and a date part the two.
_LINES = {
    1: re.compile(r"(.*?) ([0-9A-Za-z.:-]+) ([0-9]{4,17}) (.*) ([0-9]+)"),
    2: re.compile(r"(.*?) ([0-9A-Za-z.:-]+) ([0-9]{4,17}) (.*) ([0-9]{1,3}|-) (\S+) (\S+) (\S+) (\S+) ([0-9]+)"),
}
_HEAD_END = re.compile(rb"\r\n\r\n|\n\n")
_KEY = b"X-Page-Id"
_UNSAFE = re.compile(r"[\x00-\x20\x7f]")


class ArcRecord(NamedTuple):
    """A record of an ARC file: its number in the file, the header line's fields by name, the declared bytes; or what is wrong with it."""

    number: int
    fields: dict[str, str]
    block: bytes
    error: str | None = None

    @property
    def parts(self) -> tuple[bytes, bytes]:
        """HTTP head with its blank line, the first of either kind, and payload; without an HTTP head all is payload."""
        if not self.block.startswith(b"HTTP/"):
            return b"", self.block
        found = _HEAD_END.search(self.block)
        end = found.end() if found else len(self.block)
        return self.block[:end], self.block[end:]


def _gunzipped(uri: str) -> io.BufferedReader:
    files, path = opened(uri)
    raw = files.open_input_stream(path, compression=None)
    return io.BufferedReader(gzip.GzipFile(fileobj=raw) if path.endswith(".gz") else raw, 1 << 18)


def read_arc(stream: io.BufferedReader) -> Iterator[ArcRecord]:
    """The records of an ARC file after its version block, and those in error; an error is raised for a stream that doesn't begin as one."""
    head = stream.readline().decode("utf-8", "replace").rstrip("\n")
    if not head.startswith("filedesc://"):
        raise ValueError("an ARC file begins with a filedesc line")
    block = stream.read(int(head.rsplit(" ", 1)[1]))
    version = int(block.split(b" ", 1)[0])
    if version not in ARC_FIELDS:
        raise ValueError(f"ARC version {version}")
    names, number, lost = ARC_FIELDS[version], 0, False
    while line := stream.readline(1 << 16):
        if line in (b"\n", b"\r\n"):
            continue
        if not (found := _LINES[version].fullmatch(line.decode("utf-8", "replace").rstrip("\r\n"))):
            if not lost:  # one error for all lines up to the next header
                yield ArcRecord(number, {}, b"", f"header line {line[:80]!r} of version {version}")
                number, lost = number + 1, True
            continue
        lost, fields = False, dict(zip(names, found.groups(), strict=True))
        block = stream.read(int(fields["Archive-length"]))
        short = len(block) < int(fields["Archive-length"])
        yield ArcRecord(number, fields, block, f"ends after {len(block)} of {fields['Archive-length']} bytes" if short else None)
        number += 1


def arc_record(version: int, url: str | None, block: bytes, *, ip: str = "0.0.0.0", date: str = "20000101000000", kind: str = "text/html", status: str = "200") -> bytes:
    """A record with its header line; what a header line can't hold in a URL is percent-encoded, no URL is ``-``."""
    safe = _UNSAFE.sub(lambda m: f"%{ord(m[0]):02X}", url or "") or "-"
    more = [status, "-", "-", "0", "-"] if version == 2 else []
    return " ".join([safe, ip, date, kind, *more, str(len(block))]).encode("utf-8", "replace") + b"\n" + block + b"\n"


def _version_block(version: int, name: str) -> bytes:
    text = f"{version} 0 gaugewright\n{' '.join(ARC_FIELDS[version])}\n".encode()
    return arc_record(version, f"filedesc://{name}", text, kind="text/plain") if version == 1 else f"filedesc://{name} 0.0.0.0 20000101000000 text/plain 200 - - 0 - {len(text)}\n".encode() + text + b"\n"


class _Archive:
    """An archive of gzip members that appears under its name when it is complete."""

    def __init__(self, folder: str, kind: str):
        self.uri, self.size = f"{folder}/{uuid.uuid4().hex}.{kind}.gz", 0
        self.files, self.path = opened(self.uri)
        self.files.create_dir(self.path.rpartition("/")[0], recursive=True)
        self.out = self.files.open_output_stream(f"{self.path}.part", compression=None)

    def add(self, record: bytes) -> None:
        self.size += self.out.write(member := gzip.compress(record, 1, mtime=0)) or len(member)

    def close(self) -> str:
        self.out.close()
        self.files.move(f"{self.path}.part", self.path)
        return self.uri


def write_arc(pages: DataFrame) -> DataFrame:
    """(path) of ARC files with a record for each row of pages (page_id, url, html), in versions 1 and 2 by turns of a partition's number.

    The block is an HTTP response with page_id in a header; a null html is an empty body, a null page_id has no
    header. Repeated rows are records of their own; other columns are ignored.
    """
    folder = shared_folder(pages.sparkSession, "arc")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made, archive, turn = [], None, TaskContext.get().partitionId()
        for batch in batches:
            for key, url, html in zip(*(x.to_pylist() for x in batch.columns), strict=True):
                if archive is None:
                    version, turn = 1 + turn % 2, turn + 1
                    archive = _Archive(folder, "arc")
                    archive.add(_version_block(version, archive.uri.rpartition("/")[2]))
                body = (html or "").encode()
                named = b"" if key is None else b"%s: %d\r\n" % (_KEY, key)
                archive.add(arc_record(version, url, b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n%sContent-Length: %d\r\n\r\n" % (named, len(body)) + body))
                if archive.size >= FILE_BYTES:
                    made.append(archive.close())
                    archive = None
        if archive is not None:
            made.append(archive.close())
        yield pa.RecordBatch.from_arrays([pa.array(made, pa.string())], ["path"])

    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html")
    return written(rows.mapInArrow(write, "path string"), "arc-files")


def record_id(path: str, number: int) -> str:
    """The identifier of a converted record, the same whenever it is converted."""
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{path.rpartition("/")[2]}#{number}')}>"


def warc_date(date: str) -> str:
    """ISO time of an ARC date of up to 14 digits; what is missing or out of range is that of the epoch."""
    digits = (date if date.isascii() and date.isdigit() else "")[:14]
    parts = [digits[:4], *(digits[i : i + 2] for i in range(4, 14, 2))]
    low, high, none = (1, 1, 1, 0, 0, 0), (9999, 12, 31, 23, 59, 60), ("1970", "01", "01", "00", "00", "00")
    y, m, d, h, n, s = (p if len(p) == len(z) and a <= int(p) <= b else z for p, a, b, z in zip(parts, low, high, none, strict=True))
    return f"{y}-{m}-{d}T{h}:{n}:{s}Z"


def _digest(data: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(data).digest()).decode()


def _warc(kind: str, headers: list[tuple[str, str]], block: bytes) -> bytes:
    lines = [("WARC-Type", kind), *headers, ("Content-Length", str(len(block)))]
    return b"WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in lines).encode() + b"\r\n" + block + b"\r\n\r\n"


def _dealt(files: DataFrame) -> DataFrame:
    return files.repartition(max(1, min(TASKS, files.count())))


def _key(head: bytes) -> int | None:
    found = re.search(rb"(?m)^" + _KEY + rb": (-?[0-9]+)\r?$", head)
    return int(found[1]) if found else None


def convert(files: DataFrame, *, least_bytes: int = 1000) -> DataFrame:
    """(path, errors) of WARC files with a record for each record of ARC files (path); errors: (number, what is wrong) of records left out.

    Of records whose payloads are equal and have at least ``least_bytes``, that with the largest page_id (a
    header; none is least; of several the last by file and place) is written whole, the others as revisits of
    it. Records with an HTTP head are responses, others resources. A file without records gives a file with
    its warcinfo alone, as does one that is no ARC file, with error number -1; no files give none.
    """
    spark = files.sparkSession
    folder = shared_folder(spark, "warc")

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path in batch.column("path").to_pylist():
                rows = [(-1, None, 0, b"", None)]
                with _gunzipped(path) as stream:
                    try:
                        for record in read_arc(stream):
                            head, payload = record.parts
                            rows.append((record.number, _key(head), len(payload), hashlib.sha1(payload).digest(), record.error))
                    except (ValueError, IndexError, EOFError, zlib.error, gzip.BadGzipFile) as e:
                        rows = [(*rows[0][:4], f"{type(e).__name__}: {e}"), *rows[1:]]
                number, key, size, digest, error = zip(*rows, strict=True)
                yield pa.RecordBatch.from_arrays([pa.array([path] * len(rows)), pa.array(number, pa.int64()), pa.array(key, pa.int64()), pa.array(size, pa.int64()), pa.array(digest, pa.binary()), pa.array(error, pa.string())], ["path", "number", "key", "size", "digest", "error"])

    held = written(_dealt(files).mapInArrow(index, "path string, number long, key long, size long, digest binary, error string"), "arc-index")
    # number -1 stands for a file, so one without records is written too
    place = F.struct("key", "path", "number")
    several = held.where((F.col("number") >= 0) & F.col("error").isNull() & (F.col("size") >= least_bytes)).groupBy("digest").agg(F.max(place).alias("kept"), F.count("*").alias("n")).where("n > 1").select("digest", "kept")
    marked = held.join(several, "digest", "left")
    own = (F.col("kept.path") == F.col("path")) & (F.col("kept.number") == F.col("number"))
    plan = marked.withColumn("kept", F.when(~own, F.col("kept"))).select("path", "number", F.col("kept.path").alias("to_path"), F.col("kept.number").alias("to_number"), F.col("kept.key").alias("to_key"), "error")
    plan = plan.repartition(max(int(spark.conf.get("spark.sql.shuffle.partitions")), min(TASKS, files.count())), "path").sortWithinPartitions("path", "number")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, archive, records, made, errors = None, None, iter(()), [], []

        def flush() -> pa.RecordBatch:
            kind = pa.list_(pa.struct([("number", pa.int64()), ("error", pa.string())]))
            made.append((archive.close(), [{"number": n, "error": e} for n, e in errors]))
            out = pa.RecordBatch.from_arrays([pa.array([p for p, _ in made], pa.string()), pa.array([e for _, e in made], kind)], ["path", "errors"])
            made.clear()
            errors.clear()
            return out

        for batch in batches:
            for path, number, to_path, to_number, to_key, error in zip(*(x.to_pylist() for x in batch.columns), strict=True):
                if path != now:
                    if archive is not None:
                        yield flush()
                    now, archive, records = path, _Archive(folder, "warc"), read_arc(_gunzipped(path))
                    name = path.rpartition("/")[2]
                    about = f"software: gaugewright\r\nformat: WARC File Format 1.1\r\nisPartOf: {name}\r\n".encode()
                    archive.add(_warc("warcinfo", [("WARC-Record-ID", record_id(path, -1)), ("WARC-Date", warc_date("")), ("Content-Type", "application/warc-fields")], about))
                if error is not None:
                    errors.append((number, error))
                if number >= 0:
                    record = next(records)
                    if error is None:
                        archive.add(_converted(record, path, None if to_number is None else (to_path, to_number, to_key)))
        if archive is not None:
            yield flush()

    return written(plan.mapInArrow(write, "path string, errors array<struct<number: long, error: string>>"), "warc-files")


def _converted(record: ArcRecord, path: str, to: tuple[str, int, int | None] | None) -> bytes:
    """The WARC record of an ARC record; to: file, number and key of the record that has its payload."""
    head, payload = record.parts
    headers = [("WARC-Record-ID", record_id(path, record.number)), ("WARC-Date", warc_date(record.fields["Archive-date"])), ("WARC-Target-URI", record.fields["URL"]), ("WARC-IP-Address", record.fields["IP-address"]), ("WARC-Payload-Digest", _digest(payload)), ("Content-Type", "application/http; msgtype=response" if head else record.fields["Content-type"])]
    if to is None:
        return _warc("response" if head else "resource", [*headers, ("WARC-Block-Digest", _digest(record.block))], record.block)
    more = [("WARC-Profile", _PROFILE), ("WARC-Refers-To", record_id(*to[:2])), ("X-Payload-Length", str(len(payload)))]
    return _warc("revisit", [*headers, *more, *([] if to[2] is None else [("X-Refers-To-Page-Id", str(to[2]))])], head)


def read_warc(files: DataFrame, *, payloads: bool = False) -> DataFrame:
    """(page_id, record_id, url, date, record_type, payload_bytes, payload_digest, refers_to, refers_to_record, error) of the records of WARC files (path), warcinfo left out.

    payload_digest is SHA-1 in lower-case hex; that of a whole record is computed again, and where it isn't what
    the record says, error says so; else it is null. refers_to is the page_id of the record that a revisit refers to. With
    ``payloads``, a column payload of a whole record's bytes follows.
    """

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["page_id", "record_id", "url", "date", "record_type", "payload_bytes", "payload_digest", "refers_to", "refers_to_record", "error", *["payload"] * payloads]
        types = [pa.int64(), *[pa.string()] * 4, pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), *[pa.binary()] * payloads]

        def flush(rows: list[tuple]) -> pa.RecordBatch:
            columns = list(zip(*rows, strict=True)) or [[]] * len(types)
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names)

        for batch in batches:
            for path in batch.column("path").to_pylist():
                rows = []
                with _gunzipped(path) as stream:
                    for row in _warc_rows(stream):
                        rows.append(row if payloads else row[:-1])
                        if len(rows) >= (100 if payloads else 5000):
                            yield flush(rows)
                            rows = []
                yield flush(rows)

    return _dealt(files).mapInArrow(read, "page_id long, record_id string, url string, date string, record_type string, payload_bytes long, payload_digest string, refers_to long, refers_to_record string, error string" + ", payload binary" * payloads)


def _warc_rows(stream: io.BufferedReader) -> Iterator[tuple]:
    while line := stream.readline():
        if line in (b"\r\n", b"\n"):
            continue
        if not line.startswith(b"WARC/1."):
            raise ValueError(f"version line {line[:40]!r}")
        fields = {}
        while (line := stream.readline().strip(b"\r\n")):
            name, _, value = line.decode().partition(":")
            fields[name.lower()] = value.strip()
        block = stream.read(int(fields["content-length"]))
        if (kind := fields["warc-type"]) == "warcinfo":
            continue
        record = ArcRecord(0, {}, block)
        head, payload = record.parts
        said, own = base64.b32decode(fields["warc-payload-digest"].removeprefix("sha1:")).hex(), hashlib.sha1(payload).hexdigest()
        error = f"payload has digest {own}" if kind != "revisit" and own != said else None
        to = fields.get("x-refers-to-page-id")
        yield _key(head), fields["warc-record-id"], fields.get("warc-target-uri"), fields["warc-date"], kind, int(fields.get("x-payload-length", len(payload))), said, int(to) if to else None, fields.get("warc-refers-to"), error, None if kind == "revisit" else payload
