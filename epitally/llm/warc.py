"""WARC records in ZIP archives: written by Spark tasks, found by index and read back by range.

An archive holds two stored members: the records, each compressed on its own so that it can be
read alone, and an index with the place of each. Reading parses the ZIP directory, then the index,
then only the bytes of the records asked for; nothing is extracted.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import json
import uuid
import zipfile
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import scratch_path
from .common import shared_table
from .zip_archive import directory, stored_at

RECORDS, INDEX = "archive/records.warc.gz", "indexes/index.cdxj"
WRITTEN_AT = "2024-01-01T00:00:00Z"
ARCHIVE_BYTES = 64 << 20
READ_BYTES = 4 << 20
TASK_BYTES = 8 << 20
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def record_id(page_id: int | None) -> str:
    return f"<urn:x-page:{'none' if page_id is None else page_id}>"


def page_of(record: str) -> int | None:
    name = record.removeprefix("<urn:x-page:").removesuffix(">")
    return None if name == "none" else int(name)


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, revisits: bool,
           refers_to: int | None) -> bytes:
    """One record; a revisit has the response's headers without its payload."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n"
    block = http.encode() + (b"" if revisits else payload)
    head = [
        "WARC/1.1", f"WARC-Type: {'revisit' if revisits else 'response'}", f"WARC-Record-ID: {record_id(page_id)}",
        f"WARC-Date: {WRITTEN_AT}", f"WARC-Payload-Digest: sha1:{digest}",
    ]
    if url is not None:
        head.append("WARC-Target-URI: " + url.replace("\r", "%0D").replace("\n", "%0A"))
    if revisits:
        head += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: {record_id(refers_to)}"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}", "", ""]
    return "\r\n".join(head).encode("utf-8", "surrogatepass") + block + b"\r\n\r\n"


def parsed(data: bytes) -> dict:
    """The parts of one record; a payload that doesn't have its digest is an error."""
    head, block = data.split(b"\r\n\r\n", 1)
    fields = dict(line.split(": ", 1) for line in head.decode("utf-8", "surrogatepass").split("\r\n")[1:])
    block = block[: int(fields["Content-Length"])]
    http, payload = block.split(b"\r\n\r\n", 1)
    size = next(int(line.split(b":")[1]) for line in http.split(b"\r\n") if line.startswith(b"Content-Length:"))
    digest = fields["WARC-Payload-Digest"].removeprefix("sha1:")
    revisits = fields["WARC-Type"] == "revisit"
    if not revisits and (len(payload) != size or base32_sha1(payload) != digest):
        raise ValueError(f"record {fields['WARC-Record-ID']} has a damaged payload")
    refers = fields.get("WARC-Refers-To")
    return {
        "page_id": page_of(fields["WARC-Record-ID"]), "url": fields.get("WARC-Target-URI"),
        "record_type": fields["WARC-Type"], "payload_bytes": size, "payload_digest": digest,
        "refers_to": None if refers is None else page_of(refers), "payload": None if revisits else payload,
    }


def base32_sha1(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def opened(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path or URI and the path in it: local, HDFS or an object store."""
    return fs.FileSystem.from_uri(path)


def write_archives(pages: DataFrame, min_bytes: int = 0, archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """Write all pages (``page_id``, ``url``, ``html``); a row per archive: ``path``, ``records``, ``bytes``.

    Of pages with equal payloads of ``min_bytes`` or more, the one with the largest id is a response,
    the others revisit it. A null html is an empty payload. A missing id counts as the least; rows with equal
    id and payload are equal records. Every attempt of a task writes archives of its own names, and
    only those of the attempt that Spark commits are listed, so a lost executor does no harm.
    """
    html = F.coalesce(F.col("html").cast("string"), F.lit(""))
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"),
                        html.alias("html"), F.sha1(html).alias("digest"))
    ids = rows.where(F.octet_length("html") >= min_bytes).select("page_id", "digest")
    # Only small rows meet by payload, so a payload that a third of all pages share moves no text.
    shared = ids.groupBy("digest").agg(F.max("page_id").alias("last"), F.count(F.lit(1)).alias("n")).where("n > 1")
    revisits = ids.join(shared, "digest").where(~F.col("page_id").eqNullSafe(F.col("last"))).select(
        F.col("page_id").alias("of"), F.col("digest").alias("as"), "last"
    ).distinct()
    marked = rows.join(
        revisits, F.col("page_id").eqNullSafe(F.col("of")) & (F.col("digest") == F.col("as")), "left"
    ).select("page_id", "url", "html", "digest", "last", F.col("as").isNotNull().alias("revisits"))
    folder = scratch_path(pages.sparkSession, "archives")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, place = opened(folder)
        system.create_dir(place, recursive=True)
        archive = None
        for batch in batches:
            for row in batch.to_pylist():
                archive = archive or _Archive(system, place, folder)
                payload = row["html"].encode("utf-8", "surrogatepass")
                digest = base64.b32encode(bytes.fromhex(row["digest"])).decode()
                archive.add(row["page_id"], record(row["page_id"], row["url"], payload, digest, row["revisits"],
                                                   row["last"]))
                if archive.size >= archive_bytes:
                    yield archive.closed()
                    archive = None
        if archive:
            yield archive.closed()

    return shared_table(marked.mapInArrow(write, "path string, records long, bytes long"), "manifest")


class _Archive:
    """An archive while it is written; its index is held until it is closed."""

    def __init__(self, system: fs.FileSystem, place: str, folder: str):
        name = f"{uuid.uuid4().hex}.wacz"
        self.path = f"{folder}/{name}"
        self.stream = system.open_output_stream(f"{place}/{name}")
        self.zip = zipfile.ZipFile(self.stream, "w", zipfile.ZIP_STORED)
        self.member = self.zip.open(zipfile.ZipInfo(RECORDS), "w", force_zip64=True)
        self.size, self.lines = 0, []

    def add(self, page_id: int | None, data: bytes) -> None:
        packed = gzip.compress(data, 4, mtime=0)
        self.member.write(packed)
        self.lines.append(json.dumps({"page_id": page_id, "offset": self.size, "length": len(packed)}))
        self.size += len(packed)

    def closed(self) -> pa.RecordBatch:
        self.member.close()
        self.zip.writestr(zipfile.ZipInfo(INDEX), "".join(line + "\n" for line in self.lines))
        self.zip.close()
        self.stream.close()
        values = [[self.path], [len(self.lines)], [self.size]]
        return pa.RecordBatch.from_arrays([pa.array(v) for v in values], names=["path", "records", "bytes"])


def list_records(archives: DataFrame) -> DataFrame:
    """``path``, ``page_id``, ``offset`` and ``length`` of every record, from the archives' own indexes.

    Offsets count from the start of the archive, so that a record is one range of the file.
    """

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path in batch.column("path").to_pylist():
                system, place = opened(path)
                with system.open_input_file(place) as file:
                    read_at = lambda at, n: file.read_at(n, at)
                    members = {m.name: m for m in directory(read_at, file.size())}
                    base = stored_at(read_at, members[RECORDS])
                    index = members[INDEX]
                    lines = read_at(stored_at(read_at, index), index.size).decode().splitlines()
                found = [json.loads(line) for line in lines]
                yield pa.RecordBatch.from_arrays([
                    pa.array([path] * len(found), pa.string()),
                    pa.array([x["page_id"] for x in found], pa.int64()),
                    pa.array([x["offset"] + base for x in found], pa.int64()),
                    pa.array([x["length"] for x in found], pa.int64()),
                ], names=["path", "page_id", "offset", "length"])

    return archives.select("path").mapInArrow(find, "path string, page_id long, offset long, length long")


READ_SCHEMA = ("page_id long, url string, record_type string, payload_bytes long, payload_digest string, "
               "refers_to long, payload binary")


def read_records(places: DataFrame) -> DataFrame:
    """The records at ``path``, ``offset``, ``length``; neighbours are read in one range of up to 4 MB."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [f.split()[0] for f in READ_SCHEMA.split(", ")]
        types = [pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.binary()]
        for batch in batches:
            for path, spans in _ranges(batch):
                system, place = opened(path)
                with system.open_input_file(place) as file:
                    for begin, end, records in spans:
                        data = file.read_at(end - begin, begin)
                        rows = [parsed(gzip.decompress(data[at - begin: at - begin + n])) for at, n in records]
                        yield pa.RecordBatch.from_arrays(
                            [pa.array([r[c] for r in rows], t) for c, t in zip(names, types)], names=names
                        )

    return places.select("path", "offset", "length").mapInArrow(read, READ_SCHEMA)


def _ranges(batch: pa.RecordBatch) -> Iterator[tuple[str, list[tuple[int, int, list[tuple[int, int]]]]]]:
    """Per file, ranges of neighbouring records."""
    files: dict[str, list[tuple[int, int, list]]] = {}
    rows = sorted(zip(*(batch.column(c).to_pylist() for c in ("path", "offset", "length"))))
    for path, at, n in rows:
        spans = files.setdefault(path, [])
        if spans and spans[-1][1] == at and at + n - spans[-1][0] <= READ_BYTES:
            begin, _, records = spans[-1]
            records.append((at, n))
            spans[-1] = (begin, at + n, records)
        else:
            spans.append((at, at + n, [(at, n)]))
    yield from files.items()


def read_archives(archives: DataFrame) -> DataFrame:
    """All records of the listed archives, spread over tasks by the bytes they hold."""
    total = archives.agg(F.coalesce(F.sum("bytes"), F.lit(0)), F.count(F.lit(1))).first()
    tasks = max(1, -(-total[0] // TASK_BYTES))
    places = list_records(archives.repartition(max(1, min(total[1], tasks)), "path"))
    return read_records(places.repartitionByRange(tasks, "path", "offset").sortWithinPartitions("path", "offset"))
