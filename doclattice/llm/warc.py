"""WARC archives: a writer, and a splittable reader of gzip member files.

Writer: one record in one gzip member for each row. Payload digests are SHA-1 in
base32. Of rows with equal payloads of at least ``least`` bytes the one with the
smallest page_id becomes a response record and the others become revisit records
that name it and carry no payload; rows with shorter payloads are responses. A
task writes one file under a name of its own, into a folder of the shared store,
and returns the name; the names that came back are the archive (kept by
checkpoint()), so a file left by a lost or repeated task is not read.

Reader: files are cut into byte ranges without regard to records. A task reads
its range, scans it for gzip magic, and validates each candidate by decoding it: a
version line first, then a header that ends in a blank line and names a known
type, an id and a length in digits that the member's data has; data inside of a
member that looks like magic fails that. A task owns the records that start inside of its
range, and reads on past the range's end to complete the last one.

Nulls: a null html is an empty payload. A null page_id never stands for others
by smallness (it orders last) and is read back as null; among several rows with
one page_id and payload the first in the order of url is the response; of rows
alike in all three one is, and the others are revisits of it. A null
url is written as an empty target. Empty tables give an empty archive. Extra
columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from doclattice.llm.common import let

MAGIC = b"\x1f\x8b\x08"
VERSION = b"WARC/1.0\r\n"
TYPES = {b"response", b"revisit", b"request", b"warcinfo", b"resource", b"metadata", b"conversion", b"continuation"}
#: A candidate member must show the version line within so many compressed bytes.
HEAD = 512
BLOCK = 1 << 20
#: Most tasks of the reader; with more ranges than that, tasks read several.
MOST_TASKS = 20_000
#: Most digests of equal payloads that are broadcast, about 150 bytes each; more are joined by a shuffle.
BROADCAST_DIGESTS = 100_000


ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
#: Revisits of one row's alike copies that a task makes.
ALIKE = 10_000


def base32_sha1(data: Column) -> Column:
    """The SHA-1 of bytes in base32, by built-in functions: five hexadecimal digits make four letters."""

    def letters(hexadecimal: Column) -> Column:
        parts = []
        for g in range(8):
            value = F.conv(F.substring(hexadecimal, 5 * g + 1, 5), 16, 10).cast("int")
            parts += [F.substring(F.lit(ALPHABET), F.shiftright(value, shift).bitwiseAND(31) + 1, F.lit(1)) for shift in (15, 10, 5, 0)]
        return F.concat(*parts)

    return let(F.sha1(data), letters)


def digests(pages: DataFrame, least: int = 0) -> DataFrame:
    """pages -> page_id, url, payload, payload_bytes, payload_digest, record_type, refers_to.

    Which row of a digest is first follows from what rows hold alone, so a repeated task decides as before. Rows alike in all of it are one response, and
    revisits made from their number.
    """
    rows = pages.select("page_id", "url", F.coalesce(F.encode("html", "utf-8"), F.lit(b"")).alias("payload"))
    place = F.struct(F.col("page_id").isNull().alias("n"), F.col("page_id").alias("p"), F.coalesce("url", F.lit("")).alias("u"))
    dug = rows.select("*", F.octet_length("payload").cast("long").alias("payload_bytes"), base32_sha1(F.col("payload")).alias("payload_digest"), place.alias("place"))
    long = F.col("payload_bytes") >= least
    # From narrow rows, aggregated before the shuffle: the first place of each digest, and how many rows are alike there.
    places = dug.where(long).groupBy(F.col("payload_digest").alias("d"), "place").agg(F.count(F.lit(1)).alias("c"))
    least_place = places.groupBy("d").agg(F.min(F.struct("place", "c")).alias("f"), F.sum("c").alias("rows")).where("rows > 1")
    first = least_place.select("d", F.col("f.place").alias("first"), F.col("f.c").alias("alike")).checkpoint()
    few = first.count() <= BROADCAST_DIGESTS
    found = dug.join(F.broadcast(first) if few else first, (F.col("payload_digest") == F.col("d")) & long, "left")
    is_first = F.coalesce(F.col("place") == F.col("first"), F.lit(False))
    columns = ["page_id", "url", "payload", "payload_bytes", "payload_digest", "record_type", "refers_to"]
    revisit = F.col("d").isNotNull() & ~is_first
    single = found.where(~is_first | (F.col("alike") == 1)).withColumns(
        {"record_type": F.when(revisit, "revisit").otherwise("response"), "refers_to": F.when(revisit, F.col("first.p"))}
    )
    if first.where("alike > 1").isEmpty():
        return single.select(*columns)
    one = found.where(is_first & (F.col("alike") > 1)).groupBy("payload_digest").agg(*(F.first(c).alias(c) for c in ("page_id", "url", "payload", "payload_bytes", "alike")))
    response = one.withColumns({"record_type": F.lit("response"), "refers_to": F.lit(None).cast("long")})
    # Without payloads, and dealt over tasks however many there are.
    parts = one.drop("payload").withColumn("part", F.explode(F.sequence(F.lit(0), F.floor((F.col("alike") - 2) / ALIKE)))).repartition("payload_digest", "part")
    size = F.least(F.col("alike") - 1 - F.col("part") * ALIKE, F.lit(ALIKE))
    again = parts.withColumn("k", F.explode(F.sequence(F.lit(1).cast("long"), size))).withColumns({"payload": F.lit(None).cast("binary"), "record_type": F.lit("revisit"), "refers_to": F.col("page_id")})
    return single.select(*columns).unionByName(response.select(*columns)).unionByName(again.select(*columns))


def record(page_id, url, payload: bytes | None, digest: str, kind: str, refers_to, size: int | None = None) -> bytes:
    """size: of the payload, where a revisit comes without it."""
    size = len(payload) if size is None else size
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % size
    body = http + (payload if kind == "response" else b"")
    head = [
        f"WARC-Type: {kind}",
        f"WARC-Record-ID: <urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{page_id}|{url}|{digest}')}>",
        "WARC-Date: 1970-01-01T00:00:00Z",
        f"WARC-Target-URI: {(url or '').translate({10: '%0A', 13: '%0D'})}",
        f"WARC-Payload-Digest: sha1:{digest}",
        "Content-Type: application/http;msgtype=response",
        f"Content-Length: {len(body)}",
        f"X-Payload-Bytes: {size}",
    ]
    if page_id is not None:
        head.append(f"X-Page-ID: {page_id}")
    if kind == "revisit":
        head.append("WARC-Profile: http://netpreserve.org/warc/1.0/revisit/identical-payload-digest")
        if refers_to is not None:
            head.append(f"X-Refers-To-Page-ID: {refers_to}")
    return VERSION + "\r\n".join(head).encode() + b"\r\n\r\n" + body + b"\r\n\r\n"


def gzip_member(data: bytes) -> bytes:
    c = zlib.compressobj(6, zlib.DEFLATED, 31)
    return c.compress(data) + c.flush()


def open_folder(uri: str):
    """A pyarrow file system and the path in it, for local and remote URIs alike."""
    scheme, mark, rest = uri.partition("://")
    if mark:  # pyarrow knows Hadoop's S3 schemes by their plain name
        return fs.FileSystem.from_uri(f"{ {'s3a': 's3', 's3n': 's3'}.get(scheme, scheme) }://{rest}")
    return fs.FileSystem.from_uri(uri if uri.startswith(("file:", "/")) else f"file://{uri}")


def write_archive(records: DataFrame, folder: str) -> DataFrame:
    """digests() -> file, bytes, records: one row for each file written."""

    def run(batches):
        files, path = open_folder(folder)
        name, out, count, size = f"{path}/{uuid.uuid4().hex}.warc.gz", None, 0, 0
        for b in batches:
            for r in b.to_pylist():
                if out is None:
                    files.create_dir(path, recursive=True)
                    out = files.open_output_stream(name, compression=None)
                data = gzip_member(record(r["page_id"], r["url"], r["payload"], r["payload_digest"], r["record_type"], r["refers_to"], r["payload_bytes"]))
                out.write(data)
                count, size = count + 1, size + len(data)
        if out is not None:
            out.close()
            yield pa.RecordBatch.from_pydict({"file": [name], "bytes": [size], "records": [count]}, schema=pa.schema([("file", pa.string()), ("bytes", pa.int64()), ("records", pa.int64())]))

    return records.mapInArrow(run, "file string, bytes long, records long").checkpoint()


class Buffered:
    """Reads of a file, by blocks."""

    def __init__(self, f, block: int = BLOCK) -> None:
        self.f, self.block, self.at, self.data = f, block, 0, b""

    def __call__(self, position: int, size: int) -> bytes:
        if position < self.at or position + size > self.at + len(self.data):
            self.f.seek(position)
            self.at, self.data = position, self.f.read(max(size, self.block))
        return self.data[position - self.at : position - self.at + size]


def sound(member: bytes) -> bool:
    """Whether an inflated member is a WARC record, by its header."""
    head, end, body = member.partition(b"\r\n\r\n")
    lines = head.split(b"\r\n")
    fields = {k.strip().lower(): v.strip() for k, mark, v in (x.partition(b":") for x in lines[1:]) if mark}
    length = fields.get(b"content-length", b"")
    return bool(end) and lines[0] + b"\r\n" == VERSION and fields.get(b"warc-type") in TYPES and b"warc-record-id" in fields and length.isdigit() and int(length) <= len(body)


def member_at(read, at: int) -> tuple[bytes, int] | None:
    """The inflated member that starts there and where it ends; None if none does or it isn't a WARC record's."""
    d, parts, size = zlib.decompressobj(31), [], HEAD
    seen = 0
    try:
        while not d.eof:
            data = read(at, size)
            if not data:
                return None
            at, size = at + len(data), BLOCK
            parts.append(d.decompress(data))
            if seen < len(VERSION):
                parts = [b"".join(parts)]
                seen = len(parts[0])
                if not VERSION.startswith(parts[0][: len(VERSION)]):
                    return None
    except zlib.error:
        return None
    whole = b"".join(parts)
    return (whole, at - len(d.unused_data)) if sound(whole) else None


def members(read, start: int, end: int, block: int = BLOCK):
    """Inflated WARC members that start in [start, end) of a file. read(position, size): bytes of the file."""
    at = start
    while at < end:
        if read(at, len(MAGIC)) == MAGIC and (found := member_at(read, at)) is not None:
            yield found[0]
            at = found[1]
            continue
        span = min(block, end - at - 1)
        next_one = read(at + 1, span + len(MAGIC) - 1).find(MAGIC)
        at += 1 + (next_one if 0 <= next_one < span else span)


def parse(member: bytes) -> dict:
    head, _, body = member.partition(b"\r\n\r\n")
    fields = dict(x.split(": ", 1) if ": " in x else (x.rstrip(":"), "") for x in head.decode("utf-8", "replace").split("\r\n")[1:])
    block = body[: int(fields["Content-Length"])]
    number = lambda k: int(fields[k]) if k in fields else None
    kind = fields["WARC-Type"]
    payload = block.partition(b"\r\n\r\n")[2] if kind == "response" else None
    return {
        "page_id": number("X-Page-ID"),
        "url": fields["WARC-Target-URI"],
        "record_type": kind,
        "refers_to": number("X-Refers-To-Page-ID"),
        "payload": payload,
        "payload_bytes": len(payload) if payload is not None else int(fields["X-Payload-Bytes"]),
        "payload_digest": base64.b32encode(hashlib.sha1(payload).digest()).decode() if payload is not None else fields["WARC-Payload-Digest"].removeprefix("sha1:"),
    }


def read_archive(spark: SparkSession, manifest: DataFrame, folder: str, split: int = 4 << 20, payloads: bool = True) -> DataFrame:
    """The records of the manifest's files, read by byte ranges of so many bytes."""
    fields = [("page_id", pa.int64()), ("url", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string())]
    schema = "page_id long, url string, record_type string, refers_to long, payload_bytes long, payload_digest string"
    if payloads:
        fields, schema = [*fields, ("payload", pa.binary())], schema + ", payload binary"

    def run(batches):
        files, _ = open_folder(folder)
        for b in batches:
            for r in b.to_pylist():
                with files.open_input_file(r["file"]) as f:
                    rows, held = [], 0
                    for m in members(Buffered(f), r["start"], min(r["start"] + split, r["bytes"])):
                        rows.append(parse(m))
                        held += len(m)
                        if held > 8 << 20:
                            yield pa.RecordBatch.from_pylist([{k: x[k] for k, _ in fields} for x in rows], schema=pa.schema(fields))
                            rows, held = [], 0
                    if rows:
                        yield pa.RecordBatch.from_pylist([{k: x[k] for k, _ in fields} for x in rows], schema=pa.schema(fields))

    ranges = manifest.select("file", "bytes", F.explode(F.sequence(F.lit(0).cast("long"), F.col("bytes") - 1, F.lit(split).cast("long"))).alias("start"))
    # A stated number of tasks: ranges are small rows, which would be gathered into one task by their size.
    tasks = min(max(1, ranges.count()), MOST_TASKS)
    return ranges.repartition(tasks, "file", "start").mapInArrow(run, schema)


def archive_folder(spark: SparkSession) -> str:
    """A new folder below the session's checkpoint folder."""
    return f"{spark.sparkContext._jsc.sc().getCheckpointDir().get()}/warc-{uuid.uuid4().hex}"
