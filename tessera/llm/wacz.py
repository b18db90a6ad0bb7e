"""WARC records in ZIP packages, read back by range without unpacking.

A package is a ZIP file whose members are stored, not compressed:
``archive/data.warc.gz`` with one gzip member for each record, and
``indexes/index.cdxj`` with a sorted line for each record: its URL as a sort key,
its time, and as JSON its offset and length in the archive.  The reader parses the end of the central directory (and
its ZIP64 form), the central directory and the local header of a member; it then
reads the index and fetches each record as a byte range of the package.

Packages lie in the folder that the cluster shares.  They are opened with
``pyarrow.fs``, so any file system that it knows will do.
"""

from __future__ import annotations

import base64
import gzip
import io
import json
import struct
import zipfile
from collections.abc import Iterator
from dataclasses import dataclass
from uuid import uuid4

import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.llm.common import checkpointed, shared_dir

ARCHIVE, INDEX = "archive/data.warc.gz", "indexes/index.cdxj"
#: Payloads of fewer bytes are always written in full.
LEAST_BYTES = 1000
REVISIT = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
URN = "urn:tessera:page:"


# -- ZIP ---------------------------------------------------------------------


@dataclass(frozen=True)
class Member:
    """A member of a package, by its central directory entry."""

    name: str
    method: int
    size: int
    header: int


def directory(f, size: int) -> dict[str, Member]:
    """The members of the ZIP file ``f`` of ``size`` bytes, from its central or ZIP64 directory."""
    tail = min(size, 65_557)  # the end record and the longest comment
    f.seek(size - tail)
    end = f.read(tail)
    at = end.rfind(b"PK\5\6")
    if at < 0:
        raise ValueError("not a ZIP file: it has no end of central directory")
    count, length, start = struct.unpack_from("<HII", end, at + 10)
    if 0xFFFF == count or 0xFFFFFFFF in (length, start):
        if end[at - 20 : at - 16] != b"PK\6\7":
            raise ValueError("broken ZIP file: it has no ZIP64 locator")
        f.seek(struct.unpack_from("<Q", end, at - 12)[0])
        record = f.read(56)
        if record[:4] != b"PK\6\6":
            raise ValueError("broken ZIP file: it has no ZIP64 end record")
        count, length, start = struct.unpack_from("<QQQ", record, 32)
    f.seek(start)
    entries, found, at = f.read(length), {}, 0
    for _ in range(count):
        if entries[at : at + 4] != b"PK\1\2":
            raise ValueError("broken ZIP file: bad central directory")
        flags, method = struct.unpack_from("<HH", entries, at + 8)
        packed, plain, n_name, n_extra, n_comment = struct.unpack_from("<IIHHH", entries, at + 20)
        header = struct.unpack_from("<I", entries, at + 42)[0]
        name = entries[at + 46 : at + 46 + n_name].decode("utf-8" if flags & 0x800 else "cp437")
        extra = entries[at + 46 + n_name : at + 46 + n_name + n_extra]
        while len(extra) >= 4:
            kind, n = struct.unpack_from("<HH", extra)
            if kind == 1:  # ZIP64: only the values that overflow, in this order
                wide = iter(struct.unpack_from(f"<{n // 8}Q", extra, 4))
                plain = next(wide) if plain == 0xFFFFFFFF else plain
                packed = next(wide) if packed == 0xFFFFFFFF else packed
                header = next(wide) if header == 0xFFFFFFFF else header
            extra = extra[4 + n :]
        found[name] = Member(name, method, packed, header)
        at += 46 + n_name + n_extra + n_comment
    return found


def start_of(f, member: Member) -> int:
    """Where a stored member's bytes begin in the package."""
    if member.method != zipfile.ZIP_STORED:
        raise ValueError(f"{member.name} is compressed, so it can't be read by range")
    f.seek(member.header)
    local = f.read(30)
    if local[:4] != b"PK\3\4":
        raise ValueError(f"{member.name} has no local header")
    n_name, n_extra = struct.unpack_from("<HH", local, 26)
    return member.header + 30 + n_name + n_extra


# -- WARC --------------------------------------------------------------------


def record_bytes(kind: str, key: str, url: str, digest: str, size: int, payload: bytes, refers: str | None, date: str) -> bytes:
    """One WARC record: the HTTP headers of a response, then its payload; a revisit leaves the payload out."""
    block = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode()
    named = base64.b32encode(bytes.fromhex(digest)).decode()
    head = [
        "WARC/1.1",
        f"WARC-Type: {kind}",
        f"WARC-Record-ID: <{URN}{key}>",
        f"WARC-Date: {date}",
        f"WARC-Target-URI: {' '.join(url.split())}",
        f"WARC-Payload-Digest: sha1:{named}",
        "Content-Type: application/http; msgtype=response",
    ]
    if kind == "revisit":
        head += [f"WARC-Profile: {REVISIT}", f"WARC-Refers-To: <{URN}{refers}>"]
    else:
        block += payload
    head.append(f"Content-Length: {len(block)}")
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse_record(raw: bytes) -> dict:
    """Fields of one record; the digest of a response is computed from its payload and held against the header's."""
    from hashlib import sha1

    head, _, rest = raw.partition(b"\r\n\r\n")
    version, *lines = head.decode().split("\r\n")
    if not version.startswith("WARC/"):
        raise ValueError("not a WARC record")
    fields = {k.lower(): v.strip() for k, _, v in (x.partition(":") for x in lines)}
    block = rest[: int(fields["content-length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    size = next(int(x.split(b":")[1]) for x in http.split(b"\r\n") if x.lower().startswith(b"content-length:"))
    named = base64.b32decode(fields["warc-payload-digest"].removeprefix("sha1:")).hex()
    kind = fields["warc-type"]
    if kind == "response" and (sha1(payload).hexdigest() != named or len(payload) != size):
        raise ValueError(f"{fields['warc-record-id']}: its payload does not match its digest")
    bare = lambda x: x and x.strip("<>").removeprefix(URN)
    return {
        "key": bare(fields["warc-record-id"]),
        "url": fields["warc-target-uri"],
        "record_type": kind,
        "payload": payload if kind == "response" else None,
        "payload_bytes": size,
        "payload_digest": named,
        "refers_to": bare(fields.get("warc-refers-to")),
    }


def sort_key(url: str) -> str:
    """A URL with its host's labels reversed, as index lines begin: ``com,example)/path``; without white space, as that ends the key."""
    scheme, sep, rest = url.partition("://")
    host, slash, path = (rest if sep else "").partition("/")
    name = host.rpartition("@")[2].partition(":")[0].lower()
    return "".join((",".join(reversed(name.split("."))) + f")/{path}" if name else url or "-").split())


class PackageWriter:
    """Writes one package; records go straight to the file, only the index is held."""

    def __init__(self, sink, date: str):
        self.time = "".join(filter(str.isdigit, date))[:14]
        self.zip = zipfile.ZipFile(sink, "w", zipfile.ZIP_STORED, allowZip64=True)
        self.archive = self.zip.open(zipfile.ZipInfo(ARCHIVE), "w", force_zip64=True)
        self.at, self.lines = 0, []

    def add(self, kind: str, key: str, url: str, record: bytes, level: int) -> None:
        packed = gzip.compress(record, level, mtime=0)
        self.archive.write(packed)
        entry = {"url": url, "id": key, "type": kind, "offset": self.at, "length": len(packed), "filename": ARCHIVE.rpartition("/")[2]}
        self.lines.append(f"{sort_key(url)} {self.time} {json.dumps(entry)}\n")
        self.at += len(packed)

    def close(self) -> None:
        self.archive.close()
        self.zip.writestr(zipfile.ZipInfo(INDEX), "".join(sorted(self.lines)))
        self.zip.close()


def records(f, size: int) -> Iterator[dict]:
    """All records of the package ``f``, each fetched by the range that the index gives."""
    members = directory(f, size)
    index, base = members[INDEX], start_of(f, members[ARCHIVE])
    f.seek(start_of(f, index))
    entries = (json.loads(x.split(" ", 2)[2]) for x in f.read(index.size).decode().split("\n") if x)
    for offset, length in sorted((e["offset"], e["length"]) for e in entries):
        f.seek(base + offset)
        yield parse_record(gzip.decompress(f.read(length)))


# -- tables ------------------------------------------------------------------


def plan(pages: DataFrame) -> DataFrame:
    """``pages`` (page_id, url, html) with payload_digest, record_type and refers_to.

    Equal payloads are found by SHA-1 and length.  Their counts are aggregated
    before any shuffle, and only payloads that occur more than once are joined
    back, so a large group of copies is never brought together; the join's hot
    keys are split by adaptive execution.
    """
    p = pages.select("page_id", F.coalesce("url", F.lit("")).alias("url"), F.coalesce("html", F.lit("")).alias("html"))
    p = p.select("*", F.sha1("html").alias("payload_digest"), F.octet_length("html").alias("n"))
    narrow = pages.select("page_id", F.coalesce("html", F.lit("")).alias("html"))
    large = narrow.select("page_id", F.sha1("html").alias("payload_digest"), F.octet_length("html").alias("n")).where(F.col("n") >= LEAST_BYTES)
    again = large.groupBy("payload_digest", "n").agg(F.max("page_id").alias("first"), F.count(F.lit(1)).alias("copies")).where("copies > 1").drop("copies")
    out = p.join(again, ["payload_digest", "n"], "left")
    revisit = F.col("first").isNotNull() & ~F.col("first").eqNullSafe(F.col("page_id"))
    return out.select(
        "page_id",
        "url",
        "html",
        "payload_digest",
        F.when(revisit, "revisit").otherwise("response").alias("record_type"),
        F.when(revisit, F.col("first")).alias("refers_to"),
    )


def write(pages: DataFrame, folder: str | None = None, date: str = "1970-01-01T00:00:00Z", level: int = 6) -> DataFrame:
    """Writes a record for each row of ``pages`` (page_id, url, html); returns (path, bytes, records) of the packages.

    Of rows with equal payloads of at least ``LEAST_BYTES`` the one with the
    largest page_id is written in full and the others refer to it; a row that
    has the largest page_id too is written in full as well.  Null html is an
    empty payload, null url an empty one.  Each task writes one package under a
    name of its own, so a task that runs again leaves no half of a package among
    the results; a table without rows gives none.
    """
    folder = folder or f"{shared_dir(pages.sparkSession)}/wacz-{uuid4().hex}"

    def step(batches):
        where, root = fs.FileSystem.from_uri(folder)
        where.create_dir(root, recursive=True)
        context = TaskContext.get()
        name = f"part-{context.partitionId():06d}-{context.taskAttemptId()}.wacz"
        sink = writer = None
        n = 0
        for b in batches:
            for page, url, html, digest, kind, refers in zip(*[c.to_pylist() for c in b.columns], strict=True):
                if writer is None:
                    sink = where.open_output_stream(f"{root}/{name}")
                    writer = PackageWriter(sink, date)
                payload = html.encode()
                writer.add(kind, str(page), url, record_bytes(kind, str(page), url, digest, len(payload), payload, str(refers), date), level)
                n += 1
        if writer is not None:
            writer.close()
            size = sink.tell()
            sink.close()
            yield pa.RecordBatch.from_pydict({"path": [f"{folder}/{name}"], "bytes": [size], "records": [n]})

    return checkpointed(plan(pages).mapInArrow(step, "path string, bytes long, records long"))


RECORD = T.StructType(
    [
        T.StructField("page_id", T.LongType()),
        T.StructField("url", T.StringType()),
        T.StructField("record_type", T.StringType()),
        T.StructField("payload", T.BinaryType()),
        T.StructField("payload_bytes", T.LongType()),
        T.StructField("payload_digest", T.StringType()),
        T.StructField("refers_to", T.LongType()),
    ]
)


def read(packages: DataFrame, rows: int = 500) -> DataFrame:
    """The records of packages (path): page_id, url, record_type, payload (null for a revisit), payload_bytes, payload_digest, refers_to.

    Nothing is extracted; a task holds one record and ``rows`` results at a time.
    """

    def number(x: str | None) -> int | None:
        return None if x in (None, "None") else int(x)

    def out(found: list[dict]) -> pa.RecordBatch:
        kinds = {"page_id": pa.int64(), "payload": pa.binary(), "payload_bytes": pa.int64(), "refers_to": pa.int64()}
        full = [x | {"page_id": number(x["key"]), "refers_to": number(x["refers_to"])} for x in found]
        return pa.RecordBatch.from_arrays([pa.array([x[c] for x in full], kinds.get(c, pa.string())) for c in RECORD.names], RECORD.names)

    def step(batches):
        for b in batches:
            for path in b.column(0).to_pylist():
                where, name = fs.FileSystem.from_uri(path)
                held = []
                with where.open_input_file(name) as f:
                    for r in records(io.BufferedReader(f, 1 << 20), f.size()):
                        held.append(r)
                        if len(held) == rows:
                            yield out(held)
                            held = []
                if held:
                    yield out(held)

    return packages.select("path").mapInArrow(step, RECORD)
