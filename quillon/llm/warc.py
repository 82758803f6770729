"""Web archives in ZIP packages: writing, and reading by ranges without extraction.

A package stores (never deflates) a WARC file whose records are gzip members of their own, and an index
of the records' offsets. The reader parses the end record, its ZIP64 form and the central directory,
finds the stored members, and fetches single records by range. Payloads that repeat are written once;
the other records are revisits that refer to it.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import io
import json
import re
import struct
import uuid
import zipfile
from collections.abc import Iterator
from dataclasses import dataclass
from urllib.parse import quote

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import store

LEAST_REVISIT = 1000  # bytes of a payload from which on repeats become revisits
PACKAGE_BYTES = 16 << 20
DATA, INDEX = "archive/data.warc.gz", "indexes/index.cdxj"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_SCHEMA = "page_id long, record_type string, url string, refers_to long, stated_digest string, payload binary"


def _base32(digest_hex: str) -> str:
    return "sha1:" + base64.b32encode(bytes.fromhex(digest_hex)).decode()


def record_id(page_id: int | None, digest_hex: str) -> str:
    """The same for a page and its payload in every attempt of a task, so revisits can name it; new for a page without an id."""
    return f"<urn:uuid:{uuid.uuid4() if page_id is None else uuid.uuid5(uuid.NAMESPACE_OID, f'{page_id}:{digest_hex}')}>"


def record(page_id: int | None, url: str | None, payload: bytes, digest_hex: str, refers_to: int | None) -> bytes:
    """One gzip member with one WARC record. The response that a revisit refers to has the same digest."""
    kind = "response" if refers_to is None else "revisit"
    head = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: {record_id(page_id, digest_hex if refers_to is None else kind + digest_hex)}", "WARC-Date: 1970-01-01T00:00:00Z"]
    if url is not None:
        head.append("WARC-Target-URI: " + "".join(c for c in url if c not in "\r\n"))
    if page_id is not None:
        head.append(f"X-Page-ID: {page_id}")
    head.append(f"WARC-Payload-Digest: {_base32(digest_hex)}")
    body = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
    if refers_to is None:
        body += payload
    else:
        head += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: {record_id(refers_to, digest_hex)}", f"X-Refers-To-Page: {refers_to}"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(body)}"]
    return gzip.compress("\r\n".join(head).encode() + b"\r\n\r\n" + body + b"\r\n\r\n", 1, mtime=0)


def parse(member: bytes) -> dict:
    """The fields of _SCHEMA from one gzip member; other record types keep their name and whole block."""
    raw = gzip.decompress(member)
    head, _, rest = raw.partition(b"\r\n\r\n")
    lines = head.decode("utf-8", "replace").split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("not a WARC record")
    fields = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
    block = rest[: int(fields["content-length"])]
    if fields.get("content-type", "").startswith("application/http"):
        block = block.partition(b"\r\n\r\n")[2]
    number = lambda k: int(fields[k]) if k in fields else None
    return {"page_id": number("x-page-id"), "record_type": fields.get("warc-type"), "url": fields.get("warc-target-uri"), "refers_to": number("x-refers-to-page"), "stated_digest": fields.get("warc-payload-digest"), "payload": block}


def filesystem(uri: str) -> tuple[pafs.FileSystem, str]:
    """The store of a path and the path in it. Executors open packages themselves, so stores that Arrow doesn't know are an error."""
    return pafs.FileSystem.from_uri(re.sub("^s3[an]://", "s3://", uri))


class Package:
    """Members of a ZIP file that is read by ranges. source: a random access file."""

    @dataclass
    class Member:
        name: str
        method: int
        size: int
        header: int

    def __init__(self, source):
        self.source, self.size = source, source.size()
        tail_at = max(0, self.size - 65557)
        tail = self.read(tail_at, self.size - tail_at)
        end = tail.rfind(b"PK\x05\x06")
        while end >= 0 and end + 22 + struct.unpack_from("<H", tail, end + 20)[0] != len(tail):
            end = tail.rfind(b"PK\x05\x06", 0, end)
        if end < 0:
            raise ValueError("no end of central directory")
        count, length, start = struct.unpack_from("<HII", tail, end + 10)
        if count == 0xFFFF or length == 0xFFFFFFFF or start == 0xFFFFFFFF:
            mark = self.read(tail_at + end - 20, 20)
            if mark[:4] != b"PK\x06\x07":
                raise ValueError("no ZIP64 locator")
            big = self.read(struct.unpack_from("<Q", mark, 8)[0], 56)
            if big[:4] != b"PK\x06\x06":
                raise ValueError("no ZIP64 end of central directory")
            count, length, start = struct.unpack_from("<QQQ", big, 32)
        self.members = {m.name: m for m in self._directory(self.read(start, length), count)}

    def read(self, start: int, length: int) -> bytes:
        self.source.seek(start)
        out = self.source.read(length)
        if len(out) != length:
            raise ValueError("package is cut short")
        return bytes(out)

    def _directory(self, raw: bytes, count: int) -> Iterator[Package.Member]:
        at = 0
        for _ in range(count):
            if raw[at : at + 4] != b"PK\x01\x02":
                raise ValueError("bad central directory")
            flags, method = struct.unpack_from("<HH", raw, at + 8)
            packed, size, n, m, k = struct.unpack_from("<IIHHH", raw, at + 20)
            (header,) = struct.unpack_from("<I", raw, at + 42)
            name = raw[at + 46 : at + 46 + n].decode("utf-8" if flags & 0x800 else "cp437")
            extra, here = raw[at + 46 + n : at + 46 + n + m], 0
            while here + 4 <= len(extra):
                tag, long = struct.unpack_from("<HH", extra, here)
                if tag == 1:  # ZIP64: the fields that are full, in this order
                    wide = list(struct.unpack_from(f"<{long // 8}Q", extra, here + 4))
                    size = wide.pop(0) if size == 0xFFFFFFFF else size
                    packed = wide.pop(0) if packed == 0xFFFFFFFF else packed
                    header = wide.pop(0) if header == 0xFFFFFFFF else header
                here += 4 + long
            yield Package.Member(name, method, size, header)
            at += 46 + n + m + k

    def start(self, name: str) -> int:
        """Where a stored member's bytes begin."""
        member = self.members[name]
        if member.method != 0:
            raise ValueError(f"{name} is not stored")
        local = self.read(member.header, 30)
        if local[:4] != b"PK\x03\x04":
            raise ValueError("bad local header")
        n, m = struct.unpack_from("<HH", local, 26)
        return member.header + 30 + n + m

    def records(self) -> Iterator[dict]:
        """Every record that an index lists, each fetched by its range."""
        for index in sorted(n for n, m in self.members.items() if n.startswith("indexes/") and n.endswith(".cdxj") and m.method == 0):
            text = self.read(self.start(index), self.members[index].size).decode()
            starts: dict[str, int] = {}
            for line in text.splitlines():
                entry = json.loads(line[line.index("{") :])
                file = "archive/" + entry["filename"]
                if file not in starts:
                    starts[file] = self.start(file)
                yield parse(self.read(starts[file] + int(entry["offset"]), int(entry["length"])))


def pack(records: list[tuple[str, bytes]]) -> bytes:
    """A package of (url, record)."""
    data, lines, at = io.BytesIO(), [], 0
    for url, member in records:
        data.write(member)
        lines.append(f"{quote(url or '-', safe=':/?#&=+,;@~%')} 19700101000000 " + json.dumps({"filename": DATA.split("/")[1], "offset": str(at), "length": str(len(member))}))
        at += len(member)
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_STORED) as z:
        z.writestr(zipfile.ZipInfo(DATA), data.getvalue())
        z.writestr(zipfile.ZipInfo(INDEX), "\n".join(sorted(lines)))
        z.writestr(zipfile.ZipInfo("datapackage.json"), json.dumps({"profile": "data-package", "wacz_version": "1.1.1"}))
    return out.getvalue()


def write_packages(pages: DataFrame, folder: str) -> DataFrame:
    """Write pages (page_id, url, html) as packages under folder; a written table of their paths.

    Of payloads that are equal and have at least LEAST_REVISIT bytes the one of the largest page_id is
    the response; the others, without that id, are revisits. Null html is an empty payload. Names of
    packages are new in every attempt of a task, and only those of attempts that succeed are listed.
    """
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.encode(F.coalesce(F.col("html").cast("string"), F.lit("")), "UTF-8").alias("payload"))
    rows = rows.withColumn("digest", F.sha1("payload"))
    repeated = rows.where(F.length("payload") >= LEAST_REVISIT).groupBy("digest").agg(F.count("*").alias("n"), F.max("page_id").alias("first")).where("n > 1 and first is not null")
    rows = rows.join(store.table(repeated.select("digest", "first"), "repeated"), "digest", "left")
    refers = F.when((F.length("payload") >= LEAST_REVISIT) & (F.col("page_id").isNull() | (F.col("page_id") != F.col("first"))), F.col("first"))
    rows = rows.withColumn("refers_to", refers).select("page_id", "url", F.when(F.col("refers_to").isNull(), F.col("payload")).otherwise(F.lit(b"")).alias("payload"), "digest", "refers_to")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = filesystem(folder)
        held, size = [], 0

        def close() -> pa.RecordBatch:
            name = f"{uuid.uuid4().hex}.wacz"
            fs.create_dir(root, recursive=True)
            with fs.open_output_stream(f"{root}/{name}") as out:
                out.write(pack(held))
            return pa.RecordBatch.from_arrays([pa.array([f"{folder}/{name}"]), pa.array([len(held)], pa.int64())], names=["path", "n"])

        for batch in batches:
            for row in zip(*(batch.column(i) for i in range(5)), strict=True):
                page, url, payload, digest, first = (x.as_py() for x in row)
                held.append((url, record(page, url, payload, digest, first)))
                size += len(held[-1][1])
                if size >= PACKAGE_BYTES:
                    yield close()
                    held, size = [], 0
        if held:
            yield close()

    return store.table(rows.mapInArrow(run, "path string, n long"), "packages")


def read_packages(paths: DataFrame) -> DataFrame:
    """The records of packages (path), read by ranges; columns as in _SCHEMA, with the payload's own digest."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["page_id", "record_type", "url", "refers_to", "stated_digest", "payload"]
        kinds = [pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.binary()]
        for batch in batches:
            for path in batch.column(0).to_pylist():
                fs, place = filesystem(path)
                with fs.open_input_file(place) as source:
                    held, size = [], 0
                    for found in Package(source).records():
                        if found["record_type"] == "response" and found["stated_digest"] not in (None, _base32(hashlib.sha1(found["payload"]).hexdigest())):
                            raise ValueError(f"payload of {found['url']} in {path} doesn't have its digest")
                        held.append(found)
                        size += len(found["payload"])
                        if size > 1 << 22:
                            yield pa.RecordBatch.from_arrays([pa.array([h[n] for h in held], k) for n, k in zip(names, kinds, strict=True)], names=names)
                            held, size = [], 0
                    if held:
                        yield pa.RecordBatch.from_arrays([pa.array([h[n] for h in held], k) for n, k in zip(names, kinds, strict=True)], names=names)

    spread = paths.select("path").repartition(store.parallelism(paths.sparkSession), "path")
    return spread.mapInArrow(run, _SCHEMA)


def round_trip(pages: DataFrame) -> DataFrame:
    """(page_id, payload_bytes, payload_digest, record_type, refers_to) of every page, from packages read back.

    A revisit has size and digest of the response that it refers to: of that page the one whose digest it states,
    since one page_id may stand on several payloads.
    """
    spark = pages.sparkSession
    found = read_packages(write_packages(pages, store.new_path(spark, "warc")))
    found = found.select("page_id", "record_type", "refers_to", "stated_digest", F.length("payload").cast("long").alias("n"), F.sha1("payload").alias("digest"))
    found = store.table(found, "records")
    full = found.where("record_type = 'response'").groupBy(F.col("page_id").alias("first"), F.col("stated_digest").alias("of")).agg(F.max(F.struct("n", "digest")).alias("full"))
    full = store.table(full.where("first is not null"), "responses")  # of two fresh exchanges, so the revisits of one response can be split
    again = found.where("refers_to is not null").join(full, (F.col("refers_to") == F.col("first")) & (F.col("stated_digest") == F.col("of")), "left").drop("first", "of")
    alone = found.where("refers_to is null").withColumn("full", F.lit(None).cast(full.schema["full"].dataType))
    found = again.unionByName(alone)
    return found.select("page_id", F.coalesce("full.n", "n").alias("payload_bytes"), F.coalesce("full.digest", "digest").alias("payload_digest"), "record_type", "refers_to")
