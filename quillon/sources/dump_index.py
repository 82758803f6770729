"""An index into a bzip2 dump: where each page begins, so that a second pass reads only blocks with wanted pages.

bzip2 compresses blocks on their own, of at most 900 kB, that begin at any bit with a fixed mark. A data source plans
partitions by bytes and reads the blocks that begin in each; a page belongs to the partition in which the end mark before it
begins. The first pass writes a narrow directory of all pages with the block and the place in it where each begins. Fetching
groups wanted pages by block and decompresses those blocks, and the next ones where a page goes on there.
"""

from __future__ import annotations

import bz2
from bisect import bisect_right
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from .. import scratch
from . import dump

# The marks of a block and of a stream's end, and the end of a page.
BLOCK, END = 0x314159265359, 0x177245385090
PAGE_END = b"</page>"
RANGE_BYTES = 8 << 20
AHEAD = 1 << 20
FORMAT = "quillon_dump"
SCHEMA = "path string, block long, offset long, value string"


def marks(data: bytes) -> list[tuple[int, bool]]:
    """(bit, whether a block begins) of every mark in data, in order; marks may begin at any bit."""
    found = []
    for mark, begins in ((BLOCK, True), (END, False)):
        for shift in range(8):
            whole = (mark << (8 - shift)).to_bytes(7)
            at = data.find(whole[1:6], 1)  # these five bytes don't depend on what is around the mark
            while at >= 0:
                if at + 6 <= len(data):
                    bits = int.from_bytes(data[at - 1 : at + 6])
                    if bits >> (8 - shift) & ((1 << 48) - 1) == mark:
                        found.append((8 * (at - 1) + shift, begins))
                at = data.find(whole[1:6], at + 1)
    return sorted(set(found))


def decompressed(data: bytes, low: int, high: int) -> bytes:
    """The content of the block from bit low to bit high of data, as a stream of its own."""
    first, last = low // 8, -(-high // 8)
    bits = int.from_bytes(data[first:last]) >> (8 * last - high) & ((1 << (high - low)) - 1)
    check = bits >> (high - low - 80) & 0xFFFFFFFF
    n = high - low + 80
    whole = (bits << 80 | END << 32 | check) << (-n % 8)
    try:
        return bz2.decompress(b"BZh9" + whole.to_bytes((n + 7) // 8))
    except (OSError, ValueError) as error:
        raise dump.SourceError("dump has a broken block") from error


class Source:
    """A file of a store, with how many bytes were read of it."""

    def __init__(self, path: str):
        self.fs, place = scratch.filesystem(path)
        self.file = self.fs.open_input_file(place)
        self.size, self.read = self.file.size(), 0

    def __enter__(self) -> Source:
        return self

    def __exit__(self, *_) -> None:
        self.file.close()

    def blocks(self, low: int) -> Iterator[tuple[int, bytes]]:
        """(bit, content) of the blocks that begin from byte low on; raises where the file ends within one."""
        at = end = max(0, low - 1)
        held, begun, done = b"", None, 8 * low - 1
        while True:
            self.file.seek(end)
            more = self.file.read(min(AHEAD, self.size - end))
            self.read += len(more)
            held, end = held + more, end + len(more)
            for bit, begins in marks(held):
                here = 8 * at + bit
                if here <= done:
                    continue
                if begun is not None:
                    yield begun, decompressed(held, begun - 8 * at, here - 8 * at)
                begun, done = here if begins else None, here
            if not more:
                if begun is not None:
                    raise dump.SourceError("dump is cut short")
                return
            keep = max(at, (end - 8 if begun is None else begun // 8) - 1)
            held, at = held[keep - at :], keep


def owned(source: Source, low: int, high: int) -> Iterator[tuple[int, int, bytes]]:
    """(block, offset, record) of the records that are the byte range's: those after an end mark that begins in its blocks."""
    text, base = b"", 0  # content from the current record on, and where that is in the range's content
    begins: list[int] = []
    names: list[int] = []
    started, own_end, total, searched = low == 0, None, 0, 0
    for bit, content in source.blocks(low):
        if bit >= 8 * high and own_end is None:
            own_end = total
            if not started or not total:
                return
        begins.append(total)
        names.append(bit)
        text, total = text + content, total + len(content)
        while (at := text.find(PAGE_END, max(0, searched - base))) >= 0:
            if started:
                k = bisect_right(begins, base) - 1
                yield names[k], base - begins[k], text[:at]
            elif own_end is not None:
                return
            if own_end is not None and base + at >= own_end:
                return
            started = True
            text, base = text[at + len(PAGE_END) :], base + at + len(PAGE_END)
            searched = base
        if not started:
            text, base = text[-len(PAGE_END) + 1 :], total - min(len(text), len(PAGE_END) - 1)
        searched = max(base, total - len(PAGE_END) + 1)
    if started and text and begins:
        k = max(0, bisect_right(begins, base) - 1)
        yield names[k], base - begins[k], text


class Range(InputPartition):
    def __init__(self, path: str, low: int, high: int):
        self.path, self.low, self.high = path, low, high


class DumpReader(DataSourceReader):
    def __init__(self, paths: list[str], size: int):
        self.paths, self.size = paths, size

    def partitions(self) -> list[Range]:
        out = []
        for path in self.paths:
            fs, place = scratch.filesystem(path)
            n = fs.get_file_info(place).size
            out += [Range(path, low, min(n, low + self.size)) for low in range(0, n, self.size)]
        return out

    def read(self, partition: Range) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        with Source(partition.path) as source:
            for block, offset, record in owned(source, partition.low, partition.high):
                held.append((partition.path, block, offset, record.decode()))
                size += len(record)
                if size >= 4 << 20:
                    yield _batch(held, SCHEMA)
                    held, size = [], 0
        if held:
            yield _batch(held, SCHEMA)


class DumpSource(DataSource):
    """Records of bzip2 dumps. Options: paths, one a line; bytes, of a partition."""

    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DumpReader:
        return DumpReader(self.options["paths"].split("\n"), int(self.options.get("bytes", RANGE_BYTES)))


def _batch(rows: list[tuple], schema: str) -> pa.RecordBatch:
    kinds = [x.split() for x in schema.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(c, pa.int64() if k == "long" else pa.string()) for c, (_, k) in zip(zip(*rows, strict=True), kinds, strict=True)], names=[n for n, _ in kinds])


def records(spark: SparkSession, paths: list[str], size: int = RANGE_BYTES) -> DataFrame:
    """(path, block, offset, value): the records of dumps, each up to the end mark of a page, and where it begins."""
    spark.dataSource.register(DumpSource)
    return spark.read.format(FORMAT).option("paths", "\n".join(paths)).option("bytes", size).load()


def write(spark: SparkSession, paths: list[str], folder: str, size: int = RANGE_BYTES) -> DataFrame:
    """Write the directory of all pages of dumps to folder: their narrow columns, and path, block and offset; the directory."""
    rows = records(spark, paths, size).where(F.col("value").contains("<page>"))
    place = F.struct("path", "block", "offset")
    found = dump.parsed(rows.withColumn("scan_pos", place)).select("scan_pos", "title", "namespace", "page_id", "redirect_target", "revision_id")
    found.write.parquet(folder)
    return spark.read.parquet(folder)


def fetch(wanted: DataFrame) -> DataFrame:
    """(scan_pos, bytes_read, ...) and the columns of pages, of wanted places (scan_pos: path, block, offset).

    Each block is read once, by one task; bytes_read is what that took, stated with the block's first page.
    """
    places = wanted.select("scan_pos.path", "scan_pos.block", "scan_pos.offset").distinct()
    kinds = "path string, block long, offset long, value string, bytes_read long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked: dict[tuple[str, int], list[int]] = {}
        for batch in batches:  # places alone: some numbers for each wanted page of this task
            for path, block, offset in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                asked.setdefault((path, block), []).append(offset)
        for (path, block), offsets in sorted(asked.items()):
            found = []
            with Source(path) as source:
                text, left = b"", sorted(offsets)
                for bit, content in source.blocks(block // 8):
                    if not text and bit != block:
                        continue
                    text += content
                    while left and (end := text.find(PAGE_END, left[0])) >= 0:
                        found.append((path, block, left[0], text[left.pop(0) : end].decode()))
                    if not left:
                        break
                if left:
                    raise dump.SourceError(f"{path} is not what was indexed")
                yield _batch([(*row, source.read if i == 0 else 0) for i, row in enumerate(found)], kinds)

    rows = places.repartition("path", "block").mapInArrow(run, kinds)
    rows = rows.withColumn("scan_pos", F.struct("path", "block", "offset"))
    return dump.parsed(rows, "bytes_read")
