"""Compaction of small Parquet files, executed: footers are read in parallel, files are packed by first fit, groups are written.

The number of files does not follow the number of rows: a table's rows are dealt to days, lots and pieces by
shares of the whole, so the manifest that the driver packs has some four files for each day and each 150th part of the
table, however large it is. Rows never pass the driver. Each group is one task that streams its sources into one file.

A commit has two steps that can be taken again: the moves are written to a file of their own in the folder, then done; what a
driver leaves undone, recover() does. Tasks write under names of their own attempt, so a lost executor leaves
nothing that is taken for a result.
"""

from __future__ import annotations

import hashlib
import json
import re
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
import pyarrow.parquet as pq
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import store
from .warc import filesystem

LOT, SMALL, FULL = 150, 600, 400  # shares of the table: a lot, the largest file to be compacted, the largest group
ROWS_AT_ONCE, BYTES_AT_ONCE = 1 << 20, 64 << 20  # a row group of a merged file
HIDDEN = "_merging"
LOG = "_moves.json"
_NAME = re.compile(r"(-?\d+|null)-(\d+)-(\d+)(-merged)?\.parquet")


@dataclass(frozen=True)
class File:
    """A data file of a folder: its day (null: none), lot and piece, rows and name."""

    day: int | None
    lot: int
    piece: int
    rows: int
    name: str


def share(rows: int, x: int) -> int:
    return 1 + rows // x


def name_of(day: int | None, lot: int, piece: int) -> str:
    return f"{'null' if day is None else day}-{lot}-{piece}.parquet"


def _free(name: str, columns: list[str]) -> str:
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name += "_"
    return name


def write_pieces(rows: DataFrame, folder: str, arrived: str = "arrived_at", key: str = "click_id") -> int:
    """Write rows as files of one (day, lot, piece) each, sorted by arrival, then key; the number of rows.

    Rows without an arrival time have a day of their own, those without a key count as the key of no digits. Folder
    has to be new. Spark writes each file in one task and commits it; the names come after, by renames.
    """
    spark = rows.sparkSession
    total = rows.count()
    day, lot, piece, size, same = (_free(n, rows.columns) for n in ("quillon_day", "quillon_lot", "quillon_piece", "quillon_rows", "quillon_same_day"))
    found = rows.withColumn(day, F.unix_date(F.to_date(arrived)))
    days = found.groupBy(day).agg(F.count("*").alias(size)).withColumnRenamed(day, same)
    hashed: Column = F.crc32(F.coalesce(F.col(key).cast("string"), F.lit("")))
    found = found.join(days, F.col(day).eqNullSafe(F.col(same)), "left")
    found = found.withColumns({lot: F.floor(hashed / 16) % (1 + F.floor(F.col(size) / share(total, LOT))), piece: F.least(hashed % 4, F.floor(hashed / 4) % 4).cast("int")})
    found = found.select(*[F.col(f"`{c}`") for c in rows.columns], day, lot, piece)
    begun = f"{folder}/_begun"
    found.repartition(day, lot, piece).sortWithinPartitions(day, lot, piece, arrived, key).write.partitionBy(day, lot, piece).option("maxRecordsPerFile", 0).parquet(begun)
    fs, root = filesystem(folder)
    for info in fs.get_file_info(pafs.FileSelector(f"{root}/_begun", recursive=True)):  # a name for each file of the manifest
        if info.is_file and info.extension == "parquet":
            d, l, p = (re.search(f"/{c}=([^/]*)/", info.path)[1] for c in (day, lot, piece))
            fs.move(info.path, f"{root}/{name_of(None if d == '__HIVE_DEFAULT_PARTITION__' else int(d), int(l), int(p))}")
    fs.delete_dir(f"{root}/_begun")
    return total


def _in_tasks(spark: SparkSession, items: list, work, schema: str, tasks: int | None = None) -> DataFrame:
    """work(item) -> rows as tuples of Arrow columns, over items dealt to tasks; one task each where tasks is None."""
    kinds = [(f.name, pa.type_for_alias({"bigint": "int64", "boolean": "bool"}.get(f.dataType.simpleString(), f.dataType.simpleString()))) for f in spark.createDataFrame([], schema).schema]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in batch.column(0).to_pylist():
                yield pa.RecordBatch.from_arrays([pa.array([x], k) for x, (_, k) in zip(work(items[i]), kinds, strict=True)], names=[n for n, _ in kinds])

    n = len(items)
    return spark.range(0, n, 1, max(1, min(n, tasks or n))).mapInArrow(run, schema)


def manifest(spark: SparkSession, folder: str) -> list[File]:
    """The data files of a folder with the rows that their footers state, read in parallel."""
    fs, root = filesystem(folder)
    names = sorted(i.base_name for i in fs.get_file_info(pafs.FileSelector(root)) if i.is_file and _NAME.fullmatch(i.base_name))

    def footer(name: str) -> tuple[str, int]:
        own, place = filesystem(folder)
        with own.open_input_file(f"{place}/{name}") as source:
            return name, pq.ParquetFile(source).metadata.num_rows

    out = []
    for name, n in _in_tasks(spark, names, footer, "name string, n bigint", store.parallelism(spark)).collect():  # bounded by days and shares
        d, lot, piece, _ = _NAME.fullmatch(name).groups()
        out.append(File(None if d == "null" else int(d), int(lot), int(piece), n, name))
    return out


def first_fit(files: list[File], small: int, full: int) -> list[list[File]]:
    """Groups of files, each in joining order, of a day.

    Files under `small` rows, those of most rows first, join the group opened first that then has `full` rows at
    most, else open one; other files stand alone.
    """
    groups: list[list[File]] = []
    filled: dict[int | None, list[list]] = {}
    for f in sorted(files, key=lambda f: (-f.rows, f.lot, f.piece)):
        if f.rows >= small:
            groups.append([f])
            continue
        own = filled.setdefault(f.day, [])
        for bin_ in own:
            if bin_[0] + f.rows <= full:
                bin_[0] += f.rows
                bin_[1].append(f)
                break
        else:
            own.append([f.rows, [f]])
            groups.append(own[-1][1])
    return groups


def concatenate(folder: str, sources: list[str], name: str) -> tuple[str, int]:
    """(name, rows) of a new file under HIDDEN with the rows of the sources one after another, streamed."""
    fs, root = filesystem(folder)
    own = f"{HIDDEN}/{uuid.uuid4().hex}-{name}"
    fs.create_dir(f"{root}/{HIDDEN}", recursive=True)
    n, held, size, writer = 0, [], 0, None
    with fs.open_output_stream(f"{root}/{own}") as out:
        try:
            for source in sources:
                with fs.open_input_file(f"{root}/{source}") as file:
                    found = pq.ParquetFile(file)
                    writer = writer or pq.ParquetWriter(out, found.schema_arrow, compression="snappy")
                    for batch in found.iter_batches(1 << 14):
                        held.append(batch)
                        n, size = n + batch.num_rows, size + batch.nbytes
                        if size >= BYTES_AT_ONCE or sum(b.num_rows for b in held) >= ROWS_AT_ONCE:
                            writer.write_table(pa.Table.from_batches(held, writer.schema))
                            held, size = [], 0
            if held:
                writer.write_table(pa.Table.from_batches(held, writer.schema))
        finally:
            if writer:
                writer.close()
    return own, n


def recover(folder: str) -> bool:
    """Do the moves that a commit has announced and not finished; whether there were any."""
    fs, root = filesystem(folder)
    if fs.get_file_info(f"{root}/{LOG}").type == pafs.FileType.NotFound:
        return False
    with fs.open_input_stream(f"{root}/{LOG}") as source:
        moves = json.loads(source.read())
    there = lambda name: fs.get_file_info(f"{root}/{name}").type != pafs.FileType.NotFound
    for own, name, sources in moves:
        if there(own):
            fs.move(f"{root}/{own}", f"{root}/{name}")
        for source in sources:
            if there(source):
                fs.delete_file(f"{root}/{source}")
    _clear(folder)
    return True


def _clear(folder: str) -> None:
    """Drop what isn't data: files of attempts that lost, then the announcement."""
    fs, root = filesystem(folder)
    if fs.get_file_info(f"{root}/{HIDDEN}").type != pafs.FileType.NotFound:
        fs.delete_dir(f"{root}/{HIDDEN}")
    if fs.get_file_info(f"{root}/{LOG}").type != pafs.FileType.NotFound:
        fs.delete_file(f"{root}/{LOG}")


def _announce(folder: str, moves: list[tuple[str, str, list[str]]]) -> None:
    fs, root = filesystem(folder)
    with fs.open_output_stream(f"{root}/{LOG}.part") as out:
        out.write(json.dumps(moves).encode())
    fs.move(f"{root}/{LOG}.part", f"{root}/{LOG}")


def compact(spark: SparkSession, folder: str, small: int, full: int) -> list[tuple[str, list[File], bool]]:
    """Compact a folder of write_pieces; (name, sources in joining order, whether it is new) of every file that it has then.

    Groups of several files are replaced by one file of theirs, the others are not touched. Raises when a
    merged file has not as many rows as its sources; the folder is then as it was.
    """
    recover(folder)
    files = manifest(spark, folder)
    if any(f.name.endswith("-merged.parquet") for f in files):
        raise ValueError(f"{folder} is compacted already")
    groups = first_fit(files, small, full)
    several = [g for g in groups if len(g) > 1]
    target = lambda g: g[0].name.replace(".parquet", "-merged.parquet")
    plan = [(target(g), [f.name for f in g]) for g in several]
    written = _in_tasks(spark, plan, lambda p: (p[0], *concatenate(folder, p[1], p[0])), "name string, own string, n bigint").collect()
    own = {name: (path, n) for name, path, n in written}
    for g in several:
        if own[target(g)][1] != sum(f.rows for f in g):
            raise ValueError(f"{target(g)} has {own[target(g)][1]} rows")
    _announce(folder, [(own[name][0], name, sources) for name, sources in plan])
    recover(folder)
    return [(target(g) if len(g) > 1 else g[0].name, g, len(g) > 1) for g in groups]


_REPORT = """day bigint, lot bigint, piece bigint, n_rows bigint, min_click_id bigint, max_click_id bigint, cents bigint, sources string,
ids_sha256 string, columns string, path string, rewritten boolean"""


def report(spark: SparkSession, folder: str, files: list[tuple[str, list[File], bool]], key: str = "click_id", value: str = "value") -> DataFrame:
    """A row for each file, read back: (day, lot, piece, n_rows, min_click_id, max_click_id, cents, sources, ids_sha256, columns, path, rewritten).

    Null keys stand as empty texts between the commas; a value that is no finite number counts 0 cents, as null does.
    """

    def read(item: tuple[str, list[File], bool]) -> tuple:
        name, sources, new = item
        fs, root = filesystem(folder)
        n, cents, total, least, most = 0, 0, hashlib.sha256(), None, None
        with fs.open_input_file(f"{root}/{name}") as file:
            found = pq.ParquetFile(file)
            for batch in found.iter_batches(1 << 16, columns=[key, value]):
                ids = batch.column(batch.schema.get_field_index(key)).to_pylist()
                if not ids:
                    continue
                total.update(("," if n else "").encode() + ",".join("" if i is None else str(i) for i in ids).encode())
                n += len(ids)
                known = [i for i in ids if i is not None]
                least = min([*known, *([] if least is None else [least])], default=None)
                most = max([*known, *([] if most is None else [most])], default=None)
                amounts = batch.column(batch.schema.get_field_index(value)).cast(pa.float64()).fill_null(0).to_numpy(zero_copy_only=False)
                cents += sum(map(int, np.floor(100 * np.where(np.isfinite(amounts), amounts, 0) + 0.5)))
            columns = ",".join(found.schema_arrow.names)
        joined = ",".join(f"{s.lot}-{s.piece}" for s in sources)
        return (sources[0].day, sources[0].lot, sources[0].piece, n, least, most, cents, joined, total.hexdigest(), columns, f"{folder}/{name}", new)

    return _in_tasks(spark, files, read, _REPORT, 4 * store.parallelism(spark))


def compacted(rows: DataFrame, folder: str, key: str = "click_id", arrived: str = "arrived_at", value: str = "value") -> DataFrame:
    """Write rows as small files into a new folder, compact them there, and report the final files.

    An empty table gives a folder without data files and no rows.
    """
    spark = rows.sparkSession
    total = write_pieces(rows, folder, arrived, key)
    return report(spark, folder, compact(spark, folder, share(total, SMALL), share(total, FULL)), key, value)
