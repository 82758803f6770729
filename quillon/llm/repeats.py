"""Passages of a fixed length that start at two places of a corpus: routing for the shard indexes.

Every window of `short` units (bytes or words) is sampled by its own content: the least k-gram among
its first and among its last `span` k-grams, and the text between the two, its core. Equal windows
have equal cores. Cores are counted over all texts (shared_codes), which leaves the few windows whose
core occurs again. Such windows go to the shard of their least k-gram, as pieces: runs of consecutive
windows with the same least k-gram. Each shard builds an index over its distinct pieces and streams
them through it. A piece that is there several times is indexed once and keeps its count.

Repeated windows of `short` units are reported, those of `length` units are removed. Equal long windows
begin with equal short ones, so they meet in one shard too: a piece goes on for as many units as the
long window of its last start needs. Neighbouring pieces of a text overlap by less than a long window, so none
is taken for a repeat of itself. Short windows of a shard are told apart by their 64-bit hashes at the starts that a
piece has for itself; long ones by the index, over the pieces in which hashes leave a repeat possible.

No shard grows with a popular passage: pieces of one k-gram beyond a bound are dealt to parts, and each
pair of parts forms a shard of its own.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import blocks, shared_codes, store

SHARD_BYTES = 1 << 20
_HIGH = np.uint64(0xFFFFFFFF00000000)
_LOW = np.uint64(0xFFFFFFFF)


@dataclass(frozen=True)
class Sampling:
    """length: units of a window that goes; short: of one that is reported, at most as many; gram: units of a
    sampled k-gram; span: k-grams at either end of a short window."""

    length: int
    short: int
    gram: int
    span: int


@dataclass
class Units:
    """A slice as units: their codes, the first unit of each row, and the bytes of a run of units."""

    codes: np.ndarray
    of: np.ndarray


@dataclass
class Kind:
    """What differs between bytes and words."""

    sampling: Sampling
    units: Callable[[blocks.Slice], Units]
    body: Callable[[blocks.Slice, Units, int, int], bytes]  # of units low to high
    matches: Callable[[list[bytes], int], list[np.ndarray]]  # a shard's index: repeated starts of each piece
    near: Callable[[list[bytes], list[int], int], list[np.ndarray]] | None = None  # the same by hashes, at so many first starts, for windows of a size


def _least_at(grams: np.ndarray, size: int) -> np.ndarray:
    """Position of the least of each size consecutive k-grams, the first of equals."""
    return (blocks.sliding_least((grams & _HIGH) | np.arange(len(grams), dtype=np.uint64), size) & _LOW).astype(np.int64)


def cells(units: Units, s: Sampling) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Runs of short windows with one core: first window, end, and the core's hash."""
    none = np.zeros(0, np.int64)
    window = np.flatnonzero(blocks.whole(units.of, len(units.codes), s.short))
    if not len(window):
        return none, none, np.zeros(0, np.uint64)
    least = _least_at(blocks.window_hashes(units.codes, s.gram), s.span)
    left, right = least[window], least[window + (s.short - s.gram + 1 - s.span)]
    new = np.ones(len(window), bool)
    new[1:] = (np.diff(left) != 0) | (np.diff(right) != 0) | (np.diff(window) != 1)
    first = np.flatnonzero(new)
    ends = np.r_[window[first[1:] - 1] + 1, window[-1] + 1]
    return window[first], ends, blocks.range_hashes(units.codes, left[first], right[first] + s.gram)


def content_keys(units: Units) -> np.ndarray:
    return blocks.range_hashes(units.codes, units.of[:-1], units.of[1:]) if len(units.codes) else np.full(len(units.of) - 1, 0, np.uint64)


def featuriser(kind: Kind):
    def make(part: blocks.Slice) -> shared_codes.Coded:
        units = kind.units(part)
        start, _, core = cells(units, kind.sampling)
        row = np.searchsorted(units.of, start, side="right") - 1
        core = core & ~np.uint64(1)
        order = np.lexsort((core, row))
        row, core = row[order], core[order]
        again = np.zeros(len(core), bool)
        again[1:] = (core[1:] == core[:-1]) & (row[1:] == row[:-1])
        kept = np.flatnonzero(~again)
        twice = np.zeros(len(core), bool)
        twice[:-1] = again[1:]
        core = core | twice.astype(np.uint64)
        row, core = row[kept], core[kept]
        cuts = np.searchsorted(row, np.arange(1, len(part)))
        return shared_codes.Coded(content_keys(units), np.diff(units.of), np.split(core, cuts))

    return make


def _pieces(kind: Kind, bits: int):
    """From rows (key, codes, text): pieces of windows whose core is shared."""
    s = kind.sampling

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sent: set[int] = set()
        done: set[int] = set()
        for batch in batches:
            keys = batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64)
            shared = batch.column(1)
            for part in blocks.slices(batch.column(2)):
                rows = []
                units = kind.units(part)
                start, end, core = cells(units, s)
                core = shared_codes.visible(core, bits)
                owner = np.searchsorted(start, units.of)
                own_keys = content_keys(units).view(np.int64)
                flagged = np.zeros(len(start), bool)
                for i in range(len(part)):
                    key = int(keys[part.first + i])
                    if key != own_keys[i] or key in done:
                        continue
                    done.add(key)
                    a, b = owner[i], owner[i + 1]
                    flagged[a:b] = np.isin(core[a:b], np.frombuffer(shared[part.first + i].as_py(), np.uint64))
                if not flagged.any():
                    continue
                marks = np.zeros(len(units.codes) + 1, np.int32)
                np.add.at(marks, start[flagged], 1)
                np.add.at(marks, end[flagged], -1)
                window = np.flatnonzero(np.cumsum(marks[:-1]) > 0)
                grams = blocks.window_hashes(units.codes, s.gram)
                route_at = _least_at(grams, s.short - s.gram + 1)[window]
                new = np.ones(len(window), bool)
                new[1:] = (np.diff(route_at) != 0) | (np.diff(window) != 1)
                first = np.flatnonzero(new)
                low, count = window[first], np.diff(np.r_[first, len(window)])
                row = np.searchsorted(units.of, low, side="right") - 1
                high = np.minimum(low + count - 1 + s.length, units.of[row + 1])
                route = grams[route_at[first]].view(np.int64)
                same = blocks.mix(blocks.range_hashes(units.codes, low, high) + count.astype(np.uint64)).view(np.int64)
                long = np.maximum(high - low - s.length + 1, 0)  # long windows
                for j in range(len(first)):
                    body = None
                    if (piece := int(same[j])) not in sent:
                        if len(sent) > 500_000:
                            sent.clear()
                        sent.add(piece)
                        body = kind.body(part, units, int(low[j]), int(high[j]))
                    rows.append((int(route[j]), piece, int(keys[part.first + row[j]]), int(low[j] - units.of[row[j]]), int(count[j]), int(long[j]), body))
                cols = list(zip(*rows, strict=True))
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, [*[pa.int64()] * 6, pa.binary()], strict=True)], names=["route", "piece", "key", "low", "n", "long", "body"])

    return run


def _shard(kind: Kind):
    s = kind.sampling

    def packed(found: np.ndarray) -> bytes | None:
        return np.packbits(found).tobytes() if found.any() else None

    def run(group: pa.Table) -> pa.Table:
        piece = group.column("piece").to_numpy()
        _, first = np.unique(piece, return_index=True)
        body, n = group.column("body").take(pa.array(first)).to_pylist(), group.column("n").to_numpy()[first].tolist()
        if s.short == s.length:
            shorts = longs = [packed(f) for f in kind.matches(body, s.length)]
        else:
            shorts = [packed(f) for f in kind.near(body, n, s.short)]
            # A piece none of whose long windows has another's hash has nothing that the index could find.
            some = [i for i, f in enumerate(kind.near(body, [max(0, len(b) - s.length + 1) for b in body], s.length)) if f.any()]
            found = kind.matches([body[i] for i in some], s.length) if some else []
            longs = [None] * len(body)
            for i, f in zip(some, found, strict=True):
                longs[i] = packed(f)
        some = [i for i, m in enumerate(shorts) if m]
        return pa.Table.from_arrays([pa.array(piece[first[some]], pa.int64()), pa.array([shorts[i] for i in some], pa.binary()), pa.array([longs[i] for i in some], pa.binary())], names=["piece", "shorts", "longs"])

    return run


def runs_of(parts: list[dict], size: str, marks: str, length: int) -> np.ndarray:
    """(start, end) of the maximal runs of units that repeated windows of one text cover; end exclusive."""
    starts = []
    for p in parts:
        if p["n_texts"] > 1:
            starts.append(p["low"] + np.arange(p[size]))
        elif p[marks]:
            bits = np.zeros(p[size], bool)
            for m in p[marks]:  # one of each shard that the piece was in
                bits |= np.unpackbits(np.frombuffer(m, np.uint8), count=p[size]).astype(bool)
            starts.append(p["low"] + np.flatnonzero(bits))
    if not starts or not sum(map(len, starts)):
        return np.zeros((0, 2), np.int64)
    at = np.unique(np.concatenate(starts))
    cut = np.flatnonzero(np.diff(at) > length)
    return np.stack([at[np.r_[0, cut + 1]], at[np.r_[cut, len(at) - 1]] + length], axis=1)


def removals(documents: DataFrame, kind: Kind, name: str, kept: Callable[[str, np.ndarray], bytes]) -> tuple[DataFrame, DataFrame]:
    """(members, cuts) of documents(id, text).

    members: doc_id, key, size in units, copied (another document has the text). cuts: key, n_removed,
    n_spans, n_shared, kept_sha256 of the texts of which a part is repeated. A copied text of a window or more is repeated as
    a whole, whatever cuts says of it.
    """
    s = kind.sampling
    spark = documents.sparkSession
    counted, bits = shared_codes.count(documents, featuriser(kind), name)
    members = shared_codes.members(counted)
    copies = members.groupBy("key").agg(F.min("doc_id").alias("rep"), F.count("*").alias("copies"))

    def lists(group: pa.Table) -> pa.Table:
        got = shared_codes.gather(group)
        some = [i for i in range(len(got.keys)) if got.of[i + 1] > got.of[i]]
        return pa.Table.from_arrays([pa.array(got.keys.view(np.int64)[some]), pa.array([got.codes[got.of[i] : got.of[i + 1]].tobytes() for i in some], pa.binary())], names=["key", "codes"])

    shared = counted.groupBy("target").applyInArrow(lists, "key long, codes binary").join(copies, "key").select("key", "codes", F.col("rep").alias("id"))
    texts = documents.where(F.octet_length("text") >= s.short).join(shared.hint("shuffle_hash"), "id").select("key", "codes", "text")
    texts = store.table(texts, f"{name}-texts")
    pieces = texts.mapInArrow(_pieces(kind, bits), "route long, piece long, key long, low long, n long, long long, body binary")
    pieces = store.table(pieces, f"{name}-pieces")

    bodies = pieces.where("body is not null").select("route", "piece", "n", "body")
    # Written, so that the join below has two fresh exchanges and a popular route can be split.
    parts = store.table(bodies.groupBy("route").agg(F.sum(F.length("body")).alias("bytes")), f"{name}-routes")
    total = parts.agg(F.sum("bytes")).first()[0] or 0
    shards = int(total // SHARD_BYTES) + 1
    parts = parts.where(F.col("bytes") > SHARD_BYTES).select("route", F.ceil(2 * F.col("bytes") / SHARD_BYTES).cast("int").alias("parts"))
    dealt = bodies.join(parts, "route", "left").withColumn("parts", F.coalesce("parts", F.lit(1))).withColumn("part", F.pmod("piece", F.col("parts")).cast("int"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    hot = F.col("parts") > 1
    shard = F.when(hot, F.xxhash64("route", F.least("part", "other"), F.greatest("part", "other"))).otherwise(F.pmod(F.xxhash64("route"), F.lit(shards)))
    marks = dealt.select(shard.alias("shard"), "piece", "n", "body").groupBy("shard").applyInArrow(_shard(kind), "piece long, shorts binary, longs binary")
    marks = marks.groupBy("piece").agg(F.collect_set("shorts").alias("shorts"), F.collect_set("longs").alias("longs"))

    counts = pieces.groupBy("piece").agg(F.count("*").alias("n_texts"))
    verdicts = store.table(counts.join(marks, "piece", "left").where("n_texts > 1 or shorts is not null"), f"{name}-verdicts")
    placed = pieces.select("piece", "key", "low", "n", "long").join(verdicts, "piece")  # of two fresh exchanges, so a popular piece can be split
    placed = placed.groupBy("key").agg(F.collect_list(F.struct("low", "n", "long", "n_texts", "shorts", "longs")).alias("parts"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for key, parts_, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                runs = runs_of(parts_, "long", "longs", s.length)
                near = runs_of(parts_, "n", "shorts", s.short)
                rows.append((key, int((runs[:, 1] - runs[:, 0]).sum()), len(runs), int((near[:, 1] - near[:, 0]).sum()), hashlib.sha256(kept(text, runs)).hexdigest()))
            cols = list(zip(*rows, strict=True)) or [()] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, [*[pa.int64()] * 4, pa.string()], strict=True)], names=["key", "n_removed", "n_spans", "n_shared", "kept_sha256"])

    cuts = texts.select("key", "text").join(placed.hint("shuffle_hash"), "key").select("key", "parts", "text")
    cuts = cuts.mapInArrow(cut, "key long, n_removed long, n_spans long, n_shared long, kept_sha256 string").dropDuplicates(["key"])
    members = members.join(copies.where("copies > 1").select("key", F.lit(True).alias("copied")), "key", "left")
    return members.withColumn("copied", F.coalesce("copied", F.lit(False))), cuts
