"""Packing documents into sequences of a fixed length by best-two-fit.

Lengths are whole numbers up to the capacity, so how many pieces there are of each length says all that
packing has to know: the driver works on at most `capacity` counts, whatever the corpus, and gets patterns
of a bin, each with the number of bins that it fills. Pieces are numbered within their length, in buckets,
and look up their place by that number.
"""

from __future__ import annotations

import json
import re
import zlib
from array import array
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import store

CAPACITY = 1024
END = 2  # follows the ids of every document
# How byte-level BPE splits text before merging, and the bytes that it writes as themselves.
SPLIT = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
PLAIN_BYTES = (*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100))

#: Characters whose classes no version of Unicode since 5 has changed; text of others is left to the slower library.
_RARE = re.compile("[^\t\n\r\x20-\u024f\u0391-\u03a1\u03a3-\u03ce\u0400-\u0481\u2010-\u2027\u2030-\u205e\u20ac\u4e00-\u9fa5]")


@lru_cache(maxsize=2)
def _encoder(path: str) -> Callable[[str], bytes]:
    """From a text to its ids as little-endian unsigned 32 bits: those that `tokenizers` gives with the file at path.

    Where the file's merges stand in the order of their ids and its text is split by SPLIT alone, merging by
    rank is the same and tiktoken, several times faster, does it. Texts with special tokens or rare characters,
    and other files, go to `tokenizers` itself.
    """
    from tokenizers import Tokenizer

    own = Tokenizer.from_file(path)
    special = [t.content for t in own.get_added_tokens_decoder().values()]

    def exact(text: str) -> bytes:
        return np.array(own.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    parts = json.loads(own.to_str())
    model, before = parts["model"], parts["pre_tokenizer"] or {}
    others = iter(range(0x100, 0x200))
    of = {chr(b if b in PLAIN_BYTES else next(others)): b for b in range(256)}
    merged = ["".join(m.split(" ") if isinstance(m, str) else m) for m in model.get("merges", ())]
    vocabulary = model.get("vocab", {})
    by_rank = (
        model.get("type") == "BPE" and parts["normalizer"] is None and before.get("type") == "ByteLevel" and before.get("use_regex") and not before.get("add_prefix_space")
        and not any(model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges"))
        and set(of) <= set(vocabulary) and [vocabulary.get(m) for m in merged] == list(range(256, 256 + len(merged))) and sorted(vocabulary[c] for c in of) == list(range(256))
    )
    if not by_rank:
        return exact

    import tiktoken

    ranks = {bytes(map(of.__getitem__, t)): i for t, i in vocabulary.items() if t not in special}
    fast = tiktoken.Encoding("ranks", pat_str=SPLIT, mergeable_ranks=ranks, special_tokens={})

    def encode(text: str) -> bytes:
        if _RARE.search(text) or any(s in text for s in special):
            return exact(text)
        return np.asarray(array("I", fast.encode_ordinary(text))).astype("<u4", copy=False).tobytes()

    return encode


def token_bytes(text: str, path: str) -> bytes:
    """The ids of a whole text, four bytes each."""
    return _encoder(path)(text)


def pieces(documents: DataFrame, tokenizer: str, id_column: str = "doc_id", text_column: str = "text", capacity: int = CAPACITY) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32) of every document, its ids followed by END.

    Only documents longer than capacity are cut: the first piece takes what doesn't fill a whole one. tokenizer
    is a path that executors have, too. Null text counts as empty; a null id stays null.
    """
    end = np.array([END], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: tuple[list, ...] = ([], [], [], [], [])
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                ids = token_bytes(text.as_py(), tokenizer) + end
                low, n = 0, len(ids) // 4
                for k, high in enumerate(range((n - 1) % capacity + 1, n + 1, capacity)):
                    for column, value in zip(out, (doc, k, low, high - low, zlib.crc32(ids[4 * low : 4 * high])), strict=True):
                        column.append(value)
                    low = high
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()), strict=True)], names=["doc_id", "piece", "start", "length", "ids_crc32"])

    rows = documents.select(F.col(id_column).cast("long"), F.coalesce(F.col(text_column).cast("string"), F.lit("")))
    return rows.mapInArrow(run, "doc_id long, piece int, start long, length long, ids_crc32 long")


def _pair(free: np.ndarray, room: int, more_than: int) -> tuple[int, int] | None:
    """Two lengths that are free and together fill most of the room, more than the given length; the longer first."""
    have = np.flatnonzero(free[: room + 1])
    if not len(have):
        return None
    at = np.searchsorted(have, np.minimum(room - have, have), "right") - 1
    twice = (at >= 0) & (have[at] == have) & (free[have] < 2)
    at = np.where(twice, at - 1, at)
    total = np.where(at >= 0, have + have[at], 0)
    best = len(total) - 1 - int(np.argmax(total[::-1]))
    return (int(have[best]), int(have[at[best]])) if total[best] > more_than else None


def best_two_fit(counts: np.ndarray, capacity: int) -> list[tuple[int, list[tuple[int, int]]]]:
    """(bins, [(length, uses), ...] from the longest) for counts[length] pieces, bin by bin.

    A bin takes the longest piece that still fits, again and again. Then the shortest of its several pieces
    gives way to the two free ones that fill the room best, as long as they fill more than it did. A bin
    that comes out the same way is filled at once as often as the counts give.
    """
    free, out = counts.astype(np.int64), []
    longest = capacity
    while True:
        while longest and not free[longest]:
            longest -= 1
        if not longest:
            return out
        bin_: dict[int, int] = {}
        need: dict[int, int] = {}
        left, room, at = free.copy(), capacity, longest
        while room:
            fits = np.flatnonzero(left[1 : min(room, at) + 1])
            if not len(fits):
                break
            at = int(fits[-1]) + 1
            n = min(room // at, int(left[at]))
            bin_[at] = bin_.get(at, 0) + n
            left[at] -= n
            room -= n * at
            at -= 1
        need |= bin_
        while sum(bin_.values()) > 1:
            shortest = min(bin_)
            pair = _pair(left, room + shortest, shortest)
            if not room or pair is None:
                break
            bin_[shortest] -= 1
            left[shortest] += 1
            if not bin_[shortest]:
                del bin_[shortest]
            for length in pair:
                bin_[length] = bin_.get(length, 0) + 1
                left[length] -= 1
            room += shortest - sum(pair)
            for length, n in bin_.items():
                need[length] = max(need.get(length, 0), n)
        bins = min((int(free[x]) - need[x]) // n + 1 for x, n in bin_.items())
        for length in need.keys() - bin_.keys():  # what went out again has to be there each time
            bins = bins if free[length] >= need[length] else 1
        for length, n in bin_.items():
            free[length] -= bins * n
        out.append((bins, sorted(bin_.items(), reverse=True)))


def places(plan: list[tuple[int, list[tuple[int, int]]]]) -> np.ndarray:
    """Rows (length, low, uses, sequence, offset), sorted: the pieces of a length from number `low` on fill `uses`
    places of a bin, from `offset` on, bin after bin from `sequence` on."""
    rows, used, sequence = [], {}, 0
    for bins, pattern in plan:
        offset = 0
        for length, uses in pattern:
            low = used.get(length, 0)
            rows.append((length, low, uses, sequence, offset))
            used[length] = low + bins * uses
            offset += length * uses
        sequence += bins
    return np.array(sorted(rows), np.int64).reshape(-1, 5)


def pack(found: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """found, as from pieces(), with sequence_id and offset: its place in a sequence of at most capacity.

    Places of a sequence follow each other without a gap. Which of several pieces of one length gets which
    place follows from their columns; rows that are equal in all of them are interchangeable.
    """
    spark = found.sparkSession
    buckets = store.parallelism(spark)
    found = store.table(found.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "piece", "start", "ids_crc32"), F.lit(buckets)).cast("int")), "pieces")
    sizes = store.table(found.groupBy("length", "bucket").agg(F.count("*").alias("n")), "lengths")
    counts = np.zeros(capacity + 1, np.int64)
    for length, n in sizes.groupBy("length").agg(F.sum("n")).collect():  # at most `capacity` rows
        counts[length] = n
    table = places(best_two_fit(counts, capacity))
    first = np.searchsorted(table[:, 0], np.arange(capacity + 2))  # rows of a length begin there

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length, number = (batch.column(i).to_numpy(zero_copy_only=False) for i in (3, 5))
            row = np.empty(len(length), np.int64)
            for x in np.unique(length).tolist():
                own = length == x
                row[own] = first[x] + np.searchsorted(table[first[x] : first[x + 1], 1], number[own], "right") - 1
            _, low, uses, sequence, offset = table[row].T
            turn = number - low
            yield pa.RecordBatch.from_arrays([*batch.columns[:5], pa.array(sequence + turn // uses), pa.array(offset + turn % uses * length)], names=[*names, "sequence_id", "offset"])

    names = ["doc_id", "piece", "start", "length", "ids_crc32"]
    ahead = F.coalesce(F.sum("n").over(Window.partitionBy("length").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    inside = F.row_number().over(Window.partitionBy("length", "bucket").orderBy("doc_id", "piece", "start", "ids_crc32"))
    numbered = found.withColumn("inside", inside - 1).join(sizes.select("length", "bucket", ahead.alias("ahead")).hint("merge"), ["length", "bucket"])
    return numbered.select(*names, (F.col("ahead") + F.col("inside")).alias("number")).mapInArrow(run, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")


def packed(documents: DataFrame, tokenizer: str, id_column: str = "doc_id", text_column: str = "text", capacity: int = CAPACITY) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, sequence_id, offset) of every piece of every document."""
    return pack(pieces(documents, tokenizer, id_column, text_column, capacity), capacity)
