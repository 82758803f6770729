"""Which 64-bit codes of a document occur in other documents too, and in how many.

Codes (hashes of shingles or of sampled passages) are counted over all documents in one exchange.
Rows of single codes would cost an exchange several times the input, so a task packs the codes of many
documents by the leading bits of the code; the receiving task sorts its range of codes, keeps those
seen in two different texts or twice in one, and sends them back, packed by the leading bits of the
document's key. Equal texts have one key and count once, so no group of copies can swell a range.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import blocks, store

CHUNK_CODES = 1 << 20  # that a task packs at once, or CODES_A_ROW for each range where that is more
CODES_A_ROW = 16
RANGE_BYTES = 16 << 20  # of documents, for each range of codes
MOST_BITS = 20
_PACKED = "slot int, kind int, ids binary, keys binary, sizes binary, codes binary"
_OUT = "target int, kind int, ids binary, keys binary, sizes binary, codes binary"


@dataclass
class Coded:
    """What a featuriser returns for the rows of a slice. codes: sorted, distinct, bit 0 set where the
    code occurs twice in the row itself."""

    keys: np.ndarray  # uint64: equal for equal contents
    sizes: np.ndarray  # int64
    codes: list[np.ndarray]  # uint64


def _bits(n: int) -> int:
    return n.bit_length() - 1


def _shift(values: np.ndarray, bits: int) -> np.ndarray:
    return (values >> np.uint64(64 - bits)).astype(np.int64) if bits else np.zeros(len(values), np.int64)


def _pack(ids: list, keys: list, sizes: list, codes: list, bits: int) -> Iterator[pa.RecordBatch]:
    doc_ids, doc_keys, doc_sizes = np.concatenate(ids), np.concatenate(keys), np.concatenate(sizes)
    rows: list[tuple] = []
    target = _shift(doc_keys, bits)
    order = np.argsort(target, kind="stable")
    cuts = np.flatnonzero(np.diff(target[order])) + 1
    for part in np.split(order, cuts) if len(order) else []:
        rows.append((-1 - int(target[part[0]]), 0, doc_ids[part].tobytes(), doc_keys[part].tobytes(), doc_sizes[part].tobytes(), b""))
    _, first = np.unique(doc_keys, return_index=True)  # a text counts once in a chunk
    kept = np.sort(first)
    lengths = np.array([len(codes[i]) for i in kept], np.int64)
    if lengths.sum():
        flat = np.concatenate([codes[i] for i in kept])
        owner = np.repeat(np.arange(len(kept)), lengths)
        slot = _shift(flat, bits)
        order = np.argsort(slot.astype(np.uint16 if bits <= 16 else np.uint32), kind="stable")
        slot, owner, flat = slot[order], owner[order], flat[order]
        starts = np.r_[0, np.flatnonzero(np.diff(slot)) + 1, len(slot)]
        for a, b in zip(starts[:-1].tolist(), starts[1:].tolist(), strict=True):
            own, count = np.unique(owner[a:b], return_counts=True)
            rest = (flat[a:b] & ~np.uint64(1)) << np.uint64(bits)  # the flag travels apart
            body = (rest >> np.uint64(32)).astype(np.uint32).tobytes() + (((rest >> np.uint64(16)) & np.uint64(0xFFFE)) | (flat[a:b] & np.uint64(1))).astype(np.uint16).tobytes()
            rows.append((int(slot[a]), 1, b"", doc_keys[kept[own]].tobytes(), count.astype(np.uint32).tobytes(), body))
    for at in range(0, len(rows), 256):
        cols = list(zip(*rows[at : at + 256], strict=True))
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, [pa.int32(), pa.int32(), *[pa.binary()] * 4], strict=True)], names=["slot", "kind", "ids", "keys", "sizes", "codes"])


def _packer(make: Callable[[blocks.Slice], Coded], bits: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: tuple[list, list, list, list] = ([], [], [], [])
        total = 0
        for batch in batches:
            ids = batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64)
            for part in blocks.slices(batch.column(1)):
                got = make(part)
                held[0].append(ids[part.first : part.first + len(part)])
                held[1].append(got.keys)
                held[2].append(got.sizes)
                held[3].extend(got.codes)
                total += sum(map(len, got.codes))
                if total >= max(CHUNK_CODES, CODES_A_ROW << bits):
                    yield from _pack(*held, bits)
                    held, total = ([], [], [], []), 0
        if held[0]:
            yield from _pack(*held, bits)

    return run


def _counter(bits: int):
    def run(group: pa.Table) -> pa.Table:
        slot = group.column("slot")[0].as_py()
        if slot < 0:
            return group.set_column(0, "target", pa.array(np.full(len(group), -1 - slot, np.int32)))
        codes, keys = [], []
        for key, size, body in zip(group.column("keys"), group.column("sizes"), group.column("codes"), strict=True):
            size = np.frombuffer(size.as_py(), np.uint32)
            n, body = int(size.sum()), body.as_py()
            codes.append((np.frombuffer(body, np.uint32, n).astype(np.uint64) << np.uint64(16)) | np.frombuffer(body, np.uint16, n, 4 * n))
            keys.append(np.repeat(np.frombuffer(key.as_py(), np.uint64), size))
        code, key = np.concatenate(codes), np.concatenate(keys)
        del codes, keys
        order = np.argsort(code)
        code, key = code[order], key[order]
        del order
        base = code >> np.uint64(1)
        same = base[1:] == base[:-1]
        several = (code & np.uint64(1)).astype(bool)
        several[1:] |= same
        several[:-1] |= same
        code, key = code[several], key[several]
        order = np.lexsort((key, code >> np.uint64(1)))
        code, key = code[order], key[order]
        base = code >> np.uint64(1)
        fresh = np.ones(len(code), bool)
        fresh[1:] = (base[1:] != base[:-1]) | (key[1:] != key[:-1])
        code, key, base = code[fresh], key[fresh], base[fresh]
        first = np.flatnonzero(np.r_[True, base[1:] != base[:-1]]) if len(base) else np.zeros(0, np.int64)
        count = np.diff(np.r_[first, len(base)])
        df = np.repeat(count, count)
        kept = (df > 1) | ((code & np.uint64(1)) > 0)
        full = (base[kept] << np.uint64(17 - bits)) if bits <= 17 else (base[kept] >> np.uint64(bits - 17))
        full |= np.uint64(slot) << np.uint64(64 - bits) if bits else np.uint64(0)
        key, df = key[kept], df[kept].astype(np.uint32)
        target = _shift(key, bits)
        order = np.argsort(target, kind="stable")
        target, key, df, full = target[order], key[order], df[order], full[order]
        starts = np.r_[0, np.flatnonzero(np.diff(target)) + 1, len(target)] if len(target) else [0]
        rows = [(int(target[a]), 1, b"", key[a:b].tobytes(), df[a:b].tobytes(), full[a:b].tobytes()) for a, b in zip(starts[:-1], starts[1:], strict=True)]
        cols = list(zip(*rows, strict=True)) or [()] * 6
        return pa.Table.from_arrays([pa.array(c, t) for c, t in zip(cols, [pa.int32(), pa.int32(), *[pa.binary()] * 4], strict=True)], names=["target", "kind", "ids", "keys", "sizes", "codes"])

    return run


def visible(codes: np.ndarray, bits: int) -> np.ndarray:
    """Codes as count() reports them: the bits that are carried, bit 0 clear."""
    low = max(1, 17 - bits)
    return (codes >> np.uint64(low)) << np.uint64(low)


def carried_bits(documents: DataFrame) -> int:
    """Leading bits that name a range: ranges follow the bytes that Spark expects of the documents, or, where it knows
    nothing of them, those that they have.

    Never fewer ranges than spark.sql.shuffle.partitions, and never more than 2**MOST_BITS. Those make ranges of RANGE_BYTES up
    to 16 TB, and of some 100 MB at 100 TB; a range of n bytes of text has n / 6 word codes of 24 bytes, so 400 MB then.
    A task holds CODES_A_ROW codes for each range before it packs them, some 600 MB with 2**20 ranges.
    """
    spark = documents.sparkSession
    expected = int(str(documents._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    if expected >= 1 << 56:  # what Spark says of frames it knows nothing of
        expected = documents.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    return min(MOST_BITS, max(_bits(store.parallelism(spark, 16)), (expected // RANGE_BYTES).bit_length()))


def count(documents: DataFrame, make: Callable[[blocks.Slice], Coded], name: str) -> tuple[DataFrame, int]:
    """documents(id, text) -> a written table by target, and its number of bits.

    Rows of kind 0 list documents (ids, keys, sizes), rows of kind 1 shared codes (keys, codes, and in
    sizes the number of distinct texts that hold the code). Documents of one key share a target.
    """
    bits = carried_bits(documents)
    packed = documents.mapInArrow(_packer(make, bits), _PACKED)
    return store.table(packed.groupBy("slot").applyInArrow(_counter(bits), _OUT), name), bits


def members(counted: DataFrame) -> DataFrame:
    """(doc_id, key, size) of every document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for ids, keys, sizes in zip(batch.column(0), batch.column(1), batch.column(2), strict=True):
                yield pa.RecordBatch.from_arrays([pa.array(np.frombuffer(x.as_py(), np.int64)) for x in (ids, keys, sizes)], names=["doc_id", "key", "size"])

    return counted.where(F.col("kind") == 0).select("ids", "keys", "sizes").mapInArrow(run, "doc_id long, key long, size long")


@dataclass
class Gathered:
    """The documents of one target: distinct keys, their sizes, and their shared codes in key order."""

    keys: np.ndarray
    sizes: np.ndarray
    of: np.ndarray
    codes: np.ndarray
    df: np.ndarray


def gather(group: pa.Table) -> Gathered:
    def joined(name: str, kind: int, dtype) -> np.ndarray:
        out = [np.frombuffer(x.as_py(), dtype) for x, k in zip(group.column(name), group.column("kind").to_pylist(), strict=True) if k == kind]
        return np.concatenate(out) if out else np.zeros(0, dtype)

    keys, first = np.unique(joined("keys", 0, np.uint64), return_index=True)
    sizes = joined("sizes", 0, np.int64)[first]
    owner, codes, df = joined("keys", 1, np.uint64), joined("codes", 1, np.uint64), joined("sizes", 1, np.uint32)
    order = np.lexsort((codes, owner))
    owner, codes, df = owner[order], codes[order], df[order].astype(np.int64)
    return Gathered(keys, sizes, np.r_[np.searchsorted(owner, keys), len(owner)], codes, df)
