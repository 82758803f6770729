"""Removal of byte strings that repeat across a corpus, by run-length indexes per shard."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import blocks, repeats, suffixes

LENGTH = 400
SHORT = 256  # reported: passages of some fifty words and more are longer
EMPTY_SHA256 = "e3b0c44298fc1c149afbf4c8996fb92427ae41e4649b934ca495991b7852b855"


def _units(part: blocks.Slice) -> repeats.Units:
    return repeats.Units(blocks.byte_codes(part.data), part.offsets)


def _body(part: blocks.Slice, units: repeats.Units, low: int, high: int) -> bytes:
    return part.data[low:high].tobytes()


def _matches(pieces: list[bytes], length: int) -> list[np.ndarray]:
    return suffixes.RunIndex(pieces).long_matches(length)


def _kept(text: str, runs: np.ndarray) -> bytes:
    raw = text.encode()
    edges = [0, *runs.ravel().tolist(), len(raw)]
    return b"".join(raw[a:b] for a, b in zip(edges[::2], edges[1::2], strict=True))


def _near(pieces: list[bytes], counts: list[int], size: int) -> list[np.ndarray]:
    starts = np.cumsum([0, *map(len, pieces)])
    hashes = blocks.window_hashes(blocks.byte_codes(np.frombuffer(b"".join(pieces), np.uint8)), size)
    own = np.concatenate([hashes[a : a + n] for a, n in zip(starts[:-1].tolist(), counts, strict=True)])
    order = np.argsort(own)
    same = np.zeros(len(own) + 1, bool)
    same[1:-1] = own[order][1:] == own[order][:-1]
    found = np.empty(len(own), bool)
    found[order] = same[1:] | same[:-1]
    return np.split(found, np.cumsum(counts)[:-1])


def kind(length: int = LENGTH, short: int = SHORT) -> repeats.Kind:
    short = min(short, length)
    gram = max(1, min(24, short // 8))
    return repeats.Kind(repeats.Sampling(length, short, gram, max(1, (short - gram + 1) // 4)), _units, _body, _matches, _near)


def coded(documents: DataFrame, id_column: str, text_column: str) -> DataFrame:
    """(id, doc_id, text) of the rows with an id; id is a code of both, so that one doc_id may stand on several texts."""
    rows = documents.select(F.col(id_column).cast("long").alias("doc_id"), F.coalesce(F.col(text_column).cast("string"), F.lit("")).alias("text")).where("doc_id is not null")
    return rows.select(F.xxhash64("doc_id", "text").alias("id"), "doc_id", "text")


def remove_repeated_bytes(documents: DataFrame, id_column: str = "doc_id", text_column: str = "text", length: int = LENGTH, short: int = SHORT) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256, n_shared) of every document with an id.

    A byte goes when a string of `length` bytes that covers it also starts anywhere else, in the same
    document or another. n_shared counts the bytes that a string of `short` bytes covers in that way: they
    stay where they are in no longer one. Null counts as empty. Shorter texts keep all bytes. Repeated
    rows are copies of each other, and an id may have several texts. Rows whose id is null are left out.
    """
    rows = coded(documents, id_column, text_column)
    own = kind(length, short)
    members, cuts = repeats.removals(rows.select("id", "text"), own, "bytes", _kept)
    sums = rows.select("id", "doc_id", F.sha2(F.encode("text", "UTF-8"), 256).alias("sha"), F.octet_length("text").cast("long").alias("n"))
    return assembled(members, cuts, sums, "n_bytes", own.sampling)


def assembled(members: DataFrame, cuts: DataFrame, sums: DataFrame, size: str, sampling: repeats.Sampling) -> DataFrame:
    """What becomes of every document, from the parts of repeats.removals and (id, doc_id, n, sha) of the whole texts."""
    whole = F.col("copied") & (F.col("size") >= sampling.length)
    found = members.join(cuts, "key", "left").select(
        F.col("doc_id").alias("code"), F.col("size").alias(size),
        F.when(whole, F.col("size")).otherwise(F.coalesce("n_removed", F.lit(0))).alias("n_removed"),
        F.when(whole, F.lit(1)).otherwise(F.coalesce("n_spans", F.lit(0))).cast("long").alias("n_spans"),
        F.when(whole, F.lit(EMPTY_SHA256)).otherwise(F.col("kept_sha256")).alias("kept_sha256"),
        F.when(F.col("copied") & (F.col("size") >= sampling.short), F.col("size")).otherwise(F.coalesce("n_shared", F.lit(0))).alias("n_shared"),
    )
    untouched = sums.select(F.col("id").alias("code"), "doc_id", "sha").distinct()
    return found.join(untouched, "code").select("doc_id", size, "n_removed", "n_spans", F.coalesce("kept_sha256", "sha").alias("kept_sha256"), "n_shared")
