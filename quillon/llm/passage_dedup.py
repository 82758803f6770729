"""Removal of word passages that repeat across a corpus, by compressed FM-indexes per shard."""

from __future__ import annotations

import re

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import blocks, repeats, suffixes
from .substring_dedup import assembled, coded

LENGTH = 35
_WORD = re.compile("[^\x20\x09-\x0d]+")


def _units(part: blocks.Slice) -> repeats.Units:
    found = blocks.words(part)
    return repeats.Units(blocks.word_hashes(part.data, found), found.of)


def _body(part: blocks.Slice, units: repeats.Units, low: int, high: int) -> bytes:
    return units.codes[low:high].tobytes()


def _matches(pieces: list[bytes], length: int) -> list[np.ndarray]:
    return suffixes.WordIndex([np.frombuffer(p, np.uint64) for p in pieces]).long_matches(length)


def _kept(text: str, runs: np.ndarray) -> bytes:
    words = _WORD.findall(text)
    edges = [0, *runs.ravel().tolist(), len(words)]
    return " ".join(w for a, b in zip(edges[::2], edges[1::2], strict=True) for w in words[a:b]).encode()


def kind(length: int = LENGTH) -> repeats.Kind:
    gram = max(1, min(3, length // 8))
    return repeats.Kind(repeats.Sampling(length, length, gram, max(1, (length - gram + 1) // 4)), _units, _body, _matches)


def remove_repeated_passages(documents: DataFrame, id_column: str = "doc_id", text_column: str = "text", length: int = LENGTH) -> DataFrame:
    """(doc_id, n_words, n_removed, n_spans, kept_sha256) of every document with an id.

    A word goes when a window of `length` words that covers it also starts anywhere else, in the same
    document or another; kept words are joined by one space. Null counts as no words. Shorter texts
    keep all words. Repeated rows are copies of each other, and an id may have several texts. Rows whose id is null
    are left out.
    """
    rows = coded(documents, id_column, text_column)
    own = kind(length)
    members, cuts = repeats.removals(rows.select("id", "text"), own, "words", _kept)
    spaced = F.regexp_replace(F.regexp_replace("text", "[\\x20\\x09-\\x0D]+", " "), "^ | $", "")
    size = F.when(spaced == "", 0).otherwise(F.length(spaced) - F.length(F.translate(spaced, " ", "")) + 1).cast("long")
    return assembled(members, cuts, rows.select("id", "doc_id", F.sha2(F.encode(spaced, "UTF-8"), 256).alias("sha"), size.alias("n")), "n_words", own.sampling).drop("n_shared")
