"""Packing against the tokenizer itself, the rules of a sequence, and best-two-fit bin by bin."""

from __future__ import annotations

import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from quillon.llm import packing

PATH = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def encode():
    own = Tokenizer.from_file(PATH)
    return lambda text: own.encode(text, add_special_tokens=False).ids


def test_ids_are_those_of_the_tokenizer(encode):
    draw = random.Random(1)
    near = [chr(c) for c in range(9, 0x250)] + list("ΑΩαωыДя–—‘’“”…€王小明")
    texts = ["", "a  b", "a\n\n b", "  lead", "trail  ", "x \n", "don't we'll 'S", "<|endoftext|> a", "a\x1c\x1d b", "🙂  🙂x", "שלום عليكم", "ab"]
    texts += ["".join(draw.choice(near) for _ in range(draw.randrange(1, 14))) for _ in range(3000)]
    texts += ["".join(draw.choice(" \n\t.a'sé!1 Z,") for _ in range(draw.randrange(1, 14))) for _ in range(3000)]
    assert packing._encoder(PATH).__name__ == "encode"
    for text in texts:
        assert np.frombuffer(packing.token_bytes(text, PATH), "<u4").tolist() == encode(text), text


def test_other_files_go_to_their_own_library():
    path = public_tokenizers.path("word_bpe_49k.json")
    own = Tokenizer.from_file(path)
    assert packing._encoder(path).__name__ == "exact"
    assert np.frombuffer(packing.token_bytes("Some  Words.\n", path), "<u4").tolist() == own.encode("Some  Words.\n", add_special_tokens=False).ids


def bin_by_bin(lengths, capacity):
    """Best-two-fit as its name says, one bin at a time over a sorted list."""
    free, bins = sorted(lengths), 0
    while free:
        own, room = [], capacity
        for x in sorted(free, reverse=True):
            if x <= room:
                own.append(x)
                room -= x
        for x in own:
            free.remove(x)
        while room and len(own) > 1:
            least = own[-1]
            pairs = [(a + b, a, b) for i, a in enumerate(free) for b in free[:i] if least < a + b <= room + least]
            if not pairs:
                break
            total, a, b = max(pairs)
            own = sorted([*own[:-1], a, b], reverse=True)
            free.remove(a)
            free.remove(b)
            free = sorted([*free, least])
            room += least - total
        bins += 1
    return bins


@pytest.mark.parametrize("capacity", [1, 7, 30])
def test_patterns_use_every_piece_and_equal_bin_by_bin(capacity):
    draw = random.Random(capacity)
    for _ in range(40):
        lengths = [draw.randrange(1, capacity + 1) for _ in range(draw.randrange(0, 60))]
        plan = packing.best_two_fit(np.bincount(lengths, minlength=capacity + 1), capacity)
        used = Counter()
        for bins, pattern in plan:
            assert bins > 0 and sum(x * n for x, n in pattern) <= capacity
            for x, n in pattern:
                used[x] += bins * n
        assert used == Counter(lengths)
        assert sum(bins for bins, _ in plan) == bin_by_bin(lengths, capacity)


def check(rows, documents, encode, capacity):
    found = defaultdict(list)
    for r in rows:
        found[r["doc_id"]].append(r)
    expected = defaultdict(list)
    for doc, text in documents:
        ids = [*encode(text or ""), 2]
        low = 0
        for k, high in enumerate(range((len(ids) - 1) % capacity + 1, len(ids) + 1, capacity)):
            expected[doc].append((k, low, high - low, zlib.crc32(np.array(ids[low:high], "<u4").tobytes())))
            low = high
    assert {d: sorted((r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in rs) for d, rs in found.items()} == {d: sorted(p) for d, p in expected.items()}
    sequences = defaultdict(list)
    for r in rows:
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
    for places in sequences.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= capacity
    return len(sequences), sum(r["length"] for r in rows)


def test_packed_documents(spark, encode):
    documents = [(r[0], r[1]) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").collect()]
    documents += [(1, documents[0][1]), (1, documents[0][1]), (None, "no id"), (9001, None), (9002, ""), (9003, "word " * 30000)]
    frame = spark.createDataFrame([(d, t, "x", 1) for d, t in documents], "doc_id long, text string, piece string, length int")
    rows = packing.packed(frame, PATH).collect()
    n, tokens = check(rows, documents, encode, 1024)
    assert n <= 1.01 * tokens / 1024 + 1
    small = packing.packed(frame.where("doc_id is null or doc_id > 9000"), PATH, capacity=10).collect()
    check(small, [d for d in documents if d[0] is None or d[0] > 9000], encode, 10)


def test_no_documents(spark):
    assert packing.packed(spark.createDataFrame([], "doc_id long, text string"), PATH).collect() == []
