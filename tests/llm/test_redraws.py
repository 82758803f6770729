"""Surrogates that meet values of the corpus are drawn again, each value on its own."""

from __future__ import annotations

import re

import pytest
from pyspark.sql import functions as F

from quillon.llm import pii

KEY = b"secret"


def corpus(spark, texts):
    return spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")


@pytest.mark.parametrize("carried", [pii.MOST_CARRIED, 0])
def test_dense_formats_keep_clear_of_the_corpus(spark, carried):
    """A quarter of the addresses of one format, in two texts each: no surrogate is a value, none stands for two."""
    own = [f"192.168.{a}.{b}" for a in range(256) for b in range(0, 256, 4)] + [f"10.0.0.{b}" for b in range(50)]
    texts = [f"from {x} to {y}" for x, y in zip(own, own[1:] + own[:1], strict=True)] + ["nothing", "", None]
    frame = corpus(spark, texts).withColumn("draws", F.lit("own"))
    plain = pii.Surrogates(KEY)
    values = set(own)
    met = [v for v in own if plain.of("ip", v) in values]
    assert len(met) > 3000
    done = pii.replace_private(frame, KEY, most_carried=carried)
    assert done.columns == frame.columns
    rows = {r["doc_id"]: r for r in done.collect()}
    assert [rows[len(own) + i]["text"] for i in range(3)] == ["nothing", "", None] and {r["draws"] for r in rows.values()} == {"own"}
    to = {}
    for i, (x, y) in enumerate(zip(own, own[1:] + own[:1], strict=True)):
        a, b = re.fullmatch(r"from (\S+) to (\S+)", rows[i]["text"]).groups()
        assert to.setdefault(x, a) == a and to.setdefault(y, b) == b
    assert len(set(to.values())) == len(own) and not values & set(to.values())
    assert all(v.rsplit(".", 3)[0] == to[v].rsplit(".", 3)[0] for v in own)  # of the kind that they were
    assert all(to[v] == plain.of("ip", v) for v in own if v not in set(met))  # and only those that met a value move
    if carried:  # the object with all draws says the same
        made = pii.checked_surrogates(frame, KEY)
        assert all(made.rewrite(t)[0] == rows[i]["text"] for i, t in enumerate(texts))


def test_a_full_format_stays_apart(spark):
    """All addresses of a format: no place is free, so values keep their first surrogates, which are apart."""
    own = [f"192.168.{a}.{b}" for a in range(256) for b in range(256)]
    frame = corpus(spark, [" ; ".join(own[i : i + 512]) for i in range(0, len(own), 512)] + ["mail a@b.co"])
    out = [r["text"] for r in pii.replace_private(frame, KEY).orderBy("doc_id").collect()]
    new = [x for t in out[:-1] for x in t.split(" ; ")]
    assert sorted(new) == sorted(own) and all(a != b for a, b in zip(own, new, strict=True)) and "a@b.co" not in out[-1]


@pytest.mark.parametrize("carried", [pii.MOST_CARRIED, 0])
def test_every_free_place_of_a_format_is_dealt_out(spark, carried):
    """Half of all values of two formats get exactly the other halves; of three quarters, a third gets the last quarter."""
    half = [f"192.168.{a}.{b}" for a in range(256) for b in range(0, 256, 2)] + [f"{a}@{b}.co" for a in "acegikmoqsuwy" for b in "abcdefghijklmnopqrstuvwxyz"]
    most = [f"192.168.{a}.{b}" for a in range(256) for b in range(256) if b % 4]
    for own, free in ((half, len(half)), (most, 1 << 14)):
        frame = corpus(spark, [" ; ".join(own[i : i + 512]) for i in range(0, len(own), 512)])
        new = [x for r in pii.replace_private(frame, KEY, most_carried=carried).orderBy("doc_id").collect() for x in r["text"].split(" ; ")]
        assert len(new) == len(own) == len(set(new)) and len(set(new) - set(own)) == free
        assert all(a != b and [x for x in a if x in "@."] == [x for x in b if x in "@."] for a, b in zip(own, new, strict=True))


@pytest.mark.parametrize(
    ("kind", "text", "total"),
    [("phone", "+49 30 1234567", 10**9), ("phone", "(012) 345-6789", 10**9), ("ssn", "123-45-6789", 10**9), ("ip", "192.168.1.2", 1 << 16), ("ip", "8.8.8.8", 1 << 32), ("email", "Ab@x.example.com", 26**3), ("email", "ab1@mail.co", 26**6 * 10), ("card", "4111 1111 1111 1111", 10**14), ("card", "4111 1111 1111 1112", 10**15)],
)
def test_places_are_the_values_of_a_format(kind, text, total):
    shape = pii._Format(b"").of_value(kind, text)
    assert shape[1] == total and pii._Format(b"").of_value(kind, pii.Surrogates(KEY).of(kind, text)) == shape
    some, seen = pii.Placed(), {}
    for some.place in range(0, total, max(1, total // 300)):
        try:
            seen[some.place] = some._of(kind, text)
        except ValueError:  # the number is no valid value
            continue
    assert len(set(seen.values())) == len(seen) > 30
    assert all(pii._Format(b"").of_value(kind, x) == shape and pii.Surrogates(KEY).at(-1 - p).of(kind, text) == x for p, x in seen.items())


def test_clashes_by_brute_force(spark):
    rows = [("ip", "a", "a", "x"), ("ip", "b", "b", "x"), ("ip", "c", "c", "a"), ("phone", "d", "d", "a"), ("ip", "e", "e", "b"), ("ip", "f", "f", "b"), ("ip", "g", "g", "y")]
    frame = spark.createDataFrame(rows, "kind string, value string, text string, surrogate string")
    assert sorted(map(tuple, pii.clashes(frame).collect()), key=str) == [("ip", "a", None), ("ip", "b", None), ("ip", "x", "a")]
