"""Retrieval, activation, scoped decisions and blinded evaluation against plain Python."""

from __future__ import annotations

import math
import random
import re
from collections import Counter, defaultdict
from concurrent.futures import ThreadPoolExecutor
from datetime import datetime, timedelta

import pytest

from quillon import scratch
from quillon.operators import activation, evaluation, integrity, retrieval, scopes


def bm25(passages, questions, k):
    words = lambda t: re.findall(r"\w+", t.lower())
    held = {o: Counter(words(t)) for o, t in passages}
    mean = sum(sum(c.values()) for c in held.values()) / len(held)
    df = Counter(t for c in held.values() for t in c)
    out = {}
    for q, text in questions:
        scores = Counter()
        for t in set(words(text)):
            rare = math.log(1 + (len(held) - df[t] + 0.5) / (df[t] + 0.5))
            for o, c in held.items():
                if c[t]:
                    scores[o] += math.floor(1_000_000 * rare * c[t] * 2.2 / (c[t] + 1.2 * (0.25 + 0.75 * sum(c.values()) / mean)) + 0.5)
        out[q] = sorted(((-s, o) for o, s in scores.items()))[:k]
    return {(q, i + 1, o, -s) for q, found in out.items() for i, (s, o) in enumerate(found)}


@pytest.fixture(scope="module")
def corpus():
    draw = random.Random(4)
    common, rare = ["the", "of", "and", "in"], [f"word{i}" for i in range(300)]
    passages = [(i, " ".join(draw.choice(common) if draw.random() < 0.5 else draw.choice(rare[: 20 + i // 4]) for _ in range(draw.randrange(0, 40)))) for i in range(1000)]
    passages += [(5000 + i, "Twin Words!") for i in range(30)]
    questions = [(f"q{i}", " ".join(draw.choice(rare) for _ in range(4)) + " The the") for i in range(55)] + [("twin", "twin, WORDS"), ("none", "zzz"), ("empty", ""), ("marks", "?! .")]
    return passages, questions


def test_search_equals_a_full_scan_and_skips_blocks(spark, corpus):
    passages, questions = corpus
    index = retrieval.postings(spark.createDataFrame(passages, "ordinal long, text string"), 32)
    found, work = retrieval.search(scratch.table(index, "postings"), spark.createDataFrame(questions, "question_id string, text string"), 5, lead=2)
    assert {tuple(r) for r in found.select("question_id", "rank", "ordinal", "score").collect()} == bm25(passages, questions, 5)
    rows = work.collect()
    assert sum(r["scored"] for r in rows) < 0.8 * sum(r["blocks"] for r in rows) and all(r["scored"] <= r["blocks"] for r in rows)
    assert index.selectExpr("max(size(hits))").first()[0] <= 32


def test_an_index_serves_the_active_release_or_nothing(spark, corpus):
    registry, folder = scratch.new_path(spark, "registry"), scratch.new_path(spark, "index")
    passages = spark.createDataFrame(corpus[0][:50], "ordinal long, text string")
    asked = spark.createDataFrame([("q", "the word1")], "question_id string, text string")
    retrieval.write_index(passages, "one", folder, 16)
    with pytest.raises(retrieval.IndexUnavailable):
        retrieval.Retrieval.open(spark, folder, registry)
    activation.activate(spark, registry, "one", 0, {"one", "two"})
    opened = retrieval.Retrieval.open(spark, folder, registry)
    activation.activate(spark, registry, "two", 1, {"one", "two"})
    assert opened.release_id == "one" and opened.search(asked, 3).count() == 3
    with pytest.raises(retrieval.IndexUnavailable, match="doesn't fit"):
        retrieval.Retrieval.open(spark, folder, registry)
    with pytest.raises(retrieval.IndexUnavailable, match="no whole index"):
        retrieval.Retrieval.open(spark, folder + "-else", registry)
    activation.rollback(spark, registry, 2)
    closed = retrieval.Retrieval.open(spark, folder, registry, enabled=False)
    blocks = spark.createDataFrame([(1, i, "s", True, str(i)) for i in range(3)], "article_id long, source_pos long, section string, admitted boolean, text string")
    assert closed.search(asked, 3).count() == 0 and closed.context(blocks.select("article_id", "source_pos"), blocks).count() == 0


def test_context_ends_at_sections_and_excluded_blocks(spark):
    rows = [(1, i, s, a, str(i)) for i, (s, a) in enumerate([("x", True), ("x", True), ("x", False), ("x", True), ("x", True), ("y", True), ("y", True), (None, True), (None, True)])]
    blocks = spark.createDataFrame(rows, "article_id long, source_pos long, section string, admitted boolean, text string")
    found = {r["source_pos"]: (r["previous"], r["following"]) for r in retrieval.context(blocks.where("admitted").select("article_id", "source_pos"), blocks, 3).collect()}
    assert found == {0: ([], ["1"]), 1: (["0"], []), 3: ([], ["4"]), 4: (["3"], []), 5: ([], ["6"]), 6: (["5"], []), 7: ([], ["8"]), 8: (["7"], [])}


def test_of_concurrent_activations_one_succeeds(spark):
    registry, names = scratch.new_path(spark, "registry"), {f"r{i}" for i in range(8)}

    def attempt(name, seen):
        try:
            return activation.activate(spark, registry, name, seen, names)
        except activation.Conflict:
            return None

    for seen in range(3):
        with ThreadPoolExecutor(8) as pool:
            done = list(pool.map(lambda n: attempt(n, seen), sorted(names)))
        assert sorted(x for x in done if x is not None) == [seen + 1]
    assert [e["version"] for e in activation.history(spark, registry)] == [1, 2, 3]
    before = activation.history(spark, registry)
    with pytest.raises(activation.Conflict):
        activation.activate(spark, registry, "r1", 9, names)
    with pytest.raises(ValueError, match="retained"):
        activation.activate(spark, registry, "gone", 3, names)
    assert activation.rollback(spark, registry, 3) == 4 and activation.active_release(spark, registry) == before[1]["release_id"]
    assert activation.rollback(spark, registry, 4) == 5
    with pytest.raises(ValueError, match="no earlier"):
        activation.rollback(spark, registry, 5)
    kept = {before[0]["release_id"]}
    assert {r[0] for r in activation.deletable(spark.createDataFrame([(n,) for n in names], "release_id string"), spark, registry).collect()} == names - kept
    assert activation.log(spark, registry).count() == 5


def test_accepted_proposals_and_what_was_active(spark):
    draw = random.Random(8)
    rows, expected, version = [], set(), defaultdict(int)
    for i in range(1500):
        registry = draw.choice(["a", "a", "a", "b", "c"])
        seen = max(0, version[registry] - draw.choice([0, 0, 1, 2]) + (draw.random() < 0.1))
        rows.append((registry, i, seen))
        if seen == version[registry]:
            version[registry] += 1
            expected.add((registry, i, version[registry]))
    found = activation.accepted(spark.createDataFrame(rows, "registry_id string, id long, seen long"))
    assert {(r["registry_id"], r["id"], r["version"]) for r in found.collect()} == expected

    start, entries, stacks, asked, answers = datetime(2024, 1, 1), [], defaultdict(list), [], []
    for i in range(600):
        at, registry = start + timedelta(hours=i // 2), draw.choice("abc")
        if draw.random() < 0.5:
            action = draw.choice(["activate", "rollback"])
            entries.append((registry, i, at, action, f"r{i}"))
            stacks[registry] = [*stacks[registry], f"r{i}"] if action == "activate" else stacks[registry][:-1]
        if i % 2:  # both entries of the moment are in
            asked.append((registry, at, i))
            answers.append((registry, i, stacks[registry][-1] if stacks[registry] else None))
    log = spark.createDataFrame(entries, "registry_id string, id long, at timestamp_ntz, action string, release_id string")
    found = activation.active_at(log, spark.createDataFrame(asked, "registry_id string, at timestamp_ntz, no long"))
    assert sorted((r["registry_id"], r["no"], r["release_id"]) for r in found.collect()) == sorted(answers, key=lambda x: x[:2])


def test_the_most_specific_decision_counts(spark):
    kinds = "id long, article_id string, path array<string>, passage_id string, action string, classification string, rubric_id string, supersedes_event_id long"
    log = [
        (1, "a", [], None, "classify", "reference", "r2", None), (2, "a", ["h"], None, "classify", "lore", "r2", None), (3, "a", ["h", "deep"], None, "classify", "lore", "r1", None),
        (4, "a", [], "p1", "defer", None, "r2", None), (5, "b", [], None, "classify", "lore", "r2", None), (6, "b", [], None, "classify", "analysis", "r2", None),
        (7, "c", [], None, "classify", "lore", "r2", None), (8, "c", [], None, "classify", "analysis", "r2", 7), (9, "d", [], None, "classify", "lore", "r2", None), (10, "d", [], None, "undo", None, "r2", 9),
    ]
    rows = [("a", ["h"], "p1"), ("a", ["h"], "p2"), ("a", ["h", "deep"], "p3"), ("a", ["h", "else"], "p4"), ("a", [], "p5"), ("a", ["hh"], "p6"), ("b", [], "p7"), ("c", ["x"], "p8"), ("d", [], "p9")]
    found = scopes.inherited(spark.createDataFrame(rows, "article_id string, heading_path array<string>, passage_id string"), spark.createDataFrame(log, kinds), "r2")
    got = {r["passage_id"]: (r["label"], r["state"], r["depth"]) for r in found.collect()}
    assert got == {
        "p1": (None, "deferred", -1), "p2": ("lore", "classified", 1), "p3": (None, "stale", 2), "p4": ("lore", "classified", 1), "p5": ("reference", "classified", 0),
        "p6": ("reference", "classified", 0), "p7": (None, "ambiguous", 0), "p8": ("analysis", "classified", 0), "p9": (None, "undecided", None),
    }
    assert {r["passage_id"] for r in scopes.admitted(found, "lore").collect()} == {"p2", "p4"}
    none = scopes.inherited(spark.createDataFrame(rows, "article_id string, heading_path array<string>, passage_id string"), spark.createDataFrame([], kinds), "r2")
    assert {r["state"] for r in none.collect()} == {"undecided"}


def test_sides_are_balanced_in_every_block_and_hidden_from_who_lacks_the_key(spark):
    rows = [(s, 1000 * s + i, i, "normal", "disabled") for s, n in ((1, 400), (2, 41), (3, 1)) for i in range(n)]
    frame = spark.createDataFrame(rows, "stratum long, case_id long, ordinal long, first string, second string")
    dealt = {r["case_id"]: r for r in evaluation.sides(frame, "k", 6).collect()}
    for s, n in ((1, 400), (2, 41)):
        for low in range(0, n - n % 6, 6):
            assert sum(dealt[1000 * s + i]["left"] == "normal" for i in range(low, low + 6)) == 3
    assert all({r["left"], r["right"]} == {"normal", "disabled"} for r in dealt.values())
    assert {k: r["left"] for k, r in dealt.items()} == {r["case_id"]: r["left"] for r in evaluation.sides(frame.repartition(5), "k", 6).collect()}
    assert sum(r["left"] != dealt[r["case_id"]]["left"] for r in evaluation.sides(frame, "other", 6).collect()) > 100
    with pytest.raises(ValueError, match="even"):
        evaluation.sides(frame, "k", 3)


def test_only_whole_pairs_are_compared(spark):
    pairs = spark.createDataFrame([(i, "normal", "disabled") for i in range(4)], "case_id long, first string, second string")
    outputs = spark.createDataFrame([(0, "normal", "ok"), (0, "disabled", "ok"), (1, "normal", "ok"), (2, "normal", "ok"), (2, "disabled", "exposed"), (3, "disabled", "ok")], "case_id long, condition string, state string")
    assert [r["case_id"] for r in evaluation.usable(pairs, outputs).collect()] == [0]


def test_strengths_equal_a_plain_fixed_point(spark):
    draw = random.Random(2)
    reviews = []
    for _ in range(800):
        a, b = draw.sample(range(6), 2)
        reviews.append((a, b, draw.choice(["tie", "both fail", "left better" if a < b else "right better", "left better"])))
    reviews.append((1, 7, "right better"))  # never beaten
    met, points = Counter(), Counter()
    for a, b, v in reviews:
        if v != "both fail":
            met[a, b] += 1
            met[b, a] += 1
            points[a] += {"left better": 1, "tie": 0.5}.get(v, 0)
            points[b] += {"right better": 1, "tie": 0.5}.get(v, 0)
    strength = dict.fromkeys(points, 1.0)
    for _ in range(25):
        strength = {a: (points[a] + 1) / (sum(n / (strength[a] + strength[b]) for (x, b), n in met.items() if x == a) + 2 / (strength[a] + 1)) for a in strength}
    frame = evaluation.unblinded(spark.createDataFrame(reviews, "left long, right long, verdict string"))
    found = {r["condition"]: r["strength"] for r in evaluation.strengths(evaluation.pair_counts(frame), rounds=25).collect()}
    assert found.keys() == strength.keys() and all(math.isclose(found[a], strength[a], rel_tol=1e-9) for a in found)
    early = {r["condition"]: r["strength"] for r in evaluation.strengths(evaluation.pair_counts(frame), rounds=60, tolerance=1e-3).collect()}
    assert all(math.isclose(early[a], found[a], rel_tol=0.1) for a in found)
    with pytest.raises(Exception, match="unknown verdict"):
        evaluation.unblinded(spark.createDataFrame([(1, 2, "draw")], "left long, right long, verdict string")).collect()


def test_numbers_and_carried_values_cross_parts(spark):
    draw = random.Random(1)
    rows = [(draw.choice(["a", None, "b"]), i, draw.choice([None, None, str(i)])) for i in range(300)]
    frame = spark.createDataFrame(rows, "g string, o long, v string").repartition(5)
    import pyspark.sql.functions as F

    part = F.floor(F.col("o") / 16)
    seen, count = {}, Counter()
    expected = {}
    for g, o, v in rows:
        seen[g] = v if v is not None else seen.get(g)
        expected[o] = (seen[g], count[g])
        count[g] += 1
    found = integrity.numbered(integrity.with_last(frame, "g", ["o"], part, "v", "last"), "g", "o", part, "n")
    assert {r["o"]: (r["last"], r["n"]) for r in found.collect()} == expected
