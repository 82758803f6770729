"""Commits of articles, Merkle trees, predecessors in linear work, and rules that were too loose."""

from __future__ import annotations

import random
import time
from concurrent.futures import ThreadPoolExecutor

import pytest
from pyspark.sql import functions as F

from quillon import scratch
from quillon.operators import curation, integrity, merkle, release
from quillon.sources import snapshot

ARTICLES = "article_artifact_id string, document string"


def test_one_batch_may_not_hold_two_documents_of_an_id(spark):
    folder = scratch.new_path(spark, "articles")
    with pytest.raises(FileExistsError, match="several documents"):
        release.write_articles(spark.createDataFrame([("a", "x"), ("a", "y"), ("b", "z")], ARTICLES), folder)
    assert release.read_articles(spark, folder).count() == 0
    assert release.write_articles(spark.createDataFrame([("a", "x"), ("a", "x"), ("b", None)], ARTICLES), folder) == 1
    assert release.write_articles(spark.createDataFrame([("a", "x")], ARTICLES), folder) == 1
    assert sorted(map(tuple, release.read_articles(spark, folder).collect()), key=str) == [("a", "x"), ("b", None)]


def test_of_two_writers_with_other_bytes_for_an_id_one_succeeds(spark):
    folder = scratch.new_path(spark, "articles")
    release.write_articles(spark.createDataFrame([("old", "o")], ARTICLES), folder)

    def write(k):
        own = spark.newSession()
        try:
            return release.write_articles(own.createDataFrame([("shared", f"by {k}"), ("same", "s"), (f"own {k}", "x")], ARTICLES), folder)
        except FileExistsError:
            return None

    with ThreadPoolExecutor(4) as pool:
        done = list(pool.map(write, range(4)))
    won = [k for k, v in enumerate(done) if v is not None]
    assert len(won) == 1 and done[won[0]] == 2
    assert sorted(map(tuple, release.read_articles(spark, folder).collect())) == sorted([("old", "o"), ("shared", f"by {won[0]}"), ("same", "s"), (f"own {won[0]}", "x")])
    assert release.read_articles(spark, folder, 1).count() == 1
    with pytest.raises(ValueError, match="no version"):
        release.read_articles(spark, folder, 7)


def test_writers_who_agree_all_succeed_and_nothing_is_there_twice(spark):
    folder = scratch.new_path(spark, "articles")
    with ThreadPoolExecutor(3) as pool:
        list(pool.map(lambda k: release.write_articles(spark.newSession().createDataFrame([("same", "s"), (f"own {k}", "x")], ARTICLES), folder), range(3)))
    assert sorted(r[0] for r in release.read_articles(spark, folder).collect()) == ["own 0", "own 1", "own 2", "same"]


def inventory(spark, rows):
    return spark.createDataFrame([(f"p/{i}", s, f"{i}:{s}") for i, s in rows.items()], "path string, size_bytes long, sha256 string")


def test_trees_are_compared_below_nodes_that_differ(spark):
    rows = {i: i % 50 for i in range(3000)}
    later = {**rows, 7: 99, 5000: 1, 5001: 2}
    del later[11]
    one, two, three = (scratch.new_path(spark, "tree") for _ in range(3))
    merkle.write(inventory(spark, rows), one, 3)
    merkle.write(inventory(spark, later), two, 3)
    found, looked = merkle.compared(spark, one, two, 3)
    assert sorted(map(tuple, found.collect())) == [("p/11", "missing"), ("p/5000", "unexpected"), ("p/5001", "unexpected"), ("p/7", "changed")]
    assert looked[0] == 1 and looked[1] == 16 and looked[2] <= 4 * 16 and looked[3] <= 4 * 16  # of 4096 leaves
    changes = spark.createDataFrame([("p/7", 99, "7:99"), ("p/5000", 1, "5000:1"), ("p/5001", 2, "5001:2"), ("p/11", None, None)], "path string, size_bytes long, sha256 string")
    done = merkle.updated(spark, one, changes, three, 3)
    assert all(int(d.split(": ")[1]) <= 4 for d in done)
    tree = lambda f: sorted((r["level"], r["node"], r["digest"]) for r in spark.read.parquet(f"{f}/tree").collect())
    assert tree(two) == tree(three)
    same, looked = merkle.compared(spark, two, three, 3)
    assert same.count() == 0 and looked == [1]


def plain_prior(events):
    gone = {}
    for e in events:
        if e[1] == "undo":
            gone[e[3]] = min(gone.get(e[3], e[0]), e[0])
    kept = [e for e in events if e[1] != "undo"]
    return {e[0]: max((p[0] for p in kept if p[2] == e[2] and p[0] < e[0] and gone.get(p[0], 1 << 62) > e[0]), default=None) for e in kept}


LOG = "id long, action string, passage_id string, supersedes_event_id long"


@pytest.mark.parametrize("parts", [1, 7])
def test_predecessors_equal_a_plain_search(spark, parts):
    draw = random.Random(parts)
    events = []
    for i in range(1, 1500):
        undo = draw.random() < 0.4 and events
        events.append((i, "undo", "x", draw.choice(events[-200:])[0]) if undo else (i, "classify", draw.choice(["hot", "hot", "hot", "a", None]), None))
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        found = {r["id"]: r["prior_id"] for r in curation.prior_links(spark.createDataFrame(events, LOG)).collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", 4)
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert found == plain_prior(events)


def test_predecessors_of_one_long_passage_take_linear_work(spark):
    def rows(n):
        undo = F.col("id") % 3 == 2
        return spark.range(n).select((F.col("id") + 1).alias("id"), F.when(undo, "undo").otherwise("classify").alias("action"), F.lit("p").alias("passage_id"), F.when(undo, F.col("id") - F.col("id") % 7).alias("supersedes_event_id"))

    took = []
    for n in (1000, 50_000, 400_000):
        began = time.time()
        assert curation.prior_links(rows(n)).where("prior_id is not null").count() > n // 2
        took.append(time.time() - began)
    assert took[2] < 8 * took[1] + 10


def test_ids_of_other_logs_are_not_superseded(spark):
    kinds = "log string, id long, action string, passage_id string, supersedes_event_id long"
    rows = spark.createDataFrame([("A", 1, "classify", "p", None), ("B", 2, "undo", "p", 1), ("A", 3, "undo", "p", 1)], kinds)
    assert [r["log"] for r in integrity.dangling(rows, "log").collect()] == ["B"]
    event = '{"record_type":"audit_event","id":%d,"action":"%s","passage_id":"p","classification":%s,"rubric_id":"r","question":"q","evidence":"e","semantic_answer":"s","created_at":"c","supersedes_event_id":%s}'
    lines = [("A", 1, event % (1, "classify", '"lore"', "null")), ("B", 2, event % (2, "undo", "null", "1"))]
    found = snapshot.event_violations(spark.createDataFrame(lines, "log string, line_no long, value string"), ("lore",))
    assert [tuple(r) for r in found.collect()] == [("superseded event is none of this passage", 2)]


def test_stamps_are_real_moments_in_real_zones(spark):
    good = ["2024-02-29T00:00:00Z", "2024-01-01T23:59:59.123456+05:30", "2024-01-01T10:00-0800", "20240101T101010Z", "2024-01-01T10Z", "2024-01-01T10:00:00+02", "2024-01-01T10:00:00,5Z", "2024-01-01T10:00:00+02:00:30"]
    bad = ["2024-01-01T00:00:99Z", "2024-01-01T00:00:00+99:99", "2023-02-29T00:00:00Z", "2024-01-01T24:00:00Z", "2024-01-01T00:60Z", "2024-01-01 00:00:00Z", "2024-01-01T00:00:00", "2024-01-01T00:00:00+24:00", "2024-13-01T00:00Z", "2024-01-01T00:00:00Zx", "T", "", None]
    rows = spark.createDataFrame([(x, i < len(good)) for i, x in enumerate(good + bad)], "x string, ok boolean")
    wrong = rows.where(F.coalesce(integrity.zoned_timestamp(F.col("x")), F.lit(False)) != F.col("ok")).collect()
    assert wrong == []


@pytest.mark.parametrize("width", [3, 1 << 16])
def test_depths_across_parts(spark, width):
    draw = random.Random(width)
    rows = [(draw.choice(["a", "a", None]), i, draw.random() < 0.55) for i in range(400)]
    expected, held = {}, {}
    for scope, i, undo in rows:
        idle = undo and not held.get(scope, 0)
        held[scope] = held.get(scope, 0) + (0 if idle else -1 if undo else 1)
        expected[i] = (held[scope], idle)
    found = curation.depths(spark.createDataFrame(rows, "scope string, id long, undo boolean"), "scope", width)
    assert {r["id"]: (r["depth"], r["idle"]) for r in found.collect()} == expected
