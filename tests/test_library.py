from __future__ import annotations

import bz2
import json
import os
import random
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from quillon.functions import text as T
from quillon.operators import curation, extract, integrity, release, resolve
from quillon.sources import dump, snapshot

LABELS = tuple(curation.CLASSIFICATIONS.values())


def test_titles(spark):
    rows = spark.createDataFrame([("north-sea_",), (" Öland#History",), ("",), (None,)], "t string")
    got = rows.select(T.title_key(F.col("t")), T.redirect_title(F.col("t")), T.quoted(F.col("t"), "()_-")).collect()
    assert [r[0] for r in got] == ["North-sea", "Öland#History", "", None]
    assert got[1][1] == "Öland"
    assert T.wrapped("", 10) == [""] and T.wrapped("a-b", 3) == ["a-b"] and T.wrapped("abcdef gh", 4) == ["abcd", "ef", "gh"]
    assert rows.limit(1).select(resolve.category_url(F.lit("Sea ports: (old)"))).first()[0] == "https://en.wikipedia.org/wiki/Category:Sea_ports:_(old)"


def extracted(spark, raw):
    rows = extract.blocks_of(spark.createDataFrame([(1, raw)], "page_id long, raw_wikitext string")).orderBy("block_no").collect()
    return [(r["heading_path"], r["paragraph_ordinal"], r["exclusion"], r["passage"]) for r in rows]


def test_extraction_rules(spark):
    raw = "Lead '''text'''<ref name=x>no</ref> [[Harbour|the port]].\n\n{{Infobox}}\n== History ==\nOne.\n\n* item\n==== Deep ====\nTwo [http://x.y z].\n== References ==\nBook.\n{| t\n|}\n\n<poem>\nlines</poem>"
    admin = "reference or administrative material"
    assert extracted(spark, raw) == [
        (["Lead"], 1, None, "Lead text the port."), (["Lead"], 2, "unresolved template", None), (["History"], 1, None, "One."), (["History"], 2, "list", None),
        (["History", "Deep"], 1, None, "Two z."), (["References"], 1, admin, None), (["References"], 2, admin, None),
    ]
    assert extracted(spark, "<ref>only</ref>") == [] and extracted(spark, None) == [] and extracted(spark, " \n\u2003\n") == []
    assert [x[0] for x in extracted(spark, "Intro\n\n== A ==\nx\n==== B ====\ny\n=== C ===\nz\n\n* w\n== Lead ==\nv")] == [["Lead"], ["A"], ["A", "B"], ["A", "C"], ["A", "C"], ["Lead"]]
    assert extracted(spark, "a\n\n== Lead ==\nb")[1][:2] == (["Lead"], 2)  # the lead's ordinals go on under a heading of its name
    assert extracted(spark, "=== X ==\nt")[0][0] == ["= X"]
    assert extracted(spark, "x {{open\n\nclose}} y") == [(["Lead"], 1, None, "x {{open"), (["Lead"], 2, None, "close}} y")]


@pytest.mark.skipif("QUILLON_ARTICLES" not in os.environ, reason="no folder of articles with known passages is named")
def test_articles_with_known_passages(spark):
    known = [json.loads(p.read_text()) for p in sorted(Path(os.environ["QUILLON_ARTICLES"]).glob("*.json"))]
    pages = spark.createDataFrame([(d["page_id"], d["raw_wikitext"]) for d in known], "page_id long, raw_wikitext string")
    got: dict = {}
    for r in extract.blocks_of(pages).orderBy("page_id", "block_no").collect():
        got.setdefault((r["page_id"], r["exclusion"] is None), []).append((r["heading_path"], r["paragraph_ordinal"], r["exclusion"] or r["passage"]))
    for d in known:
        assert got.get((d["page_id"], True), []) == [(p["heading_path"], p["paragraph_ordinal"], p["normalized_text"]) for p in d["extracted_passages"]]
        assert got.get((d["page_id"], False), []) == [(x["heading_path"], x["paragraph_ordinal"], x["structure_type"]) for x in d["structural_exclusions"]]
        assert extract.article_id(d["dump_run"], d["page_id"], d["revision_id"], d["extractor_identity"], d["extractor_configuration"]) == d["article_artifact_id"]
        assert all(extract.passage_id(d["article_artifact_id"], p["heading_path"], p["paragraph_ordinal"]) == p["passage_id"] for p in d["extracted_passages"])


def taken(spark, categories, nominations, most):
    listed = spark.createDataFrame([(c, i, n, *page) for i, (c, pages) in enumerate(categories) for n, page in enumerate(pages, 1)], "category string, category_ord int, page_ord int, page_id long, title string")
    named = spark.createDataFrame(list(enumerate(nominations)), "nomination_ord int, title string")
    return [(r["observed_page_id"], r["observed_page_title"]) for r in resolve.discover(listed, named, most).orderBy("ord").collect()]


def test_discovery_takes_no_keys_of_refused_pages(spark):
    categories = [("A", [(1, "Oslo"), (2, "OSLO"), (2, "Turku")]), ("Category:B", [(3, "turku"), (4, "Bergen_")])]
    assert taken(spark, categories, ["Bergen", "Malmö", "malmö"], 10) == [(1, "Oslo"), (2, "Turku"), (4, "Bergen"), (None, "Malmö")]
    assert taken(spark, categories[:1], ["x"], 1) == [(1, "Oslo")]
    assert taken(spark, categories, ["x"], 2) == [(1, "Oslo"), (3, "turku")]  # the first category's third page is never asked for
    assert taken(spark, [], [], 5) == []


def test_discovery_by_brute_force(spark):
    rng = random.Random(4)
    for most in (1, 3, 7, 20):
        categories = [(f"C{i}", [(rng.randrange(9), rng.choice("abcdefghij") * rng.randrange(1, 3)) for _ in range(rng.randrange(8))]) for i in range(5)]
        nominations = [rng.choice("klmnabc") for _ in range(5)]
        want, ids, titles = [], set(), set()
        for _, pages in categories:
            for page, title in pages[: most - len(want)]:
                if len(want) < most and page not in ids and title not in titles:
                    ids.add(page), titles.add(title), want.append((page, title))
        for title in nominations:
            if len(want) < most and title not in titles:
                titles.add(title), want.append((None, title))
        assert taken(spark, categories, nominations, most) == want


def test_redirects(spark):
    chain = [(f"n{i}", f"n{i + 1}") for i in range(1000)] + [("t0", "t1"), ("t1", "x"), ("x", "y"), ("y", "z"), ("z", "x"), ("s", "s")]
    edges = spark.createDataFrame([("a", "b"), ("b", "c"), *chain], "source_key string, target_key string")
    starts = spark.createDataFrame([("a",), ("c",), ("x",), ("t0",), ("n0",), ("n999",), ("s",), (None,)], "start_key string")
    got = {r["start_key"]: (r["target_key"], r["hops"], r["loop"]) for r in resolve.resolved(starts, edges).collect()}
    assert got == {"a": ("c", 2, False), "c": ("c", 0, False), "x": ("x", 3, True), "t0": ("x", 5, True), "n0": ("n1000", 1000, False), "n999": ("n1000", 1, False), "s": ("s", 1, True), None: (None, 0, False)}
    pages = spark.createDataFrame([("one", "Two#s", 1), ("One", "Three", 2), ("Z", None, 3)], "title string, redirect_target string, scan_pos long")
    assert [tuple(r) for r in resolve.redirect_edges(pages).collect()] == [("One", "Three")]
    whole = resolve.chains(spark.createDataFrame([("One", "one"), ("Q", "q")], "start_key string, title string"), resolve.redirect_edges(pages)).collect()
    assert {r["start_key"]: (r["target_title"], [tuple(s) for s in r["redirect_chain"]]) for r in whole} == {"One": ("Three", [("one", "Three")]), "Q": ("q", [])}


def test_acquisition_takes_the_last_and_says_why_not(spark):
    pages = spark.createDataFrame([
        (1, "Oslo", 0, 1, None), (2, "Kristiania", 0, 2, "Oslo#Name"), (3, "Loop A", 0, 3, "Loop B"), (4, "Loop B", 0, 4, "Loop A"), (5, "Gone", 0, 5, "Nowhere"),
        (6, "Talk:Oslo", 1, 6, None), (7, "oslo", 0, 7, None), (8, "To talk", 0, 8, "Talk:Oslo"),
    ], "scan_pos long, title string, namespace int, page_id long, redirect_target string")
    candidates = spark.createDataFrame([(0, "Kristiania", None), (1, "Absent", None), (2, "Oslo", None), (3, "Loop A", None), (4, "Gone", None), (5, "anything", 8)], "ord int, observed_page_title string, observed_page_id long")
    selected, failures = resolve.acquired(candidates, pages)
    assert [(r["observed_page_title"], r["page_id"], r["first_order"], r["redirect_chain"]) for r in selected.collect()] == [("Oslo", 7, 0, [])]
    assert [tuple(r)[1:] for r in failures.orderBy("place").collect()] == [
        ("Absent", "source scan", "candidate absent from source snapshot", True), ("Loop A", "redirect resolution", "redirect loop at Loop A", False),
        ("Gone", "redirect resolution", "redirect target absent from source snapshot", True), ("anything", "redirect resolution", "namespace 1 is outside namespace 0", False),
    ]


def test_undo_pairs_match_a_stack(spark):
    rng = random.Random(5)
    rows, want = [], {}
    for scope in range(6):
        stack = []
        for i in range(120):
            undo = rng.random() < 0.5
            rows.append((scope, i, undo))
            if undo:
                want[scope, i] = stack.pop() if stack else None
            else:
                stack.append(i)
    got = curation.undo_pairs(spark.createDataFrame(rows, "scope long, id long, undo boolean"), "scope").where("undo").collect()
    assert {(r["scope"], r["id"]): r["undone_id"] for r in got} == want


def _event(number, action, passage, label=None, prior=None):
    return {"id": number, "action": action, "passage_id": passage, "classification": label, "rubric_id": "r1", "question": "q", "evidence": "e", "semantic_answer": "s", "created_at": "2026-01-01T00:00:00Z", "supersedes_event_id": prior}


SESSION = {"singleton": 1, "current_passage_id": "p1", "current_undecided_passage_id": None, "current_deferred_passage_id": None}
META = {"corpus_fingerprint": "f", "rubric_id": "r1"}
LOG = [_event(1, "classify", "p1", LABELS[0]), _event(2, "defer", "p2"), _event(3, "classify", "p1", LABELS[1], 1), _event(4, "undo", "p1", None, 3), _event(5, "classify", "p2", LABELS[0], 2)]


def test_snapshot_round_trip_and_fold(spark, tmp_path):
    events = spark.createDataFrame([tuple(e[f] for f in snapshot.EVENT) for e in LOG], snapshot.EVENTS_SCHEMA)
    snapshot.export(META, events, SESSION, tmp_path / "s.jsonl", LABELS)
    first = (tmp_path / "s.jsonl").read_bytes()
    meta, back, session = snapshot.load(spark, tmp_path / "s.jsonl", LABELS)
    snapshot.export(meta, back, session, tmp_path / "s.jsonl", LABELS)
    assert (tmp_path / "s.jsonl").read_bytes() == first and meta == META and session == SESSION
    assert {r["passage_id"]: r["id"] for r in curation.effective(back).collect()} == {"p1": 1, "p2": 5}
    passages = spark.createDataFrame([("a1", "p2", 1), ("a1", "p1", 2)], "article_artifact_id string, passage_id string, source_pos int")
    assert [tuple(r) for r in release.selection(passages, back).collect()] == [("a1", ["p2", "p1"])]
    with pytest.raises(ValueError, match="incomplete"):
        release.selection(passages.unionByName(spark.createDataFrame([("a1", "p3", 3)], passages.schema)), back)
    with pytest.raises(ValueError, match="unknown"):
        release.selection(passages.limit(1), back)


@pytest.mark.parametrize("change", [
    lambda rows: rows.pop(0), lambda rows: rows.pop(), lambda rows: rows.insert(1, rows[-1]), lambda rows: rows[1].update(key="x"), lambda rows: rows[3].update(id=True),
    lambda rows: rows[3].update(id=0), lambda rows: rows[3].update(extra=1), lambda rows: rows[3].update(classification="x"), lambda rows: rows[4].update(classification=LABELS[0]),
    lambda rows: rows[5].update(supersedes_event_id=2), lambda rows: rows[6].update(supersedes_event_id=None), lambda rows: rows[3].update(rubric_id="r2"), lambda rows: rows[-1].update(singleton=True), lambda rows: rows[0].update(schema_version=2),
])
def test_snapshot_refuses(change):
    rows = [json.loads(x) for x in snapshot.lines_of(META, LOG, SESSION)]
    snapshot.validated([json.dumps(r) for r in rows], LABELS)
    change(rows)
    with pytest.raises(snapshot.SnapshotError):
        snapshot.validated([json.dumps(r) for r in rows], LABELS)


DUMP = "<mediawiki><siteinfo><dbname>wiki</dbname></siteinfo>\n<page><title>A b</title><ns>0</ns><id>1</id><revision><id>9</id><parentid>8</parentid><timestamp>t</timestamp><text xml:space=\"preserve\"> x &amp; y\n</text></revision></page>\n<page><title>R</title><ns>0</ns><id>2</id><redirect title=\"A b\" /><revision><id>10</id><timestamp>t</timestamp><text/></revision></page>\n<page><title>none</title><id>3</id></page></mediawiki>"


@pytest.mark.parametrize("packed", [False, True])
def test_dump(spark, tmp_path, packed):
    path = tmp_path / ("d.xml.bz2" if packed else "d.xml")
    path.write_bytes(bz2.compress(DUMP.encode()) if packed else DUMP.encode())
    dump.check(spark, str(path), "wiki")
    got = dump.pages(spark, str(path)).orderBy("scan_pos").collect()
    assert [(r["title"], r["page_id"], r["redirect_target"], r["raw_wikitext"], r["parent_revision_id"]) for r in got] == [("A b", 1, None, " x & y\n", 8), ("R", 2, "A b", "", None)]


@pytest.mark.parametrize("text", ["<mediawiki><siteinfo><dbname>other</dbname></siteinfo></mediawiki>", "<mediawiki><page></page></mediawiki>", DUMP.replace("</mediawiki>", ""), "<mediawiki><page></page><siteinfo><dbname>wiki</dbname></siteinfo></mediawiki>"])
def test_dump_refused(spark, tmp_path, text):
    (tmp_path / "d.xml").write_text(text)
    with pytest.raises(dump.SourceError):
        dump.check(spark, str(tmp_path / "d.xml"), "wiki")


def test_publication(spark, tmp_path):
    release.publish(tmp_path / "r", {"manifest.json": b"{}", "articles/a.json": b"1"})
    assert (tmp_path / "r/articles/a.json").read_bytes() == b"1"
    with pytest.raises(FileExistsError):
        release.publish(tmp_path / "r", {})
    assert release.write_once(tmp_path / "x", b"1") and not release.write_once(tmp_path / "x", b"1")
    with pytest.raises(FileExistsError):
        release.write_once(tmp_path / "x", b"2")
    rows = spark.createDataFrame([("a", "1"), ("b", "2")], "article_artifact_id string, document string")
    release.write_articles(rows, str(tmp_path / "t"))
    release.write_articles(rows, str(tmp_path / "t"))
    assert release.read_articles(spark, str(tmp_path / "t")).count() == 2
    with pytest.raises(FileExistsError):
        release.write_articles(rows.withColumn("document", F.lit("3")), str(tmp_path / "t"))


def test_backup(spark, tmp_path):
    (tmp_path / "a").write_bytes(b"[]")
    members = {p: tmp_path / "a" for p in ("data/discovery/b.json", "data/corpus/articles/a.json", *integrity.REQUIRED_PATHS)}
    archive = release.write_backup(tmp_path / "one", "v1", "0" * 40, {}, members)
    again = release.write_backup(tmp_path / "two", "v1", "0" * 40, {}, dict(reversed(members.items())))
    assert archive.name == "quillon-v1.tar.gz" and archive.read_bytes() == again.read_bytes()
    assert sorted(p.name for p in archive.parent.iterdir()) == [archive.name, f"{archive.name}.sha256"]
    assert [m["path"] for m in release.verify_backup(archive)["members"]] == sorted(members)
    rows = release.members_of(spark.read.format("binaryFile").load(str(archive))).orderBy("position").collect()
    assert [r["path"] for r in rows] == sorted([*members, release.MANIFEST]) and rows[1]["content"] == b"[]"
    with pytest.raises(FileExistsError):
        release.write_backup(tmp_path / "one", "v1", "0" * 40, {}, members)
    for label, head, held in (("a.tar.gz", "0" * 40, members), ("v1", "0" * 39, members), ("v2", "0" * 40, {**members, "data/x": tmp_path / "a"}), ("v2", "0" * 40, {"data/discovery/b.json": tmp_path / "a"})):
        with pytest.raises(ValueError):
            release.write_backup(tmp_path / "three", label, head, {}, held)
    assert not any((tmp_path / "three").glob("*"))  # nothing half done stays
    note = archive.with_name(archive.name + ".sha256")
    good = note.read_text()
    for text in (good.replace("  ", " "), "0" * 64 + good[64:], good.replace("v1", "v2"), good + "x"):
        note.write_text(text)
        with pytest.raises(ValueError):
            release.verify_backup(archive)
    for change in ({"schema_version": True}, {"label": "a..b"}, {"git_head": "x"}, {"members": []}, {"members": [{"path": "data/x", "size_bytes": 0, "sha256": "0" * 64}]}, {"source_snapshot": None}):
        document = {"schema_version": 1, "label": "v1", "git_head": "0" * 40, "source_snapshot": {}, "members": [{"path": p, "size_bytes": 2, "sha256": "0" * 64} for p in sorted(members)]}
        assert release.manifest_faults(document) == [] and release.manifest_faults(document | change)


def test_manifest_and_fingerprint():
    text = release.release_manifest("r1", {}, [{"canonical_title": "b", "article_artifact_id": "2", "lore_passage_ids": ["x"]}, {"canonical_title": "A", "article_artifact_id": "1", "lore_passage_ids": []}], [], {})
    assert [a["article_artifact_id"] for a in json.loads(text)["articles"]] == ["1", "2"]
    release.validate_release(text, text)
    for other in (text.replace("r1", "r2"), text + "\n"):
        with pytest.raises(ValueError):
            release.validate_release(text, other)
    assert release.fingerprint([("b", "1", []), ("A", "2", [])]) == release.fingerprint([("A", "2", []), ("b", "1", [])])


def test_integrity(spark):
    rows = spark.createDataFrame([("v1.0",), ("a..b",), ("x.tar.gz",), ("v1\n",), (None,)], "s string")
    assert [r[0] for r in rows.select(integrity.backup_label(F.col("s"))).collect()] == [True, False, False, False, None]
    found = integrity.violations(rows, F.col("s"), {"label": integrity.backup_label(F.col("s"))})
    assert found.count() == 4
    with pytest.raises(ValueError, match="label"):
        integrity.first_violation(found, ["label"])


def test_previous_values_across_parts(spark):
    rng = random.Random(6)
    rows = [(g, o, rng.choice([None, rng.randrange(50)])) for g in ("a", "b", None) for o in rng.sample(range(200), 60)]
    got = integrity.with_previous(spark.createDataFrame(rows, "g string, o long, v long"), "g", "o", "v", "before", 16).collect()
    want = {}
    for g in ("a", "b", None):
        last = None
        for _, o, v in sorted((r for r in rows if r[0] == g), key=lambda r: r[1]):
            want[g, o], last = last, v
    assert {(r["g"], r["o"]): r["before"] for r in got} == want
