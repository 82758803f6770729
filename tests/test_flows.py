"""The lifecycle from candidates to a verified backup, over files."""

from __future__ import annotations

import bz2
import io
import json
import subprocess
import urllib.error
from datetime import UTC, datetime
from email.message import Message
from types import SimpleNamespace

import pytest
from pyspark.sql import functions as F

from quillon import cli, cockpit, flows
from quillon.operators import checks, release
from quillon.sources import articles, snapshot, statefile, web

PAGE = "<page><title>{title}</title><ns>{ns}</ns><id>{id}</id>{redirect}<revision><id>{rev}</id><timestamp>2026-06-30T00:00:00Z</timestamp><text>{text}</text></revision></page>\n"
AT = datetime(2026, 7, 2, tzinfo=UTC)


def page(title, number, text="", redirect="", ns=0):
    return PAGE.format(title=title, ns=ns, id=number, rev=number + 100, text=text, redirect=f'<redirect title="{redirect}" />' if redirect else "")


@pytest.fixture
def repository(spark, tmp_path):
    """A repository whose data two candidates were acquired for."""
    dump = tmp_path / checks.PINNED["filename"]
    body = page("Oslo", 1, "A city.\n\n== History ==\nIt is old.\n\n{{Box}}") + page("Christiania", 2, redirect="Oslo") + page("Turku", 3, "A port.\n\n* a list")
    dump.write_bytes(bz2.compress(f"<mediawiki><siteinfo><dbname>enwiki</dbname></siteinfo>\n{body}</mediawiki>".encode()))
    root = tmp_path / "repository"
    listing = SimpleNamespace(articles=lambda category, limit: [(2, "Christiania"), (9, "CHRISTIANIA")][:limit])
    assert flows.discover(spark, root / "data/discovery/first.json", ["Cities"], ["Turku", "turku"], 10, listing, AT) == 2
    result = flows.acquire(spark, root / "data/discovery/first.json", dump, root / "data/corpus", AT)
    assert [s["candidate_title"] for s in result["successes"]] == ["Christiania", "Turku"] and result["failures"] == [] and result["scan_passes"] == 2
    return root


def decided(repository, spark, keys="lal"):
    folder, state = repository / "data/corpus/articles", repository.parent / "state.db"
    _, rows, mark = flows.corpus(spark, folder)
    statefile.bind(state, mark, cockpit.RUBRIC)
    shown = [cockpit.Shown(r["passage_id"], r["canonical_title"], tuple(r["heading_path"]), r["normalized_text"], r["article_artifact_id"], r["paragraph_ordinal"]) for r in rows.orderBy("article_ord", "source_pos").collect()]
    ticks = iter(range(0, 10_000, 2))
    screens = []
    made = cockpit.session(shown, state, "undecided", iter(keys), screens.append, clock=lambda: next(ticks))
    return folder, state, shown, made, screens


def test_lifecycle(spark, repository, tmp_path, capsys):
    folder, state, shown, made, screens = decided(repository, spark)
    assert [p.text for p in shown] == ["A city.", "It is old.", "A port."] and made == 3 and "passage 2/2, 2/3 in all" in screens[1]
    document = json.loads(sorted(folder.glob("*.json"))[0].read_text())
    assert set(document) == {x.split()[0] for x in articles.ARTICLE.replace("struct<", "<").split(", ") if not x.startswith("extractor_configuration")} | {"extractor_configuration"}
    first = {d["canonical_title"]: d for d in (json.loads(p.read_text()) for p in folder.glob("*.json"))}
    assert first["Oslo"]["redirect_chain"] == [{"source_title": "Christiania", "target_title": "Oslo"}] and first["Oslo"]["structural_exclusions"][0]["structure_type"] == "unresolved template"
    log = tmp_path / "curation.jsonl"
    assert cli.run(["export-curation", "--state-db", str(state), "--output", str(log)]).startswith("wrote")
    cli.run(["load-curation", "--input", str(log), "--state-db", str(tmp_path / "again.db")])
    assert statefile.read(tmp_path / "again.db") == statefile.read(state)
    with pytest.raises(FileExistsError):
        flows.load_curation(log.read_text().splitlines(), tmp_path / "again.db")

    out = tmp_path / "releases/r1/manifest.json"
    made_ = flows.create_release(spark, "r1", folder, log, out)
    assert made_["counts"] == {"articles": 2, "lore_passages": 2} and [a["canonical_title"] for a in made_["articles"]] == ["Oslo", "Turku"]
    assert flows.validate_release(spark, out, out.parent / "articles", out.parent / "curation.jsonl") == made_
    (out.parent / "articles/other.json").write_text("{}")  # no inventory names it
    assert flows.validate_release(spark, out, out.parent / "articles", log) == made_
    with pytest.raises(FileExistsError):
        flows.create_release(spark, "r1", folder, log, out)
    with pytest.raises(ValueError, match="release id"):
        flows.manifest(spark, "R1", folder, log)
    good = out.read_text()
    for text, why in ((good.replace('"r1"', '"r2"'), None), (good.replace('"lore_passages": 2', '"lore_passages": 3'), "follow"), (good + "\n", "canonical"), ("[]", "manifest"), (good.replace('"artifact_sha256": "', '"artifact_sha256": "0'), "inventory")):
        out.write_text(text)
        if why:
            with pytest.raises(ValueError, match=why):
                flows.validate_release(spark, out, folder, log)
        else:
            assert flows.validate_release(spark, out, folder, log)["release_id"] == "r2"

    git = lambda *a: subprocess.run(["git", "-c", "user.name=t", "-c", "user.email=t@t", *a], cwd=repository, check=True, capture_output=True)
    git("init"), git("add", "-A"), git("commit", "-m", "data")
    archive = flows.create_backup(spark, repository, "v1", tmp_path / "backups")
    assert release.verify_backup(archive)["git_head"] == flows.git_head(repository, False) and cli.run(["verify-backup", str(archive)]) == "v1 is sound"
    (repository / "data/note.txt").write_text("x")
    with pytest.raises(ValueError, match="changes"):
        flows.create_backup(spark, repository, "v2", tmp_path / "backups")
    assert flows.create_backup(spark, repository, "v2", tmp_path / "backups", dirty=True).exists()  # the note is in neither


def test_a_release_needs_every_decision(spark, repository, tmp_path):
    folder, state, shown, made, _ = decided(repository, spark, "ls")
    log = tmp_path / "curation.jsonl"
    statefile.export(state, log, flows.LABELS)
    with pytest.raises(ValueError, match="release: (deferred|undecided) passage"):
        flows.manifest(spark, "r1", folder, log)
    lines = log.read_text().replace(statefile.read(state)[0]["corpus_fingerprint"], "0" * 64)
    log.write_text(lines)
    with pytest.raises(ValueError, match="another corpus"):
        flows.manifest(spark, "r1", folder, log)


def test_session_keeps_cursors_apart_and_undoes(spark, repository):
    folder, state, shown, made, _ = decided(repository, spark, "ss u?q")
    assert made == 3 and statefile.read(state)[2]["current_undecided_passage_id"] == shown[1].passage_id
    assert cockpit.session(shown, state, "deferred", iter("l"), lambda s: None) == 1
    rows = statefile.read(state)[1]
    assert [(e["action"], e["supersedes_event_id"]) for e in rows] == [("defer", None), ("defer", None), ("undo", 2), ("classify", 1)]
    assert statefile.read(state)[2]["current_undecided_passage_id"] == shown[1].passage_id and statefile.read(state)[2]["current_deferred_passage_id"] is None
    with pytest.raises(statefile.StateError, match="rubric"):
        statefile.bind(state, statefile.read(state)[0]["corpus_fingerprint"], "other")
    with pytest.raises(statefile.StateError, match="corpus"):
        statefile.bind(state, "other", cockpit.RUBRIC)
    assert cockpit.Repeats(iter([0, 1, 2, 4, 4.1]).__next__).refused("l") is False
    hold = cockpit.Repeats(iter([0, 1, 2, 4, 4.1]).__next__)
    assert [hold.refused(k) for k in "lllld"] == [False, True, True, False, False]
    assert statefile.record(state, cockpit._event(shown[0], "u"), None) and statefile.record(state, cockpit._event(shown[0], "u"), None) and statefile.record(state, cockpit._event(shown[0], "u"), None) == 0


def test_evidence_is_the_same_as_of_frames(spark):
    from quillon.operators import curation

    shown = [cockpit.Shown(f"p{i}", f"T{i // 4}", ("Lead", "Ö"), f"text {i} " * (20 * (i % 3) + 1), f"a{i // 4}", i % 4 + 1) for i in range(10)]
    rows = spark.createDataFrame([(p.article_id, p.title, i, p.passage_id, list(p.path), p.ordinal, p.text) for i, p in enumerate(shown)], "article_id string, article_title string, source_pos int, passage_id string, heading_path array<string>, paragraph_ordinal int, text string")
    for wide in (False, True):
        got = {r["passage_id"]: r["evidence"] for r in curation.evidence_frames(rows, cockpit.RUBRIC, wide, 60).collect()}
        assert got == {p.passage_id: cockpit.evidence(shown, i, wide, 60) for i, p in enumerate(shown)}
    assert max(len(line) for line in cockpit.screen(shown, 4, "undecided", True, 10).split("\r\n")[4:-1]) <= 40


def test_state_of_one_cursor_is_upgraded(tmp_path):
    import sqlite3

    path = tmp_path / "old.db"
    db = sqlite3.connect(path)
    with db:
        db.execute("CREATE TABLE curation_meta (key TEXT, value TEXT)")
        db.execute(f"CREATE TABLE audit_events ({', '.join(snapshot.EVENT)})")
        db.execute("CREATE TABLE session_state (singleton, current_passage_id)")
        db.execute("INSERT INTO session_state VALUES (1, 'p1')")
    db.close()
    assert statefile.layout_violations(path) == [("columns", "session_state")]
    statefile.upgrade(path)
    assert statefile.layout_violations(path) == [] and statefile.read(path)[2]["current_undecided_passage_id"] == "p1"


BREAKS = {
    "page id": lambda d: d.update(page_id=0), "namespace": lambda d: d.update(namespace=1), "title": lambda d: d.update(canonical_title=""), "revision url": lambda d: d.update(permanent_revision_url="https://x/?oldid=1"),
    "history url": lambda d: d.update(history_url="x"), "revision timestamp": lambda d: d.update(revision_timestamp="2026-01-01"), "other source": lambda d: d["source_snapshot"].update(dump_run="1"), "other dump run": lambda d: d.update(dump_run="1"),
    "passage ordinal": lambda d: d["extracted_passages"][0].update(paragraph_ordinal=0), "passage heading path": lambda d: d["extracted_passages"][0].update(heading_path=[]), "passage structure": lambda d: d["extracted_passages"][0].update(structure="x"),
    "passage place twice": lambda d: d["extracted_passages"].append(dict(d["extracted_passages"][0], passage_id="p")), "redirect chain": lambda d: d.update(redirect_chain=[{"source_title": ""}]), "no object of JSON": lambda d: d.update(page_id="x"),
    "exclusions": lambda d: d.update(structural_exclusions=[{"heading_path": ["x"], "paragraph_ordinal": 0, "structure_type": "t", "reason": "r"}]), "passage of another article": lambda d: d["extracted_passages"][0].update(article_artifact_id="x"),
}


def test_every_rule_of_articles_is_seen(spark, repository, tmp_path):
    path = next(p for p in (repository / "data/corpus/articles").glob("*.json") if "Oslo" in p.read_text())
    source = json.loads((repository / "data/corpus/source/source-snapshot.json").read_text())
    seen = lambda f: {r["check_id"] for r in f.collect()}
    for i, (rule, change) in enumerate(BREAKS.items()):
        document = json.loads(path.read_text())
        change(document)
        (tmp_path / f"bad{i}").mkdir()
        (tmp_path / f"bad{i}" / path.name).write_text(json.dumps(document))
        files = articles.json_files(spark, str(tmp_path / f"bad{i}"), articles.ARTICLE)
        assert rule in seen(checks.backup_rules(files, articles.passages(files), source))
        if rule in ("passage ordinal", "passage heading path", "namespace"):
            assert seen(checks.curation_rules(files, articles.passages(files))) == set()  # curation allows these
    files = articles.json_files(spark, str(path.parent), articles.ARTICLE)
    assert seen(checks.backup_rules(files, articles.passages(files), source)) == set()
    twice = files.unionByName(files)
    assert {"article id twice", "passage id twice"} <= seen(checks.curation_rules(twice, articles.passages(twice)))


def test_results_and_discoveries(spark, tmp_path):
    source = {"a": "b"}
    good = {"schema_version": 1, "scan_passes": 2, "failures": [], "source_snapshot": source, "successes": [{"candidate_title": "t", "article_artifact_id": "a"}]}
    assert checks.result_faults(good, source) == []
    for change in ({"schema_version": True}, {"scan_passes": 1}, {"failures": [1]}, {"source_snapshot": {}}, {"successes": []}, {"successes": [{}]}, {"successes": good["successes"] * 2}):
        assert checks.result_faults(good | change, source)
    assert checks.discovery_faults({"schema_version": 1, "records": [{}]}) == []
    for bad in ([], {"schema_version": 2, "records": [{}]}, {"schema_version": 1, "records": []}, {"schema_version": 1, "records": [1]}):
        assert checks.discovery_faults(bad)
    (tmp_path / "d.json").write_text('{"schema_version": 2, "records": []}')
    with pytest.raises(ValueError):
        articles.discoveries(spark, str(tmp_path / "d.json"))
    articles.write_new(tmp_path / "n.json", {"b": 1, "a": "ü"})
    assert (tmp_path / "n.json").read_text() == '{\n  "a": "ü",\n  "b": 1\n}\n'
    with pytest.raises(FileExistsError):
        articles.write_new(tmp_path / "n.json", {})
    assert articles.write_result(tmp_path, "n", {}, lambda: "T1").name == "n-T1.json"


class Answer(io.BytesIO):
    def __init__(self, body, status=200, **headers):
        super().__init__(body)
        self.status, self.headers = status, {k.replace("_", "-"): v for k, v in headers.items()}


def test_download_goes_on_and_waits(tmp_path):
    target, asked, slept = tmp_path / "f.bz2", [], []
    headers = Message()
    headers["Retry-After"] = "5000"
    answers = [urllib.error.HTTPError("u", 503, "busy", headers, None), Answer(b"abc", Content_Length="6"), Answer(b"def", 206, Content_Range="bytes 3-5/6", Content_Length="3")]

    def open_(request, timeout):
        asked.append(request.get_header("Range"))
        answer = answers.pop(0)
        if isinstance(answer, Exception):
            raise answer
        return answer

    got = web.download("https://x/f.bz2", target, "me@x.org", open_, slept.append, rate=None)
    assert target.read_bytes() == b"abcdef" and got.resumed and asked == [None, None, "bytes=3-"] and slept == [900, 60]
    assert web.download("https://x/f.bz2", target, "me@x.org", open_).size == 6  # nothing is asked
    for answer in (Answer(b"def", 200), Answer(b"def", 206, Content_Range="bytes 0-5/6")):
        (tmp_path / "g.bz2.part").write_bytes(b"abc")
        answers[:] = [answer]
        with pytest.raises(web.Broken):
            web.download("https://x/g.bz2", tmp_path / "g.bz2", "me@x.org", open_, slept.append, (), None)
    answers[:] = [urllib.error.HTTPError("u", 404, "no", Message(), None)]
    with pytest.raises(urllib.error.HTTPError):
        web.download("https://x/h.bz2", tmp_path / "h.bz2", "https://me.org", open_, slept.append, rate=None)
    for url, contact in (("https://x/other", "a@b"), ("https://x/f.bz2", "nobody")):
        with pytest.raises(ValueError):
            web.download(url, target, contact, open_)


def test_listings_are_paced():
    slept, now = [], [0.0]
    listing = web.Paced(SimpleNamespace(articles=lambda c, n: ((i, f"t{i}") for i in range(100))), 1.5, lambda: now[0], slept.append)
    assert listing.articles("c", 0) == [] and len(listing.articles("c", 3)) == 3 and len(listing.articles("c", 2)) == 2 and slept == [1.5]
    with pytest.raises(ValueError):
        web.Paced(None, 0.5)


def test_commands_refuse(tmp_path, capsys, monkeypatch):
    for arguments in (["acquire", "--discoveries", "x", "--data-dir", "y", "--download-rate-mib", "33"], ["acquire", "--discoveries", "x", "--data-dir", "y", "--dump-path", "z"], ["verify-backup", str(tmp_path / "no")], ["curate", "--articles-dir", "x", "--state-db", "y"]):
        with pytest.raises(ValueError):
            cli.run(arguments)
    monkeypatch.setattr("sys.argv", ["quillon", "verify-backup", str(tmp_path / "no")])
    assert cli.main() == 1
    for most, categories in ((0, ["a"]), (501, ["a"]), (5, ["a"] * 21), (5, [])):
        with pytest.raises(ValueError):
            flows.discover(None, tmp_path / "d", categories, [], most, None, AT)


def test_next_passages(spark):
    from quillon.operators import curation

    rng = __import__("random").Random(3)
    positions = sorted(rng.sample(range(5000), 300))
    open_ = sorted(rng.sample(positions, 40))
    passages = spark.createDataFrame([(p,) for p in positions], "p long")
    rows = curation.next_after(passages, passages.where(F.col("p").isin(open_)), spark.createDataFrame([(p,) for p in [*positions, 7777]], "p long"), "p", 16).collect()
    assert {r["cursor"]: r["next_open"] for r in rows} == {c: next((o for o in open_ if o > c), open_[0]) if c in positions else open_[0] for c in [*positions, 7777]}
    decisions = spark.createDataFrame([(positions[0], "defer"), (positions[1], "classify")], "p long, action string")
    assert curation.open_passages(passages, decisions, "p").count() == 298 and [r["p"] for r in curation.open_passages(passages, decisions, "p", "deferred").collect()] == [positions[0]]
    assert curation.open_passages(passages, decisions, "p", "deferred", passages.limit(1)).count() == 0
    events = spark.createDataFrame([(1, "classify", "a", None), (2, "defer", "a", None), (3, "undo", "a", 2), (4, "classify", "a", None), (5, "classify", "b", None)], "id long, action string, passage_id string, supersedes_event_id long")
    assert {r["id"]: r["prior_id"] for r in curation.prior_links(events).collect()} == {1: None, 2: 1, 4: 1, 5: None}
