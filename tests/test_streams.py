"""The decision log as a stream, progress of a scan, and the dump's index."""

from __future__ import annotations

import bz2
import random
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from quillon import scratch
from quillon.sources import dump, dump_index
from quillon.sources.progress import Progress
from quillon.streaming import decisions

KINDS = "log string, id long, action string, passage_id string, classification string, supersedes_event_id long"


def log_of(n, seed=6):
    draw = random.Random(seed)
    rows = []
    for i in range(1, n):
        name, passage = draw.choice(["A", "B", None]), draw.choice(["p", "q", None])
        own = [r for r in rows if r[0] == name and r[3] == passage and r[2] != "undo"]
        if own and draw.random() < 0.35:
            rows.append((name, i, "undo", passage, None, draw.choice(own[-3:])[1]))
        else:
            rows.append((name, i, draw.choice(["classify", "defer"]), passage, draw.choice(["x", "y"]), None))
    return rows


def held(frame):
    return sorted(map(tuple, frame.select("log", "passage_id", "id", "action", "classification").collect()), key=str)


@pytest.mark.parametrize("late", [False, True])
def test_the_stream_gives_what_the_whole_log_gives(spark, tmp_path, late):
    rows = log_of(120)
    if late:  # undo events may come before what they take back
        random.Random(1).shuffle(rows)
    at = lambda name: str(tmp_path / name)
    for k, part in enumerate((rows[:50], rows[50:51], rows[51:])):
        spark.createDataFrame(part, KINDS).coalesce(1).write.mode("append").parquet(at("in"))
        decisions.follow(spark, spark.readStream.schema(KINDS).parquet(at("in")), at("now"), at("state")).awaitTermination()
        so_far = spark.createDataFrame(rows[: (50, 51, 120)[k]], KINDS)
        assert held(decisions.effective_now(spark, at("now"))) == held(decisions.effective_in_batch(so_far))
    assert spark.read.schema(decisions.CHANGE).parquet(at("now/version=1")).count() <= 1  # a batch's work follows the batch


def test_a_batch_that_broke_off_runs_again_from_the_state_before_it(spark, tmp_path, monkeypatch):
    rows, at = log_of(90, 9), lambda name: str(tmp_path / name)
    for part in (rows[:40], rows[40:]):
        spark.createDataFrame(part, KINDS).coalesce(1).write.mode("append").parquet(at("in"))
        follow = lambda: decisions.follow(spark, spark.readStream.schema(KINDS).parquet(at("in")), at("now"), at("state")).awaitTermination()
        if part is not rows[:40] and part[0] == rows[40]:
            from pyspark.sql.readwriter import DataFrameWriter

            whole = DataFrameWriter.parquet

            def breaks(self, path, *given, **more):
                whole(self, path, *given, **more)
                raise OSError("gone after writing, before the batch was done")

            monkeypatch.setattr(DataFrameWriter, "parquet", breaks)
            with pytest.raises(Exception, match="gone after writing"):
                follow()
            monkeypatch.undo()
        follow()
    assert held(decisions.effective_now(spark, at("now"))) == held(decisions.effective_in_batch(spark.createDataFrame(rows, KINDS)))


def test_progress_is_told_while_a_scan_runs_and_counted_at_its_end(spark, tmp_path):
    spark.range(5000).repartition(5).write.parquet(str(tmp_path / "t"))
    said = []
    progress = Progress(spark, lambda step, n: said.append((step, n)), every=1000, poll=0.02)
    for _ in range(2):
        with progress.watch(spark.read.parquet(str(tmp_path / "t")), even=F.col("id") % 2 == 0) as rows:
            assert rows.groupBy((F.col("id") % 3).alias("r")).count().count() == 3
        assert progress.final == {"rows": 5000, "even": 2500}
    assert said == [(s, n) for s in (1, 2) for n in range(0, 6000, 1000)]
    with pytest.raises(ZeroDivisionError), progress.watch(spark.range(3)) as rows:
        rows.collect()
        raise ZeroDivisionError


def page(i, text):
    return f"<page><title>Page {i}</title><ns>0</ns><id>{i}</id><revision><id>{i + 1}</id><timestamp>t</timestamp><text>{text}</text></revision></page>\n"


@pytest.fixture(scope="module")
def big_dump(tmp_path_factory):
    draw = random.Random(3)
    texts = {i: "".join(draw.choice("abcdefgh éß王") for _ in range(draw.choice([5, 900, 9000, 60_000]))) for i in range(1, 140)}
    texts[50] = "long " * 120_000  # more than a block
    whole = "<mediawiki><siteinfo><dbname>w</dbname></siteinfo>" + "".join(page(i, t) for i, t in texts.items()) + "</mediawiki>"
    path = tmp_path_factory.mktemp("dump") / "d.xml.bz2"
    half = len(whole) // 2
    path.write_bytes(bz2.compress(whole[:half].encode(), 1) + bz2.compress(whole[half:].encode(), 2))  # two streams
    return path, texts


@pytest.mark.parametrize("size", [20_000, 150_000, 1 << 23])
def test_the_index_finds_every_page_whatever_the_partitions(spark, big_dump, size):
    path, texts = big_dump
    rows = dump_index.records(spark, [str(path)], size)
    values = [r["value"] for r in rows.orderBy("block", "offset").collect()]
    plain = bz2.decompress(path.read_bytes()).decode().split("</page>")
    assert values == plain
    directory = dump_index.write(spark, [f"file://{path}"], scratch.new_path(spark, "directory"), size)
    assert sorted(r["page_id"] for r in directory.collect()) == sorted(texts)
    found = dump_index.fetch(directory.where("page_id in (1, 50, 51, 139)")).collect()
    assert {r["page_id"]: r["raw_wikitext"].strip() for r in found} == {i: texts[i].strip() for i in (1, 50, 51, 139)}


def test_fetching_reads_less_than_the_dump(spark, tmp_path):
    draw = random.Random(2)
    path = tmp_path / "d.xml.bz2"
    path.write_bytes(bz2.compress(("<mediawiki>" + "".join(page(i, "".join(draw.choices("abcdefghijklmnop", k=40_000))) for i in range(400)) + "</mediawiki>").encode(), 1))
    directory = dump_index.write(spark, [str(path)], scratch.new_path(spark, "directory"))
    took = dump_index.fetch(directory.where("page_id = 7")).selectExpr("sum(bytes_read)").first()[0]
    assert 0 < took < 0.3 * path.stat().st_size


def test_marks_at_every_bit_and_broken_dumps(spark, big_dump, tmp_path):
    for shift in range(8):
        data = (0b1 << (48 + 16) | dump_index.BLOCK << 16 | 0xABCD) << (7 - shift)
        raw = data.to_bytes(12)
        assert [b for b, _ in dump_index.marks(raw)] == [f"{int.from_bytes(raw):096b}".index(f"{dump_index.BLOCK:048b}")]
    path, _ = big_dump
    cut = tmp_path / "cut.bz2"
    cut.write_bytes(path.read_bytes()[:200_000])
    with pytest.raises(Exception, match="cut short|broken block"):
        dump_index.records(spark, [str(cut)]).count()
    other = tmp_path / "other.bz2"
    other.write_bytes(bz2.compress(b"<mediawiki>" + page(1, "x").encode() + b"</mediawiki>"))
    directory = dump_index.write(spark, [str(other)], scratch.new_path(spark, "directory"))
    Path(other).write_bytes(bz2.compress(b"changed since"))
    with pytest.raises(Exception, match="not what was indexed"):
        dump_index.fetch(directory).collect()


def test_a_check_tells_its_counts(spark, tmp_path):
    path = tmp_path / "d.xml"
    path.write_text("<mediawiki><siteinfo><dbname>w</dbname></siteinfo>" + page(1, "a") + page(2, "b") + "</mediawiki>")
    progress = Progress(spark)
    dump.check(spark, str(path), "w", progress)
    assert progress.final["pages"] == 2 and progress.final["redirects"] == 0
