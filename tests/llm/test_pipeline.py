"""The pipeline stage by stage, each on what the one before kept, against plain versions of the stages."""

from __future__ import annotations

import random
from collections import Counter
from pathlib import Path

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from quillon.llm import decontaminate, mixing, ngram_join, pii, quality, store

DATA = Path("/root/testdata/sf0.001")
WORDS = [f"w{i}" for i in range(300)]
ITEM = "Alice went to the market and bought 12 apples for 30 cents then Bob sold her 12 pears near the river"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score string, drop_id long, mix_slot string, n_email string, code long"


def rows() -> list[tuple]:
    rng = random.Random(8)
    say = lambda n, bad=False: " ".join(w.upper() + "!!" if bad else w for w in rng.choices(WORDS, k=n))
    base = say(60)
    texts = [None, "", " \n", base, base, base + " tail", say(30) + " " + ITEM, say(20) + " " + ITEM.replace("12", "17").replace("Bob", "Carl"), "Mail me@site.org or Mrs. Anna Berg. " + say(30), "x" * 30_000, say(5000)]
    texts += [say(50) for _ in range(60)] + [say(50, True) for _ in range(60)]
    out = [(i, t) for i, t in enumerate(texts)] + [(3, base), (3, say(40)), (None, say(30)), (None, None)]
    return [(i, t, "en", None if (i or 0) % 4 == 0 else f"s{(i or 0) % 4}", None if t is None else len(t), "s", 1, "m", "e", 2) for i, t in out]


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    where = str(tmp_path_factory.mktemp("tables"))
    spark.createDataFrame(rows(), SCHEMA).write.parquet(f"{where}/documents.parquet")
    spark.createDataFrame([(i, int(i < 71), 0) for i in range(11, 131)], "doc_id long, quality int, toxic int").write.parquet(f"{where}/labels.parquet")
    spark.createDataFrame([(1, ITEM), (2, None)], "item_id long, text string").write.parquet(f"{where}/benchmark.parquet")
    return where


def bag(frame, *columns) -> Counter:
    return Counter(tuple(r) for r in frame.select(*columns).collect())


def test_stages(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    columns = docs.columns
    own = ("doc_id", "text", "source")
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        before, docs = docs, store.table(stage(spark, docs, folder), f"test{k}")
        assert docs.columns[: len(columns)] == columns and (k == 4 or len(docs.columns) == len(columns)), name
        if k == 0:
            scored = quality.score(before, quality.train(before, spark.read.parquet(f"{folder}/labels.parquet")), out="own")
            assert bag(docs, *own) == bag(scored.where(F.col("own") >= quality.THRESHOLD), *own)
            kept = {r["doc_id"] for r in docs.collect()}
            assert {*range(3, 9)} <= kept and len(kept & {*range(71, 131)}) < 6 < 50 < len(kept & {*range(11, 71)})
        elif k == 1:
            sets = [(r["doc_id"], r["text"], {tuple((r["text"] or "").lower().split()[i : i + 5]) for i in range(max(1, len((r["text"] or "").split()) - 4))} if (r["text"] or "").split() else set()) for r in before.collect()]
            group = list(range(len(sets)))
            for a in range(len(sets)):
                for b in range(a):
                    both = len(sets[a][2] & sets[b][2])
                    if None not in (sets[a][0], sets[b][0]) and both and 100 * both >= 75 * len(sets[a][2] | sets[b][2]):
                        group = [group[b] if g == group[a] else g for g in group]
            stays = {g: min(sets[i][0] for i in range(len(sets)) if group[i] == g) for g in group if sets[g][0] is not None and sets[g][2]}
            left = Counter(r["doc_id"] for r in docs.collect())
            alone = Counter(s[0] for s in sets if s[0] is None or not s[2])
            assert left == alone + Counter(stays.values())
        elif k == 2:
            assert bag(before, *own) - bag(docs, *own) == Counter({key: n for key, n in bag(before, *own).items() if "market" in (key[1] or "")})
        elif k == 3:
            made = pii.checked_surrogates(before, pii.key_of(spark))
            assert bag(docs, *own) == Counter({(i, made.rewrite(t)[0], s): n for (i, t, s), n in bag(before, *own).items()})
            assert all(r["n_chars"] == (None if r["text"] is None else len(r["text"])) for r in docs.collect())
            assert not any("site.org" in (r["text"] or "") and "me@" in r["text"] or "Berg" in (r["text"] or "") for r in docs.collect())
        else:
            assert bag(docs, *own) == bag(before, *own) and "mix_slot_" in docs.columns
            assert all(r["mix_release"] <= r["mix_slot_"] < r["mix_deadline"] for r in docs.collect())


def test_stages_on_empty_tables(spark, folder, tmp_path):
    for name in ("labels", "benchmark"):
        spark.read.parquet(f"{folder}/{name}.parquet").limit(0).write.parquet(f"{tmp_path}/{name}.parquet")
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs.limit(0), folder).count() == 0
        assert stage(spark, docs.limit(0), str(tmp_path)).count() == 0
    assert corpus_pipeline.good_quality(spark, docs, str(tmp_path)).count() == docs.count()  # without labels every score is a half
    assert corpus_pipeline.without_benchmark(spark, docs, str(tmp_path)).count() == docs.count()


def test_run_is_its_stages(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        docs = store.table(stage(spark, docs, folder), f"again{k}")
    shared = Path(spark.conf.get("spark.checkpoint.dir").removeprefix("file://"))
    before = set(shared.iterdir())
    result = corpus_pipeline.run(spark, folder)
    assert {p.name.split("-")[0] for p in set(shared.iterdir()) - before} <= {f"stage{k}" for k in range(5)}  # nothing else is left
    assert bag(result, *docs.columns) == bag(docs, *docs.columns)


@pytest.mark.skipif(not DATA.exists(), reason="no tables")
def test_run_on_the_smallest_tables(spark):
    got = corpus_pipeline.run(spark, str(DATA))
    assert 0 < got.count() < spark.read.parquet(f"{DATA}/documents.parquet").count()
    assert set(mixing.ADDED) <= set(got.columns) and ngram_join.keep_one(got.drop(*mixing.ADDED)).count() == got.count()
    assert decontaminate.contaminated(got, spark.read.parquet(f"{DATA}/benchmark.parquet")).count() == 0
