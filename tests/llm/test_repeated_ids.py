"""One id on several texts, payloads or vectors: each row has its own result."""

from __future__ import annotations

import hashlib

import numpy as np
import pytest

from quillon.llm import decontaminate, multi_index, passage_dedup, substring_dedup, warc

sha = lambda t: hashlib.sha256(t.encode()).hexdigest()


@pytest.mark.parametrize("run", [substring_dedup.remove_repeated_bytes, passage_dedup.remove_repeated_passages])
def test_repeats_with_one_id_on_texts_of_equal_length(spark, run):
    same = " ".join(f"w{i}" for i in range(200))
    rows = [(1, "x y z"), (1, "p q r"), (1, "x y z"), (2, same), (2, same[::-1]), (3, same), (None, "gone")]
    found = run(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    got = sorted((r["doc_id"], r["n_removed"] > 0, r["kept_sha256"]) for r in found)
    assert got == sorted([(1, False, sha("x y z")), (1, False, sha("x y z")), (1, False, sha("p q r")), (2, True, sha("")), (2, False, sha(same[::-1])), (3, True, sha(""))])


def test_revisits_of_one_page_id_on_two_payloads(spark):
    a, b = "A" * 2000, "B" * 3000
    rows = [(5, a), (5, b), (3, a), (2, b), (5, "short"), (1, None)]
    found = warc.round_trip(spark.createDataFrame([(p, f"http://x/{p}", h) for p, h in rows], "page_id long, url string, html string")).collect()
    sha1 = lambda t: hashlib.sha1((t or "").encode()).hexdigest()
    got = sorted((r["page_id"], r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"] or 0) for r in found)
    assert got == sorted([(5, 2000, sha1(a), "response", 0), (5, 3000, sha1(b), "response", 0), (3, 2000, sha1(a), "revisit", 5), (2, 3000, sha1(b), "revisit", 5), (5, 5, sha1("short"), "response", 0), (1, 0, sha1(None), "response", 0)])


def test_a_clean_text_with_the_id_of_a_contaminated_one_stays(spark):
    item = "the quick red fox walked over eleven small hills and then slept under one very old oak tree"
    rows = [(1, f"before {item} after"), (1, "a clean text"), (None, item), (2, None), (3, "")]
    docs = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, row_code string")
    left = decontaminate.keep_clean(docs, spark.createDataFrame([(7, item)], "item_id long, text string"))
    assert left.columns == docs.columns
    assert sorted((r["doc_id"] or 0, r["text"] or "") for r in left.collect()) == sorted([(1, "a clean text"), (0, item), (2, ""), (3, "")])


def test_vectors_of_extreme_components(spark):
    rows = [(1, 1, [1e308, 1e308, 0.0]), (2, 1, [1.0, 1.0, 0.0]), (3, 1, [1e-200, 0.0, 0.0]), (4, 1, [1.0, 0.0, 0.0]), (4, 1, None), (5, None, [1.0, 0.0, 0.0]), (6, 1, [5e-324, 0.0, 0.0]), (7, 1, [float("inf"), 0.0, 0.0]), (8, 1, [0.0, 0.0, 0.0])]
    found = multi_index.near_vectors(spark.createDataFrame(rows, "vec_id long, label int, embedding array<double>")).collect()
    got = sorted((r["vec_id"], r["n_links"], r["component_id"]) for r in found)
    assert got == [(1, 1, 1), (2, 1, 1), (3, 2, 3), (4, 0, 4), (4, 2, 3), (5, 0, 5), (6, 2, 3), (7, 0, 7), (8, 0, 8)]


@pytest.mark.parametrize("codes", [3, 24, 200])
def test_cells_come_nearest_first_whatever_the_number_of_codes(codes):
    rng = np.random.default_rng(codes)
    index = multi_index.Index((rng.normal(size=(codes, 4)), rng.normal(size=(codes, 4))), 1)
    unit = rng.normal(size=(20, 8))
    first, second = index.distances(unit)
    every = (first[:, :, None] + second[:, None, :]).reshape(20, -1)
    for visits in (1, 2, 7, 50, codes * codes):
        cells = index.order(unit, min(visits, codes * codes))
        assert np.allclose(np.take_along_axis(every, cells, 1), np.sort(every, axis=1)[:, : cells.shape[1]])
