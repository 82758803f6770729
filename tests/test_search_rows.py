"""A search writes no row for each pair of a question and a block, however many blocks have its terms."""

from __future__ import annotations

from quillon import scratch
from quillon.operators import retrieval


def test_rows_of_a_search(spark, monkeypatch):
    passages = spark.createDataFrame([(i, "common " + " ".join(f"w{j}" for j in range(i % 7))) for i in range(300)], "ordinal long, text string")
    questions = spark.createDataFrame([(f"q{i}", f"common w{i % 7} none") for i in range(40)], "question_id string, text string")
    index = scratch.table(retrieval.postings(passages, 2), "postings")
    written = []

    def counted(frame, name, own=scratch.table):
        out = own(frame, name)
        written.append(out.count())
        return out

    monkeypatch.setattr(scratch, "table", counted)
    found, work = retrieval.search(index, questions, 3, **({"width": 2} if "width" in retrieval.search.__code__.co_varnames else {}))
    assert {r["blocks"] for r in work.collect()} == {150} and found.count() == 120
    assert max(written) < 40 * 150
