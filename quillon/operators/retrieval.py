"""Lexical retrieval over one release: an inverted index with block maxima, top-k search that skips blocks, and context.

An index is derived from a release's passages alone and may be thrown away. Passages are numbered in the release's
order and cut into blocks of near numbers; a term's postings are a row for each block, with the greatest impact in it.
A search first adds up those maxima, scores the few blocks that promise most, and then only those others that could
still hold one of the k best. What is skipped can't hold one, so the result is that of scoring every passage.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .. import scratch
from . import activation

TERM = "[\\p{L}\\p{N}]+"
K1, B = 1.2, 0.75
MICRO = 1_000_000  # impacts are whole millionths, so sums don't depend on their order
WIDTH = 4096  # passages of a block
LEAD = 4  # blocks that are scored before any is skipped
SPAN = 1 << 14  # passages whose postings a task holds at a time
GROUP = 1 << 20  # terms of the questions that it holds beside them, about
MOST_TASKS = 1 << 16
FORMAT = 1


class IndexUnavailable(RuntimeError):
    """There is no index that fits the active release. It is never taken for an empty result."""


def terms(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(TERM), F.lit(0))


def impact(tf: Column, length: Column, mean: Column, df: Column, n: Column) -> Column:
    """BM25's weight of a term in a passage, in whole millionths."""
    rarity = F.log(1 + (n - df + 0.5) / (df + 0.5))
    return F.round(MICRO * rarity * tf * (K1 + 1) / (tf + K1 * (1 - B + B * length / mean))).cast("long")


def postings(passages: DataFrame, width: int = WIDTH) -> DataFrame:
    """(term, block, best, hits) of passages (ordinal, text); hits are (ordinal, impact), best the greatest impact.

    A row never has more than `width` hits, however common its term is. Passages without terms have none.
    """
    rows = passages.select("ordinal", terms(F.col("text")).alias("terms"))
    whole = rows.agg(F.count("*").alias("n"), F.avg(F.size("terms")).alias("mean"))  # one row
    found = rows.select("ordinal", F.size("terms").alias("length"), F.explode("terms").alias("term"))
    found = found.groupBy("term", "ordinal", "length").agg(F.count("*").alias("tf"))
    blocks = found.groupBy("term", F.floor(F.col("ordinal") / width).alias("block")).agg(F.collect_list(F.struct("ordinal", "tf", "length")).alias("hits"))
    blocks = scratch.table(blocks, "postings")
    frequency = blocks.groupBy("term").agg(F.sum(F.size("hits")).alias("df"))
    blocks = blocks.join(frequency, "term").crossJoin(F.broadcast(whole))
    hits = F.transform("hits", lambda h: F.struct(h["ordinal"].alias("ordinal"), impact(h["tf"], h["length"], F.col("mean"), F.col("df"), F.col("n")).alias("impact")))
    return blocks.select("term", "block", F.array_max(F.transform(hits, lambda h: h["impact"])).alias("best"), hits.alias("hits"))


def write_index(passages: DataFrame, release_id: str, folder: str, width: int = WIDTH) -> None:
    """Write the index of a release's passages (ordinal, text) to a new folder.

    Rows lie in order of their term, with its Bloom filter, so that a search reads few of them. The file that
    says what the index is comes last: an index that broke off has none.
    """
    spark = passages.sparkSession
    rows = postings(passages, width).repartitionByRange("term", "block").sortWithinPartitions("term", "block")
    rows.write.option("parquet.bloom.filter.enabled#term", "true").parquet(f"{folder}/postings")
    about = {"format": FORMAT, "release_id": release_id, "width": width, "k1": K1, "b": B, "term": TERM}
    if not scratch.put_if_absent(spark, f"{folder}/index.json", json.dumps(about, sort_keys=True).encode()):
        raise FileExistsError(folder)


@dataclass
class Retrieval:
    """Search in the index at a folder, for whatever release is active in the registry when it is opened.

    A retrieval that was opened stays with its release if another is activated meanwhile. enabled=False is the
    condition without evidence: neither search nor context gives any.
    """

    postings: DataFrame
    release_id: str
    enabled: bool = True
    width: int = WIDTH

    @classmethod
    def open(cls, spark: SparkSession, folder: str, registry: str, enabled: bool = True) -> Retrieval:
        active = activation.active_release(spark, registry)
        if active is None:
            raise IndexUnavailable("no release is active")
        raw = scratch.read_bytes(spark, f"{folder}/index.json")
        if raw is None:
            raise IndexUnavailable(f"{folder} holds no whole index")
        about = json.loads(raw)
        own = {"format": FORMAT, "release_id": active, "width": about.get("width"), "k1": K1, "b": B, "term": TERM}
        if about != own:
            raise IndexUnavailable(f"the index of release {about.get('release_id')} doesn't fit the active release {active}")
        return cls(spark.read.parquet(f"{folder}/postings"), active, enabled, about["width"])

    def search(self, questions: DataFrame, k: int) -> DataFrame:
        found = search(self.postings, questions, k, width=self.width)[0]
        return found if self.enabled else found.limit(0)

    def context(self, hits: DataFrame, blocks: DataFrame, reach: int = 1) -> DataFrame:
        found = context(hits, blocks, reach)
        return found if self.enabled else found.limit(0)


class _Cell:
    """The postings of a span of blocks, and sums over those of a question's terms. Sums of whole millionths are exact in doubles."""

    def __init__(self, rows: pa.Table):
        term = rows["term"].combine_chunks().dictionary_encode()
        code = term.indices.to_numpy(zero_copy_only=False)
        order = np.argsort(code, kind="stable")
        self.starts = np.searchsorted(code[order], np.arange(len(term.dictionary) + 1))
        self.codes = {t: i for i, t in enumerate(term.dictionary.to_pylist())}
        self.blocks, self.block = np.unique(rows["block"].to_numpy()[order], return_inverse=True)
        self.best = rows["best"].to_numpy()[order]
        if "hits" in rows.column_names:
            hits = rows["hits"].combine_chunks().take(pa.array(order))
            self.ends = np.concatenate([[0], np.cumsum(pc.list_value_length(hits).to_numpy(zero_copy_only=False))])
            flat = hits.flatten()
            self.ordinals, self.ordinal = np.unique(flat.field("ordinal").to_numpy(), return_inverse=True)
            self.impact = flat.field("impact").to_numpy()

    def rows(self, terms: list[str]) -> np.ndarray:
        """Where the postings of a question's terms are."""
        own = [np.arange(self.starts[c], self.starts[c + 1]) for c in map(self.codes.get, terms) if c is not None]
        return np.concatenate(own) if own else np.empty(0, int)

    def bounds(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(which blocks have any of the postings, what a passage of each block can reach)."""
        n = len(self.blocks)
        return np.bincount(self.block[rows], minlength=n) > 0, np.bincount(self.block[rows], self.best[rows], n).astype(np.int64)

    def scores(self, rows: np.ndarray, wanted: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """(ordinals, scores) of the k best passages of the wanted blocks."""
        rows = rows[wanted[self.block[rows]]]
        sizes = self.ends[rows + 1] - self.ends[rows]
        at = np.repeat(self.ends[rows] - np.cumsum(sizes) + sizes, sizes) + np.arange(sizes.sum())
        found = self.ordinal[at]
        some = np.flatnonzero(np.bincount(found, minlength=len(self.ordinals)))
        score = np.bincount(found, self.impact[at], len(self.ordinals)).astype(np.int64)[some]
        if len(some) > k:
            good = score >= np.partition(score, -k)[-k]
            some, score = some[good], score[good]
        first = np.lexsort((some, -score))[:k]
        return self.ordinals[some[first]], score[first]


def _in_cells(index: DataFrame, asked: DataFrame, span: int, cells: int, hits: bool, run: Callable[[_Cell, dict], Iterator[tuple]], schema: str) -> DataFrame:
    """run(cell, question) for every span of blocks and every question (question_id, group, terms, ...), as rows.

    A task has a span and a group of questions at a time, so neither pairs of questions and blocks nor of questions and hits
    are ever rows. The work is their number all the same.
    """
    names = [c.split()[0] for c in schema.split(", ")]
    kinds = [pa.string() if c.split()[1] == "string" else pa.int64() for c in schema.split(", ")]

    def work(left: pa.Table, right: pa.Table) -> pa.Table:
        out: list[tuple] = []
        if left.num_rows:
            cell = _Cell(left)
            for question in right.to_pylist():
                out += run(cell, question)
        columns = list(zip(*out, strict=True)) or [()] * len(names)
        return pa.table([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=names)

    postings = index.select("term", "block", "best", *(["hits"] if hits else []), F.floor(F.col("block") / span).alias("span"))
    spans = postings.select("span").distinct()
    of = asked.select("group", F.explode("terms").alias("term")).distinct()
    left = postings.join(of, "term").repartition(cells, "span", "group")
    right = asked.withColumnRenamed("group", "group_").crossJoin(F.broadcast(spans.select(F.col("span").alias("span_"))))
    right = right.select(*[F.col(c).alias(c) for c in right.columns]).repartition(cells, "span_", "group_")
    return left.groupBy("span", "group").cogroup(right.groupBy("span_", "group_")).applyInArrow(work, schema)


def search(index: DataFrame, questions: DataFrame, k: int, lead: int = LEAD, width: int = WIDTH) -> tuple[DataFrame, DataFrame]:
    """The k best passages of each question (question_id, text) in an index of blocks of `width`, and how many blocks that took.

    (question_id, rank, ordinal, score): score is the sum of the impacts of the question's different terms, in millionths; of
    equal scores the least ordinal comes first; passages without any term of a question are no answer to it. And
    (question_id, blocks, scored): the blocks that have any of its terms, and those whose postings were read.
    """
    span = max(1, SPAN // width)
    said = questions.select("question_id", F.array_distinct(terms(F.col("text"))).alias("terms")).groupBy("question_id").agg(F.flatten(F.collect_list("terms")).alias("terms"))
    said = scratch.table(said.where(F.size("terms") > 0), "question_terms")
    size = said.agg(F.sum(F.size("terms"))).first()[0] or 0
    groups = 1 + size // GROUP
    said = said.withColumn("group", F.pmod(F.xxhash64("question_id"), F.lit(groups)))
    cells = min(MOST_TASKS, 2 * groups * max(1, index.select(F.floor(F.col("block") / span)).distinct().count()))

    def bounded(cell: _Cell, question: dict) -> Iterator[tuple]:
        has, bound = cell.bounds(cell.rows(question["terms"]))
        some = np.flatnonzero(has)
        for at in some[np.lexsort((some, -bound[some]))][:lead]:
            yield question["question_id"], int(cell.blocks[at]), int(bound[at]), len(some)

    def led(cell: _Cell, question: dict) -> Iterator[tuple]:
        wanted = np.isin(cell.blocks, question["lead"])
        if wanted.any():
            for ordinal, score in zip(*cell.scores(cell.rows(question["terms"]), wanted, k), strict=True):
                yield question["question_id"], int(ordinal), int(score)

    def rest(cell: _Cell, question: dict) -> Iterator[tuple]:
        rows = cell.rows(question["terms"])
        has, bound = cell.bounds(rows)
        wanted = has & ~np.isin(cell.blocks, question["lead"])
        if question["least"] is not None:
            wanted &= bound >= question["least"]
        if wanted.any():
            yield question["question_id"], None, None, int(wanted.sum())
            for ordinal, score in zip(*cell.scores(rows, wanted, k), strict=True):
                yield question["question_id"], int(ordinal), int(score), None

    def best(scores: DataFrame) -> DataFrame:
        rank = F.row_number().over(Window.partitionBy("question_id").orderBy(F.desc("score"), "ordinal"))
        return scores.withColumn("rank", rank).where(F.col("rank") <= k)

    name = f"question_id {said.schema['question_id'].dataType.simpleString().replace('bigint', 'long')}"
    ahead = scratch.table(_in_cells(index, said, span, cells, False, bounded, f"{name}, block long, bound long, n long"), "bounds")
    place = F.row_number().over(Window.partitionBy("question_id").orderBy(F.desc("bound"), "block"))
    first = ahead.withColumn("place", place).where(F.col("place") <= lead).groupBy("question_id").agg(F.collect_list("block").alias("lead"))
    work = ahead.select("question_id", F.floor(F.col("block") / span).alias("span"), "n").distinct().groupBy("question_id").agg(F.sum("n").alias("blocks"))
    said = scratch.table(said.join(first, "question_id"), "asked")
    first = scratch.table(best(_in_cells(index, said, span, cells, True, led, f"{name}, ordinal long, score long")), "lead")
    least = first.where(F.col("rank") == k).select("question_id", F.col("score").alias("least"))
    asked = said.join(least, "question_id", "left")
    found = scratch.table(_in_cells(index, asked, span, cells, True, rest, f"{name}, ordinal long, score long, n long"), "rest")
    more = found.groupBy("question_id").agg(F.sum("n").alias("more"))
    work = work.join(said.select("question_id", F.size("lead").alias("lead")), "question_id").join(more, "question_id", "left")
    work = work.select("question_id", "blocks", (F.col("lead") + F.coalesce("more", F.lit(0))).alias("scored"))
    found = first.select("question_id", "ordinal", "score").unionByName(found.where("ordinal is not null").select("question_id", "ordinal", "score"))
    return best(found).select("question_id", "rank", "ordinal", "score"), work


def context(hits: DataFrame, blocks: DataFrame, reach: int = 1) -> DataFrame:
    """hits (article_id, source_pos, ...) with previous and following: the passages next to each one.

    blocks: article_id, source_pos, section, admitted, text, with one row for each block of an article in order, excluded ones
    included. Context ends where the section ends, and at the first excluded block: it never passes over one. Texts
    are in order of the article. Neighbours are found by their position, so a long article is no task's burden.
    """
    steps = F.explode(F.array(*[F.lit(d) for d in range(-reach, reach + 1)]))
    rows = hits.select("article_id", "source_pos").distinct().select("article_id", F.col("source_pos").alias("own"), steps.alias("step"))
    near = rows.withColumn("source_pos", F.col("own") + F.col("step")).join(blocks.select("article_id", "source_pos", "section", "admitted", "text"), ["article_id", "source_pos"])
    near = near.groupBy("article_id", "own").agg(F.array_sort(F.collect_list(F.struct("step", "section", "admitted", "text"))).alias("near"))
    own = F.filter("near", lambda x: x["step"] == 0)[0]
    good = F.filter("near", lambda x: (x["admitted"]) & x["section"].eqNullSafe(own["section"]))
    reached = lambda side: F.filter(good, lambda x: (x["step"] * side > 0) & F.forall(F.sequence(F.lit(1), F.abs(x["step"])), lambda d: F.exists(good, lambda y: y["step"] == d * side)))
    texts = lambda side: F.transform(reached(side), lambda x: x["text"])
    near = near.select("article_id", F.col("own").alias("source_pos"), texts(-1).alias("previous"), texts(1).alias("following"))
    return hits.join(near, ["article_id", "source_pos"])
