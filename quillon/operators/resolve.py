"""Candidates, redirects and what becomes of them."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .. import scratch
from ..functions import text as T

# What discovery and acquisition records say.
CATEGORY_ROUTE, NOMINATION_ROUTE, NOMINATION = "category or API", "human nomination", "operator nomination"
WIKI = "https://en.wikipedia.org/wiki/"
ABSENT = ("source scan", "candidate absent from source snapshot")
LOOP = ("redirect resolution", "redirect loop at ")
NO_TARGET = ("redirect resolution", "redirect target absent from source snapshot")


def category_url(name: Column) -> Column:
    return F.concat(F.lit(WIKI), T.quoted(T.category_title(name), ":_()"))


def discover(listings: DataFrame, nominations: DataFrame, most: int) -> DataFrame:
    """(ord, discovery_route, discovery_reference, observed_page_title, observed_page_id): bounded candidates.

    listings: category, category_ord, page_ord (from 1), page_id, title; nominations: nomination_ord, title.
    Categories come in order, and each gives no more of its pages than were missing before it; then
    single titles. A page is passed over when its id or its folded title was taken before; what is
    passed over takes neither. Only the first `most` pages of a category can matter, so what is folded in one
    task is bounded by categories x most, and by most nominations of different titles.
    """
    title = T.normalized_title(F.col("title"))
    pages = listings.withColumn("rank", F.row_number().over(Window.partitionBy("category_ord").orderBy("page_ord"))).where(F.col("rank") <= most)
    pages = pages.select(F.lit(0).alias("phase"), F.col("category_ord").cast("long").alias("a"), F.col("rank").cast("long").alias("b"), category_url(F.col("category")).alias("reference"), F.col("page_id").cast("long").alias("page_id"), title.alias("title"))
    named = nominations.select(F.lit(1).alias("phase"), F.lit(0).cast("long").alias("a"), F.col("nomination_ord").cast("long").alias("b"), F.lit(NOMINATION).alias("reference"), F.lit(None).cast("long").alias("page_id"), title.alias("title"))
    rows = pages.unionByName(named).withColumn("folded", T.casefold("title"))
    # Of nominations of one title the first stands for all; a category's pages are bounded above.
    rows = rows.withColumn("again", F.row_number().over(Window.partitionBy("phase", F.when(F.col("phase") == 1, F.col("folded")).otherwise(F.concat_ws(",", "a", "b"))).orderBy("b"))).where("again = 1")
    order = Window.partitionBy("phase", "a").orderBy("b")
    rows = rows.withColumn("place", F.row_number().over(order)).where((F.col("phase") == 0) | (F.col("place") <= 2 * most))
    rows = rows.select("phase", "a", "b", "reference", "page_id", "title", "folded")

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, before, ids, titles, out = -1, 0, set(), set(), []
        for batch in batches:
            for phase, a, b, reference, page_id, title, folded in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if phase == 0 and a != at:
                    at, before = a, len(out)
                room = len(out) < most and (phase == 1 or b <= most - before)
                if room and folded not in titles and (page_id is None or page_id not in ids):
                    titles.add(folded)
                    ids.add(page_id)
                    out.append((len(out), NOMINATION_ROUTE if phase else CATEGORY_ROUTE, reference, title, page_id))
        if out:
            kinds = [pa.int64(), pa.string(), pa.string(), pa.string(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)], names=["ord", "discovery_route", "discovery_reference", "observed_page_title", "observed_page_id"])

    bounded = rows.repartition(1).sortWithinPartitions("phase", "a", "b")
    return bounded.mapInArrow(fold, "ord long, discovery_route string, discovery_reference string, observed_page_title string, observed_page_id long")


def last_per(rows: DataFrame, keys: list[str], order: str) -> DataFrame:
    """The row of greatest order for each key."""
    rest = [c for c in rows.columns if c not in keys]
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.col(order)).alias("x")).select(*keys, "x.*")


def redirect_edges(pages: DataFrame) -> DataFrame:
    """(source_key, target_title) of pages (title, redirect_target, scan_pos); the last of a key wins."""
    edges = pages.where("redirect_target is not null and redirect_target <> ''").select(T.title_key(F.col("title")).alias("source_key"), T.redirect_title(F.col("redirect_target")).alias("target_title"), "scan_pos")
    return last_per(edges, ["source_key"], "scan_pos").drop("scan_pos")


def _kept(frame: DataFrame) -> DataFrame:
    return scratch.table(frame, "kept")


def _jumped(edges: DataFrame) -> tuple[DataFrame, bool]:
    """(key, far, steps, moves) of edges (key, far), and whether what still moves does so for ever, all of it on cycles.

    Pointers double: each round joins every key with the key that its own pointer reaches, so a chain of n
    steps takes log2(n) rounds of rows of fixed size. A longer chain would have an end that stops in the next
    round, and a longer tail of a cycle an end that no pointer reaches any more; so when as many keys move as
    before, and reach as many keys, every pointer that moves is on its cycle.
    """
    jumps, before = edges.select("key", "far", F.lit(1).cast("long").alias("steps")), None
    while True:
        beyond = jumps.select(F.col("key").alias("mid"), F.col("far").alias("far2"), F.col("steps").alias("steps2"))
        step = jumps.join(beyond, F.col("far") == F.col("mid"), "left")
        moves = F.col("far2").isNotNull()
        jumps = _kept(step.select("key", F.coalesce("far2", "far").alias("far"), (F.col("steps") + F.coalesce("steps2", F.lit(0))).alias("steps"), moves.alias("moves")))
        now = jumps.where("moves").agg(F.count("*").alias("keys"), F.count_distinct("far").alias("reached")).first()
        if not now["keys"] or now == before:
            return jumps, bool(now["keys"])
        jumps, before = jumps.select("key", "far", "steps"), now


def _rings(edges: DataFrame) -> DataFrame:
    """(node, length) of edges (key, far) that are cycles: the least key of each travels around it, in doubling steps."""
    total, reach = edges.count(), 1
    rings = edges.select("key", "far", F.least("key", "far").alias("label"))
    while reach < total:
        beyond = rings.select(F.col("key").alias("mid"), F.col("far").alias("far2"), F.col("label").alias("label2"))
        step = rings.join(beyond, F.col("far") == F.col("mid"))
        step = _kept(step.select("key", F.col("far2").alias("far"), F.least("label", "label2").alias("new"), "label"))
        reach *= 2
        done = step.where("new <> label").isEmpty()
        rings = step.select("key", "far", F.col("new").alias("label"))
        if done:  # no node saw a smaller key over as many steps again
            break
    return rings.join(rings.groupBy("label").agg(F.count("*").alias("length")), "label").select(F.col("key").alias("node"), "length")


def resolved(starts: DataFrame, edges: DataFrame) -> DataFrame:
    """(start_key, target_key, hops, loop) by following edges (source_key, target_key) from starts (start_key).

    In a loop the target is the first key that comes again, and hops count the steps until it does.
    """
    edges = _kept(edges.select(F.col("source_key").alias("key"), F.col("target_key").alias("far")))
    jumps, loops = _jumped(edges)
    ends = jumps.select("key", "far", "steps", F.lit(False).alias("loop"))
    if loops:  # after so many steps what still moves is on a cycle, and every key of a cycle is met
        inside = _kept(jumps.where("moves").select(F.col("far").alias("node")).distinct())
        rings = _rings(edges.join(inside, F.col("key") == F.col("node"), "left_semi"))
        tails, _ = _jumped(edges.join(inside, F.col("key") == F.col("node"), "left_anti"))
        tails = tails.select("key", "far", "steps").unionByName(inside.select(F.col("node").alias("key"), F.col("node").alias("far"), F.lit(0).cast("long").alias("steps")))
        ends = tails.join(rings, F.col("far") == F.col("node"), "left").select("key", "far", (F.col("steps") + F.coalesce("length", F.lit(0))).alias("steps"), F.col("length").isNotNull().alias("loop"))
    out = starts.select("start_key").join(ends, F.col("start_key") == F.col("key"), "left")
    return out.select("start_key", F.coalesce("far", "start_key").alias("target_key"), F.coalesce("steps", F.lit(0)).cast("long").alias("hops"), F.coalesce("loop", F.lit(False)).alias("loop"))


def chains(starts: DataFrame, edges: DataFrame) -> DataFrame:
    """(start_key, target_title, redirect_chain) of starts (start_key, title) that are in no loop.

    redirect_chain has the (source_title, target_title) of every step. Starts are candidates, a bounded set:
    each step joins those that still move with the edges (source_key, target_title).
    """
    step = F.struct(F.col("target_title_").alias("source_title"), F.col("target_title").alias("target_title"))
    now = starts.select("start_key", F.col("title").alias("target_title_"), F.array().cast("array<struct<source_title:string,target_title:string>>").alias("redirect_chain"))
    done = None
    while True:
        both = _kept(now.join(edges, T.title_key(F.col("target_title_")) == F.col("source_key"), "left"))
        still = both.where("source_key is null").select("start_key", F.col("target_title_").alias("target_title"), "redirect_chain")
        done = still if done is None else done.unionByName(still)
        now = both.where("source_key is not null").select("start_key", F.col("target_title").alias("target_title_"), F.concat("redirect_chain", F.array(step)).alias("redirect_chain"))
        if now.isEmpty():
            return done


def matched(candidates: DataFrame, pages: DataFrame) -> DataFrame:
    """Candidates (ord, observed_page_id, title_key) with their page (page_id, title_key, namespace,
    scan_pos): by id, else by title; of several pages the last in scan order."""
    by_id = last_per(pages.select(F.col("page_id").alias("m_id"), "namespace", F.col("title_key").alias("page_key"), "scan_pos"), ["m_id"], "scan_pos")
    by_key = last_per(pages.select(F.col("title_key").alias("m_key"), "namespace", "page_id", "scan_pos"), ["m_key"], "scan_pos")
    out = candidates.join(by_id.select("m_id", F.struct(F.col("m_id").alias("page_id"), "namespace", "page_key").alias("a")), F.col("observed_page_id") == F.col("m_id"), "left")
    out = out.join(by_key.select("m_key", F.struct("page_id", "namespace", F.col("m_key").alias("page_key")).alias("b")), F.col("title_key") == F.col("m_key"), "left")
    return out.withColumn("page", F.coalesce("a", "b")).drop("a", "b", "m_id", "m_key")


def failure(page: Column, loop_at: Column, target: Column, namespace: Column) -> Column:
    """(stage, reason, recoverable) of why a candidate gives no article, or null; the first that holds.

    loop_at: the title at which a loop closes, or null.
    """
    why = lambda stage, reason, again: F.struct(F.lit(stage).alias("stage"), reason.alias("reason"), F.lit(again).alias("recoverable"))
    outside = F.concat(F.lit("namespace "), namespace, F.lit(" is outside namespace 0"))
    return (
        F.when(page.isNull(), why(ABSENT[0], F.lit(ABSENT[1]), True))
        .when(loop_at.isNotNull(), why(LOOP[0], F.concat(F.lit(LOOP[1]), loop_at), False))
        .when(target.isNull(), why(NO_TARGET[0], F.lit(NO_TARGET[1]), True))
        .when(namespace != 0, why("redirect resolution", outside, False))
    )


def collapsed_targets(rows: DataFrame, key: str, order: str) -> DataFrame:
    """One row for each target: that of the last candidate, in the place of the first."""
    rest = [c for c in rows.columns if c != key]
    return rows.groupBy(key).agg(F.max_by(F.struct(*rest), F.col(order)).alias("x"), F.min(order).alias("first_order")).select(key, "x.*", "first_order")


def acquired(candidates: DataFrame, pages: DataFrame, fetch: Callable[[DataFrame], DataFrame] | None = None) -> tuple[DataFrame, DataFrame]:
    """(selected, failures) of candidates (ord, observed_page_title, observed_page_id) in a dump's pages.

    selected: ord, observed_page_title, redirect_chain and the page's own columns, one row for each
    target. failures: candidate_identity, stage, reason, recoverable, in `place`: candidates without a
    page and loops as they come, then targets as they were first met. Of candidates that share a title or
    an id the last stands for all, and of two with one target too, which is no failure. With fetch, pages are a
    directory of narrow columns, and fetch gives whole pages of some of its rows by their scan_pos.
    """
    keyed = pages.withColumn("title_key", T.title_key(F.col("title")))
    own = candidates.withColumn("own_key", T.title_key(F.col("observed_page_title")))
    # Every page that a candidate names, by its id, else by its title; the page then speaks for that candidate's title.
    by_id = last_per(own.where("observed_page_id is not null").select(F.col("observed_page_id").alias("m_id"), F.col("own_key").alias("key_i"), "ord"), ["m_id"], "ord").drop("ord")
    by_key = last_per(own.select(F.col("own_key").alias("m_key"), "ord"), ["m_key"], "ord").drop("ord")
    met = keyed.select("page_id", "title", "title_key", "scan_pos").join(F.broadcast(by_id), F.col("page_id") == F.col("m_id"), "left").join(F.broadcast(by_key), F.col("title_key") == F.col("m_key"), "left")
    met = met.select(F.coalesce("key_i", "m_key").alias("own_key"), F.col("title").alias("page_title"), "scan_pos").where("own_key is not null")
    met = _kept(own.join(last_per(met, ["own_key"], "scan_pos").drop("scan_pos"), "own_key", "left").withColumn("start_key", T.title_key(F.col("page_title"))))
    edges = _kept(redirect_edges(pages))
    ways = resolved(met.where("start_key is not null").select("start_key").distinct(), edges.select("source_key", T.title_key(F.col("target_title")).alias("target_key")))
    met = met.join(ways, "start_key", "left")
    ends = chains(met.where("not loop").select("start_key", F.col("page_title").alias("title")).dropDuplicates(["start_key"]), edges)
    early = met.where("page_title is null or loop").withColumn("why", failure(F.col("page_title"), F.when(F.col("loop"), F.col("target_key")), F.lit("x"), F.lit(0)))
    # Two candidates of one target: the record of the last, in the place of the first.
    targets = met.where("not loop").join(ends, "start_key").select(T.title_key(F.col("target_title")).alias("wanted_key"), "ord", "observed_page_title", "redirect_chain")
    targets = _kept(collapsed_targets(targets, "wanted_key", "ord"))
    fetched = last_per(keyed.join(F.broadcast(targets.select("wanted_key")), F.col("title_key") == F.col("wanted_key"), "left_semi"), ["title_key"], "scan_pos")
    if fetch is not None:
        fetched = fetch(fetched).withColumn("title_key", T.title_key(F.col("title")))
    got = targets.join(fetched, F.col("wanted_key") == F.col("title_key"), "left").withColumn("why", failure(F.lit("x"), F.lit(None), F.col("title"), F.col("namespace")))
    columns = [F.col("observed_page_title").alias("candidate_identity"), "why.stage", "why.reason", "why.recoverable"]
    failures = early.select(F.struct(F.lit(0), "ord").alias("place"), *columns).unionByName(got.where("why is not null").select(F.struct(F.lit(0) + 1, F.col("first_order").alias("ord")).alias("place"), *columns))
    return got.where("why is null").drop("why", "wanted_key", "title_key"), failures
