"""Near-duplicate vectors by an inverted multi-index.

Each half of the unit vectors has a codebook; a vector lies in the cell of its two codes. A query visits
cells in the order of their distance (the multi-sequence order) until it has visited as many as found
the target share of partners at the threshold, measured on a sample. Candidates are verified in double
precision. A pair counts when either end visits the other's cell.

Equal vectors are one entry with a count. Cells are dealt by label and first code to tasks, and large
ones to blocks, in which pairs are counted and contracted to stars, never listed.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import store

THRESHOLD = 0.98
TARGET = 0.995  # share of partners at the threshold that a query's own cells have to hold
SAMPLE = 8192  # vectors that the codebooks and the number of visits are fitted on; 16 for each code if that is more
CODES = 24  # of a codebook at least
MOST_CODES = 4096
CELL = 9  # vectors of the largest label that a cell holds on average, if MOST_CODES allow it
BLOCK = 1024  # entries of a cell group on either side of a block
_HOMES = "key long, label int, dim int, n long, vector binary, code1 int, code2 int, visits array<int>"


@dataclass
class Index:
    """Codebooks of one dimension and the cells to visit."""

    books: tuple[np.ndarray, np.ndarray]
    visits: int

    def distances(self, unit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        half = self.books[0].shape[1]
        out = []
        for x, book in ((unit[:, :half], self.books[0]), (unit[:, half:], self.books[1])):
            out.append((x * x).sum(1)[:, None] - 2 * x @ book.T + (book * book).sum(1))
        return out[0], out[1]

    def order(self, unit: np.ndarray, visits: int) -> np.ndarray:
        """For each vector its nearest cells (code1 * codes + code2), nearest first.

        Only cells (i, j) of sorted codes with (i + 1)(j + 1) <= visits can be among the nearest.
        """
        first, second = self.distances(unit)
        a, b = _nearest(first, visits), _nearest(second, visits)
        i, j = _candidates(a.shape[1], b.shape[1], visits)
        near = np.take_along_axis(first, a, 1)[:, i] + np.take_along_axis(second, b, 1)[:, j]
        best = np.argsort(near, axis=1, kind="stable")[:, :visits]
        return np.take_along_axis(a[:, i] * second.shape[1] + b[:, j], best, 1)


def _nearest(distance: np.ndarray, n: int) -> np.ndarray:
    """The n nearest codes of each vector in order, of equal ones the first: no more are sorted."""
    if n >= distance.shape[1]:
        return np.argsort(distance, axis=1, kind="stable")
    some = np.sort(np.argpartition(distance, n - 1, axis=1)[:, :n], axis=1)
    return np.take_along_axis(some, np.argsort(np.take_along_axis(distance, some, 1), axis=1, kind="stable"), 1)


@lru_cache(maxsize=64)
def _candidates(n: int, m: int, visits: int) -> tuple[np.ndarray, np.ndarray]:
    """Ranks (i, j) of codes whose cell may be among the nearest: some visits * log(visits) of them."""
    width = [min(m, visits // (i + 1)) for i in range(min(n, visits))]
    return np.repeat(np.arange(len(width)), width), np.concatenate([np.arange(w) for w in width])


def _codebook(points: np.ndarray, codes: int, seed: int) -> np.ndarray:
    rng = np.random.default_rng(seed)
    book = points[rng.choice(len(points), min(codes, len(points)), replace=False)].copy()
    for _ in range(12):
        norms = (book * book).sum(1)
        near = np.concatenate([(norms - 2 * points[at : at + 4096] @ book.T).argmin(1) for at in range(0, len(points), 4096)])
        sums, count = np.zeros_like(book), np.bincount(near, minlength=len(book))
        np.add.at(sums, near, points)
        book[count > 0] = sums[count > 0] / count[count > 0, None]
    return book


def fit(unit: np.ndarray, codes: int = CODES, threshold: float = THRESHOLD, target: float = TARGET) -> Index:
    """Codebooks of the sample, and the visits that find `target` of partners placed at the threshold."""
    half = (unit.shape[1] + 1) // 2
    index = Index((_codebook(unit[:, :half], codes, 1), _codebook(unit[:, half:], codes, 2)), 1)
    rng = np.random.default_rng(3)
    some = unit[:1024]
    noise = rng.normal(size=some.shape)
    noise -= (noise * some).sum(1, keepdims=True) * some
    norm = np.linalg.norm(noise, axis=1, keepdims=True)
    partner = threshold * some + np.sqrt(1 - threshold**2) * noise / np.where(norm > 0, norm, 1)
    cells = len(index.books[0]) * len(index.books[1])
    home = index.order(partner, 1)
    visits = 4
    while visits < cells:
        if (index.order(some, visits) == home).any(1).mean() >= target:
            break
        visits = min(cells, visits * 5 // 4 + 1)
    index.visits = min(visits, cells)
    return index


def _units(raw: list[bytes], kind: str) -> np.ndarray:
    x = np.frombuffer(b"".join(raw), kind).astype(np.float64).reshape(len(raw), -1)
    x = x / np.abs(x).max(axis=1, keepdims=True)  # a square of very large or small components is not a number of doubles
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _kind(embeddings: DataFrame) -> tuple[str, str]:
    """The element type that vectors keep, for numpy and for Spark: double where they come as double, else float."""
    return ("<f8", "array<double>") if embeddings.schema["embedding"].dataType.simpleString() == "array<double>" else ("<f4", "array<float>")


def vectors(embeddings: DataFrame) -> DataFrame:
    """(vec_id, label, dim, key, vector) of all rows; vector as bytes of its element type, null where it can't link."""
    kind, cast = _kind(embeddings)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for v, label, e in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                x = np.array(e if label is not None and e and None not in e else [], kind)
                rows.append((v, label, len(x), x.tobytes() if np.isfinite(x).all() and x.any() else None))
            cols = list(zip(*rows, strict=True)) or [()] * 4
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, [pa.int64(), pa.int32(), pa.int32(), pa.binary()], strict=True)], names=["vec_id", "label", "dim", "vector"])

    rows = embeddings.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("int").alias("label"), F.col("embedding").cast(cast).alias("embedding"))
    return rows.mapInArrow(run, "vec_id long, label int, dim int, vector binary").withColumn("key", F.xxhash64("label", "vector"))


def _least(first: np.ndarray, second: np.ndarray, n: int) -> np.ndarray:
    """Component numbers of n nodes under the pairs (first, second), first ascending."""
    label = np.arange(n)
    heads = np.flatnonzero(np.r_[True, first[1:] != first[:-1]])
    by = np.argsort(second, kind="stable")
    back = np.flatnonzero(np.r_[True, second[by][1:] != second[by][:-1]])
    while True:
        old = label.copy()
        label[first[heads]] = np.minimum(label[first[heads]], np.minimum.reduceat(label[second], heads))
        label[second[by][back]] = np.minimum(label[second[by][back]], np.minimum.reduceat(label[first[by]], back))
        label = label[label]
        if (label == old).all():
            return label


def _block(threshold: float, kind: str):
    """Links of one block: residents of a cell group against the queries that visit it."""

    def run(group: pa.Table) -> pa.Table:
        names = ("role", "key", "n", "code2", "home")
        role, key, n, code2, home = (group.column(c).to_numpy() for c in names)
        vector = _units(group.column("vector").to_pylist(), kind)
        asked = group.column("cells").to_pylist()
        residents, queries = np.flatnonzero(role == 0), np.flatnonzero(role == 1)
        count = np.zeros(len(key), np.int64)
        firsts, seconds = [], []
        wants: dict[int, list[int]] = {}
        for q in queries.tolist():
            for c in asked[q]:
                wants.setdefault(c, []).append(q)
        visits = {int(r): set(asked[r]) for r in residents}
        for c in np.unique(code2[residents]).tolist():
            own = residents[code2[residents] == c]
            askers = np.array(wants.get(c, []), np.int64)
            for at in range(0, len(askers), 512):
                some = askers[at : at + 512]
                i, j = np.nonzero(vector[some] @ vector[own].T >= threshold)
                i, j = some[i], own[j]
                other = key[i] != key[j]
                i, j = i[other], j[other]
                if not len(i):
                    continue
                np.add.at(count, i, n[j])
                back = np.fromiter((int(h) in visits[r] for h, r in zip(home[i].tolist(), j.tolist(), strict=True)), bool, len(i))
                np.add.at(count, j[~back], n[i[~back]])  # the resident does not visit the query's cell
                firsts.append(i)
                seconds.append(j)
        if firsts:
            i, j = np.concatenate(firsts), np.concatenate(seconds)
            order = np.argsort(i, kind="stable")
            star = _least(i[order], j[order], len(key))
        else:
            star = np.arange(len(key))
        some = np.flatnonzero((count > 0) | (star != np.arange(len(key))))
        return pa.Table.from_arrays([pa.array(key[some]), pa.array(count[some]), pa.array(key[star[some]])], names=["key", "links", "hub"])

    return run


def near_vectors(embeddings: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(vec_id, n_links, component_id, kept) of every row with an id.

    Null labels, and vectors that are null, empty, zero or hold null or non-finite components, link with
    nothing; vectors of different lengths never link. Repeated rows are copies that link. Equal vectors
    of one label always link. Rows whose id is null are left out.
    """
    spark = embeddings.sparkSession
    rows = embeddings.where("vec_id is not null")
    kind, _ = _kind(rows)
    every = store.table(vectors(rows), "vectors")
    valid = every.where("vector is not null")
    entries = valid.groupBy("key").agg(F.first("label").alias("label"), F.first("dim").alias("dim"), F.count("*").alias("n"), F.first("vector").alias("vector"), F.min("vec_id").alias("least"))
    entries = store.table(entries, "entries")
    indexes: dict[int, Index] = {}
    largest = entries.groupBy("dim", "label").agg(F.count("*").alias("n")).groupBy("dim").agg(F.max("n").alias("n"))
    for row in largest.orderBy("dim").collect():  # a row for each length
        # A label's cells grow with it, so a cell and what is compared with it do not. A bounded sample, of least hash.
        codes = min(MOST_CODES, max(CODES, math.isqrt(row["n"] // CELL)))
        sample = entries.where(F.col("dim") == row["dim"]).select("vector").orderBy(F.xxhash64("vector")).limit(max(SAMPLE, 16 * codes)).toArrow()
        indexes[row["dim"]] = fit(_units(sample.column(0).to_pylist(), kind), codes, threshold)
    share = spark.sparkContext.broadcast(indexes)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            dims = batch.column(2).to_numpy()
            for dim in np.unique(dims):
                part = batch.filter(pa.array(dims == dim))
                for at in range(0, len(part), 1024):
                    some = part.slice(at, 1024)
                    index = share.value[int(dim)]
                    cells = index.order(_units(some.column(4).to_pylist(), kind), index.visits).astype(np.int32)
                    width = len(index.books[1])
                    yield pa.RecordBatch.from_arrays([*some.columns, pa.array(cells[:, 0] // width), pa.array(cells[:, 0] % width), pa.array(list(cells), pa.list_(pa.int32()))], names=["key", "label", "dim", "n", "vector", "code1", "code2", "visits"])

    homes = entries.select("key", "label", "dim", "n", "vector").mapInArrow(place, _HOMES)
    homes = store.table(homes, "homes")
    wide = F.create_map(*[F.lit(x) for d, i in indexes.items() for x in (d, len(i.books[1]))]) if indexes else F.create_map(F.lit(0), F.lit(1))
    homes = homes.withColumn("width", wide[F.col("dim")])
    residents = homes.select("label", "dim", F.col("code1").alias("code"), F.lit(0).alias("role"), "key", "n", "vector", "code2", (F.col("code1") * F.col("width") + F.col("code2")).alias("home"), F.col("visits").alias("cells"))
    queries = homes.select("*", F.explode(F.array_distinct(F.transform("visits", lambda v: F.floor(v / F.col("width")).cast("int")))).alias("code"))
    queries = queries.select("label", "dim", "code", F.lit(1).alias("role"), "key", "n", "vector", "code2", (F.col("code1") * F.col("width") + F.col("code2")).alias("home"), F.transform(F.filter("visits", lambda v: F.floor(v / F.col("width")) == F.col("code")), lambda v: F.pmod(v, F.col("width")).cast("int")).alias("cells"))
    cell = ["label", "dim", "code"]
    parts = residents.groupBy(*cell).agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("sides"))
    asks = queries.groupBy(*cell).agg(F.ceil(F.count("*") / (4 * BLOCK)).cast("int").alias("asks"))
    parts = parts.join(asks, cell)
    both = residents.unionByName(queries).join(parts, cell)
    both = both.withColumn("side", F.explode(F.when(F.col("role") == 0, F.array(F.pmod("key", F.col("sides")).cast("int"))).otherwise(F.sequence(F.lit(0), F.col("sides") - 1))))
    both = both.withColumn("ask", F.explode(F.when(F.col("role") == 1, F.array(F.pmod("key", F.col("asks")).cast("int"))).otherwise(F.sequence(F.lit(0), F.col("asks") - 1))))
    block = both.select(*cell, "side", "ask", "role", "key", "n", "vector", "code2", "home", "cells")
    found = store.table(block.groupBy(*cell, "side", "ask").applyInArrow(_block(threshold, kind), "key long, links long, hub long"), "links")
    links = found.groupBy("key").agg(F.sum("links").alias("links"))
    label = store.components(found.select(F.col("key").alias("a"), F.col("hub").alias("b")))
    entry = entries.select("key", "n", "least").join(links, "key", "left").join(label, F.col("key") == F.col("node"), "left")
    entry = entry.select("key", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"), F.coalesce("label", "key").alias("label"), "least")
    least = entry.groupBy("label").agg(F.min("least").alias("component_id"))
    entry = entry.join(least, "label").select("key", "n_links", "component_id")
    linked = valid.select("vec_id", "key").join(entry, "key").select("vec_id", "n_links", "component_id")
    alone = every.where("vector is null").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return linked.unionByName(alone).withColumn("kept", F.col("vec_id") == F.col("component_id"))
