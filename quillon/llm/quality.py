"""Quality classifier: naive Bayes features in a linear support vector machine.

Word and word-pair indicators are hashed to a fixed number of buckets, scaled by the log ratio of
their class counts, and weighed by a hinge-loss linear model fitted with dual coordinate descent. The
fit uses a bounded sample of labelled rows; scoring is one pass over all texts with the weight vector,
whose size is fixed.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import blocks

BUCKET_BITS = 18
SAMPLE_PER_CLASS = 3000  # labelled rows of each class that the fit uses at most
THRESHOLD = 0.3
FOLDS = 3


@dataclass
class Model:
    weights: np.ndarray  # float32, one for each bucket
    bias: float
    slope: float  # margin to log odds
    shift: float


def features(part: blocks.Slice) -> tuple[np.ndarray, np.ndarray]:
    """(row, bucket) of the distinct words and word pairs of each row, ordered by row."""
    found = blocks.words(part)
    codes = blocks.word_hashes(part.data, found)
    row = found.row()
    pairs = blocks.window_hashes(codes, 2)
    inside = row[:-1] == row[1:]
    shift = np.uint64(64 - BUCKET_BITS)
    keys = np.concatenate([(row << BUCKET_BITS) | (codes >> shift).astype(np.int64), (row[:-1][inside] << BUCKET_BITS) | (pairs[inside] >> shift).astype(np.int64)])
    keys = np.unique(keys)
    return keys >> BUCKET_BITS, keys & ((1 << BUCKET_BITS) - 1)


def _log_ratios(docs: list[np.ndarray], labels: np.ndarray) -> np.ndarray:
    size = 1 << BUCKET_BITS
    counts = [np.bincount(np.concatenate([d for d, y in zip(docs, labels, strict=True) if y == side] or [np.zeros(0, np.int64)]), minlength=size) + 1.0 for side in (1, -1)]
    return np.log((counts[0] / counts[0].sum()) / (counts[1] / counts[1].sum()))


def descend(docs: list[np.ndarray], labels: np.ndarray, scale: np.ndarray, cost: float = 1.0, rounds: int = 12, seed: int = 7) -> tuple[np.ndarray, float]:
    """Dual coordinate descent for the L1 hinge loss; returns (weights over scaled indicators, bias)."""
    values = [scale[d] / np.sqrt(max(1, len(d))) for d in docs]
    square = np.array([v @ v + 1.0 for v in values])
    alpha = np.zeros(len(docs))
    weights, bias = np.zeros(1 << BUCKET_BITS), 0.0
    rng = np.random.default_rng(seed)
    for _ in range(rounds):
        moved = 0.0
        for i in rng.permutation(len(docs)):
            slope = labels[i] * (weights[docs[i]] @ values[i] + bias) - 1
            new = min(max(alpha[i] - slope / square[i], 0.0), cost)
            if step := (new - alpha[i]) * labels[i]:
                weights[docs[i]] += step * values[i]
                bias += step
                moved = max(moved, abs(step))
                alpha[i] = new
        if moved < 1e-3:
            break
    return weights, bias


def _margins(docs: list[np.ndarray], weights: np.ndarray, bias: float) -> np.ndarray:
    return np.array([weights[d].sum() / np.sqrt(max(1, len(d))) + bias for d in docs])


def fit(docs: list[np.ndarray], quality: np.ndarray, share: float) -> Model:
    """share: of label 1 among all labelled rows, to which the log odds are corrected."""
    labels = np.where(quality == 1, 1.0, -1.0)
    if len(set(labels)) < 2:  # nothing to tell apart: the share is the score
        return Model(np.zeros(1 << BUCKET_BITS, np.float32), 0.0, 0.0, float(np.log((share + 1e-6) / (1 - share + 1e-6))))
    held = np.zeros(len(docs))
    fold = np.arange(len(docs)) % FOLDS
    for f in range(FOLDS):
        own = [docs[i] for i in np.flatnonzero(fold != f)]
        ratio = _log_ratios(own, labels[fold != f])
        w, b = descend(own, labels[fold != f], ratio)
        held[fold == f] = _margins([docs[i] for i in np.flatnonzero(fold == f)], w * ratio, b)
    up = (labels > 0).mean()
    weight = np.where(labels > 0, share / up, (1 - share) / (1 - up))
    slope, shift, target = 1.0, 0.0, (labels > 0).astype(float)
    for _ in range(50):  # logistic regression of the label on the held-out margin, by Newton's method
        p = 1 / (1 + np.exp(-np.clip(slope * held + shift, -30, 30)))
        x = np.stack([held, np.ones(len(held))])
        gradient = x @ (weight * (p - target)) + 1e-3 * np.array([slope, shift])
        hessian = (x * (weight * p * (1 - p))) @ x.T + 1e-3 * np.eye(2)
        slope, shift = np.array([slope, shift]) - np.linalg.solve(hessian, gradient)
    ratio = _log_ratios(docs, labels)
    w, b = descend(docs, labels, ratio)
    return Model((w * ratio).astype(np.float32), b, float(slope), float(shift))


def train(documents: DataFrame, labels: DataFrame, per_class: int = SAMPLE_PER_CLASS) -> Model:
    """Fit on the labelled rows outside the held-out fifth: of each class the per_class ids of least hash.

    Ids that are null, unlabelled or labelled both ways are not used; of an id on several texts the one of
    least hash is. What is collected are the texts' buckets, at most 1 MB a text.
    """
    known = labels.where("quality in (0, 1) and doc_id is not null").where(~held_out("doc_id")).groupBy("doc_id").agg(F.min("quality").alias("quality"), F.max("quality").alias("most")).where("quality = most")
    counts = {r["quality"]: r["n"] for r in known.groupBy("quality").agg(F.count("*").alias("n")).collect()}
    if not counts:
        return Model(np.zeros(1 << BUCKET_BITS, np.float32), 0.0, 0.0, 0.0)
    share = counts.get(1, 0) / sum(counts.values())
    sample = None
    for side in (0, 1):
        part = known.where(F.col("quality") == side).orderBy(F.xxhash64("doc_id"), "doc_id").limit(per_class).select(F.col("doc_id").alias("id"), "quality")
        sample = part if sample is None else sample.unionByName(part)
    # At most 2 * per_class rows: small enough to broadcast at every size of the input.
    texts = documents.select(F.col("doc_id").alias("id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).join(F.broadcast(sample), "id")
    texts = texts.groupBy("id", "quality").agg(F.min_by("text", F.xxhash64("text")).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in blocks.slices(batch.column(2)):
                row, bucket = features(part)
                cuts = np.searchsorted(row, np.arange(len(part) + 1))
                rows = slice(part.first, part.first + len(part))
                yield pa.RecordBatch.from_arrays([batch.column(0)[rows], batch.column(1)[rows], pa.array([bucket[a:b].astype(np.int32).tobytes() for a, b in zip(cuts[:-1], cuts[1:], strict=True)], pa.binary())], names=["id", "quality", "buckets"])

    got = texts.mapInArrow(run, "id long, quality int, buckets binary").toArrow().sort_by("id")
    docs = [np.frombuffer(x.as_py(), np.int32).astype(np.int64) for x in got.column("buckets")]
    return fit(docs, got.column("quality").to_numpy(), share)


def held_out(column: str):
    return F.pmod(F.crc32(F.col(column).cast("string")), F.lit(5)) == 0


def score(documents: DataFrame, model: Model, text_column: str = "text", out: str = "score") -> DataFrame:
    """documents with a score from 0 to 1 in a new last column; null and empty texts have the score of no features."""
    share = documents.sparkSession.sparkContext.broadcast(model)
    schema = T.StructType([*documents.schema.fields, T.StructField(out, T.DoubleType())])
    place = documents.columns.index(text_column)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = share.value
        for batch in batches:
            scores = np.zeros(len(batch))
            for part in blocks.slices(batch.column(place)):
                row, bucket = features(part)
                n = np.bincount(row, minlength=len(part))
                margin = np.bincount(row, m.weights[bucket], minlength=len(part)) / np.sqrt(np.maximum(n, 1)) + m.bias
                scores[part.first : part.first + len(part)] = 1 / (1 + np.exp(-np.clip(m.slope * margin + m.shift, -500, 500)))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(scores)], names=[*batch.schema.names, out])

    return documents.mapInArrow(run, schema)


def classify(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every row; a null id is not held out."""
    model = train(documents, labels)
    scored = score(documents.select("doc_id", F.col("text").cast("string").alias("text")), model)
    return scored.select("doc_id", F.coalesce(held_out("doc_id"), F.lit(False)).alias("held_out"), "score", F.when(F.col("score") >= THRESHOLD, 1).otherwise(0).alias("predicted"))


def keep_good(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of documents whose predicted quality is 1, all columns as they were.

    Null and empty texts have the score of no features, so either all of them stay or none. Repeated rows have
    equal scores. Without labels of both classes the share of the one is every text's score.
    """
    name = "score"
    while name in documents.columns:
        name += "_"
    return score(documents, train(documents, labels), out=name).where(F.col(name) >= THRESHOLD).select(*documents.columns)
