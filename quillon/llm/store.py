"""Written tables in the folder that all executors share, and components over edge tables."""

from __future__ import annotations

import contextlib
from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..scratch import new_path, remove, shared_folder  # noqa: F401

_made: dict[str, set[str]] = {}


def table(frame: DataFrame, name: str) -> DataFrame:
    """frame written once and read back: its lineage ends here, and lost executors cost no recomputation."""
    spark = frame.sparkSession
    path = new_path(spark, name)
    _made.setdefault(spark.sparkContext.applicationId, set()).add(path)
    frame.write.parquet(path)
    return spark.read.schema(frame.schema).parquet(path)


@contextlib.contextmanager
def scope(spark: SparkSession) -> Iterator[Callable[[DataFrame], DataFrame]]:
    """Delete the tables written inside when it ends, but for those that the frames given to it read.

    Frames that read the others can't be used any more.
    """
    made = _made.setdefault(spark.sparkContext.applicationId, set())
    before, kept = set(made), []

    def keep(frame: DataFrame) -> DataFrame:
        kept.append(frame)
        return frame

    yield keep
    files = [f for frame in kept for f in frame.inputFiles()]
    for path in made - before:
        if not any(f"/{path.rsplit('/', 1)[-1]}/" in f for f in files):
            remove(spark, path)
            made.discard(path)


def parallelism(spark: SparkSession, least: int = 8) -> int:
    """A power of two, no less than spark.sql.shuffle.partitions."""
    n = least
    while n < int(spark.conf.get("spark.sql.shuffle.partitions")):
        n *= 2
    return n


def components(edges: DataFrame) -> DataFrame:
    """(node, label) for every node of the edges (a, b): label is the least node reachable.

    Alternates two contractions (every larger neighbour to the least neighbour, then every smaller one)
    until nothing changes; each round is joins and minima only, so a node of very many edges is
    pre-aggregated and its join can be split.
    """
    spark = edges.sparkSession
    links = table(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges")
    state = None
    while True:
        sides = links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = sides.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = sides.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        large = table(large, "large")
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        small = small.unionByName(least.select("u", F.col("m").alias("v"))).where("u <> v").distinct()
        links = table(small, "small")
        seen = links.agg(F.count("*"), F.sum(F.hash("u", "v").cast("long")), F.bit_xor(F.xxhash64("u", "v"))).first()
        if seen == state:
            break
        state = seen
    return links.select(F.col("u").alias("node"), F.col("v").alias("label")).unionByName(links.select(F.col("v").alias("node"), F.col("v").alias("label")).distinct())
