"""A Merkle tree over an inventory: which members changed, found without reading the lists of all others.

Members are dealt by the first hexadecimal digits of their path's SHA-256. A leaf is a prefix of DEPTH digits; its digest
covers its members' paths, sizes and digests in order. A node's digest covers those of its children. Two trees are
compared from the root down, and only below nodes that differ.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import scratch
from . import integrity

DEPTH = 4  # 65 536 leaves: of 10^9 members a leaf lists some 15 000


def leaf_of(path: Column, depth: int = DEPTH) -> Column:
    return F.left(F.sha2(path, 256), F.lit(depth))


def _digest(rows: DataFrame, node: str, item: Column) -> DataFrame:
    """(node, digest): the SHA-256 of a node's items in their order. Items of a leaf are as many as its members."""
    return rows.groupBy(F.col(node).alias("node")).agg(F.sha2(F.array_join(F.array_sort(F.collect_list(item)), "\n"), 256).alias("digest"))


def _leaves(members: DataFrame) -> DataFrame:
    return _digest(members, "leaf", F.to_json(F.array(F.col("path"), F.col("size_bytes").cast("string"), F.col("sha256"))))


def _above(leaves: DataFrame, depth: int) -> DataFrame:
    """(level, node, digest) of all nodes, given the leaves."""
    out = level = leaves.select(F.lit(depth).alias("level"), "node", "digest")
    for k in range(depth - 1, -1, -1):
        children = level.withColumn("parent", F.left("node", F.lit(k)))
        level = _digest(children, "parent", F.concat_ws(" ", "node", "digest")).select(F.lit(k).alias("level"), "node", "digest")
        out = out.unionByName(level)
    return out


def write(inventory: DataFrame, folder: str, depth: int = DEPTH) -> None:
    """Write an inventory (path, size_bytes, sha256) and its tree to a new folder, members in order of their leaf."""
    spark = inventory.sparkSession
    members = inventory.select(leaf_of(F.col("path"), depth).alias("leaf"), "path", F.col("size_bytes").cast("long").alias("size_bytes"), "sha256")
    members.repartitionByRange("leaf").sortWithinPartitions("leaf", "path").write.parquet(f"{folder}/members")
    leaves = scratch.table(_leaves(spark.read.parquet(f"{folder}/members")), "leaves")
    _above(leaves, depth).repartition("level").sortWithinPartitions("level", "node").write.partitionBy("level").parquet(f"{folder}/tree")


def changed(old: DataFrame, new: DataFrame, depth: int = DEPTH) -> tuple[DataFrame, list[int]]:
    """(leaf) of the leaves that differ between two trees (level, node, digest), and how many nodes each level compared.

    A level looks at the children of nodes that differ on the level above, and at no others.
    """
    below = old.sparkSession.createDataFrame([("",)], "node string")
    looked = []
    for k in range(depth + 1):
        one, two = (t.where(F.col("level") == k).withColumn("parent", F.left("node", F.lit(max(0, k - 1)))) for t in (old, new))
        some = [t.join(F.broadcast(below.withColumnRenamed("node", "parent")), "parent", "left_semi").select("node", "digest") for t in (one, two)]  # at most 16^depth short rows
        both = scratch.table(some[0].join(some[1].withColumnRenamed("digest", "other"), "node", "full"), "nodes")
        looked.append(both.count())
        below = scratch.table(both.where("not (digest <=> other)").select("node"), "differ")
        if below.isEmpty():
            break
    return below.withColumnRenamed("node", "leaf"), looked


def compared(spark: SparkSession, old: str, new: str, depth: int = DEPTH) -> tuple[DataFrame, list[int]]:
    """(path, state) of members that are missing, unexpected or changed between two folders of write(), and the nodes compared.

    Lists are read for leaves that differ only: members lie in order of their leaf, so the others are skipped by the
    statistics of their row groups.
    """
    leaves, looked = changed(spark.read.parquet(f"{old}/tree"), spark.read.parquet(f"{new}/tree"), depth)
    sides = []
    for folder in (old, new):
        members = spark.read.parquet(f"{folder}/members")
        bounds = leaves.agg(F.min("leaf"), F.max("leaf")).first()
        if bounds[0] is not None:
            members = members.where(F.col("leaf").between(*bounds))
        sides.append(members.join(leaves, "leaf", "left_semi").drop("leaf"))
    return integrity.compared(*sides), looked


def updated(spark: SparkSession, folder: str, changes: DataFrame, target: str, depth: int = DEPTH) -> list[str]:
    """Write to target the inventory at folder with changes (path, size_bytes, sha256; null digest: gone), and its tree; the levels that were worked out.

    Only leaves with a change, and the nodes above them, are worked out anew; the digests of all others are taken over.
    """
    changes = scratch.table(changes.select(leaf_of(F.col("path"), depth).alias("leaf"), "path", F.col("size_bytes").cast("long").alias("size_bytes"), "sha256"), "changes")
    touched = changes.select("leaf").distinct()
    members, tree = spark.read.parquet(f"{folder}/members"), spark.read.parquet(f"{folder}/tree")
    kept = members.join(changes.select("path"), "path", "left_anti").select("leaf", "path", "size_bytes", "sha256")
    kept.unionByName(changes.where("sha256 is not null")).repartitionByRange("leaf").sortWithinPartitions("leaf", "path").write.parquet(f"{target}/members")
    now = spark.read.parquet(f"{target}/members").join(touched, "leaf", "left_semi")
    level = tree.where(F.col("level") == depth).select("node", "digest").join(touched.withColumnRenamed("leaf", "node"), "node", "left_anti").unionByName(_leaves(now))
    level = scratch.table(level, "leaves")
    level.write.parquet(f"{target}/tree/level={depth}")
    done = [f"{depth}: {touched.count()}"]
    nodes = touched.withColumnRenamed("leaf", "node")
    for k in range(depth - 1, -1, -1):
        nodes = nodes.select(F.left("node", F.lit(k)).alias("node")).distinct()
        children = level.withColumn("parent", F.left("node", F.lit(k))).join(nodes.withColumnRenamed("node", "parent"), "parent", "left_semi")
        fresh = _digest(children, "parent", F.concat_ws(" ", "node", "digest"))
        level = tree.where(F.col("level") == k).select("node", "digest").join(nodes, "node", "left_anti").unionByName(fresh)
        level = scratch.table(level, "nodes")
        level.write.parquet(f"{target}/tree/level={k}")
        done.append(f"{k}: {nodes.count()}")
    return done
