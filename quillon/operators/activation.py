"""Which release is active: an append-only log of activations and rollbacks, at most one release at a time.

The log of a registry is a folder with one file for each version. Whoever writes names the version that it saw; the
file of the next version can be put there once only, so of several that saw the same version one succeeds and the
others are told. A rollback returns to the release that was active before, however often it is repeated.
"""

from __future__ import annotations

import json
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .. import scratch
from . import curation, integrity

LOG_SCHEMA = "version long, action string, release_id string, at timestamp"


class Conflict(RuntimeError):
    """Another activation came first."""


def _file(registry: str, version: int) -> str:
    return f"{registry}/{version:020d}.json"


def history(spark: SparkSession, registry: str) -> list[dict]:
    """The entries of a registry, a row for each decision of an operator, in order of their versions."""
    out: list[dict] = []
    while (raw := scratch.read_bytes(spark, _file(registry, len(out) + 1))) is not None:
        out.append(json.loads(raw))
    return out


def _stack(entries: list[dict]) -> list[str]:
    held: list[str] = []
    for e in entries:
        if e["action"] == "activate":
            held.append(e["release_id"])
        elif held:
            held.pop()
    return held


def current_version(spark: SparkSession, registry: str) -> int:
    return len(history(spark, registry))


def active_release(spark: SparkSession, registry: str) -> str | None:
    held = _stack(history(spark, registry))
    return held[-1] if held else None


def _append(spark: SparkSession, registry: str, seen: int, action: str, release_id: str | None, at: datetime | None) -> int:
    now = (at or datetime.now(timezone.utc)).isoformat()
    entry = {"version": seen + 1, "action": action, "release_id": release_id, "at": now}
    if current_version(spark, registry) < seen or not scratch.put_if_absent(spark, _file(registry, seen + 1), json.dumps(entry, sort_keys=True).encode()):
        raise Conflict(f"{registry} is not at version {seen}")
    return seen + 1


def activate(spark: SparkSession, registry: str, release_id: str, seen: int, retained: set[str], at: datetime | None = None) -> int:
    """Make a retained release the active one, given the version that was seen; the new version, or Conflict."""
    if not integrity.is_release_id(release_id) or release_id not in retained:
        raise ValueError(f"{release_id!r} is no retained release")
    return _append(spark, registry, seen, "activate", release_id, at)


def rollback(spark: SparkSession, registry: str, seen: int, at: datetime | None = None) -> int:
    """Return to the release that was active before; ValueError where there is none."""
    if len(_stack(history(spark, registry)[:seen])) < 2:
        raise ValueError("no earlier release to return to")
    return _append(spark, registry, seen, "rollback", None, at)


def log(spark: SparkSession, registry: str) -> DataFrame:
    rows = [(e["version"], e["action"], e["release_id"], datetime.fromisoformat(e["at"])) for e in history(spark, registry)]
    return spark.createDataFrame(rows, LOG_SCHEMA)


def deletable(releases: DataFrame, spark: SparkSession, registry: str) -> DataFrame:
    """Releases (release_id) that may go: neither active nor one that rollbacks could return to."""
    kept = set(_stack(history(spark, registry)))
    return releases.where(~F.col("release_id").isin(*kept)) if kept else releases


def accepted(proposals: DataFrame, registry: str = "registry_id", order: str = "id") -> DataFrame:
    """Of proposals (registry_id, id, seen, ...), those that a registry accepts, each with its new version.

    Proposals arrive in order; one is accepted when the version that it saw is the one that the registry has then,
    so of several that saw the same version the first one wins and every version has one proposal. What follows
    a proposal, if it is accepted, is the first one after it that saw its version; from the first one that saw
    version 0 that chain is walked with pointers that double, in as many rounds as log2 of its length.
    """
    rows = proposals.select(F.col(registry).alias("r"), F.col(order).alias("i"), F.col("seen").cast("long").alias("seen"))
    both = rows.select("r", "i", (F.col("seen") + 1).alias("version"), F.lit(None).cast("long").alias("asks")).unionByName(rows.select("r", "i", F.col("seen").alias("version"), F.col("i").alias("asks")))
    later = F.min("asks").over(Window.partitionBy("r", "version").orderBy("i").rangeBetween(1, Window.unboundedFollowing))
    jump = scratch.table(both.withColumn("to", later).where("asks is null and to is not null").select("r", "i", "to"), "jump")
    walked = scratch.table(rows.where("seen = 0").groupBy("r").agg(F.min("i").alias("i")), "walked")
    while not jump.isEmpty():
        reached = walked.join(jump, ["r", "i"]).select("r", F.col("to").alias("i"))
        walked = scratch.table(walked.unionByName(reached), "walked")
        far = jump.select("r", F.col("i").alias("to"), F.col("to").alias("beyond"))
        jump = scratch.table(jump.join(far, ["r", "to"]).select("r", "i", F.col("beyond").alias("to")), "jump")
    return proposals.join(walked.select(F.col("r").alias(registry), F.col("i").alias(order)), [registry, order]).withColumn("version", F.col("seen") + 1)


def states(entries: DataFrame, registry: str = "registry_id") -> DataFrame:
    """(registry_id, id, at, release_id): the active release after each entry (id, at, action, release_id) of registries; null: none.

    A rollback takes back the last activation that is not taken back yet, so what is active is what stands at the
    depth that it leaves.
    """
    rows = entries.select(registry, "id", "at", "release_id", (F.col("action") == "rollback").alias("undo"))
    rows = curation.depths(rows, registry)
    rows = rows.withColumns({"level_": F.struct(registry, "depth"), "own_": F.when(~F.col("undo"), F.struct("release_id"))})
    rows = integrity.with_last(rows, "level_", ["id"], F.floor(F.col("id") / (1 << 16)), "own_", "top_")
    return rows.select(registry, "id", "at", F.when(F.col("depth") > 0, F.col("top_.release_id")).alias("release_id"))


def active_at(entries: DataFrame, times: DataFrame, registry: str = "registry_id") -> DataFrame:
    """times (registry_id, at, ...) with release_id: what was active then; an entry counts from its own moment on.

    Time is cut into parts of a day, so that a registry with very many rows is many tasks'; what is active at a
    part's end is carried to the next.
    """
    known = states(entries, registry).groupBy(registry, "at").agg(F.max_by(F.struct("release_id"), "id").alias("state"))
    rest = [c for c in times.columns if c not in (registry, "at")]
    asked = times.select(registry, "at", F.struct(*rest).alias("rest"), F.lit(None).cast(known.schema["state"].dataType).alias("state"), F.lit(1).alias("kind"))
    rows = known.select(registry, "at", F.lit(None).cast(asked.schema["rest"].dataType).alias("rest"), "state", F.lit(0).alias("kind")).unionByName(asked)
    rows = integrity.with_last(rows, registry, ["at", "kind"], F.unix_date(F.to_date("at")), "state", "active")
    return rows.where("kind = 1").select(registry, "at", *[F.col(f"rest.`{c}`").alias(c) for c in rest], F.col("active.release_id").alias("release_id"))
