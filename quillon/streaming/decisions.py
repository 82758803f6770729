"""The decision log as a stream: what holds for each passage, kept as state and changed by each batch's events alone."""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery


STATE_STORE = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
CHANGE = "log string, passage_id string, id long, action string, classification string"


class Effective(StatefulProcessor):
    """State of a passage of a log: its active events, the ids that undo events took back before they came, and the last one told.

    Only a passage's active events are kept, so state grows with what is decided, not with how often. Events may come
    in any order: what holds is the active event of the greatest id, whenever it came.
    """

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.active = handle.getMapState("active", "id long", "action string, classification string")
        self.gone = handle.getMapState("gone", "id long", "at long")
        self.top = handle.getValueState("top", "id long")

    def handleInputRows(self, key: Any, rows: Iterator[Row], timerValues: Any) -> Iterator[Row]:  # noqa: N802, N803
        before = self.top.get()[0] if self.top.exists() else None
        top, look = before, False
        for e in rows:
            if e["action"] == "undo":
                if e["supersedes_event_id"] is None:
                    continue
                taken = (e["supersedes_event_id"],)
                if self.active.containsKey(taken):
                    self.active.removeKey(taken)
                    look = look or taken[0] == top
                self.gone.updateValue(taken, (e["id"],))
            elif not self.gone.containsKey((e["id"],)):
                self.active.updateValue((e["id"],), (e["action"], e["classification"]))
                top = e["id"] if top is None else max(top, e["id"])
        if look:  # the one that held was taken back: the next one down
            top = max((k[0] for k in self.active.keys()), default=None)
        if top == before:
            return
        if top is None:
            self.top.clear()
            yield Row(log=key[0], passage_id=key[1], id=None, action=None, classification=None)
        else:
            self.top.update((top,))
            action, classification = self.active.getValue((top,))
            yield Row(log=key[0], passage_id=key[1], id=top, action=action, classification=classification)

    def close(self) -> None:
        pass


def changes(events: DataFrame) -> DataFrame:
    """(log, passage_id, id, action, classification) whenever what holds for a passage changes; null id: nothing holds any more.

    events: a stream of log, id, action, passage_id, classification, supersedes_event_id. An undo concerns its own passage,
    as the rules of logs demand.
    """
    rows = events.select(F.coalesce(F.col("log").cast("string"), F.lit("")).alias("log"), F.col("passage_id").cast("string").alias("passage_id"), F.col("id").cast("long").alias("id"), "action", "classification", F.col("supersedes_event_id").cast("long").alias("supersedes_event_id"))
    return rows.groupBy("log", "passage_id").transformWithState(statefulProcessor=Effective(), outputStructType=CHANGE, outputMode="Update", timeMode="None")


def follow(spark: SparkSession, events: DataFrame, current: str, checkpoint: str) -> StreamingQuery:
    """Write the changes of each batch of a stream of events under current, as version=<batch>.

    What holds is state, kept by Spark in the checkpoint with the batch's number: a batch's work follows the batch, and
    one that runs again after a failure starts from the state before it and replaces what it wrote.
    """
    if spark.conf.get(STATE_STORE[0]) != STATE_STORE[1]:
        spark.conf.set(*STATE_STORE)  # the store that keeps several kinds of state for a key

    def batch(rows: DataFrame, number: int) -> None:
        rows.write.mode("overwrite").parquet(f"{current}/version={number}")

    return changes(events).writeStream.outputMode("update").foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def effective_now(spark: SparkSession, current: str) -> DataFrame:
    """(log, passage_id, id, action, classification): what holds after the batches that are written under current."""
    rows = spark.read.schema(f"{CHANGE}, version long").parquet(current)
    last = rows.groupBy("log", "passage_id").agg(F.max_by(F.struct("id", "action", "classification"), "version").alias("x"))
    return last.where("x.id is not null").select("log", "passage_id", "x.*")


def effective_in_batch(events: DataFrame) -> DataFrame:
    """The same of a whole log at once."""
    scoped = events.withColumn("log", F.coalesce(F.col("log").cast("string"), F.lit("")))
    undone = scoped.where("action = 'undo' and supersedes_event_id is not null").select(F.col("log").alias("l_"), F.col("passage_id").alias("p_"), F.col("supersedes_event_id").alias("i_")).distinct()
    rest = scoped.where("action <> 'undo'").join(undone, (F.col("log") == F.col("l_")) & F.col("passage_id").eqNullSafe(F.col("p_")) & (F.col("id") == F.col("i_")), "left_anti")
    return rest.groupBy("log", "passage_id").agg(F.max_by(F.struct("id", "action", "classification"), "id").alias("x")).select("log", "passage_id", "x.*")
