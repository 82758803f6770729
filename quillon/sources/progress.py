"""How far a scan is: counts while it runs and when it is done, without a job of their own or a pass through Python."""

from __future__ import annotations

import threading
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

EVERY = 1_000_000
POLL = 0.5


class Progress:
    """Tells say(step, rows) when a step begins (0 rows), at every `every` rows of it, and, in `final`, what it had at its end.

    While a step runs, rows are the records that its stages have read so far, as Spark's status store has them from
    finished tasks and heartbeats. At the end they are those that an Observation counted where they passed.
    """

    def __init__(self, spark: SparkSession, say: Callable[[int, int], None] = lambda step, rows: None, every: int = EVERY, poll: float = POLL):
        self.spark, self.say, self.every, self.poll = spark, say, every, poll
        self.step, self.told, self.final = 0, 0, {}

    def read_so_far(self, tag: str) -> int:
        context = self.spark.sparkContext._jsc.sc()
        store, total = context.statusStore(), 0
        for job in context.statusTracker().getJobIdsForTag(tag):
            stages = store.job(job).stageIds()
            for i in range(stages.size()):
                total += store.lastStageAttempt(stages.apply(i)).inputRecords()
        return total

    @contextmanager
    def watch(self, rows: DataFrame, **counts: Column) -> Iterator[DataFrame]:
        """rows, counted as they are read inside; after it, `final` has rows and the named counts of conditions.

        Observations take the first action that reads the frame: it has to be one that reads all of it.
        """
        self.step += 1
        self.told, tag, seen = 0, f"scan-{uuid.uuid4().hex}", Observation()
        observed = rows.observe(seen, F.count(F.lit(1)).alias("rows"), *[F.count_if(c).alias(name) for name, c in counts.items()])
        stop = threading.Event()

        def tell(n: int) -> None:
            while self.told + self.every <= n:
                self.told += self.every
                self.say(self.step, self.told)

        def poll() -> None:
            while not stop.wait(self.poll):
                tell(self.read_so_far(tag))

        self.say(self.step, 0)
        thread = threading.Thread(target=poll, daemon=True)
        self.spark.sparkContext.addJobTag(tag)
        thread.start()
        try:
            yield observed
        finally:
            stop.set()
            thread.join()
            self.spark.sparkContext.removeJobTag(tag)
        self.final = seen.get
        tell(self.final["rows"])
