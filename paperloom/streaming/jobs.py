"""The document queue as keyed state: capture, deduplication, retries with backoff, and giving up, in one streaming operator.

State lives with its key in the state store, so that a batch costs what its own keys cost, however much has been seen.
The checkpoint takes the place of a startup requeue: a restarted query goes on with what was captured and not finished.

Uploads of equal content are one job.  They may arrive out of order: the job is that of the earliest upload, and begins
when none earlier can come, that is when time has passed its upload by the lateness.  A failed attempt is tried again
after ``base * 2^(n - 1)`` seconds, by a timer; after the most attempts the job is FAILED.  Finished jobs are remembered
for the retention, against repeated uploads, and forgotten by a timer as well.
"""

from __future__ import annotations

import sys
from collections.abc import Callable, Iterator

from pyspark import cloudpickle
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from paperloom.session import ship

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
EVENTS = "sha256 string, doc_id bigint, attempt int, at_ms bigint, from_status string, to_status string, note string"
CAPTURED, MAPPED, FAILED = "CAPTURED", "MAPPED", "FAILED"


def use_rocksdb(spark: SparkSession) -> None:
    """State lies on disk; what all stores of an executor hold in memory is bounded together."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    spark.conf.set("spark.sql.streaming.stateStore.rocksdb.boundedMemoryUsage", "true")


def stateful(spark: SparkSession, *shipped) -> None:
    """Keyed state with timers needs this store; its files are checkpointed to the query's folder.

    The operator is also read on the driver, by a process that does not have the session's path: it and what it calls
    (``shipped``) go by value.
    """
    use_rocksdb(spark)
    ship(spark)
    for name in {thing.__module__ for thing in shipped if hasattr(thing, "__module__")} - {"__main__"}:
        cloudpickle.register_pickle_by_value(sys.modules[name])


class JobQueue(StatefulProcessor):
    """Key: content hash.  Rows: doc_id, at (milliseconds).  ``attempt(doc_id, n)`` tells whether the n-th try succeeded."""

    def __init__(self, attempt: Callable[[int, int], bool], lateness_s: float, most: int, base_s: float, retention_s: float, clock: str):
        self.attempt, self.most, self.clock = attempt, max(1, most), clock
        self.lateness, self.base, self.retention = (int(1000 * s) for s in (lateness_s, base_s, retention_s))

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.upload = handle.getValueState("upload", "at bigint, doc_id bigint, due bigint")
        self.job = handle.getValueState("job", "status string, attempts int, due bigint")

    def _forget(self) -> None:
        self.job.clear()
        self.upload.clear()

    def _now(self, times) -> int:
        return times.getCurrentWatermarkInMs() if self.clock == "EventTime" else times.getCurrentProcessingTimeInMs()

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        if self.job.exists():
            status, _, due = self.job.get()
            if status == CAPTURED or due > self._now(timerValues):  # begun, or finished and remembered: not processed again
                return
            self.handle.deleteTimer(due)
            self._forget()
        best = self.upload.get() if self.upload.exists() else None
        first = min((r.at, r.doc_id) for r in rows)
        if best is not None and (best[0], best[1]) <= first:
            return
        due = (first[0] if self.clock == "EventTime" else self._now(timerValues)) + self.lateness
        if best is not None:
            due = due if self.clock == "EventTime" else best[2]
            self.handle.deleteTimer(best[2])
        self.upload.update((*first, due))
        self.handle.registerTimer(due)
        yield from ()

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        at, now = expiredTimerInfo.getExpiryTimeInMs(), self._now(timerValues)
        _, tried, due = self.job.get() if self.job.exists() else (CAPTURED, 0, at)
        doc_id = self.upload.get()[1] if self.upload.exists() else None
        if doc_id is None or due != at:
            return
        if tried >= self.most or (self.job.exists() and self.job.get()[0] != CAPTURED):  # the retention is over
            self._forget()
            return
        while True:
            tried += 1
            done = self.attempt(doc_id, tried)
            last = tried >= self.most
            status = MAPPED if done else FAILED if last else CAPTURED
            note = None if done else f"Gave up after {self.most} attempt(s)" if last else f"Attempt {tried} failed"
            yield Row(sha256=key[0], doc_id=doc_id, attempt=tried, at_ms=at, from_status=CAPTURED, to_status=status, note=note)
            finished = done or last
            at += self.retention if finished else self.base * 2 ** (tried - 1)
            if finished or at > now:  # else time has passed it already
                break
        self.job.update((status, tried, at))
        self.handle.registerTimer(at)

    def close(self) -> None:
        pass


def run_jobs(uploads: DataFrame, attempt: Callable[[int, int], bool], lateness_s: float, most: int = 3, base_s: float = 2.0, retention_s: float = 86_400.0, clock: str = "EventTime") -> DataFrame:
    """uploads (stream of sha256, doc_id, at timestamp) -> the queue's events (EVENTS).

    Clock "EventTime" measures all times by the uploads' own, "ProcessingTime" by the machine's.
    """
    stateful(uploads.sparkSession, JobQueue, attempt)
    marked = uploads.withWatermark("at", f"{lateness_s} seconds") if clock == "EventTime" else uploads
    rows = marked.select("sha256", "doc_id", F.unix_millis("at").alias("at"), F.col("at").alias("event_time"))
    queue = JobQueue(attempt, lateness_s, most, base_s, retention_s, clock)
    return rows.groupBy("sha256").transformWithState(queue, EVENTS, "Update", clock)


class Assembler(StatefulProcessor):
    """Key: document.  Keeps its rows by their own key, and gives all of them whenever some come; repeated rows change nothing."""

    def __init__(self, schema: T.StructType, keys: list[str]):
        self.schema, self.keys = schema, keys

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.rows = handle.getValueState("rows", T.StructType([T.StructField("rows", T.ArrayType(self.schema))]))

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        names = self.schema.names
        held = self.rows.get()[0] if self.rows.exists() else []
        known = {tuple(r[names.index(k)] for k in self.keys): tuple(r) for r in held}
        for r in rows:
            known[tuple(r[k] for k in self.keys)] = tuple(r[n] for n in names)
        self.rows.update((list(known.values()),))
        for values in known.values():
            yield Row(**dict(zip(names, values)))

    def close(self) -> None:
        pass


def assembled(rows: DataFrame, document: str, keys: list[str]) -> DataFrame:
    """A stream of rows -> for each batch, all rows so far of the documents that it touches.

    Rows that only all their columns tell apart are a set, which Spark's own streaming aggregate keeps without Python;
    with keys of their own, of which the last row holds, they are the ``Assembler``'s.
    """
    if {*keys, document} == set(rows.columns):
        use_rocksdb(rows.sparkSession)
        return rows.groupBy(document).agg(F.collect_set(F.struct(*rows.columns)).alias("rows")).select(F.inline("rows"))
    stateful(rows.sparkSession, Assembler)
    return rows.groupBy(document).transformWithState(Assembler(rows.schema, keys), rows.schema, "Update", "None")


def write_batches(stream: DataFrame, out: str, checkpoint: str, mapper: Callable[[DataFrame], DataFrame] | None = None):
    """Write what each batch gives into a folder of its own, over what a failed try of that batch left; ends when the source is read."""
    def batch(rows: DataFrame, batch_id: int) -> None:
        (mapper(rows) if mapper else rows).write.mode("overwrite").parquet(f"{out}/batch={batch_id}")

    return stream.writeStream.outputMode("update").foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
