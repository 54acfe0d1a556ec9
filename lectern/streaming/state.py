"""Jobs as keyed state of a stream: fields by last write, a running count, and eviction of finished jobs by event time.

A job is the state of its key in the RocksDB store: the last value of each field, the sum of its positive steps, the time of its last update. A job that is over and older than its time
to live goes: either by a timer, when the watermark passes, or because a newer update of its key comes first and begins another job. So the jobs are the same
however the updates are cut into micro-batches, as long as none comes later than the watermark allows.

Defined results: updates of one time count in the order of ``order``; a null field keeps its value; steps that are null or not positive add nothing; a null key is a key; updates without a time are left out.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
OVER = ("done", "error")
TTL_SECONDS = 3600


class Jobs(StatefulProcessor):
    """Gives a row of a job whenever it has changed (open) and once when it is evicted (not open)."""

    def __init__(self, key: str, fields: list[str], kinds: list[T.DataType], ttl_seconds: int, over: tuple[str, ...]):
        self.key, self.fields, self.ttl, self.over = key, fields, ttl_seconds * 1_000_000, over
        self.schema = T.StructType([T.StructField(c, k) for c, k in zip(fields, kinds, strict=True)] + [T.StructField(c, T.LongType()) for c in ("delivered", "started", "updated", "updates")])

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.job = handle.getValueState("job", self.schema)

    def stale(self, job: dict | None, now: int) -> bool:
        return job is not None and job["status"] in self.over and now - job["updated"] > self.ttl

    def row(self, key: tuple, job: dict, is_open: bool) -> Row:
        return Row(**{self.key: key[0]}, **job, open=is_open)

    def handleInputRows(self, key: tuple, rows: Iterator[Row], timerValues) -> Iterator[Row]:  # noqa: N802, N803
        held = self.job.get() if self.job.exists() else None
        job = dict(zip(self.schema.names, held, strict=True)) if held is not None else None
        for r in sorted(rows, key=lambda r: (r["_at_us"], r["_order"])):  # the rows of one key in one micro-batch
            if self.stale(job, r["_at_us"]):
                yield self.row(key, job, False)
                job = None
            if job is None:
                job = dict.fromkeys(self.fields) | {"delivered": 0, "started": r["_at_us"], "updated": r["_at_us"], "updates": 0}
            job |= {c: r[c] for c in self.fields if r[c] is not None}
            job |= {"delivered": job["delivered"] + max(0, r["_step"] or 0), "updated": max(job["updated"], r["_at_us"]), "updates": job["updates"] + 1}
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        if job["status"] in self.over:
            self.handle.registerTimer((job["updated"] + self.ttl) // 1000 + 1)
        self.job.update(tuple(job[c] for c in self.schema.names))
        yield self.row(key, job, True)

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[Row]:  # noqa: N802, N803
        if self.job.exists():
            job = dict(zip(self.schema.names, self.job.get(), strict=True))
            self.job.clear()
            yield self.row(key, job, False)

    def close(self) -> None:
        pass


def job_changes(updates: DataFrame, key: str, at: str, order: str, fields: list[str], step: str, late: str = "0 seconds", ttl_seconds: int = TTL_SECONDS, over: tuple[str, ...] = OVER) -> DataFrame:
    """Stream of job rows: key, fields, delivered, started and updated (microseconds), updates, open; ``fields`` hold ``status``.

    The session's state store becomes RocksDB, which keeps jobs on the executors' disks and in the checkpoint folder.
    """
    updates.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)
    stamped = updates.withColumn("_at", F.col(at).cast("timestamp")).filter("_at IS NOT NULL").withWatermark("_at", late)
    rows = stamped.select(key, "_at", F.unix_micros("_at").alias("_at_us"), F.col(order).alias("_order"), F.col(step).cast("long").alias("_step"), *(c for c in fields))
    kinds = [rows.schema[c].dataType for c in fields]
    jobs = Jobs(key, fields, kinds, ttl_seconds, over)
    out = T.StructType([T.StructField(key, rows.schema[key].dataType), *jobs.schema.fields, T.StructField("open", T.BooleanType())])
    return rows.groupBy(key).transformWithState(jobs, outputStructType=out, outputMode="Update", timeMode="EventTime")


def jobs_of(changes: DataFrame, key: str) -> DataFrame:
    """The last row of each job from the rows of all micro-batches; partial aggregates, no sort."""
    last = F.struct("updates", (~F.col("open")).alias("over"), *(c for c in changes.columns if c not in (key, "started", "updates")))
    return changes.groupBy(key, "started").agg(F.max(last).alias("_job")).select(key, "started", "_job.*").drop("over")

