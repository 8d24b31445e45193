"""The job queue as Structured Streaming: intake, admission, conversion, status, expiry."""

import sys
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StatefulProcessor, StreamingQuery

from vellum import fixed
from vellum.operators import jobs as J

_ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def batch_folder(table: str, batch_id: int) -> str:
    return f"{table}/batch_id={batch_id}"


def run_batches(stream: DataFrame, checkpoint: str, handle: Callable[[DataFrame, int], None],
                once: bool = True) -> StreamingQuery:
    """`handle(batch, batch_id)` for every micro-batch, restarted from `checkpoint` after a loss."""
    writer = stream.writeStream.foreachBatch(handle).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()


def job_intake(requests: DataFrame, queue: str, refused: str, checkpoint: str, once: bool = True,
               **rules) -> StreamingQuery:
    """Requests as they come: accepted ones become job files, refused ones rows with their reason.

    A batch that is run again replaces its own folder, so neither is doubled.
    """
    def handle(batch: DataFrame, batch_id: int) -> None:
        jobs = J.intake(J.parse_requests(batch), **rules).persist()
        try:
            queued = jobs.where(F.col("error").isNull()).select(
                "job_id", "ts", "func", "path", "options", "kwargs")
            queued.write.mode("overwrite").json(batch_folder(queue, batch_id))
            jobs.where(F.col("error").isNotNull()).select("job_id", "ts", "error").write.mode(
                "overwrite").parquet(batch_folder(refused, batch_id))
        finally:
            jobs.unpersist()
    return run_batches(requests, checkpoint, handle, once)


def run_queue(jobs: DataFrame, status: str, checkpoint: str, convert: Callable[[DataFrame], DataFrame],
              outputs: str | None = None, settings: dict[str, str] | None = None,
              once: bool = True) -> StreamingQuery:
    """Jobs checked once more, converted, and their states recorded; a refused job stops no other.

    `convert(admitted)` returns the admitted jobs with `ok`, `error` and, if `outputs` is
    given, `files`. It runs once per batch: its result is written first and read back for
    the states.
    """
    def handle(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        checked = J.admit_jobs(batch, settings).persist()
        try:
            refused = checked.where(F.col("refusal").isNotNull()).select(
                "job_id", "ts", F.lit("failed").alias("status"), F.lit(None).cast("string").alias("result"),
                F.concat(F.lit("refused: "), "refusal").alias("error"))
            done = convert(checked.where(F.col("refusal").isNull()))
            if outputs:
                done.write.mode("overwrite").parquet(batch_folder(outputs, batch_id))
                done = spark.read.schema(done.schema).parquet(batch_folder(outputs, batch_id))
            finished = done.select(
                "job_id", "ts", F.when(F.col("ok"), F.lit("finished")).otherwise(F.lit("failed")).alias("status"),
                F.when(F.col("ok"), F.col("path")).alias("result"), "error")
            refused.unionByName(finished).write.mode("overwrite").parquet(batch_folder(status, batch_id))
        finally:
            checked.unpersist()
    return run_batches(jobs, checkpoint, handle, once)


def job_status(events: DataFrame, table: str, checkpoint: str, once: bool = True) -> StreamingQuery:
    """The latest state per job, kept as state and written whenever it changes."""
    def handle(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(batch_folder(table, batch_id))
    writer = J.latest_status(events).writeStream.outputMode("update").foreachBatch(handle).option(
        "checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()


def read_status(spark: SparkSession, table: str, schema) -> DataFrame:
    """What `job_status` last wrote for each job."""
    rows = spark.read.schema(schema).parquet(table)
    row = F.struct(*[c for c in rows.columns if c not in ("job_id", "batch_id")])
    newest = rows.groupBy("job_id").agg(F.max_by(row, "batch_id").alias("_s"))
    return newest.select("job_id", "_s.*")


class _Expiry(StatefulProcessor):
    """One job's latest state, and a timer that ends it `ttl` seconds after it finished or failed."""

    def __init__(self, ttl: int, terminal: list[str]):
        self.ttl, self.terminal = ttl, terminal

    def init(self, handle) -> None:
        self.handle = handle
        self.state = handle.getValueState("latest", "ms long, seq long, status string, expires long")

    @staticmethod
    def _row(key, status, ms):
        return pd.DataFrame({"job_id": [key[0]], "status": [status], "ms": [ms]})

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        held = self.state.get() if self.state.exists() else None
        best = tuple(held[:3]) if held else None
        for batch in rows:
            last = batch.sort_values(["ms", "seq"]).iloc[-1]
            seen = (int(last["ms"]), int(last["seq"]), last["status"])
            if best is None or seen[:2] > best[:2]:
                best = seen
        if held and held[3] >= 0:
            self.handle.deleteTimer(held[3])
        expires = -1
        if best[2] in self.terminal:
            expires = best[0] + self.ttl * 1000
            self.handle.registerTimer(expires)
        self.state.update((*best, expires))
        if held is None or tuple(held[:3]) != best:
            yield self._row(key, best[2], best[0])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.state.clear()
        yield self._row(key, "expired", expiredTimerInfo.getExpiryTimeInMs())

    def close(self) -> None:
        pass


def result_expiry(events: DataFrame, ttl: int = fixed.RESULT_TTL, lateness: str = "0 seconds") -> DataFrame:
    """Status changes per job from a stream of `events(job_id, ts, seq, status)`, ending in `expired`.

    A job that finished or failed is forgotten `ttl` seconds later by event time, so the
    state held is bounded by the jobs of one lifetime. State lives in RocksDB.
    """
    events.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", _ROCKSDB)
    # The process that first reads the processor is not given shipped files: it travels whole.
    cloudpickle.register_pickle_by_value(sys.modules[__name__])
    timed = events.withWatermark("ts", lateness).withColumn("ms", F.unix_millis("ts"))
    changes = timed.groupBy("job_id").transformWithStateInPandas(
        _Expiry(ttl, J.TERMINAL), "job_id string, status string, ms bigint", "Append", "EventTime")
    return changes.select("job_id", "status", F.timestamp_millis("ms").alias("ts"))


def job_dedup(jobs: DataFrame, within: str = "1 day") -> DataFrame:
    """A path named twice is one input, for as long as the watermark keeps it."""
    return jobs.withWatermark("ts", within).dropDuplicatesWithinWatermark(["path"])
