"""Structured Streaming over progress events and correction logs.

Per-job state is a handful of scalars that expire when a job falls silent.  Rows of one micro-batch
are ordered by arrival time (``us``, ``event_id``) and handled as arrays before they touch the state;
the trigger size bounds a batch.
"""

from __future__ import annotations

from typing import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor

from ..operators import validate

EVENT_SCHEMA = (
    "job_id bigint, event_id bigint, us bigint, sequence bigint, kind string, stage_id string, "
    "completed_units int, total_units int"
)


def read_events(spark: SparkSession, path: str, *, files_per_trigger: int | None = None) -> DataFrame:
    r = spark.readStream.schema(EVENT_SCHEMA)
    if files_per_trigger:
        r = r.option("maxFilesPerTrigger", files_per_trigger)
    return r.parquet(path)


def quarantine(events: DataFrame, violation=None) -> tuple[DataFrame, DataFrame]:
    """Stateless split into valid events and quarantined ones with their violation."""
    v = violation if violation is not None else validate.progress_violation()
    e = events.withColumn("violation", v)
    return e.where("violation IS NULL").drop("violation"), e.where("violation IS NOT NULL")


def _ordered(frames: Iterator[pd.DataFrame]) -> pd.DataFrame:
    return pd.concat(list(frames), ignore_index=True).sort_values(["us", "event_id"], kind="stable")


class _Sequence(StatefulProcessor):
    """Last sequence number of a job, whether it has ended, and whether a violation was reported."""

    def __init__(self, keep_ms: int):
        self.keep_ms = keep_ms

    def init(self, handle) -> None:
        self.state = handle.getValueState("sequence", "last bigint, ended boolean, broken boolean", self.keep_ms)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        e = _ordered(rows)
        last, ended, broken = self.state.get() if self.state.exists() else (None, False, False)
        seq, ends = e["sequence"].to_numpy(np.int64), e["kind"].isin(validate.TERMINAL).to_numpy()
        falls = seq <= np.append(seq[0] - 1 if last is None else last, seq[:-1])
        after = np.append(ended, ends[:-1])
        bad = np.flatnonzero(falls | after)
        if len(bad) and not broken:
            why = "sequence_not_increasing" if falls[bad[0]] else "event_after_terminal"
            yield pd.DataFrame({"job_id": [key[0]], "event_id": [e["event_id"].iloc[bad[0]]], "violation": [why]})
        self.state.update((int(seq[-1]), bool(ends[-1]), bool(broken or len(bad))))

    def close(self) -> None:
        pass


def _stateful(events: DataFrame, keys: list[str], processor: StatefulProcessor, schema: str) -> DataFrame:
    return events.groupBy(*keys).transformWithStateInPandas(
        statefulProcessor=processor, outputStructType=schema, outputMode="append", timeMode="processingTime")


#: How long the state of a silent job is kept.
KEEP_MS = 7 * 24 * 3_600_000


def validate_progress(events: DataFrame, *, keep_ms: int = KEEP_MS) -> DataFrame:
    """First sequence violation per job, emitted when it arrives; a job silent for ``keep_ms`` is forgotten."""
    return _stateful(events, ["job_id"], _Sequence(keep_ms), "job_id bigint, event_id bigint, violation string")


class _Spans(StatefulProcessor):
    """The open start of a stage; after the timeout a tombstone, so that a late completion still corrects it."""

    COLS = ["job_id", "stage_id", "event_id", "state", "elapsed_ms", "revision"]

    def __init__(self, timeout_ms: int, keep_ms: int):
        self.timeout_ms, self.keep_ms = timeout_ms, keep_ms

    def init(self, handle) -> None:
        self.handle = handle
        self.open = handle.getValueState("open", "event_id bigint, us bigint, told boolean, deadline bigint", self.keep_ms)

    def _rows(self, key, ids, states, elapsed, revisions) -> pd.DataFrame:
        return pd.DataFrame({"job_id": key[0], "stage_id": key[1], "event_id": np.asarray(ids, np.int64), "state": states,
                             "elapsed_ms": pd.array(elapsed, "Int64"), "revision": np.asarray(revisions, np.int32)})[self.COLS]

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        e = _ordered(rows)
        ids, us = e["event_id"].to_numpy(np.int64), e["us"].to_numpy(np.int64)
        starts = (e["kind"] == "stage_started").to_numpy()
        revision = np.ones(len(ids), np.int32)
        if self.open.exists():
            first_id, first_us, told, _ = self.open.get()
            ids, us, starts = np.append(first_id, ids), np.append(first_us, us), np.append(True, starts)
            revision = np.append(2 if told else 1, revision).astype(np.int32)
        at = np.flatnonzero(starts[:-1])
        done = ~starts[at + 1]
        elapsed = pd.Series((us[at + 1] - us[at]) // 1000, dtype="Int64").where(done)
        out = [self._rows(key, ids[at], np.where(done, "completed", "aborted"), elapsed, revision[at])]
        if starts[-1]:
            deadline = timerValues.getCurrentProcessingTimeInMs() + self.timeout_ms
            self.open.update((int(ids[-1]), int(us[-1]), False, deadline))
            self.handle.registerTimer(deadline)
            if len(ids) == 1 or at.tolist()[-1:] != [len(ids) - 1]:
                out.append(self._rows(key, ids[-1:], ["open"], [pd.NA], [0]))
        elif self.open.exists():
            self.open.clear()
        yield pd.concat(out, ignore_index=True)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        if self.open.exists():
            event_id, us, told, deadline = self.open.get()
            if not told and deadline <= expiredTimerInfo.getExpiryTimeInMs():
                self.open.update((event_id, us, True, deadline))
                yield self._rows(key, [event_id], ["aborted"], [pd.NA], [1])

    def close(self) -> None:
        pass


def stage_spans(events: DataFrame, *, timeout_ms: int = 3_600_000, keep_ms: int = KEEP_MS) -> DataFrame:
    """Changes of stage spans: ``open`` (revision 0), ``completed`` or ``aborted`` (1), and corrections (2).

    A span still open after ``timeout_ms`` of processing time is reported as aborted; its
    start is kept as a tombstone, and a completion that comes late corrects the report.  State
    is one start per job and stage, and expires ``keep_ms`` after its last change.
    """
    e = events.where(F.col("kind").isin("stage_started", "stage_completed"))
    return _stateful(e, ["job_id", "stage_id"], _Spans(timeout_ms, keep_ms),
                     "job_id bigint, stage_id string, event_id bigint, state string, elapsed_ms bigint, revision int")


def closed_spans(changes: DataFrame) -> DataFrame:
    """The last state of every span of a change log; what is still open when the stream ends counts as aborted."""
    last = changes.groupBy("job_id", "stage_id", "event_id").agg(F.max_by(F.struct("state", "elapsed_ms"), "revision").alias("s"))
    return last.select("job_id", "stage_id", "event_id", F.when(F.col("s.state") == "open", "aborted").otherwise(F.col("s.state")).alias("state"),
                       F.col("s.elapsed_ms").alias("elapsed_ms"))


def latest_progress(events: DataFrame) -> DataFrame:
    """Highest sequence with its units per job and stage (update mode, native aggregate).

    ``at`` is the (sequence, event_id) that decided, so later states of a key can be told apart.
    """
    at = F.struct("sequence", "event_id")
    return events.groupBy("job_id", "stage_id").agg(
        F.max(at).alias("at"), F.max("sequence").alias("sequence"), F.max_by("completed_units", at).alias("completed_units"),
        F.max_by("total_units", at).alias("total_units"))


class _Cpu(StatefulProcessor):
    """Time and CPU seconds of the last sample of a job."""

    def __init__(self, keep_ms: int):
        self.keep_ms = keep_ms

    def init(self, handle) -> None:
        self.last = handle.getValueState("sample", "us bigint, cpu double", self.keep_ms)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        e = _ordered(rows)
        us, cpu = e["us"].to_numpy(np.int64), e["cpu_seconds"].to_numpy(np.float64)
        known = self.last.exists()
        before = self.last.get() if known else (int(us[0]), float(cpu[0]))
        used = np.maximum(cpu - np.append(before[1], cpu[:-1]), 0.0)
        took = np.maximum((us - np.append(before[0], us[:-1])) / 1e6, 1e-9)
        percent = used / took * 100.0
        if not known:
            percent[0] = np.nan
        self.last.update((int(us[-1]), float(cpu[-1])))
        yield pd.DataFrame({"job_id": key[0], "event_id": e["event_id"], "cpu_percent": [None if np.isnan(x) else x for x in percent]}).astype(
            {"cpu_percent": "Float64"})

    def close(self) -> None:
        pass


def cpu_percent(samples: DataFrame, *, keep_ms: int = KEEP_MS) -> DataFrame:
    """CPU % between successive cumulative samples of a job; NULL for the first one."""
    return _stateful(samples, ["job_id"], _Cpu(keep_ms), "job_id bigint, event_id bigint, cpu_percent double")


# ---- sinks ---------------------------------------------------------------------------


class OverrideTable:
    """Correction log folded to its current override per key.

    Every micro-batch is reduced to its last row per key and written under its batch id; a
    replayed batch overwrites itself, so the fold is exactly-once without read-modify-write.
    Of rows equal in ``order`` the one of the least ``place`` stays, if that column of the log is named.
    """

    def __init__(self, path: str, ids: list[str], order: str = "ord", place: str | None = None):
        self.path, self.ids, self.order, self.place = path, ids, order, place

    def reduce(self, df: DataFrame) -> DataFrame:
        rest = [c for c in df.columns if c not in self.ids]
        # rows without an order are no rows of the fold, whatever their place
        last = F.col(self.order) if self.place is None else F.when(
            F.col(self.order).isNotNull(), F.struct(F.col(self.order), -F.col(self.place)))
        return df.groupBy(*self.ids).agg(F.max_by(F.struct(*rest), last).alias("_r")).select(*self.ids, "_r.*")

    def write(self, batch: DataFrame, batch_id: int) -> None:
        self.reduce(batch).write.mode("overwrite").parquet(f"{self.path}/batch={batch_id}")

    def current(self, spark: SparkSession) -> DataFrame:
        return self.reduce(spark.read.parquet(self.path).drop("batch"))


class CountingSink:
    """``foreachBatch`` target that counts failed writes and keeps their rows.

    A batch that cannot be written goes to ``dead_letter``; without one, or when that fails
    too, the error stops the stream, so the batch is not committed and comes again.
    """

    def __init__(self, write: Callable[[DataFrame, int], None], dead_letter: Callable[[DataFrame, int], None] | None = None):
        self.write, self.dead_letter, self.errors = write, dead_letter, 0

    def __call__(self, batch: DataFrame, batch_id: int) -> None:
        try:
            self.write(batch, batch_id)
        except Exception:
            self.errors += 1
            if self.dead_letter is None:
                raise
            self.dead_letter(batch, batch_id)


def run_available(stream: DataFrame, sink: Callable[[DataFrame, int], None], checkpoint: str, mode: str = "append") -> None:
    """Run a stream over everything available and stop.

    Batches without data are switched off for the run: a processing-time timeout would ask
    for another one forever.
    """
    conf = stream.sparkSession.conf
    own = {"spark.sql.streaming.noDataMicroBatches.enabled": "false",
           # state with timers and expiry lives in this store
           "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"}
    before = {k: conf.get(k) for k in own}
    for k, v in own.items():
        conf.set(k, v)
    try:
        q = (
            stream.writeStream.outputMode(mode).foreachBatch(sink)
            .option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
        )
    finally:
        for k, v in before.items():
            conf.set(k, v)
    q.awaitTermination()
