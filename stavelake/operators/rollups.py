"""Run statistics: scan totals, review state, stage spans and resource peaks."""

from __future__ import annotations

from typing import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import scan


def envelope(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    return df.groupBy(*keys).agg(
        F.min("x1").alias("x1"), F.min("y1").alias("y1"), F.max("x2").alias("x2"), F.max("y2").alias("y2"))


def scan_totals(stats: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Totals of per-page scan statistics; a ratio of sums is 1 when nothing was scanned."""
    full = F.sum("full_width_columns")
    ratio = lambda c: F.coalesce(F.try_divide(F.sum(c).cast("double"), F.when(full > 0, full)), F.lit(1.0))
    return stats.groupBy(*keys).agg(
        F.count("*").alias("processed"), full.alias("full_width_columns"),
        F.sum("eligible_columns").alias("eligible_columns"),
        F.sum("projected_columns").alias("projected_columns"),
        ratio("eligible_columns").alias("eligible_width_ratio"),
        ratio("projected_columns").alias("projected_width_ratio"))


def review_state(states: DataFrame, keys: Sequence[str] = ("package_id",)) -> DataFrame:
    """Counts per recording / application status and the package status precedence.

    ``states``: edit_status, recording_status, application_status, has_error, apply_error.
    """
    n = lambda cond: F.count(F.when(cond, 1))
    c = F.col
    a = states.groupBy(*keys).agg(
        n(c("recording_status") == "recorded").alias("recorded"),
        n(c("recording_status") == "not_recorded").alias("not_recorded"),
        n(c("edit_status") == "pending").alias("pending"),
        *(n(c("application_status") == s).alias(s) for s in ("current", "stale", "not_applied", "applying")),
        n(c("has_error") | c("apply_error")).alias("error"),
        F.count_distinct("recording_status").alias("_r"), F.count_distinct("application_status").alias("_a"),
        F.min("application_status").alias("_status"))
    status = (
        F.when(c("error") > 0, "error")
        .when((c("_r") > 1) | (c("_a") > 1), "mixed")
        .when(c("pending") > 0, "pending")
        .otherwise(F.coalesce("_status", F.lit("not_applied"))))
    return a.withColumn("status", status).drop("_r", "_a", "_status")


def last_success(attempts: DataFrame, keys: Sequence[str] = ("package_id",)) -> DataFrame:
    """Latest attempt and the last successful result, which a later failure does not erase."""
    return attempts.groupBy(*keys).agg(
        F.max("attempt").alias("attempt"),
        F.max_by("success", "attempt").alias("last_ok"),
        F.max_by("result", F.when(F.col("success"), F.col("attempt"))).alias("last_successful_result"))


def stage_spans(
    events: DataFrame, *, keys: Sequence[str] = ("job_id",), order: Sequence[str] = ("us", "event_id"),
) -> DataFrame:
    """Pair every stage start with the next start/completion of the same stage.

    A start followed by its completion is ``completed`` with the elapsed milliseconds,
    everything else ``aborted``.  The look-ahead runs over blocks of similar size, so one
    busy job is not one window partition.
    """
    e = events.where(F.col("kind").isin("stage_started", "stage_completed"))
    e = e.withColumns({f"_o{i}": -F.col(c) for i, c in enumerate(order)})
    e = scan.previous(
        e, [*keys, "stage_id"], [f"_o{i}" for i in range(len(order))],
        F.struct("kind", "us"), "nxt")
    done = F.col("nxt.kind") == "stage_completed"
    return e.where("kind = 'stage_started'").select(
        *keys, "stage_id", *order,
        F.when(F.coalesce(done, F.lit(False)), "completed").otherwise("aborted").alias("state"),
        F.when(done, F.floor((F.col("nxt.us") - F.col("us")) / 1000).cast("bigint")).alias("elapsed_ms"))


def cpu_percent(samples: DataFrame, *, keys: Sequence[str] = ("job_id",)) -> DataFrame:
    """CPU % between successive cumulative samples (``us``, ``event_id``, ``cpu_seconds``)."""
    s = scan.previous(samples, list(keys), ["us", "event_id"], F.struct("us", "cpu_seconds"), "prev")
    dt = F.greatest((F.col("us") - F.col("prev.us")) / 1e6, F.lit(1e-9))
    dc = F.greatest(F.col("cpu_seconds") - F.col("prev.cpu_seconds"), F.lit(0.0))
    return s.withColumn("cpu_percent", F.when(F.col("prev").isNotNull(), dc / dt * 100.0)).drop("prev")


def resource_peaks(samples: DataFrame, keys: Sequence[str] = ("job_id",)) -> DataFrame:
    return samples.groupBy(*keys).agg(
        F.count("*").alias("n_samples"), F.max("rss_bytes").alias("peak_rss_bytes"),
        F.max("cpu_percent").alias("peak_cpu_percent"))


def latest_progress(events: DataFrame, keys: Sequence[str] = ("job_id", "stage_id")) -> DataFrame:
    """Completed / total units of the highest sequence per job and stage."""
    at = F.struct("sequence", "event_id")
    return events.groupBy(*keys).agg(
        F.max("sequence").alias("sequence"),
        F.max_by("completed_units", at).alias("completed_units"),
        F.max_by("total_units", at).alias("total_units"))


def sequence_violations(events: DataFrame, *, keys: Sequence[str] = ("job_id",), terminal: Column) -> DataFrame:
    """First violation of each event stream in arrival order (``us``, ``event_id``).

    Sequence numbers must strictly increase and nothing may follow a terminal event.
    """
    e = scan.previous(events.withColumn("_t", terminal), list(keys), ["us", "event_id"],
                      F.struct("sequence", F.col("_t").alias("t")), "prev")
    why = F.when(F.col("sequence") <= F.col("prev.sequence"), "sequence_not_increasing").when(
        F.col("prev.t"), "event_after_terminal")
    return e.withColumn("why", why).where("why IS NOT NULL").groupBy(*keys).agg(
        F.min_by(F.struct("event_id", "why"), F.struct("us", "event_id")).alias("v")
    ).select(*keys, "v.event_id", F.col("v.why").alias("violation"))
