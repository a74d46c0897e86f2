"""Progress events: validation, spans, latest state, resource samples."""

from pyspark.sql import functions as F

from ..fixtures import duck
from ..operators import rollups, validate
from . import register

_TERM = "kind IN ('job_succeeded','job_review_required','job_failed','job_cancelled')"
R6 = lambda c: F.round(c, 6)


def progress(c):
    """Progress events with a microsecond arrival time."""
    return c["f_progress"].withColumn("us", F.unix_micros(F.col("ts").cast("timestamp"))).withColumn(
        "sequence", F.col("sequence").cast("bigint"))


@register("sequence_violations", duck(f"""
SELECT job_id,event_id,why AS violation FROM (SELECT *, row_number() OVER (PARTITION BY job_id ORDER BY ts,event_id) rn FROM (
 SELECT *, CASE WHEN sequence<=lag(sequence) OVER w THEN 'sequence_not_increasing' WHEN lag({_TERM}) OVER w THEN 'event_after_terminal' END why FROM {{f_progress}} WINDOW w AS (PARTITION BY job_id ORDER BY ts,event_id)) WHERE why IS NOT NULL) WHERE rn=1"""))
def _(c):
    return rollups.sequence_violations(progress(c), terminal=F.col("kind").isin(*validate.TERMINAL))


_PV = """SELECT *, CASE WHEN event_id%9=0 THEN NULL ELSE completed_units END cu, CASE WHEN event_id%31=1 THEN 0 ELSE total_units END tu, CASE WHEN event_id%7=0 THEN ' ' ELSE 'page' END unit,
 CASE WHEN event_id%23=0 THEN 'rendering' ELSE stage_id END st, CASE WHEN event_id%19=0 THEN 0 ELSE 1 END page_number, CASE WHEN event_id%29=0 THEN -5 ELSE 5 END elapsed_ms, kind IN ('job_failed') AND event_id%2=0 terminal FROM {f_progress}"""


@register("progress_field_violations", duck(f"""
SELECT event_id,CASE WHEN sequence<0 THEN 'bad_sequence' WHEN st='rendering' THEN 'unknown_stage' WHEN page_number<1 THEN 'bad_page_number' WHEN cu IS NULL THEN 'unpaired_units' WHEN tu<1 THEN 'bad_units'
 WHEN cu>tu THEN 'too_many_completed' WHEN trim(unit)='' THEN 'missing_unit' WHEN elapsed_ms<0 THEN 'bad_elapsed' WHEN terminal<>({_TERM}) THEN 'terminal_disagrees' END AS violation FROM {{pv_}}""", {"pv_": _PV}))
def _(c):
    e = c.sql(_PV).withColumns({"completed_units": F.col("cu"), "total_units": F.col("tu"), "stage_id": F.col("st")})
    return e.select("event_id", validate.progress_violation().alias("violation"))


@register("stage_spans", duck("""
SELECT job_id,stage_id,event_id,CASE WHEN nk='stage_completed' THEN 'completed' ELSE 'aborted' END AS state,CASE WHEN nk='stage_completed' THEN CAST(floor((epoch_us(nt)-epoch_us(ts))/1000) AS BIGINT) END AS elapsed_ms FROM (
 SELECT *, lead(kind) OVER w nk, lead(ts) OVER w nt FROM {f_progress} WHERE kind IN ('stage_started','stage_completed') WINDOW w AS (PARTITION BY job_id,stage_id ORDER BY ts,event_id)) WHERE kind='stage_started'"""))
def _(c):
    return rollups.stage_spans(progress(c)).select("job_id", "stage_id", "event_id", "state", "elapsed_ms")


@register("latest_progress", duck("""
SELECT job_id,stage_id,sequence,completed_units,total_units FROM (SELECT *, row_number() OVER (PARTITION BY job_id,stage_id ORDER BY sequence DESC,event_id DESC) rn FROM {f_progress}) WHERE rn=1"""))
def _(c):
    return rollups.latest_progress(progress(c))


_CPU = "SELECT user_id job_id,event_id,ts,value cpu_seconds,CAST(event_id*4096 AS BIGINT) rss_bytes FROM {events}"


@register("cpu_percentages", duck("""
SELECT job_id,event_id,round(CASE WHEN pt IS NOT NULL THEN greatest(cpu_seconds-pc,0)/greatest((epoch_us(ts)-epoch_us(pt))/1e6,1e-9)*100 END,6) AS cpu_percent FROM (
 SELECT *, lag(ts) OVER w pt, lag(cpu_seconds) OVER w pc FROM {cpu_} WINDOW w AS (PARTITION BY job_id ORDER BY ts,event_id))""", {"cpu_": _CPU}))
def _(c):
    s = c.sql(_CPU).withColumn("us", F.unix_micros(F.col("ts").cast("timestamp")))
    return rollups.cpu_percent(s).select("job_id", "event_id", R6(F.col("cpu_percent")).alias("cpu_percent"))


@register("resource_peaks", duck("""
SELECT job_id,count(*) AS n_samples,max(rss_bytes) AS peak_rss_bytes,round(max(CASE WHEN pt IS NOT NULL THEN greatest(cpu_seconds-pc,0)/greatest((epoch_us(ts)-epoch_us(pt))/1e6,1e-9)*100 END),6) AS peak_cpu_percent FROM (
 SELECT *, lag(ts) OVER w pt, lag(cpu_seconds) OVER w pc FROM {cpu_} WINDOW w AS (PARTITION BY job_id ORDER BY ts,event_id)) GROUP BY job_id""", {"cpu_": _CPU}))
def _(c):
    s = c.sql(_CPU).withColumn("us", F.unix_micros(F.col("ts").cast("timestamp")))
    return rollups.resource_peaks(rollups.cpu_percent(s)).withColumn("peak_cpu_percent", R6(F.col("peak_cpu_percent")))


# ---- the same results from a stream --------------------------------------------------


def _stream(c, name, rows=None, slices=3, files=4):
    """Events written to the shared folder in order of time, some files of whole jobs a slice, and read one slice per micro-batch."""
    import uuid

    from ..session import shared_dir
    from ..streaming import progress as st

    root = f"{shared_dir(c.spark, 'streams')}/{name}-{uuid.uuid4().hex}"
    if rows is None:
        rows = progress(c).select("job_id", "event_id", "us", "sequence", "kind", "stage_id", "completed_units", "total_units")
    edges = rows.approxQuantile("us", [k / slices for k in range(1, slices)], 0.01) or [0.0] * (slices - 1)
    for k in range(slices):  # the source takes files in the order in which they were written
        part = rows
        if k:
            part = part.where(rows["us"] > edges[k - 1])
        if k < slices - 1:
            part = part.where(rows["us"] <= edges[k])
        part.repartition(files, "job_id").write.mode("append").parquet(f"{root}/in")
    return st, c.spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", files).parquet(f"{root}/in"), root


def _collect(c, st, stream, root, schema, mode="append"):
    st.run_available(stream, lambda df, i: df.write.mode("overwrite").parquet(f"{root}/out/batch={i}"),
                     f"{root}/checkpoint", mode)
    return c.spark.read.schema(schema).parquet(f"{root}/out").drop("batch")


@register("streamed_sequence_violations", duck(f"""
SELECT job_id,event_id,why AS violation FROM (SELECT *, row_number() OVER (PARTITION BY job_id ORDER BY ts,event_id) rn FROM (
 SELECT *, CASE WHEN sequence<=lag(sequence) OVER w THEN 'sequence_not_increasing' WHEN lag({_TERM}) OVER w THEN 'event_after_terminal' END why FROM {{f_progress}} WINDOW w AS (PARTITION BY job_id ORDER BY ts,event_id)) WHERE why IS NOT NULL) WHERE rn=1"""))
def _(c):
    st, events, root = _stream(c, "sequence")
    return _collect(c, st, st.validate_progress(events), root, "job_id bigint, event_id bigint, violation string")


@register("streamed_latest_progress", duck("""
SELECT job_id,stage_id,sequence,completed_units,total_units FROM (SELECT *, row_number() OVER (PARTITION BY job_id,stage_id ORDER BY sequence DESC,event_id DESC) rn FROM {f_progress}) WHERE rn=1"""))
def _(c):
    st, events, root = _stream(c, "latest")
    out = _collect(c, st, st.latest_progress(events), root,
                   "job_id bigint, stage_id string, at struct<sequence: bigint, event_id: bigint>, sequence bigint, "
                   "completed_units int, total_units int", "update")
    # update mode may emit a key more than once: its last state has the latest event
    return out.groupBy("job_id", "stage_id").agg(
        F.max("sequence").alias("sequence"), F.max_by("completed_units", "at").alias("completed_units"),
        F.max_by("total_units", "at").alias("total_units"))


@register("streamed_stage_spans", duck("""
SELECT job_id,stage_id,event_id,CASE WHEN nk='stage_completed' THEN 'completed' ELSE 'aborted' END AS state,CASE WHEN nk='stage_completed' THEN CAST(floor((epoch_us(nt)-epoch_us(ts))/1000) AS BIGINT) END AS elapsed_ms FROM (
 SELECT *, lead(kind) OVER w nk, lead(ts) OVER w nt FROM {f_progress} WHERE kind IN ('stage_started','stage_completed') WINDOW w AS (PARTITION BY job_id,stage_id ORDER BY ts,event_id)) WHERE kind='stage_started'"""))
def _(c):
    st, events, root = _stream(c, "spans")
    changes = _collect(c, st, st.stage_spans(events), root,
                       "job_id bigint, stage_id string, event_id bigint, state string, elapsed_ms bigint, revision int")
    return st.closed_spans(changes)


@register("streamed_cpu_percentages", duck("""
SELECT job_id,event_id,round(CASE WHEN pt IS NOT NULL THEN greatest(cpu_seconds-pc,0)/greatest((epoch_us(ts)-epoch_us(pt))/1e6,1e-9)*100 END,6) AS cpu_percent FROM (
 SELECT *, lag(ts) OVER w pt, lag(cpu_seconds) OVER w pc FROM {cpu_} WINDOW w AS (PARTITION BY job_id ORDER BY ts,event_id))""", {"cpu_": _CPU}))
def _(c):
    rows = c.sql(_CPU).select("job_id", "event_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("us"), "cpu_seconds")
    st, samples, root = _stream(c, "cpu", rows)
    out = _collect(c, st, st.cpu_percent(samples), root, "job_id bigint, event_id bigint, cpu_percent double")
    return out.withColumn("cpu_percent", R6(F.col("cpu_percent")))


@register("streamed_current_overrides", duck("""
SELECT score_id,page_index,system,measure,max(ord) AS ord,arg_max(op,ord) AS op,arg_max(skip,ord) AS skip FROM {f_override} GROUP BY ALL"""))
def _(c):
    """The correction log folded to its current table by an idempotent batch sink; of rows equal in ``ord`` the first stays."""
    import uuid

    from ..session import shared_dir
    from ..streaming import progress as st

    root = f"{shared_dir(c.spark, 'streams')}/overrides-{uuid.uuid4().hex}"
    log = c["f_override"].select("score_id", "page_index", "system", "measure", "ord", "op", "skip").withColumn("place", F.monotonically_increasing_id())
    log.write.parquet(f"{root}/in")
    table = st.OverrideTable(f"{root}/table", ["score_id", "page_index", "system", "measure"], place="place")
    st.run_available(c.spark.readStream.schema(log.schema).parquet(f"{root}/in"), table.write, f"{root}/checkpoint")
    return table.current(c.spark).drop("place")
