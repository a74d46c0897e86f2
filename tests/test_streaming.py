"""Streams fed in several files end in the batch result."""

from pyspark.sql import functions as F

import pytest

from stavelake.fixtures import Corpus
from stavelake.operators import rollups, validate
from stavelake.queries.events import progress
from stavelake.streaming import progress as st

COLS = ["job_id", "event_id", "us", "sequence", "kind", "stage_id", "completed_units", "total_units"]


def feed(spark, sf_dir, tmp_path, n=3):
    """Write the events as ``n`` files in time order."""
    e = progress(Corpus(spark, sf_dir)).select(*COLS)
    cuts = e.approxQuantile("us", [i / n for i in range(1, n)], 0.0)
    edges = [float("-inf"), *cuts, float("inf")]
    for lo, hi in zip(edges, edges[1:]):
        part = e.where((F.col("us") > lo) & (F.col("us") <= hi))
        part.coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    return e, st.read_events(spark, f"{tmp_path}/in", files_per_trigger=1)


def run(spark, stream, tmp_path, mode="append"):
    st.run_available(stream, lambda df, i: df.write.mode("overwrite").parquet(f"{tmp_path}/out/b={i}"),
                     f"{tmp_path}/cp", mode)
    return spark.read.parquet(f"{tmp_path}/out").drop("b")


def test_sequence_validation(spark, sf_dir, tmp_path):
    e, s = feed(spark, sf_dir, tmp_path)
    got = run(spark, st.validate_progress(s), tmp_path)
    exp = rollups.sequence_violations(e, terminal=F.col("kind").isin(*validate.TERMINAL))
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, exp.collect()))


def test_spans_close_as_in_the_batch(spark, sf_dir, tmp_path):
    e, s = feed(spark, sf_dir, tmp_path)
    got = st.closed_spans(run(spark, st.stage_spans(s), tmp_path))
    exp = rollups.stage_spans(e).select(*got.columns)
    assert exp.where("state = 'completed'").count() > 0
    assert sorted(map(str, got.collect())) == sorted(map(str, exp.collect()))


class Handle:
    """State of one key in memory."""

    def __init__(self):
        self.values, self.timers = {}, []

    def getValueState(self, name, schema, ttl):
        assert ttl > 0
        handle = self

        class State:
            exists = lambda self: name in handle.values
            get = lambda self: handle.values[name]
            clear = lambda self: handle.values.pop(name, None)

            def update(self, v):
                handle.values[name] = v

        return State()

    def registerTimer(self, at):
        self.timers.append(at)


class Clock:
    def __init__(self, ms):
        self.ms = ms

    getCurrentProcessingTimeInMs = getExpiryTimeInMs = lambda self: self.ms


def test_a_late_completion_corrects_the_abort():
    import pandas as pd

    p, h = st._Spans(100, 10_000), Handle()
    p.init(h)
    rows = lambda *e: iter([pd.DataFrame(e, columns=["event_id", "us", "kind"])])
    tell = lambda frames: [(r.event_id, r.state, r.revision) for f in frames for r in f.itertuples()]
    assert tell(p.handleInputRows(("j", "s"), rows((1, 0, "stage_started")), Clock(0))) == [(1, "open", 0)]
    assert tell(p.handleExpiredTimer(("j", "s"), Clock(150), Clock(100))) == [(1, "aborted", 1)]
    assert tell(p.handleExpiredTimer(("j", "s"), Clock(300), Clock(100))) == []
    assert tell(p.handleInputRows(("j", "s"), rows((2, 5000, "stage_completed")), Clock(400))) == [(1, "completed", 2)]
    assert h.values == {}
    # starts in a row, completions out of the blue and an event out of order
    got = tell(p.handleInputRows(("j", "s"), rows((9, 90, "stage_completed"), (3, 10, "stage_started"), (4, 20, "stage_started"), (8, 80, "stage_completed")), Clock(500)))
    assert got == [(3, "aborted", 1), (4, "completed", 1)] and h.values == {}
    list(p.handleInputRows(("j", "s"), rows((10, 100, "stage_started"), (11, 110, "stage_started")), Clock(600)))
    assert len(h.values) == 1  # one start for each job and stage, however many events


def test_override_table_survives_replay(spark, tmp_path):
    t = st.OverrideTable(f"{tmp_path}/t", ["k"])
    a = spark.createDataFrame([("x", 1, 10), ("x", 2, 20), ("y", 3, 30)], "k string, ord bigint, skip int")
    b = spark.createDataFrame([("x", 4, 40)], "k string, ord bigint, skip int")
    for batch, i in ((a, 0), (b, 1), (b, 1)):
        t.write(batch, i)
    assert sorted((r["k"], r["skip"]) for r in t.current(spark).collect()) == [("x", 40), ("y", 30)]


def test_sink_errors_are_counted(spark, sf_dir, tmp_path):
    _, s = feed(spark, sf_dir, tmp_path, 2)

    def broken(df, i):
        raise RuntimeError("sink down")

    kept = []
    sink = st.CountingSink(broken, lambda df, i: kept.extend(df.collect()))
    st.run_available(s, sink, f"{tmp_path}/cp")
    assert sink.errors >= 1 and len(kept) > 0  # the rows of a failed batch are somewhere
    with pytest.raises(Exception, match="sink down"):
        st.run_available(feed(spark, sf_dir, tmp_path, 2)[1], st.CountingSink(broken), f"{tmp_path}/cp2")


def test_quarantine(spark):
    e = spark.createDataFrame(
        [("j", 0, "job_started", "job"), ("j", -1, "job_started", "job"), ("j", 1, "odd", "job")],
        "job_id string, sequence bigint, kind string, stage_id string")
    e = e.select("*", *(F.lit(None).cast(t).alias(n) for n, t in (
        ("page_number", "int"), ("completed_units", "int"), ("total_units", "int"), ("unit", "string"),
        ("elapsed_ms", "bigint"), ("terminal", "boolean"))))
    ok, bad = st.quarantine(e)
    assert ok.count() == 1
    assert sorted(r["violation"] for r in bad.collect()) == ["bad_sequence", "unknown_kind"]


def test_first_of_equal_orders_stays(spark, tmp_path):
    """Two corrections of one measure equal in ``ord``: the one that stands first in the log, as in the SQL's arg_max."""
    import duckdb

    from stavelake.queries import ORACLES, QUERIES, load_all

    load_all()
    con, path = duckdb.connect(), f"{tmp_path}/lineitem.parquet"
    # parts 4 and 4 + 4 * 99991 share a system, and their ids share a remainder
    con.sql(f"""COPY (SELECT CAST(8 AS BIGINT) l_orderkey, CAST(p AS BIGINT) l_partkey, CAST(3 AS BIGINT) l_suppkey, CAST(1 AS INT) l_linenumber,
     CAST(7 AS DOUBLE) l_quantity, f l_returnflag, 'O' l_linestatus FROM (VALUES (4, 'A'), (4 + 4 * 99991, 'R')) t(p, f)) TO '{path}' (FORMAT parquet)""")
    con.sql("SET threads = 1")
    con.sql(f"CREATE VIEW lineitem AS SELECT * FROM '{path}'")
    want = con.sql(ORACLES["streamed_current_overrides"]).fetchall()
    got = [tuple(r) for r in QUERIES["streamed_current_overrides"](spark, str(tmp_path)).collect()]
    assert len(want) == 1 and want[0][5] == "auto" and got == want
