"""Bars → measures → numbers.

Per system the bars are first reduced to one candidate per x pixel (the fold can keep no
more), so the ordered fold and the interval logic run on arrays bounded by page width.
Numbers are carried over pages with a blocked scan, never with one task per score.
"""

from __future__ import annotations

from typing import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import KEYS
from ..functions import geometry as g
from . import blocking as bl
from . import scan

# Fixed thresholds in staff units / ratios.
DEDUP_UNITS = 1.2
IMPLICIT_START_UNITS = 4.0
MIN_WIDTH_UNITS = 1.0
FULL_STAFF_UNITS = 4.0
GHOST_MEDIAN_RATIO = 0.5
GHOST_HEIGHT_RATIO = 1.2

BAR = "struct<x1:int,x2:int,y1:int,y2:int,is_ghost:boolean>"


def array_median(a: Column) -> Column:
    """Exact median of a numeric array; NULL when empty."""
    s = F.array_sort(a)
    n = F.size(s)
    mid = F.floor(n / 2).cast("int")
    return F.when(n % 2 == 1, F.get(s, mid).cast("double")).when(
        n > 0, (F.get(s, mid - 1) + F.get(s, mid)) / F.lit(2.0)
    )


def keep_first(sorted_bars: Column, threshold: Column, x: str = "x1") -> Column:
    """Greedy fold: keep a bar unless it lies closer than ``threshold`` to the last *kept* one.

    The input array must be sorted; comparing with the previous bar (``lag``) instead of
    the last kept one gives a different, wrong result on chains.
    """
    empty = F.filter(sorted_bars, lambda b: F.lit(False))
    return F.aggregate(
        sorted_bars,
        empty,
        lambda acc, b: F.when(
            (F.size(acc) == 0) | (b[x] - F.element_at(acc, -1)[x] >= threshold),
            F.concat(acc, F.array(b)),
        ).otherwise(acc),
    )


def system_attributes(staff: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """Add the geometry of a staff's system: envelope, unit, average height, staff count."""
    w = Window.partitionBy(*keys, "system_raw")
    b = g.box()
    return staff.select(
        "*",
        F.count("*").over(w).alias("n_staves"),
        F.coalesce(
            F.median(F.when(g.positive_finite(F.col("unit_size")), F.col("unit_size"))).over(w),
            F.median(F.when(g.height(b) > 0, g.height(b).cast("double"))).over(w) / 4.0,
        ).alias("sys_unit"),
        F.min("x1").over(w).alias("sx1"), F.min("y1").over(w).alias("sy1"),
        F.max("y2").over(w).alias("sy2"), F.avg(g.height(b)).over(w).alias("avg_h"),
    )


ATTRS = ("n_staves", "sys_unit", "sx1", "sy1", "sy2", "avg_h")
CANDIDATE = "array<struct<x1:int,nw:int,y1:int,y2:int,x2:int,is_ghost:boolean,ok:boolean>>"


def supported_bars(
    staff: DataFrame, extents: DataFrame, keys: Sequence[str] = KEYS
) -> DataFrame:
    """One row per system: its bars with the multi-staff support test, as an array ``bars``.

    In systems of at least three staves a bar needs a ghost flag, an overlap of four units
    with some staff, or a centre within 1.2 units on two staves.  Its own staff is one, so the nearest
    centre of another staff decides: in order of centres that is, on either side, the end of the
    neighbouring run of one staff.  ``bars`` keeps the first bar per staff, x1 and x2, with its verdict
    ``ok``; it is empty in a system without bars.
    """
    sysid = [*keys, "system_raw"]
    st = staff.select(*sysid, "pos", *ATTRS)
    sb = st.join(extents.drop("unit"), [*keys, "pos"], "left").withColumn(
        "c2", F.col("x1") + F.col("x2"))
    gap = {}
    for name, order in (("_up", (F.col("c2"), F.col("pos"))), ("_down", (F.col("c2").desc(), F.col("pos").desc()))):
        w = Window.partitionBy(*sysid).orderBy(*order)
        run_end = F.when(F.lag("pos").over(w) != F.col("pos"), F.lag("c2").over(w))
        sb = sb.withColumn(name, run_end).withColumn(
            name, F.last(name, True).over(w.rowsBetween(Window.unboundedPreceding, 0)))
        gap[name] = F.abs(F.col("c2") - F.col(name))
    near = F.coalesce(F.least(*gap.values()) / 2.0 < F.col("sys_unit") * DEDUP_UNITS, F.lit(False))
    sb = sb.withColumn("a", (F.col("n_staves") < 3) | near)
    m = lambda n: F.when(F.col("a"), F.col("m_all")[n]).otherwise(F.coalesce("m_full", "m_all")[n])
    verdict = F.when(F.col("x1").isNotNull(), F.struct(
        F.col("x1"), (F.col("x1") - F.col("x2")).alias("nw"), m("y1").alias("y1"), m("y2").alias("y2"), F.col("x2"),
        m("is_ghost").alias("is_ghost"), (F.col("a") | F.col("m_full").isNotNull()).alias("ok")))
    return sb.select(*sysid, *ATTRS, verdict.alias("v")).groupBy(*sysid, *ATTRS).agg(
        F.collect_list("v").cast(CANDIDATE).alias("bars"))


def kept_bars(bars: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """One row per system with its array of kept bars (``bars``), empty when it has none."""
    one = bars.select(*keys, "system_raw", *ATTRS, F.array_sort(F.filter("bars", lambda v: v["ok"])).alias("b")).withColumnRenamed(
        "sys_unit", "unit")
    kept = keep_first(F.col("b"), F.col("unit") * DEDUP_UNITS)
    return one.withColumn("bars", F.transform(kept, lambda v: F.struct(
        v["x1"].alias("x1"), v["x2"].alias("x2"), v["y1"].alias("y1"), v["y2"].alias("y2"),
        v["is_ghost"].alias("is_ghost"))).cast(f"array<{BAR}>")).drop("b")


def with_implicit_start(kept: DataFrame) -> DataFrame:
    """Prepend a ghost bar when the first bar starts more than four units into the system."""
    ghost = F.array(F.struct(
        F.col("sx1").alias("x1"), (F.col("sx1") + 1).alias("x2"), F.col("sy1").alias("y1"),
        F.col("sy2").alias("y2"), F.lit(True).alias("is_ghost"),
    ))
    late = F.get(F.col("bars"), 0)["x1"] - F.col("sx1") > F.col("unit") * IMPLICIT_START_UNITS
    return kept.withColumn(
        "bars", F.when(F.coalesce(late, F.lit(False)), F.concat(ghost, "bars")).otherwise(F.col("bars"))
    )


def system_intervals(kept: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """Per system the array of wide-enough intervals, the narrow-ghost flag and ``system``.

    ``system`` is the compact index over systems that get measures from uncorrected
    geometry (NULL otherwise).
    """
    i = F.sequence(F.lit(0), F.size("bars") - 2)
    iv = F.when(
        F.size("bars") >= 2,
        F.transform(i, lambda k: F.struct(
            k.alias("i"),
            F.get(F.col("bars"), k)["x2"].alias("x1"),
            F.get(F.col("bars"), k + 1)["x1"].alias("x2"),
        )),
    ).otherwise(F.array().cast("array<struct<i:int,x1:int,x2:int>>"))
    wide = lambda v: v["x2"] - v["x1"] >= F.col("unit") * MIN_WIDTH_UNITS
    s = kept.withColumn("iv", F.filter(iv, wide))
    s = s.withColumn("ghost_start", F.coalesce(F.get(F.col("bars"), 0)["is_ghost"], F.lit(False)))
    widths = F.transform("iv", lambda v: v["x2"] - v["x1"])
    # the first *eligible* width is left out after a ghost start
    s = s.withColumn("median_w", array_median(
        F.when(F.col("ghost_start"), F.slice(widths, 2, F.greatest(F.size("iv") - 1, F.lit(0))))
        .otherwise(widths)))
    narrow = lambda v: F.coalesce(
        (v["i"] == 0) & F.col("ghost_start")
        & (v["x2"] - v["x1"] < F.col("median_w") * GHOST_MEDIAN_RATIO)
        & (v["x2"] - v["x1"] < F.col("avg_h") * GHOST_HEIGHT_RATIO),
        F.lit(False),
    )
    s = s.withColumn("iv", F.transform("iv", lambda v: F.struct(
        v["i"].alias("i"), v["x1"].alias("x1"), v["x2"].alias("x2"), narrow(v).alias("narrow"))))
    has = (F.size(F.filter("iv", lambda v: ~v["narrow"])) > 0).cast("int")
    w = Window.partitionBy(*keys).orderBy("system_raw").rowsBetween(Window.unboundedPreceding, 0)
    s = s.withColumn("_has", has)
    return s.withColumn(
        "system", F.when(F.col("_has") == 1, F.sum("_has").over(w) - 1).cast("int")
    ).drop("_has")


def interval_rows(systems: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """One row per wide-enough interval of systems that have a compact index."""
    return systems.where("system IS NOT NULL").select(
        *keys, "system_raw", "system", F.explode("iv").alias("v"),
        F.col("sy1").alias("y1"), F.col("sy2").alias("y2"),
    ).select(
        *keys, "system_raw", "system", F.col("v.i").alias("interval"),
        F.col("v.x1").alias("x1"), "y1", F.col("v.x2").alias("x2"), "y2",
        F.col("v.narrow").alias("narrow"),
    )


def base_measures(intervals: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """Uncorrected measures with their visible index ``measure``."""
    w = Window.partitionBy(*keys, "system").orderBy("interval")
    return intervals.where(~F.col("narrow")).withColumn(
        "measure", (F.row_number().over(w) - 1).cast("int")
    )


def apply_overrides(
    intervals: DataFrame, overrides: DataFrame | None, keys: Sequence[str] = KEYS
) -> DataFrame:
    """Visible measures with their override.

    ``force_measure`` addresses the raw interval index and re-admits a narrow first
    interval; every other override addresses the visible index *after* that shift.
    ``overrides`` holds one row per (page, system, measure).
    """
    at = [*keys, "system"]
    w = Window.partitionBy(*at).orderBy("interval")
    if overrides is None:
        return base_measures(intervals, keys).select(
            "*", F.lit(0).alias("skip"), F.lit(None).cast("int").alias("set_number"))
    ov = overrides.select(*at, "measure", "skip", "set_number",
                          F.coalesce("force_measure", F.lit(False)).alias("force_measure"))
    forced = ov.where("force_measure").select(
        *at, F.col("measure").alias("interval"), F.col("skip").alias("f_skip"),
        F.col("set_number").alias("f_set"), F.lit(True).alias("forced"))
    m = (
        intervals.join(forced, [*at, "interval"], "left")
        .withColumn("forced", F.coalesce("forced", F.lit(False)))
        .where(~F.col("narrow") | F.col("forced"))
        .withColumn("measure", (F.row_number().over(w) - 1).cast("int"))
    )
    m = m.join(ov.drop("force_measure"), [*at, "measure"], "left")
    pick = lambda f, v: F.when(F.col("forced"), F.col(f)).otherwise(F.col(v))
    return m.select(
        *keys, "system_raw", "system", "interval", *g.BOX, "measure", "forced",
        F.coalesce(pick("f_skip", "skip"), F.lit(0)).cast("int").alias("skip"),
        pick("f_set", "set_number").cast("int").alias("set_number"),
    )


def page_counters(measures: DataFrame, boundaries: DataFrame | None = None, keys: Sequence[str] = KEYS) -> DataFrame:
    """Measures with ``_local``, their number but for the carry into the page, and ``_seg``, the anchors up to them."""
    if boundaries is not None:
        m = measures.join(boundaries.select(*keys, "system", "reset_number"),
                          [*keys, "system"], "left")
    else:
        m = measures.withColumn("reset_number", F.lit(None).cast("int"))
    anchor = F.coalesce("set_number", F.when(F.col("measure") == 0, F.col("reset_number")))
    page = Window.partitionBy(*keys).orderBy("system", "measure")
    m = m.withColumn("_anchor", anchor).withColumn(
        "_seg", F.sum(F.col("_anchor").isNotNull().cast("int")).over(page))
    seg = Window.partitionBy(*keys, "_seg").orderBy("system", "measure")
    before = F.sum(F.lit(1) + F.col("skip")).over(
        seg.rowsBetween(Window.unboundedPreceding, -1))
    return m.withColumn("_local", F.coalesce(before, F.lit(0)) + F.coalesce(
        F.first("_anchor").over(seg), F.lit(0))).drop("_anchor", "reset_number")


def page_tails(counted: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """Per page whether it has an anchor and what its measures leave or add: the units of the carry."""
    return counted.groupBy(*keys).agg(
        F.max("_seg").alias("_s"),
        F.max_by(F.col("_local") + 1 + F.col("skip"), F.struct("system", "measure")).alias("tail"),
    ).select(*keys, (F.col("_s") > 0).alias("has_anchor"), "tail")


def counted_number() -> Column:
    """Number of a counted measure whose page starts at ``unit_start``."""
    return F.when(F.col("_seg") > 0, F.col("_local")).otherwise(F.col("_local") + F.col("unit_start")).cast("bigint")


def number_measures(
    measures: DataFrame,
    boundaries: DataFrame | None = None,
    *,
    start: int = 1,
    keys: Sequence[str] = KEYS,
    block: int = 1024,
) -> DataFrame:
    """Assign ``number``: anchor value plus the sum of (1 + skip) since the anchor.

    Anchors: the score start, a boundary reset on the first measure of its system and
    ``set_number`` (which beats the reset).  Page windows hold one page; the carry over
    pages is a blocked scan.
    """
    score = list(keys[:-1])
    m = page_counters(measures, boundaries, keys)
    starts = scan.compose_starts(page_tails(m, keys), score, keys[-1], start, block=block)
    m = m.join(starts.select(*keys, "unit_start"), list(keys))
    return m.withColumn("number", counted_number()).drop("_seg", "_local", "unit_start")


def page_numbers(
    measures: DataFrame,
    pages: DataFrame,
    boundaries: DataFrame | None = None,
    *,
    start: int = 1,
    keys: Sequence[str] = KEYS,
    block: int = 1024,
) -> DataFrame:
    """Start and next number of **every** page; pages without measures carry over."""
    return carried_pages(page_tails(page_counters(measures, boundaries, keys), keys), pages, start=start, keys=keys, block=block)


def carried_pages(
    tails: DataFrame, pages: DataFrame, *, start: int = 1, keys: Sequence[str] = KEYS, block: int = 1024
) -> DataFrame:
    """``page_numbers`` from the pages' tails."""
    score = list(keys[:-1])
    units = pages.select(*keys).distinct().join(tails, list(keys), "left").select(
        *keys, F.coalesce("has_anchor", F.lit(False)).alias("has_anchor"),
        F.coalesce("tail", F.lit(0)).alias("tail"))
    out = scan.compose_starts(units, score, keys[-1], start, block=block)
    return out.select(
        *keys, F.col("unit_start").cast("bigint").alias("start_number"),
        F.col("unit_next").cast("bigint").alias("next_number"))


def unknown_boundaries(
    boundaries: DataFrame, measures: DataFrame, keys: Sequence[str] = KEYS
) -> DataFrame:
    """Boundaries that address no numbered system (an error for strict callers)."""
    at = [*keys, "system"]
    return boundaries.select(*at).join(measures.select(*at).distinct(), at, "left_anti")
