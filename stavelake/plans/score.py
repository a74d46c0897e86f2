"""Whole-score plans composed from the operators."""

from __future__ import annotations

import contextlib
from typing import NamedTuple, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import KEYS
from ..operators import corrections, islands, joins, numbering, scan
from ..session import co_partitioned, materialize


class Layout(NamedTuple):
    """Intermediate tables of one numbering run (all lazy)."""

    staff: DataFrame       # staves with pos, link, system_raw
    extents: DataFrame     # bar-staff pairs reduced to one row per staff, x1, x2
    systems: DataFrame     # systems with bars, intervals and compact index
    intervals: DataFrame   # one row per wide-enough interval


def layout(
    staff: DataFrame,
    bar: DataFrame,
    connector: DataFrame | None = None,
    *,
    connector_aware: bool = True,
    explicit: bool = False,
    stage: bool = False,
    once: bool = False,
    keys: Sequence[str] = KEYS,
) -> Layout:
    """Staves + bars → systems → intervals.

    ``connector`` is keyed by the lower staff of a pair in page order (staff_index).  With
    ``stage`` the bar-staff extents, staves and systems, which feed several branches, are written to
    the shared folder once instead of being recomputed.  Copies of a bar meet before rows are dealt by
    page; what is left of a page is bounded, so every later step stays in its partition.  With ``once`` too
    only the extents are written, and dealt once for all branches; staves and systems stay lazy, for a caller
    that reads the intervals once and ``co_partitioned``, so in the same partitions.
    """
    pos = joins.staff_positions(staff, keys)
    if connector is not None:
        connector = connector.withColumnRenamed("staff_index", "pos")
    write = lambda df, name: materialize(df, name) if stage else df
    dealt = lambda df: df.repartition(*keys) if stage else df
    with co_partitioned(staff.sparkSession) if stage else contextlib.nullcontext():
        extents = write(joins.reduce_pairs(
            joins.assign_bars(pos, dealt(joins.distinct_bars(bar, keys)), keys), keys), "extents")
        if stage and once:
            # as one column, so that every branch reads the same exchange whatever it needs of it
            rest = [n for n in extents.columns if n not in keys]
            extents = dealt(extents.select(*keys, F.struct(*rest).alias("e"))).select(*keys, "e.*")
            write = dealt = lambda df, *_: df
        else:
            extents = dealt(extents)
        grouped = write(numbering.system_attributes(
            islands.build_systems(pos, extents, connector, connector_aware=connector_aware,
                                  explicit=explicit, keys=keys), keys), "staves")
        bars = numbering.supported_bars(dealt(grouped), extents, keys)
        kept = numbering.with_implicit_start(numbering.kept_bars(bars, keys))
        systems = write(numbering.system_intervals(kept, keys), "systems")
    return Layout(grouped, extents, systems, numbering.interval_rows(systems, keys))


def number_corpus(
    staff: DataFrame,
    bar: DataFrame,
    connector: DataFrame | None = None,
    overrides: DataFrame | None = None,
    boundaries: DataFrame | None = None,
    *,
    start: int = 1,
    stage: bool = True,
    keys: Sequence[str] = KEYS,
    **options,
) -> DataFrame:
    """End to end: layout tables in, numbered measures out.

    ``overrides`` must already hold one row per (page, system, measure).
    """
    lay = layout(staff, bar, connector, keys=keys, stage=stage, **options)
    measures = numbering.apply_overrides(lay.intervals, overrides, keys)
    if stage:
        measures = materialize(measures, "measures")
    return numbering.number_measures(measures, boundaries, start=start, keys=keys)


def rerun_numbering(
    old: DataFrame,
    old_pages: DataFrame,
    touched: DataFrame,
    staff: DataFrame,
    bar: DataFrame,
    connector: DataFrame | None,
    overrides: DataFrame | None,
    boundaries: DataFrame | None,
    pages: DataFrame,
    *,
    start: int = 1,
    keys: Sequence[str] = KEYS,
    **options,
) -> DataFrame:
    """Number a corpus again after corrections on the pages of ``touched``; adds ``reused``.

    Only touched pages are laid out again; of all others the measures of the last result
    ``old`` (system, measure, box, skip, set_number, number) go straight into the running
    number.  A page whose start, next number and place before the first boundary agree with
    ``old_pages`` is reused: its rows are those of the old result.
    """
    here = touched.select(*keys).distinct()
    only = lambda df: df.join(here, list(keys), "left_semi")
    lay = layout(only(staff), only(bar), None if connector is None else only(connector), keys=keys, stage=True, once=True, **options)
    cols = [*keys, "system", "measure", "x1", "y1", "x2", "y2", "skip", "set_number"]
    with co_partitioned(staff.sparkSession):
        fresh = numbering.apply_overrides(lay.intervals, None if overrides is None else only(overrides), keys)
        rest = old.repartition(*keys).join(here, list(keys), "left_anti")
        counted = [numbering.page_counters(m, boundaries, keys).select(*cols, "_seg", "_local", "number") for m in (
            fresh.select(*cols, F.lit(None).cast("bigint").alias("number")), rest.select(*cols, "number"))]
        every = materialize(counted[0].unionByName(counted[1]), "measures")
    # from here on a page is one row
    tails = materialize(numbering.page_tails(every, keys), "tails")
    after = numbering.carried_pages(tails, pages, start=start, keys=keys)
    first = boundaries if boundaries is not None else pages.where(F.lit(False))
    flags = corrections.page_reuse(old_pages, after, here, first, keys=keys).select(*keys, "reused")
    starts = scan.compose_starts(tails, list(keys[:-1]), keys[-1], start).select(*keys, "unit_start")
    place = materialize(starts.join(flags, list(keys), "left").select(
        *keys, "unit_start", F.coalesce("reused", F.lit(False)).alias("reused")), "reused-pages")
    return every.join(place, list(keys)).select(
        *cols, F.when(F.col("reused"), F.col("number")).otherwise(numbering.counted_number()).alias("number"), "reused")
