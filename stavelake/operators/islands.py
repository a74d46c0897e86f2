"""Gaps-and-islands: row clusters, mask bands, stave systems, vertical runs.

Windows run over a page (or one pixel column of it) after the rows have been reduced
to distinct pixel positions, so a partition holds at most the page's pixel extent.
"""

from __future__ import annotations

from typing import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .. import KEYS
from ..functions import geometry as g
from . import joins

# Fixed grouping thresholds, in average staff heights and pair counts.
DIST_RATIO = 1.5
RESCUE_DIST_RATIO = 1.56
MIN_ALIGNED = 2
RESCUE_MIN_ALIGNED = 3


def row_stats(
    boxes: DataFrame,
    *,
    max_dist: float | None = None,
    min_count: int = 3,
    keys: Sequence[str] = KEYS,
) -> DataFrame:
    """Cluster boxes by centre y (gap ≤ ``max_dist``, default half the median height).

    Returns per row: median centre, top and bottom.  Works on distinct vertical extents
    with multiplicities; the medians are exact (``percentile`` with a frequency).
    """
    ext = boxes.groupBy(*keys, "y1", "y2").agg(F.count("*").alias("n"))
    page = Window.partitionBy(*keys)
    h = F.abs(F.col("y2") - F.col("y1"))
    med = F.expr("percentile(CASE WHEN abs(y2 - y1) > 0 THEN abs(y2 - y1) END, 0.5D, n)")
    limit = (
        F.lit(float(max_dist))
        if max_dist is not None
        else F.coalesce(med.over(page), F.lit(100.0)) * 0.5
    )
    c = (F.col("y1") + F.col("y2")) / F.lit(2.0)
    seq = page.orderBy("c", "y1")
    cl = (
        ext.select("*", c.alias("c"), limit.alias("lim"))
        .withColumn("brk", (F.col("c") - F.lag("c").over(seq) > F.col("lim")).cast("int"))
        .withColumn("cluster", F.sum(F.coalesce("brk", F.lit(0))).over(seq))
    )
    rows = cl.groupBy(*keys, "cluster").agg(
        F.sum("n").alias("n"),
        F.expr("percentile(c, 0.5D, n)").alias("center"),
        F.expr("percentile(y1, 0.5D, n)").alias("top"),
        F.expr("percentile(y2, 0.5D, n)").alias("bottom"),
    ).where(F.col("n") >= min_count)
    w = page.orderBy("center", "cluster")
    return rows.select(
        *keys, (F.row_number().over(w) - 1).cast("int").alias("row_idx"),
        "n", "center", "top", "bottom",
    )


def row_bands(rows: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """Integer bands of cluster rows (top/bottom truncated, reversed rows dropped)."""
    w = Window.partitionBy(*keys).orderBy("row_idx")
    return (
        rows.where("bottom >= top")
        .select(*keys, (F.row_number().over(w) - 1).cast("int").alias("band_idx"),
                F.col("top").cast("int").alias("b1"), F.col("bottom").cast("int").alias("b2"))
    )


def mask_bands(
    rows: DataFrame,
    *,
    gap_tolerance: int = 1,
    min_height: int = 1,
    keys: Sequence[str] = ("page_id",),
) -> DataFrame:
    """Staff bands from the active rows of a mask.

    ``rows``: one row per active scan line with ``y``, active span ``xa``/``xb`` and the
    page size ``img_w``/``img_h``.  First islands over rows; when the page looks like a
    stack of thin lines, second islands merge them and short fragments are dropped.
    """
    page = Window.partitionBy(*keys)
    seq = page.orderBy("y")
    seg = (
        rows.withColumn("b", (F.col("y") - F.lag("y").over(seq) > gap_tolerance).cast("int"))
        .withColumn("s", F.sum(F.coalesce("b", F.lit(0))).over(seq))
        .groupBy(*keys, "s")
        .agg(
            F.min("y").alias("y1"), F.max("y").alias("y2"),
            F.min("xa").alias("xa"), F.max("xb").alias("xb"),
            F.max("img_w").alias("img_w"), F.max("img_h").alias("img_h"),
        )
        .where(F.col("y2") - F.col("y1") + 1 >= min_height)
    )
    sw = page.orderBy("y1")
    seg = seg.withColumn("gap", F.col("y1") - F.lag("y2").over(sw) - 1)
    seg = seg.select(
        "*",
        F.count("*").over(page).alias("n_seg"),
        F.median((F.col("y2") - F.col("y1") + 1).cast("double")).over(page).alias("med_h"),
        F.median(F.when(F.col("gap") > 0, F.col("gap").cast("double"))).over(page).alias("med_gap"),
    )
    line_like = F.coalesce(
        (F.col("n_seg") >= 5)
        & (F.col("med_h") <= 3.0 * F.greatest(F.lit(1.0), F.col("med_gap")))
        & (F.col("med_gap") <= 0.05 * F.col("img_h")),
        F.lit(False),
    )
    merge_gap = F.greatest(F.lit(gap_tolerance + 1), g.half_even(F.col("med_gap") * 1.8))
    seg = seg.withColumn("line_like", line_like).withColumn(
        "grp",
        F.sum(F.when(F.col("line_like") & (F.col("gap") <= merge_gap), 0).otherwise(1)).over(sw),
    )
    long_line = (F.col("xb") - F.col("xa") + 1) >= g.half_even(F.col("img_w") * 0.30)
    merged = seg.groupBy(*keys, "grp", "line_like").agg(
        F.min("y1").alias("b1"), F.max("y2").alias("b2"), F.count("*").alias("n"),
        F.sum(long_line.cast("int")).alias("n_long"),
    ).where(
        ~F.col("line_like")
        | ((F.col("n") >= 3) & (F.col("n_long") >= 2)
           & (F.col("b2") - F.col("b1") + 1 >= min_height))
    )
    return merged.select(
        *keys,
        (F.row_number().over(page.orderBy("b1")) - 1).cast("int").alias("band_idx"),
        "b1", "b2",
    )


def system_links(
    staff: DataFrame,
    extents: DataFrame,
    connector: DataFrame | None = None,
    *,
    connector_aware: bool = True,
    keys: Sequence[str] = KEYS,
) -> DataFrame:
    """Per staff (``pos``) the link to the staff above: hard / deferred / none.

    ``extents`` are the reduced bar-staff pairs.
    ``connector`` is keyed by the lower staff; a missing row is "no evidence".
    """
    page = Window.partitionBy(*keys)
    seq = page.orderBy("pos")
    s = staff.join(joins.aligned_pairs(staff, extents, keys), [*keys, "pos"], "left")
    if connector is not None:
        s = s.join(connector.select(*keys, "pos", "present"), [*keys, "pos"], "left")
    else:
        s = s.withColumn("present", F.lit(None).cast("boolean"))
    free = F.coalesce(F.col("n_bars"), F.lit(0)) == 0
    s = s.select(
        "*",
        F.avg(F.col("y2") - F.col("y1")).over(page).alias("avg_h"),
        (F.col("y1") - F.lag("y2").over(seq)).alias("gap"),
        (free | F.lag(free).over(seq)).alias("bar_free"),
    )
    n = F.coalesce("n_pairs", F.lit(0))
    within = F.coalesce(F.col("gap") <= F.col("avg_h") * DIST_RATIO, F.lit(False))
    near = F.coalesce(F.col("gap") <= F.col("avg_h") * RESCUE_DIST_RATIO, F.lit(False))
    present = F.coalesce("present", F.lit(False))
    aligned = (within & (n >= MIN_ALIGNED)) | (present & near & (n >= RESCUE_MIN_ALIGNED))
    reachable = within | (present & near)
    if connector_aware:
        absent = F.col("present").isNotNull() & ~F.col("present")
        link = (
            F.when(~reachable | absent, "none")
            .when(within & present & F.col("bar_free"), "deferred")
            .when(aligned, "hard")
            .otherwise("none")
        )
    else:
        link = F.when(reachable & aligned, "hard").otherwise("none")
    return s.withColumn("link", link).drop("n_bars", "bar_free", "avg_h", "gap", "n_pairs", "present")


def build_systems(
    staff: DataFrame,
    extents: DataFrame,
    connector: DataFrame | None = None,
    *,
    connector_aware: bool = True,
    explicit: bool = False,
    keys: Sequence[str] = KEYS,
) -> DataFrame:
    """Group staves (with ``pos``) into systems; adds ``link``, ``chain_size``, ``system_raw``.

    Adjacent-only union-find equals islands over ``pos``.  Deferred links survive only
    in chains of at least three staves.  With ``explicit`` a page that carries any
    ``system_index`` ≥ 0 is grouped by it (others alone).
    """
    page = Window.partitionBy(*keys)
    seq = page.orderBy("pos")
    s = system_links(staff, extents, connector, connector_aware=connector_aware, keys=keys)
    s = s.withColumn("_chain", F.sum((F.col("link") == "none").cast("int")).over(seq))
    s = s.withColumn("chain_size", F.count("*").over(Window.partitionBy(*keys, "_chain")))
    linked = (F.col("link") == "hard") | ((F.col("link") == "deferred") & (F.col("chain_size") >= 3))
    s = s.withColumn("system_raw", (F.sum((~linked).cast("int")).over(seq) - 1).cast("int"))
    if explicit:
        idx = F.when(F.col("system_index") >= 0, F.col("system_index"))
        grp = F.coalesce(idx, -1 - F.col("pos"))
        s = s.select("*", grp.alias("_g"), F.max(idx.isNotNull().cast("int")).over(page).alias("_any"))
        s = s.withColumn("_first", F.min("pos").over(Window.partitionBy(*keys, "_g")))
        by_index = (F.dense_rank().over(page.orderBy("_first")) - 1).cast("int")
        s = s.withColumn(
            "system_raw", F.when(F.col("_any") == 1, by_index).otherwise(F.col("system_raw"))
        ).drop("_g", "_any", "_first")
    return s.drop("_chain")


def vertical_runs(
    pixels: DataFrame,
    *,
    min_height: int = 18,
    max_height: int = 24,
    gap_fill: int = 2,
    keys: Sequence[str] = ("page_id",),
) -> DataFrame:
    """Vertical runs ``(x, y1, y2)`` of active pixels with a height limit.

    ``pixels``: one row per active (x, y) and the page height ``img_h``.  A gap of up to
    ``gap_fill`` pixels is closed (half of it at the page edge, as a symmetric closing
    does); heights from ``min_height - 1`` to ``max_height`` are kept.
    """
    if gap_fill % 2:
        raise ValueError("gap_fill must be even")
    col = Window.partitionBy(*keys, "x").orderBy("y")
    brk = F.col("y") - F.lag("y").over(col) > gap_fill + 1
    runs = pixels.withColumn("b", F.coalesce(brk.cast("int"), F.lit(0))).withColumn(
        "r", F.sum("b").over(col)
    )
    half = gap_fill // 2
    runs = runs.groupBy(*keys, "x", "r").agg(
        F.min("y").alias("a"), (F.max("y") + 1).alias("z"), F.max("img_h").alias("img_h")
    )
    y1 = F.when(F.col("a") <= half, 0).otherwise(F.col("a"))
    y2 = F.when(F.col("img_h") - F.col("z") <= half, F.col("img_h")).otherwise(F.col("z"))
    return runs.select(*keys, "x", y1.cast("int").alias("y1"), y2.cast("int").alias("y2")).where(
        (F.col("y2") - F.col("y1") >= max(min_height - 1, 1))
        & (F.col("y2") - F.col("y1") <= max_height)
    )
