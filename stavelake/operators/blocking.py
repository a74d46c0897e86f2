"""Blocking helpers: turn range and box predicates into equi-joins on grid cells.

Spark has no band-join strategy.  A page is therefore cut into cells, the small or
de-duplicated side is replicated to the cells it touches and the join runs on
``keys + cell`` with the exact predicate as a residual.  A page that holds a large
part of the corpus is spread over as many partitions as it has cells, and no
partner is ever capped: the cell only decides *where* a pair is tested.
"""

from __future__ import annotations

from typing import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import geometry as g


def cell_of(c: Column, size: float) -> Column:
    return F.floor(c / F.lit(float(size))).cast("int")


def cells(lo: Column, hi: Column, size: float) -> Column:
    """Array of the cells touched by the closed range ``[lo, hi]``."""
    a = cell_of(lo, size)
    return F.sequence(a, F.greatest(a, cell_of(hi, size)))


def interval_pairs(
    left: DataFrame,
    right: DataFrame,
    on: Sequence[str],
    left_range: tuple[str, str],
    right_range: tuple[str, str],
    *,
    cell: float = 256,
) -> DataFrame:
    """Inner join of rows whose closed ranges intersect; every pair appears once.

    A pair is emitted only in the cell where the later of both ranges starts, so
    no distinct is needed afterwards.  Column names must be disjoint except ``on``.
    """
    (la, lb), (ra, rb) = left_range, right_range
    l = left.withColumn("_cell", F.explode(cells(F.col(la), F.col(lb), cell)))
    r = right.withColumn("_cell_r", F.explode(cells(F.col(ra), F.col(rb), cell)))
    for k in on:
        r = r.withColumnRenamed(k, f"_r_{k}")
    cond = (F.col("_cell") == F.col("_cell_r")) & (F.col(la) <= F.col(rb)) & (
        F.col(ra) <= F.col(lb)
    ) & (F.greatest(cell_of(F.col(la), cell), cell_of(F.col(ra), cell)) == F.col("_cell"))
    for k in on:
        cond = cond & (F.col(k) == F.col(f"_r_{k}"))
    return l.join(r, cond).drop("_cell", "_cell_r", *(f"_r_{k}" for k in on))


def expanded(df: DataFrame, prefix: str, src: g.Box | None = None, **pad) -> DataFrame:
    """Evaluate the padded box once per row as ``{prefix}x1`` …"""
    e = g.expand_box(src or g.box(), **pad)
    return pin(df, df.columns, **{f"{prefix}{n}": c for c, n in zip(e, g.BOX)})


def iou_anchor(df: DataFrame, prefix: str, cell: int) -> DataFrame:
    """One grid cell per box: the one holding the centre of the padded box."""
    b = g.box(prefix)
    return df.select(
        "*",
        cell_of(g.center_x(b), cell).alias("_cx"),
        cell_of(g.center_y(b), cell).alias("_cy"),
    )


def iou_cover(df: DataFrame, prefix: str, cell: int, threshold: float) -> DataFrame:
    """All grid cells in which the centre of a partner can lie.

    For IoU ≥ 0.5 the partner's centre lies inside the box on both axes; below that
    it can be off by at most extent / (2·threshold).
    """
    if threshold <= 0:
        raise ValueError("an overlap threshold of 0 or less bounds no partner")
    b = g.box(prefix)
    k = 0.0 if threshold >= 0.5 else 1.0 / (2.0 * threshold)
    mx, my = g.width(b) * F.lit(k), g.height(b) * F.lit(k)
    return df.select("*", F.explode(cells(b.x1 - mx, b.x2 + mx, cell)).alias("_cx")).select(
        "*", F.explode(cells(b.y1 - my, b.y2 + my, cell)).alias("_cy")
    )


def eq(left: DataFrame, right: DataFrame, names: Sequence[str]) -> Column:
    cond = F.lit(True)
    for n in names:
        cond = cond & (left[n] == right[n])
    return cond


def pin(df: DataFrame, keep: Sequence[str], **cols: Column) -> DataFrame:
    """Evaluate columns once: a one-row generator keeps the optimizer from inlining them
    into every later use."""
    return df.select(*keep, F.inline(F.array(F.struct(*(c.alias(n) for n, c in cols.items())))))
