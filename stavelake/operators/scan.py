"""Ordered scans over long keys without one task per key.

A running value over a score with a third of all pages must not become one window
partition.  Rows are cut into blocks of consecutive ordinals, each block is reduced to
one summary row, the (short) block list is scanned, and block offsets are joined back.
"""

from __future__ import annotations

from typing import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialize


def running_sum(
    df: DataFrame, keys: Sequence[str], order: str, value: str, out: str, *, block: int = 1024
) -> DataFrame:
    """Inclusive running sum of ``value`` by integer ``order`` within ``keys``."""
    b = df.withColumn("_blk", F.floor(F.col(order) / block))
    tot = b.groupBy(*keys, "_blk").agg(F.sum(value).alias("_t"))
    w = Window.partitionBy(*keys).orderBy("_blk").rowsBetween(Window.unboundedPreceding, -1)
    off = tot.select(*keys, "_blk", F.coalesce(F.sum("_t").over(w), F.lit(0)).alias("_off"))
    inner = Window.partitionBy(*keys, "_blk").orderBy(order).rowsBetween(
        Window.unboundedPreceding, 0
    )
    return (
        b.withColumn(out, F.sum(value).over(inner))
        .join(off, [*keys, "_blk"])
        .withColumn(out, F.col(out) + F.col("_off"))
        .drop("_blk", "_off")
    )


def compose_starts(
    units: DataFrame, keys: Sequence[str], order: str, start: int, *, block: int = 1024
) -> DataFrame:
    """Counter value before each unit.

    ``units`` holds one summary per unit (a page): ``has_anchor`` and ``tail`` – the value
    after the unit when it restarts the counter, else the amount it adds.  Two levels of
    blocks keep any window at ``block`` rows plus one row per block.
    """
    b = units.withColumn("_blk", F.floor(F.col(order) / block))
    inner = Window.partitionBy(*keys, "_blk").orderBy(order)
    seg = F.sum(F.col("has_anchor").cast("int")).over(inner.rowsBetween(Window.unboundedPreceding, 0))
    b = b.withColumn("_seg", seg)
    run = Window.partitionBy(*keys, "_blk", "_seg").orderBy(order)
    # within a segment the first row carries the anchored value, later rows add to it
    b = b.withColumn(
        "_cum", F.sum("tail").over(run.rowsBetween(Window.unboundedPreceding, 0))
    )
    blocks = b.groupBy(*keys, "_blk").agg(
        F.max_by(F.struct("_seg", "_cum"), order).alias("e")
    ).select(*keys, "_blk", (F.col("e._seg") > 0).alias("_ha"), F.col("e._cum").alias("_tail"))
    bw = Window.partitionBy(*keys).orderBy("_blk")
    blocks = blocks.withColumn(
        "_bs", F.sum(F.col("_ha").cast("int")).over(bw.rowsBetween(Window.unboundedPreceding, 0))
    )
    bs = Window.partitionBy(*keys, "_bs").orderBy("_blk")
    blocks = blocks.withColumn(
        "_bcum", F.sum("_tail").over(bs.rowsBetween(Window.unboundedPreceding, 0))
    ).withColumn("_bval", F.when(F.col("_bs") > 0, F.col("_bcum")).otherwise(F.col("_bcum") + start))
    blocks = blocks.select(
        *keys, "_blk", F.coalesce(F.lag("_bval").over(bw), F.lit(start)).alias("_base")
    )
    b = b.join(blocks, [*keys, "_blk"])
    after = F.when(F.col("_seg") > 0, F.col("_cum")).otherwise(F.col("_cum") + F.col("_base"))
    b = b.withColumn("unit_next", after)
    return b.withColumn(
        "unit_start", F.coalesce(F.lag("unit_next").over(inner), F.col("_base"))
    ).drop("_blk", "_seg", "_cum", "_base")


def by_count(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """``df`` with ``_blk``, non-decreasing along ``order`` within ``keys``; blocks hold similar row counts.

    The blocks are range partitions with sampled bounds, as many as the session has shuffle
    partitions. A key of any size spreads over as many blocks as its share of the rows; rows equal
    in keys and order share one. The sample differs between runs, so the table is written
    once and every reader sees the same blocks.
    """
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    cut = df.repartitionByRange(parts, *keys, *order)
    return materialize(cut.withColumn("_blk", F.spark_partition_id()), "blocks")


def _same_block(b: DataFrame, ends: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Join on block and keys; null keys meet, as they do in a window."""
    ends = ends.select(*(F.col(k).alias(f"_e_{k}") for k in keys), F.col("_blk").alias("_e_blk"),
                       *(c for c in ends.columns if c not in keys and c != "_blk"))
    on = F.col("_blk") == F.col("_e_blk")
    for k in keys:
        on = on & F.col(k).eqNullSafe(F.col(f"_e_{k}"))
    return b.join(ends, on).drop("_e_blk", *(f"_e_{k}" for k in keys))


def previous(df: DataFrame, keys: Sequence[str], order: Sequence[str], value: Column, out: str) -> DataFrame:
    """``lag(value)`` by ``order`` within ``keys``, evaluated in blocks of similar size.

    Only the last row of every block crosses the block boundary.
    """
    b = by_count(df.withColumn("_val", value), keys, order)
    inner = Window.partitionBy(*keys, "_blk").orderBy(*order)
    ends = b.groupBy(*keys, "_blk").agg(
        F.max_by(F.struct("_val"), F.struct(*order)).alias("_end")
    )
    bw = Window.partitionBy(*keys).orderBy("_blk")
    ends = ends.select(*keys, "_blk", F.lag("_end").over(bw).getField("_val").alias("_prev"))
    b = b.withColumn("_first", F.row_number().over(inner) == 1).withColumn("_lag", F.lag("_val").over(inner))
    return (
        _same_block(b, ends, keys)
        .withColumn(out, F.when(F.col("_first"), F.col("_prev")).otherwise(F.col("_lag")))
        .drop("_blk", "_val", "_first", "_lag", "_prev")
    )


def row_numbers(df: DataFrame, keys: Sequence[str], order: Sequence[str], out: str) -> DataFrame:
    """1-based ``row_number`` by ``order`` within ``keys``, counted in blocks of similar size."""
    b = by_count(df, keys, order)
    w = Window.partitionBy(*keys).orderBy("_blk").rowsBetween(Window.unboundedPreceding, -1)
    off = b.groupBy(*keys, "_blk").agg(F.count("*").alias("_n")).select(
        *keys, "_blk", F.coalesce(F.sum("_n").over(w), F.lit(0)).alias("_off"))
    inner = Window.partitionBy(*keys, "_blk").orderBy(*order)
    return _same_block(b.withColumn(out, F.row_number().over(inner)), off, keys).withColumn(
        out, (F.col(out) + F.col("_off")).cast("bigint")).drop("_blk", "_off")
