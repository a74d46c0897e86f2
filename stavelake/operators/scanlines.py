"""Scan lines as prefix sums and as packed bits.

What a box holds of a line is two look-ups in its prefix sums; whether a pixel is set is a bit of a
64-bit word.  Both are made a batch of lines at a time, and no pixel becomes a row.
"""

from __future__ import annotations

from typing import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

PAGE = ("page_id",)


def lists_of(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    """All pixels of a batch on end, and how many each line has; missing pixels are 0, missing lines empty."""
    px = batch.column(batch.schema.get_field_index("px"))
    n = pc.fill_null(pc.list_value_length(px), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    flat = pc.fill_null(px.flatten(), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    return flat, n


def as_lists(values: np.ndarray, sizes: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(sizes)).astype(np.int32)), pa.array(values))


def _with(raster_rows: DataFrame, keys: Sequence[str], columns: str) -> T.StructType:
    return T.StructType([*raster_rows.select(*keys, "y").schema.fields, *T.StructType.fromDDL(columns).fields])


#: Prefix sums by letter: grey, squares, dark and non-zero pixels.
SUMS = {"s": lambda v, t: v, "q": lambda v, t: v * v, "d": lambda v, t: v < t, "z": lambda v, t: v > 0}


def integral_rows(raster_rows: DataFrame, *, threshold: int = 0, sums: str = "sqdz", keys: Sequence[str] = PAGE) -> DataFrame:
    """One row per scan line: its length ``n`` and an array of n + 1 prefix sums for each letter of ``sums``."""
    out = _with(raster_rows, keys, "n int, " + ", ".join(f"{k} array<bigint>" for k in sums))

    def prefix(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            flat, n = lists_of(b)
            start = np.append(0, np.cumsum(n))[:-1]
            at = np.arange(len(flat) + len(n)) - np.repeat(np.arange(len(n)), n + 1)
            made = []
            for k in sums:
                c = np.append(0, np.cumsum(SUMS[k](flat, threshold).astype(np.int64)))
                made.append(as_lists(c[at] - np.repeat(c[start], n + 1), n + 1))
            yield pa.RecordBatch.from_arrays([*(b.column(j) for j in range(len(keys) + 1)), pa.array(n.astype(np.int32)), *made], names=out.names)

    return raster_rows.select(*keys, "y", "px").mapInArrow(prefix, out)


def packed_rows(raster_rows: DataFrame, *, keys: Sequence[str] = PAGE) -> DataFrame:
    """One row per scan line with its non-zero pixels as bits of 64-bit ``words``, column 0 the lowest bit of the first."""
    out = _with(raster_rows, keys, "words array<bigint>")

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            flat, n = lists_of(b)
            words = -(-n // 64)
            place = np.arange(len(flat)) - np.repeat(np.append(0, np.cumsum(n))[:-1], n) + 64 * np.repeat(np.append(0, np.cumsum(words))[:-1], n)
            bits = np.zeros(64 * int(words.sum()), bool)
            bits[place] = flat > 0
            yield pa.RecordBatch.from_arrays(
                [*(b.column(j) for j in range(len(keys) + 1)), as_lists(np.packbits(bits, bitorder="little").view("<i8"), words)], names=out.names)

    return raster_rows.select(*keys, "y", "px").mapInArrow(pack, out)


def bit(words: Column, x: Column) -> Column:
    """Whether column ``x`` is set; columns beyond the line are not."""
    return F.coalesce(F.getbit(F.get(words, F.floor(x / 64).cast("int")), F.pmod(x, F.lit(64)).cast("int")) == 1, F.lit(False))


def entered_rows(packed: DataFrame, keys: Sequence[str] = PAGE) -> DataFrame:
    """``packed`` with ``enters``: bits that are set and were not on the line above, which is met by its number."""
    above = packed.select(*keys, (F.col("y") + 1).cast("int").alias("y"), F.col("words").alias("_above"))
    out = packed.join(above, [*keys, "y"], "left")
    new = F.zip_with("words", F.coalesce("_above", F.array().cast("array<bigint>")),
                     lambda a, b: F.coalesce(a, F.lit(0)).bitwiseAND(F.bitwise_not(F.coalesce(b, F.lit(0)))))
    return out.withColumn("enters", new).drop("_above")


def set_columns(words: Column) -> Column:
    """The set bits of an array of words as column numbers, lowest first."""
    each = F.transform(words, lambda w, i: F.transform(
        F.filter(F.sequence(F.lit(0), F.lit(63)), lambda b: F.getbit(w, b) == 1), lambda b: i * 64 + b))
    return F.flatten(each)


#: Scan lines in a block. A box meets a block once, whatever it covers of it.
BLOCK = 64
#: What a pixel adds to a table of sums: count, grey, squares, dark (missing pixels are not), non-zero.
PIXEL = {"n": lambda v, k, t: np.ones_like(v), "s": lambda v, k, t: v, "q": lambda v, k, t: v * v,
         "d": lambda v, k, t: (v < t) & k, "z": lambda v, k, t: v > 0}


def block_tables(layers: dict[str, DataFrame], tables: dict[str, tuple[str, str, int]], keys: Sequence[str] = PAGE) -> DataFrame:
    """One row per block of scan lines: its lines ``_h``, their width ``_w`` and an array for each of ``tables``.

    A table is named by its layer, its kind and a threshold. Entry (r, x) stands at r * (_w + 1) + x:

    * ``n s q d z``: sum over the lines before r and the columns before x, so any box takes four entries
    * ``line_n line_d``: sum over the columns before x of line r
    * ``enters``: set pixels of column x, not set on the line above, in the lines before r
    * ``stays``: whether column x is set on line r and on the line above
    * ``words``: column x alone as 64 bits, line 0 the lowest; entry x
    """
    at = F.floor(F.col("y") / BLOCK).cast("int")
    lines = None
    for name, rows in layers.items():
        # the last line of a block is also the line above the next
        part = rows.select(*keys, F.lit(name).alias("layer"), F.col("y").cast("int").alias("y"), F.col("px").cast("array<bigint>").alias("px"),
                           F.explode(F.when(F.pmod("y", F.lit(BLOCK)) == BLOCK - 1, F.array(at, at + 1)).otherwise(F.array(at))).alias("_blk"))
        lines = part if lines is None else lines.unionByName(part)
    ids = [*keys, "_blk"]
    out = T.StructType([*lines.select(*ids).schema.fields, *T.StructType.fromDDL(
        "_h int, _w int, " + ", ".join(f"{k} array<bigint>" for k in tables)).fields])

    def build(t: pa.Table) -> pa.Table:
        b = t.combine_chunks().to_batches()[0]
        flat, n = lists_of(b)
        known = pc.is_valid(b.column("px").flatten()).to_numpy(zero_copy_only=False)
        y = b.column("y").to_numpy() - b.column("_blk")[0].as_py() * BLOCK
        layer = b.column("layer").to_numpy(zero_copy_only=False)
        h, w = int(y.max()) + 1, int(n.max())
        row, x = np.repeat(y, n) + 1, np.arange(len(flat)) - np.repeat(np.cumsum(n) - n, n)
        made = []
        for name, kind, threshold in tables.values():
            on = np.repeat(layer == name, n)
            grid = np.zeros((h + 1, w), np.int64)
            each = PIXEL["z" if kind in ("enters", "stays", "words") else kind[-1]]
            np.add.at(grid, (row[on], x[on]), each(flat[on], known[on], threshold).astype(np.int64))
            if kind in PIXEL:
                table = np.zeros((h + 1, w + 1), np.int64)
                table[1:, 1:] = grid[1:].cumsum(0).cumsum(1)
            elif kind == "enters":
                table = np.zeros((h + 1, w + 1), np.int64)
                table[1:, :w] = ((grid[1:] > 0) & (grid[:-1] == 0)).cumsum(0)
            elif kind == "words":
                bits = np.zeros((w, BLOCK), bool)
                bits[:, :h] = grid[1:].T > 0
                table = np.packbits(bits, axis=1, bitorder="little").view("<i8").ravel()
            else:
                table = np.zeros((h, w + 1), np.int64)
                table[:, 1:] = grid[1:].cumsum(1)
                if kind == "stays":
                    table[:, :w], table[:, w] = (grid[1:] > 0) & (grid[:-1] > 0), 0
            made.append(as_lists(table.ravel(), np.array([table.size])))
        return pa.Table.from_arrays([*(b.column(k).slice(0, 1) for k in ids), pa.array([h], pa.int32()), pa.array([w], pa.int32()), *made], names=out.names)

    return lines.groupBy(*ids).applyInArrow(build, out)


def long_runs(columns: DataFrame, ids: Sequence[str], out: str) -> DataFrame:
    """Set bits in runs of at least ``need``: ``words`` holds each column's ``n`` words on end, column after column."""
    schema = T.StructType([*columns.select(*ids).schema.fields, T.StructField(out, T.LongType())])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lists = b.column("words")
            size = pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64)
            words = lists.flatten().to_numpy(zero_copy_only=False).astype("<i8")
            row = np.repeat(np.arange(len(size)), size)
            place = np.arange(len(words)) - np.repeat(np.cumsum(size) - size, size)
            first = place % np.repeat(b.column("n").to_numpy(), size) == 0
            # an unset bit before each column keeps its runs from those of the one before
            at = BLOCK * np.arange(len(words)) + np.cumsum(first)
            bits = np.zeros(BLOCK * len(words) + int(first.sum()) + 1, np.int8)
            bits[at[:, None] + np.arange(BLOCK)] = np.unpackbits(words.view(np.uint8), bitorder="little").reshape(-1, BLOCK)
            step = np.diff(bits, prepend=0)
            start, end = np.flatnonzero(step == 1), np.flatnonzero(step == -1)
            owner = row[np.searchsorted(at, start, side="right") - 1] if len(words) else row
            long = end - start >= b.column("need").to_numpy()[owner]
            total = np.zeros(len(size), np.int64)
            np.add.at(total, owner[long], (end - start)[long])
            yield pa.RecordBatch.from_arrays([*(b.column(k) for k in ids), pa.array(total)], names=schema.names)

    return columns.select(*ids, "n", "need", "words").mapInArrow(count, schema)
