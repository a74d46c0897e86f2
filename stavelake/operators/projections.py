"""Prefix sums and packed bits of scan lines, and the probe scan that is measured on them.

A scan line becomes one row of prefix sums, so what a box holds of it is two look-ups, or one row of
64-bit words, so runs and crossings are word operations.  Bands are summed over their lines into one
profile each; every candidate column is then measured from profiles and prefix sums, judged, and what
was rejected may be rescued by the accepted columns around it.
"""

from __future__ import annotations

from typing import Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import geometry as g
from ..session import materialize
from . import folds, joins, raster
from .scanlines import as_lists, integral_rows

PAGE = ("page_id",)
#: Scan lines summed by one task before the parts of a tall band are added up.
LINES_AT_ONCE = 128


# ---- band geometry ------------------------------------------------------------------------

#: The defaults of a probe scan.
DEFAULTS = dict(
    source="horiz_scan", scan_pad=0, scan_pad_ratio=0.0, row_pad_ratio=0.0, row_pad_mult=0.0, staff_space=0.0,
    height_mode="staff", height_scale=1.0, height_min=10, extend_scale=1.0,
    width=4, ink_threshold=180, min_distance=6, refine=4, max_peaks=8,
    scan_width=40, line_ratio=0.5, min_lines=3, center_on_peak=False, fallback_pred=False, peak_height=0,
    xpeak=False, window=12, xpeak_min=1.6, segment_height=0, ignore_peak=False, ignore_radius=1,
    x_tol=4, min_v_iou=0.0, divisi=False, divisi_dist=1.2, divisi_tol=4, divisi_count=2, divisi_ratio=0.5,
    rightmost=False, right_tol=6, right_rows=3, right_ratio=0.85, gap=False, gap_threshold=1.8, gap_min=0.5, gap_margin=0.1,
)


def page_sizes(raster_rows: DataFrame, keys: Sequence[str] = PAGE) -> DataFrame:
    return raster_rows.groupBy(*keys).agg((F.max("y") + 1).alias("h"), F.max(F.size("px")).alias("w"))


def band_geometry(bands: DataFrame, existing: DataFrame, pages: DataFrame, p: dict, keys: Sequence[str] = PAGE) -> DataFrame:
    """Each band (``y1``, ``y2``) with its scan base ``s1``/``s2``, its band ``b1``/``b2`` and the extended one ``e1``/``e2``.

    The band is the padded row for ``row_stats``; else it lies around the band's middle, as high
    as the band itself or as the median existing box: that of the band, else of the page, else
    the band's own height.  Without extension ``e1`` and ``e2`` are NULL.
    """
    ids = [*keys, "band_idx"]
    c = F.col
    d = bands.join(pages, list(keys))
    high = c("y2") - c("y1") + 1
    pad = g.half_even(high * p["scan_pad_ratio"]) if p["scan_pad_ratio"] > 0 else F.lit(int(p["scan_pad"]))
    pad = F.greatest(pad, F.lit(0)) if p["source"] == "horiz_scan" else F.lit(0)
    inside = p["source"] == "horiz_scan"
    s1 = F.when(pad > 0, F.greatest(F.lit(0), c("y1") - pad)).otherwise(c("y1")) if inside else c("y1")
    s2 = F.when(pad > 0, F.least(c("h") - 1, c("y2") + pad)).otherwise(c("y2")) if inside else c("y2")
    mid = g.half_even((c("y1") + c("y2")) / 2)
    if p["source"] == "row_stats":
        b1, b2 = F.greatest(F.lit(0), c("y1")), F.least(c("h") - 1, c("y2"))
        if p["row_pad_ratio"] > 0:
            more = g.half_even((b2 - b1 + 1) * p["row_pad_ratio"])
        else:
            more = F.lit(int(np.rint(p["staff_space"] * p["row_pad_mult"])) if p["row_pad_mult"] > 0 and p["staff_space"] > 0 else 0)
        b1, b2 = F.when(more > 0, F.greatest(F.lit(0), b1 - more)).otherwise(b1), F.when(more > 0, F.least(c("h") - 1, b2 + more)).otherwise(b2)
    else:
        target = F.greatest(F.lit(1), high)
        if p["height_mode"] == "median_box":
            # copies of a box are counted, then weigh as often in the median
            boxes = existing.groupBy(*keys, *g.BOX).agg(F.count(F.lit(1)).alias("_n")).withColumn("_h", F.abs(c("y2") - c("y1")))
            tall = boxes.where("_h > 0")
            page = tall.groupBy(*keys).agg(F.percentile("_h", 0.5, F.col("_n")).cast("int").alias("_page"))
            own = joins.boxes_in_bands(tall, bands.select(*ids, c("y1").alias("b1"), c("y2").alias("b2")), keys)
            own = own.groupBy(*ids).agg(F.percentile("_h", 0.5, F.col("_n")).cast("int").alias("_own"))
            d = d.join(own, ids, "left").join(page, list(keys), "left")
            median = F.coalesce("_own", "_page", F.lit(0))
            target = F.when(median != 0, F.greatest(F.lit(int(p["height_min"])), g.half_even(median * p["height_scale"]))).otherwise(target)
        half = F.floor(target / 2).cast("int")
        b1, b2 = F.greatest(F.lit(0), mid - half), F.least(c("h") - 1, mid + half)
    d = d.select(*ids, "y1", "y2", "h", "w", s1.cast("int").alias("s1"), s2.cast("int").alias("s2"),
                 mid.alias("_mid"), b1.cast("int").alias("b1"), b2.cast("int").alias("b2"))
    none = F.lit(None).cast("int")
    e1 = e2 = none
    if p["extend_scale"] > 1.0:
        own_h = F.greatest(F.lit(1), c("b2") - c("b1") + 1)
        ext = F.greatest(own_h, g.half_even(own_h * p["extend_scale"]))
        e1 = F.greatest(F.lit(0), g.half_even(c("_mid") - ext / 2)).cast("int")
        e2 = F.least(c("h") - 1, g.half_even(c("_mid") + ext / 2)).cast("int")
    return d.select(*ids, "y1", "y2", "s1", "s2", "b1", "b2", e1.alias("e1"), e2.alias("e2"), "h", "w")


def profiles(regions: DataFrame, raster_rows: DataFrame, *, threshold: int, width: int = 4, keys: Sequence[str] = PAGE) -> DataFrame:
    """Ink ratio of a stripe of ``width`` columns around each column of every region, as one array ``ratios``.

    ``regions`` (band_idx, role, ya, yb, d1, d2): lines ya to yb; columns outside d1 to d2 get 0.
    Lines are summed as whole arrays, a tall region in parts; no pixel becomes a row.
    """
    ids = [*keys, "band_idx", "role"]
    schema = T.StructType([*regions.select(*ids).schema.fields, *T.StructType.fromDDL("part int, ink array<int>").fields])
    final = T.StructType([*regions.select(*ids).schema.fields, *T.StructType.fromDDL("cum array<int>").fields])

    def total(table: pa.Table, column: str, below: int | None) -> np.ndarray:
        lists = table.column(column).combine_chunks()
        flat = pc.fill_null(lists.flatten(), 0).to_numpy(zero_copy_only=False)
        flat = (flat < below).astype(np.int64) if below is not None else flat.astype(np.int64)
        n = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        place = np.arange(len(flat)) - np.repeat(np.append(0, np.cumsum(n))[:-1], n)
        return np.bincount(place, weights=flat, minlength=int(n.max(initial=0))).astype(np.int32)

    def row(table: pa.Table, names: list[str], schema: T.StructType, values: np.ndarray) -> pa.Table:
        lists = as_lists(values, np.array([len(values)]))
        return pa.table([*(table.column(n).combine_chunks()[:1] for n in names), lists], names=schema.names)

    def lines(table: pa.Table) -> pa.Table:
        return row(table, [*ids, "part"], schema, total(table, "px", threshold))

    def parts(table: pa.Table) -> pa.Table:
        return row(table, ids, final, np.append(0, np.cumsum(total(table, "ink", None))).astype(np.int32))

    r = regions.select(*ids, F.explode(F.sequence("ya", "yb")).alias("y"))
    r = r.join(raster_rows.select(*keys, "y", "px"), [*keys, "y"]).withColumn("part", F.floor(F.col("y") / LINES_AT_ONCE).cast("int"))
    summed = r.groupBy(*ids, "part").applyInArrow(lines, schema).groupBy(*ids).applyInArrow(parts, final)
    d = regions.join(summed, ids)
    left = width // 2
    n = F.size("cum") - 1
    area = F.greatest(F.lit(1), F.col("yb") - F.col("ya") + 1) * width
    ratio = lambda x: F.when((x >= F.col("d1")) & (x <= F.col("d2")), (
        F.get("cum", F.least(n, x + width - left)) - F.get("cum", F.greatest(F.lit(0), x - left))) / area).otherwise(F.lit(0.0))
    return d.withColumn("ratios", F.transform(F.sequence(F.lit(0), n - 1), ratio)).drop("cum")


def band_profiles(geometry: DataFrame, domains: DataFrame, raster_rows: DataFrame, p: dict, keys: Sequence[str] = PAGE) -> DataFrame:
    """``ratios`` of each band and, with an extension, of the extended band, its top and its bottom, by ``role``."""
    c = F.col
    ids = [*keys, "band_idx"]
    roles = [("band", c("b1"), c("b2"))]
    if p["extend_scale"] > 1.0:
        roles += [("ext", c("e1"), c("e2")), ("top", c("e1"), c("b1") - 1), ("bottom", c("b2") + 1, c("e2"))]
    each = F.explode(F.array(*(F.struct(F.lit(n).alias("role"), a.alias("ya"), z.alias("yb")) for n, a, z in roles)))
    regions = geometry.select(*ids, each.alias("r")).select(*ids, "r.*").where("yb >= ya").join(domains, ids)
    return profiles(regions, raster_rows, threshold=p["ink_threshold"], width=p["width"], keys=keys)


# ---- candidates ------------------------------------------------------------------------------


def selected_columns(bands: DataFrame, p: dict, *, min_ratio: float, keys: Sequence[str] = PAGE) -> DataFrame:
    """Peaks of each band's profile, strongest first, moved to the largest ratio around them: (rank, seed_x, x, ratio)."""
    ids = [*keys, "band_idx"]
    signal = bands.select(*ids, "d1", "d2", F.posexplode("ratios").alias("x", "ratio"))
    peaks = folds.nearest_first_peaks(signal, min_ratio=min_ratio, min_distance=p["min_distance"], max_peaks=p["max_peaks"], keys=ids)
    d = peaks.select(*ids, "rank", F.col("x").alias("seed_x")).join(bands.select(*ids, "ratios"), ids)
    lo = F.greatest(F.lit(0), F.col("seed_x") - p["refine"])
    hi = F.least(F.size("ratios") - 1, F.col("seed_x") + p["refine"])
    near = F.slice("ratios", lo + 1, hi - lo + 1)
    return d.select(*ids, "rank", "seed_x", (lo + F.array_position(near, F.array_max(near)) - 1).cast("int").alias("x"), F.array_max(near).alias("ratio"))


def row_profile(geometry: DataFrame, dark: DataFrame, p: dict, keys: Sequence[str] = PAGE) -> DataFrame:
    """Ink of whole scan lines of each scan base: sum, mean and largest ratio, lines above the line ratio, first peak line."""
    ids = [*keys, "band_idx"]
    e = geometry.where("s2 > s1").select(*ids, "w", F.explode(F.sequence("s1", "s2")).alias("y"))
    e = e.join(dark, [*keys, "y"]).withColumn("k", F.get("d", F.col("n")))
    return e.groupBy(*ids).agg(
        (F.sum("k") / (F.count(F.lit(1)) * F.max("w"))).alias("row_mean"), (F.max("k") / F.max("w")).alias("row_max"),
        F.sum((F.col("k") / F.col("w") >= p["line_ratio"]).cast("bigint")).alias("row_lines"),
        F.min_by("y", F.struct(-F.col("k"), F.col("y"))).alias("peak_row"))


def scan_bands(cands: DataFrame, dark: DataFrame, p: dict, keys: Sequence[str] = PAGE) -> DataFrame:
    """(x, top, bottom): the tightest group of staff lines in a strip around each candidate column."""
    at = [*keys, "band_idx", "x"]
    half = p["scan_width"] // 2
    a, z = F.greatest(F.lit(0), F.col("x") - half), F.least(F.col("w") - 1, F.col("x") + half)
    e = cands.select(*at, "s1", "s2", a.alias("_a"), z.alias("_z")).distinct().where("s2 > s1 AND _z > _a")
    e = e.select(*at, "_a", "_z", F.explode(F.sequence("s1", "s2")).alias("y")).join(dark, [*keys, "y"])
    ratio = (F.get("d", F.col("_z") + 1) - F.get("d", F.col("_a"))) / (F.col("_z") - F.col("_a") + 1)
    return raster.tightest_lines(e.select(*at, "y", ratio.alias("ratio")), line_ratio=p["line_ratio"], min_lines=p["min_lines"], keys=at)


def _contrast(sums: Sequence[Column]) -> Column:
    """Middle stripe against the median of the others; NULL where that is not positive.  Stripes off the page are NULL."""
    mid = len(sums) // 2
    others = F.array_sort(F.array_compact(F.array(*(s for k, s in enumerate(sums) if k != mid))))
    n = F.size(others)
    half = F.floor(n / 2).cast("int")
    median = F.when(n % 2 == 1, F.get(others, half).cast("double")).otherwise((F.get(others, half - 1) + F.get(others, half)) / 2.0)
    return F.when((n > 0) & (median > 0), sums[mid] / median)


def scan_segments(cands: DataFrame, dark: DataFrame, p: dict, keys: Sequence[str] = PAGE) -> DataFrame:
    """Sums of each candidate by segment of its scan band: rectangles, and the stripes around its column.

    ``cands`` carry scan_y1, scan_y2, peak_row, x_e1, x_e2 and the columns sx1 to sx2.  One row
    per candidate and line meets the line's prefix sums; each stripe is two look-ups.
    Lines outside the scan band have no segment.
    """
    c = F.col
    at = [*keys, "band_idx", "rank"]
    lo = F.least("scan_y1", "peak_row", "x_e1")
    hi = F.greatest("scan_y2", "peak_y2", "x_e2")
    e = cands.select(*at, "x", "w", "sx1", "sx2", "scan_y1", "scan_y2", "peak_row", "peak_y2", "x_e1", "x_e2",
                     F.explode(F.sequence(lo, hi)).alias("y")).join(dark, [*keys, "y"])
    v = F.get("d", F.least(c("n"), c("sx2") + 1)) - F.get("d", F.least(c("n"), c("sx1")))
    scan = c("y").between(c("scan_y1"), c("scan_y2"))
    seg_h = max(1, p["segment_height"])
    seg = F.when(scan, F.floor((c("y") - c("scan_y1")) / seg_h) if p["segment_height"] > 0 else F.lit(0)).cast("int")
    kept = scan & ~(F.coalesce(F.abs(c("y") - c("peak_row")) <= p["ignore_radius"], F.lit(False)) if p["ignore_peak"] else F.lit(False))
    left, width = p["width"] // 2, p["width"]

    def stripe(k: int) -> Column:
        x = c("x") + k
        own = F.get("d", F.least(c("n"), x + width - left)) - F.get("d", F.greatest(F.lit(0), x - left))
        return F.sum(F.when((x >= 0) & (x < c("w")), F.when(kept, own).otherwise(0)))

    within = lambda a, z: F.sum(F.when(c("y").between(a, z), v).otherwise(0))
    around = [stripe(k).alias(f"k{k + p['window']}") for k in range(-p["window"], p["window"] + 1)] if p["xpeak"] else []
    return e.groupBy(*at, seg.alias("segment")).agg(
        F.count(F.lit(1)).alias("n_lines"), within(c("scan_y1"), c("scan_y2")).alias("ink"), within(c("peak_row"), c("peak_y2")).alias("ink_peak"),
        within(c("x_e1"), c("x_e2")).alias("ink_ext"), within(c("x_e1"), c("scan_y1") - 1).alias("ink_top"),
        within(c("scan_y2") + 1, c("x_e2")).alias("ink_bottom"), *around)


def _stripes(p: dict) -> list[Column]:
    return [F.col(f"k{k}") for k in range(2 * p["window"] + 1)]


def segment_contrast(segments: DataFrame, p: dict) -> DataFrame:
    """``contrast`` of each segment of a scan band."""
    return segments.where("segment IS NOT NULL").withColumn("contrast", _contrast(_stripes(p)))


def placed_candidates(cands: DataFrame, geometry: DataFrame, existing: DataFrame, dark: DataFrame, p: dict, keys: Sequence[str] = PAGE) -> DataFrame:
    """Candidates with the lines that each is measured on.

    The scan band is the tightest group of lines around the column, else the nearest existing
    box (if allowed), else the band; or it is centred on the peak line of the scan base.
    """
    c = F.col
    ids = [*keys, "band_idx"]
    d = cands.join(geometry, ids)
    found = scan_bands(d, dark, p, keys)
    d = d.join(row_profile(geometry, dark, p, keys), ids, "left").join(found, [*ids, "x"], "left")
    y1, y2 = c("b1"), c("b2")
    if p["fallback_pred"]:
        near = joins.nearest_existing(cands.select(*ids, c("x").alias("col")), existing, geometry.select(*ids, c("y1").alias("b1"), c("y2").alias("b2")), keys)
        d = d.join(near.select(*ids, c("col").cast("int").alias("x"), "pred_y1", "pred_y2"), [*ids, "x"], "left")
        y1, y2 = F.coalesce("pred_y1", y1), F.coalesce("pred_y2", y2)
    own_h = F.greatest(F.lit(1), c("b2") - c("b1") + 1)
    y1, y2 = F.coalesce("top", y1), F.coalesce("bottom", y2)
    if p["center_on_peak"]:
        ph = F.lit(int(p["peak_height"])) if p["peak_height"] > 0 else own_h
        first = F.greatest(F.lit(0), c("peak_row") - F.floor(ph / 2)).cast("int")
        y1, y2 = F.when(c("peak_row").isNotNull(), first).otherwise(y1), F.when(c("peak_row").isNotNull(), F.least(c("h") - 1, first + ph - 1)).otherwise(y2)
    d = d.withColumns({"scan_y1": y1.cast("int"), "scan_y2": y2.cast("int")})
    d = d.withColumn("scan_h", F.greatest(F.lit(1), c("scan_y2") - c("scan_y1") + 1))
    peak_h = F.lit(int(p["peak_height"])) if p["peak_height"] > 0 else c("scan_h")
    d = d.withColumns({
        "sx1": F.greatest(F.lit(0), g.half_even(c("x") - p["width"] / 2)).cast("int"),
        "sx2": F.least(c("w") - 1, g.half_even(c("x") + p["width"] / 2)).cast("int"),
        "peak_y2": F.least(c("h") - 1, c("peak_row") + peak_h - 1).cast("int")})
    none = F.lit(None).cast("int")
    if p["extend_scale"] <= 1.0:
        return d.withColumns({"x_e1": none, "x_e2": none})
    ext = F.greatest(c("scan_h"), g.half_even(c("scan_h") * p["extend_scale"]))
    mid = g.half_even((c("scan_y1") + c("scan_y2")) / 2)
    return d.withColumns({"x_e1": F.greatest(F.lit(0), g.half_even(mid - ext / 2)).cast("int"),
                          "x_e2": F.least(c("h") - 1, g.half_even(mid + ext / 2)).cast("int")})


def measure(placed: DataFrame, dark: DataFrame, p: dict, keys: Sequence[str] = PAGE) -> DataFrame:
    """What the acceptance ladder reads of every candidate: scan, peak, extended, top and bottom ratios, contrast, segments.

    Without a horizontal scan none of it is measured.
    """
    c = F.col
    at = [*keys, "band_idx", "rank"]
    if p["source"] != "horiz_scan":
        return placed.select(*at, *(F.lit(None).cast("double").alias(n) for n in (
            "scan_ratio", "scan_peak", "scan_ext", "scan_top", "scan_bottom", "xpeak", "seg_min", "seg_pass")))
    segments = scan_segments(placed, dark, p, keys)
    sums = [F.sum(n).alias(n) for n in ("ink", "ink_peak", "ink_ext", "ink_top", "ink_bottom")]
    more = []
    if p["xpeak"]:
        segments = segments.withColumn("_c", F.when(c("segment").isNotNull(), _contrast(_stripes(p))))
        in_scan = lambda n: F.sum(F.when(c("segment").isNotNull(), c(n)))
        more = [in_scan(f"k{k}").alias(f"k{k}") for k in range(2 * p["window"] + 1)]
        more += [F.min("_c").alias("_min"), F.avg((c("_c") >= p["xpeak_min"]).cast("double")).alias("_pass")]
    t = placed.select(*at, "scan_y1", "scan_y2", "scan_h", "peak_row", "peak_y2", "x_e1", "x_e2", "sx1", "sx2").join(
        segments.groupBy(*at).agg(*sums, *more), at)
    wide = F.greatest(F.lit(1), c("sx2") - c("sx1") + 1)
    part = lambda n, high, ok: F.when(ok, c(n) / (high * wide)).cast("double")
    high_top, high_bottom = c("scan_y1") - c("x_e1"), c("x_e2") - c("scan_y2")
    split = p["xpeak"] and p["segment_height"] > 0
    return t.select(
        *at, part("ink", c("scan_h"), F.lit(True)).alias("scan_ratio"),
        part("ink_peak", F.greatest(F.lit(1), c("peak_y2") - c("peak_row") + 1), c("peak_row") <= c("peak_y2")).alias("scan_peak"),
        part("ink_ext", F.greatest(F.lit(1), c("x_e2") - c("x_e1") + 1), c("x_e1").isNotNull()).alias("scan_ext"),
        part("ink_top", high_top, high_top > 0).alias("scan_top"), part("ink_bottom", high_bottom, high_bottom > 0).alias("scan_bottom"),
        (_contrast(_stripes(p)) if p["xpeak"] else F.lit(None)).cast("double").alias("xpeak"),
        (c("_min") if split else F.lit(None)).cast("double").alias("seg_min"), (c("_pass") if split else F.lit(None)).cast("double").alias("seg_pass"))


def divisi_positions(bands: DataFrame, existing: DataFrame, pages: DataFrame, domains: DataFrame, raster_rows: DataFrame, p: dict,
                     keys: Sequence[str] = PAGE) -> DataFrame:
    """(band_idx, x, kind): where each band may hold a bar that goes on into the next one.

    Centres of existing boxes belong to the first band that holds them, else to the nearest;
    ink peaks come from the band's own profile.  ``kind`` is ``box`` or ``ink``.
    """
    c = F.col
    ids = [*keys, "band_idx"]
    own = band_geometry(bands, existing, pages, p | {"height_mode": "staff", "extend_scale": 1.0, "row_pad_ratio": 0.0, "row_pad_mult": 0.0}, keys)
    b1, b2 = ("y1", "y2") if p["source"] == "row_stats" else ("b1", "b2")
    regions = own.select(*ids, F.lit("divisi").alias("role"), c(b1).alias("ya"), c(b2).alias("yb")).where("yb >= ya").join(domains, ids)
    prof = profiles(regions, raster_rows, threshold=p["ink_threshold"], width=p["width"], keys=keys)
    r = c("ratios")
    n = F.size(r)
    ok = lambda x: (F.get(r, x) >= p["divisi_ratio"]) & (F.get(r, x) >= F.get(r, F.pmod(x - 1, n))) & (F.get(r, x) >= F.get(r, F.pmod(x + 1, n)))
    ink = prof.where(n >= 3).select(*ids, F.explode(F.filter(F.sequence("d1", "d2"), ok)).alias("x")).select(
        *ids, F.col("x").cast("double").alias("x"), F.lit("ink").alias("kind"))
    box = joins.assign_to_bands(existing, bands.select(*ids, c("y1").alias("b1"), c("y2").alias("b2")), keys).select(
        *ids, g.center_x(g.box()).cast("double").alias("x"), F.lit("box").alias("kind"))
    return box.unionByName(ink)


# ---- the scan ---------------------------------------------------------------------------------


def _flag(cands: DataFrame, existing: DataFrame, p: dict, name: str, lo: str, hi: str, keys: Sequence[str]) -> DataFrame:
    """``cands`` with ``name``: an existing box stands at the column."""
    at = [*keys, "band_idx", "rank"]
    free = joins.suppress_existing(cands.select(*at, F.col("x").alias("col"), F.col(lo).alias("b1"), F.col(hi).alias("b2")), existing,
                                   x_tol=p["x_tol"], min_v_iou=p["min_v_iou"], keys=keys)
    return cands.join(free.select(*at, F.lit(False).alias(name)), at, "left").withColumn(name, F.coalesce(name, F.lit(True)))


def judged(cands: DataFrame, existing: DataFrame, bands: DataFrame, pages: DataFrame, domains: DataFrame, raster_rows: DataFrame,
           prof: DataFrame, measured: DataFrame, p: dict, ladder: dict, keys: Sequence[str] = PAGE) -> DataFrame:
    """Candidates with all measured columns, the flags, and their ``status``."""
    c = F.col
    ids, at = [*keys, "band_idx"], [*keys, "band_idx", "rank"]
    d = cands.join(measured, at)
    there = {"ext": "ext", "top": "ext_top", "bottom": "ext_bottom"}
    if p["extend_scale"] > 1.0:
        wide = prof.where(c("role") != "band").groupBy(*ids).agg(*(F.max_by("ratios", F.when(c("role") == r, 1)).alias(f"_{n}") for r, n in there.items()))
        d = d.join(wide, ids, "left").withColumns({n: F.get(f"_{n}", c("x")) for n in there.values()})
    else:
        d = d.withColumns({n: F.lit(None).cast("double") for n in there.values()})
    flags = bands.select(*ids, F.lit(False).alias("divisi_top"), F.lit(False).alias("divisi_bottom"))
    if p["divisi"]:
        xs = divisi_positions(bands, existing, pages, domains, raster_rows, p, keys)
        flags = joins.divisi_links(bands.select(*ids, c("y1").alias("b1"), c("y2").alias("b2")), xs, dist_ratio=p["divisi_dist"],
                                   align_tol=p["divisi_tol"], min_count=p["divisi_count"], keys=keys).select(
            *ids, c("has_top").alias("divisi_top"), c("has_bottom").alias("divisi_bottom"))
    d = d.join(flags, ids, "left")
    d = _flag(d, existing, p, "existing", "y1", "y2", keys)
    rel = F.when(c("scan_peak") > 0, c("scan_ratio") / F.greatest("scan_peak", F.lit(1e-6)))
    d = d.withColumn("rel_ratio", rel if ladder["use_peak_relative"] else F.lit(None).cast("double"))
    return d.withColumn("status", raster.acceptance(ladder))


def probe_scan(bands: DataFrame, existing: DataFrame, raster_rows: DataFrame, p: dict, ladder: dict, *,
               domains: DataFrame | None = None, keys: Sequence[str] = PAGE) -> DataFrame:
    """The whole scan: one row per selected peak with its status, its box, and whether it is a bar.

    ``bands`` (band_idx, y1, y2), ``existing`` boxes with ``ord``, and scan lines.  After the
    ladder two passes look at what it rejected: near the common right end of the page's bands,
    and in large gaps between accepted and existing bars.  ``found`` is true for accepted and
    rescued columns.  Profiles, candidates and records feed several branches and are written to the
    shared folder once.  ``p`` overrides ``DEFAULTS``; ``ladder`` holds the acceptance thresholds.
    """
    p = DEFAULTS | p
    c = F.col
    ids, at = [*keys, "band_idx"], [*keys, "band_idx", "rank"]
    pages = page_sizes(raster_rows, keys)
    geometry = band_geometry(bands, existing, pages, p, keys)
    if domains is None:
        domains = geometry.select(*ids, F.lit(0).alias("d1"), (c("w") - 1).alias("d2"))
    dark = integral_rows(raster_rows, threshold=p["ink_threshold"], sums="d", keys=keys)
    prof = materialize(band_profiles(geometry, domains, raster_rows, p, keys), "profiles")
    least = min(ladder["min_ratio"], p["gap_min"]) if p["gap"] else ladder["min_ratio"]
    cands = selected_columns(prof.where("role = 'band'"), p, min_ratio=least, keys=keys)
    placed = materialize(placed_candidates(cands, geometry, existing, dark, p, keys), "candidates")
    d = judged(placed.select(*at, "seed_x", "x", "ratio", "y1", "y2", "b1", "b2", "sx1", "sx2"), existing, bands, pages, domains,
               raster_rows, prof, measure(placed, dark, p, keys), p, ladder, keys)
    limited = c("status") == "scan_ratio_rel_low_rescued_limited"
    accepted = limited | c("status").startswith("accepted")
    d = _flag(d, existing, p, "_again", "b1", "b2", keys).withColumns({
        "accepted": accepted, "rec_id": (c("band_idx") * (1 << 20) + c("rank")).cast("bigint"),
        "col": c("x").cast("double"), "_ratio": F.coalesce("scan_ratio", "ratio")})
    d = materialize(d, "records")
    bad = d.where(~c("accepted") & (c("status") != "existing")).select(
        *keys, "band_idx", "col", "status", "rec_id", c("_ratio").alias("ratio"), c("_again").alias("existing"))
    out = d
    saved = []
    if p["rightmost"]:
        # columns accepted without a rescue, where the page has any
        safe = d.where(c("status") == "accepted")
        rest = d.where("accepted").join(safe.select(*keys).distinct(), list(keys), "left_anti")
        right = raster.rightmost_rescue(safe.select(*ids, "col").unionByName(rest.select(*ids, "col")), bad, tolerance=p["right_tol"],
                                        min_rows=p["right_rows"], min_ratio=p["right_ratio"], keys=keys)
        saved.append(right.select(*keys, "rec_id", F.lit("rightmost").alias("rescue")))
    if p["gap"]:
        mates = joins.boxes_in_bands(existing.select(*keys, *g.BOX).distinct(), bands.select(*ids, c("y1").alias("b1"), c("y2").alias("b2")), keys)
        mates = mates.groupBy(*keys, *g.BOX).agg(F.min("band_idx").alias("band_idx"))
        pool = d.where("accepted").select(*ids, c("col").alias("x")).unionByName(mates.select(*ids, g.center_x(g.box()).cast("double").alias("x")))
        gaps = raster.gap_rescue(pool, bad, threshold_ratio=p["gap_threshold"], min_ratio=p["gap_min"], margin_ratio=p["gap_margin"], keys=keys)
        saved.append(gaps.select(*keys, "rec_id", F.lit("gap").alias("rescue")))
    if saved:
        both = saved[0] if len(saved) == 1 else saved[0].unionByName(saved[1])
        both = both.groupBy(*keys, "rec_id").agg(F.array_join(F.array_sort(F.collect_set("rescue")), ",").alias("rescue"))
        out = out.join(both, [*keys, "rec_id"], "left")
    else:
        out = out.withColumn("rescue", F.lit(None).cast("string"))
    return out.select(
        *at, "seed_x", "x", "ratio", "scan_ratio", "status", F.coalesce("rescue", F.lit("")).alias("rescue"),
        (c("accepted") | c("rescue").isNotNull()).alias("found"), c("sx1").alias("x1"), c("b1").alias("y1"), c("sx2").alias("x2"), c("b2").alias("y2"))
