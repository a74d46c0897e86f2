"""Column expressions over pixel boxes.

A box is four integer columns in the source-page frame.  Everything here is a
plain Catalyst expression (no UDF), so it stays inside whole-stage codegen and
can be used as a projection, a join residual or an aggregate input.

Rounding is half-even everywhere (``rint``); truncation is ``cast("int")``.
"""

from __future__ import annotations

from typing import NamedTuple, Optional

from pyspark.sql import Column
from pyspark.sql import functions as F

BOX = ("x1", "y1", "x2", "y2")

# Fixed padding used when two slender boxes are compared.
MIN_WIDTH = 12
X_MARGIN = 3
Y_MARGIN = 3


class Box(NamedTuple):
    x1: Column
    y1: Column
    x2: Column
    y2: Column


def box(prefix: str = "", suffix: str = "") -> Box:
    """Box made of the columns ``{prefix}x1{suffix}`` …"""
    return Box(*(F.col(f"{prefix}{c}{suffix}") for c in BOX))


def box_struct(b: Box) -> Column:
    return F.struct(*(c.alias(n) for c, n in zip(b, BOX)))


def of_struct(c: Column) -> Box:
    return Box(*(c.getField(n) for n in BOX))


def half_even(c: Column) -> Column:
    return F.rint(c).cast("int")


def lit(v) -> Column:
    return v if isinstance(v, Column) else F.lit(v)


def let(value: Column, fn) -> Column:
    """Bind a struct once and use it many times (keeps generated code small)."""
    return F.get(F.transform(F.array(value), fn), 0)


def clamp(c: Column, lo, hi) -> Column:
    return F.greatest(lit(lo), F.least(lit(hi), c))


# ---- extents -------------------------------------------------------------


def width(b: Box) -> Column:
    return b.x2 - b.x1


def height(b: Box) -> Column:
    return b.y2 - b.y1


def center_x(b: Box) -> Column:
    return (b.x1 + b.x2) / F.lit(2.0)


def center_y(b: Box) -> Column:
    return (b.y1 + b.y2) / F.lit(2.0)


def ordered(b: Box) -> Box:
    return Box(
        F.least(b.x1, b.x2), F.least(b.y1, b.y2), F.greatest(b.x1, b.x2), F.greatest(b.y1, b.y2)
    )


def area(b: Box) -> Column:
    zero = F.lit(0)
    # 12k-px pages overflow 32 bits once two extents are multiplied
    return F.greatest(width(b), zero).cast("bigint") * F.greatest(height(b), zero)


def intersection(a: Box, b: Box) -> Column:
    return area(
        Box(
            F.greatest(a.x1, b.x1),
            F.greatest(a.y1, b.y1),
            F.least(a.x2, b.x2),
            F.least(a.y2, b.y2),
        )
    )


# ---- padding and overlap ---------------------------------------------------


def expand_box(
    b: Box,
    *,
    min_width: int = MIN_WIDTH,
    x_margin: int = X_MARGIN,
    y_margin: int = Y_MARGIN,
    bounds: Optional[tuple] = None,
) -> Box:
    """Centred padding to ``min_width`` plus margins, clamped to the page.

    Order matters: half-even rounding, lower clamp at 0, upper clamp at
    ``bounds - 1``, then a one-pixel minimum extent.
    """
    if min_width < 1:
        raise ValueError("min_width must be at least 1")
    o = ordered(b)
    half = F.greatest(F.greatest(F.lit(1), width(o)) / F.lit(2.0), F.lit(min_width / 2.0))
    zero = F.lit(0)
    x1 = F.greatest(zero, half_even(center_x(o) - half) - x_margin)
    x2 = half_even(center_x(o) + half) + x_margin
    y1 = F.greatest(zero, o.y1 - y_margin)
    y2 = o.y2 + y_margin
    if bounds is not None:
        mx, my = lit(bounds[0]), lit(bounds[1])
        x1, x2 = F.least(x1, mx - 1), F.least(x2, mx - 1)
        y1, y2 = F.least(y1, my - 1), F.least(y2, my - 1)
    return Box(x1, y1, F.greatest(x2, x1 + 1), F.greatest(y2, y1 + 1))


def iou_expanded(a: Box, b: Box) -> Column:
    """IoU of boxes that are already padded (materialise padding once per row)."""
    inter = intersection(a, b)
    union = area(a) + area(b) - inter
    return F.when(union <= 0, F.lit(0.0)).otherwise(inter / union)


def iou(a: Box, b: Box, **pad) -> Column:
    return iou_expanded(expand_box(a, **pad), expand_box(b, **pad))


def span_overlap(lo_a, hi_a, lo_b, hi_b) -> Column:
    return F.least(hi_a, hi_b) - F.greatest(lo_a, lo_b)


def vertical_overlap(a: Box, b: Box) -> Column:
    """Overlap divided by the taller box."""
    o = span_overlap(a.y1, a.y2, b.y1, b.y2)
    one = F.lit(1)
    return F.when(o <= 0, F.lit(0.0)).otherwise(
        o / F.greatest(F.greatest(height(a), one), F.greatest(height(b), one))
    )


def axis_overlap(a: Box, b: Box, axis: str) -> Column:
    """Overlap divided by the smaller extent, along ``x`` or ``y``."""
    al, ah, bl, bh = (
        (a.x1, a.x2, b.x1, b.x2) if axis == "x" else (a.y1, a.y2, b.y1, b.y2)
    )
    o = F.greatest(F.lit(0), span_overlap(al, ah, bl, bh))
    return o / F.greatest(F.lit(1), F.least(ah - al, bh - bl))


def min_area_overlap(a: Box, b: Box) -> Column:
    one = F.lit(1).cast("bigint")
    smaller = F.least(
        F.greatest(one, width(a).cast("bigint") * height(a)),
        F.greatest(one, width(b).cast("bigint") * height(b)),
    )
    return intersection(a, b) / smaller


def center_distance_ratio(a: Box, b: Box) -> Column:
    one = F.lit(1)
    return F.abs(center_y(a) - center_y(b)) / F.greatest(
        F.greatest(one, height(a)), F.greatest(one, height(b))
    )


def staff_match(a: Box, b: Box) -> Column:
    return (axis_overlap(a, b, "y") > 0) & (center_distance_ratio(a, b) <= 0.5)


def band_iou(b: Box, band_lo: Column, band_hi: Column) -> Column:
    """Vertical IoU of a box and a band, each guarded to at least one pixel."""
    one = F.lit(1.0)
    inter = F.greatest(
        F.lit(0.0),
        F.least(band_hi, F.greatest(b.y1, b.y2)) - F.greatest(band_lo, F.least(b.y1, b.y2)),
    )
    band = F.greatest(one, band_hi - band_lo)
    tall = F.greatest(one, F.abs(b.y2 - b.y1))
    return inter / F.greatest(one, band + tall - inter)


def candidate_overlap(b: Box, band_lo: Column, band_hi: Column) -> Column:
    """Overlap with a band divided by the candidate's own height."""
    o = F.greatest(F.lit(0), span_overlap(b.y1, b.y2, band_lo, band_hi))
    return o / F.greatest(F.lit(1), height(b)).cast("double")


# ---- clipping and frames -----------------------------------------------------


def clip_box(b: Box, img_w, img_h) -> Column:
    """Struct clipped to the image, at least one pixel, NULL when impossible."""
    w, h = lit(img_w), lit(img_h)
    clipped = box_struct(Box(
        clamp(half_even(b.x1), 0, w - 1), clamp(half_even(b.y1), 0, h - 1),
        clamp(half_even(b.x2), 0, w), clamp(half_even(b.y2), 0, h),
    ))

    def at_least_one_pixel(v):
        x2 = F.when(v["x2"] <= v["x1"], F.least(w, v["x1"] + 1)).otherwise(v["x2"])
        y2 = F.when(v["y2"] <= v["y1"], F.least(h, v["y1"] + 1)).otherwise(v["y2"])
        return F.when(
            (x2 > v["x1"]) & (y2 > v["y1"]), box_struct(Box(v["x1"], v["y1"], x2, y2))
        )

    return let(clipped, at_least_one_pixel)


def to_original(b: Box, crop_x, crop_y, scale_x, scale_y, orig_w, orig_h) -> Box:
    """Predicted frame → page frame: unscale, shift by the crop, round, clamp."""
    sx, sy = lit(scale_x), lit(scale_y)
    ix = F.when(sx != 0, F.lit(1.0) / sx).otherwise(F.lit(0.0))
    iy = F.when(sy != 0, F.lit(1.0) / sy).otherwise(F.lit(0.0))
    w, h = lit(orig_w), lit(orig_h)
    x1 = clamp(half_even(b.x1 * ix + lit(crop_x)), 0, w - 1)
    x2 = clamp(half_even(b.x2 * ix + lit(crop_x)), 0, w - 1)
    y1 = clamp(half_even(b.y1 * iy + lit(crop_y)), 0, h - 1)
    y2 = clamp(half_even(b.y2 * iy + lit(crop_y)), 0, h - 1)
    return Box(x1, y1, F.greatest(x1, x2), F.greatest(y1, y2))


def downscale(b: Box, scale) -> Box:
    return Box(*((c / lit(scale)).cast("int") for c in b))


def upscale(b: Box, scale) -> Box:
    return Box(*(half_even(c * lit(scale)) for c in b))


def inferred_scale(sr_w, sr_h, orig_w, orig_h, *, tolerance: float = 0.05) -> Column:
    """Struct ``(scale, violation)`` for an upscaled image pair."""
    sx, sy = sr_w / orig_w, sr_h / orig_h
    s = half_even(sx)
    bad = (
        F.when((orig_w <= 0) | (orig_h <= 0), F.lit("invalid_dimensions"))
        .when((s < 2) | (F.abs(sx - s) > tolerance), F.lit("unexpected_x_scale"))
        .when(F.abs(sy - s) > tolerance, F.lit("unexpected_y_scale"))
    )
    return F.struct(F.when(bad.isNull(), s).alias("scale"), bad.alias("violation"))


# ---- derived boxes -------------------------------------------------------------


def measure_bars(b: Box, bar_width: int = 4) -> Column:
    """A measure box as an array of its left and right bar boxes."""
    half = bar_width // 2
    return F.array(
        box_struct(Box(b.x1 - half, b.y1, b.x1 + half, b.y2)),
        box_struct(Box(b.x2 - half, b.y1, b.x2 + half, b.y2)),
    )


def crop_size(
    b: Box, *, scale=3.0, aspect=0.5, min_h=48, max_h=256, min_w=16, max_w=128
) -> Column:
    h = clamp(half_even(F.greatest(F.lit(1.0), F.abs(b.y2 - b.y1)) * scale), min_h, max_h)
    w = clamp(half_even(h * F.lit(aspect)), min_w, max_w)
    return F.struct(w.alias("w"), h.alias("h"))


def unit_normalized(
    b: Box,
    unit: Column,
    img_w,
    img_h,
    *,
    norm_w=1.0,
    norm_h=4.0,
    apply_w=1.2,
    apply_h=4.6,
    min_h=2.5,
    min_aspect=3.0,
) -> Column:
    """Extra unit-sized box for tall or wide candidates; NULL when none is emitted."""

    def px(ratio, floor):
        return F.greatest(F.lit(floor), half_even(unit * ratio))

    w, h = F.abs(b.x2 - b.x1), F.abs(b.y2 - b.y1)
    wide, tall = w > px(apply_w, 1), h > px(apply_h, 1)
    size = F.struct(
        F.when(wide, px(norm_w, 2)).otherwise(w).alias("w"),
        F.when(tall, px(norm_h, 4)).otherwise(h).alias("h"),
    )
    cx, cy = center_x(b), center_y(b)
    nb = let(size, lambda s: clip_box(
        Box(
            half_even(cx - s["w"] / F.lit(2.0)), half_even(cy - s["h"] / F.lit(2.0)),
            half_even(cx + s["w"] / F.lit(2.0)), half_even(cy + s["h"] / F.lit(2.0)),
        ),
        img_w, img_h,
    ))
    eligible = (
        (h >= px(min_h, 1))
        & (w > 0)
        & (h / F.greatest(F.lit(1), w) >= min_aspect)
        & (wide | tall)
    )
    return F.when(eligible, let(nb, lambda n: F.when(n != box_struct(b), n)))


def connector_roi(up: Box, low: Box, img_w, img_h, mask_w, mask_h) -> Box:
    """Left-edge strip between two stacked staves, in mask pixels."""
    mw, mh = lit(mask_w), lit(mask_h)
    sx, sy = mw / lit(img_w), mh / lit(img_h)
    left = F.least(up.x1, low.x1)
    unit = F.greatest(F.lit(1.0), (height(up) + height(low)) / F.lit(2.0))
    x1 = clamp(half_even((left - unit * 0.65) * sx), 0, mw)
    x2 = clamp(half_even((left + unit * 0.80) * sx), 0, mw)
    y1 = clamp(half_even(up.y2 * sy), 0, mh)
    y2 = clamp(half_even(low.y1 * sy), 0, mh)
    x2 = F.when(x2 <= x1, F.least(mw, x1 + 1)).otherwise(x2)
    y2 = F.when(y2 <= y1, F.least(mh, y1 + 1)).otherwise(y2)
    return Box(x1, y1, x2, y2)


def shifted_retry(b: Box, fraction: float = 0.01) -> Box:
    w = width(b)
    dx = F.least(w - 1, F.greatest(F.lit(1), half_even(w * fraction)))
    return Box(F.when(w <= 1, b.x1).otherwise(b.x1 + dx), b.y1, b.x2, b.y2)


def inset_retry(b: Box, fraction: float = 0.0025) -> Box:
    w = width(b)
    d = F.least(F.greatest(F.lit(1), half_even(w * fraction)), F.floor((w - 1) / 2).cast("int"))
    ok = (w > 2) & (b.x1 + d < b.x2 - d)
    return Box(
        F.when(ok, b.x1 + d).otherwise(b.x1), b.y1, F.when(ok, b.x2 - d).otherwise(b.x2), b.y2
    )


# ---- units --------------------------------------------------------------------


def positive_finite(c: Column) -> Column:
    return c.isNotNull() & ~F.isnan(c) & (c > 0) & (c < float("inf"))


def staff_unit(explicit: Column, b: Box) -> Column:
    """Explicit spacing when usable, else height / 4, else NULL (a violation)."""
    return F.when(positive_finite(explicit), explicit).when(
        height(b) > 0, height(b) / F.lit(4.0)
    )


def system_unit_agg(explicit: Column, b: Box) -> Column:
    """Aggregate: exact median of explicit units, else median height / 4."""
    return F.coalesce(
        F.median(F.when(positive_finite(explicit), explicit)),
        F.median(F.when(height(b) > 0, height(b).cast("double"))) / 4.0,
    )


def seed_unit_agg(b: Box) -> Column:
    """Aggregate: max(1, median non-zero height / 4); NULL without boxes."""
    h = F.abs(b.y2 - b.y1)
    m = F.median(F.when(h > 0, h.cast("double")))
    return F.when(m.isNotNull(), F.greatest(F.lit(1.0), m / 4.0))


def scaled_knob(unit: Column, ratio: float, floor: int) -> Column:
    return F.when(unit.isNotNull(), F.greatest(F.lit(floor), half_even(unit * ratio)))


# ---- output geometry -------------------------------------------------------------


def label_font_size(median_height: Column) -> Column:
    return clamp(half_even(median_height * 0.28), 18, 96)


def label_box(font, row: Box, staff_top, text_w, text_h, page_w) -> Column:
    """Struct ``(x, y, placement)`` for a row label, with the gutter fallback."""
    gap = F.greatest(
        F.lit(6), F.floor(font / 6).cast("int"), ((row.y2 - row.y1) * F.lit(0.035)).cast("int")
    )
    x = F.greatest(F.lit(2), F.least(page_w - text_w - 2, row.x1 - gap - text_w))
    y = F.greatest(F.lit(2), staff_top - text_h - gap)
    inside = y <= 2
    return F.struct(
        x.cast("int").alias("x"),
        F.when(inside, F.greatest(F.lit(2), staff_top + gap)).otherwise(y).cast("int").alias("y"),
        F.when(inside, F.lit("inside_left_fallback"))
        .otherwise(F.lit("primary_left_gutter"))
        .alias("placement"),
    )


def physical_size(points_w, points_h, dpi_x, dpi_y, px_w, px_h) -> Column:
    """Struct ``(width_pt, height_pt, warning)``: captured, by DPI, else at 300 DPI."""
    captured = points_w.isNotNull() & points_h.isNotNull()
    has_dpi = positive_finite(dpi_x) & positive_finite(dpi_y)
    return F.struct(
        F.when(captured, points_w)
        .when(has_dpi, px_w * 72.0 / dpi_x)
        .otherwise(px_w * 72.0 / 300.0)
        .alias("width_pt"),
        F.when(captured, points_h)
        .when(has_dpi, px_h * 72.0 / dpi_y)
        .otherwise(px_h * 72.0 / 300.0)
        .alias("height_pt"),
        F.when(
            captured, F.when(positive_finite(points_w) & positive_finite(points_h), None).otherwise(
                F.lit("invalid_page_size_points"))
        )
        .when(~has_dpi | has_dpi.isNull(), F.lit("assumed_300_dpi"))
        .alias("warning"),
    )
