"""Order-dependent folds (greedy keep, merge, suppress) as native array aggregates.

A greedy pass only couples elements that can touch each other.  Before folding, the
elements of a page are therefore cut into independent islands wherever the geometry
rules any contact out; the result is identical to one pass over the page, while the
arrays stay small and a crowded page spreads over many groups.
"""

from __future__ import annotations

from typing import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import KEYS
from ..functions import geometry as g


def _islands(df: DataFrame, keys: Sequence[str], order: Sequence, brk: Column) -> DataFrame:
    """Number runs of rows by ``order``; ``brk`` is true where a new run must start."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_b", F.coalesce(brk.cast("int"), F.lit(0))).withColumn(
        "_isl", F.sum("_b").over(w.rowsBetween(Window.unboundedPreceding, 0))
    ).drop("_b")


def nearest_first_peaks(
    signal: DataFrame,
    *,
    min_ratio: float,
    min_distance: int,
    max_peaks: int = 0,
    keys: Sequence[str] = ("page_id", "band_idx"),
) -> DataFrame:
    """Local maxima of a column signal, strongest first, spaced and capped.

    ``signal``: (x, ratio) for every column of the band plus its domain ``d1``/``d2``.  A
    column is a peak when it reaches ``min_ratio`` and both neighbours, the page edges
    wrapping around.  One row per column: a band holds at most its width.
    """
    w = Window.partitionBy(*keys).orderBy("x")
    every = Window.partitionBy(*keys)
    left = F.coalesce(F.lag("ratio").over(w), F.max_by("ratio", "x").over(every))
    right = F.coalesce(F.lead("ratio").over(w), F.min_by("ratio", "x").over(every))
    peaks = signal.select("*", left.alias("_l"), right.alias("_r")).where(
        (F.col("ratio") >= min_ratio) & (F.col("ratio") >= F.col("_l"))
        & (F.col("ratio") >= F.col("_r")) & (F.col("x") >= F.col("d1")) & (F.col("x") <= F.col("d2"))
    )
    ranked = F.array_sort(F.collect_list(F.struct((-F.col("ratio")).alias("nr"), F.col("x"))))
    arr = peaks.groupBy(*keys).agg(ranked.alias("p"), F.count("*").alias("n_peaks"))
    full = (lambda acc: F.size(acc) >= max_peaks) if max_peaks > 0 else (lambda acc: F.lit(False))
    kept = F.aggregate(
        "p", F.filter("p", lambda v: F.lit(False)),
        lambda acc, v: F.when(
            full(acc) | F.exists(acc, lambda k: F.abs(k["x"] - v["x"]) < min_distance), acc
        ).otherwise(F.concat(acc, F.array(v))),
    )
    return arr.select(*keys, "n_peaks", F.posexplode(kept).alias("rank", "v")).select(
        *keys, "n_peaks", "rank", F.col("v.x").alias("x"), (-F.col("v.nr")).alias("ratio"))


def merge_runs(
    runs: DataFrame,
    *,
    y_tol: int = 4,
    max_width: int = 4,
    keys: Sequence[str] = ("page_id",),
) -> DataFrame:
    """Merge neighbouring one-column runs into boxes; wide results are dropped.

    A run joins the box under construction when it starts ≤ 1 column further and both ends
    are within ``y_tol`` of the *accumulated* ends.  A pass breaks for certain where the
    column gap exceeds two or an end moves by more than twice the tolerance.
    """
    r = runs.select(*keys, "x", "y1", "y2").distinct()
    w = Window.partitionBy(*keys).orderBy("x", "y1", "y2")
    brk = (
        (F.col("x") - F.lag("x").over(w) > 2)
        | (F.abs(F.col("y1") - F.lag("y1").over(w)) > 2 * y_tol)
        | (F.abs(F.col("y2") - F.lag("y2").over(w)) > 2 * y_tol)
    )
    isl = _islands(r.withColumn("_k", F.coalesce(brk, F.lit(False))), keys, ["x", "y1", "y2"],
                   F.col("_k"))
    arr = isl.groupBy(*keys, "_isl").agg(
        F.array_sort(F.collect_list(F.struct("x", "y1", "y2"))).alias("a"))
    start = lambda v: F.struct(
        v["x"].alias("x1"), v["y1"].alias("y1"), (v["x"] + 1).alias("x2"), v["y2"].alias("y2"))

    def step(acc, v):
        cur = F.element_at(acc, -1)
        joins = (
            (v["x"] - cur["x2"] <= 1)
            & (F.abs(v["y1"] - cur["y1"]) <= y_tol)
            & (F.abs(v["y2"] - cur["y2"]) <= y_tol)
        )
        grown = F.struct(
            cur["x1"].alias("x1"), F.least(cur["y1"], v["y1"]).alias("y1"),
            (v["x"] + 1).alias("x2"), F.greatest(cur["y2"], v["y2"]).alias("y2"))
        return F.when(F.size(acc) == 0, F.array(start(v))).when(
            joins, F.concat(F.slice(acc, 1, F.size(acc) - 1), F.array(grown))
        ).otherwise(F.concat(acc, F.array(start(v))))

    # element_at on an empty array is only reached behind the size check
    step_safe = lambda acc, v: F.when(
        F.size(acc) == 0, F.array(start(v))).otherwise(step(acc, v))
    boxes = F.aggregate(
        F.slice("a", 2, F.size("a")), F.array(start(F.get(F.col("a"), 0))), step_safe)
    return arr.select(*keys, F.explode(boxes).alias("b")).select(*keys, "b.*").where(
        F.col("x2") - F.col("x1") <= max_width)


def dedup_strokes(
    records: DataFrame, *, keys: Sequence[str] = KEYS, unit: str = "unit"
) -> DataFrame:
    """Keep a stroke unless a kept one lies within 0.1 unit and overlaps by ≥ 0.8.

    Copies of one box are counted first (their best score represents them).  Returns one
    row per distinct box: ``kept`` or the representative box that suppressed it, with the
    number of records ``n`` and, for kept ones, the score.
    """
    d = records.groupBy(*keys, *g.BOX).agg(
        F.max("score").alias("score"), F.count("*").alias("n"), F.max(unit).alias("unit"))
    c2 = F.col("x1") + F.col("x2")
    w = Window.partitionBy(*keys).orderBy("c2", *g.BOX)
    d = d.withColumn("c2", c2)
    brk = (F.col("c2") - F.lag("c2").over(w)) / 2.0 > 0.1 * F.col("unit")
    d = _islands(d.withColumn("_k", F.coalesce(brk, F.lit(False))), keys, ["c2", *g.BOX],
                 F.col("_k"))
    arr = d.groupBy(*keys, "_isl").agg(
        F.max("unit").alias("unit"),
        F.array_sort(F.collect_list(F.struct(
            "x1", (F.col("x1") - F.col("x2")).alias("nw"), "y1", "y2", "x2",
            (-F.col("score")).alias("ns"), "n"))).alias("a"),
    )
    near = lambda k, v: (
        F.abs((k["x1"] + k["x2"]) - (v["x1"] + v["x2"])) / 2.0 <= 0.1 * F.col("unit")
    ) & (g.vertical_overlap(g.of_struct(k), g.of_struct(v)) >= 0.8)
    kept = F.aggregate(
        "a", F.filter("a", lambda v: F.lit(False)),
        lambda acc, v: F.when(F.exists(acc, lambda k: near(k, v)), acc).otherwise(
            F.concat(acc, F.array(v))),
    )
    out = arr.withColumn("k", kept).select(*keys, "unit", "k", F.explode("a").alias("v"))
    rep = F.get(F.filter("k", lambda k: near(k, F.col("v"))), 0)
    own = g.vertical_overlap(g.of_struct(F.col("v")), g.of_struct(F.col("v"))) < 0.8
    rep = F.when(~own, rep)  # boxes without height overlap nothing, not even a copy
    same = lambda k: g.box_struct(g.of_struct(k)) == g.box_struct(g.of_struct(F.col("v")))
    o = out.select(*keys, "v", rep.alias("rep")).withColumn(
        "kept", F.col("rep").isNull() | same(F.col("rep")))
    return o.select(
        *keys, *(F.col(f"v.{n}").alias(n) for n in g.BOX), "kept", F.col("v.n").alias("n"),
        F.when(F.col("kept"), -F.col("v.ns")).alias("score"),
        *(F.when(~F.col("kept"), F.col(f"rep.{n}")).alias(f"rep_{n}") for n in g.BOX),
    )


def components(
    df: DataFrame, keys: Sequence[str], x: tuple[Column, Column], y: tuple[Column, Column], tie: Sequence[str], rounds: int = 2,
) -> tuple[DataFrame, list[str]]:
    """Columns that number the groups of rows whose ranges can touch on both axes.

    A sweep along one axis cuts where no range reaches further; the next sweeps the other axis within
    each group, so a column of bars one above the other falls apart although all share their x. Every
    sweep reads the partitions of the first.
    """
    at = (("_xa", "_xb"), ("_ya", "_yb"))
    df = df.select("*", *(c.alias(n) for pair, names in zip((x, y), at) for c, n in zip(pair, names)))
    groups: list[str] = []
    for turn in range(rounds):
        for axis, (lo, hi) in zip("xy", at):
            w = Window.partitionBy(*keys, *groups).orderBy(lo, *tie)
            reach = F.max(hi).over(w.rowsBetween(Window.unboundedPreceding, -1))
            df = df.withColumn("_k", F.col(lo) > reach)
            df = _islands(df, [*keys, *groups], [lo, *tie], F.col("_k")).drop("_k")
            groups.append(f"_{axis}{turn}")
            df = df.withColumnRenamed("_isl", groups[-1])
    return df.drop("_xa", "_xb", "_ya", "_yb"), groups


def _inner(a: Column, b: Column, share: float) -> tuple[Column, Column]:
    """The middle of a range without ``share`` of its length.

    Ranges that overlap by ``share`` of the longer one still touch in their middles.
    """
    lo, hi = F.least(a, b), F.greatest(a, b)
    cut = (hi - lo) * F.lit(share / 2.0)
    return lo + cut - F.lit(1e-6), hi - cut + F.lit(1e-6)


def nms(
    scored: DataFrame,
    *,
    iou: float = 0.5,
    x_unit_ratio: float = 1.0,
    id_col: str = "det_id",
    keys: Sequence[str] = KEYS,
) -> DataFrame:
    """Greedy suppression by score; suppressed rows keep their place with score 0.

    A better box suppresses one with padded IoU ≥ ``iou`` (at most 1), or with centres closer than its
    quarter height and vertical overlap ≥ 0.5.  Copies of a box are counted first: the best of them
    stands for all, and no other can be kept.  Boxes are folded by components that cannot
    conflict (:func:`components`), an array each.
    """
    rows = scored.groupBy(*keys, *g.BOX, id_col, "score").agg(F.count(F.lit(1)).alias("n"))
    place = F.struct((-F.col("score")).alias("ns"), F.col(id_col).alias("id"))
    b = g.box()
    unit = F.greatest(F.lit(1.0), F.greatest(F.lit(1.0), F.abs(b.y2 - b.y1)) / 4.0)
    s = rows.groupBy(*keys, *g.BOX).agg(F.min(place).alias("best")).select(
        *keys, "best", *g.BOX, *(c.alias(f"e_{n}") for c, n in zip(g.expand_box(b), g.BOX)), (unit * x_unit_ratio).alias("reach"))
    e, cx = g.box("e_"), g.center_x(b)
    ex, ey, by = _inner(e.x1, e.x2, iou), _inner(e.y1, e.y2, iou), _inner(b.y1, b.y2, 0.5)
    s, groups = components(
        s, keys, (F.least(ex[0], cx - F.col("reach")), F.greatest(ex[1], cx + F.col("reach"))),
        (F.least(ey[0], by[0]), F.greatest(ey[1], by[1])), g.BOX)
    item = F.struct("best", *g.BOX, *(f"e_{n}" for n in g.BOX), "reach")
    arr = s.groupBy(*keys, *groups).agg(F.array_sort(F.collect_list(item)).alias("a"))
    pe = lambda v: g.Box(*(v[f"e_{n}"] for n in g.BOX))

    def hits(k, v):
        dist = F.abs((k["x1"] + k["x2"]) - (v["x1"] + v["x2"])) / 2.0
        return (g.iou_expanded(pe(k), pe(v)) >= iou) | (
            (dist < k["reach"]) & (g.vertical_overlap(g.of_struct(k), g.of_struct(v)) >= 0.5))

    kept = F.aggregate(
        "a", F.filter("a", lambda v: F.lit(False)),
        lambda acc, v: F.when(F.exists(acc, lambda k: hits(k, v)), acc).otherwise(
            F.concat(acc, F.array(v))),
    )
    won = arr.select(*keys, F.explode(kept).alias("v")).select(
        *keys, *(F.col(f"v.{n}").alias(n) for n in g.BOX), F.col("v.best").alias("best"))
    out = rows.join(won, [*keys, *g.BOX], "left").withColumn(
        "won", F.col("best").isNotNull() & (place == F.col("best")))
    # of rows equal in everything, one is kept
    out = out.select("*", F.explode(F.sequence(F.lit(1), F.col("n").cast("int"))).alias("copy")).withColumn(
        "kept", F.col("won") & (F.col("copy") == 1))
    return out.select(*keys, id_col, *g.BOX, "kept", F.when(F.col("kept"), F.col("score")).otherwise(F.lit(0.0)).alias("score"))


def merge_extra(
    existing: DataFrame, extra: DataFrame, *, scale: float = 1.0, keys: Sequence[str] = KEYS
) -> DataFrame:
    """Ordered replace-or-append merge of extra boxes into the predictions of a page.

    In order, an extra box meets the first prediction within 2·scale horizontally that
    overlaps by ≥ 0.6 (replaced when the extra is taller) or whose centre is at most one
    height away (replaced when at least as tall); without such a prediction it is appended
    and can be met by later extras.  Both tables need ``ord``.
    """
    reach = 2.0 * scale
    a = existing.select(*keys, *g.BOX, F.col("ord").cast("bigint").alias("ord"), F.lit(False).alias("x"))
    b = extra.select(*keys, *g.BOX, F.col("ord").cast("bigint").alias("ord"), F.lit(True).alias("x"))
    u = a.unionByName(b)
    box = g.box()
    cx, cy, h = g.center_x(box), g.center_y(box), F.greatest(g.height(box), F.lit(1))
    u, groups = components(u, keys, (cx - reach / 2.0, cx + reach / 2.0), (cy - h, cy + h), ["x", "ord"])
    item = F.struct("ord", *g.BOX, "x")
    arr = u.groupBy(*keys, *groups).agg(
        F.array_sort(F.collect_list(F.when(~F.col("x"), item))).alias("p"),
        F.array_sort(F.collect_list(F.when(F.col("x"), item))).alias("e"),
    )
    one = F.lit(1)

    def meets(p, v):
        pb, vb = g.of_struct(p), g.of_struct(v)
        ph, vh = F.greatest(g.height(pb), one), F.greatest(g.height(vb), one)
        return (F.abs(g.center_x(pb) - g.center_x(vb)) <= reach) & (
            (g.vertical_overlap(pb, vb) >= 0.6)
            | (F.abs(g.center_y(pb) - g.center_y(vb)) <= F.greatest(ph, vh)))

    def replaces(p, v):
        pb, vb = g.of_struct(p), g.of_struct(v)
        ph, vh = F.greatest(g.height(pb), one), F.greatest(g.height(vb), one)
        return F.when(g.vertical_overlap(pb, vb) >= 0.6, vh > ph).otherwise(vh >= ph)

    def step(acc, v):
        hit = F.array_position(F.transform(acc, lambda p: meets(p, v)), True).cast("int")
        return F.when(hit == 0, F.concat(acc, F.array(v))).otherwise(
            F.transform(acc, lambda p, i: F.when(
                (i == hit - 1) & replaces(p, v), v).otherwise(p)))

    merged = F.aggregate("e", F.col("p"), step)
    return arr.select(*keys, F.explode(merged).alias("v")).select(
        *keys, *(F.col(f"v.{n}").alias(n) for n in g.BOX), F.col("v.ord").alias("ord"),
        F.col("v.x").alias("is_extra"))


LOOKALIKE = r"^[\dIl|!i\]\[]$"


def _folded_tokens(tokens: DataFrame, keys: Sequence[str], carry: Sequence[str] = ()) -> DataFrame:
    """Islands of tokens as arrays: ``a`` as they are, ``m`` merged; ``carry`` columns go with each token."""
    w = Window.partitionBy(*keys).orderBy("x1", "ord")
    digit = F.col("text").rlike(r"^\d+$")
    reach = F.max("x2").over(w.rowsBetween(Window.unboundedPreceding, -1))
    brk = (
        ~digit | ~F.lag(digit).over(w)
        | (F.col("x1") - reach >= 1.5 * (F.col("y2") - F.col("y1")))
    )
    t = _islands(tokens.withColumn("_k", F.coalesce(brk, F.lit(False))), keys, ["x1", "ord"],
                 F.col("_k"))
    item = F.struct("x1", "ord", "y1", "x2", "y2", "text", "confidence", F.lit(1).alias("n_merged"), *carry)
    arr = t.groupBy(*keys, "_isl").agg(F.array_sort(F.collect_list(item)).alias("a"))

    def joins(c, n):
        ch, nh = c["y2"] - c["y1"], n["y2"] - n["y1"]
        min_h = F.least(ch, nh)
        vdiff = F.abs((c["y1"] + c["y2"]) / F.lit(2.0) - (n["y1"] + n["y2"]) / F.lit(2.0))
        loose, strict = vdiff < min_h * 0.5, vdiff < min_h * 0.2
        split = F.trim(c["text"]).rlike(LOOKALIKE) & F.trim(n["text"]).rlike(LOOKALIKE)
        limit = F.when(split & strict, min_h * 1.5).when(split & loose, min_h * 0.8).otherwise(
            min_h * 0.3)
        similar = F.abs(ch - nh) / F.greatest(ch, nh) < F.when(split, 0.4).otherwise(0.25)
        return (
            loose & (n["x1"] - c["x2"] < limit) & similar
            & F.concat(c["text"], n["text"]).rlike(r"^\d+$")
        )

    def step(acc, n):
        c = F.element_at(acc, -1)
        both = F.struct(
            F.least(c["x1"], n["x1"]).alias("x1"), c["ord"].alias("ord"),
            F.least(c["y1"], n["y1"]).alias("y1"), F.greatest(c["x2"], n["x2"]).alias("x2"),
            F.greatest(c["y2"], n["y2"]).alias("y2"), F.concat(c["text"], n["text"]).alias("text"),
            ((c["confidence"] + n["confidence"]) / 2.0).alias("confidence"),
            (c["n_merged"] + n["n_merged"]).alias("n_merged"), *(c[k].alias(k) for k in carry))
        return F.when(
            F.coalesce(joins(c, n), F.lit(False)),
            F.concat(F.slice(acc, 1, F.size(acc) - 1), F.array(both)),
        ).otherwise(F.concat(acc, F.array(n)))

    merged = F.aggregate(F.slice("a", 2, F.size("a")), F.slice("a", 1, 1), step)
    return arr.select(*keys, "a", merged.alias("m"))

def merge_ocr_tokens(tokens: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Left-to-right merge of neighbouring digit tokens of one OCR crop.

    Both texts must be digits, vertically aligned, of similar height and close; single
    look-alike glyphs may be further apart.  Needs ``ord`` as stable order.  Only runs of
    consecutive digit tokens without a certain horizontal gap are folded together.
    Adds ``n_merged``; rows with ``n_merged`` > 1 are merged results.
    """
    return _folded_tokens(tokens, keys).select(*keys, F.explode("m").alias("v")).select(
        *keys, *(F.col(f"v.{n}").alias(n) for n in
                 ("ord", "x1", "y1", "x2", "y2", "text", "confidence", "n_merged")))


def candidate_tokens(tokens: DataFrame, keys: Sequence[str], carry: Sequence[str] = ()) -> DataFrame:
    """Raw tokens plus merged results, tagged ``raw`` / ``merged``; both come from one pass over the tokens."""
    cols = ["ord", "x1", "y1", "x2", "y2", "text", "confidence", *carry]
    tag = lambda name: lambda v: F.struct(*(v[c].alias(c) for c in cols), F.lit(name).alias("source"))
    both = F.concat(F.transform("a", tag("raw")), F.transform(F.filter("m", lambda v: v["n_merged"] > 1), tag("merged")))
    return _folded_tokens(tokens, keys, carry).select(*keys, F.explode(both).alias("v")).select(*keys, "v.*")
