"""Scan lines, profiles and candidate measurements against plain numpy."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from stavelake.operators import projections as pr
from stavelake.operators import raster, scanlines

H, W = 90, 150


@pytest.fixture(scope="module")
def page():
    rng = np.random.default_rng(4)
    px = rng.integers(0, 256, (H, W))
    px[:, [40, 41, 97]] = 10  # two bars over the whole page
    px[20:60:8] = 30  # staff lines
    return px


@pytest.fixture(scope="module")
def rows(spark, page):
    return spark.createDataFrame([(0, y, [int(v) for v in page[y]]) for y in range(H)] + [(1, 0, None), (1, 1, [])], "page_id int, y int, px array<int>")


def test_prefix_sums_and_bits(rows, page):
    got = {r.y: r for r in scanlines.integral_rows(rows, threshold=100).where("page_id = 0").collect()}
    for y in range(H):
        assert got[y].n == W and got[y].s == [0, *np.cumsum(page[y])]
        assert got[y].q == [0, *np.cumsum(page[y] ** 2)] and got[y].d == [0, *np.cumsum(page[y] < 100)] and got[y].z == [0, *np.cumsum(page[y] > 0)]
    assert [r.s for r in scanlines.integral_rows(rows).where("page_id = 1").collect()] == [[0], [0]]
    mask = rows.withColumn("px", F.transform("px", lambda p: (p < 100).cast("int")))
    packed = scanlines.entered_rows(scanlines.packed_rows(mask)).where("page_id = 0").select("y", scanlines.set_columns(F.col("words")).alias("on"), scanlines.set_columns(F.col("enters")).alias("new"))
    for r in packed.collect():
        on = page[r.y] < 100
        above = page[r.y - 1] < 100 if r.y else np.zeros(W, bool)
        assert r.on == np.flatnonzero(on).tolist() and r.new == np.flatnonzero(on & ~above).tolist()


def test_grey_values_are_those_of_single_precision(spark, tmp_path):
    import duckdb

    from stavelake.fixtures import DUCK_RASTER, Corpus

    vectors = [(i, [float(np.float32(k * 127 + i - 3200) / np.float32(12700)) for k in range(64)]) for i in range(50)] + [(50, [-0.094488225877285] * 64)]
    spark.createDataFrame(vectors, "vec_id bigint, embedding array<float>").coalesce(1).write.parquet(f"{tmp_path}/embeddings.parquet")
    got = sorted((r.page_id, r.y, list(r.px)) for r in Corpus(spark, str(tmp_path)).raster().collect())
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{tmp_path}/embeddings.parquet/*.parquet'")
    assert got == sorted(con.execute(DUCK_RASTER).fetchall()) and got[-1] == (1, 0, [115] * 64)


def test_rectangles_on_prefix_sums(spark, rows, page):
    rng = np.random.default_rng(5)
    boxes = [(0, int(a), int(b), int(a + c), int(b + d)) for a, b, c, d in zip(rng.integers(-5, W, 60), rng.integers(-5, H, 60), rng.integers(-3, 40, 60), rng.integers(-3, 40, 60))]
    out = raster.rect_stats(spark.createDataFrame(boxes, "page_id int, x1 int, y1 int, x2 int, y2 int"), rows, threshold=100)
    got = {(r.x1, r.y1, r.x2, r.y2): r for r in out.collect()}
    for _, x1, y1, x2, y2 in boxes:
        v = page[max(0, min(y1, y2)) : max(0, y1, y2), max(0, min(x1, x2)) : max(0, x1, x2)]
        if v.size:
            r = got.pop((x1, y1, x2, y2))
            assert (r.n_px, r.px_sum, r.n_dark) == (v.size, v.sum(), (v < 100).sum())
            assert abs(r.mean - v.mean()) < 1e-9 and abs(r.std - v.std()) < 1e-9
    assert not got


def test_a_box_meets_a_block_once(spark, rows, page):
    boxes = [(0, 10, 3, 14, 88), (0, 39, 60, 43, 70), (0, 95, 63, 99, 64), (0, 148, 40, 160, 120), (0, 7, 5, 7, 5), (3, 1, 1, 5, 9)]
    df = spark.createDataFrame(boxes * 2, "page_id int, x1 int, y1 int, x2 int, y2 int")
    assert sorted((r.x1, r["_blk"]) for r in raster.box_pieces(df).collect() if r.page_id == 0 and r.x1 != 7) == [(10, 0), (10, 1), (39, 0), (39, 1), (95, 0), (148, 0), (148, 1)]
    mask = rows.withColumn("px", F.transform("px", lambda p: (p < 100).cast("int")))
    crossings = {tuple(r)[:5]: r.crossings for r in raster.staff_crossings(df, mask).collect()}
    trimmed = {tuple(r)[:5]: (r.t_y1, r.t_y2) for r in raster.trim_boxes(df, rows, threshold=40, min_ratio=0.6).collect()}
    assert set(crossings) == set(trimmed) == set(boxes)
    for at in boxes:
        _, x1, y1, x2, y2 = at
        v = page[y1:y2, x1:x2] if at[0] == 0 else np.zeros((0, 0))
        column = [bool(k) for k in page[y1:y2, (x1 + x2) // 2] < 100] if v.size and (x1 + x2) // 2 < W else []
        assert crossings[at] == sum(k and not (i and column[i - 1]) for i, k in enumerate(column))
        ink = [y1 + i for i, line in enumerate(v) if v.size and (line < 40).mean() >= 0.6]
        assert trimmed[at] == ((ink[0], ink[-1] + 1) if ink else (y1, y2))


def test_vertical_runs_go_on_from_block_to_block(spark, rows, page):
    boxes = [(0, 38, 3, 43, 88), (0, 95, 50, 99, 80), (0, 10, 60, 30, 68), (0, 140, 40, 160, 120)]
    mask = rows.withColumn("px", F.transform("px", lambda p: (p < 100).cast("int")))
    df = spark.createDataFrame(boxes, "page_id int, x1 int, y1 int, x2 int, y2 int")
    assert raster.box_pieces(df).count() == 8
    got = {tuple(r)[:5]: r.open_pixels for r in raster.vertical_open(df, mask, open_ratio=0.3).collect()}
    for at in boxes:
        _, x1, y1, x2, y2 = at
        need, found = min(y2 - y1, max(3, int((y2 - y1) * 0.3))), 0
        for column in (page[y1:y2, x1:x2] < 100).T:
            run = 0
            for k in [*column, False]:
                found, run = (found, run + 1) if k else (found + run * (run >= need), 0)
        assert got[at] == found
    assert got[boxes[0]] >= 2 * 85


def test_profiles_equal_a_convolution(spark, rows, page, monkeypatch):
    monkeypatch.setattr(pr, "LINES_AT_ONCE", 7)
    ink = page < 100
    for width in (3, 4):
        for d1, d2 in ((0, W - 1), (30, 110)):
            regions = spark.createDataFrame([(0, 0, "band", 10, 70, d1, d2)], "page_id int, band_idx int, role string, ya int, yb int, d1 int, d2 int")
            got = pr.profiles(regions, rows, threshold=100, width=width).first().ratios
            want = np.convolve(ink[10:71].sum(axis=0), np.ones(width, int), mode="same") / (61 * width)
            want[:d1], want[d2 + 1 :] = 0, 0
            assert np.allclose(got, want)


def plain_measure(ink, x, scan, peak, p):
    """Ratios of one candidate, pixel by pixel."""
    h, w = ink.shape
    y1, y2 = scan
    high = max(1, y2 - y1 + 1)
    a, z = max(0, int(np.rint(x - p["width"] / 2))), min(w - 1, int(np.rint(x + p["width"] / 2)))
    part = lambda lo, hi, n: ink[lo:hi, a : z + 1].sum() / (n * (z - a + 1))
    ext = max(high, int(np.rint(high * p["extend_scale"])))
    mid = int(np.rint((y1 + y2) / 2))
    e1, e2 = max(0, int(np.rint(mid - ext / 2))), min(h - 1, int(np.rint(mid + ext / 2)))

    def contrast(lo, hi):
        strip = ink[lo : hi + 1].astype(int).copy()
        if p["ignore_peak"]:
            keep = np.abs(np.arange(lo, lo + len(strip)) - peak) > p["ignore_radius"]
            strip[~keep] = 0
        sums = np.convolve(strip.sum(axis=0), np.ones(p["width"], int), mode="same")
        near = [sums[i] for i in range(max(0, x - p["window"]), min(w - 1, x + p["window"]) + 1) if i != x]
        med = np.median(near)
        return sums[x] / med if med > 0 else None

    segs = [contrast(s, min(y2, s + p["segment_height"] - 1)) for s in range(y1, y2 + 1, p["segment_height"])]
    segs = [s for s in segs if s is not None]
    pk2 = min(h - 1, peak + high - 1)
    return (part(y1, y2 + 1, high), part(peak, pk2 + 1, pk2 - peak + 1), part(e1, e2 + 1, e2 - e1 + 1),
            part(e1, y1, y1 - e1) if y1 > e1 else None, part(y2 + 1, e2 + 1, e2 - y2) if e2 > y2 else None, contrast(y1, y2),
            min(segs) if segs else None, np.mean([s >= p["xpeak_min"] for s in segs]) if segs else None)


@pytest.mark.parametrize("change", [dict(), dict(center_on_peak=True, peak_height=9, ignore_peak=True), dict(source="row_stats", row_pad_ratio=0.2)])
def test_candidates_equal_plain_measurements(spark, rows, page, change):
    p = pr.DEFAULTS | dict(ink_threshold=100, extend_scale=1.7, xpeak=True, window=5, segment_height=6, scan_width=12, line_ratio=0.8, min_lines=2, scan_pad=3) | change
    bands = spark.createDataFrame([(0, 0, 18, 46), (0, 1, 60, 80)], "page_id int, band_idx int, y1 int, y2 int")
    none = spark.createDataFrame([], "page_id int, x1 int, y1 int, x2 int, y2 int, ord bigint")
    ink = page < 100
    geo = pr.band_geometry(bands, none, pr.page_sizes(rows), p)
    dark = scanlines.integral_rows(rows, threshold=100, sums="d")
    cands = spark.createDataFrame([(0, b, r, x) for b in (0, 1) for r, x in enumerate((0, 3, 40, 97, 120, W - 1))], "page_id int, band_idx int, rank int, x int")
    placed = pr.placed_candidates(cands, geo, none, dark, p)
    got = {(r.band_idx, r.rank): r for r in pr.measure(placed, dark, p).collect()}
    places = {(r.band_idx, r["rank"]): r for r in placed.collect()}
    assert len(got) == 12
    for at, q in places.items():
        full = ink[q.s1 : q.s2 + 1].sum(axis=1)
        assert q.peak_row == q.s1 + int(np.argmax(full)) and q.row_lines == (full / W >= p["line_ratio"]).sum()
        r = got[at]
        values = (r.scan_ratio, r.scan_peak, r.scan_ext, r.scan_top, r.scan_bottom, r.xpeak, r.seg_min, r.seg_pass)
        if p["source"] != "horiz_scan":
            assert values == (None,) * 8
            continue
        for v, x in zip(values, plain_measure(ink, q.x, (q.scan_y1, q.scan_y2), q.peak_row, p)):
            assert (v is None and x is None) or abs(v - x) < 1e-9


def test_scan_finds_the_bars(spark, rows):
    bands = spark.createDataFrame([(0, 0, 18, 46), (0, 1, 60, 80)], "page_id int, band_idx int, y1 int, y2 int")
    none = spark.createDataFrame([], "page_id int, x1 int, y1 int, x2 int, y2 int, ord bigint")
    ladder = dict(min_ratio=0.6, use_peak_relative=False, peak_ratio_min=0.9, rel_rescue=False, rel_rescue_min=0, rel_rescue_xpeak_min=0, rel_rescue_overhang=1.0,
                  ext_max=1.0, top_max=1.0, bottom_max=1.0, xpeak_rescue=False, xpeak_min=1.6, xpeak_overhang=1.0, segment_height=0, segment_pass=1.0)
    out = pr.probe_scan(bands, none, rows, dict(ink_threshold=100, rightmost=True, gap=True, gap_min=0.55), ladder).collect()
    assert {(r.band_idx, r.status) for r in out if 39 <= r.x <= 42} == {(0, "accepted"), (1, "accepted")}
    old = spark.createDataFrame([(0, 40, 20, 42, 44, 1)], none.schema)
    again = pr.probe_scan(bands, old, rows, dict(ink_threshold=100), ladder).collect()
    assert {(r.band_idx, r.status) for r in again if 39 <= r.x <= 42} == {(0, "existing"), (1, "accepted")}
