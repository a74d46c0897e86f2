"""Folds and scans against plain sequential evaluators on random small pages."""

import random

import pytest
from pyspark.sql import functions as F

from stavelake.operators import folds, joins, numbering, scan

KEY = ["page"]


def rows(df, cols):
    return sorted(tuple(r[c] for c in cols) for r in df.collect())


def v_overlap(a, b):
    o = min(a[3], b[3]) - max(a[1], b[1])
    return 0.0 if o <= 0 else o / max(a[3] - a[1], b[3] - b[1], 1)


def expand(b):
    half = max(max(1, b[2] - b[0]) / 2, 6)
    cx = (b[0] + b[2]) / 2
    x1, x2 = max(0, round(cx - half) - 3), round(cx + half) + 3
    y1, y2 = max(0, b[1] - 3), b[3] + 3
    return x1, y1, max(x2, x1 + 1), max(y2, y1 + 1)


def iou(a, b):
    a, b = expand(a), expand(b)
    w, h = max(0, min(a[2], b[2]) - max(a[0], b[0])), max(0, min(a[3], b[3]) - max(a[1], b[1]))
    area = lambda q: (q[2] - q[0]) * (q[3] - q[1])
    return w * h / (area(a) + area(b) - w * h)


def boxes(rng, n, span=120):
    out = []
    for _ in range(n):
        x, y = rng.randrange(span), rng.choice([0, 60, 120]) + rng.randrange(8)
        out.append((x, y, x + rng.randrange(1, 9), y + rng.randrange(20, 60)))
    return out


def test_keep_first_uses_last_kept(spark):
    xs = [0, 7, 14, 21, 40, 47, 54]
    df = spark.createDataFrame([(xs,)], "x array<int>").select(
        F.transform("x", lambda v: F.struct(v.alias("x1"))).alias("b"))
    got = df.select(numbering.keep_first(F.col("b"), F.lit(12.0)).alias("k")).first()["k"]
    assert [r["x1"] for r in got] == [0, 14, 40, 54]


@pytest.mark.parametrize("seed", range(2))
def test_nms(spark, seed):
    rng = random.Random(seed)
    data, exp = [], set()
    for page in range(12):
        items = [(i, rng.randrange(100) / 100, b) for i, b in enumerate(boxes(rng, 25))]
        data += [(page, i, s, *b) for i, s, b in items]
        kept = []
        for i, s, b in sorted(items, key=lambda t: (-t[1], t[0])):
            hit = any(
                iou(k, b) >= 0.5 or (abs(k[0] + k[2] - b[0] - b[2]) / 2 < max(1.0, max(1, k[3] - k[1]) / 4)
                                     and v_overlap(k, b) >= 0.5) for k in kept)
            if not hit:
                kept.append(b)
                exp.add((page, i))
    df = spark.createDataFrame(data, "page int, det_id int, score double, x1 int, y1 int, x2 int, y2 int")
    got = folds.nms(df, keys=KEY)
    assert got.count() == len(data)
    assert {(r["page"], r["det_id"]) for r in got.where("kept").collect()} == exp


@pytest.mark.parametrize("seed", range(2))
def test_merge_extra(spark, seed):
    rng = random.Random(100 + seed)
    base, extra, exp = [], [], []
    for page in range(12):
        state = [(b, False) for b in boxes(rng, 8, 60)]
        base += [(page, i, *b) for i, (b, _) in enumerate(state)]
        new = boxes(rng, 10, 60)
        extra += [(page, i, *b) for i, b in enumerate(new)]
        for e in new:
            for i, (p, _) in enumerate(state):
                if abs((p[0] + p[2]) - (e[0] + e[2])) / 2 > 2:
                    continue
                he, hp = max(e[3] - e[1], 1), max(p[3] - p[1], 1)
                if v_overlap(p, e) >= 0.6:
                    if he > hp:
                        state[i] = (e, True)
                    break
                if abs((p[1] + p[3]) - (e[1] + e[3])) / 2 <= max(he, hp):
                    if he >= hp:
                        state[i] = (e, True)
                    break
            else:
                state.append((e, True))
        exp += [(page, *b, x) for b, x in state]
    t = "page int, ord int, x1 int, y1 int, x2 int, y2 int"
    got = folds.merge_extra(spark.createDataFrame(base, t), spark.createDataFrame(extra, t), keys=KEY)
    assert rows(got, ["page", "x1", "y1", "x2", "y2", "is_extra"]) == sorted(exp)


@pytest.mark.parametrize("seed", range(2))
def test_merge_runs(spark, seed):
    rng = random.Random(200 + seed)
    data, exp = set(), []
    for page in range(10):
        runs = sorted({(rng.randrange(30), y := rng.choice([0, 3, 30]), y + rng.randrange(18, 24)) for _ in range(40)})
        data |= {(page, *r) for r in runs}
        cur = None
        for x, a, z in runs:
            if cur and x - cur[2] <= 1 and abs(a - cur[1]) <= 4 and abs(z - cur[3]) <= 4:
                cur = (cur[0], min(cur[1], a), x + 1, max(cur[3], z))
            else:
                if cur and cur[2] - cur[0] <= 4:
                    exp.append((page, *cur))
                cur = (x, a, x + 1, z)
        if cur[2] - cur[0] <= 4:
            exp.append((page, *cur))
    df = spark.createDataFrame(sorted(data), "page int, x int, y1 int, y2 int")
    assert rows(folds.merge_runs(df, keys=KEY), ["page", "x1", "y1", "x2", "y2"]) == sorted(exp)


def test_peaks_wrap_around(spark):
    ratio = [0.9, 0.2, 0.5, 0.5, 0.1, 0.8]
    df = spark.createDataFrame(
        [(1, 0, x, r, 0, 5) for x, r in enumerate(ratio)],
        "page int, band_idx int, x int, ratio double, d1 int, d2 int")
    got = folds.nearest_first_peaks(df, min_ratio=0.3, min_distance=2, keys=["page", "band_idx"])
    # column 5 loses to column 0 across the edge; of the plateau 2, 3 the first is taken
    assert [(r["rank"], r["x"]) for r in got.orderBy("rank").collect()] == [(0, 0), (1, 2)]


def brute_scan(units, start):
    out, cur = {}, start
    for page, has, tail in units:
        out[page] = (cur, tail if has else cur + tail)
        cur = out[page][1]
    return out


@pytest.mark.parametrize("block", [1, 3, 100])
def test_compose_starts_is_block_independent(spark, block):
    rng = random.Random(3)
    data, exp = [], {}
    for score in range(4):
        units = [(p, rng.random() < 0.2, rng.randrange(1, 20)) for p in range(40)]
        data += [(score, *u) for u in units]
        exp.update({(score, p): v for p, v in brute_scan(units, 1).items()})
    df = spark.createDataFrame(data, "score int, page int, has_anchor boolean, tail bigint")
    got = scan.compose_starts(df, ["score"], "page", 1, block=block)
    assert {(r["score"], r["page"]): (r["unit_start"], r["unit_next"]) for r in got.collect()} == exp


def test_blocked_lag_and_row_number(spark):
    rng = random.Random(5)
    data = [(rng.choice("aab"), t, t * 3 % 17) for t in range(200)]
    df = spark.createDataFrame(data, "k string, t int, v int")
    got = scan.previous(df, ["k"], ["t"], F.col("v"), "p")
    exp, last = {}, {}
    for k, t, v in data:
        exp[t] = last.get(k)
        last[k] = v
    assert {r["t"]: r["p"] for r in got.collect()} == exp
    n = scan.row_numbers(df, ["k"], ["t"], "n")
    seen, want = {}, {}
    for k, t, _ in data:
        seen[k] = want[t] = seen.get(k, 0) + 1
    assert {r["t"]: r["n"] for r in n.collect()} == want


def test_hot_key_spreads_over_blocks(spark):
    df = spark.range(4000).selectExpr("if(id % 40 = 0, 'small', 'hot') k", "id t")
    sizes = {r["_blk"]: r["n"] for r in scan.by_count(df, ["k"], ["t"]).groupBy("_blk").agg(F.count("*").alias("n")).collect()}
    assert len(sizes) == 4 and max(sizes.values()) < 2000
    late = scan.previous(df.withColumn("k", F.when(F.col("k") == "hot", "hot")), ["k"], ["t"], F.col("t"), "p")
    assert late.where("k IS NULL AND p IS NULL").count() == 1 and late.count() == 4000  # a null key is a key
    assert scan.row_numbers(df.limit(0), ["k"], ["t"], "n").collect() == []


def test_bars_of_one_column_are_many_components(spark):
    # each bar reaches a tenth of its height into the next; every hundredth has a rival
    b = spark.range(10000).selectExpr("1 page", "id det_id", "50 x1", "cast(id * 36 as int) y1", "54 x2", "cast(id * 36 + 40 as int) y2", "0.5d score")
    rival = b.where("det_id % 100 = 0").selectExpr("page", "det_id + 100000", "x1 + 1", "y1 + 1", "x2 + 1", "y2 + 1", "0.9d")
    at = (F.col("x1") - 5, F.col("x2") + 5)
    parts, groups = folds.components(b, KEY, at, folds._inner(F.col("y1"), F.col("y2"), 0.5), ["det_id"])
    assert parts.groupBy(*KEY, *groups).count().agg(F.max("count")).first()[0] == 1
    got = folds.nms(b.union(rival).union(b.where("det_id < 3")), keys=KEY)
    lost = [r["det_id"] for r in got.where("NOT kept").collect()]
    assert sorted(lost) == sorted([*range(0, 10000, 100), 0, 1, 2])


def test_page_without_bands_keeps_its_strokes(spark):
    c = spark.createDataFrame([(p, 0, i, 1, y, 3, y + 40) for p in (1, 2) for i, y in enumerate((0, 200))],
                              "score_id int, page_index int, det_id int, x1 int, y1 int, x2 int, y2 int")
    bands = spark.createDataFrame([(1, 0, 10, 60)], "score_id int, page_index int, b1 int, b2 int")
    assert rows(joins.staff_overlap_filter(c, bands), ["score_id", "det_id"]) == [(1, 0), (2, 0), (2, 1)]


def test_ocr_merge_breaks_on_words(spark):
    t = [(1, 1, 0, 0, 10, 30, "1", 0.9), (1, 2, 14, 1, 24, 31, "2", 0.7), (1, 3, 30, 0, 60, 30, "Viol", 0.8),
         (1, 4, 64, 0, 74, 30, "3", 0.6), (1, 5, 200, 0, 210, 30, "4", 0.5)]
    df = spark.createDataFrame(t, "crop int, ord int, x1 int, y1 int, x2 int, y2 int, text string, confidence double")
    got = folds.merge_ocr_tokens(df, ["crop"]).orderBy("x1").collect()
    assert [(r["text"], r["n_merged"]) for r in got] == [("12", 2), ("Viol", 1), ("3", 1), ("4", 1)]
    assert got[0]["confidence"] == pytest.approx(0.8)


def test_strokes_of_one_id_count_their_staves_together(spark):
    from stavelake.operators import joins

    boxes = spark.createDataFrame(
        [(0, 0, 7, 10, 100, 12, 140), (0, 0, 7, 30, 100, 32, 140), (0, 0, 7, 50, 400, 52, 440), (0, 0, 8, 70, 100, 72, 140)],
        "score_id int, page_index int, det_id long, x1 int, y1 int, x2 int, y2 int")
    staff = spark.createDataFrame([(0, 0, 0, 100, 140, 10.0)], "score_id int, page_index int, pos int, y1 int, y2 int, unit_size double")
    got = sorted((r.det_id, r.x1, r.staff) for r in joins.staff_strokes(boxes, staff, box_id="det_id").collect())
    assert got == [(7, 10, 0), (7, 30, 0), (8, 70, -1)]
    assert {r.staff for r in joins.staff_strokes(boxes, staff).collect()} == {-1}
