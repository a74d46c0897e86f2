"""Numbering rules on hand-made systems."""

from stavelake.operators import corrections as cor
from stavelake.operators import numbering
from stavelake.plans import score

OV = "score_id int, page_index int, system int, measure int, skip int, set_number int, force_measure boolean"


def page(spark, bars, staves=((0, 10, 100, 1200, 140),)):
    st = spark.createDataFrame(
        [(1, 0, i, x1, y1, x2, y2, 10.0) for i, x1, y1, x2, y2 in staves],
        "score_id int, page_index int, staff_index int, x1 int, y1 int, x2 int, y2 int, unit_size double")
    bs = spark.createDataFrame([(1, 0, x, 100, x + 4, 140) for x in bars],
                               "score_id int, page_index int, x1 int, y1 int, x2 int, y2 int")
    return st, bs


def numbers(df):
    return [(r["measure"], r["number"]) for r in df.orderBy("system", "measure").collect()]


def test_narrow_ghost_start_is_skipped_and_forced_back(spark):
    st, bs = page(spark, [55, 300, 600, 900])
    base = score.number_corpus(st, bs, stage=False)
    assert numbers(base) == [(0, 1), (1, 2), (2, 3)]
    # interval 0 is forced; the skip at visible measure 1 now means the first wide interval
    ov = spark.createDataFrame([(1, 0, 0, 0, 0, None, True), (1, 0, 0, 1, 4, None, False)], OV)
    forced = score.number_corpus(st, bs, overrides=ov, stage=False)
    assert numbers(forced) == [(0, 1), (1, 2), (2, 7), (3, 8)]


def test_set_number_beats_reset(spark):
    st, bs = page(spark, [12, 300, 600, 900])
    ov = spark.createDataFrame([(1, 0, 0, 0, 0, 50, False)], OV)
    b = spark.createDataFrame([(1, 0, 0, 1)], "score_id int, page_index int, system int, reset_number int")
    assert numbers(score.number_corpus(st, bs, overrides=ov, boundaries=b, stage=False)) == [(0, 50), (1, 51), (2, 52)]


def test_empty_staff_has_no_compact_index(spark):
    st, bs = page(spark, [12, 300, 600], ((0, 10, 100, 1200, 140), (1, 10, 400, 1200, 440)))
    lay = score.layout(st, bs)
    got = {r["system_raw"]: r["system"] for r in lay.systems.collect()}
    assert got == {0: 0, 1: None}


def test_merge_order_suppress_and_span(spark):
    cols = "score_id int, page_index int, system int, measure int, ord bigint, op string, skip int, set_number int"
    auto = spark.createDataFrame([(1, 0, 0, 0, 1, "auto", 3, None), (1, 0, 0, 1, 2, "auto", 5, None)], cols)
    force = spark.createDataFrame([(1, 0, 0, 1, 1, "force_measure", 0, None)], cols)
    log = spark.createDataFrame([(1, 0, 0, 0, 1, "suppress", None, None), (1, 0, 0, 2, 2, "set_measure_span", 4, None),
                                 (1, 0, 0, 3, 3, "set_measure_span", 0, None)], cols)
    spans = cor.measure_span_ops(log.withColumnRenamed("skip", "measure_span"))
    assert spans.where("violation IS NOT NULL").count() == 1
    got = {r["measure"]: (r["skip"], r["force_measure"]) for r in cor.merge(auto, force, spans).collect()}
    assert got == {1: (0, True), 2: (3, False)}


def test_remove_before_add_does_not_remove_it(spark):
    bar = spark.createDataFrame([(1, 0, 10, 0, 14, 40)], "score_id int, page_index int, x1 int, y1 int, x2 int, y2 int")
    ov = spark.createDataFrame(
        [(1, 0, 1, "remove", 10, 0, 14, 40), (1, 0, 2, "add", 10, 0, 14, 40), (1, 0, 3, "remove", 500, 0, 504, 40)],
        "score_id int, page_index int, ord bigint, op string, x1 int, y1 int, x2 int, y2 int")
    kept, stats = cor.apply_bar_overrides(bar, ov)
    assert [r["ord"] for r in kept.collect()] == [2]
    s = stats.first()
    assert (s["removed"], s["added"], s["remove_requests"], s["unmatched_remove"]) == (1, 1, 2, 1)


def test_hot_page_of_copies_keeps_results(spark):
    """A page flooded with copies of its bars numbers like the page itself."""
    st, bs = page(spark, [55, 300, 600, 900])
    flood = bs.crossJoin(spark.range(500)).drop("id")
    assert numbers(score.number_corpus(st, flood, stage=False)) == numbers(score.number_corpus(st, bs, stage=False))
    assert flood.count() == 2000 and numbering.KEYS
