"""Files, documents and plug-in points."""

import hashlib
import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from stavelake.functions import extensions as ext
from stavelake.operators import validate
from stavelake.sources import documents, io


def test_list_images_hashes_content(spark, tmp_path):
    for n in ("page_001.png", "page_002.png", "other.txt"):
        (tmp_path / n).write_bytes(n.encode())
    got = {r["path"].split("/")[-1]: r["sha256"] for r in io.list_images(spark, str(tmp_path)).collect()}
    assert got == {n: hashlib.sha256(n.encode()).hexdigest() for n in ("page_001.png", "page_002.png")}


def test_spans_and_progress_jsonl(spark, tmp_path):
    (tmp_path / "1.jsonl").write_text(json.dumps({"pid": 1, "stage": "scan", "duration_sec": 0.5, "success": True}) + "\n")
    (tmp_path / "2.jsonl").write_text(json.dumps({"pid": 2, "stage": "scan", "error": "x", "success": False}) + "\n")
    assert io.read_spans(spark, str(tmp_path)).where("success").count() == 1


@pytest.mark.parametrize("text, n, why", [
    ("[]", 0, None), ("[[1,2,3,4],[5,6,5,9]]", 2, None), ('[{"barline_location":[1,2,3,4]}]', 1, None),
    ('{"predictions":[{"orig_bbox":[1.9,2,3,4]}]}', 1, None), ("{", 0, "invalid_json"), ("{}", 0, "unsupported_shape"),
    ("[[1,2,3]]", 0, "four_coordinates_required"), ("[[1,2,true,4]]", 0, "non_numeric_coordinate"),
    ("[[9,2,3,4]]", 0, "reversed_bounds"),
])
def test_strict_boxes(spark, text, n, why):
    d = spark.createDataFrame([(1, text)], "id int, text string")
    rows, bad = io.read_boxes(d, ["id"])
    assert rows.count() == n
    assert [r["violation"] for r in bad.collect()] == ([why] if why else [])


def test_document_roundtrip(spark):
    k = "score_id int, page_index int, "
    m = spark.createDataFrame([(1, 0, 0, 0, 0, 7, 10, 100, 50, 140)], k + "system_raw int, system int, measure int, number bigint, x1 int, y1 int, x2 int, y2 int")
    st = spark.createDataFrame([(1, 0, 0, 0, 10, 100, 90, 140), (1, 0, 1, 1, 10, 300, 90, 340)], k + "system_raw int, pos int, x1 int, y1 int, x2 int, y2 int")
    pages = spark.createDataFrame([(1, 0, 100, 400), (1, 1, 100, 400)], k + "width int, height int")
    docs = documents.page_documents(m, st, None, pages)
    first = json.loads(docs.where("page_index = 0").first()["document"])["pages"][0]
    assert first["systems"][0]["measures"] == [{"number": 7, "bbox": [10, 100, 50, 140]}]
    assert first["empty_systems"] == [{"staves": [{"bbox": [10, 300, 90, 340]}], "reason": "no_measures"}]
    back = documents.read_documents(docs).where("number IS NOT NULL").first()
    assert (back["system"], back["measure"], back["number"], back["x2"]) == (0, 0, 7, 50)


def test_scorer_runs_per_batch(spark):
    df = spark.range(200).withColumn("x1", F.col("id").cast("int"))

    def make():
        def score(frame):
            assert len(frame) <= 64
            return np.where(frame["x1"] % 2 == 0, 50.0, -50.0)
        return score

    got = ext.score_candidates(df, make)
    assert got.where("score > 0.99").count() == 100


def test_udtf_splits_strokes(spark):
    ext.register_udtf(spark)
    got = spark.sql("""SELECT s.* FROM (SELECT 0 y1, 300 y2, array(named_struct('y1',10,'y2',50,'unit',10D),
        named_struct('y1',200,'y2',240,'unit',10D)) st) t, LATERAL staff_strokes(t.y1, t.y2, t.st) s""").collect()
    assert sorted(map(tuple, got)) == [(0, 10, 50), (1, 200, 240)]


def test_page_selection(spark):
    d = spark.createDataFrame([(1, "3,1,,3", 5), (2, "0", 5), (3, "a", 5), (4, None, 2), (5, ",".join(["1"] * 201), 5)],
                              "request_id int, selection string, total_pages int")
    got = {r["request_id"]: (r["pages"], r["violation"]) for r in validate.page_selection(d).collect()}
    assert got == {1: ([0, 2], None), 2: (None, "out_of_bounds"), 3: (None, "invalid_index"),
                   4: ([0, 1], None), 5: (None, "too_many_entries")}


def test_require_empty(spark):
    with pytest.raises(ValueError):
        validate.require_empty(spark.range(1), "violations")
    validate.require_empty(spark.range(0), "violations")
