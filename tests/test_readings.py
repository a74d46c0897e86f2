"""Readings of OCR crops in one pass, against the SQL of the votes on odd tokens."""

import random

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from stavelake.fixtures import duck
from stavelake.operators.readings import crop_readings
from stavelake.queries.folds import CROP
from stavelake.queries.votes import CK, V

TEXTS = ["", "", "1", "1", "0", "7", "12", "l", "I", "Viol 3", "q=7", "q=7=1", "E5", "P12.", "3,4", "99999999999", " 5", "x1", "con 4a 31", "1 1", "01", None]
COLUMNS = [*CROP, "ord", "x1", "y1", "x2", "y2", "text", "confidence"]


def odd_tokens():
    r = random.Random(5)
    rows = []
    for i in range(6000):
        crop = [r.randrange(3), 0, 0, r.randrange(40), r.randrange(4), r.choice(["standard", "heavy_dilate"])]
        x, y, h = r.randrange(90), r.randrange(6), r.choice([0, 20, 21, 24, 60])
        box = [x, y, x + r.choice([0, 3, 12, 40]), y + h]
        rows.append((*crop, i, *box, r.choice(TEXTS), r.choice([0.8, 0.9, 0.5, None])))
    # one crop of many batches, all of one run
    rows += [(9, 9, 9, 9, 9, "standard", 10_000 + i, i, 0, i + 2, 20, "1", 0.9) for i in range(400)]
    rows += [(9, 9, 9, 9, 9, "standard", 50_000 + i, 4 * i, 500, 4 * i + 2, 520, "31", 0.9) for i in range(400)]
    return rows


@pytest.mark.parametrize("batch", [7, 10_000])
def test_readings_equal_sql_on_odd_tokens(spark, batch):
    schema = "score_id int, page_index int, system int, measure int, staff int, view_name string, ord bigint, x1 int, y1 int, x2 int, y2 int, text string, confidence double"
    rows = odd_tokens()
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
    try:
        t = crop_readings(spark.createDataFrame(rows, schema), CROP, 90 + F.col("score_id") % 3 * 30, F.lit(100))
        got = {tuple(r)[:6]: (r["value"], None if r["score"] is None else round(r["score"], 6), r["ones"]) for r in t.collect()}
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 10_000)
    con = duckdb.connect()
    con.execute(f"CREATE TABLE odd ({schema.replace('string', 'varchar')})")
    con.executemany(f"INSERT INTO odd VALUES ({','.join('?' * len(COLUMNS))})", rows)
    v = {**V, "ocrt_": "SELECT * FROM odd"}
    best = {r[:6]: (r[6], round(r[7], 6)) for r in con.execute(duck(f"SELECT {CK},val,score FROM {{v_best}}", v)).fetchall()}
    # evidence of each crop: its staff stands in for the view
    ones = dict((r[:6], r[6]) for r in con.execute(duck(
        f"SELECT {CK},count(*) FROM {{v_num}} a WHERE val=1 AND confidence>=0.8 AND NOT (src=0 AND EXISTS (SELECT 1 FROM {{v_num}} b WHERE b.src=1 AND b.val>=2"
        f" AND {' AND '.join(f'a.{k}=b.{k}' for k in CROP)} AND b.x1<=a.x1 AND b.y1<=a.y1 AND a.x2<=b.x2 AND a.y2<=b.y2)) GROUP BY ALL", v)).fetchall())
    want = {k: (*best.get(k, (None, None)), ones.get(k, 0)) for k in best.keys() | ones.keys()}
    assert got == want


@pytest.mark.parametrize("name", "staff_votes variant_votes unique_staff_leaders".split())
def test_votes_read_tokens_once(spark, sf_dir, name):
    plan = entry.queries()[name](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Union") == 1


@pytest.mark.parametrize("name", "one_bar_evidence rest_decisions".split())
def test_evidence_writes_no_tokens(spark, sf_dir, monkeypatch, name):
    from stavelake.queries import votes

    written = []
    monkeypatch.setattr(votes, "materialize", lambda df, label: written.append(df) or df)
    entry.queries()[name](spark, sf_dir)
    assert all("text" not in t.columns and set(CROP) <= set(t.columns) for t in written)
