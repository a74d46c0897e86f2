"""Layout steps stay with their page, and no table is broadcast for a small file."""

import random
import re

from pyspark.sql import functions as F

from stavelake import KEYS
from stavelake.fixtures import Corpus
from stavelake.operators import numbering
from stavelake.plans import score


def test_a_page_is_dealt_once(spark, monkeypatch):
    c, plans = Corpus(spark, "/root/testdata/sf0.001"), {}
    write = score.materialize

    def spy(df, name):
        plans[name] = df._jdf.queryExecution().executedPlan().toString()
        return write(df, name)

    monkeypatch.setattr(score, "materialize", spy)
    before = spark.conf.get("spark.sql.requireAllClusterKeysForCoPartition")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        score.layout(c["f_staff"], c["f_barline"], c["f_connector"], stage=True)
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert set(plans) == {"extents", "staves", "systems"}
    for name in ("staves", "systems"):
        for keys in re.findall(r"Exchange hashpartitioning\(([^)]*)\)", plans[name]):
            assert not re.search(r"\b(pos|cell|_cell|_chain|system_raw|c2)#", keys), keys
    assert spark.conf.get("spark.sql.requireAllClusterKeysForCoPartition") == before


def test_a_file_just_under_the_limit_is_no_broadcast(spark, tmp_path):
    path = str(tmp_path / "t")
    spark.range(200_000).select((F.col("id") % 7).alias("k"), *(F.lit(1).alias(f"v{i}") for i in range(8))).coalesce(1).write.parquet(path)
    t = spark.read.parquet(path)
    size = int(t._jdf.queryExecution().analyzed().stats().sizeInBytes())
    files = sum(p.stat().st_size for p in (tmp_path / "t").glob("*.parquet"))
    assert size >= 8 * files


def test_support_is_that_of_all_pairs(spark):
    rng = random.Random(4)
    units = {0: 10.0, 1: 3.0, 2: None}
    staves = [(0, 0, p, s, 4, units[s], 0, 0, 9, 40.0) for s in units for p in range(4 * s, 4 * s + 4)]
    staff = spark.createDataFrame(staves, "score_id int, page_index int, pos int, system_raw int, n_staves long, sys_unit double, "
                                          "sx1 int, sy1 int, sy2 int, avg_h double")
    bars = sorted({(0, 0, p, x, x + rng.randrange(1, 5)) for p in range(11) for x in (rng.randrange(160) for _ in range(6))})
    one = F.struct(F.lit(1).alias("y1"), F.lit(2).alias("y2"), F.lit(False).alias("is_ghost"))
    ext = spark.createDataFrame(bars, "score_id int, page_index int, pos int, x1 int, x2 int").withColumns(
        {"m_all": one, "m_full": F.when(F.lit(False), one), "unit": F.lit(1.0)})
    got = numbering.supported_bars(staff, ext)
    found = {(r.system_raw, b["x1"], b["x2"], b["ok"]) for r in got.collect() for b in r.bars}
    want = set()
    for _, _, p, x1, x2 in bars:
        s = p // 4
        near = {q for _, _, q, a, b in bars if q // 4 == s and units[s] and abs(a + b - x1 - x2) / 2 < 1.2 * units[s]}
        want.add((s, x1, x2, len(near) >= 2))
    assert found == want and got.count() == len(units)
    assert {r[:3] for r in got.select(*KEYS, "system_raw").collect()} == {(0, 0, s) for s in units}
