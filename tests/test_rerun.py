"""A rerun after corrections against numbering everything anew, and what it shuffles."""

from pyspark.sql import functions as F

from stavelake import KEYS
from stavelake.fixtures import Corpus
from stavelake.operators import numbering
from stavelake.plans import score
from stavelake.queries.corrections import _TOUCHED
from stavelake.queries.layout import merged_overrides

SMALL = "/root/testdata/sf0.001"


def test_rerun_reads_the_overrides_of_touched_pages(spark):
    c = Corpus(spark, SMALL)
    touched = c.sql(_TOUCHED)
    staff, bar, conn, bound, pages = (c[f"f_{n}"] for n in ("staff", "barline", "connector", "boundary", "page"))
    before = merged_overrides(c).where("measure % 2 = 0")
    # a correction doubles the skips of touched pages
    after = before.join(touched.withColumn("t", F.lit(2)), list(KEYS), "left").withColumn(
        "skip", F.col("skip") * F.coalesce("t", F.lit(1))).drop("t")
    old = score.number_corpus(staff, bar, conn, before, bound)
    old_pages = numbering.page_numbers(old.drop("number"), pages, bound)
    got = score.rerun_numbering(old, old_pages, touched, staff, bar, conn, after, bound, pages)
    want = score.number_corpus(staff, bar, conn, after, bound)
    cols = [*KEYS, "system", "measure", "x1", "y1", "x2", "y2", "skip", "number"]
    rows = lambda df: sorted(map(tuple, df.select(*cols).collect()))
    assert rows(got) == rows(want) != rows(old)
    assert 0 < got.where("reused").count() < got.count()


def test_rerun_writes_systems_and_numbers_nowhere(spark, monkeypatch):
    from stavelake.queries import QUERIES, corrections

    written = []
    for module in (score, corrections):
        real = module.materialize
        monkeypatch.setattr(module, "materialize", lambda df, name, real=real: written.append(name) or real(df, name))
    assert QUERIES["rerun_numbering"](spark, SMALL).count() > 0
    assert set(written) == {"bars", "extents", "measures", "tails", "reused-pages"}
