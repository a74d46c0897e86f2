"""Mix sources to target weights by Pareto order sampling."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import WORD, materialize, unit_hash

MOST_COPIES = 3


def source_targets(stats: DataFrame) -> DataFrame:
    """Add ``target`` to (source, source_size): weights 1, 2, 3 in turn, at most three times the size.

    Shares above the cap are given out again by weight until none is above, which is one
    level for all sources below their cap. The table has one row for each source.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    w = stats.withColumn("w", ((F.row_number().over(by_name) - 1) % 3 + 1).cast("long"))
    w = w.withColumn("cap", F.col("source_size") * MOST_COPIES)
    by_level = Window.orderBy(F.col("cap") / F.col("w"), F.col("source").asc_nulls_last())
    everything = Window.partitionBy()
    w = w.withColumn("total", F.sum("source_size").over(everything))
    w = w.withColumn("caps_before", F.sum("cap").over(by_level.rowsBetween(Window.unboundedPreceding, -1)))
    w = w.withColumn("w_from", F.sum("w").over(by_level.rowsBetween(0, Window.unboundedFollowing)))
    level = (F.col("total") - F.coalesce("caps_before", F.lit(0))).cast("double")
    w = w.withColumn("full", F.col("cap").cast("double") * F.col("w_from") <= level * F.col("w"))
    w = w.withColumn("full_caps", F.sum(F.when(F.col("full"), F.col("cap")).otherwise(0)).over(everything))
    w = w.withColumn("open_w", F.sum(F.when(F.col("full"), F.lit(0)).otherwise(F.col("w"))).over(everything))
    share = (F.col("total") - F.col("full_caps")).cast("double") * F.col("w") / F.nullif("open_w", F.lit(0))
    return w.withColumn("target", F.when(F.col("full"), F.col("cap").cast("double")).otherwise(share))


def mix(docs: DataFrame, seed: int = 17, tilt: float = 0.5, block_rows: int = 2_000) -> DataFrame:
    """One row per input row: doc_id, source, size, source_size, target, copies, taken.

    Every document of a source whose target is r times its size gets floor(r) certain copies.
    The rest is sampled: inclusion odds rise with size ** tilt, documents are ranked by random
    odds over inclusion odds, and the first are taken while a source's words come nearer to
    its target; one document of the size that is then off is added or left out. Size counts words of the whole text, 0 for a null or empty text, which may
    be taken but adds nothing. A null source is a source. Random numbers come from the id and the text's
    checksum, so reruns agree; rows without an id draw by their place in the table, so copies of one
    draw for themselves and lie in many blocks. Rows without words pass no window. Other columns are ignored.
    """
    sized = materialize(docs.select(
        "doc_id", "source", F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long").alias("size"),
        F.coalesce(F.crc32(F.col("text").cast("binary")), F.lit(0)).alias("tie"),
        F.when(F.col("doc_id").isNull(), F.monotonically_increasing_id()).alias("nth"),
    ), "mix-sizes").withColumn("z", F.round(F.pow(F.col("size").cast("double"), F.lit(tilt)) * 1000).cast("long"))
    stats = materialize(source_targets(sized.groupBy("source").agg(
        F.sum("size").cast("long").alias("source_size"), F.count(F.lit(1)).alias("rows"),
        F.sum(F.col("size") * F.col("z")).cast("double").alias("zx"))), "mix-sources")

    s = stats.select(
        F.col("source").alias("s_source"), "source_size", "target",
        F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long").alias("whole"),
        F.greatest(F.lit(1), F.ceil(F.col("rows") / block_rows)).cast("long").alias("n_blocks"), "zx")
    rest = F.greatest(F.lit(0.0), F.col("target") - F.col("whole") * F.col("source_size"))
    s = s.withColumn("rest", F.when(F.col("whole") >= MOST_COPIES, F.lit(0.0)).otherwise(rest))
    s = s.withColumn("mean_odds", F.least(F.lit(1e6), F.greatest(
        F.lit(1e-6), F.col("rest") / F.greatest(F.lit(1e-3), F.col("source_size") - F.col("rest")))))
    d = sized.join(s, F.col("source").eqNullSafe(F.col("s_source"))).drop("s_source")

    p = F.least(F.lit(1 - 1e-9), F.greatest(F.lit(1e-12), F.when(F.col("zx") > 0, F.col("rest") * F.col("z") / F.col("zx")).otherwise(0.0)))
    u = unit_hash(F.col("doc_id"), F.col("nth"), F.col("tie"), F.lit(seed))
    d = d.withColumn("q", u * (1 - p) / ((1 - u) * p))
    even = F.col("q") * F.col("mean_odds")  # about the odds of a uniform number, so blocks are of similar size
    d = d.withColumn("block", F.floor(F.least(F.lit(1 - 1e-12), even / (1 + even)) * F.col("n_blocks")))

    # without words there is nothing to add up: such a row is in the sample where the whole source is
    empty = d.filter("size = 0")
    d = d.filter("size > 0")
    sums = d.groupBy("source", "block").agg(F.sum("size").alias("block_size"))
    before = Window.partitionBy("source").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select(F.col("source").alias("b_source"), F.col("block").alias("b_block"),
                       F.coalesce(F.sum("block_size").over(before), F.lit(0)).alias("before"))
    within = Window.partitionBy("source", "block").orderBy("q", "doc_id", "size", "tie", "nth").rowsBetween(Window.unboundedPreceding, -1)
    d = d.withColumn("within", F.coalesce(F.sum("size").over(within), F.lit(0)))
    d = d.join(sums, F.col("source").eqNullSafe(F.col("b_source")) & (F.col("block") == F.col("b_block")))
    sampled = (F.col("whole") < MOST_COPIES) & (F.col("before") + F.col("within") + F.col("size") / 2 <= F.col("rest"))
    names = ["doc_id", "source", "size", "tie", "nth", "q", "source_size", "target", "whole", "rest"]
    whole_source = (F.col("whole") < MOST_COPIES) & (F.col("source_size") <= F.col("rest"))
    d = materialize(d.select(*names, sampled.alias("sampled")).unionByName(
        empty.select(*names, whole_source.alias("sampled"))), "mix-sampled")

    # the words still missing or too many are made up by the one document of nearest size
    gap = d.groupBy("source").agg((F.max("rest") - F.sum(F.when(F.col("sampled"), F.col("size")).otherwise(0))).alias("gap"))
    d = d.join(gap.select(F.col("source").alias("g_source"), "gap"), F.col("source").eqNullSafe(F.col("g_source")))
    can = (F.col("whole") < MOST_COPIES) & (F.col("size") > 0) & (F.col("sampled") == (F.col("gap") < 0))
    off = F.abs(F.abs(F.col("gap")) - F.col("size"))
    better = can & (off < F.abs(F.col("gap")))
    me = F.struct(off.alias("off"), "q", "doc_id", "size", "tie", "nth")
    d = d.withColumn("me", F.when(better, me))
    one = d.groupBy("source").agg(F.min("me").alias("chosen")).select(F.col("source").alias("o_source"), "chosen")
    d = d.join(one, F.col("source").eqNullSafe(F.col("o_source")))
    change = F.coalesce(F.col("me") == F.col("chosen"), F.lit(False))
    copies = F.col("whole") + (F.col("sampled") != change).cast("long")
    return d.select("doc_id", "source", "size", "source_size", "target", copies.alias("copies"),
                    (copies * F.col("size")).cast("long").alias("taken"))


def take_copies(docs: DataFrame, mixed: DataFrame) -> DataFrame:
    """Rows of ``docs`` as often as the mix takes them.

    ``docs`` joins by id; where an id stands for several rows, each row follows the mix of
    its own size and source. Null ids and sources are values of their own. An empty table gives an empty
    result; columns of any name are kept.
    """
    size = F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long")
    row = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col("doc_id").alias("d"),
                      F.col("source").alias("s"), size.alias("z"))
    n = mixed.groupBy(F.col("doc_id").alias("nd"), F.col("source").alias("ns"), F.col("size").alias("nz")).agg(
        F.max("copies").cast("int").alias("n")).filter("n > 0")
    same = F.col("d").eqNullSafe(F.col("nd")) & F.col("s").eqNullSafe(F.col("ns")) & (F.col("z") == F.col("nz"))
    copies = row.join(n, same).select("row", F.explode(F.sequence(F.lit(1), F.col("n"))).alias("k"))
    return copies.select(*[F.col("row").getField(c).alias(c) for c in docs.columns])
