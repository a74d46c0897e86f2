"""Balanced label propagation: documents with equal texts move to shared shards under quotas."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import blocks, materialize, release, unit_hash


def _literal(values) -> F.Column:
    return F.array(*[F.lit(int(v)).cast("long") for v in values])


def propagate(chunks: DataFrame, quota: list[int], rounds: int) -> DataFrame:
    """Move chunks (g, salt, n, shard) towards the shard that holds most of their group.

    A chunk is all documents of a group with one salt, so a group of any size is a bounded
    number of rows. Each round joins the groups' votes back to the chunks; a shard admits
    movers by a hash at the rate that its free room allows. Members of one group prefer the
    same shard (ties by a hash), so nobody swaps places and the rounds settle.
    """
    n_shards = len(quota)
    for turn in range(rounds):
        load = [0] * n_shards
        for r in chunks.groupBy("shard").agg(F.sum("n").alias("n")).collect():  # one row for each shard
            load[r["shard"]] = r["n"]
        room = [max(0, q - x) for q, x in zip(quota, load)]
        votes = chunks.groupBy("g", "shard").agg(F.sum("n").alias("v"))
        rank = F.struct("v", F.xxhash64("g", "shard").alias("tie"), "shard")
        free = F.element_at(_literal(room), F.col("shard") + 1) > 0
        best = votes.groupBy("g").agg(
            F.max(F.when(free, rank)).alias("best"), F.sum("v").alias("group_n"),
            F.map_from_entries(F.collect_list(F.struct("shard", "v"))).alias("held"),  # at most one entry for each shard
        )
        wish = chunks.join(best, "g").withColumn("own", F.struct(
            F.element_at("held", F.col("shard")).alias("v"), F.xxhash64("g", "shard").alias("tie"), F.col("shard")))
        # a group beyond a sixteenth of a shard is admitted chunk by chunk, others whole
        lot = F.when(F.col("group_n") * 16 > min(quota), unit_hash(F.col("g"), F.col("salt"), F.lit(turn)))
        wish = wish.select(
            "g", "salt", "n", "shard", F.when(F.col("best") > F.col("own"), F.col("best.shard")).alias("to"),
            F.coalesce(lot, unit_hash(F.col("g"), F.lit(turn))).alias("lot"))
        wish = materialize(wish, "shard-wish")
        demand = [0] * n_shards
        for r in wish.filter("`to` IS NOT NULL").groupBy("to").agg(F.sum("n").alias("n")).collect():
            demand[r["to"]] = r["n"]
        if not any(demand):
            release(wish)
            break
        rate = F.array(*[F.lit(min(1.0, r / d) if d else 0.0) for r, d in zip(room, demand)])
        moved = F.col("to").isNotNull() & (F.col("lot") < F.element_at(rate, F.col("to") + 1))
        after = materialize(
            wish.select("g", "salt", "n", F.when(moved, F.col("to")).otherwise(F.col("shard")).alias("shard")), "shard-chunks")
        release(wish, chunks)
        chunks = after
    return chunks


def balanced_shards(
    docs: DataFrame, n_shards: int = 24, rounds: int = 6, chunk_rows: int = 50_000, block_rows: int = 2_000,
) -> DataFrame:
    """One row per input row: doc_id, size, text_crc32, law, shard, slot, grown_shard.

    Law ``rows``: the shards' row counts differ by one at most; slots are gapless from 0.
    Documents link when their texts are equal. A null text has size 8, checksum 0 and no
    links; an empty text is a text. Repeated rows each get a slot; a null id is placed like
    any other, and copies without one spread like copies with ids of their own. An empty table gives an empty result. Other columns are ignored.
    """
    text = F.col("text")
    base = materialize(docs.select(
        "doc_id",
        (F.coalesce(F.octet_length(text), F.lit(0)) + 8).cast("long").alias("size"),
        F.coalesce(F.crc32(text.cast("binary")), F.lit(0)).cast("long").alias("text_crc32"),
        F.unhex(F.md5(text.cast("binary"))).alias("g"),
        F.when(F.col("doc_id").isNull(), -1 - F.monotonically_increasing_id()).alias("nth"),  # rows without an id, told apart
    ), "shard-base")
    total = base.count()
    quota = [total // n_shards + (s < total % n_shards) for s in range(n_shards)]
    salts = n_shards * blocks(total, n_shards * chunk_rows)
    base = base.withColumn("salt", F.pmod(F.xxhash64("doc_id", "nth"), F.lit(salts)).cast("int"))
    first = F.pmod(F.col("salt"), F.lit(n_shards)).cast("int")

    counts = base.filter(F.col("g").isNotNull()).groupBy("g", "salt").agg(F.count(F.lit(1)).alias("n"))
    in_group = F.sum("n").over(Window.partitionBy("g"))  # at most `salts` rows for each group
    chunks = materialize(
        counts.withColumn("of", in_group).filter("`of` > 1").select("g", "salt", "n", first.alias("shard")), "shard-chunks")
    chunks = propagate(chunks, quota, rounds)

    placed = base.join(chunks.select("g", "salt", "shard"), ["g", "salt"], "left")
    # linked documents come first, so those that a full shard gives up are single ones
    placed = materialize(placed.select(
        "doc_id", "size", "text_crc32", F.coalesce("shard", first).alias("p"), F.col("shard").isNull().alias("single"),
        F.pmod(F.xxhash64("doc_id", "nth", "text_crc32"), F.lit(blocks(total, n_shards * block_rows))).cast("int").alias("block"),
    ), "shard-placed")
    per_block = placed.groupBy("p", "single", "block").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("p").orderBy("single", "block").rowsBetween(Window.unboundedPreceding, -1)
    start = per_block.select("p", "single", "block", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))
    load = [0] * n_shards
    for r in per_block.groupBy("p").agg(F.sum("n").alias("n")).collect():
        load[r["p"]] = r["n"]

    # the k-th document over quota, counted over all shards, takes the k-th free slot
    over, free = [max(0, x - q) for x, q in zip(load, quota)], [max(0, q - x) for x, q in zip(load, quota)]
    over_from = [sum(over[:s]) for s in range(n_shards)]
    takers = [s for s in range(n_shards) if free[s]] or [0]
    free_from = [sum(free[:s]) for s in takers]
    at = Window.partitionBy("p", "single", "block").orderBy("doc_id", "text_crc32", "size")
    ranked = (
        placed.withColumn("rn", F.row_number().over(at)).join(start, ["p", "single", "block"])
        .withColumn("rank", F.col("start") + F.col("rn") - 1)
        .withColumn("beyond", F.col("rank") - F.element_at(_literal(quota), F.col("p") + 1))
        .withColumn("k", F.col("beyond") + F.element_at(_literal(over_from), F.col("p") + 1))
        .withColumn("taker", F.greatest(F.lit(1), F.size(F.filter(_literal(free_from), lambda x: x <= F.col("k")))))
    )
    stays = F.col("beyond") < 0
    taker = lambda values: F.element_at(_literal(values), F.col("taker"))
    return ranked.select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"),
        F.when(stays, F.col("p")).otherwise(taker(takers)).cast("int").alias("shard"),
        F.when(stays, F.col("rank")).otherwise(
            taker([load[s] for s in takers]) + F.col("k") - taker(free_from)).cast("long").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
    )
