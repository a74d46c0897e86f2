"""Helpers that the training-data operators share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import materialize, release, shared_dir, tune  # noqa: F401

WORD = r"[^\x20\x09-\x0D]+"
SPACES = r"[\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the corpus; Python gets few rows at a time, as single texts can be large."""
    if spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == "10000":
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1000")
    return tune(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def crc_mod(doc_id: Column, n: int) -> Column:
    """crc32 of the id as text, modulo ``n``; a null id counts as remainder 0."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % n, F.lit(0)).cast("int")


def unit_hash(*cols: Column) -> Column:
    """A number in (0, 1) that depends on the columns alone."""
    return (F.pmod(F.xxhash64(*cols), F.lit(1 << 52)).cast("double") + 0.5) / float(1 << 52)


def blocks(rows: int, per_block: int) -> int:
    """Blocks of about ``per_block`` rows; grows with the data."""
    return max(1, -(-rows // per_block))
