"""A bounded, reproducible sample of labelled documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def clear_labels(labels: DataFrame, column: str) -> DataFrame:
    """One row (doc_id, y) for each id whose labels in ``column`` are 0 or 1 and agree."""
    y = F.col(column)
    return (
        labels.filter(y.isin(0, 1) & F.col("doc_id").isNotNull()).groupBy("doc_id")
        .agg(F.min(y).alias("y"), F.max(y).alias("most")).filter("y = most").select("doc_id", F.col("y").cast("int"))
    )


def sample(labels: DataFrame, column: str, may_learn: Column, per_class: int, seed: int) -> DataFrame:
    """At most ``per_class`` ids of each label, those of smallest hash; the same on every run."""
    pool = clear_labels(labels, column).filter(may_learn).withColumn("h", F.xxhash64("doc_id", F.lit(seed)))
    some = [pool.filter(F.col("y") == y).orderBy("h", "doc_id").limit(per_class) for y in (0, 1)]
    return some[0].unionAll(some[1]).select("doc_id", "y")
