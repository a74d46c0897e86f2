"""The two places where user code or a SQL table function is plugged in."""

from __future__ import annotations

from typing import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.functions import udtf
from pyspark.sql.types import DoubleType, StructField, StructType


def score_candidates(
    df: DataFrame, make_scorer: Callable[[], Callable[[pd.DataFrame], np.ndarray]], *, batch: int = 64
) -> DataFrame:
    """Add ``score`` = sigmoid(logit) from a caller-supplied scorer; no model is shipped.

    ``make_scorer`` runs once per task; the scorer maps a frame of at most ``batch`` rows to
    one logit per row.
    """
    schema = StructType([*df.schema.fields, StructField("score", DoubleType())])

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        scorer = make_scorer()
        for f in frames:
            logits = [np.asarray(scorer(f.iloc[i:i + batch]), dtype=float) for i in range(0, len(f), batch)]
            z = np.concatenate(logits) if logits else np.empty(0)
            yield f.assign(score=1.0 / (1.0 + np.exp(-z)))

    return df.mapInPandas(run, schema)


class _StaffStrokes:
    """Split one box at the staves it crosses by at least two units (when two or more)."""

    def eval(self, y1: int, y2: int, staves: list):
        hits = [(i, s) for i, s in enumerate(staves or [])
                if min(y2, s["y2"]) - max(y1, s["y1"]) >= 2 * s["unit"]]
        if len(hits) < 2:
            yield -1, y1, y2
        else:
            for i, s in hits:
                yield i, max(y1, s["y1"]), min(y2, s["y2"])


def register_udtf(spark: SparkSession) -> None:
    """Make ``staff_strokes(y1, y2, staves)`` available to SQL users."""
    fn = udtf(_StaffStrokes, returnType="staff int, y1 int, y2 int")
    spark.udtf.register("staff_strokes", fn)
