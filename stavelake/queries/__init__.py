"""Registered queries: each one a Spark plan over the driver tables plus its SQL oracle."""

from __future__ import annotations

from typing import Callable, Optional

from pyspark.sql import DataFrame, SparkSession

from ..fixtures import Corpus

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def register(name: str, oracle: Optional[str] = None):
    """Register ``fn(corpus) -> DataFrame`` under ``name`` with an optional DuckDB text."""

    def wrap(fn: Callable[[Corpus], DataFrame]):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            from ..session import tune

            return fn(Corpus(tune(spark), sf_dir))

        run.__name__, run.__doc__ = name, fn.__doc__
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")
        QUERIES[name] = run
        if oracle is not None:
            ORACLES[name] = oracle
        return fn

    return wrap


def load_all() -> None:
    from . import (  # noqa: F401
        aggregates, corrections, events, folds, geometry, islands, joins, layout, projections,
        raster, sources, validation, votes,
    )
