"""Session defaults that the operators rely on at cluster scale."""

from __future__ import annotations

import contextlib
import os
import tempfile
import uuid
from typing import Iterator

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

# Only runtime SQL settings; each is left alone when the caller already set it.
_DEFAULTS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # split skewed join partitions even where that costs one more exchange
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    "spark.sql.session.timeZone": "UTC",
    # rows of these narrow tables take about eight times their file, so a file just under the limit is no broadcast
    "spark.sql.sources.fileCompressionFactor": "8",
}


def tune(spark: SparkSession) -> SparkSession:
    explicit = {k for k, _ in spark.sparkContext.getConf().getAll()}
    for key, value in _DEFAULTS.items():
        if key not in explicit:
            spark.conf.set(key, value)
    return spark


# no inferred null filters and no pruned structs, which tell exchanges of one table apart that could be one
_BY_PAGE = {
    "spark.sql.requireAllClusterKeysForCoPartition": "false",
    "spark.sql.constraintPropagation.enabled": "false",
    "spark.sql.optimizer.expression.nestedPruning.enabled": "false",
    "spark.sql.optimizer.nestedSchemaPruning.enabled": "false",
}


@contextlib.contextmanager
def co_partitioned(spark: SparkSession) -> Iterator[None]:
    """Inside, joins and groups on more than the page stay in the partitions that rows dealt by page have."""
    before = {key: spark.conf.get(key) for key in _BY_PAGE}
    for key, value in _BY_PAGE.items():
        spark.conf.set(key, value)
    try:
        yield
    finally:
        for key, value in before.items():
            spark.conf.set(key, value)


def shared_dir(spark: SparkSession, name: str) -> str:
    """Folder for checkpoints and intermediate tables, shared by all executors.

    The cluster names it in ``spark.checkpoint.dir``. Where that is unset, a local master gets a
    temporary folder, which is recorded in the session; any other master is an error, as each
    executor would write to its own disk.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        master = spark.conf.get("spark.master", "")
        if not (master == "local" or master.startswith("local[")):
            raise ValueError(f"spark.checkpoint.dir must name a folder that all executors share (master {master})")
        root = tempfile.mkdtemp(prefix="spark-")
        spark.conf.set("spark.checkpoint.dir", root)
    path = f"{root.rstrip('/')}/{name}"
    if "://" not in path:
        os.makedirs(path, exist_ok=True)
    return path


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write an intermediate table to the shared folder and read it back.

    Cuts the lineage where one result feeds several branches; unlike cached blocks it
    survives lost executors and carries file statistics for the next join. Fails when the
    rows that can be read are not the rows that were written.
    """
    path = f"{shared_dir(df.sparkSession, 'tables')}/{name}-{uuid.uuid4().hex}"
    seen = Observation()
    df.observe(seen, F.count(F.lit(1)).alias("n")).write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    written, found = seen.get["n"], out.count()
    if written != found:
        raise RuntimeError(f"{path}: {written} rows written, {found} can be read; is the folder shared?")
    return out


def release(*tables: DataFrame) -> None:
    """Delete the files of materialized tables that nothing reads any more."""
    for df in tables:
        jvm, conf = df.sparkSession._jvm, df.sparkSession._jsparkSession.sessionState().newHadoopConf()
        for folder in {f.rpartition("/")[0] for f in df.inputFiles()}:
            path = jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(conf).delete(path, True)


def local_session(app: str = "stavelake", cores: str | None = None) -> SparkSession:
    """Session for tests and the local benchmark."""
    n = cores or os.environ.get("BENCH_CPUS", "8")
    return (
        SparkSession.builder.master(f"local[{n}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(n))
        .config("spark.driver.memory", os.environ.get("SPARK_DRIVER_MEMORY", "16g"))
        .config("spark.ui.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .getOrCreate()
    )
