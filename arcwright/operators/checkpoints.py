"""Cutting lineage in the folder that all executors share."""

from __future__ import annotations

import tempfile
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def scratch_dir(spark: SparkSession) -> str:
    """The session's checkpoint folder. Where none is named: a local one if the master is local (as in tests), else an error."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        named = spark.conf.get("spark.checkpoint.dir", None)
        if not named and not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="arcwright-"))
    return sc.getCheckpointDir()


def cut(df: DataFrame) -> DataFrame:
    """Write the rows to the shared folder and drop the lineage above them."""
    scratch_dir(df.sparkSession)
    return df.checkpoint(eager=True)


@contextmanager
def _setting(spark: SparkSession, key: str, value: str) -> Iterator[None]:
    before = spark.conf.get(key, None)
    spark.conf.set(key, value)
    try:
        yield
    finally:
        spark.conf.unset(key) if before is None else spark.conf.set(key, before)


def cut_in_order(df: DataFrame) -> DataFrame:
    """As ``cut``, and what follows knows the rows' partitions and their order, so it needn't shuffle or sort them again.

    The plan must not have been run before. Adaptive planning, which hides both, is off while the rows are written, so
    the number of partitions is what ``repartition`` or the session says.
    """
    with _setting(df.sparkSession, "spark.sql.adaptive.enabled", "false"):
        return cut(df)


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder wherever Spark's paths lead."""
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)
