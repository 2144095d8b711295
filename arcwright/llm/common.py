"""Small helpers that the corpus operators share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.checkpoints import cut, cut_in_order, remove, scratch_dir  # noqa: F401
from ..operators.skew import join_hot  # noqa: F401

WHITE = " \t\n\x0b\x0c\r"
WORD = r"[^\x20\x09-\x0D]+"
#: Bytes of rows that a Python worker is sent at a time, beyond one row.
BATCH_BYTES = 4 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def bound_batches(spark: SparkSession) -> None:
    """For a program's start: send Python workers some BATCH_BYTES at a time, whatever the length of the texts; a bound that the session has been given stays.

    Operators leave the session alone, since the bound is read when a returned DataFrame runs; the registered queries and the pipeline's stages, which
    are programs, call this. It changes no result, only the memory of Python workers on long texts.
    """
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(key, None) is None:
        spark.conf.set(key, str(BATCH_BYTES))


def words_in(text: Column) -> Column:
    """Number of runs of characters that aren't white space; a null text has none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def hash60(key: Column) -> Column:
    """The first 60 bits of the MD5 of a string, as a long that SQL engines agree on."""
    return F.conv(F.substring(F.md5(key), 1, 15), 16, 10).cast("long")


def packed(df: DataFrame) -> DataFrame:
    """All columns as one struct ``row``, so a table may have columns of any name."""
    return df.select(F.struct(*[df[c] for c in df.columns]).alias("row"))


def unpacked(columns: list[str], **new: Column) -> list[Column]:
    """The columns of ``row`` in order, some replaced by name."""
    return [(new[c] if c in new else F.col("row")[c]).alias(c) for c in columns]


def hash_bound(wanted: int, n: int) -> int:
    """Of n rows with signed 64-bit hashes, all but certainly more than ``wanted`` (if there are) have one up to this bound."""
    share = min(1.0, (2 * wanted + 50) / max(1, n))
    return min(2**63 - 1, int(-(2**63) + share * 2.0**64))
