"""Keyed tables that streams keep up to date: versions of Parquet and a pointer to the present one."""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.checkpoints import remove

Fold = Callable[[DataFrame, DataFrame], DataFrame]


class KeyedTable:
    """A table in a shared folder that micro-batches are folded into.

    A batch writes a whole new version beside the present one; the version counts once its pointer, a small file that is
    renamed into place, is there. A pointer holds the last batch of each stream, so a batch that is run again after a failure changes
    nothing, and a run that dies half way leaves the table as it was. One writer at a time. The present version and the one before
    it, which readers may still hold, are kept.
    """

    def __init__(self, spark: SparkSession, folder: str, schema: T.StructType | str):
        self.spark, self.folder = spark, folder.rstrip("/")
        self.schema = schema if isinstance(schema, T.StructType) else T.StructType.fromDDL(schema)

    def _fs(self, path: str):
        at = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        return at.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), at

    def _pointers(self) -> list[int]:
        fs, at = self._fs(f"{self.folder}/pointers")
        names = [f.getPath().getName() for f in fs.listStatus(at)] if fs.exists(at) else []
        return sorted(int(n.removesuffix(".json")) for n in names if n.endswith(".json") and n[:-5].isdigit())

    def _present(self) -> dict:
        versions = self._pointers()
        if not versions:
            return {"version": 0, "batches": {}}
        text = self.spark.read.text(f"{self.folder}/pointers/{versions[-1]}.json", wholetext=True).first()[0]
        return json.loads(text)

    def read(self) -> DataFrame:
        """The table as the last whole batch left it."""
        now = self._present()
        if not now["version"]:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(f"{self.folder}/v{now['version']}")

    def fold(self, batch: DataFrame, batch_id: int, how: Fold, stream: str = "stream") -> bool:
        """Replace the table by ``how(table, batch)``, unless the stream's batch has been folded before; whether it was new."""
        now = self._present()
        if batch_id <= now["batches"].get(stream, -1):
            return False
        version = now["version"] + 1
        new = how(self.read(), batch).select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in self.schema])
        new.write.mode("overwrite").parquet(f"{self.folder}/v{version}")  # a version without a pointer is of a run that died
        text = json.dumps({"version": version, "batches": now["batches"] | {stream: batch_id}})
        fs, draft = self._fs(f"{self.folder}/pointers/{version}.draft")
        _, at = self._fs(f"{self.folder}/pointers/{version}.json")
        out = fs.create(draft, True)
        out.write(bytearray(text.encode()))
        out.close()
        if not fs.rename(draft, at):
            raise RuntimeError(f"another writer has made version {version} of {self.folder}")
        if version > 2:
            remove(self.spark, f"{self.folder}/pointers/{version - 2}.json")
            remove(self.spark, f"{self.folder}/v{version - 2}")
        return True


def latest_by(keys: list[str], order: list[str]) -> Fold:
    """A fold that keeps each key's row with the largest ``order``; of the table and the batch alike."""

    def fold(table: DataFrame, batch: DataFrame) -> DataFrame:
        both = table.unionByName(batch.select(*table.columns))
        rest = [c for c in table.columns if c not in keys and c not in order]
        best = F.max_by(F.struct(*rest), F.struct(*order)) if rest else F.lit(None)
        rows = both.groupBy(*keys).agg(F.max(F.struct(*order)).alias("_o"), best.alias("_r"))
        return rows.select(*keys, *[F.col("_o")[c].alias(c) for c in order], *[F.col("_r")[c].alias(c) for c in rest])

    return fold


def summed(keys: list[str], numbers: list[str]) -> Fold:
    """A fold that adds the batch's numbers to the table's; keys whose numbers are all zero go."""

    def fold(table: DataFrame, batch: DataFrame) -> DataFrame:
        both = table.unionByName(batch.select(*table.columns)).groupBy(*keys).agg(*[F.sum(n).alias(n) for n in numbers])
        some = F.lit(False)
        for n in numbers:
            some = some | (F.col(n) != 0)
        return both.where(some)

    return fold
