"""Line dedup with levelled sorted runs of line hashes.

Documents arrive in batches, largest ids first. A run holds, sorted by line hash,
how many documents of its batch have the line and, if no earlier run has the line,
the document that keeps it. Each new batch is sorted likewise and merge-anti-joined with one
run after the other: lines that all of them lack get their keeper from this batch,
and the batch's run is added. When a level holds ``fanout`` runs they are merged into
one run of the next level, so a batch meets few runs. Runs live in the cluster's
shared folder (as checkpoints), dealt by hash to the same partitions and kept in order, so a
batch's rows move once, into its own run, and joins and merges of runs move nothing.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType

from .common import WHITE, cut, cut_in_order, hash_bound, join_hot, packed, unpacked

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def line_key(line: Column) -> Column:
    """The line without white space at its ends, A-Z in lower case."""
    return F.translate(F.trim(line, F.lit(WHITE)), UPPER, LOWER)


def text_lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def line_places(docs: DataFrame, min_chars: int) -> DataFrame:
    """(doc_id, text_id, pos, h1, h2): each line with a key of at least ``min_chars`` code points, by a 128-bit hash."""
    lines = docs.select("doc_id", F.xxhash64("text").alias("text_id"), F.posexplode(text_lines(F.col("text"))).alias("pos", "line"))
    keyed = lines.select("doc_id", "text_id", "pos", line_key(F.col("line")).alias("key")).where(F.length("key") >= min_chars)
    return keyed.select("doc_id", "text_id", "pos", F.xxhash64("key").alias("h1"), F.xxhash64(F.lit(1), F.col("key")).alias("h2"))


class LineRuns:
    """The store of runs: ``add`` a batch, ``merged`` for all of them.

    A run has one row for each line hash of its batches, in ``parts`` partitions by hash and in order of
    the hashes within each: (h1, h2, n_docs, keeper). All runs have the same partitions, so
    joins and merges of runs move no row.
    """

    def __init__(self, parts: int, fanout: int = 2):
        self.parts = parts
        self.fanout = fanout
        self.levels: list[list[DataFrame]] = []

    def runs(self) -> list[DataFrame]:
        return [run for level in self.levels for run in level]

    def add(self, lines: DataFrame) -> None:
        """lines: (doc_id, h1, h2) of documents whose ids are below those of all earlier batches."""
        per_doc = lines.groupBy("h1", "h2", "doc_id").agg(F.lit(1).alias("one"))
        # counted before the rows go to the run's partitions: a line of every document is one row a task
        counts = per_doc.groupBy("h1", "h2").agg(F.sum("one").cast("long").alias("n_docs"), F.max("doc_id").alias("keeper"))
        batch = cut_in_order(counts.repartition(self.parts, "h1", "h2").sortWithinPartitions("h1", "h2"))
        fresh = batch.select("h1", "h2", "keeper")
        for run in self.runs():
            fresh = fresh.hint("merge").join(run.select("h1", "h2"), ["h1", "h2"], "left_anti")
        if self.runs():  # lines that earlier runs have were counted in this batch, but have their keeper already
            batch = cut_in_order(batch.drop("keeper").hint("merge").join(fresh, ["h1", "h2"], "left"))
        self._put(0, batch)

    def _put(self, level: int, run: DataFrame) -> None:
        while len(self.levels) <= level:
            self.levels.append([])
        self.levels[level].append(run)
        if len(self.levels[level]) >= self.fanout:
            merged = cut_in_order(self._merge(self.levels[level]))
            self.levels[level] = []
            self._put(level + 1, merged)

    def _merge(self, runs: list[DataFrame]) -> DataFrame:
        every = reduce(DataFrame.unionByName, runs)
        merged = every.groupBy("h1", "h2").agg(F.sum("n_docs").alias("n_docs"), F.max("keeper").alias("keeper"))
        return merged.repartition(self.parts, "h1", "h2").sortWithinPartitions("h1", "h2")

    def merged(self) -> DataFrame:
        """(h1, h2, n_docs, keeper) over all runs, merged from the smallest upwards."""
        runs = self.runs()
        return runs[0] if len(runs) == 1 else self._merge(runs)


#: Ids among which the cuts of batches are chosen where ids are no numbers.
ID_SAMPLE = 2000


def _id_cuts(docs: DataFrame, batches: int) -> list:
    """At most ``batches`` - 1 ids between ranges of about equal size, the largest first; where ids aren't numbers, by those with the smallest hashes."""
    at = [i / batches for i in range(1, batches)]
    if isinstance(docs.schema["doc_id"].dataType, NumericType):
        cuts = docs.agg(F.percentile_approx("doc_id", at, 10_000).alias("cuts")).first()["cuts"]
    else:
        ids = docs.select("doc_id").where("doc_id IS NOT NULL")
        some = ids.where(F.xxhash64("doc_id") <= hash_bound(ID_SAMPLE, ids.count())).distinct().limit(10 * ID_SAMPLE)
        some = sorted(r["doc_id"] for r in some.collect())
        cuts = [some[int(len(some) * q)] for q in at] if some else []
    return sorted(set(cuts or []), reverse=True)


def repeated_places(docs: DataFrame, min_docs: int, min_chars: int, batches: int, fanout: int, run_rows: int) -> DataFrame:
    """(doc_id, text_id, drop): the line positions, in order, that each document loses."""
    places = line_places(docs, min_chars)
    cuts = _id_cuts(docs, batches)
    batch = F.lit(len(cuts))
    for i, least in reversed(list(enumerate(cuts))):
        batch = F.when(F.col("doc_id") > least, i).otherwise(batch)
    places = cut(places.withColumn("batch", batch))
    n = places.count()
    store = LineRuns(max(1, -(-n // run_rows)), fanout)
    for i in range(len(cuts) + 1):
        store.add(places.where(F.col("batch") == i).select("doc_id", "h1", "h2"))
    repeated = cut(store.merged().where(F.col("n_docs") >= min_docs).select("h1", "h2", "n_docs", "keeper"))
    lost = join_hot(places, repeated, ["h1", "h2"], "n_docs", n).where(~F.col("doc_id").eqNullSafe(F.col("keeper")))
    return lost.groupBy("doc_id", "text_id").agg(F.array_sort(F.collect_set("pos")).alias("drop"))


def dedup_lines(docs: DataFrame, min_docs: int = 5, min_chars: int = 40, batches: int = 4, fanout: int = 2, run_rows: int = 1_000_000) -> DataFrame:
    """Every document with its repeated lines taken out.

    A line's key is the line stripped of white space with A-Z in lower case. Keys of at
    least ``min_chars`` code points that ``min_docs`` documents hold lose all their lines
    but those of the largest doc_id that holds it. Returns the columns of ``docs`` with
    the new ``text``, and n_lines, n_dropped. A null or empty text is one empty line and
    stays as it is. Rows that repeat a doc_id count as one document; rows with a null
    doc_id as one document below all others. Lines are compared by 128-bit hashes. ``batches``: ranges of
    ids (of any type that sorts) that are added one after the other, each a job of the whole cluster; a run's partition has about
    ``run_rows`` line hashes at most.
    """
    drops = repeated_places(docs, min_docs, min_chars, batches, fanout, run_rows)
    drops = drops.select(F.col("doc_id").alias("id"), "text_id", "drop")
    rows = packed(docs)
    row_id, text = F.col("row")["doc_id"], F.col("row")["text"]
    rows = rows.join(drops, row_id.eqNullSafe(F.col("id")) & (F.xxhash64(text) == F.col("text_id")), "left")
    # one flag for each line up to the last dropped one: the gaps between dropped positions, spelt out
    flags = F.expr(
        "flatten(transform(drop, (p, i) -> concat("
        "array_repeat(false, p - if(i = 0, 0, drop[i - 1] + 1)), array(true))))"
    )
    rows = rows.withColumn("lines", text_lines(text)).withColumn("flags", flags)
    kept = F.filter(F.col("lines"), lambda _, i: ~F.coalesce(F.get(F.col("flags"), i), F.lit(False)))
    new = F.when(F.col("drop").isNull(), text).otherwise(F.array_join(kept, "\n"))
    columns = [c for c in docs.columns if c not in ("n_lines", "n_dropped")]
    return rows.select(
        *unpacked(columns, text=new),
        F.size("lines").cast("long").alias("n_lines"),
        F.when(F.col("drop").isNull(), 0).otherwise(F.size("drop")).cast("long").alias("n_dropped"),
    )
