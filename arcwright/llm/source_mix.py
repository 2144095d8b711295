"""Mixing sources to target weights with hash-threshold histograms.

Every document has a fixed pseudo-random place (a hash of its id). A source that
is to give ``budget`` words gives every document ``budget div source_size`` times
and the documents below a hash threshold once more. The threshold is found without
sorting: sum sizes by hash bucket, find the bucket in which the budget ends, and
refine that bucket alone. A smaller budget takes a subset of a larger one's words.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, hash60, packed, unpacked, words_in

#: Sources up to this many are broadcast (a few MB); more are joined by shuffle.
BROADCAST_SOURCES = 50_000
#: Right shifts of the 60-bit hash: 4096 buckets, then 4096 in each boundary bucket, and the hash itself at last.
SHIFTS = (48, 36, 24, 0)


def source_targets(sized: DataFrame, weights: tuple[int, ...] = (1, 2, 3), cap: float = 3.0) -> DataFrame:
    """Target words of each source: (source, source_size, target).

    Sources in code-point order, null last, take the weights in turn and share all
    words by weight. No target exceeds ``cap`` times the source's size; the excess
    goes to the others by weight. The level at which this settles is found from
    running sums over the sources in order of cap by weight (one row a source).
    """
    totals = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    turn = (F.row_number().over(by_name) - 1) % len(weights)
    weight = F.element_at(F.array(*map(F.lit, weights)), (turn + 1).cast("int")).cast("long")
    ranked = totals.withColumn("weight", weight).withColumn("most", F.lit(cap) * F.col("source_size"))
    by_fill = Window.orderBy(F.col("most") / F.col("weight"), F.col("source").asc_nulls_last())
    before = by_fill.rowsBetween(Window.unboundedPreceding, -1)
    after = by_fill.rowsBetween(0, Window.unboundedFollowing)
    everything = Window.partitionBy()
    filled = (
        ranked.withColumn("nth", F.row_number().over(by_fill))
        .withColumn("full_before", F.coalesce(F.sum("source_size").over(before), F.lit(0)))
        .withColumn("weight_after", F.sum("weight").over(after))
        .withColumn("all_words", F.sum("source_size").over(everything))
        .withColumn("level", (F.col("all_words") - F.lit(cap) * F.col("full_before")) / F.col("weight_after"))
        .withColumn("fits", F.col("level") * F.col("weight") <= F.col("most"))
        .withColumn("settled", F.min(F.when(F.col("fits"), F.struct("nth", "level"))).over(everything))
    )
    uncapped = F.col("nth") >= F.col("settled.nth")
    target = F.when(uncapped, F.col("settled.level") * F.col("weight")).otherwise(F.col("most"))
    return filled.select("source", "source_size", target.cast("double").alias("target"))


def _small(df: DataFrame, fits: bool) -> DataFrame:
    return F.broadcast(df) if fits else df


def _same(a: DataFrame, b: DataFrame) -> Column:
    return a["source"].eqNullSafe(b["of"])


def hash_thresholds(sized: DataFrame, targets: DataFrame, fits: bool) -> DataFrame:
    """Where each source's budget ends: (of, times, at, rest, share).

    All documents of the source are taken ``times`` times; those with a hash below
    ``at`` once more; those at it share ``rest`` words in proportion to their
    ``share`` words in all (one document, unless ids repeat).
    """
    budget = F.floor("target").cast("long")
    size = F.greatest("source_size", F.lit(1))
    ends = targets.select(
        F.col("source").alias("of"),
        F.floor(budget / size).cast("long").alias("times"),
        (budget % size).alias("rest"),
        F.lit(0).cast("long").alias("bucket"),
    )
    shift_before = 60
    for shift in SHIFTS:
        left = sized.join(
            _small(ends, fits),
            _same(sized, ends) & (F.shiftright(sized["hash"], shift_before) == ends["bucket"]),
        )
        sums = left.groupBy("of", "times", "rest", F.shiftright("hash", shift).alias("next")).agg(F.sum("size").alias("words"))
        upto = Window.partitionBy("of").orderBy("next")
        found = sums.withColumn("upto", F.sum("words").over(upto)).where(F.col("upto") > F.col("rest"))
        first = found.groupBy("of", "times", "rest").agg(F.min(F.struct("next", "upto", "words")).alias("end"))
        ends = cut(
            first.select(
                "of",
                "times",
                (F.col("rest") - F.col("end.upto") + F.col("end.words")).alias("rest"),
                F.col("end.next").alias("bucket"),
                F.col("end.words").alias("share"),
            )
        )
        shift_before = shift
    return ends.withColumnRenamed("bucket", "at")


def mix_sources(docs: DataFrame, weights: tuple[int, ...] = (1, 2, 3), cap: float = 3.0) -> DataFrame:
    """How many words of each document a mix takes.

    ``docs`` needs doc_id, text and source; other columns are left out. Returns
    doc_id, hash, source, size, source_size, target, taken. Null texts have no words
    and give none; a null source is a source of its own, last in order. The document
    at which a source's budget ends gives only the words that are left of it, so a
    source gives ``floor(target)`` words (less than one word short for each further
    row that repeats that document's id). No document gives more than ``cap`` (a whole
    number) times its size. The same ids always give the same mix; an empty table an empty one.
    Up to 50,000 sources are broadcast, so a source's rows stay where they are; beyond that rows are joined by shuffle
    on their source, where Spark's adaptive planning splits a source that holds a large share of them. Targets are ranked in one task, a row a source.
    """
    if cap != int(cap) or cap < 1:
        raise ValueError("cap must be a whole number of repeats")
    sized = cut(
        docs.select(
            "doc_id",
            "source",
            words_in(F.col("text")).alias("size"),
            hash60(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))).alias("hash"),
        )
    )
    targets = cut(source_targets(sized, weights, cap))
    fits = targets.count() <= BROADCAST_SOURCES
    ends = hash_thresholds(sized, targets, fits)
    plan = targets.join(_small(ends, fits), targets["source"].eqNullSafe(ends["of"]), "left").drop("of").withColumnRenamed("source", "of")
    more = (
        F.when(F.col("hash") < F.col("at"), F.col("size"))
        .when(F.col("hash") == F.col("at"), F.expr("rest * size div share"))
        .otherwise(0)
    )
    taken = F.coalesce(F.col("times") * F.col("size") + more, F.lit(0)).cast("long")
    return sized.join(_small(plan, fits), _same(sized, plan)).select(
        "doc_id", "hash", "source", "size", "source_size", "target", taken.alias("taken")
    )


def mixed_documents(docs: DataFrame, **how) -> DataFrame:
    """The mix itself, with the columns of ``docs``: each document as often as it is taken.

    Rows repeat for documents that are taken several times. A document taken in part
    has its first words in its last copy, and ``n_chars`` (where there is one) follows.
    Documents that the mix takes no word of are not in it. Copies of one (id, source, size)
    are taken alike.
    """
    plan = mix_sources(docs, **how).where("taken > 0").select("doc_id", "source", "size", "taken").distinct()
    rows = packed(docs)
    doc_id, source, text = (F.col("row")[c] for c in ("doc_id", "source", "text"))
    rows = rows.withColumn("words", words_in(text))
    same = doc_id.eqNullSafe(plan["doc_id"]) & source.eqNullSafe(plan["source"]) & (rows["words"] == plan["size"])
    copies = F.ceil(F.col("taken") / F.col("size")).cast("int")
    out = rows.join(plan, same).select("row", "size", "taken", F.explode(F.sequence(F.lit(1), copies)).alias("copy"))
    out = out.withColumn("left", F.col("taken") - (F.col("copy") - 1) * F.col("size"))
    first_words = F.expr(
        r"array_join(slice(regexp_extract_all(row.text, '[\\x20\\x09-\\x0D]*[^\\x20\\x09-\\x0D]+', 0), 1, cast(left as int)), '')"
    )
    part = F.col("left") < F.col("size")
    out = out.withColumn("new_text", F.when(part, first_words).otherwise(text))
    new = {"text": F.col("new_text")}
    if "n_chars" in docs.columns:
        new["n_chars"] = F.when(part, F.length("new_text").cast("long")).otherwise(F.col("row")["n_chars"])
    return out.select(*unpacked(docs.columns, **new))
