"""Sharding by a hierarchical weighted hash tree.

Region, rack and shard levels each choose one child by a weighted hash draw: child
c of weight w gets ``-ln(u(key, c)) / w`` and the smallest draw wins, so a child is
chosen in proportion to its weight. A draw depends on the key, the child and the
child's weight alone: if a weight changes, rows only move into or out of that
child's subtree at each level. New capacity is added as a new region, into which
rows only move.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut

#: Added to a row's bytes: what a record needs besides its text.
ROW_OVERHEAD = 16
#: Rows that one task numbers at a time (a bucket of a shard), on average.
SLOT_BUCKET_ROWS = 20_000
#: Copies of a row that are numbered at a time.
STRETCH = 65_536


@dataclass(frozen=True)
class HashTree:
    """children: for each inner node, its children and their weights; ``root`` is the top. Leaves: ``shard:N``."""

    children: dict[str, tuple[tuple[str, float], ...]]
    levels: int = 3

    @classmethod
    def of(cls, regions: dict[str, dict[str, dict[int, float]]]) -> "HashTree":
        """Region name -> rack name -> shard number -> weight; a node weighs what its children weigh."""
        rack_weight = {(r, k): float(sum(s.values())) for r, racks in regions.items() for k, s in racks.items()}
        kids: dict[str, tuple[tuple[str, float], ...]] = {
            "root": tuple((f"region:{r}", sum(rack_weight[r, k] for k in racks)) for r, racks in regions.items())
        }
        for r, racks in regions.items():
            kids[f"region:{r}"] = tuple((f"rack:{r}/{k}", rack_weight[r, k]) for k in racks)
            for k, shards in racks.items():
                kids[f"rack:{r}/{k}"] = tuple((f"shard:{n}", float(w)) for n, w in shards.items())
        return cls(kids)

    @classmethod
    def even(cls, shards: int, regions: int = 5, racks: int = 2) -> "HashTree":
        """Equal shards, numbered through ``regions`` times ``racks`` racks (which must divide them)."""
        per = shards // (regions * racks)
        if per * regions * racks != shards:
            raise ValueError("shards must fill the racks evenly")
        return cls.of(
            {
                str(r): {str(k): {(r * racks + k) * per + s: 1.0 for s in range(per)} for k in range(racks)}
                for r in range(regions)
            }
        )

    def with_region(self, name: str, shards: dict[int, float]) -> "HashTree":
        """The same tree with one more region of one rack."""
        weight = float(sum(shards.values()))
        return HashTree(
            self.children
            | {
                "root": (*self.children["root"], (f"region:{name}", weight)),
                f"region:{name}": ((f"rack:{name}/0", weight),),
                f"rack:{name}/0": tuple((f"shard:{n}", float(w)) for n, w in shards.items()),
            },
            self.levels,
        )


def _draw(key: Column, child: Column, weight: Column) -> Column:
    # 52 bits of an MD5, moved half a step off 0 and 1, so the logarithm is finite
    bits = F.conv(F.substring(F.md5(F.concat(key, F.lit("|"), child)), 1, 13), 16, 10).cast("double")
    return -F.log((bits + F.lit(0.5)) / F.lit(float(2**52))) / weight


def _choose(key: Column, children: Column) -> Column:
    """The child with the smallest draw; children: array of (name, weight)."""
    drawn = F.transform(children, lambda c: F.struct(_draw(key, c["name"], c["weight"]).alias("draw"), c["name"].alias("name")))
    return F.array_min(drawn)["name"]


def _as_array(children: tuple[tuple[str, float], ...]) -> Column:
    return F.array(*[F.struct(F.lit(n).alias("name"), F.lit(w).alias("weight")) for n, w in children if w > 0])


def shard_of(df: DataFrame, key: Column, tree: HashTree, out: str) -> DataFrame:
    """Add column ``out``: the shard number (int) that ``tree`` gives to the string ``key``.

    A tree is a few entries for each shard, so its levels are literals in the plan.
    """
    df = df.withColumn("_key", key).withColumn("_node", _choose(F.col("_key"), _as_array(tree.children["root"])))
    for _ in range(tree.levels - 1):
        below = [(name, kids) for name, kids in tree.children.items() if name != "root" and any(w > 0 for _, w in kids)]
        kids = F.create_map(*[x for name, k in below for x in (F.lit(name), _as_array(k))])
        df = df.withColumn("_kids", F.element_at(kids, F.col("_node"))).withColumn("_node", _choose(F.col("_key"), F.col("_kids")))
    number = F.split_part(F.col("_node"), F.lit(":"), F.lit(2)).cast("int")
    return df.withColumn(out, number).drop("_key", "_node", "_kids")


def slots(df: DataFrame, shard: str, order: list[str], bucket_rows: int = SLOT_BUCKET_ROWS) -> DataFrame:
    """Add column ``slot``: each shard's rows numbered from 0 without gaps.

    Equal rows are counted first, so they move as one. A shard is numbered in hash buckets (of the columns of ``order``) of about ``bucket_rows`` rows, each from where
    the buckets before it end, so no task holds a shard. Slots depend on the rows alone, not on how the table lies in files.
    """
    equal = cut(df.groupBy(*df.columns).agg(F.count(F.lit(1)).alias("_copies")))
    n = equal.agg(F.coalesce(F.sum("_copies"), F.lit(0)).alias("n")).first()["n"]
    shards = max(1, equal.select(shard).distinct().count())
    buckets = max(1, -(-n // (bucket_rows * shards)))
    rows = equal.withColumn("_bucket", F.pmod(F.xxhash64(*order), F.lit(buckets)))
    before = Window.partitionBy(shard).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = (
        rows.groupBy(shard, "_bucket")
        .agg(F.sum("_copies").alias("_n"))
        .withColumn("_start", F.coalesce(F.sum("_n").over(before), F.lit(0)))
        .select(F.col(shard).alias("_s"), F.col("_bucket").alias("_b"), "_start")
    )
    rest = [c for c in df.columns if c not in order]
    own = Window.partitionBy(shard, "_bucket").orderBy(*order, *rest).rowsBetween(Window.unboundedPreceding, -1)
    numbered = rows.withColumn("_at", F.coalesce(F.sum("_copies").over(own), F.lit(0)))
    joined = numbered.join(starts, (F.col(shard) == F.col("_s")) & (F.col("_bucket") == F.col("_b")))
    # many copies come out in stretches, so no row holds the numbers of all of them
    at = joined.withColumn("_i", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("_copies") - 1) / STRETCH))))
    first = F.col("_start") + F.col("_at") + F.col("_i") * STRETCH
    last = F.least(first + STRETCH, F.col("_start") + F.col("_at") + F.col("_copies")) - 1
    return at.select(*df.columns, F.explode(F.sequence(first.cast("long"), last.cast("long"))).alias("slot"))


def shard_rows(docs: DataFrame, tree: HashTree, grown: HashTree | None = None) -> DataFrame:
    """Put every document into a shard by its id (law ``key``).

    ``docs`` needs doc_id and text; other columns are left out. Returns doc_id, size
    (UTF-8 bytes of the text plus 16; 16 for a null text), text_crc32 (0 for a null or
    empty text), law, shard, slot and grown_shard (the shard in ``grown``, null without
    one). Rows with the same id share a shard; null ids share one as well. Only the id,
    the size and the checksum of a row leave its scan.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select(
        "doc_id",
        (F.octet_length(text) + F.lit(ROW_OVERHEAD)).cast("long").alias("size"),
        F.crc32(text).alias("text_crc32"),
        F.lit("key").alias("law"),
    )
    key = F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))
    rows = shard_of(rows, key, tree, "shard")
    rows = shard_of(rows, key, grown, "grown_shard") if grown else rows.withColumn("grown_shard", F.lit(None).cast("int"))
    out = slots(rows, "shard", ["doc_id", "text_crc32", "size"])
    return out.select("doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard")
