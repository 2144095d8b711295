"""Ranks, percentiles and quantile bins that need no group in one task.

Values are cut into ranges at approximate quantiles. Rows are ranked within their
range; what lies in lower ranges is added from a small table of counts. Equal values
always share a range, so ties are exact.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .checkpoints import cut

#: Ranges per ranking; a task ranks about this fraction of a group.
RANGES = 24


def range_cuts(df: DataFrame, value: str, ranges: int = RANGES) -> list[float]:
    """Approximate quantiles of a numeric column, distinct and in order (at most ``ranges`` - 1 numbers)."""
    at = [i / ranges for i in range(1, ranges)]
    got = df.agg(F.percentile_approx(F.col(value).cast("double"), at, 10_000).alias("q")).first()["q"]
    return sorted(set(got or []))


def range_of(value: Column, cuts: list[float]) -> Column:
    """How many cuts lie below the value: the same for equal values."""
    if not cuts:
        return F.lit(0)
    return F.size(F.filter(F.array(*map(F.lit, cuts)), lambda c: c < value.cast("double")))


def ranks_within(df: DataFrame, groups: list[str], value: str, ranges: int = RANGES) -> DataFrame:
    """Rows with a value, with less (rows of the group below it), ties (equal rows, itself included) and n (rows with a value).

    Null and NaN values are left out. Null groups are groups.
    """
    v = F.col(value).cast("double")
    rows = df.withColumn("_v", v).where(v.isNotNull() & ~F.isnan(v))
    rows = rows.withColumn("_r", range_of(F.col("_v"), range_cuts(rows, "_v", ranges)))
    part = Window.partitionBy(*groups) if groups else Window.partitionBy()
    starts = rows.groupBy(*groups, "_r").agg(F.count(F.lit(1)).alias("_k")).select(
        *[F.col(g).alias(f"_g{i}") for i, g in enumerate(groups)],
        F.col("_r").alias("_q"),
        (F.sum("_k").over(part.orderBy("_r")) - F.col("_k")).alias("_below"),
        F.sum("_k").over(part).alias("n"),
    )
    own = Window.partitionBy(*groups, "_r").orderBy("_v")
    rows = rows.withColumn("_rank", F.rank().over(own) - 1).withColumn("ties", F.count("_v").over(own.rangeBetween(0, 0)))
    match = rows["_r"] == starts["_q"]
    for i, g in enumerate(groups):
        match = match & rows[g].eqNullSafe(starts[f"_g{i}"])
    joined = rows.join(starts, match)
    return joined.select(*df.columns, (F.col("_below") + F.col("_rank")).cast("long").alias("less"), "ties", "n")


def percentiles_within(df: DataFrame, key: str, groups: list[str], values: dict[str, str], descending: bool = False) -> DataFrame:
    """For each value column, named out in ``values``, add out: the rank by number of values in the group, ties at their
    average rank; null where the value is missing.

    Several rows may have one ``key``: each is ranked for itself, told apart by a number that it is written with.
    """
    rows = cut(df.withColumn("_row", F.monotonically_increasing_id()))
    each = F.explode(F.array(*[F.struct(F.lit(v).alias("of"), F.col(v).cast("double").alias("x")) for v in values])).alias("_e")
    long = rows.select(F.col("_row").alias("_key"), *groups, each).select("_key", *groups, F.col("_e.of").alias("_of"), F.col("_e.x").alias("_x"))
    r = ranks_within(long, [*groups, "_of"], "_x")
    below = F.col("n") - F.col("less") - F.col("ties") if descending else F.col("less")
    pct = (below + 1 + (F.col("ties") - 1) / 2) / F.col("n")
    wide = r.groupBy("_key").agg(*[F.max(F.when(F.col("_of") == v, pct)).alias(out) for v, out in values.items()])
    return rows.join(wide, rows["_row"] == wide["_key"], "left").drop("_key", "_row")


def number_rows(
    df: DataFrame, value: str, then: list[str], out: str, descending: bool = True, ranges: int = RANGES, cuts: list[float] | None = None
) -> DataFrame:
    """Add ``out``: rows numbered from 1 by value, then by the columns of ``then`` upwards; missing values last.

    ``cuts``: known range cuts of the value (of its negative where descending), to save the pass that finds them.
    """
    r = df.withColumn("_v", F.when(~F.isnan(F.col(value).cast("double")), F.col(value).cast("double")))
    r = r.withColumn("_v", -F.col("_v") if descending else F.col("_v"))
    cuts = range_cuts(r, "_v", ranges) if cuts is None else cuts
    r = r.withColumn("_range", F.when(F.col("_v").isNull(), F.lit(len(cuts) + 1)).otherwise(range_of(F.col("_v"), cuts)))
    counts = r.groupBy("_range").agg(F.count(F.lit(1)).alias("_k"))
    starts = counts.withColumn("_below", F.sum("_k").over(Window.orderBy("_range")) - F.col("_k")).select(F.col("_range").alias("_r"), "_below")
    own = Window.partitionBy("_range").orderBy(F.col("_v").asc_nulls_last(), *then)
    numbered = r.withColumn("_at", F.row_number().over(own)).join(F.broadcast(starts), F.col("_range") == F.col("_r"))
    return numbered.select(*df.columns, (F.col("_below") + F.col("_at")).cast("long").alias(out))


def running_sums(df: DataFrame, value: str, sums: dict[str, Column], groups: list[str] | None = None, descending: bool = False, ranges: int = RANGES) -> DataFrame:
    """Add for each name in ``sums`` the sum of its column over the group's rows up to the row's value (from it on where descending), ties included.

    Rows are summed within ranges of the value; what lies in other ranges is added from a small table. The value must be there.
    """
    groups = groups or []
    r = df.withColumn("_r", range_of(F.col(value), range_cuts(df, value, ranges)))
    r = r.withColumn("_r", -F.col("_r")) if descending else r
    for i, (name, column) in enumerate(sums.items()):
        r = r.withColumn(f"_c{i}", column)
    n = range(len(sums))
    part = Window.partitionBy(*groups) if groups else Window.partitionBy()
    totals = r.groupBy(*groups, "_r").agg(*[F.sum(f"_c{i}").alias(f"_t{i}") for i in n])
    starts = totals.select(
        *[F.col(g).alias(f"_g{i}") for i, g in enumerate(groups)], F.col("_r").alias("_q"),
        *[(F.sum(f"_t{i}").over(part.orderBy("_r")) - F.col(f"_t{i}")).alias(f"_b{i}") for i in n],
    )
    own = Window.partitionBy(*groups, "_r").orderBy(F.desc(value) if descending else F.asc(value))
    for i in n:
        r = r.withColumn(f"_u{i}", F.sum(f"_c{i}").over(own))
    match = r["_r"] == starts["_q"]
    for i, g in enumerate(groups):
        match = match & r[g].eqNullSafe(starts[f"_g{i}"])
    return r.join(starts, match).select(*df.columns, *[(F.col(f"_b{i}") + F.col(f"_u{i}")).alias(name) for i, name in enumerate(sums)])


def number_sorted(df: DataFrame, groups: list[str], order: list[str], out: str) -> DataFrame:
    """Add ``out``: the rows of each group numbered from 1 in the order of columns of any type that sorts.

    Rows are dealt to ranges of (groups, order), so a large group is sorted by many tasks; the ranges are written once, and a small table of counts says what lies before each.
    """
    dealt = cut(df.repartitionByRange(*groups, *order).withColumn("_part", F.spark_partition_id()))
    counts = dealt.groupBy(*groups, "_part").agg(F.count(F.lit(1)).alias("_k"))
    below = F.sum("_k").over(Window.partitionBy(*groups).orderBy("_part")) - F.col("_k")
    starts = counts.select(*[F.col(g).alias(f"_g{i}") for i, g in enumerate(groups)], F.col("_part").alias("_q"), below.alias("_below"))
    numbered = dealt.withColumn("_at", F.row_number().over(Window.partitionBy(*groups, "_part").orderBy(*order)))
    match = numbered["_part"] == starts["_q"]
    for i, g in enumerate(groups):
        match = match & numbered[g].eqNullSafe(starts[f"_g{i}"])
    return numbered.join(starts, match).select(*df.columns, (F.col("_below") + F.col("_at")).cast("long").alias(out))


def smallest_draws(df: DataFrame, group: str, n_groups: int, value: str, then: list[str], k: int, buckets: int = 1024) -> DataFrame:
    """The k rows of each group with the smallest value in [0, 1), ties by ``then``; fewer where a group has fewer.

    Rows are counted by buckets of the value; a bucket is taken or left whole but for the one in which the k-th row lies, so only its rows move
    and are sorted. ``n_groups`` bounds the number of groups, a row each of a broadcast table.
    """
    placed = df.withColumn("_b", F.floor(F.col(value) * buckets).cast("int"))
    counts = placed.groupBy(group, "_b").agg(F.count(F.lit(1)).alias("_k"))
    upto = F.sum("_k").over(Window.partitionBy(group).orderBy("_b"))
    edges = counts.withColumn("_upto", upto).where((F.col("_upto") >= k) & (F.col("_upto") - F.col("_k") < k)).select(F.col(group).alias("_g"), F.col("_b").alias("_edge"), (k - F.col("_upto") + F.col("_k")).alias("_need"))
    edges = F.broadcast(edges) if n_groups <= 100_000 else edges
    met = placed.join(edges, placed[group].eqNullSafe(F.col("_g")), "left")
    inside = met.where("_edge IS NULL OR _b < _edge").select(*df.columns)
    nth = F.row_number().over(Window.partitionBy(group).orderBy(value, *then))
    return inside.unionByName(met.where("_b = _edge").withColumn("_nth", nth).where("_nth <= _need").select(*df.columns))


def group_medians(df: DataFrame, groups: list[str], value: str, out: str, ranges: int = RANGES) -> DataFrame:
    """(groups..., out): the median of each group's values, halfway between the middle two; missing values are left out, groups without any don't come.

    Only the ranges of values that hold a group's middle rows are sorted. ``df`` is read three times.
    """
    v = F.col(value).cast("double")
    rows = df.select(*groups, v.alias("_v")).where(v.isNotNull() & ~F.isnan(v))
    rows = rows.withColumn("_range", range_of(F.col("_v"), range_cuts(rows, "_v", ranges)))
    counts = rows.groupBy(*groups, "_range").agg(F.count(F.lit(1)).alias("_k"))
    own = Window.partitionBy(*groups)
    placed = counts.withColumn("_below", F.sum("_k").over(own.orderBy("_range")) - F.col("_k")).withColumn("_n", F.sum("_k").over(own))
    low, high = F.floor((F.col("_n") - 1) / 2), F.ceil((F.col("_n") - 1) / 2)
    middle = placed.where((F.col("_below") <= high) & (low < F.col("_below") + F.col("_k")))
    middle = middle.select(*[F.col(g).alias(f"_g{i}") for i, g in enumerate(groups)], F.col("_range").alias("_q"), "_below", low.alias("_low"), high.alias("_high"))
    match = rows["_range"] == middle["_q"]
    for i, g in enumerate(groups):
        match = match & rows[g].eqNullSafe(middle[f"_g{i}"])
    at = F.col("_below") + F.row_number().over(Window.partitionBy(*groups, "_range").orderBy("_v")) - 1
    found = rows.join(middle, match).withColumn("_at", at).where((F.col("_at") == F.col("_low")) | (F.col("_at") == F.col("_high")))
    return found.groupBy(*groups).agg((0.5 * F.min("_v") + 0.5 * F.max("_v")).alias(out))


def exact_quantiles(df: DataFrame, value: str, at: list[float], ranges: int = 64) -> list[float]:
    """Linear-interpolated quantiles. Only the ranges that hold a wanted position are sorted.

    Missing values are left out; none left gives an empty list.
    """
    v = F.col(value).cast("double")
    values = df.select(v.alias("v")).where(v.isNotNull() & ~F.isnan(v))
    cuts = range_cuts(values, "v", ranges)
    placed = values.withColumn("r", range_of(F.col("v"), cuts))
    counts = {row["r"]: row["count"] for row in placed.groupBy("r").count().collect()}  # at most ``ranges`` rows
    n = sum(counts.values())
    if not n:
        return []
    below, total = {}, 0
    for r in sorted(counts):
        below[r], total = total, total + counts[r]
    spots = sorted({p for q in at for p in (math.floor(q * (n - 1)), math.ceil(q * (n - 1)))})
    wanted = {r: [p - below[r] + 1 for p in spots if below[r] <= p < below[r] + counts[r]] for r in counts}
    wanted = {r: ps for r, ps in wanted.items() if ps}
    keep = None
    for r, ps in wanted.items():
        rule = (F.col("r") == r) & F.col("i").isin(ps)
        keep = rule if keep is None else keep | rule
    near = placed.where(F.col("r").isin(list(wanted))).withColumn("i", F.row_number().over(Window.partitionBy("r").orderBy("v")))
    found = {below[row["r"]] + row["i"] - 1: row["v"] for row in near.where(keep).select("r", "i", "v").collect()}  # two for each quantile
    out = []
    for q in at:
        spot = q * (n - 1)
        lo, hi = math.floor(spot), math.ceil(spot)
        out.append(found[lo] + (found[hi] - found[lo]) * (spot - lo))
    return out


def bins_right_closed(value: Column, edges: list[float]) -> Column:
    """Quantile bins whose upper edge belongs to them; repeated edges are dropped; null where the value is missing."""
    inner = F.array(*[F.lit(e) for e in sorted(set(edges))]) if edges else F.array().cast("array<double>")
    return F.when(value.isNotNull(), F.greatest(F.lit(0), F.size(F.filter(inner, lambda e: e < value)) - 1))


def bins_left_closed(value: Column, edges: list[float]) -> Column:
    """Number of inner edges at or below the value: an edge value goes up."""
    inner = F.array(*[F.lit(e) for e in edges]) if edges else F.array().cast("array<double>")
    return F.size(F.filter(inner, lambda e: e <= value))


def equal_count_bins(df: DataFrame, value: str, then: list[str], k: int, out: str) -> DataFrame:
    """Add ``out``: k bins of nearly equal counts by rank, ties in the order of ``then``."""
    n = df.count()
    r = number_rows(df, value, then, "_rn", descending=False)
    at = F.when(F.lit(n) > 1, F.greatest(F.lit(0), F.ceil(F.lit(float(k)) * (F.col("_rn") - 1) / max(1, n - 1)) - 1)).otherwise(0)
    return r.withColumn(out, at.cast("int")).drop("_rn")


def ecdf_percentile(df: DataFrame, reference: DataFrame, groups: list[str], value: str, out: str) -> DataFrame:
    """Add ``out``: the share of the reference's values in the row's group at or below its value; without such a
    group, of all reference values.

    The reference is summed by distinct value first. Its counts and the rows' distinct values meet within ranges of the value; what lies in lower ranges
    comes from one array of range totals for each group, so no task sees all values of a group.
    """
    counted = reference.where(F.col(value).isNotNull())
    cuts = range_cuts(counted, value)
    place = lambda d: d.withColumn("_range", range_of(F.col("_x"), cuts))

    def share(rows: DataFrame, keys: list[str], name: str) -> DataFrame:
        ref = place(counted.groupBy(*keys, F.col(value).alias("_x")).agg(F.count(F.lit(1)).alias("_k")))
        pair = F.struct(F.col("_range").alias("r"), F.col("_t").alias("t"))
        totals = ref.groupBy(*keys, "_range").agg(F.sum("_k").alias("_t")).groupBy(*keys).agg(F.sum("_t").alias("_all"), F.collect_list(pair).alias("_totals"))  # a range each
        mine = place(rows.select(*keys, F.col(value).alias("_x")).where("_x IS NOT NULL").distinct())
        both = ref.withColumn("_side", F.lit(0)).unionByName(mine.withColumn("_side", F.lit(1)).withColumn("_k", F.lit(0).cast("long")))
        order = Window.partitionBy(*keys, "_range").orderBy("_x", "_side").rowsBetween(Window.unboundedPreceding, 0)
        got = both.withColumn("_upto", F.sum("_k").over(order)).where("_side = 1")
        if keys:
            match = F.lit(True)
            for k in keys:
                match = match & F.col(k).eqNullSafe(F.col(f"_t_{k}"))
            got = got.join(totals.withColumnsRenamed({k: f"_t_{k}" for k in keys}), match, "left")
        else:
            got = got.crossJoin(F.broadcast(totals))  # one row
        below = F.aggregate(F.filter("_totals", lambda p: p["r"] < F.col("_range")), F.lit(0).cast("long"), lambda a, p: a + p["t"])
        got = got.select(*[F.col(k).alias(f"_{k}") for k in keys], F.col("_x").alias("_value"), ((below + F.col("_upto")) / F.col("_all")).alias(name))
        match = rows[value] == got["_value"]
        for k in keys:
            match = match & rows[k].eqNullSafe(got[f"_{k}"])
        return rows.join(got, match, "left").drop("_value", *[f"_{k}" for k in keys])

    rows = share(share(df, groups, "_own"), [], "_any")
    return rows.withColumn(out, F.when(F.col(value).isNotNull(), F.coalesce("_own", "_any"))).drop("_own", "_any")


def latest_per_parent(df: DataFrame, parent: str, order: list[Column], keep: int = 1) -> DataFrame:
    """The first rows of each parent in the given order, one unless ``keep`` says more, with their place as ``nth``."""
    nth = F.row_number().over(Window.partitionBy(parent).orderBy(*order))
    return df.withColumn("nth", nth).where(F.col("nth") <= keep)  # Spark drops the others before rows move
