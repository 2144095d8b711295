"""Distributions, rank correlation and resampling tests.

Replicates are rows and random draws are hashes of (seed, replicate, id), so a test is a
join and two aggregates, the same on every run and cluster. Permutation p-values are
(1 + hits) / (replicates + 1).
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.geo import wrap_lon
from .checkpoints import cut
from .ranking import group_medians, number_sorted, range_cuts, range_of, ranks_within, running_sums, smallest_draws
from .spatial import nearest_neighbour


def draw(seed: int, *keys: Column | str) -> Column:
    """A number in [0, 1) from the MD5 of seed and keys."""
    text = F.concat_ws(":", F.lit(str(seed)), *[F.col(k).cast("string") if isinstance(k, str) else k.cast("string") for k in keys])
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("double") / float(2**32)


def spread(df: DataFrame) -> DataFrame:
    """The rows dealt evenly to as many partitions as the session shuffles into."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions", "200")))


def replicates(df: DataFrame, n: int) -> DataFrame:
    """Every row once for each replicate 0 to n - 1 (column rep). Rows are dealt before they are repeated: those of a small file or shuffle lie in few tasks."""
    return spread(df).withColumn("rep", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))


def value_counts(df: DataFrame, value: str, *groups: str) -> DataFrame:
    v = F.col(value).cast("double")
    return df.where(v.isNotNull() & ~F.isnan(v)).groupBy(*groups, v.alias("v")).agg(F.count(F.lit(1)).alias("k"))


#: Ranges of values by which tails are bounded, level after level, as long as more than one is left.
TAIL_LEVELS = (64, 1024)


def _tail_rows(df: DataFrame, value: str, min_tail: int) -> tuple[DataFrame, DataFrame]:
    """(sums, tails): every distinct value with n values from it on, ``above`` of them larger; and the tails that are tried."""
    c = value_counts(df, value).where("v > 0")
    sums = cut(running_sums(c, "v", {"n": F.col("k"), "s": F.col("k") * F.log("v")}, descending=True).withColumn("above", F.col("n") - F.col("k")))
    top = sums.agg(F.max("v").alias("top")).first()["top"]
    tails = sums.where((F.col("n") >= min_tail) & (F.col("v") < F.lit(top)))
    return sums, tails.select(F.col("v").alias("xmin"), "n", (1 + F.col("n") / (F.col("s") - F.col("n") * F.log("v"))).alias("alpha_pdf"))


def tails_left(sums: DataFrame, tails: DataFrame, levels: tuple[int, ...] = TAIL_LEVELS) -> DataFrame:
    """The tails whose KS distance can still be the smallest.

    Values are cut into ranges, of which only the smallest and largest value and the counts are kept. At these values the distance is known, which
    bounds a tail's from below; between them both distribution functions only rise, which bounds it from above. Tails whose lower bound exceeds
    the smallest upper bound go; those left are bounded by more ranges.
    """
    for level in levels:
        cuts = range_cuts(sums, "v", level)
        spot = F.struct("v", "k", "above")
        marks = sums.withColumn("_r", range_of(F.col("v"), cuts)).groupBy("_r").agg(F.min(spot).alias("lo"), F.max(spot).alias("hi"))
        marks = marks.agg(F.collect_list(F.struct("lo", "hi")).alias("_marks"))  # one row with ``level`` ranges
        model = lambda v: 1 - F.pow(v / F.col("xmin"), 1 - F.col("alpha_pdf"))
        upto = lambda p: (F.col("n") - p["above"]) / F.col("n")
        first = lambda p: (F.col("n") - p["above"] - p["k"] + 1) / F.col("n")

        def bound(acc: Column, m: Column) -> Column:
            lo, hi = m["lo"], m["hi"]
            whole = lo["v"] >= F.col("xmin")
            at = F.when(whole, first(lo)).otherwise(1 / F.col("n"))
            low, high = F.when(whole, model(lo["v"])).otherwise(F.lit(0.0)), model(hi["v"])
            near = F.greatest(F.abs(upto(hi) - high), F.when(whole, F.abs(at - low)).otherwise(F.lit(0.0)))
            far = F.greatest(upto(hi) - low, high - at)
            return F.struct(F.greatest(acc["least"], near).alias("least"), F.greatest(acc["most"], far).alias("most"))

        inside = F.filter("_marks", lambda m: m["hi"]["v"] >= F.col("xmin"))
        zero = F.struct(F.lit(0.0).alias("least"), F.lit(0.0).alias("most"))
        bounded = cut(tails.crossJoin(F.broadcast(marks)).select("xmin", "n", "alpha_pdf", F.aggregate(inside, zero, bound).alias("b")))
        limit = bounded.agg(F.min("b.most").alias("m")).first()["m"]
        if limit is None:
            return tails
        tails = cut(bounded.where(F.col("b.least") <= limit * (1 + 1e-9) + 1e-12).select("xmin", "n", "alpha_pdf"))
    return tails


def power_law_tail(df: DataFrame, value: str, min_tail: int = 25, few_pairs: int = 20_000_000) -> DataFrame:
    """One row (xmin, alpha_pdf, n, ks): the tail whose Pareto fit has the smallest KS distance, the smaller xmin among ties.

    Each distinct value with at least ``min_tail`` values from it on, not all equal, is tried: alpha = 1 + n / sum(ln(x / xmin)).
    Values are summed by distinct value first. Bounds from range totals leave few tails (see ``tails_left``); only these meet all values, range by range. Up to ``few_pairs`` pairs of a
    tail and a value the bounds would cost more than they save, and all are compared. No tail: no row.
    """
    sums, tails = _tail_rows(df, value, min_tail)
    cuts = range_cuts(sums, "v")
    if tails.count() * sums.count() > few_pairs:
        tails = tails_left(sums, tails)
    # a value's rank within a tail follows from its rank among all
    ranked = sums.select("v", "k", "above", range_of(F.col("v"), cuts).alias("_range"))
    each = tails.withColumn("_range", F.explode(F.sequence(range_of(F.col("xmin"), cuts), F.lit(len(cuts)))))
    pairs = each.join(ranked, "_range").where(F.col("v") >= F.col("xmin"))
    model = 1 - F.pow(F.col("v") / F.col("xmin"), 1 - F.col("alpha_pdf"))
    last = (F.col("n") - F.col("above")) / F.col("n")
    first = (F.col("n") - F.col("above") - F.col("k") + 1) / F.col("n")
    fit = pairs.groupBy("xmin", "alpha_pdf", "n").agg(F.max(F.greatest(F.abs(last - model), F.abs(first - model))).alias("ks"))
    best = fit.agg(F.min(F.struct("ks", "xmin", "alpha_pdf", "n")).alias("b"))
    return best.where("b IS NOT NULL").select("b.xmin", "b.alpha_pdf", "b.n", "b.ks")


def _largest_gap(counts: DataFrame, groups: list[str]) -> DataFrame:
    """(groups..., ks) from (groups..., v, kx, ky): both samples' numbers at each value."""
    both = running_sums(counts, "v", {"ux": F.col("kx"), "uy": F.col("ky")}, groups)
    # the sums at the largest value are the samples' sizes
    out = both.groupBy(*groups).agg(F.max("ux").alias("_nx"), F.max("uy").alias("_ny"))
    match = F.lit(True)
    for i, g in enumerate(groups):
        out = out.withColumnRenamed(g, f"_g{i}")
        match = match & F.col(g).eqNullSafe(F.col(f"_g{i}"))
    joined = both.join(out, match) if groups else both.crossJoin(F.broadcast(out))  # one row
    return joined.groupBy(*groups).agg(F.max(F.abs(F.col("ux") / F.col("_nx") - F.col("uy") / F.col("_ny"))).alias("ks"))


def _counts_of_both(x: DataFrame, y: DataFrame, groups: list[str]) -> DataFrame:
    both = x.withColumn("j", F.lit(0)).unionByName(y.withColumn("j", F.lit(1)))
    own = lambda j: F.sum(F.when(F.col("j") == j, F.col("k")).otherwise(0))
    return both.groupBy(*groups, "v").agg(own(0).alias("kx"), own(1).alias("ky"))


def ks_two_sample(x: DataFrame, y: DataFrame, value: str, groups: list[str] | None = None) -> DataFrame:
    """(groups..., ks): the largest gap between two samples' distribution functions, by group."""
    groups = groups or []
    return _largest_gap(_counts_of_both(value_counts(x, value, *groups), value_counts(y, value, *groups), groups), groups)


def _log_counts(df: DataFrame, value: str, groups: list[str]) -> DataFrame:
    return value_counts(df.select(*groups, F.log(F.col(value).cast("double")).alias("l")).where("l IS NOT NULL"), "l", *groups)


def _best_shifts(cx: DataFrame, cy: DataFrame, group: str, steps: int, rounds: int) -> DataFrame:
    """(group, shift, ks): for each group the shift of y's logarithms with the smallest KS distance; cx, cy: (group, v, k)."""
    middle = lambda c, out: c.groupBy(group).agg(F.percentile("v", F.lit(0.5), F.col("k")).alias(out))
    at = middle(cx, "a").join(middle(cy, "b"), group).select(group, (F.col("a") - F.col("b")).alias("mid"))
    half = 5.0
    for _ in range(rounds):
        tries = cut(at.select(group, "mid", F.explode(F.array(*[F.lit(half * (2 * i / steps - 1)) for i in range(steps + 1)])).alias("by")).withColumn("shift", F.col("mid") + F.col("by")))
        moved = lambda c: c.join(tries.select(group, "shift"), group)
        counts = _counts_of_both(moved(cx).select(group, "shift", "v", "k"), moved(cy).select(group, "shift", (F.col("v") + F.col("shift")).alias("v"), "k"), [group, "shift"])
        found = _largest_gap(cut(counts), [group, "shift"])
        best = cut(found.groupBy(group).agg(F.min(F.struct("ks", "shift")).alias("b")).select(group, F.col("b.shift").alias("mid"), "b.ks"))
        at, half = best.select(group, "mid"), half * 2 / steps
    return best.select(group, F.col("mid").alias("shift"), "ks")


def ks_scaled(x: DataFrame, y: DataFrame, value: str, steps: int = 40, rounds: int = 3) -> DataFrame:
    """One row (scale, ks): the factor on y that minimizes the KS distance, by a grid of log shifts, refined ``rounds`` times.

    The grid covers e**-5 to e**5 about the ratio of medians; ties go to the smallest shift. A sample without values: no row.
    """
    one = [c.withColumn("_all", F.lit(0)) for c in (_log_counts(x, value, []), _log_counts(y, value, []))]
    return _best_shifts(cut(one[0]), cut(one[1]), "_all", steps, rounds).select(F.exp("shift").alias("scale"), "ks")


def ks_permutation(x: DataFrame, y: DataFrame, key: str, value: str, n: int, seed: int, steps: int = 40, rounds: int = 3) -> DataFrame:
    """(rep, scale, ks): each replicate deals the rows of both samples anew to samples of their sizes and fits the factor again; rep -1 is as observed.

    ``null_summary`` of ks gives p: how often arbitrary samples of one distribution differ as much. A replicate's first sample are the
    rows with the smallest draws; ties by sample and key.
    """
    ok = lambda d, j: d.select(F.lit(j).alias("_side"), F.col(key).cast("string").alias("_key"), F.log(F.col(value).cast("double")).alias("v")).where("v IS NOT NULL")
    pool = cut(ok(x, 0).unionByName(ok(y, 1)))
    nx = pool.where("_side = 0").count()
    many = replicates(pool, n).withColumn("_draw", draw(seed, "rep", "_side", "_key"))
    taken = smallest_draws(many, "rep", n, "_draw", ["_side", "_key"], nx).groupBy("rep", "v").agg(F.count(F.lit(1)).alias("k0"))
    whole = cut(pool.groupBy("v").agg(F.count(F.lit(1)).alias("k"), F.count_if(F.col("_side") == 0).alias("k0")))
    dealt = whole.select("v", "k", F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("rep")).join(taken, ["rep", "v"], "left").select("rep", "v", "k", F.coalesce("k0", F.lit(0)).alias("k0"))
    every = cut(whole.select(F.lit(-1).alias("rep"), "v", "k", "k0").unionByName(dealt))  # the second sample has what the first leaves
    side = lambda j: every.select("rep", "v", (F.col("k0") if j == 0 else F.col("k") - F.col("k0")).alias("k")).where("k > 0")
    return _best_shifts(side(0), side(1), "rep", steps, rounds).select("rep", F.exp("shift").alias("scale"), "ks")


def survival(df: DataFrame, value: str) -> DataFrame:
    """(v, n, survival): the share of values at or above each distinct value."""
    c = value_counts(df, value)
    total = c.agg(F.sum("k").alias("_all"))
    upto = running_sums(c, "v", {"_from": F.col("k")}, descending=True).crossJoin(F.broadcast(total))  # one row
    return upto.select("v", F.col("k").alias("n"), (F.col("_from") / F.col("_all")).alias("survival"))


def labelled_bins(df: DataFrame, value: str, edges: list[float]) -> DataFrame:
    """(nth, label, n, percent) of half-open bins between the edges, the last one open; empty bins are there."""
    tops = [*edges[1:], float("inf")]
    names = [f"{a:g}-{b:g}" if b != float("inf") else f">={a:g}" for a, b in zip(edges, tops, strict=True)]
    spark = df.sparkSession
    bins = spark.createDataFrame([(i, n) for i, n in enumerate(names)], "nth int, label string")
    v = F.col(value)
    at = F.size(F.filter(F.array(*map(F.lit, edges)), lambda e: e <= v)) - 1
    c = df.where(v.isNotNull() & (v >= edges[0])).groupBy(at.alias("nth")).agg(F.count(F.lit(1)).alias("n"))
    all_n = F.sum("n").over(Window.partitionBy())
    out = bins.join(c, "nth", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    return out.select("nth", "label", "n", (100 * F.col("n") / F.greatest(all_n, F.lit(1))).alias("percent"))


def density_bins(df: DataFrame, value: str, bins: int = 32) -> DataFrame:
    """(bin, n, density) of equal-width bins from the smallest to the largest value, which falls in the last."""
    v = F.col(value).cast("double")
    ends = df.agg(F.min(v).alias("lo"), F.max(v).alias("hi"), F.count(v).alias("all"))
    at = F.least(F.lit(bins - 1), F.floor((v - F.col("lo")) / ((F.col("hi") - F.col("lo")) / bins)))
    rows = df.where(v.isNotNull()).crossJoin(F.broadcast(ends))  # one row
    c = rows.groupBy(F.coalesce(at, F.lit(0)).cast("int").alias("bin"), "lo", "hi", "all").agg(F.count(F.lit(1)).alias("n"))
    return c.select("bin", "n", (F.col("n") / (F.col("all") * (F.col("hi") - F.col("lo")) / bins)).alias("density"))


def spearman(df: DataFrame, x: str, y: str, key: str) -> DataFrame:
    """One row (rho, n): the correlation of average ranks of the rows with both values. Several rows may have one ``key``: ranks stay with their rows."""
    rows = df.where(F.col(x).isNotNull() & F.col(y).isNotNull() & ~F.isnan(F.col(x).cast("double")) & ~F.isnan(F.col(y).cast("double"))).select(key, x, y)
    rank = F.col("less") + 1 + (F.col("ties") - 1) / 2
    rx = ranks_within(rows, [], x).select(y, rank.alias("rx"))
    return ranks_within(rx, [], y).select("rx", rank.alias("ry")).agg(F.corr("rx", "ry").alias("rho"), F.count(F.lit(1)).alias("n"))


def rotation_null(points: DataFrame, key: str, targets: DataFrame, target_key: str, n: int, seed: int, within_km: float = 100.0) -> DataFrame:
    """(rep, count_within, median_km): each replicate moves all points by one longitude and looks for their nearest targets; rep -1 is unmoved."""
    rows = spread(points.select(key, "lon", "lat")).withColumn("rep", F.explode(F.sequence(F.lit(-1), F.lit(n - 1))))
    turn = F.when(F.col("rep") < 0, F.lit(0.0)).otherwise(360 * draw(seed, "rep") - 180)
    moved = rows.withColumn("lon", wrap_lon(F.col("lon") + turn)).withColumn("point_rep", F.concat_ws("#", "rep", key))
    near = nearest_neighbour(moved.select("point_rep", "lon", "lat"), "point_rep", targets, target_key).select("point_rep", "distance_km")
    got = cut(near.select(F.split_part("point_rep", F.lit("#"), F.lit(1)).cast("int").alias("rep"), "distance_km"))
    return _counts_and_medians(got, "distance_km", within_km)


def _counts_and_medians(rows: DataFrame, distance: str, within_km: float) -> DataFrame:
    counts = rows.groupBy("rep").agg(F.count_if(F.col(distance) <= within_km).alias("count_within"))
    return counts.join(group_medians(rows, ["rep"], distance, "median_km"), "rep", "left")


def label_null(points: DataFrame, key: str, label: str, distance: str, n: int, seed: int, within_km: float = 100.0) -> DataFrame:
    """(rep, count_within, median_km): each replicate labels as many points as are labelled, at random; rep -1 has the true labels.

    The labelled ones of a replicate are those with the smallest draws; ties by key.
    """
    points = cut(points.select(key, label, distance))
    k = points.where(F.col(label)).count()
    many = replicates(points.select(key, distance), n).withColumn("_draw", draw(seed, "rep", key))
    drawn = smallest_draws(many, "rep", n, "_draw", [key], k).select("rep", distance)
    true = points.where(F.col(label)).select(F.lit(-1).alias("rep"), distance)
    return _counts_and_medians(cut(true.unionByName(drawn)), distance, within_km)


def null_summary(reps: DataFrame, value: str, larger_is_extreme: bool = True) -> DataFrame:
    """(observed, null_mean, null_low, null_median, null_high, p) of a replicate table; rep -1 is the observation."""
    seen = reps.where("rep < 0").select(F.col(value).cast("double").alias("observed"))
    rows = reps.where("rep >= 0").select(F.col(value).cast("double").alias("x")).crossJoin(F.broadcast(seen))  # one row
    hit = F.col("x") >= F.col("observed") if larger_is_extreme else F.col("x") <= F.col("observed")
    q = F.percentile("x", F.array(F.lit(0.025), F.lit(0.5), F.lit(0.975)))
    out = rows.groupBy("observed").agg(F.avg("x").alias("null_mean"), q.alias("q"), ((1 + F.count_if(hit)) / (F.count(F.lit(1)) + 1)).alias("p"))
    return out.select("observed", "null_mean", F.col("q")[0].alias("null_low"), F.col("q")[1].alias("null_median"), F.col("q")[2].alias("null_high"), "p")


def candidate_p(observed: DataFrame, nulls: DataFrame, key: str, value: str) -> DataFrame:
    """(key, p, n_null): each candidate's p among its own null draws; missing values are left out, none left: null.

    Draws are never broadcast: Spark takes exploded rows to be as large as what they come from.
    """
    o = observed.select(key, F.col(value).cast("double").alias("_o"))
    d = nulls.select(key, F.col(value).cast("double").alias("_d")).where("_d IS NOT NULL AND NOT isnan(_d)")
    c = o.join(d.hint("merge"), key, "left").groupBy(key, "_o").agg(F.count("_d").alias("n_null"), F.count_if(F.col("_d") >= F.col("_o")).alias("_h"))
    return c.select(key, F.when(F.col("_o").isNotNull() & (F.col("n_null") > 0), (1 + F.col("_h")) / (F.col("n_null") + 1)).alias("p"), "n_null")


def global_null(observed: DataFrame, nulls: DataFrame, key: str, value: str, n: int, seed: int, statistic: str = "median", complete: int | None = None) -> DataFrame:
    """(rep, median) or (rep, mean): each replicate takes one null draw of every candidate; rep -1 is observed. nulls: key, null_index 0.., value.

    Candidates without an observation or without any null value are left out; with ``complete``, so are those with fewer null values than that.
    """
    o = observed.where(F.col(value).isNotNull()).select(key, F.col(value).alias("_o"))
    sizes = nulls.groupBy(key).agg((F.max("null_index") + 1).alias("_n"), F.count(value).alias("_some")).where(F.col("_some") >= (complete or 1))
    rows = o.join(sizes.hint("merge"), key)
    picks = replicates(rows, n).withColumn("null_index", F.floor(draw(seed, "rep", key) * F.col("_n")).cast(nulls.schema["null_index"].dataType))
    got = picks.join(nulls.select(key, "null_index", value).hint("merge"), [key, "null_index"]).select("rep", F.col(value).alias("x"))
    every = rows.select(F.lit(-1).alias("rep"), F.col("_o").alias("x")).unionByName(got)
    return group_medians(cut(every), ["rep"], "x", "median") if statistic == "median" else every.groupBy("rep").agg(F.avg("x").alias("mean"))


#: Rows that a task shuffles at a time, about.
SHUFFLED = 200_000


def _shuffled_products(key: tuple, drawn: pa.Table, others: pa.Table, mean_x: float, mean_y: float) -> pa.Table:
    """(rep, xy): for each replicate the sum of products of rows in the order of their draws with the rows whose places they take, over a range of draws in a stratum."""
    if not drawn.num_rows:
        return pa.table({"rep": pa.array([], pa.int32()), "xy": pa.array([], pa.float64())})
    rep, value, i, ry = (drawn[c].to_numpy() for c in ("rep", "_draw", "i", "ry"))
    order = np.lexsort((i, value, rep))
    rep, ry = rep[order], ry[order]
    places, below = others.filter(pc.is_valid(others["rx"])), others.filter(pc.is_valid(others["below"]))
    at, rx = places["place"].to_numpy(), places["rx"].to_numpy()
    by = np.argsort(at)
    at, rx = at[by], rx[by]
    reps, starts, counts = np.unique(rep, return_index=True, return_counts=True)
    before = dict(zip(below["rep"].to_pylist(), below["below"].to_pylist(), strict=True))
    place = np.arange(len(rep)) + 1 + np.repeat(np.array([before[r] for r in reps.tolist()], np.int64) - starts, counts)
    found = np.searchsorted(at, place)
    assert (at[found] == place).all()
    products = (rx[found] - mean_x) * (ry - mean_y)
    return pa.table({"rep": pa.array(reps.astype(np.int32)), "xy": pa.array(np.add.reduceat(products, starts))})


def stratified_null(df: DataFrame, key: str, strata: list[str], x: str, y: str, n: int, seed: int) -> DataFrame:
    """(rep, rho): Spearman correlation with y shuffled within strata; rep -1 is unshuffled.

    A shuffle gives the i-th row of a stratum, by key, the value of the row with the i-th smallest draw. Ranks don't change, so of a replicate only the sum of their products is new. Rows meet once:
    each goes to its range of draws in its stratum, with all replicates, as do the rows whose places these draws can take, which the draws' even spread tells but for a few ranges.
    Rows whose stratum is null in some column are a stratum of their own.
    """
    average = F.col("less") + 1 + (F.col("ties") - 1) / 2
    rows = df.where(F.col(x).isNotNull() & F.col(y).isNotNull()).select(key, F.to_json(F.struct(*strata), {"ignoreNullFields": "false"}).alias("_stratum"), x, y)
    ranked = ranks_within(rows, [], x).withColumn("rx", average).drop("less", "ties", "n")
    ranked = ranks_within(ranked, [], y).withColumn("ry", average)
    base = cut(number_sorted(ranked.select(key, "_stratum", "rx", "ry"), ["_stratum"], [key], "i"))
    true = base.agg(F.try_divide(F.covar_pop("rx", "ry"), F.sqrt(F.var_pop("rx") * F.var_pop("ry"))).alias("rho")).select(F.lit(-1).alias("rep"), "rho")
    all_rows = base.agg(F.avg("rx").alias("x"), F.avg("ry").alias("y"), (F.count("rx") * F.sqrt(F.var_pop("rx") * F.var_pop("ry"))).alias("spread")).first()
    if all_rows["x"] is None:
        return true
    if not all_rows["spread"]:  # no correlation, whatever the order
        return true.unionByName(df.sparkSession.range(n).select(F.col("id").cast("int").alias("rep"), F.lit(None).cast("double").alias("rho")))
    sizes = cut(base.groupBy("_stratum").agg(F.count(F.lit(1)).alias("_size")).withColumn("_s", F.monotonically_increasing_id()))
    sizes = sizes.withColumn("_ranges", F.greatest(F.lit(1), F.floor(F.col("_size") * n / SHUFFLED)))
    base = cut(base.join(sizes, "_stratum").select("_s", "_size", "_ranges", key, "i", "rx", "ry"))
    drawn = replicates(base.select("_s", "_ranges", key, "i", "ry"), n).withColumn("_draw", draw(seed, "rep", key))
    drawn = drawn.select("_s", F.floor(F.col("_draw") * F.col("_ranges")).alias("_range"), "rep", "_draw", "i", "ry")
    counts = drawn.groupBy("_s", "_range", "rep").agg(F.count(F.lit(1)).alias("k"))
    counts = cut(counts.withColumn("below", F.sum("k").over(Window.partitionBy("_s", "rep").orderBy("_range")) - F.col("k")))
    home = lambda i: F.floor((i - 1) / F.col("_size") * F.col("_ranges"))
    off = F.greatest(F.abs(home(F.col("below") + 1) - F.col("_range")), F.abs(home(F.col("below") + F.col("k")) - F.col("_range")))
    slack = counts.join(sizes, "_s").agg(F.max(off)).first()[0]
    near = F.sequence(F.greatest(F.lit(0).cast("long"), home(F.col("i")) - slack), F.least(F.col("_ranges") - 1, home(F.col("i")) + slack))
    others = base.select(F.col("_s").alias("_t"), F.explode(near).alias("_part"), F.col("i").alias("place"), "rx")
    others = others.unionByName(counts.select(F.col("_s").alias("_t"), F.col("_range").alias("_part"), "rep", "below"), allowMissingColumns=True)
    mean_x, mean_y = all_rows["x"], all_rows["y"]
    products = lambda at, left, right: _shuffled_products(at, left, right, mean_x, mean_y)
    sums = drawn.groupBy("_s", "_range").cogroup(others.groupBy("_t", "_part")).applyInArrow(products, "rep int, xy double")
    return true.unionByName(sums.groupBy("rep").agg((F.sum("xy") / all_rows["spread"]).alias("rho")))


def matched_null(cases: DataFrame, controls: DataFrame, key: str, levels: list[list[str]], values: dict[str, str], n: int, seed: int, least: int = 3) -> DataFrame:
    """Replicates of one matched control for each case: (rep, each of ``values``), rep -1 the cases themselves.

    levels: matching columns from narrow to wide; a case takes the first level at which it has ``least`` controls, else
    the last. values: name -> 'mean of column' as ``avg:column`` or ``median:column``. Controls of a level are numbered within ranges, however wide it is.
    """
    stratum = lambda on: F.to_json(F.struct(*on), {"ignoreNullFields": "false"})  # noqa: E731  # a null matches a null
    pools, sizes = [], cases.select(key, *[stratum(on).alias(f"_s{i}") for i, on in enumerate(levels)])
    for i, on in enumerate(levels):
        keyed = controls.withColumn(f"_s{i}", stratum(on))
        pools.append(number_sorted(keyed, [f"_s{i}"], [key], "_i").withColumn("_i", (F.col("_i") - 1).cast("int")))
        sizes = sizes.join(keyed.groupBy(f"_s{i}").agg(F.count(F.lit(1)).alias(f"_c{i}")), f"_s{i}", "left")
    rule = F.lit(len(levels) - 1)
    for i in reversed(range(len(levels) - 1)):
        rule = F.when(F.coalesce(F.col(f"_c{i}"), F.lit(0)) >= least, i).otherwise(rule)
    sizes = sizes.withColumn("_level", rule).withColumn("_size", F.coalesce(F.get(F.array(*[F.col(f"_c{i}") for i in range(len(levels))]), F.col("_level")), F.lit(0)))
    picks = replicates(sizes.where("_size > 0"), n).withColumn("_i", F.floor(draw(seed, "rep", key) * F.col("_size")).cast("int"))
    columns = sorted({v.split(":")[1] for v in values.values()})
    drawn = None
    for i in range(len(levels)):
        part = picks.where(F.col("_level") == i).join(pools[i].select(f"_s{i}", "_i", *columns), [f"_s{i}", "_i"]).select("rep", *columns)
        drawn = part if drawn is None else drawn.unionByName(part)
    every = cases.select(F.lit(-1).alias("rep"), *columns).unionByName(drawn)
    how = {"avg": F.avg, "median": F.median}
    return every.groupBy("rep").agg(*[how[v.split(":")[0]](F.col(v.split(":")[1]).cast("double")).alias(name) for name, v in values.items()])
