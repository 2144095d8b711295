"""Fault traces near candidates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import geo as G
from ..functions.scoring import known

#: Degrees of the widening search.
LADDER = (2, 5, 10, 20, 40, 60)


def _met(places: DataFrame, segments: DataFrame, step: int, size: float) -> DataFrame:
    """Pairs of places and segments whose box comes within ``step`` degrees: their columns, ``at`` (the nearest point's distance) and ``inside`` (the length within the radius), in km."""
    tile_of = lambda x: F.floor(x / size)
    cells = lambda low, high: F.explode(F.sequence(tile_of(low), tile_of(high)))
    trig = lambda i: {f"sin{i}": F.sin(F.radians(f"lat{i}")), f"cos{i}": F.cos(F.radians(f"lat{i}"))}
    a = places.withColumns({"sin0": F.sin(F.radians("lat")), "cos0": F.cos(F.radians("lat"))}).withColumn("ty", cells(F.col("lat") - step, F.col("lat") + step)).withColumn("tx", cells(F.col("lon") - step, F.col("lon") + step))
    b = segments.withColumns({"w": F.least("lon1", "lon2"), "e": F.greatest("lon1", "lon2"), "s": F.least("lat1", "lat2"), "n": F.greatest("lat1", "lat2"), **trig(1), **trig(2)})
    b = b.withColumn("ty", cells(F.col("s"), F.col("n"))).withColumn("tx", cells(F.col("w"), F.col("e")))
    # a pair that meets on several tiles counts on the first tile that both have
    first_y, first_x = tile_of(F.greatest(F.col("lat") - step, F.col("s"))), tile_of(F.greatest(F.col("lon") - step, F.col("w")))
    near = a.join(b.hint("merge"), ["ty", "tx"]).where((F.col("ty") == first_y) & (F.col("tx") == first_x)).where(
        (F.col("w") <= F.col("lon") + step) & (F.col("e") >= F.col("lon") - step) & (F.col("s") <= F.col("lat") + step) & (F.col("n") >= F.col("lat") - step)
    )
    # ``geo.azimuthal_xy_km`` in steps, so that each is taken once and the code of a pair stays small enough to be compiled
    for i in ("1", "2"):
        near = near.withColumn(f"d{i}", F.radians(F.col(f"lon{i}") - F.col("lon"))).withColumns({f"u{i}": F.cos(f"d{i}"), f"v{i}": F.sin(f"d{i}")})
        cosc = F.col("sin0") * F.col(f"sin{i}") + F.col("cos0") * F.col(f"cos{i}") * F.col(f"u{i}")
        near = near.withColumn(f"c{i}", F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), cosc)))).withColumn(f"q{i}", F.sin(f"c{i}"))
        near = near.withColumn(f"k{i}", F.when(F.col(f"q{i}") < 1e-12, F.lit(1.0)).otherwise(F.col(f"c{i}") / F.col(f"q{i}")) * G.EARTH_RADIUS_KM)
        y = F.col("cos0") * F.col(f"sin{i}") - F.col("sin0") * F.col(f"cos{i}") * F.col(f"u{i}")
        near = near.withColumns({f"x{i}": F.col(f"k{i}") * F.col(f"cos{i}") * F.col(f"v{i}"), f"y{i}": F.col(f"k{i}") * y})
    plane = [F.col(c) for c in ("x1", "y1", "x2", "y2")]
    return near.withColumns({"at": G.origin_to_segment_km(*plane), "inside": G.length_in_disk_km(*plane, F.col("radius_km"))})


def fault_metrics(points: DataFrame, segments: DataFrame, key: str = "candidate_id", tile: int = 2) -> DataFrame:
    """Nearest fault and fault length within the radius of each point, by a search that widens until some segment's box is met.

    points: key, lon, lat, radius_km; segments: fault_id, segment_no, name, slip_type, lon1, lat1, lon2, lat2 (no wrap at the date line,
    as in the search), any number of them a fault. Nearest among ties: the smallest fault_id, then segment_no. A point and a segment meet on tiles of the step's own size (``tile`` degrees for the first), so each step is an
    equi-join; points go on to the next step only while they have met nothing. No segment within the last step: coverage 0. Points of one key give one row: of those that
    meet segments in the fewest steps, the nearest fault and the sum of lengths.

    Points of one place and radius are searched for once, and so are segments with the same ends. Pairs only go into numbers, which tasks hold without sorting pairs: the least distance and the
    sum of lengths, then, in a second search, the first segment at that distance, by its number.
    """
    from .checkpoints import cut
    from .ranking import number_sorted

    place, ends = ["lon", "lat", "radius_km"], ["lon1", "lat1", "lon2", "lat2"]
    rows = points.select(key, *place)
    places = cut(rows.select(*place).distinct().withColumn("_place", F.monotonically_increasing_id()))
    s = segments.groupBy(*ends).agg(F.count(F.lit(1)).alias("copies"), F.min(F.struct("fault_id", "segment_no", "name", "slip_type")).alias("told"))
    s = cut(number_sorted(s.select(*ends, "copies", "told.*"), [], ["fault_id", "segment_no", *ends], "nth"))
    told = s.select("nth", "fault_id", "segment_no", "name", "slip_type")
    s = s.select(*ends, "copies", "nth")
    todo, found = places, None
    for step in LADDER:
        size = float(max(tile, step))
        got = _met(todo, s, step, size).groupBy("_place").agg(F.min("at").alias("km"), F.sum(F.col("inside") * F.col("copies")).alias("length"))
        now = cut(todo.join(got, "_place", "left"))
        hit = now.where("km IS NOT NULL")
        least = lambda limit: F.min(F.when(F.col("at") <= limit, F.col("nth")))
        which = _met(hit.select("_place", *place, "km"), s, step, size).groupBy("_place").agg(F.coalesce(least(F.col("km")), least(F.col("km") * (1 + 1e-12))).alias("nth"))
        named = hit.join(which, "_place").join(told, "nth")
        part = cut(named.select("_place", F.lit(step).alias("step"), F.struct("km", "fault_id", "segment_no", "name", "slip_type").alias("b"), "length"))
        found = part if found is None else found.unionByName(part)
        todo = now.where("km IS NULL").select("_place", *place)
        if todo.isEmpty():
            break
    own = places.withColumnsRenamed({c: f"_{c}" for c in place})
    each = rows.join(own, [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in place]).join(found, "_place", "left")
    best = each.groupBy(key, "step").agg(F.min("b").alias("b"), F.sum("length").alias("length")).groupBy(key).agg(F.min_by(F.struct("step", "b", "length"), "step").alias("g"))
    there = F.col("g").isNotNull()
    return best.select(
        key, there.cast("int").alias("active_fault_coverage"), F.col("g.b.km").alias("nearest_active_fault_km"), F.col("g.b.name").alias("nearest_active_fault_name"),
        F.col("g.b.slip_type").alias("nearest_active_fault_slip_type"), F.col("g.length").alias("fault_length_within_radius_km"),
        F.when(there, (F.col("g.length") > 0).cast("int")).otherwise(0).alias("fault_intersects_candidate"), F.coalesce("g.step", F.lit(LADDER[-1])).alias("fault_search_degrees"),
    )


def with_fault_flag(structures: DataFrame) -> DataFrame:
    """Add active_fault_proximity_ratio and fault_control_flag; a missing distance counts as no fault within the radius."""
    ratio = known("nearest_active_fault_km") / F.col("radius_km")
    flag = F.when(F.col("fault_intersects_candidate") == 1, "intersects_active_fault").when(ratio <= 1, "near_active_fault").otherwise("no_mapped_active_fault_within_radius")
    return structures.withColumn("active_fault_proximity_ratio", ratio).withColumn("fault_control_flag", flag)
