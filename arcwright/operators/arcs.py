"""Traced arcs: vertices, spherical fits, segments."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import geo as G


def spherical_fit(vertices: DataFrame) -> DataFrame:
    """(candidate_id, lon, lat, radius_km, diameter_km, relative_radial_mad, angular_coverage, vertices) of each arc.

    The center is the mean unit vector; the radius the median distance from it; the spread the median deviation from the
    radius, by the radius; coverage the share of 72 bearing sectors that have a vertex. Needs candidate_id, lon, lat.
    """
    x, y, z = G.unit_vector("lon", "lat")
    v = vertices.select("candidate_id", "lon", "lat", x.alias("x"), y.alias("y"), z.alias("z"))
    c = v.groupBy("candidate_id").agg(F.avg("x").alias("mx"), F.avg("y").alias("my"), F.avg("z").alias("mz"), F.count(F.lit(1)).alias("vertices"))
    n = F.sqrt(F.col("mx") * F.col("mx") + F.col("my") * F.col("my") + F.col("mz") * F.col("mz"))
    c = c.select("candidate_id", "vertices", *[(F.col(m) / n).alias(m) for m in ("mx", "my", "mz")])
    dot = F.col("x") * F.col("mx") + F.col("y") * F.col("my") + F.col("z") * F.col("mz")
    d = v.join(c, "candidate_id").withColumn("km", F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), dot))) * G.EARTH_RADIUS_KM)
    clon, clat = F.degrees(F.atan2("my", "mx")), F.degrees(F.asin(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), F.col("mz")))))
    d = d.withColumn("clon", clon).withColumn("clat", clat)
    east, north = G.local_xy_km("lon", "lat", "clon", "clat")
    d = d.withColumn("sector", F.floor(G.bearing(east, north) / (2 * math.pi) * 72))
    arcs = Window.partitionBy("candidate_id")  # an arc's vertices
    d = d.withColumn("radius", F.median("km").over(arcs))
    out = d.groupBy("candidate_id", "clon", "clat", "radius", "vertices").agg(
        F.median(F.abs(F.col("km") - F.col("radius"))).alias("mad"), F.least(F.lit(1.0), F.countDistinct("sector") / 72).alias("angular_coverage")
    )
    return out.select(
        "candidate_id", F.col("clon").alias("lon"), F.col("clat").alias("lat"), F.col("radius").alias("radius_km"), (2 * F.col("radius")).alias("diameter_km"),
        (F.col("mad") / F.greatest("radius", F.lit(1e-9))).alias("relative_radial_mad"), "angular_coverage", "vertices",
    )


def dateline_segments(vertices: DataFrame) -> DataFrame:
    """Add segment: it grows by one where an arc jumps over the date line (more than half a turn between vertices)."""
    order = Window.partitionBy("candidate_id").orderBy("line_no", "vertex_no", "lon")
    jump = F.coalesce(F.abs(F.col("lon") - F.lag("lon").over(order)) > 180, F.lit(False))
    return vertices.withColumn("_jump", jump.cast("long")).withColumn("segment", F.sum("_jump").over(order.rowsBetween(Window.unboundedPreceding, 0))).drop("_jump")


def collapse_geometries(features: DataFrame) -> DataFrame:
    """One row a name: the geometry with role center, else the first; a middle diameter only where both bounds are there.

    Needs name, source_index, geometry_role, lon, lat, diameter_min_km, diameter_max_km, status.
    """
    first = F.struct((F.coalesce(F.col("geometry_role"), F.lit("")) != "center").alias("later"), "source_index", "lon", "lat", "diameter_min_km", "diameter_max_km", "status")
    best = features.groupBy("name").agg(F.min(first).alias("b"))
    return best.select("name", "b.lon", "b.lat", ((F.col("b.diameter_min_km") + F.col("b.diameter_max_km")) / 2).alias("diameter_km"), "b.status")
