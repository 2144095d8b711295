"""Positions on the sphere as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

EARTH_RADIUS_KM = 6371.0088


def _c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def great_circle_km(lon1: Column | str, lat1: Column | str, lon2: Column | str, lat2: Column | str) -> Column:
    """Haversine distance; the root's argument is held to 1, so antipodes don't turn into NaN."""
    p1, p2 = F.radians(_c(lat1)), F.radians(_c(lat2))
    return haversine_km(lon1, p1, F.cos(p1), lon2, p2, F.cos(p2))


def haversine_km(lon1: Column | str, p1: Column, cos1: Column, lon2: Column | str, p2: Column, cos2: Column) -> Column:
    """As ``great_circle_km``, of latitudes in radians whose cosines are known."""
    dp, dl = p2 - p1, F.radians(_c(lon2) - _c(lon1))
    a = F.pow(F.sin(dp / 2), F.lit(2.0)) + cos1 * cos2 * F.pow(F.sin(dl / 2), F.lit(2.0))
    return F.asin(F.least(F.lit(1.0), F.sqrt(a))) * (2 * EARTH_RADIUS_KM)


def unit_vector(lon: Column | str, lat: Column | str) -> tuple[Column, Column, Column]:
    lo, la = F.radians(_c(lon)), F.radians(_c(lat))
    return F.cos(la) * F.cos(lo), F.cos(la) * F.sin(lo), F.sin(la)


def from_unit_vector(x: Column, y: Column, z: Column) -> tuple[Column, Column]:
    """(lon, lat) in degrees of a vector of any length but zero."""
    n = F.sqrt(x * x + y * y + z * z)
    return F.degrees(F.atan2(y, x)), F.degrees(F.asin(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), z / n))))


def wrap_lon(lon: Column | str) -> Column:
    """Longitude in [-180, 180)."""
    return F.pmod(_c(lon) + 180, F.lit(360.0)) - 180


def unwrap_lon(lon: Column | str, center: Column | str) -> Column:
    """Longitude moved by whole turns to lie near ``center``."""
    return _c(lon) + F.round((_c(center) - _c(lon)) / 360) * 360


def local_xy_km(lon: Column | str, lat: Column | str, lon0: Column | str, lat0: Column | str) -> tuple[Column, Column]:
    """Equirectangular kilometres east and north of a center."""
    x = F.radians(wrap_lon(_c(lon) - _c(lon0))) * F.cos(F.radians(_c(lat0))) * EARTH_RADIUS_KM
    return x, F.radians(_c(lat) - _c(lat0)) * EARTH_RADIUS_KM


def bearing(x: Column, y: Column) -> Column:
    """Clockwise from north in [0, 2 pi)."""
    import math

    return F.pmod(F.atan2(x, y), F.lit(2 * math.pi))


def azimuthal_xy_km(lon: Column | str, lat: Column | str, lon0: Column | str, lat0: Column | str) -> tuple[Column, Column]:
    """Azimuthal equidistant projection: distances and directions from the center are true."""
    p0, p = F.radians(_c(lat0)), F.radians(_c(lat))
    dl = F.radians(_c(lon) - _c(lon0))
    cosc = F.greatest(F.lit(-1.0), F.least(F.lit(1.0), F.sin(p0) * F.sin(p) + F.cos(p0) * F.cos(p) * F.cos(dl)))
    c = F.acos(cosc)
    k = F.when(F.sin(c) < 1e-12, F.lit(1.0)).otherwise(c / F.sin(c)) * EARTH_RADIUS_KM
    return k * F.cos(p) * F.sin(dl), k * (F.cos(p0) * F.sin(p) - F.sin(p0) * F.cos(p) * F.cos(dl))


def origin_to_segment_km(x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
    """Distance of the origin to a segment."""
    dx, dy = x2 - x1, y2 - y1
    long = dx * dx + dy * dy
    t = F.when(long == 0, F.lit(0.0)).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), -(x1 * dx + y1 * dy) / long)))
    px, py = x1 + t * dx, y1 + t * dy
    return F.sqrt(px * px + py * py)


def length_in_disk_km(x1: Column, y1: Column, x2: Column, y2: Column, radius: Column) -> Column:
    """Length of a segment's part within ``radius`` of the origin, from the roots of the circle's equation."""
    dx, dy = x2 - x1, y2 - y1
    a = dx * dx + dy * dy
    b = x1 * dx + y1 * dy
    c = x1 * x1 + y1 * y1 - radius * radius
    d = b * b - a * c
    root = F.sqrt(F.greatest(d, F.lit(0.0)))
    t1 = F.greatest(F.lit(0.0), F.least(F.lit(1.0), (-b - root) / a))
    t2 = F.greatest(F.lit(0.0), F.least(F.lit(1.0), (-b + root) / a))
    return F.when((a == 0) | (d <= 0), F.lit(0.0)).otherwise((t2 - t1) * F.sqrt(a))


def circle_vertices(lon: Column | str, lat: Column | str, diameter_km: Column | str, steps: int = 96, digits: int = 7) -> Column:
    """A closed ring of (lon, lat) at half the diameter from the center, as an array of structs."""
    import math

    angular = _c(diameter_km) / 2 / EARTH_RADIUS_KM
    p1, l1 = F.radians(_c(lat)), F.radians(_c(lon))

    def at(i: Column) -> Column:
        turn = i * (2 * math.pi) / steps
        p2 = F.asin(F.sin(p1) * F.cos(angular) + F.cos(p1) * F.sin(angular) * F.cos(turn))
        l2 = l1 + F.atan2(F.sin(turn) * F.sin(angular) * F.cos(p1), F.cos(angular) - F.sin(p1) * F.sin(p2))
        return F.struct(F.round(wrap_lon(F.degrees(l2)), digits).alias("lon"), F.round(F.degrees(p2), digits).alias("lat"))

    return F.transform(F.sequence(F.lit(0), F.lit(steps)), at)


def fill_size(radius: Column | str, diameter: Column | str) -> tuple[Column, Column]:
    """Radius and diameter, each from the other where it is missing."""
    r, d = _c(radius), _c(diameter)
    return F.coalesce(r, d / 2), F.coalesce(d, r * 2)


def segments_cross(ax: Column, ay: Column, bx: Column, by: Column, cx: Column, cy: Column, dx: Column, dy: Column) -> Column:
    """Whether segments ab and cd cross, by orientation (touching ends count)."""

    def turn(px: Column, py: Column, qx: Column, qy: Column, rx: Column, ry: Column) -> Column:
        return F.signum((qx - px) * (ry - py) - (qy - py) * (rx - px))

    return (turn(ax, ay, bx, by, cx, cy) * turn(ax, ay, bx, by, dx, dy) <= 0) & (
        turn(cx, cy, dx, dy, ax, ay) * turn(cx, cy, dx, dy, bx, by) <= 0
    )


def register(spark: SparkSession) -> None:
    """Make the library's scalar and table functions known to SQL: arc_km, arc_geodesic_km, arc_wrap_lon, arc_name_key, arc_harmonic, arc_circle, arc_tiles."""
    from . import geodesic, text

    half = "radians({b} - {a}) / 2"
    dp, dl = half.format(a="lat1", b="lat2"), half.format(a="lon1", b="lon2")
    root = f"pow(sin({dp}), 2) + cos(radians(lat1)) * cos(radians(lat2)) * pow(sin({dl}), 2)"
    create = lambda signature, body: spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {signature} RETURN {body}")
    create("arc_km(lon1 DOUBLE, lat1 DOUBLE, lon2 DOUBLE, lat2 DOUBLE) RETURNS DOUBLE", f"{2 * EARTH_RADIUS_KM} * asin(least(1D, sqrt({root})))")
    create("arc_wrap_lon(lon DOUBLE) RETURNS DOUBLE", "pmod(lon + 180, 360D) - 180")
    create("arc_harmonic(xs ARRAY<DOUBLE>) RETURNS DOUBLE", """CASE WHEN exists(xs, x -> x <= 0) THEN 0D
        WHEN size(filter(xs, x -> x > 0 AND NOT isnan(x))) > 0 THEN size(filter(xs, x -> x > 0 AND NOT isnan(x))) / aggregate(filter(xs, x -> x > 0 AND NOT isnan(x)), 0D, (s, x) -> s + 1 / least(1D, x)) END""")
    spark.udf.register("arc_geodesic_km", geodesic.geodesic_km)
    spark.udf.register("arc_name_fold", text._fold)
    create("arc_name_key(name STRING) RETURNS STRING", "regexp_replace(lower(arc_name_fold(name)), '[^a-z0-9]+', '')")
    create(
        "arc_circle(lon DOUBLE, lat DOUBLE, diameter_km DOUBLE, steps INT) RETURNS TABLE (i INT, v_lon DOUBLE, v_lat DOUBLE)",
        f"""SELECT i, pmod(degrees(radians(lon) + atan2(sin(b) * sin(a) * cos(radians(lat)), cos(a) - sin(radians(lat)) * sin(p))) + 180, 360D) - 180, degrees(p)
        FROM (SELECT i, a, b, asin(sin(radians(lat)) * cos(a) + cos(radians(lat)) * sin(a) * cos(b)) AS p
              FROM (SELECT i, diameter_km / 2 / {EARTH_RADIUS_KM} AS a, i * 2 * pi() / steps AS b FROM (SELECT explode(sequence(0, steps)) AS i)))""",
    )
    create(
        "arc_tiles(west DOUBLE, south DOUBLE, east DOUBLE, north DOUBLE, tile INT) RETURNS TABLE (ty BIGINT, tx BIGINT)",
        "SELECT ty, pmod(t, 360 div tile) FROM (SELECT explode(sequence(floor((south + 90) / tile), floor((north + 90) / tile))) AS ty) CROSS JOIN (SELECT explode(sequence(floor((west + 180) / tile), floor((east + 180) / tile))) AS t)",
    )
