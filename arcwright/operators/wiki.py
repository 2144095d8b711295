"""Table rows of wiki page snapshots, and the repair of a catalogue by them."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as X
from ..functions.geo import circle_vertices, great_circle_km
from .checkpoints import cut
from .relational import without_duplicates


def table_rows(pages: DataFrame, key: str, text: str, least_cells: int = 4) -> DataFrame:
    """(key, row_no, cells) of all tables: ``{|`` opens one, ``|-`` starts a row, ``|}`` ends the table, other lines that start with one
    ``|`` are cells. Cells before a table's first row mark are no row's, and a row is one only when a mark or the table's end
    follows it. Rows with fewer cells than ``least_cells`` are left out."""
    lines = pages.select(F.col(key), F.posexplode(F.split(text, r"\r?\n")).alias("pos", "line"))
    order = Window.partitionBy(key).orderBy("pos")  # the lines of a page
    upto = order.rowsBetween(Window.unboundedPreceding, 0)
    opens, ends = F.col("line").startswith("{|"), F.col("line").startswith("|}")
    state = F.last(F.when(opens, 1).when(ends, 0), True).over(upto)
    marks = lines.withColumn("_in", F.coalesce(state, F.lit(0))).withColumn("_mark", (F.col("_in") == 1) & F.col("line").startswith("|-"))
    # whether a row is open: since the last mark no table has ended; a table that opens within another changes nothing
    row_open = F.coalesce(F.last(F.when(F.col("_mark"), True).when(ends, False), True).over(upto), F.lit(False))
    closed_later = F.max((F.col("_mark") | ((F.col("_in") == 0) & ends)).cast("int")).over(order.rowsBetween(1, Window.unboundedFollowing))
    marks = marks.withColumns({"_open": row_open, "_row": F.sum(F.col("_mark").cast("int")).over(upto), "_closed": F.coalesce(closed_later, F.lit(0)) == 1})
    cell = F.col("line").startswith("|") & ~F.col("line").startswith("||") & ~F.col("line").startswith("|-") & ~ends
    cells = marks.where((F.col("_in") == 1) & F.col("_open") & F.col("_closed") & cell).select(key, "_row", "pos", F.trim(F.expr("substring(line, 2)")).alias("cell"))
    rows = cells.groupBy(key, "_row").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "cell"))), lambda c: c["cell"]).alias("cells"))
    return rows.where(F.size("cells") >= least_cells).select(key, F.col("_row").alias("row_no"), "cells")


def catalogue_rows(rows: DataFrame) -> DataFrame:
    """Add name (first cell), diameter_km (fourth cell) and coordinates (all cells) to table rows; nameless rows go."""
    out = rows.withColumns(
        {"name": X.wiki_name(F.col("cells")[0]), "diameter_km": X.first_number(F.col("cells")[3]), "coordinates": X.coordinates(F.array_join("cells", "\n"))}
    )
    return out.where("name <> ''")


def match_source(records: DataFrame, source: DataFrame, near_km: float = 5.0, missing: str = "not_found_in_2026_snapshot") -> DataFrame:
    """(record_id, source_id, coordinate_audit_status, distance_km): by name key, the source row of the closest diameter; without one,
    the nearest within ``near_km``.

    records: record_id, name, lon, lat, diameter_raw_km; source: source_id, name, diameter_km, and coordinates (array of lat, lon; the nearest
    counts) or lon and lat (may be null). Ties go to the smaller source_id. Rows whose name has no letter or digit match none by name.
    """
    from .spatial import nearest_neighbour

    places = F.col("coordinates") if "coordinates" in source.columns else F.when(F.col("lon").isNotNull() & F.col("lat").isNotNull(), F.array(F.struct("lat", "lon"))).otherwise(F.array())
    s = source.select("source_id", X.name_key("name").alias("_key"), places.alias("_places"), F.col("diameter_km").alias("s_km"))
    r = records.withColumn("_key", X.name_key("name")).where("_key <> ''")
    # of the source rows with one name and one diameter only the smallest id can win, so records meet diameters, not rows
    smallest = s.groupBy("_key", "s_km").agg(F.min("source_id").alias("source_id")).withColumnsRenamed({"_key": "_k", "s_km": "_d", "source_id": "_i"})
    same = (F.col("_key") == F.col("_k")) & F.col("s_km").eqNullSafe(F.col("_d")) & F.col("source_id").eqNullSafe(F.col("_i"))
    few = cut(s.join(smallest, same).groupBy("_key", "s_km", "source_id").agg(F.collect_list("_places").alias("_each")))
    gap = F.abs(F.coalesce("s_km", F.lit(float("inf"))) - F.coalesce("diameter_raw_km", F.lit(0.0)))
    away = F.transform("_each", lambda e: F.array_min(F.transform(e, lambda p: great_circle_km("lon", "lat", p["lon"], p["lat"]))))
    named = r.join(few, "_key").withColumn("gap", gap).withColumn("km", F.when(F.exists(away, lambda d: d.isNull()), None).otherwise(F.array_min(away)))
    best = cut(named.groupBy("record_id").agg(F.min(F.struct("gap", "source_id", "km")).alias("b")))
    by_name = best.select("record_id", F.col("b.source_id").alias("source_id"), F.col("b.km").alias("distance_km"))
    status = F.when(F.col("distance_km") <= near_km, "verified_within_5_km").when(F.col("distance_km").isNull(), "source_has_no_coordinate").otherwise("coordinate_review_required")
    by_name = by_name.withColumn("coordinate_audit_status", status)
    rest = cut(records.join(by_name.select("record_id"), "record_id", "left_anti"))
    each = s.select("source_id", F.explode("_places").alias("p")).select("source_id", "p.lat", "p.lon")
    near = nearest_neighbour(rest, "record_id", each, "source_id").withColumn("_ok", F.coalesce(F.col("distance_km") <= near_km, F.lit(False)))
    by_place = near.select(
        "record_id", F.when(F.col("_ok"), F.col("source_id")).alias("source_id"), F.when(F.col("_ok"), F.col("distance_km")).alias("distance_km"),
        F.when(F.col("_ok"), "verified_by_coordinate_alias_within_5_km").otherwise(missing).alias("coordinate_audit_status"),
    )
    return by_name.select("record_id", "source_id", "coordinate_audit_status", "distance_km").unionByName(by_place.select("record_id", "source_id", "coordinate_audit_status", "distance_km"))


def repair_diameters(records: DataFrame) -> DataFrame:
    """Add diameter_km_original, diameter_repair_status and the repaired diameter_km; needs diameter_km, diameter_raw, source_diameter_km.

    A diameter is repaired if the preserved text is a number that isn't the same (relative or absolute 1e-9).
    """
    raw, old, source = X.plain_number("diameter_raw"), F.col("diameter_km"), F.col("source_diameter_km")
    close = lambda a, b: F.abs(a - b) <= F.greatest(1e-9 * F.greatest(F.abs(a), F.abs(b)), F.lit(1e-9))
    changed = F.coalesce(~close(raw, old), F.lit(False))
    verified = F.coalesce(close(source, raw), F.lit(False))
    status = F.when(~changed, "unchanged").when(verified, "verified_against_snapshot").otherwise("repaired_from_preserved_rendered_value")
    return records.withColumns({"diameter_repair_status": status, "diameter_km_original": F.when(changed, old), "diameter_km": F.when(changed, raw).otherwise(old)})


def disambiguate_names(records: DataFrame) -> DataFrame:
    """Add display_name; needs name, source_key, coordinate_title, place. Repeats are counted by grouped joins."""
    by_source = records.groupBy("source_key", "name").agg(F.count(F.lit(1)).alias("_s"))
    by_name = records.groupBy("name").agg(F.count(F.lit(1)).alias("_g"))
    rows = records.join(by_source, ["source_key", "name"], "left").join(by_name, "name", "left")
    return rows.withColumn("display_name", X.display_name("name", "place", F.col("_s"), F.col("_g"), "coordinate_title")).drop("_s", "_g")


def repair_catalogue(records: DataFrame, pages: DataFrame, exclusions: DataFrame) -> dict[str, DataFrame]:
    """A catalogue repaired by a snapshot of the pages that it was drawn from.

    records: record_id, name, source_key, lon, lat, diameter_km, diameter_raw, coordinate_title, place; pages: page, text; exclusions: record_id,
    duplicate_of, note. Returns ``catalogue`` (repaired diameters, display names, circle, analytical_include), ``audit`` (a row a record: what was
    found and changed) and ``summary`` (one row of counts).
    """
    rows = cut(catalogue_rows(table_rows(pages, "page", "text")).select(F.struct("page", "row_no").alias("source_id"), "name", "diameter_km", "coordinates"))
    known = records.select("record_id", "name", "lon", "lat", X.first_number("diameter_raw").alias("diameter_raw_km"))
    match = match_source(known, rows)
    found = match.join(rows.select("source_id", F.col("diameter_km").alias("source_diameter_km")), "source_id", "left")
    fixed = repair_diameters(records.join(found, "record_id"))
    named = without_duplicates(disambiguate_names(fixed), exclusions)
    catalogue = cut(named.withColumn("ring", circle_vertices("lon", "lat", "diameter_km")))
    renamed = F.col("display_name") != F.col("name")
    audit = catalogue.select(
        "record_id", "name", "display_name", "diameter_km_original", "diameter_km", "source_diameter_km", "diameter_repair_status", "coordinate_audit_status",
        F.round("distance_km", 3).alias("coordinate_distance_km"), renamed.alias("name_changed"), "analytical_include", "duplicate_of", "note",
    )
    count = lambda rule: F.count_if(rule)
    summary = audit.agg(
        F.count(F.lit(1)).alias("records"), count(F.col("analytical_include")).alias("unique_records"), count(F.col("diameter_repair_status") != "unchanged").alias("diameters_changed"),
        count(F.col("diameter_repair_status") == "verified_against_snapshot").alias("diameters_verified"), count(F.col("name_changed")).alias("names_changed"),
        count(F.col("coordinate_audit_status") == "verified_within_5_km").alias("coordinates_verified"),
        count(F.col("coordinate_audit_status") == "verified_by_coordinate_alias_within_5_km").alias("coordinates_verified_by_alias"),
    )
    return {"catalogue": catalogue, "audit": audit, "summary": summary}
