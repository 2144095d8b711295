"""Writing results: sorted CSV, features, packets, request manifests and summaries."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import scoring as S
from ..functions import text as X


def write_sorted_csv(df: DataFrame, path: str) -> None:
    """CSV with a header and columns in the order of their names."""
    df.select(*sorted(df.columns)).write.mode("errorifexists").csv(path, header=True)


def as_features(df: DataFrame, lon: str = "lon", lat: str = "lat", geometry: tuple[str, str] | None = None) -> DataFrame:
    """One GeoJSON feature a row (column value): a point, or the original geometry from its (type, coordinates as JSON text) columns, and
    all other columns as properties; NaN becomes null."""
    shape = geometry or (lon, lat)
    props = [c for c in df.columns if c not in shape]
    clean = [S.known(c).alias(c) if t in ("double", "float") else F.col(c) for c, t in df.dtypes if c in props]
    if geometry:
        drawn = F.struct(F.col(geometry[0]).alias("type"), F.try_parse_json(geometry[1]).alias("coordinates"))
    else:
        drawn = F.struct(F.lit("Point").alias("type"), F.array(F.col(lon), F.col(lat)).alias("coordinates"))
    feature = F.struct(F.lit("Feature").alias("type"), drawn.alias("geometry"), F.struct(*clean).alias("properties"))
    return df.select(F.to_json(feature, {"ignoreNullFields": "false"}).alias("value"))


def write_features(df: DataFrame, path: str, geometry: tuple[str, str] | None = None) -> None:
    """Line-delimited GeoJSON features."""
    as_features(df, geometry=geometry).write.mode("errorifexists").text(path)


def as_collections(df: DataFrame, parts: int, metadata: dict[str, str] | None = None, **how) -> DataFrame:
    """(part, value): whole FeatureCollections of about equal numbers of features, for an export that must be read at once.

    A part is one task's text: choose ``parts`` so that it can hold one.
    """
    features = as_features(df, **how).withColumn("part", F.pmod(F.xxhash64("value"), F.lit(parts)).cast("int"))
    said = ", ".join(f"{json.dumps(k)}: {json.dumps(v)}" for k, v in (metadata or {}).items())
    head = '{"type": "FeatureCollection", ' + (f'"metadata": {{{said}}}, ' if said else "") + '"features": ['
    joined = F.concat_ws(", ", F.array_sort(F.collect_list("value")))
    return features.groupBy("part").agg(F.concat(F.lit(head), joined, F.lit("]}")).alias("value"))


def result_rows(summary: DataFrame, test: str, statistic: str) -> DataFrame:
    """A null summary as (test, statistic, observed, null_center, low, high, p, p_label)."""
    label = F.when(F.col("p") < 0.001, "<0.001").otherwise(F.format_string("%.3f", "p"))
    return summary.select(
        F.lit(test).alias("test"), F.lit(statistic).alias("statistic"), "observed", F.col("null_median").alias("null_center"), F.col("null_low").alias("low"), F.col("null_high").alias("high"), "p", label.alias("p_label")
    )


# Tests that could refute a candidate.
REFUTING_TESTS = ("mapped bedrock structure", "independent gravity or seismic model", "petrography of target rocks")


def review_packets(df: DataFrame, top: int = 25, control: str | None = None, tests: tuple[str, ...] = REFUTING_TESTS) -> DataFrame:
    """(candidate_id, packet): a nested JSON record of the best candidates, with alternatives (the class of the nearest control, in column
    ``control``, first) and tests that could refute them."""
    best = df.orderBy(F.desc_nulls_last("followup_score"), "candidate_id").limit(top)
    evidence = X.score_breakdown({c: c for c in ("followup_score", "gravity_bouguer_ring_score", "magnetic_ring_score") if c in df.columns})
    near = F.col(control) if control else F.lit(None).cast("string")
    packet = F.struct("candidate_id", evidence.alias("evidence"), X.packet_alternatives("domain", near).alias("alternatives"), F.array(*map(F.lit, tests)).alias("falsification_tests"))
    return best.select("candidate_id", F.to_json(packet).alias("packet"))


def imagery_requests(df: DataFrame, start: str, end: str, cloud: int = 20) -> DataFrame:
    """(candidate_id, west, south, east, north, request): boxes of 1.75 radii, 15 degrees at most; requests only, nothing is fetched."""
    half = F.least(F.lit(15.0), 1.75 * F.col("radius_km") / 111.2)
    box = [F.col("lon") - half, F.col("lat") - half, F.col("lon") + half, F.col("lat") + half]
    named = [c.alias(n) for c, n in zip(box, ("west", "south", "east", "north"), strict=True)]
    ask: Column = F.struct(F.array(*box).alias("bbox"), F.lit(f"{start}/{end}").alias("datetime"), F.struct(F.struct(F.lit(cloud).alias("lt")).alias("eo:cloud_cover")).alias("query"))
    return df.select("candidate_id", *named, F.to_json(ask).alias("request"))


def screening_summary(sections: dict[str, tuple[DataFrame, str]]) -> DataFrame:
    """(section, key, value): the number of rows by a column's values, for each section."""
    out = None
    for name, (df, column) in sections.items():
        part = df.groupBy(F.coalesce(F.col(column).cast("string"), F.lit("missing")).alias("key")).agg(F.count(F.lit(1)).alias("value")).select(F.lit(name).alias("section"), "key", "value")
        out = part if out is None else out.unionByName(part)
    return out


def source_manifest(tables: dict[str, DataFrame], fingerprints: DataFrame | None = None) -> DataFrame:
    """(output, rows[, path, bytes, sha256]) of each output table, and of the source files (see ``files.source_fingerprints``)."""
    out = None
    for name, df in tables.items():
        part = df.agg(F.count(F.lit(1)).alias("rows")).select(F.lit(name).alias("output"), "rows")
        out = part if out is None else out.unionByName(part)
    if fingerprints is None:
        return out
    return out.unionByName(fingerprints.select(F.lit("source").alias("output"), "path", "bytes", "sha256"), allowMissingColumns=True)


def write_grid_cells(grid: DataFrame, path: str, tile: int = 10) -> None:
    """Cells (iy, ix, lat, lon, value) as Parquet by tile of ``tile`` degrees, ascending within a file, which ``ring.grid_window_join`` reads.

    Axes must ascend and be whole: an iy (ix) of one lat (lon), which grows with it, and every pair once. Longitudes may begin at 0 or at -180.
    """
    axis = lambda i, x: grid.groupBy(i).agg(F.min(x).alias("lo"), F.max(x).alias("hi"))
    sizes = []
    for i, x in (("iy", "lat"), ("ix", "lon")):
        rows = axis(i, x).agg(
            F.count(F.lit(1)).alias("n"), F.count_if(F.col("lo") != F.col("hi")).alias("torn"), (F.max(i) - F.min(i) + 1).alias("span"),
            F.corr(F.col(i).cast("double"), "lo").alias("way"), F.countDistinct("lo").alias("values"),
        ).first()
        if rows["torn"] or rows["n"] != rows["span"] or rows["values"] != rows["n"] or (rows["n"] > 1 and not rows["way"] > 0.999):
            raise ValueError(f"{i} is no ascending axis of {x}")
        sizes.append(rows["n"])
    if grid.count() != sizes[0] * sizes[1]:
        raise ValueError(f"expected {sizes[0]} x {sizes[1]} cells")
    lon = F.when(F.col("lon") >= 180, F.col("lon") - 360).otherwise(F.col("lon"))
    placed = grid.withColumns({"ty": F.floor((F.col("lat") + 90) / tile), "tx": F.pmod(F.floor((lon + 180) / tile), F.lit(360 // tile))})
    placed.repartition("ty", "tx").sortWithinPartitions("ty", "tx", "iy", "ix").write.mode("errorifexists").partitionBy("ty", "tx").parquet(path)
