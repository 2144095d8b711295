"""Reading study files into tables. All readers take paths that Spark can open."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import scoring as S
from ..functions import text as X

# Control classes by file name.
CLASS_BY_FILE = {
    "calderas": "caldera", "seamounts": "volcanic_seamount", "ring_complexes": "ring_complex", "diapirs": "diapir",
    "sedimentary_basins": "sedimentary_basin", "salt_structures": "salt_structure", "tectonic_arcs": "tectonic_arc", "intrusive_complexes": "intrusive_complex",
}
_FEATURE = "STRUCT<id: STRING, geometry: STRUCT<type: STRING, coordinates: STRING>, properties: MAP<STRING, STRING>>"


def read_features(spark: SparkSession, path: str, lines: bool = False) -> DataFrame:
    """(source_file, source_index, feature_id, geometry_type, coordinates, properties) of GeoJSON.

    A FeatureCollection is one record a file; ``lines``: a feature a line, for large inputs, numbered within its file by
    where it stands. Coordinates stay JSON text, as their depth depends on the type. Empty geometries are left out; a missing id
    becomes candidate_0001 and so on.
    """
    raw = spark.read.text(path, wholetext=not lines).withColumn("source_file", F.col("_metadata.file_path"))
    if lines:
        order = Window.partitionBy("source_file").orderBy("_at")
        f = raw.withColumn("_at", F.monotonically_increasing_id()).withColumn("source_index", F.row_number().over(order) - 1)
        f = f.select("source_file", "source_index", F.from_json("value", _FEATURE).alias("f"))
    else:
        f = raw.select("source_file", F.posexplode(F.from_json("value", f"STRUCT<features: ARRAY<{_FEATURE}>>")["features"]).alias("source_index", "f"))
    given = F.coalesce(F.col("f.properties")["candidate_id"], F.col("f.id"), F.format_string("candidate_%04d", F.col("source_index").cast("int")))
    out = f.select("source_file", "source_index", given.alias("feature_id"), F.col("f.geometry.type").alias("geometry_type"), F.col("f.geometry.coordinates").alias("coordinates"), F.col("f.properties").alias("properties"))
    return out.where("coordinates IS NOT NULL AND coordinates NOT IN ('[]', 'null')")


def explode_vertices(features: DataFrame) -> DataFrame:
    """(feature_id, line_no, vertex_no, lon, lat) of lines; other geometry types are an error."""
    line, many = F.col("geometry_type") == "LineString", F.col("geometry_type") == "MultiLineString"
    single = F.array(F.from_json("coordinates", "ARRAY<ARRAY<DOUBLE>>"))
    lines = F.when(many, F.from_json("coordinates", "ARRAY<ARRAY<ARRAY<DOUBLE>>>")).when(line, single).otherwise(F.raise_error(F.concat(F.lit("not a line: "), F.coalesce("geometry_type", F.lit("none")))))
    v = features.select("feature_id", F.posexplode(lines).alias("line_no", "l")).select("feature_id", "line_no", F.posexplode("l").alias("vertex_no", "p"))
    return v.select("feature_id", "line_no", "vertex_no", F.get("p", F.lit(0)).alias("lon"), F.get("p", F.lit(1)).alias("lat"))


def typed(df: DataFrame, text_columns: tuple[str, ...]) -> DataFrame:
    """Text columns stay text (empty: null); others become doubles where all their values are numbers, NaN to null."""
    others = [c for c in df.columns if c not in text_columns]
    blank = lambda c: F.nullif(F.trim(F.col(c).cast("string")), F.lit(""))
    bad = df.agg(*[F.count_if(blank(c).isNotNull() & blank(c).try_cast("double").isNull()).alias(c) for c in others]).first() if others else {}
    return df.select(*[S.known(blank(c).try_cast("double")).alias(c) if c in others and not bad[c] else blank(c).alias(c) for c in df.columns])


def read_metrics_csv(spark: SparkSession, path: str, text_columns: tuple[str, ...] = ("candidate_id", "name")) -> DataFrame:
    return typed(spark.read.csv(path, header=True), text_columns)


def read_large_catalogue(spark: SparkSession, path: str, columns: dict[str, str], size: str, least: float) -> DataFrame:
    """Chosen columns, renamed, of rows whose size (a source column) is at least ``least``, the largest first; columns are numbers where all their values are."""
    rows = spark.read.csv(path, header=True).where(F.col(size).try_cast("double") >= least).select(*[F.col(c).alias(new) for c, new in columns.items()])
    return typed(rows, ()).orderBy(F.desc(columns[size]))


def read_positional_csv(spark: SparkSession, path: str, names: list[str], numbers: tuple[str, ...]) -> DataFrame:
    """A CSV without header: trimmed, empty to null, the named columns as doubles."""
    rows = spark.read.schema(", ".join(f"`{n}` string" for n in names)).csv(path)
    blank = lambda n: F.nullif(F.trim(F.col(n)), F.lit(""))
    return rows.select(*[blank(n).try_cast("double").alias(n) if n in numbers else blank(n).alias(n) for n in names])


def sequence_to_grid(values: DataFrame, n: str, value: str, rows: int, columns: int) -> DataFrame:
    """(iy, ix, lat, lon, value) of values numbered from 0 row by row, at cell centers of a global grid from the south and from 0 degrees east.

    A wrong number of values, a hole or a repeated number is an error.
    """
    count = values.agg(F.count(F.lit(1)).alias("c"), F.min(n).alias("lo"), F.max(n).alias("hi"), F.countDistinct(n).alias("d")).first()
    if (count["c"], count["d"], count["lo"], count["hi"]) != (rows * columns, rows * columns, 0, rows * columns - 1):
        raise ValueError(f"expected {rows * columns} values numbered from 0, found {count['c']}")
    ix, iy = F.col(n) % columns, F.floor(F.col(n) / columns)
    lat = iy * (180.0 / rows) + 90.0 / rows - 90.0
    return values.select(iy.alias("iy"), ix.alias("ix"), lat.alias("lat"), (ix * (360.0 / columns) + 180.0 / columns).alias("lon"), F.col(value).alias("value"))


def read_kml_provinces(spark: SparkSession, path: str) -> DataFrame:
    """(province_id, ring_no, is_hole, ring, properties, is_closed) of polygons; outer rings need four points; description lines ``key: value`` are
    properties. is_closed: the last point is the first, as a ring that geometry operators take must be."""
    schema = T.StructType([T.StructField("name", T.StringType()), T.StructField("description", T.StringType())] + [
        T.StructField("Polygon", T.ArrayType(T.StructType([
            T.StructField(side, T.ArrayType(T.StructType([T.StructField("LinearRing", T.StructType([T.StructField("coordinates", T.StringType())]))])))
            for side in ("outerBoundaryIs", "innerBoundaryIs")
        ])))
    ])
    p = spark.read.format("xml").option("rowTag", "Placemark").schema(schema).load(path)
    p = p.withColumn("province_id", F.xxhash64("name", "description", F.to_json("Polygon")))  # the same however the file is split; equal placemarks are one
    text = F.regexp_replace(F.coalesce("description", F.lit("")), "<[^>]*>", "\n")
    p = p.withColumn("properties", X.key_values(text)).select("province_id", "name", "properties", F.explode("Polygon").alias("g"))

    def side(name: str, hole: bool) -> DataFrame:
        r = p.select("province_id", "properties", F.posexplode(f"g.{name}").alias("ring_no", "r"))
        return r.select("province_id", "ring_no", F.lit(hole).alias("is_hole"), X.coordinate_list(F.col("r.LinearRing.coordinates")).alias("ring"), "properties")

    rings = side("outerBoundaryIs", False).where(F.size("ring") >= 4).unionByName(side("innerBoundaryIs", True))
    return rings.withColumn("is_closed", F.coalesce(F.get("ring", F.lit(0)) == F.element_at("ring", -1), F.lit(False)))


def source_fingerprints(spark: SparkSession, path: str, head_bytes: int | None = None) -> DataFrame:
    """(path, bytes, modified, sha256) of files, of the whole or of their first bytes."""
    f = spark.read.format("binaryFile").load(path)
    content: Column = F.col("content") if head_bytes is None else F.substring("content", 1, head_bytes)
    return f.select("path", F.col("length").alias("bytes"), F.col("modificationTime").alias("modified"), F.sha2(content, 256).alias("sha256"))


def read_controls(spark: SparkSession, paths: list[str]) -> DataFrame:
    """Standard control rows of GeoJSON files: the class from keywords, else from the file's name."""
    f = None
    for path in dict.fromkeys(paths):
        rows = read_features(spark, path)
        f = rows if f is None else f.unionByName(rows)
    if f is None:
        raise ValueError("no control files")
    stem = F.regexp_extract("source_file", r"([^/]+?)(?:\.[^./]+)?$", 1)
    named = F.create_map(*[F.lit(x) for kv in CLASS_BY_FILE.items() for x in kv])
    by_file = F.coalesce(F.element_at(named, stem), F.regexp_replace(stem, "s+$", ""))
    get = lambda *keys: F.coalesce(*[F.col("properties")[k] for k in keys])
    name = F.coalesce(get("name", "Name"), F.col("feature_id"))
    kind, about = get("source_control_type", "Type"), get("control_description", "Description")
    return f.select(
        F.concat(F.lit("control_"), X.slug(name)).alias("negative_control_id"), name.alias("negative_control_name"), S.control_class(kind, about, by_file).alias("negative_control_class"),
        kind.alias("source_control_type"), about.alias("control_description"), F.lit(True).alias("known_endogenic_negative_control"), "geometry_type", "coordinates",
    )
