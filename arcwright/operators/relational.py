"""Small rules over tables: searches, pages, merges, assertions, descriptions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def id_filter(df: DataFrame, column: str, ids: str | None) -> DataFrame:
    """Rows whose id is in a comma list; blanks are dropped, an empty list keeps all."""
    wanted = [x.strip() for x in (ids or "").split(",") if x.strip()]
    return df.where(F.col(column).isin(wanted)) if wanted else df


def page(df: DataFrame, order: str, start: int = 0, limit: int | None = None) -> DataFrame:
    """Rows from ``start`` of an order column on, at most ``limit``."""
    out = df.where(F.col(order) >= start).orderBy(order)
    return out if limit is None else out.limit(limit)


def status_filter(df: DataFrame, column: str, value: str | None, allowed: tuple[str, ...]) -> DataFrame:
    """Rows of a status; an unknown status filters nothing."""
    return df.where(F.col(column) == value) if value in allowed else df


def text_search(df: DataFrame, columns: list[str], terms: list[tuple[str, str]] | str) -> DataFrame:
    """Rows where some column holds its term, whatever the case; one term for all columns if ``terms`` is a text."""
    pairs = [(c, terms) for c in columns] if isinstance(terms, str) else terms
    rule = F.lit(False)
    for c, term in pairs:
        rule = rule | F.coalesce(F.lower(F.col(c).cast("string")).contains(term.lower()), F.lit(False))
    return df.where(rule)


def record_search(df: DataFrame, term: str) -> DataFrame:
    """Rows whose whole record, as lower-cased JSON, holds the term."""
    return df.where(F.lower(F.to_json(F.struct(*df.columns))).contains(term.lower()))


def visible_to(df: DataFrame, owner: str | None, public: tuple[str, ...], scope: str = "all") -> DataFrame:
    """Rows that an owner may see: ``all`` (public ones and the owner's own), ``own``, or ``others`` (public ones of others)."""
    shown, mine = F.col("status").isin(*public), F.lit(False) if owner is None else F.coalesce(F.col("owner") == owner, F.lit(False))
    return df.where({"all": shown | mine, "own": mine, "others": shown & ~mine}[scope])


def without_duplicates(records: DataFrame, exclusions: DataFrame) -> DataFrame:
    """Records with duplicate_of, note and analytical_include; exclusions: record_id, duplicate_of, note (any number; Spark broadcasts or shuffles them by their size)."""
    rows = records.join(exclusions, "record_id", "left")
    return rows.withColumn("analytical_include", F.col("duplicate_of").isNull())


def detect_field(columns: list[str], aliases: list[str], name: str = "field", required: bool = False) -> str | None:
    """The first alias that names a column, letters' case and - or _ aside, else the first that part of a column's name equals."""
    plain = {c.lower().replace("-", "").replace("_", ""): c for c in reversed(columns)}
    wanted = [a.lower().replace("-", "").replace("_", "") for a in aliases]
    for a in wanted:
        if a in plain:
            return plain[a]
    for a in wanted:
        for k in sorted(plain, key=lambda k: columns.index(plain[k])):
            if a in k:
                return plain[k]
    if required:
        raise ValueError(f"no column for {name}: {', '.join(aliases)}")
    return None


def first_of_aliases(df: DataFrame, aliases: dict[str, list[str]]) -> DataFrame:
    """Each name as the first of its aliases' values that isn't null, NaN or blank; aliases that aren't columns are passed over, other columns stay."""
    known = dict(df.dtypes)

    def value(c: str) -> Column:
        if known[c] in ("double", "float"):
            return F.when(~F.isnan(c), F.col(c))
        return F.when(F.trim(c) != "", F.col(c)) if known[c] == "string" else F.col(c)

    new = {name: [value(c) for c in names if c in known] for name, names in aliases.items()}
    return df.withColumns({name: F.coalesce(*cols) if cols else F.lit(None).cast("string") for name, cols in new.items()})


def override(base: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """Base rows updated by new rows of the same key: the new value wins where there is a row, even if it is null."""
    fresh = new.select(F.struct(*[new[c] for c in new.columns]).alias("_new"), new[key].alias("_key"))
    joined = base.join(fresh, base[key] == F.col("_key"), "left")
    has = F.col("_key").isNotNull()
    cols = [F.when(has, F.col("_new")[c]).otherwise(base[c]).alias(c) if c in new.columns and c != key else base[c] for c in base.columns]
    cols += [F.col("_new")[c].alias(c) for c in new.columns if c not in base.columns]
    return joined.select(*cols)


def assert_one_to_one(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """One row (n_left, n_right, left_only, right_only, repeated, ok) of a mapping's checks."""
    a = left.groupBy(key).agg(F.count(F.lit(1)).alias("a"))
    b = right.groupBy(key).agg(F.count(F.lit(1)).alias("b"))
    j = a.join(b, key, "full").agg(
        F.coalesce(F.sum("a"), F.lit(0)).alias("n_left"), F.coalesce(F.sum("b"), F.lit(0)).alias("n_right"), F.count_if(F.col("b").isNull()).alias("left_only"),
        F.count_if(F.col("a").isNull()).alias("right_only"), F.count_if((F.col("a") > 1) | (F.col("b") > 1)).alias("repeated"),
    )
    return j.withColumn("ok", (F.col("left_only") == 0) & (F.col("right_only") == 0) & (F.col("repeated") == 0))


def field_dictionary(df: DataFrame, categories: dict[str, str] | None = None, descriptions: dict[str, str] | None = None) -> DataFrame:
    """(field, type, nullable, n[, category, description]): the kind, whether values are missing, and how many there are, in one pass.

    categories: prefix -> category, the first that fits, else ``other``; both columns are there only if given.
    """
    kinds = {"string": "string", "boolean": "boolean", "double": "number", "float": "number"}
    kind = lambda t: kinds.get(t, "integer" if t in ("int", "bigint", "smallint", "tinyint") else "object")
    more = lambda c: [] if categories is None else [
        F.lit(next((k for p, k in categories.items() if c.startswith(p)), "other")).alias("category"), F.lit((descriptions or {}).get(c, "")).alias("description")
    ]
    counts = df.agg(F.count(F.lit(1)).alias("_all"), *[F.count(c).alias(c) for c in df.columns])
    rows = F.array(*[F.struct(F.lit(c).alias("field"), F.lit(kind(t)).alias("type"), (F.col(c) < F.col("_all")).alias("nullable"), F.col(c).alias("n"), *more(c)) for c, t in df.dtypes])
    return counts.select(F.explode(rows).alias("r")).select("r.*")


def with_capture_fields(df: DataFrame, fields: dict[str, str], done: str = "review_complete") -> DataFrame:
    """Empty columns for reviewers to fill, and a flag that they haven't yet."""
    return df.withColumns({c: F.lit(None).cast(t) for c, t in fields.items()}).withColumn(done, F.lit(False))


def prefixed(df: DataFrame, prefix: str, keep: list[str]) -> DataFrame:
    return df.select(*keep, *[F.col(c).alias(f"{prefix}{c}") for c in df.columns if c not in keep])


def ratios(radii: Column) -> Column:
    """Ratios of neighbours in the sorted positive values."""
    s = F.array_sort(F.filter(radii, lambda x: x.isNotNull() & (x > 0)))
    return F.transform(F.slice(s, 2, F.greatest(F.size(s) - 1, F.lit(0))), lambda x, i: x / F.element_at(s, i + 1))


def compare_planetary(families: DataFrame, planetary: DataFrame) -> DataFrame:
    """Planetary rows and terrestrial families in one table; a family's diameter is the upper end of its range."""
    earth = families.select(
        F.lit("terrestrial_screening").alias("source"), F.col("family_id").alias("object"), F.lit("Earth").alias("body"), F.lit("screening geometry only").alias("certainty"),
        F.element_at(F.split("diameter_range_km", "-"), -1).try_cast("double").alias("diameter_km"), F.lit("candidate nested geometry; requires geological discrimination").alias("comparison_interpretation"),
    )
    other = planetary.withColumn("comparison_interpretation", F.lit("geometric comparison only; size similarity does not imply common origin"))
    return other.unionByName(earth, allowMissingColumns=True)


def group_sizes(df: DataFrame, *columns: str) -> DataFrame:
    """(columns..., n): the number of rows of each group; nulls are a group."""
    return df.groupBy(*columns).agg(F.count(F.lit(1)).alias("n"))


def complete_rows(df: DataFrame, columns: list[str]) -> DataFrame:
    """Rows in which none of the columns is null or NaN."""
    return df.dropna(subset=columns)


def colour_domain(df: DataFrame, value: str) -> DataFrame:
    """One row (low, high): the ends of a field's colour scale over the visible rows; see ``scoring.colour_position``."""
    v = F.when(~F.isnan(F.col(value).cast("double")), F.col(value).cast("double"))
    return df.agg(F.min(v).alias("low"), F.max(v).alias("high"))


def first_families(members: DataFrame, family: str, order: str, n: int) -> DataFrame:
    """The members of the first n families, in the order in which their first members come."""
    first = members.groupBy(family).agg(F.min(order).alias("_first")).orderBy("_first", family).limit(n)
    return members.join(first.select(family), family, "left_semi")


def with_mandatory_control(controls: DataFrame, candidates: DataFrame, candidate_id: str, control_class: str) -> DataFrame:
    """The controls and, as one more, the candidate of this id."""
    fields = {"negative_control_id": F.concat(F.lit("control_"), F.col("candidate_id")), "negative_control_class": F.lit(control_class), "known_endogenic_negative_control": F.lit(True)}
    chosen = candidates.where(F.col("candidate_id") == candidate_id).withColumns(fields)
    return controls.unionByName(chosen.select(*[c for c in chosen.columns if c in controls.columns]), allowMissingColumns=True)


def catalogue_projection(records: DataFrame) -> DataFrame:
    """(record_id, name, lon, lat, diameter_km, eid_match, source): a repaired catalogue's records that count, with plain types."""
    shown = F.coalesce(F.nullif("display_name", F.lit("")), "name")
    match = F.coalesce(F.col("earth_impact_database_match").cast("boolean"), F.lit(False))
    rows = records.where(F.coalesce("analytical_include", F.lit(True)))
    return rows.select("record_id", shown.alias("name"), F.col("center_lon").cast("double").alias("lon"), F.col("center_lat").cast("double").alias("lat"), F.col("diameter_km").cast("double").alias("diameter_km"), match.alias("eid_match"), "source")


def with_figures(rows: DataFrame, figures: DataFrame) -> DataFrame:
    """Rows with figure_id and figure_title where their candidate has a figure, of several the smallest id; has_figure tells which."""
    one = figures.groupBy("candidate_id").agg(F.min(F.struct("figure_id", "figure_title")).alias("_f"))
    return rows.join(one, "candidate_id", "left").select(*rows.columns, F.col("_f.figure_id").alias("figure_id"), F.col("_f.figure_title").alias("figure_title"), F.col("_f").isNotNull().alias("has_figure"))


def planetary_rings(rows: DataFrame) -> DataFrame:
    """Ring sets with ring_ratios (neighbours of the sorted diameters) and number_of_nested_rings; needs ring_diameters_km."""
    rings = F.array_sort(F.filter("ring_diameters_km", lambda x: x.isNotNull() & (x > 0)))
    return rows.withColumns({"ring_ratios": ratios(F.col("ring_diameters_km")), "number_of_nested_rings": F.coalesce(F.size(rings), F.lit(0))})
