"""Filter clauses over company columns, composed into plain predicates."""

from __future__ import annotations

from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

EARTH_KM = 6371.0088


def _is_array(df: DataFrame, field: str) -> bool:
    return isinstance(df.schema[field].dataType, T.ArrayType)


def term(df: DataFrame, field: str, value: Any) -> Column:
    return F.array_contains(field, value) if _is_array(df, field) else F.col(field) == value


def terms(df: DataFrame, field: str, values: list) -> Column:
    if _is_array(df, field):
        return F.arrays_overlap(F.col(field), F.array(*[F.lit(v) for v in values]))
    return F.col(field).isin(values)


def value_range(field: str, low: Any = None, high: Any = None) -> Column:
    bounds = []
    if low is not None:
        bounds.append(F.col(field) >= low)
    if high is not None:
        bounds.append(F.col(field) <= high)
    return all_of(bounds)


def present(df: DataFrame, field: str) -> Column:
    """A value is there; an empty array or map is not one."""
    dtype = df.schema[field].dataType
    if isinstance(dtype, (T.ArrayType, T.MapType)):
        return F.coalesce(F.size(field) > 0, F.lit(False))
    return F.col(field).isNotNull()


def missing(df: DataFrame, field: str) -> Column:
    return ~present(df, field)


def all_of(clauses: list[Column]) -> Column:
    return reduce(lambda a, b: a & b, clauses, F.lit(True))


def any_of(clauses: list[Column], at_least: int = 1) -> Column:
    """At least that many clauses hold."""
    if at_least == 1 and clauses:
        return reduce(lambda a, b: a | b, clauses)
    true = [F.coalesce(c.cast("int"), F.lit(0)) for c in clauses]
    return reduce(lambda a, b: a + b, true, F.lit(0)) >= at_least


def compile_filters(df: DataFrame, filters: dict[str, Any] | None) -> Column:
    """One predicate from {field: value | [values] | {"min":…, "max":…}}.

    Plain comparisons on top-level columns, so they reach the file scan.
    """
    clauses = []
    for field, value in (filters or {}).items():
        if isinstance(value, (list, tuple)):
            clauses.append(terms(df, field, list(value)))
        elif isinstance(value, dict):
            clauses.append(value_range(field, value.get("min"), value.get("max")))
        else:
            clauses.append(term(df, field, value))
    return all_of(clauses)


def boolean_query(
    must: list[Column] = (), filter_: list[Column] = (), should: list[Column] = (), minimum_should_match: int | None = None
) -> Column:
    """All of must and filter; of should as many as asked for (one, if there is nothing else)."""
    clauses = [*must, *filter_]
    needed = minimum_should_match
    if needed is None:
        needed = 0 if clauses else 1
    if should and needed:
        clauses.append(any_of(list(should), needed))
    return all_of(clauses)


def segment_filter(
    df: DataFrame,
    city: str | None = None,
    industry: str | None = None,
    company_size: str | None = None,
    priority_tier: str | None = None,
    min_rating: float | None = None,
) -> DataFrame:
    asked = {"city": city, "industry": industry, "company_size": company_size, "priority_tier": priority_tier}
    clauses = [term(df, f, v) for f, v in asked.items() if v]
    if min_rating:
        clauses.append(value_range("rating", low=min_rating))
    return df.filter(all_of(clauses))


def high_value_targets(
    df: DataFrame,
    min_reviews: int = 50,
    min_rating: float = 4.0,
    industries: list[str] | None = None,
    limit: int = 100,
) -> DataFrame:
    clauses = [
        value_range("total_reviews", low=min_reviews),
        value_range("rating", low=min_rating),
        terms(df, "priority_tier", ["A", "B"]),
        present(df, "website_domain"),
        present(df, "emails"),
    ]
    if industries:
        clauses.append(terms(df, "industry", industries))
    order = [F.desc("engagement_score"), F.desc("total_reviews"), F.asc("company_id")]
    return df.filter(all_of(clauses)).orderBy(*order).limit(limit)


def recent_updates(
    df: DataFrame, days: int = 7, min_confidence: float = 0.8, as_of: str | None = None, limit: int = 50
) -> DataFrame:
    now = F.current_timestamp() if as_of is None else F.lit(as_of).cast("timestamp")
    fresh = F.col("last_updated") >= now - F.make_dt_interval(F.lit(days))
    sure = value_range("confidence_score", low=min_confidence)
    return df.filter(fresh & sure).orderBy(F.desc("last_updated"), F.asc("company_id")).limit(limit)


def distance_km(lat: Column, lon: Column, to_lat: float, to_lon: float) -> Column:
    """Great-circle distance."""
    half_lat = F.radians(lat - to_lat) / 2
    half_lon = F.radians(lon - to_lon) / 2
    chord = F.pow(F.sin(half_lat), 2) + F.cos(F.radians(lat)) * F.cos(F.radians(F.lit(to_lat))) * F.pow(
        F.sin(half_lon), 2
    )
    return 2 * EARTH_KM * F.asin(F.sqrt(F.least(chord, F.lit(1.0))))


def within_distance(
    df: DataFrame,
    lat: float,
    lon: float,
    km: float = 10.0,
    lat_col: str = "lat",
    lon_col: str = "lon",
    tie: str | None = None,
) -> DataFrame:
    """Rows within ``km``, nearest first; equally near ones by ``tie``, or by all other columns.

    A latitude band and, away from poles and date line, a longitude band come first: plain
    comparisons that skip row groups before any trigonometry.
    """
    from math import asin, cos, degrees, pi, radians, sin

    reach = km / EARTH_KM
    band = degrees(reach)
    near = F.col(lat_col).between(lat - band, lat + band)
    if abs(radians(lat)) + reach < pi / 2:
        span = degrees(asin(sin(reach) / cos(radians(lat))))
        if lon - span >= -180 and lon + span <= 180:
            near = near & F.col(lon_col).between(lon - span, lon + span)
    away = distance_km(F.col(lat_col), F.col(lon_col), lat, lon)
    # Maps and variants have no order.
    ties = [tie] if tie else [c for c, t in df.dtypes if "map<" not in t and "variant" not in t]
    found = df.filter(near).withColumn("distance_km", away).filter(F.col("distance_km") <= km)
    return found.orderBy("distance_km", *ties)


def point_lookup(index: DataFrame, stored: DataFrame, id_col: str, value: Any) -> DataFrame:
    """One document with the fields of the stored record laid over it, personal data filtered.

    The key is filtered on both sides, so the scan reads the row groups that may hold it.
    """
    from firmaforge.functions.privacy import filter_pii

    found = index.filter(F.col(id_col) == value)
    over = stored.filter(F.col(id_col) == value)
    shared = [c for c in over.columns if c != id_col]
    renamed = over.select(id_col, *[F.col(c).alias(f"_s_{c}") for c in shared])
    joined = found.join(renamed, id_col, "left")
    fields = [
        F.coalesce(F.col(f"_s_{c}"), F.col(c)).alias(c) if c in shared else F.col(c) for c in index.columns
    ]
    extra = [F.col(f"_s_{c}").alias(c) for c in shared if c not in index.columns]
    return filter_pii(joined.select(*fields, *extra), keep=(id_col,))


def response_rows(df: DataFrame) -> DataFrame:
    """The fields a search answer shows, with empty arrays where there are none."""
    no_texts = F.array().cast("array<string>")
    c = F.col
    return df.select(
        c("company_id").alias("id"),
        F.coalesce("legal_name", F.lit("")).alias("legal_name"),
        "trade_name",
        "city",
        "company_type",
        c("website_domain").alias("website"),
        F.coalesce("emails", no_texts).alias("emails"),
        F.coalesce("phones", no_texts).alias("phones"),
        "rating",
        "industry",
        c("company_size").alias("size"),
        "priority_tier",
        "last_updated",
    )
