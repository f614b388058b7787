"""Bronze: typed columns out of raw JSON tables, loaded incrementally by arrival time."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from firmaforge import schemas


def _now(as_of: datetime | str | None) -> Column:
    return F.current_timestamp() if as_of is None else F.lit(as_of).cast("timestamp")


def bronze_search(raw: DataFrame, as_of: datetime | str | None = None) -> DataFrame:
    doc = F.from_json("data", schemas.SEARCH_JSON)
    names = ["title", "snippet", "link", "company_name", "city", "company_type"]
    return raw.withColumn("_d", doc).select(
        "source_url",
        "source_type",
        "fetch_ts",
        *[F.col(f"_d.{n}") for n in names],
        F.col("data").alias("full_data"),
        "parser_version",
        "created_at",
        _now(as_of).alias("processed_at"),
    )


def bronze_places(raw: DataFrame, as_of: datetime | str | None = None) -> DataFrame:
    doc = F.from_json("data", schemas.PLACES_JSON)
    return raw.withColumn("_d", doc).select(
        "place_id",
        "source_type",
        "fetch_ts",
        F.col("_d.name").alias("business_name"),
        F.col("_d.formatted_address").alias("address"),
        F.col("_d.formatted_phone_number").alias("phone"),
        F.col("_d.website").alias("website"),
        F.expr("try_cast(_d.rating AS DECIMAL(2,1))").alias("rating"),
        F.expr("try_cast(_d.user_ratings_total AS INT)").alias("reviews_count"),
        F.col("_d.types").alias("business_types"),
        F.col("_d.business_status").alias("business_status"),
        F.col("data").alias("full_data"),
        "parser_version",
        "created_at",
        _now(as_of).alias("processed_at"),
    )


def bronze_websites(raw: DataFrame, as_of: datetime | str | None = None) -> DataFrame:
    doc = F.from_json("data", schemas.WEBSITE_JSON)
    return raw.withColumn("_d", doc).select(
        "website_url",
        "source_type",
        "fetch_ts",
        "status_code",
        F.col("_d.company_name").alias("company_name"),
        F.col("_d.title").alias("page_title"),
        F.col("_d.meta_description").alias("meta_description"),
        *[F.col(f"_d.{n}") for n in ("emails", "phones", "address", "social_links", "keywords")],
        F.col("data").alias("full_data"),
        "parser_version",
        "created_at",
        _now(as_of).alias("processed_at"),
    )


def json_fields(df: DataFrame, column: str, ddl: str, keep: list[str]) -> DataFrame:
    """Any JSON text column parsed once with an explicit layout and spread into columns."""
    parsed = df.select(*keep, F.from_json(column, ddl).alias("_d"))
    return parsed.select(*keep, "_d.*")


def json_text(column: str, path: str) -> Column:
    """One scalar out of JSON text, for ad-hoc use; prefer :func:`json_fields` for several."""
    return F.get_json_object(column, path)


def json_with(column: Column, key: str, value: Column) -> Column:
    """A map column with one key set to a new value."""
    kept = F.map_filter(column, lambda k, _: k != key)
    return F.map_concat(kept, F.create_map(F.lit(key), value))


def high_water_mark(loaded: DataFrame, ts: str = "created_at") -> datetime | None:
    """The newest arrival already loaded: one value, read from an aggregate."""
    return loaded.agg(F.max(ts)).first()[0]


def newer_than(
    raw: DataFrame, mark: datetime | None, ts: str = "created_at", overlap: str | None = None
) -> DataFrame:
    """Rows that arrived after ``mark``; everything where nothing was loaded yet.

    The mark is a literal, so the predicate reaches the file scan and skips row groups.
    ``overlap`` (an interval such as ``'2 HOURS'``) re-reads a window for late rows, which
    the keyed merge then makes harmless.
    """
    if mark is None:
        return raw
    bound = F.lit(mark)
    if overlap:
        return raw.filter(F.col(ts) >= bound - F.expr(f"INTERVAL {overlap}"))
    return raw.filter(F.col(ts) > bound)


def latest_per_key(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The last row of each key.

    ``max_by`` aggregates before the shuffle, so a key that holds much of the data costs one
    row per task instead of a sort of the whole group.
    """
    rest = [c for c in df.columns if c not in keys]
    top = F.max_by(F.struct(*rest), F.struct(*order)).alias("_r")
    return df.groupBy(*keys).agg(top).select(*keys, "_r.*").select(*df.columns)


def merge_by_key(
    existing: DataFrame, incoming: DataFrame, keys: list[str], order: list[str]
) -> DataFrame:
    """Incoming rows replace existing ones of the same key; the last incoming row wins."""
    fresh = latest_per_key(incoming, keys, order)
    kept = existing.join(fresh.select(*keys), keys, "left_anti")
    return kept.unionByName(fresh.select(*existing.columns))


def incremental_load(
    raw: DataFrame,
    loaded: DataFrame | None,
    keys: list[str],
    ts: str = "created_at",
    order: list[str] | None = None,
    overlap: str | None = None,
) -> DataFrame:
    """One load step: filter by the mark, then merge by key into what is there."""
    order = order or [ts]
    if loaded is None:
        return latest_per_key(raw, keys, order)
    return merge_by_key(loaded, newer_than(raw, high_water_mark(loaded, ts), ts, overlap), keys, order)
