"""Silver: three bronze sources under one layout, then one row per company."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from firmaforge.functions.text import address_city, blank_to_null, url_domain

UNION_COLUMNS = {
    "legal_name": "string",
    "city": "string",
    "company_type": "string",
    "source_url": "string",
    "website": "string",
    "phones": "array<string>",
    "address": "string",
    "rating": "double",
    "reviews_count": "bigint",
    "emails": "array<string>",
    "social_links": "string",
    "keywords": "array<string>",
    "source_type": "string",
    "processed_at": "timestamp",
}


def _padded(df: DataFrame, **columns: Column) -> DataFrame:
    named = df.filter(columns["legal_name"].isNotNull())
    return named.select(
        *[columns.get(n, F.lit(None)).cast(t).alias(n) for n, t in UNION_COLUMNS.items()]
    )


def union_sources(search: DataFrame, places: DataFrame, websites: DataFrame) -> DataFrame:
    """All named records of the three bronze tables, columns padded with nulls."""
    c = F.col
    return (
        _padded(
            search,
            legal_name=c("company_name"),
            city=c("city"),
            company_type=c("company_type"),
            source_url=c("link"),
            source_type=F.lit("google_search"),
            processed_at=c("processed_at"),
        )
        .unionByName(
            _padded(
                places,
                legal_name=c("business_name"),
                city=address_city(c("address")),
                website=c("website"),
                phones=F.array_compact(F.array(c("phone"))),
                address=c("address"),
                rating=c("rating"),
                reviews_count=c("reviews_count"),
                source_type=F.lit("google_places"),
                processed_at=c("processed_at"),
            )
        )
        .unionByName(
            _padded(
                websites,
                legal_name=c("company_name"),
                website=c("website_url"),
                phones=c("phones"),
                address=c("address"),
                emails=c("emails"),
                social_links=F.to_json(c("social_links")),
                keywords=c("keywords"),
                source_type=F.lit("website"),
                processed_at=c("processed_at"),
            )
        )
    )


GROUP = ["legal_name", "city", "company_type"]


def _items(kind: str, array: Column) -> Column:
    texts = F.coalesce(array, F.array().cast("array<string>"))
    return F.transform(texts, lambda x: F.struct(F.lit(kind).alias("kind"), x.alias("item")))


def company_items(records: DataFrame) -> DataFrame:
    """Distinct sites, phones, mails, profiles, keywords and sources of each (name, city, legal
    form), one row per item: the form to use where a group may have more items than fit a row."""
    rows = _distinct_items(records).filter("_i.kind <> 'row'")
    return rows.select(*GROUP, F.col("_i.kind").alias("kind"), F.col("_i.item").alias("item"))


def _distinct_items(records: DataFrame) -> DataFrame:
    """Groups by item with partial sums of the scalars, which ride along on items of kind row."""
    site = F.col("website")
    keyed = records.filter(F.col("legal_name").isNotNull()).select(
        F.upper(F.trim("legal_name")).alias("legal_name"),
        F.initcap(F.trim("city")).alias("city"),
        "company_type",
        "address",
        F.col("rating").cast("decimal(12,6)").alias("rating"),
        "reviews_count",
        "processed_at",
        F.explode(
            F.concat(
                F.array(F.struct(F.lit("row").alias("kind"), F.lit(None).cast("string").alias("item"))),
                _items("website", F.array_compact(F.array(site))),
                _items("phone", F.array_compact("phones")),
                _items("email", F.array_compact("emails")),
                _items("social", F.array_compact(F.array("social_links"))),
                _items("keyword", F.array_compact("keywords")),
                _items("source", F.array("source_type")),
            )
        ).alias("_i"),
    )
    row = F.col("_i.kind") == "row"

    def of_row(name: str) -> Column:
        return F.when(row, F.col(name))

    return keyed.groupBy(*GROUP, "_i").agg(
        F.max(of_row("address")).alias("address"),
        F.sum(of_row("rating")).alias("rating_sum"),
        F.count(of_row("rating")).alias("rating_count"),
        F.sum(of_row("reviews_count")).alias("reviews"),
        F.min(of_row("processed_at")).alias("first_seen"),
        F.max(of_row("processed_at")).alias("last_updated"),
    )


def unify(records: DataFrame, as_of: datetime | str | None = None) -> DataFrame:
    """One row per (name, city, legal form) with merged attributes.

    Two aggregations. The first is keyed by group *and* item, so the repeats inside a very
    large group vanish in many tasks before anything is collected; scalars ride along on one
    extra row per record and are reduced map-side. The second gathers distinct items only,
    which are what the result row holds anyway; :func:`company_items` gives them as rows.
    """
    return unify_items(_distinct_items(records), as_of)


def item_sums(records: DataFrame) -> DataFrame:
    """The item rows and partial sums of :func:`unify`, to be stored and merged with later ones."""
    rows = _distinct_items(records)
    return rows.select(*GROUP, F.col("_i.kind").alias("kind"), F.col("_i.item").alias("item"), *SUMS)


def merge_item_sums(stored: DataFrame, increment: DataFrame) -> DataFrame:
    """Both as one: an item stands once, partial sums are added up. Raw rows are not read again."""
    how = {"address": F.max, "first_seen": F.min, "last_updated": F.max}
    both = stored.unionByName(increment).groupBy(*GROUP, "kind", "item")
    return both.agg(*[how.get(c, F.sum)(c).cast(stored.schema[c].dataType).alias(c) for c in SUMS])


def unify_sums(sums: DataFrame, as_of: datetime | str | None = None) -> DataFrame:
    """The companies of :func:`unify` out of stored item rows."""
    return unify_items(sums.select(*GROUP, F.struct("kind", "item").alias("_i"), *SUMS), as_of)


SUMS = ["address", "rating_sum", "rating_count", "reviews", "first_seen", "last_updated"]


def unify_items(distinct: DataFrame, as_of: datetime | str | None = None) -> DataFrame:
    """The second aggregation of :func:`unify`."""

    def gathered(kind: str) -> Column:
        return F.sort_array(F.collect_list(F.when(F.col("_i.kind") == kind, F.col("_i.item"))))

    site_item = F.when(F.col("_i.kind") == "website", F.col("_i.item"))
    grouped = distinct.groupBy(*GROUP).agg(
        F.min(F.regexp_replace(site_item, r"^https?://(www\.)?", "")).alias("_site"),
        F.min(site_item).alias("_first_site"),
        gathered("website").alias("_sites"),
        gathered("phone").alias("phone_list"),
        F.max("address").alias("address"),
        (F.sum("rating_sum") / F.sum("rating_count")).alias("_rating"),
        F.sum("reviews").alias("total_reviews"),
        gathered("email").alias("emails"),
        gathered("social").alias("_social"),
        gathered("keyword").alias("keywords"),
        gathered("source").alias("data_sources"),
        F.min("first_seen").alias("first_seen"),
        F.max("last_updated").alias("last_updated"),
    )
    created = F.current_timestamp() if as_of is None else F.lit(as_of).cast("timestamp")
    identity = F.concat_ws(
        "|",
        F.col("legal_name"),
        F.upper(F.coalesce("city", F.lit(""))),
        F.coalesce("company_type", F.lit("")),
        F.coalesce("_site", F.lit("")),
    )
    return grouped.select(
        F.md5(identity).alias("company_id"),
        "legal_name",
        "city",
        "company_type",
        blank_to_null(F.array_join("_sites", ", ")).alias("websites"),
        url_domain(F.col("_first_site")).alias("website_domain"),
        blank_to_null(F.array_join("phone_list", ", ")).alias("phones"),
        "phone_list",
        "address",
        F.round("_rating", 1).cast("double").alias("rating"),
        "total_reviews",
        "emails",
        F.transform("_social", lambda s: F.from_json(s, "map<string,string>")).alias("social_links"),
        "keywords",
        F.slice("keywords", 1, 20).alias("top_keywords"),
        "data_sources",
        "first_seen",
        "last_updated",
        created.alias("created_at"),
    )


def unnest(df: DataFrame, array: str, item: str) -> DataFrame:
    """One row per array item; rows whose array is null or empty stay once, with a null item."""
    return df.select(*[c for c in df.columns if c != array], F.explode_outer(array).alias(item))
