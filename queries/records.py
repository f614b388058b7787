"""Nested company records out of the sources, source merge and registry enrichment."""

from __future__ import annotations

from pyspark.sql import functions as F

from firmaforge.operators import pages as page_ops
from firmaforge.plans import views
from firmaforge.sources import raw
from firmaforge.sources import records as rec
from queries.company_sql import RATING
from queries.pages import _TITLE, with_footer
from queries.registry import query


def place_records(spark, d):
    return rec.places_records(raw.bronze_places(views.raw_places(spark, d), views.AS_OF))


def search_records(spark, d):
    return rec.search_records(raw.bronze_search(views.raw_search(spark, d), views.AS_OF))


def website_records(spark, d):
    parsed = page_ops.parse_pages(with_footer(spark, d).select("page_id", "url", "html"))
    return rec.website_records(parsed, fetched=F.lit(views.AS_OF).cast("timestamp"))


@query(
    "place_records",
    f"""WITH rev AS (SELECT o_custkey, CAST(sum(floor(o_totalprice / 10000)) AS INTEGER) AS reviews FROM orders GROUP BY 1)
        SELECT md5('places:P' || c_custkey) AS id, c_name AS legal_name, n_name AS city, {RATING} AS rating,
          coalesce(reviews, 0) AS reviews, '+90212' || lpad(CAST(c_custkey % 10000000 AS VARCHAR), 7, '0') AS phones,
          lower(c_mktsegment) || ',establishment' AS keywords,
          'https://maps.google.com/maps/place/?q=place_id:P' || c_custkey AS source_url
        FROM customer JOIN nation ON c_nationkey = n_nationkey LEFT JOIN rev ON o_custkey = c_custkey""",
)
def place_records_query(spark, d):
    return place_records(spark, d).select(
        "id",
        "identity.legal_name",
        "identity.city",
        F.col("web_presence.google_places.rating").alias("rating"),
        F.col("web_presence.google_places.reviews_count").alias("reviews"),
        F.array_join("contacts.phones_public", ",").alias("phones"),
        F.array_join("business_meta.keywords", ",").alias("keywords"),
        F.element_at("provenance", 1)["source_url"].alias("source_url"),
    )


@query(
    "search_records",
    """SELECT md5('search:https://find.example.com/' || c_custkey) AS id, c_name AS legal_name,
         'https://find.example.com/' || c_custkey AS link, 'Firm,in,' || n_name AS keywords,
         md5('{"snippet":"Firm in ' || n_name || '"}') AS hash FROM customer JOIN nation ON c_nationkey = n_nationkey""",
)
def search_records_query(spark, d):
    return search_records(spark, d).select(
        "id",
        "identity.legal_name",
        F.col("web_presence.social_links")["source_url"].alias("link"),
        F.array_join("business_meta.keywords", ",").alias("keywords"),
        F.element_at("provenance", 1)["hash"].alias("hash"),
    )


@query(
    "website_records",
    f"""WITH t AS (SELECT page_id, url, {_TITLE} AS title FROM pages)
        SELECT url, md5('website:' || url) AS id, CAST(count(*) AS INTEGER) AS pages,
          min('info@firm' || page_id || '.example.com') AS first_email FROM t GROUP BY url""",
)
def website_records_query(spark, d):
    """Records of all pages, rolled up by address because pages repeat one."""
    made = website_records(spark, d)
    return made.groupBy("id", F.col("web_presence.website_url").alias("url")).agg(
        F.count("*").cast("int").alias("pages"),
        F.min(F.element_at("contacts.emails_public", 1)).alias("first_email"),
    )


@query(
    "normalize_records",
    """SELECT md5('places:P' || c_custkey) AS id, replace(upper(c_name), '#', ' ') AS legal_name,
         upper(left(n_name, 1)) || lower(substr(n_name, 2)) AS city,
         CASE WHEN c_custkey % 7 <> 0 THEN 'https://c' || (c_custkey // 30) || '.example.com/' || c_custkey END AS website,
         '+90212' || lpad(CAST(c_custkey % 10000000 AS VARCHAR), 7, '0') AS phones
       FROM customer JOIN nation ON c_nationkey = n_nationkey""",
)
def normalize_records(spark, d):
    return rec.normalize_records(place_records(spark, d)).select(
        "id",
        "identity.legal_name",
        "identity.city",
        F.col("web_presence.website_url").alias("website"),
        F.array_join("contacts.phones_public", ",").alias("phones"),
    )


@query(
    "merge_sources",
    """SELECT c_name AS legal_name, CASE WHEN c_custkey % 7 <> 0 THEN 'https://www.c' || (c_custkey // 30) || '.example.com/' || c_custkey END AS website,
         '+90212' || lpad(CAST(c_custkey % 10000000 AS VARCHAR), 7, '0') AS phones FROM customer""",
)
def merge_sources(spark, d):
    """Search hits completed with the place of the same name."""
    key = F.md5("identity.legal_name")
    hits = search_records(spark, d).withColumn("id", key)
    places = place_records(spark, d).withColumn("id", key)
    return rec.merge_sources(hits, places).select(
        "identity.legal_name",
        F.col("web_presence.website_url").alias("website"),
        F.array_join("contacts.phones_public", ",").alias("phones"),
    )


def registry(spark, d):
    """Domain registrations of the hosts that the places link to, held by suppliers."""
    k = F.col("s_suppkey")
    orgs = F.when(k % 3 == 0, "Ada Byron").otherwise(F.col("s_name"))
    dates = F.when(k % 2 == 0, F.lit("1999-05-17")).otherwise("17.05.2003")
    return views.table(spark, d, "supplier").select(
        F.concat(F.lit("C"), k, F.lit(".example.com")).alias("domain"),
        orgs.alias("org"),
        dates.alias("creation_date"),
        F.lit("Germany").alias("country"),
        F.lit("Berlin").alias("city"),
        F.array(F.lit("Info@reg.example.com"), F.lit("ada.byron@reg.example.com")).alias("emails"),
        F.concat(F.lit("Registrar "), k % 4).alias("registrar"),
    )


@query(
    "lookup_enrich",
    """WITH p AS (SELECT *, c_custkey % 7 <> 0 AND c_custkey // 30 IN (SELECT s_suppkey FROM supplier) AS hit, c_custkey // 30 AS k
         FROM customer JOIN nation ON c_nationkey = n_nationkey)
       SELECT md5('places:P' || c_custkey) AS id,
         CASE WHEN hit AND k % 3 <> 0 THEN 'Supplier#' || lpad(CAST(k AS VARCHAR), 9, '0') END AS trade_name, n_name AS city,
         CASE WHEN hit THEN 'DE' ELSE 'TR' END AS country,
         CAST(CASE WHEN NOT hit THEN NULL WHEN k % 2 = 0 THEN 1999 ELSE 2003 END AS DOUBLE) AS founded,
         CASE WHEN hit THEN 'info@reg.example.com' ELSE '' END AS emails, CASE WHEN hit THEN 'Registrar ' || (k % 4) END AS registrar
       FROM p""",
)
def lookup_enrich(spark, d):
    """Places without trade name and country, filled from the registrations of their host."""
    bare = place_records(spark, d).withColumn(
        "identity",
        F.col("identity").withField("trade_name", F.lit(None).cast("string")).withField("country", F.lit(None).cast("string")),
    )
    enriched = rec.with_default_country(rec.enrich_from_registry(bare, registry(spark, d)))
    return enriched.select(
        "id",
        "identity.trade_name",
        "identity.city",
        "identity.country",
        F.col("business_meta.founding_year_guess").cast("double").alias("founded"),
        F.array_join("contacts.emails_public", ",").alias("emails"),
        F.col("web_presence.ssl_issuer").alias("registrar"),
    )


@query(
    "search_documents",
    """SELECT md5('places:P' || c_custkey) AS id, c_name AS legal_name, n_name AS city,
         '+90212' || lpad(CAST(c_custkey % 10000000 AS VARCHAR), 7, '0') AS phones, '2024-06-01' AS updated
       FROM customer JOIN nation ON c_nationkey = n_nationkey""",
)
def search_documents(spark, d):
    from firmaforge.sources.sinks import search_documents as flatten

    return flatten(place_records(spark, d)).select(
        "id",
        "legal_name",
        "city",
        F.array_join("phones", ",").alias("phones"),
        F.date_format("updated_at", "yyyy-MM-dd").alias("updated"),
    )


@query(
    "daily_pipeline",
    """WITH p AS (SELECT upper(c_name) AS n, upper(left(n_name, 1)) || lower(substr(n_name, 2)) AS city FROM customer JOIN nation ON c_nationkey = n_nationkey)
       SELECT city, count(*) AS companies, count(DISTINCT n) AS names FROM p GROUP BY city""",
)
def daily_pipeline(spark, d):
    """Places and search hits through joining, normalising, matching, enriching and
    flattening, counted by city."""
    from firmaforge.plans.daily import run

    key = F.md5("identity.legal_name")
    hits = search_records(spark, d).withColumn("id", key)
    done = run(place_records(spark, d).withColumn("id", key), registry(spark, d), second=hits)
    return done.documents.groupBy("city").agg(
        F.count("*").alias("companies"), F.countDistinct("legal_name").alias("names")
    )
