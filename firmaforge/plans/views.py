"""Raw company tables derived from the star-schema tables, so that every query has input
that grows with the data: customers become search hits and places, suppliers websites."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from firmaforge.plans.gold import INDUSTRIES
from firmaforge.plans.silver import unify, union_sources
from firmaforge.sources.raw import bronze_places, bronze_search, bronze_websites

AS_OF = "2024-06-01 00:00:00"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def segment_company_type(segment: Column) -> Column:
    return (
        F.when(segment == "AUTOMOBILE", "Anonim Şirket")
        .when(segment == "BUILDING", "Limited Şirket")
        .when(segment == "FURNITURE", "Şahıs Şirketi")
    )


def balance_rating(balance: Column) -> Column:
    return F.round((1 + 4 * (balance + 1000) / 11000).cast("decimal(10,4)"), 1)


def reviews_per_customer(spark: SparkSession, sf_dir: str) -> DataFrame:
    return (
        table(spark, sf_dir, "orders")
        .groupBy(F.col("o_custkey").alias("c_custkey"))
        .agg(F.sum(F.floor(F.col("o_totalprice") / 10000)).cast("bigint").alias("reviews"))
    )


def customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    nation = table(spark, sf_dir, "nation").select(
        F.col("n_nationkey").alias("c_nationkey"), F.col("n_name").alias("city")
    )
    return table(spark, sf_dir, "customer").join(nation, "c_nationkey")


def _stamp(key: Column) -> Column:
    return F.timestamp_seconds(F.lit(1704067200) + key * 60)


def raw_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("c_custkey")
    payload = F.struct(
        F.concat(F.col("c_name"), F.lit(" | Profile")).alias("title"),
        F.concat(F.lit("Firm in "), F.col("city")).alias("snippet"),
        F.concat(F.lit("https://find.example.com/"), key).alias("link"),
        F.col("c_name").alias("company_name"),
        "city",
        segment_company_type(F.col("c_mktsegment")).alias("company_type"),
    )
    return customers(spark, sf_dir).select(
        F.concat(F.lit("https://find.example.com/"), key).alias("source_url"),
        F.lit("google_search").alias("source_type"),
        _stamp(key).alias("fetch_ts"),
        F.to_json(payload).alias("data"),
        F.lit("1.0.0").alias("parser_version"),
        _stamp(key).alias("created_at"),
    )


def host_no(key: F.Column) -> F.Column:
    """Thirty customers share a host, so hosts grow with the customers."""
    return F.floor(key / 30)


def raw_places(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The untyped half of the customers has a place with rating and reviews."""
    key = F.col("c_custkey")
    site = F.concat(F.lit("https://www.c"), host_no(key), F.lit(".example.com/"), key)
    payload = F.struct(
        F.col("c_name").alias("name"),
        F.concat(F.lit("Street "), key, F.lit(", "), F.col("city"), F.lit(", TR")).alias("formatted_address"),
        F.concat(F.lit("0212 "), F.lpad((key % 10000000).cast("string"), 7, "0")).alias("formatted_phone_number"),
        F.when(key % 7 != 0, site).alias("website"),
        balance_rating(F.col("c_acctbal")).cast("string").alias("rating"),
        F.col("reviews").cast("string").alias("user_ratings_total"),
        F.array(F.lower("c_mktsegment"), F.lit("establishment")).alias("types"),
        F.lit("OPERATIONAL").alias("business_status"),
    )
    return (
        customers(spark, sf_dir)
        .join(reviews_per_customer(spark, sf_dir), "c_custkey", "left")
        .select(
            F.concat(F.lit("P"), key).alias("place_id"),
            F.lit("google_places").alias("source_type"),
            _stamp(key).alias("fetch_ts"),
            F.to_json(payload).alias("data"),
            F.lit("1.0.0").alias("parser_version"),
            _stamp(key).alias("created_at"),
        )
    )


def raw_websites(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers as websites; the key picks the industry whose keywords the page carries."""
    key = F.col("s_suppkey")
    words = F.lit(None).cast("array<string>")
    for i, terms in enumerate(INDUSTRIES.values()):
        words = F.when(key % 12 == i, F.array(*[F.lit(t) for t in terms])).otherwise(words)
    host = F.concat(F.lit("s"), key, F.lit(".example.org"))
    payload = F.struct(
        F.col("s_name").alias("company_name"),
        F.concat(F.col("s_name"), F.lit(" - Home")).alias("title"),
        F.concat(F.lit("Supplier "), key).alias("meta_description"),
        F.array(F.concat(F.lit("info@"), host), F.concat(F.lit("sales@"), host)).alias("emails"),
        F.array(F.concat(F.lit("+90216"), F.lpad((key % 10000000).cast("string"), 7, "0"))).alias("phones"),
        F.concat(F.lit("Cad. "), key, F.lit(", Kat 2")).alias("address"),
        F.create_map(F.lit("linkedin"), F.concat(F.lit("https://linkedin.com/company/s"), key)).alias("social_links"),
        words.alias("keywords"),
    )
    return table(spark, sf_dir, "supplier").select(
        F.concat(F.lit("https://www."), host, F.lit("/")).alias("website_url"),
        F.lit("website").alias("source_type"),
        _stamp(key).alias("fetch_ts"),
        F.to_json(payload).alias("data"),
        F.when(key % 9 == 0, 404).otherwise(200).cast("int").alias("status_code"),
        F.lit("1.0.0").alias("parser_version"),
        _stamp(key).alias("created_at"),
    )


def union_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    return union_sources(
        bronze_search(raw_search(spark, sf_dir), AS_OF),
        bronze_places(raw_places(spark, sf_dir), AS_OF),
        bronze_websites(raw_websites(spark, sf_dir), AS_OF),
    )


def silver_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    return unify(union_view(spark, sf_dir), AS_OF)


def company_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Companies with one row per customer: the input of gold, facets, filters and search."""
    key = F.col("c_custkey")
    days = (key % 120).cast("int")
    industry_words = F.array(*[F.array(*[F.lit(t) for t in terms]) for terms in INDUSTRIES.values()])
    mailbox = F.concat(F.lit("info@c"), host_no(key), F.lit(".example.com"))
    person = F.concat(F.lit("ada.byron@c"), host_no(key), F.lit(".example.com"))
    no_texts = F.array().cast("array<string>")
    return (
        customers(spark, sf_dir)
        .join(reviews_per_customer(spark, sf_dir), "c_custkey", "left")
        .select(
            F.md5(key.cast("string")).alias("company_id"),
            key.alias("company_no"),
            F.col("c_name").alias("legal_name"),
            F.when(key % 5 == 0, F.concat(F.lit("Trade "), F.col("city"))).alias("trade_name"),
            "city",
            segment_company_type(F.col("c_mktsegment")).alias("company_type"),
            F.when(key % 7 != 0, F.concat(F.lit("c"), host_no(key), F.lit(".example.com"))).alias("website_domain"),
            balance_rating(F.col("c_acctbal")).cast("double").alias("rating"),
            F.col("reviews").alias("total_reviews"),
            F.when(key % 3 == 0, no_texts)
            .when(key % 3 == 1, F.array(mailbox))
            .otherwise(F.array(mailbox, person))
            .alias("emails"),
            F.when(key % 4 == 0, F.lit(None).cast("array<string>"))
            .otherwise(F.array(F.concat(F.lit("0212"), F.lpad((key % 10000000).cast("string"), 7, "0"))))
            .alias("phones"),
            F.when(key % 6 != 0, F.concat(F.lit("Cad. "), key, F.lit(" "), F.col("city"))).alias("address"),
            F.when(key % 11 < 10, F.element_at(industry_words, (key % 11 + 1).cast("int"))).alias("keywords"),
            F.when(key % 8 == 0, F.array(F.lit("website")))
            .otherwise(F.array(F.lit("google_places"), F.lit("google_search")))
            .alias("data_sources"),
            ((key % 100) / 100.0).alias("confidence_score"),
            F.expr("timestamp'2024-06-01 00:00:00'").cast("timestamp").alias("_end"),
            days.alias("_days"),
        )
        .withColumn("last_updated", F.timestamp_seconds(F.unix_timestamp("_end") - F.col("_days") * 86400))
        .drop("_end", "_days")
    )
