"""Gold: marketing segments per company and three families of metrics over them."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from firmaforge.session import cut

# Industries with the keywords that reveal them, first hit wins.
INDUSTRIES = {
    "Technology": ["yazılım", "software", "bilişim", "teknoloji", "tech"],
    "E-Commerce": ["e-ticaret", "ecommerce", "online", "satış", "mağaza"],
    "Consulting": ["danışmanlık", "consulting", "consultancy", "müşavirlik"],
    "Manufacturing": ["üretim", "imalat", "fabrika", "manufacturing", "production"],
    "Logistics": ["lojistik", "nakliye", "kargo", "taşımacılık", "logistics"],
    "Tourism": ["turizm", "otel", "tourism", "travel", "seyahat"],
    "Education": ["eğitim", "education", "okul", "kurs", "training"],
    "Healthcare": ["sağlık", "health", "medical", "hastane", "klinik"],
    "Construction": ["inşaat", "construction", "yapı", "müteahhit"],
    "Food & Beverage": ["gıda", "food", "restoran", "yemek", "restaurant"],
}

# Advice per priority tier.
RECOMMENDATIONS = {
    "A": "High-value target for direct outreach",
    "B": "Good candidate for email marketing",
    "C": "Nurture with content marketing",
    "D": "Low priority - monitor only",
}


def contains_all(array: Column, items: list[str]) -> Column:
    wanted = F.array(*[F.lit(x) for x in items])
    return F.size(F.array_except(wanted, array)) == 0


def contains_any(array: Column, items: list[str]) -> Column:
    return F.arrays_overlap(array, F.array(*[F.lit(x) for x in items]))


def industry(keywords: Column, match: str = "all") -> Column:
    """``match='all'`` needs every keyword of an industry, ``'any'`` needs one."""
    test = {"all": contains_all, "any": contains_any}[match]
    out = None
    for name, words in INDUSTRIES.items():
        hit = test(keywords, words)
        out = F.when(hit, name) if out is None else out.when(hit, name)
    return out.otherwise("Other")


def company_size(company_type: Column, reviews: Column) -> Column:
    return (
        F.when(company_type == "Anonim Şirket", "Large")
        .when(reviews > 1000, "Large")
        .when(reviews.between(100, 1000), "Medium")
        .when(reviews.between(10, 100), "Small")
        .when((company_type == "Limited Şirket") & (reviews < 10), "Small")
        .when(company_type == "Şahıs Şirketi", "Micro")
        .otherwise("Unknown")
    )


def engagement_level(rating: Column, reviews: Column) -> Column:
    return (
        F.when((rating >= 4.5) & (reviews > 50), "High")
        .when((rating >= 4.0) & (reviews > 20), "Medium")
        .when(rating >= 3.5, "Low")
        .otherwise("Very Low")
    )


def engagement_score(rating: Column, reviews: Column) -> Column:
    return F.coalesce(rating * F.log10(reviews + 1), F.lit(0.0))


def priority_tier(size: Column, engagement: Column, domain: Column) -> Column:
    return (
        F.when(size.isin("Large", "Medium") & engagement.isin("High", "Medium") & domain.isNotNull(), "A")
        .when(size.isin("Medium", "Small") & engagement.isin("Medium", "Low") & domain.isNotNull(), "B")
        .when((size == "Small") & (engagement == "Low"), "C")
        .otherwise("D")
    )


def segment_label(city: Column, ind: Column, size: Column, engagement: Column) -> Column:
    return F.concat(
        F.coalesce(city, F.lit("Unknown")),
        F.lit(" - "),
        ind,
        F.lit(" - "),
        size,
        F.lit(" - "),
        engagement,
        F.lit(" Engagement"),
    )


def rounded(c: Column, places: int = 2) -> Column:
    """Half away from zero on a decimal, as numeric rounding in SQL databases does."""
    return F.round(c.cast("decimal(24,8)"), places).cast("double")


def segments(
    companies: DataFrame, as_of: datetime | str | None = None, match: str = "all", ordered: bool = True
) -> DataFrame:
    """Classify every company. One projection: no self-join, no shuffle but the final sort."""
    c = F.col
    created = F.current_timestamp() if as_of is None else F.lit(as_of).cast("timestamp")
    out = (
        companies.withColumns(
            {
                "industry": industry(c("keywords"), match),
                "company_size": company_size(c("company_type"), c("total_reviews")),
                "engagement_level": engagement_level(c("rating"), c("total_reviews")),
            }
        )
        .withColumn("priority_tier", priority_tier(c("company_size"), c("engagement_level"), c("website_domain")))
        .select(
            "company_id",
            "legal_name",
            "city",
            "company_type",
            "website_domain",
            "industry",
            "company_size",
            "engagement_level",
            rounded(engagement_score(c("rating"), c("total_reviews"))).alias("engagement_score"),
            "rating",
            "total_reviews",
            F.nullif(F.size("emails"), F.lit(0)).alias("email_count"),
            F.nullif(F.size("data_sources"), F.lit(0)).alias("data_source_count"),
            segment_label(c("city"), c("industry"), c("company_size"), c("engagement_level")).alias("segment"),
            "priority_tier",
            F.element_at(
                F.create_map(*[F.lit(x) for kv in RECOMMENDATIONS.items() for x in kv]), c("priority_tier")
            ).alias("marketing_recommendation"),
            "last_updated",
            created.alias("created_at"),
        )
    )
    if ordered:
        out = out.orderBy(F.asc("priority_tier"), F.desc_nulls_first("engagement_score"))
    return out


def _count_if(cond: Column) -> Column:
    return F.count(F.when(cond, 1))


def _percent(part: Column, whole: Column) -> Column:
    share = part.cast("decimal(20,0)") / whole.cast("decimal(20,0)") * 100
    return F.round(share, 2).cast("double")


def segment_metrics(seg: DataFrame) -> DataFrame:
    return seg.groupBy("segment", "city", "industry", "company_size", "priority_tier").agg(
        F.count("*").alias("company_count"),
        F.avg("rating").alias("avg_rating"),
        F.sum("total_reviews").alias("total_reviews"),
        F.avg("engagement_score").alias("avg_engagement_score"),
        F.countDistinct("website_domain").alias("unique_domains"),
        F.avg("email_count").alias("avg_emails_per_company"),
    )


def city_metrics(seg: DataFrame) -> DataFrame:
    high = F.col("priority_tier").isin("A", "B")
    return (
        seg.filter(F.col("city").isNotNull())
        .groupBy("city")
        .agg(
            F.count("*").alias("total_companies"),
            F.countDistinct("industry").alias("industry_diversity"),
            F.avg("rating").alias("city_avg_rating"),
            F.sum("total_reviews").alias("city_total_reviews"),
            _count_if(high).alias("high_value_companies"),
        )
        .withColumn("high_value_percentage", _percent(F.col("high_value_companies"), F.col("total_companies")))
    )


def industry_metrics(seg: DataFrame) -> DataFrame:
    return (
        seg.groupBy("industry")
        .agg(
            F.count("*").alias("total_companies"),
            F.countDistinct("city").alias("city_coverage"),
            F.avg("rating").alias("industry_avg_rating"),
            F.avg("engagement_score").alias("industry_avg_engagement"),
            _count_if(F.col("company_size").isin("Large", "Medium")).alias("large_medium_companies"),
            _count_if(F.col("website_domain").isNotNull()).alias("companies_with_website"),
        )
        .withColumn(
            "website_coverage_percentage", _percent(F.col("companies_with_website"), F.col("total_companies"))
        )
    )


def city_tier(percent: Column) -> Column:
    return F.when(percent > 30, "A").when(percent > 20, "B").when(percent > 10, "C").otherwise("D")


def industry_tier(large_medium: Column, coverage: Column) -> Column:
    return (
        F.when((large_medium > 10) & (coverage > 50), "A")
        .when((large_medium > 5) & (coverage > 30), "B")
        .when(coverage > 20, "C")
        .otherwise("D")
    )


METRIC_COLUMNS = {
    "metric_type": "string",
    "metric_name": "string",
    "count": "bigint",
    "avg_rating": "double",
    "total_reviews": "bigint",
    "avg_engagement": "double",
    "unique_domains": "bigint",
    "avg_emails": "double",
    "percentage": "double",
    "priority_tier": "string",
    "calculated_at": "timestamp",
}


def metrics(seg: DataFrame, as_of: datetime | str | None = None) -> DataFrame:
    """Segment, city and industry metrics in one layout, ordered for reading.

    The classified companies are written first: three groupings read them.
    """
    seg = cut(seg)
    c = F.col
    at = F.current_timestamp() if as_of is None else F.lit(as_of)

    def shaped(df: DataFrame, kind: str, **columns: Column) -> DataFrame:
        columns = {"metric_type": F.lit(kind), "calculated_at": at, **columns}
        return df.select(
            *[columns.get(n, F.lit(None)).cast(t).alias(n) for n, t in METRIC_COLUMNS.items()]
        )

    by_segment = shaped(
        segment_metrics(seg),
        "segment",
        metric_name=c("segment"),
        count=c("company_count"),
        avg_rating=rounded(c("avg_rating")),
        total_reviews=c("total_reviews"),
        avg_engagement=rounded(c("avg_engagement_score")),
        unique_domains=c("unique_domains"),
        avg_emails=rounded(c("avg_emails_per_company")),
        priority_tier=c("priority_tier"),
    )
    by_city = shaped(
        city_metrics(seg),
        "city",
        metric_name=c("city"),
        count=c("total_companies"),
        avg_rating=rounded(c("city_avg_rating")),
        total_reviews=c("city_total_reviews"),
        percentage=c("high_value_percentage"),
        priority_tier=city_tier(c("high_value_percentage")),
    )
    by_industry = shaped(
        industry_metrics(seg),
        "industry",
        metric_name=c("industry"),
        count=c("total_companies"),
        avg_rating=rounded(c("industry_avg_rating")),
        avg_engagement=rounded(c("industry_avg_engagement")),
        unique_domains=c("companies_with_website"),
        percentage=c("website_coverage_percentage"),
        priority_tier=industry_tier(c("large_medium_companies"), c("website_coverage_percentage")),
    )
    return by_segment.unionByName(by_city).unionByName(by_industry).orderBy(
        "metric_type", "priority_tier", F.desc("count")
    )
