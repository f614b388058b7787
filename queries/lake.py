"""Bronze, silver, gold and analytics."""

from __future__ import annotations

from pyspark.sql import functions as F

from firmaforge.operators import facets as facet_ops
from firmaforge.plans import gold, silver, views
from firmaforge.session import cut
from firmaforge.sources import raw
from queries.company_sql import ADVICE_CASE, COMPANY, RATING, SEGMENTS, SOURCES
from queries.registry import query


def segments(spark, d, ordered=False):
    return gold.segments(views.company_view(spark, d), views.AS_OF, ordered=ordered)


@query(
    "bronze_events_json",
    """SELECT event_id, event_type, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k,
         json_extract_string(props, '$.k') AS k_text FROM events""",
)
def bronze_events_json(spark, d):
    events = views.table(spark, d, "events").withColumn("k_text", raw.json_text("props", "$.k"))
    return raw.json_fields(events, "props", "k int", ["event_id", "event_type", "k_text"])


@query(
    "bronze_search",
    """SELECT 'https://find.example.com/' || c_custkey AS source_url, c_name || ' | Profile' AS title,
         'Firm in ' || n_name AS snippet, c_name AS company_name, n_name AS city
       FROM customer JOIN nation ON c_nationkey = n_nationkey""",
)
def bronze_search(spark, d):
    return raw.bronze_search(views.raw_search(spark, d), views.AS_OF).select(
        "source_url", "title", "snippet", "company_name", "city"
    )


@query(
    "bronze_places",
    f"""WITH rev AS (SELECT o_custkey, CAST(sum(floor(o_totalprice / 10000)) AS INTEGER) AS reviews FROM orders GROUP BY 1)
        SELECT 'P' || c_custkey AS place_id, c_name AS business_name, {RATING} AS rating, reviews AS reviews_count,
          lower(c_mktsegment) || ',establishment' AS types, 'OPERATIONAL' AS business_status
        FROM customer LEFT JOIN rev ON o_custkey = c_custkey""",
)
def bronze_places(spark, d):
    return raw.bronze_places(views.raw_places(spark, d), views.AS_OF).select(
        "place_id",
        "business_name",
        F.col("rating").cast("double").alias("rating"),
        "reviews_count",
        F.array_join("business_types", ",").alias("types"),
        "business_status",
    )


@query(
    "bronze_websites",
    """SELECT 'https://www.s' || s_suppkey || '.example.org/' AS website_url,
         CAST(CASE WHEN s_suppkey % 9 = 0 THEN 404 ELSE 200 END AS INTEGER) AS status_code,
         s_name || ' - Home' AS page_title,
         'info@s' || s_suppkey || '.example.org,sales@s' || s_suppkey || '.example.org' AS emails,
         'https://linkedin.com/company/s' || s_suppkey AS linkedin FROM supplier""",
)
def bronze_websites(spark, d):
    return raw.bronze_websites(views.raw_websites(spark, d), views.AS_OF).select(
        "website_url",
        "status_code",
        "page_title",
        F.array_join("emails", ",").alias("emails"),
        F.col("social_links")["linkedin"].alias("linkedin"),
    )


@query(
    "bronze_incremental_upsert",
    """SELECT user_id, event_id, event_type, value FROM events
       QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1""",
)
def bronze_incremental_upsert(spark, d):
    """What a first load kept of the early half, then one incremental load of the rest."""
    events = views.table(spark, d, "events")
    bounds = events.agg(F.min("ts").alias("lo"), F.max("ts").alias("hi")).first()
    middle = bounds["lo"] + (bounds["hi"] - bounds["lo"]) / 2
    loaded = raw.incremental_load(events.filter(F.col("ts") <= middle), None, ["user_id"], "ts", ["ts", "event_id"])
    merged = raw.incremental_load(events, loaded, ["user_id"], "ts", ["ts", "event_id"])
    return merged.select("user_id", "event_id", "event_type", "value")


@query(
    "silver_union_sources",
    f"""WITH {SOURCES} SELECT legal_name, city, company_type, source_url, website, array_to_string(phones, ',') AS phones,
          address, rating, CAST(reviews_count AS DOUBLE) AS reviews_count, array_to_string(emails, ',') AS emails,
          array_to_string(keywords, ',') AS keywords, source_type FROM unioned""",
)
def silver_union_sources(spark, d):
    arrays = ("phones", "emails", "keywords")
    return views.union_view(spark, d).select(
        *[F.array_join(c, ",").alias(c) if c in arrays else c for c in silver.UNION_COLUMNS if c not in ("social_links", "processed_at")]
    ).withColumn("reviews_count", F.col("reviews_count").cast("double"))


_UNIFY = f"""WITH {SOURCES},
keyed AS (SELECT upper(trim(legal_name)) AS legal_name,
    upper(left(trim(city), 1)) || lower(substr(trim(city), 2)) AS city, * EXCLUDE (legal_name, city) FROM unioned),
grouped AS (SELECT legal_name, city, company_type,
    min(regexp_replace(website, '^https?://(www\\.)?', '')) AS site, min(website) AS first_site,
    string_agg(DISTINCT website, ', ' ORDER BY website) AS websites,
    list_sort(list_distinct(flatten(list(phones) FILTER (phones IS NOT NULL)))) AS phones,
    max(address) AS address, round(CAST(sum(CAST(rating AS DECIMAL(12,6))) / count(rating) AS DECIMAL(18,6)), 1) AS rating,
    sum(reviews_count) AS total_reviews,
    list_sort(list_distinct(flatten(list(emails) FILTER (emails IS NOT NULL)))) AS emails,
    list_sort(list_distinct(flatten(list(keywords) FILTER (keywords IS NOT NULL)))) AS keywords,
    string_agg(DISTINCT source_type, ',' ORDER BY source_type) AS data_sources,
    string_agg(DISTINCT social_links, ',') AS social
  FROM keyed GROUP BY ALL)
SELECT md5(concat_ws('|', legal_name, upper(coalesce(city, '')), coalesce(company_type, ''), coalesce(site, ''))) AS company_id,
  legal_name, city, company_type, websites,
  nullif(regexp_extract(first_site, '^(?:https?://)?(?:www\\.)?([^/:?#\\s]+)', 1), '') AS website_domain,
  nullif(array_to_string(phones, ', '), '') AS phones, address, CAST(rating AS DOUBLE) AS rating,
  CAST(total_reviews AS DOUBLE) AS total_reviews, coalesce(array_to_string(emails, ','), '') AS emails,
  coalesce(array_to_string(keywords[1:20], ','), '') AS top_keywords, data_sources,
  json_extract_string(social, '$.linkedin') AS linkedin
FROM grouped"""


_ITEMS = " UNION ".join(
    f"SELECT legal_name, city, company_type, '{kind}' AS kind, {item} AS item FROM keyed"
    for kind, item in {
        "website": "website", "phone": "unnest(phones)", "email": "unnest(emails)", "social": "social_links",
        "keyword": "unnest(keywords)", "source": "source_type",
    }.items()
)


@query(
    "silver_items",
    f"""WITH {SOURCES}, keyed AS (SELECT upper(trim(legal_name)) AS legal_name,
          upper(left(trim(city), 1)) || lower(substr(trim(city), 2)) AS city, * EXCLUDE (legal_name, city) FROM unioned)
        SELECT * FROM ({_ITEMS}) WHERE item IS NOT NULL""",
)
def silver_items(spark, d):
    """What silver companies gather into arrays, one row per item."""
    return silver.company_items(views.union_view(spark, d))


def _unified(companies):
    return companies.select(
        "company_id",
        "legal_name",
        "city",
        "company_type",
        "websites",
        "website_domain",
        "phones",
        "address",
        "rating",
        F.col("total_reviews").cast("double").alias("total_reviews"),
        F.array_join("emails", ",").alias("emails"),
        F.array_join("top_keywords", ",").alias("top_keywords"),
        F.array_join("data_sources", ",").alias("data_sources"),
        F.try_element_at("social_links", F.lit(1))["linkedin"].alias("linkedin"),
    )


@query("silver_unify", _UNIFY)
def silver_unify(spark, d):
    return _unified(views.silver_view(spark, d))


@query("silver_two_loads", _UNIFY)
def silver_two_loads(spark, d):
    """The same from stored item rows of a first load, merged with those of a second."""
    records = views.union_view(spark, d)
    second = F.pmod(F.xxhash64("legal_name", "source_type"), F.lit(3)) == 0
    stored = cut(silver.item_sums(records.filter(~second)))
    merged = cut(silver.merge_item_sums(stored, silver.item_sums(records.filter(second))))
    return _unified(silver.unify_sums(merged, views.AS_OF))


@query(
    "silver_array_unnest",
    f"""WITH {COMPANY}, kw AS (SELECT company_no, unnest(keywords) AS keyword FROM company)
        SELECT company.company_no, keyword FROM company LEFT JOIN kw ON kw.company_no = company.company_no""",
)
def silver_array_unnest(spark, d):
    return silver.unnest(views.company_view(spark, d).select("company_no", "keywords"), "keywords", "keyword")


_SEGMENT_COLUMNS = [
    "company_id", "legal_name", "city", "company_type", "website_domain", "industry", "company_size",
    "engagement_level", "engagement_score", "rating", "total_reviews", "email_count",
    "data_source_count", "segment", "priority_tier",
]


@query(
    "gold_segments",
    f"WITH {SEGMENTS} SELECT * REPLACE (CAST(email_count AS DOUBLE) AS email_count) FROM (SELECT {', '.join(_SEGMENT_COLUMNS)}, {ADVICE_CASE} AS marketing_recommendation FROM segments)",
)
def gold_segments(spark, d):
    return segments(spark, d, ordered=True).select(*_SEGMENT_COLUMNS, "marketing_recommendation").withColumn(
        "email_count", F.col("email_count").cast("double")
    )


@query(
    "gold_from_raw",
    _UNIFY.replace("SELECT md5(", ", silver AS (SELECT md5(")
    + """) SELECT coalesce(city, 'Unknown') AS city, count(*) AS companies, CAST(sum(total_reviews) AS DOUBLE) AS reviews,
         count(*) FILTER (company_type = 'Anonim Şirket' OR total_reviews >= 100) AS large_or_medium
       FROM silver GROUP BY 1""",
)
def gold_from_raw(spark, d):
    """The whole way from raw JSON to segments, then rolled up by city."""
    seg = gold.segments(views.silver_view(spark, d), views.AS_OF, ordered=False)
    return seg.groupBy(F.coalesce("city", F.lit("Unknown")).alias("city")).agg(
        F.count("*").alias("companies"),
        F.sum("total_reviews").cast("double").alias("reviews"),
        F.count_if(F.col("company_size").isin("Large", "Medium")).alias("large_or_medium"),
    )


@query(
    "gold_industry_any",
    f"""WITH {SEGMENTS} SELECT industry, count(*) AS n FROM segments GROUP BY 1""",
)
def gold_industry_any(spark, d):
    """Two of three companies keep one keyword only, which is enough for any-of and not for all-of."""
    companies = views.company_view(spark, d)
    some = F.when(F.col("company_no") % 3 == 0, F.col("keywords")).otherwise(F.slice("keywords", 1, 1))
    return (
        gold.segments(companies.withColumn("keywords", some), views.AS_OF, match="any", ordered=False)
        .groupBy("industry")
        .agg(F.count("*").alias("n"))
    )


def _r(expr: str, places: int = 4) -> str:
    return f"CAST(round(CAST({expr} AS DECIMAL(24,8)), {places}) AS DOUBLE)"


@query(
    "gold_segment_metrics",
    f"""WITH {SEGMENTS} SELECT segment, city, industry, company_size, priority_tier, count(*) AS company_count,
          {_r('avg(rating)')} AS avg_rating, CAST(sum(total_reviews) AS BIGINT) AS total_reviews,
          {_r('avg(engagement_score)')} AS avg_engagement_score, count(DISTINCT website_domain) AS unique_domains,
          {_r('avg(email_count)')} AS avg_emails_per_company
        FROM segments GROUP BY ALL""",
)
def gold_segment_metrics(spark, d):
    doubles = ("avg_rating", "avg_engagement_score", "avg_emails_per_company")
    return gold.segment_metrics(segments(spark, d)).withColumns({c: gold.rounded(F.col(c), 4) for c in doubles})


_PERCENT = "CAST(round(100 * CAST({} AS DECIMAL(24,10)) / count(*), 2) AS DOUBLE)"


@query(
    "gold_city_metrics",
    f"""WITH {SEGMENTS} SELECT city, count(*) AS total_companies, count(DISTINCT industry) AS industry_diversity,
          {_r('avg(rating)')} AS city_avg_rating, CAST(sum(total_reviews) AS BIGINT) AS city_total_reviews,
          count(*) FILTER (priority_tier IN ('A', 'B')) AS high_value_companies,
          {_PERCENT.format("count(*) FILTER (priority_tier IN ('A', 'B'))")} AS high_value_percentage
        FROM segments WHERE city IS NOT NULL GROUP BY city""",
)
def gold_city_metrics(spark, d):
    return gold.city_metrics(segments(spark, d)).withColumn("city_avg_rating", gold.rounded(F.col("city_avg_rating"), 4))


@query(
    "gold_industry_metrics",
    f"""WITH {SEGMENTS} SELECT industry, count(*) AS total_companies, count(DISTINCT city) AS city_coverage,
          {_r('avg(rating)')} AS industry_avg_rating, {_r('avg(engagement_score)')} AS industry_avg_engagement,
          count(*) FILTER (company_size IN ('Large', 'Medium')) AS large_medium_companies,
          count(website_domain) AS companies_with_website,
          {_PERCENT.format('count(website_domain)')} AS website_coverage_percentage
        FROM segments GROUP BY industry""",
)
def gold_industry_metrics(spark, d):
    doubles = ("industry_avg_rating", "industry_avg_engagement")
    return gold.industry_metrics(segments(spark, d)).withColumns({c: gold.rounded(F.col(c), 4) for c in doubles})


@query(
    "gold_metrics_union",
    f"""WITH {SEGMENTS},
    by_city AS (SELECT city, count(*) AS n, avg(rating) AS r, sum(total_reviews) AS t,
        round(100 * CAST(count(*) FILTER (priority_tier IN ('A', 'B')) AS DECIMAL(24,10)) / count(*), 2) AS p
      FROM segments WHERE city IS NOT NULL GROUP BY city),
    by_industry AS (SELECT industry, count(*) AS n, avg(rating) AS r, avg(engagement_score) AS e,
        count(*) FILTER (company_size IN ('Large', 'Medium')) AS big, count(website_domain) AS w,
        round(100 * CAST(count(website_domain) AS DECIMAL(24,10)) / count(*), 2) AS p
      FROM segments GROUP BY industry)
    SELECT 'segment' AS metric_type, segment AS metric_name, count(*) AS count, {_r('avg(rating)', 2)} AS avg_rating,
      CAST(sum(total_reviews) AS DOUBLE) AS total_reviews, {_r('avg(engagement_score)', 2)} AS avg_engagement,
      CAST(count(DISTINCT website_domain) AS DOUBLE) AS unique_domains, {_r('avg(email_count)', 2)} AS avg_emails,
      CAST(NULL AS DOUBLE) AS percentage, priority_tier
    FROM segments GROUP BY segment, city, industry, company_size, priority_tier
    UNION ALL
    SELECT 'city', city, n, {_r('r', 2)}, CAST(t AS DOUBLE), NULL, NULL, NULL, CAST(p AS DOUBLE),
      CASE WHEN p > 30 THEN 'A' WHEN p > 20 THEN 'B' WHEN p > 10 THEN 'C' ELSE 'D' END FROM by_city
    UNION ALL
    SELECT 'industry', industry, n, {_r('r', 2)}, NULL, {_r('e', 2)}, w, NULL, CAST(p AS DOUBLE),
      CASE WHEN big > 10 AND p > 50 THEN 'A' WHEN big > 5 AND p > 30 THEN 'B' WHEN p > 20 THEN 'C' ELSE 'D' END
    FROM by_industry""",
)
def gold_metrics_union(spark, d):
    return gold.metrics(segments(spark, d), views.AS_OF).drop("calculated_at").withColumns(
        {c: F.col(c).cast("double") for c in ("total_reviews", "unique_domains")}
    )


@query(
    "analytics_summary",
    f"""WITH {SEGMENTS}, stats AS (SELECT count(DISTINCT company_id) AS total_companies, count(DISTINCT city) AS cities_covered,
          count(DISTINCT industry) AS industries_count,
          avg(CASE WHEN email_count > 0 THEN 1 ELSE 0 END) AS email, avg(CASE WHEN website_domain IS NOT NULL THEN 1 ELSE 0 END) AS web,
          max(last_updated) AS last_update FROM segments)
        SELECT total_companies, cities_covered, industries_count, round(email, 6) AS email_coverage,
          round(web, 6) AS website_coverage, strftime(last_update, '%Y-%m-%d') AS last_update,
          round((email * 0.3 + web * 0.3 + CASE WHEN total_companies > 1000 THEN 0.4 ELSE total_companies / 2500 END) * 100, 2) AS data_quality_score
        FROM stats""",
)
def analytics_summary(spark, d):
    scored = facet_ops.data_quality_score(facet_ops.global_stats(segments(spark, d)))
    return scored.select(
        "total_companies",
        "cities_covered",
        "industries_count",
        F.round("email_coverage", 6).alias("email_coverage"),
        F.round("website_coverage", 6).alias("website_coverage"),
        F.date_format("last_update", "yyyy-MM-dd").alias("last_update"),
        "data_quality_score",
    )


@query(
    "analytics_distributions",
    f"""WITH {SEGMENTS} SELECT 'industry' AS dimension, industry AS value, count(*) AS count FROM segments GROUP BY ALL
        UNION ALL SELECT 'company_size', company_size, count(*) FROM segments GROUP BY ALL
        UNION ALL SELECT 'priority_tier', priority_tier, count(*) FROM segments GROUP BY ALL""",
)
def analytics_distributions(spark, d):
    return facet_ops.distributions(segments(spark, d))
