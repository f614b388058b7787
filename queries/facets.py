"""Filters, facets, buckets, histograms, sorting and paging over the company view."""

from __future__ import annotations

from pyspark.sql import functions as F

from firmaforge.operators import facets as f
from firmaforge.operators import filters as fl
from firmaforge.operators.ranking import ordered_by, page
from firmaforge.plans import gold, views
from firmaforge.session import new_shared_path
from queries.company_sql import COMPANY, SEGMENTS
from queries.lake import segments
from queries.registry import query


def enriched(spark, d):
    """Company view with its classification beside the raw columns."""
    c = F.col
    return (
        views.company_view(spark, d)
        .withColumns(
            {
                "industry": gold.industry(c("keywords")),
                "company_size": gold.company_size(c("company_type"), c("total_reviews")),
                "engagement_level": gold.engagement_level(c("rating"), c("total_reviews")),
                "engagement_score": gold.rounded(gold.engagement_score(c("rating"), c("total_reviews"))),
                "social_links": F.when(
                    c("company_no") % 4 == 1, F.create_map(F.lit("x"), F.concat(F.lit("https://x.com/"), c("company_no")))
                ).when(c("company_no") % 4 == 2, F.create_map().cast("map<string,string>")),
            }
        )
        .withColumn("priority_tier", gold.priority_tier(c("company_size"), c("engagement_level"), c("website_domain")))
    )


@query(
    "filter_compound",
    f"""WITH {SEGMENTS} SELECT company_no FROM segments WHERE city IN ('NATION_1', 'NATION_2', 'NATION_3')
          AND priority_tier = 'A' AND rating >= 3 AND rating <= 4.8 AND list_contains(data_sources, 'google_places')
          AND list_has_any(keywords, ['otel', 'tech'])""",
)
def filter_compound(spark, d):
    df = enriched(spark, d)
    asked = {
        "city": ["NATION_1", "NATION_2", "NATION_3"],
        "priority_tier": "A",
        "rating": {"min": 3, "max": 4.8},
        "data_sources": "google_places",
        "keywords": ["otel", "tech"],
    }
    return df.filter(fl.compile_filters(df, asked)).select("company_no")


@query(
    "filter_should",
    f"""WITH {SEGMENTS} SELECT company_no FROM segments WHERE rating IS NOT NULL AND len(emails) > 0 AND
          CAST(city = 'NATION_1' AS INT) + CAST(industry = 'Tourism' AS INT) + CAST(rating >= 4 AS INT) >= 2""",
)
def filter_should(spark, d):
    df = enriched(spark, d)
    wanted = [fl.term(df, "city", "NATION_1"), fl.term(df, "industry", "Tourism"), fl.value_range("rating", low=4)]
    cond = fl.boolean_query(filter_=[fl.present(df, "rating"), fl.present(df, "emails")], should=wanted, minimum_should_match=2)
    return df.filter(cond).select("company_no")


@query(
    "segment_search",
    f"""WITH {SEGMENTS} SELECT segment, count(*) AS count, round(avg(rating), 4) AS avg_rating,
          round(avg(engagement_score), 4) AS avg_engagement, count(company_id) AS company_count
        FROM segments WHERE priority_tier = 'A' AND rating >= 4 GROUP BY segment ORDER BY count DESC, segment LIMIT 50""",
)
def segment_search(spark, d):
    hits = fl.segment_filter(segments(spark, d), priority_tier="A", min_rating=4.0)
    return f.segment_terms(hits).withColumns({c: F.round(c, 4) for c in ("avg_rating", "avg_engagement")})


@query(
    "high_value",
    f"""WITH {SEGMENTS} SELECT company_no, engagement_score FROM segments WHERE total_reviews >= 50 AND rating >= 4
          AND priority_tier IN ('A', 'B') AND website_domain IS NOT NULL AND len(emails) > 0
        ORDER BY engagement_score DESC, total_reviews DESC, company_id LIMIT 100""",
)
def high_value(spark, d):
    return fl.high_value_targets(enriched(spark, d)).select("company_no", "engagement_score")


@query(
    "recent_updates",
    f"""WITH {COMPANY} SELECT company_no, strftime(last_updated, '%Y-%m-%d') AS day FROM company
        WHERE last_updated >= TIMESTAMP '2024-05-25' AND confidence_score >= 0.8 ORDER BY last_updated DESC, company_id LIMIT 50""",
)
def recent_updates(spark, d):
    hits = fl.recent_updates(views.company_view(spark, d), as_of=views.AS_OF)
    return hits.select("company_no", F.date_format("last_updated", "yyyy-MM-dd").alias("day"))


@query(
    "geo_radius",
    """WITH p AS (SELECT c_custkey, 36 + (c_custkey * 37 % 600) / 100.0 AS lat, 26 + (c_custkey * 91 % 1900) / 100.0 AS lon FROM customer),
       d AS (SELECT *, 2 * 6371.0088 * asin(sqrt(least(1.0, pow(sin(radians(lat - 39.93) / 2), 2)
         + cos(radians(lat)) * cos(radians(39.93)) * pow(sin(radians(lon - 32.86) / 2), 2)))) AS km FROM p)
       SELECT c_custkey, round(km, 4) AS km FROM d WHERE km <= 200""",
)
def geo_radius(spark, d):
    key = F.col("c_custkey")
    placed = views.table(spark, d, "customer").select(
        "c_custkey", (36 + key * 37 % 600 / 100.0).alias("lat"), (26 + key * 91 % 1900 / 100.0).alias("lon")
    )
    return fl.within_distance(placed, 39.93, 32.86, 200.0).select("c_custkey", F.round("distance_km", 4).alias("km"))


@query(
    "paged_sort",
    "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 20 OFFSET 40",
)
def paged_sort(spark, d):
    orders = views.table(spark, d, "orders").select("o_orderkey", "o_totalprice")
    return page(orders, [*ordered_by(orders, "o_totalprice"), F.asc("o_orderkey")], number=3, size=20)


@query(
    "point_lookup",
    f"""WITH {COMPANY} SELECT company_no, legal_name, 'stored ' || city AS city FROM company WHERE company_no = 42""",
)
def point_lookup(spark, d):
    index = views.company_view(spark, d).select("company_no", "legal_name", "city")
    stored = index.select("company_no", F.concat(F.lit("stored "), F.col("city")).alias("city"))
    return fl.point_lookup(index, stored, "company_no", 42)


@query(
    "response_rows",
    f"""WITH {SEGMENTS} SELECT company_id AS id, legal_name, trade_name, city, company_type, website_domain AS website,
          array_to_string(emails, ',') AS emails, coalesce(array_to_string(phones, ','), '') AS phones, rating, industry,
          company_size AS size, priority_tier, strftime(last_updated, '%Y-%m-%d') AS last_updated FROM segments""",
)
def response_rows(spark, d):
    rows = fl.response_rows(enriched(spark, d))
    return rows.withColumns(
        {
            "emails": F.array_join("emails", ","),
            "phones": F.array_join("phones", ","),
            "last_updated": F.date_format("last_updated", "yyyy-MM-dd"),
        }
    )


def _facet_sql(name: str, size: int) -> str:
    return (
        f"SELECT * FROM (SELECT '{name}' AS facet, {name} AS value, count(*) AS count FROM segments "
        f"WHERE {name} IS NOT NULL GROUP BY {name} ORDER BY count DESC, value LIMIT {size})"
    )


@query("facets_topk", f"WITH {SEGMENTS} " + " UNION ALL ".join(_facet_sql(n, s) for n, s in f.FACETS.items()))
def facets_topk(spark, d):
    return f.facets(segments(spark, d))


@query(
    "nested_terms",
    f"""WITH {SEGMENTS}, o AS (SELECT city, count(*) AS count, round(avg(rating), 4) AS avg_rating FROM segments GROUP BY city ORDER BY count DESC, city LIMIT 20),
        i AS (SELECT city, company_type, count(*) AS inner_count FROM segments WHERE company_type IS NOT NULL GROUP BY ALL)
        SELECT o.city, count, avg_rating, company_type, inner_count FROM o LEFT JOIN i ON i.city = o.city
        QUALIFY row_number() OVER (PARTITION BY o.city ORDER BY inner_count DESC, company_type) <= 5""",
)
def nested_terms(spark, d):
    out = f.nested_terms(segments(spark, d), "city", "company_type", 20, 5, avg_rating=F.avg("rating"))
    return out.withColumn("avg_rating", F.round("avg_rating", 4))


@query(
    "multi_terms",
    f"""WITH {COMPANY}, u AS (SELECT unnest(data_sources) AS data_sources FROM company)
        SELECT data_sources, count(*) AS count FROM u GROUP BY 1""",
)
def multi_terms(spark, d):
    return f.multi_terms(views.company_view(spark, d), "data_sources")


@query(
    "range_buckets",
    f"""WITH {COMPANY}, b AS (SELECT count(*) FILTER (confidence_score < 0.5) AS very_low,
          count(*) FILTER (confidence_score >= 0.5 AND confidence_score < 0.7) AS low,
          count(*) FILTER (confidence_score >= 0.7 AND confidence_score < 0.9) AS medium,
          count(*) FILTER (confidence_score >= 0.9) AS high FROM company)
        UNPIVOT b ON very_low, low, medium, high INTO NAME bucket VALUE count""",
)
def range_buckets(spark, d):
    return f.range_buckets(views.company_view(spark, d), "confidence_score")


@query(
    "missing_counts",
    f"""WITH {COMPANY}, m AS (SELECT count(*) FILTER (len(coalesce(emails, [])) = 0) AS emails, count(*) FILTER (phones IS NULL) AS phones,
          count(*) FILTER (website_domain IS NULL) AS website_domain, count(*) FILTER (city IS NULL) AS city FROM company)
        UNPIVOT m ON emails, phones, website_domain, city INTO NAME field VALUE missing""",
)
def missing_counts(spark, d):
    return f.data_quality_panels(views.company_view(spark, d))["missing"]


@query(
    "completeness",
    f"""WITH {COMPANY}, m AS (SELECT count(*) FILTER (len(coalesce(emails, [])) > 0) AS has_email, count(phones) AS has_phone,
          count(website_domain) AS has_website, count(address) AS has_address,
          count(*) FILTER (company_no % 4 = 1) AS has_social FROM company)
        UNPIVOT m ON has_email, has_phone, has_website, has_address, has_social INTO NAME flag VALUE count""",
)
def completeness(spark, d):
    return f.dashboard(enriched(spark, d))["data_completeness"]


@query(
    "tier_subcounts",
    f"""WITH {SEGMENTS} SELECT priority_tier, count(*) AS count, count(company_id) AS company_count,
          count(*) FILTER (len(emails) > 0) AS with_email, count(website_domain) AS with_website FROM segments GROUP BY 1""",
)
def tier_subcounts(spark, d):
    return f.tier_counts(enriched(spark, d))


@query(
    "histogram_rating",
    f"WITH {COMPANY} SELECT CAST(floor(rating / 0.5) * 0.5 AS DOUBLE) AS bucket, count(*) AS count FROM company GROUP BY 1",
)
def histogram_rating(spark, d):
    return f.histogram(views.company_view(spark, d), "rating", 0.5)


@query(
    "histogram_day",
    "SELECT strftime(date_trunc('day', ts), '%Y-%m-%d') AS day, count(*) AS count FROM events GROUP BY 1",
)
def histogram_day(spark, d):
    return f.day_histogram(views.table(spark, d, "events"), "ts").withColumn("day", F.date_format("day", "yyyy-MM-dd"))


@query("cardinality", "SELECT true AS within_error FROM orders HAVING count(*) > 0")
def cardinality(spark, d):
    """Is the approximate count of customers that ordered within its stated error?"""
    orders = views.table(spark, d, "orders")
    exact = orders.agg(F.countDistinct("o_custkey").alias("exact"))
    # Two rows of one value each.
    both = f.cardinality(orders, "o_custkey", 0.02).withColumn("exact", F.lit(None).cast("long")).union(
        exact.select(F.lit(None).cast("long"), "exact")
    )
    one = both.agg(F.max("distinct_count").alias("near"), F.max("exact").alias("exact"))
    # Three standard errors.
    return one.select((F.abs(F.col("near") - F.col("exact")) <= 0.06 * F.col("exact")).alias("within_error"))


@query(
    "dashboard",
    f"""WITH {SEGMENTS}, cities AS (SELECT city, count(*) AS n FROM segments WHERE city IS NOT NULL GROUP BY city ORDER BY n DESC, city LIMIT 20),
          inds AS (SELECT industry, count(*) AS n FROM segments WHERE industry IS NOT NULL GROUP BY industry ORDER BY n DESC, industry LIMIT 15)
        SELECT 'total_companies' AS panel, 'total' AS key, count(DISTINCT company_id) AS count FROM segments
        UNION ALL SELECT 'cities', city, n FROM cities
        UNION ALL SELECT 'industries', industry, n FROM inds
        UNION ALL SELECT 'priority_distribution', priority_tier, count(*) FROM segments GROUP BY priority_tier
        UNION ALL SELECT 'rating_distribution', CAST(floor(rating / 0.5) * 0.5 AS VARCHAR), count(*) FROM segments WHERE rating IS NOT NULL GROUP BY 2
        UNION ALL SELECT 'recent_activity', strftime(last_updated, '%Y-%m-%d'), count(*) FROM segments GROUP BY 2
        UNION ALL SELECT 'data_completeness', 'has_email', count(*) FILTER (len(emails) > 0) FROM segments
        UNION ALL SELECT 'data_completeness', 'has_phone', count(phones) FROM segments
        UNION ALL SELECT 'data_completeness', 'has_website', count(website_domain) FROM segments
        UNION ALL SELECT 'data_completeness', 'has_address', count(address) FROM segments
        UNION ALL SELECT 'data_completeness', 'has_social', count(*) FILTER (company_no % 4 = 1) FROM segments""",
)
def dashboard(spark, d):
    """All panels as rows: panel, key, count."""
    return f.dashboard_rows(enriched(spark, d))


@query(
    "dashboard_nested",
    f"""WITH {SEGMENTS},
          cities AS (SELECT city, count(*) AS n, avg(rating) AS r FROM segments WHERE city IS NOT NULL GROUP BY city ORDER BY n DESC, city LIMIT 20),
          types AS (SELECT city, company_type, count(*) AS n FROM segments WHERE company_type IS NOT NULL AND city IN (SELECT city FROM cities)
            GROUP BY city, company_type QUALIFY row_number() OVER (PARTITION BY city ORDER BY count(*) DESC, company_type) <= 5),
          inds AS (SELECT industry, count(*) AS n, avg(engagement_score) AS e FROM segments WHERE industry IS NOT NULL GROUP BY industry ORDER BY n DESC, industry LIMIT 15),
          sizes AS (SELECT industry, company_size, count(*) AS n FROM segments WHERE company_size IS NOT NULL AND industry IN (SELECT industry FROM inds)
            GROUP BY industry, company_size QUALIFY row_number() OVER (PARTITION BY industry ORDER BY count(*) DESC, company_size) <= 5),
          a(panel, key, inner_key, count, avg_rating, avg_engagement, with_email, with_website) AS (
        SELECT 'total_companies', 'total', NULL, count(DISTINCT company_id), NULL::DOUBLE, NULL::DOUBLE, NULL::BIGINT, NULL::BIGINT FROM segments
        UNION ALL SELECT 'cities', city, NULL, n, r, NULL, NULL, NULL FROM cities
        UNION ALL SELECT 'cities', city, company_type, n, NULL, NULL, NULL, NULL FROM types
        UNION ALL SELECT 'industries', industry, NULL, n, NULL, e, NULL, NULL FROM inds
        UNION ALL SELECT 'industries', industry, company_size, n, NULL, NULL, NULL, NULL FROM sizes
        UNION ALL SELECT 'priority_distribution', priority_tier, NULL, count(*), NULL, NULL, count(*) FILTER (len(emails) > 0), count(website_domain)
          FROM segments WHERE priority_tier IS NOT NULL GROUP BY priority_tier
        UNION ALL SELECT 'rating_distribution', CAST(floor(rating / 0.5) * 0.5 AS VARCHAR), NULL, count(*), NULL, NULL, NULL, NULL
          FROM segments WHERE rating IS NOT NULL GROUP BY 2
        UNION ALL SELECT 'recent_activity', strftime(last_updated, '%Y-%m-%d'), NULL, count(*), NULL, NULL, NULL, NULL
          FROM segments WHERE last_updated IS NOT NULL GROUP BY 2
        UNION ALL SELECT 'data_completeness', 'has_email', NULL, count(*) FILTER (len(emails) > 0), NULL, NULL, NULL, NULL FROM segments
        UNION ALL SELECT 'data_completeness', 'has_phone', NULL, count(phones), NULL, NULL, NULL, NULL FROM segments
        UNION ALL SELECT 'data_completeness', 'has_website', NULL, count(website_domain), NULL, NULL, NULL, NULL FROM segments
        UNION ALL SELECT 'data_completeness', 'has_address', NULL, count(address), NULL, NULL, NULL, NULL FROM segments
        UNION ALL SELECT 'data_completeness', 'has_social', NULL, count(*) FILTER (company_no % 4 = 1), NULL, NULL, NULL, NULL FROM segments)
        SELECT panel, key, inner_key, count, round(avg_rating, 4) AS avg_rating, round(avg_engagement, 4) AS avg_engagement, with_email, with_website FROM a""",
)
def dashboard_nested(spark, d):
    """All panels with averages, sub-counts and inner buckets, from one aggregation."""
    rows = f.dashboard_buckets(enriched(spark, d))
    return rows.withColumns({c: F.round(c, 4) for c in ("avg_rating", "avg_engagement")})


@query(
    "cardinality_stored",
    """SELECT event_type, CAST(count(*) AS BIGINT) AS values, true AS within_error FROM events WHERE user_id IS NOT NULL GROUP BY event_type""",
)
def cardinality_stored(spark, d):
    """Users by type of event, from sketches stored by day in two loads and merged."""
    events = views.table(spark, d, "events").select("event_type", F.to_date("ts").alias("day"), "user_id", "event_id")
    path = new_shared_path(spark, "sketches")
    for half in (0, 1):
        part = events.filter(F.col("event_id") % 2 == half)
        f.distinct_sketches(part, ["day", "event_type"], "user_id").write.mode("append").parquet(path)
    merged = f.distinct_of_sketches(spark.read.parquet(path), ["event_type"])
    exact = events.groupBy("event_type").agg(F.countDistinct("user_id").alias("exact"))
    off = F.abs(F.col("distinct_count") - F.col("exact"))
    # Five standard errors of a sketch of 12 bits.
    return merged.join(exact, "event_type").select("event_type", "values", (off <= 0.082 * F.col("exact")).alias("within_error"))
