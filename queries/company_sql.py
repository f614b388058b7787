"""SQL text shared by the oracles: the company view and its segments."""

from firmaforge.plans.gold import INDUSTRIES, RECOMMENDATIONS


def sql_list(items) -> str:
    return "[" + ", ".join("'" + str(i).replace("'", "''") + "'" for i in items) + "]"


_WORDS = " ".join(f"WHEN {i} THEN {sql_list(w)}" for i, w in enumerate(INDUSTRIES.values()))

COMPANY_TYPE = (
    "CASE c_mktsegment WHEN 'AUTOMOBILE' THEN 'Anonim Şirket' "
    "WHEN 'BUILDING' THEN 'Limited Şirket' WHEN 'FURNITURE' THEN 'Şahıs Şirketi' END"
)
RATING = "CAST(round(CAST(1 + 4 * (c_acctbal + 1000) / 11000 AS DECIMAL(10,4)), 1) AS DOUBLE)"

COMPANY = f"""
rev AS (SELECT o_custkey, CAST(sum(floor(o_totalprice / 10000)) AS BIGINT) AS reviews FROM orders GROUP BY 1),
company AS (
  SELECT md5(CAST(c_custkey AS VARCHAR)) AS company_id, c_custkey AS company_no, c_name AS legal_name,
    CASE WHEN c_custkey % 5 = 0 THEN 'Trade ' || n_name END AS trade_name, n_name AS city,
    {COMPANY_TYPE} AS company_type,
    CASE WHEN c_custkey % 7 <> 0 THEN 'c' || (c_custkey // 30) || '.example.com' END AS website_domain,
    {RATING} AS rating, reviews AS total_reviews,
    CASE c_custkey % 3 WHEN 0 THEN []::VARCHAR[]
      WHEN 1 THEN ['info@c' || (c_custkey // 30) || '.example.com']
      ELSE ['info@c' || (c_custkey // 30) || '.example.com', 'ada.byron@c' || (c_custkey // 30) || '.example.com'] END AS emails,
    CASE WHEN c_custkey % 4 <> 0 THEN ['0212' || lpad(CAST(c_custkey % 10000000 AS VARCHAR), 7, '0')] END AS phones,
    CASE WHEN c_custkey % 6 <> 0 THEN 'Cad. ' || c_custkey || ' ' || n_name END AS address,
    CASE c_custkey % 11 {_WORDS} END AS keywords,
    CASE WHEN c_custkey % 8 = 0 THEN ['website'] ELSE ['google_places', 'google_search'] END AS data_sources,
    (c_custkey % 100) / 100.0 AS confidence_score,
    TIMESTAMP '2024-06-01 00:00:00' - to_days(CAST(c_custkey % 120 AS INTEGER)) AS last_updated
  FROM customer JOIN nation ON c_nationkey = n_nationkey LEFT JOIN rev ON o_custkey = c_custkey
)"""

_INDUSTRY = " ".join(
    f"WHEN list_has_all(keywords, {sql_list(w)}) THEN '{n}'" for n, w in INDUSTRIES.items()
)
_ADVICE = " ".join(f"WHEN '{t}' THEN '{a}'" for t, a in RECOMMENDATIONS.items())

SEGMENTS = f"""{COMPANY},
classified AS (
  SELECT *, CASE {_INDUSTRY} ELSE 'Other' END AS industry,
    CASE WHEN company_type = 'Anonim Şirket' THEN 'Large'
      WHEN total_reviews > 1000 THEN 'Large'
      WHEN total_reviews BETWEEN 100 AND 1000 THEN 'Medium'
      WHEN total_reviews BETWEEN 10 AND 100 THEN 'Small'
      WHEN company_type = 'Limited Şirket' AND total_reviews < 10 THEN 'Small'
      WHEN company_type = 'Şahıs Şirketi' THEN 'Micro' ELSE 'Unknown' END AS company_size,
    CASE WHEN rating >= 4.5 AND total_reviews > 50 THEN 'High'
      WHEN rating >= 4.0 AND total_reviews > 20 THEN 'Medium'
      WHEN rating >= 3.5 THEN 'Low' ELSE 'Very Low' END AS engagement_level,
    CAST(round(CAST(coalesce(rating * log10(total_reviews + 1), 0) AS DECIMAL(24,8)), 2) AS DOUBLE) AS engagement_score
  FROM company),
segments AS (
  SELECT *, CAST(nullif(len(emails), 0) AS INTEGER) AS email_count,
    CAST(nullif(len(data_sources), 0) AS INTEGER) AS data_source_count,
    coalesce(city, 'Unknown') || ' - ' || industry || ' - ' || company_size || ' - ' || engagement_level || ' Engagement' AS segment,
    CASE WHEN company_size IN ('Large', 'Medium') AND engagement_level IN ('High', 'Medium') AND website_domain IS NOT NULL THEN 'A'
      WHEN company_size IN ('Medium', 'Small') AND engagement_level IN ('Medium', 'Low') AND website_domain IS NOT NULL THEN 'B'
      WHEN company_size = 'Small' AND engagement_level = 'Low' THEN 'C' ELSE 'D' END AS priority_tier
  FROM classified)"""

ADVICE_CASE = f"CASE priority_tier {_ADVICE} END"

# The three raw sources as the silver layer sees them.
SOURCES = f"""
rev AS (SELECT o_custkey, CAST(sum(floor(o_totalprice / 10000)) AS BIGINT) AS reviews FROM orders GROUP BY 1),
unioned AS (
  SELECT c_name AS legal_name, n_name AS city, {COMPANY_TYPE} AS company_type,
    'https://find.example.com/' || c_custkey AS source_url, CAST(NULL AS VARCHAR) AS website,
    CAST(NULL AS VARCHAR[]) AS phones, CAST(NULL AS VARCHAR) AS address, CAST(NULL AS DOUBLE) AS rating,
    CAST(NULL AS BIGINT) AS reviews_count, CAST(NULL AS VARCHAR[]) AS emails, CAST(NULL AS VARCHAR) AS social_links,
    CAST(NULL AS VARCHAR[]) AS keywords, 'google_search' AS source_type
  FROM customer JOIN nation ON c_nationkey = n_nationkey
  UNION ALL
  SELECT c_name, n_name, NULL, NULL,
    CASE WHEN c_custkey % 7 <> 0 THEN 'https://www.c' || (c_custkey // 30) || '.example.com/' || c_custkey END,
    ['0212 ' || lpad(CAST(c_custkey % 10000000 AS VARCHAR), 7, '0')],
    'Street ' || c_custkey || ', ' || n_name || ', TR', {RATING}, reviews, NULL, NULL, NULL, 'google_places'
  FROM customer JOIN nation ON c_nationkey = n_nationkey LEFT JOIN rev ON o_custkey = c_custkey
  UNION ALL
  SELECT s_name, NULL, NULL, NULL, 'https://www.s' || s_suppkey || '.example.org/',
    ['+90216' || lpad(CAST(s_suppkey % 10000000 AS VARCHAR), 7, '0')],
    'Cad. ' || s_suppkey || ', Kat 2', NULL, NULL,
    ['info@s' || s_suppkey || '.example.org', 'sales@s' || s_suppkey || '.example.org'],
    '{{"linkedin":"https://linkedin.com/company/s' || s_suppkey || '"}}',
    CASE s_suppkey % 12 {_WORDS} END, 'website'
  FROM supplier
)"""
