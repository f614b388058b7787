"""Quality rules over the company view, documents as flat records and orders."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from firmaforge.operators import quality as q
from firmaforge.plans import views
from firmaforge.session import new_shared_path
from queries.company_sql import COMPANY, SEGMENTS
from queries.lake import segments
from queries.registry import query


def flat_companies(spark, d):
    """One e-mail and one phone per company, with some values that break a rule."""
    n = F.col("company_no")
    return views.company_view(spark, d).select(
        "company_id",
        F.when(n % 97 == 0, F.lit("X"))
        .when(n % 31 == 0, F.lit("Acme 12345678901"))
        .otherwise(F.col("legal_name"))
        .alias("legal_name"),
        F.when(n % 50 == 0, F.lit("Şirket")).otherwise(F.col("company_type")).alias("company_type"),
        F.when(n % 30 == 0, "XX").otherwise("TR").alias("country"),
        F.translate("city", "_0123456789", "").alias("city"),
        F.try_element_at("emails", F.lit(-1)).alias("email"),
        F.try_element_at("phones", F.lit(1)).alias("phone"),
        F.when(n % 7 != 0, F.concat(F.lit("https://"), F.col("website_domain"))).alias("website_url"),
        F.when(n % 9 == 0, 0).otherwise(200).alias("website_status_code"),
        (F.lit(1890) + n % 140).cast("int").alias("founding_year"),
        F.when(n % 2 == 0, F.lit("11-50")).alias("headcount_band"),
        "rating",
        F.col("total_reviews").alias("reviews_count"),
        "confidence_score",
    )


_FLAT = f"""{COMPANY}, flat AS (SELECT company_id, CASE WHEN company_no % 97 = 0 THEN 'X' WHEN company_no % 31 = 0 THEN 'Acme 12345678901' ELSE legal_name END AS legal_name,
    CASE WHEN company_no % 50 = 0 THEN 'Şirket' ELSE company_type END AS company_type,
    CASE WHEN company_no % 30 = 0 THEN 'XX' ELSE 'TR' END AS country, translate(city, '_0123456789', '') AS city,
    emails[-1] AS email, phones[1] AS phone,
    CASE WHEN company_no % 7 <> 0 THEN 'https://' || website_domain END AS website_url,
    CASE WHEN company_no % 9 = 0 THEN 0 ELSE 200 END AS website_status_code, 1890 + company_no % 140 AS founding_year,
    CASE WHEN company_no % 2 = 0 THEN '11-50' END AS headcount_band, rating, total_reviews AS reviews_count, confidence_score
  FROM company)"""


def _line(rule: str, column: str, test: str, mostly: float, nulls: bool = False, table: str = "flat") -> str:
    counted = "count(*)" if nulls else f"count({column})"
    return (
        f"SELECT '{rule}' AS rule, '{column}' AS \"column\", {counted} AS evaluated, "
        f"count(*) FILTER (({column} IS NOT NULL{' OR true' if nulls else ''}) AND ({test})) AS passed, "
        f"CAST({mostly} AS DOUBLE) AS mostly FROM {table}"
    )


_LINES = [
    "SELECT 'column_exists' AS rule, 'legal_name' AS \"column\", 1 AS evaluated, 1 AS passed, CAST(1.0 AS DOUBLE) AS mostly",
    _line("not_null", "legal_name", "legal_name IS NOT NULL", 0.99, True),
    _line("length_between", "legal_name", "len(legal_name) BETWEEN 2 AND 200", 1),
    _line("in_set", "company_type", "company_type IN ('Anonim Şirket', 'Limited Şirket', 'Şahıs Şirketi')", 1),
    _line("in_set", "country", "country IN ('TR', 'US', 'GB', 'DE', 'FR')", 0.95),
    _line("matches_regex", "city", "regexp_matches(city, '^[A-ZÇĞİÖŞÜa-zçğıöşü\\s\\-]+$')", 0.95),
    _line("matches_regex", "email", "regexp_matches(email, '^[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\\.[a-zA-Z]{2,}$')", 0.98),
    _line("matches_regex", "phone", "regexp_matches(phone, '^\\+?[0-9\\s\\-\\(\\)]+$')", 0.95),
    _line("length_between", "phone", "len(phone) BETWEEN 10 AND 20", 1),
    _line("matches_regex", "website_url", "regexp_matches(website_url, '^https?://[a-zA-Z0-9\\-\\.]+\\.[a-zA-Z]{2,}')", 0.95),
    _line("between", "website_status_code", "website_status_code BETWEEN 200 AND 599", 0.9),
    _line("between", "founding_year", "founding_year BETWEEN 1900 AND 2024", 0.95),
    _line("in_set", "headcount_band", "headcount_band = '11-50'", 1),
    _line("between", "rating", "rating BETWEEN 1 AND 5", 1),
    _line("between", "reviews_count", "reviews_count BETWEEN 0 AND 100000", 0.99),
    "SELECT 'unique', 'company_id', CAST(sum(n) AS BIGINT), count(*) FILTER (n = 1), 1.0 FROM (SELECT count(*) AS n FROM flat GROUP BY company_id)",
    _line("between", "confidence_score", "confidence_score BETWEEN 0 AND 1", 1),
    _line("not_matches_regex", "legal_name", "NOT regexp_matches(legal_name, '\\d{11}')", 1),
    _line("not_matches_regex", "email", "NOT regexp_matches(email, '^[a-z]+\\.[a-z]+@')", 0.95),
]
_RESULTS = f"WITH {_FLAT}, lines AS ({' UNION ALL '.join(_LINES)}), results AS (SELECT *, passed / evaluated AS pass_share, passed / evaluated >= mostly AS success FROM lines)"


@query(
    "quality_suite",
    f"""{_RESULTS} SELECT rule, "column", CAST(evaluated AS BIGINT) AS evaluated, CAST(passed AS BIGINT) AS passed,
          round(pass_share, 6) AS pass_share, mostly, success FROM results""",
)
def quality_suite(spark, d):
    return q.run_rules(flat_companies(spark, d), q.company_rules()).withColumn("pass_share", F.round("pass_share", 6))


@query(
    "quality_summary",
    f"""{_RESULTS} SELECT count(*) AS evaluated_expectations, count(*) FILTER (success) AS successful_expectations,
          count(*) FILTER (NOT success) AS unsuccessful_expectations,
          round(count(*) FILTER (success) * 100.0 / count(*), 4) AS success_percent, bool_and(success) AS success FROM results""",
)
def quality_summary(spark, d):
    done = q.summary(q.run_rules(flat_companies(spark, d), q.company_rules()))
    return done.withColumn("success_percent", F.round("success_percent", 4))


@query(
    "quality_failing_kinds",
    f"{_RESULTS} SELECT rule, count(*) AS failures FROM results WHERE NOT success GROUP BY rule ORDER BY 2 DESC, 1 LIMIT 10",
)
def quality_failing_kinds(spark, d):
    return q.failing_kinds(q.run_rules(flat_companies(spark, d), q.company_rules()))


_SEG_LINES = [
    _line("in_set", "industry", "true", 1, table="segments"),
    _line("in_set", "company_size", "company_size IN ('Micro', 'Small', 'Medium', 'Large', 'Unknown')", 1, table="segments"),
    _line("in_set", "engagement_level", "engagement_level IN ('Very Low', 'Low', 'Medium', 'High')", 1, table="segments"),
    _line("in_set", "priority_tier", "priority_tier IN ('A', 'B', 'C', 'D')", 1, table="segments"),
    _line("between", "engagement_score", "engagement_score BETWEEN 0 AND 100", 0.99, table="segments"),
]


@query(
    "quality_segments",
    f"""WITH {SEGMENTS}, lines AS ({' UNION ALL '.join(_SEG_LINES)})
        SELECT rule, "column", evaluated, passed, passed / evaluated AS pass_share, mostly, passed / evaluated >= mostly AS success FROM lines""",
)
def quality_segments(spark, d):
    return q.run_rules(segments(spark, d), q.segment_rules())


@query(
    "quality_report",
    f"""{_RESULTS}, {SEGMENTS.replace(COMPANY + ',', '').strip()}, seg_lines AS ({' UNION ALL '.join(_SEG_LINES)}),
        runs AS (SELECT 'company' AS run, rule, success FROM results UNION ALL SELECT 'segment', rule, passed / evaluated >= mostly FROM seg_lines),
        per_run AS (SELECT run, bool_and(success) AS ok FROM runs GROUP BY run)
        SELECT count(*) AS total_validations, count(*) FILTER (ok) AS successful_validations,
          count(*) FILTER (NOT ok) AS failed_validations, count(*) FILTER (ok) * 100.0 / count(*) AS overall_success_rate,
          (SELECT count(DISTINCT rule) FILTER (NOT success AND rule IN ('not_null', 'matches_regex', 'unique')) FROM runs)
            + CASE WHEN count(*) FILTER (ok) * 100.0 / count(*) < 90 THEN 1 ELSE 0 END AS advice FROM per_run""",
)
def quality_report(spark, d):
    runs = {
        "company": q.run_rules(flat_companies(spark, d), q.company_rules()),
        "segment": q.run_rules(segments(spark, d), q.segment_rules()),
    }
    tagged = reduce(DataFrame.unionByName, [r.withColumn("run", F.lit(n)) for n, r in runs.items()])
    out = q.report(tagged)
    return out.select(*[c for c in out.columns if c != "recommendations"], F.size("recommendations").cast("bigint").alias("advice"))


def _stored_runs(spark, d):
    """Two layers written and checked in one pass each; the second run is repeated and counts once."""
    base = new_shared_path(spark, "checked")
    layers = {"company": (flat_companies, q.company_rules()), "segment": (segments, q.segment_rules())}
    for run in ("company", "segment", "segment"):
        rows, rules = layers[run]
        q.write_checked(rows(spark, d), rules, f"{base}/{run}", f"{base}/runs", run)
    return q.stored_runs(spark, f"{base}/runs")


@query(
    "quality_stored_runs",
    f"""{_RESULTS}, {SEGMENTS.replace(COMPANY + ',', '').strip()}, seg_lines AS ({' UNION ALL '.join(_SEG_LINES)})
        SELECT 'company' AS run, rule, "column", CAST(evaluated AS BIGINT) AS evaluated, CAST(passed AS BIGINT) AS passed, success FROM results
        UNION ALL SELECT 'segment', rule, "column", evaluated, passed, passed / evaluated >= mostly FROM seg_lines""",
)
def quality_stored_runs(spark, d):
    return _stored_runs(spark, d).select("run", "rule", "column", "evaluated", "passed", "success")


@query(
    "construction_rules",
    f"""WITH {_FLAT}, lines AS ({_line('not_null', 'legal_name', 'legal_name IS NOT NULL', 1, True)}
          UNION ALL {_line('between', 'confidence_score', 'confidence_score BETWEEN 0 AND 1', 1)}
          UNION ALL {_line('matches_regex', 'email', "regexp_matches(email, '^[^@]+@[^@]+$')", 1)}
          UNION ALL {_line('matches_regex', 'website_url', "website_url LIKE 'https://%'", 1)})
        SELECT rule, "column", evaluated, passed, passed / evaluated AS pass_share, mostly, passed / evaluated >= mostly AS success FROM lines""",
)
def construction_rules(spark, d):
    return q.run_rules(flat_companies(spark, d), q.construction_rules())


def _loaded(spark, d):
    n = F.col("c_custkey")
    return views.table(spark, d, "customer").select(
        n.alias("id"),
        F.when(n % 13 != 0, F.col("c_name")).alias("legal_name"),
        F.when(n % 17 == 0, F.lit("ftp://x.example.com")).when(n % 3 == 0, F.lit("https://x.example.com")).alias("website_url"),
    )


_ISSUES = """checked AS (SELECT c_custkey AS id, concat_ws(',', CASE WHEN c_custkey % 13 = 0 THEN 'Missing legal_name' END,
  CASE WHEN c_custkey % 17 = 0 THEN 'Invalid website URL' END) AS issues FROM customer)"""


@query("record_issues", f"WITH {_ISSUES} SELECT id, issues FROM checked WHERE issues <> ''")
def record_issues(spark, d):
    checked = q.record_issues(_loaded(spark, d)).filter(F.size("issues") > 0)
    return checked.select("id", F.array_join("issues", ",").alias("issues"))


@query(
    "record_validation",
    f"""WITH {_ISSUES} SELECT count(*) AS total, count(*) FILTER (issues = '') AS valid,
          count(*) FILTER (issues <> '') AS invalid FROM checked""",
)
def record_validation(spark, d):
    return q.record_counts(q.record_issues(_loaded(spark, d)))
