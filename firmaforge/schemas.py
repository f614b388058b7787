"""Record layouts: nested company record, raw JSON payloads, match edges and audit rows."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Fixed values.
COMPANY_TYPES = [
    "Anonim Şirket", "Limited Şirket", "Şahıs Şirketi", "Kolektif Şirket", "Komandit Şirket",
    "Kooperatif", "Dernek", "Vakıf", "Diğer",
]
DATA_SOURCES = [
    "google_search", "google_places", "linkedin", "instagram", "facebook", "twitter", "website",
    "whois", "trade_registry", "manual",
]

STR, INT, DBL, BOOL, TS = (
    T.StringType(), T.IntegerType(), T.DoubleType(), T.BooleanType(), T.TimestampType()
)
STRS = T.ArrayType(STR)


def _struct(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(n, t) for n, t in fields.items()])


IDENTITY = _struct(
    legal_name=STR, trade_name=STR, company_type=STR, country=STR, city=STR, district=STR,
    registration_hint=STR,
)
PLACES = _struct(place_id=STR, rating=DBL, reviews_count=INT, types=STRS, business_status=STR)
WEB_PRESENCE = _struct(
    website_url=STR, website_status_code=INT, ssl_issuer=STR, first_seen_ts=TS, last_seen_ts=TS,
    social_links=T.MapType(STR, STR), google_places=PLACES,
)
CONTACTS = _struct(emails_public=STRS, phones_public=STRS, address_public=STR)
BUSINESS_META = _struct(
    industry_naics_guess=STR, sic_guess=STR, headcount_band_guess=STR, founding_year_guess=INT,
    keywords=STRS,
)
SEO_SIGNALS = _struct(
    title=STR, meta_description=STR, h1_keywords=STRS, indexed_pages_estimate=INT
)
PROVENANCE = _struct(source_url=STR, source_type=STR, fetch_ts=TS, parser_version=STR, hash=STR)
COMPANY = _struct(
    id=STR, identity=IDENTITY, web_presence=WEB_PRESENCE, contacts=CONTACTS,
    business_meta=BUSINESS_META, seo_signals=SEO_SIGNALS, provenance=T.ArrayType(PROVENANCE),
    canonical_id=STR, confidence_score=DBL, gdpr_suppressed=BOOL, suppression_date=TS,
    last_updated=TS, created_at=TS,
)
# Payloads of the three raw tables. Numbers arrive as text and are cast with try_cast.
SEARCH_JSON = "title string, snippet string, link string, company_name string, city string, company_type string"
PLACES_JSON = (
    "name string, formatted_address string, formatted_phone_number string, website string, "
    "rating string, user_ratings_total string, types array<string>, business_status string"
)
WEBSITE_JSON = (
    "company_name string, title string, meta_description string, emails array<string>, "
    "phones array<string>, address string, social_links map<string,string>, keywords array<string>"
)

COMPLIANCE_LOG = (
    "reference_id string, action string, entity_id string, requester_info map<string,string>, "
    "timestamp timestamp, status string, completion_date timestamp, notes string"
)
CRAWL_JOB = (
    "job_id string, source string, target_url string, search_query string, status string, "
    "started_at timestamp, completed_at timestamp, records_found int, errors array<string>, "
    "rate_limit_hits int"
)


def typed_null(dtype: T.DataType | str) -> Column:
    return F.lit(None).cast(dtype)


def company_record(**parts: Column) -> list[Column]:
    """All columns of a company record in order; parts that are not given are null or default."""
    defaults = {
        "confidence_score": F.lit(1.0),
        "gdpr_suppressed": F.lit(False),
    }
    return [
        parts.get(f.name, defaults.get(f.name, F.lit(None))).cast(f.dataType).alias(f.name)
        for f in COMPANY.fields
    ]


def struct_of(schema: T.StructType, **fields: Column) -> Column:
    """A struct with the fields of ``schema``; those not given are null."""
    return F.struct(
        *[fields.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in schema.fields]
    )
