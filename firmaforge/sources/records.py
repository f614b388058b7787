"""Company records out of the three sources, source merges and registry enrichment."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from firmaforge import schemas
from firmaforge.functions import text
from firmaforge.functions.privacy import (
    contact_emails,
    filter_pii,
    is_corporate_email,
    is_personal_name,
    provenance,
)
from firmaforge.operators.pages import name_from_domain
from firmaforge.schemas import company_record, struct_of

# Columns that carry keys, links and times, which the personal-data filter must not touch.
KEYS = ("id", "provenance", "canonical_id")

# Cities looked for in search snippets, in order.
SNIPPET_CITIES = [(("Istanbul", "İstanbul"), "İstanbul"), (("Ankara",), "Ankara"), (("Izmir", "İzmir"), "İzmir")]


def _no_texts() -> Column:
    return F.array().cast("array<string>")


def _items(value: Column) -> Column:
    return F.when(F.length(value) > 0, F.array(value)).otherwise(_no_texts())


def places_records(bronze: DataFrame) -> DataFrame:
    """Nested records of places; rows without place_id are dropped, personal data filtered."""
    c = F.col
    name = F.coalesce(c("business_name"), F.lit(""))
    legal = text.collapse_spaces(name)
    types = F.coalesce(c("business_types"), _no_texts())
    link = F.concat(F.lit("https://maps.google.com/maps/place/?q=place_id:"), c("place_id"))
    # Numbers are written without blanks first: a domestic number has the shape of a national
    # id, and the filter would drop it.
    phone = text.normalize_phone(c("phone"))
    records = bronze.filter(F.length("place_id") > 0).select(
        *company_record(
            id=F.md5(F.concat(F.lit("places:"), c("place_id"))),
            identity=struct_of(
                schemas.IDENTITY,
                legal_name=legal,
                trade_name=name,
                city=text.address_city(c("address")),
                country=F.lit("TR"),
            ),
            web_presence=struct_of(
                schemas.WEB_PRESENCE,
                website_url=text.blank_to_null(c("website")),
                social_links=F.create_map().cast("map<string,string>"),
                google_places=F.struct(
                    c("place_id"),
                    c("rating").cast("double").alias("rating"),
                    F.coalesce("reviews_count", F.lit(0)).alias("reviews_count"),
                    types.alias("types"),
                    F.coalesce("business_status", F.lit("OPERATIONAL")).alias("business_status"),
                ),
            ),
            contacts=struct_of(
                schemas.CONTACTS,
                emails_public=_no_texts(),
                phones_public=_items(phone),
                address_public=F.coalesce(c("address"), F.lit("")),
            ),
            business_meta=struct_of(schemas.BUSINESS_META, keywords=types),
            provenance=F.array(provenance(link, "google_places", c("fetch_ts"), F.struct("place_id"))),
            last_updated=c("processed_at"),
            created_at=c("created_at"),
        )
    )
    return filter_pii(records, keep=KEYS)


def search_records(bronze: DataFrame) -> DataFrame:
    """Nested records of search hits: name from the title, form and city from the snippet."""
    c = F.col
    title, snippet, link = (F.coalesce(c(n), F.lit("")) for n in ("title", "snippet", "link"))
    name = text.collapse_edges(F.split_part(title, F.lit("|"), F.lit(1)))
    for tail in (" - LinkedIn", " | Crunchbase"):
        name = text.collapse_edges(F.replace(name, F.lit(tail), F.lit("")))
    lowered = F.lower(snippet)
    form = F.when(lowered.contains("anonim şirket"), "Anonim Şirket").when(
        lowered.contains("limited şirket"), "Limited Şirket"
    )
    city = None
    for spellings, result in SNIPPET_CITIES:
        hit = reduce(lambda a, b: a | b, [snippet.contains(s) for s in spellings])
        city = F.when(hit, result) if city is None else city.when(hit, result)
    words = F.filter(F.split(snippet, r"(?U)\s+"), lambda w: F.length(w) > 0)
    return bronze.select(
        *company_record(
            id=F.md5(F.concat(F.lit("search:"), link)),
            identity=struct_of(
                schemas.IDENTITY,
                legal_name=text.collapse_spaces(name),
                company_type=form,
                city=city,
                country=F.lit("TR"),
            ),
            web_presence=struct_of(schemas.WEB_PRESENCE, social_links=F.create_map(F.lit("source_url"), link)),
            business_meta=struct_of(schemas.BUSINESS_META, keywords=F.slice(words, 1, 10)),
            provenance=F.array(provenance(link, "google_search", c("fetch_ts"), F.struct(snippet.alias("snippet")))),
            last_updated=c("processed_at"),
            created_at=c("created_at"),
        )
    )


def website_records(parsed: DataFrame, server: Column | None = None, fetched: Column | None = None) -> DataFrame:
    """Nested records of parsed pages (see ``parse_pages``), personal data filtered."""
    c = F.col
    fetched = F.current_timestamp() if fetched is None else fetched
    status = c("status_code") if "status_code" in parsed.columns else F.lit(None).cast("int")
    server = F.lit(None).cast("string") if server is None else server
    meta = F.struct(c("url"), status.alias("status_code"))
    records = parsed.select(
        *company_record(
            id=F.md5(F.concat(F.lit("website:"), c("url"))),
            identity=struct_of(
                schemas.IDENTITY,
                legal_name=text.collapse_spaces(name_from_domain(c("company_name"), c("url"))),
                country=F.lit("TR"),
            ),
            web_presence=struct_of(
                schemas.WEB_PRESENCE,
                website_url=c("url"),
                website_status_code=status,
                ssl_issuer=server,
                social_links=c("social_links"),
            ),
            contacts=struct_of(
                schemas.CONTACTS,
                emails_public=contact_emails(c("emails")),
                phones_public=F.transform("phones", text.normalize_phone),
                address_public=c("address"),
            ),
            business_meta=struct_of(schemas.BUSINESS_META, keywords=c("keywords")),
            seo_signals=struct_of(
                schemas.SEO_SIGNALS,
                title=c("title"),
                meta_description=c("meta_description"),
                h1_keywords=c("h1_keywords"),
            ),
            provenance=F.array(provenance(c("url"), "website", fetched, meta)),
            last_updated=fetched,
            created_at=fetched,
        )
    )
    return filter_pii(records, keep=KEYS)


def normalize_records(companies: DataFrame) -> DataFrame:
    """All normalisers over a nested record. The legal form is read before it is stripped."""
    c = F.col
    links = F.transform_values(
        c("web_presence.social_links"), lambda _, v: F.when(F.length(v) > 0, text.normalize_url(v)).otherwise(v)
    )

    def kept(column: str, fn) -> Column:
        return F.filter(F.transform(column, fn), lambda x: F.length(x) > 0)

    def present(name: str, value: Column) -> Column:
        return F.when(F.length(name) > 0, value).otherwise(c(name))

    identity = (
        c("identity")
        .withField("legal_name", text.normalize_name(c("identity.legal_name")))
        .withField("trade_name", present("identity.trade_name", text.normalize_name(c("identity.trade_name"))))
        .withField("city", present("identity.city", text.normalize_city(c("identity.city"))))
        .withField(
            "company_type", F.coalesce("identity.company_type", text.legal_form(c("identity.legal_name")))
        )
    )
    web = (
        c("web_presence")
        .withField(
            "website_url", present("web_presence.website_url", text.normalize_url(c("web_presence.website_url")))
        )
        .withField("social_links", links)
    )
    contacts = (
        c("contacts")
        .withField("emails_public", kept("contacts.emails_public", text.normalize_email))
        .withField("phones_public", kept("contacts.phones_public", text.normalize_phone))
        .withField(
            "address_public",
            present("contacts.address_public", text.normalize_address(c("contacts.address_public"))),
        )
    )
    return companies.withColumns(
        {
            "identity": identity,
            "web_presence": F.when(c("web_presence").isNotNull(), web),
            "contacts": F.when(c("contacts").isNotNull(), contacts),
        }
    )


def merge_sources(first: DataFrame, second: DataFrame, on: str = "id") -> DataFrame:
    """Complete records with a second source: its website wins, its contacts are appended."""
    c = F.col
    other = second.select(
        on, c("web_presence").alias("_web"), c("contacts").alias("_contacts")
    )
    joined = first.join(other, on, "left")

    def appended(field: str) -> Column:
        return F.concat(
            F.coalesce(f"contacts.{field}", _no_texts()), F.coalesce(f"_contacts.{field}", _no_texts())
        )

    web = c("web_presence").withField(
        "website_url", F.coalesce(text.blank_to_null(c("_web.website_url")), c("web_presence.website_url"))
    )
    contacts = (
        c("contacts")
        .withField("emails_public", appended("emails_public"))
        .withField("phones_public", appended("phones_public"))
    )
    return joined.withColumns(
        {
            "web_presence": F.when(c("web_presence").isNull(), c("_web")).otherwise(web),
            "contacts": F.when(c("contacts").isNull(), c("_contacts")).otherwise(contacts),
        }
    ).select(*first.columns)


def parsed_date(c: Column) -> Column:
    """The first of several usual date formats that fits."""
    formats = ["yyyy-MM-dd'T'HH:mm:ssX", "yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd", "dd-MMM-yyyy", "dd.MM.yyyy", "yyyy.MM.dd"]
    return F.coalesce(*[F.try_to_timestamp(c, F.lit(f)) for f in formats])


def enrich_from_registry(companies: DataFrame, registry: DataFrame) -> DataFrame:
    """Fill gaps from domain registrations: domain, org, creation_date, country, city, emails,
    registrar.

    The domain join shuffles both tables on it; a domain that very many records share is a
    skewed join that AQE splits, because a domain has one registration.
    """
    c = F.col
    one = registry.groupBy(F.lower("domain").alias("_domain")).agg(
        F.min(F.struct("org", "creation_date", "country", "city", "emails", "registrar")).alias("_r")
    )
    keyed = companies.withColumn("_domain", text.url_domain(c("web_presence.website_url")))
    joined = keyed.join(one, "_domain", "left")
    org = F.when(~is_personal_name(c("_r.org")), text.blank_to_null(c("_r.org")))
    founded = F.year(parsed_date(c("_r.creation_date")))
    corporate = F.transform(F.filter(c("_r.emails"), is_corporate_email), F.lower)
    identity = (
        c("identity")
        .withField("trade_name", F.coalesce(text.blank_to_null(c("identity.trade_name")), org))
        .withField("country", F.coalesce(text.blank_to_null(c("identity.country")), text.country_code(c("_r.country"))))
        .withField("city", F.coalesce(text.blank_to_null(c("identity.city")), text.blank_to_null(c("_r.city"))))
    )
    meta = c("business_meta").withField(
        "founding_year_guess", F.coalesce("business_meta.founding_year_guess", founded)
    )
    contacts = c("contacts").withField(
        "emails_public",
        F.when(
            F.size(corporate) > 0,
            F.sort_array(F.array_union(F.coalesce("contacts.emails_public", _no_texts()), corporate)),
        ).otherwise(c("contacts.emails_public")),
    )
    web = c("web_presence").withField(
        "ssl_issuer", F.coalesce("_r.registrar", "web_presence.ssl_issuer")
    )
    found = c("_r").isNotNull()
    return joined.withColumns(
        {
            "identity": F.when(found, identity).otherwise(c("identity")),
            "business_meta": F.when(found & c("business_meta").isNotNull(), meta).otherwise(c("business_meta")),
            "contacts": F.when(found & c("contacts").isNotNull(), contacts).otherwise(c("contacts")),
            "web_presence": F.when(found, web).otherwise(c("web_presence")),
        }
    ).select(*companies.columns)


def with_default_country(companies: DataFrame, country: str = "TR") -> DataFrame:
    """Country default, to be applied after enrichment had its say."""
    filled = F.coalesce(text.blank_to_null(F.col("identity.country")), F.lit(country))
    return companies.withColumn("identity", F.col("identity").withField("country", filled))
