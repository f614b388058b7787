"""Record matching over firm records with planted copies and near copies.

Every customer is a firm; three firms share a site. A firm has up to five records: its own, a
copy in capitals with a legal form, one with a shorter name, more numbers and mail hosts, one with
the words of the name swapped and other contacts, and one of a supplier, as a second source.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from firmaforge import schemas
from firmaforge.functions import text
from firmaforge.functions.privacy import provenance
from firmaforge.operators import resolve as r
from firmaforge.plans import views
from firmaforge.session import cut
from queries.registry import query
from queries.texts import _lcs_sql

FIRST = ["Amber", "Cobalt", "Granite", "Harbour", "Juniper", "Orchid", "Willow"]
SECOND = [
    "Logistics", "Trading", "Foods", "Textiles", "Großhandel", "Machinery", "Ceramics", "Press", "Marine", "Optics", "Works",
]
LAST_VARIANT = 4


def firm_variants(spark, d):
    """k (firm), v (which of its records), nation."""
    k, v = F.col("k"), F.col("v")
    customers = views.table(spark, d, "customer").select(F.col("c_custkey").alias("k"), F.col("c_nationkey").alias("nation"))
    own = customers.withColumn("v", F.explode(F.array(*[F.lit(i) for i in range(LAST_VARIANT)])))
    own = own.filter((v == 0) | ((v == 1) & (k % 2 == 0)) | ((v == 2) & (k % 3 == 0)) | ((v == 3) & (k % 5 == 0)))
    suppliers = views.table(spark, d, "supplier").select(
        (F.col("s_suppkey") * 10).alias("k"), F.col("s_nationkey").alias("nation"), F.lit(LAST_VARIANT).alias("v")
    )
    # A small file makes many records, so the keys are dealt out before.
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return own.unionByName(suppliers).repartition(parts, "k", "v")


def flat_records(spark, d):
    k, v = F.col("k"), F.col("v")

    def by_variant(*options):
        out = F.when(v == 0, options[0])
        for i, option in enumerate(options[1:], 1):
            out = out.when(v == i, option)
        return out

    def word(words, at):
        return F.element_at(F.array(*[F.lit(w) for w in words]), (at % len(words) + 1).cast("int"))

    def number(area: str):
        return F.concat(F.lit(f"{area} "), F.lpad(k.cast("string"), 7, "0"))

    one, two, site = F.col("one"), F.col("two"), F.col("site")
    name = F.concat_ws(" ", one, two, F.concat(F.lit("F"), k))
    street = F.concat(two, F.lit(" Street "), k * 37 % 1000, F.lit(" Block "), k % 13)
    info, mail = F.concat(F.lit("INFO@"), site), F.concat(F.lit("x"), k, F.lit("@mail.example"))
    named = firm_variants(spark, d).select(
        "k", "v", "nation", word(FIRST, k).alias("one"), word(SECOND, F.floor(k / 7)).alias("two"),
        F.concat(F.lit("c"), F.floor(k / 3), F.lit(".example.com")).alias("site"),
    )
    # A stored table, as records are in practice: their making is not to be planned into every use.
    return cut(named.select(
        F.concat(F.lpad(k.cast("string"), 9, "0"), F.lit("-"), v).alias("id"),
        by_variant(
            name,
            F.concat(F.upper(name), F.lit(" LTD.")),
            F.concat(F.lit("The "), one, F.lit(" F"), k),
            F.concat_ws(" ", two, F.concat(F.lit("F"), k), one),
            name,
        ).alias("legal_name"),
        F.when(v != 3, F.concat(F.lit("City "), "nation")).alias("city"),
        F.concat(F.lit("https://www."), site, F.lit("/"), v).alias("website_url"),
        by_variant(
            F.array(number("0212")), F.array(number("0212")), F.array(number("0216"), number("0212")),
            F.array(number("0216")), F.array(number("0212"), number("0232")),
        ).alias("phones"),
        by_variant(
            F.array(info), F.array(info), F.array(F.concat(F.lit("sales@"), site), mail), F.array(mail), F.array(info)
        ).alias("emails"),
        by_variant(street, street, F.concat(two, F.lit(" Street "), k % 97), street, F.upper(street)).alias("address"),
        F.concat(F.lit("src"), k % 20 + v).alias("source"),
        ((k % 10 + v) / 20.0).cast("double").alias("confidence"),
    ))


def records(spark, d):
    """The same as nested company records."""
    c = F.col
    return flat_records(spark, d).select(
        *schemas.company_record(
            id=c("id"),
            identity=schemas.struct_of(schemas.IDENTITY, legal_name=c("legal_name"), trade_name=c("source"), city=c("city")),
            web_presence=schemas.struct_of(
                schemas.WEB_PRESENCE, website_url=c("website_url"), social_links=F.create_map(c("source"), c("id"))
            ),
            contacts=schemas.struct_of(
                schemas.CONTACTS, emails_public=c("emails"), phones_public=c("phones"), address_public=c("address")
            ),
            business_meta=schemas.struct_of(schemas.BUSINESS_META, keywords=F.array(c("source"), c("city"))),
            provenance=F.array(
                provenance(c("website_url"), "website", F.lit("2024-06-01").cast("timestamp"), F.struct("id"))
            ),
            confidence_score=c("confidence"),
        )
    )


_UPPER = "upper(replace(legal_name, 'ß', 'SS'))"
_NAME = f"regexp_replace({_UPPER}, '\\bLTD\\b', '', 'g')"
_NAME = f"trim(regexp_replace({_NAME}, '[^\\p{{L}}\\p{{N}}_&-]+', ' ', 'g'))"
_TOKENS = (
    f"array_to_string(list_sort(list_filter(string_split(trim(regexp_replace(regexp_replace(lower({_NAME}), '[^\\x00-\\x7f]', '', 'g'), "
    "'[^a-z0-9_]+', ' ', 'g')), ' '), lambda w: w <> '')), ' ')"
)


def _by_variant(*options: str) -> str:
    return "CASE v " + " ".join(f"WHEN {i} THEN {o}" for i, o in enumerate(options)) + " END"


def _number(area: str) -> str:
    return f"'{area}' || lpad(CAST(k AS VARCHAR), 7, '0')"


_NAMED = "one || ' ' || two || ' F' || k"
_STREET = "two || ' Street ' || (k * 37 % 1000) || ' Block ' || (k % 13)"
_INFO, _MAIL = "'INFO@' || site", "'x' || k || '@mail.example'"
_RECORDS = f"""firms AS (SELECT c_custkey AS k, c_nationkey AS nation, v FROM customer, (SELECT unnest([0, 1, 2, 3]) AS v)
      WHERE v = 0 OR (v = 1 AND c_custkey % 2 = 0) OR (v = 2 AND c_custkey % 3 = 0) OR (v = 3 AND c_custkey % 5 = 0)
    UNION ALL SELECT s_suppkey * 10, s_nationkey, {LAST_VARIANT} FROM supplier),
  named AS (SELECT k, nation, v, ({FIRST})[k % {len(FIRST)} + 1] AS one, ({SECOND})[k // 7 % {len(SECOND)} + 1] AS two,
    'c' || (k // 3) || '.example.com' AS site FROM firms),
  recs AS (SELECT lpad(CAST(k AS VARCHAR), 9, '0') || '-' || v AS id, CASE WHEN v <> 3 THEN 'City ' || nation END AS city,
    'src' || (k % 20 + v) AS source, (k % 10 + v) / 20e0 AS own_confidence, site AS host, 'https://www.' || site || '/' || v AS url,
    {_by_variant(_NAMED, f"upper(replace({_NAMED}, 'ß', 'SS')) || ' LTD.'", "'The ' || one || ' F' || k", "two || ' F' || k || ' ' || one", _NAMED)} AS legal_name,
    {_by_variant(f"[{_number('+90212')}]", f"[{_number('+90212')}]", f"[{_number('+90216')}, {_number('+90212')}]", f"[{_number('+90216')}]", f"[{_number('+90212')}, {_number('+90232')}]")} AS numbers,
    {_by_variant(f"[{_INFO}]", f"[{_INFO}]", f"['sales@' || site, {_MAIL}]", f"[{_MAIL}]", f"[{_INFO}]")} AS emails,
    {_by_variant(_STREET, _STREET, "two || ' Street ' || (k % 97)", _STREET, f"upper(replace({_STREET}, 'ß', 'SS'))")} AS street
    FROM named),
  feats AS MATERIALIZED (SELECT *, {_TOKENS} AS name, {_NAME} <> '' AS has_name, lower(street) AS address, list_sort(numbers) AS phones,
    list_sort(list_distinct(list_transform(emails, lambda e: lower(split_part(e, '@', 2))))) AS hosts FROM recs)"""

# Sums in the order and the doubles of the engine, so that thresholds are compared as they stand.
_PAIRS = f"""{_RECORDS},
  blocks AS (SELECT a.id AS a, b.id AS b, a.name AS na, b.name AS nb, a.address AS aa, b.address AS ab,
      list_has_any(a.phones, b.phones) AS p, list_has_any(a.hosts, b.hosts) AS e, a.has_name AND b.has_name AS named
    FROM feats a JOIN feats b ON a.host = b.host AND a.id < b.id),
  graded AS (SELECT *, CASE WHEN NOT named THEN 0e0 WHEN na = nb THEN 1e0 WHEN na = '' OR nb = '' THEN 0e0
      ELSE round_even(1e2 * (2e0 * {_lcs_sql('na', 'nb')} / (len(na) + len(nb))), 0) / 1e2 END AS n,
    CASE WHEN aa = '' OR ab = '' THEN 0e0 WHEN aa = ab THEN 1e0
      ELSE round_even(1e2 * (2e0 * {_lcs_sql('aa', 'ab')} / (len(aa) + len(ab))), 0) / 1e2 END AS d FROM blocks),
  scored AS (SELECT *, (0.35e0 + n * 0.25e0 + CAST(p AS INT) * 0.15e0 + CAST(e AS INT) * 0.15e0 + d * 0.10e0)
      / (0.35e0 + 0.25e0 + 0.15e0 + 0.15e0 + 0.10e0) AS score FROM graded),
  matches AS MATERIALIZED (SELECT a, b, round(score, 6) AS score, score >= 0.85e0 AND score < 0.95e0 AS review,
      CASE WHEN score >= 0.95e0 THEN 'exact' ELSE 'fuzzy' END AS kind FROM scored WHERE score >= 0.70e0)"""


@query(
    "er_blocking",
    f"""WITH {_RECORDS} SELECT id, 'domain:' || host AS domain_key, 'phone:' || left(numbers[1], 6) AS phone_key,
          'city:' || upper(city) AS city_key FROM feats""",
)
def er_blocking(spark, d):
    c = F.col
    keys = r.blocking_keys(c("legal_name"), c("website_url"), c("phones"), c("city"))

    def of(kind: str):
        return F.try_element_at(F.filter(c("_k"), lambda k: k.startswith(kind)), F.lit(1))

    return flat_records(spark, d).withColumn("_k", keys).select(
        "id", of("domain:").alias("domain_key"), of("phone:").alias("phone_key"), of("city:").alias("city_key")
    )


@query(
    "er_pairs",
    f"WITH {_PAIRS} SELECT a AS company_a_id, b AS company_b_id, score AS match_score, kind AS match_type, review AS requires_review FROM matches",
)
def er_pairs(spark, d):
    pairs = r.expand_matches(r.match_features(flat_records(spark, d)))
    return pairs.select(
        "company_a_id", "company_b_id", F.round("match_score", 6).alias("match_score"), "match_type", "requires_review"
    )


@query(
    "er_matches",
    f"""WITH {_PAIRS}, same AS (SELECT id, min(id) OVER (PARTITION BY has_name, name, host, phones, hosts, address) AS first FROM feats)
        SELECT a AS company_a_id, b AS company_b_id, score AS match_score, kind AS match_type
        FROM matches JOIN same x ON x.id = a JOIN same y ON y.id = b
        WHERE (x.first = a AND y.first = b) OR (x.first = y.first AND x.first = a)""",
)
def er_matches(spark, d):
    """Edges with copies tied to the first of their group only."""
    found = r.find_matches(r.match_features(flat_records(spark, d)))
    return found.select("company_a_id", "company_b_id", F.round("match_score", 6).alias("match_score"), "match_type")


_GROUPS = """edges AS (SELECT a, b FROM matches WHERE kind = 'exact' UNION SELECT b, a FROM matches WHERE kind = 'exact'),
  reach AS (SELECT a AS id, b AS other FROM edges UNION SELECT reach.id, edges.b FROM reach JOIN edges ON edges.a = reach.other),
  groups AS (SELECT id, min(other) AS component FROM reach GROUP BY id)"""


@query("er_components", f"WITH RECURSIVE {_PAIRS}, {_GROUPS} SELECT id, component FROM groups")
def er_components(spark, d):
    return r.merge_groups(r.match_features(flat_records(spark, d)))


@query(
    "er_merge",
    f"""WITH RECURSIVE {_PAIRS}, {_GROUPS},
        joined AS (SELECT groups.component, feats.* FROM groups JOIN feats ON feats.id = groups.id)
        SELECT component AS id, min_by(legal_name, id) AS legal_name, min_by(source, id) AS trade_name,
          string_agg(DISTINCT source, ',' ORDER BY source) AS sources, CAST(count(DISTINCT source) AS INTEGER) AS links,
          max(length(street)) AS address_length, array_to_string(list_sort(list_distinct(flatten(list(numbers)))), ',') AS phones,
          lower(array_to_string(list_sort(list_distinct(flatten(list(joined.emails)))), ',')) AS emails, min_by(url, id) AS website,
          round(list_reduce(list(own_confidence ORDER BY id), lambda acc, x: (acc + x) / 2), 9) AS confidence
        FROM joined GROUP BY component""",
)
def er_merge(spark, d):
    """Merged records only: scalar, set and map fields, and the mean that halves record by record."""
    companies = records(spark, d)
    groups = r.merge_groups(r.features(companies))
    merged = r.merge(companies, groups)
    return merged.select(
        "id",
        "identity.legal_name",
        "identity.trade_name",
        F.array_join(F.filter("business_meta.keywords", lambda k: k.startswith("src")), ",").alias("sources"),
        F.size("web_presence.social_links").alias("links"),
        F.length("contacts.address_public").cast("bigint").alias("address_length"),
        F.array_join(F.array_sort(F.transform("contacts.phones_public", text.normalize_phone)), ",").alias("phones"),
        F.lower(F.array_join("contacts.emails_public", ",")).alias("emails"),
        F.col("web_presence.website_url").alias("website"),
        F.round("confidence_score", 9).alias("confidence"),
    )


@query(
    "er_resolve",
    f"""WITH RECURSIVE {_PAIRS}, {_GROUPS} SELECT id, legal_name, source AS trade_name, url AS website FROM feats WHERE id NOT IN (SELECT id FROM groups)
        UNION ALL SELECT component, min_by(legal_name, id), min_by(source, id), min_by(url, id) FROM groups JOIN feats USING (id) GROUP BY 1""",
)
def er_resolve(spark, d):
    done = r.resolve(records(spark, d)).companies
    return done.select("id", "identity.legal_name", "identity.trade_name", F.col("web_presence.website_url").alias("website"))


@query(
    "er_provenance",
    f"""WITH RECURSIVE {_PAIRS}, {_GROUPS} SELECT coalesce(component, id) AS id, url AS source_url, 'website' AS source_type,
          md5('{{"id":"' || id || '"}}') AS hash FROM feats LEFT JOIN groups USING (id)""",
)
def er_provenance(spark, d):
    """Where each record, merged or not, came from: one row per entry."""
    return r.resolve(records(spark, d)).provenance.select("id", "source_url", "source_type", "hash")


@query(
    "er_review_queue",
    f"""WITH {_PAIRS}, same AS (SELECT id, min(id) OVER (PARTITION BY has_name, name, host, phones, hosts, address) AS first FROM feats)
        SELECT a AS company_a_id, b AS company_b_id, score AS match_score
        FROM matches JOIN same x ON x.id = a JOIN same y ON y.id = b
        WHERE review AND ((x.first = a AND y.first = b) OR (x.first = y.first AND x.first = a))""",
)
def er_review_queue(spark, d):
    """Copies stand behind the first of their group and are decided with it."""
    found = r.find_matches(r.match_features(flat_records(spark, d)))
    return r.review_queue(found).select("company_a_id", "company_b_id", F.round("match_score", 6).alias("match_score"))


@query(
    "er_aliases",
    f"""WITH RECURSIVE {_PAIRS}, {_GROUPS}, j AS (SELECT component, legal_name, source FROM groups JOIN feats ON feats.id = groups.id)
        SELECT DISTINCT component AS id, 'legal' AS kind, legal_name AS name FROM j UNION SELECT DISTINCT component, 'trade', source FROM j""",
)
def er_aliases(spark, d):
    companies = records(spark, d)
    return r.aliases(companies, r.merge_groups(r.features(companies)))


_KEY = f"regexp_replace(translate({_NAME}, 'İIĞÜŞÖÇ', 'I'), '[^A-Z0-9]', '', 'g')"
_BLOCKS = f"""blocked AS (SELECT *, concat_ws('|', 'domain:' || host, CASE WHEN len({_KEY}) >= 3 THEN 'name:' || left({_KEY}, 3) END,
    'phone:' || left(numbers[1], 6), 'city:' || upper(city)) AS block FROM feats),
  same AS (SELECT id, block, min(id) OVER (PARTITION BY block, has_name, name, host, phones, hosts, address) AS first FROM blocked)"""


@query(
    "er_compat",
    f"""WITH {_PAIRS}, {_BLOCKS} SELECT a AS company_a_id, b AS company_b_id, score AS match_score, kind AS match_type
        FROM matches JOIN same x ON x.id = a JOIN same y ON y.id = b
        WHERE x.block = y.block AND ((x.first = a AND y.first = b) OR (x.first = y.first AND x.first = a))""",
)
def er_compat(spark, d):
    """Only records whose blocking keys all agree are compared."""
    found = r.find_matches(r.match_features(flat_records(spark, d)), compat=True)
    return found.select("company_a_id", "company_b_id", F.round("match_score", 6).alias("match_score"), "match_type")
