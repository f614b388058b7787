"""Normalisers over names, links, numbers and addresses of the test tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from firmaforge.functions import similarity, text
from firmaforge.plans import views
from queries.registry import query

# A firm-like name out of a part: abbreviations, a legal form, punctuation.
PART_NAME = "p_name || ' tic  san ltd. ' || p_brand"
_NORM = """trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(
  upper({}), '\\s+', ' ', 'g'), '\\bTIC\\b', 'TİCARET', 'g'), '\\bSAN\\b', 'SANAYİ', 'g'), '\\bLTD\\b', '', 'g'),
  '[^\\p{{L}}\\p{{N}}_\\s&-]+|\\s+', ' ', 'g'))"""
NORMALIZED = f"regexp_replace({_NORM.format(PART_NAME)}, ' +', ' ', 'g')"


def part_names(spark, d):
    return views.table(spark, d, "part").select(
        "p_partkey", F.concat(F.col("p_name"), F.lit(" tic  san ltd. "), F.col("p_brand")).alias("raw")
    )


@query("norm_name", f"SELECT p_partkey, {NORMALIZED} AS name FROM part")
def norm_name(spark, d):
    return part_names(spark, d).select("p_partkey", text.normalize_name(F.col("raw")).alias("name"))


@query(
    "match_key",
    f"""SELECT p_partkey, regexp_replace(translate({NORMALIZED}, 'İ', 'I'), '[^A-Z0-9]', '', 'g') AS key,
          regexp_replace(replace(translate(replace({NORMALIZED}, 'I', ''), 'İ', 'I'), ' ', ''), '[^A-Z0-9]', '', 'g') AS compat_key
        FROM part""",
)
def match_key(spark, d):
    raw = F.col("raw")
    return part_names(spark, d).select(
        "p_partkey", text.match_key(raw).alias("key"), text.match_key(raw, compat=True).alias("compat_key")
    )


@query(
    "legal_form",
    """SELECT c_custkey, CASE c_custkey % 4 WHEN 0 THEN 'Anonim Şirket' WHEN 1 THEN 'Limited Şirket'
         WHEN 2 THEN 'Kolektif Şirket' END AS form FROM customer""",
)
def legal_form(spark, d):
    tail = F.element_at(F.array(*[F.lit(x) for x in (" A.S.", " ltd.", " KOL. ŞTİ.", " Inc")]), (F.col("c_custkey") % 4 + 1).cast("int"))
    named = views.table(spark, d, "customer").select("c_custkey", F.concat(F.col("c_name"), tail, F.lit(" ")).alias("n"))
    return named.select("c_custkey", text.legal_form(F.col("n")).alias("form"))


_URL = """regexp_replace(regexp_replace(CASE WHEN regexp_matches(lower(trim(url)), '^https?://') THEN lower(trim(url))
  ELSE 'https://' || lower(trim(url)) END, '/+$', ''), '://www\\.', '://', 'g')"""


@query("norm_url", f"SELECT page_id, {_URL} AS url FROM pages")
def norm_url(spark, d):
    return views.table(spark, d, "pages").select("page_id", text.normalize_url(F.col("url")).alias("url"))


@query(
    "norm_domain",
    "SELECT page_id, regexp_extract(lower(url), '^(?:https?://)?(?:www\\.)?([^/:?#\\s]+)', 1) AS domain FROM pages",
)
def norm_domain(spark, d):
    return views.table(spark, d, "pages").select("page_id", text.url_domain(F.col("url")).alias("domain"))


@query(
    "norm_phone",
    """SELECT c_custkey, '+90212' || lpad(CAST(c_custkey % 10000000 AS VARCHAR), 7, '0') AS phone FROM customer""",
)
def norm_phone(spark, d):
    """Five spellings of a number come out as one."""
    n = F.lpad((F.col("c_custkey") % 10000000).cast("string"), 7, "0")
    a, b = F.left(n, F.lit(3)), F.substring(n, 4, 4)
    spellings = F.array(
        F.concat(F.lit("0212 "), a, F.lit(" "), b),
        F.concat(F.lit("+90 (212) "), a, F.lit("-"), b),
        F.concat(F.lit("0212"), n),
        F.concat(F.lit("212"), n),
        F.concat(F.lit("90-212-"), n),
    )
    pick = F.element_at(spellings, (F.col("c_custkey") % 5 + 1).cast("int"))
    return views.table(spark, d, "customer").select("c_custkey", text.normalize_phone(pick).alias("phone"))


EMAIL_PATTERN = r"[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,}"


def document_emails(spark, d):
    return views.table(spark, d, "documents").select(
        "doc_id", F.explode(F.regexp_extract_all("text", F.lit(EMAIL_PATTERN), F.lit(0))).alias("email")
    )


DOCUMENT_EMAILS = f"emails AS (SELECT doc_id, unnest(regexp_extract_all(text, '{EMAIL_PATTERN}')) AS email FROM documents)"


@query(
    "norm_email",
    f"""WITH {DOCUMENT_EMAILS} SELECT doc_id, lower(email) AS email, split_part(lower(email), '@', 2) AS host FROM emails""",
)
def norm_email(spark, d):
    shouted = F.concat(F.lit("  MAILTO:"), F.upper("email"), F.lit(" "))
    return document_emails(spark, d).select(
        "doc_id", text.normalize_email(shouted).alias("email"), text.email_domain(shouted).alias("host")
    )


@query(
    "norm_city",
    """SELECT c_custkey, CASE c_custkey % 3 WHEN 0 THEN 'İstanbul' WHEN 1 THEN 'İzmir'
         ELSE upper(left(n_name, 1)) || lower(substr(n_name, 2)) END AS city
       FROM customer JOIN nation ON c_nationkey = n_nationkey""",
)
def norm_city(spark, d):
    raw = F.when(F.col("c_custkey") % 3 == 0, " istanbul").when(F.col("c_custkey") % 3 == 1, "IZMIR ").otherwise(F.col("city"))
    return views.customers(spark, d).select("c_custkey", text.normalize_city(raw).alias("city"))


@query(
    "norm_address",
    """SELECT c_custkey, 'Gül Mahallesi Ata Caddesi No: ' || c_custkey || ' ' || n_name AS address, n_name AS city
       FROM customer JOIN nation ON c_nationkey = n_nationkey""",
)
def norm_address(spark, d):
    raw = F.concat(F.lit(" Gül Mah.  Ata Cad. No: "), F.col("c_custkey"), F.lit("\t"), F.col("city"))
    comma = F.concat(raw, F.lit(", "), F.col("city"), F.lit(" , TR"))
    return views.customers(spark, d).select(
        "c_custkey", text.normalize_address(raw).alias("address"), text.address_city(comma).alias("city")
    )


@query(
    "country_code",
    """SELECT c_custkey, CASE c_nationkey % 4 WHEN 0 THEN 'TR' WHEN 1 THEN 'GB' WHEN 2 THEN 'DE' END AS code FROM customer""",
)
def country_code(spark, d):
    names = F.array(*[F.lit(x) for x in ("Republic of Türkiye", "United Kingdom (GB)", "GERMANY", "Atlantis")])
    pick = F.element_at(names, F.col("c_nationkey") % 4 + 1)
    return views.table(spark, d, "customer").select("c_custkey", text.country_code(pick).alias("code"))


@query(
    "tokens_and_ngrams",
    """SELECT p_partkey, array_to_string(list_filter(string_split_regex(lower(p_name || ' ' || p_brand), '[^\\p{L}\\p{N}]+'), lambda w: w <> ''), ' ') AS tokens,
         array_to_string(list_transform(range(2, least(len(split_part(p_name, ' ', 1)), 20) + 1), lambda n: left(split_part(p_name, ' ', 1), n)), ' ') AS grams
       FROM part""",
)
def tokens_and_ngrams(spark, d):
    words = text.tokens(F.concat_ws(" ", "p_name", "p_brand"))
    return views.table(spark, d, "part").select(
        "p_partkey",
        F.array_join(words, " ").alias("tokens"),
        F.array_join(text.edge_ngrams(F.element_at(words, 1)), " ").alias("grams"),
    )


def _lcs_sql(a: str, b: str) -> str:
    """One row of the table per letter of ``a``; ``b`` is walked inside."""
    inner = (
        f"list_reduce(range(1, len({b}) + 1), lambda row, j: list_append(row, "
        f"CASE WHEN substr({b}, CAST(j AS INTEGER), 1) = ch THEN prev[j] + 1 ELSE greatest(prev[j + 1], row[-1]) END), [0::BIGINT])"
    )
    zeros = f"list_transform(range(0, len({b}) + 1), lambda z: 0::BIGINT)"
    return f"list_reduce(string_split({a}, ''), lambda prev, ch: {inner}, {zeros})[-1]"


@query(
    "similarity_ratios",
    f"""WITH pairs AS (SELECT a.p_partkey AS key, a.p_name AS a, b.p_name AS b FROM part a JOIN part b ON b.p_partkey = a.p_partkey + 1),
        sorted AS (SELECT *, array_to_string(list_sort(string_split(a, ' ')), ' ') AS sa, array_to_string(list_sort(string_split(b, ' ')), ' ') AS sb FROM pairs)
        SELECT key, a, b, round_even(100.0 * (2.0 * {_lcs_sql('a', 'b')} / (len(a) + len(b))), 0) / 100 AS ratio,
          round_even(100.0 * (2.0 * {_lcs_sql('sa', 'sb')} / (len(sa) + len(sb))), 0) / 100 AS token_ratio,
          CAST(a = b AS DOUBLE) AS exact
        FROM sorted""",
)
def similarity_ratios(spark, d):
    """The name of each part and of its successor, compared by both ratios."""
    names = views.table(spark, d, "part").select("p_partkey", "p_name")
    a, b = F.col("a"), F.col("b")
    after = names.select((F.col("p_partkey") - 1).alias("key"), F.col("p_name").alias("b"))
    return names.toDF("key", "a").join(after, "key").select(
        "key",
        "a",
        "b",
        similarity.ratio(a, b, arrow=True).alias("ratio"),
        similarity.token_sort_ratio(a, b, arrow=True).alias("token_ratio"),
        similarity.exact_similarity(a, b).alias("exact"),
    )
