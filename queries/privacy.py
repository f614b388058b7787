"""Personal data: detection, masking, filtering, suppression, requests and reports."""

from __future__ import annotations

from pyspark.sql import functions as F

from firmaforge.functions import privacy as p
from firmaforge.operators import compliance as ops
from firmaforge.plans import views
from queries.registry import query
from queries.texts import DOCUMENT_EMAILS, document_emails

# The SQL twin has ASCII word boundaries only, so letters beyond ASCII are spelt as 'a' first.
_PLAIN = "regexp_replace(text, '[^\\x00-\\x7f]', 'a', 'g')"


def _pii_sql(t: str) -> dict[str, str]:
    return {
        "tc_kimlik": f"regexp_matches({t}, '\\b\\d{{11}}\\b', 'i')",
        "credit_card": f"regexp_matches({t}, '\\b\\d{{4}}[\\s-]?\\d{{4}}[\\s-]?\\d{{4}}[\\s-]?\\d{{4}}\\b', 'i')",
        "iban": f"regexp_matches({t}, '\\b[A-Z]{{2}}\\d{{2}}[A-Z0-9]{{4}}\\d{{7}}[A-Z0-9]{{0,16}}\\b', 'i')",
        "passport": f"regexp_matches({t}, '\\b[A-Z][0-9]{{8}}\\b', 'i')",
    }


NAME_SQL = (
    "(regexp_matches({0}, '^\\s*\\p{{Lu}}\\S*\\s+\\p{{Lu}}\\S*\\s*$') AND "
    "regexp_matches({0}, '(?:^|[^\\p{{L}}\\p{{N}}_])(?:[A-Z][a-z]+\\s+[A-Z][a-z]+|[A-Z]\\.\\s*[A-Z][a-z]+)(?:$|[^\\p{{L}}\\p{{N}}_])') AND "
    "NOT regexp_matches({0}, 'Ltd|Inc|Corp|Company|Group|A\\.Ş\\.'))"
)


def _kinds_sql(t: str, plain: str) -> str:
    kinds = [f"CASE WHEN {c} THEN '{n}' END" for n, c in _pii_sql(plain).items()]
    kinds.append(f"CASE WHEN {NAME_SQL.format(t)} THEN 'personal_name' END")
    return "concat_ws(',', " + ", ".join(kinds) + ")"


@query("pii_detect", f"SELECT doc_id, {_kinds_sql('text', _PLAIN)} AS kinds FROM documents")
def pii_detect(spark, d):
    return views.table(spark, d, "documents").select(
        "doc_id", F.array_join(p.detect_pii(F.col("text")), ",").alias("kinds")
    )


@query(
    "pii_kinds",
    f"""WITH k AS (SELECT unnest(string_split({_kinds_sql('text', _PLAIN)}, ',')) AS kind FROM documents)
        SELECT kind, count(*) AS count FROM k WHERE kind <> '' GROUP BY 1""",
)
def pii_kinds(spark, d):
    return ops.pii_kinds(views.table(spark, d, "documents"), "text")


CORPORATE = (
    "(regexp_matches(lower(split_part({0}, '@', 1)), '^(" + "|".join(p.CORPORATE_PREFIXES) + ")') OR "
    "(NOT regexp_full_match(lower(split_part({0}, '@', 1)), '\\p{{L}}+\\.\\p{{L}}+') AND "
    "NOT regexp_matches(split_part({0}, '@', 1), '\\d')))"
)
_EMAIL_SQL = "[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\\.[a-zA-Z]{2,}"


def _mask_sql(t: str) -> str:
    patterns = [
        "\\b\\d{11}\\b",
        "\\b\\d{4}[\\s-]?\\d{4}[\\s-]?\\d{4}[\\s-]?\\d{4}\\b",
        "\\b[A-Z]{2}\\d{2}[A-Z0-9]{4}\\d{7}[A-Z0-9]{0,16}\\b",
        "\\b[A-Z][0-9]{8}\\b",
    ]
    for pattern in patterns:
        t = f"regexp_replace({t}, '{pattern}', '[REDACTED]', 'gi')"
    return t


@query(
    "pii_mask",
    f"""WITH m AS (SELECT doc_id, {_mask_sql('text')} AS t FROM documents),
        e AS (SELECT *, list_filter(regexp_extract_all(t, '\\b{_EMAIL_SQL}\\b'), lambda e: NOT {CORPORATE.format('e')}) AS personal FROM m)
        SELECT doc_id, md5(CASE WHEN len(personal) = 0 THEN t
          ELSE list_reduce(personal, lambda acc, e: replace(acc, e, '[EMAIL_REDACTED]'), t) END) AS masked_md5 FROM e""",
)
def pii_mask(spark, d):
    return views.table(spark, d, "documents").select("doc_id", F.md5(p.mask_pii(F.col("text"))).alias("masked_md5"))


@query(
    "email_corporate",
    f"""WITH {DOCUMENT_EMAILS} SELECT doc_id, email, {CORPORATE.format('email')} AS corporate,
          regexp_matches(lower(split_part(email, '@', 1)), '^({"|".join(p.CONTACT_PREFIXES)})')
            OR NOT regexp_matches(split_part(email, '@', 1), '[\\d.]') AS contact FROM emails""",
)
def email_corporate(spark, d):
    e = F.col("email")
    return document_emails(spark, d).select(
        "doc_id", "email", p.is_corporate_email(e).alias("corporate"), p.is_contact_email(e).alias("contact")
    )


@query(
    "personal_name",
    f"""SELECT doc_id, CAST(len(s) AS INTEGER) AS sentences, CAST(len(list_filter(s, lambda x: {NAME_SQL.format('x')})) AS INTEGER) AS personal
        FROM (SELECT doc_id, regexp_split_to_array(text, '[.\\n]') AS s FROM documents)""",
)
def personal_name(spark, d):
    """How many sentences of a document read as a name?"""
    sentences = F.split("text", r"[.\n]")
    return views.table(spark, d, "documents").select(
        "doc_id",
        F.size(sentences).alias("sentences"),
        F.size(F.filter(sentences, p.is_personal_name)).alias("personal"),
    )


_TAINTED = "(" + " OR ".join(_pii_sql("regexp_replace({0}, '[^\\x00-\\x7f]', 'a', 'g')").values()).replace("{0}", "@@") + ")"
_TAINTED = _TAINTED.replace("{", "{{").replace("}", "}}").replace("@@", "{0}")


@query(
    "pii_filter_record",
    f"""WITH r AS (SELECT doc_id, text, string_split(text, chr(10)) AS lines FROM documents),
        k AS (SELECT *, list_filter(lines, lambda x: NOT ({_TAINTED.format('x')} OR {NAME_SQL.format('x')})) AS kept,
          {_TAINTED.format('text')} OR {NAME_SQL.format('text')} AS tainted FROM r),
        m AS (SELECT *, {_mask_sql('text')} AS t FROM k),
        e AS (SELECT *, list_filter(regexp_extract_all(t, '\\b{_EMAIL_SQL}\\b'), lambda e: NOT {CORPORATE.format('e')}) AS personal FROM m)
        SELECT doc_id, CAST(len(kept) AS INTEGER) AS lines_kept, md5(array_to_string(kept, chr(10))) AS lines_md5,
          md5(CASE WHEN NOT tainted THEN text WHEN len(personal) = 0 THEN t
            ELSE list_reduce(personal, lambda acc, e: replace(acc, e, '[EMAIL_REDACTED]'), t) END) AS text_md5
        FROM e""",
)
def pii_filter_record(spark, d):
    """A nested record: its text is masked, tainted lines are dropped from the list."""
    records = views.table(spark, d, "documents").select(
        "doc_id", F.struct("text", F.split("text", "\n").alias("lines")).alias("body")
    )
    return p.filter_pii(records, keep=("doc_id",)).select(
        "doc_id",
        F.size("body.lines").alias("lines_kept"),
        F.md5(F.array_join("body.lines", "\n")).alias("lines_md5"),
        F.md5("body.text").alias("text_md5"),
    )


def suppressed(spark, d):
    asked = views.table(spark, d, "customer").filter("c_custkey % 10 = 0")
    return ops.suppression_list(asked, "c_custkey")


@query(
    "suppression_antijoin",
    "SELECT c_custkey, c_name, sha256(CAST(c_custkey AS VARCHAR)) AS id_hash FROM customer WHERE c_custkey % 10 <> 0",
)
def suppression_antijoin(spark, d):
    kept = ops.without_suppressed(views.table(spark, d, "customer"), suppressed(spark, d), "c_custkey")
    return kept.select("c_custkey", "c_name", p.hash_identifier(F.col("c_custkey")).alias("id_hash"))


@query(
    "suppression_check",
    "SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey % 10 = 0",
)
def suppression_check(spark, d):
    """Orders of suppressed customers."""
    return ops.only_suppressed(views.table(spark, d, "orders"), suppressed(spark, d), "o_custkey").select(
        "o_orderkey", "o_custkey"
    )


def requests(spark, d):
    """One request per tenth customer: deletion, export, suppression or an unknown action."""
    key = F.col("c_custkey")
    actions = F.array(*[F.lit(a) for a in ("delete", "export", "suppress", "rename")])
    return views.table(spark, d, "customer").filter(key % 10 == 0).select(
        F.element_at(actions, (key / 10 % 4 + 1).cast("int")).alias("action"),
        F.when(key % 20 == 10, F.col("c_name")).otherwise(key.cast("string")).alias("identifier"),
        F.concat(F.lit("dpo@c"), key, F.lit(".example.com")).alias("requester"),
    )


_REQUESTS = """requests AS (SELECT ['delete', 'export', 'suppress', 'rename'][CAST(c_custkey // 10 % 4 + 1 AS INTEGER)] AS action,
  CASE WHEN c_custkey % 20 = 10 THEN c_name ELSE CAST(c_custkey AS VARCHAR) END AS identifier,
  'dpo@c' || c_custkey || '.example.com' AS requester FROM customer WHERE c_custkey % 10 = 0)"""


@query(
    "soft_delete",
    f"""WITH {_REQUESTS} SELECT c_custkey, requester IS NOT NULL AS gdpr_suppressed,
          CASE WHEN requester IS NOT NULL THEN '2024-06-01' END AS suppressed_on, requester AS suppression_requester
        FROM customer LEFT JOIN requests ON action = 'delete' AND identifier = CAST(c_custkey AS VARCHAR)""",
)
def soft_delete(spark, d):
    deletes = requests(spark, d).filter("action = 'delete'")
    flagged = ops.soft_delete(views.table(spark, d, "customer"), deletes, "c_custkey", views.AS_OF)
    return flagged.select(
        "c_custkey",
        "gdpr_suppressed",
        F.date_format("suppression_date", "yyyy-MM-dd").alias("suppressed_on"),
        "suppression_requester",
    )


def _firms(spark, d):
    return views.table(spark, d, "customer").select(
        F.col("c_custkey").cast("string").alias("id"), F.col("c_name").alias("legal_name"), "c_mktsegment"
    )


@query(
    "subject_export",
    f"""WITH {_REQUESTS} SELECT CAST(c_custkey AS VARCHAR) AS id, c_name AS legal_name, c_mktsegment FROM customer
        WHERE EXISTS (SELECT 1 FROM requests WHERE action = 'export' AND (identifier = CAST(c_custkey AS VARCHAR) OR identifier = c_name))""",
)
def subject_export(spark, d):
    return ops.subject_export(_firms(spark, d), requests(spark, d).filter("action = 'export'"))


@query(
    "compliance_requests",
    f"""WITH {_REQUESTS} SELECT action, identifier AS entity_id, requester,
          CASE WHEN action = 'delete' THEN 'DEL-20240601000000-' || left(identifier, 8) END AS reference_id,
          CASE action WHEN 'delete' THEN 'accepted' WHEN 'rename' THEN 'rejected' ELSE 'completed' END AS status,
          CASE WHEN action = 'rename' THEN 'Invalid action' END AS notes FROM requests""",
)
def compliance_requests(spark, d):
    out = ops.process_requests(
        requests(spark, d), _firms(spark, d), _firms(spark, d), suppressed(spark, d), at=views.AS_OF
    )
    return out["audit"].select(
        "action", "entity_id", F.col("requester_info")["requester"].alias("requester"), "reference_id", "status", "notes"
    )


@query(
    "search_set_after_requests",
    f"""WITH {_REQUESTS} SELECT CAST(c_custkey AS VARCHAR) AS id FROM customer
        WHERE CAST(c_custkey AS VARCHAR) NOT IN (SELECT identifier FROM requests WHERE action = 'delete')""",
)
def search_set_after_requests(spark, d):
    out = ops.process_requests(
        requests(spark, d), _firms(spark, d), _firms(spark, d), suppressed(spark, d), at=views.AS_OF
    )
    return out["search_set"].select("id")


@query(
    "retention_status",
    """SELECT o_orderkey, CASE WHEN date_diff('day', CAST(o_orderdate AS DATE), DATE '2000-01-01') <= 365 THEN 'active'
         WHEN date_diff('day', CAST(o_orderdate AS DATE), DATE '2000-01-01') <= 730 THEN 'archive' ELSE 'expired' END AS status FROM orders""",
)
def retention_status(spark, d):
    return views.table(spark, d, "orders").select(
        "o_orderkey", ops.retention_status(F.col("o_orderdate"), F.lit("2000-01-01").cast("date")).alias("status")
    )


@query(
    "audit_retention",
    """SELECT o_orderkey, o_orderdate IS NULL OR date_diff('day', CAST(o_orderdate AS DATE), DATE '1998-08-02') <= 1095 AS kept,
         coalesce(date_diff('day', CAST(o_orderdate AS DATE), DATE '1998-08-02') > 1095, false) AS expired
       FROM (SELECT o_orderkey, CASE WHEN o_orderkey % 13 <> 0 THEN o_orderdate END AS o_orderdate FROM orders)""",
)
def audit_retention(spark, d):
    """Orders as audit rows: which are kept, which may go."""
    at = F.when(F.col("o_orderkey") % 13 != 0, F.col("o_orderdate"))
    log = views.table(spark, d, "orders").select("o_orderkey", at.alias("timestamp"))
    day = F.lit("1998-08-02").cast("date")
    kept = ops.audit_kept(log, day).select("o_orderkey", F.lit(True).alias("kept"), F.lit(False).alias("expired"))
    gone = ops.audit_expired(log, day).select("o_orderkey", F.lit(False).alias("kept"), F.lit(True).alias("expired"))
    return kept.union(gone)


@query(
    "compliance_whole_record",
    f"""WITH f AS (SELECT {_TAINTED.format('text')} OR {_TAINTED.format("coalesce(personal_phones[1], '')")} AS pii
          FROM (SELECT text, CASE WHEN doc_id % 11 = 0 THEN ['5321234567' || (doc_id % 10)] END AS personal_phones FROM documents))
        SELECT count(*) AS total_records, count(*) FILTER (pii) AS pii_detected FROM f""",
)
def compliance_whole_record(spark, d):
    """Personal data anywhere in a record, here also inside of a list."""
    number = F.concat(F.lit("5321234567"), F.col("doc_id") % 10)
    records = views.table(spark, d, "documents").select(
        F.concat(F.lit("d"), "doc_id").alias("id"), "text", F.when(F.col("doc_id") % 11 == 0, F.array(number)).alias("numbers")
    )
    return ops.compliance_report(records, suppressed(spark, d)).select("total_records", "pii_detected")


def _collected(spark, d):
    """Documents as collected records; part of them carries fields that should not exist."""
    return views.table(spark, d, "documents").select(
        F.col("doc_id").cast("string").alias("id"),
        "text",
        F.when(F.col("doc_id") % 7 == 0, F.array(F.lit("ada@example.com"))).otherwise(F.array().cast("array<string>")).alias("personal_emails"),
        F.when(F.col("doc_id") % 11 == 0, F.lit("05321234567")).alias("personal_phones"),
    )


@query(
    "minimisation_issues",
    f"""SELECT CAST(doc_id AS VARCHAR) AS company_id, concat_ws(',', CASE WHEN doc_id % 7 = 0 THEN 'personal_emails' END,
          CASE WHEN doc_id % 11 = 0 THEN 'personal_phones' END) AS issues FROM documents WHERE doc_id % 7 = 0 OR doc_id % 11 = 0""",
)
def minimisation_issues(spark, d):
    return ops.minimisation_report(_collected(spark, d)).select(
        "company_id", F.array_join(F.sort_array(F.map_keys("issues")), ",").alias("issues")
    )


@query(
    "compliance_report",
    f"""WITH f AS (SELECT doc_id, {_TAINTED.format('text')} OR {NAME_SQL.format('text')} AS pii FROM documents),
        t AS (SELECT count(*) AS total_records, count(*) FILTER (pii) AS pii_detected,
          count(*) FILTER (doc_id % 10 = 0 AND doc_id IN (SELECT c_custkey FROM customer)) AS suppressed_records,
          count(*) FILTER (doc_id % 7 = 0 OR doc_id % 11 = 0) AS minimisation_records FROM f)
        SELECT *, 'Review and remove PII from ' || pii_detected || ' records|{ops.ADVICE_MINIMISE}' AS recommendations FROM t""",
)
def compliance_report(spark, d):
    report = ops.compliance_report(_collected(spark, d), suppressed(spark, d), ["text"])
    return report.withColumn("recommendations", F.array_join("recommendations", "|"))
