"""Suppression list, deletion and export requests, retention, minimisation and reporting."""

from __future__ import annotations

from datetime import datetime
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from firmaforge.functions.privacy import (
    SENSITIVE_FIELDS,
    detect_pii,
    filter_pii,
    has_pii,
    hash_identifier,
    record_has_pii,
)

# Days a record stays active, days until an archived one may go, and the
# limits for requests and audit rows.
RETENTION_DAYS = {"active": 365, "archive": 730, "request": 30, "audit": 1095}

# Texts of the minimisation check.
PERSONAL_FIELDS = {
    "personal_emails": "Personal emails should not be collected",
    "personal_phones": "Personal phone numbers should not be collected",
}
SENSITIVE_TEXT = "Sensitive data field '{}' should not be collected"
ADVICE_PII = "Review and remove PII from {} records"
ADVICE_MINIMISE = "Review data collection to ensure only necessary business data is collected"


def suppression_list(identifiers: DataFrame, column: str) -> DataFrame:
    """Hashes only: the list itself names nobody."""
    return identifiers.select(hash_identifier(F.col(column)).alias("id_hash")).distinct()


def add_to_suppression(current: DataFrame, identifiers: DataFrame, column: str) -> DataFrame:
    return current.union(suppression_list(identifiers, column)).distinct()


def _hashed(df: DataFrame, column: str) -> DataFrame:
    return df.withColumn("id_hash", hash_identifier(F.col(column)))


def without_suppressed(df: DataFrame, suppressed: DataFrame, column: str) -> DataFrame:
    """Rows whose identifier is not on the list.

    No broadcast is forced: the list grows with requests, so its runtime size decides.
    """
    return _hashed(df, column).join(suppressed, "id_hash", "left_anti").drop("id_hash")


def only_suppressed(df: DataFrame, suppressed: DataFrame, column: str) -> DataFrame:
    return _hashed(df, column).join(suppressed, "id_hash", "left_semi").drop("id_hash")


def soft_delete(
    master: DataFrame, requests: DataFrame, column: str, at: datetime | str | None = None
) -> DataFrame:
    """Flag requested records in the master with date and requester; other rows unchanged.

    ``requests`` has columns identifier and requester; the first requester by name is kept.
    """
    when = F.current_timestamp() if at is None else F.lit(at).cast("timestamp")
    one = requests.groupBy(F.col("identifier").cast("string").alias("_id")).agg(
        F.min("requester").alias("_requester")
    )
    hit = F.col("_id").isNotNull()
    kept = [c for c in master.columns if c not in ("gdpr_suppressed", "suppression_date", "suppression_requester")]

    def old(name: str, default: Column) -> Column:
        return F.col(name) if name in master.columns else default

    return (
        master.join(one, master[column].cast("string") == one["_id"], "left")
        .select(
            *kept,
            (hit | old("gdpr_suppressed", F.lit(False))).alias("gdpr_suppressed"),
            F.when(hit, when).otherwise(old("suppression_date", F.lit(None).cast("timestamp"))).alias("suppression_date"),
            F.when(hit, F.col("_requester"))
            .otherwise(old("suppression_requester", F.lit(None).cast("string")))
            .alias("suppression_requester"),
        )
    )


def subject_export(companies: DataFrame, requests: DataFrame, id_col: str = "id", name_col: str = "legal_name") -> DataFrame:
    """Records whose id or name is asked for, personal data filtered.

    Two equi-joins rather than one join on an OR, which could only be a nested loop.
    """
    wanted = requests.select(F.col("identifier").alias("_w")).distinct()
    by_id = companies.join(wanted, companies[id_col].cast("string") == F.col("_w"), "left_semi")
    by_name = companies.join(wanted, companies[name_col] == F.col("_w"), "left_semi")
    rest = by_name.join(by_id.select(id_col), id_col, "left_anti").select(*companies.columns)
    return filter_pii(by_id.unionByName(rest), keep=(id_col,))


def audit_rows(requests: DataFrame, at: datetime | str | None = None) -> DataFrame:
    """One log row per request: status by action and, for deletions, a reference id."""
    when = F.current_timestamp() if at is None else F.lit(at).cast("timestamp")
    c = F.col
    known = c("action").isin("delete", "export", "suppress")
    reference = F.concat(
        F.lit("DEL-"), F.date_format(when, "yyyyMMddHHmmss"), F.lit("-"), F.left(c("identifier"), F.lit(8))
    )
    return requests.select(
        F.when(c("action") == "delete", reference).alias("reference_id"),
        "action",
        c("identifier").alias("entity_id"),
        F.create_map(F.lit("requester"), c("requester")).alias("requester_info"),
        when.alias("timestamp"),
        F.when(c("action") == "delete", "accepted").when(known, "completed").otherwise("rejected").alias("status"),
        F.when(c("action").isin("export", "suppress"), when).alias("completion_date"),
        F.when(~known, F.lit("Invalid action")).alias("notes"),
    )


def process_requests(
    requests: DataFrame,
    companies: DataFrame,
    search_set: DataFrame,
    suppressed: DataFrame,
    id_col: str = "id",
    at: datetime | str | None = None,
) -> dict[str, DataFrame]:
    """All outputs of one batch of requests: master, search set, exports, suppression, audit."""
    deletes = requests.filter("action = 'delete'")
    hiding = requests.filter("action IN ('delete', 'suppress')")
    gone = deletes.select(F.col("identifier").alias("_g")).distinct()
    return {
        "master": soft_delete(companies, deletes, id_col, at),
        "search_set": search_set.join(gone, search_set[id_col].cast("string") == gone["_g"], "left_anti"),
        "exports": subject_export(companies, requests.filter("action = 'export'"), id_col),
        "suppressed": add_to_suppression(suppressed, hiding, "identifier"),
        "audit": audit_rows(requests, at),
    }


def retention_status(last_activity: Column, as_of: Column) -> Column:
    age = F.datediff(as_of, last_activity)
    return (
        F.when(age <= RETENTION_DAYS["active"], "active")
        .when(age <= RETENTION_DAYS["archive"], "archive")
        .otherwise("expired")
    )


def overdue(log: DataFrame, as_of: Column) -> DataFrame:
    """Requests still open after the time the policy allows."""
    age = F.datediff(as_of, F.col("timestamp"))
    return log.filter(F.col("completion_date").isNull() & (age > RETENTION_DAYS["request"]))


def audit_expired(log: DataFrame, as_of: Column) -> DataFrame:
    """Audit rows past the time they have to be kept."""
    return log.filter(F.datediff(as_of, F.col("timestamp")) > RETENTION_DAYS["audit"])


def audit_kept(log: DataFrame, as_of: Column) -> DataFrame:
    """The audit log without expired rows; rows without a time stay."""
    age = F.datediff(as_of, F.col("timestamp"))
    return log.filter(F.coalesce(age <= RETENTION_DAYS["audit"], F.lit(True)))


def minimisation_issues(df: DataFrame) -> Column:
    """Map of offending field to message. Sensitive fields offend by being in the layout."""
    entries = []
    for name, message in PERSONAL_FIELDS.items():
        if name in df.columns:
            filled = F.size(name) > 0 if dict(df.dtypes)[name].startswith("array") else F.length(name) > 0
            entries.append(F.when(filled, F.struct(F.lit(name).alias("k"), F.lit(message).alias("v"))))
    for name in SENSITIVE_FIELDS:
        if name in df.columns:
            entries.append(F.struct(F.lit(name).alias("k"), F.lit(SENSITIVE_TEXT.format(name)).alias("v")))
    if not entries:
        return F.create_map().cast("map<string,string>")
    return F.map_from_entries(F.array_compact(F.array(*entries)))


def minimisation_report(df: DataFrame, id_col: str = "id") -> DataFrame:
    """Offending records only, with their issues."""
    flagged = df.select(F.col(id_col).alias("company_id"), minimisation_issues(df).alias("issues"))
    return flagged.filter(F.size("issues") > 0)


def compliance_report(
    df: DataFrame, suppressed: DataFrame, texts: list[str] | None = None, id_col: str = "id"
) -> DataFrame:
    """One row: totals, records with personal data, suppressed records, advice.

    Every text of the record is looked into, nested ones too; ``texts`` looks into some
    columns instead. The findings are joined by OR, so one pass over the table decides
    everything but the suppression join.
    """
    found = reduce(lambda a, b: a | b, [has_pii(F.col(t)) for t in texts]) if texts else record_has_pii(df)
    flagged = _hashed(df, id_col).select(
        "id_hash", found.alias("pii"), (F.size(minimisation_issues(df)) > 0).alias("offends")
    )
    # Each hash once, so the left join keeps one row per record.
    listed = suppressed.select("id_hash").distinct().withColumn("hit", F.lit(True))
    marked = flagged.join(listed, "id_hash", "left")
    totals = marked.agg(
        F.count("*").alias("total_records"),
        F.count_if(F.col("pii")).alias("pii_detected"),
        F.count_if(F.col("hit")).alias("suppressed_records"),
        F.count_if(F.col("offends")).alias("minimisation_records"),
    )
    return totals.withColumn(
        "recommendations",
        F.array_compact(
            F.array(
                F.when(F.col("pii_detected") > 0, F.format_string(ADVICE_PII.replace("{}", "%d"), "pii_detected")),
                F.when(F.col("minimisation_records") > 0, F.lit(ADVICE_MINIMISE)),
            )
        ),
    )


def pii_kinds(df: DataFrame, column: str) -> DataFrame:
    """How many rows hold each kind of personal data."""
    return df.select(F.explode(detect_pii(F.col(column))).alias("kind")).groupBy("kind").count()
