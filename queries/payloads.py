"""Payloads without a fixed layout: keys that no layout names survive bronze."""

from __future__ import annotations

from pyspark.sql import functions as F

from firmaforge.plans import views
from firmaforge.sources import payloads
from queries.registry import query

_KNOWN = {"name": ("$.name", "string"), "balance": ("$.account.balance", "double"), "tag": ("$.tags[0]", "string")}


def _payload_rows(spark, d):
    """Customers as JSON with a key of their own by segment; each eleventh is cut off."""
    key = F.col("c_custkey")
    text = F.format_string(
        '{"name":"%s","account":{"balance":%s},"tags":["t%s"],"x_%s":%s}',
        F.col("c_name"),
        F.col("c_acctbal").cast("decimal(12,2)").cast("string"),
        (key % 5).cast("string"),
        F.lower("c_mktsegment"),
        F.when(key % 2 == 0, F.lit("true")).otherwise(key.cast("string")),
    )
    cut_off = F.when(key % 11 == 0, F.left(text, F.length(text) - 2)).otherwise(text)
    data = F.when(key % 13 != 0, cut_off)
    return payloads.bronze_payload(views.table(spark, d, "customer").select("c_custkey", data.alias("data")), "data")


@query(
    "payload_fields",
    """SELECT c_custkey, c_custkey % 13 <> 0 AND c_custkey % 11 = 0 AS is_broken,
         CASE WHEN c_custkey % 13 <> 0 AND c_custkey % 11 <> 0 THEN c_name END AS name,
         CASE WHEN c_custkey % 13 <> 0 AND c_custkey % 11 <> 0 THEN CAST(c_acctbal AS DOUBLE) END AS balance,
         CASE WHEN c_custkey % 13 <> 0 AND c_custkey % 11 <> 0 THEN 't' || c_custkey % 5 END AS tag FROM customer""",
)
def payload_fields(spark, d):
    return payloads.fields(_payload_rows(spark, d), _KNOWN).select("c_custkey", "is_broken", *_KNOWN)


@query(
    "payload_unknown_keys",
    """SELECT c_custkey, 'x_' || lower(c_mktsegment) AS key, CASE WHEN c_custkey % 2 = 0 THEN 'true' ELSE CAST(c_custkey AS VARCHAR) END AS value,
         CASE WHEN c_custkey % 2 = 0 THEN 'BOOLEAN' ELSE 'BIGINT' END AS kind
       FROM customer WHERE c_custkey % 13 <> 0 AND c_custkey % 11 <> 0""",
)
def payload_unknown_keys(spark, d):
    found = payloads.unknown_entries(_payload_rows(spark, d), ["name", "account", "tags"], ["c_custkey"])
    return found.select("c_custkey", "key", F.to_json("value").alias("value"), "kind")


@query(
    "payload_key_report",
    """WITH good AS (SELECT * FROM customer WHERE c_custkey % 13 <> 0 AND c_custkey % 11 <> 0)
       SELECT key, kind, is_known, count(*) AS n_rows FROM (
         SELECT unnest(['name', 'account', 'tags', 'x_' || lower(c_mktsegment)]) AS key,
           unnest(['STRING', 'OBJECT', 'ARRAY<STRING>', CASE WHEN c_custkey % 2 = 0 THEN 'BOOLEAN' ELSE 'BIGINT' END]) AS kind,
           unnest([true, true, true, false]) AS is_known FROM good) GROUP BY ALL""",
)
def payload_key_report(spark, d):
    report = payloads.key_report(_payload_rows(spark, d), ["name", "account", "tags"])
    # Numbers differ in digits, so the inner layout of objects is left out.
    kind = F.regexp_replace("kind", "^OBJECT<.*$", "OBJECT")
    return report.groupBy("key", kind.alias("kind"), "is_known").agg(F.sum("n_rows").alias("n_rows"))
