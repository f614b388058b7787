"""Merges, partial updates, history, hashes, exports and stored copies."""

from __future__ import annotations

from pyspark.sql import functions as F

from firmaforge.functions.privacy import change_hash
from firmaforge.operators import search as search_ops
from firmaforge.plans import views
from firmaforge.session import new_shared_path
from firmaforge.sources import raw, sinks
from queries.registry import query


def _upsert(spark, d):
    """Half of the customers is stored, two thirds come in; every ninth has no city."""
    k = F.col("c_custkey")
    base = views.customers(spark, d).select(
        k, F.col("c_name").alias("legal_name"), F.when(k % 9 != 0, F.col("city")).alias("city"), "c_mktsegment"
    )
    before = F.lit("2024-01-01 00:00:00").cast("timestamp")
    stored = base.filter(k % 2 == 0).select(
        k.cast("string").alias("id"),
        "legal_name",
        "city",
        F.to_json(F.struct(F.lit(1).alias("v"))).alias("data"),
        before.alias("created_at"),
        before.alias("updated_at"),
    )
    incoming = base.filter(k % 3 != 0).select("legal_name", "city", F.to_json(F.struct(F.lit(2).alias("v"))).alias("data"))
    return sinks.upsert_plan(stored, incoming, F.lit(views.AS_OF).cast("timestamp"))


_UPSERT = """p AS (SELECT c_custkey AS k, c_name AS legal_name, CASE WHEN c_custkey % 9 <> 0 THEN n_name END AS city,
    CASE WHEN c_custkey % 2 = 0 AND c_custkey % 3 <> 0 THEN 'update' WHEN c_custkey % 2 = 0 THEN 'keep' ELSE 'insert' END AS action
  FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE c_custkey % 2 = 0 OR c_custkey % 3 <> 0)"""


@query(
    "upsert_merge",
    f"""WITH {_UPSERT} SELECT legal_name, city, action, CASE action WHEN 'keep' THEN '{{"v":1}}' ELSE '{{"v":2}}' END AS data,
          CASE action WHEN 'insert' THEN '2024-06-01' ELSE '2024-01-01' END AS created,
          CASE action WHEN 'insert' THEN NULL WHEN 'update' THEN '2024-06-01' ELSE '2024-01-01' END AS updated FROM p""",
)
def upsert_merge(spark, d):
    return _upsert(spark, d).select(
        "legal_name",
        "city",
        "action",
        "data",
        F.date_format("created_at", "yyyy-MM-dd").alias("created"),
        F.date_format("updated_at", "yyyy-MM-dd").alias("updated"),
    )


@query("upsert_counts", f"WITH {_UPSERT} SELECT action, count(*) AS rows FROM p GROUP BY action")
def upsert_counts(spark, d):
    return sinks.action_counts(_upsert(spark, d))


@query(
    "bulk_update",
    """SELECT coalesce(c_custkey, 1000000 + o.o_custkey) AS id, c_name AS name, coalesce(n.status, CASE WHEN c_custkey IS NOT NULL THEN 'old' END) AS status,
         n.total FROM customer FULL JOIN (SELECT o_custkey, max(o_orderstatus) AS status, max(o_totalprice) AS total FROM orders GROUP BY 1) n ON n.o_custkey = c_custkey LEFT JOIN (SELECT 0 AS o_custkey) o ON false""",
)
def bulk_update(spark, d):
    """Order facts laid over customer documents; a new field appears with them."""
    docs = views.table(spark, d, "customer").select(
        F.col("c_custkey").alias("id"), F.col("c_name").alias("name"), F.lit("old").alias("status")
    )
    updates = views.table(spark, d, "orders").select(
        F.col("o_custkey").alias("id"), F.col("o_orderstatus").alias("status"), F.col("o_totalprice").alias("total")
    )
    return sinks.bulk_update(docs, updates)


@query(
    "scd2_history",
    """SELECT o_custkey, o_orderkey, strftime(o_orderdate, '%Y-%m-%d %H:%M:%S') AS valid_from,
         strftime(lead(o_orderdate IGNORE NULLS) OVER w, '%Y-%m-%d %H:%M:%S') AS valid_to, lead(o_orderkey) OVER w IS NULL AS is_current
       FROM (SELECT CASE WHEN o_custkey % 10 <> 0 THEN o_custkey END AS o_custkey,
           CASE WHEN o_orderkey % 7 <> 0 THEN o_orderdate END AS o_orderdate, o_orderkey FROM orders)
       WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate NULLS FIRST, o_orderkey)""",
)
def scd2_history(spark, d):
    """Orders as versions of their customer; some lack the customer or the time."""
    versions = views.table(spark, d, "orders").select(
        F.when(F.col("o_custkey") % 10 != 0, F.col("o_custkey")).alias("o_custkey"),
        F.when(F.col("o_orderkey") % 7 != 0, F.col("o_orderdate")).alias("o_orderdate"),
        "o_orderkey",
    )
    fmt = "yyyy-MM-dd HH:mm:ss"
    return sinks.history(versions, "o_custkey", "o_orderdate", "year", ("o_orderkey",)).select(
        "o_custkey",
        "o_orderkey",
        F.date_format("valid_from", fmt).alias("valid_from"),
        F.date_format("valid_to", fmt).alias("valid_to"),
        "is_current",
    )


@query(
    "scd2_two_loads",
    """SELECT o_custkey, o_orderkey, strftime(o_orderdate, '%Y-%m-%d') AS valid_from,
         strftime(lead(o_orderdate) OVER w, '%Y-%m-%d') AS valid_to, lead(o_orderkey) OVER w IS NULL AS is_current
       FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey)""",
)
def scd2_two_loads(spark, d):
    """Orders as versions of their customer, loaded in two increments of time."""
    orders = views.table(spark, d, "orders").select("o_custkey", "o_orderdate", "o_orderkey")
    bounds = orders.agg(F.min("o_orderdate").alias("lo"), F.max("o_orderdate").alias("hi")).first()
    middle = bounds["lo"] + (bounds["hi"] - bounds["lo"]) / 2
    path = new_shared_path(spark, "history")
    halves = (orders.filter(F.col("o_orderdate") <= middle), orders.filter(F.col("o_orderdate") > middle))
    for load, half in enumerate(halves, 1):
        sinks.append_history(spark, path, half, load, "o_custkey", "o_orderdate", ("o_orderkey",))
    return sinks.read_history(spark, path).select(
        "o_custkey",
        "o_orderkey",
        F.date_format("valid_from", "yyyy-MM-dd").alias("valid_from"),
        F.date_format("valid_to", "yyyy-MM-dd").alias("valid_to"),
        "is_current",
    )


@query(
    "change_hash",
    """SELECT c_custkey, sha256('{"c_mktsegment":"' || c_mktsegment || '","c_name":"' || c_name || '"}') AS digest FROM customer""",
)
def change_hash_query(spark, d):
    return views.table(spark, d, "customer").select("c_custkey", change_hash("c_name", "c_mktsegment").alias("digest"))


@query(
    "json_set_key",
    """SELECT event_id, json_extract_string(props, '$.k') AS k, 'e' || user_id AS owner FROM events""",
)
def json_set_key(spark, d):
    """One key added to a JSON object."""
    events = views.table(spark, d, "events").withColumn("m", F.from_json("props", "map<string,string>"))
    owned = events.withColumn("m", raw.json_with(F.col("m"), "owner", F.concat(F.lit("e"), F.col("user_id"))))
    return owned.select("event_id", F.col("m")["k"].alias("k"), F.col("m")["owner"].alias("owner"))


@query(
    "export_projection",
    """SELECT c_custkey, c_name FROM (SELECT * FROM customer WHERE c_mktsegment IN ('BUILDING', 'MACHINERY') AND c_nationkey = 3
         ORDER BY c_custkey LIMIT 10000)""",
)
def export_projection(spark, d):
    """A JSON export written and read back."""
    path = new_shared_path(spark, "export")
    asked = {"c_mktsegment": ["BUILDING", "MACHINERY"], "c_nationkey": 3}
    sinks.export(views.table(spark, d, "customer"), path, "json", asked, ["c_custkey", "c_name"], 10_000)
    back = spark.read.schema("c_custkey long, c_name string").json(path)
    return back


@query(
    "export_csv",
    """SELECT CAST(o_orderkey AS VARCHAR) AS o_orderkey, '["' || o_orderstatus || '"]' AS states FROM orders WHERE o_totalprice > 300000
       ORDER BY orders.o_orderkey LIMIT 500""",
)
def export_csv(spark, d):
    """A CSV export with a nested column, written and read back."""
    path = new_shared_path(spark, "export")
    orders = views.table(spark, d, "orders").filter("o_totalprice > 300000").select(
        "o_orderkey", F.array("o_orderstatus").alias("states")
    )
    sinks.export(orders, path, "csv", None, ["o_orderkey", "states"], 500)
    return spark.read.option("header", True).schema("o_orderkey string, states string").csv(path)


@query(
    "save_layer",
    "SELECT c_mktsegment, count(*) AS rows, CAST(sum(c_custkey) AS BIGINT) AS keys FROM customer GROUP BY 1",
)
def save_layer(spark, d):
    """A table saved by segment, exposed as a view and read through SQL."""
    path = new_shared_path(spark, "layer")
    sinks.save_layer(views.table(spark, d, "customer").select("c_custkey", "c_mktsegment"), path, ["c_mktsegment"])
    sinks.expose(spark.read.parquet(path), "saved_customers")
    return spark.sql("SELECT c_mktsegment, count(*) AS rows, sum(c_custkey) AS keys FROM saved_customers GROUP BY 1")


@query(
    "update_counts",
    "SELECT count(*) FILTER (o_custkey % 5 <> 0) AS success, count(*) FILTER (o_custkey % 5 = 0) AS failed FROM orders",
)
def update_counts(spark, d):
    """Order facts as updates; some name no customer."""
    key = F.when(F.col("o_custkey") % 5 != 0, F.col("o_custkey"))
    return sinks.update_counts(views.table(spark, d, "orders").select(key.alias("id")))


@query(
    "landing_json",
    """SELECT event_type AS source_type, count(*) AS rows, CAST(sum(event_id) AS BIGINT) AS ids FROM events GROUP BY 1""",
)
def landing_json(spark, d):
    """Events landed as JSON by type, read back by partition."""
    path = new_shared_path(spark, "landing")
    events = views.table(spark, d, "events").withColumnRenamed("event_type", "source_type")
    sinks.land_json(events.select("event_id", "props", "source_type"), path)
    back = spark.read.schema("event_id long, props string, source_type string").json(path)
    return back.groupBy("source_type").agg(F.count("*").alias("rows"), F.sum("event_id").alias("ids"))


@query(
    "copy_filtered",
    "SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderstatus = 'F'",
)
def copy_filtered(spark, d):
    path = new_shared_path(spark, "copy")
    sinks.copy_filtered(spark, f"{d.rstrip('/')}/orders.parquet", path, "o_orderstatus = 'F'")
    return spark.read.parquet(path).select("o_orderkey", "o_totalprice")


@query(
    "stored_index_search",
    """WITH t AS (SELECT p_partkey FROM part WHERE p_name LIKE '%widget%' AND p_name LIKE '%red%') SELECT p_partkey FROM t""",
)
def stored_index_search(spark, d):
    """A search over an index that was written first: only the row groups of its terms are read."""
    parts = views.table(spark, d, "part").select("p_partkey", "p_name")
    path = new_shared_path(spark, "index")
    search_ops.build_index(parts, "p_partkey", ["p_name"], path=path)
    index = search_ops.read_index(spark, path)
    hits = search_ops.search(parts, "red widget", "p_partkey", {"p_name": 1.0}, index, mode="all", fuzzy=False)
    return hits.select("p_partkey")
