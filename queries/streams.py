"""The incremental loads as streams over the event files."""

from __future__ import annotations

from pyspark.sql import functions as F

from firmaforge.plans import views
from firmaforge.streaming import bronze as st
from queries.registry import query


def _stream(spark, d):
    schema = views.table(spark, d, "events").schema
    # As a pattern the path may be one file or a folder of part files.
    stream = st.read_files(spark, f"{d.rstrip('/')}/event[s].parquet", schema)
    return stream.withColumn("ts", F.col("ts").cast("timestamp"))


@query("stream_dedup", "SELECT event_id, user_id, min(event_type) AS event_type FROM events GROUP BY event_id, user_id")
def stream_dedup(spark, d):
    out, checkpoint = st.scratch(spark, "dedup")
    st.run(st.append_to(st.deduplicated(_stream(spark, d), ["event_id"], "ts"), out, checkpoint))
    return spark.read.parquet(out).select("event_id", "user_id", "event_type")


@query(
    "stream_upsert_latest",
    """SELECT user_id, event_id, value FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1""",
)
def stream_upsert_latest(spark, d):
    stream = _stream(spark, d).select("user_id", "ts", "event_id", "value")
    out, checkpoint = st.scratch(spark, "latest")
    table = st.KeyedTable(spark, out, stream.schema, ["user_id"])
    st.run(st.upsert_latest(stream, table, ["ts", "event_id"], checkpoint))
    return table.read().select("user_id", "event_id", "value")


@query(
    "bronze_bucketed_load",
    """SELECT user_id, event_id, event_type, value FROM events
       QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1""",
)
def bronze_bucketed_load(spark, d):
    """The early half of the events, then the rest, into a stored table by buckets of the key."""
    events = views.table(spark, d, "events").select("user_id", "ts", "event_id", "event_type", "value")
    bounds = events.agg(F.min("ts").alias("lo"), F.max("ts").alias("hi")).first()
    middle = bounds["lo"] + (bounds["hi"] - bounds["lo"]) / 2
    out, _ = st.scratch(spark, "loaded")
    table = st.KeyedTable(spark, out, events.schema, ["user_id"])
    st.load_increment(table, events.filter(F.col("ts") <= middle), "ts", ["ts", "event_id"])
    st.load_increment(table, events, "ts", ["ts", "event_id"])
    return table.read().select("user_id", "event_id", "event_type", "value")


@query(
    "stream_day_histogram",
    "SELECT strftime(date_trunc('day', ts), '%Y-%m-%d') AS day, count(*) AS count FROM events GROUP BY 1",
)
def stream_day_histogram(spark, d):
    out, checkpoint = st.scratch(spark, "days")
    last = st.run(st.complete_to(st.day_counts(_stream(spark, d), "ts"), out, checkpoint))
    return st.latest(spark, out, last).select(F.date_format("day", "yyyy-MM-dd").alias("day"), "count")
