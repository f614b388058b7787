"""Writing: landing zone, keyed merge, partial updates, history, copies and exports."""

from __future__ import annotations

from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pyspark.sql.types import BooleanType, IntegerType, StructField, StructType

from firmaforge.operators.filters import compile_filters
from firmaforge.session import cut, discard


def land_json(df: DataFrame, path: str, by: str = "source_type", max_rows: int = 1_000_000) -> None:
    """Append raw rows as JSON, one folder per source; a large source spans many files."""
    df.write.mode("append").partitionBy(by).option("maxRecordsPerFile", max_rows).json(path)


def save_layer(df: DataFrame, path: str, by: list[str] | None = None) -> None:
    writer = df.write.mode("overwrite")
    (writer.partitionBy(*by) if by else writer).parquet(path)


def expose(df: DataFrame, name: str) -> None:
    df.createOrReplaceTempView(name)


def upsert_plan(stored: DataFrame, incoming: DataFrame, at: Column | None = None) -> DataFrame:
    """Result of merging companies by (legal_name, city), with what happened to each row.

    ``stored`` has id, legal_name, city, data, created_at, updated_at; ``incoming`` has
    legal_name, city, data. Keys compare null-safely: a firm without city is one firm, too.
    ``action`` is keep, update or insert. The last incoming row of a key by ``data`` wins.
    """
    at = F.current_timestamp() if at is None else at
    fresh = incoming.groupBy("legal_name", "city").agg(F.max("data").alias("data"), F.count("*").alias("_rows"))
    s, n = stored.alias("s"), fresh.alias("n")
    same = F.col("s.legal_name").eqNullSafe(F.col("n.legal_name")) & F.col("s.city").eqNullSafe(F.col("n.city"))
    is_new, is_old = F.col("s.id").isNull(), F.col("n._rows").isNull()
    action = F.when(is_old, "keep").when(is_new, "insert").otherwise("update")
    key = F.md5(F.concat_ws("|", F.col("n.legal_name"), F.coalesce("n.city", F.lit(""))))
    return s.join(n, same, "full_outer").select(
        F.coalesce(F.col("s.id").cast("string"), key).alias("id"),
        F.coalesce("s.legal_name", "n.legal_name").alias("legal_name"),
        F.coalesce("s.city", "n.city").alias("city"),
        F.coalesce("n.data", "s.data").alias("data"),
        F.when(is_new, at).otherwise(F.col("s.created_at")).alias("created_at"),
        F.when(action == "update", at).otherwise(F.col("s.updated_at")).alias("updated_at"),
        action.alias("action"),
    )


def action_counts(planned: DataFrame) -> DataFrame:
    return planned.groupBy("action").agg(F.count("*").alias("rows"))


def bulk_update(docs: DataFrame, updates: DataFrame, id_col: str = "id", order: str | None = None) -> DataFrame:
    """Lay the non-null fields of ``updates`` over the documents with that id, insert the rest.

    Several updates of one document apply field by field; the last by ``order`` wins (the
    greatest value where no order is given).
    """
    fields = [c for c in updates.columns if c not in (id_col, order)]

    def last(f: str) -> Column:
        return F.max_by(f, F.when(F.col(f).isNotNull(), F.col(order))) if order else F.max(f)

    one = updates.groupBy(id_col).agg(*[last(f).alias(f"_u_{f}") for f in fields])
    columns = [*docs.columns, *[f for f in fields if f not in docs.columns]]

    def value(name: str) -> Column:
        if name == id_col or name not in fields:
            return F.col(name)
        if name not in docs.columns:
            return F.col(f"_u_{name}").alias(name)
        return F.coalesce(F.col(f"_u_{name}"), F.col(name)).alias(name)

    return docs.join(one, id_col, "full_outer").select(*[value(c) for c in columns])


def update_counts(updates: DataFrame, id_col: str = "id") -> DataFrame:
    """How many updates can be applied: those that name a document."""
    return updates.agg(
        F.count_if(F.col(id_col).isNotNull()).alias("success"), F.count_if(F.col(id_col).isNull()).alias("failed")
    )


def history(
    versions: DataFrame, key: str, updated: str, period: str = "month", ties: tuple[str, ...] = ()
) -> DataFrame:
    """Add valid_from, valid_to and is_current to the versions of each key.

    Versions without a time come first and end when the first timed one begins; versions
    without a key are versions of one nameless thing; ``ties`` orders equal times.

    The successor of a version is looked up within its period first and among the first
    versions of the periods otherwise, so a key with a very long history is sorted in parts,
    one per period, and not in one task.
    """
    within = Window.partitionBy(key, "_period").orderBy(updated, *ties)
    parted = versions.withColumn("_period", F.date_trunc(period, F.col(updated)))
    inside = parted.withColumns(
        {"_next": F.lead(updated).over(within), "_follows": F.lead(F.lit(True)).over(within)}
    )
    starts = (
        parted.groupBy(F.col(key).alias("_key"), F.col("_period").alias("_own"))
        .agg(F.min(updated).alias("_start"))
        .withColumnRenamed("_own", "_period")
        .withColumns(
            {
                "_later": F.lead("_start").over(Window.partitionBy("_key").orderBy("_period")),
                "_more": F.lead(F.lit(True)).over(Window.partitionBy("_key").orderBy("_period")),
            }
        )
        .select("_key", F.col("_period").alias("_own"), "_later", "_more")
    )
    same = F.col(key).eqNullSafe(F.col("_key")) & F.col("_period").eqNullSafe(F.col("_own"))
    return inside.join(starts, same).select(
        *versions.columns,
        F.col(updated).alias("valid_from"),
        F.coalesce("_next", "_later").alias("valid_to"),
        (F.col("_follows").isNull() & F.col("_more").isNull()).alias("is_current"),
    )


def history_delta(
    open_versions: DataFrame, increment: DataFrame, key: str, updated: str, ties: tuple[str, ...] = ()
) -> DataFrame:
    """Versions to be written after an increment: those that were open, and the new ones.

    ``open_versions`` is the current version of each key, ``increment`` has later versions only
    (a version that is not later than the open one of its key is an error, since closed versions
    are not read again). Keys that the increment does not name are left out.
    """
    columns = increment.columns
    order = [key, updated, *ties]
    named = increment.select(F.col(key).alias("_key")).distinct()
    touched = open_versions.join(named, F.col(key).eqNullSafe(F.col("_key")), "left_semi").select(*columns)
    late = F.struct(*[F.col(c) for c in order[1:]])
    first = increment.groupBy(key).agg(F.min(late).alias("_first"))
    before = touched.select(F.col(key).alias("_key"), late.alias("_open"))
    wrong = before.join(first, F.col("_key").eqNullSafe(F.col(key))).filter(F.col("_first") <= F.col("_open"))
    if not wrong.isEmpty():
        raise ValueError("the increment holds versions that are not later than the stored ones")
    return history(touched.unionByName(increment.select(*columns)), key, updated, ties=ties)


def append_history(
    spark: SparkSession, path: str, increment: DataFrame, load: int, key: str, updated: str,
    ties: tuple[str, ...] = (), buckets: int = 64,
) -> None:
    """Close the open versions of the increment's keys and add its versions.

    The table is partitioned by ``is_current``, the number of the load that closed a version and
    a hash of the key. An increment reads the partitions of open versions that it touches. One
    write replaces those and adds the versions that it closes, in partitions of its own number,
    so a load that failed half-way is simply run again; one that was done is refused.
    """
    bucket = F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int")
    staged_in = cut(increment)
    time = staged_in.schema[updated].dataType
    fields = [*staged_in.schema.fields, StructField("valid_from", time), StructField("valid_to", time)]
    parts = ("is_current", "_load", "_bucket")
    kinds = (BooleanType(), IntegerType(), IntegerType())
    stored = StructType([*fields, *[StructField(n, k) for n, k in zip(parts, kinds, strict=True)]])
    spark.createDataFrame([], stored).write.mode("ignore").partitionBy(*parts).parquet(path)
    touched = [r[0] for r in staged_in.select(bucket).distinct().collect()]  # no more than there are buckets
    open_ = spark.read.schema(stored).parquet(path).filter(F.col("is_current") & F.col("_bucket").isin(touched))
    made = history_delta(open_, staged_in, key, updated, ties)
    named = staged_in.select(F.col(key).alias("_key")).distinct()
    others = open_.join(named, F.col(key).eqNullSafe(F.col("_key")), "left_anti").select(*made.columns)
    rows = made.unionByName(others).withColumns(
        {"_load": F.when(F.col("is_current"), 0).otherwise(load), "_bucket": bucket}
    )
    # Staged first, since what is overwritten is read here.
    staged = cut(rows.select(*stored.names))
    staged.repartition("_bucket").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(
        *parts
    ).parquet(path)
    discard(staged_in, staged)


def read_history(spark: SparkSession, path: str) -> DataFrame:
    stored = spark.read.parquet(path).drop("_load", "_bucket")
    return stored.withColumn("is_current", F.col("is_current").cast("boolean"))


def search_documents(companies: DataFrame) -> DataFrame:
    """Flat search documents out of nested records, to be written as the search set."""
    no_texts = F.array().cast("array<string>")
    c = F.col
    return companies.select(
        "id",
        c("identity.legal_name").alias("legal_name"),
        c("identity.trade_name").alias("trade_name"),
        c("identity.city").alias("city"),
        c("identity.company_type").alias("company_type"),
        c("web_presence.website_url").alias("website_url"),
        F.coalesce("contacts.emails_public", no_texts).alias("emails"),
        F.coalesce("contacts.phones_public", no_texts).alias("phones"),
        F.coalesce("business_meta.keywords", no_texts).alias("keywords"),
        "created_at",
        c("last_updated").alias("updated_at"),
    )


def copy_filtered(spark: SparkSession, source: str, target: str, condition: Column | str | None = None) -> None:
    df = spark.read.parquet(source)
    (df if condition is None else df.filter(condition)).write.mode("overwrite").parquet(target)


def export_rows(
    df: DataFrame, filters: dict[str, Any] | None = None, fields: list[str] | None = None, limit: int = 10_000
) -> DataFrame:
    """Filtered rows with the fields asked for; a field that does not exist is null."""
    # Which rows an export holds must not depend on the run: the first ones by all columns
    # that can be ordered.
    order = [n for n, t in df.dtypes if "map<" not in t]
    kept = df.filter(compile_filters(df, filters)).orderBy(*[F.col(f"`{n}`") for n in order]).limit(limit)
    if not fields:
        return kept
    return kept.select(*[F.col(f) if f in df.columns else F.lit(None).cast("string").alias(f) for f in fields])


def export(
    df: DataFrame,
    path: str,
    fmt: str = "json",
    filters: dict[str, Any] | None = None,
    fields: list[str] | None = None,
    limit: int = 1_000,
) -> None:
    """Write an export of at most 10,000 rows as csv or json."""
    if fmt not in ("csv", "json"):
        raise ValueError(f"invalid export format {fmt!r}")
    if not 1 <= limit <= 10_000:
        raise ValueError("an export has 1 to 10,000 rows")
    rows = export_rows(df, filters, fields, limit)
    if fmt == "json":
        rows.write.mode("overwrite").json(path)
        return
    # CSV cells are flat: nested values go in as JSON text.
    flat = [F.to_json(n).alias(n) if t.startswith(("array", "map", "struct")) else F.col(n) for n, t in rows.dtypes]
    rows.select(*flat).write.mode("overwrite").option("header", True).csv(path)
