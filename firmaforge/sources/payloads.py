"""Payloads without a fixed layout: kept whole as VARIANT, read by path, unfolded by key."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def bronze_payload(raw: DataFrame, column: str, into: str = "payload") -> DataFrame:
    """JSON text parsed once into a VARIANT column; whatever keys it has survive.

    Text that is no JSON gives a null payload and ``is_broken``; null text is not broken.
    """
    parsed = F.try_parse_json(F.col(f"`{column}`"))
    rest = [F.col(f"`{c}`") for c in raw.columns if c not in (column, into)]
    out = raw.select(*rest, F.col(f"`{column}`").alias("_text"), parsed.alias(into))
    broken = F.col("_text").isNotNull() & F.col(f"`{into}`").isNull()
    return out.select(*rest, F.col(f"`{into}`"), broken.alias("is_broken"))


def field(payload: str | Column, path: str, ddl: str) -> Column:
    """A value by its path, cast; null where it is missing or of another type."""
    return F.try_variant_get(payload if isinstance(payload, Column) else F.col(f"`{payload}`"), path, ddl)


def fields(df: DataFrame, layout: dict[str, tuple[str, str]], payload: str = "payload") -> DataFrame:
    """``df`` with a column for each name of ``layout``: name -> (path, type)."""
    return df.withColumns({name: field(payload, path, ddl) for name, (path, ddl) in layout.items()})


def entries(df: DataFrame, keep: list[str], payload: str = "payload") -> DataFrame:
    """One row per top-level entry of an object: the kept columns, key, value (VARIANT), kind.

    A row whose payload is null, no object or empty gives none.
    """
    held = df.select(*[F.col(f"`{c}`") for c in keep], F.col(f"`{payload}`").alias("_p"))
    # Other variants would unfold to elements without a key.
    objects = held.filter(F.schema_of_variant("_p").startswith("OBJECT"))
    unfolded = objects.lateralJoin(df.sparkSession.tvf.variant_explode(F.col("_p").outer()))
    return unfolded.select(*[F.col(f"`{c}`") for c in keep], "key", "value", F.schema_of_variant("value").alias("kind"))


def unknown_entries(df: DataFrame, known: list[str], keep: list[str], payload: str = "payload") -> DataFrame:
    """Entries whose key no layout names, so that new keys of a source are noticed and kept."""
    return entries(df, keep, payload).filter(~F.col("key").isin(*known) if known else F.lit(True))


def key_report(df: DataFrame, known: list[str], payload: str = "payload") -> DataFrame:
    """Per key and kind of value: number of rows and whether the layout knows the key."""
    found = entries(df, [], payload).groupBy("key", "kind").agg(F.count("*").alias("n_rows"))
    return found.withColumn("is_known", F.col("key").isin(*known) if known else F.lit(False))


def merged_layout(df: DataFrame, payload: str = "payload") -> DataFrame:
    """One row: the layout that all payloads fit, as DDL."""
    return df.agg(F.schema_of_variant_agg(F.col(f"`{payload}`")).alias("layout"))
