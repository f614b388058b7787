"""Counts over result sets: facets, nested terms, buckets, histograms and the dashboard."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from firmaforge.operators.filters import missing, present
from firmaforge.operators.ranking import top_rows

# Facets of the search answer with their sizes.
FACETS = {"city": 20, "industry": 15, "company_type": 10, "priority_tier": 4}


def facets(df: DataFrame, sizes: dict[str, int] | None = None) -> DataFrame:
    """facet, value, count for all facets in one pass: most frequent values first."""
    sizes = sizes or FACETS
    pairs = F.array(
        *[F.struct(F.lit(f).alias("facet"), F.col(f).cast("string").alias("value")) for f in sizes]
    )
    counts = (
        df.select(F.inline(pairs)).filter("value IS NOT NULL").groupBy("facet", "value").agg(F.count("*").alias("count"))
    )
    limit = F.create_map(*[F.lit(x) for kv in sizes.items() for x in kv])
    order = Window.partitionBy("facet").orderBy(F.desc("count"), F.asc("value"))
    # The literal bound lets every task cut its share before the shuffle (see top_rows).
    return (
        counts.withColumn("_r", F.row_number().over(order))
        .filter((F.col("_r") <= max(sizes.values())) & (F.col("_r") <= F.element_at(limit, F.col("facet"))))
        .drop("_r")
    )


def terms(df: DataFrame, field: str, size: int, **metrics: Column) -> DataFrame:
    """The most frequent values of a field with their count and further aggregates."""
    return (
        df.filter(F.col(field).isNotNull())
        .groupBy(field)
        .agg(F.count("*").alias("count"), *[m.alias(n) for n, m in metrics.items()])
        .orderBy(F.desc("count"), F.asc(field))
        .limit(size)
    )


def multi_terms(df: DataFrame, field: str, size: int = 20) -> DataFrame:
    """Value counts of an array field; a value counts once per row."""
    values = df.select(F.explode(F.array_distinct(field)).alias(field))
    return terms(values, field, size)


def nested_terms(
    df: DataFrame, outer: str, inner: str, outer_size: int, inner_size: int, **metrics: Column
) -> DataFrame:
    """Top outer values, and within each the top inner values.

    Both levels come from counts, so the join is between small tables whatever the input.
    """
    parents = terms(df, outer, outer_size, **metrics)
    children = (
        df.filter(F.col(outer).isNotNull() & F.col(inner).isNotNull())
        .groupBy(outer, inner)
        .agg(F.count("*").alias("inner_count"))
    )
    kept = parents.join(children, outer, "left")
    return top_rows(kept, [outer], [F.desc("inner_count"), F.asc(inner)], inner_size)


def segment_terms(df: DataFrame, size: int = 50) -> DataFrame:
    return terms(
        df,
        "segment",
        size,
        avg_rating=F.avg("rating"),
        avg_engagement=F.avg("engagement_score"),
        company_count=F.count("company_id"),
    )


def cardinality(df: DataFrame, field: str, rsd: float = 0.02) -> DataFrame:
    return df.agg(F.approx_count_distinct(field, rsd).alias("distinct_count"))


def missing_counts(df: DataFrame, fields: list[str]) -> DataFrame:
    counts = df.agg(*[F.count_if(missing(df, f)).alias(f) for f in fields])
    return counts.unpivot([], fields, "field", "missing")


def completeness(df: DataFrame, flags: dict[str, str]) -> DataFrame:
    """How many rows have each field; ``flags`` maps the flag's name to the field."""
    counts = df.agg(*[F.count_if(present(df, f)).alias(n) for n, f in flags.items()])
    return counts.unpivot([], list(flags), "flag", "count")


# Confidence buckets, lower bound included, upper bound not.
CONFIDENCE_BUCKETS = [("very_low", None, 0.5), ("low", 0.5, 0.7), ("medium", 0.7, 0.9), ("high", 0.9, None)]


def range_buckets(df: DataFrame, field: str, buckets: list[tuple] = CONFIDENCE_BUCKETS) -> DataFrame:
    """Counts per range; ranges nobody falls into are listed with zero."""

    def inside(low: float | None, high: float | None) -> Column:
        cond = F.col(field).isNotNull()
        if low is not None:
            cond = cond & (F.col(field) >= low)
        if high is not None:
            cond = cond & (F.col(field) < high)
        return cond

    counts = df.agg(*[F.count_if(inside(low, high)).alias(name) for name, low, high in buckets])
    return counts.unpivot([], [b[0] for b in buckets], "bucket", "count")


def tier_counts(df: DataFrame) -> DataFrame:
    return terms(
        df,
        "priority_tier",
        4,
        company_count=F.count("company_id"),
        with_email=F.count_if(present(df, "emails")),
        with_website=F.count_if(present(df, "website_domain")),
    )


def histogram(df: DataFrame, field: str, interval: float) -> DataFrame:
    return (
        df.filter(F.col(field).isNotNull())
        .groupBy((F.floor(F.col(field) / interval) * interval).cast("double").alias("bucket"))
        .agg(F.count("*").alias("count"))
        .orderBy("bucket")
    )


def day_histogram(df: DataFrame, field: str) -> DataFrame:
    return (
        df.filter(F.col(field).isNotNull())
        .groupBy(F.date_trunc("day", F.col(field)).alias("day"))
        .agg(F.count("*").alias("count"))
        .orderBy("day")
    )


COMPLETENESS = {
    "has_email": "emails",
    "has_phone": "phones",
    "has_website": "website_domain",
    "has_address": "address",
    "has_social": "social_links",
}


def dashboard(df: DataFrame) -> dict[str, DataFrame]:
    """All dashboard panels. Persist ``df`` first when it is costly: each panel reads it."""
    absent = [f for f in COMPLETENESS.values() if f not in df.columns]
    if absent:
        raise ValueError(f"the dashboard needs the columns {absent}")
    return {
        "total_companies": cardinality(df, "company_id"),
        "cities": nested_terms(df, "city", "company_type", 20, 5, avg_rating=F.avg("rating")),
        "industries": nested_terms(
            df, "industry", "company_size", 15, 5, avg_engagement=F.avg("engagement_score")
        ),
        "priority_distribution": tier_counts(df),
        "rating_distribution": histogram(df, "rating", 0.5),
        "recent_activity": day_histogram(df, "last_updated"),
        "data_completeness": completeness(df, COMPLETENESS),
    }


def dashboard_rows(df: DataFrame) -> DataFrame:
    """The dashboard as one answer in one pass: panel, key, count.

    Every row votes for its key in each panel; one aggregation counts the votes, and only
    then are the panels cut to their sizes. The total counts distinct companies.
    """
    absent = [f for f in COMPLETENESS.values() if f not in df.columns]
    if absent:
        raise ValueError(f"the dashboard needs the columns {absent}")

    def vote(panel: str, key: Column, cast: Column | None = None) -> Column:
        said = key.isNotNull() if cast is None else cast
        return F.when(said, F.struct(F.lit(panel).alias("panel"), key.cast("string").alias("key")))

    votes = F.array(
        vote("cities", F.col("city")),
        vote("industries", F.col("industry")),
        vote("priority_distribution", F.col("priority_tier")),
        vote("rating_distribution", (F.floor(F.col("rating") / 0.5) * 0.5).cast("double")),
        vote("recent_activity", F.date_format("last_updated", "yyyy-MM-dd")),
        *[vote("data_completeness", F.lit(n), present(df, c)) for n, c in COMPLETENESS.items()],
    )
    counted = df.select(F.inline(F.array_compact(votes))).groupBy("panel", "key").agg(F.count("*").alias("count"))
    order = Window.partitionBy("panel").orderBy(F.desc("count"), F.asc("key"))
    size = F.when(F.col("panel") == "cities", 20).when(F.col("panel") == "industries", 15)
    flags = df.sparkSession.createDataFrame([("data_completeness", n) for n in COMPLETENESS], "panel string, key string")
    rows = (
        counted.withColumn("_r", F.row_number().over(order))
        .filter(size.isNull() | (F.col("_r") <= size))
        .drop("_r")
        .join(flags.withColumn("_flag", F.lit(True)), ["panel", "key"], "full_outer")
        .select("panel", "key", F.coalesce("count", F.lit(0)).alias("count"))
    )
    total = df.agg(F.countDistinct("company_id").alias("count"))
    return rows.union(total.select(F.lit("total_companies"), F.lit("total"), "count"))


# Panels of the dashboard with their inner buckets and sizes.
NESTED = {"cities": ("city", "company_type", 20, 5), "industries": ("industry", "company_size", 15, 5)}


def dashboard_buckets(df: DataFrame) -> DataFrame:
    """The dashboard with its measures and inner buckets: panel, key, inner_key and measures.

    One aggregation over grouping sets counts outer and inner buckets, tiers, histograms and the
    flags of the whole together, so averages and sub-counts ride along. Only then are both
    levels cut to their sizes. ``inner_key`` is null in outer buckets.
    """
    absent = [f for f in COMPLETENESS.values() if f not in df.columns]
    if absent:
        raise ValueError(f"the dashboard needs the columns {absent}")
    keyed = df.select(
        *[F.col(f).cast("string").alias(f) for pair in NESTED.values() for f in pair[:2]],
        F.col("priority_tier").cast("string").alias("tier"),
        (F.floor(F.col("rating") / 0.5) * 0.5).cast("double").cast("string").alias("step"),
        F.date_format("last_updated", "yyyy-MM-dd").alias("day"),
        "rating",
        F.col("engagement_score").alias("engagement"),
        *[present(df, c).cast("int").alias(n) for n, c in COMPLETENESS.items()],
    )
    columns = [f for pair in NESTED.values() for f in pair[:2]] + ["tier", "step", "day"]
    sets = {(n, False): [o] for n, (o, *_) in NESTED.items()} | {(n, True): [o, i] for n, (o, i, *_) in NESTED.items()}
    sets |= {("priority_distribution", False): ["tier"], ("rating_distribution", False): ["step"]}
    sets |= {("recent_activity", False): ["day"], ("data_completeness", False): []}
    counted = keyed.groupingSets([[F.col(c) for c in cols] for cols in sets.values()], *columns).agg(
        F.grouping_id().alias("_set"),
        F.count("*").alias("count"),
        F.avg("rating").alias("avg_rating"),
        F.avg("engagement").alias("avg_engagement"),
        *[F.sum(n).alias(n) for n in COMPLETENESS],
    )
    panel, key, inner = F.lit(None).cast("string"), F.lit(None).cast("string"), F.lit(None).cast("string")
    for (name, nested), cols in sets.items():
        number = sum(1 << (len(columns) - 1 - i) for i, c in enumerate(columns) if c not in cols)
        here = F.col("_set") == number
        panel = F.when(here, name).otherwise(panel)
        if cols:
            key = F.when(here, F.col(cols[0])).otherwise(key)
        if nested:
            inner = F.when(here, F.col(cols[1])).otherwise(inner)
    nested = F.col("_set").isin(
        [sum(1 << (len(columns) - 1 - i) for i, c in enumerate(columns) if c not in cols) for (_, n), cols in sets.items() if n]
    )
    # A few rows for each bucket from here on, whatever the number of companies.
    rows = counted.select(panel.alias("panel"), key.alias("key"), inner.alias("inner_key"), nested.alias("_nested"),
                          "count", "avg_rating", "avg_engagement", *COMPLETENESS)
    buckets = rows.filter("panel <> 'data_completeness' AND key IS NOT NULL AND (NOT _nested OR inner_key IS NOT NULL)")
    limits = {n: (outer, within) for n, (_, _, outer, within) in NESTED.items()}
    size = F.lit(None).cast("int")
    for name, (outer, within) in limits.items():
        size = F.when(F.col("panel") == name, F.when(F.col("_nested"), within).otherwise(outer)).otherwise(size)
    order = Window.partitionBy("panel", "_nested", F.when(F.col("_nested"), F.col("key"))).orderBy(
        F.desc("count"), F.asc(F.coalesce("inner_key", "key"))
    )
    cut_ = buckets.withColumn("_r", F.row_number().over(order)).filter(size.isNull() | (F.col("_r") <= size))
    # Inner buckets of an outer one that is left.
    whole = Window.partitionBy("panel", "key")
    cut_ = cut_.withColumn("_outer", F.count_if(~F.col("_nested")).over(whole)).filter("_outer > 0")
    measured = cut_.select(
        "panel", "key", "inner_key", "count",
        F.when((F.col("panel") == "cities") & ~F.col("_nested"), F.col("avg_rating")).alias("avg_rating"),
        F.when((F.col("panel") == "industries") & ~F.col("_nested"), F.col("avg_engagement")).alias("avg_engagement"),
        *[F.when(F.col("panel") == "priority_distribution", F.col(f)).alias(n)
          for n, f in (("with_email", "has_email"), ("with_website", "has_website"))],
    )
    flags = rows.filter("panel = 'data_completeness'").unpivot("panel", list(COMPLETENESS), "key", "count")
    total = df.agg(F.countDistinct("company_id").alias("count")).select(
        F.lit("total_companies").alias("panel"), F.lit("total").alias("key"), "count"
    )
    rest = flags.withColumn("count", F.coalesce("count", F.lit(0))).unionByName(total)
    return measured.unionByName(rest, allowMissingColumns=True)


def distinct_sketches(df: DataFrame, by: list[str], field: str, bits: int = 12) -> DataFrame:
    """A mergeable sketch of the distinct values of a field for each group, to be stored.

    Rows without a value add nothing. Sketches of later loads are appended as they are.
    """
    return df.groupBy(*by).agg(F.hll_sketch_agg(field, bits).alias("sketch"), F.count(field).alias("values"))


def distinct_of_sketches(stored: DataFrame, by: list[str]) -> DataFrame:
    """Distinct values by fewer keys, from stored sketches alone: about 1.6 % off with 12 bits."""
    merged = F.hll_sketch_estimate(F.hll_union_agg("sketch")).alias("distinct_count")
    values = F.sum("values").alias("values")
    return stored.groupBy(*by).agg(merged, values) if by else stored.agg(merged, values)


def data_quality_panels(df: DataFrame) -> dict[str, DataFrame]:
    return {
        "missing": missing_counts(df, ["emails", "phones", "website_domain", "city"]),
        "low_confidence": range_buckets(df, "confidence_score"),
        "data_sources_distribution": multi_terms(df, "data_sources", 20),
    }


def distributions(seg: DataFrame) -> DataFrame:
    """Counts by industry, size and tier in one pass."""
    fields = {"industry": "industry", "company_size": "company_size", "priority_tier": "priority_tier"}
    pairs = F.array(*[F.struct(F.lit(n).alias("dimension"), F.col(f).alias("value")) for n, f in fields.items()])
    return (
        seg.select(F.inline(pairs))
        .groupBy("dimension", "value")
        .agg(F.count("*").alias("count"))
        .orderBy("dimension", F.desc("count"), "value")
    )


def global_stats(seg: DataFrame) -> DataFrame:
    return seg.agg(
        F.countDistinct("company_id").alias("total_companies"),
        F.countDistinct("city").alias("cities_covered"),
        F.countDistinct("industry").alias("industries_count"),
        F.avg(F.when(F.col("email_count") > 0, 1).otherwise(0)).alias("email_coverage"),
        F.avg(F.when(F.col("website_domain").isNotNull(), 1).otherwise(0)).alias("website_coverage"),
        F.max("last_updated").alias("last_update"),
    )


def data_quality_score(stats: DataFrame) -> DataFrame:
    """Add the 0 to 100 score to the one row of :func:`global_stats`."""
    volume = F.when(F.col("total_companies") > 1000, 0.4).otherwise(F.col("total_companies") / 2500)
    score = F.col("email_coverage") * 0.3 + F.col("website_coverage") * 0.3 + volume
    return stats.withColumn("data_quality_score", F.round(score * 100, 2))
