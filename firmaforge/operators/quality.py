"""Declarative quality rules, evaluated together in one aggregation."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F

from firmaforge.schemas import COMPANY_TYPES


@dataclass(frozen=True, eq=False)  # columns do not compare to a bool
class Rule:
    """``test`` is true for a good value. Nulls are left out unless ``nulls_count``."""

    kind: str
    column: str
    test: Column | None
    mostly: float = 1.0
    nulls_count: bool = False
    over: Column | None = None

    @property
    def value(self) -> Column:
        return F.col(self.column) if self.over is None else self.over


def exists(column: str) -> Rule:
    return Rule("column_exists", column, None)


def not_null(column: str, mostly: float = 1.0) -> Rule:
    return Rule("not_null", column, F.col(column).isNotNull(), mostly, nulls_count=True)


def length_between(column: str, low: int, high: int, mostly: float = 1.0) -> Rule:
    return Rule("length_between", column, F.length(column).between(low, high), mostly)


def in_set(column: str, values: list, mostly: float = 1.0) -> Rule:
    return Rule("in_set", column, F.col(column).isin(values), mostly)


def matches(column: str, regex: str, mostly: float = 1.0) -> Rule:
    """The pattern has to match somewhere in the text."""
    return Rule("matches_regex", column, F.col(column).rlike(regex), mostly)


def not_matches(column: str, regex: str, mostly: float = 1.0) -> Rule:
    return Rule("not_matches_regex", column, ~F.col(column).rlike(regex), mostly)


def between(column: str, low: float, high: float, mostly: float = 1.0) -> Rule:
    return Rule("between", column, F.col(column).between(low, high), mostly)


def unique(column: str) -> Rule:
    return Rule("unique", column, None)


def company_rules() -> list[Rule]:
    """Rules for flat company rows: one e-mail and one phone per row."""
    # Bounds, sets and patterns of the rules.
    return [
        exists("legal_name"),
        not_null("legal_name", 0.99),
        length_between("legal_name", 2, 200),
        in_set("company_type", COMPANY_TYPES),
        in_set("country", ["TR", "US", "GB", "DE", "FR"], 0.95),
        matches("city", r"^[A-ZÇĞİÖŞÜa-zçğıöşü\s\-]+$", 0.95),
        matches("email", r"^[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,}$", 0.98),
        matches("phone", r"^\+?[0-9\s\-\(\)]+$", 0.95),
        length_between("phone", 10, 20),
        matches("website_url", r"^https?://[a-zA-Z0-9\-\.]+\.[a-zA-Z]{2,}", 0.95),
        between("website_status_code", 200, 599, 0.90),
        between("founding_year", 1900, 2024, 0.95),
        in_set(
            "headcount_band",
            ["1-10", "11-50", "51-200", "201-500", "501-1000", "1001-5000", "5000+"],
        ),
        between("rating", 1.0, 5.0),
        between("reviews_count", 0, 100000, 0.99),
        unique("company_id"),
        between("confidence_score", 0.0, 1.0),
        not_matches("legal_name", r"\d{11}"),
        not_matches("email", r"^[a-z]+\.[a-z]+@", 0.95),
    ]


def segment_rules() -> list[Rule]:
    from firmaforge.plans.gold import INDUSTRIES

    return [
        in_set("industry", [*INDUSTRIES, "Other"]),
        in_set("company_size", ["Micro", "Small", "Medium", "Large", "Unknown"]),
        in_set("engagement_level", ["Very Low", "Low", "Medium", "High"]),
        in_set("priority_tier", ["A", "B", "C", "D"]),
        between("engagement_score", 0.0, 100.0, 0.99),
    ]


def construction_rules() -> list[Rule]:
    """What a company record must satisfy to exist at all."""
    return [
        not_null("legal_name"),
        between("confidence_score", 0.0, 1.0),
        matches("email", r"^[^@\s]+@[^@\s]+\.[^@\s]+$"),
        matches("website_url", r"^https?://\S+$"),
    ]


RESULT = ["rule", "column", "evaluated", "passed", "pass_share", "mostly", "success"]


def _finished(df: DataFrame) -> DataFrame:
    share = F.when(F.col("evaluated") > 0, F.col("passed") / F.col("evaluated"))
    return (
        df.withColumn("pass_share", share)
        # A rule without any value to look at holds.
        .withColumn("success", F.coalesce(F.col("pass_share") >= F.col("mostly"), F.lit(True)))
        .select(*RESULT)
    )


def _counters(row_rules: list[Rule]) -> list[Column]:
    """Two counts a rule: values looked at (e) and values that pass (p)."""
    aggs = []
    for i, rule in enumerate(row_rules):
        counted = F.lit(True) if rule.nulls_count else rule.value.isNotNull()
        aggs.append(F.count(F.when(counted, 1)).alias(f"e{i}"))
        aggs.append(F.count(F.when(counted & rule.test, 1)).alias(f"p{i}"))
    return aggs


def run_rules(df: DataFrame, rules: list[Rule]) -> DataFrame:
    """One result row per rule.

    All row rules share one scan and one aggregation without a shuffle of rows; a uniqueness
    rule adds a count per value, which shrinks before it is shuffled.
    """
    spark = df.sparkSession
    present = [r for r in rules if r.kind != "column_exists" and (r.over is not None or r.column in df.columns)]
    row_rules = [r for r in present if r.kind != "unique"]
    aggs = _counters(row_rules)
    results = []
    if row_rules:
        lines = F.array(
            *[
                F.struct(
                    F.lit(r.kind).alias("rule"),
                    F.lit(r.column).alias("column"),
                    F.col(f"e{i}").alias("evaluated"),
                    F.col(f"p{i}").alias("passed"),
                    F.lit(float(r.mostly)).alias("mostly"),
                )
                for i, r in enumerate(row_rules)
            ]
        )
        results.append(df.agg(*aggs).select(F.inline(lines)))
    for rule in (r for r in present if r.kind == "unique"):
        counts = df.filter(rule.value.isNotNull()).groupBy(rule.value.alias("_v")).agg(F.count("*").alias("n"))
        results.append(
            counts.agg(
                F.coalesce(F.sum("n"), F.lit(0)).alias("evaluated"),
                F.count(F.when(F.col("n") == 1, 1)).alias("passed"),
            ).select(
                F.lit("unique").alias("rule"),
                F.lit(rule.column).alias("column"),
                "evaluated",
                "passed",
                F.lit(1.0).alias("mostly"),
            )
        )
    # Rules on columns that are not there are decided by the schema alone.
    known = [(r.kind, r.column, 1, int(r.column in df.columns), r.mostly) for r in rules if r not in present]
    if known:
        ddl = "rule string, column string, evaluated long, passed long, mostly double"
        results.append(spark.createDataFrame(known, ddl))
    return _finished(reduce(DataFrame.unionByName, results))


RUNS = "run string, rule string, column string, evaluated long, passed long, pass_share double, mostly double, success boolean"


def write_checked(df: DataFrame, rules: list[Rule], path: str, runs_path: str, run: str) -> DataFrame:
    """Write a layer and check it in the same pass; returns the result rows of this run.

    The row rules are counted by ``DataFrame.observe`` in the tasks that write, so the plan has one
    scan and the rows are computed once. Uniqueness needs a shuffle and takes a second look at the
    written column alone. Tasks that are run again must not count twice, so the number of rows observed is
    compared with the number written (file footers only); where they differ the rules are run on
    the written table. The results are appended to the table of runs, partitioned by run, and
    a run that is repeated replaces its own rows.
    """
    spark = df.sparkSession
    row_rules = [r for r in rules if r.kind not in ("unique", "column_exists") and (r.over is not None or r.column in df.columns)]
    seen = Observation()
    observed = df.observe(seen, F.count(F.lit(1)).alias("n_rows"), *_counters(row_rules))
    observed.write.mode("overwrite").parquet(path)
    written = spark.read.schema(df.schema).parquet(path)
    counts = seen.get
    if counts["n_rows"] == written.count():
        lines = [
            (r.kind, r.column, counts[f"e{i}"], counts[f"p{i}"], float(r.mostly)) for i, r in enumerate(row_rules)
        ]
        ddl = "rule string, column string, evaluated long, passed long, mostly double"
        results = _finished(spark.createDataFrame(lines, ddl))
        others = [r for r in rules if r not in row_rules]
        if others:
            results = results.unionByName(run_rules(written, others))
    else:
        results = run_rules(written, rules)
    # A few rows; only the partition of this run is replaced.
    out = results.withColumn("run", F.lit(run)).coalesce(1)
    out.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("run").parquet(runs_path)
    return stored_runs(spark, runs_path).filter(F.col("run") == run)


def stored_runs(spark: SparkSession, runs_path: str) -> DataFrame:
    """The result rows of all runs so far, for :func:`report` and :func:`trend`."""
    return spark.read.schema(RUNS).parquet(runs_path)


def trend(runs: DataFrame, run: str = "run") -> DataFrame:
    """Each rule's share against the run before (by the order of run names)."""
    before = Window.partitionBy("rule", "column").orderBy(run)
    change = F.col("pass_share") - F.lag("pass_share").over(before)
    return runs.select(run, "rule", "column", "pass_share", "success", change.alias("change"))


def summary(results: DataFrame) -> DataFrame:
    """Counts and success percentage of one run."""
    ok = F.col("success")
    return results.agg(
        F.count("*").alias("evaluated_expectations"),
        F.count_if(ok).alias("successful_expectations"),
        F.count_if(~ok).alias("unsuccessful_expectations"),
        (F.count_if(ok) * 100.0 / F.count("*")).alias("success_percent"),
        F.bool_and("success").alias("success"),
    )


def failing_kinds(results: DataFrame, limit: int = 10) -> DataFrame:
    """Rule kinds by number of failures, most frequent first."""
    return (
        results.filter(~F.col("success"))
        .groupBy("rule")
        .agg(F.count("*").alias("failures"))
        .orderBy(F.desc("failures"), "rule")
        .limit(limit)
    )


# Advice by failing rule kind.
ADVICE = {
    "not_null": "Review data collection to ensure required fields are captured",
    "matches_regex": "Improve data validation at collection time",
    "unique": "Review deduplication logic to prevent duplicate records",
}
CRITICAL = "Critical: Data quality below acceptable threshold. Review entire pipeline"


def report(runs: DataFrame, run: str = "run") -> DataFrame:
    """One row over many runs: totals, success rate and recommendations.

    ``runs`` holds rule results with a column that names the run; a run succeeds when all its
    rules do.
    """
    advice = [F.when(F.count_if(~F.col("ok") & F.col(f"_{k}")) > 0, F.lit(t)) for k, t in ADVICE.items()]
    failed = {f"_{k}": F.count_if(~F.col("success") & (F.col("rule") == k)) > 0 for k in ADVICE}
    per_run = runs.groupBy(run).agg(
        F.bool_and("success").alias("ok"), *[v.alias(k) for k, v in failed.items()]
    )
    good = F.count_if(F.col("ok"))
    total = F.count("*")
    rate = F.when(total > 0, good * 100.0 / total).otherwise(0.0)
    return per_run.agg(
        total.alias("total_validations"),
        good.alias("successful_validations"),
        (total - good).alias("failed_validations"),
        rate.alias("overall_success_rate"),
        F.array_compact(F.array(*advice, F.when(rate < 90, F.lit(CRITICAL)))).alias("recommendations"),
    )


def record_issues(df: DataFrame) -> DataFrame:
    """Per-record checks of a load: a name must be there, a website needs a scheme."""
    missing = F.coalesce(F.length("legal_name") > 0, F.lit(False))
    bad_url = (F.length("website_url") > 0) & ~F.col("website_url").rlike("^https?://")
    return df.withColumn(
        "issues",
        F.array_compact(
            F.array(
                F.when(~missing, F.lit("Missing legal_name")),
                F.when(bad_url, F.lit("Invalid website URL")),
            )
        ),
    )


def record_counts(checked: DataFrame) -> DataFrame:
    return checked.agg(
        F.count("*").alias("total"),
        F.count_if(F.size("issues") == 0).alias("valid"),
        F.count_if(F.size("issues") > 0).alias("invalid"),
    )
