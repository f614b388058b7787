"""The daily chain: normalise, check, resolve, enrich, flatten, report."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from firmaforge.operators.compliance import compliance_report
from firmaforge.operators.quality import record_counts, record_issues
from firmaforge.operators.resolve import MatchConfig, resolve
from firmaforge.sources.records import (
    enrich_from_registry,
    merge_sources,
    normalize_records,
    with_default_country,
)
from firmaforge.sources.sinks import search_documents
from firmaforge.session import cut


@dataclass(frozen=True)
class Daily:
    companies: DataFrame
    documents: DataFrame
    matches: DataFrame
    validation: DataFrame
    compliance: DataFrame


def run(
    records: DataFrame,
    registry: DataFrame,
    suppressed: DataFrame | None = None,
    cfg: MatchConfig = MatchConfig(),
    second: DataFrame | None = None,
) -> Daily:
    """All steps as one chain; checks report beside it and drop nothing.

    Records of a ``second`` source complete those of the same id first.

    The normalised records are written down once: matching, merging and checking all read
    them, and none should parse and clean the sources again.
    """
    normal = cut(normalize_records(records if second is None else merge_sources(records, second)))
    flat = normal.select(
        F.col("identity.legal_name").alias("legal_name"), F.col("web_presence.website_url").alias("website_url")
    )
    resolved = resolve(normal, cfg)
    companies = with_default_country(enrich_from_registry(resolved.companies, registry))
    if suppressed is None:
        suppressed = records.sparkSession.createDataFrame([], "id_hash string")
    documents = search_documents(companies)
    return Daily(
        companies,
        documents,
        resolved.matches,
        record_counts(record_issues(flat)),
        compliance_report(documents, suppressed),
    )
