"""Personal-data rules: detecting, masking and filtering, for flat and nested records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# The three shapes of a personal name.
PERSONAL_NAME_SHAPES = [
    r"\b[A-Z][a-z]+\s+[A-Z][a-z]+\b",
    r"\b[A-Z]\.\s*[A-Z][a-z]+\b",
    r"\b[A-Z][a-z]+\s+[A-Z]\.\b",
]

# Words that mark a company name.
COMPANY_WORDS = ["Ltd", "Inc", "Corp", "Company", "Group", "A.Ş.", "Ltd.Şti."]

# Prefixes of role mailboxes.
CORPORATE_PREFIXES = [
    "info", "contact", "sales", "support", "hello", "admin", "office", "inquiry", "service",
    "help", "team", "hr", "career", "job", "press", "media", "partner", "business",
]
CONTACT_PREFIXES = ["info", "contact", "sales", "support", "hello", "admin", "office"]

# Identifiers, in masking order.
PII_PATTERNS = {
    "tc_kimlik": r"\b\d{11}\b",
    "credit_card": r"\b\d{4}[\s-]?\d{4}[\s-]?\d{4}[\s-]?\d{4}\b",
    "iban": r"\b[A-Z]{2}\d{2}[A-Z0-9]{4}\d{7}[A-Z0-9]{0,16}\b",
    "passport": r"\b[A-Z][0-9]{8}\b",
}
EMAIL = r"\b[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,}\b"

REDACTED = "[REDACTED]"
EMAIL_REDACTED = "[EMAIL_REDACTED]"
NAME_REDACTED = "[NAME_REDACTED]"

# Fields that must not be collected at all.
SENSITIVE_FIELDS = ["religion", "political_views", "health_data", "biometric_data"]


def _any(hits: list[Column]) -> Column:
    out = hits[0]
    for hit in hits[1:]:
        out = out | hit
    return out


def is_personal_name(text: Column) -> Column:
    shaped = text.rlike("(?U)" + "|".join(PERSONAL_NAME_SHAPES))
    # Exactly two words, both starting with a capital.
    two_capitals = text.rlike(r"(?U)^\s*\p{Lu}\S*\s+\p{Lu}\S*\s*$")
    company = _any([text.contains(w) for w in COMPANY_WORDS])
    return F.coalesce(two_capitals & shaped & ~company, F.lit(False))


def local_part(email: Column) -> Column:
    return F.lower(F.split_part(email, F.lit("@"), F.lit(1)))


def is_corporate_email(email: Column) -> Column:
    """Role mailboxes are corporate; ``first.last`` and anything with a digit is not."""
    local = local_part(email)
    verdict = (
        F.when(local.rlike("^(?:" + "|".join(CORPORATE_PREFIXES) + ")"), True)
        .when(local.rlike(r"^\p{L}+\.\p{L}+$"), False)
        .otherwise(~local.rlike(r"(?U)\d"))
    )
    return F.coalesce(email.contains("@") & verdict, F.lit(False))


def is_contact_email(email: Column) -> Column:
    """The stricter rule for published contacts: role mailbox, or neither digit nor dot."""
    local = local_part(email)
    role = local.rlike("^(?:" + "|".join(CONTACT_PREFIXES) + ")")
    return F.coalesce(role | ~local.rlike(r"(?U)[\d.]"), F.lit(False))


def contact_emails(emails: Column) -> Column:
    return F.filter(emails, is_contact_email)


def _has_number(text: Column) -> Column:
    """Every identifier holds four digits in a row: one cheap scan spares most texts the
    slow, boundary-checking patterns."""
    return text.rlike(r"\p{Nd}{4}")


def pii_hits(text: Column) -> list[tuple[str, Column]]:
    number = _has_number(text)
    hits = [(name, number & text.rlike(f"(?iU){p}")) for name, p in PII_PATTERNS.items()]
    return [*hits, ("personal_name", is_personal_name(text))]


def detect_pii(text: Column) -> Column:
    """Names of the kinds of personal data found, in rule order."""
    return F.array_compact(F.array(*[F.when(hit, F.lit(name)) for name, hit in pii_hits(text)]))


def has_pii(text: Column) -> Column:
    # One scan for all identifiers, and only where there are digits enough.
    number = text.rlike("(?iU)" + "|".join(f"(?:{p})" for p in PII_PATTERNS.values()))
    return F.coalesce((_has_number(text) & number) | is_personal_name(text), F.lit(False))


def mask_pii(text: Column, names: bool = False) -> Column:
    """Identifiers, then e-mails of persons, replaced by markers.

    ``names`` also replaces a text that is itself a personal name.
    """
    masked = text
    for pattern in PII_PATTERNS.values():
        masked = F.regexp_replace(masked, f"(?iU){pattern}", REDACTED)
    masked = F.when(_has_number(text), masked).otherwise(text)
    without = F.aggregate(
        personal_emails(masked), masked, lambda acc, e: F.replace(acc, e, F.lit(EMAIL_REDACTED))
    )
    masked = F.when(text.contains("@"), without).otherwise(masked)
    return F.when(is_personal_name(text), NAME_REDACTED).otherwise(masked) if names else masked


def personal_emails(text: Column) -> Column:
    found = F.regexp_extract_all(text, F.lit(f"(?U){EMAIL}"), F.lit(0))
    return F.filter(found, lambda e: ~is_corporate_email(e))


def _clean_text(c: Column, strict: bool) -> Column:
    if strict:
        return mask_pii(c, names=True)
    return F.when(has_pii(c), mask_pii(c)).otherwise(c)


def _tainted(c: Column, strict: bool) -> Column:
    if not strict:
        return has_pii(c)
    return has_pii(c) | (c.contains("@") & (F.size(personal_emails(c)) > 0))


def clean_value(c: Column, dtype: T.DataType, strict: bool = False) -> Column:
    """Filter one value of any type: texts are masked, tainted list items are dropped."""
    if isinstance(dtype, T.StringType):
        return _clean_text(c, strict)
    if isinstance(dtype, T.StructType):
        inner = F.struct(
            *[clean_value(c[f.name], f.dataType, strict).alias(f.name) for f in dtype.fields]
        )
        return F.when(c.isNotNull(), inner)
    if isinstance(dtype, T.MapType):
        return F.transform_values(c, lambda _, v: clean_value(v, dtype.valueType, strict))
    if isinstance(dtype, T.ArrayType):
        item = dtype.elementType
        if isinstance(item, T.StringType):
            return F.filter(c, lambda x: x.isNull() | ~_tainted(x, strict))
        if isinstance(item, (T.StructType, T.MapType, T.ArrayType)):
            return F.transform(c, lambda x: clean_value(x, item, strict))
    return c


def filter_pii(df: DataFrame, strict: bool = False, keep: tuple[str, ...] = ()) -> DataFrame:
    """Filter every column of ``df`` except those in ``keep`` (keys, hashes)."""
    return df.select(
        *[
            (F.col(f"`{f.name}`") if f.name in keep else clean_value(F.col(f"`{f.name}`"), f.dataType, strict)).alias(f.name)
            for f in df.schema.fields
        ]
    )


def text_leaves(c: Column, dtype: T.DataType) -> Column:
    """All texts inside of a value of any type, as one array."""
    none = F.array().cast("array<string>")
    if isinstance(dtype, T.StringType):
        return F.array(c)
    if isinstance(dtype, T.StructType):
        inner = [text_leaves(c[f.name], f.dataType) for f in dtype.fields]
        return F.when(c.isNotNull(), F.concat(*inner)).otherwise(none) if inner else none
    if isinstance(dtype, T.MapType):
        return text_leaves(F.map_values(c), T.ArrayType(dtype.valueType))
    if isinstance(dtype, T.ArrayType):
        item = dtype.elementType
        own = c if isinstance(item, T.StringType) else F.flatten(F.transform(c, lambda x: text_leaves(x, item)))
        return F.coalesce(own, none)
    return none


def record_has_pii(df: DataFrame) -> Column:
    """Personal data in any text of the row, however deep it lies."""
    leaves = F.concat(*[text_leaves(F.col(f"`{f.name}`"), f.dataType) for f in df.schema.fields])
    return F.coalesce(F.exists(leaves, has_pii), F.lit(False))


def hash_identifier(identifier: Column) -> Column:
    return F.sha2(identifier.cast("string"), 256)


def change_hash(*columns: str) -> Column:
    """Digest of the named columns that does not depend on the order they are given in.

    Nulls are written out, so a value that goes missing changes the digest.
    """
    body = F.to_json(F.struct(*sorted(columns)), {"ignoreNullFields": "false"})
    return F.sha2(body, 256)


def provenance(source_url: Column, source_type: str, fetch_ts: Column, metadata: Column) -> Column:
    """Where a record came from; the hash covers the metadata as JSON."""
    return F.struct(
        source_url.alias("source_url"),
        F.lit(source_type).alias("source_type"),
        fetch_ts.alias("fetch_ts"),
        F.lit("1.0.0").alias("parser_version"),
        F.md5(F.to_json(metadata)).alias("hash"),
    )
