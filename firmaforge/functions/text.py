"""Normalisers for names, phones, e-mails, URLs, cities and addresses.

Every function maps Column to Column with built-in expressions only, so a chain of
them stays in one generated stage. Patterns carry ``(?U)`` because word boundaries
must treat Turkish letters as letters.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Legal forms, their display names and the patterns that reveal them.
LEGAL_FORMS = {
    "Anonim Şirket": [r"\bA\.Ş\.?\b", r"\bANONİM\s+ŞİRKET[İI]?\b", r"\bA\.S\.?\b"],
    "Limited Şirket": [r"\bLTD\.?\s*ŞT[İI]\.?\b", r"\bL[İI]M[İI]TED\s+ŞİRKET[İI]?\b", r"\bLTD\.?\b"],
    "Şahıs Şirketi": [r"\bŞAHIS\s+ŞİRKET[İI]?\b", r"\bŞAHIS\b"],
    "Kolektif Şirket": [r"\bKOLEKT[İI]F\s+ŞİRKET[İI]?\b", r"\bKOL\.?\s*ŞT[İI]\.?\b"],
    "Komandit Şirket": [r"\bKOMAND[İI]T\s+ŞİRKET[İI]?\b", r"\bKOM\.?\s*ŞT[İI]\.?\b"],
}

# Abbreviations in company names.
NAME_ABBREVIATIONS = {
    "TIC": "TİCARET",
    "SAN": "SANAYİ",
    "PAZ": "PAZARLAMA",
    "MÜH": "MÜHENDİSLİK",
    "İNŞ": "İNŞAAT",
    "BİLİŞ": "BİLİŞİM",
    "TEK": "TEKNOLOJİ",
    "TURZ": "TURİZM",
    "LOJ": "LOJİSTİK",
    "İTH": "İTHALAT",
    "İHR": "İHRACAT",
}

# Abbreviations in addresses.
ADDRESS_ABBREVIATIONS = {"Mah.": "Mahallesi", "Cad.": "Caddesi", "Sok.": "Sokak", "Apt.": "Apartmanı"}

# Cities whose spelling is corrected, keyed by the upper-case ASCII form.
CITY_SPELLINGS = {
    "ISTANBUL": "İstanbul",
    "ANKARA": "Ankara",
    "IZMIR": "İzmir",
    "BURSA": "Bursa",
    "ANTALYA": "Antalya",
    "ADANA": "Adana",
    "KONYA": "Konya",
    "GAZIANTEP": "Gaziantep",
    "KOCAELI": "Kocaeli",
    "KAYSERI": "Kayseri",
}

# Country names and their ISO codes, first hit wins.
COUNTRY_CODES = {
    "turkey": "TR",
    "türkiye": "TR",
    "united states": "US",
    "united kingdom": "GB",
    "germany": "DE",
    "france": "FR",
}

TURKISH = "ıİğĞüÜşŞöÖçÇ"
ASCII = "iIgGuUsSoOcC"


def blank_to_null(c: Column) -> Column:
    return F.when(F.length(c) > 0, c)


def collapse_spaces(c: Column) -> Column:
    return F.trim(F.regexp_replace(c, r"(?U)[\s\x1c-\x1f]+", " "))


def fold_turkish(c: Column) -> Column:
    return F.translate(c, TURKISH, ASCII)


def normalize_name(name: Column) -> Column:
    """Upper case, abbreviations spelt out, legal form and punctuation removed."""
    out = collapse_spaces(F.upper(F.coalesce(name, F.lit(""))))
    for short, full in NAME_ABBREVIATIONS.items():
        out = F.regexp_replace(out, rf"(?U)\b{short}\b", full)
    for patterns in LEGAL_FORMS.values():
        for pattern in patterns:
            out = F.regexp_replace(out, f"(?iU){pattern}", "")
    return collapse_spaces(F.regexp_replace(out, r"(?U)[^\p{L}\p{N}_\s&-]", " "))


def match_key(name: Column, compat: bool = False) -> Column:
    """Letters and digits of the normalised name, for comparing spellings.

    ``compat`` drops the Turkish capitals and plain I instead of folding them.
    """
    norm = normalize_name(name)
    folded = F.translate(norm, "İIĞÜŞÖÇ", "I") if compat else fold_turkish(norm)
    return F.regexp_replace(folded, "[^A-Z0-9]", "")


def legal_form(name: Column) -> Column:
    upper = F.upper(name)
    out = None
    for form, patterns in LEGAL_FORMS.items():
        hit = upper.rlike("(?iU)" + "|".join(patterns))
        out = F.when(hit, form) if out is None else out.when(hit, form)
    return out


def normalize_phone(phone: Column) -> Column:
    """E.164 with Turkey assumed where no country code is given."""
    digits = F.regexp_replace(phone, r"(?U)\D", "")
    number = (
        F.when(digits.startswith("90"), F.concat(F.lit("+"), digits))
        .when(digits.startswith("0"), F.concat(F.lit("+90"), F.substring(digits, 2, 1 << 30)))
        .otherwise(F.concat(F.lit("+90"), digits))
    )
    return F.when(F.length(phone) > 0, number).otherwise("")


def normalize_email(email: Column) -> Column:
    """Lower case without ``mailto:``; empty where the text cannot be an address."""
    text = F.replace(collapse_edges(F.lower(email)), F.lit("mailto:"), F.lit(""))
    host = F.split_part(text, F.lit("@"), F.lit(2))
    return F.when(text.contains("@") & host.contains("."), text).otherwise("")


def collapse_edges(c: Column) -> Column:
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def normalize_url(url: Column) -> Column:
    text = collapse_edges(F.lower(url))
    text = F.when(text.rlike("^https?://"), text).otherwise(F.concat(F.lit("https://"), text))
    text = F.regexp_replace(F.regexp_replace(text, "/+$", ""), r"://www\.", "://")
    return F.when(F.length(url) > 0, text).otherwise("")


def normalize_city(city: Column) -> Column:
    titled = F.initcap(collapse_edges(city))
    spellings = F.create_map(*[F.lit(x) for pair in CITY_SPELLINGS.items() for x in pair])
    return F.coalesce(F.try_element_at(spellings, F.upper(titled)), titled, F.lit(""))


def normalize_address(address: Column) -> Column:
    text = collapse_spaces(F.coalesce(address, F.lit("")))
    return reduce(
        lambda acc, kv: F.replace(acc, F.lit(kv[0]), F.lit(kv[1])), ADDRESS_ABBREVIATIONS.items(), text
    )


def url_domain(url: Column) -> Column:
    """Host without scheme, leading ``www.`` and port; null where there is none."""
    host = F.regexp_extract(F.lower(F.trim(url)), r"^(?:https?://)?(?:www\.)?([^/:?#\s]+)", 1)
    return blank_to_null(host)


def email_domain(email: Column) -> Column:
    norm = normalize_email(email)
    return blank_to_null(F.split_part(norm, F.lit("@"), F.lit(2)))


def country_code(country: Column) -> Column:
    lowered = F.lower(country)
    out = None
    for text, code in COUNTRY_CODES.items():
        hit = lowered.contains(text)
        out = F.when(hit, code) if out is None else out.when(hit, code)
    return out


def address_city(address: Column) -> Column:
    """The part before the last comma of an address; null where there is no comma."""
    return blank_to_null(F.trim(F.split_part(address, F.lit(","), F.lit(-2))))


def tokens(text: Column, stop_words: list[str] | None = None) -> Column:
    """Lower-case folded word tokens: runs of letters and digits, stop words left out.

    Stop words are compared before folding, as the analyser chain orders it.
    """
    lowered = F.lower(F.translate(text, "İ", "i"))
    if not stop_words:
        return F.array_remove(F.split(fold_latin(lowered), NOT_IN_WORDS), "")
    words = F.filter(F.split(lowered, NOT_IN_WORDS), lambda w: (F.length(w) > 0) & ~w.isin(stop_words))
    return F.transform(words, fold_latin)


NOT_IN_WORDS = r"[^\p{L}\p{N}]+"


def token_count(text: Column) -> Column:
    """How many :func:`tokens` a text has, without making them."""
    return F.regexp_count(text, F.lit(r"[\p{L}\p{N}]+"))


# Accented Latin letters and their plain forms.
ACCENTED = "àáâãäåçèéêëìíîïñòóôõöøùúûüýÿğış"
PLAIN = "aaaaaaceeeeiiiinoooooouuuuyygis"


def fold_latin(c: Column) -> Column:
    return F.translate(c, ACCENTED, PLAIN)


def edge_ngrams(token: Column, low: int = 2, high: int = 20) -> Column:
    """Prefixes of ``low`` to ``high`` characters, for indexed prefix search."""
    top = F.least(F.length(token), F.lit(high))
    return F.when(
        top >= low, F.transform(F.sequence(F.lit(low), top), lambda n: F.left(token, n))
    ).otherwise(F.array().cast("array<string>"))


def email_tokens(email: Column) -> Column:
    return F.split(F.lower(email), "@")
