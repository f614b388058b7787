"""Company facts out of web pages: one projection per page table, no row ever leaves the JVM."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from firmaforge.functions.text import blank_to_null, collapse_edges, url_domain

# Role mailboxes read off pages.
PAGE_EMAIL = r"\b(?:info|contact|sales|support|hello|admin|office)@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,}\b"

# Landline area codes and the two phone shapes.
AREA_CODES = (
    "212|216|312|232|224|262|282|322|342|352|362|372|382|392|422|432|442|452|462|472|482"
)
PHONES = [
    rf"(?:\+90|0)?[\s-]?\(?(?:{AREA_CODES})\)?[\s-]?\d{{3}}[\s-]?\d{{2}}[\s-]?\d{{2}}",
    r"(?:\+90|0)?[\s-]?\(?5\d{2}\)?[\s-]?\d{3}[\s-]?\d{2}[\s-]?\d{2}",
]

# Words that announce an address, in order of preference.
ADDRESS_WORDS = ["adres", "address", "location", "konum"]

# Link patterns of the social platforms.
SOCIAL = {
    "linkedin": r"linkedin\.com/company/([^/\s]+)",
    "instagram": r"instagram\.com/([^/\s]+)",
    "facebook": r"facebook\.com/([^/\s]+)",
    "twitter": r"(?:twitter|x)\.com/([^/\s]+)",
    "youtube": r"youtube\.com/(?:c/|channel/|user/)([^/\s]+)",
}

# Stop words of the keyword count.
STOP_WORDS = [
    "ve", "ile", "bir", "bu", "da", "de", "için", "olan", "olarak", "the", "and", "or", "for", "with", "as",
]

# Paths that may hold contact data, best first.
CONTACT_PATHS = ["/iletisim", "/contact", "/hakkimizda", "/about", "/kurumsal"]

ENTITIES = {"&nbsp;": " ", "&lt;": "<", "&gt;": ">", "&quot;": '"', "&#39;": "'", "&amp;": "&"}


def decode_entities(c: Column) -> Column:
    return reduce(lambda acc, kv: F.replace(acc, F.lit(kv[0]), F.lit(kv[1])), ENTITIES.items(), c)


def inner_text(fragment: Column) -> Column:
    return collapse_edges(decode_entities(F.regexp_replace(fragment, "(?s)<[^>]*>", "")))


def visible_text(html: Column) -> Column:
    """Text without tags; bodies of scripts and styles and comments are left out."""
    bare = F.regexp_replace(html, r"(?is)<(script|style)\b.*?</\1\s*>|<!--.*?-->|<!DOCTYPE[^>]*>", "")
    return decode_entities(F.regexp_replace(bare, "(?s)<[^>]*>", ""))


def page_title(html: Column) -> Column:
    raw = F.regexp_extract(html, r"(?is)<title[^>]*>(.*?)</title>", 1)
    return F.when(html.rlike("(?i)<title"), inner_text(raw))


def _meta(html: Column, attribute: str, value: str) -> Column:
    """``content`` of the first meta tag with the attribute, whichever order they come in."""
    tag = F.regexp_extract(html, rf"(?is)<meta\b[^>]*\b{attribute}\s*=\s*[\"']{value}[\"'][^>]*>", 0)
    content = F.regexp_extract(tag, r"(?is)\bcontent\s*=\s*(\"([^\"]*)\"|'([^']*)')", 1)
    unquoted = F.substring(content, F.lit(2), F.greatest(F.length(content) - 2, F.lit(0)))
    return F.when(tag != "", collapse_edges(decode_entities(unquoted)))


def meta_description(html: Column) -> Column:
    return _meta(html, "name", "description")


def headings(html: Column, limit: int = 3) -> Column:
    found = F.regexp_extract_all(html, F.lit(r"(?is)<h1\b[^>]*>(.*?)</h1>"), F.lit(1))
    return F.transform(F.slice(found, 1, limit), inner_text)


def company_name(html: Column) -> Column:
    """og:title, else the title up to the first bar or dash."""
    title = page_title(html)
    from_title = (
        F.when(title.contains("|"), F.split_part(title, F.lit("|"), F.lit(1)))
        .when(title.contains("-"), F.split_part(title, F.lit("-"), F.lit(1)))
        .otherwise(title)
    )
    return F.coalesce(_meta(html, "property", "og:title"), collapse_edges(from_title))


def links(html: Column) -> Column:
    """Targets of all anchors in page order."""
    found = F.regexp_extract_all(
        html, F.lit(r"(?is)<a\b[^>]*?\bhref\s*=\s*(\"[^\"]*\"|'[^']*')"), F.lit(1)
    )
    return F.transform(found, lambda x: decode_entities(F.substring(x, F.lit(2), F.length(x) - 2)))


def _distinct_sorted(*arrays: Column) -> Column:
    return F.sort_array(F.array_distinct(F.concat(*arrays)))


def emails(text: Column, hrefs: Column) -> Column:
    """Role mailboxes in the text and in ``mailto:`` links."""
    pattern = f"(?iU){PAGE_EMAIL}"
    in_text = F.transform(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.lower)
    mails = F.transform(
        F.filter(hrefs, lambda h: h.startswith("mailto:")),
        lambda h: F.lower(collapse_edges(F.replace(h, F.lit("mailto:"), F.lit("")))),
    )
    return _distinct_sorted(in_text, F.filter(mails, lambda m: m.rlike(f"^{pattern}")))


def phones(text: Column, hrefs: Column) -> Column:
    """Turkish numbers in the text with +90, and ``tel:`` links as they are."""
    found = F.concat(*[F.regexp_extract_all(text, F.lit(f"(?U){p}"), F.lit(0)) for p in PHONES])
    bare = F.transform(found, lambda p: F.regexp_replace(p, r"(?U)[\s()-]", ""))
    national = F.transform(
        bare,
        lambda p: F.when(p.startswith("+"), p).otherwise(F.concat(F.lit("+90"), F.regexp_replace(p, "^0+", ""))),
    )
    tel = F.transform(
        F.filter(hrefs, lambda h: h.startswith("tel:")),
        lambda h: F.regexp_replace(F.replace(h, F.lit("tel:"), F.lit("")), r"(?U)[\s()-]", ""),
    )
    return _distinct_sorted(national, F.filter(tel, lambda p: p != ""))


def address(html: Column) -> Column:
    """Text of the element whose own text names an address, 21 to 499 characters long."""
    found = []
    for word in ADDRESS_WORDS:
        # The innermost element around the first text run with the word. No pattern here
        # repeats a group: the matcher would recurse once for each tag of the page.
        start = rf"(?is)<([a-z][a-z0-9]*)\b[^>]*>([^<]*{word}[^<]*)"
        head, tag, own = (F.regexp_extract(html, start, i) for i in range(3))
        tail = F.substring(html, F.position(head, html) + F.length(head), F.length(html))
        end = F.concat(F.lit("(?is)</"), tag, F.lit("\\b.*"))
        rest = F.regexp_replace(tail, end, F.lit(""))
        closed = F.length(rest) < F.length(tail)
        text = inner_text(F.concat(own, rest))
        found.append(F.when((tag != "") & closed & F.length(text).between(21, 499), text))
    return F.coalesce(*found)


def social_links(hrefs: Column) -> Column:
    """Platform to link; the last link of a platform wins."""
    entries = []
    for platform, pattern in SOCIAL.items():
        last = F.try_element_at(F.filter(hrefs, lambda h: h.rlike(pattern)), F.lit(-1))
        entries.append(F.when(last.isNotNull(), F.struct(F.lit(platform).alias("k"), last.alias("v"))))
    return F.map_from_entries(F.array_compact(F.array(*entries)))


def ssl_enabled(headers: Column) -> Column:
    return F.length(F.try_element_at(headers, F.lit("strict-transport-security"))) > 0


def page_words(text: Column) -> Column:
    words = F.transform(F.split(F.lower(text), r"(?U)\s+"), lambda w: F.regexp_replace(w, r"(?U)[^\w\s]", ""))
    return F.filter(words, lambda w: (F.length(w) > 3) & ~w.isin(STOP_WORDS))


def keyword_counts(df: DataFrame, id_col: str, text: str) -> DataFrame:
    """How often each word of more than three letters occurs in each page."""
    return (
        df.select(id_col, F.explode(page_words(F.col(text))).alias("word"))
        .groupBy(id_col, "word")
        .agg(F.count("*").alias("n"))
    )


def top_words(text: Column, limit: int = 20) -> Column:
    """The ``limit`` most frequent words of a text; ties in alphabetical order.

    A page is one row, so its words are sorted and counted by runs within it: no shuffle. Both
    arrays are bound as variables of a lambda, so that they are made once per row.
    """

    def bound(value: Column, use) -> Column:
        return F.transform(F.array(value), use)[0]

    def starts(words: Column) -> Column:
        places = F.when(F.size(words) > 0, F.sequence(F.lit(0), F.size(words) - 1)).otherwise(F.array().cast("array<int>"))
        return F.filter(places, lambda i: (i == 0) | (F.get(words, i) != F.get(words, i - 1)))

    def ranked(words: Column, at: Column) -> Column:
        runs = F.transform(
            at, lambda k, i: F.struct((k - F.coalesce(F.get(at, i + 1), F.size(words))).alias("n"), F.get(words, k).alias("word"))
        )
        return F.transform(F.slice(F.sort_array(runs), 1, limit), lambda run: run["word"])

    return bound(F.sort_array(page_words(text)), lambda words: bound(starts(words), lambda at: ranked(words, at)))


def keywords(df: DataFrame, id_col: str, text: str, limit: int = 20) -> DataFrame:
    """id and keywords of the pages that have any."""
    # Exploded and not filtered, since a filter would be pushed down and count all words twice.
    found = F.filter(F.array(top_words(F.col(text), limit)), lambda words: F.size(words) > 0)
    return df.select(id_col, F.explode(found).alias("keywords"))


def parse_pages(pages: DataFrame, html: str = "html") -> DataFrame:
    """All page facts. Text and links are computed once and shared by the extractors."""
    h = F.col(html)
    prepared = pages.withColumns({"_text": visible_text(h), "_links": links(h)})
    facts = {
        "title": page_title(h),
        "meta_description": meta_description(h),
        "h1_keywords": headings(h),
        "company_name": company_name(h),
        "emails": emails(F.col("_text"), F.col("_links")),
        "phones": phones(F.col("_text"), F.col("_links")),
        "address": address(h),
        "social_links": social_links(F.col("_links")),
    }
    if "headers" in pages.columns:
        facts["ssl_enabled"] = ssl_enabled(F.col("headers"))
    facts["keywords"] = F.coalesce(top_words(F.col("_text")), F.array().cast("array<string>"))
    kept = [c for c in pages.columns if c not in (html, *facts)]
    return prepared.select(*kept, *[v.alias(n) for n, v in facts.items()])


def with_contact_page(parsed: DataFrame, url: str = "url", status: str = "status_code") -> DataFrame:
    """Main page of each site completed from its best contact page that answered 200.

    Fields the contact page has replace those of the main page.
    """
    path = F.regexp_extract(F.col(url), r"^https?://[^/]+(/[^?#]*)?", 1)
    rank = F.try_element_at(
        F.create_map(*[F.lit(x) for i, p in enumerate(CONTACT_PATHS) for x in (p, i)]),
        F.regexp_replace(path, "/+$", ""),
    )
    sited = parsed.withColumns({"_site": url_domain(F.col(url)), "_rank": rank, "_path": path})
    facts = [c for c in parsed.columns if c not in (url, status)]
    # min_by keeps one page per site before the shuffle, however many a site has.
    contact = (
        sited.filter(F.col("_rank").isNotNull() & (F.col(status) == 200))
        .groupBy("_site")
        .agg(F.min_by(F.struct(*facts), F.col("_rank")).alias("_c"))
    )
    main = sited.filter(F.regexp_replace("_path", "/+$", "") == "").drop("_rank", "_path")
    joined = main.join(contact, "_site", "left")
    return joined.select(url, status, *[F.coalesce(F.col(f"_c.{f}"), F.col(f)).alias(f) for f in facts])


def name_from_domain(name: Column, url: Column) -> Column:
    """The name found, else the first label of the host in title case."""
    return F.coalesce(blank_to_null(name), F.initcap(F.split_part(url_domain(url), F.lit("."), F.lit(1))))
