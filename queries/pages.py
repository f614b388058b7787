"""Facts out of the web pages."""

from __future__ import annotations

from pyspark.sql import functions as F

from firmaforge.operators import pages as ops
from firmaforge.plans import views
from queries.registry import query


def _decode(expr: str) -> str:
    for entity, char in ops.ENTITIES.items():
        expr = f"replace({expr}, '{entity}', '{char.replace(chr(39), chr(39) * 2)}')"
    return expr


def _inner(expr: str) -> str:
    bare = _decode(f"regexp_replace({expr}, '(?s)<[^>]*>', '', 'g')")
    return f"regexp_replace({bare}, '^\\s+|\\s+$', '', 'g')"


_TITLE = _inner("regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1)")


@query(
    "page_seo",
    f"""SELECT page_id, {_TITLE} AS title,
          array_to_string(list_transform(regexp_extract_all(html, '(?is)<h1\\b[^>]*>(.*?)</h1>', 1)[1:3], lambda h: {_inner('h')}), '|') AS h1,
          CAST(NULL AS VARCHAR) AS meta_description FROM pages""",
)
def page_seo(spark, d):
    html = F.col("html")
    return views.table(spark, d, "pages").select(
        "page_id",
        ops.page_title(html).alias("title"),
        F.array_join(ops.headings(html), "|").alias("h1"),
        ops.meta_description(html).alias("meta_description"),
    )


@query(
    "page_name",
    f"""WITH t AS (SELECT page_id, url, {_TITLE} AS title FROM pages)
        SELECT page_id, regexp_replace(CASE WHEN contains(title, '|') THEN split_part(title, '|', 1)
          WHEN contains(title, '-') THEN split_part(title, '-', 1) ELSE title END, '^\\s+|\\s+$', '', 'g') AS company_name FROM t""",
)
def page_name(spark, d):
    return views.table(spark, d, "pages").select("page_id", ops.company_name(F.col("html")).alias("company_name"))


_TEXT = _decode(
    "regexp_replace(regexp_replace(html, '(?is)<script\\b.*?</script\\s*>|<style\\b.*?</style\\s*>|<!--.*?-->|<!DOCTYPE[^>]*>', '', 'g'), '(?s)<[^>]*>', '', 'g')"
)


@query("page_text", f"SELECT page_id, md5({_TEXT}) AS text_md5, CAST(len({_TEXT}) AS INTEGER) AS n_chars FROM pages")
def page_text(spark, d):
    text = ops.visible_text(F.col("html"))
    return views.table(spark, d, "pages").select("page_id", F.md5(text).alias("text_md5"), F.length(text).alias("n_chars"))


_STOP = ", ".join(f"'{w}'" for w in ops.STOP_WORDS)


@query(
    "page_keywords",
    f"""WITH w AS (SELECT page_id, regexp_replace(unnest(string_split_regex(lower({_TEXT}), '\\s+')), '[^\\p{{L}}\\p{{N}}_\\s]', '', 'g') AS word FROM pages),
        c AS (SELECT page_id, word, count(*) AS n FROM w WHERE len(word) > 3 AND word NOT IN ({_STOP}) GROUP BY ALL),
        r AS (SELECT *, row_number() OVER (PARTITION BY page_id ORDER BY n DESC, word) AS r FROM c)
        SELECT page_id, string_agg(word, ' ' ORDER BY r) AS keywords FROM r WHERE r <= 20 GROUP BY page_id""",
)
def page_keywords(spark, d):
    pages = views.table(spark, d, "pages").select("page_id", ops.visible_text(F.col("html")).alias("t"))
    return ops.keywords(pages, "page_id", "t").withColumn("keywords", F.array_join("keywords", " "))


# The pages hold no contact data, so every page gets a footer made of its own key: role and
# personal mailboxes, numbers in several spellings, links and an address.
def with_footer(spark, d):
    k = F.col("page_id").cast("string")
    n = F.lpad((F.col("page_id") % 10000000).cast("string"), 7, "0")
    footer = F.concat(
        F.lit('<footer><p>Write to INFO@firm'), k, F.lit('.example.com or ada@firm'), k, F.lit('.example.com</p>'),
        F.lit('<a href="mailto:sales@firm'), k, F.lit('.example.com">mail</a>'),
        F.lit('<p>(0212) '), F.left(n, F.lit(3)), F.lit(" "), F.substring(n, 4, 2), F.lit(" "), F.substring(n, 6, 2), F.lit('</p>'),
        F.lit('<a href="tel:+90 532 '), F.left(n, F.lit(3)), F.lit(" "), F.substring(n, 4, 4), F.lit('">call</a>'),
        F.lit('<a href="https://www.linkedin.com/company/old'), k, F.lit('">in</a>'),
        F.lit('<a href="https://www.linkedin.com/company/firm'), k, F.lit('">in</a>'),
        F.lit('<a href="https://x.com/firm'), k, F.lit('">x</a>'),
        F.lit('<div>Adres: Cumhuriyet <b>Cad.</b> No '), k, F.lit(' Ankara</div></footer>'),
    )
    return views.table(spark, d, "pages").withColumn("html", F.concat("html", footer))


_FOUND = " , ".join(f"regexp_extract_all(t, '{pattern}')" for pattern in ops.PHONES)
_BARE = "regexp_replace(p, '[\\s()-]', '', 'g')"


@query(
    "page_contacts",
    f"""WITH n AS (SELECT page_id, lpad(CAST(page_id % 10000000 AS VARCHAR), 7, '0') AS n, {_TEXT} AS t FROM pages),
        f AS (SELECT *, list_transform(list_concat({_FOUND}), lambda p: CASE WHEN {_BARE} LIKE '+%' THEN {_BARE}
          ELSE '+90' || ltrim({_BARE}, '0') END) AS found FROM n)
        SELECT page_id, 'info@firm' || page_id || '.example.com,sales@firm' || page_id || '.example.com' AS emails,
          array_to_string(list_sort(list_distinct(list_concat(found, ['+90212' || n, '+90532' || n]))), ',') AS phones,
          'Adres: Cumhuriyet Cad. No ' || page_id || ' Ankara' AS address FROM f""",
)
def page_contacts(spark, d):
    pages = with_footer(spark, d)
    text, hrefs = ops.visible_text(F.col("html")), ops.links(F.col("html"))
    return pages.withColumns({"_t": text, "_l": hrefs}).select(
        "page_id",
        F.array_join(ops.emails(F.col("_t"), F.col("_l")), ",").alias("emails"),
        F.array_join(ops.phones(F.col("_t"), F.col("_l")), ",").alias("phones"),
        ops.address(F.col("html")).alias("address"),
    )


@query(
    "page_social",
    """SELECT page_id, 'https://www.linkedin.com/company/firm' || page_id AS linkedin, 'https://x.com/firm' || page_id AS twitter,
         CAST(2 AS INTEGER) AS platforms FROM pages""",
)
def page_social(spark, d):
    pages = with_footer(spark, d).select("page_id", ops.social_links(ops.links(F.col("html"))).alias("s"))
    return pages.select("page_id", F.col("s")["linkedin"].alias("linkedin"), F.col("s")["twitter"].alias("twitter"), F.size("s").alias("platforms"))


@query(
    "page_security",
    "SELECT page_id, page_id % 2 = 0 AS ssl_enabled FROM pages",
)
def page_security(spark, d):
    headers = F.when(
        F.col("page_id") % 2 == 0, F.create_map(F.lit("strict-transport-security"), F.lit("max-age=1"))
    ).otherwise(F.create_map(F.lit("server"), F.lit("x")))
    return views.table(spark, d, "pages").select(
        "page_id", F.coalesce(ops.ssl_enabled(headers), F.lit(False)).alias("ssl_enabled")
    )


def _site_pages(spark, d):
    """Each page as the main page of a site of its own, with a contact page and an about page beside it.

    All are parsed from their HTML; the contact page is the page with its footer.
    """
    bare = views.table(spark, d, "pages").select("page_id", F.col("html").alias("main"))
    full = with_footer(spark, d).select("page_id", F.col("html").alias("contact"))
    site = F.concat(F.lit("https://www.s"), F.col("page_id"), F.lit(".example.com"))
    about = F.concat(
        F.lit("<html><head><title>About</title></head><body><p>Write to info@about"), F.col("page_id"), F.lit(".example.com</p></body></html>")
    )
    answered = F.when(F.col("page_id") % 2 == 0, 200).otherwise(404)

    def page(path: str, html, status) -> F.Column:
        return F.struct(F.concat(site, F.lit(path)).alias("url"), html.alias("html"), status.cast("int").alias("status_code"))

    three = F.array(page("/", F.col("main"), F.lit(200)), page("/contact", F.col("contact"), answered), page("/about", about, F.lit(200)))
    return ops.parse_pages(bare.join(full, "page_id").select(F.inline(three)))


@query(
    "page_contact_merge",
    f"""WITH t AS (SELECT page_id, {_TITLE} AS title FROM pages)
        SELECT 'https://www.s' || page_id || '.example.com/' AS url, CASE WHEN page_id % 2 = 0 THEN title ELSE 'About' END AS title,
          CASE WHEN page_id % 2 = 0 THEN 'Adres: Cumhuriyet Cad. No ' || page_id || ' Ankara' END AS address,
          CASE WHEN page_id % 2 = 0 THEN 'info@firm' || page_id || '.example.com,sales@firm' || page_id || '.example.com'
            ELSE 'info@about' || page_id || '.example.com' END AS emails FROM t""",
)
def page_contact_merge(spark, d):
    merged = ops.with_contact_page(_site_pages(spark, d))
    return merged.select("url", "title", "address", F.array_join("emails", ",").alias("emails"))
