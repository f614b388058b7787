from pyspark.sql import functions as F

from firmaforge.operators import facets, filters, pages, search
from firmaforge.operators.ranking import page


def firms(spark):
    rows = [
        ("1", "Acme Tekno", None, "Ankara", ["otel"], "T"),
        ("2", "Acme Gıda", "Lezzet", "İzmir", ["gıda"], "F"),
        ("3", "Beta Turizm", None, "Ankara", [], "T"),
        ("4", "Ab Ltd", None, "Bursa", None, "O"),
    ]
    ddl = "company_id string, legal_name string, trade_name string, city string, keywords array<string>, industry string"
    return spark.createDataFrame(rows, ddl).withColumns({"address": F.lit(None).cast("string"), "company_type": F.lit("x"), "last_updated": F.current_timestamp()})


def ids(df):
    return sorted(r.company_id for r in df.collect())


def test_fuzzy_limits(spark):
    df = firms(spark)
    assert ids(search.search(df, "Amce")) == ["1", "2"]  # neighbours swapped
    assert ids(search.search(df, "Acmee")) == ["1", "2"]
    assert ids(search.search(df, "aq")) == []  # two letters allow no edit
    assert ids(search.search(df, "tirzim")) == ["3"]  # two edits in six letters
    assert ids(search.search(df, "acme", fuzzy=False)) == ["1", "2"]


def test_all_terms_across_fields(spark):
    df = firms(spark)
    assert ids(search.advanced_search(df, "acme izmir")) == ["2"]
    assert ids(search.advanced_search(df, "acme bursa")) == []
    assert ids(search.advanced_search(df, None, {"city": "Ankara"})) == ["1", "3"]


def test_highlight_and_boost(spark):
    hits = search.basic_search(firms(spark), "gida").collect()
    assert hits[0].company_id == "2" and hits[0].legal_name_marked == "Acme <em>Gıda</em>"


def test_autocomplete(spark):
    names = [r.legal_name for r in search.autocomplete(firms(spark), "ACM").collect()]
    assert names[:2] == ["Acme Gıda", "Acme Tekno"]


def test_paging_and_facets(spark):
    df = firms(spark)
    seen = [r.company_id for n in (1, 2) for r in page(df, [F.asc("city"), F.asc("company_id")], n, 2).collect()]
    assert sorted(seen) == ["1", "2", "3", "4"]
    got = facets.facets(df, {"city": 1, "industry": 2}).collect()
    assert sorted((r.facet, r.value, r["count"]) for r in got) == [("city", "Ankara", 2), ("industry", "F", 1), ("industry", "T", 2)]


def test_empty_arrays_do_not_exist(spark):
    df = firms(spark)
    assert ids(df.filter(filters.missing(df, "keywords"))) == ["3", "4"]


def test_radius(spark):
    rows = [("in", 0.0, 0.0898), ("out", 0.0, 0.0901), ("north", 0.0898, 0.0)]
    df = spark.createDataFrame(rows, "id string, lat double, lon double")
    assert sorted(r.id for r in filters.within_distance(df, 0.0, 0.0, 10.0).collect()) == ["in", "north"]


PAGE = """<html><head><title> Acme | Home &amp; More </title><meta content="We sell" name="description">
<script>var x="info@script.example";</script></head><body><h1>One <b>x</b></h1><h1>Two</h1><h1>Three</h1><h1>Four</h1>
<p>Mail INFO@acme.example or ada@acme.example, tel 0 (212) 345 67 89 or 0532 111 22 33</p>
<a href="mailto:sales@acme.example">m</a><a href='tel:+90 312 1112233'>t</a>
<a href="https://facebook.com/old">f</a><a href="https://facebook.com/new">f</a>
<p>%s</p></body></html>"""


def parse(spark, html):
    df = spark.createDataFrame([("https://acme.example", html)], "url string, html string")
    return pages.parse_pages(df).first()


def test_page(spark):
    got = parse(spark, PAGE % "Adres: Ata Cad. No 5 Ankara")
    assert got.title == "Acme | Home & More" and got.company_name == "Acme" and got.meta_description == "We sell"
    assert got.h1_keywords == ["One x", "Two", "Three"]
    assert got.emails == ["info@acme.example", "sales@acme.example"]
    assert got.phones == ["+902123456789", "+903121112233", "+905321112233"]
    assert got.social_links == {"facebook": "https://facebook.com/new"}
    assert got.address == "Adres: Ata Cad. No 5 Ankara"
    assert "sell" not in got.keywords and "mail" in got.keywords


def test_names_and_address_lengths(spark, apply):
    html = ["<meta property='og:title' content='Og'><title>T</title>", "<title>A - B</title>", "<title>Plain</title>", "<p>x</p>"]
    assert apply(pages.company_name, html) == ["Og", "A", "Plain", None]
    texts = [f"<p>{'adres '.ljust(n, 'x')}</p>" for n in (20, 21, 499, 500)]
    assert [a is not None for a in apply(pages.address, texts)] == [False, True, True, False]


def test_security_header(spark):
    df = spark.createDataFrame([({"strict-transport-security": "max-age=1"},), ({"a": "b"},)], "h map<string,string>")
    assert [r[0] for r in df.select(pages.ssl_enabled(F.col("h"))).collect()] == [True, None]
