import datetime as dt

from pyspark.sql import functions as F

from firmaforge.operators import quality as q
from firmaforge.plans import gold, silver
from firmaforge.sources import raw, sinks


def test_bad_numbers_do_not_stop_a_load(spark):
    rows = [
        ("p1", '{"name":"A","rating":"4.5","user_ratings_total":7,"types":["x"]}'),
        ("p2", '{"name":"B","rating":"10.5","user_ratings_total":"many"}'),
        ("p3", "{}"),
    ]
    df = spark.createDataFrame(rows, "place_id string, data string").selectExpr(
        "*", "'google_places' AS source_type", "now() AS fetch_ts", "'1' AS parser_version", "now() AS created_at"
    )
    got = {r.place_id: (r.business_name, r.rating and float(r.rating), r.reviews_count) for r in raw.bronze_places(df).collect()}
    assert got == {"p1": ("A", 4.5, 7), "p2": ("B", None, None), "p3": (None, None, None)}


def test_incremental_load(spark):
    day = lambda n: dt.datetime(2024, 1, n)
    ddl = "k string, created_at timestamp, v int"
    loaded = spark.createDataFrame([("a", day(1), 1), ("b", day(2), 1)], ddl)
    incoming = spark.createDataFrame([("a", day(3), 2), ("a", day(4), 3), ("c", day(2), 9), ("d", day(5), 1)], ddl)
    got = {r.k: r.v for r in raw.incremental_load(incoming, loaded, ["k"]).collect()}
    assert got == {"a": 3, "b": 1, "d": 1}  # c arrived at the mark itself
    late = raw.incremental_load(incoming, loaded, ["k"], overlap="1 DAY")
    assert {r.k for r in late.collect()} == {"a", "b", "c", "d"}
    empty = spark.createDataFrame([], ddl)
    assert raw.incremental_load(incoming, empty, ["k"]).count() == 3


def test_unify_merges_sources(spark):
    ddl = ", ".join(f"{n} {t}" for n, t in silver.UNION_COLUMNS.items())
    at = dt.datetime(2024, 1, 1)
    rows = [
        (" acme ", "ankara", None, "l", None, None, None, None, None, None, None, None, "google_search", at),
        ("ACME", "Ankara ", None, None, "https://www.b.example/x", ["1"], "A", 4.0, 3, None, None, None, "google_places", at),
        ("Acme", "ANKARA", None, None, "http://a.example", ["2", "1"], "B", 4.5, 4, ["i@a"], '{"x":"1"}', ["k2", "k1"], "website", at),
        (None, "Ankara", None, None, None, None, None, None, None, None, None, None, "website", at),
    ]
    got = silver.unify(spark.createDataFrame(rows, ddl)).collect()
    assert len(got) == 1
    one = got[0]
    assert (one.legal_name, one.city, one.rating, one.total_reviews) == ("ACME", "Ankara", 4.3, 7)
    assert one.websites == "http://a.example, https://www.b.example/x" and one.website_domain == "a.example"
    assert one.phone_list == ["1", "2"] and one.keywords == ["k1", "k2"] and one.emails == ["i@a"]
    assert one.social_links == [{"x": "1"}] and len(one.data_sources) == 3 and one.address == "B"


def test_gold_boundaries(spark):
    rows = [(None, 9), (None, 10), (None, 100), (None, 1000), (None, 1001), (None, None), ("Limited Şirket", 9),
            ("Şahıs Şirketi", 5), ("Anonim Şirket", None)]
    df = spark.createDataFrame(rows, "t string, n bigint")
    sizes = [r[0] for r in df.select(gold.company_size(F.col("t"), F.col("n"))).collect()]
    assert sizes == ["Unknown", "Small", "Medium", "Medium", "Large", "Unknown", "Small", "Micro", "Large"]
    rows = [(4.5, 51), (4.5, 50), (4.0, 21), (4.0, 20), (3.5, 0), (3.4, 99), (None, 99)]
    df = spark.createDataFrame(rows, "r double, n bigint")
    levels = [r[0] for r in df.select(gold.engagement_level(F.col("r"), F.col("n"))).collect()]
    assert levels == ["High", "Medium", "Medium", "Low", "Low", "Very Low", "Very Low"]
    score = [r[0] for r in df.select(gold.engagement_score(F.col("r"), F.lit(99))).collect()]
    assert score[0] == 9.0 and score[-1] == 0.0
    tiers = [r[0] for r in spark.createDataFrame([(30.0,), (30.01,), (20.0,), (10.0,), (10.01,)], "p double").select(gold.city_tier(F.col("p"))).collect()]
    assert tiers == ["B", "A", "C", "D", "C"]


def test_industry_needs_all_words_or_any(spark):
    df = spark.createDataFrame([(["otel"],), (gold.INDUSTRIES["Tourism"],), (None,), ([],)], "k array<string>")
    assert [r[0] for r in df.select(gold.industry(F.col("k"))).collect()] == ["Other", "Tourism", "Other", "Other"]
    assert [r[0] for r in df.select(gold.industry(F.col("k"), "any")).collect()] == ["Tourism", "Tourism", "Other", "Other"]


def test_rules_at_the_limit(spark):
    df = spark.createDataFrame([("ab", 1), ("a", 1), (None, 2), ("abc", None)], "name string, n int")
    rules = [q.not_null("name", 0.75), q.not_null("name", 0.76), q.length_between("name", 2, 3, 0.6), q.unique("n"),
             q.exists("gone"), q.between("n", 5, 6), q.matches("name", "b"), q.not_matches("name", "b")]
    got = [(r.rule, r.evaluated, r.passed, r.success) for r in q.run_rules(df, rules).collect()]
    assert sorted(got) == sorted([
        ("not_null", 4, 3, True), ("not_null", 4, 3, False), ("length_between", 3, 2, True), ("unique", 3, 1, False),
        ("column_exists", 1, 0, False), ("between", 3, 0, False), ("matches_regex", 3, 2, False), ("not_matches_regex", 3, 1, False),
    ])
    nothing = q.run_rules(df.filter("false"), [q.in_set("n", [1])]).first()
    assert nothing.success and nothing.pass_share is None


def test_history_of_one_key_over_many_periods(spark):
    days = [dt.datetime(2024, 1, 1) + dt.timedelta(days=11 * i) for i in range(20)]
    df = spark.createDataFrame([("a", d) for d in days] + [("b", days[0])], "k string, at timestamp")
    got = sorted((r.k, r.valid_from, r.valid_to) for r in sinks.history(df, "k", "at").collect() if r.k == "a")
    assert [x[2] for x in got] == days[1:] + [None]


def test_bulk_update_applies_in_order(spark):
    docs = spark.createDataFrame([("1", "a", "x"), ("2", "b", "y")], "id string, f string, g string")
    ups = spark.createDataFrame([("1", "z", None, 1), ("1", "c", None, 2), ("3", "n", "m", 1)], "id string, f string, g string, o int")
    got = {r.id: (r.f, r.g) for r in sinks.bulk_update(docs, ups, order="o").collect()}
    assert got == {"1": ("c", "x"), "2": ("b", "y"), "3": ("n", "m")}


def test_export_formats(spark, tmp_path):
    import pytest

    df = spark.createDataFrame([("1", ["a"])], "id string, tags array<string>")
    sinks.export(df, str(tmp_path / "c"), "csv", fields=["id", "tags", "none"])
    assert spark.read.option("header", True).csv(str(tmp_path / "c")).first().tags == '["a"]'
    with pytest.raises(ValueError):
        sinks.export(df, str(tmp_path / "x"), "xlsx")
