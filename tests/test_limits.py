"""Rows that are large, deep, null or repeated, where a plan must neither fail nor lose any."""

import datetime as dt

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from firmaforge import session
from firmaforge.functions import privacy
from firmaforge.operators import compliance, facets, near_equal, pages, quality, resolve, search
from firmaforge.sources import sinks


def addresses(spark, htmls):
    df = spark.createDataFrame(list(enumerate(htmls)), "i int, html string")
    return [r.a for r in df.select("i", pages.address(F.col("html")).alias("a")).orderBy("i").collect()]


def test_address_of_a_page_of_very_many_tags(spark):
    own = "Our address: Long Street 12, Ankara"
    many = f"<html><body><p>{own}</p>" + "<br>" * 100_000 + "</body></html>"
    around = f"<div>{own}" + "<br><i>x</i>" * 50_000 + "</div>"
    assert addresses(spark, [many, around]) == [own, None]


def test_address_ends_with_its_element(spark):
    nested = "<div>Address of the firm: <b>Long Street</b> 12<div>Ankara</div></div><p>other</p>"
    upper = "<DIV class='a'>The ADDRESS is Long Street 12</DIV> tail"
    open_ = "<td>The address is Long Street 12"
    longer = "<p>The address is <pre>Long Street</pre> 12</p>"
    got = addresses(spark, [nested, upper, open_, longer, None, ""])
    assert got[0].startswith("Address of the firm:") and "other" not in got[0]
    assert got[1] == "The ADDRESS is Long Street 12"
    assert got[2] is None and got[3].endswith("12") and got[4:] == [None, None]


def test_history_keeps_rows_without_key_or_time(spark):
    day = lambda n: dt.datetime(2024, 1 + n, 3)
    rows = [("a", day(0), 1), ("a", day(1), 2), ("a", None, 3), (None, day(2), 4), (None, day(2), 5), ("b", None, 6), ("b", None, 7)]
    df = spark.createDataFrame(rows, "k string, t timestamp, n int")
    got = {r.n: (r.valid_from, r.valid_to, r.is_current) for r in sinks.history(df, "k", "t", ties=("n",)).collect()}
    assert got == {
        1: (day(0), day(1), False), 2: (day(1), None, True), 3: (None, day(0), False), 4: (day(2), day(2), False),
        5: (day(2), None, True), 6: (None, None, False), 7: (None, None, True),
    }


def test_rules_match_anywhere(spark):
    df = spark.createDataFrame([("Acme 12345678901",), ("12345678901",), ("Acme",)], "legal_name string")
    got = quality.run_rules(df, [quality.not_matches("legal_name", r"\d{11}")]).first()
    assert (got.evaluated, got.passed) == (3, 1)


def test_running_mean_forgets_nothing(spark):
    rows = [("g", i, 1.0 if i == 0 else 0.0) for i in range(80)]
    got = resolve.running_mean(spark.createDataFrame(rows, "g string, i int, v double"), "g", "i", "v").first()
    assert got.v == 2.0**-79


def test_bag_of_a_long_text(spark):
    text = "ab" * 5000
    got = spark.createDataFrame([(text,)], "t string").select(F.size(F.array_distinct(resolve._bag(F.col("t"))))).first()[0]
    assert got == 10_000


def test_keys_of_long_texts_are_few(spark):
    rows = [("n" * 50, "abcdefghij" * 200), ("name" * 75, "some address " * 154), ("x", "y"), ("", "")]
    df = spark.createDataFrame(rows, "n string, a string")
    got = [r.k for r in df.select(F.size(near_equal.near_equal_keys(F.col("n"), F.col("a"))).alias("k")).collect()]
    assert max(got) < 1000 and got[2:] == [1, 1]


def test_suppression_list_with_repeats(spark):
    df = spark.createDataFrame([("1", "x"), ("2", "y")], "id string, t string")
    listed = compliance.suppression_list(df.limit(1), "id")
    got = compliance.compliance_report(df, listed.union(listed).union(listed)).first()
    assert (got.total_records, got.suppressed_records) == (2, 1)


def test_personal_data_anywhere_in_a_record(spark):
    item = T.StructType().add("notes", T.ArrayType(T.ArrayType(T.StringType()))).add("m", T.MapType(T.StringType(), T.StringType()))
    schema = T.StructType().add("id", T.StringType()).add("r", item)
    rows = [("1", ([["a"], ["id 12345678901"]], {})), ("2", ([], {"k": "12345678901"})), ("3", (None, None)), ("4", None)]
    df = spark.createDataFrame(rows, schema)
    assert [r[0] for r in df.select(privacy.record_has_pii(df)).collect()] == [True, True, False, False]
    clean = privacy.filter_pii(df).collect()
    assert clean[0].r.notes == [["a"], []]


def test_dashboard_needs_its_columns(spark):
    with pytest.raises(ValueError):
        facets.dashboard_rows(spark.createDataFrame([("1",)], "company_id string"))


def test_marks_in_lists(spark):
    df = spark.createDataFrame([("1", ["Çay", "kahve"], ["cay"])], "id string, keywords array<string>, terms array<string>")
    got = df.select(search.marked_field(df, "keywords", F.col("terms")).alias("m")).first().m
    assert got == ["<em>Çay</em>", "kahve"]


def test_cut_tables_can_be_deleted(spark):
    df = session.cut(spark.range(5))
    assert df.count() == 5
    session.discard(df)
    with pytest.raises(Exception, match="(?i)exist"):
        spark.read.parquet(df.inputFiles()[0]).count()


def test_exports_are_ordered(spark):
    df = spark.range(1000, numPartitions=8).orderBy(F.desc("id"))
    assert [r.id for r in sinks.export_rows(df, limit=3).collect()] == [0, 1, 2]


def test_keyed_table_rewrites_touched_partitions_only(spark, tmp_path):
    from firmaforge.streaming.bronze import KeyedTable

    schema = "k int, t int, v string"
    table = KeyedTable(spark, str(tmp_path / "t"), schema, ["k"], buckets=4)
    files = lambda: {str(f) for f in (tmp_path / "t").rglob("*.parquet")}
    assert table.read().collect() == []
    batches = [[(i, 0, "a") for i in range(20)], [(1, 1, "b"), (2, -1, "late")], [(1, 2, "c"), (30, 0, "new")], []]
    for rows in batches:
        for _ in range(2):  # a repeated batch changes nothing
            table.merge(spark.createDataFrame(rows, schema), ["t"])
    got = {r.k: r.v for r in table.read().collect()}
    assert got == {i: "a" for i in range(20)} | {1: "c", 30: "new"}
    before = files()
    table.merge(spark.createDataFrame([(1, 3, "d")], schema), ["t"])
    gone = before - files()
    assert len({f.rsplit("/", 2)[1] for f in gone}) == 1  # one partition; the others keep their files
    assert {r.k: r.v for r in table.read().collect()} == got | {1: "d"}
