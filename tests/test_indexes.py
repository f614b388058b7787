"""Stored indexes and increments against the plain ways, and their plans."""

import random

import pytest
from pyspark.sql import functions as F

from firmaforge.operators import facets, pages, search
from firmaforge.sources import sinks


def plan(df):
    return df._jdf.queryExecution().explainString(df._sc._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))


def distance(a, b):
    """Edits, a swap of neighbours counting as one."""
    rows = [list(range(len(b) + 1))]
    for i in range(1, len(a) + 1):
        rows.append([i])
        for j in range(1, len(b) + 1):
            best = min(rows[i - 1][j] + 1, rows[i][j - 1] + 1, rows[i - 1][j - 1] + (a[i - 1] != b[j - 1]))
            if i > 1 and j > 1 and a[i - 1] == b[j - 2] and a[i - 2] == b[j - 1]:
                best = min(best, rows[i - 2][j - 2] + 1)
            rows[i].append(best)
    return rows[-1][-1]


@pytest.fixture(scope="module")
def words():
    rng = random.Random(1)
    made = {"".join(rng.choices("abc", k=rng.randrange(1, 13))) for _ in range(900)}
    return sorted(made | {"x" * 40, "abcabcabcabcabcabc", "abcabcabcabcabcacb"})


def test_deletions_find_every_near_term(spark, words):
    df = spark.createDataFrame([(i, w) for i, w in enumerate(words)], "id long, name string")
    index = search.build_index(df, "id", ["name"])
    asked = ["a", "ab", "abc", "bacab", "abcabc", "cabbac", "abcabcabcabcabcabc", "aabbccaabb", "zzz"]
    near = search.matching_terms(index, asked, ["name"], True)
    assert "levenshtein" not in plan(index.deletions.filter(F.col("left").isin(["ab"])))
    assert "In(left" in plan(near) and "vocabulary" not in plan(near)
    got = {(r.wanted, r.term, r.edits) for r in near.collect()}
    want = {(a, w, distance(a, w)) for a in asked for w in words if distance(a, w) <= search.allowed_edits(a)}
    assert got == want and len(want) > 100


@pytest.mark.parametrize("prefix", ["ab", "abc", "bca", "cabca", "aabbcc", "İstanbul"])
@pytest.mark.parametrize("fuzzy", [True, False])
def test_prefixes_like_a_scan(spark, words, prefix, fuzzy):
    rows = [(w, words[-i], f"c{i % 3}") for i, w in enumerate(words)] + [("Istanbul Gıda", None, "c"), ("istanbu", "", "d")]
    df = spark.createDataFrame(rows, "legal_name string, trade_name string, city string")
    shown = ("legal_name", "trade_name", "city")
    index = search.build_prefix_index(df, ("legal_name", "trade_name"), shown)
    found = search.autocomplete_indexed(index, prefix, 50, fuzzy)
    scanned = search.autocomplete(df, prefix, 50, ("legal_name", "trade_name"), shown, fuzzy)
    assert [tuple(r) for r in found.collect()] == [tuple(r) for r in scanned.collect()]
    if not fuzzy:
        assert "EqualTo(prefix" in plan(found)


def test_keywords_without_a_shuffle(spark):
    rows = [(1, "alpha beta alpha gamma beta alpha zeta"), (2, ""), (3, None), (3, "Word word WORD tiny")]
    df = spark.createDataFrame(rows, "id int, text string")
    found = pages.keywords(df, "id", "text", 3)
    assert "Exchange" not in plan(found)
    assert sorted(map(tuple, found.collect())) == [(1, ["alpha", "beta", "gamma"]), (3, ["word", "tiny"])]


def test_sketches_of_two_loads(spark):
    df = spark.range(20_000).select((F.col("id") % 5000).alias("user"), (F.col("id") % 7).alias("day"))
    stored = facets.distinct_sketches(df.filter("day < 4"), ["day"], "user").unionByName(
        facets.distinct_sketches(df.filter("day >= 3"), ["day"], "user")
    )
    row = facets.distinct_of_sketches(stored, []).first()
    assert abs(row.distinct_count - 5000) < 0.082 * 5000


def test_history_of_two_loads(spark, tmp_path):
    rng = random.Random(6)
    rows = sorted({(rng.randrange(12) or None, rng.randrange(1000)) for _ in range(200)}, key=lambda r: r[1])
    df = lambda part: spark.createDataFrame(part, "k int, t int").select("k", F.timestamp_seconds("t").alias("t"))
    path = str(tmp_path / "history")
    cut = next(i for i, r in enumerate(rows) if r[1] >= 500)
    sinks.append_history(spark, path, df(rows[:cut]), 1, "k", "t")
    closed = {str(f) for f in (tmp_path / "history").glob("is_current=false/**/*.parquet")}
    sinks.append_history(spark, path, df(rows[cut:]), 2, "k", "t")
    assert closed <= {str(f) for f in (tmp_path / "history").rglob("*.parquet")}
    names = ["k", "t", "valid_from", "valid_to", "is_current"]
    got = sorted(map(str, sinks.read_history(spark, path).select(*names).collect()))
    assert got == sorted(map(str, sinks.history(df(rows), "k", "t").select(*names).collect()))
    with pytest.raises(ValueError):
        sinks.append_history(spark, path, df(rows[cut:]), 3, "k", "t")


def test_many_near_terms_do_not_sort_the_postings(spark, monkeypatch):
    """More near terms than fit literals are sent to the postings; these stay where they are."""
    rows = [(f"{i:03d}", f"nation {i:04d} {i % 7}") for i in range(300)] + [("000", "nation 0000 0")]
    df = spark.createDataFrame(rows, "id string, name string")
    index = search.build_index(df, "id", ["name"])
    few = sorted(tuple(r)[:4] for r in search.field_scores(index, ["0004", "nation"], {"name": 1.0}, True).collect())
    monkeypatch.setattr(search, "LITERAL_TERMS", 1)
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        scores = search.field_scores(index, ["0004", "nation"], {"name": 1.0}, True)
        assert "SortMergeJoin" not in plan(scores)
        assert sorted(tuple(r)[:4] for r in scores.collect()) == few and len(few) > 300
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    # A repeated record counts its words together, as before.
    assert index.postings.filter("id = '000' and term = 'nation'").select("tf").collect()[0].tf == 2
