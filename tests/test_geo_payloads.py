"""Grid cells against all pairs, payloads of odd shapes, and layers checked while they are written."""

import math
import random

import pytest
from pyspark.sql import functions as F

from firmaforge.operators import geo
from firmaforge.operators import quality as q
from firmaforge.sources import payloads


def km(a, b):
    half = lambda x, y: math.sin(math.radians(x - y) / 2) ** 2
    chord = half(a[0], b[0]) + math.cos(math.radians(a[0])) * math.cos(math.radians(b[0])) * half(a[1], b[1])
    return 2 * 6371.0088 * math.asin(math.sqrt(min(chord, 1.0)))


EDGES = [(90.0, 10.0), (-90.0, 0.0), (89.9, -179.9), (0.0, 180.0), (0.0, -180.0), (51.0, 179.99), (51.0, -179.99), (0.0, 0.0)]


@pytest.mark.parametrize("reach", [3.0, 80.0, 1500.0, 12000.0, 21000.0])
def test_cells_lose_no_pair(spark, reach):
    rng = random.Random(7)
    near = [(40 + rng.gauss(0, 0.3), 29 + rng.gauss(0, 0.3)) for _ in range(60)]
    wide = [(rng.uniform(-90, 90), rng.uniform(-180, 180)) for _ in range(60)]
    places = [(i, *p) for i, p in enumerate(EDGES + near + wide)]
    points = [(i, *p) for i, p in enumerate(EDGES + near[::3] + wide[::2])]
    bad = [(900, None, 1.0), (901, 91.0, 0.0), (902, float("nan"), 0.0), (903, 0.0, 181.0)]
    ddl = "id int, lat double, lon double"
    out = geo.radius_join(spark.createDataFrame(places + bad, ddl), spark.createDataFrame(points + bad, ddl), reach)
    got = sorted((r[0], r[1]) for r in out.select("place.id", F.col("point.id").alias("o")).collect())
    want = sorted((i, j) for i, *a in places for j, *b in points if km(a, b) <= reach)
    assert got == want and len(set(got)) == len(got)


def test_radius_join_is_keyed(spark):
    df = spark.createDataFrame([(1, 40.0, 29.0)], "id int, lat double, lon double")
    plan = geo.radius_join(df, df, 5.0)._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "NestedLoop" not in plan
    sizes = df.select(F.size(geo.cells_around(F.col("lat"), F.col("lon"), 5.0)).alias("n")).first()["n"]
    assert 1 <= sizes <= 12
    empty = geo.counted_within(df.limit(0), df, 5.0, "id").collect()
    assert [(r["id"], r["n_places"], r["nearest_km"]) for r in empty] == [(1, 0, None)]
    with pytest.raises(ValueError):
        geo.radius_join(df, df, 0.0)


def test_crowded_cells_are_compared_in_tiles(spark):
    """One cell of 600 places and 300 points: no partition holds all of it, and no pair is lost or doubled."""
    rng = random.Random(3)
    near = lambda n: [(i, 40.5 + rng.random() / 10, 29.5 + rng.random() / 10) for i in range(n)]
    places, points = near(600), near(300) + [(300, 40.5, 29.5)] * 2
    sides = [spark.createDataFrame(rows, "id int, lat double, lon double") for rows in (places, points)]
    out = geo.radius_join(*sides, 8.0, tile_rows=50).select("place.id", F.col("point.id").alias("o"), F.spark_partition_id().alias("p"))
    rows = out.collect()
    want = sorted((i, j) for i, *a in places for j, *b in points if km(a, b) <= 8.0)
    assert sorted((r[0], r[1]) for r in rows) == want
    assert len({r["p"] for r in rows}) > 2


def test_payloads_of_odd_shapes(spark):
    texts = ['{"a":1,"b":{"c":[1,2]}}', '{"a":"x","new":null}', "[1,2]", "7", "{}", "", "{broken", None]
    raw = spark.createDataFrame(list(enumerate(texts)), "id int, payload string")
    kept = payloads.bronze_payload(raw, "payload").select("id", "payload", "is_broken")
    assert [r["id"] for r in kept.orderBy("id").collect() if r["is_broken"]] == [5, 6]
    layout = {"a": ("$.a", "int"), "c": ("$.b.c[1]", "int")}
    found = [(r["a"], r["c"]) for r in payloads.fields(kept, layout).orderBy("id").collect()]
    assert found == [(1, 2)] + [(None, None)] * 7
    rows = payloads.unknown_entries(kept, ["a"], ["id"]).orderBy("id", "key").collect()
    assert [(r["id"], r["key"], str(r["value"])) for r in rows] == [(0, "b", '{"c":[1,2]}'), (1, "new", "null")]
    assert payloads.entries(kept.limit(0), ["id"]).count() == 0


def test_payloads_are_stored_and_read_back(spark, tmp_path):
    raw = spark.createDataFrame([(1, '{"a":1,"z":{"y":2}}')], "id int, data string")
    payloads.bronze_payload(raw, "data").write.parquet(str(tmp_path / "bronze"))
    back = spark.read.parquet(str(tmp_path / "bronze"))
    assert back.select(payloads.field("payload", "$.z.y", "int").alias("y")).first()["y"] == 2


def test_layers_are_checked_while_written(spark, tmp_path):
    df = spark.range(10).select(F.col("id"), F.when(F.col("id") < 9, F.lit("n")).alias("name"))
    rules = [q.not_null("name", 0.95), q.unique("id"), q.exists("gone")]
    for run, rows in (("r1", df), ("r2", df.filter("id < 9")), ("r1", df)):
        got = q.write_checked(rows, rules, str(tmp_path / run), str(tmp_path / "runs"), run)
        want = q.run_rules(rows, rules)
        key = lambda r: (r["rule"], r["column"])
        assert [r.asDict() for r in sorted(got.drop("run").collect(), key=key)] == [
            r.asDict() for r in sorted(want.collect(), key=key)
        ]
    runs = q.stored_runs(spark, str(tmp_path / "runs"))
    assert runs.count() == 6
    assert q.report(runs).first()["total_validations"] == 2
    change = q.trend(runs).filter("rule = 'not_null' and run = 'r2'").first()["change"]
    assert abs(change - 0.1) < 1e-9
    empty = q.write_checked(df.limit(0), rules[:1], str(tmp_path / "e"), str(tmp_path / "runs"), "r3")
    assert [(r["evaluated"], r["success"]) for r in empty.collect()] == [(0, True)]
