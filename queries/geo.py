"""Places around points, by grid cells; the twins compare all pairs."""

from __future__ import annotations

from pyspark.sql import functions as F

from firmaforge.operators import geo
from firmaforge.plans import views
from queries.registry import query

_KM = 500.0


def _placed(spark, d, name: str, key: str, lat_step: int, lon_step: int):
    """Rows of a table all over the globe, poles and date line included."""
    k = F.col(key)
    return views.table(spark, d, name).select(
        key, (k * lat_step % 1801 / 10.0 - 90).alias("lat"), (k * lon_step % 3601 / 10.0 - 180).alias("lon")
    )


_PAIRS = f"""WITH a AS (SELECT c_custkey, (c_custkey * 37 % 1801) / 10.0 - 90 AS lat, (c_custkey * 911 % 3601) / 10.0 - 180 AS lon FROM customer),
  b AS (SELECT s_suppkey, (s_suppkey * 613 % 1801) / 10.0 - 90 AS lat, (s_suppkey * 1789 % 3601) / 10.0 - 180 AS lon FROM supplier),
  d AS (SELECT c_custkey, s_suppkey, 2 * 6371.0088 * asin(sqrt(least(1.0, pow(sin(radians(a.lat - b.lat) / 2), 2)
    + cos(radians(a.lat)) * cos(radians(b.lat)) * pow(sin(radians(a.lon - b.lon) / 2), 2)))) AS km FROM a, b),
  pairs AS (SELECT * FROM d WHERE km <= {_KM})"""


def _sides(spark, d):
    return _placed(spark, d, "customer", "c_custkey", 37, 911), _placed(spark, d, "supplier", "s_suppkey", 613, 1789)


@query("geo_radius_pairs", f"{_PAIRS} SELECT c_custkey, s_suppkey, round(km, 3) AS km FROM pairs")
def geo_radius_pairs(spark, d):
    pairs = geo.radius_join(*_sides(spark, d), _KM)
    return pairs.select("place.c_custkey", "point.s_suppkey", F.round("distance_km", 3).alias("km"))


@query(
    "geo_radius_counts",
    f"""{_PAIRS} SELECT b.s_suppkey, count(c_custkey) AS n_places, round(min(km), 3) AS nearest_km
        FROM b LEFT JOIN pairs USING (s_suppkey) GROUP BY 1""",
)
def geo_radius_counts(spark, d):
    counted = geo.counted_within(*_sides(spark, d), _KM, "s_suppkey")
    return counted.select("s_suppkey", "n_places", F.round("nearest_km", 3).alias("nearest_km"))
