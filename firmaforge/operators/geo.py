"""Pairs of places and points within a distance, by an equi-join on grid cells."""

from __future__ import annotations

from math import pi, sin

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from firmaforge.operators.filters import EARTH_KM

# Degrees by which reach and cells are wider than exact, so that rounding loses no pair.
SLACK = 1e-9


def _row(lat: Column, height: float) -> Column:
    """Number of the latitude band; the last one holds the pole."""
    last = int(180 // height)
    return F.least(F.floor((lat + 90) / height), F.lit(last)).cast("int")


def _reach_lon(lat: Column, reach: float) -> Column:
    """Half the longitudes in degrees that a circle of ``reach`` radians around ``lat`` covers; 180 over a pole."""
    over_pole = F.abs(F.radians(lat)) + reach >= pi / 2 - SLACK
    wide = F.degrees(F.asin(F.least(F.sin(F.lit(reach)) / F.cos(F.radians(lat)), F.lit(1.0))))
    return F.when(over_pole, 180.0).otherwise(F.least(wide + SLACK, F.lit(180.0)))


def _columns(row: Column, height: float, reach: float) -> Column:
    """How many cells a band has: each is as wide as the widest circle around a neighbouring band."""
    worst = F.least(F.greatest(F.abs((row - 1) * height - 90), F.abs((row + 2) * height - 90)), F.lit(90.0))
    return F.greatest(F.floor(360 / (2 * _reach_lon(worst, reach))), F.lit(1)).cast("int")


def _column(lon: Column, columns: Column) -> Column:
    """Cell of a longitude in its band, around the date line."""
    return F.pmod(F.floor((lon + 180) / 360 * columns), columns).cast("int")


def _height(km: float) -> tuple[float, float]:
    reach = km / EARTH_KM
    return reach, min(reach * 180 / pi + SLACK, 180.0)


def cell(lat: Column, lon: Column, km: float) -> Column:
    """Struct (band, column) of the one cell of a place, also a key to lay tables out by.

    Null where a coordinate is null, no number or out of range.
    """
    reach, height = _height(km)
    row = _row(lat, height)
    return F.when(_valid(lat, lon), F.struct(row.alias("band"), _column(lon, _columns(row, height, reach)).alias("column")))


def cells_around(lat: Column, lon: Column, km: float) -> Column:
    """The distinct cells that may hold a place within ``km``: three bands, in each the columns in reach.

    At most nine or so away from the poles; a circle over a pole takes every column of bands that have few.
    """
    reach, height = _height(km)
    last = int(180 // height)
    bands = F.filter(F.sequence(_row(lat, height) - 1, _row(lat, height) + 1), lambda r: r.between(0, last))
    half = _reach_lon(lat, reach)

    def of_band(r):
        n = _columns(r, height, reach)
        first = F.floor((lon - half + 180) / 360 * n)
        # No more than a full turn.
        end = F.least(F.floor((lon + half + 180) / 360 * n), first + n - 1)
        return F.transform(
            F.sequence(first, end), lambda c: F.struct(r.cast("int").alias("band"), F.pmod(c, n).cast("int").alias("column"))
        )

    return F.when(_valid(lat, lon), F.array_distinct(F.flatten(F.transform(bands, of_band))))


def _valid(lat: Column, lon: Column) -> Column:
    inside = lat.between(-90, 90) & lon.between(-180, 180)
    return F.coalesce(inside & ~F.isnan(lat) & ~F.isnan(lon), F.lit(False))


def km_between(lat: Column, lon: Column, to_lat: Column, to_lon: Column) -> Column:
    """Great-circle distance of two points given by columns."""
    half = lambda a, b: F.pow(F.sin(F.radians(a - b) / 2), 2)
    chord = half(lat, to_lat) + F.cos(F.radians(lat)) * F.cos(F.radians(to_lat)) * half(lon, to_lon)
    return 2 * EARTH_KM * F.asin(F.sqrt(F.least(chord, F.lit(1.0))))


# Places and points of a cell that one unit of comparing holds at most, roughly.
TILE_ROWS = 2000


def _chord(lat: Column, lon: Column) -> list[Column]:
    """A point of the unit sphere, so that near and far are told apart by products alone."""
    la, lo = F.radians(lat), F.radians(lon)
    return [F.cos(la) * F.cos(lo), F.cos(la) * F.sin(lo), F.sin(la)]


def _tiles(own: DataFrame, near: DataFrame, rows: int) -> tuple[DataFrame, DataFrame]:
    """Both sides with the tile (_i, _j) of their cell that they meet in.

    A cell of n places and m points has n / rows by m / rows tiles; a place goes to the tiles of its
    slice, a point to those of its own, and a pair meets in one of them.
    """
    sizes = [
        df.groupBy("cell").agg(F.ceil(F.count("*") / rows).cast("int").alias(f"_{name}"))
        for df, name in ((own, "place_slices"), (near, "point_slices"))
    ]
    # Cells with one tile need no entry, and those that lack a side have no pair.
    cut_up = sizes[0].join(sizes[1], "cell").filter("_place_slices > 1 or _point_slices > 1")

    def sliced(df: DataFrame, side: str, mine: str, other: str, at: str, across: str) -> DataFrame:
        known = df.join(cut_up, "cell", "left")
        slice_ = F.pmod(F.xxhash64(side, F.lit(at)), F.coalesce(mine, F.lit(1))).cast("int")
        copies = F.sequence(F.lit(0), F.coalesce(other, F.lit(1)) - 1)
        return known.select(*df.columns, slice_.alias(at), F.explode(copies).alias(across))

    left = sliced(own, "place_key", "_place_slices", "_point_slices", "_i", "_j")
    right = sliced(near, "point_key", "_point_slices", "_place_slices", "_j", "_i")
    # Few bytes mean many comparisons, so these partitions are counted out and not left to be
    # coalesced, or read from one file, by size.
    parts = int(own.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return tuple(df.repartition(parts, "cell", "_i", "_j") for df in (left, right))


def radius_join(
    places: DataFrame,
    points: DataFrame,
    km: float,
    place: tuple[str, str] = ("lat", "lon"),
    point: tuple[str, str] = ("lat", "lon"),
    tile_rows: int = TILE_ROWS,
) -> DataFrame:
    """All pairs within ``km``: columns ``place`` and ``point`` (structs of the rows) and distance_km.

    A place has one cell; a point goes to the few cells around it, so the smaller table should be
    ``points``. Two rows meet in one cell only, hence no pair comes twice. A cell with many rows is cut
    into tiles, which are compared apart from each other. Rows without coordinates pair with none;
    columns of one name on both sides don't clash.
    """
    if not km > 0:
        raise ValueError("km must be positive")
    at = lambda side, names: [F.col(f"{side}.`{n}`").cast("double") for n in names]
    rows = lambda df, side: df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias(side))

    def spread(side: str, df: DataFrame, names: tuple[str, str]) -> list[Column]:
        axes = [c.alias(f"{side}_{n}") for c, n in zip(_chord(*at(side, names)), "xyz")]
        # By its values, so that a repeated task deals it out alike; maps and variants have no hash.
        hashed = [F.col(f"{side}.`{n}`") for n, kind in df.dtypes if "map<" not in kind and "variant" not in kind]
        return [side, *axes, F.xxhash64(*hashed).alias(f"{side}_key")]

    own = rows(places, "place").select(*spread("place", places, place), cell(*at("place", place), km).alias("cell"))
    own = own.filter("cell is not null")
    near = rows(points, "point").select(*spread("point", points, point), F.explode(cells_around(*at("point", point), km)).alias("cell"))
    left, right = _tiles(own, near, tile_rows)
    away = km_between(*at("place", place), *at("point", point))
    # Most rows of neighbouring cells are too far away, which the chord tells before any angle is
    # worked out; it is taken a little too long, and the distance decides.
    apart = sum(((F.col(f"place_{n}") - F.col(f"point_{n}")) * (F.col(f"place_{n}") - F.col(f"point_{n}")) for n in "xyz"), F.lit(0.0))
    reach = 2 * sin(min(km / EARTH_KM, pi) / 2)
    pairs = left.join(right, ["cell", "_i", "_j"]).filter(apart <= reach * reach + SLACK)
    return pairs.select("place", "point", away.alias("distance_km")).filter(F.col("distance_km") <= km)


def counted_within(places: DataFrame, points: DataFrame, km: float, point_id: str, **names) -> DataFrame:
    """Per point: how many places lie within ``km`` and the nearest distance; points without any have zero."""
    pairs = radius_join(places, points, km, **names)
    found = pairs.groupBy(F.col(f"point.`{point_id}`").alias("_id")).agg(
        F.count("*").alias("n_places"), F.min("distance_km").alias("nearest_km")
    )
    out = points.join(found, F.col(f"`{point_id}`") == F.col("_id"), "left")
    return out.select(*[points[f"`{c}`"] for c in points.columns], F.coalesce("n_places", F.lit(0)).alias("n_places"), "nearest_km")
