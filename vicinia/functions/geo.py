"""Distances, boxes, travel times and geometry as column expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

EARTH_M = 6_371_000.0
METERS_A_DEGREE = 111_320.0


def haversine(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """G1: great-circle meters."""
    a = F.pow(F.sin(F.radians(lat2 - lat1) / 2), 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(F.radians(lon2 - lon1) / 2), 2)
    return 2 * EARTH_M * F.atan2(F.sqrt(a), F.sqrt(1 - a))


def valid_point(lat: Column, lon: Column) -> Column:
    """F3."""
    return lat.isNotNull() & lon.isNotNull() & ~F.isnan(lat) & ~F.isnan(lon) & lat.between(-90, 90) & lon.between(-180, 180)


def box(lat: float, lon: float, radius_m: float, least: float = 100.0, clamp: bool = True) -> tuple[float, float, float, float]:
    """(south, north, west, east) around a point, worked out once so that the scan gets plain range filters."""
    r = max(least, radius_m)
    dlat, dlon = r / METERS_A_DEGREE, r / (METERS_A_DEGREE * max(0.1, abs(math.cos(math.radians(lat)))))
    b = lat - dlat, lat + dlat, lon - dlon, lon + dlon
    return (max(-90.0, b[0]), min(90.0, b[1]), max(-180.0, b[2]), min(180.0, b[3])) if clamp else b


def in_box(df: DataFrame, b: tuple[float, float, float, float], lat: str = "lat", lon: str = "lon") -> DataFrame:
    return df.where((F.col(lat) >= b[0]) & (F.col(lat) <= b[1]) & (F.col(lon) >= b[2]) & (F.col(lon) <= b[3]))


def within_radius(df: DataFrame, lat: float, lon: float, radius_m: float) -> DataFrame:
    """box first, which the scan can use, then the exact distance; adds distance_m."""
    d = haversine(F.lit(lat), F.lit(lon), F.col("lat"), F.col("lon"))
    return in_box(df, box(lat, lon, radius_m)).withColumn("distance_m", d).where(F.col("distance_m") <= radius_m)


def travel_minutes(distance_m: Column, mode: str = "walk") -> Column:
    """Detour factor and speed by mode, a minute at least, 0 for no distance."""
    detour, kmh = {"walk": (1.3, 4.8), "bike": (1.2, 14.0)}[mode]
    m = F.greatest(F.lit(1.0), F.floor(distance_m * detour / (kmh * 1000 / 60) + 0.5).cast("double"))
    return F.when(distance_m <= 0, 0).otherwise(m.cast("int"))


def suggested_radius_km(nearest_m: Column, current_km: Column) -> Column:
    """The next half kilometer beyond the nearest hit, half a kilometer more than now at least, 0.5 to 15."""
    up = F.ceil((nearest_m / 1000 + 0.2) / 0.5) * 0.5
    return F.least(F.lit(15.0), F.greatest(F.lit(0.5), F.greatest(up, current_km + 0.5)))


def expanded_radius_km(current_km: Column) -> Column:
    """One kilometer or half as much again, rounded up to half a kilometer."""
    return F.least(F.lit(15.0), F.ceil(F.greatest(current_km + 1, current_km * 1.5) / 0.5) * 0.5)


def fallback_route(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Origin, a bent middle, destination."""
    p = lambda a, b: F.struct(a.alias("lat"), b.alias("lon"))
    return F.array(p(lat1, lon1), p((lat1 + lat2) / 2, (lon1 + lon2) / 2 + 0.06 * (lat2 - lat1)), p(lat2, lon2))


def radius_polygon(lat: Column, lon: Column, radius_m: Column, points: int = 72, wobble: float = 0.0) -> Column:
    """Points + 1 corners of a circle; wobble moves the radius by a share of it, three waves around."""

    def corner(i: Column) -> Column:
        a = i * (2 * math.pi / points)
        r = radius_m * (1 + wobble * F.sin(3 * a))
        return F.struct((lat + r * F.cos(a) / METERS_A_DEGREE).alias("lat"), (lon + r * F.sin(a) / (METERS_A_DEGREE * F.greatest(F.lit(0.1), F.abs(F.cos(F.radians(lat)))))).alias("lon"))

    return F.transform(F.sequence(F.lit(0), F.lit(points)), corner)


def path_length(path: Column) -> Column:
    """Meters along an array of (lat, lon)."""


    def step(s: Column, p: Column) -> Column:
        d = F.when(s["at"].isNull(), 0.0).otherwise(haversine(s["at"]["lat"], s["at"]["lon"], p["lat"], p["lon"]))
        return F.struct((s["sum"] + d).alias("sum"), p.alias("at"))

    nowhere = F.lit(None).cast("struct<lat:double,lon:double>")
    return F.aggregate(path, F.struct(F.lit(0.0).alias("sum"), nowhere.alias("at")), step)["sum"]


def path_upto(path: Column, meters: Column) -> Column:
    """The part of a path up to a distance, its last point interpolated."""

    def step(s: Column, p: Column) -> Column:
        last = F.element_at(s["out"], -1)
        d = F.when(F.size(s["out"]) == 0, 0.0).otherwise(haversine(last["lat"], last["lon"], p["lat"], p["lon"]))
        f = F.when(d > 0, F.least(F.lit(1.0), s["left"] / d)).otherwise(1.0)
        at = F.when(F.size(s["out"]) == 0, p).otherwise(F.struct((last["lat"] + (p["lat"] - last["lat"]) * f).alias("lat"), (last["lon"] + (p["lon"] - last["lon"]) * f).alias("lon")))
        return F.struct((s["left"] - F.least(d, s["left"])).alias("left"), F.when((s["left"] <= 0) & (F.size(s["out"]) > 0), s["out"]).otherwise(F.concat(s["out"], F.array(at))).alias("out"))

    start = F.struct(meters.cast("double").alias("left"), F.filter(path, lambda _: F.lit(False)).alias("out"))
    return F.aggregate(path, start, step)["out"]


def rounded_key(x: Column, digits: int = 4) -> Column:
    """The whole number of 10^-digits steps nearest to x."""
    return F.floor(x * 10**digits + 0.5)


def envelope(df: DataFrame, lat: str = "lat", lon: str = "lon") -> DataFrame:
    """South, north, west, east of all points."""
    return df.agg(F.min(lat).alias("south"), F.max(lat).alias("north"), F.min(lon).alias("west"), F.max(lon).alias("east"))


def near_pairs(points: DataFrame, meters: float, key: str = "id") -> DataFrame:
    """Pairs (id1 < id2, distance_m) up to a distance. Points fall into cells of that size; one side also takes the four cells
    that follow its own (the others find it from their side), so the join is an equi-join on cells and no two points meet twice. Cells of longitude widen with latitude.

    Points also carry their place on the unit sphere: the chord, a few products, rules out most that meet before the exact distance is worked out. Pairs
    grow with the square of the points of an area, as the result does, so few bytes of points are much work: cells are dealt to all tasks, however small their table."""
    dlat = meters / METERS_A_DEGREE
    band = F.floor(F.col("lat") / dlat)
    la, lo = F.radians("lat"), F.radians("lon")
    p = points.where(valid_point(F.col("lat"), F.col("lon"))).select(F.col(key).alias("id"), "lat", "lon", (F.cos(la) * F.cos(lo)).alias("x"), (F.cos(la) * F.sin(lo)).alias("y"), F.sin(la).alias("z")).withColumn("band", band)
    width = lambda b: dlat / F.greatest(F.lit(0.01), F.cos(F.radians(F.least(F.lit(89.0), F.greatest(F.abs((b - 2) * dlat), F.abs((b + 3) * dlat))))))
    step = lambda dy, dx: F.struct(F.lit(dy).alias("dy"), F.lit(dx).alias("dx"))
    ahead = F.array(step(0, 0), step(0, 1), step(1, -1), step(1, 0), step(1, 1))
    left = p.withColumn("by", F.col("band")).withColumn("col", F.floor(F.col("lon") / width(F.col("by"))))
    # A cell meets the next one of its band and the three of the band above, by that band's widths.
    right = p.withColumn("s", F.explode(ahead)).withColumn("by", F.col("band") + F.col("s.dy")).withColumn("own", F.expr("s.dy = 0 and s.dx = 0"))
    right = right.withColumn("col", F.floor(F.col("lon") / width(F.col("by"))) + F.col("s.dx"))
    at = lambda x, k, *more: x.select("by", "col", *[F.col(c).alias(f"{c}{k}") for c in ("id", "lat", "lon", "x", "y", "z")], *more)
    d2 = sum(((F.col(f"{c}1") - F.col(f"{c}2")) * (F.col(f"{c}1") - F.col(f"{c}2")) for c in "yz"), (F.col("x1") - F.col("x2")) * (F.col("x1") - F.col("x2")))
    # Squared chord of the distance, a little more and less for rounding: what lies between the two is left to the exact distance.
    chord2 = (2 * math.sin(min(math.pi / 2, meters / EARTH_M / 2))) ** 2
    parts = int(points.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    met = at(left, 1).repartition(parts, "by", "col").join(at(right, 2, "own").hint("merge"), ["by", "col"]).where((~F.col("own") | (F.col("id1") < F.col("id2"))) & (d2 <= chord2 * (1 + 1e-6) + 1e-14))
    d = haversine(F.col("lat1"), F.col("lon1"), F.col("lat2"), F.col("lon2"))
    near = met.where((F.col("id1") != F.col("id2")) & ((d2 <= chord2 * (1 - 1e-6) - 1e-14) | (d <= meters)))
    return near.select(F.least("id1", "id2").alias("id1"), F.greatest("id1", "id2").alias("id2"), d.alias("distance_m"))
