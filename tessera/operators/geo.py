"""Geospatial sets: a table geo(key, member, lon DOUBLE, lat DOUBLE). Radius joins go through a grid of cells, so no pair outside neighbouring cells is formed."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.errors import CommandError
from tessera.operators.keyspace import upsert
from tessera.operators.order import lookup

# The earth's radius in metres, metres of each unit, latitudes of the 52-bit grid, base 32.
RADIUS = 6372797.560856
UNITS = {"m": 1.0, "km": 1000.0, "ft": 0.3048, "mi": 1609.34}
LAT_LIMIT = 85.05112878
BASE32 = "0123456789bcdefghjkmnpqrstuvwxyz"
BITS = 26


def geoadd(geo: DataFrame, new: DataFrame, mode: str | None = None) -> DataFrame:
    """Upsert of new(key, member, lon, lat); NX only new members, XX only present ones. Coordinates outside the grid are an error. A present member moves."""
    bad = (F.abs("lon") > 180) | (F.abs("lat") > LAT_LIMIT)
    new = new.withColumn("lon", F.when(bad, F.raise_error(F.lit("ERR invalid longitude,latitude pair"))).otherwise(F.col("lon")))
    if mode:
        new = new.join(geo.select("key", "member"), ["key", "member"], {"NX": "left_anti", "XX": "left_semi"}[mode])
    return upsert(geo, new, "key", "member")


def haversine(lon1: Column, lat1: Column, lon2: Column, lat2: Column) -> Column:
    """Metres between two positions in degrees."""
    u, v = F.sin((F.radians(lat2) - F.radians(lat1)) / 2), F.sin((F.radians(lon2) - F.radians(lon1)) / 2)
    return 2 * RADIUS * F.asin(F.least(F.lit(1.0), F.sqrt(u * u + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * v * v)))


def _cell(x: Column, low: float, high: float) -> Column:
    return F.least(F.floor((x - low) / (high - low) * (1 << BITS)), F.lit((1 << BITS) - 1)).cast("long")


def quantise(lon: Column, lat: Column) -> tuple[Column, Column]:
    """The centre of a position's cell in the 52-bit grid."""
    at = lambda x, a, b: (_cell(x, a, b) + 0.5) / (1 << BITS) * (b - a) + a
    return at(lon, -180.0, 180.0), at(lat, -LAT_LIMIT, LAT_LIMIT)


def _interleaved(lon: Column, lat: Column, lat_limit: float, bits: int) -> Column:
    """A text of binary digits, longitude first."""
    digits = lambda x, a, b: F.lpad(F.bin(F.least(F.floor((x - a) / (b - a) * (1 << bits)), F.lit((1 << bits) - 1)).cast("long")), bits, "0")
    xs, ys = digits(lon, -180.0, 180.0), digits(lat, -lat_limit, lat_limit)
    return F.concat(*[c for i in range(1, bits + 1) for c in (F.substring(xs, i, 1), F.substring(ys, i, 1))])


def geohash_int(lon: Column, lat: Column) -> Column:
    """The 52-bit cell number."""
    return F.conv(_interleaved(lon, lat, LAT_LIMIT, BITS), 2, 10).cast("long")


def geohash(lon: Column, lat: Column) -> Column:
    """Eleven base-32 characters over latitudes -90 to 90."""
    bits = F.rpad(_interleaved(lon, lat, 90.0, BITS), 55, "0")
    return F.concat(*[F.substring(F.lit(BASE32), F.conv(F.substring(bits, 5 * i + 1, 5), 2, 10).cast("int") + 1, F.lit(1)) for i in range(11)])


def _unit(name: str) -> float:
    if name.lower() not in UNITS:
        raise CommandError("ERR unsupported unit provided. please use M, KM, FT, MI")
    return UNITS[name.lower()]


def geopos(geo: DataFrame, req: DataFrame) -> DataFrame:
    """(pos, key, member, lon, lat) at six decimals, null for missing members."""
    return lookup(req, geo, "key", "member").select("pos", "key", "member", F.round("lon", 6).alias("lon"), F.round("lat", 6).alias("lat"))


def geodist(geo: DataFrame, pairs: DataFrame, unit: str = "m") -> DataFrame:
    """(key, a, b, dist) at four decimals; null if a member is missing."""
    side = lambda k: geo.select("key", F.col("member").alias(k), F.col("lon").alias(f"lon_{k}"), F.col("lat").alias(f"lat_{k}"))
    j = lookup(lookup(pairs, side("a"), "key", "a"), side("b"), "key", "b")
    return j.select("key", "a", "b", F.round(haversine(F.col("lon_a"), F.col("lat_a"), F.col("lon_b"), F.col("lat_b")) / _unit(unit), 4).alias("dist"))


def _box(lon: float, lat: float, metres: float) -> Column:
    """A bounding box that reaches the scan; longitudes are open where it meets a pole or the date line."""
    d = math.degrees(metres / RADIUS) * 1.0001
    out = F.col("lat").between(lat - d, lat + d)
    if abs(lat) + d < 89:
        w = math.degrees(2 * math.asin(min(1.0, math.sin(min(metres / RADIUS, math.pi) / 2) / math.cos(math.radians(abs(lat) + d))))) * 1.0001
        if lon - w > -180 and lon + w < 180:
            out = out & F.col("lon").between(lon - w, lon + w)
    return out


def geosearch(geo: DataFrame, lon: float, lat: float, radius: float, unit: str = "m", *, key: str | None = None, count: int | None = None, descending: bool = False, ordered: bool = True) -> DataFrame:
    """(key, member, dist, hash, lon, lat) within a radius, nearest first."""
    u = _unit(unit)
    near = geo.where(_box(lon, lat, radius * u)) if key is None else geo.where((F.col("key") == key) & _box(lon, lat, radius * u))
    d = haversine(F.lit(float(lon)), F.lit(float(lat)), F.col("lon"), F.col("lat")) / u
    out = near.withColumn("_d", d).where(F.col("_d") <= radius)
    if ordered or count is not None:
        out = out.orderBy(F.desc("_d") if descending else F.asc("_d"), "member")
    out = out if count is None else out.limit(count)
    return out.select("key", "member", F.round("_d", 4).alias("dist"), geohash_int(F.col("lon"), F.col("lat")).alias("hash"), F.round("lon", 6).alias("lon"), F.round("lat", 6).alias("lat"))


def geosearch_member(geo: DataFrame, key: str, member: str, radius: float, unit: str = "m", **kw) -> DataFrame:
    """As geosearch around a member; a missing one gives no rows."""
    at = geo.where((F.col("key") == key) & (F.col("member") == member)).select("lon", "lat").head(1)
    return geosearch(geo, at[0][0], at[0][1], radius, unit, key=key, **kw) if at else geosearch(geo, 0.0, 0.0, -1.0, unit, key=key, **kw)


def radius_join(left: DataFrame, right: DataFrame, metres: float) -> DataFrame:
    """(l, r, dist) of all positions l(member, lon, lat) and r within a distance.

    Both are dealt to latitude bands of that height, and to longitude cells wide enough at the band's far edge; a
    right position goes to its neighbour cells, too, so the join is on equal cells.
    """
    h = math.degrees(metres / RADIUS) * 1.0001
    band = lambda c: F.floor((c + 90) / h)
    far = lambda b: F.least(F.lit(89.9), F.greatest(F.abs(b * h - 90), F.abs((b + 1) * h - 90)) + h)
    width = lambda b: h / F.cos(F.radians(far(b)))
    cells = lambda b: F.greatest(F.lit(1), F.floor(360 / width(b)))
    column = lambda c, b: F.floor((c + 180) / 360 * cells(b)) % cells(b)
    a = left.select(F.col("member").alias("l"), F.col("lon").alias("lon_l"), F.col("lat").alias("lat_l"), band(F.col("lat")).alias("b"))
    a = a.withColumn("c", column(F.col("lon_l"), F.col("b")))
    z = right.select(F.col("member").alias("r"), F.col("lon").alias("lon_r"), F.col("lat").alias("lat_r"), F.explode(F.array(*[band(F.col("lat")) + i for i in (-1, 0, 1)])).alias("b"))
    z = z.select("*", F.explode(F.array_distinct(F.transform(F.array(*[F.lit(i) for i in (-1, 0, 1)]), lambda i: F.pmod(column(F.col("lon_r"), F.col("b")) + i, cells(F.col("b")))))).alias("c"))
    d = haversine(F.col("lon_l"), F.col("lat_l"), F.col("lon_r"), F.col("lat_r"))
    return a.join(z, ["b", "c"]).withColumn("dist", d).where(F.col("dist") <= metres).select("l", "r", "dist")
