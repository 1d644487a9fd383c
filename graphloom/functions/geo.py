"""Points, circles, boxes, polygons and geohashes as Column arithmetic. A point is a struct (latitude, longitude)."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

EARTH_KM = 6371.0
#: The digits of a geohash.
DIGITS = "0123456789bcdefghjkmnpqrstuvwxyz"


def point(latitude, longitude) -> Column:
    """Null if a coordinate is null."""
    lat, lon = (x if isinstance(x, Column) else F.lit(x) for x in (latitude, longitude))
    return F.when(lat.isNotNull() & lon.isNotNull(), F.struct(lat.cast("double").alias("latitude"), lon.cast("double").alias("longitude")))


def parse_point(text: Column) -> Column:
    parts = F.split(text, ",")
    return point(F.trim(F.get(parts, F.lit(0))).try_cast("double"), F.trim(F.get(parts, F.lit(1))).try_cast("double"))


def distance(p: Column, q: Column) -> Column:
    """Great-circle kilometres."""
    la, lb = F.radians(p["latitude"]), F.radians(q["latitude"])
    h = F.pow(F.sin((lb - la) / 2), 2) + F.cos(la) * F.cos(lb) * F.pow(F.sin(F.radians(q["longitude"] - p["longitude"]) / 2), 2)
    return 2 * EARTH_KM * F.asin(F.least(F.lit(1.0), F.sqrt(h)))


def in_circle(p: Column, centre: Column, km) -> Column:
    return distance(p, centre) <= km


def in_box(p: Column, north: float, west: float, south: float, east: float) -> Column:
    return p["latitude"].between(south, north) & p["longitude"].between(west, east)


def in_polygon(p: Column, ring: list[tuple[float, float]]) -> Column:
    """Even-odd rule over (latitude, longitude) corners; points on an edge may fall on either side."""
    x, y, crossings = p["longitude"], p["latitude"], F.lit(0)
    for (ya, xa), (yb, xb) in zip(ring, ring[1:] + ring[:1], strict=True):
        if ya != yb:
            cuts = (F.lit(ya) > y) != (F.lit(yb) > y)
            crossings = crossings + (cuts & (x < (xb - xa) * (y - ya) / (yb - ya) + xa)).cast("int")
    return crossings % 2 == 1


def geohash(p: Column, precision: int) -> Column:
    """The geohash cell of a point: bits of longitude and latitude in turn, five to a digit."""
    bits = 5 * precision
    lon_bits, lat_bits = (bits + 1) // 2, bits // 2
    cell = lambda v, low, width, n: F.least(F.floor((v - low) / width * (1 << n)), F.lit((1 << n) - 1)).cast("long")
    lon, lat = cell(p["longitude"], -180.0, 360.0, lon_bits), cell(p["latitude"], -90.0, 180.0, lat_bits)
    digits = []
    for d in range(precision):
        value = F.lit(0).cast("long")
        for b in range(5):
            i = 5 * d + b
            source, at, n = (lon, i // 2, lon_bits) if i % 2 == 0 else (lat, i // 2, lat_bits)
            value = value * 2 + F.shiftright(source, n - 1 - at).bitwiseAND(F.lit(1).cast("long"))
        digits.append(F.substr(F.lit(DIGITS), value.cast("int") + 1, F.lit(1)))
    return F.concat(*digits)


def point_with_height(latitude, longitude, height) -> Column:
    """A point with metres over the ground."""
    flat, h = point(latitude, longitude), height if isinstance(height, Column) else F.lit(height)
    return F.when(flat.isNotNull(), F.struct(flat["latitude"].alias("latitude"), flat["longitude"].alias("longitude"), h.cast("double").alias("height")))


#: Accessors of a point; x and y are longitude and latitude.
COMPONENTS = {
    "x": lambda p: p["longitude"],
    "y": lambda p: p["latitude"],
    "z": lambda p: p["height"],
    "longitude": lambda p: p["longitude"],
    "latitude": lambda p: p["latitude"],
    "height": lambda p: p["height"],
}


def _let(value: Column, use) -> Column:
    """``use(value)`` with the value worked out once, however often it is used."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def geohash_centre(cell: Column) -> Column:
    """The middle of a geohash cell as a point."""
    digits = F.filter(F.split(cell, ""), lambda d: d != "")
    bits = F.concat_ws("", F.transform(digits, lambda d: F.lpad(F.bin(F.instr(F.lit(DIGITS), d).cast("long") - 1), 5, "0")))
    every = lambda b, start: F.concat_ws("", F.transform(F.sequence(F.lit(start), F.length(b), F.lit(2)), lambda i: F.substr(b, i, F.lit(1))))
    middle = lambda low, width: lambda b: low + width * (F.conv(b, 2, 10).cast("double") + 0.5) / F.pow(F.lit(2.0), F.length(b))
    return _let(bits, lambda b: point(_let(every(b, 2), middle(-90.0, 180.0)), _let(every(b, 1), middle(-180.0, 360.0))))
