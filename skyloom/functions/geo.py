"""Navigation on a sphere as column expressions; degrees in, nautical miles and degrees out."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Mean earth radius in nautical miles.
RADIUS_NM = 6371.0088 / 1.852


def distance_nm(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Haversine distance, null where a coordinate is; rounding never takes the sine's square beyond 1."""
    a, b = F.sin(F.radians(lat2 - lat1) / 2), F.sin(F.radians(lon2 - lon1) / 2)
    h = a * a + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * b * b
    return 2 * RADIUS_NM * F.asin(F.sqrt(F.when(h > 1, 1.0).otherwise(h)))


def bearing(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Initial bearing from the first point to the second, 0 to 360."""
    p, q, d = F.radians(lat1), F.radians(lat2), F.radians(lon2 - lon1)
    return F.pmod(F.degrees(F.atan2(F.sin(d) * F.cos(q), F.cos(p) * F.sin(q) - F.sin(p) * F.cos(q) * F.cos(d))), F.lit(360.0))


def cross_track_nm(lat: Column, lon: Column, lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Signed distance of a point from the great circle through two others; right of it is positive."""
    along = distance_nm(lat1, lon1, lat, lon) / RADIUS_NM
    off = F.radians(bearing(lat1, lon1, lat, lon) - bearing(lat1, lon1, lat2, lon2))
    return F.asin(F.sin(along) * F.sin(off)) * RADIUS_NM


def angle_difference(a: Column, b: Column) -> Column:
    """a - b as an angle above -180 up to 180."""
    turned = F.pmod(a - b, F.lit(360.0))
    return F.when(turned > 180, turned - 360).otherwise(turned)


def squared_degrees(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """The plain squared distance in degrees, by which the nearest place is named."""
    return (lat1 - lat2) * (lat1 - lat2) + (lon1 - lon2) * (lon1 - lon2)


def coordinate(token: Column) -> Column:
    """Struct lat, lon of a token such as N5120.9/W00033.5 (degrees and minutes); null if it is none."""
    pattern = r"^([NS])(\d{2})(\d{2}(?:\.\d+)?)/([EW])(\d{3})(\d{2}(?:\.\d+)?)$"
    part = lambda i: F.regexp_extract(F.trim(token), pattern, i)
    degrees = lambda d, m: part(d).try_cast("double") + part(m).try_cast("double") / 60
    signed = lambda s, minus, v: F.when(part(s) == minus, -v).otherwise(v)
    found = F.struct(signed(1, "S", degrees(2, 3)).alias("lat"), signed(4, "W", degrees(5, 6)).alias("lon"))
    return F.when(F.trim(token).rlike(pattern), found)


def crosswind(speed: Column, direction: Column, course: Column) -> Column:
    """Size of the crosswind, never negative."""
    return speed * F.sin(F.radians(_between(direction, course)))


def wind_along(speed: Column, direction: Column, course: Column) -> Column:
    """Recorder convention: negative is a headwind."""
    return -speed * F.cos(F.radians(_between(direction, course)))


def headwind(speed: Column, direction: Column, course: Column) -> Column:
    """Planning convention: positive is a headwind."""
    return speed * F.cos(F.radians(direction - course))


def side_wind(speed: Column, direction: Column, course: Column) -> Column:
    """Planning convention: positive comes from the right."""
    return speed * F.sin(F.radians(direction - course))


def _between(direction: Column, course: Column) -> Column:
    full = F.when(direction < 0, direction + 360).otherwise(direction)
    apart = F.abs(full - course)
    return F.when(apart > 180, 360 - apart).otherwise(apart)


def mean_wind(speed: Column, direction: Column) -> Column:
    """Aggregate: struct direction, speed of the vector mean."""
    east, north = F.avg(speed * F.sin(F.radians(direction))), F.avg(speed * F.cos(F.radians(direction)))
    return F.struct(F.pmod(F.degrees(F.atan2(east, north)), F.lit(360.0)).alias("direction"), F.hypot(east, north).alias("speed"))


def midpoint(low: Column, high: Column, inset: float = 0.0) -> Column:
    """Struct mid, low, high of a range widened by a share of it on both sides."""
    more = (high - low) * inset
    return F.struct(((low + high) / 2).alias("mid"), (low - more).alias("low"), (high + more).alias("high"))
