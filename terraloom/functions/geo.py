"""Column builders for spherical and Web-Mercator geometry."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values.
EARTH_RADIUS_M = 6_371_000.0
GEODESIC_RADIUS_KM = 6371.0088
MERCATOR_RADIUS_M = 6_378_137.0
MERCATOR_MAX_LAT = 85.05112878
METRES_PER_DEGREE = 111_111.0
KM_PER_LAT_DEGREE = 111.0
WALK_METRES_PER_SECOND = 1.67
WALK_SHOWN_KMH = 6


def _c(x) -> Column:
    if isinstance(x, str):
        return F.col(x)
    return x if isinstance(x, Column) else F.lit(float(x))


def _half_chord(lat1, lon1, lat2, lon2, cosines: tuple[str, str] | None = None) -> Column:
    lat1, lon1, lat2, lon2 = map(_c, (lat1, lon1, lat2, lon2))
    c1, c2 = (F.col(c) for c in cosines) if cosines else (F.cos(F.radians(lat1)), F.cos(F.radians(lat2)))
    a = F.sin(F.radians(lat2 - lat1) / 2)
    b = F.sin(F.radians(lon2 - lon1) / 2)
    h = a * a + c1 * c2 * (b * b)
    return F.least(F.greatest(h, F.lit(0.0)), F.lit(1.0))


def haversine_m(lat1, lon1, lat2, lon2, radius: float = EARTH_RADIUS_M, cosines: tuple[str, str] | None = None) -> Column:
    """Great-circle metres between two points in degrees.

    ``cosines`` names columns with the cosines of both latitudes, if there are.
    """
    h = _half_chord(lat1, lon1, lat2, lon2, cosines)
    return F.lit(2 * radius) * F.atan2(F.sqrt(h), F.sqrt(F.lit(1.0) - h))


def great_circle_km(lat1, lon1, lat2, lon2, radius_km: float = GEODESIC_RADIUS_KM) -> Column:
    return haversine_m(lat1, lon1, lat2, lon2, radius_km)


def bearing_rad(lat1, lon1, lat2, lon2) -> Column:
    """Initial bearing of the great circle from the first point to the second."""
    lat1, lat2 = F.radians(_c(lat1)), F.radians(_c(lat2))
    dl = F.radians(_c(lon2)) - F.radians(_c(lon1))
    return F.atan2(
        F.sin(dl) * F.cos(lat2),
        F.cos(lat1) * F.sin(lat2) - F.sin(lat1) * F.cos(lat2) * F.cos(dl),
    )


def destination(lat, lon, km, bearing, radius_km: float = GEODESIC_RADIUS_KM) -> tuple[Column, Column]:
    """(lat, lon) reached after ``km`` along ``bearing`` (radians)."""
    la, lo, d, b = F.radians(_c(lat)), F.radians(_c(lon)), _c(km) / radius_km, _c(bearing)
    s = F.sin(la) * F.cos(d) + F.cos(la) * F.sin(d) * F.cos(b)
    lat2 = F.asin(F.least(F.greatest(s, F.lit(-1.0)), F.lit(1.0)))
    lon2 = lo + F.atan2(F.sin(b) * F.sin(d) * F.cos(la), F.cos(d) - F.sin(la) * F.sin(lat2))
    return F.degrees(lat2), F.degrees(lon2)


def east_degrees(lat, km, radius_km: float = GEODESIC_RADIUS_KM) -> Column:
    """Longitude degrees covered by ``km`` due east at ``lat``."""
    return F.abs(destination(lat, 0.0, km, math.pi / 2, radius_km)[1])


def along(lat1, lon1, lat2, lon2, fraction) -> tuple[Column, Column]:
    """Point at ``fraction`` of the great circle between two points."""
    km = great_circle_km(lat1, lon1, lat2, lon2) * _c(fraction)
    return destination(lat1, lon1, km, bearing_rad(lat1, lon1, lat2, lon2))


def mercator_x(lon) -> Column:
    return F.radians(_c(lon)) * MERCATOR_RADIUS_M


def mercator_y(lat) -> Column:
    clamped = F.greatest(F.least(_c(lat), F.lit(MERCATOR_MAX_LAT)), F.lit(-MERCATOR_MAX_LAT))
    return F.log(F.tan(F.lit(math.pi / 4) + F.radians(clamped) / 2)) * MERCATOR_RADIUS_M


def lon_of_mercator(x) -> Column:
    return F.degrees(_c(x) / MERCATOR_RADIUS_M)


def lat_of_mercator(y) -> Column:
    return F.degrees(F.atan(F.exp(_c(y) / MERCATOR_RADIUS_M)) * 2 - math.pi / 2)


def unit_sphere(lat, lon) -> tuple[Column, Column, Column]:
    la, lo = F.radians(_c(lat)), F.radians(_c(lon))
    return F.cos(la) * F.cos(lo), F.cos(la) * F.sin(lo), F.sin(la)


def chord_of_m(metres) -> Column:
    """Straight-line length on the unit sphere of a great-circle distance."""
    half = F.least(_c(metres) / (2 * EARTH_RADIUS_M), F.lit(math.pi / 2))
    return F.sin(half) * 2


def walk_ms(metres) -> Column:
    return F.floor(_c(metres) * 1000.0 / WALK_METRES_PER_SECOND).cast("long")


def located(lat, lon) -> Column:
    """Valid position; the exact origin counts as missing."""
    lat, lon = _c(lat), _c(lon)
    ok = lat.between(-90.0, 90.0) & lon.between(-180.0, 180.0) & ~((lat == 0) & (lon == 0))
    return F.coalesce(ok, F.lit(False))


def _spread(c: Column) -> Column:
    """Bits of a 24-bit number moved to the even positions."""
    for shift, mask in (
        (16, 0x0000FFFF0000FFFF), (8, 0x00FF00FF00FF00FF), (4, 0x0F0F0F0F0F0F0F0F),
        (2, 0x3333333333333333), (1, 0x5555555555555555),
    ):
        c = c.bitwiseOR(F.shiftleft(c, shift)).bitwiseAND(F.lit(mask))
    return c


MORTON_BITS = 24


def morton_xy(lat, lon) -> tuple[Column, Column]:
    """Column and row of a point on the 2^24 world grid."""
    n = 2 ** MORTON_BITS
    cx = F.least(F.floor((_c(lon) + 180.0) / 360.0 * n), F.lit(n - 1)).cast("long")
    cy = F.least(F.floor((_c(lat) + 90.0) / 180.0 * n), F.lit(n - 1)).cast("long")
    return cx, cy


def morton(cx: Column, cy: Column) -> Column:
    return _spread(cx).bitwiseOR(F.shiftleft(_spread(cy), 1))
