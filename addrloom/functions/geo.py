"""Distances on the ellipsoid and in the plane, and coordinate changes in closed form."""

import pandas as pd
from pyspark.sql import Column, functions as F
from pyspark.sql.types import DoubleType

from . import geodesic

MERCATOR = 6378137.0


@F.pandas_udf(DoubleType())
def ellipsoidal(x1: pd.Series, y1: pd.Series, x2: pd.Series, y2: pd.Series) -> pd.Series:
    """Metres along the WGS 84 ellipsoid; null where a coordinate is missing."""
    found = pd.Series(geodesic.lengths(x1, y1, x2, y2))
    return found.astype(object).where(found.notna(), None)


def planar(x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
    return F.sqrt(F.pow(x2 - x1, 2) + F.pow(y2 - y1, 2))


def distance(x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
    """Metres: on the ellipsoid where both points are in the range of degrees, or else in the plane."""
    geographic = (F.abs(x1) < 180) & (F.abs(y1) < 90) & (F.abs(x2) < 180) & (F.abs(y2) < 90)
    return F.when(geographic, ellipsoidal(*(F.when(geographic, c) for c in (x1, y1, x2, y2)))).otherwise(planar(x1, y1, x2, y2))


def to_mercator(x: Column, y: Column) -> tuple[Column, Column]:
    return F.radians(x) * MERCATOR, F.log(F.tan(F.radians(y) / 2 + 3.141592653589793 / 4)) * MERCATOR


def from_mercator(x: Column, y: Column) -> tuple[Column, Column]:
    return F.degrees(x / MERCATOR), F.degrees(2 * F.atan(F.exp(y / MERCATOR)) - 3.141592653589793 / 2)


class Transverse:
    """A transverse Mercator projection, by Krueger's series in the third flattening to its fourth power: better than a
    millimetre within some thousand kilometres of the central meridian."""

    def __init__(self, central: float, scale: float, east: float, north: float, flat: float = geodesic.FLAT):
        n = flat / (2 - flat)
        self.central, self.east, self.north, self.e = central, east, north, 2 * n**0.5 / (1 + n)
        self.radius = scale * geodesic.AXIS / (1 + n) * (1 + n**2 / 4 + n**4 / 64)
        #: Fixed values of the series: forward, inverse, and from the conformal latitude.
        self.alpha = [
            n / 2 - 2 * n**2 / 3 + 5 * n**3 / 16 + 41 * n**4 / 180, 13 * n**2 / 48 - 3 * n**3 / 5 + 557 * n**4 / 1440,
            61 * n**3 / 240 - 103 * n**4 / 140, 49561 * n**4 / 161280
        ]
        self.beta = [
            n / 2 - 2 * n**2 / 3 + 37 * n**3 / 96 - n**4 / 360, n**2 / 48 + n**3 / 15 - 437 * n**4 / 1440,
            17 * n**3 / 480 - 37 * n**4 / 840, 4397 * n**4 / 161280
        ]
        self.delta = [
            2 * n - 2 * n**2 / 3 - 2 * n**3 + 116 * n**4 / 45, 7 * n**2 / 3 - 8 * n**3 / 5 - 227 * n**4 / 45,
            56 * n**3 / 15 - 136 * n**4 / 35, 4279 * n**4 / 630
        ]

    def forward(self, x: Column, y: Column) -> tuple[Column, Column]:
        lon, sin_y = F.radians(x - self.central), F.sin(F.radians(y))
        t = F.sinh(F.atanh(sin_y) - self.e * F.atanh(self.e * sin_y))
        xi, eta = F.atan2(t, F.cos(lon)), F.atanh(F.sin(lon) / F.sqrt(1 + t * t))
        more = list(enumerate(self.alpha, 1))
        return (
            self.east + self.radius * sum((a * F.cos(2 * j * xi) * F.sinh(2 * j * eta) for j, a in more), eta),
            self.north + self.radius * sum((a * F.sin(2 * j * xi) * F.cosh(2 * j * eta) for j, a in more), xi)
        )

    def inverse(self, x: Column, y: Column) -> tuple[Column, Column]:
        xi, eta = (y - self.north) / self.radius, (x - self.east) / self.radius
        more = list(enumerate(self.beta, 1))
        u = sum((-b * F.sin(2 * j * xi) * F.cosh(2 * j * eta) for j, b in more), xi)
        v = sum((-b * F.cos(2 * j * xi) * F.sinh(2 * j * eta) for j, b in more), eta)
        chi = F.asin(F.sin(u) / F.cosh(v))
        lat = sum((d * F.sin(2 * j * chi) for j, d in enumerate(self.delta, 1)), chi)
        return self.central + F.degrees(F.atan2(F.sinh(v), F.cos(u))), F.degrees(lat)


CHINA_FLAT = 1 / 298.257222101


def projection(code: int) -> Transverse | None:
    """The projection of a reference system by its EPSG number: UTM zones on WGS 84, Gauss-Krueger zones of CGCS2000 (six and
    three degrees, with and without the zone before the easting); None for degrees."""
    if code in (4326, 4490):
        return None
    for first, last, north in ((32601, 32660, 0.0), (32701, 32760, 10_000_000.0)):
        if first <= code <= last:
            return Transverse(6 * (code - first) - 177, 0.9996, 500_000.0, north)
    for first, last, step, zone in ((4491, 4501, 6, 13), (4502, 4512, 6, 0), (4513, 4533, 3, 25), (4534, 4554, 3, 0)):
        if first <= code <= last:
            before = (zone + code - first) * 1_000_000.0 if zone else 0.0
            return Transverse(75 + step * (code - first), 1.0, before + 500_000.0, 0.0, CHINA_FLAT)
    raise ValueError(f"EPSG:{code} is not known here")


def transformed(x: Column, y: Column, source: int, target: int) -> tuple[Column, Column]:
    """Coordinates of one reference system in another one, by EPSG numbers. Degrees of WGS 84 and of CGCS2000 count as equal."""
    if source == target:
        return x, y
    if source == 3857:
        x, y = from_mercator(x, y)
    elif found := projection(source):
        x, y = found.inverse(x, y)
    if target == 3857:
        return to_mercator(x, y)
    found = projection(target)
    return found.forward(x, y) if found else (x, y)
