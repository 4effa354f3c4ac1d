"""Lengths of shortest lines on the WGS 84 ellipsoid, for many pairs of points at a time."""

from __future__ import annotations

import numpy as np

#: Fixed values of the ellipsoid: semi-major axis in metres and flattening.
AXIS, FLAT = 6378137.0, 1 / 298.257223563
MINOR = AXIS * (1 - FLAT)
_NODES, _WEIGHTS = np.polynomial.legendre.leggauss(24)


def _vincenty(u1, u2, longitude, rounds: int = 60):
    """(length, settled) by Vincenty's iteration on the auxiliary sphere; it does not settle near antipodes."""
    s1, c1, s2, c2 = np.sin(u1), np.cos(u1), np.sin(u2), np.cos(u2)
    lam, settled = longitude.copy(), np.zeros(len(longitude), bool)
    for _ in range(rounds):
        sl, cl = np.sin(lam), np.cos(lam)
        sin_s = np.hypot(c2 * sl, c1 * s2 - s1 * c2 * cl)
        cos_s = s1 * s2 + c1 * c2 * cl
        sigma = np.arctan2(sin_s, cos_s)
        sin_a = np.divide(c1 * c2 * sl, sin_s, out=np.zeros_like(sl), where=sin_s > 0)
        cos2_a = 1 - sin_a**2
        mid = cos_s - np.divide(2 * s1 * s2, cos2_a, out=cos_s.copy(), where=cos2_a > 1e-15)
        k = FLAT / 16 * cos2_a * (4 + FLAT * (4 - 3 * cos2_a))
        last, lam = lam, longitude + (1 - k) * FLAT * sin_a * (sigma + k * sin_s * (mid + k * cos_s * (2 * mid**2 - 1)))
        settled = (np.abs(lam - last) < 1e-13) & (lam <= np.pi)
        if settled.all():
            break
    v = cos2_a * (AXIS**2 - MINOR**2) / MINOR**2
    a = 1 + v / 16384 * (4096 + v * (-768 + v * (320 - 175 * v)))
    b = v / 1024 * (256 + v * (-128 + v * (74 - 47 * v)))
    part = b / 4 * (cos_s * (2 * mid**2 - 1) - b / 6 * mid * (4 * sin_s**2 - 3) * (4 * mid**2 - 3))
    return MINOR * a * (sigma - b * sin_s * (mid + part)), settled


def _integral(f, low, high):
    half, centre = (high - low) / 2, (high + low) / 2
    return half * (f(centre[:, None] + half[:, None] * _NODES) * _WEIGHTS).sum(axis=1)


def _shooting(u1, u2, longitude, rounds: int = 80):
    """Lengths by halving the interval of the first azimuth until the line reaches the other longitude, which rises with it.

    The first point is the one farther from the equator, and south of it; integrals are by Gauss and Legendre."""
    swap = np.abs(u2) > np.abs(u1)
    first, other = np.where(swap, u2, u1), np.where(swap, u1, u2)
    sign = np.where(first > 0, -1.0, 1.0)
    first, other = np.minimum(first * sign, -1e-13), other * sign  # a point on the equator counts as just south of it
    s1, c1, c2 = np.sin(first), np.cos(first), np.cos(other)
    k2 = (AXIS**2 - MINOR**2) / MINOR**2

    def line(azimuth):
        sin_0 = np.sin(azimuth) * c1
        ep2 = k2 * (1 - sin_0**2)[:, None]
        cos_2 = np.sqrt(np.maximum(0, (np.cos(azimuth) * c1) ** 2 + c2**2 - c1**2))  # times c2
        sigma1, sigma2 = np.arctan2(s1, np.cos(azimuth) * c1), np.arctan2(np.sin(other), cos_2)
        omega1, omega2 = (np.arctan2(sin_0 * np.sin(s), np.cos(s)) for s in (sigma1, sigma2))
        root = lambda s: np.sqrt(1 + ep2 * np.sin(s) ** 2)
        shift = _integral(lambda s: (2 - FLAT) / (1 + (1 - FLAT) * root(s)), sigma1, sigma2)
        return omega2 - omega1 - FLAT * sin_0 * shift, MINOR * _integral(root, sigma1, sigma2)

    low, high = np.zeros(len(u1)), np.full(len(u1), np.pi)
    for _ in range(rounds):
        middle = (low + high) / 2
        far = line(middle)[0] >= longitude
        low, high = np.where(far, low, middle), np.where(far, middle, high)
    return line((low + high) / 2)[1]


def lengths(x1, y1, x2, y2) -> np.ndarray:
    """Metres between points in degrees (x is longitude); not a number where one is missing."""
    x1, y1, x2, y2 = (np.asarray(v, float) for v in (x1, y1, x2, y2))
    out = np.full(len(x1), np.nan)
    known = np.isfinite(x1) & np.isfinite(y1) & np.isfinite(x2) & np.isfinite(y2)
    reduced = lambda y: np.arctan((1 - FLAT) * np.tan(np.radians(y[known])))
    u1, u2 = reduced(y1), reduced(y2)
    longitude = np.radians(np.abs((x2[known] - x1[known] + 180) % 360 - 180))
    found, settled = _vincenty(u1, u2, longitude)
    if not settled.all():
        rest = ~settled
        found[rest] = _shooting(u1[rest], u2[rest], longitude[rest])
    out[known] = found
    return out
