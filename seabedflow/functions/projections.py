"""Map projections on the WGS-84 ellipsoid as column expressions (closed forms and series of USGS PP 1395).

Angles are degrees, distances metres. Null in, null out. All expressions stay in generated code.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

A, FLAT = 6378137.0, 1 / 298.257223563
E2 = FLAT * (2 - FLAT)
E = math.sqrt(E2)


def _t(lat: Column) -> Column:
    """tan of half the conformal colatitude, latitude in radians."""
    s = E * F.sin(lat)
    return F.tan(math.pi / 4 - lat / 2) / F.pow((1 - s) / (1 + s), F.lit(E / 2))


def _from_conformal(chi: Column) -> Column:
    """Geodetic from conformal latitude, series to the eighth power of the eccentricity."""
    c = (
        E2 / 2 + 5 * E2**2 / 24 + E2**3 / 12 + 13 * E2**4 / 360,
        7 * E2**2 / 48 + 29 * E2**3 / 240 + 811 * E2**4 / 11520,
        7 * E2**3 / 120 + 81 * E2**4 / 1120,
        4279 * E2**4 / 161280,
    )
    return chi + sum(k * F.sin((2 * i + 2) * chi) for i, k in enumerate(c))


def _wrap(degrees: Column) -> Column:
    return degrees - 360 * F.floor((degrees + 180) / 360)


@dataclass(frozen=True)
class Mercator:
    """True scale at ``lat0``."""

    lon0: float
    lat0: float = 0.0
    x0: float = 0.0
    y0: float = 0.0

    @property
    def _scale(self) -> float:
        p = math.radians(self.lat0)
        return A * math.cos(p) / math.sqrt(1 - E2 * math.sin(p) ** 2)

    def forward(self, lon: Column, lat: Column) -> tuple[Column, Column]:
        return F.radians(_wrap(lon - self.lon0)) * self._scale + self.x0, F.lit(self.y0) - F.log(_t(F.radians(lat))) * self._scale

    def inverse(self, x: Column, y: Column) -> tuple[Column, Column]:
        chi = math.pi / 2 - 2 * F.atan(F.exp((F.lit(self.y0) - y) / self._scale))
        return _wrap(F.degrees((x - self.x0) / self._scale) + self.lon0), F.degrees(_from_conformal(chi))


@dataclass(frozen=True)
class PolarStereographic:
    """True scale at ``lat0``, whose sign picks the pole."""

    lon0: float
    lat0: float
    x0: float = 0.0
    y0: float = 0.0

    @property
    def _south(self) -> int:
        return -1 if self.lat0 < 0 else 1

    @property
    def _scale(self) -> float:
        p = math.radians(abs(self.lat0))
        if p > math.pi / 2 - 1e-10:
            return 2 * A / math.sqrt((1 + E) ** (1 + E) * (1 - E) ** (1 - E))
        s = E * math.sin(p)
        t = math.tan(math.pi / 4 - p / 2) / ((1 - s) / (1 + s)) ** (E / 2)
        return A * math.cos(p) / math.sqrt(1 - s * s) / t

    def forward(self, lon: Column, lat: Column) -> tuple[Column, Column]:
        k, turn = self._south, F.radians(_wrap(lon - self.lon0))
        rho = self._scale * _t(F.radians(lat) * k)
        return rho * F.sin(turn) + self.x0, F.lit(self.y0) - k * rho * F.cos(turn)

    def inverse(self, x: Column, y: Column) -> tuple[Column, Column]:
        k, dx, dy = self._south, x - self.x0, y - self.y0
        chi = math.pi / 2 - 2 * F.atan(F.hypot(dx, dy) / self._scale)
        return _wrap(F.degrees(F.atan2(dx, -k * dy)) + self.lon0), k * F.degrees(_from_conformal(chi))


@dataclass(frozen=True)
class Utm:
    zone: int
    south: bool = False

    @classmethod
    def at(cls, lon: float, lat: float) -> Utm:
        return cls(min(int((lon + 180) // 6) + 1, 60), lat < 0)

    @property
    def lon0(self) -> float:
        return 6.0 * self.zone - 183.0

    @property
    def _north0(self) -> float:
        return 1e7 if self.south else 0.0

    def forward(self, lon: Column, lat: Column) -> tuple[Column, Column]:
        p, k0 = F.radians(lat), 0.9996
        n = A / F.sqrt(1 - E2 * F.sin(p) * F.sin(p))
        ep = E2 / (1 - E2)
        t, c, a = F.tan(p) * F.tan(p), ep * F.cos(p) * F.cos(p), F.radians(_wrap(lon - self.lon0)) * F.cos(p)
        m = A * (
            (1 - E2 / 4 - 3 * E2**2 / 64 - 5 * E2**3 / 256) * p - (3 * E2 / 8 + 3 * E2**2 / 32 + 45 * E2**3 / 1024) * F.sin(2 * p)
            + (15 * E2**2 / 256 + 45 * E2**3 / 1024) * F.sin(4 * p) - (35 * E2**3 / 3072) * F.sin(6 * p)
        )
        x = k0 * n * (a + (1 - t + c) * a * a * a / 6 + (5 - 18 * t + t * t + 72 * c - 58 * ep) * F.pow(a, F.lit(5)) / 120) + 500000.0
        y = k0 * (m + n * F.tan(p) * (a * a / 2 + (5 - t + 9 * c + 4 * c * c) * F.pow(a, F.lit(4)) / 24 + (61 - 58 * t + t * t + 600 * c - 330 * ep) * F.pow(a, F.lit(6)) / 720))
        return x, y + self._north0

    def inverse(self, x: Column, y: Column) -> tuple[Column, Column]:
        k0, ep = 0.9996, E2 / (1 - E2)
        mu = (y - self._north0) / (k0 * A * (1 - E2 / 4 - 3 * E2**2 / 64 - 5 * E2**3 / 256))
        e1 = (1 - math.sqrt(1 - E2)) / (1 + math.sqrt(1 - E2))
        p = mu + (3 * e1 / 2 - 27 * e1**3 / 32) * F.sin(2 * mu) + (21 * e1**2 / 16 - 55 * e1**4 / 32) * F.sin(4 * mu) + (151 * e1**3 / 96) * F.sin(6 * mu) + (1097 * e1**4 / 512) * F.sin(8 * mu)
        c, t, w = ep * F.cos(p) * F.cos(p), F.tan(p) * F.tan(p), 1 - E2 * F.sin(p) * F.sin(p)
        n, r = A / F.sqrt(w), A * (1 - E2) / F.pow(w, F.lit(1.5))
        d = (x - 500000.0) / (n * k0)
        lat = p - n * F.tan(p) / r * (d * d / 2 - (5 + 3 * t + 10 * c - 4 * c * c - 9 * ep) * F.pow(d, F.lit(4)) / 24 + (61 + 90 * t + 298 * c + 45 * t * t - 252 * ep - 3 * c * c) * F.pow(d, F.lit(6)) / 720)
        lon = (d - (1 + 2 * t + c) * d * d * d / 6 + (5 - 2 * c + 28 * t - 3 * c * c + 8 * ep + 24 * t * t) * F.pow(d, F.lit(5)) / 120) / F.cos(p)
        return _wrap(F.degrees(lon) + self.lon0), F.degrees(lat)
