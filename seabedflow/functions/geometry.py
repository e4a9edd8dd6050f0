"""Beam positions on the ellipsoid and the small formulas of survey planning and attribution, as column expressions."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .params import CI95
from .projections import A, FLAT

_B = A * (1 - FLAT)
_EP2 = (A * A - _B * _B) / (_B * _B)


def arc_end(t: DataFrame, lon: Column, lat: Column, length: Column, azimuth: Column, names: tuple[str, str] = ("b_lon", "b_lat"), rounds: int = 8) -> DataFrame:
    """``t`` with the end of a geodesic: degrees for positions, metres, radians from north (direct problem, Vincenty 1975).

    The fixed number of rounds is ample: each shrinks the error by about 300. Null in, null out.
    """
    c = F.col
    t = t.withColumns({"_lon": F.radians(lon), "_u": F.atan((1 - FLAT) * F.tan(F.radians(lat))), "_len": length.cast("double"), "_az": azimuth})
    t = t.withColumns({"_su": F.sin("_u"), "_cu": F.cos("_u"), "_ca": F.cos("_az")}).withColumn("_sa", c("_cu") * F.sin("_az"))
    t = t.withColumns({"_s1": F.atan2(c("_su"), c("_cu") * c("_ca")), "_c2": 1 - c("_sa") * c("_sa")}).withColumn("_w", c("_c2") * _EP2)
    w = c("_w")
    t = t.withColumn("_bb", w / 1024 * (256 + w * (-128 + w * (74 - 47 * w))))
    t = t.withColumn("_sig0", c("_len") / (_B * (1 + w / 16384 * (4096 + w * (-768 + w * (320 - 175 * w))))))

    def closer(sig: Column, _: Column) -> Column:
        m, b = F.cos(2 * c("_s1") + sig), c("_bb")
        tail = b / 6 * m * (4 * F.sin(sig) * F.sin(sig) - 3) * (4 * m * m - 3)
        return c("_sig0") + b * F.sin(sig) * (m + b / 4 * (F.cos(sig) * (2 * m * m - 1) - tail))

    t = t.withColumn("_sig", F.aggregate(F.array_repeat(F.lit(0), rounds), c("_sig0"), closer))
    s, k = F.sin("_sig"), F.cos("_sig")
    north = c("_su") * k + c("_cu") * s * c("_ca")
    across = c("_su") * s - c("_cu") * k * c("_ca")
    turn = F.atan2(s * F.sin("_az"), c("_cu") * k - c("_su") * s * c("_ca"))
    q = FLAT / 16 * c("_c2") * (4 + FLAT * (4 - 3 * c("_c2")))
    m = F.cos(2 * c("_s1") + c("_sig"))
    fix = (1 - q) * FLAT * c("_sa") * (c("_sig") + q * s * (m + q * k * (2 * m * m - 1)))
    t = t.withColumns({names[0]: F.degrees(c("_lon") + turn - fix), names[1]: F.degrees(F.atan2(north, (1 - FLAT) * F.sqrt(c("_sa") * c("_sa") + across * across)))})
    return t.drop("_lon", "_u", "_len", "_az", "_su", "_cu", "_ca", "_sa", "_s1", "_c2", "_w", "_bb", "_sig0", "_sig")


def locate_points(t: DataFrame, ahead: Column, starboard: Column, heading: Column, lon: Column, lat: Column, names: tuple[str, str] = ("b_lon", "b_lat")) -> DataFrame:
    """Positions of points given by metres ahead and to starboard of a place with a heading in degrees.

    A point straight ahead counts like any other; without a position the result is null.
    """
    return arc_end(t, lon, lat, F.hypot(ahead, starboard), F.radians(heading) + F.atan2(starboard, ahead), names)


def locate_beams(t: DataFrame, proj, ahead: Column, starboard: Column, heading: Column, lon: Column, lat: Column) -> DataFrame:
    """The same in the coordinates of a projection: columns east and north."""
    g = locate_points(t, ahead, starboard, heading, lon, lat, ("_b_lon", "_b_lat"))
    x, y = proj.forward(F.col("_b_lon"), F.col("_b_lat"))
    return g.withColumns({"east": x, "north": y}).drop("_b_lon", "_b_lat")


def slant_range(depth: Column, de: Column, dn: Column) -> Column:
    return F.sqrt(depth * depth + de * de + dn * dn)


def depth_thresholds(beamwidth: float, spacings: Sequence[float]) -> list[float]:
    """Depths in metres at which the footprint of a beam (degrees) is as wide as the grid spacing."""
    return [0.5 * dx / math.tan(math.radians(beamwidth) / 2) for dx in spacings]


def prior_variance(z: Column, value: float, percent: bool) -> Column:
    """Variance of an initial surface: ``value`` squared, or from ``value`` percent of depth at 95 % confidence."""
    return F.when(z.isNotNull(), F.pow(z * (value / (100 * CI95)), F.lit(2.0)) if percent else F.lit(float(value) ** 2))


def interpolation_variance(z: Sequence[Column], v: Sequence[Column], u: Column, w: Column, var_h: Column, sx: float, sy: float) -> Column:
    """Variance of a depth interpolated between NW, NE, SW and SE nodes, at fractions ``u`` east of the west and ``w`` north of
    the south nodes: that of the nodes by their weights, and the horizontal variance through the slopes along and across."""
    nw, ne, sw, se = z
    weights = ((1 - u) * w, u * w, (1 - u) * (1 - w), u * (1 - w))
    own = sum((k * k * x for k, x in zip(weights, v, strict=True)), F.lit(0.0))
    east = (ne - nw) * w + (se - sw) * (1 - w)
    north = (ne - se) * u + (nw - sw) * (1 - u)
    return own + var_h * (east * east / sx**2 + north * north / sy**2)


def packed_time(date: Column, millis: Column) -> Column:
    """Epoch seconds of a date YYYYMMDD and milliseconds of the day; null if there is no such day."""
    day = F.try_to_timestamp(F.lpad(date.cast("string"), 8, "0"), F.lit("yyyyMMdd")).cast("date")
    return F.unix_date(day) * 86400.0 + millis / 1000


def stamp_time(text: Column) -> Column:
    """Epoch seconds of ``YYYY/MM/DD:hh:mm:ss``, null if the text is none."""
    return F.unix_seconds(F.try_to_timestamp(text, F.lit("yyyy/M/d:H:m:s"))).cast("double")


def time_fields(epoch: Column) -> Column:
    """Struct (year, month, day, yday, hour, minute, second, msec) in UTC of epoch seconds."""
    day = F.date_from_unix_date(F.floor(epoch / 86400).cast("int"))
    s = epoch - F.floor(epoch / 86400) * 86400
    parts = {"year": F.year(day), "month": F.month(day), "day": F.day(day), "yday": F.dayofyear(day), "hour": F.floor(s / 3600).cast("int"), "minute": F.floor(s % 3600 / 60).cast("int"), "second": F.floor(s % 60).cast("int")}
    return F.struct(*[v.alias(k) for k, v in parts.items()], ((s - F.floor(s)) * 1000).alias("msec"))
