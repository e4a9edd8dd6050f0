"""Position and tide text as DataFrames, where lines that do not parse are left out, and text files of series, tides and points."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

_WHOLE = r"\s*([-+]?\d++)"
_REAL = r"\s*([-+]?(?:\d++\.?\d*+|\.\d++)(?:[eE][-+]?\d++)?)"
#: Formats of the two fixed tide layouts.
JULIAN_TIDE, DATED_TIDE = "J h m T", "D/M/Y h:m T"


def parse_gga(line: Column) -> Column:
    """A GGA sentence as struct (epoch: seconds of the day, lon, lat: degrees), null if it is none or a number is missing."""
    part = F.split(line, ",")
    number = lambda i: F.get(part, F.lit(i)).try_cast("double")

    def degrees(i: int, minus: str) -> Column:
        whole = F.floor(number(i) / 100)
        d = whole + (number(i) - whole * 100) / 60
        return F.when(F.get(part, F.lit(i + 1)).startswith(minus), -d).otherwise(d)

    t = number(1)
    hour = F.floor(t / 10000)
    minute = F.floor((t - hour * 10000) / 100)
    epoch, lat, lon = (hour * 60 + minute) * 60 + (t - hour * 10000 - minute * 100), degrees(2, "S"), degrees(4, "W")
    good = line.rlike(r"^\$..GGA,") & epoch.isNotNull() & lon.isNotNull() & lat.isNotNull()
    return F.when(good, F.struct(epoch.alias("epoch"), lon.alias("lon"), lat.alias("lat")))


def tide_pattern(fmt: str) -> tuple[str, list[str]]:
    """The regular expression of a tide format and its fields in order.

    Y, M, D, J (day of the year), h, m, s and T (tide) are fields, ``*`` is a word to skip, blanks match any
    blanks and other characters stand for themselves. Hour, minute, tide and a month with day or a day of the year are needed.
    """
    out, fields = ["^"], []
    for c in fmt:
        if c in "YMDJhmsT":
            if c in fields:
                raise ValueError(f"{c} given twice in {fmt!r}")
            fields.append(c)
            out.append(_REAL if c == "T" else _WHOLE)
        else:
            out.append(r"\s*\S++" if c == "*" else r"\s*" if c.isspace() else re.escape(c))
    if not {"h", "m", "T"} <= set(fields) or not ("J" in fields or {"M", "D"} <= set(fields)):
        raise ValueError(f"{fmt!r} lacks a date, hour, minute or tide")
    return "".join(out), fields


def parse_tide(line: Column, fmt: str, year: int | None = None) -> Column:
    """A tide line as struct (epoch: UTC seconds, tide), null if it does not match or names no such day.

    ``year`` serves formats without Y; years of two digits up to 70 are 20xx, later ones 19xx.
    """
    pattern, fields = tide_pattern(fmt)
    if "Y" not in fields and year is None:
        raise ValueError("a format without Y needs a year")
    field = lambda c, kind="int": F.regexp_extract(line, pattern, fields.index(c) + 1).try_cast(kind) if c in fields else F.lit(0)
    y = field("Y") if "Y" in fields else F.lit(year)
    y = F.when(y > 99, y).when(y > 70, y + 1900).otherwise(y + 2000)
    if "J" in fields:
        day = F.unix_date(F.format_string("%04d-01-01", y).try_cast("date")) + field("J") - 1
    else:
        day = F.unix_date(F.format_string("%04d-%02d-%02d", y, field("M"), field("D")).try_cast("date"))
    epoch = day.cast("long") * 86400 + field("h") * 3600 + field("m") * 60 + field("s")
    tide = field("T", "double")
    return F.when(line.rlike(pattern) & epoch.isNotNull() & tide.isNotNull(), F.struct(epoch.alias("epoch"), tide.alias("tide")))


def _lines(spark: SparkSession, paths: str | list[str], parsed) -> DataFrame:
    return spark.read.text(paths).select(parsed(F.col("value")).alias("p")).where("p is not null").select("p.*")


def read_gga(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    return _lines(spark, paths, parse_gga)


def read_tides(spark: SparkSession, paths: str | list[str], fmt: str, year: int | None = None) -> DataFrame:
    """ts, tide of every line of the files that parses."""
    t = _lines(spark, paths, lambda c: parse_tide(c, fmt, year))
    return t.select(F.timestamp_seconds("epoch").alias("ts"), "tide")


def tide_lines(t: DataFrame, fmt: str) -> DataFrame:
    """Tides (ts, tide) as lines (``value``) of a format of :func:`tide_pattern`; what it skips with ``*`` is written as 0."""
    tide_pattern(fmt)
    two = lambda c: F.lpad(c.cast("string"), 2, "0")
    ts = F.col("ts")
    field = {
        "Y": F.lpad(F.year(ts).cast("string"), 4, "0"), "M": two(F.month(ts)), "D": two(F.dayofmonth(ts)), "J": F.lpad(F.dayofyear(ts).cast("string"), 3, "0"),
        "h": two(F.hour(ts)), "m": two(F.minute(ts)), "s": two(F.floor(F.second(ts))), "T": F.format_string("%.3f", F.col("tide").cast("double")), "*": F.lit("0"),
    }
    return t.where("ts is not null and tide is not null").select(F.concat(*[field.get(c, F.lit(c)) for c in fmt]).alias("value"))


def series_lines(t: DataFrame, values: list[str], key: str = "k") -> DataFrame:
    """A series (key, ts, values) as lines of number, epoch and values, numbered within each key in the order of time."""
    w = Window.partitionBy(key).orderBy("ts")
    numbers = [F.format_string("%g", F.col(v).cast("double")) for v in values]
    return t.select(key, F.concat_ws(" ", (F.row_number().over(w) - 1).cast("string"), F.format_string("%.3f", F.unix_micros("ts") / 1e6), *numbers).alias("value"))


#: The column that colours points in a point file, by what it shows.
POINT_COLOURS = {"depth": "3 AS_HEIGHT", "range": "5", "beam": "6", "file": "7"}


def point_file(t: DataFrame, colour: str = "depth") -> tuple[str, DataFrame]:
    """Soundings (east, north, depth, dz, range, beam, file_id, backscatter) as a point file: its header and its lines (``value``), relative to the middle of the
    points and a metre below the deepest. Soundings at the very origin have no position and are left out; one aggregation finds the extent."""
    t = t.where("not (east = 0 and north = 0)")
    r = t.agg(F.count("*").alias("n"), *[f(c).alias(f"{n}_{c}") for c in ("east", "north", "depth") for n, f in (("lo", F.min), ("hi", F.max))]).first()
    x, y, z = ((r.hi_east or 0) + (r.lo_east or 0)) / 2, ((r.hi_north or 0) + (r.lo_north or 0)) / 2, (r.lo_depth or 0) - 1
    head = (
        f"BEGIN DATA_POINTS 1.0\nN_RECORDS {r.n}\nN_COLUMNS 8\nXYZ\nCOLOR ATTRIBUTE {POINT_COLOURS[colour]}\nGLYPH UCUBE\nDROP_LINE OFF\n"
        f"SIZE COLUMNS XYZK 4 4 4 1.96\nTEXT NONE\nDEGRADATION NTH\nLOCAL_ORIGIN {x:f} {y:f} {z:f}\n"
    )
    number = lambda c: F.format_string("%.3f", c.cast("double"))
    own = [F.col("east") - x, F.col("north") - y, F.col("depth") - z, F.sqrt("dz"), F.col("range")]
    return head, t.select(F.concat_ws(" ", *map(number, own), *[F.col(c).cast("string") for c in ("beam", "file_id", "backscatter")]).alias("value"))


def find_files(spark: SparkSession, folder: str, suffix: str) -> DataFrame:
    """Paths and sizes of the files below a folder whose names end with ``suffix``, by any file system Spark can list; contents are not read."""
    t = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", f"*{suffix}").load(folder)
    return t.select("path", "length")


def name_list(spark: SparkSession, path: str, prefix: str = "") -> list[str]:
    """File names out of a list file, one in a line, with a folder put before those that are not absolute; blank lines and comments are skipped. A list of lines of one survey goes to the driver."""
    names = [r.value.strip() for r in spark.read.text(path, wholetext=False).collect()]
    return [n if n.startswith("/") or ":" in n or not prefix else f"{prefix.rstrip('/')}/{n}" for n in names if n and not n.startswith("#")]
