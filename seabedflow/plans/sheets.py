"""The catalogue of sheets: their text description, construction by longitude and latitude, outlines, and planning sheets by depth."""

from __future__ import annotations

import math
import re
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import projections as M
from ..functions.bounds import Bounds
from ..functions.params import SheetSpec, parse_config, parse_unit
from ..operators import surfaces as S

_PAIR = re.compile(r"\(([^()]*)\)\s*(\w*)")


def _numbers(text: str, unit: str = "length") -> list[float]:
    """``(1, 2) m`` or ``(1 m, 2 km)`` as metres; degrees stay what they are."""
    m = _PAIR.search(text)
    if not m:
        raise ValueError(f"no list of numbers: {text!r}")
    out = []
    for part in m[1].split(","):
        words = part.split()
        own = words[1] if len(words) > 1 else m[2]
        out.append(float(words[0]) if own in ("", "deg") else parse_unit(f"{words[0]} {own}", unit))
    return out


def parse_sheet(text: str) -> tuple[SheetSpec, object]:
    """A sheet description -> sheet and projection. Nodes are given by bounds (west, south, east, north), by centre with width and height, or by
    width and height in nodes with the north-west corner (``location``); an origin is needed for the projection (utm or mercator)."""
    flat = {k.removeprefix("sheet."): v for k, v in parse_config(text).items() if k.startswith("sheet.")}
    lon, lat = _numbers(flat["projection.origin"])[:2]
    kind = flat.get("projection.type", "utm")
    if kind not in ("utm", "mercator"):
        raise ValueError(f"projection {kind!r} is not known")
    proj = M.Utm.at(lon, lat) if kind == "utm" else M.Mercator(lon, lat)
    dx, dy = _numbers(flat["spacing"])
    if "bounds" in flat:
        return SheetSpec.from_bounds(*_numbers(flat["bounds"]), dx, dy), proj
    width, height = (parse_unit(flat[k], "length") for k in ("width", "height"))
    if "center" in flat:
        return SheetSpec.from_center(*_numbers(flat["center"]), width, height, dx, dy), proj
    x0, y0 = _numbers(flat["location"])
    return SheetSpec(x0, y0, dx, dy, int(width / dx) + 1, int(height / dy) + 1), proj


def sheet_text(s: SheetSpec, lon: float, lat: float, kind: str = "utm") -> str:
    """The description that :func:`parse_sheet` reads."""
    x1, y1 = s.x0 + (s.cols - 1) * s.dx, s.y0 - (s.rows - 1) * s.dy
    return (
        f"sheet {{\n\tprojection {{\n\t\ttype {kind};\n\t\torigin ({lon:.6f}, {lat:.6f}) deg;\n\t}}\n"
        f"\tbounds ({s.x0:.2f} m, {y1:.2f} m, {x1:.2f} m, {s.y0:.2f} m);\n\tspacing ({s.dx:.2f}, {s.dy:.2f}) m;\n}}\n"
    )


def _projected(spark: SparkSession, proj, points: Sequence[tuple[float, float]]) -> list[tuple[float, float]]:
    x, y = proj.forward(F.col("lon"), F.col("lat"))
    rows = spark.createDataFrame([(i, *map(float, p)) for i, p in enumerate(points)], "i int, lon double, lat double").select("i", x.alias("x"), y.alias("y"))
    return [(r.x, r.y) for r in sorted(rows.collect())]


def sheet_by_lonlat_center(spark: SparkSession, proj, lon: float, lat: float, width: float, height: float, dx: float, dy: float) -> SheetSpec:
    return SheetSpec.from_center(*_projected(spark, proj, [(lon, lat)])[0], width, height, dx, dy)


def sheet_by_lonlat_bounds(spark: SparkSession, proj, left: float, bottom: float, right: float, top: float, dx: float, dy: float) -> SheetSpec:
    (x0, y0), (x1, y1) = _projected(spark, proj, [(left, bottom), (right, top)])
    return SheetSpec.from_bounds(x0, y0, x1, y1, dx, dy)


def sheet_bounds(s: SheetSpec) -> Bounds:
    return Bounds(s.x0, s.y0 - (s.rows - 1) * s.dy, s.x0 + (s.cols - 1) * s.dx, s.y0)


def contains(s: SheetSpec, x: float, y: float) -> bool:
    return sheet_bounds(s).contains(x, y)


def sheet_info(s: SheetSpec, name: str = "sheet") -> dict[str, object]:
    """What a listing of sheets shows."""
    b = sheet_bounds(s)
    return {"name": name, "cols": s.cols, "rows": s.rows, "dx": s.dx, "dy": s.dy, "west": b.min_x, "south": b.min_y, "east": b.max_x, "north": b.max_y, "area_km2": (b.max_x - b.min_x) * (b.max_y - b.min_y) / 1e6}


def outlines(sheets: Sequence[SheetSpec], step: float = 1.0) -> str:
    """Closed outlines of sheets as lines of x, y and z, relative to their common south-west corner; each lies ``step`` above the one before."""
    every = Bounds()
    for s in sheets:
        every = every.union(sheet_bounds(s))
    out = [f"BEGIN DATA_LINES 1.0\nN_RECORDS {len(sheets)}\nN_COLUMNS 3\nXYZ\nCOLOR CONSTANT CODE R\nLINE ON\nTUBE OFF\nSIZE CONSTANT 2\nTEXT NONE\nDEGRADATION FACETS\nLOCAL_ORIGIN {every.min_x:.2f} {every.min_y:.2f} 0.0\n"]
    for i, s in enumerate(sheets):
        b = sheet_bounds(s)
        corners = [(b.min_x, b.min_y), (b.min_x, b.max_y), (b.max_x, b.max_y), (b.max_x, b.min_y), (b.min_x, b.min_y)]
        out.append("NEW 5\n" + "".join(f"{x - every.min_x:.2f} {y - every.min_y:.2f} {i * step:.2f}\n" for x, y in corners))
    return "".join(out)


def stencil(mask: DataFrame, base: SheetSpec, s: SheetSpec, value: int = 255) -> DataFrame:
    """``mask`` (row, col, v) over ``base`` with the outline of another sheet burnt in."""
    b = sheet_bounds(s)
    clamp = lambda v, n: min(max(int(v), 0), n - 1)
    west, east = (clamp((x - base.x0) / base.dx, base.cols) for x in (b.min_x, b.max_x))
    north, south = (clamp((base.y0 - y) / base.dy, base.rows) for y in (b.max_y, b.min_y))
    r, c = F.col("row"), F.col("col")
    sides = (r.between(north, south - 1) & c.isin(west, east)) | (c.between(west, east - 1) & r.isin(north, south))
    return mask.withColumn("v", F.when(sides, F.lit(value)).otherwise(F.col("v")))


def scaled_mask(mask: DataFrame, base: SheetSpec, sheet: SheetSpec) -> DataFrame:
    """The mask value of the cell of ``base`` that each node of ``sheet`` lies in, 0 (active) outside it or where it has none. One join on the cell of the mask."""
    spark = mask.sparkSession
    t = spark.range(sheet.rows * sheet.cols).select((F.col("id") / sheet.cols).cast("int").alias("row"), (F.col("id") % sheet.cols).cast("int").alias("col"))
    c, r = (sheet.node_x() - base.x0) / base.dx, (F.lit(base.y0) - sheet.node_y()) / base.dy
    inside = c.between(0, base.cols - 1) & r.between(0, base.rows - 1)
    t = t.select("row", "col", F.when(inside, F.floor(r).cast("int")).alias("mr"), F.when(inside, F.floor(c).cast("int")).alias("mc"))
    m = mask.select(F.col("row").alias("mr"), F.col("col").alias("mc"), "v")
    return t.join(m, ["mr", "mc"], "left").select("row", "col", F.coalesce("v", F.lit(0)).alias("v"))


def covering(left: float, bottom: float, right: float, top: float, spacing: float) -> SheetSpec:
    """The least sheet that covers a rectangle from its south-west corner; node counts are odd, so it may reach up to two nodes beyond."""
    wide, high = (math.ceil((b - a) / (2 * spacing) - 1e-9) * 2 * spacing for a, b in ((left, right), (bottom, top)))
    return SheetSpec.from_bounds(left, bottom, left + wide, bottom + high, spacing, spacing)


def component_sheets(active: DataFrame, whole: SheetSpec, spacing: float, size: int, slop: float = 0.1) -> list[SheetSpec]:
    """Sheets of about ``size`` x ``size`` nodes of ``spacing`` metres that cover the active cells (row, col, v = 0) of ``whole``.

    An area that fits one sheet with ``slop`` to spare is one sheet. Otherwise it is cut into equal parts, each shrunk to its active cells; parts without any
    are left out. One aggregation finds the extents of all parts, and the driver sees one row for each.
    """
    width, height = (whole.cols - 1) * whole.dx, (whole.rows - 1) * whole.dy
    cols, rows = int(width // spacing) + 1, int(height // spacing) + 1
    bottom = whole.y0 - height
    if max(cols, rows) < (1 + slop) * size:
        return [covering(whole.x0, bottom, whole.x0 + width, whole.y0, spacing)]

    def parts(n: int) -> tuple[int, float]:
        k = max(1, n // size)
        k += n / k > (1 + slop) * size
        return k, math.ceil(n / k) * spacing

    (n_cols, part_w), (n_rows, part_h) = parts(cols), parts(rows)
    x, y = F.col("col") * whole.dx, (whole.rows - 1 - F.col("row")) * whole.dy
    t = active.where("v = 0").select(F.least(F.floor(x / part_w), F.lit(n_cols - 1)).alias("pc"), F.least(F.floor(y / part_h), F.lit(n_rows - 1)).alias("pr"), x.alias("x"), y.alias("y"))
    got = t.groupBy("pr", "pc").agg(F.min("x").alias("x0"), F.max("x").alias("x1"), F.min("y").alias("y0"), F.max("y").alias("y1")).orderBy("pr", "pc").collect()
    out = []
    for r in got:
        west, east = whole.x0 + r.x0, whole.x0 + min(r.x1 + whole.dx, (r.pc + 1) * part_w, width)
        south, north = bottom + r.y0, bottom + min(r.y1 + whole.dy, (r.pr + 1) * part_h, height)
        out.append(covering(west, south, east, north, spacing))
    return out


def plan_sheets(depth: DataFrame, whole: SheetSpec, thresholds: Sequence[float], spacings: Sequence[float], size: int, context: float = 0.0, slop: float = 0.1) -> dict[float, list[SheetSpec]]:
    """Sheets for each spacing: the finest covers depths down to the first of ``thresholds`` (positive down), the next ones those between two, the last all that is deeper.
    The active cells of each level, grown by ``context`` metres, begin with a clear mask."""
    out, upper = {}, [*thresholds[: len(spacings) - 1], math.inf]
    down = -F.col("z")
    grow = int((context + 0.5) / whole.dx) | 1
    for i, (limit, spacing) in enumerate(zip(upper, spacings, strict=True)):
        least = upper[i - 1] if i else -math.inf
        here = depth.where("z is not null").select("row", "col", ((down > least) & (down <= limit)).cast("int").alias("v"))
        here = S.dilate(here, grow) if grow > 1 else here
        out[spacing] = component_sheets(here.select("row", "col", (1 - F.col("v")).alias("v")).where("v = 0"), whole, spacing, size, slop) if here.where("v = 1").limit(1).count() else []
    return out
