"""Surface algebra, neighbourhood filters, morphology, resampling and blobs on cells (row, col, z).

A neighbourhood sends each cell's value to the cells around it and aggregates there: one shuffle on the cell, with partial
sums before it, and no self-join. A null value is no value, as if the cell were not there; a cell is expected once; an empty surface gives an empty one.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.params import SheetSpec
from ..plans.store import shared_table as durable
from .graph import components

CELL = ("row", "col")


def spread(t: DataFrame, offsets: Sequence[tuple[int, int, float]], *values: str) -> DataFrame:
    """Send ``values`` to (row + dr, col + dc) with weight ``k``; offset (0, 0) marks the cell itself."""
    o = F.array(*[F.struct(F.lit(dr).alias("dr"), F.lit(dc).alias("dc"), F.lit(float(k)).alias("k")) for dr, dc, k in offsets])
    t = t.select(*CELL, *values, F.explode(o).alias("o"))
    return t.select((F.col("row") + F.col("o.dr")).alias("row"), (F.col("col") + F.col("o.dc")).alias("col"), *values, F.col("o.k").alias("k"), ((F.col("o.dr") == 0) & (F.col("o.dc") == 0)).alias("own"))


def square(half: int) -> list[tuple[int, int, float]]:
    return [(r, c, 1.0) for r in range(-half, half + 1) for c in range(-half, half + 1)]


def disc(size: int) -> list[tuple[int, int, float]]:
    half = size // 2
    return [(r, c, 1.0) for r in range(-half, half + 1) for c in range(-half, half + 1) if r * r + c * c <= half * half]


def around(t: DataFrame, half: int) -> DataFrame:
    """z, mean and number of the neighbours without the cell itself; cells without a value of their own have null z."""
    s = spread(t.where("z is not null"), square(half), "z")
    other = F.when(~F.col("own"), F.col("z"))
    return s.groupBy(*CELL).agg(F.max(F.when(F.col("own"), F.col("z"))).alias("z"), F.avg(other).alias("m"), F.count(other).alias("n"))


def slope(dx: float) -> Column:
    return F.when(F.col("n") == 0, F.lit(math.pi / 2)).otherwise(F.atan(F.abs(F.col("z") - F.col("m")) / dx))


def spike_angle(t: DataFrame, half: int, dx: float) -> DataFrame:
    return around(t, half).where("z is not null").select(*CELL, slope(dx).alias("angle"))


def despike(t: DataFrame, half: int, dx: float, max_angle: float, sheet: SheetSpec, deep_only: bool = False) -> DataFrame:
    """Cells steeper than ``max_angle`` (radians) against their neighbours become null, as do isolated cells and those within ``half`` cells of the sheet's border."""
    a = around(t, half).where("z is not null")
    steep = F.abs(F.col("z") - F.col("m")) / dx > math.tan(max_angle)
    steep = steep & (F.col("z") < F.col("m")) if deep_only else steep
    inner = F.col("row").between(half, sheet.rows - 1 - half) & F.col("col").between(half, sheet.cols - 1 - half)
    return a.select(*CELL, F.when(inner & (F.col("n") > 0) & ~steep, F.col("z")).alias("z"))


def clip(t: DataFrame, limit: float, flip: bool = False) -> DataFrame:
    """Values above ``limit`` become null; with ``flip`` those below."""
    z = F.col("z")
    return t.select(*CELL, F.when(z >= limit if flip else z <= limit, z).alias("z"))


def threshold(t: DataFrame, limit: float, flip: bool = False) -> DataFrame:
    """Mask ``v``: 1 above ``limit`` and 0 elsewhere; with ``flip`` the other way round. Null counts as not above."""
    above = F.coalesce(F.col("z") > limit, F.lit(False))
    return t.select(*CELL, (~above if flip else above).cast("int").alias("v"))


def mask_edges(t: DataFrame, spacing: float, width: float) -> DataFrame:
    """Null where opening the mask of cells below zero by a disc about ``width`` metres wide leaves nothing: thin edges and specks."""
    size = int((width + 0.5) / spacing) | 1
    mask = dilate(erode(threshold(t, 0.0, flip=True), size), size)
    return t.join(mask, list(CELL)).select(*CELL, F.when(F.col("v") == 1, F.col("z")).alias("z"))


def magnitude(t: DataFrame) -> DataFrame:
    return t.select(*CELL, F.abs("z").alias("z"))


def check_geometry(a: SheetSpec, b: SheetSpec) -> None:
    """Raise unless two surfaces lie on the same nodes."""
    if a != b:
        raise ValueError(f"surfaces are not compatible: {a} and {b}")


def remap_unsigned(t: DataFrame, value: str = "v") -> tuple[DataFrame, int, float, int]:
    """Whole numbers as the smallest unsigned type that holds them: the table with ``value`` remapped, bits (8 or 16), scale and shift (new = scale * (old - shift)).

    Shifted only if the plain values do not fit, scaled only if the shifted ones do not either. One aggregation finds the range.
    """
    r = t.agg(F.min(value).alias("lo"), F.max(value).alias("hi")).first()
    lo, hi = r.lo or 0, r.hi or 0
    if hi < 65535:
        bits, scale, shift = (8 if hi < 255 else 16), 1.0, 0
    elif hi - lo < 65535:
        bits, scale, shift = (8 if hi - lo < 255 else 16), 1.0, lo
    else:
        bits, scale, shift = 16, 65535.0 / (hi - lo), lo
    return t.withColumn(value, F.floor(scale * (F.col(value) - shift)).cast("int")), bits, scale, shift


def rgb(hue: Column, saturation: Column, value: Column) -> Column:
    """Struct (r, g, b) of 0 to 255 for a hue in degrees; greys without saturation."""
    h = F.pmod(hue, F.lit(360.0)) / 60
    i, f = F.floor(h), h - F.floor(h)
    p, q, u = value * (1 - saturation), value * (1 - saturation * f), value * (1 - saturation * (1 - f))
    wheel = {"r": (value, q, p, p, u, value), "g": (u, value, value, q, p, p), "b": (p, p, u, value, value, q)}

    def byte(parts: Sequence[Column]) -> Column:
        return F.greatest(F.lit(0), F.floor(F.element_at(F.array(*parts), (i + 1).cast("int")) * 255.999)).cast("int")

    return F.struct(*[byte(parts).alias(k) for k, parts in wheel.items()])


def colour_table(lo: float, hi: float, entries: int) -> list[tuple[float, float]]:
    """(depth, hue) of each entry: violet for the least depth to red for the greatest."""
    steps = max(1, entries - 1)
    return [(lo + (hi - lo) * k / steps, 300.0 - 300.0 * k / steps) for k in range(entries)]


def patch_surface(t: DataFrame, half: int) -> DataFrame:
    """Holes get the mean of their neighbours if more than 80 % of the places around hold one."""
    k = (2 * half + 1) ** 2
    a = around(t, half)
    return a.where((F.col("z").isNotNull()) | (F.col("n") > math.floor(0.8 * k))).select(*CELL, F.coalesce("z", "m").alias("z"))


def convolve(t: DataFrame, kernel: Sequence[tuple[int, int, float]]) -> DataFrame:
    """Weighted sum over the kernel where every place under it holds a value."""
    s = spread(t, [(-r, -c, k) for r, c, k in kernel], "z")
    return s.groupBy(*CELL).agg(F.sum(F.col("z") * F.col("k")).alias("z"), F.count("z").alias("n")).where(F.col("n") == len(kernel)).select(*CELL, "z")


def gauss_kernel(half: int) -> list[tuple[int, int, float]]:
    """Normalised, three standard deviations to the edge."""
    s = half / 3.0
    w = {(r, c): math.exp(-(r * r + c * c) / (2 * s * s)) for r, c, _ in square(half)}
    return [(r, c, k / sum(w.values())) for (r, c), k in w.items()]


def erode(mask: DataFrame, size: int) -> DataFrame:
    """``mask`` (row, col, v); places without a cell count as 0."""
    o = disc(size)
    s = spread(mask, o, "v").groupBy(*CELL).agg(F.sum("v").alias("s"), F.max("own").alias("here"))
    return s.where("here").select(*CELL, (F.col("s") == len(o)).cast("int").alias("v"))


def dilate(mask: DataFrame, size: int) -> DataFrame:
    s = spread(mask, disc(size), "v").groupBy(*CELL).agg(F.max("v").alias("v"), F.max("own").alias("here"))
    return s.where("here").select(*CELL, "v")


def combine(primary: DataFrame, secondary: DataFrame) -> DataFrame:
    return primary.join(secondary.withColumnRenamed("z", "z2"), list(CELL), "full").select(*CELL, F.coalesce("z", "z2").alias("z"))


def arithmetic(a: DataFrame, b: DataFrame, minus: bool) -> DataFrame:
    z = F.col("z") - F.col("z2") if minus else F.col("z") + F.col("z2")
    return a.join(b.withColumnRenamed("z", "z2"), list(CELL)).select(*CELL, z.alias("z"))


def percent_of_depth(diff: DataFrame, depth: DataFrame) -> DataFrame:
    return diff.join(depth.withColumnRenamed("z", "d"), list(CELL)).select(*CELL, (100 * F.col("z") / -F.col("d")).alias("pct"))


def histogram(t: DataFrame, width: float) -> DataFrame:
    """Density over bins from the least value on: slot, ordinate (its middle), n and pmf.

    There are (max - min) / width whole slots, or 65,536 if ``width`` is not positive, and they are widened to fill the range; the greatest value lies beyond
    the last slot and is not counted. Empty slots are listed. One row for each slot is summed, so the window holds no cells.
    """
    z = F.col("z")
    span = t.agg(F.min("z").alias("lo"), F.max("z").alias("hi"))
    slots = F.floor((F.col("hi") - F.col("lo")) / width).cast("long") if width > 0 else F.lit(1 << 16).cast("long")
    span = span.where("hi > lo").withColumn("slots", slots).where("slots > 0").withColumn("scale", F.col("slots") / (F.col("hi") - F.col("lo")))
    counted = t.where(z.isNotNull()).join(F.broadcast(span)).select(F.floor(F.col("scale") * (z - F.col("lo"))).alias("slot"), "slots").where("slot < slots").groupBy("slot").agg(F.count("*").alias("n"))
    every = span.select("lo", "scale", F.explode(F.sequence(F.lit(0).cast("long"), F.col("slots") - 1)).alias("slot"))
    h = every.join(counted, "slot", "left").select("slot", ((F.col("slot") + 0.5) / F.col("scale") + F.col("lo")).alias("ordinate"), F.coalesce("n", F.lit(0)).alias("n"), "scale")
    total = F.sum("n").over(Window.partitionBy())
    return h.select("slot", "ordinate", "n", (F.col("n") * F.col("scale") / F.when(total > 0, total)).alias("pmf"))


def bilinear(t: DataFrame, factor: int) -> DataFrame:
    """Resample to ``factor`` times as many nodes; a node is left out if a corner of its cell is missing."""
    s = spread(t, [(0, 0, 0), (0, -1, 1), (-1, 0, 2), (-1, -1, 3)], "z").groupBy(*CELL).agg(*[F.max(F.when(F.col("k") == i, F.col("z"))).alias(f"z{i}") for i in range(4)], F.count("*").alias("n")).where("n = 4")
    steps = F.sequence(F.lit(0), F.lit(factor - 1))
    s = s.withColumn("i", F.explode(steps)).withColumn("j", F.explode(steps))
    u, v = F.col("j") / factor, F.col("i") / factor
    z = (F.col("z0") * (1 - u) + F.col("z1") * u) * (1 - v) + (F.col("z2") * (1 - u) + F.col("z3") * u) * v
    return s.select((F.col("row") * factor + F.col("i")).alias("row"), (F.col("col") * factor + F.col("j")).alias("col"), z.alias("z"))


def capture_radii(depth: DataFrame, sheet: SheetSpec, limit: int = 10) -> DataFrame:
    """``reach`` of every cell of the sheet: 2.5 m and 2.5 % of its depth, or of the nearest shoalest depth less than ``limit`` rings away; 0 where there is none or it is above water."""
    spark = depth.sparkSession
    every = spark.range(sheet.rows * sheet.cols).select((F.col("id") / sheet.cols).cast("int").alias("row"), (F.col("id") % sheet.cols).cast("int").alias("col"))
    known = depth.where("z is not null").select(*CELL, "z")
    holes = every.join(known, list(CELL), "left_anti")
    z = known.unionByName(nearest_shoal(known, holes, limit - 1))
    t = every.join(z, list(CELL), "left")
    return t.select(*CELL, F.when(F.col("z") < 0, 2.5 - 0.025 * F.col("z")).otherwise(0.0).alias("reach"))


def coverage(soundings: DataFrame, depth: DataFrame, sheet: SheetSpec, limit: int = 10) -> DataFrame:
    """The shoalest of the soundings (east, north, depth) that lie within each cell's capture radius; cells without one are left out.

    A sounding goes to the cells its depth can reach and no farther than the greatest radius on the sheet, is held against their radii there, and partial maxima travel.
    Soundings without a place or depth are left out.
    """
    capture = durable(capture_radii(depth, sheet, limit), "capture")
    most = capture.agg(F.max("reach")).first()[0] or 0.0
    t = soundings.where("east is not null and north is not null and depth is not null").select("east", "north", "depth", *[c.alias(n) for c, n in zip(sheet.cell(F.col("east"), F.col("north")), ("r", "c"), strict=True)])
    t = t.where(F.col("r").between(0, sheet.rows) & F.col("c").between(0, sheet.cols))
    reach = F.least(5 * F.ceil((2.5 - 0.025 * F.col("depth")) / 5 + 1), F.lit(most))
    around = lambda at, step, n: F.sequence(F.greatest(F.col(at) - F.ceil(reach / step), F.lit(0)).cast("int"), F.least(F.col(at) + F.ceil(reach / step), F.lit(n - 1)).cast("int"))
    t = t.withColumn("row", F.explode(around("r", sheet.dy, sheet.rows))).withColumn("col", F.explode(around("c", sheet.dx, sheet.cols)))
    far2 = F.pow(F.col("east") - sheet.node_x(), F.lit(2.0)) + F.pow(F.col("north") - sheet.node_y(), F.lit(2.0))
    t = t.select(*CELL, "depth", far2.alias("far2")).where(F.col("far2") < most * most)
    hit = t.join(capture, list(CELL)).where("far2 < reach * reach")
    return hit.groupBy(*CELL).agg(F.max("depth").alias("z"))


def nearest_shoal(t: DataFrame, holes: DataFrame, limit: int) -> DataFrame:
    """For each hole the shoalest value of the nearest square ring that holds data, up to ``limit`` rings out."""
    offs = [(r, c, max(abs(r), abs(c))) for r in range(-limit, limit + 1) for c in range(-limit, limit + 1) if r or c]
    s = spread(t, offs, "z").join(holes.select(*CELL), list(CELL), "left_semi")
    return s.groupBy(*CELL).agg(F.max(F.struct((-F.col("k")).alias("near"), "z")).alias("b")).select(*CELL, F.col("b.z").alias("z"))


def blobs(mask: DataFrame) -> DataFrame:
    """4-connected components of cells with v = 1: (row, col, blob), blob = least row * 2^32 + col.

    Neighbours meet in joins on the cell, and components of the edges are found in a number of rounds that grows with the logarithm of the
    longest path; no task holds a row of the sheet.
    """
    t = mask.where("v = 1").select(*CELL).distinct()
    name = lambda r, c: F.col(r).cast("long") * (1 << 32) + F.col(c)
    steps = F.array(F.struct(F.lit(0).alias("dr"), F.lit(1).alias("dc")), F.struct(F.lit(1).alias("dr"), F.lit(0).alias("dc")))
    near = t.select(name("row", "col").alias("a"), "row", "col", F.explode(steps).alias("s"))
    near = near.select("a", (F.col("row") + F.col("s.dr")).alias("row"), (F.col("col") + F.col("s.dc")).alias("col"))
    edges = near.join(t, list(CELL)).select("a", name("row", "col").alias("b"))
    label = components(edges, "blobs")
    return t.withColumn("id", name("row", "col")).join(label, "id", "left").select(*CELL, F.coalesce("component", "id").alias("blob"))


def blob_stats(labelled: DataFrame, z: DataFrame) -> DataFrame:
    j = labelled.join(z, list(CELL))
    return j.groupBy("blob").agg(F.count("*").alias("pixels"), F.min("row").alias("row_min"), F.max("row").alias("row_max"), F.min("col").alias("col_min"), F.max("col").alias("col_max"), F.avg("z").alias("mean_z"), F.max("z").alias("shoalest"))
