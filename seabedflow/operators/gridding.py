"""Binning, gates, the sounding-to-node join and order-free estimates: all DataFrame expressions."""

from __future__ import annotations

import warnings

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.geometry import interpolation_variance
from ..functions.params import CI95, CI99_GRID, Params, SheetSpec
from ..plans.store import drop_tables, shared_table

CELL = ("row", "col")


def hits(cells: DataFrame) -> DataFrame:
    """Soundings of each cell, those without a depth too; soundings without a place are counted under a null cell, repeated rows each."""
    return cells.groupBy(*CELL).agg(F.count("*").alias("hits"))


def density(cells: DataFrame, sheet: SheetSpec) -> DataFrame:
    """Hits for each square metre."""
    return hits(cells).select(*CELL, (F.col("hits") / (sheet.dx * sheet.dy)).alias("density"))


def mean_surface(cells: DataFrame) -> DataFrame:
    """Mean of the depths below half a metre; nulls, and cells without such depths, are left out."""
    return cells.where("depth < -0.5").groupBy(*CELL).agg(F.avg("depth").alias("z"))


def median_surface(cells: DataFrame) -> DataFrame:
    """Upper median: the value at place n div 2 of the ascending order, nulls left out. Equal depths of a cell are counted before the shuffle, so that the
    running count sorts different depths only."""
    counts = cells.where("depth is not null").groupBy(*CELL, "depth").agg(F.count("*").alias("k"))
    w = Window.partitionBy(*CELL)
    ranked = counts.select(*CELL, "depth", "k", F.sum("k").over(w.orderBy("depth")).alias("upto"), F.sum("k").over(w).alias("n"))
    place = F.floor(F.col("n") / 2) + 1
    return ranked.where((F.col("upto") >= place) & (F.col("upto") - F.col("k") < place)).select(*CELL, F.col("depth").alias("z"))


def sdev_surface(cells: DataFrame) -> DataFrame:
    """Standard deviation of the population; null where a cell has no depth, 0 for a single one."""
    d = F.col("depth")
    var = F.greatest(F.avg(d * d) - F.avg(d) * F.avg(d), F.lit(0.0))
    return cells.groupBy(*CELL).agg(F.when(F.count(d) > 0, F.sqrt(var)).alias("sdev"))


def trimmed_mean(cells: DataFrame, rounds: int = 100, tolerance: float = 0.01, scale: float = 2.0) -> DataFrame:
    """Mean after clipping to ``scale`` deviations, again and again until mean and deviation of a cell both change by less than ``tolerance`` of themselves.

    Each round tests all samples of the cells that still move, so a dropped sample may return. The deviation is sqrt(sum of squares / (n - 1) -
    mean^2), as existing surfaces have it; a single sample is its own mean, that of a cell without depths is null. Cells that move after ``rounds``
    keep the last mean and are counted in a warning.

    Equal depths of a cell are counted once, before anything else is shuffled, and rounds work on these counts; a round is one aggregation and one join on the
    cell, with sums in part before the shuffle, and its few numbers for each cell are written, so the plan does not grow.
    """
    own = shared_table(cells.groupBy(*CELL, "depth").agg(F.count("*").alias("k")), "depth-counts")
    d, k, pm, pse = (F.col(c) for c in ("depth", "k", "pm", "pse"))
    known = F.when(d.isNotNull(), k)

    def stat(t: DataFrame, *kept: Column) -> DataFrame:
        t = t.groupBy(*CELL).agg(F.sum(k * d).alias("s1"), F.sum(k * d * d).alias("s2"), F.coalesce(F.sum(known), F.lit(0)).alias("n"), *kept)
        m, n = F.col("s1") / F.when(F.col("n") > 0, F.col("n")), F.col("n")
        return t.withColumns({"m": m, "se": F.when(n > 1, F.sqrt(F.greatest(F.col("s2") / F.greatest(n - 1, F.lit(1)) - m * m, F.lit(0.0))))})

    m, se, n = (F.col(c) for c in ("m", "se", "n"))
    moves = lambda x, old: (x != old) & (F.abs(x - old) >= tolerance * F.abs(x))
    state = shared_table(stat(own).select(*CELL, "m", "se", "n", (n > 1).alias("moving")), "cells")
    for _ in range(rounds):
        at = state.where("moving").select(F.col("row").alias("_r"), F.col("col").alias("_c"), m.alias("pm"), se.alias("pse"))
        kept = own.join(at, own["row"].eqNullSafe(at["_r"]) & own["col"].eqNullSafe(at["_c"])).where(d.between(pm - scale * pse, pm + scale * pse))
        new = stat(kept, F.first("pm").alias("pm"), F.first("pse").alias("pse"))
        new = new.select(*CELL, "m", "se", "n", ((n > 1) & (moves(m, pm) | moves(se, pse))).alias("moving"))
        before, state = state, shared_table(state.where("not moving").unionByName(new), "cells")
        drop_tables(before)
        left = state.where("moving").count()
        if not left:
            break
    else:
        warnings.warn(f"{left} cells still move after {rounds} rounds of clipping", stacklevel=2)
    drop_tables(own)
    return state.select(*CELL, m.alias("z"), n.alias("n_kept"))


def extent(cells: DataFrame, *by: str) -> DataFrame:
    """First and last row and column of the cells, of each group or of all; nulls are no cells."""
    return cells.groupBy(*by).agg(F.min("row").alias("row_min"), F.max("row").alias("row_max"), F.min("col").alias("col_min"), F.max("col").alias("col_max"))


def depth_gate(t: DataFrame, least: float, most: float) -> DataFrame:
    """Gates are given positive-down; depths are negative."""
    return t.where((F.col("depth") <= -least) & (F.col("depth") >= -most))


def angle_gate(t: DataFrame, across: Column, lo: float, hi: float) -> DataFrame:
    """Keep beams whose signed angle from the vertical is within radians ``lo`` to ``hi``."""
    return t.withColumn("angle", F.atan2(across, -F.col("depth"))).where(F.col("angle").between(lo, hi))


def iho_error(p: Params) -> tuple[Column, Column]:
    """Vertical variance of the order's limits at the depth, and a constant horizontal one."""
    d2 = F.col("depth") * F.col("depth")
    return (F.lit(p.fixed2) + F.lit(p.pct2) * d2) / (CI95 * CI95), F.lit((p.limits()[2] / CI95) ** 2)


def influence_radius(p: Params) -> Column:
    maxvar = (F.lit(p.fixed2) + F.lit(p.pct2) * F.col("depth") * F.col("depth")) / (CI95 * CI95)
    ratio = F.greatest(F.lit(2.0), maxvar / F.col("dz"))
    rmax = CI99_GRID * F.sqrt("dr")
    r = p.dist_scale * F.pow(ratio - 1, F.lit(1.0 / p.dist_exp)) - rmax
    r = F.when(r < 0, F.lit(p.dist_scale)).otherwise(r)
    return F.greatest(F.least(r, rmax), F.lit(p.dist_scale))


def complete(t: DataFrame) -> DataFrame:
    """Soundings whose place, depth and errors are all there."""
    return t.where("east is not null and north is not null and depth is not null and dz is not null and dr is not null")


def node_candidates(t: DataFrame, sheet: SheetSpec, p: Params) -> DataFrame:
    """Each sounding with each node nearer than its radius. Nodes are generated from the radius, so no node table is joined. Soundings without a place, a depth or an error
    reach no node; repeated soundings count each."""
    t = complete(t).withColumn("radius", influence_radius(p))
    r = F.col("radius")
    row_lo, col_lo = F.ceil((sheet.y0 - F.col("north") - r) / sheet.dy), F.ceil((F.col("east") - r - sheet.x0) / sheet.dx)
    row_hi, col_hi = F.floor((sheet.y0 - F.col("north") + r) / sheet.dy), F.floor((F.col("east") + r - sheet.x0) / sheet.dx)
    span = lambda lo, hi, n: (F.greatest(lo, F.lit(0)).cast("int"), F.least(hi, F.lit(n - 1)).cast("int"))
    (r0, r1), (c0, c1) = span(row_lo, row_hi, sheet.rows), span(col_lo, col_hi, sheet.cols)
    t = t.withColumns({"r0": r0, "r1": r1, "c0": c0, "c1": c1}).where("r0 <= r1 and c0 <= c1")
    t = t.withColumn("row", F.explode(F.sequence("r0", "r1"))).withColumn("col", F.explode(F.sequence("c0", "c1")))
    dx, dy = sheet.node_x() - F.col("east"), sheet.node_y() - F.col("north")
    return t.withColumn("dist2", dx * dx + dy * dy).where(F.col("dist2") < r * r).drop("r0", "r1", "c0", "c1")


def gated(t: DataFrame, p: Params) -> DataFrame:
    """Capture distance and distance-diluted variance; rows are (sounding, node) pairs of :func:`node_candidates`.

    Where pairs have the initial surface at their node (``node_depth``, ``node_var``; :func:`at_nodes`), a frozen node (NaN) takes nothing, soundings
    deeper than the blunder limit are dropped, and the capture distance goes by the node's depth. Where they also have the surface at
    the sounding (``pred_depth``; :func:`predict`), the depth is moved by the slope between the two. Nodes and soundings
    without a prediction (null) are treated as if there were no surface.
    """
    target = F.col("depth")
    if "node_depth" in t.columns:
        z = F.col("node_depth")
        limit = F.least(z - p.blunder_min, z - p.blunder_pct * F.abs(z), z - p.blunder_scalar * F.sqrt("node_var"))
        t = t.where(z.isNull() | (~F.isnan(z) & (F.col("depth") >= limit)))
        target = F.coalesce(z, target)
    t = t.where(F.sqrt("dist2") <= F.greatest(p.capture * F.abs(target), F.lit(0.5)))
    if {"node_depth", "pred_depth"} <= set(t.columns):
        t = t.withColumn("depth", F.col("depth") + F.coalesce(F.col("node_depth") - F.col("pred_depth"), F.lit(0.0)))
    dist = F.sqrt("dist2") + CI95 * F.sqrt("dr")
    return t.withColumn("var", F.col("dz") * (1 + p.var_scale * F.pow(dist, F.lit(p.dist_exp))))


def nodal_pairs(t: DataFrame, sheet: SheetSpec, p: Params) -> DataFrame:
    """Pairs by the older rule: all nodes of the square as wide as the uncapped radius, without a capture distance."""
    t = complete(t)
    maxvar = (F.lit(p.fixed2) + F.lit(p.pct2) * F.col("depth") * F.col("depth")) / (CI95 * CI95)
    r = p.dist_scale * F.pow(F.greatest(F.lit(2.0), maxvar / F.col("dz")) - 1, F.lit(1.0 / p.dist_exp))
    # cells by truncation towards the north-west node, as far as the sheet goes
    fc, fr = (F.col("east") - sheet.x0) / sheet.dx, (F.lit(sheet.y0) - F.col("north")) / sheet.dy
    lo = lambda v, n: F.greatest(v.cast("int"), F.lit(0))
    hi = lambda v, n: F.least(v.cast("int"), F.lit(n - 1))
    t = t.withColumns({"r0": lo(fr - r / sheet.dy, sheet.rows), "r1": hi(fr + r / sheet.dy, sheet.rows), "c0": lo(fc - r / sheet.dx, sheet.cols), "c1": hi(fc + r / sheet.dx, sheet.cols)})
    t = t.where(f"r0 <= r1 and c0 <= c1 and r0 < {sheet.rows - 1} and c0 < {sheet.cols - 1}")
    t = t.withColumn("row", F.explode(F.sequence("r0", "r1"))).withColumn("col", F.explode(F.sequence("c0", "c1"))).drop("r0", "r1", "c0", "c1")
    dx, dy = sheet.node_x() - F.col("east"), sheet.node_y() - F.col("north")
    dist = F.sqrt(dx * dx + dy * dy) + CI95 * F.sqrt("dr")
    return t.withColumn("var", F.col("dz") * (1 + p.var_scale * F.pow(dist, F.lit(p.dist_exp))))


def at_nodes(pairs: DataFrame, surface: DataFrame) -> DataFrame:
    """Pairs with the initial surface (row, col, z, var; z NaN: frozen) at their node as ``node_depth`` and ``node_var``; null where it has none."""
    s = surface.select(*CELL, F.col("z").alias("node_depth"), F.col("var").alias("node_var"))
    return pairs.join(s, list(CELL), "left")


def node_estimate_ivw(t: DataFrame) -> DataFrame:
    """The filter in closed form where no hypothesis is split: precision-weighted mean, variance and confidence limit."""
    w = 1 / F.col("var")
    return t.groupBy(*CELL).agg((F.sum(F.col("depth") * w) / F.sum(w)).alias("depth"), (1 / F.sum(w)).alias("var"), F.count("*").alias("n")).withColumn("unct", CI95 * F.sqrt("var"))


#: A platform list describes the devices of one survey; longer ones are refused, since every file is held against all of it.
MAX_PLATFORMS = 10_000


def platform_match(files: DataFrame, platforms: DataFrame) -> DataFrame:
    """First platform (by rank) whose recognition string is part of the file name, null if there is none; one row per different name.

    ``platforms`` (rank, recog) is a configuration of a checked size and becomes part of the expression, so files are matched without a join.
    """
    rows = platforms.select("rank", "recog").orderBy("rank", "recog").limit(MAX_PLATFORMS + 1).collect()
    if len(rows) > MAX_PLATFORMS:
        raise ValueError(f"more than {MAX_PLATFORMS} platforms")
    names = files.select("name").distinct()
    if not rows:
        return names.withColumn("recog", F.lit(None).cast("string"))
    known = F.array(*[F.lit(r.recog) for r in rows])
    return names.select("name", F.get(F.filter(known, lambda r: F.contains(F.col("name"), r)), F.lit(0)).alias("recog"))


def corners(surface: DataFrame, *values: str) -> DataFrame:
    """For each place between four nodes (named by the north-west one) arrays of the values at NW, NE, SW and SE; places that lack a node are left out."""
    o = F.array(*[F.struct(F.lit(-r).alias("dr"), F.lit(-c).alias("dc"), F.lit(2 * r + c).alias("at")) for r in (0, 1) for c in (0, 1)])
    t = surface.select(*CELL, *values, F.explode(o).alias("o"))
    t = t.groupBy((F.col("row") + F.col("o.dr")).alias("row"), (F.col("col") + F.col("o.dc")).alias("col"))
    pick = lambda v, i: F.max(F.when(F.col("o.at") == i, F.col(v)))
    t = t.agg(*[F.array(*[pick(v, i) for i in range(4)]).alias(v) for v in values])
    whole = [F.forall(v, lambda x: x.isNotNull()) for v in values]
    for w in whole:
        t = t.where(w)
    return t


def predict(soundings: DataFrame, surface: DataFrame, sheet: SheetSpec) -> DataFrame:
    """Add pred_depth and pred_var: the initial surface (row, col, z, var) interpolated at each sounding (east, north, dr).

    The variance holds that of the nodes and what the slope makes of the sounding's horizontal variance. Soundings between nodes that are
    not all there have null. One join on the place between the nodes; the surface side is no larger than the sheet, and places
    with many soundings are split by the adaptive skew join.
    """
    fc, fr = (F.col("east") - sheet.x0) / sheet.dx, (F.lit(sheet.y0) - F.col("north")) / sheet.dy
    t = soundings.withColumns({"_c": F.floor(fc).cast("int"), "_r": F.floor(fr).cast("int"), "_u": fc - F.floor(fc), "_w": 1 - (fr - F.floor(fr))})
    k = corners(surface, "z", "var").select(F.col("row").alias("_r"), F.col("col").alias("_c"), F.col("z").alias("_z"), F.col("var").alias("_v"))
    t = t.join(k, ["_r", "_c"], "left")
    z, v = ([F.col(n)[i] for i in range(4)] for n in ("_z", "_v"))
    u, w = F.col("_u"), F.col("_w")
    depth = (z[0] * (1 - u) + z[1] * u) * w + (z[2] * (1 - u) + z[3] * u) * (1 - w)
    return t.withColumns({"pred_depth": depth, "pred_var": interpolation_variance(z, v, u, w, F.col("dr"), sheet.dx, sheet.dy)}).drop("_r", "_c", "_u", "_w", "_z", "_v")


def coverage_ratio(cells: DataFrame, sheet: SheetSpec) -> DataFrame:
    """Hits for each area of a beam's footprint, (5 + 5 % of the depth) squared; depths count positive-down."""
    t = cells.groupBy(*CELL).agg(F.count("*").alias("hits"), F.avg("depth").alias("z"))
    return t.select(*CELL, (F.col("hits") / (sheet.dx * sheet.dy) * F.pow(5 - 0.05 * F.col("z"), F.lit(2.0))).alias("ratio"))
