"""The batch programs: soundings of many platforms into stored sheets, and the summary of a sheet."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import geometry as H
from ..functions.bounds import Bounds
from ..functions.params import Params, SheetSpec
from ..operators import estimate as E
from ..operators import gridding as G
from ..operators import series as T
from ..operators import surfaces as S
from ..sources import grids as R
from .sheets import sheet_bounds
from .store import drop_tables, shared_table


def gated_soundings(soundings: DataFrame, platforms: DataFrame) -> DataFrame:
    """Soundings (file, depth, across, ...) within the gates of their platform: depths positive-down, angles in degrees.

    Files are matched once each, not once for each sounding. A file that no platform fits stops the job.
    """
    known = G.platform_match(soundings.select(F.col("file").alias("name")), platforms)
    gates = platforms.groupBy("recog").agg(F.min_by(F.struct("min_depth", "max_depth", "min_angle", "max_angle"), "rank").alias("g"))
    known = known.join(F.broadcast(gates), "recog", "left").select(F.col("name").alias("file"), "recog", "g.*")
    t = soundings.join(known, "file")
    lost = F.raise_error(F.concat(F.lit("no platform for "), F.col("file"))).cast("boolean")
    angle = F.degrees(F.atan2(F.col("across"), -F.col("depth")))
    inside = (-F.col("depth")).between(F.col("min_depth"), F.col("max_depth")) & angle.between(F.col("min_angle"), F.col("max_angle"))
    return t.where(F.when(F.col("recog").isNull(), lost).otherwise(inside)).drop("min_depth", "max_depth", "min_angle", "max_angle", "recog")


def start_surface(surface: DataFrame, value: float = 0.0, percent: bool = False, mask: DataFrame | None = None) -> DataFrame:
    """What nodes begin with: (row, col, z) or (row, col, z, var) as row, col, z, var, where nodes that ``mask`` (row, col, v) marks with 255 are frozen (NaN).

    A surface without its own variance gets one from ``value``: metres, or percent of the depth at 95 % confidence. Places without a depth are left out.
    """
    t = surface if "var" in surface.columns else surface.withColumn("var", H.prior_variance(F.col("z"), value, percent))
    t = t.where("z is not null").select("row", "col", "z", "var")
    if mask is None:
        return t
    frozen = mask.where("v = 255").select("row", "col", F.lit(True).alias("_frozen"))
    t = t.join(frozen, ["row", "col"], "full")
    return t.select("row", "col", F.when(F.col("_frozen"), F.lit(float("nan"))).otherwise(F.col("z")).alias("z"), "var")


def resampled(surface: DataFrame, base: SheetSpec, sheet: SheetSpec, secondary: DataFrame | None = None) -> DataFrame:
    """A surface (row, col, z, var) on ``base`` as one on the nodes of ``sheet``: bilinear depths with the variance of the interpolation, then ``secondary`` (on ``sheet``) where there is none."""
    nodes = surface.sparkSession.range(sheet.rows * sheet.cols).select((F.col("id") / sheet.cols).cast("int").alias("row"), (F.col("id") % sheet.cols).cast("int").alias("col"))
    nodes = nodes.withColumns({"east": sheet.node_x(), "north": sheet.node_y(), "dr": F.lit(0.0)})
    t = G.predict(nodes, surface, base).where("pred_depth is not null").select("row", "col", F.col("pred_depth").alias("z"), F.col("pred_var").alias("var"))
    if secondary is None:
        return t
    other = secondary.select("row", "col", F.col("z").alias("z2"), F.col("var").alias("v2"))
    return t.join(other, ["row", "col"], "full").select("row", "col", F.coalesce("z", "z2").alias("z"), F.coalesce("var", "v2").alias("var"))


def node_pairs(soundings: DataFrame, sheet: SheetSpec, p: Params, start: DataFrame | None = None, nodal: bool = False) -> DataFrame:
    """Gated (sounding, node) pairs. With ``start`` (:func:`start_surface`) predictions at nodes and soundings steer the gates; ``nodal`` is the older
    rule without a cap on the radius or a capture distance."""
    if nodal:
        return G.nodal_pairs(soundings, sheet, p)
    if start is None:
        return G.gated(G.node_candidates(soundings, sheet, p), p)
    known = start.where(~F.isnan("z"))
    t = G.node_candidates(G.predict(soundings, known, sheet), sheet, p)
    return G.gated(G.at_nodes(t, start), p)


#: Surfaces that need no filter.
PLAIN = {"mean": G.mean_surface, "median": G.median_surface, "trimmed": lambda c: G.trimmed_mean(c).select("row", "col", "z"), "hits": lambda c: G.hits(c).withColumnRenamed("hits", "z"), "sdev": lambda c: G.sdev_surface(c).withColumnRenamed("sdev", "z")}


def estimate(soundings: DataFrame, sheet: SheetSpec, p: Params, order: list[str], how: str = "prior", start: DataFrame | None = None) -> DataFrame:
    """One surface of the soundings (east, north, depth, dz, dr): ``mean``, ``median``, ``trimmed``, ``hits`` or ``sdev`` of each node's cell (row, col, z), or by the filter
    ``prior``, ``context``, ``posterior``, ``predsurf``, ``nodal`` (row, col and all layers)."""
    if how in PLAIN:
        row, col = sheet.cell(F.col("east"), F.col("north"))
        return PLAIN[how](soundings.withColumns({"row": row, "col": col}).where(sheet.inside()))
    nodes = shared_table(E.hypotheses(node_pairs(soundings, sheet, p, start, how == "nodal"), order, p), "nodes")
    return extract(nodes, p, "prior" if how == "nodal" else how, start)


def extract(nodes: DataFrame, p: Params, how: str = "prior", start: DataFrame | None = None, layers: tuple[str, ...] = ("depth", "unct", "ratio", "nhyp", "n")) -> DataFrame:
    """The wanted layers of a surface out of hypotheses, by the extraction named ``how``: most samples, nearest to or most likely under the guide of the nearest plain
    node, or nearest to the surface the nodes began with."""
    if how == "prior":
        t = E.prior_surface(nodes, p.uncertainty)
    elif how in ("context", "posterior"):
        t = E.guided_surface(nodes, E.guides(nodes, p), "closest" if how == "context" else "posterior", p.uncertainty)
    elif how == "predsurf" and start is not None:
        guide = start.where(~F.isnan("z")).select("row", "col", F.col("z").alias("gz"), F.col("var").alias("gv"))
        t = E.guided_surface(nodes, guide, "closest", p.uncertainty)
    else:
        raise ValueError(f"extraction {how!r} is not known or lacks its surface")
    return t.select("row", "col", *layers)


def within(soundings: DataFrame, sheet: SheetSpec, mask: DataFrame | None = None) -> DataFrame:
    """Soundings whose node is on the sheet, and active (v = 0 or none) in its mask."""
    row, col = sheet.cell(F.col("east"), F.col("north"))
    t = soundings.where(sheet_bounds(sheet).expand(sheet.x0 - sheet.dx / 2, sheet.y0 + sheet.dy / 2).expand(sheet.x0 + (sheet.cols - 0.5) * sheet.dx, sheet.y0 - (sheet.rows - 0.5) * sheet.dy).holds(F.col("east"), F.col("north")))
    t = t.withColumns({"row": row, "col": col}).where(sheet.inside())
    if mask is not None:
        t = t.join(mask.where("v <> 0").select("row", "col"), ["row", "col"], "left_anti")
    return t.drop("row", "col")


def assimilate(soundings: DataFrame, platforms: DataFrame, sheet: SheetSpec, p: Params, order: list[str], path: str, tide: DataFrame | None = None, mask: DataFrame | None = None, start: DataFrame | None = None, how: str = "prior") -> DataFrame:
    """Gate, correct for tide (key ``k``, soundings with ``k`` and ``id``), keep what is on the sheet and active, fold and store: the layers depth, unct, ratio, nhyp and n of the sheet at ``path``."""
    kept = gated_soundings(soundings, platforms)
    if tide is not None:
        kept = T.tide_corrected(kept, tide)
    if mask is not None:
        kept = within(kept, sheet, mask)
    nodes = E.hypotheses(node_pairs(kept, sheet, p, start), order, p)
    if how != "prior":
        nodes = shared_table(nodes, "nodes")
    R.save_sheet(extract(nodes, p, how, start), sheet, path)
    return R.load_sheet(soundings.sparkSession, path)[1]


def assimilate_sheets(soundings: DataFrame, platforms: DataFrame, sheets: dict[str, SheetSpec], p: Params, order: list[str], folder: str, masks: dict[str, DataFrame] | None = None, tide: DataFrame | None = None) -> dict[str, DataFrame]:
    """The same for several sheets. What all share, gates and tide, is written once; each sheet reads from it the rectangle it covers and a margin that soundings can reach in from."""
    kept = gated_soundings(soundings, platforms)
    if tide is not None:
        kept = T.tide_corrected(kept, tide)
    kept = shared_table(kept, "gated")
    out = {}
    for name, sheet in sheets.items():
        own = within(kept, sheet, (masks or {}).get(name))
        R.save_sheet(extract(E.hypotheses(node_pairs(own, sheet, p), order, p), p), sheet, f"{folder}/{name}")
        out[name] = R.load_sheet(soundings.sparkSession, f"{folder}/{name}")[1]
    drop_tables(kept)
    return out


def blank_sheet(spark: SparkSession, sheet: SheetSpec, path: str) -> None:
    """A stored sheet without any data, for later runs to fill."""
    layers = "row int, col int, depth double, unct double, ratio double, nhyp int, n long"
    R.save_sheet(spark.createDataFrame([], layers), sheet, path)


def sheet_layer(spark: SparkSession, path: str, layer: str, out: str, area: Bounds | None = None, despike_angle: float | None = None, half: int = 1, edge: float | None = None) -> None:
    """One layer of a stored sheet as a text grid: cut to an area (metres), despiked (radians) and with thin edges masked, as wanted."""
    sheet, t = R.load_sheet(spark, path)
    t = t.select("row", "col", F.col(layer).cast("double").alias("z"))
    if despike_angle is not None:
        t = S.despike(t, half, sheet.dx, despike_angle, sheet)
    if edge is not None:
        t = S.mask_edges(t, sheet.dx, edge)
    if area is not None:
        t = t.where(area.holds(sheet.node_x(), sheet.node_y()))
    R.write_grid(t, sheet, out)


def line_bounds(soundings: DataFrame, file: str = "file") -> DataFrame:
    """One row for each line: its soundings, first and last time, and rectangle."""
    times = [F.min("ts").alias("first"), F.max("ts").alias("last")] if "ts" in soundings.columns else []
    return soundings.groupBy(file).agg(F.count("*").alias("n"), *times, F.min("east").alias("west"), F.min("north").alias("south"), F.max("east").alias("east"), F.max("north").alias("north"))


def areas_of_interest(surface: DataFrame, sheet: SheetSpec, context: float) -> DataFrame:
    """Where a surface (row, col, depth, unct, ratio, nhyp) has several hypotheses, grown by ``context`` metres: centre, size, shoalest depth, the node of the
    greatest strength in doubt, and means of depth, uncertainty, number and strength."""
    size = int((context + 0.5) / sheet.dx) | 1
    several = surface.select("row", "col", (F.col("nhyp") > 1).cast("int").alias("v"))
    found = S.blobs(S.dilate(several, size)).join(surface.select("row", "col", "depth", "unct", "ratio", "nhyp"), ["row", "col"])
    x, y = sheet.node_x(), sheet.node_y()
    t = found.groupBy("blob").agg(
        F.count("*").alias("nodes"), ((F.min(x) + F.max(x)) / 2).alias("x"), ((F.min(y) + F.max(y)) / 2).alias("y"), (F.max(x) - F.min(x)).alias("width"), (F.max(y) - F.min(y)).alias("height"),
        F.max("depth").alias("shoalest"), F.avg("depth").alias("mean_depth"), F.avg("unct").alias("mean_unct"), F.avg("nhyp").alias("mean_nhyp"), F.avg("ratio").alias("mean_ratio"),
        F.max(F.struct("ratio", x.alias("x"), y.alias("y"))).alias("focus"),
    )
    return t.select("*", F.col("focus.ratio").alias("focus_ratio"), F.col("focus.x").alias("focus_x"), F.col("focus.y").alias("focus_y")).drop("focus")


def hypothesis_dump(nodes: DataFrame, sheet: SheetSpec, area: Bounds | None = None) -> DataFrame:
    """All hypotheses (of an area) with their place in metres and 95 % limit, as text for a point file."""
    t = E.hypothesis_list(nodes).withColumns({"x": sheet.node_x(), "y": sheet.node_y(), "unct": 1.96 * F.sqrt("samp_var")})
    t = t if area is None else t.where(area.holds(F.col("x"), F.col("y")))
    return t.select(F.format_string("%.3f %.3f %.3f %.3f %d %d", "x", "y", "cur", "unct", F.col("num").cast("long"), "n").alias("value"))


def put_soundings(soundings: DataFrame, proj, path: str) -> None:
    """Append attributed soundings to a store; positions are kept as lon and lat, so that any sheet can take them."""
    lon, lat = proj.inverse(F.col("east"), F.col("north"))
    soundings.withColumns({"lon": lon, "lat": lat}).drop("east", "north").write.mode("append").parquet(path)


def get_soundings(spark: SparkSession, proj, path: str | list[str]) -> DataFrame:
    """Stored soundings in the coordinates of a projection."""
    t = spark.read.parquet(*([path] if isinstance(path, str) else path))
    east, north = proj.forward(F.col("lon"), F.col("lat"))
    return t.withColumns({"east": east, "north": north}).drop("lon", "lat")


def summarise(cells: DataFrame, surface: DataFrame, sheet: SheetSpec, path: str) -> None:
    """A text grid for each layer of ``surface`` (row, col, layers), and of the density and coverage of the soundings."""
    layers = [(c, surface.select("row", "col", F.col(c).cast("double").alias("z"))) for c in surface.columns if c not in G.CELL]
    layers.append(("density", G.density(cells, sheet).withColumnRenamed("density", "z")))
    layers.append(("coverage", G.coverage_ratio(cells, sheet).withColumnRenamed("ratio", "z")))
    for name, t in layers:
        R.write_grid(t, sheet, f"{path}/{name}")
