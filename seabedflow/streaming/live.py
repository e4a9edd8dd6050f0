"""The live program: soundings of moving sensors into the map, and a grid published at intervals; and the same over recorded points."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions.params import Params, SheetSpec
from ..operators import estimate as E
from ..operators import gridding as G
from ..sources import grids as R
from .nodes import stream_surface


def rotated(x: Column, y: Column, z: Column, q: tuple[Column, Column, Column, Column]) -> tuple[Column, Column, Column]:
    """A vector turned by a unit quaternion (x, y, z, w)."""
    qx, qy, qz, qw = q
    # twice the cross product of the axis with the vector, then once more
    tx, ty, tz = 2 * (qy * z - qz * y), 2 * (qz * x - qx * z), 2 * (qx * y - qy * x)
    return x + qw * tx + qy * tz - qz * ty, y + qw * ty + qz * tx - qx * tz, z + qw * tz + qx * ty - qy * tx


def in_map(points: DataFrame, transforms: DataFrame, tolerance: float = 1.0) -> DataFrame:
    """``points`` (frame, ts, x, y, z, vertical_uncertainty, horizontal_uncertainty; z up) as soundings (ts, east, north, depth, dz, dr) in the map, by the latest of ``transforms`` (frame, ts, tx,
    ty, tz, qx, qy, qz, qw) that is at most ``tolerance`` seconds older.

    Both are dealt by frame and whole second, so a point meets the transforms of two seconds or so and none else; points without one are dropped, as are those with a missing value.
    """
    sec = lambda c: F.unix_micros(c) / 1e6
    back = int(tolerance) + 1
    t = transforms.withColumns({"_s": F.explode(F.sequence(F.floor(sec(F.col("ts"))), F.floor(sec(F.col("ts"))) + back)), "_at": F.col("ts")}).drop("ts")
    p = points.withColumns({"_id": F.monotonically_increasing_id(), "_s": F.floor(sec(F.col("ts")))})
    j = p.join(t, ["frame", "_s"]).where((F.col("_at") <= F.col("ts")) & (sec(F.col("ts")) - sec(F.col("_at")) <= tolerance))
    value = F.struct("ts", "x", "y", "z", "vertical_uncertainty", "horizontal_uncertainty", "tx", "ty", "tz", "qx", "qy", "qz", "qw")
    j = j.groupBy("_id").agg(F.max_by(value, "_at").alias("v")).select("v.*")
    x, y, z = rotated(F.col("x"), F.col("y"), F.col("z"), tuple(F.col(c) for c in ("qx", "qy", "qz", "qw")))
    out = j.select("ts", (x + F.col("tx")).alias("east"), (y + F.col("ty")).alias("north"), (z + F.col("tz")).alias("depth"), F.col("vertical_uncertainty").alias("dz"), F.col("horizontal_uncertainty").alias("dr"))
    return out.na.drop()


def grid_message(surface: DataFrame) -> DataFrame:
    """Cells of a published grid: elevation (up) and uncertainty."""
    return surface.select("row", "col", F.col("depth").alias("elevation"), F.col("unct").alias("uncertainty"))


def publish(pairs: DataFrame, p: Params, sheet: SheetSpec, folder: str, checkpoint: str, every: str | None = "5 seconds", order: str = "seq") -> StreamingQuery:
    """Run the node filter over streaming (row, col, depth, var, ``order``) and, each ``every`` (None: for what there is), append the nodes that changed as a grid message: a Parquet
    folder by number under ``folder``, the sheet's place in its ``head`` column. A message that is written again after a failure replaces itself."""
    head = json.dumps({"x0": sheet.x0, "y0": sheet.y0, "dx": sheet.dx, "dy": sheet.dy, "cols": sheet.cols, "rows": sheet.rows})

    def write(batch: DataFrame, number: int) -> None:
        grid_message(batch).withColumn("head", F.lit(head)).write.mode("overwrite").parquet(f"{folder}/message={number}")

    out = stream_surface(pairs, p, order).writeStream.outputMode("update").foreachBatch(write).option("checkpointLocation", checkpoint)
    return (out.trigger(processingTime=every) if every else out.trigger(availableNow=True)).start()


def latest_grid(messages: DataFrame) -> DataFrame:
    """The grid after all messages: of each node what the last message said."""
    return messages.groupBy("row", "col").agg(F.max_by(F.struct("elevation", "uncertainty"), "message").alias("v")).select("row", "col", "v.*")


def recorded_grid(points: DataFrame, transforms: DataFrame, sheet: SheetSpec, p: Params, path: str, tolerance: float = 1.0) -> DataFrame:
    """Recorded points of any number of sensors, merged in the order of time, as a stored sheet of two layers, elevation and uncertainty. Equal times are ordered by the whole sounding."""
    snd = in_map(points, transforms, tolerance)
    pairs = G.gated(G.node_candidates(snd, sheet, p), p)
    nodes = E.hypotheses(pairs, ["ts", "east", "north", "dz", "dr"], p)
    R.save_sheet(grid_message(E.prior_surface(nodes, "posterior")), sheet, path)
    return R.load_sheet(points.sparkSession, path)[1]
