"""Grid text, stored sheets, world files and platform lists.

A grid has columns row, col, z (and alt); rows run south and cells without a value are left out or null. Grid text lists rows from
the south; each row of a partial grid starts with its first column and the one after its last, zero stands for no value and depths are
offsets from the third number of the origin.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import asdict

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.params import SheetSpec

GRID_SCHEMA = "row int, col int, z double, alt double"


def _header(lines: list[str]) -> tuple[SheetSpec, bool, bool, float, int]:
    at = next((i for i, x in enumerate(lines) if x.startswith("BEGIN GUTM 1.0")), None)
    try:
        if at is None:
            raise ValueError("no such header")
        size, cell, shape = lines[at + 1].split(), lines[at + 2].split(), lines[at + 3].split()
        alt = lines[at + 4].startswith("USE_ALTERNATE_DATA")
        origin = lines[at + 4 + alt].split()
        if [x[0] for x in (size, cell, shape, origin)] != ["COLS_ROWS", "CELLSIZE", "SHAPE", "LOCAL_ORIGIN"] or not {"FULL", "PARTIAL"} & set(shape):
            raise ValueError("lines missing")
        cols, rows, d = int(size[1]), int(size[2]), float(cell[1])
        x0, south, z0 = (float(v) for v in origin[1:4])
    except (IndexError, ValueError) as e:
        raise ValueError(f"not a grid text: {e}") from e
    return SheetSpec(x0, south + (rows - 1) * d, d, d, cols, rows), "PARTIAL" not in shape, alt, z0, at + 5 + alt


def grid_spec(spark: SparkSession, path: str) -> SheetSpec:
    """Geometry of one grid text; the driver gets its first lines only."""
    return _header([r.value for r in spark.read.text(path).limit(200).collect()])[0]


def _cells(text: str) -> pd.DataFrame:
    lines = text.splitlines()
    spec, full, alt, z0, at = _header(lines)
    word = iter(" ".join(lines[at:]).split())
    out = []
    try:
        for row in range(spec.rows - 1, -1, -1):
            first, end = (0, spec.cols) if full else (int(next(word)), int(next(word)))
            for col in range(first, end):
                z = float(next(word))
                other = float(next(word)) if alt else None
                if z != 0:
                    out.append((row, col, z + z0, other))
    except StopIteration:
        raise ValueError("a grid text ends early") from None
    return pd.DataFrame(out, columns=["row", "col", "z", "alt"])


def read_grid(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """Cells of grid texts with the file each comes from. One file is one task, since where a value lies depends on all before it."""

    def parsed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for file, text in zip(b.file, b.value, strict=True):
                yield _cells(text).assign(file=file)

    return spark.read.text(path, wholetext=True).select("value", F.input_file_name().alias("file")).mapInPandas(parsed, GRID_SCHEMA + ", file string")


def write_grid(t: DataFrame, spec: SheetSpec, path: str) -> None:
    """Write (row, col, z) as one partial grid text in the folder ``path``. A line of the grid is made where its cells meet; the
    lines, at most ``spec.rows`` of ``spec.cols`` values, meet in the one task that writes the file."""
    t = t.where(F.col("z").isNotNull() & spec.inside()).select("row", "col", "z")
    low = t.agg(F.min("z")).first()[0]
    base = float(f"{(low if low is not None else 1.0) - 1.0:f}")
    line = t.groupBy("row").agg(F.min("col").alias("a"), F.max("col").alias("b"), F.map_from_entries(F.collect_list(F.struct("col", F.format_string("%.6f", F.col("z") - base)))).alias("m"))
    values = F.transform(F.sequence("a", "b"), lambda c: F.coalesce(F.try_element_at("m", c), F.lit("0.0")))
    line = line.select("row", F.concat_ws("\n", F.concat_ws(" ", "a", F.col("b") + 1), F.array_join(values, "\n")).alias("value"))
    empty = F.concat_ws("\n", F.lit("0 1"), F.lit("0.0"))
    rows = t.sparkSession.range(spec.rows).select(F.col("id").cast("int").alias("row")).join(line, "row", "left").select("row", F.coalesce("value", empty).alias("value"))
    head = f"BEGIN GUTM 1.0\nCOLS_ROWS {spec.cols} {spec.rows}\nCELLSIZE {spec.dx:f}\nSHAPE PARTIAL\nLOCAL_ORIGIN {spec.x0:f} {spec.y0 - (spec.rows - 1) * spec.dy:f} {base:f}"
    first = t.sparkSession.createDataFrame([(spec.rows, head)], "row int, value string")
    rows.unionByName(first).repartition(1).sortWithinPartitions(F.col("row").desc()).select("value").write.mode("overwrite").text(path)


def save_sheet(layers: DataFrame, spec: SheetSpec, path: str, tile: int = 511) -> None:
    """Store layers (row, col, ...) by tile with the geometry beside them."""
    spark = layers.sparkSession
    at = layers.withColumns({"tile_row": F.floor(F.col("row") / tile).cast("int"), "tile_col": F.floor(F.col("col") / tile).cast("int")})
    at.write.mode("overwrite").partitionBy("tile_row", "tile_col").parquet(f"{path}/layers")
    spark.createDataFrame([{**asdict(spec), "tile": tile}]).coalesce(1).write.mode("overwrite").json(f"{path}/sheet")


def load_sheet(spark: SparkSession, path: str, rows: tuple[int, int] | None = None, cols: tuple[int, int] | None = None) -> tuple[SheetSpec, DataFrame]:
    """Geometry and layers; limits on rows and columns (both ends included) leave out tiles before they are read."""
    meta = spark.read.schema("x0 double, y0 double, dx double, dy double, cols int, rows int, tile int").json(f"{path}/sheet").first().asDict()
    tile, t = meta.pop("tile"), spark.read.parquet(f"{path}/layers")
    for name, span in (("row", rows), ("col", cols)):
        if span:
            t = t.where(F.col(f"tile_{name}").between(span[0] // tile, span[1] // tile) & F.col(name).between(*span))
    return SheetSpec(**meta), t.drop("tile_row", "tile_col")


def world_file(spec: SheetSpec) -> str:
    """Text of a world file: pixel sizes, no rotation, centre of the north-west node."""
    return "".join(f"{v:.6f}\n" for v in (spec.dx, 0.0, 0.0, -spec.dy, spec.x0, spec.y0))


def read_platforms(spark: SparkSession, path: str) -> DataFrame:
    """A platform list: recognition string, device, ``min,max`` depth, ``min,max`` angle in degrees and configuration on each line,
    ranked in the order of the file. A line that is none of this, a negative depth or an angle of 90 degrees and more raise."""
    out = []
    for i, line in enumerate(spark.read.text(path, wholetext=True).first().value.splitlines()):
        try:
            recog, device, depth, angle, config = line.split()[:5]
            (d0, d1), (a0, a1) = ((float(v) for v in g.split(",")) for g in (depth, angle))
        except ValueError as e:
            raise ValueError(f"line {i + 1} is no platform: {line!r}") from e
        if d0 < 0 or d1 < 0 or a0 <= -90 or a1 >= 90:
            raise ValueError(f"line {i + 1}: gates out of range")
        out.append((i + 1, recog, device, d0, d1, a0, a1, config))
    return spark.createDataFrame(out, "rank int, recog string, device string, min_depth double, max_depth double, min_angle double, max_angle double, config string")
