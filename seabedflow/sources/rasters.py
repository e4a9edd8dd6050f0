"""Uncompressed single-band TIFF rasters of U8, U16 and F32 values.

A raster holds a bounded piece of a sheet: sheets are encoded tile by tile, and one file is decoded by one task. Row 0 is the
first line of the image. Missing values of F32 rasters are written as the greatest float and read as absent, like NaN.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.params import SheetSpec

#: Numpy type, bits, sample format and missing value by name; tags and field sizes of the file format.
KINDS = {"u8": ("u1", 8, 1, 255), "u16": ("u2", 16, 1, 65535), "f32": ("f4", 32, 3, float(np.finfo("f4").max))}
WIDTH, HEIGHT, BITS, PACKING, MEANING, STRIPS, BANDS, STRIP_ROWS, STRIP_BYTES, FORMAT = 256, 257, 258, 259, 262, 273, 277, 278, 279, 339
FIELDS = {1: "B", 3: "H", 4: "I"}


def encode(z: np.ndarray, kind: str = "f32") -> bytes:
    """One strip, little-endian. NaN becomes the missing value; values of integer rasters must be in range."""
    form, bits, sample, missing = KINDS[kind]
    hole = np.isnan(z)
    filled = np.where(hole, missing, z)
    if kind != "f32" and ((filled < 0) | (filled > missing)).any():
        raise ValueError(f"values out of the range of {kind}")
    data = (np.rint(filled) if kind != "f32" else filled).astype("<" + form).tobytes()
    data += b"\0" * (len(data) % 2)
    rows, cols = z.shape
    tags = [(WIDTH, 4, cols), (HEIGHT, 4, rows), (BITS, 3, bits), (PACKING, 3, 1), (MEANING, 3, 1), (STRIPS, 4, 8), (BANDS, 3, 1), (STRIP_ROWS, 4, rows), (STRIP_BYTES, 4, rows * cols * bits // 8), (FORMAT, 3, sample)]
    table = b"".join(struct.pack("<HHII", tag, kind_, 1, value) for tag, kind_, value in tags)
    return struct.pack("<2sHI", b"II", 42, 8 + len(data)) + data + struct.pack("<H", len(tags)) + table + struct.pack("<I", 0)


def decode(content: bytes) -> np.ndarray:
    """Values as floats, NaN where missing (F32 only). Raises on anything but an uncompressed single band."""
    try:
        end = {b"II": "<", b"MM": ">"}[bytes(content[:2])]
        magic, at = struct.unpack_from(end + "HI", content, 2)
        (count,) = struct.unpack_from(end + "H", content, at)
        tag = {}
        for i in range(count):
            place = at + 2 + 12 * i
            name, field, n = struct.unpack_from(end + "HHI", content, place)
            if field in FIELDS:
                form = f"{end}{n}{FIELDS[field]}"
                where = place + 8 if struct.calcsize(form) <= 4 else struct.unpack_from(end + "I", content, place + 8)[0]
                tag[name] = struct.unpack_from(form, content, where)
        rows, cols = tag[HEIGHT][0], tag[WIDTH][0]
        shape = (tag.get(BITS, (1,))[0], tag.get(FORMAT, (1,))[0])
        kind = next((k for k, v in KINDS.items() if v[1:3] == shape), None)
        if magic != 42 or kind is None or tag.get(PACKING, (1,))[0] != 1 or tag.get(BANDS, (1,))[0] != 1:
            raise ValueError("only uncompressed single bands of U8, U16 or F32")
        data = b"".join(bytes(content[o : o + n]) for o, n in zip(tag[STRIPS], tag[STRIP_BYTES], strict=True))
        z = np.frombuffer(data, end + KINDS[kind][0], rows * cols).reshape(rows, cols).astype("f8")
    except (KeyError, struct.error, ValueError) as e:
        raise ValueError(f"not a raster that can be read: {e}") from e
    return np.where(z == KINDS["f32"][3], np.nan, z) if kind == "f32" else z


def read_rasters(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """Cells (row, col, z) of rasters with the file each comes from; missing values have no row."""

    def parsed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for file, content in zip(b.path, b.content, strict=True):
                z = decode(content)
                row, col = np.nonzero(~np.isnan(z))
                yield pd.DataFrame({"file": file, "row": row.astype("i4"), "col": col.astype("i4"), "z": z[row, col]})

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(parsed, "file string, row int, col int, z double")


def encode_tiles(t: DataFrame, kind: str = "f32", tile: int = 511) -> DataFrame:
    """Cells (row, col, z) as one raster for each tile of ``tile`` x ``tile`` nodes: tile_row, tile_col, content.

    A tile holds at most ``tile`` squared cells, which bounds a task. Of repeated cells the least value stays.
    """

    def packed(key: tuple, g: pd.DataFrame) -> pd.DataFrame:
        z = np.full((tile, tile), np.nan)
        z[g.row - key[0] * tile, g.col - key[1] * tile] = g.z
        return pd.DataFrame({"tile_row": [key[0]], "tile_col": [key[1]], "content": [encode(z, kind)]})

    t = t.where("z is not null").groupBy("row", "col").agg(F.min("z").cast("double").alias("z"))
    t = t.withColumns({"tile_row": F.floor(F.col("row") / tile).cast("int"), "tile_col": F.floor(F.col("col") / tile).cast("int")})
    return t.groupBy("tile_row", "tile_col").applyInPandas(packed, "tile_row int, tile_col int, content binary")


#: The header of an R4 raster (big-endian, 1,024 bytes) and numpy types by its type number.
R4_HEAD = struct.Struct(">4sIII6d4B9f72s72sc7s768s")
R4_KINDS = {1: "u1", 2: ">u2", 3: ">f4"}
R4_PROJECTIONS = {"none": 0, "mercator": 1, "utm": 2, "lonlat": 3}


def encode_r4(z: np.ndarray, spec: SheetSpec, kind: int = 3, projection: str = "utm", meridian: float = 0.0) -> bytes:
    """A raster of depths with its place; missing values are 0. Row 0 is the northern edge."""
    if z.shape != (spec.rows, spec.cols):
        raise ValueError(f"{z.shape} values for {spec.rows} x {spec.cols} nodes")
    filled = np.nan_to_num(z, nan=0.0)
    if kind != 3 and ((filled < 0) | (filled > np.iinfo(R4_KINDS[kind]).max)).any():
        raise ValueError(f"values out of the range of type {kind}")
    south, east = spec.y0 - (spec.rows - 1) * spec.dy, spec.x0 + (spec.cols - 1) * spec.dx
    known = z[~np.isnan(z)]
    lo, hi = (float(known.min()), float(known.max())) if known.size else (0.0, 0.0)
    place = (spec.x0, east, south, spec.y0, spec.dx, spec.dy)
    head = R4_HEAD.pack(b"OMG1", spec.cols, spec.rows, 0, *place, kind, 0, R4_PROJECTIONS[projection], 0, meridian, *[0.0] * 6, hi, lo, b"", b"", b"N", b"", b"")
    return head + filled.astype(R4_KINDS[kind]).tobytes()


def decode_r4(content: bytes) -> tuple[SheetSpec, np.ndarray]:
    """The nodes and values of an R4 raster, NaN where missing; raises on rotated projections and other formats."""
    if len(content) < 1024 or bytes(content[:4]) != b"OMG1":
        raise ValueError("no R4 raster")
    cols, rows = struct.unpack_from(">II", content, 4)
    west, _, _, north, dx, dy = struct.unpack_from(">6d", content, 16)
    kind, _, projection, _ = struct.unpack_from("4B", content, 64)
    if kind not in R4_KINDS or projection not in R4_PROJECTIONS.values():
        raise ValueError(f"type {kind} in projection {projection} is not read")
    form = np.dtype(R4_KINDS[kind])
    if len(content) < 1024 + rows * cols * form.itemsize:
        raise ValueError("the file ends inside its values")
    z = np.frombuffer(content, form, rows * cols, 1024).reshape(rows, cols).astype("f8")
    return SheetSpec(west, north, dx, dy, cols, rows), np.where(z == 0, np.nan, z)


def read_r4(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """Cells (file, row, col, z) of R4 rasters; missing values have no row."""

    def parsed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for file, content in zip(b.path, b.content, strict=True):
                _, z = decode_r4(content)
                row, col = np.nonzero(~np.isnan(z))
                yield pd.DataFrame({"file": pd.Series([file] * len(row), dtype=object), "row": row.astype("i4"), "col": col.astype("i4"), "z": z[row, col]})

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(parsed, "file string, row int, col int, z double")
