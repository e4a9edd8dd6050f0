"""Rectangles in metres or in nodes, and positions on tiled sheets."""

from __future__ import annotations

import math
from collections.abc import Iterable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Bounds:
    """A rectangle with its borders; the empty one holds nothing and grows from the first point on."""

    min_x: float = math.inf
    min_y: float = math.inf
    max_x: float = -math.inf
    max_y: float = -math.inf

    @classmethod
    def of(cls, points: Iterable[tuple[float, float]]) -> Bounds:
        b = cls()
        for x, y in points:
            b = b.expand(x, y)
        return b

    @property
    def valid(self) -> bool:
        return self.min_x <= self.max_x and self.min_y <= self.max_y

    def expand(self, x: float, y: float) -> Bounds:
        return Bounds(min(self.min_x, x), min(self.min_y, y), max(self.max_x, x), max(self.max_y, y))

    def union(self, other: Bounds) -> Bounds:
        return Bounds(min(self.min_x, other.min_x), min(self.min_y, other.min_y), max(self.max_x, other.max_x), max(self.max_y, other.max_y))

    def contains(self, x: float, y: float) -> bool:
        return self.min_x <= x <= self.max_x and self.min_y <= y <= self.max_y

    def holds(self, x: Column, y: Column) -> Column:
        """The same as a predicate; false for null positions. It reaches a scan as ranges of both columns."""
        return x.between(self.min_x, self.max_x) & y.between(self.min_y, self.max_y) if self.valid else F.lit(False)

    def cells(self, dx: float, dy: float) -> Bounds:
        """The whole cells of a grid from the origin that the rectangle touches, as indexes from its first to its last."""
        return Bounds(math.floor(self.min_x / dx), math.floor(self.min_y / dy), math.floor(self.max_x / dx), math.floor(self.max_y / dy))

    def indexes(self) -> Iterable[tuple[int, int]]:
        """All whole (x, y) of the rectangle, row by row."""
        if self.valid:
            for y in range(math.ceil(self.min_y), math.floor(self.max_y) + 1):
                for x in range(math.ceil(self.min_x), math.floor(self.max_x) + 1):
                    yield x, y


def bounds_of(t: DataFrame, x: str = "east", y: str = "north") -> Bounds:
    """The rectangle around all positions of a table; one aggregation."""
    r = t.agg(F.min(x).alias("x0"), F.min(y).alias("y0"), F.max(x).alias("x1"), F.max(y).alias("y1")).first()
    return Bounds() if r.x0 is None else Bounds(r.x0, r.y0, r.x1, r.y1)


def tile_of(x: Column, y: Column, dx: float, dy: float, cols: int, rows: int) -> Column:
    """Struct (tile_x, tile_y, x, y) of a position on an endless sheet of tiles of ``cols`` x ``rows`` cells: whole divisions that round down, so tiles west and south of the origin count from -1."""
    cx, cy = F.floor(x / dx).cast("long"), F.floor(y / dy).cast("long")
    return F.struct(F.floor(cx / cols).cast("int").alias("tile_x"), F.floor(cy / rows).cast("int").alias("tile_y"), F.pmod(cx, F.lit(cols)).cast("int").alias("x"), F.pmod(cy, F.lit(rows)).cast("int").alias("y"))


def tiles_in(b: Bounds, dx: float, dy: float, cols: int, rows: int) -> list[tuple[int, int]]:
    """The tiles that a rectangle touches."""
    return list(b.cells(dx * cols, dy * rows).indexes())
