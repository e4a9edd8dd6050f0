"""Estimator parameters, survey-order limits, unit strings and sheet geometry."""

from __future__ import annotations

import math
import re
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed values: (fixed depth error m, fraction of depth) at 95 % confidence by survey order.
ORDERS = {"exclusive": (0.15, 0.0075), "special": (0.25, 0.0075), "order1a": (0.5, 0.013), "order1b": (0.5, 0.013), "order1": (0.5, 0.013), "order2": (1.0, 0.023), "order3": (1.0, 0.023)}
#: Horizontal limits in metres at 95 % confidence by survey order.
HORIZONTAL = {"exclusive": 1.0, "special": 2.0, "order1a": 5.0, "order1b": 5.0, "order1": 5.0, "order2": 20.0, "order3": 150.0}
#: The older numbered orders as (fixed depth error, fraction of depth, fixed grid error, fraction of depth, horizontal).
NUMBERED_ORDERS = {"1": (0.2, 0.0075, 0.2, 0.0075, 2.0), "2": (0.5, 0.013, 1.0, 0.0026, 5.0), "3": (1.0, 0.023, 2.0, 0.05, 20.0), "4": (1.0, 0.023, 5.0, 0.05, 150.0)}
CI95, CI99_GRID, CI99_NODE = 1.96, 2.95, 2.56
#: Metres, seconds, hertz and bytes for unit suffixes.
UNITS = {
    "length": {"nm": 1852.0, "ft": 0.3048, "in": 0.0254, "um": 1e-6, "mm": 1e-3, "cm": 1e-2, "dm": 0.1, "m": 1.0, "hm": 100.0, "km": 1000.0},
    "duration": {"s": 1.0, "mn": 60.0, "hr": 3600.0},
    "rate": {"hz": 1.0, "khz": 1e3, "mhz": 1e6},
    "memory": {"b": 1.0, "kb": 1024.0, "mb": 1024.0**2, "gb": 1024.0**3, "tb": 1024.0**4},
}


def parse_unit(text: str, kind: str) -> float:
    """``5 mm`` -> 0.005; raises on an unknown unit."""
    m = re.fullmatch(r"\s*([-+]?[0-9.]+(?:[eE][-+]?\d+)?)\s*([A-Za-z]+)\s*", text)
    if not m or m[2].lower() not in UNITS[kind]:
        raise ValueError(f"not a {kind}: {text!r}")
    return float(m[1]) * UNITS[kind][m[2].lower()]


def parse_config(text: str) -> dict[str, str]:
    """Nested ``name { key value; ... }`` text as a flat dictionary with dotted names; ``#`` starts a comment."""
    flat, path = {}, []
    for token in re.findall(r"[^{};]*[{};]", re.sub(r"#[^\n]*", "", text)):
        body, end = token[:-1].strip(), token[-1]
        if end == "{":
            path.append(body)
        elif end == ";" and body:
            key, _, value = body.partition(" ")
            flat[".".join([*path, key])] = value.strip().strip('"')
        elif end == "}":
            path.pop()
    if path:
        raise ValueError("unclosed section " + ".".join(path))
    return flat


@dataclass(frozen=True)
class SheetSpec:
    """A grid of nodes: the centre of node (0, 0) is the north-west corner (x0, y0); rows run south."""

    x0: float
    y0: float
    dx: float
    dy: float
    cols: int
    rows: int

    @classmethod
    def from_center(cls, x: float, y: float, width: float, height: float, dx: float, dy: float) -> SheetSpec:
        """Node counts are forced odd so that a node lies on the centre."""
        cols, rows = (int(n) + 1 - int(n) % 2 for n in (width / dx, height / dy))
        return cls(x - (cols // 2) * dx, y + (rows // 2) * dy, dx, dy, cols, rows)

    @classmethod
    def from_bounds(cls, left: float, bottom: float, right: float, top: float, dx: float, dy: float) -> SheetSpec:
        return cls.from_center((left + right) / 2, (bottom + top) / 2, right - left, top - bottom, dx, dy)

    def cell(self, x: Column, y: Column) -> tuple[Column, Column]:
        """Nearest node as (row, col)."""
        return F.floor((F.lit(self.y0) - y) / self.dy + 0.5).cast("int"), F.floor((x - self.x0) / self.dx + 0.5).cast("int")

    def inside(self) -> Column:
        return F.col("row").between(0, self.rows - 1) & F.col("col").between(0, self.cols - 1)

    def node_x(self) -> Column:
        return F.col("col") * self.dx + self.x0

    def node_y(self) -> Column:
        return F.lit(self.y0) - F.col("row") * self.dy


@dataclass(frozen=True)
class Params:
    """Estimator settings; variances are squares of the order's limits."""

    order: str = "order1"
    dist_exp: float = 2.0
    dist_scale: float = 1.0
    queue_length: int = 11
    quotient_limit: float = 30.0
    discount: float = 1.0
    est_offset: float = 4.0
    bayes_threshold: float = 0.135
    run_limit: int = 5
    capture: float = 0.05
    blunder_min: float = 10.0
    blunder_pct: float = 0.25
    blunder_scalar: float = 3.0
    min_context: float = 5.0
    max_context: float = 10.0
    #: ``sample``, ``posterior`` or ``max``: the variance that uncertainties are reported from.
    uncertainty: str = "sample"

    @classmethod
    def for_spacing(cls, dx: float, dy: float, **kw) -> Params:
        """Settings for a node spacing: distances are scaled by the smaller one, contexts in metres become nodes by it."""
        return cls(dist_scale=min(dx, dy), **kw)

    def limits(self) -> tuple[float, float, float]:
        """Fixed depth error, fraction of depth and horizontal error of the order, named or by its older number; raises on an unknown one."""
        if self.order in NUMBERED_ORDERS:
            fixed, part, *_, horizontal = NUMBERED_ORDERS[self.order]
            return fixed, part, horizontal
        if self.order not in ORDERS:
            raise ValueError(f"order {self.order!r} is not known")
        return (*ORDERS[self.order], HORIZONTAL[self.order])

    @property
    def fixed2(self) -> float:
        return self.limits()[0] ** 2

    @property
    def pct2(self) -> float:
        return self.limits()[1] ** 2

    @property
    def var_scale(self) -> float:
        return math.pow(self.dist_scale, -self.dist_exp)
