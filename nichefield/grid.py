"""Driver-side descriptions of a cell table: its grid and the layers it was built from."""

from __future__ import annotations

import math
from dataclasses import dataclass

# Grid comparison tolerance, slack when rounding up to whole cells,
# default missing-value markers, default random seed.
GRID_TOLERANCE = 1e-6
CEIL_SLACK = 1e-9
FLOAT_NODATA = -9999.0
BINARY_NODATA = 255
DEFAULT_SEED = 42


def cells_across(span: float, resolution: float) -> int:
    """Whole cells needed to cover ``span``; at least one."""
    return max(1, math.ceil(span / resolution - CEIL_SLACK))


@dataclass(frozen=True)
class Grid:
    """North-up grid anchored at its top-left corner (``minx``, ``maxy``)."""

    minx: float
    maxy: float
    res_x: float
    res_y: float
    width: int
    height: int
    crs: str = ""

    def __post_init__(self) -> None:
        if self.res_x <= 0 or self.res_y <= 0:
            raise ValueError("cells must have a positive size")
        if self.width < 1 or self.height < 1:
            raise ValueError("a grid needs at least one row and one column")

    @property
    def maxx(self) -> float:
        return self.minx + self.width * self.res_x

    @property
    def miny(self) -> float:
        return self.maxy - self.height * self.res_y

    @property
    def bounds(self) -> tuple[float, float, float, float]:
        return self.minx, self.miny, self.maxx, self.maxy

    @property
    def n_cells(self) -> int:
        return self.width * self.height

    @property
    def shorter_side(self) -> float:
        return min(self.maxx - self.minx, self.maxy - self.miny)

    @classmethod
    def covering(cls, bounds, res_x: float, res_y: float, crs: str = "") -> "Grid":
        """Smallest grid of whole cells that covers ``bounds`` from its top-left corner."""
        minx, miny, maxx, maxy = (float(v) for v in bounds)
        if res_x <= 0 or res_y <= 0:
            raise ValueError("cells must have a positive size")
        if maxx <= minx or maxy <= miny:
            raise ValueError("empty extent: nothing is common to the layers, or east and west or north and south are swapped")
        return cls(minx, maxy, res_x, res_y, cells_across(maxx - minx, res_x),
                   cells_across(maxy - miny, res_y), crs)


@dataclass(frozen=True)
class Layer:
    """Header of one predictor layer; ``a``..``f`` are its affine coefficients."""

    name: str
    crs: str
    dtype: str
    width: int
    height: int
    a: float
    b: float
    c: float
    d: float
    e: float
    f: float
    nodata: float | None = None

    @property
    def resolution(self) -> tuple[float, float]:
        return abs(self.a), abs(self.e)

    @property
    def bounds(self) -> tuple[float, float, float, float]:
        xs = (self.c, self.c + self.a * self.width)
        ys = (self.f, self.f + self.e * self.height)
        return min(xs), min(ys), max(xs), max(ys)

    @property
    def grid(self) -> Grid:
        if abs(self.b) > GRID_TOLERANCE or abs(self.d) > GRID_TOLERANCE:
            raise ValueError(f"layer {self.name!r} is rotated; regrid it first")
        minx, _, _, maxy = self.bounds
        return Grid(minx, maxy, *self.resolution, self.width, self.height, self.crs)

    @classmethod
    def on_grid(cls, name: str, grid: Grid, dtype: str = "float32",
                nodata: float | None = None) -> "Layer":
        return cls(name, grid.crs, dtype, grid.width, grid.height, grid.res_x, 0.0, grid.minx,
                   0.0, -grid.res_y, grid.maxy, nodata)
