"""What a query asks for."""

from __future__ import annotations

import math
from dataclasses import dataclass, replace
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terrafold.model.descriptor import GeoTransform
from terrafold.model.time import MAX_MS, MIN_MS, intersects


@dataclass(frozen=True)
class Rect:
    """Bounds and a time interval, and bands or columns.

    bbox: x_min, y_min, x_max, y_max for vectors; pixels: first and last row, first and last column for rasters.  None is all.
    """

    bbox: tuple[float, float, float, float] | None = None
    pixels: tuple[int, int, int, int] | None = None
    time: tuple[int, int] = (MIN_MS, MAX_MS)
    bands: tuple[int, ...] | None = None
    columns: tuple[str, ...] | None = None

    def but(self, **changes: Any) -> Rect:
        return replace(self, **changes)

    def on_grid(self, transform: GeoTransform) -> Rect:
        """With pixel bounds for the box, if only the box is given."""
        if self.pixels is not None or self.bbox is None:
            return self
        rows = sorted([(self.bbox[1] - transform.y) / transform.y_size, (self.bbox[3] - transform.y) / transform.y_size])
        cols = sorted([(self.bbox[0] - transform.x) / transform.x_size, (self.bbox[2] - transform.x) / transform.x_size])
        first = lambda v: math.floor(v + 1e-9)
        last = lambda v: math.ceil(v - 1e-9) - 1
        return self.but(pixels=(first(rows[0]), last(rows[1]), first(cols[0]), last(cols[1])))

    def grown(self, rows: int, cols: int) -> Rect:
        """With a margin of pixels."""
        if self.pixels is None:
            return self
        a, b, c, d = self.pixels
        return self.but(pixels=(a - rows, b + rows, c - cols, d + cols))

    def in_time(self, df: DataFrame) -> DataFrame:
        if self.time == (MIN_MS, MAX_MS):
            return df
        return df.where(intersects(F.col("t_start"), F.col("t_end"), F.lit(self.time[0]), F.lit(self.time[1])))

    def of_pixels(self, df: DataFrame) -> DataFrame:
        """Pixel rows inside the bounds, the time and the bands; plain comparisons, so that a scan can skip what lies outside."""
        if self.pixels is not None:
            a, b, c, d = self.pixels
            df = df.where(F.col("y").between(a, b) & F.col("x").between(c, d))
        if self.bands is not None:
            df = df.where(F.col("band").isin(list(self.bands)))
        return self.in_time(df)
