"""What is known of a result before any data is read."""

from __future__ import annotations

import math
from dataclasses import dataclass, field, replace
from typing import Any

from terrafold.model.time import TimeStep

#: Pixel types: lowest and highest value of the integers, and the Spark type that holds them.
PIXEL_TYPES = {
    "U8": (0, 2**8 - 1, "smallint"), "U16": (0, 2**16 - 1, "int"), "U32": (0, 2**32 - 1, "bigint"), "U64": (0, 2**64 - 1, "decimal(20,0)"),
    "I8": (-(2**7), 2**7 - 1, "tinyint"), "I16": (-(2**15), 2**15 - 1, "smallint"), "I32": (-(2**31), 2**31 - 1, "int"), "I64": (-(2**63), 2**63 - 1, "bigint"),
    "F32": (None, None, "float"), "F64": (None, None, "double"),
}


def is_float(data_type: str) -> bool:
    return data_type in ("F32", "F64")


@dataclass(frozen=True)
class GeoTransform:
    """Origin and pixel sizes; the y size is negative as a rule."""

    x: float
    y: float
    x_size: float
    y_size: float

    def centre(self, row: int, col: int) -> tuple[float, float]:
        return self.x + (col + 0.5) * self.x_size, self.y + (row + 0.5) * self.y_size

    def pixel(self, x: float, y: float) -> tuple[int, int]:
        """(row, column) of a coordinate."""
        return math.floor((y - self.y) / self.y_size), math.floor((x - self.x) / self.x_size)


@dataclass(frozen=True)
class Measurement:
    """unitless, continuous (with a unit) or classification (with labels of the classes)."""

    kind: str = "unitless"
    name: str = ""
    unit: str | None = None
    classes: tuple[tuple[int, str], ...] = ()


@dataclass(frozen=True)
class Band:
    name: str
    measurement: Measurement = Measurement()


@dataclass(frozen=True)
class RasterDescriptor:
    """data_type, spatial reference, transform, pixel bounds (first and last row, first and last column), bands, time."""

    data_type: str
    transform: GeoTransform
    pixels: tuple[int, int, int, int]
    bands: tuple[Band, ...]
    srs: str = "EPSG:4326"
    time: tuple[int, int] | None = None
    step: TimeStep | None = None
    reference: int = 0
    properties: tuple[tuple[str, Any], ...] = ()

    kind = "raster"

    def __post_init__(self) -> None:
        if self.data_type not in PIXEL_TYPES:
            raise ValueError(f"unknown pixel type {self.data_type!r}")
        names = [b.name for b in self.bands]
        if len(set(names)) < len(names):
            raise ValueError("band names must be unique")

    def property(self, key: str, default: Any = None) -> Any:
        return dict(self.properties).get(key, default)

    def but(self, **changes: Any) -> RasterDescriptor:
        return replace(self, **changes)


@dataclass(frozen=True)
class VectorDescriptor:
    """geometry (Data, MultiPoint, MultiLineString, MultiPolygon) and columns with their types (category, int, float, text, bool, datetime)."""

    geometry: str
    columns: dict[str, str] = field(default_factory=dict)
    srs: str | None = "EPSG:4326"
    measurements: dict[str, Measurement] = field(default_factory=dict)

    kind = "vector"

    def but(self, **changes: Any) -> VectorDescriptor:
        return replace(self, **changes)


@dataclass(frozen=True)
class PlotDescriptor:
    srs: str | None = None

    kind = "plot"
