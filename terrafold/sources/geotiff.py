"""GeoTIFF files as pixel rows: read as binary files, decoded on the executors.

Baseline TIFF in either byte order: strips or tiles, uncompressed or deflated, bands side by side or in planes, integer and float samples,
with the georeference (pixel size and tie point, EPSG code) and the no-data value of its tags.  Other compressions raise.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from datetime import UTC, datetime, timedelta

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from terrafold.engine.graph import GraphError
from terrafold.engine.workers import importable
from terrafold.model.descriptor import PIXEL_TYPES, Band, GeoTransform, RasterDescriptor
from terrafold.model.time import TimeStep

#: Formats of the types of tags, and pixel types by sample format and bits.
_TYPES = {1: "B", 2: "s", 3: "H", 4: "I", 6: "b", 8: "h", 9: "i", 11: "f", 12: "d", 16: "Q"}
_SAMPLES = {(1, 8): "U8", (1, 16): "U16", (1, 32): "U32", (2, 8): "I8", (2, 16): "I16", (2, 32): "I32", (3, 32): "F32", (3, 64): "F64"}
#: Parameter: rows of a file that become pixel rows at once.
ROWS = 256
EPOCH = datetime(1970, 1, 1, tzinfo=UTC)


@dataclass(frozen=True)
class Image:
    """The header of a file; ``rows`` decodes a run of rows of all bands."""

    content: bytes
    order: str
    tags: dict[int, tuple]

    @staticmethod
    def parse(content: bytes) -> Image:
        order = {b"II": "<", b"MM": ">"}.get(content[:2])
        if order is None or struct.unpack(order + "H", content[2:4])[0] != 42:
            raise GraphError("no TIFF file")
        at = struct.unpack(order + "I", content[4:8])[0]
        tags = {}
        for k in range(struct.unpack(order + "H", content[at : at + 2])[0]):
            tag, kind, count, place = struct.unpack(order + "HHI4s", content[at + 2 + 12 * k : at + 14 + 12 * k])
            if kind not in _TYPES:
                continue
            form = f"{order}{count}{_TYPES[kind]}"
            size = struct.calcsize(form)
            start = struct.unpack(order + "I", place)[0] if size > 4 else 0
            tags[tag] = struct.unpack(form, content[start : start + size] if size > 4 else place[:size])
        return Image(content, order, tags)

    def one(self, tag: int, default: float | None = None):  # noqa: ANN201
        if tag not in self.tags and default is None:
            raise GraphError(f"tag {tag} is missing")
        return self.tags.get(tag, (default,))[0]

    @property
    def shape(self) -> tuple[int, int, int]:
        """Bands, rows, columns."""
        return self.one(277, 1), self.one(257), self.one(256)

    @property
    def pixel_type(self) -> str:
        kind = _SAMPLES.get((self.one(339, 1), self.one(258, 1)))
        if kind is None:
            raise GraphError("unknown kind of samples")
        return kind

    @property
    def transform(self) -> GeoTransform:
        x_size, y_size = self.tags[33550][:2]
        col, row, _, x, y, _ = self.tags[33922][:6]
        return GeoTransform(x - col * x_size, y + row * y_size, x_size, -y_size)

    @property
    def srs(self) -> str:
        own = self.tags.get(34735, ())
        keys = {own[i]: own[i + 3] for i in range(4, len(own), 4)}
        return f"EPSG:{keys.get(3072) or keys.get(2048) or 4326}"

    @property
    def no_data(self) -> float | None:
        return float(self.tags[42113][0].split(b"\0")[0]) if 42113 in self.tags else None

    def _piece(self, index: int, shape: tuple[int, ...]) -> np.ndarray:
        offsets, sizes = (self.tags[t] for t in ((324, 325) if 324 in self.tags else (273, 279)))
        raw = self.content[offsets[index] : offsets[index] + sizes[index]]
        method = self.one(259, 1)
        if method in (8, 32946):
            raw = zlib.decompress(raw)
        elif method != 1:
            raise GraphError(f"compression {method} is not read")
        dtype = np.dtype(self.order + {"U": "u", "I": "i", "F": "f"}[self.pixel_type[0]] + str(int(self.pixel_type[1:]) // 8))
        own = np.frombuffer(raw, dtype, int(np.prod(shape)))
        if self.one(317, 1) == 2:  # differences along a row
            own = np.cumsum(own.reshape(shape), axis=len(shape) - 2, dtype=dtype)
        return own.reshape(shape)

    def rows(self, first: int, last: int) -> np.ndarray:
        """(bands, rows, columns) of rows ``first`` to ``last``, the last one not included."""
        bands, height, width = self.shape
        planes = self.one(284, 1) == 2
        out = None
        tall, wide = (self.one(323), self.one(322)) if 324 in self.tags else (self.one(278, height), width)
        across, down = -(-width // wide), -(-height // tall)
        for r in range(first // tall, -(-last // tall)):
            for c in range(across):
                lines = tall if 324 in self.tags else min(tall, height - r * tall)
                for plane in range(bands if planes else 1):
                    piece = self._piece((plane * down + r) * across + c, (lines, wide, 1 if planes else bands))
                    out = np.zeros((bands, last - first, width), piece.dtype) if out is None else out
                    top, bottom = max(first, r * tall), min(last, r * tall + lines, height)
                    right = min(width, (c + 1) * wide)
                    part = np.moveaxis(piece[top - r * tall : bottom - r * tall, : right - c * wide], 2, 0)
                    out[plane if planes else slice(None), top - first : bottom - first, c * wide : right] = part[0] if planes else part
        return out


def descriptor(content: bytes, names: tuple[str, ...] = ()) -> RasterDescriptor:
    """What the header of a file tells."""
    image = Image.parse(content)
    bands, height, width = image.shape
    return RasterDescriptor(image.pixel_type, image.transform, (0, height - 1, 0, width - 1), tuple(Band(n) for n in names or [f"band {i}" for i in range(bands)]), srs=image.srs)


def whole_path(spark: SparkSession, path: str) -> str:
    """A path as Spark's readers write it: with the scheme and the host of its file system."""
    jvm = spark._jvm.org.apache.hadoop.fs  # noqa: SLF001
    own = jvm.Path(path)
    return own.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(own).toString()  # noqa: SLF001


def regular_files(pattern: str, time: tuple[int, int], step: TimeStep, placeholders: dict[str, tuple[str, str]], reference: int = 0) -> list[tuple[str, int, int, int]]:
    """Files of a dataset with one slice for each step of ``time``: (path, start and end of its time, z-index).

    placeholders: text in the pattern -> (start or end, a format of ``strftime``), written from that end of a slice in UTC.
    """
    out = []
    for a, b in step.steps(*time, reference):
        path = pattern
        for text, (end, form) in placeholders.items():
            if end not in ("start", "end") or text not in pattern:
                raise GraphError(f"placeholder {text!r} is not in the pattern, or is no start or end")
            path = path.replace(text, (EPOCH + timedelta(milliseconds=a if end == "start" else b)).strftime(form))
        out.append((path, a, b, 0))
    return out


def read_geotiffs(spark: SparkSession, files: list[tuple[str, int, int, int]], desc: RasterDescriptor) -> DataFrame:
    """Pixel rows of ``files`` (path, start and end of its time, z-index) on the grid of ``desc``: t_start, t_end, band, y, x, value, z_index.

    Files may cover any part of the grid, so they suit GdalSource and MultiBandGdalSource; a file whose pixels don't lie on the grid raises.
    Each file is decoded by one task, a run of rows at a time.
    """
    importable(spark)
    # the reader names a file by its whole path, so that files of one name in several folders stay apart
    known = spark.createDataFrame([(whole_path(spark, p), a, b, z) for p, a, b, z in files], "file string, t_start long, t_end long, z_index long")
    content = spark.read.format("binaryFile").load(sorted({p for p, *_ in files})).select(F.col("path").alias("file"), "content").join(known, "file")
    t, whole = desc.transform, desc.data_type not in ("F32", "F64")

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            for row in part.itertuples():
                image = Image.parse(row.content)
                own, (bands, height, width) = image.transform, image.shape
                top, left = (own.y - t.y) / t.y_size, (own.x - t.x) / t.x_size
                if max(abs(top - round(top)), abs(left - round(left)), abs(own.x_size / t.x_size - 1), abs(own.y_size / t.y_size - 1)) > 1e-6:
                    raise GraphError(f"{row.file} does not lie on the grid")
                for first in range(0, height, ROWS):
                    data = image.rows(first, min(height, first + ROWS))
                    band, y, x = (a.ravel() for a in np.indices(data.shape))
                    value = data.ravel().astype(float)
                    if image.no_data is not None:
                        value = np.where(value == image.no_data, np.nan, value)
                    yield pd.DataFrame({"t_start": row.t_start, "t_end": row.t_end, "band": band, "y": y + first + round(top), "x": x + round(left), "value": value, "z_index": row.z_index})

    made = content.mapInPandas(run, "t_start long, t_end long, band int, y int, x int, value double, z_index long")
    value = F.when(~F.isnan("value"), F.col("value"))
    return made.withColumn("value", (value.cast("decimal(38,0)") if whole and desc.data_type in ("U64", "I64") else value).cast(PIXEL_TYPES[desc.data_type][2]))
