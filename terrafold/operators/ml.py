"""Scoring of pixels by a model.

A model is an ONNX file, or any callable that takes an array (pixels, bands) and returns one value for each pixel; it is applied to Arrow
batches on the executors.  A model of whole tiles takes an array (1, rows, columns, bands) and returns one value for each pixel of it.  A file is
read once, on the driver, and its bytes go with the tasks, so that no executor needs the path.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from typing import Any, ClassVar

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terrafold.engine.graph import Context, GraphError, Operator, need
from terrafold.engine.workers import importable
from terrafold.model.descriptor import PIXEL_TYPES, Band, RasterDescriptor
from terrafold.model.rect import Rect


@dataclass(frozen=True)
class Model:
    """score: callable, or path or bytes of an ONNX file.  tile: rows and columns of a model of whole tiles.  input_no_data: a number (a pixel counts if any band has data) or None (only if all have).
    output_no_data: a number, "nan" or None."""

    score: Callable[[np.ndarray], np.ndarray] | str | bytes
    bands: int
    input_type: str = "F32"
    output_type: str = "F32"
    input_no_data: float | None = None
    output_no_data: float | str | None = None
    tile: tuple[int, int] | None = None


def linear(weights: tuple[float, ...], bias: float = 0.0) -> Callable[[np.ndarray], np.ndarray]:
    """A model that needs no file."""
    w = np.array(weights, float)
    return lambda x: x.astype(float) @ w + bias


def _field(number: int, value: int | bytes | str) -> bytes:
    """A field of a protocol buffer: a number, or bytes."""

    def varint(v: int) -> bytes:
        out = bytearray()
        while v > 127:
            out.append(v & 127 | 128)
            v >>= 7
        return bytes([*out, v])

    if isinstance(value, int):
        return varint(number << 3) + varint(value)
    value = value.encode() if isinstance(value, str) else value
    return varint(number << 3 | 2) + varint(len(value)) + value


def onnx_linear(weights: tuple[float, ...], bias: float = 0.0) -> bytes:
    """An ONNX file of one matrix product: floats (pixels, bands) to (pixels, 1).  Numbers of fields and types are those of the format."""
    tensor = lambda name, values, *dims: _field(5, b"".join(_field(1, d) for d in dims) + _field(2, 1) + _field(8, name) + _field(9, np.array(values, "<f4").tobytes()))
    shape = lambda n: _field(1, _field(2, "pixels")) + _field(1, _field(1, n))
    slot = lambda number, name, n: _field(number, _field(1, name) + _field(2, _field(1, _field(1, 1) + _field(2, shape(n)))))
    node = _field(1, _field(1, "x") + _field(1, "w") + _field(1, "b") + _field(2, "y") + _field(4, "Gemm"))
    graph = node + _field(2, "linear") + tensor("w", weights, len(weights), 1) + tensor("b", [bias], 1) + slot(11, "x", len(weights)) + slot(12, "y", 1)
    return _field(1, 8) + _field(7, graph) + _field(8, _field(2, 13))


def _session(model: bytes) -> Callable[[np.ndarray], np.ndarray]:
    import onnxruntime

    session = onnxruntime.InferenceSession(model, providers=["CPUExecutionProvider"])
    name = session.get_inputs()[0].name
    return lambda x: np.asarray(session.run(None, {name: x})[0])


@dataclass(frozen=True)
class Onnx(Operator):
    """One band ``prediction``: the first output of a model over all bands of each pixel."""

    TYPE: ClassVar[str] = "Onnx"
    KEEPS_TIME: ClassVar[bool] = True
    INPUTS: ClassVar[tuple[str, ...]] = ("raster",)
    raster: Operator
    model: str = field(default="")

    def describe(self, ctx: Context) -> RasterDescriptor:
        desc, model = need("raster", self.raster, ctx), ctx.models.get(self.model)
        if model is None:
            raise GraphError(f"unknown model {self.model!r}")
        if model.bands != len(desc.bands):
            raise GraphError(f"the model takes {model.bands} bands, not {len(desc.bands)}")
        if model.input_type != desc.data_type:
            raise GraphError(f"the model takes {model.input_type}, not {desc.data_type}")
        return desc.but(data_type=model.output_type, bands=(Band("prediction"),))

    def query(self, ctx: Context, rect: Rect) -> DataFrame:
        self.describe(ctx)
        importable(ctx.spark)
        model, file = ctx.models[self.model], None
        if isinstance(model.score, str):
            file = bytes(ctx.spark.read.format("binaryFile").load(model.score).select("content").first()[0])
        elif isinstance(model.score, bytes):
            file = model.score
        call = None if file else model.score
        found = self.raster.query(ctx, rect.but(bands=None))
        cols = [f"b{i}" for i in range(model.bands)]
        wide = found.groupBy("t_start", "t_end", "y", "x").agg(*[F.max(F.when(F.col("band") == i, F.col("value"))).cast("double").alias(c) for i, c in enumerate(cols)])
        dtype = {"F32": np.float32, "F64": np.float64}.get(model.input_type) or np.dtype(model.input_type.replace("U", "uint").replace("I", "int"))

        def scored(score: Callable[[np.ndarray], np.ndarray], part: pd.DataFrame) -> pd.DataFrame:
            x = part[cols].to_numpy(float)
            missing = np.isnan(x)
            valid = ~missing.all(axis=1) if model.input_no_data is not None else ~missing.any(axis=1)
            fed = np.where(missing, 0.0 if model.input_no_data is None else model.input_no_data, x)
            out: Any = np.full(len(x), np.nan)
            if valid.any() and model.tile is None:
                out[valid] = np.asarray(score(fed[valid].astype(dtype)), float).reshape(int(valid.sum()), -1)[:, 0]
            elif valid.any():
                rows, columns = model.tile
                at = (part["y"].to_numpy() % rows, part["x"].to_numpy() % columns)
                whole = np.full((1, rows, columns, model.bands), 0.0 if model.input_no_data is None else model.input_no_data)
                whole[0][at] = fed
                out = np.where(valid, np.asarray(score(whole.astype(dtype)), float).reshape(rows, columns, -1)[:, :, 0][at], np.nan)
            if model.output_no_data not in (None, "nan"):
                out = np.where(out == model.output_no_data, np.nan, out)
            return part[["t_start", "t_end", "y", "x"]].assign(value=out)

        def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            score = _session(file) if file else call
            for part in parts:
                yield scored(score, part)

        schema = "t_start long, t_end long, y int, x int, value double"
        if model.tile is None:
            made = wide.mapInPandas(run, schema)
        else:  # a tile is what the model takes at once
            rows, columns = model.tile
            tile = [F.floor(F.col("y") / rows).alias("tile_y"), F.floor(F.col("x") / columns).alias("tile_x")]
            made = wide.groupBy("t_start", "t_end", *tile).applyInPandas(lambda part: next(run(iter([part]))), schema)
        value = F.when(~F.isnan("value"), F.col("value")).cast(PIXEL_TYPES[model.output_type][2])
        return made.select("t_start", "t_end", F.lit(0).alias("band"), "y", "x", value.alias("value"))
