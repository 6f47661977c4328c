"""A registered graph, with the calls of a client."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from typing import Any

from pyspark.sql import DataFrame

from terrafold.engine.graph import Context, Operator, from_json
from terrafold.model.rect import Rect

_SPACE = uuid.UUID("6f0e1c9a-6f2b-5f0e-9d7a-0b8f6a1c2d3e")


class Workflow:
    """A graph and its context.  The id depends on the graph alone, so registering it again changes nothing."""

    def __init__(self, graph: Operator | dict | str, ctx: Context):
        self.graph = graph if isinstance(graph, Operator) else from_json(graph)
        self.ctx = ctx
        self.descriptor = self.graph.describe(ctx)
        self.id = uuid.uuid5(_SPACE, self.graph.key())

    def query(self, rect: Rect | None = None) -> DataFrame:
        """A lazy DataFrame."""
        return self.graph.query(self.ctx, rect or Rect())

    def get_dataframe(self, rect: Rect | None = None) -> Any:
        """A pandas DataFrame of a vector result."""
        return self.query(rect).toPandas()

    def get_array(self, rect: Rect, band: int = 0) -> Any:
        """A masked numpy array (time, row, column) of one band; the rectangle must have pixel bounds."""
        import numpy as np

        rows = self.query(rect.on_grid(self.descriptor.transform).but(bands=(band,))).toPandas()
        a, b, c, d = rect.on_grid(self.descriptor.transform).pixels
        times = sorted(rows["t_start"].unique())
        out = np.ma.masked_all((len(times), b - a + 1, d - c + 1))
        known = rows[rows["value"].notna()]
        at = (known["t_start"].map({t: i for i, t in enumerate(times)}).to_numpy(), (known["y"] - a).to_numpy(), (known["x"] - c).to_numpy())
        out[at] = known["value"].to_numpy(float)
        return out

    def time_slices(self, rect: Rect | None = None) -> DataFrame:
        """Which slices of time a raster has in the rectangle, without their pixels' values."""
        return self.query(rect).select("t_start", "t_end").distinct()

    def raster_stream(self, rect: Rect | None = None, size: int = 512) -> Iterator[Any]:
        """Tiles by time, then place, then band; one partition of them at a time comes to the driver."""
        from terrafold.sinks.outputs import tiles

        yield from tiles(self.query(rect), size).orderBy("t_start", "tile_y", "tile_x", "band").toLocalIterator()

    def vector_stream(self, rect: Rect | None = None) -> Iterator[Any]:
        """Features, one partition at a time."""
        yield from self.query(rect).toLocalIterator()

    def plot_json(self, rect: Rect | None = None) -> dict:
        """The document of a plot."""
        return self.graph.document(self.ctx, rect or Rect())

    def save(self, path: str, rect: Rect | None = None) -> None:
        """Store the result as a dataset: Parquet."""
        self.query(rect).write.parquet(path)
