"""Results that are kept: a later query of the same graph inside a kept rectangle reads them."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terrafold.engine.graph import Context, Operator
from terrafold.functions import geometry
from terrafold.model.rect import Rect


def contains(outer: Rect, inner: Rect) -> bool:
    """Whether all that ``inner`` asks for is part of ``outer``."""
    box = outer.bbox is None or (inner.bbox is not None and outer.bbox[0] <= inner.bbox[0] and outer.bbox[1] <= inner.bbox[1] and inner.bbox[2] <= outer.bbox[2] and inner.bbox[3] <= outer.bbox[3])
    o, i = outer.pixels, inner.pixels
    pixels = o is None or (i is not None and o[0] <= i[0] and i[1] <= o[1] and o[2] <= i[2] and i[3] <= o[3])
    bands = outer.bands is None or (inner.bands is not None and set(inner.bands) <= set(outer.bands))
    columns = outer.columns is None or (inner.columns is not None and set(inner.columns) <= set(outer.columns))
    return box and pixels and bands and columns and outer.time[0] <= inner.time[0] and inner.time[1] <= outer.time[1]


@dataclass
class _Entry:
    rect: Rect
    df: DataFrame


class QueryCache:
    """The newest results by graph; the oldest go when there are more than ``most``.

    Only raster results and features that keep their own time can be cut to a smaller rectangle; both are filtered by the same predicates as a source.
    Results that depend on the query's time as a whole (rasterised features, windows) are found again for an equal rectangle only.
    """

    WHOLE = ("Rasterization", "TemporalRasterAggregation", "TimeShift", "TimeProjection")

    def __init__(self, ctx: Context, most: int = 16):
        self.ctx, self.most, self.entries = ctx, most, {}
        self.hits = self.misses = 0

    def _cuttable(self, node: Operator) -> bool:
        return node.TYPE not in self.WHOLE and all(map(self._cuttable, node.inputs()))

    def query(self, node: Operator, rect: Rect) -> DataFrame:
        key, desc = node.key(), node.describe(self.ctx)
        for e in self.entries.get(key, ()):
            if e.rect == rect:
                self.hits += 1
                return e.df
            if self._cuttable(node) and contains(e.rect, rect):
                self.hits += 1
                if desc.kind == "raster":
                    return rect.on_grid(desc.transform).of_pixels(e.df)
                found = rect.in_time(e.df)
                if rect.bbox is not None and desc.geometry != "Data":
                    found = found.where(geometry.overlaps_box(F.col("geom"), desc.geometry, rect.bbox))
                return found if rect.columns is None else found.select(*[c for c in found.columns if c in ("t_start", "t_end", "geom") or c in rect.columns])
        self.misses += 1
        df = node.query(self.ctx, rect).persist(StorageLevel.MEMORY_AND_DISK)
        self.entries.setdefault(key, []).append(_Entry(rect, df))
        while sum(map(len, self.entries.values())) > self.most:
            oldest = next(iter(self.entries))
            self.entries[oldest].pop(0).df.unpersist()
            if not self.entries[oldest]:
                del self.entries[oldest]
        return df
