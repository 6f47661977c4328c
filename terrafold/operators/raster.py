"""Operators on pixel rows."""

from __future__ import annotations

import bisect
from dataclasses import dataclass, field
from typing import ClassVar

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from terrafold.engine.graph import Context, GraphError, Operator, need
from terrafold.functions import expression
from terrafold.functions.casts import machine_cast, saturated
from terrafold.model.descriptor import PIXEL_TYPES, Band, RasterDescriptor, is_float
from terrafold.model.rect import Rect
from terrafold.model.time import MAX_MS, MIN_MS, TimeStep, interval_intersects, to_ms

PIXEL = ("t_start", "t_end", "band", "y", "x")


#: Parameter: pieces of time that are broadcast at most.
BROADCAST_PIECES = 100_000


@dataclass(frozen=True)
class BandFilter(Operator):
    """Bands by name or index, in the source's order, numbered anew."""

    TYPE: ClassVar[str] = "BandFilter"
    KEEPS_TIME: ClassVar[bool] = True
    INPUTS: ClassVar[tuple[str, ...]] = ("raster",)
    raster: Operator
    bands: tuple = ()

    def _chosen(self, desc: RasterDescriptor) -> list[int]:
        if not self.bands:
            raise GraphError("no bands")
        names, out = [b.name for b in desc.bands], set()
        for b in self.bands:
            i = names.index(b) if b in names else b
            if not isinstance(i, int) or not 0 <= i < len(names):
                raise GraphError(f"unknown band {b!r}")
            out.add(i)
        return sorted(out)

    def describe(self, ctx: Context) -> RasterDescriptor:
        desc = need("raster", self.raster, ctx)
        return desc.but(bands=tuple(desc.bands[i] for i in self._chosen(desc)))

    def query(self, ctx: Context, rect: Rect) -> DataFrame:
        chosen = self._chosen(need("raster", self.raster, ctx))
        asked = [i for k, i in enumerate(chosen) if rect.bands is None or k in rect.bands]
        found = self.raster.query(ctx, rect.but(bands=tuple(asked)))
        new = F.coalesce(*[F.when(F.col("band") == i, F.lit(k)) for k, i in enumerate(chosen)])
        return found.withColumn("band", new)


@dataclass(frozen=True)
class RasterTypeConversion(Operator):
    """Every pixel as another type, as machine arithmetic casts."""

    TYPE: ClassVar[str] = "RasterTypeConversion"
    KEEPS_TIME: ClassVar[bool] = True
    INPUTS: ClassVar[tuple[str, ...]] = ("raster",)
    raster: Operator
    output_data_type: str

    def describe(self, ctx: Context) -> RasterDescriptor:
        return need("raster", self.raster, ctx).but(data_type=self.output_data_type)

    def query(self, ctx: Context, rect: Rect) -> DataFrame:
        source = need("raster", self.raster, ctx).data_type
        return self.raster.query(ctx, rect).withColumn("value", machine_cast(F.col("value"), source, self.output_data_type))


def _constant(number: float, kind: str) -> float | int:
    """A number as a constant of a pixel type: cut off and saturated for integers."""
    low, high, _ = PIXEL_TYPES[kind]
    return float(number) if low is None else max(low, min(high, int(number)))


@dataclass(frozen=True)
class RasterScaling(Operator):
    """mulSlopeAddOffset: value * slope + offset; subOffsetDivSlope: (value - offset) / slope.

    slope and offset: {"type": "auto"} (the dataset's scale and offset), {"type": "metadataKey", "key"} or {"type": "constant", "value"}.  They are cast to
    the pixel type first; what overflows an integer type, or divides by zero there, is no data.
    """

    TYPE: ClassVar[str] = "RasterScaling"
    KEEPS_TIME: ClassVar[bool] = True
    INPUTS: ClassVar[tuple[str, ...]] = ("raster",)
    raster: Operator
    slope: dict = field(hash=False)
    offset: dict = field(hash=False)
    scaling_mode: str = "mulSlopeAddOffset"
    output_measurement: str | None = None

    def _number(self, desc: RasterDescriptor, spec: dict, auto: str, default: float) -> float:
        if spec["type"] == "constant":
            return spec["value"]
        key = auto if spec["type"] == "auto" else spec["key"]
        value = desc.property(key, default if spec["type"] == "auto" else None)
        if value is None:
            raise GraphError(f"no property {key!r}")
        return value

    def describe(self, ctx: Context) -> RasterDescriptor:
        if self.scaling_mode not in ("mulSlopeAddOffset", "subOffsetDivSlope"):
            raise GraphError(f"unknown mode {self.scaling_mode!r}")
        return need("raster", self.raster, ctx)

    def query(self, ctx: Context, rect: Rect) -> DataFrame:
        desc = self.describe(ctx)
        kind = desc.data_type
        slope = _constant(self._number(desc, self.slope, "scale", 1.0), kind)
        offset = _constant(self._number(desc, self.offset, "offset", 0.0), kind)
        v = F.col("value")
        if is_float(kind):
            spark_type = PIXEL_TYPES[kind][2]
            s, o = F.lit(slope).cast(spark_type), F.lit(offset).cast(spark_type)
            made = v * s + o if self.scaling_mode == "mulSlopeAddOffset" else expression.divide((v - o).cast("double"), s.cast("double")).cast(spark_type)
        else:
            low, high, _ = PIXEL_TYPES[kind]
            wide = lambda c: c.cast("decimal(38,0)")
            checked = lambda c: F.when(c.between(F.lit(str(low)).cast("decimal(38,0)"), F.lit(str(high)).cast("decimal(38,0)")), c)
            s, o = wide(F.lit(slope)), wide(F.lit(offset))
            if self.scaling_mode == "mulSlopeAddOffset":
                made = checked((checked((wide(v) * s).cast("decimal(38,0)")) + o).cast("decimal(38,0)"))
            else:
                left = checked((wide(v) - o).cast("decimal(38,0)"))
                part = F.floor(F.abs(left) / max(1, abs(slope)))
                cut = F.when((left >= 0) == F.lit(slope > 0), part).otherwise(-part)  # towards zero
                made = F.lit(None) if slope == 0 else checked(cut.cast("decimal(38,0)"))
            made = made.cast(PIXEL_TYPES[kind][2])
        return self.raster.query(ctx, rect).withColumn("value", made)


BAND_NAMES = "ABCDEFGH"


@dataclass(frozen=True)
class Expression(Operator):
    """One band from an expression over at most eight bands, A to H.

    Bands of a pixel are brought together by one aggregation, which combines rows before the exchange.
    """

    TYPE: ClassVar[str] = "Expression"
    KEEPS_TIME: ClassVar[bool] = True
    INPUTS: ClassVar[tuple[str, ...]] = ("raster",)
    raster: Operator
    expression: str
    output_type: str = "F64"
    output_band: str | None = None
    map_no_data: bool = False

    def describe(self, ctx: Context) -> RasterDescriptor:
        desc = need("raster", self.raster, ctx)
        if len(desc.bands) > 8:
            raise GraphError("at most eight bands")
        return desc.but(data_type=self.output_type, bands=(Band(self.output_band or "expression"),))

    def query(self, ctx: Context, rect: Rect) -> DataFrame:
        desc = need("raster", self.raster, ctx)
        found = self.raster.query(ctx, rect.but(bands=None))
        n = len(desc.bands)
        if n == 1:
            wide = found.select("t_start", "t_end", "y", "x", F.col("value").cast("double").alias("A"))
        else:
            wide = found.groupBy("t_start", "t_end", "y", "x").agg(*[F.max(F.when(F.col("band") == i, F.col("value"))).cast("double").alias(BAND_NAMES[i]) for i in range(n)])
        names = {BAND_NAMES[i]: expression.Value(F.col(BAND_NAMES[i])) for i in range(n)}
        value = expression.compiled(self.expression, names).column
        if not self.map_no_data:
            value = F.when(expression.known(*[F.col(c) for c in names]), value)
        value = machine_cast(value, "F64", self.output_type)
        out = wide.select("t_start", "t_end", F.lit(0).alias("band"), "y", "x", value.alias("value"))
        return out if rect.bands is None or 0 in rect.bands else out.where(F.lit(False))


@dataclass(frozen=True)
class BandwiseExpression(Operator):
    """An expression over ``x``, for each band by itself."""

    TYPE: ClassVar[str] = "BandwiseExpression"
    KEEPS_TIME: ClassVar[bool] = True
    INPUTS: ClassVar[tuple[str, ...]] = ("raster",)
    raster: Operator
    expression: str
    output_type: str = "F64"
    map_no_data: bool = False

    def describe(self, ctx: Context) -> RasterDescriptor:
        return need("raster", self.raster, ctx).but(data_type=self.output_type)

    def query(self, ctx: Context, rect: Rect) -> DataFrame:
        self.describe(ctx)
        x = F.col("value").cast("double")
        value = expression.compiled(self.expression, {"x": expression.Value(x)}).column
        if not self.map_no_data:
            value = F.when(x.isNotNull(), value)
        return self.raster.query(ctx, rect).withColumn("value", machine_cast(value, "F64", self.output_type))


@dataclass(frozen=True)
class TemporalRasterAggregation(Operator):
    """Pixels over tumbling calendar windows.

    A slice counts in each window that it intersects; a window without slices is without data.  aggregation: dict of type (min, max, first, last, mean, sum, count,
    percentileEstimate), ignoreNoData, percentile.  Without ignoreNoData one pixel without data makes the result no data.
    first and last take the pixel of the first or last slice (by start, then end), or with ignoreNoData the first or last pixel with data.  sum and count stay
    inside the pixel type's range.  With output_type values are cast first.  The percentile is the exact one, interpolated between ranks.
    """

    TYPE: ClassVar[str] = "TemporalRasterAggregation"
    INPUTS: ClassVar[tuple[str, ...]] = ("raster",)
    raster: Operator
    aggregation: dict = field(hash=False)
    window: TimeStep | dict = field(hash=False)
    window_reference: int | str | None = None
    output_type: str | None = None

    def describe(self, ctx: Context) -> RasterDescriptor:
        desc = need("raster", self.raster, ctx)
        kind = self.aggregation.get("type")
        if kind not in ("min", "max", "first", "last", "mean", "sum", "count", "percentileEstimate"):
            raise GraphError(f"unknown aggregation {kind!r}")
        if kind == "percentileEstimate" and not 0 < self.aggregation.get("percentile", 0) < 1:
            raise GraphError("a percentile lies between 0 and 1")
        return desc.but(data_type=self.output_type or desc.data_type, step=TimeStep.of(self.window), reference=to_ms(self.window_reference or 0))

    def _hull(self, ctx: Context, rect: Rect) -> tuple[int, int, int]:
        """Start of the first window, start of the last one, and its end."""
        source, desc = need("raster", self.raster, ctx), self.describe(ctx)
        step, ref = desc.step, desc.reference
        low, high = rect.time
        if (low, high) == (MIN_MS, MAX_MS) and source.time:
            low, high = source.time
        first, last = step.snap_ms(low, ref), high if low == high else step.snap_ms(max(low, high - 1), ref)
        return first, last, MAX_MS if last >= MAX_MS else step.add_ms(last)

    def times(self, ctx: Context, rect: Rect) -> list[tuple[int, int]] | None:
        first, _, end = self._hull(ctx, rect)
        desc = self.describe(ctx)
        return None if first <= MIN_MS or end >= MAX_MS else desc.step.steps(first, end, desc.reference)

    def query(self, ctx: Context, rect: Rect) -> DataFrame:
        from terrafold.sources.tables import empty_pixels, missing_slices

        source, desc = need("raster", self.raster, ctx), self.describe(ctx)
        step, ref = desc.step, desc.reference
        low, last_start, end = self._hull(ctx, rect)
        wide = (low, last_start)
        asked = rect.but(time=(wide[0], end))
        found = self.raster.query(ctx, asked).withColumn("real", F.lit(True))
        if wide[0] > MIN_MS and end < MAX_MS:
            # windows that no slice meets: told by the source's slices, else by the times of its pixels
            slices, on_grid = self.raster.times(ctx, asked), asked.on_grid(desc.transform)
            if slices is None:
                empty = missing_slices(ctx.spark, found.select("t_start", "t_end").distinct(), (wide[0], end), step, ref)
            else:
                gaps = [w for w in step.steps(wide[0], end, ref) if not any(interval_intersects(w, o) for o in meeting(slices, w))]
                empty = ctx.spark.createDataFrame(gaps, "t_start long, t_end long") if gaps else None
            if empty is not None:
                found = found.unionByName(empty_pixels(ctx, empty, source, on_grid).withColumn("real", F.lit(False)))
        kind, spark_type = desc.data_type, PIXEL_TYPES[desc.data_type][2]
        if self.output_type:
            found = found.withColumn("value", machine_cast(F.col("value"), source.data_type, kind))
        first = F.greatest(F.col("t_start"), F.lit(wide[0]))
        last = F.least(F.greatest(F.col("t_start"), F.col("t_end") - 1), F.lit(end - 1))
        # a slice names its windows by number: rows multiply only where it spans several
        found = found.withColumn("w", F.explode(F.sequence(step.index(first, ref), step.index(last, ref))))
        v, strict = F.col("value"), not self.aggregation.get("ignoreNoData", False)
        order = F.struct("t_start", "t_end")
        name = self.aggregation["type"]
        if name in ("first", "last"):
            pick = F.min_by if name == "first" else F.max_by
            value = pick(v, order if strict else F.when(v.isNotNull(), order))
        else:
            wide_type = "double" if is_float(kind) else "decimal(38,0)" if kind in ("U64", "I64") else "bigint"
            value = {
                "min": lambda: F.min(v),
                "max": lambda: F.max(v),
                "mean": lambda: machine_cast(F.avg(v.cast("double")), "F64", kind),
                "sum": lambda: saturated(F.coalesce(F.sum(v.cast(wide_type)), F.lit(0)) if not strict else F.sum(v.cast(wide_type)), kind),
                "count": lambda: F.when(F.max("real"), saturated(F.count(v), kind)),
                "percentileEstimate": lambda: machine_cast(F.percentile(v.cast("double"), F.lit(self.aggregation["percentile"])), "F64", kind),
            }[name]()
            if strict:
                value = F.when((F.count(v) == F.count(F.lit(1))) & F.max("real"), value)
            elif name == "sum":
                value = F.when(F.count(v) > 0, value)
        out = found.groupBy("w", "band", "y", "x").agg(value.cast(spark_type).alias("value"))
        return out.select(step.at(F.col("w"), ref).alias("t_start"), step.at(F.col("w") + 1, ref).alias("t_end"), "band", "y", "x", "value")


@dataclass(frozen=True)
class NeighborhoodAggregate(Operator):
    """sum or standardDeviation over a kernel of odd size.

    neighborhood: {"type": "rectangle", "dimensions": (rows, columns)} or {"type": "weightsMatrix", "weights": rows}.  A sum needs data everywhere under the
    kernel; the deviation (of a population) needs two values.  Rows are combined along x and then along y by windows over neighbouring
    rows: two exchanges of as many rows as there are pixels, whatever the kernel's size.
    """

    TYPE: ClassVar[str] = "NeighborhoodAggregate"
    KEEPS_TIME: ClassVar[bool] = True
    INPUTS: ClassVar[tuple[str, ...]] = ("raster",)
    raster: Operator
    neighborhood: dict = field(hash=False)
    aggregate_function: str = "sum"

    def _weights(self) -> list[list[float]]:
        if self.neighborhood["type"] == "rectangle":
            rows, cols = self.neighborhood["dimensions"]
            weights = [[1.0] * cols for _ in range(rows)]
        else:
            weights = [[float(w) for w in row] for row in self.neighborhood["weights"]]
        if len(weights) % 2 == 0 or any(len(r) % 2 == 0 or len(r) != len(weights[0]) for r in weights):
            raise GraphError("a kernel has odd sides")
        return weights

    def describe(self, ctx: Context) -> RasterDescriptor:
        if self.aggregate_function not in ("sum", "standardDeviation"):
            raise GraphError(f"unknown function {self.aggregate_function!r}")
        self._weights()
        return need("raster", self.raster, ctx)

    def query(self, ctx: Context, rect: Rect) -> DataFrame:
        desc, weights = self.describe(ctx), self._weights()
        rows, cols = len(weights) // 2, len(weights[0]) // 2
        rect = rect.on_grid(desc.transform)
        found = self.raster.query(ctx, rect.grown(rows, cols))
        along_x = Window.partitionBy("t_start", "t_end", "band", "y").orderBy("x")
        along_y = Window.partitionBy("t_start", "t_end", "band", "x").orderBy("y")
        # a neighbouring row is a neighbouring pixel only where its place says so
        near = lambda name, d, w, at: F.col(name) if d == 0 else F.when(F.lag(at, -d).over(w) == F.col(at) + d, F.lag(name, -d).over(w))
        v = F.col("value").cast("double")
        across = found.select(*PIXEL, v.alias("v"))
        parts = {f"n{d}": near("v", d, along_x, "x") for d in range(-cols, cols + 1)}
        across = across.withColumns({k: c for k, c in parts.items()})
        distinct = list(dict.fromkeys(tuple(r) for r in weights))
        sums: dict[str, Column] = {}
        for k, row in enumerate(distinct):
            terms = [F.col(f"n{d}") * row[d + cols] for d in range(-cols, cols + 1)]
            if self.aggregate_function == "sum":
                total = terms[0]
                for t in terms[1:]:
                    total = total + t
                sums[f"s{k}"] = total  # NULL if any is
            else:
                known = [F.coalesce(t, F.lit(0.0)) for t in terms]
                sums[f"s{k}"] = sum(known[1:], known[0])
                sums[f"q{k}"] = sum([t * t for t in known[1:]], known[0] * known[0])
                sums[f"c{k}"] = sum([F.when(t.isNotNull(), 1).otherwise(0) for t in terms[1:]], F.when(terms[0].isNotNull(), 1).otherwise(0))
        across = across.select(*PIXEL, *[c.alias(k) for k, c in sums.items()])
        down = {f"{k}_{d}": near(k, d, along_y, "y") for k in sums for d in range(-rows, rows + 1)}
        tall = across.withColumns(down)
        pick = lambda kind: [F.col(f"{kind}{distinct.index(tuple(row))}_{d}") for d, row in zip(range(-rows, rows + 1), weights, strict=True)]
        if self.aggregate_function == "sum":
            s = pick("s")
            value = sum(s[1:], s[0])
        else:
            add = lambda own: sum([F.coalesce(c, F.lit(0)) for c in own[1:]], F.coalesce(own[0], F.lit(0)))
            s, q, c = add(pick("s")), add(pick("q")), add(pick("c"))
            value = F.when(c >= 2, F.sqrt(F.greatest(q / F.when(c >= 2, c) - (s / F.when(c >= 2, c)) ** 2, F.lit(0.0))))
        out = tall.select(*PIXEL, machine_cast(value, "F64", desc.data_type).alias("value"))
        return rect.of_pixels(out) if rect.pixels is not None else out


@dataclass(frozen=True)
class BandNeighborhoodAggregate(Operator):
    """Over neighbouring bands: {"type": "firstDerivative", "bandDistance": {"type": "equallySpaced", "distance"}} or {"type": "average", "windowSize"}."""

    TYPE: ClassVar[str] = "BandNeighborhoodAggregate"
    KEEPS_TIME: ClassVar[bool] = True
    INPUTS: ClassVar[tuple[str, ...]] = ("raster",)
    raster: Operator
    aggregate: dict = field(hash=False)

    def describe(self, ctx: Context) -> RasterDescriptor:
        desc = need("raster", self.raster, ctx)
        if self.aggregate["type"] == "firstDerivative":
            if len(desc.bands) < 2:
                raise GraphError("a derivative needs two bands")
            if self.aggregate["bandDistance"]["distance"] <= 0:
                raise GraphError("a distance is positive")
        elif self.aggregate["type"] == "average":
            size = self.aggregate["windowSize"]
            if size % 2 == 0 or not 0 < size <= 8:
                raise GraphError("a window is odd and at most 8")
        else:
            raise GraphError(f"unknown aggregate {self.aggregate['type']!r}")
        return desc.but(data_type="F64")

    def query(self, ctx: Context, rect: Rect) -> DataFrame:
        self.describe(ctx)
        found = self.raster.query(ctx, rect.but(bands=None)).withColumn("v", F.col("value").cast("double"))
        w = Window.partitionBy("t_start", "t_end", "y", "x").orderBy("band")
        if self.aggregate["type"] == "firstDerivative":
            d = float(self.aggregate["bandDistance"]["distance"])
            before, after = F.lag("v").over(w), F.lead("v").over(w)
            first, last = F.lag("band").over(w).isNull(), F.lead("band").over(w).isNull()
            value = F.when(first, (after - F.col("v")) / d).when(last, (F.col("v") - before) / d).otherwise((after - before) / (2 * d))
        else:
            r = self.aggregate["windowSize"] // 2
            own = w.rowsBetween(-r, r)
            value = F.when(F.count("v").over(own) == F.count(F.lit(1)).over(own), F.avg("v").over(own))
        out = found.select(*PIXEL, value.alias("value"))
        return out if rect.bands is None else out.where(F.col("band").isin(list(rect.bands)))


def band_names(parts: list[list[str]], rule: dict | None) -> list[str]:
    """Names of stacked bands: default (" (n)" where a name is taken), suffix (values) or rename (values)."""
    rule = rule or {"type": "default"}
    flat = [n for own in parts for n in own]
    if rule["type"] == "rename":
        out = list(rule["values"])
        if len(out) != len(flat):
            raise GraphError("a name for each band is needed")
    elif rule["type"] == "suffix":
        if len(rule["values"]) != len(parts):
            raise GraphError("a suffix for each input is needed")
        out = [f"{n}{s}" for own, s in zip(parts, rule["values"], strict=True) for n in own]
    else:
        out, seen = [], {}
        for n in flat:
            k = seen.get(n, 0)
            seen[n] = k + 1
            name = n if not k else f"{n} ({k})"
            out.append(name)
    if len(set(out)) < len(out):
        raise GraphError("band names must be unique")
    return out


@dataclass(frozen=True)
class RasterStacker(Operator):
    """Bands of several rasters in one, over the common refinement of their times.

    Times where any input has no slice are left out; so the result ends when the first input ends.
    """

    TYPE: ClassVar[str] = "RasterStacker"
    INPUTS: ClassVar[tuple[str, ...]] = ("rasters",)
    rasters: tuple[Operator, ...]
    rename_bands: dict | None = field(default=None, hash=False)

    def describe(self, ctx: Context) -> RasterDescriptor:
        if not 1 <= len(self.rasters) <= 8:
            raise GraphError("one to eight rasters")
        own = [need("raster", r, ctx) for r in self.rasters]
        if len({d.data_type for d in own}) > 1:
            raise GraphError("rasters have different types")
        if len({d.srs for d in own}) > 1:
            raise GraphError("rasters have different reference systems")
        if len({d.transform for d in own}) > 1:
            raise GraphError("rasters have different grids")
        names = band_names([[b.name for b in d.bands] for d in own], self.rename_bands)
        bands = [b for d in own for b in d.bands]
        px = [d.pixels for d in own]
        hull = (min(p[0] for p in px), max(p[1] for p in px), min(p[2] for p in px), max(p[3] for p in px))
        return own[0].but(bands=tuple(Band(n, b.measurement) for n, b in zip(names, bands, strict=True)), pixels=hull)

    def query(self, ctx: Context, rect: Rect) -> DataFrame:
        self.describe(ctx)
        parts, offset = [], 0
        for r in self.rasters:
            n = len(need("raster", r, ctx).bands)
            bands = tuple(range(n)) if rect.bands is None else tuple(b - offset for b in rect.bands if offset <= b < offset + n)
            parts.append((r.query(ctx, rect.but(bands=bands if bands else tuple(range(n)))), offset, bool(bands)))
            offset += n
        if len(parts) == 1:
            return parts[0][0]
        # the slices of an input are its time steps, whatever its number of pixels; a job asks for those that no loading information tells
        known = [r.times(ctx, rect) for r in self.rasters]
        slices = [own if own is not None else sorted({(r.t_start, r.t_end) for r in df.select("t_start", "t_end").distinct().collect()}) for own, (df, _, _) in zip(known, parts, strict=True)]
        aligned = all(s == slices[0] for s in slices)
        pieces = [] if aligned else refined(slices)
        out = None
        for k, (df, offset, wanted) in enumerate(parts):
            if not wanted:
                continue
            moved = df.withColumn("band", F.col("band") + offset)
            if not aligned:
                rows = [(*own[k], a, b) for a, b, own in pieces]
                mine = ctx.spark.createDataFrame(rows, "t_start long, t_end long, a long, b long")
                mine = F.broadcast(mine) if len(rows) <= BROADCAST_PIECES else mine
                moved = moved.join(mine, ["t_start", "t_end"]).select(F.col("a").alias("t_start"), F.col("b").alias("t_end"), "band", "y", "x", "value")
            moved = moved.select(*PIXEL, "value")
            out = moved if out is None else out.unionByName(moved)
        return out


def meeting(slices: list[tuple[int, int]], window: tuple[int, int]) -> list[tuple[int, int]]:
    """Those of sorted ``slices``, which are apart, that may meet ``window``."""
    first = bisect.bisect_left(slices, window)
    return slices[max(0, first - 1) : bisect.bisect_left(slices, (window[1], MIN_MS), lo=first)]


def refined(slices: list[list[tuple[int, int]]]) -> list[tuple[int, int, list[tuple[int, int]]]]:
    """(start, end, the slice of each input) of the pieces of time that all inputs have; slices are sorted and apart."""
    edges = sorted({e for own in slices for s in own for e in s})
    at, out = [0] * len(slices), []
    for a, b in zip(edges, edges[1:], strict=False):
        own = []
        for k, mine in enumerate(slices):
            while at[k] < len(mine) and mine[at[k]][1] <= a:
                at[k] += 1
            if at[k] < len(mine) and mine[at[k]][0] <= a:
                own.append(mine[at[k]])
        if len(own) == len(slices):
            out.append((a, b, own))
    return out
