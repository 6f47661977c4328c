"""Points as circles for a map: near ones merge."""

from __future__ import annotations

import math
from dataclasses import dataclass, field
from typing import Any, ClassVar

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from terrafold.engine.graph import Context, GraphError, Operator, need
from terrafold.engine.workers import importable
from terrafold.functions import geometry
from terrafold.model.descriptor import VectorDescriptor
from terrafold.model.rect import Rect


def radius(n: float, least: float, resolution: float) -> float:
    """Of a circle of n points, in map units."""
    return (least + math.log(n)) * resolution


def merge_circles(rows: list[dict], least: float, delta: float, resolution: float, columns: dict[str, str]) -> list[dict]:
    """Each circle merges with those it comes near to, until none is left; circles are looked up in cells of a grid."""
    size = max(2 * radius(max((r["n"] for r in rows), default=1) or 1, least, resolution) + delta * resolution, 1e-12) * 2
    cells: dict[tuple[int, int], dict[int, dict]] = {}
    place = lambda c: (math.floor(c["x"] / size), math.floor(c["y"] / size))
    number = 0
    for row in rows:
        new = dict(row)
        while True:
            cx, cy = place(new)
            reach = radius(new["n"], least, resolution)
            steps = max(1, math.ceil((reach + size / 2) / size))
            near = [(k, c) for i in range(cx - steps, cx + steps + 1) for j in range(cy - steps, cy + steps + 1) for k, c in cells.get((i, j), {}).items() if math.hypot(c["x"] - new["x"], c["y"] - new["y"]) < reach + radius(c["n"], least, resolution) + delta * resolution]
            if not near:
                break
            k, other = min(near)
            del cells[place(other)][k]
            new = merged(other, new, columns)
        number += 1
        cells.setdefault(place(new), {})[number] = new
    return sorted((c for own in cells.values() for c in own.values()), key=lambda c: (c["x"], c["y"]))


def merged(a: dict, b: dict, columns: dict[str, str]) -> dict:
    n = a["n"] + b["n"]
    out: dict[str, Any] = {"n": n, "x": (a["x"] * a["n"] + b["x"] * b["n"]) / n, "y": (a["y"] * a["n"] + b["y"] * b["n"]) / n}
    out |= {"t_start": min(a["t_start"], b["t_start"]), "t_end": max(a["t_end"], b["t_end"])}
    for c, how in columns.items():
        u, v = a[c], b[c]
        out[c] = (list(u) + list(v))[:3] if how == "stringSample" else (u * a["n"] + v * b["n"]) / n if u is not None and v is not None else None
    return out


@dataclass(frozen=True)
class VisualPointClustering(Operator):
    """Circles for points: radius in pixels grows with the logarithm of the count.

    column_aggregates: new name -> {"columnName", "aggregateType": meanNumber or stringSample (three values)}.  Points of one cell of a
    grid are combined by an aggregation first; only the cells, as many as a map can show, meet in one task.
    """

    TYPE: ClassVar[str] = "VisualPointClustering"
    INPUTS: ClassVar[tuple[str, ...]] = ("vector",)
    vector: Operator
    min_radius_px: float
    delta_px: float
    resolution: float
    radius_column: str = "radius"
    count_column: str = "count"
    column_aggregates: dict = field(default_factory=dict, hash=False)

    def describe(self, ctx: Context) -> VectorDescriptor:
        desc = need("vector", self.vector, ctx)
        if desc.geometry != "MultiPoint":
            raise GraphError("only points are clustered")
        if self.min_radius_px <= 0 or self.delta_px < 0 or self.resolution <= 0:
            raise GraphError("sizes are positive")
        if len({self.radius_column, self.count_column, *self.column_aggregates}) < 2 + len(self.column_aggregates):
            raise GraphError("column names must be unique")
        columns = {self.radius_column: "float", self.count_column: "int"}
        for name, spec in self.column_aggregates.items():
            if spec["columnName"] not in desc.columns:
                raise GraphError(f"unknown column {spec['columnName']!r}")
            columns[name] = "float" if spec["aggregateType"] == "meanNumber" else "text"
        return desc.but(columns=columns)

    def cells(self, ctx: Context, rect: Rect) -> DataFrame:
        """Stage one: a circle for each grid cell that has points."""
        size = (2 * self.min_radius_px + self.delta_px) / math.sqrt(2) * self.resolution
        points = self.vector.query(ctx, rect.but(columns=None)).withColumn("p", F.explode("geom"))
        made = [F.count(F.lit(1)).alias("n"), F.avg("p.x").alias("x"), F.avg("p.y").alias("y"), F.min("t_start").alias("t_start"), F.max("t_end").alias("t_end")]
        cell = [F.floor(F.col("p.x") / size).alias("cx"), F.floor(F.col("p.y") / size).alias("cy")]
        for name, spec in self.column_aggregates.items():
            if spec["aggregateType"] == "meanNumber":
                c = F.col(spec["columnName"])
                made.append(F.when(F.count(c) == F.count(F.lit(1)), F.avg(c)).alias(name))
        out = points.groupBy(*cell).agg(*made)
        for name, spec in self.column_aggregates.items():
            if spec["aggregateType"] != "meanNumber":  # the least three values: a sample that does not depend on the order of rows
                values = points.where(F.col(spec["columnName"]).isNotNull()).select(*cell, F.col(spec["columnName"]).alias("v")).distinct()
                least = values.withColumn("k", F.row_number().over(Window.partitionBy("cx", "cy").orderBy("v"))).where("k <= 3")
                out = out.join(least.groupBy("cx", "cy").agg(F.array_sort(F.collect_list("v")).alias(name)), ["cx", "cy"], "left").withColumn(name, F.coalesce(name, F.array().cast("array<string>")))
        return out

    def query(self, ctx: Context, rect: Rect) -> DataFrame:
        importable(ctx.spark)
        columns = {n: s["aggregateType"] for n, s in self.column_aggregates.items()}
        types = self.describe(ctx).columns
        least, delta, resolution = self.min_radius_px, self.delta_px, self.resolution
        kinds = {"float": "double", "int": "bigint", "text": "string"}
        schema = "t_start long, t_end long, x double, y double, " + ", ".join(f"`{c}` {kinds[t]}" for c, t in types.items())
        rc, cc = self.radius_column, self.count_column

        def run(part: pd.DataFrame) -> pd.DataFrame:
            rows = part.sort_values(["cx", "cy"]).astype(object).where(lambda d: d.map(lambda v: v is not None and v == v if not hasattr(v, "__len__") else True), None).to_dict("records")
            out = merge_circles(rows, least, delta, resolution, columns)
            made = pd.DataFrame({"t_start": [c["t_start"] for c in out], "t_end": [c["t_end"] for c in out], "x": [c["x"] for c in out], "y": [c["y"] for c in out]})
            made[rc], made[cc] = [radius(c["n"], least, resolution) / resolution for c in out], [c["n"] for c in out]
            for c, how in columns.items():
                made[c] = [", ".join(map(str, o[c])) if how == "stringSample" else o[c] for o in out]
            return made

        circles = self.cells(ctx, rect).groupBy().applyInPandas(run, schema)
        return circles.select("t_start", "t_end", geometry.multi_point(F.col("x"), F.col("y")).alias("geom"), *types)


