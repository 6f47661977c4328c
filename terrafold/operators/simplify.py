"""Simplification of lines and rings, in Arrow batches."""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from terrafold.engine.workers import importable

#: Parameter: cells of a segment at most, beyond which it is compared with every other one.
FEW_CELLS = 64


def douglas_peucker(points: np.ndarray, epsilon: float) -> np.ndarray:
    """Points farther than ``epsilon`` from the line that replaces them stay.  A stack, so that long lines need no recursion."""
    keep = np.zeros(len(points), bool)
    keep[[0, -1]] = True
    todo = [(0, len(points) - 1)]
    while todo:
        a, b = todo.pop()
        if b - a < 2:
            continue
        p, q, own = points[a], points[b], points[a + 1 : b]
        d = q - p
        length = np.hypot(*d)
        # distance to the segment's line, or to the point if both ends are one
        far = np.abs(d[0] * (own[:, 1] - p[1]) - d[1] * (own[:, 0] - p[0])) / length if length else np.hypot(*(own - p).T)
        k = int(far.argmax())
        if far[k] > epsilon:
            keep[a + 1 + k] = True
            todo += [(a, a + 1 + k), (a + 1 + k, b)]
    return points[keep]


def crosses(p: np.ndarray, q: np.ndarray, a: np.ndarray, b: np.ndarray) -> bool:
    """Whether the segment from ``p`` to ``q`` has a point in common with any of the segments from ``a`` to ``b`` (arrays)."""
    side = lambda u, v, w: np.sign((v[..., 0] - u[..., 0]) * (w[..., 1] - u[..., 1]) - (v[..., 1] - u[..., 1]) * (w[..., 0] - u[..., 0]))
    near = (np.minimum(a, b) <= np.maximum(p, q)).all(axis=1) & (np.maximum(a, b) >= np.minimum(p, q)).all(axis=1)
    a, b = a[near], b[near]
    return bool(((side(p, q, a) * side(p, q, b) <= 0) & (side(a, b, p) * side(a, b, q) <= 0)).any())


class Segments:
    """Segments of one line by cells of a grid, so that few are compared with a new one.  Those that cover many cells are looked at always."""

    def __init__(self, points: np.ndarray) -> None:
        self.points = points
        extent = float(np.ptp(points, axis=0).max()) if len(points) else 0.0
        self.size = extent / math.sqrt(len(points)) or 1.0
        self.cells: dict[tuple[int, int] | None, dict[int, int]] = {}
        for i in range(len(points) - 1):
            self.add(i, i + 1)

    def covered(self, a: int, b: int) -> list[tuple[int, int]] | None:
        """Cells that meet the box of a segment, None if they are many."""
        (x0, y0), (x1, y1) = (np.floor(f(self.points[a], self.points[b]) / self.size).astype(int).tolist() for f in (np.minimum, np.maximum))
        if (x1 - x0 + 1) * (y1 - y0 + 1) > FEW_CELLS:
            return None
        return [(x, y) for x in range(x0, x1 + 1) for y in range(y0, y1 + 1)]

    def add(self, a: int, b: int) -> None:
        for cell in self.covered(a, b) or [None]:
            self.cells.setdefault(cell, {})[a] = b

    def remove(self, a: int, b: int) -> None:
        for cell in self.covered(a, b) or [None]:
            del self.cells[cell][a]

    def near(self, a: int, b: int) -> dict[int, int]:
        """Ends by start of the segments that may meet the one from point ``a`` to point ``b``."""
        cells = self.covered(a, b)
        cells = self.cells if cells is None else [*cells, None]
        return {k: v for cell in cells for k, v in self.cells.get(cell, {}).items()}


def visvalingam(points: np.ndarray, epsilon: float, least: int) -> np.ndarray:
    """Points whose triangle with their neighbours is smaller than ``epsilon`` go, the smallest first; ``least`` points stay.

    A point stays as well if the segment that would replace its two would meet another one, so a line without crossings gets none.
    It is tried again when a neighbour goes.
    """
    n = len(points)
    before, after, alive = list(range(-1, n - 1)), list(range(1, n + 1)), np.ones(n, bool)
    segments, ring = Segments(points), np.array_equal(points[0], points[-1])

    def triangle(i: int) -> float:
        (ax, ay), (bx, by), (cx, cy) = points[before[i]], points[i], points[after[i]]
        return abs((bx - ax) * (cy - ay) - (cx - ax) * (by - ay)) / 2

    def meets_others(i: int) -> bool:
        left, right = before[i], after[i]
        # not its own two segments nor their neighbours; a ring's ends are neighbours
        other = [
            (a, b) for a, b in segments.near(left, right).items()
            if b not in (left, i) and a not in (i, right) and not (ring and ((a == 0 and right == n - 1) or (b == n - 1 and left == 0)))
        ]
        return bool(other) and crosses(points[left], points[right], *(points[list(k)] for k in zip(*other, strict=True)))

    heap = [(triangle(i), i) for i in range(1, n - 1)]
    heapq.heapify(heap)
    area, left = {i: a for a, i in heap}, n
    while heap and left > least:
        a, i = heapq.heappop(heap)
        if not alive[i] or area[i] != a:
            continue
        if a > epsilon:
            break
        if meets_others(i):
            continue
        alive[i] = False
        left -= 1
        segments.remove(before[i], i)
        segments.remove(i, after[i])
        segments.add(before[i], after[i])
        after[before[i]], before[after[i]] = after[i], before[i]
        for k in (before[i], after[i]):
            if 0 < k < n - 1:
                area[k] = triangle(k)
                heapq.heappush(heap, (area[k], k))
    return points[alive]


def simplified(df: DataFrame, kind: str, algorithm: str, epsilon: float) -> DataFrame:
    """``df`` with simpler geometries; rings keep four points."""
    importable(df.sparkSession)
    depth, least = (1, 2) if kind == "MultiLineString" else (2, 4)

    def one(line: list) -> list:
        points = np.array([(p["x"], p["y"]) for p in line], float)
        if len(points) <= least:
            return list(line)
        made = douglas_peucker(points, epsilon) if algorithm == "douglasPeucker" else visvalingam(points, epsilon, least)
        if len(made) < least:
            made = points[[0, *np.linspace(1, len(points) - 2, least - 2).astype(int), len(points) - 1]]
        return [{"x": float(x), "y": float(y)} for x, y in made]

    def deep(geom: list, level: int) -> list:
        return [one(g) if level == 1 else deep(g, level - 1) for g in geom]

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            yield part.assign(geom=[None if g is None else deep(g, depth) for g in part["geom"]])

    return df.mapInPandas(run, df.schema)
