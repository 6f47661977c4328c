"""Vega-Lite documents of plots."""

from __future__ import annotations

from datetime import datetime, timedelta, timezone
from typing import Any

SCHEMA = "https://vega.github.io/schema/vega-lite/v5.json"

#: Names of fields that clients read from a histogram's document, and of the selection that an interactive one offers.
BIN_START, BIN_END, COUNT, SELECTION = "binStart", "binEnd", "Frequency", "range_selection"


def _doc(values: list[dict], mark: Any, encoding: dict, **more: Any) -> dict:
    return {"$schema": SCHEMA, "data": {"values": values}, "mark": mark, "encoding": encoding, **more}


def number(field: str, **more: Any) -> dict:
    """The channel of a quantitative field."""
    return {"field": field, "type": "quantitative", **more}


def name(field: str, **more: Any) -> dict:
    """The channel of a field of names."""
    return {"field": field, "type": "nominal", **more}


def iso(ms: int) -> str:
    return (datetime(1970, 1, 1, tzinfo=timezone.utc) + timedelta(milliseconds=ms)).isoformat(timespec="milliseconds").replace("+00:00", "Z")


def histogram(rows: list[dict], no_data: int, interactive: bool) -> dict:
    bins = [{BIN_START: r["bucket_start"], BIN_END: r["bucket_end"], COUNT: r["frequency"]} for r in rows]
    doc = _doc(bins, "bar", {"x": {"field": BIN_START, "bin": {"binned": True}}, "x2": {"field": BIN_END}, "y": number(COUNT)}, usermeta={"nodataCount": no_data})
    if interactive:
        doc["params"] = [{"name": SELECTION, "select": {"type": "interval", "encodings": ["x"]}}]
    return doc


def bars(rows: list[tuple[str, int]]) -> dict:
    return _doc([{"label": a, COUNT: b} for a, b in rows], "bar", {"x": name("label", sort=None), "y": number(COUNT)})


def pie(rows: list[tuple[str, int]], donut: bool) -> dict:
    return _doc([{"slice": a, "value": b} for a, b in rows], {"type": "arc", "innerRadius": 50 if donut else 0}, {"theta": number("value"), "color": name("slice")})


def boxes(rows: list[dict]) -> dict:
    """Whiskers, the box between the quartiles, and the median: three marks over one axis of names."""
    at = lambda mark, low, high=None: {"mark": mark, "encoding": {"x": name("name"), "y": number(low, title="value"), **({"y2": {"field": high}} if high else {})}}
    return {"$schema": SCHEMA, "data": {"values": rows}, "layer": [at("rule", "min", "max"), at({"type": "bar", "size": 14}, "q1", "q3"), at({"type": "tick", "size": 14}, "median")]}


def scatter(rows: list[dict], x: str, y: str) -> dict:
    return _doc(rows, "point", {"x": {"field": "x", "type": "quantitative", "title": x}, "y": {"field": "y", "type": "quantitative", "title": y}})


def heat(rows: list[dict], bounds: tuple[float, float, float, float], side: int, x: str, y: str) -> dict:
    x0, x1, y0, y1 = bounds
    w, h = (x1 - x0) / side, (y1 - y0) / side
    values = [{"x": x0 + r["bucket_x"] * w, "x2": x0 + (r["bucket_x"] + 1) * w, "y": y0 + r["bucket_y"] * h, "y2": y0 + (r["bucket_y"] + 1) * h, "count": r["n"]} for r in rows]
    return _doc(values, "rect", {"x": {"field": "x", "type": "quantitative", "title": x}, "x2": {"field": "x2"}, "y": {"field": "y", "type": "quantitative", "title": y}, "y2": {"field": "y2"}, "color": {"field": "count", "type": "quantitative"}})


def line(rows: list[tuple[int, float]], area: bool) -> dict:
    """A curve with its points; ``area`` fills the space below it."""
    mark = {"type": "area", "line": True, "point": True} if area else {"type": "line", "point": True}
    return _doc([{"x": iso(t), "y": v} for t, v in rows], mark, {"x": {"field": "x", "type": "temporal"}, "y": number("y")})


def lines(rows: list[tuple[str, int, float]]) -> dict:
    """A curve for each series, told apart by colour."""
    doc = line([(t, v) for _, t, v in rows], False)
    for point, (series, *_) in zip(doc["data"]["values"], rows, strict=True):
        point["series"] = series
    doc["encoding"]["color"] = name("series")
    return doc
