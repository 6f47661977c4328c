"""Graphs by calls: one function for each registered operator, and chains of them.

    from terrafold.builder import build

    ndvi = build.GdalSource(data="raster").BandFilter(bands=["a", "b"]).Expression(expression="(B - A) / (A + B)", outputType="F64")
    ndvi.to_json()

The functions come from the registry: parameters are those of the JSON graph, sources are given by name or as what a chain continues.
"""

from __future__ import annotations

import json
from typing import Any

from terrafold.engine.graph import REGISTRY, Context, GraphError, Operator, from_json
from terrafold.engine.workflow import Workflow


class Graph:
    """A node of a graph; its attributes are the operators that can follow."""

    def __init__(self, spec: dict):
        self.spec = spec

    def to_json(self) -> str:
        return json.dumps(self.spec)

    def operator(self) -> Operator:
        return from_json(self.spec)

    def workflow(self, ctx: Context) -> Workflow:
        return Workflow(self.operator(), ctx)

    def __getattr__(self, kind: str) -> Any:
        return _maker(kind, self)


def _maker(kind: str, first: Graph | None) -> Any:
    if kind not in REGISTRY:
        raise AttributeError(f"no operator {kind!r}")
    inputs = REGISTRY[kind].INPUTS

    def make(**given: Any) -> Graph:
        sources = {k: given.pop(k) for k in inputs if k in given}
        if first is not None:
            if not (free := [k for k in inputs if k not in sources]):
                raise GraphError(f"{kind} takes no source more")
            sources[free[0]] = [first] if free[0] == "rasters" else first
        plain = {k: [g.spec for g in v] if isinstance(v, (list, tuple)) else v.spec for k, v in sources.items()}
        graph = Graph({"type": kind, "params": given} | ({"sources": plain} if plain else {}))
        graph.operator()  # unknown parameters and missing sources are told here
        return graph

    return make


class _Build:
    def __getattr__(self, kind: str) -> Any:
        return _maker(kind, None)


build = _Build()
