"""Operators as nodes of a graph that JSON describes.

A node is a frozen dataclass.  ``describe`` checks the parameters and gives the descriptor without any job; ``query``
builds a lazy DataFrame for a rectangle, and rewrites the rectangle before it asks its sources.
"""

from __future__ import annotations

import dataclasses
import hashlib
import json
import re
from dataclasses import dataclass, field
from typing import Any, ClassVar

from pyspark.sql import DataFrame, SparkSession

from terrafold.model.rect import Rect
from terrafold.model.time import TimeStep

REGISTRY: dict[str, type[Operator]] = {}


class GraphError(ValueError):
    """A graph or its parameters are not valid."""


@dataclass
class Context:
    """A session and the datasets that sources name: each a loader of a DataFrame, and a descriptor.

    slices: loading information of raster datasets by name: the (start, end) of their slices in time, as a list or a function of the session that
    gives one.  It is as long as there are time steps, and asked for instead of the pixels to tell which steps are missing.
    """

    spark: SparkSession
    datasets: dict[str, tuple[Any, Any]] = field(default_factory=dict)
    models: dict[str, Any] = field(default_factory=dict)
    slices: dict[str, Any] = field(default_factory=dict)

    def known_slices(self, name: str) -> list[tuple[int, int]] | None:
        """Sorted slices of a dataset, if its loading information is known."""
        own = self.slices.get(name)
        own = own(self.spark) if callable(own) else own
        return None if own is None else sorted(own)

    def descriptor(self, name: str) -> Any:
        """What is known of a dataset; nothing is loaded."""
        if name not in self.datasets:
            raise GraphError(f"unknown dataset {name!r}")
        return self.datasets[name][1]

    def dataset(self, name: str) -> tuple[DataFrame, Any]:
        descriptor, load = self.descriptor(name), self.datasets[name][0]
        return (load(self.spark) if callable(load) else load), descriptor


def snake(name: str) -> str:
    return re.sub(r"(?<=[a-z0-9])([A-Z])", r"_\1", name).lower()


def camel(name: str) -> str:
    head, *rest = name.split("_")
    return head + "".join(w.capitalize() for w in rest)


@dataclass(frozen=True)
class Operator:
    """Base of all nodes.  INPUTS names the fields that hold source nodes; the others are parameters."""

    TYPE: ClassVar[str] = ""
    INPUTS: ClassVar[tuple[str, ...]] = ()

    def __init_subclass__(cls, **kwargs: Any) -> None:
        super().__init_subclass__(**kwargs)
        if cls.__dict__.get("TYPE"):
            REGISTRY[cls.TYPE] = cls

    def describe(self, ctx: Context) -> Any:
        raise NotImplementedError

    def query(self, ctx: Context, rect: Rect) -> DataFrame:
        raise NotImplementedError

    #: Whether the slices in time of the result are those of the first input.
    KEEPS_TIME: ClassVar[bool] = False

    def times(self, ctx: Context, rect: Rect) -> list[tuple[int, int]] | None:
        """The sorted slices of a raster result in the time of ``rect``, if they are known without a job."""
        return self.inputs()[0].times(ctx, rect) if self.KEEPS_TIME else None

    def inputs(self) -> list[Operator]:
        own = [getattr(self, n) for n in self.INPUTS]
        return [x for o in own for x in (o if isinstance(o, tuple) else (o,))]

    def with_inputs(self, change: Any) -> Operator:
        """A copy whose source nodes are changed by a function."""
        new = {n: tuple(map(change, v)) if isinstance(v := getattr(self, n), tuple) else change(v) for n in self.INPUTS}
        return dataclasses.replace(self, **new)

    def to_json(self) -> dict:
        params = {camel(f.name): _plain(getattr(self, f.name)) for f in dataclasses.fields(self) if f.name not in self.INPUTS and f.metadata.get("json", True)}
        out: dict = {"type": self.TYPE, "params": params}
        if self.INPUTS:
            out["sources"] = {n: [s.to_json() for s in v] if isinstance(v := getattr(self, n), tuple) else v.to_json() for n in self.INPUTS}
        return out

    def key(self) -> str:
        """The same for graphs that are the same."""
        return hashlib.sha256(json.dumps(self.to_json(), sort_keys=True, default=str).encode()).hexdigest()


def _plain(value: Any) -> Any:
    if isinstance(value, TimeStep):
        return value.json()
    if isinstance(value, tuple):
        return [_plain(v) for v in value]
    if isinstance(value, dict):
        return {k: _plain(v) for k, v in value.items()}
    return value


def _frozen(value: Any) -> Any:
    return tuple(map(_frozen, value)) if isinstance(value, list) else value


def from_json(spec: dict | str) -> Operator:
    """The node that a JSON graph describes."""
    spec = json.loads(spec) if isinstance(spec, str) else spec
    cls = REGISTRY.get(spec.get("type", ""))
    if cls is None:
        raise GraphError(f"unknown operator {spec.get('type')!r}")
    known = {f.name for f in dataclasses.fields(cls)}
    values: dict[str, Any] = {}
    for k, v in (spec.get("params") or {}).items():
        if snake(k) not in known:
            raise GraphError(f"{cls.TYPE} has no parameter {k!r}")
        values[snake(k)] = _frozen(v)
    for k, v in (spec.get("sources") or {}).items():
        if k not in cls.INPUTS:
            raise GraphError(f"{cls.TYPE} has no source {k!r}")
        values[k] = tuple(map(from_json, v)) if isinstance(v, list) else from_json(v)
    if missing := [n for n in cls.INPUTS if n not in values]:
        raise GraphError(f"{cls.TYPE} needs {', '.join(missing)}")
    return cls(**values)


def need(kind: str, operator: Operator, ctx: Context) -> Any:
    """The descriptor of a source that must be of a kind."""
    found = operator.describe(ctx)
    if found.kind != kind:
        raise GraphError(f"{operator.TYPE} is no {kind}")
    return found
