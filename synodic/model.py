"""Types of agents and edges with their hints, params and globals: the schema of a simulation."""

from __future__ import annotations

import logging
from collections.abc import Iterable
from dataclasses import dataclass, field

from pyspark.sql import types as T

log = logging.getLogger("synodic")
AGENT_HINTS = {"Immortal", "Independent"}
EDGE_HINTS = {"Stateless", "IgnoreFrom", "SingleEdge", "SingleType", "IgnoreSourceState"}
COMBINED = {"NumEdgesOnly": {"Stateless", "IgnoreFrom"}, "HasEdgeOnly": {"Stateless", "IgnoreFrom", "SingleEdge"}}
FIXED = (T.NumericType, T.BooleanType, T.StringType)


class ModelError(ValueError):
    """A type, hint or step that the rules do not allow."""


@dataclass
class Config:
    """asserts: check steps; detect_stateless: hint edge types without fields; warnings: say what was assumed; folder and codec: where stores with a relative path lie, and how they are compressed."""

    asserts: bool = True
    detect_stateless: bool = False
    warnings: bool = True
    folder: str = ""
    codec: str = "snappy"


config = Config()


def fields_of(schema) -> T.StructType:
    if schema is None or schema == "":
        return T.StructType([])
    return schema if isinstance(schema, T.StructType) else T.StructType.fromDDL(schema)


def storable(kind: T.DataType) -> bool:
    return all(storable(f.dataType) for f in kind.fields) if isinstance(kind, T.StructType) else isinstance(kind, FIXED) and not isinstance(kind, T.DecimalType) or isinstance(kind, T.DecimalType | T.DateType | T.TimestampType)


@dataclass(frozen=True)
class AgentType:
    name: str
    number: int
    fields: T.StructType
    hints: frozenset

    @property
    def immortal(self) -> bool:
        return "Immortal" in self.hints

    @property
    def columns(self) -> list[str]:
        return ["id", *self.fields.names]


@dataclass(frozen=True)
class EdgeType:
    name: str
    fields: T.StructType
    hints: frozenset
    target: str | None = None

    def has(self, hint: str) -> bool:
        return hint in self.hints

    @property
    def counts_only(self) -> bool:
        """Stateless without sources: a count for each target, or a mark if single."""
        return {"Stateless", "IgnoreFrom"} <= self.hints

    @property
    def columns(self) -> list[str]:
        if self.counts_only:
            return ["to"] if self.has("SingleEdge") else ["to", "n"]
        return [*([] if self.has("IgnoreFrom") else ["from"]), "to", *([] if self.has("Stateless") else self.fields.names)]

    def allow(self, accessor: str) -> None:
        """Raise if the hints rule the accessor out."""
        lost = set()
        if self.has("Stateless"):
            lost |= {"edges", "edgestates", "mapreduce"}
        if self.has("IgnoreFrom"):
            lost |= {"edges", "neighborids", "neighborstates"}
        if self.has("SingleEdge") and not self.counts_only:
            lost |= {"num_edges"}
        if self.counts_only and self.has("SingleEdge"):
            lost |= {"num_edges"}
        if accessor in lost:
            raise ModelError(f"{accessor} is not defined for edge type {self.name} with hints {sorted(self.hints)}")


@dataclass(repr=False)
class Model:
    """A registry; every method gives the model back, so that calls chain."""

    name: str = "model"
    agents: dict[str, AgentType] = field(default_factory=dict)
    edges: dict[str, EdgeType] = field(default_factory=dict)
    params: dict[str, object] = field(default_factory=dict)
    globals: dict[str, object] = field(default_factory=dict)

    def agent(self, name: str, schema=None, hints: Iterable[str] = ()) -> Model:
        hints = frozenset(hints)
        if hints - AGENT_HINTS:
            raise ModelError(f"unknown hints for agent type {name}: {sorted(hints - AGENT_HINTS)}")
        if name in self.agents or len(self.agents) >= 255:
            raise ModelError(f"agent type {name} is registered already, or there are 255 types")
        fields = self.checked(name, schema)
        self.agents[name] = AgentType(name, len(self.agents) + 1, fields, hints)
        return self

    def edge(self, name: str, schema=None, hints: Iterable[str] = (), target: str | None = None, size: int | None = None) -> Model:
        """``size`` is taken and has no effect: storage is not preallocated."""
        given, fields = set(hints), self.checked(name, schema, ("from", "to", "n"))
        hints = set().union(*(COMBINED.get(h, {h}) for h in given))
        if hints - EDGE_HINTS:
            raise ModelError(f"unknown hints for edge type {name}: {sorted(hints - EDGE_HINTS)}")
        if name in self.edges:
            raise ModelError(f"edge type {name} is registered already")
        if target and "SingleType" not in hints:
            if config.warnings:
                log.info("edge type %s has a target, so it gets the hint SingleType", name)
            hints.add("SingleType")
        if "SingleType" in hints and not target:
            raise ModelError(f"edge type {name} with SingleType needs a target")
        if target and target not in self.agents:
            raise ModelError(f"target {target} of edge type {name} is no agent type")
        if not fields.fields and "Stateless" not in hints:
            if config.detect_stateless:
                hints.add("Stateless")
            elif config.warnings:
                log.warning("edge type %s has no fields and no hint Stateless", name)
        if {"SingleEdge", "SingleType"} <= hints and not {"Stateless", "IgnoreFrom"} <= hints:
            raise ModelError(f"edge type {name}: SingleEdge and SingleType go together only with Stateless and IgnoreFrom")
        self.edges[name] = EdgeType(name, fields, frozenset(hints), target)
        return self

    @staticmethod
    def checked(name: str, schema, own: tuple = ("id",)) -> T.StructType:
        fields = fields_of(schema)
        bad = [f.name for f in fields.fields if not storable(f.dataType) or f.name in own]
        if bad:
            raise ModelError(f"fields of {name} need a fixed-width type and a name of their own: {bad}")
        return fields

    def param(self, name: str, default=None) -> Model:
        self.params[name] = default
        return self

    def global_(self, name: str, initial=None) -> Model:
        self.globals[name] = initial
        return self

    def __repr__(self) -> str:
        own = [f"  agent {t.name}({t.fields.simpleString()[7:-1]}) {' '.join(sorted(t.hints))}".rstrip() for t in self.agents.values()]
        own += [f"  edge {t.name}({t.fields.simpleString()[7:-1]}) {' '.join(sorted(t.hints))}".rstrip() for t in self.edges.values()]
        return "\n".join([f"Model {self.name}", *own, f"  params {sorted(self.params)}, globals {sorted(self.globals)}"])

    def has_hint(self, kind: str, hint: str) -> bool:
        return hint in (self.agents.get(kind) or self.edges[kind]).hints
