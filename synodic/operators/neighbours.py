"""What a rule sees of its agent: own state, params, globals, and aggregates over incoming edges.

Requests are gathered and answered with one grouping for each edge type and source type, joined to
the called agents. Without an incoming edge counts are 0 and all other results are null.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..model import ModelError, config
from .ranges import range_totals


class Fields:
    """Attribute access to the columns of a state."""

    def __init__(self, prefix: str, names: list[str], hidden: str = ""):
        self.prefix, self.names, self.hidden = prefix, names, hidden

    def __getattr__(self, name: str) -> Column:
        if name.startswith("__") or name not in self.names:
            raise ModelError(self.hidden or f"no field {name}; there are {self.names}")
        return F.col(f"{self.prefix}{name}")


@dataclass
class Requests:
    columns: dict[str, Column] = field(default_factory=dict)


class Context:
    """Of one called agent type within one step."""

    def __init__(self, sim, kind: str, read: set[str]):
        self.sim, self.kind, self.read = sim, sim.model.agents[kind], read
        shown = kind in read
        self.id = F.col("id")
        self.state = Fields("", self.kind.fields.names if shown else [], "" if shown else f"{kind} is not in read")
        self.requests: dict[tuple, Requests] = {}
        self.ranges: list[tuple] = []
        self.lookups: list[tuple[str, Column, list[str]]] = []
        self.param, self.glob = sim.param, sim.get_global

    def ask(self, edge: str, accessor: str, value: Column, source: str | None = None, own: bool = False) -> Column:
        if edge not in self.read:
            raise ModelError(f"edge type {edge} is not in read")
        for name in (source or "").split("|"):
            if name and name not in self.read:
                raise ModelError(f"agent type {name} is not in read")
        self.sim.model.edges[edge].allow(accessor)
        own_requests = self.requests.setdefault((edge, source, own), Requests())
        name = f"_r{sum(len(r.columns) for r in self.requests.values())}"
        own_requests.columns[name] = value
        return F.col(name)

    def num_edges(self, edge: str) -> Column:
        kind = self.sim.model.edges[edge]
        n = F.sum("n") if kind.counts_only and not kind.has("SingleEdge") else F.count("*")
        return F.coalesce(self.ask(edge, "num_edges", n.cast("long")), F.lit(0).cast("long"))

    def has_edge(self, edge: str) -> Column:
        return F.coalesce(self.ask(edge, "has_edge", F.count("*") > 0), F.lit(False))

    def listed(self, edge: str, value: Column) -> Column:
        """A single value for a SingleEdge type, else all in ascending order."""
        return F.first(value) if self.sim.model.edges[edge].has("SingleEdge") else F.array_sort(F.collect_list(value))

    def edges(self, edge: str) -> Column:
        names = self.sim.model.edges[edge].fields.names
        return self.ask(edge, "edges", self.listed(edge, F.struct("from", F.struct(*names).alias("state"))))

    def neighborids(self, edge: str) -> Column:
        return self.ask(edge, "neighborids", self.listed(edge, F.col("from")))

    def edgestates(self, edge: str) -> Column:
        return self.ask(edge, "edgestates", self.listed(edge, F.struct(*self.sim.model.edges[edge].fields.names)))

    def neighborstates(self, edge: str, source: str) -> Column:
        return self.ask(edge, "neighborstates", self.listed(edge, F.col("source")), source)

    def neighborstates_flexible(self, edge: str, *sources: str) -> Column:
        """States of sources of several types, as structs with the fields of all (null where a type has none)."""
        return self.ask(edge, "neighborstates", self.listed(edge, F.col("source")), "|".join(sources))

    # Spark is lazy: the iterators are the same plans
    neighborids_iter, edgestates_iter = neighborids, edgestates
    neighborstates_iter, neighborstates_flexible_iter = neighborstates, neighborstates_flexible

    def agg(self, edge: str, value: Column, source: str | None = None, own: bool = False) -> Column:
        """Any aggregate over the incoming edges: edge fields by name, those of the source agent as source.x, with ``own`` the agent's as own.x."""
        return self.ask(edge, "neighborstates" if source else "has_edge", value, source, own)

    def checked(self, found: Column, apply) -> Column:
        """apply(found) where there is something, else null."""
        return F.when(found.isNotNull(), apply(found))

    def agentstate(self, ident: Column, kind: str) -> Column:
        """The state of another agent by id, as a struct; null for a null id. The step fails if there is no such living agent.

        ``ident`` may use what edges or earlier lookups gave.
        """
        return self.agentstate_flexible(ident, kind)

    def agentstate_flexible(self, ident: Column, *kinds: str) -> Column:
        """As agentstate() where the type follows from the id: one of ``kinds`` (all agent types in read), with the fields of all."""
        kinds = kinds or tuple(k for k in self.sim.model.agents if k in self.read)
        for kind in kinds:
            if kind not in self.read:
                raise ModelError(f"agent type {kind} is not in read")
        name = f"_s{len(self.lookups)}"
        self.lookups.append((name, ident, list(kinds)))
        found = F.col(name)
        return F.when(found.isNull() & ident.isNotNull(), F.raise_error(F.lit(f"agentstate: no living agent of {', '.join(kinds)} with this id"))).otherwise(found) if config.asserts else found

    def near(self, group: Column, order: Column, reach, value: Column) -> tuple[Column, Column]:
        """Of the agents of the called type in the same group whose ``order`` differs by less than ``reach``, itself included: their number, and the sum of ``value``.

        This is the step over a complete graph of each group, without its edges.
        """
        name = f"_n{len(self.ranges)}"
        self.ranges.append((name, group, order, reach, value))
        return F.col(f"{name}_n"), F.col(f"{name}_s")

    def answered(self, called: DataFrame) -> DataFrame:
        for (edge, source, own), requests in self.requests.items():
            frame = self.sim.edges(edge)
            if source:
                frame = frame.join(sources(self.sim, source.split("|")).withColumnRenamed("id", "_source"), F.col("from") == F.col("_source")).drop("_source")
            if own:
                mine = self.sim.agents(self.kind.name)
                frame = frame.join(mine.select(F.col("id").alias("_own"), F.struct(*mine.columns).alias("own")), F.col("to") == F.col("_own")).drop("_own")
            found = frame.groupBy("to").agg(*[v.alias(k) for k, v in requests.columns.items()])
            called = called.join(found.withColumnRenamed("to", "_to"), F.col("id") == F.col("_to"), "left").drop("_to")
        for name, ident, kinds in self.lookups:
            found = sources(self.sim, kinds).select(F.col("id").alias("_id"), F.col("source").alias(name))
            called = called.join(found, ident == F.col("_id"), "left").drop("_id")
        for name, group, order, reach, value in self.ranges:
            found = range_totals(self.sim.agents(self.kind.name), group, order, reach, value).select(F.col("id").alias("_id"), F.col("n").alias(f"{name}_n"), F.col("s").alias(f"{name}_s"))
            called = called.join(found, F.col("id") == F.col("_id"), "left").drop("_id")
        return called


def sources(sim, kinds: list[str]) -> DataFrame:
    """(id, source) of one agent type, or of several with the fields of all."""
    if len(kinds) == 1:
        frame = sim.agents(kinds[0])
        names = sim.model.agents[kinds[0]].fields.names or ["id"]
        return frame.select("id", F.struct(*names).alias("source"))
    whole = None
    for k in kinds:
        whole = sim.agents(k) if whole is None else whole.unionByName(sim.agents(k), allowMissingColumns=True)
    return whole.select("id", F.struct(*[c for c in whole.columns if c != "id"]).alias("source"))
