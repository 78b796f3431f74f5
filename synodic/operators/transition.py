"""One synchronous step: rules give columns, all inputs are the old tables, the results are swapped in at once."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.ids import numbered
from ..model import EdgeType, ModelError, config
from ..plans.materialise import small_tasks
from .neighbours import Context


@dataclass
class NewEdge:
    """An edge for each called agent where ``when`` holds; ``each`` explodes an array first and is then F.col('each')."""

    type: str
    to: Column
    source: Column | None = None
    fields: dict[str, Column] = field(default_factory=dict)
    when: Column | None = None
    each: Column | None = None


@dataclass
class NewAgent:
    """``count`` agents for each called agent where ``when`` holds; ``edges`` may use F.col('newborn') and F.col('k')."""

    type: str
    fields: dict[str, Column] = field(default_factory=dict)
    when: Column | None = None
    count: Column | int = 1
    edges: list[NewEdge] = field(default_factory=list)


@dataclass
class DropEdges:
    """All edges to ``to``, or all parallel edges from ``source`` to it; with ``matching`` (a column over the edge's fields)
    all parallel edges of each edge to ``to`` that matches."""

    type: str
    to: Column
    source: Column | None = None
    when: Column | None = None
    each: Column | None = None
    matching: Column | None = None


@dataclass
class HubEdges:
    """Around each called agent (the hub) where ``when`` holds: an edge from each source of its ``left`` edges to each source of its ``right`` ones.

    ``fields`` are columns over left.x and right.x, the fields of the two edges.
    """

    type: str
    left: str
    right: str
    fields: dict[str, Column] = field(default_factory=dict)
    when: Column | None = None


@dataclass
class Step:
    """What a rule gives back. state: new fields (others stay); alive: null or absent means true."""

    state: dict[str, Column] | None = None
    alive: Column | None = None
    agents: list[NewAgent] = field(default_factory=list)
    edges: list[NewEdge] = field(default_factory=list)
    drops: list[DropEdges] = field(default_factory=list)
    hubs: list[HubEdges] = field(default_factory=list)


def as_set(names) -> set[str]:
    return {names} if isinstance(names, str) else set(names or ())


def emitted(frame: DataFrame, kind: EdgeType, e: NewEdge) -> DataFrame:
    frame = frame if e.when is None else frame.filter(e.when)
    if e.each is not None:
        frame = frame.select("*", F.explode(e.each).alias("each"))
    columns = [e.to.cast("long").alias("to")]
    if "from" in kind.columns:
        if e.source is None:
            raise ModelError(f"an edge of type {kind.name} needs a source")
        columns.insert(0, e.source.cast("long").alias("from"))
    if "n" in kind.columns:
        columns.append(F.lit(1).cast("long").alias("n"))
    for f in kind.fields.fields if not kind.has("Stateless") else ():
        if f.name not in e.fields:
            raise ModelError(f"an edge of type {kind.name} needs the field {f.name}")
        columns.append(e.fields[f.name].cast(f.dataType).alias(f.name))
    return frame.select(*columns)


def met_at_hubs(sim, frame: DataFrame, kind: EdgeType, h: HubEdges, read: set[str]) -> DataFrame:
    """The edges of ``h``; a join on the hub, which Spark splits where one hub has very many.

    A hub's pairs are many more than its edges, so that commit() gives the table small tasks.
    """
    sides = []
    for side, name in (("left", h.left), ("right", h.right)):
        if name not in read:
            raise ModelError(f"edge type {name} is not in read")
        own = sim.model.edges[name]
        own.allow("neighborids")
        fields = [] if own.has("Stateless") else own.fields.names
        sides.append(sim.edges(name).select(F.col("to").alias("_hub"), F.col("from").alias(f"_{side}"), *([F.struct(*fields).alias(side)] if fields else [])))
    hubs = (frame if h.when is None else frame.filter(h.when)).select(F.col("id").alias("_hub"))
    pairs = sides[0].join(hubs, "_hub", "left_semi").join(sides[1], "_hub")
    return emitted(pairs, kind, NewEdge(h.type, to=F.col("_right"), source=F.col("_left"), fields=h.fields))


def settled(frame: DataFrame, kind: EdgeType) -> DataFrame:
    """The table of an edge type as its hints store it."""
    if kind.counts_only:
        return frame.select("to").distinct() if kind.has("SingleEdge") else frame.groupBy("to").agg(F.sum("n").alias("n"))
    if kind.has("SingleEdge"):
        return frame.distinct()
    return frame


def check_edges(frame: DataFrame, kind: EdgeType, sim) -> None:
    """Hints that can be broken by data: one edge a target, one type of target."""
    if not config.asserts:
        return
    if kind.has("SingleEdge") and not kind.counts_only and not frame.groupBy("to").agg(F.count("*").alias("k")).filter("k > 1").isEmpty():
        raise ModelError(f"edge type {kind.name} is SingleEdge and a target has several different edges")
    if kind.has("SingleType"):
        from ..functions.ids import type_nr

        if not frame.filter(type_nr(F.col("to")) != sim.model.agents[kind.target].number).isEmpty():
            raise ModelError(f"edge type {kind.name} has a target that is no {kind.target}")


def checked_arguments(sim, call: set, read: set, write: set, keep: set, with_edge: str | None) -> None:
    known = set(sim.model.agents) | set(sim.model.edges)
    for names in (call, read, write, keep):
        if names - known:
            raise ModelError(f"unknown types {sorted(names - known)}")
    if not sim.initialized:
        raise ModelError("finish_init() comes before the first step")
    if call & keep:
        raise ModelError(f"called types may not be in add_existing: {sorted(call & keep)}")
    if keep - write:
        raise ModelError(f"add_existing must be in write: {sorted(keep - write)}")
    if call - set(sim.model.agents):
        raise ModelError("only agent types can be called")
    for name in write & set(sim.model.agents):
        if sim.model.agents[name].immortal and name not in call | keep:
            raise ModelError(f"{name} is immortal and would be rebuilt: call it or add it to add_existing")
    if with_edge and sim.model.edges[with_edge].has("SingleType"):
        raise ModelError("with_edge is not defined for edge types with the hint SingleType")


def transition(sim, rule: Callable[[Context], Step | None], call, read=(), write=(), add_existing=(), with_edge: str | None = None):
    """The next simulation: ``sim`` stays as it is."""
    order = [call] if isinstance(call, str) else list(call)
    call, read, write, keep = as_set(call), as_set(read), as_set(write), as_set(add_existing)
    checked_arguments(sim, call, read, write, keep, with_edge)
    sim.solid(*call, *read, *keep, *([with_edge] if with_edge else []))
    after = sim.successor()
    births: dict[str, list[DataFrame]] = {}
    grown: dict[str, list[DataFrame]] = {}
    drops: dict[str, list[DataFrame]] = {}
    dead: list[DataFrame] = []
    states: dict[str, DataFrame] = {}
    hubs: list[HubEdges] = []
    for name in order:
        kind = sim.model.agents[name]
        table, rest = sim.agents(name), None
        if with_edge:
            hit = sim.edges(with_edge).select(F.col("to").alias("_hit")).distinct()
            rest = table.join(hit, table.id == hit._hit, "left_anti")
            table = table.join(hit, table.id == hit._hit, "left_semi")
        context = Context(sim, name, read)
        step = rule(context) or Step()
        frame = context.answered(table)
        if (step.state is not None or step.alive is not None) and name not in write:
            raise ModelError(f"the rule changes {name}, which is not in write")
        if kind.immortal and step.alive is not None:
            raise ModelError(f"{name} is immortal")
        if name in write:
            fields = step.state or {}
            if set(fields) - set(kind.fields.names):
                raise ModelError(f"{name} has no fields {sorted(set(fields) - set(kind.fields.names))}")
            alive = F.lit(True) if step.alive is None else F.coalesce(step.alive, F.lit(True))
            result = frame.select("id", *[fields.get(f.name, F.col(f.name)).cast(f.dataType).alias(f.name) for f in kind.fields.fields], alive.alias("_alive"))
            if step.alive is not None:
                result = after.settle(result)
                dead.append(result.filter("not _alive").select("id"))
            alive_rows = result.filter("_alive").drop("_alive") if step.alive is not None else result.drop("_alive")
            states[name] = alive_rows if rest is None else alive_rows.unionByName(rest)
        if step.agents or len(step.edges) + len(step.drops) > 1:
            frame = after.settle(frame) if context.requests else frame
        for h in step.hubs:
            require(h.type, write)
            hubs.append(h)
            grown.setdefault(h.type, []).append(met_at_hubs(sim, frame, sim.model.edges[h.type], h, read))
        for e in step.edges:
            require(e.type, write)
            grown.setdefault(e.type, []).append(emitted(frame, sim.model.edges[e.type], e))
        for d in step.drops:
            if d.type not in write & keep:
                raise ModelError(f"edges of {d.type} can be dropped only if it is in write and add_existing")
            if d.source is not None and sim.model.edges[d.type].has("IgnoreFrom"):
                raise ModelError(f"{d.type} does not know its sources")
            rows = frame if d.when is None else frame.filter(d.when)
            rows = rows if d.each is None else rows.select("*", F.explode(d.each).alias("each"))
            if d.matching is not None:
                if d.type not in read:
                    raise ModelError(f"edge type {d.type} is not in read")
                mine = sim.edges(d.type).filter(d.matching).select(F.col("to").alias("_to"), F.col("from").alias("_from"))
                drops.setdefault(d.type, []).append(mine.join(rows.select(d.to.cast("long").alias("_to")), "_to", "left_semi"))
                continue
            source = F.lit(None).cast("long") if d.source is None else d.source.cast("long")
            drops.setdefault(d.type, []).append(rows.select(d.to.cast("long").alias("_to"), source.alias("_from")))
        for b in step.agents:
            require(b.type, write)
            born = born_agents(sim, after, frame, b)
            births.setdefault(b.type, []).append(born.select("newborn", *[c.cast(f.dataType).alias(f.name) for f, c in ((f, b.fields[f.name]) for f in sim.model.agents[b.type].fields.fields)]).withColumnRenamed("newborn", "id"))
            for e in b.edges:
                require(e.type, write)
                grown.setdefault(e.type, []).append(emitted(born, sim.model.edges[e.type], e))
    met = {h.type: [sim.edges(h.left), sim.edges(h.right)] for h in hubs}
    commit(sim, after, write, keep, states, births, grown, drops, dead, met)
    return after


def require(name: str, write: set[str]) -> None:
    if name not in write:
        raise ModelError(f"the rule adds to {name}, which is not in write")


def born_agents(sim, after, frame: DataFrame, b: NewAgent) -> DataFrame:
    """The creators' rows with k and the newborn's id, numbered by creator and k."""
    frame = frame if b.when is None else frame.filter(b.when)
    count = b.count if isinstance(b.count, Column) else F.lit(b.count)
    frame = frame.withColumn("_count", count.cast("int")).filter("_count > 0")
    frame = frame.select("*", F.explode(F.sequence(F.lit(1), F.col("_count"))).alias("k")).drop("_count")
    from ..functions.ids import make_id

    kind = sim.model.agents[b.type]
    start = after.next_number(b.type)
    born = numbered(frame, "_nr", start, ["id", "k"])
    after.used[b.type] = start - 1 + born.count()
    return born.withColumn("newborn", make_id(kind.number, F.col("_nr"))).drop("_nr")


def union(frames: list[DataFrame]) -> DataFrame:
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f)
    return out


def commit(sim, after, write, keep, states, births, grown, drops, dead, met) -> None:
    """Agents, then edges: old rows (if kept) without the dropped, with the new, without those of the dead. met: the edges that types of HubEdges are made of."""
    for name in write & set(sim.model.agents):
        parts = [states[name]] if name in states else [sim.agents(name)] if name in keep else []
        parts += births.get(name, [])
        after.agent_tables[name] = union(parts) if parts else sim.empty_agents(name)
        loosened(after, name, bool(parts))
    gone = union(dead) if dead else None
    if gone is not None and gone.isEmpty():
        gone = None
    for name, kind in sim.model.edges.items():
        if name not in write and gone is None:
            continue
        table = sim.edges(name)
        if gone is not None and name not in write:
            sim.solid(name)
            table = sim.edges(name)
        if name in write:
            old = [table] if name in keep else []
            if old and name in drops:
                rows = union(drops[name])
                whole, pair = rows.filter("_from is null").select("_to").distinct(), rows.filter("_from is not null").distinct()
                old[0] = old[0].join(whole, F.col("to") == F.col("_to"), "left_anti")
                if not kind.has("IgnoreFrom"):
                    old[0] = old[0].join(pair, (F.col("to") == F.col("_to")) & (F.col("from") == F.col("_from")), "left_anti")
            parts = old + grown.get(name, [])
            table = union(parts) if parts else sim.empty_edges(name)
        if gone is not None:
            lost = gone.withColumnRenamed("id", "_gone")
            table = table.join(lost, F.col("to") == F.col("_gone"), "left_anti")
            if not kind.has("IgnoreFrom"):
                table = table.join(lost, F.col("from") == F.col("_gone"), "left_anti")
        table = settled(table, kind) if name in write else table
        after.edge_tables[name] = small_tasks(table, *met[name]) if name in met else table
        loosened(after, name, True)
        if name in write and (kind.has("SingleType") or kind.has("SingleEdge") and not kind.counts_only):
            after.solid(name)
            check_edges(after.edge_tables[name], kind, sim)
    after.num_transitions += 1
    for name in write:
        after.last_change[name] = after.num_transitions


def loosened(after, name: str, made: bool) -> None:
    """What a step makes is a plan until something reads it, if the plan gives the same rows each time."""
    after.loose.discard(name)
    if made:
        after.loose.add(name)
        tables = after.agent_tables if name in after.model.agents else after.edge_tables
        if not tables[name]._jdf.queryExecution().analyzed().deterministic():
            after.solid(name)
