"""One graph: a table for each agent and edge type, params, globals, rasters, and the steps that change it."""

from __future__ import annotations

import copy
import logging
import time
import weakref
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .functions.ids import agent_nr, hex_id, make_id, numbered, type_nr
from .functions.reductions import OPS, aggregate, identity, whole_product
from .model import Model, ModelError
from .operators.raster import RasterMethods
from .operators.transition import Step, check_edges, settled, transition
from .plans.materialise import materialised, removed
from .sources.graphs import GraphMethods
from .sources.snapshots import SnapshotMethods

log = logging.getLogger("synodic")


class Simulation(RasterMethods, GraphMethods, SnapshotMethods):
    """With ``lazy`` the tables given before finish_init() stay plans over their sources (which must read the same each time)
    and only the columns that a step needs are read. What a step makes is written when something reads it, once."""

    def __init__(self, spark: SparkSession, model: Model, params: dict | None = None, globals: dict | None = None, name: str | None = None, filename: str | None = None, overwrite_file: bool = True, lazy: bool = False):
        self.lazy, self.made, self.family, self.loose = lazy, [], weakref.WeakSet(), set()
        self.family.add(self)
        self.spark, self.model, self.name = spark, model, name or model.name
        self.params = {**model.params, **(params or {})}
        self.globals = {**copy.deepcopy(model.globals), **(globals or {})}
        self.globals_last_change, self.num_transitions, self.initialized = 0, 0, False
        self.agent_tables: dict[str, DataFrame] = {}
        self.edge_tables: dict[str, DataFrame] = {}
        self.pending: dict[str, list] = {}
        self.used: dict[str, int] = {}
        self.last_change: dict[str, int] = {}
        self.rasters: dict[str, tuple[tuple[int, ...], str, DataFrame]] = {}
        self.external: dict = {}
        self.store, self.versions = None, {}
        self.filename, self.overwrite_file = filename or self.name, overwrite_file
        self.metadata: dict = {}

    def __repr__(self) -> str:
        return f"Simulation({self.name}: agents {list(self.model.agents)}, edges {list(self.model.edges)}, {'step ' + str(self.num_transitions) if self.initialized else 'not initialized'})"

    def settle(self, frame: DataFrame) -> DataFrame:
        """The frame written, to be removed by finish()."""
        out = materialised(frame)
        self.made.append(out.written_at)
        return out

    def solid(self, *kinds: str) -> None:
        """Write what the last step made of these types, unless it is written."""
        for kind in kinds:
            if kind in self.loose:
                tables = self.agent_tables if kind in self.model.agents else self.edge_tables
                tables[kind] = self.settle(tables[kind])
                self.loose.discard(kind)

    # params and globals
    def param(self, name: str):
        return self.params[name]

    def set_param(self, name: str, value):
        if self.initialized:
            raise ModelError("params are fixed after finish_init()")
        if name not in self.params:
            log.warning("no param %s", name)
            return self
        self.params[name] = value
        return self

    def get_global(self, name: str):
        return self.globals[name]

    def set_global(self, name: str, value):
        self.globals[name] = value
        self.globals_last_change = self.num_transitions
        return self

    def modify_global(self, name: str, change: Callable):
        return self.set_global(name, change(self.globals[name]))

    def push_global(self, name: str, value):
        return self.set_global(name, [*(self.globals[name] or []), value])

    def globals_table(self) -> DataFrame:
        """Vector globals as columns; those as long as the first."""
        vectors = {k: v for k, v in self.globals.items() if isinstance(v, list | tuple)}
        n = len(next(iter(vectors.values()), []))
        kept = {k: v for k, v in vectors.items() if len(v) == n}
        return self.spark.createDataFrame([Row(**{k: v[i] for k, v in kept.items()}) for i in range(n)]) if n else self.spark.createDataFrame([], T.StructType([]))

    # construction
    def next_number(self, kind: str) -> int:
        return self.used.get(kind, 0) + 1

    def before_steps(self) -> None:
        if self.initialized:
            raise ModelError("outside a step agents and edges are added before finish_init() only")

    def add_agents(self, kind: str, frame: DataFrame, nr: str | None = None) -> DataFrame:
        """Insert the rows; ``nr`` names a unique column of numbers from 1 on, else they are numbered. Gives id and all columns."""
        self.before_steps()
        t = self.model.agents[kind]
        if nr is None:
            frame, nr = numbered(frame, "_nr", self.next_number(kind)), "_nr"
            self.used[kind] = self.used.get(kind, 0) + frame.count()
        else:
            frame = frame if self.lazy else self.settle(frame)
            self.used[kind] = max(self.used.get(kind, 0), frame.agg(F.max(nr)).first()[0] or 0)
        out = frame.withColumn("id", make_id(t.number, F.col(nr))).drop("_nr")
        rows = out.select("id", *[F.col(f.name).cast(f.dataType) for f in t.fields.fields])
        self.agent_tables[kind] = self.agent_tables[kind].unionByName(rows) if kind in self.agent_tables else rows
        return out

    def add_agent(self, kind: str, **fields) -> int:
        """One agent; many go by add_agents()."""
        self.before_steps()
        nr = self.next_number(kind)
        self.used[kind] = nr
        value = self.model.agents[kind].number << 56 | nr
        value = value - (1 << 64) if value >= 1 << 63 else value
        self.pending.setdefault(kind, []).append((value, *[fields[n] for n in self.model.agents[kind].fields.names]))
        return value

    def add_agent_per_process(self, kind: str, **fields):
        """One agent for each unit of default parallelism, after initialisation."""
        t, n = self.model.agents[kind], self.spark.sparkContext.defaultParallelism
        rows = self.spark.range(1, n + 1).select(make_id(t.number, F.col("id") + self.used.get(kind, 0)).alias("id"), *[F.lit(fields[f.name]).cast(f.dataType).alias(f.name) for f in t.fields.fields])
        self.used[kind] = self.used.get(kind, 0) + n
        self.agent_tables[kind] = self.agents(kind).unionByName(rows)
        return n

    def add_edges(self, kind: str, frame: DataFrame):
        """Insert rows with from, to and the fields (as far as the hints keep them)."""
        self.before_steps()
        t = self.model.edges[kind]
        if "n" in t.columns:
            frame = frame.withColumn("n", F.lit(1).cast("long"))
        kinds = {f.name: f.dataType for f in self.edge_schema(kind).fields}
        rows = frame.select(*[F.col(c).cast(kinds[c]) for c in t.columns])
        self.edge_tables[kind] = self.edge_tables[kind].unionByName(rows) if kind in self.edge_tables else rows
        return self

    def add_edge(self, kind: str, source: int | None, to: int, **fields):
        self.before_steps()
        t = self.model.edges[kind]
        row = {"from": source, "to": to, "n": 1, **fields}
        self.pending.setdefault(kind, []).append(tuple(row[c] for c in t.columns))
        return self

    def flush(self) -> None:
        for kind, rows in self.pending.items():
            tables, schema = (self.agent_tables, self.agent_schema(kind)) if kind in self.model.agents else (self.edge_tables, self.edge_schema(kind))
            frame = self.spark.createDataFrame(rows, schema)
            tables[kind] = tables[kind].unionByName(frame) if kind in tables else frame
        self.pending = {}

    def finish_init(self, checked: bool = True, return_idmapping: bool = False, partition: DataFrame | None = None):
        """Seal the tables. Ids stay as they are, so the mapping (old, new) is the identity.

        ``partition`` (id, part) deals the agents to Spark partitions as they are written; rows without a part go by id.
        """
        if self.initialized:
            raise ModelError("finish_init() was called already")
        self.flush()
        for kind in self.model.agents:
            if kind not in self.agent_tables:
                self.agent_tables[kind] = self.empty_agents(kind)
            elif partition is not None:
                own = self.agent_tables[kind]
                placed = own.join(partition.select("id", "part"), "id", "left").repartition(F.coalesce(F.col("part").cast("long"), F.col("id")))
                self.agent_tables[kind] = self.settle(placed.select(*own.columns))
        for name, t in self.model.edges.items():
            own = settled(self.edge_tables[name], t) if name in self.edge_tables else self.empty_edges(name)
            self.edge_tables[name] = own if self.lazy or name not in self.edge_tables else self.settle(own)
            if checked:
                check_edges(self.edge_tables[name], t, self)
        self.initialized = True
        if not return_idmapping:
            return self
        ids = [self.agents(kind).select(F.col("id").alias("old"), F.col("id").alias("new")) for kind in self.model.agents]
        out = ids[0]
        for more in ids[1:]:
            out = out.unionByName(more)
        return out

    def agent_schema(self, kind: str) -> T.StructType:
        return T.StructType([T.StructField("id", T.LongType()), *self.model.agents[kind].fields.fields])

    def edge_schema(self, name: str) -> T.StructType:
        t = self.model.edges[name]
        known = {f.name: f for f in t.fields.fields}
        return T.StructType([known.get(c, T.StructField(c, T.LongType())) for c in t.columns])

    def empty_agents(self, kind: str) -> DataFrame:
        return self.spark.createDataFrame([], self.agent_schema(kind))

    def empty_edges(self, name: str) -> DataFrame:
        return self.spark.createDataFrame([], self.edge_schema(name))

    # scans
    def agents(self, kind: str) -> DataFrame:
        self.flush()
        return self.agent_tables.get(kind) or self.empty_agents(kind)

    def edges(self, name: str) -> DataFrame:
        self.flush()
        return self.edge_tables.get(name) or self.empty_edges(name)

    def all_agents(self, kind: str) -> DataFrame:
        return self.agents(kind).select(*self.model.agents[kind].fields.names)

    def all_agentids(self, kind: str) -> DataFrame:
        return self.agents(kind).select("id")

    def all_edges(self, name: str) -> DataFrame:
        """to, and the edge as a struct of source and state."""
        self.model.edges[name].allow("edges")
        return self.edges(name).select("to", F.struct("from", F.struct(*self.model.edges[name].fields.names).alias("state")).alias("edge"))

    def edges_iterator(self, name: str) -> DataFrame:
        """(to, edge) as all_edges() gives it, or (to, from) of a Stateless type; not defined for types that keep no sources."""
        kind = self.model.edges[name]
        if kind.has("IgnoreFrom"):
            raise ModelError(f"edge type {name} does not know its sources")
        return self.edges(name).select("to", "from") if kind.has("Stateless") else self.all_edges(name)

    def num_agents(self, kind: str) -> int:
        self.solid(kind)
        return self.agents(kind).count()

    def num_edges(self, name: str, write: bool = False) -> int:
        """Before finish_init() the edges are pending: they count with ``write`` only."""
        if not self.initialized and not write:
            return 0
        self.solid(name)
        frame = self.edges(name)
        return int(frame.agg(F.sum("n")).first()[0] or 0) if "n" in frame.columns else frame.count()

    def agentstate(self, frame: DataFrame, ident: str, kind: str) -> DataFrame:
        """The frame with the state of agent ``ident`` as a struct column named like the type; without that agent the row goes."""
        t = self.agents(kind)
        return frame.join(t.select(F.col("id").alias("_id"), F.struct(*t.columns).alias(kind)), F.col(ident) == F.col("_id")).drop("_id")

    def table(self, kind: str, types: bool = False, localnr: bool = False) -> DataFrame:
        """Agents or edges as a table; types adds type names, localnr shows numbers instead of ids (and types)."""
        frame = self.agents(kind) if kind in self.model.agents else self.edges(kind)
        frame = frame.withColumnRenamed("n", "num_edges") if "n" in frame.columns else frame
        if frame.columns == ["to"]:
            frame = frame.withColumn("has_edge", F.lit(True))
        names = {t.number: t.name for t in self.model.agents.values()}
        for c in ("id", "from", "to"):
            if c in frame.columns and (types or localnr):
                if c != "id":
                    name = F.lit(None).cast("string")
                    for number, own in names.items():
                        name = F.when(type_nr(F.col(c)) == number, own).otherwise(name)
                    frame = frame.withColumn(f"{c}_type", name)
                if localnr:
                    frame = frame.withColumn(c, agent_nr(F.col(c)))
        return frame

    def show_table(self, kind: str, n: int = 20) -> None:
        frame = self.table(kind)
        frame.select(*[hex_id(F.col(c)).alias(c) if c in ("id", "from", "to") else c for c in frame.columns]).show(n, False)

    def describe_agent(self, kind: str, ident: int | None = None, most: int = 5, neighborstates: tuple[str, ...] = (), seed: int = 0) -> int | None:
        """Print an agent (a random one without an id) and up to ``most`` incoming edges of each type; gives its id.

        ``neighborstates`` names the edge types whose source agents are shown too.
        """
        frame = self.agents(kind).orderBy(F.xxhash64("id", F.lit(seed)), "id") if ident is None else self.agents(kind).filter(F.col("id") == ident)
        row = frame.first()
        if row is None:
            return None
        print(kind, row)
        names = {t.number: t.name for t in self.model.agents.values()}
        for name in self.model.edges:
            for edge in self.edges(name).filter(F.col("to") == row["id"]).limit(most).collect():
                print(" ", name, edge)
                if name in neighborstates and "from" in edge:
                    source = names[(edge["from"] & ((1 << 64) - 1)) >> 56]
                    print("   ", source, self.agents(source).filter(F.col("id") == edge["from"]).first())
        return row["id"]

    # steps
    def apply(self, rule, call, read=(), write=(), add_existing=(), with_edge=None) -> Simulation:
        """The simulation after one step; this one stays."""
        began, context = time.time(), self.spark.sparkContext
        log.info("<Begin> transition %s of %s: call %s", self.num_transitions + 1, self.name, call)
        before = context.getLocalProperty("spark.job.description")
        context.setJobDescription(f"{self.name}: transition {self.num_transitions + 1}")
        try:
            out = transition(self, rule, call, read, write, add_existing, with_edge)
        finally:
            context.setLocalProperty("spark.job.description", before)
        log.info("<End> transition %s of %s, Duration (ms): %.0f", out.num_transitions, self.name, 1000 * (time.time() - began))
        return out

    def apply_(self, *args, **named) -> Simulation:
        """apply() in place."""
        after = self.apply(*args, **named)
        family = self.family
        self.__dict__.update(after.__dict__)
        family.discard(after)
        return self

    def log_overview(self) -> None:
        """A log line for each type with its hints and number of rows."""
        for name, t in self.model.agents.items():
            log.info("agent type %s %s: %s", name, sorted(t.hints), self.num_agents(name))
        for name, t in self.model.edges.items():
            log.info("edge type %s %s: %s", name, sorted(t.hints), self.num_edges(name, write=True))

    def copy(self) -> Simulation:
        """Independent: tables never change, dicts are copied; the store stays with the original."""
        out = self.successor()
        out.store, out.versions, out.metadata = None, {}, dict(self.metadata)
        return out

    def successor(self) -> Simulation:
        """A copy that goes on with the store."""
        out = copy.copy(self)
        for k in ("agent_tables", "edge_tables", "used", "last_change", "rasters", "params", "external"):
            setattr(out, k, dict(getattr(self, k)))
        out.globals, out.pending, out.loose = copy.deepcopy(self.globals), {k: list(v) for k, v in self.pending.items()}, set(self.loose)
        self.family.add(out)
        return out

    def finish(self) -> dict:
        """Let the tables go; params and globals stay.

        What was written for this simulation and its earlier steps is removed, unless a copy or another step of it lives on.
        """
        self.agent_tables, self.edge_tables, self.external, self.rasters, self.store = {}, {}, {}, {}, None
        self.family.discard(self)
        if not len(self.family):
            while self.made:
                removed(self.spark, self.made.pop())
        return self.globals

    # reductions
    def mapreduce(self, value: Column, op, kind: str, init=None, datatype: str | T.DataType | None = None):
        """Reduce a column over agents or edges. op: + * max min & |, or a function of the column giving an aggregate (then init is needed)."""
        if kind in self.model.edges:
            self.model.edges[kind].allow("mapreduce")
        self.solid(kind)
        frame = (self.agents(kind) if kind in self.model.agents else self.edges(kind)).select(value.alias("v"))
        data = frame.schema["v"].dataType if datatype is None else T._parse_datatype_string(datatype) if isinstance(datatype, str) else datatype
        v = F.col("v") if datatype is None else F.col("v").cast(data)
        if not isinstance(op, str):
            if init is None:
                raise ModelError("an op of your own needs init")
            got = frame.agg(op(v)).first()[0]
            return init if got is None else got
        if op not in OPS:
            raise ModelError(f"no op {op}")
        if op == "*" and isinstance(data, T.IntegralType):
            return whole_product(frame, v)
        got = frame.agg(aggregate(op, v, data)).first()[0]
        return (identity(op, data) if init is None else init) if got is None else got


def noop(context) -> Step:
    """A rule that changes nothing, for steps that only rebuild or keep."""
    return Step()


