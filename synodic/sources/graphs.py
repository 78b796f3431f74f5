"""Graph generators, import of graphs, export of subgraphs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..model import ModelError


def complete_graph(spark: SparkSession, n: int) -> tuple[DataFrame, DataFrame]:
    """Vertices v from 1 to n, and an undirected edge (s, t), s < t, for every two."""
    vertices = spark.range(1, n + 1).withColumnRenamed("id", "v")
    edges = spark.range(1, n).select(F.col("id").alias("s"), F.explode(F.sequence(F.col("id") + 1, F.lit(n).cast("long"))).alias("t"))
    return vertices, edges


def cycle_digraph(spark: SparkSession, n: int) -> tuple[DataFrame, DataFrame]:
    return spark.range(1, n + 1).withColumnRenamed("id", "v"), spark.range(1, n + 1).select(F.col("id").alias("s"), (F.pmod(F.col("id"), F.lit(n)) + 1).alias("t"))


def clique_graph(spark: SparkSession, k: int, n: int) -> tuple[DataFrame, DataFrame]:
    """n cliques of k vertices, the first vertices of neighbouring cliques joined to a ring."""
    vertices = spark.range(1, k * n + 1).withColumnRenamed("id", "v")
    base = spark.range(n).withColumnRenamed("id", "c")
    inside = base.select((F.col("c") * k).alias("b"), F.explode(F.sequence(F.lit(1), F.lit(max(k - 1, 1)))).alias("x")).filter(F.lit(k > 1))
    inside = inside.select((F.col("b") + F.col("x")).alias("s"), F.explode(F.expr(f"transform(sequence(x + 1, {k}), y -> b + y)")).alias("t"))
    ring = base.filter(F.lit(n > 1) & ((F.col("c") < n - 1) | F.lit(n > 2))).select((F.col("c") * k + 1).alias("s"), (F.pmod(F.col("c") + 1, F.lit(n)) * k + 1).alias("t"))
    return vertices, inside.unionByName(ring)


class Graph:
    """A directed graph of dense vertices: (v, id) and (s, t, edge type)."""

    def __init__(self, vertex_table: DataFrame, edge_table: DataFrame):
        self.vertex_table, self.edge_table = vertex_table, edge_table

    is_directed = True
    eltype, edgetype = "long", "struct<s:bigint,t:bigint>"

    def vertices(self) -> DataFrame:
        return self.vertex_table.select("v")

    def edges(self) -> DataFrame:
        return self.edge_table.select("s", "t")

    def nv(self) -> int:
        return self.vertex_table.count()

    def ne(self) -> int:
        return self.edge_table.count()

    def has_vertex(self, v: int) -> bool:
        return not self.vertex_table.filter(F.col("v") == v).isEmpty()

    def has_edge(self, s: int, t: int) -> bool:
        return not self.edge_table.filter((F.col("s") == s) & (F.col("t") == t)).isEmpty()

    def inneighbors(self) -> DataFrame:
        """v with its distinct sources, sorted."""
        return self.edge_table.groupBy(F.col("t").alias("v")).agg(F.array_sort(F.collect_set("s")).alias("neighbors"))

    def outneighbors(self) -> DataFrame:
        return self.edge_table.groupBy(F.col("s").alias("v")).agg(F.array_sort(F.collect_set("t")).alias("neighbors"))


class GraphMethods:
    """Part of Simulation."""

    def add_graph(self, vertices: DataFrame, edges: DataFrame, kind: str, edge: str, directed: bool = False, agent_fields: dict | None = None, edge_fields: dict | None = None) -> DataFrame:
        """Vertices (v from 1 on) become agents, edges (s, t) edges, both ways if undirected. Gives v and id."""
        t, e = self.model.agents[kind], self.model.edges[edge]
        offset = self.used.get(kind, 0)
        frame = vertices.select("*", *[c.alias(k) for k, c in (agent_fields or {}).items()]).withColumn("_n", F.col("v") + offset)
        ids = self.add_agents(kind, frame, nr="_n").select("v", "id")
        both = edges.select("*", *[c.alias(k) for k, c in (edge_fields or {}).items()])
        both = both if directed else both.unionByName(both.select(F.col("t").alias("s"), F.col("s").alias("t"), *[c for c in both.columns if c not in ("s", "t")]))
        from ..functions.ids import make_id

        rows = both.withColumn("from", make_id(t.number, F.col("s") + offset)).withColumn("to", make_id(t.number, F.col("t") + offset))
        self.add_edges(edge, rows.select(*[c for c in ("from", "to", *e.fields.names) if c in rows.columns]))
        return ids

    def subgraph(self, agenttypes=None, edgetypes=None, drop_multiedges: bool = False) -> Graph:
        """The graph of the chosen types; of parallel edges the first type stays if multi-edges are dropped."""
        from ..functions.ids import numbered

        agents, edges = list(agenttypes or self.model.agents), list(edgetypes or self.model.edges)
        ids = None
        for a in agents:
            own = self.agents(a).select("id")
            ids = own if ids is None else ids.unionByName(own)
        vertices = numbered(ids, "v", 1, ["id"])
        rows = None
        for k, e in enumerate(edges):
            if self.model.edges[e].has("IgnoreFrom"):
                continue
            own = self.edges(e).select("from", "to", F.lit(k).alias("k"), F.lit(e).alias("edgetype"))
            rows = own if rows is None else rows.unionByName(own)
        if rows is None:
            raise ModelError("no chosen edge type knows its sources")
        if drop_multiedges:
            rows = rows.groupBy("from", "to").agg(F.min(F.struct("k", "edgetype")).alias("m")).select("from", "to", "m.k", "m.edgetype")
        rows = rows.join(vertices.select(F.col("id").alias("from"), F.col("v").alias("s")), "from").join(vertices.select(F.col("id").alias("to"), F.col("v").alias("t")), "to")
        return Graph(vertices, rows.select("s", "t", "edgetype"))

    def simplegraph(self, agenttypes=None, edgetypes=None) -> DataFrame:
        """v and the list of its targets, parallel edges kept."""
        g = self.subgraph(agenttypes, edgetypes)
        return g.vertex_table.join(g.edge_table.groupBy("s").agg(F.array_sort(F.collect_list("t")).alias("targets")), F.col("v") == F.col("s"), "left").select("v", "id", F.coalesce("targets", F.array().cast("array<bigint>")).alias("targets"))
