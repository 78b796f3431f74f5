"""The engine over tiny graphs with counts that are known in closed form."""

import pytest
from pyspark.sql import functions as F

from synodic import DropEdges, Model, ModelError, NewAgent, NewEdge, Simulation, Step, noop
from synodic.operators.raster import stencil
from synodic.sources.graphs import clique_graph, complete_graph, cycle_digraph
from synodic.sources.snapshots import list_snapshots, read_agents, read_globals, read_metadata


def numbers(spark, n):
    return spark.range(1, n + 1).withColumnRenamed("id", "foo")


def core(spark):
    m = Model().agent("A", "foo long").agent("B", "foo long", hints=["Immortal"]).edge("E", "foo long").edge("S", hints=["Stateless"])
    sim = Simulation(spark, m)
    a = [sim.add_agent("A", foo=k) for k in (1, 2, 3)]
    b = sim.add_agents("B", numbers(spark, 10))
    for k, s in enumerate([a[1], a[2]], 1):
        sim.add_edge("E", s, a[0], foo=k)
    sim.add_edges("S", b.select(F.col("id").alias("from"), F.lit(a[0]).alias("to")))
    return sim.finish_init(), a


def test_reductions(spark):
    sim, _ = core(spark)
    got = {op: sim.mapreduce(F.col("foo"), op, "B") for op in ("+", "*", "&", "|", "max", "min")}
    assert got == {"+": 55, "*": 3628800, "&": 0, "|": 15, "max": 10, "min": 1}
    empty = sim.apply(noop, "A", write="A").apply(lambda c: Step(alive=F.lit(False)), "A", write="A")
    assert [empty.mapreduce(F.col("foo"), op, "A") for op in ("+", "*", "&", "|", "max", "min")] == [0, 1, -1, 0, -(2**63 - 1), 2**63 - 1]


def test_neighbours(spark):
    sim, a = core(spark)
    rule = lambda c: Step({"foo": F.coalesce(c.agg("S", F.sum("source.foo"), "B"), F.lit(0)) + c.state.foo})
    after = sim.apply(rule, "A", read=["A", "B", "S"], write="A")
    assert sorted(r.foo for r in after.agents("A").collect()) == [2, 3, 56]
    assert sorted(r.foo for r in sim.agents("A").collect()) == [1, 2, 3]
    counted = sim.apply(lambda c: Step({"foo": c.num_edges("E")}), "A", read=["A", "E"], write="A")
    assert sorted(r.foo for r in counted.agents("A").collect()) == [0, 0, 2]
    with pytest.raises(ModelError):
        sim.apply(lambda c: Step({"foo": c.num_edges("E")}), "A", read=["A"], write="A")
    with pytest.raises(ModelError):
        sim.apply(lambda c: Step({"foo": c.state.foo}), "A", read=[], write="A")


def test_death_cascades_both_ways(spark):
    sim, a = core(spark)
    after = sim.apply(lambda c: Step(alive=c.state.foo != 1), "A", read="A", write="A")
    assert (after.num_agents("A"), after.num_edges("E"), after.num_edges("S")) == (2, 0, 0)
    after = sim.apply(lambda c: Step(alive=c.state.foo != 2), "A", read="A", write="A")
    assert (after.num_edges("E"), after.num_edges("S")) == (1, 10)
    with pytest.raises(ModelError):
        sim.apply(lambda c: Step(alive=F.lit(False)), "B", write="B")


def test_rebuild_keep_and_guards(spark):
    sim, _ = core(spark)
    assert sim.apply(noop, "A", write="E").num_edges("E") == 0
    assert sim.apply(noop, "A", write="E", add_existing="E").num_edges("E") == 2
    with pytest.raises(ModelError):
        sim.apply(noop, "A", write="B")
    with pytest.raises(ModelError):
        sim.apply(noop, "A", write=["A"], add_existing=["E"])
    with pytest.raises(ModelError):
        sim.apply(lambda c: Step({"foo": F.lit(1)}), "A")
    with pytest.raises(ModelError):
        sim.add_agent("A", foo=1)


def test_drop_then_add(spark):
    v, e = cycle_digraph(spark, 100)
    m = Model().agent("N", "idx long").edge("E", hints=["Stateless"])
    sim = Simulation(spark, m)
    sim.add_graph(v, e, "N", "E", directed=True, agent_fields={"idx": F.col("v")})
    sim.finish_init()
    even = lambda c: Step(drops=[DropEdges("E", to=c.id, when=c.state.idx % 2 == 0)])
    assert sim.apply(even, "N", read="N", write="E", add_existing="E").num_edges("E") == 50
    again = lambda c: Step(drops=[DropEdges("E", to=c.id)], edges=[NewEdge("E", to=c.id, source=c.id)])
    assert sim.apply(again, "N", read="N", write="E", add_existing="E").num_edges("E") == 100
    unknown = lambda c: Step(drops=[DropEdges("E", to=c.id, source=F.lit(0))])
    assert sim.apply(unknown, "N", read="N", write="E", add_existing="E").num_edges("E") == 100
    with pytest.raises(ModelError):
        sim.apply(even, "N", read="N", write="E")


def test_births_and_their_edges(spark):
    sim, _ = core(spark)
    born = lambda c: Step(agents=[NewAgent("A", {"foo": c.state.foo * 10}, count=2, edges=[NewEdge("S", to=F.col("newborn"), source=F.col("id"))])])
    after = sim.apply(born, "B", read="B", write=["B", "A", "S"], add_existing=["A", "S"])
    assert (after.num_agents("A"), after.num_edges("S"), after.num_agents("B")) == (23, 30, 10)
    assert after.agents("A").select("id").distinct().count() == 23


def test_with_edge(spark):
    sim, _ = core(spark)
    assert sim.apply(lambda c: Step(alive=F.lit(False)), "A", write="A", with_edge="E").num_agents("A") == 2


def test_hints(spark):
    with pytest.raises(ModelError):
        Model().agent("A", "", hints=["What"])
    with pytest.raises(ModelError):
        Model().agent("A", "").edge("E", "foo long", hints=["SingleEdge", "SingleType"], target="A")
    m = Model().agent("A", "").edge("N", hints=["NumEdgesOnly"]).edge("H", hints=["HasEdgeOnly"]).edge("O", "foo long", hints=["SingleEdge"])
    sim = Simulation(spark, m)
    a, b = sim.add_agent("A"), sim.add_agent("A")
    for kind in ("N", "H"):
        sim.add_edge(kind, a, b).add_edge(kind, b, b)
    sim.add_edge("O", a, b, foo=1).add_edge("O", a, b, foo=2)
    with pytest.raises(ModelError):
        sim.finish_init()
    sim.edge_tables["O"] = sim.edge_tables["O"].limit(0)
    sim.finish_init()
    assert (sim.num_edges("N"), sim.num_edges("H")) == (2, 1)
    with pytest.raises(ModelError):
        m.edges["N"].allow("neighborids")


@pytest.mark.parametrize("dims,seed,options,counts", [((10, 8), (10, 8), {}, [1, 9, 25]), ((6, 7, 6), (1, 1, 1), {"periodic": False}, [1, 8, 27]), ((6, 7, 6), (1, 1, 1), {"distance": 1.5, "metric": "euclidean"}, [1, 19]), ((6, 7, 6), (1, 1, 1), {"distance": 2, "metric": "manhatten", "periodic": False}, [1, 10])])
def test_diffusion(spark, dims, seed, options, counts):
    from synodic.queries import grid, spread

    for steps, n in list(enumerate(counts))[-1:]:
        assert spread(grid(spark, dims, **options), steps, seed).agents("Cell").filter("active").count() == n


def test_stencils():
    assert [len(stencil(m, 2, d)) + 1 for m, d in (("chebyshev", 2), ("manhattan", 2), ("euclidean", 2.5))] == [25, 13, 21]
    assert [len(stencil(m, 4, 1)) + 1 for m in ("chebyshev", "manhattan")] == [81, 9]


def test_graph_import_and_export(spark):
    m = Model().agent("G", "idx long, s long").edge("E", hints=["Stateless"])
    sim = Simulation(spark, m)
    v, e = complete_graph(spark, 4)
    sim.add_graph(v, e, "G", "E", agent_fields={"idx": F.col("v"), "s": F.lit(0)})
    sim.finish_init()
    after = sim.apply(lambda c: Step({"s": c.agg("E", F.sum("source.idx"), "G")}), "G", read=["G", "E"], write="G")
    assert after.mapreduce(F.col("s"), "+", "G") == 30
    g = sim.subgraph()
    assert (g.nv(), g.ne(), g.has_edge(1, 2), g.has_vertex(5)) == (4, 12, True, False)
    assert clique_graph(spark, 7, 8)[1].count() == 8 * 21 + 8


def test_snapshots(spark, tmp_path):
    sim, _ = core(spark)
    path = str(tmp_path / "store")
    sim.globals["g"] = [1, 2]
    sim.write_metadata("A", "foo", "unit", "m")
    sim.create_store(path)
    sim.write_snapshot("start")
    for _ in range(2):
        sim.apply_(lambda c: Step({"foo": c.state.foo + 1}), "A", read="A", write="A")
    sim.write_snapshot("end")
    assert list_snapshots(spark, path) == [(0, "start"), (2, "end")]
    assert sorted(r.foo for r in read_agents(spark, path, "A", transition=1).collect()) == [1, 2, 3]
    assert sorted(r.foo for r in read_agents(spark, path, "A", comment="end").collect()) == [3, 4, 5]
    assert read_globals(spark, path) == {"g": [1, 2]} and read_metadata(spark, path, "A", "foo", "unit") == "m"
    again = Simulation(spark, sim.model)
    assert again.read_snapshot(path) and again.num_transitions == 2 and again.num_edges("S") == 10
    assert not Simulation(spark, sim.model).read_snapshot(str(tmp_path / "none"))
