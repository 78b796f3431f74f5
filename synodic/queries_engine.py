"""More queries over the driver's tables: one for each operator that the graph queries leave out."""

from __future__ import annotations

import logging
import os
import tempfile
import uuid

from pyspark.sql import functions as F

from . import DropEdges, HubEdges, Model, ModelError, NewEdge, Simulation, Step, config, noop
from .functions.ids import agent_nr, hex_id, make_id
from .functions.logs import create_logger, with_logger
from .functions.text import enum_to_int, fixed_width, int_to_enum, named_tuples, struct_of
from .plans.materialise import shared_folder
from .queries import agents, grid, ident, latest, lines, money, nr, one_row, query, region_seen, returned, shop, table, world
from .sources.graphs import clique_graph, complete_graph, cycle_digraph
from .sources.snapshots import list_snapshots, read_agents, read_edges, read_globals, read_metadata, read_params, read_sim_metadata


def fresh(spark) -> str:
    return f"{shared_folder(spark)}/store-{uuid.uuid4().hex}"


def refused(call) -> bool:
    try:
        call()
    except ModelError:
        return True
    return False


# model, params, globals, the life of a simulation
@query("SELECT count(*) AS n, CAST(300000 AS BIGINT) AS cut, CAST(7 AS BIGINT) AS plain FROM orders WHERE o_totalprice > 300000")
def params_in_rule(spark, sf_dir):
    model = Model("params").agent("Order", "total decimal(18,2)").param("cut", 1).param("plain", 7)
    sim = Simulation(spark, model, lazy=True).set_param("cut", 300000).set_param("unknown", 1)
    agents(sim, spark, sf_dir, "Order", "orders", "o_orderkey", total=money("o_totalprice"))
    after = sim.finish_init().apply(lambda c: Step(alive=c.state.total > c.param("cut")), "Order", read="Order", write="Order")
    assert refused(lambda: sim.set_param("cut", 2))
    return one_row(spark, n=(after.num_agents("Order"), "long"), cut=(sim.param("cut"), "long"), plain=(sim.param("plain"), "long"))


@query("SELECT count(*) AS a, 2 * count(*) AS b, CAST(3 AS BIGINT) AS pushed, CAST(1 AS BIGINT) AS changed FROM customer")
def globals_of_steps(spark, sf_dir):
    sim = shop(spark, sf_dir)
    sim.globals |= {"a": 0, "b": 1, "list": [1, 2]}
    sim.apply_(noop, "Customer", write="Customer")
    n = sim.num_agents("Customer")
    sim.set_global("a", n).set_global("b", n).modify_global("b", lambda x: 2 * x).push_global("list", 3)
    return one_row(spark, a=(sim.get_global("a"), "long"), b=(sim.get_global("b"), "long"), pushed=(len(sim.get_global("list")), "long"), changed=(sim.globals_last_change, "long"))


@query("SELECT count(*) AS n, count(*) FILTER (c_acctbal >= 0) AS left_in_copy, true AS detached FROM customer")
def copy_simulation(spark, sf_dir):
    sim = shop(spark, sf_dir)
    sim.create_store(fresh(spark))
    other = sim.copy()
    other.apply_(lambda c: Step(alive=c.state.bal >= 0), "Customer", read="Customer", write="Customer")
    return one_row(spark, n=(sim.num_agents("Customer"), "long"), left_in_copy=(other.num_agents("Customer"), "long"), detached=(other.store is None and sim.store is not None, "boolean"))


@query("SELECT count(*) AS n, CAST(0 AS BIGINT) AS after, CAST(5 AS BIGINT) AS param FROM customer")
def finish_simulation(spark, sf_dir):
    model = Model("finish").agent("Customer", "bal decimal(18,2)").param("p", 5).global_("n", 0)
    sim = Simulation(spark, model)
    agents(sim, spark, sf_dir, "Customer", "customer", "c_custkey", bal=money("c_acctbal"))
    sim.finish_init().apply_(noop, "Customer", write="Customer", read="Customer")
    sim.set_global("n", sim.num_agents("Customer"))
    kept = sim.finish()
    return one_row(spark, n=(kept["n"], "long"), after=(sim.num_agents("Customer"), "long"), param=(sim.param("p"), "long"))


@query("SELECT * FROM (VALUES ('Customer', 'Immortal', true), ('Customer', 'Independent', false), ('Placed', 'Stateless', true), ('Placed', 'IgnoreFrom', true), ('Placed', 'SingleEdge', false)) v(kind, hint, has)")
def has_hint(spark, sf_dir):
    model = Model("hints").agent("Customer", "", hints=["Immortal"]).edge("Placed", hints=["NumEdgesOnly"])
    asked = [("Customer", "Immortal"), ("Customer", "Independent"), ("Placed", "Stateless"), ("Placed", "IgnoreFrom"), ("Placed", "SingleEdge")]
    return spark.createDataFrame([(k, h, model.has_hint(k, h)) for k, h in asked], "kind string, hint string, has boolean")


ACCESSORS = ("edges", "neighborids", "edgestates", "num_edges", "has_edge", "mapreduce")
HINTED = {
    "D": [], "E": ["SingleEdge"], "T": ["SingleType"], "I": ["IgnoreFrom"], "EI": ["SingleEdge", "IgnoreFrom"], "TI": ["SingleType", "IgnoreFrom"], "S": ["Stateless"], "SE": ["Stateless", "SingleEdge"],
    "ST": ["Stateless", "SingleType"], "SI": ["Stateless", "IgnoreFrom"], "SEI": ["Stateless", "SingleEdge", "IgnoreFrom"], "STI": ["Stateless", "SingleType", "IgnoreFrom"], "SETI": ["Stateless", "SingleEdge", "SingleType", "IgnoreFrom"],
    # with a size
    "Ts": ["SingleType"], "TsI": ["SingleType", "IgnoreFrom"], "STs": ["Stateless", "SingleType"], "STsI": ["Stateless", "SingleType", "IgnoreFrom"], "SETsI": ["Stateless", "SingleEdge", "SingleType", "IgnoreFrom"],
}


@query("""
WITH t(name) AS (VALUES ('D'), ('E'), ('T'), ('I'), ('EI'), ('TI'), ('S'), ('SE'), ('ST'), ('SI'), ('SEI'), ('STI'), ('SETI'), ('Ts'), ('TsI'), ('STs'), ('STsI'), ('SETsI')), a(accessor) AS (VALUES ('edges'), ('neighborids'), ('edgestates'), ('num_edges'), ('has_edge'), ('mapreduce'))
SELECT name, accessor, CASE accessor WHEN 'edges' THEN name NOT LIKE '%S%' AND name NOT LIKE '%I%' WHEN 'neighborids' THEN name NOT LIKE '%I%' WHEN 'num_edges' THEN name NOT LIKE '%E%' WHEN 'has_edge' THEN true ELSE name NOT LIKE '%S%' END AS allowed FROM t, a
""")
def hint_matrix(spark, sf_dir):
    model = Model("matrix").agent("A", "")
    for name, hints in HINTED.items():
        model.edge(name, "" if "Stateless" in hints else "x long", hints=hints, target="A" if "SingleType" in hints else None, size=10 if "s" in name else None)
    rows = [(name, accessor, not refused(lambda n=name, a=accessor: model.edges[n].allow(a))) for name in HINTED for accessor in ACCESSORS]
    return spark.createDataFrame(rows, "name string, accessor string, allowed boolean")


@query("SELECT * FROM (VALUES ('D', 2, 3), ('E', 1, 1), ('T', 2, 3), ('S', 2, NULL), ('SI', 2, NULL), ('SEI', 1, NULL)) v(name, n, s)")
def hinted_edges(spark, sf_dir):
    model = Model("hinted").agent("A", "")
    names = ("D", "E", "T", "S", "SI", "SEI")
    for name in names:
        model.edge(name, "" if "Stateless" in HINTED[name] else "x long", hints=HINTED[name], target="A" if "SingleType" in HINTED[name] else None)
    sim = Simulation(spark, model)
    a, b, c = (sim.add_agent("A") for _ in range(3))
    for name in names:
        fields = () if "Stateless" in HINTED[name] else (1, 2)
        sim.add_edge(name, a, c, **({"x": fields[0]} if fields else {}))
        if name != "E":
            sim.add_edge(name, b, c, **({"x": fields[1]} if fields else {}))
    sim.finish_init()
    rows = [(name, sim.num_edges(name), sim.mapreduce(F.col("x"), "+", name) if "Stateless" not in HINTED[name] else None) for name in names]
    return spark.createDataFrame(rows, "name string, n int, s int")


# construction
@query("SELECT i AS id, CAST(i * i AS BIGINT) AS square, CAST(i - 1 AS BIGINT) AS sources FROM range(1, 9) t(i)")
def single_adds(spark, sf_dir):
    sim = Simulation(spark, Model("single").agent("A", "square long, n long").edge("E", "w long"))
    ids = [sim.add_agent("A", square=i * i, n=0) for i in range(1, 9)]
    for k, to in enumerate(ids):
        for source in ids[:k]:
            sim.add_edge("E", source, to, w=k)
    after = sim.finish_init().apply(lambda c: Step({"n": c.num_edges("E")}), "A", read=["A", "E"], write="A")
    return after.agents("A").select(nr("id").alias("id"), "square", F.col("n").alias("sources"))


@query("SELECT count(*) AS before, true AS one_each FROM customer")
def agent_per_process(spark, sf_dir):
    sim = shop(spark, sf_dir)
    before = sim.num_agents("Customer")
    sim.add_agent_per_process("Customer", bal=0, nation=1, n=0, spend=0)
    added = sim.num_agents("Customer") - before
    return one_row(spark, before=(before, "long"), one_each=(added == spark.sparkContext.defaultParallelism, "boolean"))


def linked_graph(spark, vertices, edges, directed=False) -> Simulation:
    sim = Simulation(spark, Model("graph").agent("V", "idx long, s long").edge("E", hints=["Stateless"]))
    sim.add_graph(vertices, edges, "V", "E", directed=directed, agent_fields={"idx": F.col("v"), "s": F.lit(0)})
    return sim.finish_init()


def neighbour_sums(sim: Simulation):
    after = sim.apply(lambda c: Step({"s": c.agg("E", F.sum("source.idx"), "V")}), "V", read=["V", "E"], write="V")
    return after.agents("V").select("idx", "s")


@query("SELECT i AS idx, CAST(325 - i AS BIGINT) AS s FROM range(1, 26) t(i)")
def add_graph_complete(spark, sf_dir):
    return neighbour_sums(linked_graph(spark, *complete_graph(spark, 25)))


@query("SELECT i AS idx, CASE WHEN i = 1 THEN 100 ELSE i - 1 END AS s FROM range(1, 101) t(i)")
def add_graph_cycle(spark, sf_dir):
    return neighbour_sums(linked_graph(spark, *cycle_digraph(spark, 100), directed=True))


@query("WITH v AS (SELECT c * 7 + x AS idx, c, x FROM range(0, 8) a(c), range(1, 8) b(x)), w AS (SELECT a.idx, b.idx AS o FROM v a JOIN v b ON a.c = b.c AND a.idx != b.idx UNION ALL SELECT a.idx, b.idx FROM v a JOIN v b ON a.x = 1 AND b.x = 1 AND ((a.c + 1) % 8 = b.c OR (b.c + 1) % 8 = a.c)) SELECT idx, CAST(sum(o) AS BIGINT) AS s FROM w GROUP BY idx")
def add_graph_cliques(spark, sf_dir):
    return neighbour_sums(linked_graph(spark, *clique_graph(spark, 7, 8)))


@query("SELECT count(*) AS n, count(*) AS same FROM (SELECT c_custkey FROM customer UNION ALL SELECT o_orderkey FROM orders)")
def init_idmapping(spark, sf_dir):
    model = Model("init").agent("Customer", "").agent("Order", "")
    sim = Simulation(spark, model, lazy=True)
    agents(sim, spark, sf_dir, "Customer", "customer", "c_custkey")
    agents(sim, spark, sf_dir, "Order", "orders", "o_orderkey")
    part = sim.agents("Customer").select("id", F.pmod("id", F.lit(3)).alias("part"))
    ids = sim.finish_init(return_idmapping=True, partition=part)
    assert refused(sim.finish_init)
    known = sim.agents("Customer").select("id").unionByName(sim.agents("Order").select("id"))
    return ids.join(known, ids.new == known.id).agg(F.count("*").alias("n"), F.count_if(F.col("old") == F.col("new")).alias("same"))


# rasters
@query("SELECT x, y, (x - 1) + 10 * (y - 1) + 1 AS id FROM (VALUES (1, 1), (10, 1), (3, 5), (10, 8)) v(x, y)")
def raster_cellid(spark, sf_dir):
    sim = grid(spark, (10, 8)).finish_init()
    rows = [(x, y, sim.cellid("g", x, y) & ((1 << 36) - 1)) for x, y in ((1, 1), (10, 1), (3, 5), (10, 8))]
    return spark.createDataFrame(rows, "x int, y int, id int")


@query("SELECT count(*) AS n, true AS inside, true AS spread, true AS right_cell FROM customer")
def random_cells_uniform(spark, sf_dir):
    sim = grid(spark, (10, 8)).finish_init()
    rows = sim.random_cells("g", table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id")), 7)
    n = F.count("*")
    right = F.col("cell").bitwiseAND(F.lit((1 << 36) - 1)) == F.col("i0") + 10 * (F.col("i1") - 1)
    # each of 80 cells gets its share within a wide band
    counts = rows.groupBy("cell").agg(n.alias("k")).agg(F.min("k").alias("low"), F.max("k").alias("high"), F.count("*").alias("cells"))
    whole = rows.agg(n.alias("n"), F.bool_and(F.col("i0").between(1, 10) & F.col("i1").between(1, 8)).alias("inside"), F.bool_and(right).alias("right_cell"))
    got, each = whole.first(), counts.first()
    mean = got["n"] / 80
    return one_row(spark, n=(got["n"], "long"), inside=(got["inside"], "boolean"), spread=(each["cells"] == 80 and each["high"] < 3 * mean + 10, "boolean"), right_cell=(got["right_cell"], "boolean"))


# what a rule sees
def buyers(spark, sf_dir) -> Simulation:
    """Orders that know their customer's id, and a mixed id: the customer's, or for large orders the nation's."""
    model = Model("buyers").agent("Nation", "name string").agent("Customer", "name string, bal decimal(18,2)").agent("Order", "buyer long, mixed long, bal decimal(18,2), name string")
    sim = Simulation(spark, model, lazy=True)
    agents(sim, spark, sf_dir, "Nation", "nation", "n_nationkey", 1, name=F.col("n_name"))
    agents(sim, spark, sf_dir, "Customer", "customer", "c_custkey", name=F.col("c_name"), bal=money("c_acctbal"))
    home = make_id(model.agents["Nation"].number, F.pmod("o_orderkey", F.lit(25)) + 1)
    buyer = ident(sim, "Customer", "o_custkey")
    agents(sim, spark, sf_dir, "Order", "orders", "o_orderkey", buyer=buyer, mixed=F.when(F.col("o_totalprice") > 200000, home).otherwise(buyer), bal=None, name=None)
    return sim.finish_init()


@query("SELECT o_orderkey AS id, CAST(c_acctbal AS DECIMAL(18,2)) AS bal, c_name AS name FROM orders JOIN customer ON c_custkey = o_custkey")
def agentstate_in_rule(spark, sf_dir):
    def rule(c):
        buyer = c.agentstate(c.state.buyer, "Customer")
        return Step({"bal": buyer["bal"], "name": buyer["name"]})

    after = buyers(spark, sf_dir).apply(rule, "Order", read=["Order", "Customer"], write="Order")
    return after.agents("Order").select(nr("id").alias("id"), "bal", "name")


@query("SELECT o_orderkey AS id, CASE WHEN o_totalprice > 200000 THEN n_name ELSE c_name END AS name FROM orders JOIN customer ON c_custkey = o_custkey JOIN nation ON n_nationkey = o_orderkey % 25")
def agentstate_flexible(spark, sf_dir):
    rule = lambda c: Step({"name": c.agentstate_flexible(c.state.mixed, "Customer", "Nation")["name"]})
    after = buyers(spark, sf_dir).apply(rule, "Order", read=["Order", "Customer", "Nation"], write="Order")
    return after.agents("Order").select(nr("id").alias("id"), "name")


@query("SELECT n_regionkey AS id, string_agg(n_nationkey::VARCHAR, ',' ORDER BY n_nationkey) AS ids, string_agg(n_name, ',' ORDER BY n_name) AS names, string_agg(n_nationkey::VARCHAR, ';' ORDER BY n_nationkey) AS states FROM nation GROUP BY 1")
def neighbour_iterators(spark, sf_dir):
    def rule(c):
        ids = F.array_join(F.transform(c.neighborids_iter("In"), lambda x: (agent_nr(x) - 1).cast("string")), ",")
        names = F.array_join(F.array_sort(F.transform(c.neighborstates_iter("In", "Nation"), lambda x: x["name"])), ",")
        flexible = F.array_join(F.array_sort(F.transform(c.neighborstates_flexible_iter("In", "Nation", "Region"), lambda x: x["name"])), ",")
        states = F.array_join(F.transform(c.edgestates_iter("In"), lambda x: x.k.cast("string")), ";")
        return Step({"seen": F.concat_ws("|", ids, names, flexible, states)})

    after = world(spark, sf_dir).apply(rule, "Region", read=["Region", "Nation", "In"], write="Region")
    part = F.split("seen", r"\|")
    rows = after.agents("Region").select((agent_nr(F.col("id")) - 1).cast("int").alias("id"), part[0].alias("ids"), part[1].alias("names"), part[2].alias("flexible"), part[3].alias("states"))
    return rows.filter("names = flexible").drop("flexible")


@query("SELECT c_custkey AS id, count(o_orderkey) AS n, count(o_orderkey) = 0 AS none FROM customer LEFT JOIN orders ON o_custkey = c_custkey AND o_totalprice > 300000 GROUP BY 1")
def checked_neighbours(spark, sf_dir):
    sim = shop(spark, sf_dir).apply(lambda c: Step(alive=c.state.total > 300000), "Order", read="Order", write="Order")
    after = sim.apply(lambda c: Step({"n": c.checked(c.neighborids("Placed"), lambda found: F.size(found).cast("long"))}), "Customer", read=["Customer", "Placed"], write="Customer")
    return after.agents("Customer").select(nr("id").alias("id"), F.coalesce("n", F.lit(0)).alias("n"), F.col("n").isNull().alias("none"))


@query("SELECT a.l_partkey AS part, b.l_suppkey AS supplier, count(*) AS n, CAST(sum(CAST(a.l_quantity AS DECIMAL(18,2)) - CAST(b.l_discount AS DECIMAL(18,2))) AS DECIMAL(28,2)) AS w FROM lineitem a JOIN lineitem b ON a.l_orderkey = b.l_orderkey WHERE a.l_orderkey % 2 = 0 GROUP BY 1, 2")
def hub_edges(spark, sf_dir):
    sim = lines(spark, sf_dir)
    sim.model.edge("Meets", "w decimal(18,2)")
    meets = HubEdges("Meets", "Uses", "Ships", {"w": F.col("left.qty") - F.col("right.discount")}, when=agent_nr(F.col("id")) % 2 == 0)
    after = sim.apply(lambda c: Step(hubs=[meets]), "Order", read=["Uses", "Ships"], write="Meets")
    return after.edges("Meets").groupBy(nr("from").alias("part"), nr("to").alias("supplier")).agg(F.count("*").alias("n"), F.sum("w").cast("decimal(28,2)").alias("w"))


@query("SELECT count(*) AS n, true AS hidden FROM customer WHERE c_custkey % 2 = 0")
def hidden_state(spark, sf_dir):
    sim = shop(spark, sf_dir)
    hidden = refused(lambda: sim.apply(lambda c: Step({"n": c.state.nation}), "Customer", write="Customer"))
    after = sim.apply(lambda c: Step(alive=agent_nr(c.id) % 2 == 0), "Customer", write="Customer")
    return one_row(spark, n=(after.num_agents("Customer"), "long"), hidden=(hidden, "boolean"))


@query("SELECT true AS state, true AS death, true AS edge, true AS drop_rest, true AS read_edge, true AS immortal, true AS unknown")
def step_guards(spark, sf_dir):
    sim = world(spark, sf_dir)
    still = Simulation(spark, Model("still").agent("A", "x long", hints=["Immortal"]).edge("E", hints=["Stateless"]))
    still.add_agent("A", x=1)
    still.finish_init()
    calls = {
        "state": lambda: sim.apply(lambda c: Step({"size": F.lit(1)}), "Region", read="Region"),
        "death": lambda: sim.apply(lambda c: Step(alive=F.lit(False)), "Region", read="Region"),
        "edge": lambda: sim.apply(lambda c: Step(edges=[NewEdge("Lives", to=c.id, source=c.id)]), "Region", read="Region"),
        "drop_rest": lambda: sim.apply(lambda c: Step(drops=[DropEdges("Lives", to=c.id)]), "Nation", read="Nation", write="Lives"),
        "read_edge": lambda: sim.apply(lambda c: Step({"size": c.num_edges("In")}), "Region", read="Region", write="Region"),
        "immortal": lambda: still.apply(lambda c: Step(alive=F.lit(False)), "A", read="A", write="A"),
        "unknown": lambda: sim.apply(noop, "Nobody"),
    }
    return one_row(spark, **{k: (refused(f), "boolean") for k, f in calls.items()})


@query("SELECT count(*) AS pending, CAST(0 AS BIGINT) AS sealed, count(*) AS done FROM orders")
def num_edges_pending(spark, sf_dir):
    model = Model("pending").agent("Customer", "").edge("Bought", hints=["Stateless"])
    sim = Simulation(spark, model, lazy=True)
    agents(sim, spark, sf_dir, "Customer", "customer", "c_custkey")
    sim.add_edges("Bought", table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("from"), ident(sim, "Customer", "o_custkey").alias("to")))
    pending, sealed = sim.num_edges("Bought", write=True), sim.num_edges("Bought")
    return one_row(spark, pending=(pending, "long"), sealed=(sealed, "long"), done=(sim.finish_init().num_edges("Bought"), "long"))


# scans and export
@query("SELECT CAST(c_acctbal AS DECIMAL(18,2)) AS bal FROM customer")
def all_agents(spark, sf_dir):
    return world(spark, sf_dir).all_agents("Customer")


@query("SELECT c_custkey AS id FROM customer")
def all_agentids(spark, sf_dir):
    return world(spark, sf_dir).all_agentids("Customer").select(nr("id").alias("id"))


@query("SELECT CAST(n_regionkey AS BIGINT) AS \"to\", CAST(n_nationkey AS BIGINT) AS \"from\", n_nationkey AS k FROM nation")
def all_edges(spark, sf_dir):
    return world(spark, sf_dir).all_edges("In").select(nr("to", 1).alias("to"), nr("edge.from", 1).alias("from"), F.col("edge.state.k").alias("k"))


@query("SELECT CAST(c_nationkey AS BIGINT) AS \"to\", c_custkey AS \"from\" FROM customer")
def edges_iterator(spark, sf_dir):
    sim = world(spark, sf_dir)
    counts = latest(spark, sf_dir, ["NumEdgesOnly"])
    assert refused(lambda: counts.edges_iterator("Last")) and sim.edges_iterator("In").columns == ["to", "edge"]
    return sim.edges_iterator("Lives").select(nr("to", 1).alias("to"), nr("from").alias("from"))


@query("SELECT '0x' || lpad(lower(to_hex(CAST(3 AS BIGINT) * 72057594037927936 + c_custkey)), 16, '0') AS hex FROM customer")
def hex_ids(spark, sf_dir):
    return world(spark, sf_dir).agents("Customer").select(hex_id(F.col("id")).alias("hex"))


@query("SELECT count(*) AS ne, count(DISTINCT l_partkey) + (SELECT count(*) FROM orders) + (SELECT count(*) FROM part WHERE p_partkey NOT IN (SELECT l_partkey FROM lineitem)) AS nv, true AS directed, 'long' AS eltype, true AS inside, false AS outside FROM lineitem")
def graph_interface(spark, sf_dir):
    g = returned(spark, sf_dir).subgraph()
    s, t = (int(x) for x in g.edges().first())
    assert g.edgetype and g.edges().columns == ["s", "t"] and g.vertices().columns == ["v"]
    return one_row(spark, ne=(g.ne(), "long"), nv=(g.nv(), "long"), directed=(g.is_directed, "boolean"), eltype=(g.eltype, "string"), inside=(g.has_edge(s, t) and g.has_vertex(s), "boolean"), outside=(g.has_edge(t, s) or g.has_vertex(0), "boolean"))


@query("SELECT l_partkey AS id, count(DISTINCT l_orderkey) AS k FROM lineitem GROUP BY 1")
def graph_outneighbors(spark, sf_dir):
    g = returned(spark, sf_dir).subgraph()
    return g.outneighbors().join(g.vertex_table, "v").select(nr("id").alias("id"), F.size("neighbors").cast("long").alias("k"))


@query("SELECT true AS printed, true AS one, true AS none, true AS reprs")
def describe_agent(spark, sf_dir):
    import contextlib
    import io

    sim, out = world(spark, sf_dir), io.StringIO()
    with contextlib.redirect_stdout(out):
        one = sim.describe_agent("Region", neighborstates=("In",), most=2)
        none = sim.describe_agent("Region", 1)
    shown = out.getvalue()
    reprs = "agent Region" in repr(sim.model) and "edge Lives" in repr(sim.model) and "Region" in repr(sim)
    return one_row(spark, printed=("Region" in shown and "Nation" in shown, "boolean"), one=(one is not None, "boolean"), none=(none is None, "boolean"), reprs=(reprs, "boolean"))


# stores
def stored(spark, sf_dir, steps: int = 2) -> tuple[Simulation, str]:
    """The world in a store: a snapshot at the start, and one after ``steps`` steps that add one to each balance."""
    sim, path = world(spark, sf_dir), fresh(spark)
    sim.params["p"], sim.globals["g"], sim.globals["still"] = {"a": [1, 2]}, 0, 1
    sim.write_metadata("Customer", "bal", "unit", "dollar")
    sim.create_store(path)
    sim.write_sim_metadata("note", "n1")
    sim.write_snapshot("start")
    for k in range(steps):
        sim.apply_(lambda c: Step({"bal": c.state.bal + 1}), "Customer", read="Customer", write="Customer")
        sim.set_global("g", k + 1)
    sim.write_snapshot("end")
    return sim, path


@query("SELECT * FROM (VALUES (CAST(0 AS BIGINT), 'start', CAST(0 AS BIGINT)), (2, 'end', 2)) v(transition, comment, g)")
def snapshot_list(spark, sf_dir):
    _, path = stored(spark, sf_dir)
    rows = [(t, c, read_globals(spark, path, comment=c)["g"]) for t, c in list_snapshots(spark, path)]
    assert list_snapshots(spark, fresh(spark)) is None
    return spark.createDataFrame(rows, "transition long, comment string, g long")


@query("SELECT CAST(2 AS BIGINT) AS g_versions, CAST(1 AS BIGINT) AS still_versions, CAST(1 AS BIGINT) AS edge_versions, CAST(2 AS BIGINT) AS agent_versions, true AS closed")
def store_versions(spark, sf_dir):
    sim, _ = stored(spark, sf_dir)
    sim.write_snapshot("again")
    store = sim.store
    n = {k: len(store.entries(*k)) for k in (("global", "g"), ("global", "still"), ("table", "In"), ("table", "Customer"))}
    sim.close_store()
    g, still, e, a = n.values()
    return one_row(spark, g_versions=(g, "long"), still_versions=(still, "long"), edge_versions=(e, "long"), agent_versions=(a, "long"), closed=(sim.store is None, "boolean"))


@query("SELECT '{\"a\": [1, 2]}' AS p, 'dollar' AS unit, 'n1' AS note, 'world' AS model")
def store_values(spark, sf_dir):
    import json

    _, path = stored(spark, sf_dir, 1)
    return one_row(spark, p=(json.dumps(read_params(spark, path)["p"]), "string"), unit=(read_metadata(spark, path, "Customer", "bal", "unit"), "string"), note=(read_sim_metadata(spark, path, "note"), "string"), model=(read_sim_metadata(spark, path, "model_name"), "string"))


@query("SELECT CAST(n_nationkey AS BIGINT) AS \"from\", n_nationkey AS k FROM nation")
def read_edges_as_of(spark, sf_dir):
    _, path = stored(spark, sf_dir)
    return read_edges(spark, path, "In", transition=1).select(nr("from", 1).alias("from"), "k")


@query("SELECT c_nationkey AS nation, 2 * count(*) AS n, CAST(2 * sum(CAST(c_acctbal AS DECIMAL(18,2))) + 2 * count(*) AS DECIMAL(28,2)) AS bal FROM customer GROUP BY 1")
def merge_stores(spark, sf_dir):
    """Two snapshots of one store side by side under new ids: balances of the start and two steps later."""
    first, path = stored(spark, sf_dir)
    sim = Simulation(spark, first.model)
    for t in (0, 2):
        ids = sim.merge_agents(path, transition=t)
        sim.merge_edges(path, ids, ["Lives"], transition=t)
    sim.finish_init()
    found = sim.agentstate(sim.agentstate(sim.edges("Lives"), "from", "Customer"), "to", "Nation").select(F.col("Nation.name").alias("n_name"), F.col("Customer.bal").alias("bal"))
    home = table(spark, sf_dir, "nation").select("n_name", F.col("n_nationkey").alias("nation"))
    return found.join(home, "n_name").groupBy("nation").agg(F.count("*").alias("n"), F.sum("bal").cast("decimal(28,2)").alias("bal"))


@query("SELECT CAST(80 AS BIGINT) AS cells, CAST(2 AS BIGINT) AS step, CAST(1 AS BIGINT) AS changed, true AS goes_on, false AS missing")
def restore_rasters(spark, sf_dir):
    sim, path = grid(spark, (10, 8)).finish_init(), fresh(spark)
    sim.globals["g"] = 0
    sim.create_store(path)
    sim.apply_(noop, "Cell", write="Cell", read="Cell").set_global("g", 1)
    sim.apply_(noop, "Cell", write="Cell", read="Cell")
    sim.write_snapshot("two")
    only = Simulation(spark, sim.model)
    only.read_rasters(path)
    again = Simulation(spark, sim.model, filename=path)
    assert again.read_snapshot(writeable=True)
    again.apply_(noop, "Cell", write="Cell", read="Cell")
    again.write_snapshot("three")
    missing = Simulation(spark, sim.model).read_snapshot(fresh(spark))
    back = Simulation(spark, sim.model)
    back.read_snapshot(path, comment="two")
    return one_row(spark, cells=(only.raster("g").count(), "long"), step=(back.num_transitions, "long"), changed=(back.globals_last_change, "long"), goes_on=([c for _, c in list_snapshots(spark, path)] == ["two", "three"], "boolean"), missing=(missing, "boolean"))


@query("SELECT '-000001' AS first, '-000002' AS second, count(*) AS n FROM customer")
def numbered_stores(spark, sf_dir):
    base, ends = f"run-{uuid.uuid4().hex}", []
    before = config.folder, config.codec
    config.folder, config.codec = shared_folder(spark), "zstd"
    try:
        sim = world(spark, sf_dir)
        for _ in range(2):
            store = sim.create_store(base, overwrite=False)
            sim.write_snapshot()
            ends.append(store.path[-7:])
        assert config.folder in store.path
        n = read_agents(spark, store.path, "Customer").count()
    finally:
        config.folder, config.codec = before
    return one_row(spark, first=(ends[0], "string"), second=(ends[1], "string"), n=(n, "long"))


@query("SELECT o_orderkey AS id, CASE o_orderstatus WHEN 'F' THEN 0 WHEN 'O' THEN 1 WHEN 'P' THEN 2 END AS code, o_orderstatus AS status, rtrim(o_orderpriority[1:6]) AS short, o_orderkey + 1 AS next FROM orders")
def converters(spark, sf_dir):
    names = ["F", "O", "P"]
    code = enum_to_int(F.col("o_orderstatus"), names)
    rows = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), code.alias("code"), int_to_enum(code, names).alias("status"), fixed_width(F.col("o_orderpriority"), 6).alias("short"), struct_of(a=F.col("o_orderkey"), b=F.col("o_orderkey") + 1).alias("pair"))
    some = named_tuples("Pair", rows.limit(1).collect(), "pair")
    assert some[0].b == some[0].a + 1
    return rows.select("id", "code", "status", "short", F.col("pair.b").alias("next"))


# logs and settings
@query("SELECT CAST(2 AS BIGINT) AS begun, CAST(2 AS BIGINT) AS ended, true AS timed, true AS overview")
def logged_steps(spark, sf_dir):
    with tempfile.TemporaryDirectory() as folder:  # a log of the driver
        sim = world(spark, sf_dir)
        with with_logger(create_logger("run", folder)):
            for _ in range(2):
                sim.apply_(noop, "Nation", read="Nation", write="Nation")
            sim.log_overview()
        with open(os.path.join(folder, "run.log")) as f:
            said = f.read()
    logging.getLogger("synodic").debug("read back")
    return one_row(spark, begun=(said.count("<Begin>"), "long"), ended=(said.count("<End>"), "long"), timed=("Duration (ms)" in said, "boolean"), overview=("agent type Region" in said, "boolean"))


@query("SELECT true AS found_stateless, false AS kept, true AS asserted, false AS silent")
def config_flags(spark, sf_dir):
    before = dict(vars(config))
    try:
        config.detect_stateless, config.warnings = True, False
        found = Model("f").agent("A", "").edge("E").has_hint("E", "Stateless")
        config.detect_stateless = False
        kept = Model("f").agent("A", "").edge("E").has_hint("E", "Stateless")

        def broken() -> bool:
            sim = Simulation(spark, Model("f").agent("A", "").edge("E", "x long", hints=["SingleEdge"]))
            a = sim.add_agent("A")
            sim.add_edge("E", a, a, x=1).add_edge("E", a, a, x=2)
            return refused(sim.finish_init)

        config.asserts = True
        asserted = broken()
        config.asserts = False
        silent = broken()
    finally:
        vars(config).update(before)
    return one_row(spark, found_stateless=(found, "boolean"), kept=(kept, "boolean"), asserted=(asserted, "boolean"), silent=(silent, "boolean"))


@query("SELECT event_type AS kind, count(*) AS n FROM events GROUP BY 1")
def stream_steps(spark, sf_dir):
    """Events as a stream: each micro-batch becomes agents' counts by one step."""
    from .streaming.driver import StreamDriver

    model = Model("stream").agent("Kind", "name string, n long")
    sim = Simulation(spark, model)
    names = sorted(r[0] for r in table(spark, sf_dir, "events").select("event_type").distinct().collect())
    for name in names:
        sim.add_agent("Kind", name=name, n=0)
    sim.finish_init()

    def on_batch(sim, rows):
        counts = rows.groupBy("event_type").agg(F.count("*").alias("k"))
        seen = {r["event_type"]: r["k"] for r in counts.collect()}  # one row a kind
        more = F.coalesce(F.create_map(*[F.lit(x) for pair in seen.items() for x in pair])[F.col("name")] if seen else F.lit(0), F.lit(0))
        return sim.apply(lambda c: Step({"n": c.state.n + more}), "Kind", read="Kind", write="Kind")

    source = table(spark, sf_dir, "events")
    stream = spark.readStream.schema(source.schema).parquet(f"{sf_dir}/events.parquet*")
    driver = StreamDriver(sim, on_batch, store=fresh(spark))
    driver.start(stream, fresh(spark)).awaitTermination()
    return driver.sim.agents("Kind").select(F.col("name").alias("kind"), "n")
