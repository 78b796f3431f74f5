"""Queries over the driver's tables read as graphs, each with the SQL it must agree with."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import DropEdges, Model, NewAgent, NewEdge, Simulation, Step, noop
from .functions.ids import agent_nr, make_id
from .plans.materialise import shared_folder
from .sources.snapshots import read_agents

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def money(column: str):
    return F.col(column).cast("decimal(18,2)")


def agents(sim: Simulation, spark, sf_dir, kind: str, name: str, key: str, shift: int = 0, /, **fields) -> None:
    frame = table(spark, sf_dir, name)
    types = {f.name: f.dataType for f in sim.model.agents[kind].fields.fields}
    columns = [(F.lit(None) if c is None else c).cast(types[f]).alias(f) for f, c in fields.items()]
    sim.add_agents(kind, frame.select((F.col(key).cast("long") + shift).alias("_key"), *columns), nr="_key")


def ident(sim: Simulation, kind: str, key, shift: int = 0):
    return make_id(sim.model.agents[kind].number, (F.col(key) if isinstance(key, str) else key).cast("long") + shift)


def shop(spark, sf_dir, **hints) -> Simulation:
    """Customers and orders; an edge from each order to its customer."""
    model = Model("shop").agent("Customer", "bal decimal(18,2), nation int, n long, spend decimal(28,2)").agent("Order", "total decimal(18,2), priority string")
    model.edge("Placed", "total decimal(18,2)", **hints)
    sim = Simulation(spark, model, lazy=True)
    agents(sim, spark, sf_dir, "Customer", "customer", "c_custkey", bal=money("c_acctbal"), nation=F.col("c_nationkey"), n=None, spend=None)
    agents(sim, spark, sf_dir, "Order", "orders", "o_orderkey", total=money("o_totalprice"), priority=F.col("o_orderpriority"))
    sim.add_edges("Placed", table(spark, sf_dir, "orders").select(ident(sim, "Order", "o_orderkey").alias("from"), ident(sim, "Customer", "o_custkey").alias("to"), money("o_totalprice").alias("total")))
    return sim.finish_init()


def lines(spark, sf_dir) -> Simulation:
    """Parts, suppliers and orders; an edge for each line from part to order and from supplier to order (parallel ones stay)."""
    model = Model("lines").agent("Part", "price decimal(18,2), size int").agent("Supplier", "bal decimal(18,2)").agent("Order", "value decimal(28,2), n long")
    model.edge("Uses", "qty decimal(18,2), discount decimal(18,2)").edge("Ships", "qty decimal(18,2), discount decimal(18,2)")
    sim = Simulation(spark, model, lazy=True)
    agents(sim, spark, sf_dir, "Part", "part", "p_partkey", price=money("p_retailprice"), size=F.col("p_size"))
    agents(sim, spark, sf_dir, "Supplier", "supplier", "s_suppkey", bal=money("s_acctbal"))
    agents(sim, spark, sf_dir, "Order", "orders", "o_orderkey", value=None, n=None)
    rows = table(spark, sf_dir, "lineitem").select("l_partkey", "l_suppkey", ident(sim, "Order", "l_orderkey").alias("to"), money("l_quantity").alias("qty"), money("l_discount").alias("discount"))
    sim.add_edges("Uses", rows.withColumn("from", ident(sim, "Part", "l_partkey")))
    sim.add_edges("Ships", rows.withColumn("from", ident(sim, "Supplier", "l_suppkey")))
    return sim.finish_init()


def nr(column: str, shift: int = 0):
    return (agent_nr(F.col(column)) - shift).cast("long")


@query("SELECT c_custkey AS id, count(o_orderkey) AS n, CAST(coalesce(sum(CAST(o_totalprice AS DECIMAL(18,2))), 0) AS DECIMAL(28,2)) AS spend FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY c_custkey")
def customer_spend(spark, sf_dir):
    rule = lambda c: Step({"n": c.num_edges("Placed"), "spend": F.coalesce(c.agg("Placed", F.sum("total")), F.lit(0))})
    after = shop(spark, sf_dir).apply(rule, "Customer", read=["Customer", "Placed"], write="Customer")
    return after.agents("Customer").select(nr("id").alias("id"), "n", "spend")


@query("SELECT c_custkey AS id, count(o_orderkey) AS n FROM customer LEFT JOIN orders ON o_custkey = c_custkey AND o_totalprice > 300000 GROUP BY c_custkey")
def num_edges(spark, sf_dir):
    sim = shop(spark, sf_dir)
    big = sim.apply(lambda c: Step(alive=c.state.total > 300000), "Order", read="Order", write="Order")
    after = big.apply(lambda c: Step({"n": c.num_edges("Placed")}), "Customer", read=["Customer", "Placed"], write="Customer")
    return after.agents("Customer").select(nr("id").alias("id"), "n")


@query("SELECT c_custkey AS id, EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 400000) AS has FROM customer")
def has_edge(spark, sf_dir):
    big = shop(spark, sf_dir).apply(lambda c: Step(alive=c.state.total > 400000), "Order", read="Order", write="Order")
    after = big.apply(lambda c: Step({"n": c.has_edge("Placed").cast("long")}), "Customer", read=["Customer", "Placed"], write="Customer")
    return after.agents("Customer").select(nr("id").alias("id"), (F.col("n") == 1).alias("has"))


def world(spark, sf_dir) -> Simulation:
    model = Model("world").agent("Region", "seen string, size long").agent("Nation", "name string, region int").agent("Customer", "bal decimal(18,2)")
    model.edge("In", "k int").edge("Lives", hints=["Stateless"])
    sim = Simulation(spark, model, lazy=True)
    agents(sim, spark, sf_dir, "Region", "region", "r_regionkey", 1, seen=None, size=None)
    agents(sim, spark, sf_dir, "Nation", "nation", "n_nationkey", 1, name=F.col("n_name"), region=F.col("n_regionkey"))
    agents(sim, spark, sf_dir, "Customer", "customer", "c_custkey", bal=money("c_acctbal"))
    sim.add_edges("In", table(spark, sf_dir, "nation").select(ident(sim, "Nation", "n_nationkey", 1).alias("from"), ident(sim, "Region", "n_regionkey", 1).alias("to"), F.col("n_nationkey").alias("k")))
    sim.add_edges("Lives", table(spark, sf_dir, "customer").select(ident(sim, "Customer", "c_custkey").alias("from"), ident(sim, "Nation", "c_nationkey", 1).alias("to")))
    return sim.finish_init()


def region_seen(spark, sf_dir, value, read=()):
    after = world(spark, sf_dir).apply(lambda c: Step({"seen": value(c)}), "Region", read=["Region", "In", *read], write="Region")
    return after.agents("Region").select(nr("id", 1).alias("id"), "seen")


@query("SELECT r_regionkey::BIGINT AS id, string_agg(n_nationkey::VARCHAR, ',' ORDER BY n_nationkey) AS seen FROM region LEFT JOIN nation ON n_regionkey = r_regionkey GROUP BY r_regionkey")
def neighborids(spark, sf_dir):
    return region_seen(spark, sf_dir, lambda c: F.array_join(F.transform(c.neighborids("In"), lambda x: (agent_nr(x) - 1).cast("string")), ","))


@query("SELECT r_regionkey::BIGINT AS id, string_agg(n_nationkey::VARCHAR, ',' ORDER BY n_nationkey) AS seen FROM region LEFT JOIN nation ON n_regionkey = r_regionkey GROUP BY r_regionkey")
def edgestates(spark, sf_dir):
    return region_seen(spark, sf_dir, lambda c: F.array_join(F.transform(c.edgestates("In"), lambda x: x.k.cast("string")), ","))


@query("SELECT r_regionkey::BIGINT AS id, string_agg(n_nationkey || ':' || n_nationkey, ',' ORDER BY n_nationkey) AS seen FROM region LEFT JOIN nation ON n_regionkey = r_regionkey GROUP BY r_regionkey")
def edges_of_agent(spark, sf_dir):
    return region_seen(spark, sf_dir, lambda c: F.array_join(F.transform(c.edges("In"), lambda x: F.concat((agent_nr(x["from"]) - 1).cast("string"), F.lit(":"), x.state.k.cast("string"))), ","))


@query("SELECT r_regionkey::BIGINT AS id, string_agg(n_name, ',' ORDER BY n_name) AS seen FROM region LEFT JOIN nation ON n_regionkey = r_regionkey GROUP BY r_regionkey")
def neighborstates(spark, sf_dir):
    return region_seen(spark, sf_dir, lambda c: F.array_join(F.array_sort(F.transform(c.neighborstates("In", "Nation"), lambda x: x["name"])), ","), ["Nation"])


@query("SELECT l_orderkey AS id, CAST(sum(CAST(p_retailprice AS DECIMAL(18,2))) AS DECIMAL(28,2)) AS value, count(*) AS n FROM lineitem JOIN part ON p_partkey = l_partkey GROUP BY l_orderkey")
def neighborstates_agg(spark, sf_dir):
    rule = lambda c: Step({"value": c.agg("Uses", F.sum("source.price"), "Part"), "n": c.num_edges("Uses")}, alive=c.has_edge("Uses"))
    after = lines(spark, sf_dir).apply(rule, "Order", read=["Order", "Part", "Uses"], write="Order")
    return after.agents("Order").select(nr("id").alias("id"), "value", "n")


@query("SELECT l_orderkey AS id, count(*) AS n, CAST(sum(CAST(s_acctbal AS DECIMAL(18,2))) AS DECIMAL(28,2)) AS value FROM lineitem JOIN supplier ON s_suppkey = l_suppkey GROUP BY l_orderkey")
def neighborstates_flexible(spark, sf_dir):
    rule = lambda c: Step({"value": F.aggregate(c.neighborstates_flexible("Ships", "Supplier", "Part"), F.lit(0).cast("decimal(28,2)"), lambda a, x: (a + x.bal).cast("decimal(28,2)")), "n": c.num_edges("Ships")}, alive=c.has_edge("Ships"))
    after = lines(spark, sf_dir).apply(rule, "Order", read=["Order", "Part", "Supplier", "Ships"], write="Order")
    return after.agents("Order").select(nr("id").alias("id"), "value", "n")


def one_row(spark, **values) -> DataFrame:
    return spark.range(1).select(*[F.lit(v).cast(kind).alias(k) for k, (v, kind) in values.items()])


@query("SELECT CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) AS DECIMAL(28,2)) AS total, max(o_orderkey) AS top, min(o_orderkey) AS low, count(*) AS n FROM orders")
def mapreduce_sum(spark, sf_dir):
    sim = shop(spark, sf_dir)
    edge_total = sim.mapreduce(F.col("total"), "+", "Placed")
    return one_row(spark, total=(edge_total, "decimal(28,2)"), top=(sim.mapreduce(agent_nr(F.col("id")), "max", "Order"), "long"), low=(sim.mapreduce(agent_nr(F.col("id")), "min", "Order"), "long"), n=(sim.num_agents("Order"), "long"))


@query("SELECT bool_and(o_totalprice > 0) AS ba, bool_or(o_totalprice > 500000) AS bo, bit_and(o_orderkey) AS ia, bit_or(o_orderkey) AS io, CAST(sum(CASE WHEN o_totalprice > 100000 THEN 1 ELSE 0 END) AS BIGINT) AS k FROM orders")
def mapreduce_bits(spark, sf_dir):
    sim, key = shop(spark, sf_dir), agent_nr(F.col("id"))
    return one_row(
        spark, ba=(sim.mapreduce(F.col("total") > 0, "&", "Order"), "boolean"), bo=(sim.mapreduce(F.col("total") > 500000, "|", "Order"), "boolean"), ia=(sim.mapreduce(key, "&", "Order"), "long"),
        io=(sim.mapreduce(key, "|", "Order"), "long"), k=(sim.mapreduce(F.col("total") > 100000, "+", "Order"), "long"),
    )


@query("SELECT CAST(product(r_regionkey + 2) AS BIGINT) AS p FROM region")
def mapreduce_product(spark, sf_dir):
    return one_row(spark, p=(world(spark, sf_dir).mapreduce(agent_nr(F.col("id")) + 1, "*", "Region"), "long"))


@query("SELECT CAST(coalesce(sum(o_orderkey), 0) AS BIGINT) AS s, coalesce(max(o_orderkey), -9223372036854775807) AS mx, coalesce(min(o_orderkey), 9223372036854775807) AS mn, coalesce(bool_and(o_totalprice > 0), true) AS ba, coalesce(bool_or(o_totalprice > 0), false) AS bo FROM orders WHERE o_orderkey < 0")
def mapreduce_empty(spark, sf_dir):
    sim, key = shop(spark, sf_dir).apply(noop, "Customer", write="Order"), F.col("id")
    got = {k: sim.mapreduce(v, op, "Order") for k, v, op in (("s", key, "+"), ("mx", key, "max"), ("mn", key, "min"), ("ba", F.col("total") > 0, "&"), ("bo", F.col("total") > 0, "|"))}
    return one_row(spark, **{k: (v, "boolean" if k[0] == "b" else "long") for k, v in got.items()})


@query("SELECT CAST(sum(CASE WHEN c_acctbal < 0 THEN 1 ELSE 0 END) AS BIGINT) AS below, CAST(count(*) AS BIGINT) AS n, CAST(max(CAST(c_acctbal AS DECIMAL(18,2))) - min(CAST(c_acctbal AS DECIMAL(18,2))) AS DECIMAL(28,2)) AS spread FROM customer")
def mapreduce_own_op(spark, sf_dir):
    sim = shop(spark, sf_dir)
    spread = sim.mapreduce(F.col("bal"), lambda v: F.max(v) - F.min(v), "Customer", init=0)
    return one_row(spark, below=(sim.mapreduce(F.col("bal") < 0, "+", "Customer"), "long"), n=(sim.num_agents("Customer"), "long"), spread=(spread, "decimal(28,2)"))


@query("WITH hit AS (SELECT DISTINCT o_custkey AS k FROM orders WHERE o_orderpriority = '1-URGENT' AND o_totalprice > 400000) SELECT c_custkey AS id, CAST(CAST(c_acctbal AS DECIMAL(18,2)) + CASE WHEN k IS NULL THEN 0 ELSE 1 END AS DECIMAL(18,2)) AS bal FROM customer LEFT JOIN hit ON k = c_custkey")
def with_edge(spark, sf_dir):
    sim = shop(spark, sf_dir).apply(lambda c: Step(alive=(c.state.priority == "1-URGENT") & (c.state.total > 400000)), "Order", read="Order", write="Order")
    after = sim.apply(lambda c: Step({"bal": c.state.bal + 1}), "Customer", read="Customer", write="Customer", with_edge="Placed")
    return after.agents("Customer").select(nr("id").alias("id"), "bal")


@query("SELECT c_nationkey AS nation, count(o_orderkey) AS n FROM customer JOIN orders ON o_custkey = c_custkey WHERE c_acctbal >= 0 GROUP BY c_nationkey")
def remove_agents_cascade(spark, sf_dir):
    after = shop(spark, sf_dir).apply(lambda c: Step(alive=c.state.bal >= 0), "Customer", read="Customer", write="Customer")
    return after.agentstate(after.edges("Placed"), "to", "Customer").groupBy("Customer.nation").agg(F.count("*").alias("n")).select("nation", "n")


@query("SELECT count(*) AS n, CAST(sum(o_orderkey) AS BIGINT) AS s FROM orders JOIN customer ON c_custkey = o_custkey WHERE c_acctbal >= 5000")
def remove_edges_to(spark, sf_dir):
    rule = lambda c: Step(drops=[DropEdges("Placed", to=c.id, when=c.state.bal < 5000)])
    after = shop(spark, sf_dir).apply(rule, "Customer", read=["Customer"], write="Placed", add_existing="Placed")
    return after.edges("Placed").agg(F.count("*").alias("n"), F.sum(agent_nr(F.col("from"))).alias("s"))


@query("SELECT count(*) AS n, CAST(sum(l_suppkey) AS BIGINT) AS s FROM lineitem l WHERE NOT EXISTS (SELECT 1 FROM lineitem r WHERE r.l_discount > 0.09 AND r.l_suppkey = l.l_suppkey AND r.l_orderkey = l.l_orderkey)")
def remove_edges_pair(spark, sf_dir):
    rule = lambda c: Step(drops=[DropEdges("Ships", to=c.id, matching=F.col("discount") > 0.09)])
    after = lines(spark, sf_dir).apply(rule, "Order", read=["Order", "Ships"], write="Ships", add_existing="Ships")
    return after.edges("Ships").agg(F.count("*").alias("n"), F.sum(agent_nr(F.col("from"))).alias("s"))


def doubled(spark, sf_dir, **keep):
    rule = lambda c: Step(edges=[NewEdge("Placed", to=F.col("each"), source=c.id, fields={"total": c.state.total}, each=F.array(F.col("id")), when=c.state.total > 200000)])
    after = shop(spark, sf_dir).apply(rule, "Order", read="Order", write="Placed", **keep)
    return after.edges("Placed").agg(F.count("*").alias("n"), F.sum("total").cast("decimal(28,2)").alias("s"))


@query("SELECT count(*) AS n, CAST(sum(t) AS DECIMAL(28,2)) AS s FROM (SELECT CAST(o_totalprice AS DECIMAL(18,2)) AS t FROM orders UNION ALL SELECT CAST(o_totalprice AS DECIMAL(18,2)) FROM orders WHERE o_totalprice > 200000)")
def add_existing_edges(spark, sf_dir):
    return doubled(spark, sf_dir, add_existing="Placed")


@query("SELECT count(*) AS n, CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) AS DECIMAL(28,2)) AS s FROM orders WHERE o_totalprice > 200000")
def rebuild_edges(spark, sf_dir):
    return doubled(spark, sf_dir)


@query("WITH p AS (SELECT o_custkey AS k, count(*) AS c FROM orders GROUP BY 1 HAVING count(*) > 15), m AS (SELECT max(c_custkey) AS mx FROM customer) SELECT mx + row_number() OVER (ORDER BY k) AS id, c AS n FROM p CROSS JOIN m")
def births(spark, sf_dir):
    def rule(c):
        n = c.num_edges("Placed")
        fields = {"bal": c.state.bal, "nation": c.state.nation, "n": n, "spend": F.lit(0)}
        return Step(agents=[NewAgent("Customer", fields, when=n > 15)])

    sim = shop(spark, sf_dir)
    top = sim.used["Customer"]
    after = sim.apply(rule, "Customer", read=["Customer", "Placed"], write="Customer")
    return after.agents("Customer").filter(agent_nr(F.col("id")) > top).select(nr("id").alias("id"), "n")


@query("WITH p AS (SELECT o_custkey AS k, count(*) AS c FROM orders GROUP BY 1 HAVING count(*) > 15), m AS (SELECT max(c_custkey) AS mx FROM customer), r AS (SELECT k, row_number() OVER (ORDER BY k) AS i FROM p) SELECT k AS parent, mx + 2 * i - 2 + j AS child FROM r CROSS JOIN m CROSS JOIN (VALUES (1), (2)) v(j)")
def birth_edges(spark, sf_dir):
    model_edge = "Placed"

    def rule(c):
        n = c.num_edges(model_edge)
        fields = {"bal": c.state.bal, "nation": c.state.nation, "n": n, "spend": F.lit(0)}
        link = NewEdge(model_edge, to=F.col("newborn"), source=F.col("id"), fields={"total": F.lit(0)})
        return Step(agents=[NewAgent("Customer", fields, when=n > 15, count=2, edges=[link])])

    after = shop(spark, sf_dir).apply(rule, "Customer", read=["Customer", model_edge], write=["Customer", model_edge])
    return after.edges(model_edge).select(nr("from").alias("parent"), nr("to").alias("child"))


def latest(spark, sf_dir, hints, schema=""):
    model = Model("hints").agent("Customer", "").agent("Order", "").edge("Last", schema, hints=hints)
    sim = Simulation(spark, model, lazy=True)
    agents(sim, spark, sf_dir, "Customer", "customer", "c_custkey")
    agents(sim, spark, sf_dir, "Order", "orders", "o_orderkey")
    rows = table(spark, sf_dir, "orders")
    if schema:
        rows = rows.groupBy("o_custkey").agg(F.max("o_orderkey").alias("o_orderkey"))
    sim.add_edges("Last", rows.select(ident(sim, "Order", "o_orderkey").alias("from"), ident(sim, "Customer", "o_custkey").alias("to"), F.col("o_orderkey").alias("key")))
    return sim.finish_init()


@query("SELECT o_custkey AS id, max(o_orderkey) AS key FROM orders GROUP BY 1")
def single_edge(spark, sf_dir):
    return latest(spark, sf_dir, ["SingleEdge"], "key long").edges("Last").select(nr("to").alias("id"), "key")


@query("SELECT o_custkey AS id, count(*) AS num_edges FROM orders GROUP BY 1")
def num_edges_only(spark, sf_dir):
    return latest(spark, sf_dir, ["NumEdgesOnly"]).table("Last", localnr=True).select(F.col("to").alias("id"), "num_edges")


@query("SELECT DISTINCT o_custkey AS id, true AS has_edge FROM orders")
def has_edge_only(spark, sf_dir):
    return latest(spark, sf_dir, ["HasEdgeOnly"]).table("Last", localnr=True).select(F.col("to").alias("id"), "has_edge")


def grid(spark, dims, **options) -> Simulation:
    model = Model("grid").agent("Cell", "".join(f"i{k} int, " for k in range(len(dims))) + "active boolean").agent("Mover", "value long").edge("Next", hints=["Stateless"]).edge("On", hints=["Stateless"])
    sim = Simulation(spark, model, lazy=True)
    sim.add_raster("g", dims, "Cell", active=F.lit(False), **{f"i{k}": F.col(f"i{k}") for k in range(len(dims))})
    return sim.connect_raster_neighbors("g", "Next", **options)


@query("WITH c AS (SELECT a.x AS x, b.y AS y FROM range(1, 11) a(x) CROSS JOIN range(1, 9) b(y)), s AS (SELECT a.dx AS dx, b.dy AS dy FROM range(-1, 2) a(dx) CROSS JOIN range(-1, 2) b(dy) WHERE NOT (dx = 0 AND dy = 0)) SELECT (c.x - 1) + 10 * (c.y - 1) AS src, ((c.x + dx - 1 + 10) % 10) + 10 * ((c.y + dy - 1 + 8) % 8) AS dst FROM c CROSS JOIN s")
def raster_edges(spark, sf_dir):
    return grid(spark, (10, 8)).finish_init().edges("Next").select(nr("from", 1).alias("src"), nr("to", 1).alias("dst"))


@query("WITH c AS (SELECT a.x AS x, b.y AS y FROM range(1, 11) a(x) CROSS JOIN range(1, 9) b(y)), s AS (SELECT a.dx AS dx, b.dy AS dy FROM range(-2, 3) a(dx) CROSS JOIN range(-2, 3) b(dy) WHERE dx * dx + dy * dy BETWEEN 1 AND 5) SELECT (c.x - 1) + 10 * (c.y - 1) AS src, (c.x + dx - 1) + 10 * (c.y + dy - 1) AS dst FROM c CROSS JOIN s WHERE c.x + dx BETWEEN 1 AND 10 AND c.y + dy BETWEEN 1 AND 8")
def raster_euclidean(spark, sf_dir):
    return grid(spark, (10, 8), distance=2.24, metric="euclidean", periodic=False).finish_init().edges("Next").select(nr("from", 1).alias("src"), nr("to", 1).alias("dst"))


@query("SELECT c_custkey AS mover, 1 + (CAST(c_custkey % 10 AS BIGINT) + dx + 10) % 10 AS x, 1 + (CAST(c_custkey % 8 AS BIGINT) + dy + 8) % 8 AS y FROM customer CROSS JOIN range(-1, 2) a(dx) CROSS JOIN range(-1, 2) b(dy) WHERE abs(dx) + abs(dy) <= 1")
def move_to(spark, sf_dir):
    sim = grid(spark, (10, 8))
    agents(sim, spark, sf_dir, "Mover", "customer", "c_custkey", value=F.col("c_custkey"))
    at = sim.agents("Mover").select("id", (F.pmod("value", F.lit(10)) + 1).alias("i0"), (F.pmod("value", F.lit(8)) + 1).alias("i1"))
    sim.move_to("g", at, edge_to_cell="On", distance=1, metric="manhattan").finish_init()
    found = sim.edges("On").join(sim.raster("g").select(F.col("id").alias("to"), "i0", "i1"), "to")
    return found.select(nr("from").alias("mover"), F.col("i0").cast("long").alias("x"), F.col("i1").cast("long").alias("y"))


@query("SELECT 1 + c_custkey % 10 AS x, 1 + c_custkey % 8 AS y, count(*) AS n FROM customer GROUP BY 1, 2")
def move_within_step(spark, sf_dir):
    sim = grid(spark, (10, 8))
    agents(sim, spark, sf_dir, "Mover", "customer", "c_custkey", value=F.col("c_custkey"))
    sim.finish_init()
    rule = lambda c: Step(edges=sim.moved_edges("g", [F.pmod(c.state.value, F.lit(10)) + 1, F.pmod(c.state.value, F.lit(8)) + 1], edge_to_cell="On"))
    after = sim.apply(rule, "Mover", read="Mover", write="On")
    found = after.calc_raster("g", after.edges("On").groupBy(F.col("to").alias("id")).agg(F.count("*").alias("n")), F.col("n")).filter("value is not null")
    return found.select(F.col("i0").cast("long").alias("x"), F.col("i1").cast("long").alias("y"), F.col("value").alias("n"))


def spread(sim: Simulation, steps: int, start: tuple[int, ...]) -> Simulation:
    first = F.lit(True)
    for k, p in enumerate(start):
        first = first & (F.col(f"i{k}") == p)
    sim = sim.finish_init().apply(lambda c: Step({"active": first}), "Cell", read="Cell", write="Cell")
    for _ in range(steps):
        sim = sim.apply(lambda c: Step({"active": c.state.active | F.coalesce(c.agg("Next", F.bool_or("source.active"), "Cell"), F.lit(False))}), "Cell", read=["Cell", "Next"], write="Cell")
    return sim


@query("SELECT x, y, ((x + 10 - 8) % 10 <= 4) AND ((y + 8 - 6) % 8 <= 4) AS active FROM range(1, 11) a(x) CROSS JOIN range(1, 9) b(y)")
def diffusion(spark, sf_dir):
    found = spread(grid(spark, (10, 8)), 2, (10, 8)).rastervalues("g", "active")
    return found.select(F.col("i0").cast("long").alias("x"), F.col("i1").cast("long").alias("y"), F.col("value").alias("active"))


@query("SELECT c_custkey AS id, CAST(3 AS BIGINT) AS x, CAST(5 AS BIGINT) AS y FROM customer")
def random_cells_weighted(spark, sf_dir):
    sim = grid(spark, (10, 8)).finish_init()
    weights = sim.raster("g").select("i0", "i1", ((F.col("i0") == 3) & (F.col("i1") == 5)).cast("double").alias("weight"))
    rows = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"))
    return sim.random_cells("g", rows, 7, weights).select("id", F.col("i0").cast("long").alias("x"), F.col("i1").cast("long").alias("y"))


def opinions(spark, sf_dir) -> Simulation:
    """Customers; those of a nation are a complete graph, which needs no edges."""
    model = Model("opinions").agent("Person", "opinion decimal(18,2), nation int, n long, s decimal(28,2)")
    sim = Simulation(spark, model, lazy=True)
    agents(sim, spark, sf_dir, "Person", "customer", "c_custkey", opinion=money("c_acctbal"), nation=F.col("c_nationkey"), n=None, s=None)
    return sim.finish_init()


@query("WITH x AS (SELECT c_custkey AS i, c_nationkey AS g, CAST(c_acctbal AS DECIMAL(18,2)) AS o FROM customer) SELECT a.i AS id, count(*) AS n, CAST(sum(b.o) AS DECIMAL(28,2)) AS s FROM x a JOIN x b ON a.g = b.g AND abs(a.o - b.o) < 500 GROUP BY a.i")
def opinion_step(spark, sf_dir):
    def rule(c):
        n, s = c.near(c.state.nation, c.state.opinion, 500, c.state.opinion)
        return Step({"n": n, "s": s}, alive=n.isNotNull())

    after = opinions(spark, sf_dir).apply(rule, "Person", read=["Person"], write="Person")
    return after.agents("Person").select(nr("id").alias("id"), "n", "s")


@query("WITH p AS (SELECT l_orderkey AS k, count(DISTINCT l_partkey) AS a, count(DISTINCT l_suppkey) AS b FROM lineitem GROUP BY 1) SELECT CAST(sum(a * b) AS BIGINT) AS n FROM p")
def hub_pairs(spark, sf_dir):
    rule = lambda c: Step({"n": c.agg("Uses", F.count_distinct("from")) * c.agg("Ships", F.count_distinct("from"))}, alive=c.has_edge("Uses"))
    after = lines(spark, sf_dir).apply(rule, "Order", read=["Order", "Uses", "Ships"], write="Order")
    return one_row(spark, n=(after.mapreduce(F.col("n"), "+", "Order"), "long"))


def returned(spark, sf_dir) -> Simulation:
    model = Model("returned").agent("Part", "").agent("Order", "").edge("A", hints=["Stateless"]).edge("Other", hints=["Stateless"])
    sim = Simulation(spark, model, lazy=True)
    agents(sim, spark, sf_dir, "Part", "part", "p_partkey")
    agents(sim, spark, sf_dir, "Order", "orders", "o_orderkey")
    rows = table(spark, sf_dir, "lineitem").select("l_returnflag", ident(sim, "Part", "l_partkey").alias("from"), ident(sim, "Order", "l_orderkey").alias("to"))
    sim.add_edges("A", rows.filter("l_returnflag = 'A'")).add_edges("Other", rows.filter("l_returnflag != 'A'"))
    return sim.finish_init()


@query("SELECT a, b, min(t) AS t FROM (SELECT l_partkey AS a, l_orderkey AS b, CASE WHEN l_returnflag = 'A' THEN 'A' ELSE 'Other' END AS t FROM lineitem) q GROUP BY a, b")
def subgraph_drop_multiedges(spark, sf_dir):
    g = returned(spark, sf_dir).subgraph(drop_multiedges=True)
    ids = g.vertex_table
    out = g.edge_table.join(ids.select(F.col("v").alias("s"), F.col("id").alias("x")), "s").join(ids.select(F.col("v").alias("t"), F.col("id").alias("y")), "t")
    return out.select(nr("x").alias("a"), nr("y").alias("b"), F.col("edgetype").alias("t"))


@query("SELECT l_orderkey AS id, count(DISTINCT l_partkey) AS k FROM lineitem GROUP BY 1")
def graph_inneighbors(spark, sf_dir):
    g = returned(spark, sf_dir).subgraph()
    return g.inneighbors().join(g.vertex_table, "v").select(nr("id").alias("id"), F.size("neighbors").cast("long").alias("k"))


@query("SELECT p_partkey AS id, count(l_orderkey) AS k FROM part LEFT JOIN lineitem ON l_partkey = p_partkey GROUP BY 1")
def simple_graph(spark, sf_dir):
    sim = returned(spark, sf_dir)
    parts = sim.agents("Part").select("id")
    return sim.simplegraph().join(parts, "id", "left_semi").select(nr("id").alias("id"), F.size("targets").cast("long").alias("k"))


@query("SELECT c_custkey AS id, CAST(CAST(c_acctbal AS DECIMAL(18,2)) + 2 AS DECIMAL(18,2)) AS bal FROM customer")
def snapshot_as_of(spark, sf_dir):
    import uuid

    sim, path = shop(spark, sf_dir), f"{shared_folder(spark)}/snap-{uuid.uuid4().hex}"
    sim.create_store(path)
    for k in range(4):
        sim.apply_(lambda c: Step({"bal": c.state.bal + 1}), "Customer", read="Customer", write="Customer")
        if k != 2:
            sim.write_snapshot(f"after {k + 1}")
    return read_agents(spark, path, "Customer", transition=3).select(nr("id").alias("id"), "bal")


@query("SELECT c_custkey AS id, count(o_orderkey) AS n FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY c_custkey")
def snapshot_restore(spark, sf_dir):
    import uuid

    sim, path = shop(spark, sf_dir), f"{shared_folder(spark)}/snap-{uuid.uuid4().hex}"
    sim.create_store(path)
    sim.write_snapshot("start")
    again = Simulation(spark, sim.model)
    assert again.read_snapshot(path, comment="start")
    after = again.apply(lambda c: Step({"n": c.num_edges("Placed")}), "Customer", read=["Customer", "Placed"], write="Customer")
    return after.agents("Customer").select(nr("id").alias("id"), "n")


@query("SELECT n_nationkey + 1::BIGINT AS id, n_name AS name, n_regionkey AS region FROM nation")
def agents_table(spark, sf_dir):
    return world(spark, sf_dir).table("Nation", localnr=True)


@query("SELECT CAST(n_nationkey + 1 AS BIGINT) AS \"from\", CAST(n_regionkey + 1 AS BIGINT) AS \"to\", n_nationkey AS k, 'Nation' AS from_type, 'Region' AS to_type FROM nation")
def edges_table(spark, sf_dir):
    return world(spark, sf_dir).table("In", localnr=True)


@query("SELECT i AS step, CAST(i * i AS BIGINT) AS square FROM range(1, 6) t(i)")
def globals_table(spark, sf_dir):
    sim = Simulation(spark, Model("globals").global_("step", []).global_("square", []).global_("odd", [1]))
    for i in range(1, 6):
        sim.push_global("step", i).push_global("square", i * i)
    return sim.globals_table()


@query("SELECT a AS source, b AS target, count(*) AS n FROM (SELECT event_type AS a, lead(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS b FROM events) WHERE b IS NOT NULL GROUP BY 1, 2")
def user_transitions(spark, sf_dir):
    from pyspark.sql import Window

    model = Model("users").agent("Event", "kind string, before string").edge("Then", hints=["Stateless", "SingleEdge"])
    sim = Simulation(spark, model, lazy=True)
    agents(sim, spark, sf_dir, "Event", "events", "event_id", 1, kind=F.col("event_type"), before=None)
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    pairs = table(spark, sf_dir, "events").select("event_id", F.lead("event_id").over(w).alias("next")).dropna()
    sim.add_edges("Then", pairs.select(ident(sim, "Event", "event_id", 1).alias("from"), ident(sim, "Event", "next", 1).alias("to"))).finish_init()
    after = sim.apply(lambda c: Step({"before": c.neighborstates("Then", "Event").kind}), "Event", read=["Event", "Then"], write="Event")
    return after.agents("Event").filter("before is not null").groupBy(F.col("before").alias("source"), F.col("kind").alias("target")).agg(F.count("*").alias("n"))
