"""Other agents' states in rules, edges through hubs, range totals, stores, streams, and what finish() leaves."""

import random

import pytest
from pyspark.sql import functions as F

from synodic import DropEdges, HubEdges, Model, ModelError, Simulation, Step
from synodic.functions.logs import plot_globals
from synodic.operators.ranges import range_totals
from synodic.plans.materialise import shared_folder
from synodic.queries import grid
from synodic.streaming.driver import StreamDriver


def people(spark, n=12, **options):
    sim = Simulation(spark, Model("people").agent("P", "friend long, x long").agent("Q", "x long").edge("K", "w long").edge("M", "w long"), **options)
    rows = spark.range(1, n + 1).select(F.col("id").alias("k"), F.col("id").alias("x"), F.lit(None).cast("long").alias("friend"))
    sim.add_agents("P", rows, nr="k")
    return sim


def test_agentstate_follows_lookups(spark):
    sim = people(spark)
    ids = sorted(r.id for r in sim.agents("P").collect())
    sim.finish_init()
    number = {i: k + 1 for k, i in enumerate(ids)}
    nxt = F.create_map(*[F.lit(v) for k, i in enumerate(ids) for v in (i, ids[(k + 1) % len(ids)])])
    sim = sim.apply(lambda c: Step({"friend": nxt[F.col("id")]}), "P", read="P", write="P")

    def second(c):
        first = c.agentstate(c.state.friend, "P")
        return Step({"x": c.agentstate(first["friend"], "P")["x"]})

    got = {number[r.id]: r.x for r in sim.apply(second, "P", read="P", write="P").agents("P").collect()}
    assert got == {k: (k + 1) % 12 + 1 for k in range(1, 13)}
    bad = sim.apply(lambda c: Step({"friend": F.lit(77).cast("long")}), "P", read="P", write="P")
    with pytest.raises(Exception, match="no living agent"):
        bad.apply(lambda c: Step({"x": c.agentstate(c.state.friend, "P")["x"]}), "P", read="P", write="P").agents("P").collect()
    none = sim.apply(lambda c: Step({"friend": F.lit(None)}), "P", read="P", write="P").apply(lambda c: Step({"x": c.agentstate(c.state.friend, "P")["x"]}), "P", read="P", write="P")
    assert {r.x for r in none.agents("P").collect()} == {None}
    with pytest.raises(ModelError):
        sim.apply(lambda c: Step({"x": c.agentstate(c.state.friend, "Q")["x"]}), "P", read="P", write="P")


def test_hubs_and_matching_drops(spark):
    sim = people(spark)
    ids = sorted(r.id for r in sim.agents("P").collect())
    for k in (1, 2, 3):
        sim.add_edge("K", ids[k], ids[0], w=k)
        sim.add_edge("K", ids[k], ids[0], w=10 * k)
    for k in (4, 5):
        sim.add_edge("M", ids[k], ids[0], w=k)
    sim.finish_init()
    hubs = HubEdges("M", "K", "M", {"w": F.col("left.w") * F.col("right.w")})
    after = sim.apply(lambda c: Step(hubs=[hubs]), "P", read=["P", "K", "M"], write="M", add_existing="M")
    got = sorted((ids.index(r["from"]), ids.index(r["to"]), r.w) for r in after.edges("M").collect())
    assert got == sorted([(4, 0, 4), (5, 0, 5)] + [(a, b, f * a * b) for a in (1, 2, 3) for f in (1, 10) for b in (4, 5)])
    drop = DropEdges("K", to=F.col("id"), matching=F.col("w") == 20)
    left = sim.apply(lambda c: Step(drops=[drop]), "P", read=["P", "K"], write="K", add_existing="K")
    assert sorted(r.w for r in left.edges("K").collect()) == [1, 3, 10, 30]


@pytest.mark.parametrize("reach", [1, 7, 1000])
def test_range_totals(spark, reach):
    rng = random.Random(reach)
    rows = [(k, rng.choice([1, 2, None]), rng.choice([rng.randint(-60, 60), 5, None]), rng.randint(-9, 9)) for k in range(150)]
    got = {r.id: (r.n, r.s) for r in range_totals(spark.createDataFrame(rows, "id long, g int, o long, v long"), F.col("g"), F.col("o"), reach, F.col("v")).collect()}
    slow = {}
    for k, g, o, _ in rows:
        if g is not None and o is not None:
            near = [v for _, h, p, v in rows if h == g and p is not None and abs(p - o) < reach]
            slow[k] = (len(near), sum(near))
    assert got == slow


def test_weighted_cells(spark):
    sim = grid(spark, (10, 8)).finish_init()
    weight = F.when((F.col("i0") == 3) & (F.col("i1") == 5), 6.0).when((F.col("i0") == 10) & (F.col("i1") == 8), 2.0).otherwise(F.lit(0.0))
    rows = sim.random_cells("g", spark.range(4000), 7, sim.raster("g").select("i0", "i1", weight.alias("weight")))
    got = {(r.i0, r.i1): r["count"] for r in rows.groupBy("i0", "i1").count().collect()}
    assert set(got) == {(3, 5), (10, 8)} and sum(got.values()) == 4000 and 850 < got[10, 8] < 1150
    even = sim.random_cells("g", spark.range(4000), 7, sim.raster("g").select("i0", "i1", F.lit(1.0).alias("weight")))
    assert even.count() == 4000 and even.select("cell").distinct().count() == 80


def test_finish_removes_what_was_written(spark):
    sim = people(spark).finish_init()
    other = sim.copy()
    sim.apply_(lambda c: Step({"x": c.state.x + 1}), "P", read="P", write="P")
    assert sim.num_agents("P") == 12
    paths = list(sim.made)
    sim.finish()
    assert paths and other.num_agents("P") == 12
    other.finish()
    fs = spark.sparkContext._jvm.org.apache.hadoop.fs.FileSystem.get(spark.sparkContext._jsc.hadoopConfiguration())
    assert not any(fs.exists(spark.sparkContext._jvm.org.apache.hadoop.fs.Path(p)) for p in paths)


def test_steps_are_written_once(spark):
    sim = people(spark, lazy=True).finish_init()
    assert not sim.made
    after = sim.apply(lambda c: Step({"x": c.state.x + 1}), "P", read="P", write="P")
    assert not after.made and after.mapreduce(F.col("x"), "+", "P") == 90 and after.mapreduce(F.col("x"), "max", "P") == 13
    assert len(after.made) == 1
    noisy = after.apply(lambda c: Step({"x": F.floor(F.rand() * 1000)}), "P", read="P", write="P")
    assert len(after.made) == 2 and noisy.agents("P").collect() == noisy.agents("P").collect()


def test_stream_goes_on_after_a_restart(spark, tmp_path):
    source, store, checkpoint = tmp_path / "in", str(tmp_path / "store"), str(tmp_path / "checkpoint")
    model = Model("stream").agent("A", "n long")

    def begun():
        sim = Simulation(spark, model)
        sim.add_agent("A", n=0)
        return sim.finish_init()

    def on_batch(sim, rows):
        k = rows.count()
        return sim.apply(lambda c: Step({"n": c.state.n + k}), "A", read="A", write="A")

    for k in (3, 4):
        spark.range(k).write.mode("append").parquet(str(source))
        driver = StreamDriver(begun(), on_batch, store=store)
        driver.start(spark.readStream.schema("id long").parquet(str(source)), checkpoint).awaitTermination()
    assert driver.sim.agents("A").first().n == 7 and driver.last >= 1
    driver(spark.range(100), driver.last)  # a batch that comes again
    assert driver.sim.agents("A").first().n == 7


def test_plots_need_matplotlib(spark):
    sim = people(spark)
    sim.globals["g"] = [1, 2]
    try:
        import matplotlib  # noqa: F401
    except ImportError:
        with pytest.raises(RuntimeError):
            plot_globals(sim, ["g"])
    else:
        assert plot_globals(sim, ["g"]).axes


def test_shared_folder_is_needed_on_a_cluster():
    class Conf:
        def get(self, *_):
            return None

    class Session:
        conf = Conf()

        class sparkContext:  # noqa: N801
            master = "spark://host:7077"

            @staticmethod
            def getConf():
                return Conf()

    with pytest.raises(ValueError, match="checkpoint"):
        shared_folder(Session())


def test_hub_pairs_are_made_in_small_tasks(spark, tmp_path):
    """A task of the join at hubs reads a bounded part of the edges, however large Spark's own partitions are, and the partitions grow with them."""
    from synodic.functions.ids import make_id
    from synodic.plans import materialise

    model = Model("hubs").agent("A", "x long").edge("L", "v long").edge("R", "v long").edge("M", "v long")
    sim = Simulation(spark, model, lazy=True)
    sim.add_agents("A", spark.range(1, 101).select(F.col("id").alias("_key"), F.lit(0).cast("long").alias("x")), nr="_key")
    rows = spark.range(3000).select(make_id(1, F.col("id") % 90 + 1).alias("from"), make_id(1, F.col("id") % 100 + 1).alias("to"), F.xxhash64("id").alias("v"))
    rows.write.parquet(f"{tmp_path}/rows")
    for name in ("L", "R"):
        sim.add_edges(name, spark.read.parquet(f"{tmp_path}/rows"))
    sim.finish_init()
    step = lambda c: Step(hubs=[HubEdges("M", "L", "R", {"v": F.col("left.v") % 7 - F.col("right.v") % 5})])
    whole = sim.apply(step, "A", read=["L", "R"], write="M").edges("M").groupBy("from", "to").agg(F.sum("v").alias("v"))
    before, sizes = materialise.TASK_BYTES, []
    try:
        for limit in (8192, 1024):
            materialise.TASK_BYTES = limit
            made = sim.apply(step, "A", read=["L", "R"], write="M").edges("M").groupBy("from", "to").agg(F.sum("v").alias("v"))
            assert made._jdf.sparkSession().conf().get("spark.sql.adaptive.advisoryPartitionSizeInBytes") == str(limit)
            sizes.append(int(made._jdf.sparkSession().conf().get("spark.sql.shuffle.partitions")))
            assert sorted(map(tuple, made.collect())) == sorted(map(tuple, whole.collect()))
    finally:
        materialise.TASK_BYTES = before
    assert 4 < sizes[0] < sizes[1] and spark.conf.get("spark.sql.shuffle.partitions") == "4"
