"""Rasters: grids of cells that are agents, their neighbourhoods, and movers on them. Positions count from 1."""

from __future__ import annotations

from functools import lru_cache
from itertools import product

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.ids import make_id
from ..model import ModelError
from .transition import NewEdge


@lru_cache(maxsize=256)
def stencil(metric: str, n: int, distance: float) -> list[tuple[int, ...]]:
    """Offsets within the distance, without the origin."""
    d = int(distance)
    norm = {"chebyshev": lambda o: max(map(abs, o)), "euclidean": lambda o: sum(x * x for x in o) ** 0.5, "manhatten": lambda o: sum(map(abs, o))}
    norm["manhattan"] = norm["manhatten"]
    if metric not in norm:
        raise ModelError(f"no metric {metric}")
    return [o for o in product(range(-d, d + 1), repeat=n) if any(o) and norm[metric](o) <= distance]


def shifted(frame: DataFrame, axes: list[str], dims: tuple[int, ...], offsets: list[tuple[int, ...]], periodic: bool) -> DataFrame:
    """A row for each offset with the shifted position in s0, s1, ...; wrapped, or left out beyond the edges."""
    steps = F.array(*[F.struct(*[F.lit(x).alias(f"d{k}") for k, x in enumerate(o)]) for o in offsets])
    frame = frame.select("*", F.explode(steps).alias("_o"))
    for k, (axis, size) in enumerate(zip(axes, dims, strict=True)):
        at = F.col(axis) + F.col(f"_o.d{k}")
        frame = frame.withColumn(f"s{k}", (F.pmod(at - 1, F.lit(size)) + 1 if periodic else at).cast("int"))
        if not periodic:
            frame = frame.filter(F.col(f"s{k}").between(1, size))
    return frame.drop("_o")


class RasterMethods:
    """Part of Simulation."""

    def add_raster(self, name: str, dims: tuple[int, ...], kind: str, **fields: Column) -> DataFrame:
        """A cell of type ``kind`` at each position; fields are columns over i0, i1, ... Gives positions and ids, first axis fastest."""
        self.before_steps()
        cells = 1
        for d in dims:
            cells *= d
        frame = self.spark.range(cells)
        rest = F.col("id")
        for k, d in enumerate(dims):
            frame = frame.withColumn(f"i{k}", (F.pmod(rest, F.lit(d)) + 1).cast("int"))
            rest = F.floor(rest / d)
        start, t = self.next_number(kind), self.model.agents[kind]
        frame = frame.withColumn("id", make_id(t.number, F.col("id") + start))
        self.used[kind] = start - 1 + cells
        rows = frame.select("id", *[fields[f.name].cast(f.dataType).alias(f.name) for f in t.fields.fields])
        self.agent_tables[kind] = self.agent_tables[kind].unionByName(rows) if kind in self.agent_tables else rows
        grid = self.settle(frame.select(*[f"i{k}" for k in range(len(dims))], "id"))
        self.rasters[name] = (tuple(dims), kind, grid)
        return grid

    def raster(self, name: str) -> DataFrame:
        return self.rasters[name][2]

    def connect_raster_neighbors(self, name: str, edge: str, distance: float = 1, metric: str = "chebyshev", periodic: bool = True, **fields: Column):
        """An edge from each cell to each cell of its stencil; fields may use i0.. (the source) and s0.. (the target)."""
        dims, _, grid = self.rasters[name]
        axes = [f"i{k}" for k in range(len(dims))]
        moved = shifted(grid.withColumnRenamed("id", "from"), axes, dims, stencil(metric, len(dims), distance), periodic)
        # the number of a cell follows from its position, so that no join is needed
        first = F.lit(0).cast("long")
        for k in reversed(range(len(dims))):
            first = first * dims[k] + F.col(f"s{k}") - 1
        base = grid.agg(F.min("id")).first()[0]
        return self.add_edges(edge, moved.select("from", (first + F.lit(base)).alias("to"), *[c.alias(k) for k, c in fields.items()]))

    def move_to(self, name: str, frame: DataFrame, edge_to_agent: str | None = None, edge_to_cell: str | None = None, distance: float = 0, metric: str = "chebyshev", periodic: bool = True, only_surrounding: bool = False):
        """Before the first step: edges cell to agent and/or agent to cell for movers (id, i0, i1, ...) and the cells around them."""
        pairs = self.cells_around(name, frame, distance, metric, periodic, only_surrounding)
        if edge_to_agent:
            self.add_edges(edge_to_agent, pairs.select(F.col("cell").alias("from"), F.col("id").alias("to")))
        if edge_to_cell:
            self.add_edges(edge_to_cell, pairs.select(F.col("id").alias("from"), F.col("cell").alias("to")))
        return self

    def cells_around(self, name: str, frame: DataFrame, distance: float = 0, metric: str = "chebyshev", periodic: bool = True, only_surrounding: bool = False) -> DataFrame:
        """(id, cell) for movers (id, i0, i1, ...)."""
        dims, _, grid = self.rasters[name]
        axes = [f"i{k}" for k in range(len(dims))]
        offsets = [] if only_surrounding else [(0,) * len(dims)]
        offsets += stencil(metric, len(dims), distance) if distance >= 1 else []
        moved = shifted(frame.select("id", *axes), axes, dims, offsets, periodic) if offsets else frame.select("id", *[F.col(a).alias(f"s{k}") for k, a in enumerate(axes)]).limit(0)
        cells = grid.select(*[F.col(a).alias(f"s{k}") for k, a in enumerate(axes)], F.col("id").alias("cell"))
        return moved.select("id", *[f"s{k}" for k in range(len(dims))]).join(cells, [f"s{k}" for k in range(len(dims))]).select("id", "cell")

    def cell_column(self, name: str, *position: Column) -> Column:
        """Id of the cell at a position, as a column: for edges emitted within a step."""
        dims, kind, grid = self.rasters[name]
        base = self.external.setdefault(f"_first_{name}", grid.agg(F.min("id")).first()[0])
        at = F.lit(0).cast("long")
        for k in reversed(range(len(dims))):
            at = at * dims[k] + position[k].cast("long") - 1
        return at + F.lit(base)

    def moved_edges(self, name: str, position: list[Column], edge_to_agent: str | None = None, edge_to_cell: str | None = None, distance: float = 0, metric: str = "chebyshev", periodic: bool = True, only_surrounding: bool = False, when: Column | None = None) -> list[NewEdge]:
        """move_to within a step: new edges for the called agents at the positions given by columns."""
        dims, _, _ = self.rasters[name]
        offsets = [] if only_surrounding else [(0,) * len(dims)]
        offsets += stencil(metric, len(dims), distance) if distance >= 1 else []
        cells = []
        for o in offsets:
            at = [position[k] + F.lit(o[k]) for k in range(len(dims))]
            inside = F.lit(True)
            for k, d in enumerate(dims):
                at[k] = F.pmod(at[k] - 1, F.lit(d)) + 1 if periodic else at[k]
                inside = inside & at[k].between(1, d)
            cells.append(F.when(inside, self.cell_column(name, *at)))
        each = F.filter(F.array(*cells), lambda c: c.isNotNull())
        out = [NewEdge(edge_to_agent, to=F.col("id"), source=F.col("each"), each=each, when=when)] if edge_to_agent else []
        return out + ([NewEdge(edge_to_cell, to=F.col("each"), source=F.col("id"), each=each, when=when)] if edge_to_cell else [])

    def cellid(self, name: str, *position: int) -> int:
        found = self.raster(name)
        for k, p in enumerate(position):
            found = found.filter(F.col(f"i{k}") == p)
        return found.first()["id"]

    def calc_raster(self, name: str, values: DataFrame, value: Column, default=None) -> DataFrame:
        """Position and value for each cell: a frame with id, and a column over it; default where there is no row."""
        out = self.raster(name).join(values.select("id", value.alias("value")), "id", "left")
        return out if default is None else out.fillna({"value": default}) if isinstance(default, int | float | str | bool) else out

    def calc_rasterstate(self, name: str, value: Column) -> DataFrame:
        """Position and a column over the state of the cell."""
        return self.calc_raster(name, self.agents(self.rasters[name][1]), value)

    def rastervalues(self, name: str, field: str) -> DataFrame:
        return self.calc_rasterstate(name, F.col(field))

    def to_numpy(self, name: str, values: DataFrame):
        """An array of the value column; for grids that fit the driver."""
        import numpy as np

        dims = self.rasters[name][0]
        rows = values.select(*[f"i{k}" for k in range(len(dims))], "value").toPandas()
        out = np.empty(dims, dtype=rows["value"].dtype)
        out[tuple(rows[f"i{k}"].to_numpy() - 1 for k in range(len(dims)))] = rows["value"].to_numpy()
        return out

    def random_cells(self, name: str, frame: DataFrame, seed: int, weights: DataFrame | None = None, key: str = "id") -> DataFrame:
        """The frame with a random position (i0, ...) and cell: drawn from a hash of key and seed, so that it is the same in any order.

        weights: positions and a column ``weight``, all of them at least 0. Running sums are taken per
        first axis and then over the axis, so that no task holds the grid; draws and cells meet by bins.
        """
        dims, _, grid = self.rasters[name]
        axes = [f"i{k}" for k in range(len(dims))]
        draw = F.pmod(F.xxhash64(F.col(key), F.lit(seed)), F.lit(1 << 40)) / float(1 << 40)
        if weights is None:
            cells = 1
            for d in dims:
                cells *= d
            at = frame.withColumn("_c", F.floor(draw * cells))
            rest = F.col("_c")
            for k, d in enumerate(dims):
                at = at.withColumn(axes[k], (F.pmod(rest, F.lit(d)) + 1).cast("int"))
                rest = F.floor(rest / d)
            return at.drop("_c").join(grid.withColumnRenamed("id", "cell"), axes)
        from pyspark.sql import Window

        table = grid.join(weights.select(*axes, F.col("weight").cast("double").alias("weight")), axes).filter("weight > 0")
        slices = table.groupBy("i0").agg(F.sum("weight").alias("w"))
        slices = slices.withColumn("_high", F.sum("w").over(Window.orderBy("i0")))
        total = slices.agg(F.max("_high")).first()[0]
        within = Window.partitionBy("i0").orderBy(*axes[1:], "id")
        table = table.join(slices.select("i0", (F.col("_high") - F.col("w")).alias("_base")), "i0").withColumn("_to", F.col("_base") + F.sum("weight").over(within)).withColumn("_from", F.col("_to") - F.col("weight"))
        # as many bins as cells: a draw meets the few cells of its bin
        n = table.count()
        width = F.lit(total / max(n, 1))
        bins = F.explode(F.sequence(F.floor(F.col("_from") / width), F.floor(F.col("_to") / width))).alias("_bin")
        table = table.withColumnRenamed("id", "cell").select("*", bins)
        drawn = frame.withColumn("_d", draw * F.lit(total)).withColumn("_bin", F.floor(F.col("_d") / width))
        met = drawn.join(table, "_bin").filter((F.col("_d") >= F.col("_from")) & (F.col("_d") < F.col("_to")))
        return met.drop("_d", "_bin", "_from", "_to", "_base", "weight")
