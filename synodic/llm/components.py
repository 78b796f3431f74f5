"""Connected components by alternating large-star and small-star steps, each over written tables; few edges in one task."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import dropped, record, written

#: So many edges, 2 MB, one task unites.
FEW = 1 << 17


def united(edges: DataFrame) -> DataFrame:
    """(node, component) of a bounded number of edges, by union-find in one task."""

    def rows(batches):
        up: dict[int, int] = {}

        def root(x: int) -> int:
            while (y := up.setdefault(x, x)) != x:
                up[x] = x = up.setdefault(y, y)
            return x

        for batch in batches:
            for a, b in zip(batch.column("a").to_pylist(), batch.column("b").to_pylist(), strict=True):
                a, b = root(a), root(b)
                up[max(a, b)] = min(a, b)
        nodes = list(up)
        for k in range(0, len(nodes), 10_000):
            some = nodes[k : k + 10_000]
            yield record(node=np.array(some, np.int64), component=np.array([root(x) for x in some], np.int64))

    return edges.select("a", "b").repartition(1).mapInArrow(rows, "node long, component long")


def components(edges: DataFrame, few: int = FEW) -> DataFrame:
    """(node, component): for each node of ``edges`` (a, b) the smallest node it reaches.

    Nulls and loops are ignored. Up to ``few`` distinct edges are united in one task. Beyond that each round
    joins every edge with one row per node (the smallest neighbour), so that no neighbourhood is gathered;
    rounds end when a round changes no edge.
    """
    clean = edges.filter(F.col("a").isNotNull() & F.col("b").isNotNull() & (F.col("a") != F.col("b")))
    now = written(clean.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    if now.count() <= few:
        return united(now)
    mark = None
    while True:
        # large star: neighbours above a node go to the smallest of it and its neighbours
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(least, "a").filter(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a != b").distinct()
        # small star: neighbours below a node, and the node, go to the smallest of them
        lows = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(lows, "a").select(F.explode(F.array(F.struct("b", "m"), F.struct(F.col("a").alias("b"), "m"))).alias("e"))
        small = small.select(F.greatest("e.b", "e.m").alias("a"), F.least("e.b", "e.m").alias("b")).filter("a != b").distinct()
        before, now = now, written(small)
        dropped(edges.sparkSession, before)
        seen = now.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("h")).first()
        if mark == tuple(seen):
            break
        mark = tuple(seen)
    roots = now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    return now.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(roots)
