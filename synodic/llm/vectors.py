"""Embedding near-dedup by sorted projection passes.

Each pass orders the vectors lexicographically by the concatenated signs of random projections and
compares each with the next ``window`` ones, over the edges of tasks too, so that the result does not
depend on how the rows are dealt; the pairs verified at the threshold are united across passes into
components. Equal vectors are one class with a count.

Passes go in rounds, as many at least as a pair just at the threshold among scattered vectors needs for
``recall``, and until a whole round joins nothing more among all vectors. Where a round after these joins
more than half of what the one before did, as in a crowd of vectors that are all alike, the window doubles;
it ends as wide as the table at the worst. The recall on the links of a sample of vectors with all others,
found by brute force (a link is found when its ends are joined), can only add rounds and widen the window.

The links of a vector are counted within its component, where all its links are that the passes have
found a way to: a component of up to ``block`` vectors in one task, a larger one by pairs of blocks about
pivots. Blocks whose caps lie within the threshold of each other as a whole are counted without a
comparison, those whose caps lie apart not at all, so that a crowd of near copies costs its members.

Vectors that are null, zero, or hold null or non-finite components link with nothing, as do vectors
of other lengths with each other. Cosines are in double precision. Ids are cast to long; rows without an
id link with nothing, have no component and are not kept; rows of one id are vectors of their own that
share it: each counts its own links, their component is the smallest id that any of them reaches.
"""

from __future__ import annotations

import hashlib
import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Shared, dropped, record, released, written
from .components import components


@dataclass(frozen=True)
class VectorConfig:
    """``sample`` vectors measure the recall."""

    threshold: float = 0.9
    bits: int = 48
    window: int = 32
    each_round: int = 8
    recall: float = 0.99
    sample: int = 1024
    block: int = 4096
    stripe: int = 512
    seed: int = 20


def wire(frame: DataFrame, embedding: str) -> str:
    """Single-precision components travel as such."""
    kind = frame.schema[embedding].dataType
    return "<f4" if isinstance(kind, T.ArrayType) and isinstance(kind.elementType, T.FloatType) else "<f8"


def units(raw: list, kind: str) -> np.ndarray:
    """Unit vectors, as doubles, of vectors of one length."""
    x = np.stack([np.frombuffer(r, kind) for r in raw]).astype(np.float64)
    x /= np.abs(x).max(1, keepdims=True)
    return x / np.sqrt(np.einsum("ij,ij->i", x, x))[:, None]


def by_length(raw: list, kind: str):
    """(places, unit vectors) of each length."""
    sizes = np.array([len(r) for r in raw])
    for size in np.unique(sizes):
        at = np.flatnonzero(sizes == size)
        yield at, units([raw[k] for k in at], kind)


def keyed_vectors(frame: DataFrame, vec_id: str, embedding: str) -> DataFrame:
    """(vec_id, key, v): key names equal vectors, v holds the components; both null if it links with nothing."""
    kind = wire(frame, embedding)

    def rows(batches):
        for batch in batches:
            keys, vs = [], []
            for x in batch.column(1):
                key = v = None
                if x.is_valid and x.values.null_count == 0 and len(x.values):
                    raw = x.values.to_numpy(zero_copy_only=False).astype(kind) + 0.0
                    if np.isfinite(raw).all() and raw.any():
                        v = raw.astype(kind).tobytes()
                        key = hashlib.md5(v).hexdigest()
                keys.append(key)
                vs.append(v)
            yield record(vec_id=batch.column(0), key=pa.array(keys, pa.string()), v=pa.array(vs, pa.binary()))
        released()

    return frame.select(F.col(vec_id).cast("long"), embedding).mapInArrow(rows, "vec_id long, key string, v binary")


def projections(config: VectorConfig, p: int, size: int) -> np.ndarray:
    return np.random.default_rng([config.seed, p, size]).normal(size=(size, config.bits))


def signed(classes: DataFrame, passes: range, config: VectorConfig, kind: str) -> DataFrame:
    """A row for each class and pass: pass, size of the vector, concatenated signs, class, vector."""

    def rows(batches):
        held: dict[int, list[np.ndarray]] = {}
        weights = 1 << np.arange(config.bits - 1, -1, -1, dtype=np.int64)
        for batch in batches:
            ids, raw = batch.column("id").to_numpy(), [x.as_buffer() for x in batch.column("v")]
            for at, x in by_length(raw, kind):
                size = x.shape[1]
                if size not in held:
                    held[size] = [projections(config, p, size) for p in passes]
                for p, normals in zip(passes, held[size], strict=True):
                    signs = ((x @ normals) > 0) @ weights
                    yield record(p=np.full(len(at), p, np.int32), size=np.full(len(at), size, np.int32), signs=signs.astype(np.int64), id=ids[at], v=batch.column("v").take(pa.array(at)))
        released()

    return classes.select("id", "v").mapInArrow(rows, "p int, size int, signs long, id long, v binary")


ORDER = ("p", "size", "signs", "id")
EDGE = "a long, b long, p int, size int, signs long, id long, task int, skipped long, v binary"


def close_pairs(place: np.ndarray, ids: np.ndarray, x: np.ndarray, window: int, threshold: float, ok) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (smaller, larger id) at the threshold of rows in order whose places differ by ``window`` at most, where ``ok(i, j)``."""
    a, b = [], []
    for gap in range(1, min(window, len(ids) - 1) + 1):
        i = np.flatnonzero((place[gap:] - place[:-gap] <= window) & ok(np.arange(len(ids) - gap), np.arange(gap, len(ids))))
        if len(i):
            i = i[np.einsum("ij,ij->i", x[i], x[i + gap]) >= threshold]
            a.append(ids[i])
            b.append(ids[i + gap])
    if not a:
        return ids[:0], ids[:0]
    a, b = np.concatenate(a), np.concatenate(b)
    once = np.unique(np.stack((np.minimum(a, b), np.maximum(a, b))), axis=1)
    return once[0], once[1]


def neighbours(ordered: DataFrame, window: int, config: VectorConfig, kind: str) -> DataFrame:
    """Pairs (a, b) within each task, and (a null) the first and last ``window`` rows of its stretches, with the rows left out before each."""

    def found(ids, x, new):
        a, b = close_pairs(np.arange(len(ids)), ids, x, window, config.threshold, lambda i, j: j >= new)
        n = len(a)
        empty = pa.nulls(n)
        return record(a=a, b=b, p=empty.cast(pa.int32()), size=empty.cast(pa.int32()), signs=empty.cast(pa.int64()), id=empty.cast(pa.int64()), task=empty.cast(pa.int32()), skipped=empty.cast(pa.int64()), v=empty.cast(pa.binary())) if n else None

    def rows(batches):
        task, group, edge, seen = TaskContext.get().partitionId(), None, [], 0
        tail_ids, tail_x, tail_rows = None, None, []

        def edges(close: bool):
            """Rows that wait, as a batch; at the end of a stretch its last rows."""
            out = edge + [(*group, *r, 0 if k or seen - len(tail_rows) <= window else seen - len(tail_rows) - window) for k, r in enumerate(tail_rows) if seen - len(tail_rows) + k >= window] if close else edge
            if not out:
                return None
            p, size, signs, ids, v, skipped = zip(*out, strict=True)
            empty = pa.nulls(len(out), pa.int64())
            return record(a=empty, b=empty, p=np.array(p, np.int32), size=np.array(size, np.int32), signs=np.array(signs, np.int64), id=np.array(ids, np.int64), task=np.full(len(out), task, np.int32), skipped=np.array(skipped, np.int64), v=pa.array(v, pa.binary()))

        for batch in batches:
            p, size, signs, ids = (batch.column(c).to_numpy() for c in ORDER)
            raw = [x.as_py() for x in batch.column("v")]
            for part in np.split(np.arange(len(p)), np.flatnonzero((np.diff(p) != 0) | (np.diff(size) != 0)) + 1):
                if not len(part):
                    continue
                if group != (int(p[part[0]]), int(size[part[0]])):
                    if group is not None and (told := edges(True)) is not None:
                        yield told
                    group, edge, seen, tail_ids, tail_x, tail_rows = (int(p[part[0]]), int(size[part[0]])), [], 0, None, None, []
                x, own = units([raw[k] for k in part], kind), ids[part]
                edge += [(*group, int(signs[k]), int(ids[k]), raw[k], 0) for k in part[: max(0, window - seen)]]
                new = 0
                if tail_ids is not None:
                    new = len(tail_ids)
                    x, own = np.concatenate((tail_x, x)), np.concatenate((tail_ids, own))
                if (pairs := found(own, x, new)) is not None:
                    yield pairs
                seen += len(part)
                tail_ids, tail_x = own[-window:], x[-window:]
                tail_rows = (tail_rows + [(int(signs[k]), int(ids[k]), raw[k]) for k in part[-window:]])[-window:]
        if group is not None and (told := edges(True)) is not None:
            yield told
        released()

    return ordered.mapInArrow(rows, EDGE)


def over_edges(edge: DataFrame, window: int, config: VectorConfig, kind: str) -> DataFrame:
    """Pairs (a, b) of rows of different tasks; rows of a pass are as many as tasks have edges."""

    def rows(batches):
        group, held = None, None
        for batch in batches:
            p, size, ids, task, skipped = (batch.column(c).to_numpy() for c in ("p", "size", "id", "task", "skipped"))
            raw = [x.as_py() for x in batch.column("v")]
            for part in np.split(np.arange(len(p)), np.flatnonzero((np.diff(p) != 0) | (np.diff(size) != 0)) + 1):
                if not len(part):
                    continue
                own = (np.cumsum(1 + skipped[part]), ids[part], task[part], units([raw[k] for k in part], kind))
                new = 0
                if group == (p[part[0]], size[part[0]]):
                    own = (own[0] + held[0][-1], *own[1:])
                    new = len(held[1])
                    own = tuple(np.concatenate(c) for c in zip(held, own, strict=True))
                group = (p[part[0]], size[part[0]])
                place, own_ids, own_task, x = own
                a, b = close_pairs(place, own_ids, x, window, config.threshold, lambda i, j: (own_task[i] != own_task[j]) & (j >= new))  # noqa: B023
                if len(a):
                    yield record(a=a, b=b)
                held = tuple(c[-window:] for c in own)
        released()

    return edge.repartition("p", "size").sortWithinPartitions(*ORDER).mapInArrow(rows, "a long, b long")


def one_round(classes: DataFrame, passes: range, window: int, config: VectorConfig, kind: str) -> DataFrame:
    """The distinct pairs (a, b) that these passes find."""
    ordered = signed(classes, passes, config, kind).repartitionByRange(*ORDER).sortWithinPartitions(*ORDER)
    met = written(neighbours(ordered, window, config, kind))
    both = met.filter("a is not null").select("a", "b").unionByName(over_edges(met.filter("a is null"), window, config, kind))
    out = written(both.distinct())
    dropped(classes.sparkSession, met)
    return out


def sample_links(classes: DataFrame, config: VectorConfig, kind: str) -> DataFrame:
    """All links (a, b) of ``sample`` classes, taken by hash, with any class: by brute force, against which recall is measured."""
    some = classes.orderBy(F.xxhash64("id"), "id").limit(config.sample).select("id", "v").collect()
    ids, raw = [r["id"] for r in some], [bytes(r["v"]) for r in some]
    shared = Shared(classes.sparkSession, {x.shape[1]: (np.array([ids[k] for k in at]), x) for at, x in by_length(raw, kind)} if some else {})

    def rows(batches):
        for batch in batches:
            own = batch.column("id").to_numpy()
            for at, x in by_length([v.as_buffer() for v in batch.column("v")], kind):
                if x.shape[1] not in shared.value:
                    continue
                others, y = shared.value[x.shape[1]]
                i, j = np.nonzero(x @ y.T >= config.threshold)
                a, b = own[at[i]], others[j]
                keep = a != b
                if keep.any():
                    yield record(a=np.minimum(a, b)[keep], b=np.maximum(a, b)[keep])

    return written(classes.select("id", "v").mapInArrow(rows, "a long, b long").distinct())


def least_passes(n: int, config: VectorConfig) -> int:
    """Passes after which a pair at the threshold among n scattered vectors has been within a window with probability ``recall``."""
    same = 1 - math.acos(config.threshold) / math.pi
    once = same ** max(0.0, math.log2(max(n, 1) / config.window))
    return max(1, math.ceil(math.log(1 - config.recall) / math.log1p(-min(once, 0.999))))


def passed(classes: DataFrame, config: VectorConfig, kind: str) -> DataFrame:
    """(node, component) of the pairs of all rounds. A link of the sample is found when its ends are in one component, as links are counted there."""
    spark, n = classes.sparkSession, classes.count()
    truth = sample_links(classes, config, kind)
    links, done, window, pairs = truth.count(), 0, config.window, None
    joined, before = 0, n
    least = least_passes(n, config)
    while True:
        found = one_round(classes, range(done, done + config.each_round), window, config, kind)
        done += config.each_round
        if pairs is not None:
            both = written(pairs.unionByName(found).distinct())
            dropped(spark, pairs, found)
            found = both
        pairs = found
        labels = written(components(pairs))
        ends = truth.join(labels.select(F.col("node").alias("a"), F.col("component").alias("x")), "a").join(labels.select(F.col("node").alias("b"), F.col("component").alias("y")), "b")
        right = ends.filter("x = y").count() >= config.recall * links
        # how often any two components became one: over all vectors, not the sample
        now = labels.count() - labels.select("component").distinct().count()
        gain, joined = now - joined, now
        if window >= n or right and done >= least and not gain:
            break
        dropped(spark, labels)
        if done >= least and (not right or 2 * gain > before):
            window *= 2
        before = gain
    dropped(spark, truth, pairs)
    return labels


def compared(ids: np.ndarray, count: np.ndarray, left: np.ndarray, right: np.ndarray, n_left: int, config: VectorConfig) -> tuple:
    """(id, n) of the classes that link with another: rows of other classes linked to it.

    ``right`` is empty where a block meets itself; ids are those of the left rows, then the right ones.
    """
    own = not len(right)
    n = np.zeros(len(ids), np.int64)
    first = 0 if own else n_left
    other = left if own else right
    for start in range(0, len(left), config.stripe):
        linked = left[start : start + config.stripe] @ other.T >= config.threshold
        at = np.arange(start, start + len(linked))
        if own:
            linked[np.arange(len(linked)), at] = False
        n[at] += linked @ count[first : first + len(other)]
        if not own:
            n[first:] += linked.T @ count[at]
    some = np.flatnonzero(n)
    return ids[some], n[some]


def tiled(tiles: DataFrame, config: VectorConfig, kind: str) -> DataFrame:
    """(id, n) of each tile: the rows (component, i, j, side, id, count, v) of two blocks, or of one with itself."""

    def one(rows: list[tuple]) -> tuple:
        ids, count, side = (np.array(c, dtype=np.int64) for c in list(zip(*rows, strict=True))[:3])
        x = units([r[3] for r in rows], kind)
        cut = int((side == 0).sum())
        return compared(ids, count, x[:cut], x[cut:], cut, config)

    def rows(batches):
        held, key = [], None
        for batch in batches:
            for c, i, j, *row in zip(*(batch.column(k).to_pylist() for k in ("component", "i", "j", "id", "count", "side", "v")), strict=True):
                if (c, i, j) != key:
                    if len(held) > 1 and len((out := one(held))[0]):
                        yield record(id=out[0], n=out[1])
                    held, key = [], (c, i, j)
                held.append(row)
        if len(held) > 1 and len((out := one(held))[0]):
            yield record(id=out[0], n=out[1])
        released()

    columns = ["component", "i", "j"]
    return tiles.repartition(*columns).sortWithinPartitions(*columns, "side").mapInArrow(rows, "id long, n long")


def celled(large: DataFrame, sizes: dict[int, int], config: VectorConfig, kind: str) -> DataFrame:
    """Classes of large components with the nearest pivot of the component, by number, and the angle to it."""
    spark = large.sparkSession
    wanted = spark.createDataFrame([(c, max(2, min(64, -(-m // config.block)))) for c, m in sizes.items()], "component long, k int")
    from pyspark.sql import Window

    first = Window.partitionBy("component").orderBy("h", "id")
    # a share by hash, a few times what is wanted, so that no component is sorted whole
    share = large.join(F.broadcast(spark.createDataFrame([(c, m) for c, m in sizes.items()], "component long, m long")), "component").withColumn("h", F.xxhash64("id"))
    some = share.join(F.broadcast(wanted), "component").filter(F.pmod("h", F.lit(1 << 30)) < F.least(F.lit(1.0), (4 * F.col("k") + 16) / F.col("m")) * (1 << 30))
    rows = some.withColumn("r", F.row_number().over(first)).filter("r <= k").select("component", "v").collect()
    pivots: dict[int, list] = {}
    for r in rows:
        pivots.setdefault(r["component"], []).append(bytes(r["v"]))
    shared = Shared(spark, {c: units(raw, kind) for c, raw in pivots.items()})

    def judge(batches):
        for batch in batches:
            own = batch.column("component").to_numpy()
            raw = [v.as_buffer() for v in batch.column("v")]
            cell, angle = np.zeros(len(raw), np.int32), np.full(len(raw), np.pi)
            for c in np.unique(own).tolist():
                at = np.flatnonzero(own == c)
                if c in shared.value:
                    close = units([raw[k] for k in at], kind) @ shared.value[c].T
                    cell[at], angle[at] = close.argmax(1), np.arccos(np.clip(close.max(1), -1, 1))
            yield record(component=own, id=batch.column("id"), count=batch.column("count"), v=batch.column("v"), cell=cell, angle=angle)
        released()

    return written(large.select("component", "id", "count", "v").mapInArrow(judge, "component long, id long, count long, v binary, cell int, angle double")), shared.value


def large_links(large: DataFrame, sizes: dict[int, int], config: VectorConfig, kind: str) -> list[DataFrame]:
    """(id, n) within components of more than ``block`` classes, by pairs of blocks."""
    spark = large.sparkSession
    cells, pivots = celled(large, sizes, config, kind)
    # near vectors lie in rings about their pivot: a block is a part of a ring
    ring = F.floor(F.col("angle") / 0.1).cast("int")
    cells = cells.withColumn("ring", ring)
    kinds = cells.groupBy("component", "cell", "ring").agg(F.count("*").alias("m"), F.sum("count").alias("rows"), F.max("angle").alias("radius")).collect()
    reach, slack = math.acos(config.threshold), 1e-6
    blocks, whole, open_ = [], [], []
    by: dict[int, list] = {}
    for r in kinds:
        parts = -(-r["m"] // config.block)
        by.setdefault(r["component"], []).append((len(blocks), r["cell"], r["ring"], r["radius"], r["rows"], parts))
        blocks.append((r["component"], r["cell"], r["ring"], len(blocks), parts))
    for c, own in by.items():
        centres = pivots.get(c)
        for x in own:
            for y in own:
                apart = 0.0 if x[1] == y[1] else float(np.arccos(np.clip(centres[x[1]] @ centres[y[1]], -1, 1))) if centres is not None else math.pi
                low = max(0.0, apart - x[3] - y[3], (x[2] - y[2] - 1) * 0.1 if apart == 0 else 0.0, (y[2] - x[2] - 1) * 0.1 if apart == 0 else 0.0)
                if apart + x[3] + y[3] < reach - slack:
                    whole.append((c, x[1], x[2], y[4]))
                elif low <= reach + slack and x[0] <= y[0]:
                    open_.append((x[0], y[0], x[5], y[5]))
    table = F.broadcast(spark.createDataFrame(blocks, "component long, cell int, ring int, block int, parts int"))
    dealt = cells.join(table, ["component", "cell", "ring"]).withColumn("part", F.pmod(F.xxhash64("id"), F.col("parts")).cast("int"))
    out = []
    if whole:
        sums = spark.createDataFrame(whole, "component long, cell int, ring int, rows long").groupBy("component", "cell", "ring").agg(F.sum("rows").alias("rows"), F.max(F.lit(1)).alias("one"))
        own = {(c, x, r) for c, x, r, _ in whole}
        # a block that is all linked with itself counts the row's own class too
        selfs = spark.createDataFrame([(b[0], b[1], b[2], 2 * next(z[3] for z in by[b[0]] if z[0] == b[3]) < reach - slack) for b in blocks if (b[0], b[1], b[2]) in own], "component long, cell int, ring int, alone boolean")
        counted = cells.join(F.broadcast(sums), ["component", "cell", "ring"]).join(F.broadcast(selfs), ["component", "cell", "ring"])
        out.append(counted.select("id", (F.col("rows") - F.when(F.col("alone"), F.col("count")).otherwise(0)).alias("n")))
    if open_:
        pairs = [(x, i, y, j) for x, y, px, py in open_ for i in range(px) for j in range(py) if x != y or i <= j]
        sides = [(x, i, x * 4096 + i, y * 4096 + j, 0) for x, i, y, j in pairs] + [(y, j, x * 4096 + i, y * 4096 + j, 1) for x, i, y, j in pairs if (x, i) != (y, j)]
        asked = spark.createDataFrame(sides, "block int, part int, i long, j long, side int")
        out.append(tiled(dealt.join(asked, ["block", "part"]).select("component", "i", "j", "id", "count", "side", "v"), config, kind))
    return out


def counted_links(classes: DataFrame, found: DataFrame, config: VectorConfig, kind: str) -> DataFrame:
    """(id, n): rows of other classes linked with a class, all of its component compared."""
    own = written(classes.join(found.withColumnRenamed("node", "id"), "id").select("component", "id", "count", "v"))
    # one row for each large component: a table of n classes has n / block at most
    sizes = {r["component"]: r["m"] for r in own.groupBy("component").agg(F.count("*").alias("m")).filter(F.col("m") > config.block).collect()}
    zero = F.lit(0).cast("long")
    if not sizes:
        return written(tiled(own.select("component", zero.alias("i"), zero.alias("j"), "id", "count", F.lit(0).alias("side"), "v"), config, kind))
    names = F.broadcast(classes.sparkSession.createDataFrame([(c,) for c in sizes], "component long"))
    small = own.join(names, "component", "left_anti")
    out = tiled(small.select("component", zero.alias("i"), zero.alias("j"), "id", "count", F.lit(0).alias("side"), "v"), config, kind)
    for more in large_links(own.join(names, "component", "left_semi"), sizes, config, kind):
        out = out.unionByName(more)
    return written(out)


def near_vectors(frame: DataFrame, config: VectorConfig = VectorConfig(), vec_id="vec_id", embedding="embedding") -> DataFrame:
    """vec_id, n_links, component_id, kept for every row."""
    kind = wire(frame, embedding)
    keyed = keyed_vectors(frame, vec_id, embedding)
    named = written(keyed.select("vec_id", "key", F.when(F.col("key").isNotNull() & F.col("vec_id").isNotNull(), F.col("v")).alias("v")))
    good = named.filter("v is not null")
    # a class has a number of its own, as rows of one id may hold different vectors
    classes = written(good.groupBy("key").agg(F.min("vec_id").alias("least"), F.count("*").alias("count"), F.min("v").alias("v")).withColumn("id", F.xxhash64("key")))
    found = passed(classes, config, kind)
    links = counted_links(classes, found, config, kind).groupBy("id").agg(F.sum("n").alias("n"))
    per_class = written(classes.select("key", "id", "least", "count").join(links, "id", "left").join(found.withColumnRenamed("node", "id"), "id", "left").withColumn("component", F.coalesce("component", "id")))
    # the smallest id of a component; one id with several vectors joins their components
    roots = per_class.groupBy("component").agg(F.min("least").alias("root"))
    per_key = per_class.join(roots, "component").select("key", (F.col("count") - 1 + F.coalesce("n", F.lit(0))).alias("n_links"), "root")
    rows = named.select("vec_id", F.when(F.col("v").isNotNull(), F.col("key")).alias("key")).join(per_key, "key", "left")
    component = F.when(F.col("vec_id").isNotNull(), F.coalesce("root", "vec_id"))
    return rows.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(component == F.col("vec_id"), F.lit(False)).alias("kept"))
