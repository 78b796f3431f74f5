"""N-gram Jaccard join by T-occurrence search.

Two documents link when the Jaccard similarity of their sets of five-word shingles is 0.8 or more
(judged in whole numbers: 100 * intersection >= 80 * union). A set of n shingles can only link with
one that shares T = ceil(0.8 n) of them, so that one of the n - T + 1 rarest is shared too.

The index of inverted lists lies in shards of documents. The rarest shingles route a set (the probe) to
the shards that hold a document which could link: first by lists of the rarest shingles, then by
histograms of hashes that bound the intersection. Each shard answers its probes as DivideSkip does: the
lists of the probe's shingles are divided, the short ones are merged by a heap that counts occurrences
and skips documents that cannot reach the count, the long ones are probed by binary search for what the
merge retains, and documents that reach the overlap both sizes ask for are linked. A shard tells only
links between documents that it has not joined yet, so that a crowd costs as many rows as members.

The order of the shingles is by document counts over all documents, gathered task by task, then by hash;
any order gives the same links. Sets that are equal are one class and are linked without a search. In
lists of more than ``small`` members, members first probe one centre; what the links found so far do not
join then probes the other members: by pairs, or in lists of more than ``crowd`` such members by whole
shards of documents of about their size, by histograms first and with their sets where these allow a
link, so that the rows grow with the members and shards and not with the pairs.

Null and empty texts have an empty set and link with nothing; texts may be of any length. Rows with a
null id link with nothing; repeated ids are one document with the texts of each row; ids are cast to
long. Ties go to the smallest id. Other columns are ignored. Shingles are 64-bit hashes of 64-bit word
hashes.
"""

from __future__ import annotations

import heapq
from bisect import bisect_left
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Shared, byte_slices, dropped, over_texts, record, released, splitmix, words_of, written
from .components import components

SIZE = 5


@dataclass(frozen=True)
class JaccardConfig:
    """``percent`` is the similarity; ``hottest`` bounds the shingles that are ordered by count, the others are ordered by hash.

    ``shard`` is the number of documents whose lists a shard holds, about, and ``load`` that of shingles where the longest gather; ``mu`` weighs merging against probing when lists are divided.
    """

    percent: int = 80
    small: int = 4
    hottest: int = 400_000
    hot: int = 64
    crowd: int = 64
    shard: int = 1000
    load: int = 2_000_000
    mu: float = 0.0085


def shingle_sets(texts: list[str]) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text."""
    words, counts = words_of(texts)
    ends = np.cumsum(counts)
    out = []
    if len(words) >= SIZE:
        h = np.full(len(words) - SIZE + 1, SIZE, dtype=np.uint64)
        for k in range(SIZE):
            h = splitmix(h ^ words[k : len(words) - SIZE + 1 + k]) + np.uint64(k + 1)
    for end, n in zip(ends, counts, strict=True):
        if n >= SIZE:
            out.append(np.unique(h[end - n : end - SIZE + 1]))
        elif n:
            s = np.uint64(n)
            for w in words[end - n : end]:
                s = splitmix(np.array([s ^ w], dtype=np.uint64))[0] + np.uint64(7)
            out.append(np.array([s], dtype=np.uint64))
        else:
            out.append(np.empty(0, dtype=np.uint64))
    return out


def signature(s: np.ndarray) -> bytes:
    """16 bytes that equal sets share."""
    return splitmix(s).sum(dtype=np.uint64).tobytes() + np.bitwise_xor.reduce(splitmix(s ^ np.uint64(0xA5A5A5A5A5A5A5A5)), initial=np.uint64(len(s))).tobytes()


def sizes_and_counts(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """Rows (doc, n, sig) of all documents, and rows (shingle, n) of shingles that a task met more than once."""

    def run(batches):
        held: list[np.ndarray] = []

        def counted():
            keys, n = np.unique(np.concatenate(held), return_counts=True)
            held.clear()
            more = n > 1
            keys, n = keys[more], n[more]
            empty = pa.nulls(len(keys))
            return record(doc=empty.cast(pa.int64()), n=n.astype(np.int64), sig=empty.cast(pa.binary()), shingle=keys.view(np.int64))

        room = 0
        for batch in batches:
            for part in byte_slices(batch, text, 1 << 18):
                sets = shingle_sets(["" if t is None else t for t in part.column(text).to_pylist()])
                held += sets
                room += sum(map(len, sets))
                yield record(doc=part.column(doc_id), n=np.array([len(s) for s in sets], dtype=np.int64), sig=pa.array([signature(s) if len(s) else None for s in sets], pa.binary()), shingle=pa.nulls(len(sets), pa.int64()))
                if room > 1_000_000:
                    yield counted()
                    room = 0
        if held:
            yield counted()

    return docs.mapInArrow(run, "doc long, n long, sig binary, shingle long")


class Order:
    """The common order of shingles: those with a count after those without, by count, then by hash."""

    def __init__(self, keys: np.ndarray, counts: np.ndarray):
        by = np.argsort(keys)
        self.keys, self.counts = keys[by], counts[by]

    def count(self, s: np.ndarray) -> np.ndarray:
        if not len(self.keys):
            return np.zeros(len(s), dtype=np.int64)
        at = np.minimum(np.searchsorted(self.keys, s), len(self.keys) - 1)
        return np.where(self.keys[at] == s, self.counts[at], 0)


def short_lists(docs: DataFrame, order: Order, config: JaccardConfig, doc_id: str, text: str) -> DataFrame:
    """Rows (shingle, doc, n, pos, typical, hot) of the short lists; copies that one task met before are left out."""
    shared, percent, hot = Shared(docs.sparkSession, order), config.percent, config.hot
    known: set[bytes] = set()

    def rows(part, texts):
        out = []
        for doc, s in zip(part.column(doc_id).to_pylist(), shingle_sets(texts), strict=True):
            if not len(s) or doc is None:
                continue
            sig = signature(s)
            if sig in known:
                continue
            if len(known) > 500_000:
                known.clear()
            known.add(sig)
            count = shared.value.count(s)
            first = len(s) - -(-percent * len(s) // 100) + 1
            by = np.lexsort((s, count))[:first]
            out.append((s[by], np.full(first, doc), np.full(first, len(s)), np.arange(first), np.full(first, int(count.mean() * 16)), count[by] >= hot))
        if not out:
            return None
        shingle, doc, n, pos, typical, is_hot = map(np.concatenate, zip(*out, strict=True))
        return record(shingle=shingle.view(np.int64), doc=doc.astype(np.int64), n=n.astype(np.int32), pos=pos.astype(np.int32), typical=typical.astype(np.int64), hot=is_hot)

    return over_texts(docs, text, rows, "shingle long, doc long, n int, pos int, typical long, hot boolean", 1 << 18)


def could_link(na, nb, pa_, pb, percent):
    """Size and position filter: the overlap that both sets still allow against what the threshold asks for."""
    # an intersection i that links has 100 i >= percent * (na + nb - i)
    na, nb = na.astype(np.int64), nb.astype(np.int64)
    need = -(-percent * (na + nb) // (100 + percent))
    left = np.minimum(na - pa_, nb - pb)
    return (100 * np.minimum(na, nb) >= percent * np.maximum(na, nb)) & (left >= need)


def merged_lists(lists: DataFrame, config: JaccardConfig) -> DataFrame:
    """Rows (a, b, shingle, n, pos): probes a and documents b of lists up to ``small`` members; of longer
    lists the members as probes of the centre, and (b null) the members. Lists must stand together, sorted by shingle."""
    small, percent = config.small, config.percent

    def flush(t: dict[str, np.ndarray]):
        edge = np.flatnonzero(np.diff(t["shingle"])) + 1
        starts, ends = np.concatenate(([0], edge)), np.concatenate((edge, [len(t["shingle"])]))
        size = ends - starts
        pairs_a, pairs_b, long_rows = [], [], []
        for gap in range(1, small):
            for s0 in range(small - gap):
                ok = (size <= small) & (size > s0 + gap)
                pairs_a.append(starts[ok] + s0)
                pairs_b.append(starts[ok] + s0 + gap)
        for s, e in zip(starts[size > small], ends[size > small], strict=True):
            own = np.arange(s, e)
            centre = own[np.lexsort((t["doc"][own], -t["typical"][own]))[0]]
            pairs_a.append(own[own != centre])
            pairs_b.append(np.full(len(own) - 1, centre))
            long_rows.append(own)
        i, j = np.concatenate([*pairs_a, np.zeros(0, int)]).astype(int), np.concatenate([*pairs_b, np.zeros(0, int)]).astype(int)
        ok = could_link(t["n"][i], t["n"][j], t["pos"][i], t["pos"][j], percent) & (t["doc"][i] != t["doc"][j])
        a, b = t["doc"][i[ok]], t["doc"][j[ok]]
        if len(a):
            once = np.unique(np.stack((a, b)), axis=1)
            k = once.shape[1]
            yield record(a=once[0], b=once[1], shingle=pa.nulls(k, pa.int64()), n=pa.nulls(k, pa.int32()), pos=pa.nulls(k, pa.int32()))
        if long_rows:
            own = np.concatenate(long_rows)
            yield record(a=t["doc"][own], b=pa.nulls(len(own), pa.int64()), shingle=t["shingle"][own], n=t["n"][own].astype(np.int32), pos=t["pos"][own].astype(np.int32))

    def run(batches):
        held: list[dict] = []
        rows = 0
        for batch in batches:
            t = {c: batch.column(c).to_numpy(zero_copy_only=False) for c in ("shingle", "doc", "n", "pos", "typical")}
            held.append(t)
            rows += len(t["shingle"])
            if rows >= 200_000 and t["shingle"][0] != t["shingle"][-1]:
                whole = {c: np.concatenate([h[c] for h in held]) for c in t}
                cut = int(np.searchsorted(whole["shingle"], whole["shingle"][-1]))
                yield from flush({c: v[:cut] for c, v in whole.items()})
                held, rows = [{c: v[cut:] for c, v in whole.items()}], len(whole["shingle"]) - cut
        if rows:
            yield from flush({c: np.concatenate([h[c] for h in held]) for c in held[0]})

    return lists.mapInArrow(run, "a long, b long, shingle long, n int, pos int")


def of_wanted(ids: DataFrame, docs: DataFrame, doc_id: str, text: str, make, schema: str) -> DataFrame:
    """A written table of make(ids, sets) for the documents in ``ids`` (doc, without repeats), and perhaps a few more.

    Up to 2**25 documents a bitmap of a byte for each, 32 MB at most, passes over most others; beyond that
    the texts are joined with the ids.
    """
    n = ids.count()

    def made(batches):
        for batch in batches:
            for part in byte_slices(batch, text, 1 << 18):
                yield make(part.column(doc_id), shingle_sets(["" if t is None else t for t in part.column(text).to_pylist()]))
        released()

    known = docs.filter(F.col(doc_id).isNotNull()).select(doc_id, text)
    if n > 1 << 25:
        return written(known.join(ids.select(F.col("doc").alias(doc_id)), doc_id, "left_semi").mapInArrow(made, schema))
    bits = 1 << max(16, int(np.ceil(np.log2(8 * max(n, 1)))))
    stretch = min(bits, 1 << 16)

    def places(batch, column):
        return (splitmix(batch.column(column).to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)) % np.uint64(bits)).astype(np.int64)

    def marks(batches):
        held: dict[int, np.ndarray] = {}
        for batch in batches:
            at = places(batch, "doc")
            for c in np.unique(at // stretch).tolist():
                held.setdefault(c, np.zeros(stretch, dtype=bool))[at[at // stretch == c] % stretch] = True
        if held:
            yield record(c=np.array(list(held), dtype=np.int64), m=pa.array([np.packbits(v).tobytes() for v in held.values()], pa.binary()))

    bitmap = np.zeros((bits // stretch, stretch // 8), dtype=np.uint8)
    for r in ids.select("doc").mapInArrow(marks, "c long, m binary").toLocalIterator():
        bitmap[r["c"]] |= np.frombuffer(r["m"], np.uint8)
    shared = Shared(docs.sparkSession, bitmap.ravel())

    def rows(batches):
        for batch in batches:
            at = places(batch, doc_id)
            wanted = (shared.value[at >> 3] >> (7 - (at & 7)).astype(np.uint8)) & 1 == 1
            if wanted.any():
                yield from made([batch.filter(pa.array(wanted))])

    return written(known.mapInArrow(rows, schema))


def joined(pairs: DataFrame, table: DataFrame, column: str) -> DataFrame:
    """(a, b, x, y): the column of the table for both documents of each pair."""
    first = pairs.join(table.select(F.col("doc").alias("b"), F.col(column).alias("y")), "b")
    return first.join(table.select(F.col("doc").alias("a"), F.col(column).alias("x")), "a").select("a", "b", "x", "y")


def kept_pairs(rows: DataFrame, test) -> DataFrame:
    def run(batches):
        for batch in batches:
            ok = [test(x.as_buffer(), y.as_buffer()) for x, y in zip(batch.column("x"), batch.column("y"), strict=True)]
            keep = batch.filter(pa.array(ok, pa.bool_()))
            yield record(a=keep.column("a"), b=keep.column("b"))

    return rows.mapInArrow(run, "a long, b long").distinct()


def histogram(s: np.ndarray) -> bytes:
    """Counts of the hashes by their highest bits: a byte a cell, or four where that is too small.

    Up to 128 hashes have about as many cells as half of them, from 512 on an eighth to a quarter: unrelated
    sets of n hashes in n / 8 cells share 0.80 n at most by these counts, and 0.89 n are asked for.
    """
    bits = int(np.ceil(np.log2(max(len(s), 2))))
    k = max(4, min(bits - 1, 6), bits - 3)
    count = np.bincount((s >> np.uint64(64 - k)).astype(np.int64), minlength=1 << k)
    return bytes((k,)) + count.astype(np.uint8 if count.max(initial=0) < 256 else np.uint32).tobytes()


def cells(raw) -> tuple[int, np.ndarray]:
    raw = memoryview(raw)
    k, rest = raw[0], raw[1:]
    return k, np.frombuffer(rest, np.uint8 if len(rest) == 1 << k else np.uint32).astype(np.int64)


def likely(pairs: DataFrame, docs: DataFrame, config: JaccardConfig, doc_id: str, text: str) -> DataFrame:
    """The pairs (a, b) that histograms of the hashes, which bound the intersection from above, do not rule out."""
    percent = config.percent

    def could(x, y) -> bool:
        (k, p), (m, q) = cells(x), cells(y)
        if k < m:
            q = q.reshape(1 << k, -1).sum(1)
        elif m < k:
            p = p.reshape(1 << m, -1).sum(1)
        most = int(np.minimum(p, q).sum())
        return 100 * most >= percent * (int(p.sum()) + int(q.sum()) - most)

    wanted = pairs.select(F.col("a").alias("doc")).unionByName(pairs.select(F.col("b").alias("doc"))).distinct()
    sketches = of_wanted(wanted, docs, doc_id, text, lambda ids, sets: record(doc=ids, h=pa.array([histogram(s) for s in sets], pa.binary())), "doc long, h binary")
    out = written(kept_pairs(joined(pairs, sketches, "h"), could))
    dropped(docs.sparkSession, sketches)
    return out


@dataclass
class ShardIndex:
    """Inverted lists of a shard: ``postings`` are list and document in one number, sorted, so that each list is a stretch in order of its documents."""

    docs: np.ndarray
    sizes: np.ndarray
    keys: np.ndarray
    begin: np.ndarray
    postings: np.ndarray
    percent: int
    mu: float
    pops: int = 0
    probes: int = 0
    roots: dict = field(default_factory=dict)

    @classmethod
    def build(cls, docs: list[int], sets: list[np.ndarray], percent: int, mu: float) -> ShardIndex:
        sizes = np.array([len(s) for s in sets], dtype=np.int64)
        shingle, doc = np.concatenate([*sets, np.empty(0, np.uint64)]), np.repeat(np.arange(len(sets)), sizes)
        keys, place = np.unique(shingle, return_inverse=True)
        postings = np.sort(place.astype(np.int64) << 32 | doc)
        return cls(np.array(docs, dtype=np.int64), sizes, keys, np.append(np.searchsorted(postings, np.arange(len(keys)) << 32), len(postings)), postings, percent, mu)

    def merged(self, lists: list[list[int]], least: int) -> list[tuple[int, int]]:
        """(document, occurrences) of documents in ``least`` of the lists or more: a heap of the lists' heads, that skips what cannot reach it."""
        heap = [(own[0], k, 0) for k, own in enumerate(lists)]
        heapq.heapify(heap)
        out = []
        while len(heap) >= least:
            head, popped = heap[0][0], []
            while heap and heap[0][0] == head:
                popped.append(heapq.heappop(heap))
            self.pops += len(popped)
            if len(popped) >= least:
                out.append((head, len(popped)))
                target = head + 1
            else:
                # with less than ``least`` lists out of the way nothing below the next head can reach the count
                while heap and len(popped) < least - 1:
                    popped.append(heapq.heappop(heap))
                    self.pops += 1
                if not heap:
                    break
                target = max(heap[0][0], head + 1)
            for _, k, at in popped:
                at = bisect_left(lists[k], target, at)
                if at < len(lists[k]):
                    heapq.heappush(heap, (lists[k][at], k, at))
        return out

    def search(self, s: np.ndarray) -> list[int]:
        """Documents of the shard that link with the set ``s``, by DivideSkip."""
        n = len(s)
        least = -(-self.percent * n // 100)
        at = np.minimum(np.searchsorted(self.keys, s), max(len(self.keys) - 1, 0))
        found = at[self.keys[at] == s] if len(self.keys) else at[:0]
        if len(found) < least or not n:
            return []
        length = self.begin[found + 1] - self.begin[found]
        found = found[np.argsort(length, kind="stable")]
        # the long lists are left to binary search; one occurrence at least must come from the merge
        long = max(0, min(least - 1, int(least / (self.mu * np.log2(length.max()) + 1))))
        short, rest = found[: len(found) - long], found[len(found) - long :]
        lists = [(self.postings[a:b] & 0xFFFFFFFF).tolist() for a, b in zip(self.begin[short].tolist(), self.begin[short + 1].tolist(), strict=True)]
        out = []
        for doc, seen in self.merged(lists, least - long):
            need = -(-self.percent * (n + int(self.sizes[doc])) // (100 + self.percent))
            if seen + len(rest) < need:
                continue
            wanted = rest << 32 | doc
            place = np.minimum(np.searchsorted(self.postings, wanted), len(self.postings) - 1)
            self.probes += len(wanted)
            both = seen + int((self.postings[place] == wanted).sum())
            if 100 * both >= self.percent * (n + int(self.sizes[doc]) - both):
                out.append(doc)
        return out

    def root(self, x: int) -> int:
        while (up := self.roots.get(x, x)) != x:
            self.roots[x] = x = self.roots.get(up, up)
        return x

    def links(self, probe: int, s: np.ndarray) -> list[int]:
        """Ids of documents that ``probe`` links with, without those that links of this shard have joined with it before."""
        out = []
        for doc in self.search(s):
            other = int(self.docs[doc])
            x, y = self.root(probe), self.root(other)
            if x != y:
                self.roots[max(x, y)] = min(x, y)
                out.append(other)
        return out


def answered(routes: DataFrame, docs: DataFrame, config: JaccardConfig, doc_id: str, text: str) -> DataFrame:
    """Links (a, b) of routes: kind 0: document a is indexed in its shard; 1: probe a asks shard ``shard``."""
    percent, mu = config.percent, config.mu
    sets = None
    if routes.count() <= 1 << 19:
        # few enough for every task: sets go from their texts to the shards at once
        to = F.broadcast(routes.groupBy("a").agg(F.collect_list(F.struct("shard", "kind")).alias("to")))
        texts = docs.filter(F.col(doc_id).isNotNull()).select(F.col(doc_id).alias("a"), F.col(text).alias("text")).join(to, "a")

        def made(batches):
            for batch in batches:
                for part in byte_slices(batch, "text", 1 << 18):
                    n, own = [], []
                    for raw, out in zip((s.tobytes() for s in shingle_sets(["" if t is None else t for t in part.column("text").to_pylist()])), part.column("to").to_pylist(), strict=True):
                        n.append(len(out))
                        own += [(raw, r["shard"], r["kind"]) for r in out]
                    raw, shard, kind = zip(*own, strict=True)
                    ids = np.repeat(part.column("a").to_numpy(), n)
                    for k in range(0, len(own), 512):
                        yield record(a=ids[k : k + 512], s=pa.array(raw[k : k + 512], pa.binary()), shard=np.array(shard[k : k + 512], np.int32), kind=np.array(kind[k : k + 512], np.int32))
            released()

        sent = texts.mapInArrow(made, "a long, s binary, shard int, kind int")
    else:
        sets = of_wanted(routes.select(F.col("a").alias("doc")).distinct(), docs, doc_id, text, lambda ids, own: record(doc=ids, s=pa.array([s.tobytes() for s in own], pa.binary())), "doc long, s binary")
        sent = routes.join(sets.withColumnRenamed("doc", "a"), "a")
    sent = sent.repartition("shard").sortWithinPartitions("shard", "kind", "a")

    def rows(batches):
        shard, index, own_ids, own_sets, a, b = None, None, [], [], [], []
        for batch in batches:
            for sh, kind, doc, raw in zip(batch.column("shard").to_pylist(), batch.column("kind").to_pylist(), batch.column("a").to_pylist(), batch.column("s"), strict=True):
                if sh != shard:
                    shard, index, own_ids, own_sets = sh, None, [], []
                s = np.frombuffer(raw.as_buffer(), np.uint64)
                if kind == 0:
                    own_ids.append(doc)
                    own_sets.append(s)
                    continue
                if index is None:
                    index = ShardIndex.build(own_ids, own_sets, percent, mu)
                    own_ids, own_sets = [], []
                for other in index.links(doc, s):
                    a.append(min(doc, other))
                    b.append(max(doc, other))
            if a:
                yield record(a=np.array(a, np.int64), b=np.array(b, np.int64))
                a, b = [], []
        released()

    out = written(sent.select("shard", "kind", "a", "s").mapInArrow(rows, "a long, b long").distinct())
    if sets is not None:
        dropped(docs.sparkSession, sets)
    return out


def shard_of(column: str, shards: int):
    return F.pmod(F.xxhash64(column), F.lit(shards)).cast("int")


def routed(pairs: DataFrame, config: JaccardConfig) -> DataFrame:
    """Routes of pairs (probe a, document b), each document in the shard of its id."""
    own = pairs.select(F.col("b").alias("a")).distinct()
    shards = max(1, own.count() // config.shard)
    return written(own.select("a", shard_of("a", shards).alias("shard"), F.lit(0).alias("kind")).unionByName(pairs.select("a", shard_of("b", shards).alias("shard"), F.lit(1).alias("kind")).distinct()))


def verified(pairs: DataFrame, docs: DataFrame, config: JaccardConfig, doc_id: str, text: str) -> DataFrame:
    """Links of the pairs (probe a, document b); links with other documents of a shard may come with them."""
    left = likely(pairs, docs, config, doc_id, text)
    routes = routed(left, config)
    out = answered(routes, docs, config, doc_id, text)
    dropped(docs.sparkSession, left, routes)
    return out


def jaccard_links(docs: DataFrame, config: JaccardConfig = JaccardConfig(), doc_id="doc_id", text="text") -> tuple[DataFrame, DataFrame, DataFrame]:
    """A written table, (doc, n) of every row in it, and links (a, b) whose components are those of all links."""
    spark = docs.sparkSession
    docs = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    table = written(sizes_and_counts(docs, "doc_id", "text"))
    sizes = table.filter(F.col("shingle").isNull()).select("doc", "n", "sig")
    met = table.filter(F.col("shingle").isNotNull()).groupBy("shingle").agg(F.sum("n").alias("n"))
    top = met.orderBy(F.desc("n"), "shingle").limit(config.hottest).toArrow()
    order = Order(top.column("shingle").to_numpy().view(np.uint64), top.column("n").to_numpy())
    lists = written(short_lists(docs, order, config, "doc_id", "text"))
    cold = lists.filter(~F.col("hot")).select("shingle", "doc", "n", "pos", "typical").repartition("shingle").sortWithinPartitions("shingle")
    first = written(merged_lists(cold, config))
    # hot lists are not brought together: each has one centre, at most ``hottest`` in all
    hot = lists.filter("hot")
    centres = F.broadcast(hot.groupBy("shingle").agg(F.max(F.struct("typical", (-F.col("doc")).alias("d"), "n", "pos")).alias("c")).select("shingle", (-F.col("c.d")).alias("cd"), F.col("c.n").alias("cn"), F.col("c.pos").alias("cp")))
    met_centre = hot.join(centres, "shingle").filter((F.col("doc") != F.col("cd")) & fits("n", "cn", "pos", "cp", config.percent))
    pairs = first.filter("b is not null").select("a", "b").unionByName(met_centre.select(F.col("doc").alias("a"), F.col("cd").alias("b")))
    pairs = written(pairs.distinct())
    same = sizes.filter(F.col("sig").isNotNull() & F.col("doc").isNotNull()).select("sig", "doc")
    least = same.groupBy("sig").agg(F.min("doc").alias("m"), F.max("doc").alias("x")).filter("m != x").select("sig", "m")
    copies = same.join(least, "sig").filter("doc != m").select(F.col("m").alias("a"), F.col("doc").alias("b"))
    links = written(verified(pairs, docs, config, "doc_id", "text").unionByName(copies))
    # long lists: members that no link joins yet probe the members of other components
    members = first.filter("b is null").select("shingle", F.col("a").alias("doc"), "n", "pos").unionByName(hot.select("shingle", "doc", "n", "pos"))
    more = unjoined(members, components(links), pairs, docs, config)
    for found in more:
        links = links.unionByName(found)
    dropped(spark, lists, first, pairs)
    return table, sizes.select("doc", "n"), links


def fits(na: str, nb: str, pa_: str, pb: str, percent: int):
    a, b = F.col(na).cast("long"), F.col(nb).cast("long")
    need = F.ceil((a + b) * percent / (100 + percent))
    return (F.least(a, b) * 100 >= F.greatest(a, b) * percent) & (F.least(a - F.col(pa_), b - F.col(pb)) >= need)


def unjoined(members: DataFrame, labels: DataFrame, tested: DataFrame, docs: DataFrame, config: JaccardConfig) -> list[DataFrame]:
    """Links between members of one list in different components that were not compared, and could link."""
    own = written(members.join(labels.withColumnRenamed("node", "doc"), "doc", "left").withColumn("component", F.coalesce("component", "doc")))
    # the largest component of a list stays where it is; the others look for partners
    per = written(own.groupBy("shingle", "component").agg(F.count("*").alias("k")))
    largest = per.groupBy("shingle").agg(F.max(F.struct("k", "component")).alias("m"), F.sum("k").alias("all"), F.count("*").alias("kinds")).filter("kinds > 1")
    largest = largest.select("shingle", F.col("m.component").alias("largest"), (F.col("all") > config.crowd).alias("crowded"))
    open_ = written(own.join(largest, "shingle"))
    out = []
    if not open_.isEmpty():
        few = open_.filter("not crowded")
        seek = few.filter("component != largest").select("shingle", F.col("doc").alias("d2"), F.col("n").alias("n2"), F.col("pos").alias("p2"), F.col("component").alias("c2"))
        met = few.join(seek, "shingle").filter((F.col("component") != F.col("c2")) & ((F.col("component") == F.col("largest")) | (F.col("doc") < F.col("d2"))) & fits("n", "n2", "pos", "p2", config.percent))
        same = F.struct(F.least("a", "b"), F.greatest("a", "b"))
        before = tested.select(same.alias("x")).distinct()
        pairs = written(met.select(F.col("d2").alias("a"), F.col("doc").alias("b")).distinct().withColumn("x", same).join(before, "x", "left_anti").select("a", "b"))
        if not pairs.isEmpty():
            out.append(verified(pairs, docs, config, "doc_id", "text"))
        dropped(docs.sparkSession, pairs)
        many = open_.filter("crowded")
        if not many.isEmpty():
            out.append(searched_shards(many, docs, config))
    dropped(docs.sparkSession, own, per, open_)
    return out


def shards_by_size(members: DataFrame, config: JaccardConfig) -> DataFrame:
    """(doc, shard) of the members (doc, n): a shard holds documents of about one size, ``shard`` of them and ``load`` shingles at most, about."""
    near = members.withColumn("size", F.floor(F.log(F.col("n").cast("double")) / F.log(F.lit(max(100 / config.percent, 1.01)))).cast("int"))
    # one row for each power of 100 / percent
    kinds = near.groupBy("size").agg(F.count("*").alias("m"), F.sum("n").alias("all")).orderBy("size").collect()
    # every probe meets long lists here: smaller shards as long as they are few, so that more tasks share the work
    spread = min(8 * sum(r["m"] for r in kinds) // config.shard, 64) / max(1, sum(r["m"] for r in kinds))
    parts, total = [], 0
    for r in kinds:
        own = max(1, -(-r["m"] // config.shard), -(-r["all"] // config.load), int(spread * r["m"]))
        parts.append((r["size"], own, total))
        total += own
    dealt = near.join(F.broadcast(members.sparkSession.createDataFrame(parts, "size int, parts int, first int")), "size")
    return dealt.select("doc", (F.col("first") + F.pmod(F.xxhash64("doc"), F.col("parts"))).cast("int").alias("shard")).distinct()


def asked_shards(many: DataFrame, dealt: DataFrame, config: JaccardConfig) -> DataFrame:
    """Routes (probe a, shard): the shard holds a member of a list of the probe whose size and place there could allow a link."""
    percent = config.percent
    held = many.join(dealt, "doc").groupBy("shingle", "shard").agg(F.min("n").alias("lo"), F.max("n").alias("hi"), F.max(F.col("n") - F.col("pos")).alias("left"))
    seek = many.filter("component != largest").select("shingle", F.col("doc").alias("a"), "n", "pos")
    n, lo = F.col("n").cast("long"), F.col("lo").cast("long")
    need = F.ceil((n + lo) * percent / (100 + percent))
    could = (n * 100 >= lo * percent) & (F.col("hi").cast("long") * 100 >= n * percent) & (n - F.col("pos") >= need) & (F.col("left") >= need)
    return seek.join(held, "shingle").filter(could).select("a", "shard").distinct()


def likely_shards(asks: DataFrame, dealt: DataFrame, docs: DataFrame, config: JaccardConfig) -> DataFrame:
    """The routes (a, shard) of ``asks`` to shards that hold a document which the histograms do not rule out.

    Histograms travel in place of the sets, a thirtieth of their size; a crowd gives a row for each probe and shard, not for each pair.
    """
    percent = config.percent
    held = dealt.join(asks.select("shard").distinct(), "shard").select(F.col("doc").alias("a"), "shard", F.lit(0).alias("kind"))
    routes = written(held.unionByName(asks.select("a", "shard", F.lit(1).alias("kind"))))
    sketches = of_wanted(routes.select(F.col("a").alias("doc")).distinct(), docs, "doc_id", "text", lambda ids, sets: record(doc=ids, h=pa.array([histogram(s) for s in sets], pa.binary())), "doc long, h binary")
    sent = routes.join(sketches.withColumnRenamed("doc", "a"), "a").repartition("shard").sortWithinPartitions("shard", "kind", "a")

    def rows(batches):
        shard, own, by = None, {}, {}

        def matrix(k: int, to: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
            """Ids, cells (in 2**to of them) and sizes of the shard's documents with 2**k cells."""
            if (k, to) not in by:
                ids, cs = zip(*own[k], strict=True)
                full = np.stack(cs)
                by[k, to] = np.array(ids), full.reshape(len(cs), 1 << to, -1).sum(2), full.sum(1)
            return by[k, to]

        for batch in batches:
            a, shards = [], []
            for sh, kind, doc, raw in zip(batch.column("shard").to_pylist(), batch.column("kind").to_pylist(), batch.column("a").to_pylist(), batch.column("h"), strict=True):
                if sh != shard:
                    shard, own, by = sh, {}, {}
                m, p = cells(raw.as_buffer())
                if kind == 0:
                    own.setdefault(m, []).append((doc, p))
                    continue
                for k in own:
                    to = min(k, m)
                    ids, q, sizes = matrix(k, to)
                    most = np.minimum(p.reshape(1 << to, -1).sum(1), q).sum(1)
                    if ((100 * most >= percent * (int(p.sum()) + sizes - most)) & (ids != doc)).any():
                        a.append(doc)
                        shards.append(sh)
                        break
            if a:
                yield record(a=np.array(a, np.int64), shard=np.array(shards, np.int32))
        released()

    out = written(sent.select("shard", "kind", "a", "h").mapInArrow(rows, "a long, shard int"))
    dropped(docs.sparkSession, routes, sketches)
    return out


def searched_shards(many: DataFrame, docs: DataFrame, config: JaccardConfig) -> DataFrame:
    """Links among the members of crowded lists: each probes the shards that hold members of its lists which could link."""
    dealt = written(shards_by_size(many.select("doc", "n").distinct(), config))
    asks = written(asked_shards(many, dealt, config))
    left = likely_shards(asks, dealt, docs, config)
    held = dealt.join(left.select("shard").distinct(), "shard").select(F.col("doc").alias("a"), "shard", F.lit(0).alias("kind"))
    routes = written(held.unionByName(left.select("a", "shard", F.lit(1).alias("kind"))))
    out = answered(routes, docs, config, "doc_id", "text")
    dropped(docs.sparkSession, dealt, asks, left, routes)
    return out


def jaccard_join(docs: DataFrame, config: JaccardConfig = JaccardConfig(), doc_id="doc_id", text="text") -> DataFrame:
    """doc_id, n_shingles, component_id (smallest id reachable by links) for every row."""
    _, sizes, links = jaccard_links(docs, config, doc_id, text)
    found = components(links).withColumnRenamed("node", "doc")
    return sizes.join(found, "doc", "left").select(F.col("doc").alias("doc_id"), F.col("n").alias("n_shingles"), F.coalesce("component", "doc").alias("component_id"))


def drop_near_copies(docs: DataFrame, config: JaccardConfig = JaccardConfig(), doc_id="doc_id", text="text") -> DataFrame:
    """One document of each component stays, the one with the smallest id; rows without an id stay."""
    found = jaccard_join(docs, config, doc_id, text)
    gone = written(found.filter("doc_id != component_id").select(F.col("doc_id").alias(doc_id)).distinct())
    return docs.join(gone, doc_id, "left_anti").select(*docs.columns)
